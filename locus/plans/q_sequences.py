"""Queries on sequences, their statistics and Markov chains, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from locus.functions import seq as fn
from locus.operators import features as ft
from locus.operators import markov as mk
from locus.operators import seqstats as ss
from locus.plans import standins as st

TYPES = ["de", "en", "es", "fr"]
#: The order of the Markov chains and the length of a generated sequence are production values.
L, K, SAMPLE = 200, 6, 1000


def seqs(s, d):
    return st.sequences(s, d)


def tiles(s, d):
    return st.tiles(s, d, L)


def rounded(df, *keep):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def spans_of(word, width):
    return F.transform(F.filter(fn.occurrences(F.col("seq"), word), lambda i: i + width <= F.length("seq")), lambda i: F.struct(i.alias("start"), (i + width).alias("end")))


def stats_rows(s, d):
    base = seqs(s, d).withColumn("n_bases", F.length("seq"))
    z, m = (ft.fit_normalisation(base, ["n_chars", "n_bases"], x) for x in ("zscore", "minmax"))
    return z.unionByName(m).select("method", "features", *[F.transform(c, lambda x: F.round(x, 6)).alias(c) for c in ("center", "scale")])


def conditions(s, d):
    base = seqs(s, d).withColumn("n_bases", F.length("seq"))
    out = ft.condition_vectors(base, ft.fit_normalisation(base, ["n_chars", "n_bases"]), TYPES, ["n_chars", "n_bases"])
    return out.select("seq_id", F.transform("condition", lambda x: F.round(x, 6)).alias("condition"))


def compare(s, d):
    """Every language against English and random sequences of English lengths."""
    rows = ss.with_control(seqs(s, d), "cell_type", "en", 3)
    return rounded(ss.realism_of_pools(ss.realism_profiles(rows, "doc_id", "cell_type"), "cell_type", "en"))


def entropies(s, d):
    counts = ss.kmer_tables(seqs(s, d), [2, 4, 6])
    return rounded(counts.groupBy("k").agg(ss.entropy_of(F.col("n")).alias("entropy")))


def samples(s, d):
    base = seqs(s, d)
    return mk.markov_sample(base.select(F.col("seq_id").alias("sample_id")), mk.markov_fit(base, K), mk.markov_prefixes(base, K), K, SAMPLE, 5)


def queries():
    def qc(s, d):
        return ft.window_qc(st.tiles(s, d, L, "ACGTN"), L, 0.36)[1]

    return {
        "one_hot": lambda s, d: st.tiles(s, d, L, "ACGTN").select("seq_id", fn.one_hot(F.col("seq")).cast("array<double>").alias("tensor")),
        "decode_one_hot": lambda s, d: st.tiles(s, d, L, "ACGTN").withColumn("tensor", fn.one_hot(F.col("seq"))).select("seq_id", fn.decode_one_hot(F.col("tensor")).alias("seq")),
        "fit_normalisation": stats_rows,
        "condition_vectors": conditions,
        "filter_sequence_length": lambda s, d: ft.filter_sequence_length(st.tiles(s, d, L), L).select("seq_id", "seq"),
        "window_qc": qc,
        "gc_fraction": lambda s, d: rounded(seqs(s, d).select("seq_id", fn.gc_fraction(F.col("seq")).alias("gc"))),
        "cpg_count": lambda s, d: seqs(s, d).select("seq_id", fn.cpg_count(F.col("seq")).alias("cpg")),
        "cpg_obs_exp": lambda s, d: rounded(seqs(s, d).select("seq_id", fn.cpg_obs_exp(F.col("seq")).alias("cpg_oe"))),
        "longest_run": lambda s, d: seqs(s, d).select("seq_id", fn.longest_run(F.col("seq")).alias("run")),
        "gc_content": lambda s, d: rounded(ss.gc_content(seqs(s, d))),
        "kmer_entropy": entropies,
        "cpg_obs_exp_pool": lambda s, d: rounded(ss.cpg_obs_exp_pool(seqs(s, d), "doc_id")),
        "median_longest_run": lambda s, d: ss.median_longest_run(seqs(s, d)),
        "realism_profile": lambda s, d: rounded(ss.realism_profile(seqs(s, d), "doc_id")),
        "realism_compare": compare,
        "random_control": lambda s, d: ss.random_control(seqs(s, d), 3).select("seq_id", "seq"),
        "swap_dinucleotides": lambda s, d: tiles(s, d).select("seq_id", fn.swap_dinucleotides(F.col("seq"), "GC", 3, 1, F.col("seq_id")).alias("x")).select("seq_id", "x.seq", "x.swaps"),
        "shuffle_spans": lambda s, d: tiles(s, d).select("seq_id", fn.shuffle_spans(F.col("seq"), spans_of("TAC", 9), 2, F.col("seq_id")).alias("seq")),
        "control_spans": lambda s, d: tiles(s, d).select("seq_id", F.explode(fn.control_spans(spans_of("TAC", 9), F.length("seq"), 4, F.col("seq_id"))).alias("x")).select("seq_id", "x.*"),
        "occlude_tiles": lambda s, d: tiles(s, d).withColumn("start", F.explode(F.sequence(F.lit(0), F.length("seq") - 1, F.lit(60)))).select("seq_id", "start", fn.occlude(F.col("seq"), F.col("start"), 60, 7, F.col("seq_id")).alias("seq")),
        "markov_fit": lambda s, d: rounded(mk.markov_fit(seqs(s, d), K)),
        "markov_prefixes": lambda s, d: mk.markov_prefixes(seqs(s, d), 4),
        "markov_sample": samples,
    }


SQ = st.sequences_sql()
TL = st.tiles_sql(L)
TN = st.tiles_sql(L, "ACGTN")


def u(seed, *key):
    return f"(('0x' || substr(md5('{seed}:' || " + " || ':' || ".join(key) + "), 1, 8))::BIGINT / 4294967296.0)"


def md5(seed, *key):
    return f"md5('{seed}:' || " + " || ':' || ".join(key) + ")"


def count_of(letters, seq="seq"):
    return f"length(regexp_replace({seq}, '[^{letters}]', '', 'g'))"


CPG = "((length(seq) - length(replace(seq, 'CG', ''))) // 2)"
CHARS = "list_transform(generate_series(1, length(seq)), lambda i: substr(seq, i, 1))"
HOT = "list_concat(" + ", ".join(f"list_transform(c, lambda x: CASE WHEN x = '{b}' THEN 1.0 WHEN x IN ('A', 'C', 'G', 'T') THEN 0.0 ELSE 0.25 END::DOUBLE)" for b in "ACGT") + ")"


def entropy(k, view):
    return f"(SELECT coalesce(log2(sum(n)) - sum(n * log2(n)) / sum(n), 0) FROM (SELECT count(*) AS n FROM (SELECT substr(seq, unnest(generate_series(1, length(seq) - {k - 1})), {k}) AS g FROM {view}) GROUP BY g))"


def gc(view):
    return f"(SELECT coalesce(sum({count_of('GC')}) / sum(length(seq)), 0) FROM {view})"


def oe(view):
    return f"""(SELECT coalesce((sum({CPG} + CASE WHEN seq[-1] = 'C' AND nxt = 'G' THEN 1 ELSE 0 END) / (sum(length(seq)) - 1)) / ((sum({count_of('C')}) / sum(length(seq))) * (sum({count_of('G')}) / sum(length(seq)))), 0)
      FROM (SELECT seq, lead(seq[1]) OVER (ORDER BY doc_id) AS nxt FROM {view} WHERE length(seq) > 0))"""


def runs(view):
    """Longest run of each sequence by gaps and islands; empty sequences have 0."""
    return f"""(SELECT s.doc_id, s.seq_id, coalesce(r.run, 0) AS run FROM {view} s LEFT JOIN (SELECT doc_id, max(n)::INTEGER AS run FROM (SELECT doc_id, isl, count(*) AS n FROM (SELECT doc_id, i,
      sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS isl FROM (SELECT doc_id, i, CASE WHEN c = lag(c) OVER (PARTITION BY doc_id ORDER BY i) THEN 0 ELSE 1 END AS new
      FROM (SELECT doc_id, i, substr(seq, i, 1) AS c FROM (SELECT doc_id, seq, unnest(generate_series(1, length(seq))) AS i FROM {view}))))
      GROUP BY doc_id, isl) GROUP BY doc_id) r USING (doc_id))"""


def median(view):
    return f"(SELECT run FROM (SELECT run, row_number() OVER (ORDER BY run) AS k, count(*) OVER () AS n FROM {runs(view)}) WHERE k = n // 2 + 1)"


def profile(view, digits=6):
    r = (lambda x: f"round({x}, {digits})") if digits else (lambda x: x)
    return f"SELECT (SELECT count(*) FROM {view}) AS n, {r(gc(view))} AS gc, {r(entropy(2, view))} AS entropy_2, {r(entropy(4, view))} AS entropy_4, {r(entropy(6, view))} AS entropy_6, {r(oe(view))} AS cpg_oe, {median(view)} AS median_run"


RANDOM = "SELECT doc_id, seq_id, coalesce(array_to_string(list_transform(generate_series(0, length(seq) - 1), lambda i: substr('ACGT', 1 + floor(" + u(3, "seq_id", "i") + " * 4)::INTEGER, 1)), ''), '') AS seq FROM {}"
SPANS = f"spans AS (SELECT seq_id, seq, unnest(list_filter(generate_series(0, length(seq) - 9), lambda i: substr(seq, i + 1, 3) = 'TAC')) AS start FROM tiles)"
FIT = f"""counts AS (SELECT substr(g, 1, {K}) AS context, substr(g, {K + 1}, 1) AS base, count(*) AS n FROM (SELECT substr(seq, unnest(generate_series(1, length(seq) - {K})), {K + 1}) AS g FROM sequences) GROUP BY ALL),
fit AS (SELECT context, base, coalesce(n, 0) AS n, (coalesce(n, 0) + 1.0) / (sum(coalesce(n, 0)) OVER (PARTITION BY context) + 4.0) AS p
  FROM (SELECT DISTINCT context, unnest(['A', 'C', 'G', 'T']) AS base FROM counts) LEFT JOIN counts USING (context, base))"""
LANGS = [t for t in TYPES if t != "en"]
UNPIVOT = " UNION ALL ".join(f"SELECT '{m}' AS metric, a.{m}::DOUBLE AS generated, b.{m}::DOUBLE AS reference, c.{m}::DOUBLE AS control FROM a, b, c" for m in ss.METRICS)

REALISM = f"""WITH {SQ}, rnd AS ({RANDOM.format("sequences WHERE cell_type = 'en'")}), b AS ({profile("(SELECT * FROM sequences WHERE cell_type = 'en')", 0)}), c AS ({profile('rnd', 0)}),
  m AS (""" + " UNION ALL ".join(f"SELECT '{t}' AS cell_type, * FROM (WITH a AS ({profile(f"(SELECT * FROM sequences WHERE cell_type = '{t}')", 0)}) {UNPIVOT})" for t in LANGS) + """)
  SELECT cell_type, metric, round(generated, 6) AS generated, round(reference, 6) AS reference, round(control, 6) AS control, round(1 - (generated - reference) / (control - reference), 6) AS realism FROM m WHERE abs(control - reference) >= 1e-12"""


def oracle_sql():
    return {
        "one_hot": f"WITH {TN}, c AS (SELECT seq_id, {CHARS} AS c FROM tiles) SELECT seq_id, {HOT} AS tensor FROM c",
        "decode_one_hot": f"WITH {TN} SELECT seq_id, seq FROM tiles",
        "fit_normalisation": f"""WITH {SQ}, b AS (SELECT n_chars, length(seq) AS n_bases FROM sequences)
          SELECT 'zscore' AS method, ['n_chars', 'n_bases'] AS features, [round(avg(n_chars), 6), round(avg(n_bases), 6)] AS center, [round(stddev_pop(n_chars), 6), round(stddev_pop(n_bases), 6)] AS scale FROM b
          UNION ALL SELECT 'minmax', ['n_chars', 'n_bases'], [min(n_chars)::DOUBLE, min(n_bases)::DOUBLE], [(max(n_chars) - min(n_chars))::DOUBLE, (max(n_bases) - min(n_bases))::DOUBLE] FROM b""",
        "condition_vectors": f"""WITH {SQ}, b AS (SELECT seq_id, cell_type, n_chars, length(seq) AS n_bases FROM sequences), s AS (SELECT avg(n_chars) AS a, stddev_pop(n_chars) AS sa, avg(n_bases) AS b, stddev_pop(n_bases) AS sb FROM b)
          SELECT seq_id, [{', '.join(f"(cell_type = '{t}')::INTEGER::DOUBLE" for t in TYPES)}, round((n_chars - a) / sa, 6), round((n_bases - s.b) / sb, 6)] AS condition FROM b, s""",
        "filter_sequence_length": f"WITH {TL} SELECT seq_id, seq FROM tiles WHERE length(seq) = {L}",
        "window_qc": f"""WITH {TN}, r AS (SELECT CASE WHEN length(seq) <> {L} THEN 'length' WHEN {count_of('N')} / length(seq) > 0.36 THEN 'n_fraction' END AS reason FROM tiles)
          SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY reason""",
        "gc_fraction": f"WITH {SQ} SELECT seq_id, CASE WHEN length(seq) > 0 THEN round({count_of('GC')} / length(seq), 6) END AS gc FROM sequences",
        "cpg_count": f"WITH {SQ} SELECT seq_id, {CPG}::INTEGER AS cpg FROM sequences",
        "cpg_obs_exp": f"WITH {SQ} SELECT seq_id, CASE WHEN {count_of('C')} > 0 AND {count_of('G')} > 0 THEN round({CPG} * length(seq) / ({count_of('C')} * {count_of('G')}), 6) END AS cpg_oe FROM sequences",
        "longest_run": f"WITH {SQ} SELECT seq_id, run FROM {runs('sequences')}",
        "gc_content": f"WITH {SQ} SELECT round({gc('sequences')}, 6) AS gc",
        "kmer_entropy": f"WITH {SQ} " + " UNION ALL ".join(f"SELECT {k}::INTEGER AS k, round({entropy(k, 'sequences')}, 6) AS entropy" for k in (2, 4, 6)),
        "cpg_obs_exp_pool": f"WITH {SQ} SELECT round({oe('sequences')}, 6) AS cpg_oe",
        "median_longest_run": f"WITH {SQ} SELECT {median('sequences')} AS median_run",
        "realism_profile": f"WITH {SQ} {profile('sequences')}",
        "realism_compare": REALISM,
        "random_control": f"WITH {SQ}, r AS ({RANDOM.format('sequences')}) SELECT seq_id, seq FROM r",
        "swap_dinucleotides": f"""WITH {TL}, o AS (SELECT seq_id, seq, list_filter(generate_series(0, length(seq) - 2), lambda i: substr(seq, i + 1, 2) = 'GC') AS at FROM tiles),
          c AS (SELECT seq_id, seq, list_transform(list_sort(list_transform(at, lambda i: {{'k': {md5(1, 'seq_id', 'i')}, 'i': i}}))[1:3], lambda x: x.i) AS ch FROM o)
          SELECT seq_id, array_to_string(list_transform(generate_series(0, length(seq) - 1), lambda i: CASE WHEN list_contains(ch, i) THEN 'C' WHEN list_contains(ch, i - 1) THEN 'G' ELSE substr(seq, i + 1, 1) END), '') AS seq, len(ch)::INTEGER AS swaps FROM c""".replace(" AS at FROM", " AS ats FROM").replace("list_transform(at,", "list_transform(ats,"),
        "shuffle_spans": f"""WITH RECURSIVE {TL}, {SPANS}, sp AS (SELECT seq_id, start, row_number() OVER (PARTITION BY seq_id ORDER BY start) AS k FROM spans),
          f AS (SELECT seq_id, seq, 0::BIGINT AS k FROM tiles UNION ALL SELECT f.seq_id, substr(seq, 1, start) || array_to_string(list_transform(list_sort(list_transform(generate_series(0, 8),
            lambda i: {{'k': {md5(2, 'f.seq_id', 'start', 'i')}, 'c': substr(f.seq, start + i + 1, 1)}})), lambda x: x.c), '') || substr(seq, start + 10), sp.k FROM f JOIN sp ON f.seq_id = sp.seq_id AND sp.k = f.k + 1)
          SELECT seq_id, seq FROM f QUALIFY row_number() OVER (PARTITION BY seq_id ORDER BY k DESC) = 1""",
        "control_spans": f"""WITH RECURSIVE {TL}, {SPANS}, sp AS (SELECT seq_id, start, length(seq) AS len, row_number() OVER (PARTITION BY seq_id ORDER BY start) AS k, list(start) OVER (PARTITION BY seq_id) AS own FROM spans),
          f AS (SELECT seq_id, [-1000] AS got, 0::BIGINT AS k FROM tiles UNION ALL
            SELECT f.seq_id, list_concat(got, list_filter(list_transform(generate_series(0, 99), lambda t: floor({u(4, 'f.seq_id', 'start', 't')} * greatest(1, len - 9))::INTEGER),
              lambda s: len(list_filter(own, lambda o: s < o + 9 AND s + 9 > o)) = 0 AND len(list_filter(got, lambda o: s < o + 9 AND s + 9 > o)) = 0)[1:1]), sp.k FROM f JOIN sp ON f.seq_id = sp.seq_id AND sp.k = f.k + 1),
          e AS (SELECT seq_id, got FROM f QUALIFY row_number() OVER (PARTITION BY seq_id ORDER BY k DESC) = 1)
          SELECT seq_id, start, start + 9 AS "end" FROM (SELECT seq_id, unnest(got) AS start FROM e) WHERE start >= 0""",
        "occlude_tiles": f"""WITH {TL}, t AS (SELECT seq_id, seq, unnest(generate_series(0, length(seq) - 1, 60))::INTEGER AS start FROM tiles)
          SELECT seq_id, start, substr(seq, 1, start) || array_to_string(list_transform(generate_series(0, least(60, length(seq) - start) - 1), lambda i: substr('ACGT', 1 + floor({u(7, 'seq_id', 'start', 'i')} * 4)::INTEGER, 1)), '') || substr(seq, start + 61) AS seq FROM t""",
        "markov_fit": f"WITH {SQ}, {FIT} SELECT context, base, n, round(p, 6) AS p FROM fit",
        "markov_prefixes": f"WITH {SQ} SELECT substr(seq, 1, 4) AS prefix, count(*) AS weight FROM sequences WHERE length(seq) >= 4 GROUP BY ALL",
        "markov_sample": f"""WITH RECURSIVE {SQ}, {FIT}, cum AS (SELECT context, list(c ORDER BY base) AS r FROM (SELECT context, base, sum(p) OVER (PARTITION BY context ORDER BY base) AS c FROM fit) GROUP BY context),
          pre AS (SELECT prefix, sum(w) OVER (ORDER BY prefix) AS upto, sum(w) OVER () AS total FROM (SELECT substr(seq, 1, {K}) AS prefix, count(*) AS w FROM sequences WHERE length(seq) >= {K} GROUP BY ALL)),
          f AS (SELECT seq_id AS sample_id, (SELECT min(prefix) FROM pre WHERE upto > {u(5, 'seq_id', "'prefix'")} * total) AS seq, 0 AS i FROM sequences
            UNION ALL SELECT f.sample_id, f.seq || substr('ACGT', 1 + len(list_filter(coalesce(r, [0.25, 0.5, 0.75, 1.0])[1:3], lambda c: c <= {u(5, 'f.sample_id', 'f.i')})), 1), f.i + 1
            FROM f LEFT JOIN cum ON context = substr(f.seq, f.i + 1, {K}) WHERE f.i < {SAMPLE - K})
          SELECT sample_id, seq FROM f WHERE i = {SAMPLE - K}""",
    }
