"""Queries on scores, rankings and tests, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from locus.functions import seq as fn
from locus.operators import perturb as pt
from locus.operators import ranking as rk
from locus.operators import scoring as sc
from locus.operators import stats as stt
from locus.plans import standins as st
from locus.plans.q_sequences import rounded, u

PANEL = {"ct0": [0, 1, 2, 3, 4], "ct1": [5, 6, 7, 8, 9], "ct2": [10, 11, 12, 13, 14]}
BACK = list(range(40, 50))
N_PERM = 1000


def tracks(s, d):
    return st.table(s, d, "embeddings").select(
        "vec_id", F.concat(F.lit("v"), F.col("vec_id")).alias("seq_id"), F.col("embedding").alias("tracks"), F.concat(F.lit("ct"), F.col("label") % 3).alias("cell_type"), F.col("label").alias("locus")
    )


def scores(s, d):
    return sc.mssi(tracks(s, d), PANEL, BACK).select("vec_id", "seq_id", "locus", "cell_type", F.round("mssi_score", 9).alias("mssi_score"))


def metadata(s, d):
    return st.table(s, d, "embeddings").select(
        F.concat(F.lit("v"), F.col("vec_id")).alias("seq_id"), F.concat(F.lit("chr"), F.col("label")).alias("chrom"), (F.col("vec_id") * 100).alias("start"), (F.col("vec_id") * 100 + 200).alias("end"),
        F.concat(F.lit("ct"), F.col("label") % 3).alias("cell_type"), "vec_id",
    )


def windows(s, d):
    return st.peaks(s, d).select("peak_id", "chrom", "start", "end", "cell_type", "peak_score")


def long_stats(s, d):
    seqs = st.sequences(s, d).join(st.table(s, d, "labels").select("doc_id", "quality"), "doc_id")
    base = seqs.select(
        F.col("doc_id").alias("unit"), F.when(F.col("quality") == 1, "selected").otherwise("rejected").alias("grp"), fn.gc_fraction(F.col("seq")).alias("gc"),
        F.length("seq").cast("double").alias("n_bases"), fn.cpg_obs_exp(F.col("seq")).alias("cpg_oe"),
    )
    return base.unpivot(["unit", "grp"], ["gc", "n_bases", "cpg_oe"], "statistic", "value")


def pvalues(s, d):
    return st.table(s, d, "documents").select(F.concat(F.lit("t"), F.col("doc_id")).alias("statistic"), (((F.col("doc_id") * 7919) % 10007 + 1) / 10007.0).alias("p"))


def variants(s, d):
    two = st.table(s, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("variant"), F.upper("r_name").alias("insert"))
    return two


def custs(s, d):
    return st.table(s, d, "customer").select(F.col("c_custkey").alias("peak_id"), "c_nationkey")


def panel_rows(s, d):
    """A panel per nation: indices from its keys."""
    k, r = F.col("n_nationkey"), F.col("n_regionkey")
    return st.table(s, d, "nation").select(F.col("n_name").alias("cell_type"), F.filter(F.array(k, k * 3), lambda x: r != 1).alias("target"), F.array(r * 6, r + 50).alias("background"))


SCOLS = ["seq_id", "locus", "mssi_score"]


def queries():
    def summary(s, d):
        return rounded(sc.mssi_summary(scores(s, d), "vec_id").select("seq_id", "running_mean", "mean_mssi"))

    def evaluate(s, d):
        return sc.score_with(st.tiles(s, d, 200), st.kmer_linear_standin).select("seq_id", F.col("tracks").cast("array<double>").alias("tracks"))

    def tests(s, d):
        return rounded(stt.selected_vs_rejected(long_stats(s, d), N_PERM, 9))

    return {
        "mssi": lambda s, d: sc.mssi(tracks(s, d), PANEL, BACK).select("seq_id", F.round("mssi_score", 6).alias("mssi_score"), F.transform("target_signal", lambda x: F.round(x, 6)).alias("target_signal")),
        "mssi_summary": summary,
        "bin_mean": lambda s, d: rounded(sc.bin_mean(tracks(s, d).select("seq_id", F.posexplode("tracks")).select("seq_id", (F.col("pos") % 8).alias("track"), F.col("col").cast("double").alias("value")))),
        "attribution_summary": lambda s, d: rounded(sc.attribution_summary(tracks(s, d).withColumnRenamed("tracks", "attribution"))),
        "score_with": evaluate,
        "score_with_locus": lambda s, d: sc.score_with_locus(scores(s, d).select("seq_id", "mssi_score"), metadata(s, d).unionByName(metadata(s, d).withColumns({"start": F.col("start") + 7, "vec_id": F.col("vec_id") + 1})), "vec_id"),
        "track_panel_check": lambda s, d: sc.track_panel_violations(panel_rows(s, d), 55),
        "select_top_k": lambda s, d: rk.select_top_k(scores(s, d).select(SCOLS), metadata(s, d).select("seq_id", "chrom", "start"), 20),
        "select_top_k_per_locus": lambda s, d: rk.select_top_k(scores(s, d).select(SCOLS), metadata(s, d).select("seq_id", "chrom", "start"), 3, ["locus"]),
        "split_tails": lambda s, d: rk.split_tails(scores(s, d).select(SCOLS), 0.2),
        "choose_loci": lambda s, d: rk.choose_loci(windows(s, d), 37, 4),
        "stratified_sample": lambda s, d: rk.stratified_sample(scores(s, d).select(SCOLS), "mssi_score", 30, 10, 6),
        "top_bottom_k": lambda s, d: rk.top_bottom_k(scores(s, d).select(SCOLS), "mssi_score", 15, 12),
        "train_val_split": lambda s, d: rk.train_val_split(scores(s, d).select(SCOLS), 0.13, 8),
        "pick_inserts": lambda s, d: rk.pick_inserts(scores(s, d).select(SCOLS), 25),
        "unmatched_ids": lambda s, d: rk.unmatched_ids(custs(s, d), st.table(s, d, "orders").select(F.col("o_custkey").alias("peak_id")), "peak_id"),
        "join_scores": lambda s, d: rk.join_scores(metadata(s, d).select("seq_id", "chrom"), scores(s, d).select(SCOLS)),
        "filter_measured": lambda s, d: rk.filter_measured(st.sequences(s, d).select("seq_id", "n_chars"), st.table(s, d, "labels").select(F.concat(F.lit("seq"), F.col("doc_id")).alias("seq_id"))),
        "place_inserts": lambda s, d: rk.place_inserts(custs(s, d), variants(s, d), st.table(s, d, "orders").select(F.col("o_custkey").alias("peak_id"))),
        "assign_hosts": lambda s, d: rk.assign_hosts(scores(s, d).select(F.col("seq_id").alias("sample_id")), windows(s, d), 12).select("sample_id", "peak_id", "chrom", "start"),
        "fixed_host": lambda s, d: rk.fixed_host(scores(s, d).select(SCOLS), windows(s, d).withColumn("peak_id", F.concat(F.lit("p"), F.col("peak_id"))), "p5"),
        "selection_report": lambda s, d: rounded(rk.selection_report(scores(s, d), 20, scores(s, d).filter("cell_type = 'ct0'"))),
        "stack_variants": lambda s, d: pt.stack_variants(metadata(s, d).select("seq_id", F.col("cell_type").alias("variant")), intact=scores(s, d).select("seq_id")),
        "permutation_test": lambda s, d: rounded(stt.permutation_test(long_stats(s, d), N_PERM, 9)),
        "bh_fdr": lambda s, d: rounded(stt.bh_fdr(pvalues(s, d))),
        "test_floor": lambda s, d: rounded(stt.test_floor(stt.bh_fdr(pvalues(s, d)), 1000)),
        "selected_vs_rejected": tests,
    }


def mean_of(index):
    return "(" + " + ".join(f"tracks[{i + 1}]::DOUBLE" for i in index) + f") / {len(index)}"


TARGET = "CASE cell_type " + " ".join(f"WHEN '{c}' THEN {mean_of(i)}" for c, i in PANEL.items()) + " END"
TRACKS = "tracks AS (SELECT vec_id, 'v' || vec_id AS seq_id, embedding AS tracks, 'ct' || (label % 3) AS cell_type, label AS locus FROM embeddings)"
SCORES = f"{TRACKS}, scores AS (SELECT vec_id, seq_id, locus, cell_type, round({TARGET} - {mean_of(BACK)}, 9) AS mssi_score FROM tracks)"
META = """meta AS (SELECT 'v' || vec_id AS seq_id, 'chr' || label AS chrom, vec_id * 100 AS start, vec_id * 100 + 200 AS "end", 'ct' || (label % 3) AS cell_type, vec_id FROM embeddings)"""
S = "seq_id, locus, mssi_score"
LONG = f"""{st.sequences_sql()}, b AS (SELECT s.doc_id AS unit, CASE WHEN quality = 1 THEN 'selected' ELSE 'rejected' END AS grp, seq, length(seq) AS n, length(regexp_replace(seq, '[^C]', '', 'g')) AS c, length(regexp_replace(seq, '[^G]', '', 'g')) AS g,
  (length(seq) - length(replace(seq, 'CG', ''))) // 2 AS cg FROM sequences s JOIN labels l ON s.doc_id = l.doc_id),
long AS (SELECT unit, grp, 'gc' AS statistic, CASE WHEN n > 0 THEN (c + g) / n END AS value FROM b UNION ALL SELECT unit, grp, 'n_bases', n FROM b UNION ALL SELECT unit, grp, 'cpg_oe', CASE WHEN c > 0 AND g > 0 THEN cg * n / (c * g) END FROM b),
v AS (SELECT * FROM long WHERE value IS NOT NULL),
seen AS (SELECT statistic, avg(value) FILTER (grp = 'selected') AS mean_selected, avg(value) FILTER (grp = 'rejected') AS mean_rejected, count(*) FILTER (grp = 'selected') AS na FROM v GROUP BY statistic),
pr AS (SELECT v.statistic, perm, value, row_number() OVER (PARTITION BY v.statistic, perm ORDER BY md5('9:' || perm || ':' || unit), unit) <= na AS a FROM v JOIN seen USING (statistic), generate_series(0, {N_PERM - 1}) t(perm)),
pd AS (SELECT statistic, perm, abs(avg(value) FILTER (a) - avg(value) FILTER (NOT a)) AS dist FROM pr GROUP BY ALL),
test AS (SELECT statistic, mean_selected, mean_rejected, mean_selected - mean_rejected AS delta, (SELECT count(*) FROM pd WHERE pd.statistic = seen.statistic AND dist >= abs(mean_selected - mean_rejected) - 1e-12) AS k FROM seen),
tests AS (SELECT statistic, mean_selected, mean_rejected, delta, (k + 1) / ({N_PERM} + 1) AS p FROM test)"""


def bh(view):
    return f"SELECT * EXCLUDE (rank, m), least(1.0, min(p * m / rank) OVER (ORDER BY rank DESC)) AS q FROM (SELECT *, row_number() OVER (ORDER BY p, statistic) AS rank, count(*) OVER () AS m FROM {view})"


PV = "pv AS (SELECT 't' || doc_id AS statistic, ((doc_id * 7919) % 10007 + 1) / 10007.0::DOUBLE AS p FROM documents)"
KM = "[" + ", ".join(f"'{a}{b}'" for a in "ACGT" for b in "ACGT") + "]"


def oracle_sql():
    def w(body, *ctes):
        return f"WITH {', '.join(ctes or (SCORES,))} {body}"

    rs = lambda names: ", ".join(f"round({n}, 6) AS {n}" for n in names.split())
    return {
        "mssi": w(f"SELECT seq_id, round({TARGET} - {mean_of(BACK)}, 6) AS mssi_score, CASE cell_type " + " ".join(f"WHEN '{c}' THEN [{', '.join(f'round(tracks[{i + 1}]::DOUBLE, 6)' for i in x)}]" for c, x in PANEL.items()) + " END AS target_signal FROM tracks", TRACKS),
        "mssi_summary": w("SELECT seq_id, round(avg(mssi_score) OVER (ORDER BY vec_id), 6) AS running_mean, round(avg(mssi_score) OVER (), 6) AS mean_mssi FROM scores"),
        "bin_mean": w("SELECT seq_id, i % 8 AS track, round(avg(tracks[i + 1]::DOUBLE), 6) AS mean FROM (SELECT *, unnest(generate_series(0, len(tracks) - 1))::INTEGER AS i FROM tracks) GROUP BY seq_id, i % 8", TRACKS),
        "attribution_summary": w("SELECT seq_id, round(list_avg(a), 6) AS mean_abs, round(list_max(a), 6) AS max_abs, (list_position(a, list_max(a)) - 1)::INTEGER AS argmax FROM (SELECT seq_id, list_transform(tracks, lambda x: abs(x::DOUBLE)) AS a FROM tracks)", TRACKS),
        "score_with": w(f"SELECT seq_id, list_transform({KM}, lambda m: len(list_filter(generate_series(1, length(seq) - 1), lambda i: substr(seq, i, 2) = m))::DOUBLE) AS tracks FROM tiles", st.tiles_sql(200)),
        "score_with_locus": w("""SELECT s.seq_id, mssi_score, chrom, (start + "end") // 2 AS center, m.cell_type FROM scores s JOIN (SELECT * REPLACE (start + 7 AS start) FROM meta) m USING (seq_id)""", SCORES, META),
        "track_panel_check": """WITH p AS (SELECT n_name AS cell_type, CASE WHEN n_regionkey <> 1 THEN [n_nationkey, n_nationkey * 3] ELSE [] END AS t, [n_regionkey * 6, n_regionkey + 50] AS b FROM nation)
          SELECT cell_type, 'no target' AS problem FROM p WHERE len(t) = 0 UNION ALL SELECT cell_type, 'out of range' FROM p WHERE len(list_filter(list_concat(t, b), lambda i: i < 0 OR i >= 55)) > 0 UNION ALL SELECT cell_type, 'overlap' FROM p WHERE list_has_any(t, b)""",
        "select_top_k": w(f"SELECT {S}, chrom, start FROM (SELECT {S} FROM scores ORDER BY mssi_score DESC, seq_id LIMIT 20) JOIN meta USING (seq_id)", SCORES, META),
        "select_top_k_per_locus": w(f"SELECT {S}, chrom, start FROM (SELECT {S} FROM scores QUALIFY row_number() OVER (PARTITION BY locus ORDER BY mssi_score DESC, seq_id) <= 3) JOIN meta USING (seq_id)", SCORES, META),
        "split_tails": w(f"SELECT {S}, CASE WHEN down <= size THEN 'selected' ELSE 'rejected' END AS tail FROM (SELECT {S}, floor(count(*) OVER (PARTITION BY locus) * 0.2::DOUBLE) AS size, row_number() OVER (PARTITION BY locus ORDER BY mssi_score, seq_id) AS up, row_number() OVER (PARTITION BY locus ORDER BY mssi_score DESC, seq_id DESC) AS down FROM scores WHERE seq_id <> 'real') WHERE down <= size OR up <= size"),
        "choose_loci": f"""WITH {st.PEAKS}, o AS (SELECT peak_id, chrom, start, "end", cell_type, peak_score, row_number() OVER (ORDER BY peak_score, peak_id) - 1 AS r, count(*) OVER () AS n FROM peaks),
          k AS (SELECT i::INTEGER AS stratum, (i * n) // 37 + floor({u(4, 'i')} * (((i + 1) * n) // 37 - (i * n) // 37))::BIGINT AS r FROM (SELECT count(*) AS n FROM peaks), generate_series(0, 36) t(i) WHERE ((i + 1) * n) // 37 > (i * n) // 37)
          SELECT peak_id, chrom, start, "end", cell_type, peak_score, stratum FROM o JOIN k USING (r)""",
        "stratified_sample": w(f"""SELECT {S}, stratum FROM (SELECT *, 'top' AS stratum FROM t UNION ALL SELECT *, 'bottom' FROM b UNION ALL SELECT * FROM (SELECT *, 'random' FROM scores WHERE seq_id NOT IN (SELECT seq_id FROM t UNION ALL SELECT seq_id FROM b) ORDER BY md5('6:' || seq_id), seq_id LIMIT 30))""",
            SCORES, "t AS (SELECT * FROM scores ORDER BY mssi_score DESC, seq_id DESC LIMIT 10)", "b AS (SELECT * FROM scores ORDER BY mssi_score, seq_id LIMIT 10)"),
        "top_bottom_k": w(f"SELECT * FROM (SELECT {S}, 'selected' AS grp FROM scores ORDER BY mssi_score DESC, seq_id DESC LIMIT 15) UNION ALL SELECT * FROM (SELECT {S}, 'rejected' FROM scores ORDER BY mssi_score, seq_id LIMIT 12)"),
        "train_val_split": w(f"SELECT {S}, row_number() OVER (ORDER BY md5('8:' || seq_id), seq_id) <= floor(count(*) OVER () * 0.13::DOUBLE) AS is_val FROM scores"),
        "pick_inserts": w(f"SELECT {S} FROM scores WHERE seq_id <> 'real' ORDER BY seq_id LIMIT 25"),
        "unmatched_ids": "SELECT DISTINCT c_custkey AS peak_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
        "join_scores": w(f"SELECT {S}, chrom FROM meta JOIN (SELECT {S} FROM scores) USING (seq_id)", SCORES, META),
        "filter_measured": w("SELECT seq_id, n_chars FROM sequences WHERE doc_id IN (SELECT doc_id FROM labels)", st.sequences_sql()),
        "place_inserts": """WITH l AS (SELECT c_custkey AS peak_id, c_nationkey, row_number() OVER (ORDER BY c_custkey) - 1 AS i FROM customer)
          SELECT peak_id, c_nationkey, 'r' || r_regionkey AS variant, upper(r_name) AS "insert", 'L' || CASE WHEN i < 100 THEN lpad(i::VARCHAR, 2, '0') ELSE i::VARCHAR END || '_r' || r_regionkey AS seq_id FROM l, region WHERE peak_id IN (SELECT o_custkey FROM orders)""",
        "assign_hosts": w(f"""SELECT s.seq_id AS sample_id, peak_id, chrom, start FROM scores s, (SELECT count(*) AS n FROM peaks) JOIN (SELECT *, row_number() OVER (ORDER BY md5('12:' || peak_id), peak_id) - 1 AS r FROM peaks) p ON p.r = floor({u(12, "'host'", 's.seq_id')} * n)""", SCORES, st.PEAKS),
        "fixed_host": w(f"""SELECT {S}, chrom, start, "end" FROM scores, (SELECT chrom, start, "end" FROM peaks WHERE peak_id = 5)""", SCORES, st.PEAKS),
        "selection_report": w("SELECT round(max(mssi_score), 6) AS best, round(min(mssi_score), 6) AS worst_kept, count(*) FILTER (mssi_score > (SELECT avg(mssi_score) FROM scores WHERE cell_type = 'ct0')) AS n_above, (SELECT round(avg(mssi_score), 6) FROM scores) AS pool_mean FROM (SELECT * FROM scores ORDER BY mssi_score DESC, seq_id LIMIT 20)"),
        "stack_variants": w("SELECT seq_id, 'intact' AS variant FROM scores UNION ALL SELECT seq_id, cell_type FROM meta", SCORES, META),
        "permutation_test": w(f"SELECT statistic, {rs('mean_selected mean_rejected delta p')} FROM tests", LONG),
        "bh_fdr": w(f"SELECT statistic, {rs('p q')} FROM ({bh('pv')})", PV),
        "test_floor": w(f"SELECT round(1 / 1001, 6) AS p_floor, round(0.05 / count(*), 6) AS bonferroni, count(*) FILTER (q < 0.05) AS n_significant, 1 / 1001 <= 0.05 / count(*) AS reachable FROM ({bh('pv')})", PV),
        "selected_vs_rejected": w(f"SELECT statistic, {rs('mean_selected mean_rejected delta p q')} FROM ({bh('tests')})", LONG),
    }
