"""Queries on motif hits, the genome and sample metadata, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from locus.functions import seq as fn
from locus.operators import genome as gn
from locus.operators import grammar as gr
from locus.operators import motifs as mo
from locus.operators import provenance as pv
from locus.plans import standins as st
from locus.plans.q_sequences import rounded
from locus.sources import files

REL, WIDTH, T, CTX = 0.97, 6, 256, 400
FACTORS = ["de", "en", "es", "fr"]


def counts(s, d):
    """Base counts by place in two versions per language, from the first or the eleventh base of every 200-base piece on."""
    t = st.tiles(s, d, 200)
    places = [(v, p, v * 10 - 10 + p) for v in (1, 2) for p in range(WIDTH)]
    n = lambda b, at: F.count(F.when(fn.at(F.col("seq"), F.lit(at)) == b, 1))
    wide = t.groupBy("cell_type").agg(*[n(b, at).alias(f"{b}{v}_{p}") for v, p, at in places for b in "ACGT"])
    cells = F.array(*[F.struct(F.lit(v).alias("version"), F.lit(p).alias("pos"), *[F.col(f"{b}{v}_{p}").alias(b.lower()) for b in "ACGT"]) for v, p, _ in places])
    rows = wide.select("cell_type", F.explode(cells).alias("x")).select("cell_type", "x.*")
    return rows.select(F.col("cell_type").alias("tf"), F.concat_ws(".", F.lit("M"), "cell_type", "version").alias("matrix_id"), "version", "pos", *"acgt")


def matrices(s, d, names=FACTORS):
    return mo.load_matrices(counts(s, d), names, REL)


def hits(s, d):
    return mo.scan_motifs(st.sequences(s, d), matrices(s, d))


def lines(s, d):
    return st.sequences(s, d, "ACGTN").select(F.col("cell_type").alias("chrom"), F.col("doc_id").alias("line_no"), "seq")


def tiles(s, d):
    return gn.tile_genome(lines(s, d), T)


def stored(s, d):
    """The tiles as a bucketed table of its own."""
    path = st.folder(s, "genome")
    return gn.store_genome(tiles(s, d), path.rsplit("/", 1)[1].replace("-", "_"), path, T)


def windows(s, d):
    """A window per document, some beyond their contig's end or on a contig that isn't there."""
    start = (F.col("doc_id") * 7919) % 60000
    return st.table(s, d, "documents").select("doc_id", F.when(F.col("source") == "src3", "xx").otherwise(F.col("lang")).alias("chrom"), start.alias("start"), (start + 150 + F.col("doc_id") % 400).alias("end"))


def inserts(s, d):
    t = st.sequences(s, d)
    return t.select("seq_id", F.col("cell_type").alias("chrom"), ((F.col("doc_id") * 104729) % 50000).alias("center"), "seq")


def soft(s, d):
    """A text per conversation: each of its turns is a sample."""
    c = st.table(s, d, "conversations")
    record = F.concat_ws(
        "\n", F.concat(F.lit("^SAMPLE = GSM"), F.col("conv_id"), F.lit("_"), F.col("turn")), F.concat(F.lit("!Sample_title = "), F.col("role"), F.lit(" "), F.col("turn")),
        F.concat(F.lit("!Sample_organism_ch1 = organism "), F.col("conv_id") % 3), F.lit("!Sample_library_strategy = ATAC-seq"),
        F.concat(F.lit("!Sample_characteristics_ch1 = Cell Type: kind"), F.col("turn") % 4), F.lit("!Sample_characteristics_ch1 = age: 5"),
        F.concat(F.lit("!Sample_supplementary_file = "), F.lit(pv.FTP), F.lit("/x"), F.col("turn"), F.lit(".txt")), F.concat(F.lit("!Sample_supplementary_file = "), F.lit(pv.FTP), F.lit("/y"), F.col("turn"), F.lit(".narrowPeak.gz")),
    )
    per = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", record.alias("r")))), lambda x: x["r"]), "\n").alias("t"))
    return per.select(F.concat(F.lit("GSE"), F.col("conv_id")).alias("accession"), F.concat(F.lit("!Series\nAssembly: hg"), F.col("conv_id") % 4 + 36, F.lit(" x\n"), F.col("t")).alias("text"))


def samples(s, d):
    return pv.parse_sample_metadata(soft(s, d))


def soft_lines(s, d):
    """The texts written to files, each series after the other, and read as lines."""
    path = st.folder(s, "soft")
    soft(s, d).select(F.concat(F.lit("^SERIES = "), "accession", F.lit("\n"), "text").alias("value")).write.text(path)
    return files.read_sample_metadata(s, path)


def verified(s, d):
    lines = soft_lines(s, d)
    return pv.verify_series(pv.sample_records(lines), pv.first_assembly(lines), expected(s, d), ["HG38", "GRCh38"])


def expected(s, d):
    return st.table(s, d, "conversations").select(F.concat(F.lit("GSE"), F.col("conv_id")).alias("accession"), F.lit("organism 1").alias("organism"), F.lit("ATAC-seq").alias("library_strategy"), F.lit(2).cast("long").alias("n_samples")).distinct()


def assemblies(s, d):
    return soft(s, d).select("accession", pv.extract_assembly(F.col("text")).alias("genome_build"))


MAP = {"kind0": "T", "kind1": "B"}
HCOLS = ["seq_id", "tf", "matrix_id", "start", "end", "strand", "match_seq", "score", "relative_score"]


def queries():
    def seqs(s, d):
        return st.sequences(s, d)

    def factors(s, d):
        return counts(s, d).select("tf").distinct()

    def flat(m):
        return rounded(m.select("tf", "matrix_id", "width", F.posexplode("logodds").alias("pos", "x"), "min", "max", "threshold").select("tf", "matrix_id", "width", "pos", "x.*", "min", "max", "threshold"))

    return {
        "load_matrices": lambda s, d: flat(matrices(s, d)),
        "load_matrices_all": lambda s, d: flat(matrices(s, d, None)),
        "scan_motifs": lambda s, d: rounded(hits(s, d)),
        "tf_summary": lambda s, d: rounded(mo.tf_summary(hits(s, d), factors(s, d))),
        "homotypic_cluster": lambda s, d: gr.homotypic_cluster(hits(s, d)),
        "distinct_factors": lambda s, d: gr.distinct_factors(hits(s, d)),
        "heterotypic_pairs": lambda s, d: gr.heterotypic_pairs(hits(s, d)),
        "centre_distance": lambda s, d: rounded(gr.centre_distance(hits(s, d), seqs(s, d))),
        "grammar_profile": lambda s, d: rounded(gr.grammar_profile(hits(s, d), seqs(s, d))),
        "factor_counts": lambda s, d: gr.factor_counts(hits(s, d), seqs(s, d), factors(s, d)),
        "tile_genome": tiles,
        "extract_windows": lambda s, d: gn.extract_windows(windows(s, d), stored(s, d), "doc_id"),
        "context_windows": lambda s, d: gn.context_windows(inserts(s, d), stored(s, d), "seq_id", CTX).select("seq_id", "context"),
        "parse_sample_metadata": lambda s, d: pv.sample_records(soft_lines(s, d)),
        "characteristic_lookup": lambda s, d: samples(s, d).select("gsm", pv.characteristic_lookup(F.col("characteristics"), "cell type").alias("cell_type")),
        "clean_accession": lambda s, d: st.table(s, d, "conversations").select("conv_id", "turn", pv.clean_accession(F.concat(F.when(F.col("turn") % 2 == 0, " http://x/EFO_").otherwise(" plain "), F.col("conv_id"), F.lit(" "))).alias("accession")),
        "map_cell_types": lambda s, d: pv.map_cell_types(samples(s, d), MAP, "^user", "U").select("gsm", "cell_type"),
        "verify_series": verified,
        "build_check": lambda s, d: pv.build_violations(assemblies(s, d), ["HG38", "hg37"]),
        "select_samples": lambda s, d: pv.select_samples(samples(s, d), MAP, r"narrowPeak\.gz$", "^user", "U"),
    }


TL = st.tiles_sql(200)
COUNTS = f"""counts AS (SELECT cell_type AS tf, 'M.' || cell_type || '.' || version AS matrix_id, version, pos, count(*) FILTER (b = 'A') AS a, count(*) FILTER (b = 'C') AS c, count(*) FILTER (b = 'G') AS g, count(*) FILTER (b = 'T') AS t
  FROM (SELECT cell_type, (i // {WIDTH} + 1)::INTEGER AS version, (i % {WIDTH})::INTEGER AS pos, substr(seq, (i // {WIDTH} * 10 + i % {WIDTH} + 1)::INTEGER, 1) AS b FROM tiles, generate_series(0, {2 * WIDTH - 1}) g(i)) GROUP BY ALL),
odds AS (SELECT tf, matrix_id, version, pos, log2((a + ps) / (a + c + g + t + 4 * ps) / 0.25::DOUBLE) AS a, log2((c + ps) / (a + c + g + t + 4 * ps) / 0.25::DOUBLE) AS c, log2((g + ps) / (a + c + g + t + 4 * ps) / 0.25::DOUBLE) AS g, log2((t + ps) / (a + c + g + t + 4 * ps) / 0.25::DOUBLE) AS t
  FROM (SELECT *, sqrt(avg(a + c + g + t) OVER (PARTITION BY tf, matrix_id)) / 4 AS ps FROM counts)),
lim AS (SELECT tf, matrix_id, version, count(*)::INTEGER AS width, sum(least(a, c, g, t)) AS lo, sum(greatest(a, c, g, t)) AS hi FROM odds GROUP BY ALL)"""
FLAT = f"""width, pos, round(a, 6) AS a, round(c, 6) AS c, round(g, 6) AS g, round(t, 6) AS t, round(lo, 6) AS "min", round(hi, 6) AS "max", round(lo + {REL}::DOUBLE * (hi - lo), 6) AS threshold FROM odds JOIN lim USING (tf, matrix_id, version)"""
MX = f"""mx AS (SELECT tf, matrix_id, any_value(lo) AS lo, any_value(hi) AS hi, round(any_value(lo) + {REL}::DOUBLE * (any_value(hi) - any_value(lo)), 9) AS thr, list({{'A': a, 'C': c, 'G': g, 'T': t}} ORDER BY pos) AS m,
  list({{'A': t, 'C': g, 'G': c, 'T': a}} ORDER BY pos DESC) AS r FROM odds JOIN lim USING (tf, matrix_id, version) WHERE version = 2 GROUP BY tf, matrix_id)"""


def _sum(m):
    return " + ".join(f"(CASE substr(w, {k}, 1) WHEN 'A' THEN {m}[{k}].A WHEN 'C' THEN {m}[{k}].C WHEN 'G' THEN {m}[{k}].G ELSE {m}[{k}].T END)" for k in range(1, WIDTH + 1))


HITS = f"""{TL}, {COUNTS}, {MX}, win AS (SELECT seq_id, i AS start, substr(seq, i + 1, {WIDTH}) AS w FROM (SELECT seq_id, seq, unnest(generate_series(0, length(seq) - {WIDTH}))::INTEGER AS i FROM sequences)),
words AS (SELECT w, tf, matrix_id, lo, hi, strand, CASE strand WHEN '+' THEN round({_sum('m')}, 9) ELSE round({_sum('r')}, 9) END AS score, thr FROM (SELECT DISTINCT w FROM win), mx, (VALUES ('+'), ('-')) v(strand)),
hits AS (SELECT seq_id, tf, matrix_id, start, start + {WIDTH} AS "end", strand, w AS match_seq, score, (score - lo) / (hi - lo) AS relative_score, (start + start + {WIDTH}) // 2 AS c FROM win JOIN words USING (w) WHERE score >= thr)"""
CLUSTER = "cl AS (SELECT seq_id, max(n) AS cluster FROM (SELECT seq_id, count(*) OVER (PARTITION BY seq_id, tf ORDER BY c RANGE BETWEEN 100 PRECEDING AND CURRENT ROW) AS n FROM hits) GROUP BY seq_id)"
PAIRS = """pairs AS (SELECT x.seq_id, (sum(x.n * y.n) // 2)::BIGINT AS pairs FROM (SELECT seq_id, tf, c, count(*) AS n FROM hits GROUP BY ALL) x JOIN (SELECT seq_id, tf, c, count(*) AS n FROM hits GROUP BY ALL) y
  ON x.seq_id = y.seq_id AND x.tf <> y.tf AND abs(x.c - y.c) <= 100 GROUP BY x.seq_id)"""
DIST = """dist AS (SELECT h.seq_id, avg(abs((start + "end") / 2.0::DOUBLE - length(seq) / 2.0::DOUBLE)) AS d FROM hits h JOIN sequences USING (seq_id) GROUP BY h.seq_id)"""
NDOC = st.sequences_sql("ACGTN")
GENOME = NDOC + f""",
contig AS (SELECT cell_type AS chrom, string_agg(seq, '' ORDER BY doc_id) AS whole FROM sequences GROUP BY cell_type)"""
SOFT = f"""smp AS (SELECT 'GSE' || conv_id AS accession, conv_id, turn, 'GSM' || conv_id || '_' || turn AS gsm, role || ' ' || turn AS title, 'organism ' || (conv_id % 3) AS organism, 'ATAC-seq' AS library_strategy, role,
  ['Cell Type: kind' || (turn % 4), 'age: 5'] AS characteristics, ['{pv.FTP}/x' || turn || '.txt', '{pv.FTP}/y' || turn || '.narrowPeak.gz'] AS supplementary_urls FROM conversations)"""
TYPED = "typed AS (SELECT *, CASE WHEN turn % 4 = 0 THEN 'T' WHEN turn % 4 = 1 THEN 'B' WHEN role = 'user' THEN 'U' END AS cell_type FROM smp)"


def oracle_sql():
    return {
        "load_matrices": f"WITH {TL}, {COUNTS} SELECT tf, matrix_id, {FLAT} WHERE version = 2",
        "load_matrices_all": f"WITH {TL}, {COUNTS} SELECT tf || '|' || matrix_id AS tf, matrix_id, {FLAT}",
        "scan_motifs": f"""WITH {HITS} SELECT seq_id, tf, matrix_id, start, "end", strand, match_seq, round(score, 6) AS score, round(relative_score, 6) AS relative_score FROM hits""",
        "tf_summary": f"WITH {HITS} SELECT tf, count(h.seq_id) AS n_hits, round(coalesce(avg(relative_score), 0), 6) AS mean_relative FROM (SELECT DISTINCT tf FROM counts) f LEFT JOIN hits h USING (tf) GROUP BY tf",
        "homotypic_cluster": f"WITH {HITS}, {CLUSTER} SELECT * FROM cl",
        "distinct_factors": f"WITH {HITS} SELECT seq_id, count(DISTINCT tf) AS factors FROM hits GROUP BY seq_id",
        "heterotypic_pairs": f"WITH {HITS}, {PAIRS} SELECT seq_id, coalesce(pairs, 0) AS pairs FROM (SELECT DISTINCT seq_id FROM hits) LEFT JOIN pairs USING (seq_id)",
        "centre_distance": f"WITH {HITS}, {DIST} SELECT seq_id, round(d, 6) AS centre_distance FROM dist",
        "grammar_profile": f"""WITH {HITS}, {CLUSTER}, {PAIRS}, {DIST}, n AS (SELECT seq_id, count(*) AS n_hits, count(DISTINCT tf) AS factors FROM hits GROUP BY seq_id)
          SELECT seq_id, coalesce(cluster, 0) AS cluster, coalesce(factors, 0) AS factors, coalesce(pairs, 0) AS pairs, round(d, 6) AS centre_distance, coalesce(n_hits, 0) AS n_hits
          FROM sequences LEFT JOIN cl USING (seq_id) LEFT JOIN pairs USING (seq_id) LEFT JOIN dist USING (seq_id) LEFT JOIN n USING (seq_id)""",
        "factor_counts": f"WITH {HITS} SELECT s.seq_id, 'hits:' || f.tf AS statistic, count(h.start) AS value FROM sequences s CROSS JOIN (SELECT DISTINCT tf FROM counts) f LEFT JOIN hits h ON h.seq_id = s.seq_id AND h.tf = f.tf GROUP BY ALL",
        "tile_genome": f"WITH {GENOME} SELECT chrom, tile, substr(whole, tile * {T} + 1, {T}) AS seq FROM (SELECT chrom, whole, unnest(generate_series(0, (length(whole) - 1) // {T})) AS tile FROM contig)",
        "extract_windows": f"""WITH {GENOME}, w AS (SELECT doc_id, CASE WHEN source = 'src3' THEN 'xx' ELSE lang END AS chrom, (doc_id * 7919) % 60000 AS start, (doc_id * 7919) % 60000 + 150 + doc_id % 400 AS "end" FROM documents)
          SELECT doc_id, w.chrom, start, "end", substr(whole, start + 1, "end" - start) AS seq FROM w LEFT JOIN contig USING (chrom)""",
        "context_windows": f"""WITH {GENOME}, i AS (SELECT 'seq' || doc_id AS seq_id, lang AS chrom, (doc_id * 104729) % 50000 AS c, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS s FROM documents),
          k AS (SELECT *, length(s) AS n, ({CTX} - length(s)) // 2 AS ln, ({CTX} - length(s)) - ({CTX} - length(s)) // 2 AS rn FROM i JOIN contig USING (chrom)),
          f AS (SELECT *, substr(whole, greatest(0, c - {CTX // 2}) + 1, greatest(0, greatest(0, c - n // 2) - greatest(0, c - {CTX // 2}))) AS l, substr(whole, c + n // 2 + n % 2 + 1, greatest(0, {CTX // 2} - n // 2 - n % 2)) AS r FROM k)
          SELECT seq_id, CASE WHEN n <= {CTX} THEN (CASE WHEN length(l) < ln THEN repeat('N', ln - length(l)) || l ELSE substr(l, length(l) - ln + 1, ln) END) || s || (CASE WHEN length(r) < rn THEN r || repeat('N', rn - length(r)) ELSE substr(r, 1, rn) END) END AS context FROM f""",
        "parse_sample_metadata": f"WITH {SOFT} SELECT accession, gsm, title, organism, library_strategy, characteristics, supplementary_urls FROM smp",
        "characteristic_lookup": f"WITH {SOFT} SELECT gsm, 'kind' || (turn % 4) AS cell_type FROM smp",
        "clean_accession": "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'EFO_' || conv_id ELSE 'plain ' || conv_id END AS accession FROM conversations",
        "map_cell_types": f"WITH {SOFT}, {TYPED} SELECT gsm, cell_type FROM typed WHERE cell_type IS NOT NULL",
        "verify_series": f"""WITH {SOFT} SELECT accession, [any_value(organism)] AS organism, ['ATAC-seq'] AS library_strategy, count(*) AS n_samples, 'hg' || (any_value(conv_id) % 4 + 36) AS genome_build,
          list_filter([CASE WHEN any_value(conv_id) % 3 <> 1 THEN 'organism' END, CASE WHEN count(*) <> 2 THEN 'n_samples' END, CASE WHEN any_value(conv_id) % 4 + 36 <> 38 THEN 'genome_build' END], lambda x: x IS NOT NULL) AS problems FROM smp GROUP BY accession""",
        "build_check": f"WITH {SOFT} SELECT DISTINCT accession, 'hg' || (conv_id % 4 + 36) AS genome_build FROM smp WHERE conv_id % 4 + 36 NOT IN (37, 38)",
        "select_samples": f"WITH {SOFT}, {TYPED} SELECT accession, gsm, title, cell_type, '{pv.HTTPS}/y' || turn || '.narrowPeak.gz' AS url FROM typed WHERE cell_type IS NOT NULL",
    }
