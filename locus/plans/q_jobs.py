"""Queries on files, perturbation sets and composite jobs, with their SQL."""

from __future__ import annotations

import string

from pyspark.sql import functions as F

from locus.functions import seq as fn
from locus.operators import features as ft
from locus.operators import intervals as iv
from locus.operators import perturb as pt
from locus.operators import ranking as rk
from locus.plans import dataset as ds
from locus.plans import q_intervals as qi
from locus.plans import q_motifs as qm
from locus.plans import q_scores as qs
from locus.plans import q_sequences as qq
from locus.plans import standins as st
from locus.plans.q_sequences import rounded
from locus.plans.standins import folder
from locus.sources import files, sinks

L, TOP = 200, 12
#: Bases that stand for letters in the stand-in genome, the contig it lacks, and the counts of the dataset job.
LETTERS, BASES = string.ascii_letters, 2 * "ACGTACGTACGTACGTACGTNNACGT"
MISSING = "chr_purchase"
COUNTS = ["loci", "windows", "kept", "missing_contig", "length", "n_fraction"]


def candidates(s, d):
    t = qq.tiles(s, d)
    return t.select("seq_id", "seq", "cell_type", F.round(F.length(F.regexp_replace("seq", "[^GC]", "")) / L, 9).alias("mssi_score"))


def read_narrowpeak(s, d):
    path = folder(s, "narrow")
    p = st.peaks(s, d)
    p.select("chrom", "start", "end", F.concat(F.lit("p"), "peak_id"), "peak_score", F.lit("."), "fold_enrichment", F.lit(5), F.lit(3), "summit_offset").write.csv(path, sep="\t", nullValue="")
    return files.read_narrowpeak(s, path)


def read_homer(s, d):
    path = folder(s, "homer")
    p = st.peaks(s, d)
    p.select(F.col("peak_id").alias("#PeakID"), F.col("chrom").alias("chr"), "start", "end", F.col("peak_score").alias("findPeaks Score"), F.col("fold_enrichment").alias("Fold Change vs Local")).write.csv(path, sep="\t", header=True)
    return files.read_homer(s, path)


def manifest_rows(s, d, path):
    samples = st.peaks(s, d).select("gsm", "cell_type").distinct()
    one = samples.groupBy("gsm").agg(F.min("cell_type").alias("cell_type"))
    return one.select(F.lit("GSE1").alias("accession"), "gsm", F.concat(F.lit("t"), "gsm").alias("title"), "cell_type", F.lit("u").alias("url"), F.lit("narrowPeak").alias("peak_format"), F.concat(F.lit(f"{path}/"), "gsm").alias("local_path"))


def read_manifest(s, d):
    path = folder(s, "manifest")
    rows = manifest_rows(s, d, "x")
    rows.agg(F.to_json(F.array_sort(F.collect_list(F.struct(*rows.columns)))).alias("value")).write.text(path)
    return files.read_manifest(s, path)


def sample_files(s, d):
    """Each sample's peaks go to files of its own, named after it; returns the manifest that lists them."""
    path = folder(s, "samples")
    p = st.peaks(s, d)
    p.select("gsm", F.concat_ws("\t", "chrom", "start", "end", F.concat(F.lit("p"), "peak_id"), "peak_score", F.lit("."), "fold_enrichment", F.lit("5"), F.lit("3"), F.coalesce(F.col("summit_offset").cast("string"), F.lit(""))).alias("value")).write.partitionBy("gsm").text(path)
    names = s.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path).select("path").withColumn("gsm", F.regexp_extract("path", "gsm=([^/]+)/", 1))
    return manifest_rows(s, d, "x").drop("local_path").join(names, "gsm").withColumnRenamed("path", "local_path")


def scan_samples(s, d):
    return files.scan_samples(s, sample_files(s, d)).groupBy("gsm", "cell_type", "chrom").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("peak_score"), 4).alias("score"), F.sum("summit_offset").alias("offsets"))


def genome_files(s, d):
    """FASTA files of contigs made of whole documents, every line under its header; one contig of the peaks is missing."""
    path = folder(s, "fasta")
    kinds = F.array(*[F.lit(f"chr_{t}") for t in st.EVENT_TYPES])
    rows = st.table(s, d, "documents").select("doc_id", F.get(kinds, (F.col("doc_id") % 5).cast("int")).alias("chrom"), F.translate(F.regexp_replace("text", "[^A-Za-z]+", ""), LETTERS, BASES).alias("seq"))
    rows = rows.filter((F.col("chrom") != MISSING) & (F.length("seq") > 0)).repartitionByRange("chrom", "doc_id").sortWithinPartitions("chrom", "doc_id")
    rows.select(F.concat(F.lit(">"), "chrom", F.lit("\n"), "seq").alias("value")).write.text(path)
    return path


def built(s, d):
    """The dataset job from files to files, read back with its counts."""
    manifest, out = folder(s, "manifest"), folder(s, "built")
    rows = sample_files(s, d)
    rows.agg(F.to_json(F.array_sort(F.collect_list(F.struct(*rows.columns)))).alias("value")).write.text(manifest)  # a short list of files
    ds.dataset_job(s, pages=page_files(s, d), manifest=manifest, genome=genome_files(s, d), out=out, primary=st.PRIMARY, types=["ct0", "ct1", "ct2"], flank=st.FLANK)
    counts = s.read.schema(", ".join(f"{c} long" for c in COUNTS)).json(f"{out}/manifest")
    schema = "peak_id string, chrom string, start long, seq string, condition array<double>, tensor array<float>, cell_type string"
    data = s.read.schema(schema).parquet(f"{out}/dataset/data")  # no file at all if no window passed
    back = data.select("peak_id", "chrom", "start", "seq", F.transform("condition", lambda x: F.round(x, 6)).alias("condition"), F.size("tensor").alias("n_tensor"), "cell_type")
    return back.crossJoin(F.broadcast(counts))


def fasta_with_metadata(s, d):
    """Sequences and their metadata, written side by side and joined again."""
    path = folder(s, "aligned")
    sinks.write_fasta_with_metadata(st.sequences(s, d).select("seq_id", "seq", "cell_type", "source", "n_chars"), path)
    meta = s.read.csv(f"{path}/metadata.csv", header=True, schema="peak_id string, cell_type string, source string, n_chars long")
    return files.read_fasta(s, f"{path}/sequences").join(meta.withColumnRenamed("peak_id", "seq_id"), "seq_id")


def loci_bed(s, d):
    path = folder(s, "loci")
    qi.loci(s, d).select("chrom", "start", "end", "name").write.csv(path, sep="\t")
    return files.read_loci_bed(s, path)


def page_files(s, d):
    """Variants in pages of about a thousand, dealt by a hash, so that pages grow in number and not in size."""
    path = folder(s, "pages")
    v = st.variants(s, d)
    here = F.struct(F.regexp_replace("chrom", "^chr", "").alias("chromosomeName"), F.col("pos").alias("chromosomePosition"))
    nowhere = F.struct(F.lit(None).cast("string").alias("chromosomeName"), F.lit(1).cast("long").alias("chromosomePosition"))
    snp = F.struct(F.col("rs_id").alias("rsId"), F.col("functional_class").alias("functionalClass"), F.array(here, nowhere).alias("locations"))
    n = max(1, v.count() // 1000)
    per = v.groupBy(F.pmod(F.xxhash64("rs_id"), F.lit(n)).alias("page")).agg(F.struct(F.collect_list(snp).alias("singleNucleotidePolymorphisms")).alias("_embedded"))
    per.select("_embedded").write.json(path)
    return path


def pages(s, d):
    return files.variants_from_pages(s, page_files(s, d))


def fasta(s, d):
    path = folder(s, "fasta")
    sinks.write_fasta(st.sequences(s, d).select(F.concat("seq_id", F.lit(" of "), "cell_type").alias("seq_id"), F.concat(F.substring("seq", 1, 60), F.lit("\n"), F.substring(F.col("seq"), F.lit(61), F.length("seq"))).alias("seq")), path)
    return files.read_fasta(s, path)


def report(s, d):
    path = folder(s, "report")
    signals = {"target_signal": F.array(F.lit(1.0)), "background_signal": F.array(F.lit(0.5)), "target_tracks": F.array(F.lit(3))}
    sinks.write_score_report(qs.scores(s, d).withColumns(signals), path)
    return files.read_score_report(s, path, multi_line=False)


def window_metadata(s, d):
    path = folder(s, "meta") + ".csv"
    sinks.write_metadata(st.peaks(s, d).select(F.concat(F.lit("p"), "peak_id").alias("peak_id"), "chrom", "start", "end", "cell_type", "peak_score", "fold_enrichment", F.col("gsm").alias("source_gsm")), path)
    return files.read_window_metadata(s, path)


def write_bed(s, d):
    path = folder(s, "bed")
    sinks.write_bed(st.peaks(s, d).withColumn("name", F.concat(F.lit("p"), "peak_id")), path)
    return s.read.csv(path, sep="\t", schema="chrom string, start long, `end` long, name string, peak_score double")


def write_report(s, d):
    path = folder(s, "out")
    sinks.write_report(qs.scores(s, d).select("seq_id", "mssi_score"), path)
    summary = s.read.schema("n long, mean_mssi double").json(f"{path}/summary")
    return files.read_report(s, path).crossJoin(F.broadcast(rounded(summary)))  # one row


def dataset(s, d):
    """The windows around each document's place, cut, checked, encoded and written."""
    w = qm.windows(s, d).select(F.concat(F.lit("w"), "doc_id").alias("name"), "chrom", "start", (F.col("start") + L).alias("end"), F.col("chrom").alias("cell_type"), F.col("doc_id").cast("double").alias("peak_score"), (F.col("doc_id") % 7).cast("double").alias("fold_enrichment"))
    data, stats, _ = ds.build_dataset(w, qm.stored(s, d), qq.TYPES, L, 0.36)
    path = folder(s, "dataset")
    sinks.write_dataset(data, stats, path)
    back = s.read.parquet(f"{path}/data")
    return back.select("peak_id", "seq", F.transform("condition", lambda x: F.round(x, 6)).alias("condition"), F.size("tensor").alias("n_tensor"), "cell_type")


def host(s, d, df):
    meta = st.peaks(s, d).select(F.concat(F.lit("p"), "peak_id").alias("peak_id"), "chrom", "start", "end")
    return rk.fixed_host(df.withColumnRenamed("peak_id", "variant_id"), meta, "p5").withColumnRenamed("variant_id", "peak_id")


def hit_rows(s, d):
    """Every TACT in a piece, as (seq_id, start, end) of width 9."""
    t = qq.tiles(s, d)
    return t.select("seq_id", F.explode(qq.spans_of("TAC", 9)).alias("x")).select("seq_id", "x.*")


def survey(s, d, part):
    loci = rk.choose_loci(qq.tiles(s, d).select(F.col("seq_id").alias("peak_id"), F.lit("c").alias("chrom"), F.col("tile").alias("start"), (F.col("tile") + 1).alias("end"), F.col("doc_id").cast("double").alias("peak_score")), 20, 3).drop("stratum")
    hosts = qq.tiles(s, d).select(F.col("seq_id").alias("peak_id"), "seq")
    ins = rk.pick_inserts(candidates(s, d).select("seq_id", "seq"), 4)
    return pt.locus_survey_set(ins, loci, hosts, 3, 1)[part]


def measured(s, d):
    m = st.sequences(s, d).select("seq_id", F.col("n_chars").cast("double").alias("spec"))
    known = st.table(s, d, "labels").select(F.concat(F.lit("seq"), F.col("doc_id")).alias("seq_id"))
    meta = st.peaks(s, d).select(F.concat(F.lit("p"), "peak_id").alias("peak_id"), "chrom", "start", "end")
    return pt.measured_scoring_set(m, known, meta, "p5", column="spec", n_random=20, n_extreme=5, seed=6)


def generated(s, d):
    t = qq.seqs(s, d)
    w = st.sequences(s, d).select(F.col("seq_id").alias("peak_id"), "cell_type", "source")
    return ds.markov_generate(t, w, t.select(F.col("seq_id").alias("sample_id")), "en", qq.K, qq.SAMPLE, 5).select("sample_id", "seq", "peak_id", "source")


def evaluation(s, d):
    """The three evaluations' headline numbers in one long table."""
    seqs = qq.seqs(s, d)
    m = ds.evaluate("motif", sequences=seqs, matrices=qm.matrices(s, d)).select(F.concat(F.lit("motif:"), "tf").alias("metric"), F.col("n_hits").cast("double").alias("value"))
    r = ds.evaluate("realism_by_pool", sequences=seqs, pool="cell_type", reference="en", seed=3, order="doc_id").select(F.concat_ws(":", F.lit("realism"), "cell_type", "metric").alias("metric"), F.col("realism").alias("value"))
    o = ds.evaluate("oracle", sequences=qq.tiles(s, d).withColumn("context", F.col("seq")), load=st.kmer_linear_standin, panel={t: [0, 5] for t in qq.TYPES}, background=[10, 15])
    return rounded(m.unionByName(r).unionByName(o.agg(F.avg("mssi_score").alias("value")).select(F.lit("oracle:mean").alias("metric"), "value")))


def ablations(s, d):
    return pt.motif_ablation_set(candidates(s, d), hit_rows(s, d), 40, [1, 0], 2, 2)


def queries():
    return {
        "read_narrowpeak": read_narrowpeak,
        "read_homer": read_homer,
        "read_manifest": read_manifest,
        "scan_samples": scan_samples,
        "read_loci_bed": loci_bed,
        "variants_from_pages": pages,
        "read_fasta": fasta,
        "read_score_report": report,
        "read_window_metadata": window_metadata,
        "write_bed": write_bed,
        "write_fasta": fasta_with_metadata,
        "write_report": write_report,
        "write_dataset": dataset,
        "build_dataset": built,
        "align_metadata": lambda s, d: ft.align_metadata(st.sequences(s, d).select(F.col("seq_id").alias("peak_id"), "seq"), st.table(s, d, "labels").select(F.concat(F.lit("seq"), F.col("doc_id")).alias("peak_id"), "quality"), validate=False),
        "draw_dose": lambda s, d: pt.draw_dose(hit_rows(s, d), 2, 8),
        "occlusion_set": lambda s, d: host(s, d, pt.occlusion_set(candidates(s, d), TOP, 60, 7)),
        "cpg_swap_set": lambda s, d: host(s, d, pt.cpg_swap_set(candidates(s, d), TOP, 3, 1)),
        "motif_ablation_set": ablations,
        "motif_ablation_controls": lambda s, d: ablations(s, d).filter(F.col("variant").contains("ctl")),
        "locus_survey_set": lambda s, d: survey(s, d, 0),
        "locus_survey_hosts": lambda s, d: rounded(survey(s, d, 1)),
        "measured_scoring_set": measured,
        "markov_generate": generated,
        "evaluate": evaluation,
    }


def oracle_sql():
    peaks = f"WITH {st.PEAKS}"
    cand = f"{qq.TL}, cand AS (SELECT seq_id, seq, cell_type, round({qq.count_of('GC')} / {L}, 9) AS mssi_score FROM tiles)"
    best = "best AS (SELECT *, row_number() OVER (ORDER BY mssi_score DESC, seq_id) - 1 AS rank FROM cand QUALIFY rank < {})"
    at_host = """(SELECT chrom, start, "end" FROM peaks WHERE peak_id = 5)"""
    prefix = "'c' || lpad(rank::VARCHAR, 2, '0') || '_' || seq_id || '_'"

    def swap(word, seed, count=3, key="seq_id"):
        places = f"list_filter(generate_series(0, length(seq) - 2), lambda i: substr(seq, i + 1, 2) = '{word}')"
        chosen = f"list_transform(list_sort(list_transform({places}, lambda i: {{'k': {qq.md5(seed, key, 'i')}, 'i': i}}))[1:{count}], lambda x: x.i)"
        return f"(SELECT array_to_string(list_transform(generate_series(0, length(seq) - 1), lambda i: CASE WHEN list_contains(ch, i) THEN '{word[1]}' WHEN list_contains(ch, i - 1) THEN '{word[0]}' ELSE substr(seq, i + 1, 1) END), '') FROM (SELECT {chosen} AS ch))"

    occ = f"substr(seq, 1, t) || array_to_string(list_transform(generate_series(0, least(60, length(seq) - t) - 1), lambda i: substr('ACGT', 1 + floor({qq.u(7, 'seq_id', 't', 'i')} * 4)::INTEGER, 1)), '') || substr(seq, t + 61)"
    swaps = " UNION ALL ".join([f"SELECT seq_id, seq AS old, rank, 'intact' AS variant, seq FROM best"] + [f"SELECT seq_id, seq AS old, rank, '{n}', {swap(w, 1)} FROM best" for n, w in pt.SWAPS.items()])
    cg = lambda c: f"((length({c}) - length(replace({c}, 'CG', ''))) // 2)"
    fit_en = qq.FIT.replace("FROM sequences)", "FROM en)")
    syn = "'syn_en_' || seq_id"
    oe = f"CASE WHEN {qq.count_of('C')} > 0 AND {qq.count_of('G')} > 0 THEN round({qq.CPG} * length(seq) / ({qq.count_of('C')} * {qq.count_of('G')}), 6) END"
    survey_ctes = f"""{cand}, o AS (SELECT seq_id, tile, doc_id, seq, row_number() OVER (ORDER BY doc_id::DOUBLE, seq_id) - 1 AS r, count(*) OVER () AS n FROM tiles),
      k AS (SELECT (i * n) // 20 + floor({qq.u(3, 'i')} * (((i + 1) * n) // 20 - (i * n) // 20))::BIGINT AS r FROM (SELECT count(*) AS n FROM tiles), generate_series(0, 19) t(i)),
      loci AS (SELECT *, 'L' || lpad((row_number() OVER (ORDER BY seq_id) - 1)::VARCHAR, 2, '0') AS locus FROM o JOIN k USING (r)),
      ins AS (SELECT seq_id, seq, row_number() OVER (ORDER BY seq_id) - 1 AS i FROM (SELECT seq_id, seq FROM cand ORDER BY seq_id LIMIT 4)),
      v AS (SELECT i, 'intact' AS kind, seq FROM ins UNION ALL SELECT i, 'cpg_up', {swap('GC', 1)} FROM ins UNION ALL SELECT i, 'ctl', {swap('AT', 1)} FROM ins)"""
    spans = f"{cand}, hits AS (SELECT seq_id, unnest(list_filter(generate_series(0, length(seq) - 9), lambda i: substr(seq, i + 1, 3) = 'TAC'))::INTEGER AS start FROM tiles)"
    drawn = "SELECT seq_id, start FROM (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY md5('{}:' || seq_id || ':' || start), start) AS n, count(*) OVER (PARTITION BY seq_id) AS m FROM hits) WHERE {}"
    count2 = lambda w: f"len(list_filter(generate_series(1, length(seq) - 1), lambda i: substr(seq, i, 2) = '{w}'))"
    keyed = lambda *k: "md5((3 + c) || ':' || " + " || ':' || ".join(k) + ")"
    free = "len(list_filter(own, lambda o: s < o + 9 AND s + 9 > o)) = 0 AND len(list_filter(got, lambda o: s < o + 9 AND s + 9 > o)) = 0 AND s + 9 <= len"
    mixed = lambda key: "array_to_string(list_transform(list_sort(list_transform(generate_series(0, 8), lambda i: {'k': " + key + ", 'c': substr(f.seq, start + i + 1, 1)})), lambda x: x.c), '')"
    ablated = f"""WITH RECURSIVE {spans}, {best.format(40)}, x AS (SELECT 1 AS dose, * FROM ({drawn.format(3, 'n <= 1')}) UNION ALL SELECT 0, * FROM ({drawn.format(2, 'true')})),
      sp AS (SELECT dose, seq_id, start, row_number() OVER (PARTITION BY dose, seq_id ORDER BY start) AS k FROM x),
      f AS (SELECT dose, b.seq_id, rank, b.seq, 0::BIGINT AS k FROM best b JOIN (SELECT DISTINCT dose, seq_id FROM sp) d ON b.seq_id = d.seq_id
        UNION ALL SELECT f.dose, f.seq_id, rank, substr(seq, 1, start) || {mixed(qq.md5(2, 'f.seq_id', 'start', 'i'))} || substr(seq, start + 10), sp.k FROM f JOIN sp ON f.seq_id = sp.seq_id AND f.dose = sp.dose AND sp.k = f.k + 1),
      made AS (SELECT {prefix} || 'd' || dose || '_ablated' AS peak_id, seq_id AS parent_id, rank::INTEGER AS rank, 'd' || dose || '_ablated' AS variant, seq FROM f QUALIFY row_number() OVER (PARTITION BY dose, seq_id ORDER BY k DESC) = 1),
      taken AS (SELECT seq_id, list(start) AS own FROM hits GROUP BY seq_id),
      place AS (SELECT DISTINCT dose, b.seq_id, c, own, length(b.seq) AS len, [-1000] AS got, 0::BIGINT AS k FROM best b JOIN sp ON b.seq_id = sp.seq_id JOIN taken t ON t.seq_id = b.seq_id, (VALUES (0), (1)) v(c)
        UNION ALL SELECT p.dose, p.seq_id, c, own, len, list_concat(got, list_filter(list_transform(generate_series(0, 99), lambda t: floor(('0x' || substr({keyed('p.seq_id', 'start', 't')}, 1, 8))::BIGINT / 4294967296.0 * greatest(1, len - 9))::INTEGER), lambda s: {free})[1:1]), sp.k
        FROM place p JOIN sp ON p.seq_id = sp.seq_id AND p.dose = sp.dose AND sp.k = p.k + 1),
      offs AS (SELECT dose, seq_id, c, unnest(got) AS start, generate_subscripts(got, 1) - 1 AS k FROM (SELECT * FROM place QUALIFY row_number() OVER (PARTITION BY dose, seq_id, c ORDER BY k DESC) = 1)),
      g AS (SELECT dose, o.seq_id, c, rank, seq, 0::BIGINT AS k FROM offs o JOIN best b ON o.seq_id = b.seq_id WHERE o.k = 0
        UNION ALL SELECT f.dose, f.seq_id, f.c, rank, substr(seq, 1, start) || {mixed(keyed('f.seq_id', 'start', 'i').replace('+ c', '+ f.c'))} || substr(seq, start + 10), o.k FROM g f JOIN offs o ON o.seq_id = f.seq_id AND o.dose = f.dose AND o.c = f.c AND o.k = f.k + 1),
      control AS (SELECT {prefix} || 'd' || dose || '_ctl' || c AS peak_id, seq_id AS parent_id, rank::INTEGER AS rank, 'd' || dose || '_ctl' || c AS variant, seq FROM g QUALIFY row_number() OVER (PARTITION BY dose, seq_id, c ORDER BY k DESC) = 1)"""
    data_w = f"""w AS (SELECT doc_id, CASE WHEN source = 'src3' THEN 'xx' ELSE lang END AS chrom, (doc_id * 7919) % 60000 AS start FROM documents),
      cut AS (SELECT 'w' || doc_id AS peak_id, w.chrom, doc_id, substr(whole, start + 1, {L}) AS seq FROM w JOIN contig USING (chrom)),
      ok AS (SELECT * FROM cut WHERE length(seq) = {L} AND length(regexp_replace(seq, '[^N]', '', 'g')) / length(seq) <= 0.36)"""
    return {
        "read_narrowpeak": f"""{peaks} SELECT chrom, start, "end", peak_score, fold_enrichment, summit_offset FROM peaks""",
        "read_homer": f"""{peaks} SELECT chrom, start, "end", peak_score, fold_enrichment, NULL::BIGINT AS summit_offset FROM peaks""",
        "read_manifest": f"{peaks} SELECT 'GSE1' AS accession, gsm, 't' || gsm AS title, min(cell_type) AS cell_type, 'u' AS url, 'narrowPeak' AS peak_format, 'x/' || gsm AS local_path FROM peaks GROUP BY gsm",
        "scan_samples": f"{peaks}, c AS (SELECT gsm, min(cell_type) AS cell_type FROM peaks GROUP BY gsm) SELECT p.gsm, c.cell_type, chrom, count(*) AS n, round(sum(peak_score), 4) AS score, sum(summit_offset)::BIGINT AS offsets FROM peaks p JOIN c ON p.gsm = c.gsm GROUP BY ALL",
        "read_loci_bed": f"""WITH {st.VARIANTS}, {qi.LOCI} SELECT chrom, start, "end" FROM loci""",
        "variants_from_pages": f"WITH {st.VARIANTS} SELECT rs_id, chrom, pos, min(functional_class) AS functional_class FROM variants GROUP BY ALL",
        "read_fasta": f"WITH {st.sequences_sql()} SELECT seq_id, seq FROM sequences",
        "read_score_report": f"WITH {qs.SCORES} SELECT seq_id, mssi_score FROM scores",
        "read_window_metadata": f"""{peaks} SELECT 'p' || peak_id AS peak_id, chrom, start, "end", cell_type, peak_score, fold_enrichment, gsm AS source_gsm FROM peaks""",
        "write_bed": f"""{peaks} SELECT chrom, start, "end", 'p' || peak_id AS name, peak_score FROM peaks""",
        "write_fasta": f"WITH {st.sequences_sql()} SELECT seq_id, seq, cell_type, source, n_chars FROM sequences",
        "write_report": f"WITH {qs.SCORES} SELECT seq_id, mssi_score, count(*) OVER () AS n, round(avg(mssi_score) OVER (), 6) AS mean_mssi FROM scores",
        "write_dataset": f"""WITH {qm.GENOME}, {data_w}, s AS (SELECT avg(doc_id) AS a, stddev_pop(doc_id) AS sa, avg(doc_id % 7) AS b, stddev_pop(doc_id % 7) AS sb FROM ok)
          SELECT peak_id, seq, [{', '.join(f"(chrom = '{t}')::INTEGER::DOUBLE" for t in qq.TYPES)}, round((doc_id - a) / sa, 6), round((doc_id % 7 - b) / sb, 6)] AS condition, {4 * L} AS n_tensor, chrom AS cell_type FROM ok, s""",
        "build_dataset": f"""WITH RECURSIVE {st.PEAKS}, {qi.CENTRED}, {qi.PRIME}, {st.VARIANTS}, {qi.LOCI}, {qi.INSIDE.format('prime')}, {qi.BOUNDED.format('inside')}, {qi.BEST}, {qi.GREEDY}, alone AS ({qi.SHARED.format('collapsed')}),
          contig AS (SELECT contig_name, string_agg(translate(letters, '{LETTERS}', '{BASES}'), '' ORDER BY doc_id) AS whole
            FROM (SELECT doc_id, 'chr_' || {st.EVENT_TYPES}[(doc_id % 5 + 1)::INTEGER] AS contig_name, regexp_replace(text, '[^A-Za-z]', '', 'g') AS letters FROM documents) WHERE contig_name <> '{MISSING}' GROUP BY contig_name),
          cut AS (SELECT {qi.NAME} AS peak_id, chrom, win_start AS start, cell_type, peak_score, fold_enrichment, substr(whole, win_start + 1, {iv.WINDOW}) AS seq FROM alone a LEFT JOIN contig ON chrom = contig_name),
          marked AS (SELECT *, CASE WHEN seq IS NULL THEN 'missing_contig' WHEN length(seq) <> {iv.WINDOW} THEN 'length' WHEN length(regexp_replace(seq, '[^N]', '', 'g')) / length(seq) > 0.05 THEN 'n_fraction' ELSE 'kept' END AS reason FROM cut),
          st AS (SELECT avg(peak_score) AS a, stddev_pop(peak_score) AS sa, avg(fold_enrichment) AS b, stddev_pop(fold_enrichment) AS sb FROM marked WHERE reason = 'kept')
          SELECT peak_id, chrom, start, seq, [{', '.join(f"(cell_type = 'ct{t}')::INTEGER::DOUBLE" for t in range(3))}, round((peak_score - a) / CASE WHEN sa = 0 THEN 1 ELSE sa END, 6), round((fold_enrichment - b) / CASE WHEN sb = 0 THEN 1 ELSE sb END, 6)] AS condition,
            {4 * iv.WINDOW} AS n_tensor, cell_type, (SELECT count(*) FROM loci) AS loci, (SELECT count(*) FROM marked) AS windows, {', '.join(f"(SELECT count(*) FROM marked WHERE reason = '{r}') AS {r}" for r in COUNTS[2:])} FROM marked, st WHERE reason = 'kept'""",
        "align_metadata": f"WITH {st.sequences_sql()} SELECT seq_id AS peak_id, seq, quality FROM sequences s JOIN labels l ON s.doc_id = l.doc_id",
        "draw_dose": f"""WITH {spans}, x AS ({drawn.format(8, 'm >= 2 AND n <= 2')}) SELECT seq_id, start, start + 9 AS "end" FROM x""",
        "occlusion_set": f"""WITH {st.PEAKS}, {cand}, {best.format(TOP)}, v AS (SELECT {prefix} || 'intact' AS peak_id, seq_id AS parent_id, rank::INTEGER AS rank, 'intact' AS variant, seq FROM best
          UNION ALL SELECT {prefix} || 'tile' || t, seq_id, rank::INTEGER, 'tile' || t, {occ} FROM (SELECT *, unnest(generate_series(0, length(seq) - 1, 60)) AS t FROM best)) SELECT * FROM v, {at_host}""",
        "cpg_swap_set": f"WITH {st.PEAKS}, {cand}, {best.format(TOP)}, v AS ({swaps}) SELECT {prefix} || variant AS peak_id, seq_id AS parent_id, rank::INTEGER AS rank, variant, seq, ({cg('seq')} - {cg('old')})::INTEGER AS delta_cpg, h.* FROM v, {at_host} h",
        "motif_ablation_set": f"{ablated} SELECT * FROM made UNION ALL SELECT * FROM control",
        "motif_ablation_controls": f"{ablated} SELECT * FROM control",
        "evaluate": f"""SELECT 'motif:' || tf AS metric, n::DOUBLE AS value FROM (WITH {qm.HITS} SELECT tf, count(h.seq_id) AS n FROM (SELECT DISTINCT tf FROM counts) f LEFT JOIN hits h USING (tf) GROUP BY tf)
          UNION ALL SELECT 'realism:' || cell_type || ':' || metric, realism FROM ({qq.REALISM})
          UNION ALL SELECT 'oracle:mean', round(avg(score), 6) FROM (WITH {qq.TL} SELECT ({count2('AA')} + {count2('CC')}) / 2.0::DOUBLE - ({count2('GG')} + {count2('TT')}) / 2.0::DOUBLE AS score FROM tiles)""",
        "locus_survey_set": f"""WITH {survey_ctes} SELECT locus || '_i' || lpad(i::VARCHAR, 2, '0') || '_' || kind AS seq_id, v.seq, 'c' AS chrom, tile AS start, tile + 1 AS "end" FROM loci, v""",
        "locus_survey_hosts": f"""WITH {survey_ctes} SELECT locus, seq_id AS peak_id, 'c' AS chrom, tile AS start, doc_id::DOUBLE AS peak_score, {oe} AS host_cpg_oe, round({qq.count_of('GC')} / length(seq), 6) AS host_gc FROM loci""",
        "measured_scoring_set": f"""WITH {st.PEAKS}, {st.sequences_sql()}, m AS (SELECT seq_id, n_chars::DOUBLE AS spec FROM sequences WHERE doc_id IN (SELECT doc_id FROM labels)), t AS (SELECT * FROM m ORDER BY spec DESC, seq_id DESC LIMIT 5), b AS (SELECT * FROM m ORDER BY spec, seq_id LIMIT 5),
          v AS (SELECT *, 'top' AS stratum FROM t UNION ALL SELECT *, 'bottom' FROM b UNION ALL SELECT * FROM (SELECT *, 'random' FROM m WHERE seq_id NOT IN (SELECT seq_id FROM t UNION ALL SELECT seq_id FROM b) ORDER BY md5('6:' || seq_id), seq_id LIMIT 20))
          SELECT seq_id AS peak_id, spec, stratum, h.* FROM v, {at_host} h""",
        "markov_generate": f"""WITH RECURSIVE {st.sequences_sql()}, en AS (SELECT * FROM sequences WHERE cell_type = 'en'), {fit_en}, cum AS (SELECT context, list(c ORDER BY base) AS r FROM (SELECT context, base, sum(p) OVER (PARTITION BY context ORDER BY base) AS c FROM fit) GROUP BY context),
          pre AS (SELECT prefix, sum(w) OVER (ORDER BY prefix) AS upto, sum(w) OVER () AS total FROM (SELECT substr(seq, 1, {qq.K}) AS prefix, count(*) AS w FROM en WHERE length(seq) >= {qq.K} GROUP BY ALL)),
          f AS (SELECT {syn} AS sample_id, (SELECT min(prefix) FROM pre WHERE upto > {qq.u(5, syn, "'prefix'")} * total) AS seq, 0 AS i FROM sequences
            UNION ALL SELECT f.sample_id, f.seq || substr('ACGT', 1 + len(list_filter(coalesce(r, [0.25, 0.5, 0.75, 1.0])[1:3], lambda c: c <= {qq.u(5, 'f.sample_id', 'f.i')})), 1), f.i + 1 FROM f LEFT JOIN cum ON context = substr(f.seq, f.i + 1, {qq.K}) WHERE f.i < {qq.SAMPLE - qq.K}),
          hosts AS (SELECT seq_id AS peak_id, source, row_number() OVER (ORDER BY md5('5:' || seq_id), seq_id) - 1 AS r, count(*) OVER () AS n FROM en)
          SELECT sample_id, f.seq, peak_id, source FROM f JOIN hosts ON hosts.r = floor({qq.u(5, "'host'", 'f.sample_id')} * n) WHERE i = {qq.SAMPLE - qq.K}""",
    }
