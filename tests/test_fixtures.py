"""Small cases worked out by hand, and invariants of random choices."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from locus.functions import seq as fn
from locus.plans import standins as st
from locus.operators import features as ft
from locus.operators import genome as gn
from locus.operators import grammar as gr
from locus.operators import intervals as iv
from locus.operators import markov as mk
from locus.operators import motifs as mo
from locus.operators import perturb as pt
from locus.operators import provenance as pv
from locus.operators import ranking as rk
from locus.operators import scoring as sc
from locus.operators import seqstats as ss
from locus.operators import stats as stt
from locus.sources import files, sinks


def values(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def seqs(spark, *texts):
    return spark.createDataFrame([(f"s{i}", i, t) for i, t in enumerate(texts)], "seq_id string, n int, seq string")


def windows(spark, *rows):
    return spark.createDataFrame(rows, "cell_type string, chrom string, win_start long, peak_score double")


def test_primary_filter_and_resize(spark):
    p = spark.createDataFrame([("chr1", 1000, 1400, 100), ("chr1", 1000, 1400, None), ("chr1_gl000191_random", 1, 2, 0), ("chr2", 100, 300, 900)], "chrom string, start long, end long, summit_offset long")
    out = iv.resize_to_window(iv.filter_primary_chromosomes(p, ["chr1", "chr2"]))
    assert values(out, "win_start", "win_end", "method") == [(0, 1000, "midpoint"), (600, 1600, "summit"), (700, 1700, "midpoint")]


def test_collapse_and_exclusivity(spark):
    w = windows(spark, ("B", "chr1", 1000, 50.0), ("B", "chr1", 1030, 120.0), ("B", "chr1", 1055, 80.0), ("CD4", "chr1", 1010, 10.0))
    assert values(iv.collapse_redundant_windows(w, 500), "cell_type", "peak_score") == [("B", 120.0), ("CD4", 10.0)]
    assert iv.collapse_redundant_windows(w, 0).count() == 4
    x = windows(spark, ("B", "chr1", 1000, 1.0), ("CD4", "chr1", 1200, 1.0), ("mg", "chr2", 5000, 1.0), ("B", "chr3", 7000, 1.0))
    assert values(iv.drop_shared_windows(x, 500), "chrom") == [("chr2",), ("chr3",)]
    assert iv.drop_shared_windows(x, 0).count() == 4


def test_collapse_equals_plain_greedy_for_any_partitioning(spark):
    rng = np.random.default_rng(1)
    rows = [("B", "chr1", int(s), float(v)) for s, v in {int(s): v for s, v in zip(rng.integers(0, 40_000, 300), rng.permutation(300))}.items()]
    kept = []
    for r in sorted(rows, key=lambda r: -r[3]):
        if all(abs(r[2] - k) >= 500 for k in kept):
            kept.append(r[2])
    for n in (1, 5):
        assert values(iv.collapse_redundant_windows(windows(spark, *rows).repartition(n), 500), "win_start") == sorted((k,) for k in kept)


def test_loci(spark):
    v = spark.createDataFrame([("rs1", "chr6", 32_000_000, "x"), ("rs2", "chr6", 32_050_000, "x"), ("rs3", "chr1", 50, "x"), ("rs3", "chr1", 50, "x")], "rs_id string, chrom string, pos long, functional_class string")
    loci = iv.merge_loci(iv.flank_variants(iv.distinct_variants(v), 100_000))
    assert values(loci, "chrom", "start", "end", "name", "score") == [("chr1", 0, 100_050, "rs3", 1), ("chr6", 31_899_999, 32_150_000, "rs1,rs2", 2)]
    many = spark.createDataFrame([(f"rs{i}", "c", i, i + 1) for i in range(7)], "rs_id string, chrom string, start long, end long")
    assert values(iv.merge_loci(many), "name") == [("rs0,rs1,rs2,rs3,rs4...",)]


def test_as_of_join_looks_at_one_locus_only(spark):
    loci = spark.createDataFrame([("c", 0, 1_000_000), ("c", 100, 200)], "chrom string, start long, end long")
    p = spark.createDataFrame([("c", 50), ("c", 150), ("c", 500), ("c", 999_999), ("d", 50)], "chrom string, summit long")
    assert values(iv.intersect_with_loci(p, loci), "summit") == [(50,), (150,)]
    far = loci.filter("start = 0")
    assert values(iv.intersect_with_loci(p, far), "summit") == [(50,), (150,), (500,), (999_999,)]


def test_one_hot(spark):
    df = seqs(spark, "ACGTNR", "acgt", "")
    rows = df.select(fn.one_hot(F.col("seq")).alias("u"), fn.one_hot(F.col("seq"), "zero").alias("z"), fn.decode_one_hot(fn.one_hot(F.col("seq"))).alias("d")).collect()
    assert rows[0]["u"][:6] == [1, 0, 0, 0, 0.25, 0.25] and rows[0]["z"][:6] == [1, 0, 0, 0, 0, 0]
    assert [r["d"] for r in rows] == ["ACGTNN", "ACGT", ""]


def test_conditions(spark):
    df = spark.createDataFrame([("B", 100.0, 1.0), ("x", 200.0, 2.0), ("T", 300.0, 3.0)], "cell_type string, peak_score double, fold_enrichment double")
    stats = ft.fit_normalisation(df, ["peak_score", "fold_enrichment"])
    assert stats.first()["center"] == [200.0, 2.0]
    got = {r["cell_type"]: r["condition"] for r in ft.condition_vectors(df, stats, ["B", "T"], ["peak_score", "fold_enrichment"]).collect()}
    assert got["x"] == [0, 0, 0, 0] and got["B"][:2] == [1, 0] and got["T"][2] == pytest.approx(1.2247448)
    one = ft.fit_normalisation(df.limit(1), ["peak_score"])
    assert one.first()["scale"] == [1.0]
    with pytest.raises(ValueError):
        ft.fit_normalisation(df, ["peak_score"], "other")


def test_realism_values(spark):
    assert ss.gc_content(seqs(spark, "GGCC", "AATT")).first()["gc"] == 0.5
    assert ss.kmer_entropy(seqs(spark, "A" * 100), 2).first()["entropy"] == 0
    assert ss.cpg_obs_exp_pool(seqs(spark, "CG" * 200), "n").first()["cpg_oe"] > 1.5
    assert ss.cpg_obs_exp_pool(seqs(spark, "AC", "GT"), "n").first()["cpg_oe"] == pytest.approx((1 / 3) / (1 / 16))
    assert ss.median_longest_run(seqs(spark, "A" * 50 + "CGCGCG")).first()["median_run"] == 50
    ref, ctl = (ss.realism_profile(x, "n") for x in (seqs(spark, "ACGT" * 30), seqs(spark, "AAAAC" * 30)))
    assert all(r["realism"] == pytest.approx(1) for r in ss.realism_compare(ref, ref, ctl).collect())
    assert all(r["realism"] == pytest.approx(0) for r in ss.realism_compare(ctl, ref, ctl).collect())


def test_swaps_keep_the_composition(spark):
    df = seqs(spark, "AAGCAAGCAAGCAA", "GCGC", "AAAA")
    up = df.select("seq", fn.swap_dinucleotides(F.col("seq"), "GC", 3, 1, F.col("seq_id")).alias("x")).collect()
    assert up[0]["x"]["seq"].count("CG") == 3 and up[0]["x"]["swaps"] == 3 and up[2]["x"]["swaps"] == 0
    assert all(Counter(r["seq"]) == Counter(r["x"]["seq"]) for r in up)
    with pytest.raises(ValueError):
        fn.swap_dinucleotides(F.col("seq"), "GG", 1, 1, F.col("seq_id"))


def test_spans(spark):
    df = spark.createDataFrame([("s", "ACGT" * 125, [(10, 20), (50, 61)])], "seq_id string, seq string, spans array<struct<start: int, end: int>>")
    row = df.select("seq", fn.shuffle_spans(F.col("seq"), F.col("spans"), 1, F.col("seq_id")).alias("s"), fn.control_spans(F.col("spans"), F.lit(500), 1, F.col("seq_id")).alias("c")).first()
    assert Counter(row["s"][10:20]) == Counter(row["seq"][10:20]) and row["s"][:10] == row["seq"][:10] and row["s"][61:] == row["seq"][61:]
    placed = [(c["start"], c["end"]) for c in row["c"]]
    assert sorted(b - a for a, b in placed) == [10, 11]
    every = placed + [(10, 20), (50, 61)]
    assert all(a[1] <= b[0] or b[1] <= a[0] for i, a in enumerate(every) for b in every[i + 1 :])
    full = spark.createDataFrame([("s", [(0, 10)])], "seq_id string, spans array<struct<start: int, end: int>>")
    assert full.select(fn.control_spans(F.col("spans"), F.lit(10), 1, F.col("seq_id")).alias("c")).first()["c"] == []


def test_occlusion_touches_one_tile(spark):
    df = seqs(spark, "N" * 130)
    for start in (0, 50, 100):
        s = df.select(fn.occlude(F.col("seq"), F.lit(start), 50, 3, F.col("seq_id")).alias("s")).first()["s"]
        end = min(130, start + 50)
        assert len(s) == 130 and set(s[:start] + s[end:]) <= {"N"} and "N" not in s[start:end]


def test_markov(spark):
    train = spark.createDataFrame([(f"a{i}", "ACGT" * 50) for i in range(5)], "seq_id string, seq string")
    fit = mk.markov_fit(train, 2, 0.0)
    assert values(fit.filter("p > 0"), "context", "base") == [("AC", "G"), ("CG", "T"), ("GT", "A"), ("TA", "C")]
    ids = spark.range(6).select(F.col("id").cast("string").alias("sample_id"))
    got = mk.markov_sample(ids, fit, mk.markov_prefixes(train, 2), 2, 21, 1).collect()
    assert all(r["seq"] == ("ACGT" * 6)[:21] for r in got)
    assert mk.markov_fit(seqs(spark, "NNNN"), 2).count() == 0
    with pytest.raises(ValueError):
        mk.markov_sample(ids, fit, mk.markov_prefixes(train, 2), 2, 1, 1)


def hit_table(spark):
    rows = [("s", "SPI1", c, c) for c in (0, 40, 80)] + [("s", "PAX5", c, c) for c in (20, 60)] + [("t", "SPI1", 0, 0), ("t", "SPI1", 20, 20), ("t", "PAX5", 30, 30), ("t", "EBF1", 600, 600)]
    return spark.createDataFrame(rows, "seq_id string, tf string, start int, end int")


def test_grammar(spark):
    h, s = hit_table(spark), spark.createDataFrame([("s", "A" * 100), ("t", "A" * 100), ("none", "A")], "seq_id string, seq string")
    got = {r["seq_id"]: r for r in gr.grammar_profile(h, s).collect()}
    assert got["s"]["cluster"] == 3 and got["t"]["pairs"] == 2 and got["t"]["factors"] == 3
    assert (got["none"]["cluster"], got["none"]["pairs"], got["none"]["centre_distance"]) == (0, 0, None)
    same = spark.createDataFrame([("s", "a", 5, 5), ("s", "b", 5, 5), ("s", "b", 5, 5)], "seq_id string, tf string, start int, end int")
    assert gr.heterotypic_pairs(same).first()["pairs"] == 2
    with pytest.raises(ValueError):
        gr.grammar_profile(h, s, 0)


def matrix(spark, word="GGGGAATTCC", version=1):
    return spark.createDataFrame([("NF", f"M{version}", version, i, *[100 * (b == x) for x in "ACGT"]) for i, b in enumerate(word)], "tf string, matrix_id string, version int, pos int, a int, c int, g int, t int")


def test_known_site_is_found_on_both_strands_and_a_degraded_one_is_not(spark):
    m = mo.load_matrices(matrix(spark), ["NF"], 0.95)
    s = seqs(spark, "ACGT" * 10 + "GGGGAATTCC" + "ACGT" * 10, "ACGT" * 10 + "GGAATTCCCC"[::-1].translate(str.maketrans("ACGT", "TGCA")) + "ACGT" * 10, "ACGT" * 25, "ACGT" * 10 + "GGGGANNTCC", "GG")
    got = values(mo.scan_motifs(s, m), "seq_id", "start", "strand", "match_seq")
    assert got == [("s0", 40, "+", "GGGGAATTCC"), ("s1", 40, "+", "GGGGAATTCC")]
    back = seqs(spark, "TT" + "GGAATTCCCC" + "TT")
    assert values(mo.scan_motifs(back, m), "start", "end", "strand", "match_seq", "relative_score") == [(2, 12, "-", "GGAATTCCCC", 1.0)]


def test_newest_matrix_and_errors(spark):
    both = matrix(spark).unionByName(matrix(spark, "AAAAAAAAAA", 2))
    assert mo.load_matrices(both, ["NF"], 0.8).first()["matrix_id"] == "M2"
    assert values(mo.load_matrices(both, None, 0.8), "tf") == [("NF|M1",), ("NF|M2",)]
    with pytest.raises(ValueError):
        mo.load_matrices(both, ["other"], 0.8)
    with pytest.raises(ValueError):
        mo.load_matrices(both, ["NF"], 0.0)


def test_fdr_and_permutation(spark):
    t = spark.createDataFrame([(str(i), p) for i, p in enumerate([0.001, 0.5, 0.6, 0.7])], "statistic string, p double")
    assert {r["statistic"]: r["q"] for r in stt.bh_fdr(t).collect()}["0"] == pytest.approx(0.004)
    many = spark.createDataFrame([(f"{i:03d}", 1e-4 if i < 26 else 0.5) for i in range(726)], "statistic string, p double")
    assert {r["statistic"] for r in stt.bh_fdr(many).filter("q < 0.05").collect()} == {f"{i:03d}" for i in range(26)}
    rows = [(i, "far", "selected" if i < 50 else "rejected", float(i if i < 50 else i + 50)) for i in range(100)] + [(i, "same", "selected" if i < 50 else "rejected", 1.0) for i in range(100)]
    long = spark.createDataFrame(rows, "unit int, statistic string, grp string, value double")
    p = {r["statistic"]: r["p"] for r in stt.permutation_test(long, 120, 1).collect()}
    assert p["far"] < 0.01 and p["same"] == 1.0


def test_selection(spark):
    s = spark.createDataFrame([(f"c{i}", "L", float(v)) for i, v in enumerate([0.5, 2.5, -1, 1.5])] + [("real", "L", 9.0)], "seq_id string, locus string, mssi_score double")
    assert values(rk.split_tails(s, 0.25), "seq_id", "tail") == [("c1", "selected"), ("c2", "rejected")]
    assert values(rk.pick_inserts(s, 2), "seq_id") == [("c0",), ("c1",)]
    for bad in (0, 0.6):
        with pytest.raises(ValueError):
            rk.split_tails(s, bad)
    hundred = spark.createDataFrame([(f"p{i:03d}", float(i)) for i in range(100)], "peak_id string, peak_score double")
    got = sorted(r["peak_score"] for r in rk.choose_loci(hundred, 10, 3).collect())
    assert [int(x // 10) for x in got] == list(range(10))
    sample = rk.stratified_sample(hundred.withColumnRenamed("peak_id", "seq_id"), "peak_score", 20, 5, 1)
    assert Counter(r["stratum"] for r in sample.collect()) == {"random": 20, "top": 5, "bottom": 5} and sample.select("seq_id").distinct().count() == 30
    with pytest.raises(ValueError):
        rk.stratified_sample(hundred.withColumnRenamed("peak_id", "seq_id"), "peak_score", 99, 5, 1)
    split = rk.train_val_split(hundred.withColumnRenamed("peak_id", "seq_id"), 0.13, 1)
    assert split.filter("is_val").count() == 13
    assert values(split.repartition(9).filter("is_val"), "seq_id") == values(split.filter("is_val"), "seq_id")


def test_numbering_is_the_order(spark):
    df = spark.createDataFrame([(i, float((i * 7919) % 1000 // 3)) for i in range(1000)], "id int, v double").repartition(7)
    got = sorted(rk.numbered(df, [F.col("v"), F.col("id")]).collect(), key=lambda r: r["row"])
    assert [r["row"] for r in got] == list(range(1000)) and [(r["v"], r["id"]) for r in got] == sorted((r["v"], r["id"]) for r in got)


def test_scores(spark):
    df = spark.createDataFrame([("s", "B", [float(i) for i in range(20)])], "seq_id string, cell_type string, tracks array<float>")
    row = sc.mssi(df, {"B": [10, 12]}, [0, 2]).first()
    assert row["mssi_score"] == 10 and row["target_signal"] == [10, 12]
    out = sc.score_with(seqs(spark, "ACAC"), st.kmer_linear_standin).first()["tracks"]
    assert sum(out) == 3 and out[1] == 2
    with pytest.raises(Exception, match="no model"):
        sc.score_with(seqs(spark, "ACAC"), lambda: None).collect()
    a = spark.createDataFrame([("s", [1.0, -3.0, 3.0])], "seq_id string, attribution array<double>")
    assert values(sc.attribution_summary(a), "max_abs", "argmax") == [(3.0, 1)]


def test_genome(spark):
    lines = spark.createDataFrame([("chr1", i, "a" * 25) for i in range(100)] + [("chr1", 100 + i, "C" * 25) for i in range(100)], "chrom string, line_no long, seq string")
    tiles = gn.tile_genome(lines.repartition(5), 64)
    w = spark.createDataFrame([("a", "chr1", 2490, 2510), ("b", "chr1", 4990, 5010), ("c", "chrX", 0, 10), ("d", "chr1", 9000, 9010)], "id string, chrom string, start long, end long")
    assert values(gn.extract_windows(w, tiles, "id", 64), "id", "seq")[:2] == [("a", "A" * 10 + "C" * 10), ("b", "C" * 10)]
    assert {r["id"]: r["seq"] for r in gn.extract_windows(w, tiles, "id", 64).collect()}["c"] is None
    i = spark.createDataFrame([("a", "chr1", 2500, "GGGG"), ("b", "chr1", 3, "GG"), ("c", "chrX", 5, "G"), ("d", "chr1", 5, "G" * 30)], "id string, chrom string, center long, seq string")
    got = {r["id"]: r["context"] for r in gn.context_windows(i, tiles, "id", 20, 64).collect()}
    assert got == {"a": "A" * 8 + "GGGG" + "C" * 8, "b": "N" * 7 + "AA" + "GG" + "A" * 9, "c": None, "d": None}


def test_sample_metadata(spark):
    text = "x\n!Sample_title = lost\n^SAMPLE = GSM1\n!Sample_title = a\n!Sample_title = b\n!Sample_characteristics_ch1 = Cell Type: CD4+ T cell \n!Sample_organism_ch1 = Homo sapiens\n!Sample_supplementary_file = ftp://ftp.ncbi.nlm.nih.gov/a.narrowPeak.gz\n^SAMPLE = GSM2\nAssembly: GRCh38 more"
    t = spark.createDataFrame([("GSE1", text)], "accession string, text string")
    s = pv.parse_sample_metadata(t)
    assert values(s, "gsm", "title", "organism") == [("GSM1", "b", "Homo sapiens"), ("GSM2", "", "")]
    assert values(pv.select_samples(s, {"CD4+ T cell": "CD4"}), "gsm", "cell_type", "url") == [("GSM1", "CD4", "https://ftp.ncbi.nlm.nih.gov/a.narrowPeak.gz")]
    assert t.select(pv.extract_assembly(F.col("text")).alias("b")).first()["b"] == "GRCh38"
    assert pv.map_cell_types(s, {}, default="U").count() == 2


def test_files(spark, tmp_path):
    (tmp_path / "p.tsv").write_text("# c\nchr1\t1000\t1400\tpeak1\t100\t.\t2.5\t5.0\t3.0\t100\nchr1\tx\t1\tn\t1\t.\t1\t1\t1\t1\nchr2\t5\t9\tn\t7\t.\n")
    assert values(files.read_narrowpeak(spark, str(tmp_path / "p.tsv")), "chrom", "start", "peak_score", "fold_enrichment", "summit_offset")[0] == ("chr1", 1000, 100.0, 2.5, 100)
    assert values(files.read_narrowpeak(spark, str(tmp_path / "p.tsv")).filter("chrom = 'chr2'"), "fold_enrichment", "summit_offset") == [(1.0, None)]
    (tmp_path / "h.tsv").write_text("#PeakID\tchr\tstart\tend\tfindPeaks Score\tFold Change vs Local\na\tchr1\t1\t5\t9.5\t2\n")
    assert values(files.read_homer(spark, str(tmp_path / "h.tsv")), "chrom", "start", "end", "peak_score", "fold_enrichment") == [("chr1", 1, 5, 9.5, 2.0)]
    (tmp_path / "a.fa").write_text("before\n>a one\nACGT\nACGT\n>b\nGG\n>b\nTT\n")
    assert values(files.read_fasta(spark, str(tmp_path / "a.fa")), "seq_id", "seq") == [("a", "ACGTACGT"), ("b", "TT")]
    with pytest.raises(ValueError):
        files.read_peaks(spark, "x", "other")
    (tmp_path / "bad.tsv").write_text("a\tb\n1\t2\n")
    with pytest.raises(ValueError):
        files.read_homer(spark, str(tmp_path / "bad.tsv"))
    sinks.write_fasta(seqs(spark, "ACGT"), str(tmp_path / "out"))
    assert values(files.read_fasta(spark, str(tmp_path / "out")), "seq_id", "seq") == [("s0", "ACGT")]


def test_perturbation_sets(spark):
    c = spark.createDataFrame([(f"s{i}", "ACGT" * 30, float(i)) for i in range(5)], "seq_id string, seq string, mssi_score double")
    occ = pt.occlusion_set(c, 2, 50, 1).collect()
    assert len(occ) == 8 and {r["peak_id"] for r in occ if r["variant"] == "intact"} == {"c00_s4_intact", "c01_s3_intact"}
    swaps = pt.cpg_swap_set(c, 1, 3, 1).collect()
    assert {r["variant"] for r in swaps} == {"intact", *pt.SWAPS} and all(Counter(r["seq"]) == Counter("ACGT" * 30) for r in swaps)
    with pytest.raises(ValueError):
        pt.occlusion_set(c, 2, 0, 1)


def test_fasta_of_several_files_with_carriage_returns_tabs_and_preambles(spark, tmp_path):
    for name, text in {"a.fa": "junk\n>a one\nAC\nGT\n>b\nTT\n", "b.fa": "more junk\nand more\n>c\tdesc\nGG\n", "c.fa": ">d\r\nAA\r\nCC\r\n"}.items():
        (tmp_path / name).write_bytes(text.encode())
    got = files.read_fasta(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == [("a", "ACGT"), ("b", "TT"), ("c", "GG"), ("d", "AACC")]


def test_unmatched_ids_and_short_tables_are_errors(spark):
    ids = spark.createDataFrame([("a",), ("b",)], "seq_id string")
    scores = spark.createDataFrame([("a", 1.0)], "seq_id string, mssi_score double")
    with pytest.raises(ValueError):
        rk.join_scores(ids, scores)
    assert rk.join_scores(ids, scores, validate=False).count() == 1
    with pytest.raises(ValueError):
        rk.select_top_k(scores, ids.filter("seq_id = 'b'"), 1)
    with pytest.raises(ValueError):
        rk.choose_loci(spark.createDataFrame([("p", 1.0)], "peak_id string, peak_score double"), 2, 1)
    with pytest.raises(ValueError):
        rk.pick_inserts(ids, 3)


def test_empty_lists_of_tracks_have_no_mean(spark):
    df = spark.createDataFrame([("a", [])], "seq_id string, attribution array<double>")
    assert sc.attribution_summary(df).first()["mean_abs"] is None


def test_genome_files_give_lines_of_their_contigs(spark, tmp_path):
    (tmp_path / "a.fa").write_bytes(b"junk\r\n>c1 first\r\nACGT\r\nAC\r\n>c2\tsecond\r\nTTTT\r\n")
    (tmp_path / "b.fa").write_bytes(b"lost\n>c3\n" + b"".join(bytes([65 + i % 2 * 2] * 50) + b"\n" for i in range(200)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        tiles = gn.tile_genome(files.read_genome(spark, str(tmp_path)), 100).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = {}
    for r in sorted(tiles, key=lambda r: (r["chrom"], r["tile"])):
        got[r["chrom"]] = got.get(r["chrom"], "") + r["seq"]
    assert got == {"c1": "ACGTAC", "c2": "TTTT", "c3": "".join("AC"[i % 2] * 50 for i in range(200))}


def test_numbering_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(rk, "BUCKET_ROWS", 5)
    rows = [(f"chr_{(i * 7919) % 3001:05d}", float((i * 31) % 97) if i % 50 else None) for i in range(3000)]
    df = spark.createDataFrame(rows, "id string, x double")
    by_text = rk.numbered(df, [F.col("id")]).collect()
    assert {r["id"]: r["row"] for r in by_text} == {k: n for n, k in enumerate(sorted(k for k, _ in rows))}
    by_number = rk.numbered(df, [F.col("x"), F.col("id")]).collect()
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    assert {r["id"]: r["row"] for r in by_number} == {k: n for n, (k, _) in enumerate(want)}


def test_loci_merge_across_buckets(spark):
    rows = [(f"r{i:03d}", "c", s, s + n) for i, (s, n) in enumerate([(0, 5), (5, 30), (12, 1), (36, 4), (80, 900), (200, 1), (500, 3), (979, 2), (981, 2), (990, 1)])]
    df = spark.createDataFrame(rows, "rs_id string, chrom string, start long, `end` long")
    for bucket in (10, 100_000):
        got = sorted((r["start"], r["end"], r["name"], r["score"]) for r in iv.merge_loci(df, bucket=bucket).collect())
        assert got == [(0, 35, "r000,r001,r002", 3), (36, 40, "r003", 1), (80, 983, "r004,r005,r006,r007,r008", 5), (990, 991, "r009", 1)]


def test_greedy_suppression_is_the_same_for_all_buckets(spark):
    rows = [(f"t{i % 2}", "c", (i * 7919) % 6007, float((i * 31) % 97)) for i in range(200)]
    df = spark.createDataFrame(rows, "cell_type string, chrom string, win_start long, peak_score double")
    want = set()
    for t in ("t0", "t1"):
        kept = []
        for s, w in sorted((-r[3], r[2]) for r in rows if r[0] == t):
            if all(abs(w - k) >= 50 for k in kept):
                kept.append(w)
        want |= {(t, w) for w in kept}
    for bucket in (64, 100_000):
        assert {(r["cell_type"], r["win_start"]) for r in iv.collapse_redundant_windows(df, 50, bucket=bucket).collect()} == want


def test_shared_windows_are_dropped_on_both_sides_of_a_bucket_edge(spark):
    rows = [("a", "c", 99_900), ("b", "c", 100_100), ("a", "c", 100_700), ("b", "c", 101_200), (None, "c", 99_950), ("a", "d", 5), ("a", "d", 6)]
    df = spark.createDataFrame(rows, "cell_type string, chrom string, win_start long")
    got = sorted(map(repr, map(tuple, iv.drop_shared_windows(df).collect())))
    assert got == sorted(map(repr, [("a", "c", 100_700), ("b", "c", 101_200), (None, "c", 99_950), ("a", "d", 5), ("a", "d", 6)]))
