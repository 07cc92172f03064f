"""Operators whose plan changed for scale, against plain Python."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from locus.operators import genome as gn
from locus.operators import intervals as iv
from locus.operators import motifs as mo
from locus.operators import perturb as pt
from locus.operators import provenance as pv
from locus.operators import ranking as rk
from locus.operators import seqstats as ss
from locus.operators import spacing
from locus.operators import stats as stt
from locus.plans import dataset as ds
from locus.plans import q_jobs as qj
from locus.plans import q_scores
from locus.plans import standins as st
from locus.sources import files, sinks


@pytest.fixture
def small_blocks(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def greedy(rows, separation):
    kept = []
    for _, start in sorted((-(score if score is not None else float("-inf")), start) for start, score in rows):
        if all(abs(start - k) >= separation for k in kept):
            kept.append(start)
    return sorted(kept)


@pytest.mark.parametrize("kind", ["random", "rising", "falling", "equal", "null"])
def test_spacing_equals_greedy_choice(spark, kind):
    rng = random.Random(kind)
    starts = sorted(rng.sample(range(-500, 6000), 700))
    score = {"random": lambda i: rng.randint(0, 50), "rising": lambda i: i, "falling": lambda i: -i, "equal": lambda i: 1, "null": lambda i: None}[kind]
    rows = [(s, score(i)) for i, s in enumerate(starts)]
    data = [(c, "chr1", s, None if v is None else float(v), "kept") for c in ("a", None) for s, v in rows]
    df = spark.createDataFrame(data, "cell_type string, chrom string, win_start long, peak_score double, other string").repartition(5)
    for bucket in (100, 1000, 100_000):
        got = spacing.spaced(df, ["cell_type", "chrom"], 40, bucket).collect()
        for c in ("a", None):
            assert sorted(r["win_start"] for r in got if r["cell_type"] == c) == greedy(rows, 40)
        assert all(r["other"] == "kept" for r in got)
    assert spacing.spaced(df.limit(0), ["cell_type", "chrom"], 40, 100).count() == 0


def test_collapse_with_dedupe_equals_both_steps(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), "c1", rng.randint(0, 3000), float(rng.randint(0, 9)), rng.choice("xyz"), i, i + 1) for i in range(600)]
    df = spark.createDataFrame(rows, "cell_type string, chrom string, win_start long, peak_score double, gsm string, start int, end int")
    two = iv.collapse_redundant_windows(iv.dedupe_best(df), 50, bucket=200)
    assert sorted(map(tuple, iv.collapse_redundant_windows(df, 50, bucket=200, dedupe=True).collect())) == sorted(map(tuple, two.collect()))


def matrix_rows(spark, widths, seed=1):
    rng = random.Random(seed)
    data = []
    for m, w in enumerate(widths):
        odds = [[rng.uniform(-3, 2) for _ in "acgt"] for _ in range(w)]
        low, high = sum(map(min, odds)), sum(map(max, odds))
        data.append((f"t{m}", f"m{m}", w, [tuple(x) for x in odds], low, high, low + 0.8 * (high - low)))
    return spark.createDataFrame(data, "tf string, matrix_id string, width int, logodds array<struct<a:double,c:double,g:double,t:double>>, min double, max double, threshold double")


def naive_hits(seqs, matrices):
    out = []
    for r in matrices:
        m = np.array([[x[b] for b in "acgt"] for x in r["logodds"]])
        for i, seq in seqs:
            for strand, scores in (("+", m), ("-", m[::-1, ::-1])):
                for at in range(len(seq or "") - len(m) + 1):
                    word = "".join(c.upper() if c in "acgt" else c for c in seq[at : at + len(m)])
                    if set(word) <= set("ACGT"):
                        score = round(sum(scores[j]["ACGT".index(c)] for j, c in enumerate(word)), 9)
                        if score >= round(r["threshold"], 9):
                            out.append((i, r["tf"], at, at + len(m), strand, word, round(score, 6)))
    return sorted(out, key=str)


def test_scan_equals_column_sums_also_across_pieces(spark, monkeypatch):
    rng = random.Random(2)
    seqs = [("a", "".join(rng.choice("ACGTacgtN") if rng.random() < 0.1 else rng.choice("ACGT") for _ in range(900))), ("b", ""), ("c", None), ("d", "ßACGT" * 30 + " " + "TTGACA" * 9), ("e", "AC"), (None, "ACGTACGTTGCA" * 5)]
    df, matrices = spark.createDataFrame(seqs, "seq_id string, seq string"), matrix_rows(spark, [1, 4, 6, 7, 13, 20])
    want = naive_hits([s for s in seqs if s[1]], matrices.collect())
    for stretch in (1 << 22, 100, 25):
        monkeypatch.setattr(mo, "STRETCH", stretch)
        monkeypatch.setattr(mo, "HELD", 7)
        got = mo.scan_motifs(df, matrices).collect()
        assert sorted(((r["seq_id"], r["tf"], r["start"], r["end"], r["strand"], r["match_seq"], round(r["score"], 6)) for r in got), key=str) == want
    assert mo.scan_motifs(df.limit(0), matrices).count() == 0


def test_stored_genome_is_not_shuffled(spark, tmp_path):
    rng = random.Random(5)
    contigs = {c: "".join(rng.choice("ACGT") for _ in range(n)) for c, n in (("c1", 2000), ("c2", 130))}
    lines = spark.createDataFrame([(c, i, s[i : i + 70]) for c, s in contigs.items() for i in range(0, len(s), 70)], "chrom string, line_no long, seq string")
    stored = gn.store_genome(gn.tile_genome(lines, 64), "genome_of_test", f"file://{tmp_path}/genome", 64, buckets=4)
    assert {r["chrom"]: r["length"] for r in stored.contigs.collect()} == {c: len(s) for c, s in contigs.items()}
    spans = [(i, rng.choice(["c1", "c2", "cx", None]), a := rng.randint(0, 2100), a + rng.randint(-3, 300), "x") for i in range(200)]
    df = spark.createDataFrame(spans, "id int, chrom string, start long, end long, other string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cut = gn.extract_windows(df, stored, "id")
        plan = cut._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    scan = next(k for k, x in enumerate(plan) if "genome_of_test" in x)
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    above, at = [], depth(plan[scan])
    for x in plan[:scan][::-1]:  # from the scan up to its join
        if depth(x) < at:
            above.append(x)
            at = depth(x)
            if "Join" in x:
                break
    assert "SortMergeJoin" in above[-1] and not any("Exchange" in x for x in above), "\n".join(plan)
    assert {r["id"]: (r["seq"], r["other"]) for r in cut.collect()} == {i: (contigs[c][a : max(a, b)] if c in contigs else None, "x") for i, c, a, b, _ in spans}
    spark.sql("DROP TABLE genome_of_test")


def test_contigs_go_on_in_further_files(spark, tmp_path, small_blocks):
    a, b = "ACGTTGCA" * 60, "TTTTCCCC" * 40
    (tmp_path / "1.fa").write_text("skipped\n>c1 x\n" + "\n".join(a[i : i + 30] for i in range(0, 240, 30)) + "\n")
    (tmp_path / "2.fa").write_text(">c1\n" + "\n".join(a[i : i + 30] for i in range(240, 480, 30)) + "\n>c2\n" + b + "\n")
    tiles = gn.tile_genome(files.read_genome(spark, str(tmp_path)), 50).collect()
    got = {}
    for r in sorted(tiles, key=lambda r: (r["chrom"], r["tile"])):
        got[r["chrom"]] = got.get(r["chrom"], "") + r["seq"]
    assert got == {"c1": a, "c2": b}


def test_last_record_of_a_repeated_id_wins(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">x\nTTTT\n>y\nAC\n>x more\nGG\nGG\n")
    (tmp_path / "b.fa").write_text(">y\nAA\n")
    assert {r["seq_id"]: r["seq"] for r in files.read_fasta(spark, str(tmp_path)).collect()} == {"x": "GGGG", "y": "AA"}


def test_fasta_with_metadata_is_aligned_and_whole(spark, tmp_path):
    rows = [(f"s{i}", "ACGT" * (i % 5), i, 'a "quoted", text' if i % 3 else None) for i in range(500)]
    path = f"file://{tmp_path}/out"
    sinks.write_fasta_with_metadata(spark.createDataFrame(rows, "seq_id string, seq string, n int, note string").repartition(4), path)
    parts = sorted(p.stem for p in (tmp_path / "out/sequences").glob("*.fasta"))
    assert len(parts) == 4 and parts == sorted(p.stem for p in (tmp_path / "out/metadata.csv").glob("*.csv"))
    for p in parts:  # row by row the same ids
        ids = [x[1:] for x in (tmp_path / f"out/sequences/{p}.fasta").read_text().splitlines() if x.startswith(">")]
        table = spark.read.csv(f"file://{tmp_path}/out/metadata.csv/{p}.csv", header=True, escape='"').toPandas()
        assert ids == table["peak_id"].tolist()
    back = spark.read.csv(f"file://{tmp_path}/out/metadata.csv", header=True, schema="peak_id string, n int, note string", escape='"')
    assert sorted(map(tuple, back.collect()), key=str) == sorted(((a, c, d) for a, _, c, d in rows), key=str)
    assert {r["seq_id"]: r["seq"] for r in files.read_fasta(spark, f"{path}/sequences").collect()} == {a: b for a, b, _, _ in rows}
    assert [p.name for p in (tmp_path / "out").iterdir() if p.name.startswith("_")] == []


def test_fasta_with_metadata_leaves_nothing_of_a_failed_job(spark, tmp_path):
    bad = F.udf(lambda i: 1 // (7 - i), "int")
    df = spark.range(10, numPartitions=2).select(F.col("id").cast("string").alias("seq_id"), F.lit("A").alias("seq"), bad("id").alias("n"))
    with pytest.raises(Exception):
        sinks.write_fasta_with_metadata(df, f"file://{tmp_path}/bad")
    assert list(tmp_path.glob("bad/*/*")) == [] and list(tmp_path.glob("bad/_*")) == []


def test_score_report_in_pages(spark, tmp_path):
    rows = [(f"s{i}", i / 7, [1.0], [0.5], "ct", [3]) for i in range(700)]
    df = spark.createDataFrame(rows, "seq_id string, mssi_score double, target_signal array<double>, background_signal array<double>, cell_type string, target_tracks array<int>")
    sinks.write_score_report(df, f"file://{tmp_path}/r", page=50)
    assert spark.read.text(f"file://{tmp_path}/r").count() >= 10
    assert sorted(map(tuple, files.read_score_report(spark, f"file://{tmp_path}/r", multi_line=False).collect())) == sorted((r[0], r[1]) for r in rows)


def test_records_that_cross_blocks(spark, tmp_path, small_blocks):
    text = "ignored\n^SERIES = GSE7\n!Series_x = Assembly: hg19\n" + "".join(f"^SAMPLE = GSM{i}\n!Sample_title = t{i}\n" + "".join(f"!Sample_characteristics_ch1 = k{j}: {i}\n" for j in range(12)) for i in range(9))
    (tmp_path / "GSE7_family.soft").write_text(text + "^SERIES = GSE8\n!Series_y = Assembly: hg38 z\n^SAMPLE = GSM99\n!Sample_title = last\n")
    (tmp_path / "GSE9_family.soft").write_text("^SAMPLE = GSM5\r\n!Sample_title = a\r\n!Sample_title = b\r\n")
    lines = files.read_sample_metadata(spark, str(tmp_path))
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 5
    got = {(r["accession"], r["gsm"]): (r["title"], r["characteristics"]) for r in pv.sample_records(lines).collect()}
    assert got == {("GSE7", f"GSM{i}"): (f"t{i}", [f"k{j}: {i}" for j in range(12)]) for i in range(9)} | {("GSE8", "GSM99"): ("last", []), ("GSE9", "GSM5"): ("b", [])}
    assert {r["accession"]: r["genome_build"] for r in pv.first_assembly(lines).collect()} == {"GSE7": "hg19", "GSE8": "hg38", "GSE9": None}


def test_permutations_share_their_draws(spark):
    rng = random.Random(8)
    units = list(range(40))
    rows = [(u, f"s{k}", "selected" if u % 3 else "rejected", None if k == 2 and u % 5 == 0 else float("nan") if k == 3 and u == 1 else rng.gauss(u % 3 * k, 1)) for u in units for k in range(6)]
    long = spark.createDataFrame(rows, "unit long, statistic string, grp string, value double")
    n = 10_000
    got = {r["statistic"]: r["p"] for r in stt.permutation_test(long, n, 4).collect()}
    orders = [sorted(units, key=lambda u: hashlib.md5(f"4:{i}:{u}".encode()).hexdigest()) for i in range(n)]
    for k in range(6):
        value = {u: v for u, s, _, v in rows if s == f"s{k}" and v is not None and v == v}
        chosen = [u for u in value if u % 3]
        mean = lambda us: sum(value[u] for u in us) / len(us)
        seen, far = abs(mean(chosen) - mean([u for u in value if not u % 3])), 0
        for order in orders:
            drawn = [u for u in order if u in value]
            far += abs(mean(drawn[: len(chosen)]) - mean(drawn[len(chosen) :])) >= seen - 1e-12
        assert got[f"s{k}"] == pytest.approx((far + 1) / (n + 1))


def test_permutations_by_rows_and_in_blocks_agree(spark):
    rng = random.Random(9)
    rows = [(f"u{u}", f"s{k}", rng.choice(["selected", "rejected"]), rng.random()) for u in range(30) for k in range(3) if rng.random() < 0.9]
    long = spark.createDataFrame(rows, "unit string, statistic string, grp string, value double")
    a, b = (sorted(map(tuple, stt.permutation_test(long, 60, 1, held=held).collect())) for held in (10**6, 0))
    assert [x[0] for x in a] == [x[0] for x in b] and all(p == pytest.approx(q) for x, y in zip(a, b) for p, q in zip(x[1:], y[1:]))
    doubled = long.unionByName(long.limit(1))  # a unit twice goes by rows
    assert stt.permutation_test(doubled, 20, 1).count() == 3
    assert stt.permutation_test(long.limit(0), 20, 1).count() == 0


def test_a_table_of_one_value_is_dealt_evenly(spark, monkeypatch):
    monkeypatch.setattr(rk, "BUCKET_ROWS", 500)
    df = spark.range(10_000).select(F.lit(1.0).alias("v"), "id").repartition(3)
    rows = rk.numbered(df, [F.col("v"), F.col("id")], bucket="part")
    assert [r["row"] for r in rows.orderBy("id").collect()] == list(range(10_000))
    assert max(r["count"] for r in rows.groupBy("part").count().collect()) < 1500


def test_profiles_of_pools_equal_single_profiles(spark):
    rng = random.Random(4)
    rows = [(i, f"s{i}", rng.choice(["x", "y", "en"]), "".join(rng.choice("ACGT") for _ in range(rng.randint(0, 60)))) for i in range(150)] + [(200, "e", "empty", "")]
    df = spark.createDataFrame(rows, "n long, seq_id string, pool string, seq string")
    got = {r["pool"]: tuple(r)[1:] for r in ss.realism_profiles(df, "n", "pool").collect()}
    for pool in ("x", "y", "en", "empty"):
        assert got[pool] == pytest.approx(tuple(ss.realism_profile(df.filter(F.col("pool") == pool), "n").first()))
    kept = ss.with_control(df, "pool", "en", 1)
    assert kept.count() == len(rows) + sum(r[2] == "en" for r in rows)
    assert {r["pool"] for r in ss.realism_of_pools(ss.realism_profiles(kept, "n", "pool"), "pool", "en").collect()} == {"x", "y", "empty"}


def test_dataset_job_counts_what_it_drops(spark):
    d = "/root/testdata/sf0.01"
    out = st.folder(spark, "job")
    rows = qj.sample_files(spark, d)
    manifest = st.folder(spark, "manifest")
    rows.agg(F.to_json(F.array_sort(F.collect_list(F.struct(*rows.columns)))).alias("value")).write.text(manifest)
    counts = ds.dataset_job(spark, pages=qj.page_files(spark, d), manifest=manifest, genome=qj.genome_files(spark, d), out=out, primary=st.PRIMARY, types=["ct0", "ct1", "ct2"], flank=st.FLANK)
    assert counts["windows"] == counts["kept"] + counts["missing_contig"] + counts["length"] + counts["n_fraction"] and counts["kept"] > 0
    assert spark.read.parquet(f"{out}/dataset/data").count() == counts["kept"] == files.read_fasta(spark, f"{out}/sequences/sequences").count()
    assert spark.read.json(f"{out}/manifest").first().asDict() == counts
    assert spark.read.csv(f"{out}/windows.bed", sep="\t").count() == counts["windows"] and spark.read.csv(f"{out}/loci.bed", sep="\t").count() == counts["loci"]


def test_stacked_variants_are_named_or_bring_their_names(spark):
    one = spark.createDataFrame([("a",), ("b",)], "seq_id string")
    sets = spark.createDataFrame([("up", "a"), ("down", "a"), (None, "b")], "variant string, seq_id string")
    got = pt.stack_variants(sets, intact=one)
    assert got.columns == ["seq_id", "variant"]
    assert sorted(map(tuple, got.collect()), key=str) == [("a", "down"), ("a", "intact"), ("a", "up"), ("b", "intact"), ("b", None)]


def test_the_stacked_query_names_each_row_by_its_cell_type(spark):
    rows = q_scores.queries()["stack_variants"](spark, "/root/testdata/sf0.001")
    types = st.table(spark, "/root/testdata/sf0.001", "embeddings").select(F.concat(F.lit("v"), F.col("vec_id")).alias("seq_id"), F.concat(F.lit("ct"), F.col("label") % 3).alias("t"))
    assert sorted(map(tuple, rows.filter("variant <> 'intact'").collect())) == sorted(map(tuple, types.collect()))
    assert rows.filter("variant = 'intact'").count() == types.count()
