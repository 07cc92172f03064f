"""Readers of peak, locus, sequence and report files. All columns are read as text and cast, so that bad numbers become null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locus.operators import provenance as pv

#: The ten columns of the narrowPeak layout, and the renamed columns of the other format.
NARROW = ["chrom", "start", "end", "name", "peak_score", "strand", "fold_enrichment", "p_value", "q_value", "summit_offset"]
HOMER = {"chr": "chrom", "start": "start", "end": "end", "findPeaks Score": "peak_score", "Fold Change vs Local": "fold_enrichment"}
PEAK_COLUMNS = {"chrom": "string", "start": "long", "end": "long", "peak_score": "double", "fold_enrichment": "double", "summit_offset": "long"}


def _number(c: str, kind: str) -> Column:
    return F.expr(f"CAST(try_cast(`{c}` AS double) AS {kind})") if kind == "long" else F.expr(f"try_cast(`{c}` AS {kind})")


def _peaks(df: DataFrame, *extra: str) -> DataFrame:
    out = df.select(*[(F.col(c) if k == "string" else _number(c, k)).alias(c) for c, k in PEAK_COLUMNS.items()], *extra)
    return out.dropna(subset=["start", "end", "peak_score", "fold_enrichment"])


def _not_empty(df: DataFrame, what: str, validate: bool) -> DataFrame:
    if validate and df.isEmpty():
        raise ValueError(f"no rows in {what}")
    return df


def read_narrowpeak(spark: SparkSession, paths: str | list[str], validate: bool = False, with_path: bool = False) -> DataFrame:
    """Headerless tab-separated peaks, `#` lines left out; an absent fold column is 1.0, an absent summit null. Extra columns are ignored."""
    schema = ", ".join(f"`{c}` string" for c in NARROW)
    rows = spark.read.csv(paths, sep="\t", comment="#", schema=schema, mode="PERMISSIVE")
    rows = rows.withColumn("fold_enrichment", F.coalesce("fold_enrichment", F.lit("1.0")))
    extra = [F.col("_metadata.file_path").alias("path")] if with_path else []
    return _not_empty(_peaks(rows, *extra), str(paths), validate)


def read_homer(spark: SparkSession, paths: str | list[str], validate: bool = False, with_path: bool = False) -> DataFrame:
    """Headed tab-separated peaks; `#` before a header is dropped. The summit is always null."""
    rows = spark.read.csv(paths, sep="\t", header=True)
    names = {c: c.strip().lstrip("#").strip() for c in rows.columns}
    missing = sorted(set(HOMER) - set(names.values()))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    extra = [F.col("_metadata.file_path").alias("path")] if with_path else []
    picked = rows.select(*[F.col(f"`{c}`").alias(HOMER[n]) for c, n in names.items() if n in HOMER], F.lit(None).cast("string").alias("summit_offset"), *extra)
    return _not_empty(_peaks(picked, *(["path"] if with_path else [])), str(paths), validate)


def read_peaks(spark: SparkSession, paths: str | list[str], peak_format: str, **options: bool) -> DataFrame:
    readers = {"narrowPeak": read_narrowpeak, "homer": read_homer}
    if peak_format not in readers:
        raise ValueError(f"unknown peak format {peak_format}")
    return readers[peak_format](spark, paths, **options)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list of samples."""
    names = ["accession", "gsm", "title", "cell_type", "url", "peak_format", "local_path"]
    return spark.read.json(path, multiLine=True, schema=", ".join(f"{n} string" for n in names))


def scan_samples(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """All samples' peaks, pooled, with cell_type and gsm. The manifest is a list of files, so short."""
    listed = manifest.select("local_path", "peak_format").distinct().collect()
    parts = []
    for kind in sorted({r["peak_format"] for r in listed}):
        parts.append(read_peaks(spark, sorted(r["local_path"] for r in listed if r["peak_format"] == kind), kind, with_path=True))
    pooled = reduce(DataFrame.unionByName, parts)
    plain = lambda c: F.regexp_replace(c, "^[A-Za-z0-9]+:/*", "/")
    tags = manifest.select(plain("local_path").alias("_file"), "cell_type", "gsm")
    return pooled.withColumn("_file", plain("path")).join(F.broadcast(tags), "_file").drop("_file", "path")


def read_loci_bed(spark: SparkSession, path: str, validate: bool = False) -> DataFrame:
    """The first three columns of a BED file, `#` lines left out."""
    rows = spark.read.csv(path, sep="\t", comment="#", schema="chrom string, start string, `end` string")
    return _not_empty(rows.select("chrom", _number("start", "long").alias("start"), _number("end", "long").alias("end")), path, validate)


VARIANT_PAGE = "_embedded struct<singleNucleotidePolymorphisms: array<struct<rsId: string, functionalClass: string, locations: array<struct<chromosomeName: string, chromosomePosition: bigint>>>>>"


def variants_from_pages(spark: SparkSession, path: str, validate: bool = False) -> DataFrame:
    """Nested pages to one row per variant and location, `chr` put before bare names, de-duplicated."""
    pages = spark.read.json(path, schema=VARIANT_PAGE)
    snp = pages.select(F.explode("_embedded.singleNucleotidePolymorphisms").alias("s"))
    rows = snp.select(F.col("s.rsId").alias("rs_id"), F.col("s.functionalClass").alias("functional_class"), F.explode("s.locations").alias("l"))
    chrom = F.when(F.startswith("l.chromosomeName", F.lit("chr")), F.col("l.chromosomeName")).otherwise(F.concat(F.lit("chr"), F.col("l.chromosomeName")))
    rows = rows.select("rs_id", chrom.alias("chrom"), F.col("l.chromosomePosition").alias("pos"), "functional_class").dropna(subset=["chrom", "pos"])
    return _not_empty(rows.groupBy("rs_id", "chrom", "pos").agg(F.min("functional_class").alias("functional_class")), path, validate)


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """seq_id and seq; the id is the header's first word, wrapped lines are joined, text before the first header is left out.

    Files are split at headers, so a large one is read by many tasks. A repeated id keeps its last
    record: by file name, then place in the file.
    """
    text = spark.read.option("lineSep", "\n>").text(path).select(
        F.col("value").alias("v"), F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i")
    )
    # Only a file's first record keeps its mark; if it has none, it is text before the first header.
    heads = text.filter("_b = 0").groupBy("_f").agg(F.min("_i").alias("_first"))
    record = F.regexp_replace("v", r"^>", "")
    first = F.coalesce((F.col("_b") == 0) & (F.col("_i") == F.col("_first")), F.lit(False))
    rows = text.join(heads, "_f", "left").filter((F.startswith("v", F.lit(">")) | ~first) & (F.length(F.trim(record)) > 0))
    head = F.split_part(record, F.lit("\n"), F.lit(1))
    body = F.regexp_replace(F.substring(record, F.length(head) + 1, F.length(record)), r"\s+", "")
    out = rows.select(F.regexp_extract(head, r"^\s*(\S*)", 1).alias("seq_id"), body.alias("seq"), F.struct("_f", "_b", "_i").alias("_at"))
    return out.groupBy("seq_id").agg(F.max_by("seq", "_at").alias("seq"))


def _lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines of text files, with their file _f, its _size, the start _s of their block and a number _line that rises in the file."""
    text = spark.read.text(paths).select(
        F.rtrim("value").alias("line"), F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_size").alias("_size"), F.col("_metadata.file_block_start").alias("_s"), F.monotonically_increasing_id().alias("_i")
    )
    # A line takes at least a byte, so block start and number within the block order all lines of a file.
    return text.withColumn("_line", F.col("_s") + F.row_number().over(W.partitionBy("_f", "_s").orderBy("_i"))).drop("_i")


def _fill_down(rows: DataFrame, marks: dict[str, Column]) -> DataFrame:
    """Adds to each of _lines' rows the last value of each mark that isn't null, at or before it in its file.

    Found within the row's block, else carried over from the blocks before it by a window over
    one row per block, so a file is as many tasks as it has blocks.
    """
    rows = rows.withColumns({f"_m_{n}": c for n, c in marks.items()})
    block = W.partitionBy("_f", "_s").orderBy("_line").rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy("_f").orderBy("_s").rowsBetween(W.unboundedPreceding, -1)
    last = rows.groupBy("_f", "_s").agg(*[F.max_by(f"_m_{n}", F.when(F.col(f"_m_{n}").isNotNull(), F.col("_line"))).alias(f"_l_{n}") for n in marks])
    carried = last.select("_f", "_s", *[F.last(f"_l_{n}", ignorenulls=True).over(before).alias(f"_c_{n}") for n in marks])
    own = {f"_o_{n}": F.last(f"_m_{n}", ignorenulls=True).over(block) for n in marks}
    out = rows.withColumns(own).join(carried, ["_f", "_s"]).withColumns({n: F.coalesce(f"_o_{n}", f"_c_{n}") for n in marks})
    return out.drop(*[f"_{k}_{n}" for k in "moc" for n in marks])


def read_genome(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """A genome's FASTA files as (chrom, line_no, seq), one row per line, for tile_genome.

    A line belongs to the last header before it in its file. line_no rises along a contig, with
    gaps; a contig may go on in further files, in the order of their names, each of which begins
    with its header again. Text before a file's first header is left out.
    """
    rows = _lines(spark, paths)
    head = F.when(F.startswith("line", F.lit(">")), F.regexp_extract("line", r"^>\s*(\S*)", 1))
    per_file = rows.groupBy("_f").agg((F.max("_size") + 1).alias("_n"))  # a row per file
    offsets = per_file.select("_f", F.coalesce(F.sum("_n").over(W.orderBy("_f").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
    out = _fill_down(rows, {"chrom": head}).filter(~F.startswith("line", F.lit(">")) & F.col("chrom").isNotNull() & (F.length("line") > 0))
    return out.join(offsets, "_f").select("chrom", (F.col("_offset") + F.col("_line")).alias("line_no"), F.col("line").alias("seq"))


def read_sample_metadata(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines (accession, sample, pos, line) of SOFT files, for provenance.sample_records and first_assembly.

    Large files are read by many tasks: the series and the record that a line belongs to are
    carried over lines. The accession is the value of the last ^SERIES line, else the file's name
    up to its first dot or underscore; lines before a series' first record have a null sample.
    """
    value = F.trim(F.regexp_replace("line", r"^[^=]*=", ""))
    series = F.when(F.startswith("line", F.lit(pv.SERIES)), F.struct(value.alias("v"), F.col("_line").alias("at")))
    sample = F.when(F.startswith("line", F.lit(pv.RECORD)), F.col("_line"))
    rows = _fill_down(_lines(spark, paths), {"series": series, "sample": sample})
    name = F.regexp_extract("_f", r"([^/._]+)[^/]*$", 1)
    begun = F.when(F.coalesce(F.col("sample") > F.col("series.at"), F.col("sample").isNotNull()), F.concat_ws(":", "_f", "sample"))
    return rows.select(F.coalesce("series.v", name).alias("accession"), begun.alias("sample"), F.struct("_f", "_line").alias("pos"), "line")


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """The sequences of a report that write_report wrote."""
    return spark.read.schema("seq_id string, mssi_score double").json(f"{path}/sequences")


#: A report's sequences by id.
ENTRIES = "map<string, struct<mssi_score: double, target_signal: array<double>, background_signal: array<double>, cell_type: string, target_tracks: array<int>>>"


def read_score_report(spark: SparkSession, path: str | list[str], validate: bool = False, multi_line: bool = True) -> DataFrame:
    """seq_id and mssi_score of JSON reports with a map of sequences.

    A report is one JSON document, which one task reads; a large one comes as several files, or
    (multi_line off) as a document per line, as write_score_report writes them.
    """
    rows = spark.read.json(path, multiLine=multi_line, schema=f"sequences {ENTRIES}").select(F.explode("sequences").alias("seq_id", "s"))
    return _not_empty(rows.select("seq_id", F.col("s.mssi_score").alias("mssi_score")).filter("mssi_score IS NOT NULL"), str(path), validate)


def read_window_metadata(spark: SparkSession, path: str) -> DataFrame:
    """CSV, or tab-separated when the name doesn't end in .csv."""
    schema = "peak_id string, chrom string, start long, `end` long, cell_type string, peak_score double, fold_enrichment double, source_gsm string"
    return spark.read.csv(path, header=True, sep="," if path.rstrip("/").endswith(".csv") else "\t", schema=schema)
