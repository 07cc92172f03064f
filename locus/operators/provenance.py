"""Sample metadata: parsing, lookup, verification and selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Line prefixes of the metadata format, the address that downloads use instead, and accession patterns.
SERIES, RECORD, TITLE, TRAITS, FILES, ORGANISM, STRATEGY = "^SERIES", "^SAMPLE", "!Sample_title", "!Sample_characteristics_ch1", "!Sample_supplementary_file", "!Sample_organism_ch1", "!Sample_library_strategy"
FTP, HTTPS = "ftp://ftp.ncbi.nlm.nih.gov", "https://ftp.ncbi.nlm.nih.gov"
ACCESSION = r"(EFO_\d+|MONDO_\d+|HP_\d+|GSE\d+)"


def parse_sample_metadata(texts: DataFrame) -> DataFrame:
    """texts(accession, text), short ones held whole, to one row per sample (see sample_records)."""
    lines = texts.select("accession", F.posexplode(F.split("text", r"\r\n|\n|\r")).alias("pos", "line")).withColumn("line", F.rtrim("line"))
    sample = F.sum(F.startswith("line", F.lit(RECORD)).cast("int")).over(W.partitionBy("accession").orderBy("pos"))
    return sample_records(lines.withColumn("sample", F.nullif(sample, F.lit(0))))


def sample_records(lines: DataFrame) -> DataFrame:
    """lines(accession, sample, pos, line) to one row per sample: gsm, title, organism, library_strategy, characteristics, supplementary_urls.

    Scalars take the last line that gives them, lists keep the order of pos, lines of no sample are ignored.
    """
    rows = lines.filter("sample IS NOT NULL").withColumn("value", F.trim(F.regexp_replace("line", r"^[^=]*=", "")))

    def starts(prefix: str) -> Column:
        return F.startswith("line", F.lit(prefix))

    def last(prefix: str) -> Column:
        return F.max_by("value", F.when(starts(prefix), F.col("pos")))

    def all_of(prefix: str) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.when(starts(prefix), F.struct("pos", "value")))), lambda x: x["value"])

    return rows.groupBy("accession", "sample").agg(
        last(RECORD).alias("gsm"), F.coalesce(last(TITLE), F.lit("")).alias("title"), F.coalesce(last(ORGANISM), F.lit("")).alias("organism"),
        F.coalesce(last(STRATEGY), F.lit("")).alias("library_strategy"), all_of(TRAITS).alias("characteristics"), all_of(FILES).alias("supplementary_urls"),
    ).drop("sample")


def first_assembly(lines: DataFrame) -> DataFrame:
    """accession and the genome_build that its first line with one names; null without any."""
    build = extract_assembly(F.col("line"))
    return lines.groupBy("accession").agg(F.min_by(build, F.when(build.isNotNull(), F.col("pos"))).alias("genome_build"))


def extract_assembly(text: Column) -> Column:
    found = F.regexp_extract(text, r"Assembly:\s*(\S+)", 1)
    return F.when(found != "", found)


def clean_accession(value: Column) -> Column:
    found = F.regexp_extract(value, ACCESSION, 1)
    return F.when(found != "", found).otherwise(F.trim(value))


def characteristic_lookup(characteristics: Column, key: str) -> Column:
    """The value of the first `key: value` entry, whatever its case; null without one."""
    found = F.filter(characteristics, lambda x: F.startswith(F.lower(x), F.lit(f"{key.lower()}:")))
    return F.trim(F.regexp_replace(F.get(found, F.lit(0)), r"^[^:]*:", ""))


def map_cell_types(samples: DataFrame, mapping: dict[str, str], title_regex: str | None = None, default: str | None = None) -> DataFrame:
    """Adds cell_type by the `cell type` characteristic, else `default` where the title matches; other samples go.

    Without a mapping and a pattern every sample gets the default.
    """
    raw = characteristic_lookup(F.col("characteristics"), "cell type")
    mapped = F.element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), raw) if mapping else None
    fallback = F.when(F.col("title").rlike(title_regex), F.lit(default)) if title_regex else (F.lit(default) if not mapping else F.lit(None).cast("string"))
    return samples.withColumn("cell_type", F.coalesce(*([mapped] if mapped is not None else []), fallback)).filter("cell_type IS NOT NULL")


def select_samples(samples: DataFrame, mapping: dict[str, str], url_regex: str = ".*", title_regex: str | None = None, default: str | None = None, validate: bool = False) -> DataFrame:
    """accession, gsm, title, cell_type and the first matching url, by https."""
    typed = map_cell_types(samples, mapping, title_regex, default)
    url = F.get(F.filter("supplementary_urls", lambda u: u.rlike(url_regex)), F.lit(0))
    out = typed.withColumn("url", F.replace(url, F.lit(FTP), F.lit(HTTPS))).filter("url IS NOT NULL").select("accession", "gsm", "title", "cell_type", "url")
    if validate and out.isEmpty():
        raise ValueError("no sample is left")
    return out


def verify_series(samples: DataFrame, assemblies: DataFrame, expected: DataFrame, builds: list[str]) -> DataFrame:
    """accession, observed organisms, strategies, n_samples, genome_build and the list of problems against expected(accession, organism, library_strategy, n_samples)."""
    some = lambda c: F.array_sort(F.collect_set(F.when(F.col(c) != "", F.col(c))))
    seen = samples.groupBy("accession").agg(some("organism").alias("organism"), some("library_strategy").alias("library_strategy"), F.count(F.lit(1)).alias("n_samples"))
    met = seen.join(assemblies.select("accession", "genome_build"), "accession", "left")
    met = met.join(expected.select("accession", *[F.col(c).alias(f"_{c}") for c in ("organism", "library_strategy", "n_samples")]), "accession", "left")

    def differs(c: str) -> Column:
        return F.when(F.col(f"_{c}").isNotNull() & (F.col(c) != F.array(F.col(f"_{c}"))), c)

    build = F.when(F.col("genome_build").isNotNull() & ~F.lower("genome_build").isin([b.lower() for b in builds]), "genome_build")
    count = F.when(F.col("_n_samples").isNotNull() & (F.col("_n_samples") != F.col("n_samples")), "n_samples")
    problems = F.array_compact(F.array(differs("organism"), differs("library_strategy"), count, build))
    return met.withColumn("problems", problems).drop("_organism", "_library_strategy", "_n_samples")


def build_violations(declared: DataFrame, builds: list[str]) -> DataFrame:
    """Rows of declared(accession, genome_build) whose build is not accepted, whatever its case."""
    return declared.filter(~F.coalesce(F.lower("genome_build").isin([b.lower() for b in builds]), F.lit(False)))
