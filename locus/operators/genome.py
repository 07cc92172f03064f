"""A reference genome as a table of tiles, and windows cut from it by equi-joins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locus.operators.shared import reused

TILE, LINE_BUCKET = 4096, 10_000
#: Tiles per bucket of a stored genome, the most buckets, and contigs that may go to every task.
BUCKET_TILES, MOST_BUCKETS, CONTIGS = 20_000, 4096, 1_000_000


def tile_genome(lines: DataFrame, tile: int = TILE) -> DataFrame:
    """lines(chrom, line_no, seq) to tiles (chrom, tile, seq), upper-cased; line_no orders a contig's lines.

    Offsets are sums within buckets of line numbers plus sums of the buckets before, so a
    contig isn't one task.
    """
    rows = lines.select("chrom", "line_no", F.upper("seq").alias("seq"), F.floor(F.col("line_no") / LINE_BUCKET).alias("_b")).filter(F.length("seq") > 0)
    size = F.length("seq").cast("long")
    before = W.partitionBy("chrom").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    per = rows.groupBy("chrom", "_b").agg(F.sum(size).alias("_s")).withColumn("_base", F.coalesce(F.sum("_s").over(before), F.lit(0))).drop("_s")
    inside = W.partitionBy("chrom", "_b").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_in", F.sum(size).over(inside) - size).join(per, ["chrom", "_b"]).withColumn("_at", F.col("_base") + F.col("_in"))
    rows = rows.withColumn("tile", F.explode(F.sequence(F.floor(F.col("_at") / tile), F.floor((F.col("_at") + size - 1) / tile))))
    start = F.greatest(F.col("_at"), F.col("tile") * tile)
    stop = F.least(F.col("_at") + size, (F.col("tile") + 1) * tile)
    piece = F.substring(F.col("seq"), (start - F.col("_at") + 1).cast("int"), (stop - start).cast("int"))
    pieces = rows.select("chrom", "tile", F.struct(start.alias("s"), piece.alias("p")).alias("x"))
    return pieces.groupBy("chrom", "tile").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["p"]), "").alias("seq"))


@dataclass(frozen=True)
class Genome:
    """Tiles (chrom, tile, seq), the contigs (chrom, length) and the bases per tile."""

    tiles: DataFrame
    contigs: DataFrame
    tile: int = TILE


def store_genome(tiles: DataFrame, name: str, path: str, tile: int = TILE, buckets: int | None = None) -> Genome:
    """Writes tiles as the table `name`, bucketed and sorted by (chrom, tile) below `path`, and the contigs beside it.

    Joins with the stored tiles shuffle the other side only. Buckets hold about BUCKET_TILES tiles each.
    """
    spark = tiles.sparkSession
    kept = reused(tiles.select("chrom", "tile", "seq"))
    contigs = kept.groupBy("chrom").agg(F.sum(F.length("seq").cast("long")).alias("length"), F.count(F.lit(1)).alias("tiles"))
    contigs.write.parquet(f"{path}/contigs")
    if buckets is None:
        n = spark.read.parquet(f"{path}/contigs").agg(F.sum("tiles")).first()[0] or 1
        buckets = max(1, min(MOST_BUCKETS, -(-n // BUCKET_TILES)))
    kept.repartition(buckets, "chrom", "tile").write.bucketBy(buckets, "chrom", "tile").sortBy("chrom", "tile").option("path", f"{path}/tiles").saveAsTable(name)
    return open_genome(spark, name, path, tile)


def open_genome(spark: SparkSession, name: str, path: str, tile: int = TILE) -> Genome:
    """A genome that store_genome wrote, in a session whose catalog knows the table."""
    return Genome(spark.table(name), spark.read.parquet(f"{path}/contigs").select("chrom", "length"), tile)


def _genome(tiles: DataFrame | Genome, tile: int) -> Genome:
    if isinstance(tiles, Genome):
        return tiles
    return Genome(tiles, tiles.groupBy("chrom").agg(F.sum(F.length("seq").cast("long")).alias("length")), tile)


def extract_windows(windows: DataFrame, genome: DataFrame | Genome, key: str, tile: int = TILE) -> DataFrame:
    """Adds seq, the bases of [start, end) of (key, chrom, start, end): null for a contig that isn't there, shorter at its end.

    `key` must be unique. Each window meets the tiles it covers by (chrom, tile), its columns with
    it; of a tile only the bases that the window covers go on. A stored genome isn't shuffled.
    """
    g = _genome(genome, tile)
    contigs = g.contigs.select("chrom", F.col("length").alias("_length"))
    if isinstance(genome, Genome) and contigs.limit(CONTIGS + 1).count() <= CONTIGS:
        contigs = F.broadcast(contigs)
    kept = F.struct(*[F.col(f"`{c}`") for c in windows.columns])
    known = windows.withColumn("_row", kept).select(F.col(key).alias("_key"), "chrom", F.col("start").cast("long").alias("_from"), F.col("end").cast("long").alias("_end"), "_row").join(contigs, "chrom", "left")
    stop = F.least("_end", "_length")  # nothing is looked for beyond a contig
    covers = F.col("_length").isNotNull() & (F.col("_from") < stop)
    numbers = F.when(covers, F.sequence(F.floor(F.col("_from") / g.tile), F.floor((stop - 1) / g.tile)))
    dealt = known.withColumn("tile", F.explode_outer(numbers))
    found = dealt.join(g.tiles.select("chrom", "tile", F.col("seq").alias("_t")), ["chrom", "tile"], "left")
    begin = F.greatest(F.col("_from") - F.col("tile") * g.tile, F.lit(0).cast("long"))
    piece = F.substring(F.col("_t"), (begin + 1).cast("int"), F.greatest(stop - F.col("tile") * g.tile - begin, F.lit(0).cast("long")).cast("int"))
    pieces = found.withColumn("_piece", F.struct("tile", piece.alias("p"))).groupBy("_key").agg(F.any_value("_row").alias("_row"), F.any_value("_length").alias("_length"), F.collect_list("_piece").alias("_pieces"))
    seq = F.array_join(F.transform(F.array_sort("_pieces"), lambda x: x["p"]), "")
    return pieces.select("_row.*", F.when(F.col("_length").isNotNull(), seq).alias("seq"))


def context_windows(inserts: DataFrame, genome: DataFrame | Genome, key: str, context: int, tile: int = TILE) -> DataFrame:
    """Adds context: the insert (seq) between the genome's flanks around center, N beyond a contig's ends, `context` long.

    Inserts longer than the context, and those on a contig that isn't there, have a null context.
    One span around the center is fetched for each insert and cut into both flanks.
    """
    n, center, zero = F.length("_insert"), F.col("center"), F.lit(0).cast("long")
    begin = F.greatest(zero, center - context // 2)
    fits = F.when(F.length("seq") <= context, F.col("seq"))
    spans = inserts.select(*[F.col(f"`{c}`") for c in inserts.columns if c != "seq"], F.col("seq").alias("_insert"), fits.isNotNull().alias("_fits"))
    ends = {"start": begin, "end": F.when(F.col("_fits"), center + context // 2).otherwise(begin)}
    renamed = {c: f"_own_{c}" for c in ("start", "end") if c in inserts.columns}
    out = extract_windows(spans.withColumnsRenamed(renamed).withColumns(ends), genome, key, tile)
    half = F.floor(n / 2)
    left = F.substring(F.col("seq"), F.lit(1), (F.greatest(zero, center - half) - begin).cast("int"))
    right = F.substring(F.col("seq"), (center + half + n % 2 - begin + 1).cast("int"), F.lit(context))
    need = F.lit(context) - n
    left_need = F.floor(need / 2).cast("int")

    def fit(flank: Column, need: Column, side: str) -> Column:
        short = need - F.length(flank)
        pad = F.repeat(F.lit("N"), F.greatest(short, F.lit(0)))
        if side == "l":
            return F.concat(pad, F.substring(flank, F.greatest(F.length(flank) - need, F.lit(0)) + 1, F.greatest(need, F.lit(0))))
        return F.concat(F.substring(flank, F.lit(1), F.greatest(need, F.lit(0))), pad)

    whole = F.concat(fit(left, left_need, "l"), F.col("_insert"), fit(right, (need - left_need).cast("int"), "r"))
    out = out.withColumn("context", F.when(F.col("_fits"), whole)).drop("seq", "start", "end", "_fits").withColumnsRenamed({v: k for k, v in renamed.items()} | {"_insert": "seq"})
    return out.select(*inserts.columns, "context")
