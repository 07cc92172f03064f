"""Queries on peaks, loci and windows, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from locus.operators import intervals as iv
from locus.plans import standins as st
from locus.plans.windows import build_windows as build

PRIMARY = ", ".join(f"'{c}'" for c in st.PRIMARY)


def loci(spark, d):
    return iv.merge_loci(iv.flank_variants(iv.distinct_variants(st.variants(spark, d)), st.FLANK))


def centred(spark, d):
    return iv.summit_position(iv.filter_primary_chromosomes(st.peaks(spark, d), st.PRIMARY))


def bounded(spark, d):
    return iv.window_bounds(centred(spark, d))


def best(spark, d):
    return iv.dedupe_best(bounded(spark, d))


COLS = ["peak_id", "chrom", "cell_type", "gsm", "peak_score", "win_start", "win_end"]


def queries():
    return {
        "filter_primary_chromosomes": lambda s, d: iv.filter_primary_chromosomes(st.peaks(s, d), st.PRIMARY),
        "summit_position": lambda s, d: iv.summit_position(st.peaks(s, d)).select("peak_id", "summit", "center_method"),
        "resize_to_window": lambda s, d: iv.resize_to_window(st.peaks(s, d)).select("peak_id", "win_start", "win_end", "method"),
        "window_bounds": lambda s, d: bounded(s, d).select("peak_id", "win_start", "win_end"),
        "flank_variants": lambda s, d: iv.flank_variants(st.variants(s, d), st.FLANK).select("rs_id", "chrom", "start", "end"),
        "distinct_variants": lambda s, d: iv.distinct_variants(st.variants(s, d).unionByName(st.variants(s, d))),
        "merge_loci": loci,
        "intersect_with_loci": lambda s, d: iv.intersect_with_loci(iv.summit_position(st.peaks(s, d)), loci(s, d)).select("peak_id", "chrom", "summit"),
        "dedupe_best": lambda s, d: best(s, d).select(COLS),
        "collapse_redundant_windows": lambda s, d: iv.collapse_redundant_windows(best(s, d)).select(COLS),
        "drop_shared_windows": lambda s, d: iv.drop_shared_windows(best(s, d)).select(COLS),
        "top_n_per_type": lambda s, d: iv.top_n_per_type(best(s, d), 100).select(COLS),
        "count_by_type": lambda s, d: iv.count_by(centred(s, d), "cell_type", "center_method"),
        "pool_samples": lambda s, d: iv.count_by(iv.pool_samples(centred(s, d).select("gsm", "chrom"), st.variants(s, d).select(F.col("functional_class").alias("gsm"), "chrom")), "gsm", "chrom"),
        "window_names": lambda s, d: iv.window_names(best(s, d), iv.majority_method(centred(s, d))).select("peak_id", "name", "center_method"),
        "build_windows": lambda s, d: build(st.peaks(s, d), loci(s, d), primary=st.PRIMARY),
    }


CENTRED = f"""centred AS (SELECT *, coalesce(start + summit_offset, (start + "end") // 2) AS summit, CASE WHEN summit_offset IS NOT NULL THEN 'summit' ELSE 'midpoint' END AS center_method FROM peaks)"""
LOCI = f"""flanked AS (SELECT DISTINCT rs_id, chrom, greatest(0, pos - 1 - {st.FLANK}) AS start, pos + {st.FLANK} AS "end" FROM variants),
opened AS (SELECT *, CASE WHEN start > coalesce(max("end") OVER (PARTITION BY chrom ORDER BY start, "end", rs_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) THEN 1 ELSE 0 END AS opens FROM flanked),
islands AS (SELECT *, sum(opens) OVER (PARTITION BY chrom ORDER BY start, "end", rs_id) AS island FROM opened),
loci AS (SELECT chrom, min(start) AS start, max("end") AS "end", array_to_string(list(rs_id ORDER BY start, "end", rs_id)[1:5], ',') || CASE WHEN count(*) > 5 THEN '...' ELSE '' END AS name, count(*) AS score
  FROM islands GROUP BY chrom, island)"""
BOUNDED = f"""bounded AS (SELECT *, greatest(0, summit - {iv.WINDOW // 2}) AS win_start, greatest(0, summit - {iv.WINDOW // 2}) + {iv.WINDOW} AS win_end FROM {{}})"""
BEST = """best AS (SELECT * FROM bounded QUALIFY row_number() OVER (PARTITION BY cell_type, chrom, win_start ORDER BY peak_score DESC, gsm, start, "end") = 1)"""
PRIME = f"prime AS (SELECT * FROM centred WHERE chrom IN ({PRIMARY}))"
TO_BEST = f"WITH RECURSIVE {st.PEAKS}, {CENTRED}, {PRIME}, {BOUNDED.format('prime')}, {BEST}"
GREEDY = f"""gaps AS (SELECT *, CASE WHEN win_start - lag(win_start) OVER (PARTITION BY cell_type, chrom ORDER BY win_start) < {iv.SEPARATION} THEN 0 ELSE 1 END AS gap FROM best),
isl AS (SELECT *, sum(gap) OVER (PARTITION BY cell_type, chrom ORDER BY win_start) AS island FROM gaps),
rk AS (SELECT *, row_number() OVER (PARTITION BY cell_type, chrom, island ORDER BY peak_score DESC, win_start) AS k FROM isl),
fold AS (SELECT cell_type, chrom, island, 1 AS k, [win_start] AS kept FROM rk WHERE k = 1
  UNION ALL SELECT f.cell_type, f.chrom, f.island, f.k + 1, CASE WHEN len(list_filter(f.kept, lambda x: abs(x - r.win_start) < {iv.SEPARATION})) > 0 THEN f.kept ELSE list_append(f.kept, r.win_start) END
  FROM fold f JOIN rk r ON r.cell_type = f.cell_type AND r.chrom = f.chrom AND r.island = f.island AND r.k = f.k + 1),
kept AS (SELECT cell_type, chrom, unnest(kept) AS win_start FROM fold QUALIFY k = max(k) OVER (PARTITION BY cell_type, chrom, island)),
collapsed AS (SELECT b.* FROM best b SEMI JOIN kept k ON b.cell_type = k.cell_type AND b.chrom = k.chrom AND b.win_start = k.win_start)"""
SHARED = f"""SELECT * FROM {{0}} a WHERE NOT EXISTS (SELECT 1 FROM {{0}} b WHERE a.chrom = b.chrom AND a.cell_type <> b.cell_type AND abs(a.win_start - b.win_start) < {iv.SEPARATION})"""
INSIDE = """inside AS (SELECT p.* FROM {} p ASOF JOIN (SELECT chrom, start AS s, "end" AS e FROM loci) l ON p.chrom = l.chrom AND p.summit >= l.s WHERE p.summit < l.e)"""
METHOD = "(SELECT CASE WHEN count(*) FILTER (center_method = 'summit') >= count(*) FILTER (center_method = 'midpoint') THEN 'summit' ELSE 'midpoint' END FROM prime)"
NAME = "format('{}|{}:{}-{}', cell_type, chrom, win_start, win_end)"
SEL = ", ".join(COLS)


def oracle_sql():
    return {
        "filter_primary_chromosomes": f"WITH {st.PEAKS} SELECT * FROM peaks WHERE chrom IN ({PRIMARY})",
        "summit_position": f"WITH {st.PEAKS}, {CENTRED} SELECT peak_id, summit, center_method FROM centred",
        "resize_to_window": f"""WITH {st.PEAKS}, m AS (SELECT *, coalesce(summit_offset >= 0 AND summit_offset <= "end" - start, false) AS ok FROM peaks),
          c AS (SELECT peak_id, ok, greatest(0, CASE WHEN ok THEN start + summit_offset ELSE (start + "end") // 2 END - {iv.WINDOW // 2}) AS win_start FROM m)
          SELECT peak_id, win_start, win_start + {iv.WINDOW} AS win_end, CASE WHEN ok THEN 'summit' ELSE 'midpoint' END AS method FROM c""",
        "window_bounds": f"WITH {st.PEAKS}, {CENTRED}, {PRIME}, {BOUNDED.format('prime')} SELECT peak_id, win_start, win_end FROM bounded",
        "flank_variants": f"""WITH {st.VARIANTS} SELECT rs_id, chrom, greatest(0, pos - 1 - {st.FLANK}) AS start, pos + {st.FLANK} AS "end" FROM variants""",
        "distinct_variants": f"WITH {st.VARIANTS} SELECT rs_id, chrom, pos, min(functional_class) AS functional_class FROM variants GROUP BY ALL",
        "merge_loci": f"WITH {st.VARIANTS}, {LOCI} SELECT * FROM loci",
        "intersect_with_loci": f"WITH {st.VARIANTS}, {st.PEAKS}, {LOCI}, {CENTRED}, {INSIDE.format('centred')} SELECT peak_id, chrom, summit FROM inside",
        "dedupe_best": f"{TO_BEST} SELECT {SEL} FROM best",
        "collapse_redundant_windows": f"{TO_BEST}, {GREEDY} SELECT {SEL} FROM collapsed",
        "drop_shared_windows": f"{TO_BEST}, s AS ({SHARED.format('best')}) SELECT {SEL} FROM s",
        "top_n_per_type": f"{TO_BEST} SELECT {SEL} FROM best QUALIFY row_number() OVER (PARTITION BY cell_type ORDER BY peak_score DESC, chrom, win_start, gsm) <= 100",
        "count_by_type": f"WITH {st.PEAKS}, {CENTRED}, {PRIME} SELECT cell_type, center_method, count(*) AS n FROM prime GROUP BY ALL",
        "pool_samples": f"WITH {st.PEAKS}, {CENTRED}, {PRIME}, {st.VARIANTS} SELECT gsm, chrom, count(*) AS n FROM (SELECT gsm, chrom FROM prime UNION ALL SELECT functional_class, chrom FROM variants) GROUP BY ALL",
        "window_names": f"{TO_BEST} SELECT peak_id, {NAME} AS name, {METHOD} AS center_method FROM best",
        "build_windows": f"""WITH RECURSIVE {st.PEAKS}, {CENTRED}, {PRIME}, {st.VARIANTS}, {LOCI}, {INSIDE.format('prime')}, {BOUNDED.format('inside')}, {BEST}, {GREEDY}, s AS ({SHARED.format('collapsed')})
          SELECT chrom, win_start AS start, win_end AS "end", {NAME} AS name, cell_type, gsm, peak_score, fold_enrichment, {METHOD} AS center_method FROM s""",
    }
