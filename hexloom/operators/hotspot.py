"""Hotspots, agreement of cell sets, and what is lost when fine cells are rolled up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hexgrid import GRID, HexGrid
from ..functions.order import quantile
from ..functions.scalars import clean
from ..functions.storage import cut
from .rollup import pyramid


def hotspots(cells: DataFrame, value: str, q: float = 0.9, absolute: float | None = None) -> DataFrame:
    """Cells whose value is at least the q-quantile (or the absolute cut), with the threshold; ties all count."""
    if absolute is not None:
        at = cells.sparkSession.range(1).select(F.lit(float(absolute)).alias("threshold"))
    else:
        at = quantile(cells, value, q)
    v = clean(F.col(value).cast("double"))
    return cells.withColumn("hx_v", v).crossJoin(F.broadcast(at)).where(F.col("hx_v") >= F.col("threshold")).drop("hx_v")


def jaccard_of(both: Column, either: Column) -> Column:
    """1 where both sets are empty."""
    return F.when(either == 0, 1.0).otherwise(both / either)


def f1_of(both: Column, n_a: Column, n_b: Column) -> Column:
    return F.when(n_a + n_b == 0, 1.0).otherwise(both * 2 / (n_a + n_b))


def set_agreement(a: DataFrame, b: DataFrame, key: str = "cell") -> DataFrame:
    """One row: sizes, common and joint sizes, Jaccard and F1 of two sets of cells."""
    marks = a.select(key).distinct().withColumn("in_a", F.lit(1)).join(b.select(key).distinct().withColumn("in_b", F.lit(1)), key, "full")
    n = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long")
    x = marks.agg(n("in_a").alias("n_a"), n("in_b").alias("n_b"), n((F.col("in_a") * F.col("in_b"))).alias("n_both"), F.count(F.lit(1)).alias("n_any"))
    return x.withColumns({"jaccard": jaccard_of(F.col("n_both"), F.col("n_any")), "f1": f1_of(F.col("n_both"), F.col("n_a"), F.col("n_b"))})


def set_operation(a: DataFrame, b: DataFrame, kind: str, key: str = "cell") -> DataFrame:
    """Union, intersection or difference of two sets of cells."""
    a, b = a.select(key), b.select(key)
    if kind == "union":
        return a.union(b).distinct()
    return a.join(b, key, "left_semi" if kind == "intersection" else "left_anti").distinct()


def resolution_ladder(cells: DataFrame, value: str, res: int, levels: list[int] | None = None, quantiles: tuple[float, ...] = (0.9,), grid: HexGrid = GRID) -> DataFrame:
    """How well the hotspots of coarse cells (by mean, max and p90) agree with the parents of fine hotspots.

    One row for each level, aggregate and quantile. extrema_smoothing is the Jaccard of max less that of mean. All
    levels come from one pass over the ancestors; thresholds are a few rows that are joined back.
    """
    levels = [r for r in (range(max(0, res - 3), res) if levels is None else sorted(set(levels))) if r < res]
    v = cut(cells.select("cell", clean(F.col(value).cast("double")).alias("v")))  # it is read several times for each quantile
    cuts = None
    for q in quantiles:
        one = quantile(v, "v", q, "fine_hotspot_threshold").withColumn("hotspot_quantile", F.lit(float(q)))
        cuts = one if cuts is None else cuts.union(one)
    n_fine = v.agg(F.count(F.lit(1)).alias("n_fine"))
    hot = [F.max((F.col("v") >= F.col(f"hx_t{k}")).cast("int")).alias(f"hx_hot{k}") for k in range(len(quantiles))]
    cut_map = cuts.groupBy().agg(*[F.max(F.when(F.col("hotspot_quantile") == q, F.col("fine_hotspot_threshold"))).alias(f"hx_t{k}") for k, q in enumerate(quantiles)])
    x = grid.with_ancestors(v.crossJoin(F.broadcast(cut_map)), res, levels)
    rolled = x.groupBy("coarse_res", "parent").agg(F.avg("v").alias("mean"), F.max("v").alias("max"), F.percentile("v", 0.9).alias("p90"), *hot)
    rolled = cut(rolled)  # thresholds and flags read it several times
    long = rolled.select(
        "coarse_res",
        F.explode(F.array(*[F.struct(F.lit(float(q)).alias("hotspot_quantile"), F.coalesce(F.col(f"hx_hot{k}"), F.lit(0)).alias("fine_hot")) for k, q in enumerate(quantiles)])).alias("h"),
        F.array(*[F.struct(F.lit(a).alias("aggregation"), F.col(a).alias("value")) for a in ("mean", "max", "p90")]).alias("a"),
    ).select("coarse_res", "h.*", F.explode("a").alias("a"))
    long = long.select("coarse_res", "hotspot_quantile", "fine_hot", "a.*")
    at = None
    for q in quantiles:
        part = quantile(long.where(F.col("hotspot_quantile") == q), "value", q, "coarse_hotspot_threshold", by=["coarse_res", "hotspot_quantile", "aggregation"])
        at = part if at is None else at.union(part)
    flags = long.join(F.broadcast(at), ["coarse_res", "hotspot_quantile", "aggregation"])
    coarse = F.coalesce((F.col("value") >= F.col("coarse_hotspot_threshold")).cast("int"), F.lit(0))
    fine = F.col("fine_hot")
    out = flags.groupBy("coarse_res", "hotspot_quantile", "aggregation", "coarse_hotspot_threshold").agg(
        F.count(F.lit(1)).alias("n_coarse"),
        F.sum(fine).cast("long").alias("n_hotspot_fine_parents"),
        F.sum(coarse).cast("long").alias("n_hotspot_coarse"),
        F.sum(fine * coarse).cast("long").alias("hx_both"),
        F.sum(F.greatest(fine, coarse)).cast("long").alias("hx_any"),
    )
    # one pass counts the hotspots of all quantiles, by the thresholds that are there already
    sums = v.crossJoin(F.broadcast(cut_map)).agg(*[F.coalesce(F.sum((F.col("v") >= F.col(f"hx_t{k}")).cast("long")), F.lit(0)).alias(f"hx_n{k}") for k in range(len(quantiles))])
    fine_hot = sums.select(F.explode(F.array(*[F.struct(F.lit(float(q)).alias("hotspot_quantile"), F.col(f"hx_n{k}").alias("n_hotspot_fine")) for k, q in enumerate(quantiles)])).alias("x")).select("x.*")
    out = out.join(F.broadcast(cuts), "hotspot_quantile").join(F.broadcast(fine_hot), "hotspot_quantile").crossJoin(F.broadcast(n_fine))
    out = out.withColumns({"jaccard": jaccard_of(F.col("hx_both"), F.col("hx_any")), "f1": f1_of(F.col("hx_both"), F.col("n_hotspot_coarse"), F.col("n_hotspot_fine_parents"))})
    both = out.groupBy("coarse_res", "hotspot_quantile").agg(
        (F.max(F.when(F.col("aggregation") == "max", F.col("jaccard"))) - F.max(F.when(F.col("aggregation") == "mean", F.col("jaccard")))).alias("extrema_smoothing")
    )
    return out.join(F.broadcast(both), ["coarse_res", "hotspot_quantile"]).select(
        F.lit(res).alias("fine_res"), "coarse_res", "aggregation", "hotspot_quantile", "n_fine", "n_coarse", "n_hotspot_fine", "n_hotspot_fine_parents",
        "n_hotspot_coarse", "fine_hotspot_threshold", "coarse_hotspot_threshold", "jaccard", "f1", "extrema_smoothing",
    )


def jaccard_matrix(cells: DataFrame, value: str, res: int, levels: list[int], q: float = 0.9, grid: HexGrid = GRID) -> DataFrame:
    """Jaccard of the hotspots of each pair of resolutions (by mean), the finer ones projected to the coarser."""
    rolled = cut(pyramid(cells, value, res, levels, grid).select("coarse_res", "parent", "mean"))
    at = quantile(rolled, "mean", q, "t", by=["coarse_res"])  # a row for each level
    hot = cut(rolled.join(F.broadcast(at), "coarse_res").where("mean >= t").select("coarse_res", "parent"))
    projected = None
    for r in sorted(levels):
        finer = grid.with_ancestors(hot.where(F.col("coarse_res") == r).select(F.col("parent").alias("cell")), r, [x for x in levels if x <= r])
        one = finer.select(F.lit(r).alias("fine_res"), "coarse_res", "parent").distinct()
        projected = one if projected is None else projected.union(one)
    b = hot.select("coarse_res", "parent", F.lit(1).alias("in_b"))
    pairs = projected.select("coarse_res", "fine_res").where("fine_res > coarse_res").distinct()
    a = projected.where("fine_res > coarse_res").withColumn("in_a", F.lit(1))
    x = a.join(b.join(F.broadcast(pairs), "coarse_res"), ["coarse_res", "fine_res", "parent"], "full")
    n = x.groupBy("fine_res", "coarse_res").agg(F.coalesce(F.sum(F.col("in_a") * F.col("in_b")), F.lit(0)).alias("both"), F.count(F.lit(1)).alias("any"))
    return n.select("fine_res", "coarse_res", jaccard_of(F.col("both"), F.col("any")).alias("jaccard"))
