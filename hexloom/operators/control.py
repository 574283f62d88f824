"""Negative control: do high scores gather where only the coast floods?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.order import quantile


def negative_control(cells: DataFrame, score: str, coastal: str = "sandy_area_frac", event: str = "flood_area_frac", q: float = 0.8, event_class: str | None = None) -> DataFrame:
    """One row: sizes and mean scores of coastal-only, event-only, both and neither, and what the high scores consist of.

    The event mask is the covered fraction (so a cell with points only counts as neither), or the class if one is named.
    """
    x = cells.crossJoin(F.broadcast(quantile(cells, score, q, "hx_cut")))
    c = F.coalesce(F.col(coastal) > 0, F.lit(False))
    e = F.coalesce(F.col(event_class) == 1 if event_class else F.col(event) > 0, F.lit(False))
    groups = {"coastal_only": c & ~e, "pluvial_only": e & ~c, "both": c & e, "neither": ~c & ~e}
    s = F.when(~F.isnan(F.col(score).cast("double")), F.col(score).cast("double"))
    high = F.coalesce(s >= F.col("hx_cut"), F.lit(False))
    n = lambda m: F.coalesce(F.sum(m.cast("long")), F.lit(0)).cast("long")
    out = x.agg(
        F.count(F.lit(1)).alias("n_cells"),
        n(c).alias("n_coastal"),
        n(e).alias("n_pluvial"),
        *[n(m).alias(f"n_{k}") for k, m in groups.items()],
        *[F.avg(F.when(m, s)).alias(f"mean_score_{k}") for k, m in groups.items()],
        F.max("hx_cut").alias("high_score_threshold"),
        n(high).alias("n_high_score"),
        F.avg(F.when(high, groups["coastal_only"].cast("double"))).alias("coastal_only_among_high_score"),
        F.avg(F.when(high, e.cast("double"))).alias("pluvial_among_high_score"),
    )
    return out.withColumn("pluvial_minus_coastal_mean_score", F.col("mean_score_pluvial_only") - F.col("mean_score_coastal_only"))
