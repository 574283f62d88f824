"""Running sums and exact quantiles without bringing all rows into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import cut


def running_sums(df: DataFrame, by: str, columns: Sequence[str], groups: Sequence[str] = (), slice_rows: int = 50_000) -> DataFrame:
    """Add before_<c> for each column: its sum over the rows (of the same group) with a smaller value of ``by``, of which
    a group has each once.

    The input is written once. Rows are dealt to slices of about ``slice_rows`` rows (bounds from an approximate quantile
    over all groups), summed within group and slice, and given the totals of the group's slices before; so a group that
    holds most rows is many tasks. Totals are as many as slices and groups, and are joined, not broadcast.
    """
    groups = list(groups)
    df = cut(df)
    slices = min(10_000, 1 + df.count() // slice_rows)
    if slices == 1:
        w = Window.partitionBy(*groups).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumns({f"before_{c}": F.coalesce(F.sum(c).over(w), F.lit(0)) for c in columns})
    bounds = df.agg(F.percentile_approx(by, [i / slices for i in range(1, slices)], 100_000).alias("hx_bounds"))
    x = df.crossJoin(F.broadcast(bounds)).withColumn("hx_slice", F.size(F.filter("hx_bounds", lambda b: b < F.col(by)))).drop("hx_bounds")
    total = x.groupBy(*groups, "hx_slice").agg(*[F.sum(c).alias(f"hx_{c}") for c in columns])
    earlier = Window.partitionBy(*groups).orderBy("hx_slice").rowsBetween(Window.unboundedPreceding, -1)
    same = [F.col(g).alias(f"hx_of_{g}") for g in groups]
    total = total.select(*same, F.col("hx_slice").alias("hx_at"), *[F.coalesce(F.sum(f"hx_{c}").over(earlier), F.lit(0)).alias(f"hx_{c}") for c in columns])
    on = F.col("hx_slice") == F.col("hx_at")
    for g in groups:
        on = on & F.col(g).eqNullSafe(F.col(f"hx_of_{g}"))
    within = Window.partitionBy(*groups, "hx_slice").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    x = x.join(total, on)
    x = x.withColumns({f"before_{c}": F.col(f"hx_{c}") + F.coalesce(F.sum(c).over(within), F.lit(0)) for c in columns})
    return x.select(*df.columns, *[f"before_{c}" for c in columns])


def quantile(df: DataFrame, value: str, q: float, name: str = "threshold", by: Sequence[str] = (), margin: float = 2e-4, few: int = 20_000, weight: str | None = None) -> DataFrame:
    """One row (of each group): the exact q-quantile of the values that are there (linear between neighbours), null if there are none.

    An approximate quantile brackets the rank; only distinct values in the bracket (one rank in 2,500, or all of a group
    of ``few`` values, where that would be too narrow) are sorted, and one count gives how many lie below it: a group of any
    size keeps a few thousand values of a task at most, beyond ``few``. A group without values has no row; all of nothing
    has one. With ``weight``, a row stands for that many values (whole, at least 1).
    """
    by = list(by)
    v = df.select(*by, F.col(value).cast("double").alias("hx_v"), (F.lit(1) if weight is None else F.col(weight)).cast("long").alias("hx_w")).where(F.col("hx_v").isNotNull() & ~F.isnan("hx_v"))
    ends = [max(0.0, q - margin), min(1.0, q + margin)]
    guess = v.groupBy(*by).agg(F.sum("hx_w").alias("hx_n"), F.count(F.lit(1)).alias("hx_rows"), F.percentile_approx("hx_v", ends, 50_000).alias("b"))
    if weight is not None:
        # an approximate quantile knows no weights: all distinct values are sorted, of which there are as many as rows at most
        guess = guess.withColumns({"hx_rows": F.lit(0), "b": F.lit(None).cast("array<double>")})
    low = F.when((F.lit(q) <= margin) | (F.col("hx_rows") <= few), float("-inf")).otherwise(F.col("b")[0]).alias("hx_lo")
    high = F.when((F.lit(q) >= 1 - margin) | (F.col("hx_rows") <= few), float("inf")).otherwise(F.col("b")[1]).alias("hx_hi")
    guess = guess.select(*by, "hx_n", low, high)
    # groups may be many: their brackets are joined on the group, where a hot one is a skewed join key and no more
    x = (v.join(guess, by) if by else v.crossJoin(F.broadcast(guess))).where(F.col("hx_v") <= F.col("hx_hi"))
    # everything below the bracket is one row, so the window sees the bracket's distinct values only
    x = x.withColumn("hx_v", F.when(F.col("hx_v") >= F.col("hx_lo"), F.col("hx_v"))).groupBy(*by, "hx_v").agg(F.sum("hx_w").alias("c"), F.first("hx_n").alias("n"))
    x = x.withColumn("upto", F.sum("c").over(Window.partitionBy(*by).orderBy(F.col("hx_v").asc_nulls_first()))).where("hx_v is not null")
    rank = F.lit(float(q)) * (F.col("n") - 1)
    low = F.min(F.when(F.col("upto") > F.floor(rank), F.col("hx_v")))
    high = F.min(F.when(F.col("upto") > F.ceil(rank), F.col("hx_v")))
    part = F.first(rank - F.floor(rank))
    return x.groupBy(*by).agg((low + (high - low) * part).alias(name))
