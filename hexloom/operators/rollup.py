"""Rollups along the hierarchy of cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hexgrid import GRID, HexGrid
from ..functions.order import quantile
from ..functions.scalars import clean
from ..functions.storage import cut


def _aggregates(value: str) -> list:
    v = clean(F.col(value).cast("double"))
    return [F.avg(v).alias("mean"), F.max(v).alias("max"), F.percentile(v, 0.9).alias("p90"), F.count(F.lit(1)).alias("n_children")]


def parent_rollup(cells: DataFrame, value: str, res: int, to: int, grid: HexGrid = GRID) -> DataFrame:
    """Mean, max and 90th percentile of the children's values in each parent; n_children counts missing values too."""
    return grid.with_parent(cells, res, to).groupBy("parent").agg(*_aggregates(value))


def pyramid(cells: DataFrame, value: str, res: int, levels: list[int], grid: HexGrid = GRID) -> DataFrame:
    """The rollup at several levels, from one pass: coarse_res, parent and the aggregates."""
    return grid.with_ancestors(cells, res, levels).groupBy("coarse_res", "parent").agg(*_aggregates(value))


def level_statistics(levels: DataFrame, value: str = "mean") -> DataFrame:
    """Distribution of a value over the cells of each resolution. Quantiles are exact, and sort a bracket each only."""
    v = F.col(value)
    levels = cut(levels.select("coarse_res", v))  # each quantile reads it twice
    out = levels.groupBy("coarse_res").agg(F.count(F.lit(1)).alias("n"), F.avg(v).alias("avg"), F.var_pop(v).alias("variance"), F.min(v).alias("least"), F.max(v).alias("most"))
    for q in (0.1, 0.5, 0.9):
        out = out.join(F.broadcast(quantile(levels, value, q, f"q{round(100 * q)}", by=["coarse_res"])), "coarse_res", "left")
    return out
