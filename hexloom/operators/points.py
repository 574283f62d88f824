"""Points to cells: counts, means, indices and labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hexgrid import GRID, HexGrid
from ..functions.scalars import clean
from .shapes import centroids, index_by


def in_cells(points: DataFrame, columns: Sequence[str], res: int, grid: HexGrid) -> DataFrame:
    """The columns and the cell of the points that have coordinates."""
    return grid.with_cell(points.where("lon is not null and lat is not null").select("lon", "lat", *columns), res=res)


def left_by_cell(spine: DataFrame, layer: DataFrame) -> DataFrame:
    """A left join on the cell."""
    return spine.join(layer, "cell", "left")


def point_count(points: DataFrame, res: int = 9, grid: HexGrid = GRID, name: str = "point_count") -> DataFrame:
    """Points in each cell that has any; points without coordinates are in none."""
    return in_cells(points, [], res, grid).groupBy("cell").agg(F.count(F.lit(1)).alias(name))


def point_mean(points: DataFrame, values: Sequence[str] | None = None, res: int = 9, grid: HexGrid = GRID) -> DataFrame:
    """Means of the value columns (all but the coordinates, if not named) in each cell; counts if there are none."""
    values = [c for c in points.columns if c not in ("lon", "lat", "cell")] if values is None else list(values)
    if not values:
        return point_count(points, res, grid)
    return in_cells(points, values, res, grid).groupBy("cell").agg(*[F.avg(clean(F.col(v).cast("double"))).alias(v) for v in values])


def score_index(points: DataFrame, score: str = "score", cut: float = 0.8, res: int = 9, grid: HexGrid = GRID) -> DataFrame:
    """Index of each cell over the scores of its buildings: mean, number, sum, share above the cut, p95, max.

    All but p95 are combined before the shuffle; p95 brackets its rank in each cell, so a cell with half of all buildings
    is sorted in no task.
    """
    x = in_cells(points.withColumn("hx_score", clean(F.col(score))), ["hx_score"], res, grid)
    return index_by(x, "cell", cut)


def density(points: DataFrame, spine: DataFrame, res: int = 9, grid: HexGrid = GRID) -> DataFrame:
    """Points per square kilometre in each cell of the spine, 0 where there are none."""
    x = left_by_cell(spine.select("cell"), point_count(points, res, grid))
    return x.select("cell", (F.coalesce("point_count", F.lit(0)) / grid.area_km2(res)).alias("building_density"))


def join_column(spine: DataFrame, layer: DataFrame, column: str) -> DataFrame:
    """The layer's column on the spine, in place of one of that name; null where the layer has no such cell."""
    return left_by_cell(spine.drop(column), layer.select("cell", column))


def label_columns(cells: DataFrame, least: float = 1e-9) -> DataFrame:
    """Observed labels from flood_point_count and flood_area_frac, of which either may be null: no point, nothing covered.

    Risk is the greater of the covered fraction and 1 where a point lies in the cell.
    """
    x = cells.withColumns({"flood_point_count": F.coalesce("flood_point_count", F.lit(0)).cast("long"), "flood_area_frac": F.coalesce("flood_area_frac", F.lit(0.0))})
    risk = F.least(F.greatest("flood_area_frac", (F.col("flood_point_count") > 0).cast("double")), F.lit(1.0))
    return x.withColumns({"observed_risk": risk, "flood_risk": risk, "flood_class": (risk >= least).cast("int"), "label_source": F.lit("observed")})


def point_label(spine: DataFrame, points: DataFrame | None, area: DataFrame | None = None, res: int = 9, grid: HexGrid = GRID, least: float = 1e-9) -> DataFrame:
    """Observed labels (``label_columns``) on the spine from incident points and, if given, a coverage layer (cell, area_frac).

    Points outside the spine drop out.
    """
    x = spine.drop("flood_point_count", "flood_area_frac")
    none = lambda c: x.withColumn(c, F.lit(None).cast("double"))
    x = none("flood_point_count") if points is None else left_by_cell(x, point_count(points, res, grid, "flood_point_count"))
    x = none("flood_area_frac") if area is None else join_column(x, area.withColumnRenamed("area_frac", "flood_area_frac"), "flood_area_frac")
    return label_columns(x, least)


def mean_by(df: DataFrame, group: str, value: str) -> DataFrame:
    """Mean, number, spread and range of a value in each group: damage counts, catchments or any other zones."""
    v = clean(F.col(value).cast("double"))
    return df.groupBy(group).agg(F.avg(v).alias("mean"), F.count(F.lit(1)).alias("n"), F.min(v).alias("least"), F.max(v).alias("most"), F.stddev_pop(v).alias("spread"))
