"""Distance to the nearest of many segments."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hexgrid import GRID, M_PER_LAT, HexGrid
from ..functions.scalars import clip, haversine
from ..functions.storage import by_sorting, cut


def foot(lon: Column, lat: Column, grid: HexGrid = GRID) -> tuple[Column, Column, Column]:
    """Of the segment (x1, y1, x2, y2): the plane distance in metres from the point, and the nearest place on it."""
    ax, ay = (F.col("x1") - lon) * grid.kx, (F.col("y1") - lat) * M_PER_LAT
    bx, by = (F.col("x2") - lon) * grid.kx, (F.col("y2") - lat) * M_PER_LAT
    length = (bx - ax) * (bx - ax) + (by - ay) * (by - ay)
    t = F.when(length > 0, clip(-(ax * (bx - ax) + ay * (by - ay)) / length, 0, 1)).otherwise(0.0)
    px, py = ax + (bx - ax) * t, ay + (by - ay) * t
    return F.sqrt(px * px + py * py), lon + px / grid.kx, lat + py / M_PER_LAT


def in_pieces(segments: DataFrame, res: int, grid: HexGrid = GRID) -> DataFrame:
    """A row for each piece of a segment, none longer than the spacing of cells, under the cell of its middle (at)."""
    dx, dy = (F.col("x2") - F.col("x1")) * grid.kx, (F.col("y2") - F.col("y1")) * M_PER_LAT
    n = F.greatest(F.ceil(F.sqrt(dx * dx + dy * dy) / grid.spacing(res)), F.lit(1)).cast("int")
    x = segments.select("x1", "y1", "x2", "y2", n.alias("n")).where("n is not null").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n"))))
    middle = lambda c: F.col(f"{c}1") + (F.col(f"{c}2") - F.col(f"{c}1")) * ((F.col("k") - 0.5) / F.col("n"))
    x = x.withColumns({"lon": middle("x"), "lat": middle("y")})
    return grid.with_cell(x, res=res, name="at").select("at", "x1", "y1", "x2", "y2").distinct()


def near_cells(asked: DataFrame, held: DataFrame, res: int, few: int = 200, grid: HexGrid = GRID) -> DataFrame:
    """(cell, at): for each asked cell the held cells that may have what is nearest to some place in it.

    Descends the hierarchy from the finest level of which the held cells have at most ``few`` ancestors (counted; the
    coarsest has fewer on all the globe). At each level a pair stays if its least possible distance is no more than what
    some pair of its cell surely reaches, so a cell keeps a handful of candidates whatever lies far away. Each level is an
    equi-join and a minimum by cell, cut from the lineage.
    """
    lon, lat = (F.expr(e) for e in grid.centre("cell", res))
    x = asked.select("cell", lon.alias("lon"), lat.alias("lat"))
    levels = cut(grid.with_ancestors(held.select(F.col("at").alias("cell")).distinct(), res, list(range(res + 1))).select("coarse_res", F.col("parent").alias("at")).distinct())
    sizes = {r[0]: r[1] for r in levels.groupBy("coarse_res").count().collect()}  # a row for each level
    start = max([0, *[k for k, n in sizes.items() if n <= few]])
    # a piece lies within half a spacing of its middle, which lies in its cell
    own = grid.spacing(res) / math.sqrt(3)
    for level in range(start, res + 1):
        there = levels.where(F.col("coarse_res") == level).select("at")
        if level == start:
            x = x.crossJoin(F.broadcast(there))  # at most ``few`` rows
        else:
            up = grid.with_parent(there.select(F.col("at").alias("below")), level, level - 1, "below", "above")
            x = x.join(by_sorting(up), F.col("at") == F.col("above")).drop("at", "above").withColumnRenamed("below", "at")
        # centres of descendants stay within the sum of the steps from level to level
        reach = sum(grid.spacing(r) for r in range(level + 1, res + 1)) + own + grid.spacing(res) / 2 + own
        to_lon, to_lat = (F.expr(e) for e in grid.centre("at", level))
        dx, dy = (to_lon - F.col("lon")) * grid.kx, (to_lat - F.col("lat")) * M_PER_LAT
        x = x.withColumn("d", F.sqrt(dx * dx + dy * dy))
        x = x.withColumn("least", F.min("d").over(Window.partitionBy("cell"))).where(F.col("d") <= F.col("least") + 2 * reach * (1 + 1e-9))
        x = cut(x.select("cell", "lon", "lat", "at"))
    return x.select("cell", "at")


def nearest_distance(points: DataFrame, segments: DataFrame, key: str = "cell", res: int = 9, grid: HexGrid = GRID) -> DataFrame:
    """key, dist_m: metres from each point (key, lon, lat) to the nearest segment, however far; null where there is no segment.

    Segments are cut into pieces of a cell's size and listed under their cells. Candidates are found for cells, not for
    points, by descent; points and pieces then meet in two equi-joins. A point without coordinates has no distance.
    """
    asked = grid.with_cell(points.select(key, "lon", "lat").where("lon is not null and lat is not null"), res=res, name="hx_cell")
    asked, pieces = cut(asked), cut(in_pieces(segments, res, grid))
    near = near_cells(asked.select(F.col("hx_cell").alias("cell")).distinct(), pieces, res, grid=grid)
    pairs = asked.join(by_sorting(near.withColumnRenamed("cell", "hx_cell")), "hx_cell").join(by_sorting(pieces), "at")
    d, lon, lat = foot(F.col("lon"), F.col("lat"), grid)
    best = pairs.groupBy(key, "lon", "lat").agg(F.min(F.struct(d.alias("d"), lon.alias("x"), lat.alias("y"))).alias("b"))
    best = best.select(key, haversine(F.col("lon"), F.col("lat"), F.col("b.x"), F.col("b.y")).alias("dist_m"))
    return points.select(key).join(by_sorting(best), key, "left")
