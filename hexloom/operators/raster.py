"""Rasters as tables of pixels: slope, flow and zonal means."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hexgrid import GRID, M_PER_LAT, M_PER_LON, HexGrid
from ..functions.scalars import clean, clip
from ..functions.storage import by_sorting, cut, ship
from .points import left_by_cell

#: The eight neighbours in the order that settles ties, row by row from the upper left.
NEIGHBOURS = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]


def raster_keys(pixels: DataFrame) -> list[str]:
    """What tells rasters of one table apart: raster_id, where there is one."""
    return ["raster_id"] if "raster_id" in pixels.columns else []


def _with_raster(pixels: DataFrame, values: DataFrame) -> DataFrame:
    """pixels with the row of values of their raster: one row where there is one raster, else joined on its id."""
    by = raster_keys(pixels)
    if not by:
        return pixels.crossJoin(F.broadcast(values))
    same = F.col("raster_id").eqNullSafe(F.col("hx_id"))
    return pixels.join(values.withColumnRenamed("raster_id", "hx_id"), same).drop("hx_id")


def fraction_scale(pixels: DataFrame, value: str = "value") -> DataFrame:
    """Percent to fraction: divided by 100 if the largest value of the raster is over 1.5; clipped to 0..1."""
    top = pixels.groupBy(*raster_keys(pixels)).agg((F.max(clean(F.col(value))) > 1.5).alias("hx_percent"))
    x = _with_raster(pixels, top)
    return x.withColumn(value, clip(F.when(F.col("hx_percent"), F.col(value) / 100).otherwise(F.col(value)), 0, 1)).drop("hx_percent")


def by_tiles(pixels: DataFrame, value: str, work: Callable[[Tile], dict[str, pa.Array]], made: str, keep: Sequence[str], size: int = 256) -> DataFrame:
    """The columns ``keep`` of each pixel and what ``work`` makes of its tile (``made``, as a schema).

    A tile is ``size`` pixels a side, with those one step around it: a pixel goes to its tile, and one on a border to the
    next tiles as well, so the exchange is about that of the table. A task holds one tile. Pixels (row, col) are there
    once in a raster; those that are absent have no row.
    """
    by = raster_keys(pixels)

    def tiles(c: str) -> Column:
        at = F.pmod(F.col(c), F.lit(size))
        own = ((F.col(c) - at) / size).cast("long")
        return F.explode(F.array_compact(F.array(own, F.when(at == 0, own - 1), F.when(at == size - 1, own + 1))))

    kept = list(dict.fromkeys([*by, "row", "col", *keep]))
    x = pixels.select(*[F.col(f"`{c}`") for c in kept], clean(F.col(value).cast("double")).alias("hx_z"))
    x = x.withColumn("hx_tr", tiles("row")).withColumn("hx_tc", tiles("col"))
    schema = ", ".join([*[f"`{c}` {t}" for c, t in pixels.dtypes if c in keep], made])

    def run(table: pa.Table) -> pa.Table:
        tile = Tile(table, size)
        found = work(tile)
        own = table.filter(pa.array(tile.own))
        return pa.table([*[own.column(c) for c in pixels_kept], *found.values()], names=[*pixels_kept, *found])

    pixels_kept = [c for c in pixels.columns if c in keep]
    ship(pixels.sparkSession)
    return x.groupBy(*by, "hx_tr", "hx_tc").applyInArrow(run, schema)


class Tile:
    """The values of a tile and of the pixels around it: NaN where a pixel is missing or absent."""

    def __init__(self, table: pa.Table, size: int):
        row, col = (table.column(c).to_numpy().astype(np.int64) for c in ("row", "col"))
        i, j = row - table.column("hx_tr")[0].as_py() * size + 1, col - table.column("hx_tc")[0].as_py() * size + 1
        value = table.column("hx_z").to_numpy(zero_copy_only=False).astype(np.float64)
        self.z = np.full((size + 2, size + 2), np.nan)
        self.z[i, j] = value
        self.own = (i > 0) & (i <= size) & (j > 0) & (j <= size)
        self.i, self.j, self.row, self.col, self.value = i[self.own], j[self.own], row[self.own], col[self.own], value[self.own]

    def near(self, dr: int, dc: int) -> np.ndarray:
        return self.z[self.i + dr, self.j + dc]


def _gradient(tile: Tile, dr: int, dc: int) -> np.ndarray:
    """Central differences in units of a pixel; one-sided at edges and next to missing pixels; 0 for a lone pixel."""
    before, after, z = tile.near(-dr, -dc), tile.near(dr, dc), tile.value
    out = (after - before) / 2
    for other in (after - z, z - before, np.zeros(len(z))):
        out = np.where(np.isnan(out), other, out)
    return out


def slope(pixels: DataFrame, dx_deg: float, dy_deg: float, mid_lat: float, value: str = "value") -> DataFrame:
    """slope_deg of each pixel (row, col), from metres per degree at the raster's middle latitude; null where missing.

    Rasters are told apart by raster_id, if the table has it; a task holds a tile, never the whole of one.
    """
    east, north = M_PER_LON * math.cos(math.radians(mid_lat)) * dx_deg, M_PER_LAT * dy_deg

    def work(tile: Tile) -> dict[str, pa.Array]:
        tilt = np.degrees(np.arctan(np.hypot(_gradient(tile, 0, 1) / east, _gradient(tile, 1, 0) / north)))
        return {"slope_deg": pa.array(tilt, mask=np.isnan(tile.value))}

    return by_tiles(pixels.drop("slope_deg") if value != "slope_deg" else pixels, value, work, "slope_deg double", [c for c in pixels.columns if c != "slope_deg"])


def d8_receiver(pixels: DataFrame, value: str = "value") -> DataFrame:
    """row, col, to_row, to_col (and raster_id, if there is one): the lowest of eight neighbours if it is lower than the
    pixel; the first in order of ties.

    Missing pixels count as the raster's highest.
    """
    by = raster_keys(pixels)

    def work(tile: Tile) -> dict[str, pa.Array]:
        near = np.stack([tile.near(dr, dc) for dr, dc in NEIGHBOURS])
        near[np.isnan(near)] = np.inf
        best = near.argmin(axis=0)
        low = near.min(axis=0, initial=np.inf)
        none = ~(low < np.where(np.isnan(tile.value), np.inf, tile.value))
        step = np.array(NEIGHBOURS)[best]
        # a missing pixel is as high as the raster's highest, which its tile doesn't know
        return {
            "to_row": pa.array((tile.row + step[:, 0]).astype(np.int32), mask=none),
            "to_col": pa.array((tile.col + step[:, 1]).astype(np.int32), mask=none),
            "hx_low": pa.array(low, mask=~np.isnan(tile.value) | none),
        }

    x = by_tiles(pixels, value, work, "to_row int, to_col int, hx_low double", [*by, "row", "col"])
    top = pixels.groupBy(*by).agg(F.max(clean(F.col(value).cast("double"))).alias("hx_top"))
    flows = F.col("hx_low").isNull() | (F.col("hx_low") < F.col("hx_top"))
    to = [F.when(flows, F.col(c)).cast(dict(pixels.dtypes)[c.removeprefix("to_")]).alias(c) for c in ("to_row", "to_col")]
    return _with_raster(x, top).select(*by, "row", "col", *to)


def d8_accumulation(pixels: DataFrame, value: str = "value") -> DataFrame:
    """row, col, flow (and raster_id, if there is one): how many pixels drain through each, itself included; null where
    the pixel is missing.

    Pointer doubling: each round adds what arrives over twice as many steps, so a path of n pixels takes log2(n) rounds
    of joins on the pixel, each cut from its lineage.
    """
    by = raster_keys(pixels)
    there = pixels.select(*by, "row", "col", clean(F.col(value).cast("double")).isNotNull().alias("there"))
    to = F.struct(*by, F.col("to_row").alias("row"), F.col("to_col").alias("col"))
    ids = d8_receiver(pixels, value).select(F.struct(*by, "row", "col").alias("at"), F.when(F.col("to_row").isNotNull(), to).alias("to"), F.lit(1).cast("long").alias("flow"))
    state = cut(ids)
    while state.where("to is not null").limit(1).count():
        arrives = state.where("to is not null").groupBy(F.col("to").alias("at")).agg(F.sum("flow").alias("more"))
        jump = state.select(F.col("at").alias("to"), F.col("to").alias("next"))
        state = state.join(by_sorting(arrives), "at", "left").join(by_sorting(jump), "to", "left")
        state = cut(state.select("at", F.col("next").alias("to"), (F.col("flow") + F.coalesce("more", F.lit(0))).alias("flow")))
    x = state.select("at.*", "flow").join(by_sorting(there), [*by, "row", "col"])
    return x.select(*by, "row", "col", F.when(F.col("there"), F.col("flow")).alias("flow"))


def zonal_mean(pixels: DataFrame, res: int = 9, value: str = "value", name: str = "zonal", spine: DataFrame | None = None, grid: HexGrid = GRID) -> DataFrame:
    """Mean of the pixels whose centre (x, y) lies in each cell; missing ones do not count. With a spine, its cells."""
    v = F.col(value).cast("double")
    v = F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)
    x = pixels.select(F.col("x").alias("lon"), F.col("y").alias("lat"), v.alias("hx_v")).where("lon is not null and lat is not null and hx_v is not null")
    x = grid.with_cell(x, res=res).groupBy("cell").agg(F.avg("hx_v").alias(name))
    return x if spine is None else left_by_cell(spine.select("cell"), x)
