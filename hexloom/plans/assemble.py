"""The cell table from layers: features, labels, overlay and where they come from."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hexgrid import GRID, HexGrid
from ..functions.scalars import hash_features, normal_noise, synthetic_score
from ..functions.storage import by_sorting
from ..operators import overlay, points, raster
from ..operators.adaptive import inherit_parent
from ..operators.nearest import nearest_distance
from ..schema import CLASS, FEATURES, RISK


@dataclass
class Layers:
    """What there is; all of it optional. Pixel tables (row, col, x, y, value; raster_id if there are several rasters), points
    (lon, lat), segments, polygons (rings). Buildings are points or polygons."""

    dem: DataFrame | None = None
    slope: DataFrame | None = None
    impervious: DataFrame | None = None
    buildings: DataFrame | None = None
    streams: DataFrame | None = None
    event_rain: DataFrame | None = None
    flood_polygons: DataFrame | None = None
    flood_points: DataFrame | None = None
    coastal: DataFrame | None = None
    mode: str = "opendata"
    pixel: tuple[float, float, float] = field(default=(0.001, 0.001, 40.7))  # degrees across and down, middle latitude


def event_rainfall(cells: DataFrame, pixels: DataFrame | None, res: int, grid: HexGrid = GRID) -> DataFrame:
    """The event's rain in place of the table's; no layer, no change."""
    if pixels is None:
        return cells
    return points.join_column(cells, raster.zonal_mean(pixels, res, name="rainfall_mm_h", grid=grid), "rainfall_mm_h")


def on_spine(spine: DataFrame, layers: dict[str, DataFrame]) -> DataFrame:
    """cell, lon, lat and a column for each of the layers (cell and a column of that name), null where it has no such cell.

    The spine's rows and all layers' values stand one under the other, and one aggregate on the cell brings them together:
    one exchange, however many layers there are. A layer has one value for each cell; cells that are not on the spine drop
    out, and those that are there twice are one.
    """
    value = "cast(null as double)"
    rows = spine.selectExpr("cell", "lon", "lat", "-1 as layer", f"{value} as value")
    for k, (name, layer) in enumerate(layers.items()):
        place = "cast(null as double)"
        rows = rows.unionByName(layer.selectExpr("cell", f"{place} as lon", f"{place} as lat", f"{k} as layer", f"cast(`{name}` as double) as value"))
    columns = [F.max(F.when(F.col("layer") == k, F.col("value"))).alias(name) for k, name in enumerate(layers)]
    x = rows.groupBy("cell").agg(F.max("lon").alias("lon"), F.max("lat").alias("lat"), F.max((F.col("layer") == -1).cast("int")).alias("hx_there"), *columns)
    return x.where("hx_there = 1").drop("hx_there")


def feature_layers(spine: DataFrame, layers: Layers, res: int, grid: HexGrid = GRID) -> dict[str, DataFrame]:
    """The tables (cell, value) that the layers give, by the name of their column."""
    found: dict[str, DataFrame] = {}
    dx, dy, mid = layers.pixel
    if layers.dem is not None:
        found["elevation_m"] = raster.zonal_mean(layers.dem, res, name="elevation_m", grid=grid)
        if layers.slope is None:
            tilt = raster.slope(layers.dem, dx, dy, mid)
            found["slope_deg"] = raster.zonal_mean(tilt, res, "slope_deg", "slope_deg", grid=grid)
        at = [*raster.raster_keys(layers.dem), "row", "col"]
        flow = raster.d8_accumulation(layers.dem).join(by_sorting(layers.dem.select(*at, "x", "y")), at)
        found["flow_accum_proxy"] = raster.zonal_mean(flow, res, "flow", "flow_accum_proxy", grid=grid)
    if layers.slope is not None:
        found["slope_deg"] = raster.zonal_mean(layers.slope, res, name="slope_deg", grid=grid)
    if layers.impervious is not None:
        found["impervious_frac"] = raster.zonal_mean(raster.fraction_scale(layers.impervious), res, name="impervious_frac", grid=grid)
    if layers.buildings is not None:
        buildings = points.centroids(layers.buildings) if "rings" in layers.buildings.columns else layers.buildings
        found["building_density"] = points.point_count(buildings.select("lon", "lat"), res, grid, "building_density")
    if layers.streams is not None:
        found["dist_stream_m"] = nearest_distance(spine, layers.streams, res=res, grid=grid).withColumnRenamed("dist_m", "dist_stream_m")
    if layers.event_rain is not None:
        found["rainfall_mm_h"] = raster.zonal_mean(layers.event_rain, res, name="rainfall_mm_h", grid=grid)
    return found


def features(spine: DataFrame, layers: Layers, res: int, rainfall_mm_h: float = 25.0, fallback: bool = True, grid: HexGrid = GRID, more: dict[str, DataFrame] | None = None) -> DataFrame:
    """Features on the spine (cell, lon, lat): observed where there is a layer, else drawn from the cell's name.

    Without fallback, what no layer gives is null. Columns say which it was. ``more`` are further layers, whose columns come
    as they are. All layers are brought to the spine by one aggregate (``on_spine``).
    """
    found = feature_layers(spine, layers, res, grid)
    x = on_spine(spine, found | (more or {}))
    if "building_density" in found:
        x = x.withColumn("building_density", F.coalesce("building_density", F.lit(0.0)) / grid.area_km2(res))
    if "impervious_frac" in found:
        x = x.withColumn("land_cover_urban", (F.col("impervious_frac") > 0.45).cast("double"))
    seen = [c for c in FEATURES if c in x.columns]
    x = x.select("cell", "lon", "lat", *[F.col(c).alias(f"hx_seen_{c}") for c in seen], *(more or {}), F.lower(F.hex("cell")).alias("hx_name"))
    x = hash_features(x, "hx_name", rainfall_mm_h).drop("hx_name")
    x = x.withColumns({c: F.coalesce(f"hx_seen_{c}", c) if fallback else F.col(f"hx_seen_{c}") for c in seen}).drop(*[f"hx_seen_{c}" for c in seen])
    if not fallback:
        x = x.withColumns({c: F.lit(None).cast("double") for c in FEATURES if c not in seen and c != "rainfall_mm_h"})
    static = [c for c in FEATURES if c != "rainfall_mm_h"]
    observed = [c for c in seen if c != "rainfall_mm_h"]
    source = "observed" if observed == static else "mixed" if observed else "synthetic"
    return x.withColumns(
        {
            "cell_res": F.lit(res),
            "feature_source": F.lit(source),
            "assembly_mode": F.lit(layers.mode),
            "observed_feature_cols": F.array(*[F.lit(c) for c in sorted(observed)]).cast("array<string>"),
            "rainfall_source": F.lit("event_raster" if layers.event_rain is not None else "scenario_or_config"),
        }
    )


def synthetic_labels(cells: DataFrame, threshold: float = 0.55, noise: float = 0.05) -> DataFrame:
    risk = synthetic_score(normal_noise(F.col("cell"), noise) if noise else None)
    return cells.withColumn(RISK, risk).withColumns({CLASS: (F.col(RISK) >= threshold).cast("int"), "label_source": F.lit("synthetic")})


def cell_table(spine: DataFrame, layers: Layers, res: int, rainfall_mm_h: float = 25.0, depth: int | None = None, grid: HexGrid = GRID) -> DataFrame:
    """Features, labels (observed if there is a flood layer, else synthetic and said to be so), and the coastal overlay."""
    more: dict[str, DataFrame] = {}
    if layers.flood_points is not None:
        more["flood_point_count"] = points.point_count(layers.flood_points, res, grid, "flood_point_count")
    if layers.flood_polygons is not None:
        more["flood_area_frac"] = overlay.coverage(spine, layers.flood_polygons, res, depth, grid, "flood_area_frac")
    if layers.coastal is not None:
        more["sandy_area_frac"] = overlay.coverage(spine, layers.coastal, res, depth, grid, "sandy_area_frac")
    x = features(spine, layers, res, rainfall_mm_h, grid=grid, more=more)
    if layers.flood_polygons is None and layers.flood_points is None:
        x = synthetic_labels(x)
    else:
        x = x.withColumns({c: F.lit(None).cast("double") for c in ("flood_point_count", "flood_area_frac") if c not in more})
        x = points.label_columns(x)
    if layers.coastal is None:
        return x
    share = F.coalesce("sandy_area_frac", F.lit(0.0))
    return x.withColumns({"sandy_area_frac": share, "sandy_class": (share >= 1e-9).cast("int")})


def demo_table(spark, box: tuple[float, float, float, float], res: int = 9, grid: HexGrid = GRID) -> DataFrame:
    return cell_table(grid.cover(spark, box, res), Layers(mode="demo"), res, grid=grid)


def label_scale_table(spine: DataFrame, layers: Layers, res: int, parents: DataFrame | None = None, parent_res: int | None = None, grid: HexGrid = GRID) -> DataFrame:
    """Fine cells with point labels, or the risk of their coarse parent if that is greater; class is any risk at all.

    With neither points nor parents the whole assembly is done instead.
    """
    inherits = parents is not None and parent_res is not None and parent_res < res
    if layers.flood_points is None and not inherits:
        return cell_table(spine, layers, res, grid=grid)
    x = points.point_label(spine, layers.flood_points, None, res, grid)
    if inherits:
        above = inherit_parent(spine.select("cell"), parents.select("cell", F.col(RISK).alias("hx_above")), "hx_above", res, parent_res, grid)
        x = x.join(above, "cell", "left").withColumn(RISK, F.greatest(RISK, F.coalesce("hx_above", F.lit(0.0)))).drop("hx_above")
        x = x.withColumn("label_source", F.lit("observed_points_plus_parent"))
    mode = "points_plus_parent_inherit" if inherits else "points_only"
    return x.withColumns({CLASS: (F.col(RISK) > 0).cast("int"), "label_scale_mode": F.lit(mode), "assembly_mode": F.lit(layers.mode), "feature_source": F.lit("labels_only_diagnostics")})
