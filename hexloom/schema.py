"""Columns of the cell table and of the layers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: The feature columns, in order, and the range that each is expected in.
FEATURES = ["elevation_m", "slope_deg", "flow_accum_proxy", "impervious_frac", "building_density", "dist_stream_m", "rainfall_mm_h", "land_cover_urban"]
FEATURE_RANGES = {
    "elevation_m": (-50.0, 3000.0),
    "slope_deg": (0.0, 90.0),
    "flow_accum_proxy": (0.0, 1e6),
    "impervious_frac": (0.0, 1.0),
    "building_density": (0.0, 1e5),
    "dist_stream_m": (0.0, 50_000.0),
    "rainfall_mm_h": (0.0, 500.0),
    "land_cover_urban": (0.0, 1.0),
}
RISK, CLASS = "flood_risk", "flood_class"

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
#: A vector record: rings hold the vertices of every part of its geometry.
FEATURE_RECORD = T.StructType(
    [
        T.StructField("feature_id", T.LongType()),
        T.StructField("geom_type", T.StringType()),
        T.StructField("rings", T.ArrayType(T.ArrayType(POINT))),
        T.StructField("props", T.MapType(T.StringType(), T.StringType())),
    ]
)
PIXELS = T.StructType(
    [T.StructField("raster_id", T.StringType()), T.StructField("row", T.IntegerType()), T.StructField("col", T.IntegerType())]
    + [T.StructField(c, T.DoubleType()) for c in ("x", "y", "value")]
)


def require(df: DataFrame, *columns: str) -> DataFrame:
    """df, or a KeyError that names the missing columns."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"missing columns: {missing}")
    return df
