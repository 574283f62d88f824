"""Cell tables, layers of several files, loose CSV and pixel tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import require

#: Header names tried in order, in any case. Fixed values.
LON_NAMES = ("longitude", "lon", "lng", "x", "x_coord")
LAT_NAMES = ("latitude", "lat", "y", "y_coord")


def read_cells(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """A Parquet cell table that has the named columns."""
    return require(spark.read.parquet(path), "cell", *columns)


def write_cells(cells: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parquet by resolution, cells in order within each file."""
    by = ["cell_res"] if "cell_res" in cells.columns else []
    cells.repartitionByRange("cell").sortWithinPartitions("cell").write.mode(mode).partitionBy(*by).parquet(path)


def union_layers(layers: dict[str, DataFrame]) -> DataFrame:
    """All layers below each other with their names in the column source; columns that one lacks are null there."""
    out = None
    for name, df in layers.items():
        one = df.withColumn("source", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def pick(df: DataFrame, names: Sequence[str], kind: str = "double") -> Column:
    """The first of the named columns, in any case, that can be read as the kind; the next where one can't."""
    have = {c.lower().strip(): c for c in df.columns}
    found = [F.col(f"`{have[n]}`").try_cast(kind) for n in names if n in have]
    return F.coalesce(*found) if found else F.lit(None).cast(kind)


def points_of(df: DataFrame, lon_names: Sequence[str] = LON_NAMES, lat_names: Sequence[str] = LAT_NAMES) -> DataFrame:
    """df with lon and lat from whatever its headers call them; rows without a position drop out."""
    x = df.withColumns({"hx_lon": pick(df, lon_names), "hx_lat": pick(df, lat_names)}).where("hx_lon is not null and hx_lat is not null")
    rest = [c for c in df.columns if c.lower() not in ("lon", "lat")]
    return x.select(F.col("hx_lon").alias("lon"), F.col("hx_lat").alias("lat"), *[F.col(f"`{c}`") for c in rest])


def read_points_csv(spark: SparkSession, path: str, **names) -> DataFrame:
    return points_of(spark.read.csv(path, header=True), **names)


def read_cited_csv(spark: SparkSession, path: str, words: Sequence[str] = ("latitude", "longitude")) -> DataFrame:
    """CSV files whose header follows lines of citation: the header is the first line that holds all the words.

    One header line is fetched; the rows are read where they lie. Lines of the citation do not parse as positions and
    drop out with the header itself.
    """
    lines = spark.read.text(path)
    held = F.lit(True)
    for w in words:
        held = held & F.lower("value").contains(w)
    header = lines.where(held).select("value").first()
    if header is None:
        raise ValueError(f"no header with {list(words)} in {path}")
    names = [c.strip().strip('"') for c in header[0].split(",")]
    schema = ", ".join(f"`{n}` string" for n in names)
    rows = lines.where(F.col("value") != header[0]).select(F.from_csv("value", schema).alias("r")).select("r.*")
    return points_of(rows)


def write_metrics(table: DataFrame, path: str, kind: str = "csv") -> None:
    """A small table of metrics; NaN becomes null."""
    clean = table.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in table.dtypes])
    writer = clean.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else writer.json(path)


def pixel_table(df: DataFrame, x0: float, y0: float, dx: float, dy: float, nodata: float | None = None, value: str = "value") -> DataFrame:
    """Pixels (row, col, value) with the positions of their centres; nodata and NaN become null."""
    v = F.col(value).cast("double")
    good = ~F.isnan(v) if nodata is None else ~F.isnan(v) & (v != nodata)
    return df.withColumns({value: F.when(good, v), "x": (F.col("col") + 0.5) * dx + x0, "y": (F.col("row") + 0.5) * dy + y0})
