"""Live incidents and rain on the grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hexgrid import GRID, HexGrid
from ..operators.models import RiskModels


def windowed_counts(incidents: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "1 hour", res: int = 9, once: str | None = None, grid: HexGrid = GRID) -> DataFrame:
    """Incidents (ts, lon, lat) by cell and window; with ``once``, rows that repeat that id within the watermark count once.

    The same for a stream and for a table. A stream in update or append mode drops rows whose window ended more than
    ``late`` before the latest row seen in earlier batches, and repeats of an id that come later than that after it.
    """
    x = incidents.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    if once is not None:
        x = x.dropDuplicatesWithinWatermark([once]) if incidents.isStreaming else x.dropDuplicates([once])
    x = grid.with_cell(x, res=res).where("cell is not null and ts is not null")
    return x.groupBy(F.window("ts", size, slide).alias("w") if slide else F.window("ts", size).alias("w"), "cell").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "cell", "n")


def live_risk(readings: DataFrame, cells: DataFrame, models: RiskModels, res: int = 9, grid: HexGrid = GRID) -> DataFrame:
    """PFI_h of the cell of each rain reading (ts, lon, lat, rainfall_mm_h), from the cell's static features."""
    x = grid.with_cell(readings, res=res).drop("lon", "lat")
    x = x.join(cells.drop("rainfall_mm_h", "lon", "lat"), "cell")
    return models.predict(x).withColumn("PFI_h", F.col("predicted_risk"))


def run_available(stream: DataFrame, path: str, keys: Sequence[str] = (), *, mode: str = "update") -> DataFrame:
    """Run a stream over all input that there is, and read back its rows; with ``keys``, the last row of each.

    In update mode a batch writes the rows that it changed, under its number: a batch that is run again writes the same
    folder anew, and state is kept no longer than the watermark asks for.
    """
    spark = stream.sparkSession

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    rows = spark.read.schema(schema).option("basePath", f"{path}/rows").parquet(f"{path}/rows")
    if not keys:
        return rows.drop("batch")
    value = F.struct(*[c for c in stream.columns if c not in keys])
    return rows.groupBy(*keys).agg(F.max_by(value, "batch").alias("x")).select(*keys, "x.*").select(*stream.columns)
