"""Proportional stratified interleaving: shards of equal row counts that all carry the corpus's mixture of sources."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def interleave(
    df: DataFrame, n_shards: int = 40, id_col: str = "doc_id", source_col: str = "source", seed: int = 42, carry: Sequence[str] | None = None
) -> DataFrame:
    """Add shard (from 0) and slot (gapless from 0 in each shard) to the rows of df.

    Rows of one source are put in a seeded order; the row of rank r among n gets the fraction (r + 1/2) / n. All rows
    are sorted by fraction and the order is cut into n_shards stretches whose row counts differ by one at most, so each
    stretch holds every source in its share of the corpus, to within about a row for each of the other sources.

    Ranks are taken in two levels: rows are counted by (source, slice of the seeded order), running sums of those few
    counts give each slice's first rank, and only within a slice are rows numbered. A slice has about sqrt(rows) rows
    whatever the source, so a source with a third of all rows is spread over many tasks. No Python runs on the data.

    carry: the columns to keep (all by default); columns named shard or slot are replaced. A null source counts as a
    source of its own. Repeated rows each get a slot of their own; those of one id that differ are ordered by a hash of the row. An empty table gives an empty result.
    """
    kept = [c for c in (carry or df.columns) if c not in ("shard", "slot")]
    row = F.struct(*[F.col(f"`{c}`") for c in kept])
    order = F.xxhash64(F.lit(seed), F.col(id_col))
    hashed = [F.col(f"`{c}`") for c, t in df.dtypes if c in kept and "map<" not in t and t != "variant"] or [F.col(id_col)]
    x = df.select(
        row.alias("row"),
        F.struct(F.col(source_col).isNull().alias("none"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("name")).alias("source"),
        order.alias("seeded"),
        F.struct(F.col(id_col), F.xxhash64(*hashed)).alias("id"),  # rows that share an id have an order, too
    )
    total = df.count()
    bits = max(0, int(math.log2(max(1, math.sqrt(total)))))
    x = x.withColumn("slice", F.shiftright(F.col("seeded"), 63 - bits) if bits else F.lit(0).cast("long"))

    counts = x.groupBy("source", "slice").agg(F.count(F.lit(1)).alias("n"))
    by_slice = Window.partitionBy("source").orderBy("slice")
    first = counts.select(
        "source",
        "slice",
        (F.sum("n").over(by_slice) - F.col("n")).alias("first"),
        F.sum("n").over(Window.partitionBy("source")).alias("of_source"),
    )
    within = Window.partitionBy("source", "slice").orderBy("seeded", "id")
    ranked = x.withColumn("rank", F.row_number().over(within)).join(first, ["source", "slice"])
    ranked = ranked.withColumn("fraction", (F.col("first") + F.col("rank") - F.lit(0.5)) / F.col("of_source"))

    cut = ranked.withColumn("stretch", F.floor(F.col("fraction") * F.lit(float(1 << bits))))
    sizes = cut.groupBy("stretch").agg(F.count(F.lit(1)).alias("n"))
    start = sizes.select("stretch", (F.sum("n").over(Window.orderBy("stretch")) - F.col("n")).alias("start"))
    within = Window.partitionBy("stretch").orderBy("fraction", "seeded", "id")
    placed = cut.withColumn("place", F.row_number().over(within)).join(start, "stretch")
    at = (F.col("start") + F.col("place") - 1).cast("long")
    # floor(at * n / total) in whole numbers, so that no rounding moves a row over a cut
    shard = F.expr(f"cast((start + place - 1) * {n_shards}L div {max(1, total)}L as int)")
    opens = F.expr(f"(cast(shard as bigint) * {total}L + {n_shards - 1}L) div {n_shards}L")
    placed = placed.withColumn("shard", shard).withColumn("slot", (at - opens).cast("long"))
    return placed.select("row.*", "shard", "slot")


def write_shards(df: DataFrame, path: str, n_shards: int = 40, **options) -> None:
    """One folder for each shard, its rows in the order of their slots."""
    x = interleave(df, n_shards, **options)
    x.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op4_stratified_interleave(spark, sf_dir: str) -> DataFrame:
    """All documents in 40 shards under the law ``rows``; a null text has no bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id",
        "source",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    return interleave(docs, 40).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
