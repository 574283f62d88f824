"""What the operators of this subpackage share: shared-folder tables, group joins and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import ship


def map_arrow(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    A temporary folder is used only in local mode, and only where the setting is absent.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='hexloom-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Folders that shared_path gave out and that were not deleted since, in order.
_given: list[str] = []


def shared_path(spark: SparkSession, label: str) -> str:
    _given.append(f"{shared_dir(spark)}/hexloom/{label}-{uuid.uuid4().hex}")
    return _given[-1]


@contextmanager
def scratch(spark: SparkSession):
    """Folders given out inside are deleted at the end, but for that of the table handed to the function that this yields."""
    start, kept = len(_given), []
    try:
        yield kept.append
    finally:
        for path in _given[start:]:
            if not any(path.rpartition("/")[2] in file for table in kept for file in table.inputFiles()[:1]):
                delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    if path in _given:
        _given.remove(path)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends, and lost executors cost nothing before it."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a materialised table that nothing reads any more."""
    for file in df.inputFiles()[:1]:
        name = file.rpartition("/")[0].rpartition("/")[2]
        for path in [p for p in _given if p.endswith(f"/{name}")]:
            delete(spark, path)


def text_key(column: str) -> list:
    """128 bits that stand for a text."""
    return [F.xxhash64(column).alias("key_a"), F.xxhash64(F.lit(977), F.col(column)).alias("key_b")]


def with_group(df: DataFrame, keys: Sequence[str], id_col: str, salts: int = 16) -> DataFrame:
    """Add group_id (smallest id with the same keys) and group_size to every row.

    The aggregate is combined before its shuffle and only groups of two rows or more are joined back, on the keys and
    a salt, so a key that a third of the rows share is spread over ``salts`` tasks.
    """
    groups = (
        df.groupBy(*keys)
        .agg(F.min(id_col).alias("group_id"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
        .withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    )
    salted = df.withColumn("salt", F.pmod(F.xxhash64(id_col), F.lit(salts)).cast("int"))
    return (
        salted.join(groups, [*keys, "salt"], "left")
        .drop("salt")
        .withColumns({"group_id": F.coalesce("group_id", F.col(id_col)), "group_size": F.coalesce("group_size", F.lit(1).cast("long"))})
    )


def local_components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges a-b and the smallest node of each one's component, by hooking and pointer jumping."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        for side in (x, y):
            np.minimum.at(new, label[side], low)
            np.minimum.at(new, side, low)
        while not np.array_equal(new, jumped := new[new]):
            new = jumped
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def _forest(batches):
    import pyarrow as pa

    for batch in batches:
        if batch.num_rows:
            nodes, root = local_components(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            keep = nodes != root
            yield pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(root[keep])], ["u", "v"])


def _with_least(rows: DataFrame, most: int | None) -> DataFrame:
    """(u, v, m) of rows (u, v): m is the least v of u. Nodes of more than ``most`` rows, if there may be any, are broadcast."""
    least = rows.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    if most is None:
        return rows.join(least.drop("n"), "u")
    hubs = F.broadcast(least.where(F.col("n") > most).drop("n"))
    rest = rows.join(hubs.select("u"), "u", "left_anti").join(least.where(F.col("n") <= most).drop("n"), "u")
    return rows.join(hubs, "u").unionByName(rest)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b): component is the smallest node that edges lead to.

    Alternating large-star and small-star rounds over a table in the shared folder; both steps take minima by
    aggregates that are combined before the shuffle. Edges of one Arrow batch are first reduced to a forest. A node with
    over a thousandth of all edges is a hub: its minimum is broadcast (there are at most 2,000 hubs), so its edges are
    not brought to one task. The number of rounds grows with the logarithm of the longest path.
    """
    spark = edges.sparkSession
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v")
    e = materialise(map_arrow(e, _forest, "u long, v long").distinct(), "edges")
    before = None
    while True:
        degree = e.union(e.select("v", "u")).groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s"))
        n, total, largest = degree.agg(F.sum("n"), F.sum("s"), F.max("n")).first()
        if not n or (n, total) == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v"), F.col("v")).distinct())
        before = (n, total)
        most = max(1000, n // 2000)
        most = most if largest > most else None
        both = e.union(e.select("v", "u"))
        large = _with_least(both, most).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        small = (
            _with_least(large, most)
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
            .select("x.*")
            .where("u != v")
            .distinct()
        )
        after = materialise(small, "edges")
        discard(spark, e)
        e = after
