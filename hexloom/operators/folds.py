"""Spatial blocks, folds of whole blocks, and stratified splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hexgrid import GRID, HexGrid
from ..functions.order import running_sums


def with_block(cells: DataFrame, res: int, k: int = 2, grid: HexGrid = GRID) -> DataFrame:
    """block: the ancestor k levels up, at resolution 0 at the least."""
    return grid.with_parent(cells, res, max(0, res - k), name="block")


def fold_runs(counts: list[tuple[int, int]], folds: int) -> list[tuple[int, int, int, list[int]]]:
    """Rows (n, first_rank, how many, folds): blocks of n rows and those ranks go to the folds in turn.

    ``counts`` are pairs of block size and number of such blocks. Blocks go by falling size, each to the lightest fold
    (the first of several). Blocks of one size come back to the same fold after a whole turn, so as many turns as leave
    the order of the folds unchanged are one row.
    """
    folds = min(folds, sum(c for _, c in counts))
    load, out = [0] * folds, []
    for n, left in sorted(counts, reverse=True):
        rank = 0
        while left:
            order = sorted(range(folds), key=lambda f: (load[f], f))
            low = order[0]
            turn = [f for f in order if (load[f], f) < (load[low] + n, low)]
            rest = [load[f] for f in order[len(turn) :]]
            turns = max(1, min([left // len(turn), *[(x - load[turn[-1]]) // n - 1 for x in rest]]))
            many = min(left, turns * len(turn))
            out.append((n, rank, many, turn))
            for k, f in enumerate(turn):
                load[f] += n * (many // len(turn) + (k < many % len(turn)))
            rank, left = rank + many, left - many
    return out


def greedy_folds(sizes: DataFrame, folds: int = 5) -> DataFrame:
    """block, n, fold_id: blocks by falling size (then falling id), each to the fold with the fewest rows so far.

    The rule is sequential, but needs the number of blocks of each size only: the driver sees one row for each size, and
    a block finds its fold by its rank among the blocks of its size. There are no more folds than blocks.
    """
    counts = [(int(r[0]), int(r[1])) for r in sizes.groupBy("n").agg(F.count(F.lit(1))).collect()]
    if not counts:
        return sizes.select("block", "n", F.lit(0).cast("int").alias("fold_id"))
    spark = sizes.sparkSession
    runs = spark.createDataFrame(fold_runs(counts, folds), "n long, first long, many long, turn array<int>")
    # blocks of one size may be most of all blocks: their places are running counts, taken in slices
    placed = running_sums(sizes.select("block", F.col("n").cast("long").alias("n"), F.lit(1).cast("long").alias("one")), "block", ["one"], ["n"])
    ranked = placed.join(F.broadcast(spark.createDataFrame(counts, "n long, of_size long")), "n").select("block", "n", (F.col("of_size") - 1 - F.col("before_one")).alias("rank"))
    x = ranked.join(F.broadcast(runs.withColumnRenamed("n", "of")), F.expr("n = of and rank >= first and rank < first + many"))
    return x.select("block", "n", F.expr("turn[cast((rank - first) % size(turn) as int)]").alias("fold_id"))


def with_folds(cells: DataFrame, folds: int = 5, by_hash: bool = False) -> DataFrame:
    """fold_id on every row: greedy by block size, or by a hash of the block where there are very many blocks."""
    if by_hash:
        return cells.withColumn("fold_id", F.pmod(F.xxhash64("block"), F.lit(folds)).cast("int"))
    sizes = cells.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    return cells.join(greedy_folds(sizes, folds).select("block", "fold_id"), "block")


def stratified_split(df: DataFrame, label: str, key: str, share: float = 0.2, slice_rows: int = 100_000) -> DataFrame:
    """is_test on every row: of each class the rows with the least scrambled keys, share of them rounded down.

    Rows are ranked in slices of the scrambled order of about ``slice_rows`` rows, so no class is sorted in one task.
    """
    slices = min(1_000_003, 1 + df.count() // slice_rows)
    order = (F.pmod(F.col(key).cast("bigint"), F.lit(1_000_003)) * 7919 + 104729) % 1_000_003  # no key overflows
    x = df.withColumns({"hx_order": order, "hx_slice": F.floor(order * slices / 1_000_003)})
    counts = x.groupBy(label, "hx_slice").agg(F.count(F.lit(1)).alias("hx_n"))
    whole = Window.partitionBy(label)
    counts = counts.select(label, "hx_slice", (F.sum("hx_n").over(whole.orderBy("hx_slice")) - F.col("hx_n")).alias("hx_before"), F.sum("hx_n").over(whole).alias("hx_total"))
    rank = F.row_number().over(Window.partitionBy(label, "hx_slice").orderBy("hx_order", key))
    x = x.withColumn("hx_rank", rank).join(counts, [label, "hx_slice"])
    return x.withColumn("is_test", F.col("hx_before") + F.col("hx_rank") <= F.floor(F.col("hx_total") * share)).select(*df.columns, "is_test")
