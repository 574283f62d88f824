"""Which cells to refine, the mixed index that results, and what it keeps of a uniform fine grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hexgrid import GRID, HexGrid
from ..functions.order import quantile
from ..functions.scalars import uncertainty
from .hotspot import hotspots


def refine_parents(cells: DataFrame, score: str, probability: str | None = None, q: float = 0.8, least_uncertainty: float = 0.7, expand_k: int = 0, grid: HexGrid = GRID) -> DataFrame:
    """Cells at or over the q-quantile of the score, or uncertain; with expand_k their neighbours within the table."""
    x = cells.crossJoin(F.broadcast(quantile(cells, score, q, "hx_cut")))
    chosen = F.coalesce((F.col(score) >= F.col("hx_cut")) & ~F.isnan(score), F.lit(False))
    if probability is not None:
        chosen = chosen | F.coalesce((uncertainty(F.col(probability)) >= least_uncertainty) & ~F.isnan(probability), F.lit(False))
    picked = x.where(chosen).select("cell").distinct()
    if not expand_k:
        return picked
    near = grid.disk(picked, expand_k).select(F.col("near").alias("cell")).distinct()
    return near.join(cells.select("cell"), "cell", "left_semi").union(picked).distinct()


def mixed_cells(coarse: DataFrame, refined: DataFrame, res: int, fine_res: int, grid: HexGrid = GRID) -> DataFrame:
    """Coarse cells that aren't refined, and the descendants of those that are."""
    kept = coarse.select("cell").join(refined.select("cell"), "cell", "left_anti")
    fine = grid.children(refined.select("cell"), res, fine_res).select(F.col("child").alias("cell"))
    return kept.union(fine).distinct()


def covered(fine: DataFrame, mixed: DataFrame, res: int, coarsest: int = 0, grid: HexGrid = GRID) -> DataFrame:
    """The fine cells that are, or have an ancestor, in the mixed index."""
    lines = grid.with_ancestors(fine.select("cell").distinct(), res, list(range(coarsest, res + 1)))
    found = lines.join(mixed.select(F.col("cell").alias("parent")), "parent", "left_semi").select("cell").distinct()
    return fine.join(found, "cell", "left_semi")


def adaptive_metrics(mixed: DataFrame, uniform: DataFrame, score: str, fine_res: int, q: float = 0.9, coarsest: int = 0, grid: HexGrid = GRID) -> DataFrame:
    """One row: sizes of the mixed and uniform index, their ratio, and the share of uniform hotspots that are covered."""
    hot = hotspots(uniform, score, q).select("cell")
    held = covered(hot, mixed, fine_res, coarsest, grid)
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    x = n(mixed, "n_adaptive").crossJoin(n(uniform, "n_uniform_fine")).crossJoin(n(hot, "n_hotspot_uniform")).crossJoin(n(held, "hx_held"))
    return x.select(
        "n_adaptive",
        "n_uniform_fine",
        (F.col("n_adaptive") / F.greatest("n_uniform_fine", F.lit(1))).alias("cell_count_ratio"),
        "n_hotspot_uniform",
        (F.col("hx_held") / F.greatest("n_hotspot_uniform", F.lit(1))).alias("hotspot_recall"),
        F.lit(float(q)).alias("hotspot_quantile"),
    )


def adaptive_run(coarse: DataFrame, res: int, fine_res: int, score: str, probability: str | None = None, q: float = 0.8, least_uncertainty: float = 0.7, expand_k: int = 1, grid: HexGrid = GRID) -> tuple[DataFrame, DataFrame]:
    """The mixed index, and one row of its size against the coarse grid and the uniform fine grid (7 children a level)."""
    parents = refine_parents(coarse, score, probability, q, least_uncertainty, expand_k, grid)
    mixed = mixed_cells(coarse, parents, res, fine_res, grid)
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    uniform = F.col("n_fixed_coarse") * 7 ** max(0, fine_res - res)
    x = n(coarse.select("cell").distinct(), "n_fixed_coarse").crossJoin(n(parents, "n_parents_refined")).crossJoin(n(mixed, "n_adaptive_mixed"))
    row = x.select(
        "n_fixed_coarse",
        "n_parents_refined",
        "n_adaptive_mixed",
        uniform.cast("long").alias("n_uniform_fine"),
        (F.col("n_adaptive_mixed") / uniform).alias("cell_count_ratio"),
        (F.col("n_adaptive_mixed") / F.col("n_fixed_coarse")).alias("cell_count_ratio_vs_fixed"),
    )
    return mixed, row


def inherit_parent(fine: DataFrame, coarse: DataFrame, value: str, res: int, to: int, grid: HexGrid = GRID) -> DataFrame:
    """The parent's value on each fine cell, 0 where the parent is missing."""
    x = grid.with_parent(fine.drop(value), res, to, name="hx_parent")
    return x.join(coarse.select(F.col("cell").alias("hx_parent"), value), "hx_parent", "left").fillna(0.0, [value]).drop("hx_parent")
