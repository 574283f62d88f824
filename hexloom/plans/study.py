"""A whole study: table, ladder, control, models, evaluation, scenarios, refinement."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hexgrid import GRID, HexGrid
from ..functions.storage import cut
from ..operators import adaptive, control, folds, hotspot, metrics, models, quality
from ..schema import RISK
from .assemble import Layers, cell_table, label_scale_table


@dataclass
class Study:
    cells: DataFrame
    issues: DataFrame
    ladder: DataFrame
    control: DataFrame | None
    metrics: DataFrame
    oof: DataFrame
    scored: DataFrame
    mixed: DataFrame
    comparison: DataFrame
    fitted: models.RiskModels


def _long(name: str, x: DataFrame) -> DataFrame:
    """metric, value of the numbers of a table of one row."""
    numbers = [c for c, t in x.dtypes if t in ("double", "float", "int", "bigint", "boolean")]
    pairs = F.array(*[F.struct(F.lit(f"{name}_{c}").alias("metric"), F.col(c).cast("double").alias("value")) for c in numbers])
    return x.select(F.explode(pairs).alias("x")).select("x.*")


def evaluation(fitted: models.RiskModels, cells: DataFrame, oof: DataFrame) -> DataFrame:
    """metric, value: in-sample metrics, and metrics out of fold (mean and spread over folds, and pooled)."""
    return _long("in_sample", models.evaluate(fitted.predict(cells))).union(_long("blocked_cv", models.validation_report(oof)))


def baselines(cells: DataFrame) -> DataFrame:
    """metric, value: the ponding rule and the linear models, on all cells and as means over folds (cells must have fold_id)."""
    out = None
    whole, each = models.in_sample_baselines(cells), models.baseline_table(cells)
    for model in ("rule", "linear"):
        one = _long(f"{model}_in_sample", whole.where(F.col("model") == model))
        one = one.union(_long(f"{model}_blocked_cv", metrics.fold_spread(each.where(F.col("model") == model), models.FOLD_METRICS)))
        out = one if out is None else out.union(one)
    return out


def summary(study: Study) -> DataFrame:
    """part, metric, value: every number that the study reports, and counts of its tables."""
    n = lambda x, name: x.agg(F.count(F.lit(1)).alias(name))
    parts = {
        "table": _long("n", n(study.cells, "cells").crossJoin(n(study.issues, "issues")).crossJoin(n(study.scored, "scored"))),
        "ladder": study.ladder.select(F.concat_ws("_", F.lit("jaccard"), "coarse_res", "aggregation").alias("metric"), F.col("jaccard").alias("value")),
        "metrics": study.metrics,
        "comparison": _long("cells", study.comparison),
    }
    if study.control is not None:
        parts["control"] = _long("control", study.control)
    out = None
    for name, x in parts.items():
        x = x.select(F.lit(name).alias("part"), "metric", "value")
        out = x if out is None else out.union(x)
    return out


def infer(fitted: models.RiskModels, spark, box: tuple[float, float, float, float], layers: Layers, res: int = 9, rainfall_mm_h: float = 25.0, grid: HexGrid = GRID) -> DataFrame:
    """Scores of all cells of a box; rainfall_mm_h is the rain that was used."""
    return fitted.predict(cell_table(grid.cover(spark, box, res), layers, res, rainfall_mm_h, grid=grid))


def run_study(spine: DataFrame, layers: Layers, res: int = 9, fine: int = 1, rates=(("moderate", 25.0), ("heavy", 40.0), ("extreme", 100.0)), n_folds: int = 5, depth: int | None = None, grid: HexGrid = GRID) -> Study:
    """Every stage of a study over one spine; models come before refinement, which needs their scores."""
    cells = cut(cell_table(spine, layers, res, depth=depth, grid=grid))
    fine_spine = grid.children(spine.select("cell"), res, res + fine).select(F.col("child").alias("cell"))
    labels = label_scale_table(fine_spine, layers, res + fine, cells, res, grid)
    ladder = hotspot.resolution_ladder(labels, RISK, res + fine, grid=grid)
    fitted, held_out = models.train(cells)
    parts = folds.with_folds(folds.with_block(cells, res, grid=grid), n_folds)
    oof = cut(models.cross_validate(parts))
    scored = models.scenarios(fitted, cells, rates)
    first = fitted.predict(cells)
    mixed, comparison = adaptive.adaptive_run(first, res, res + 2, "predicted_risk", "flood_probability", grid=grid)
    checked = control.negative_control(first, "predicted_risk") if layers.coastal is not None else None
    return Study(cells, quality.issues(cells), ladder, checked, evaluation(fitted, cells, oof), oof, scored, mixed, comparison, fitted)
