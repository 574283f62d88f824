"""Checks of a training table, as a table of issues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import CLASS, FEATURE_RANGES


def issues(cells: DataFrame, least_cells: int = 50, least_share: float = 0.05, most_share: float = 0.95) -> DataFrame:
    """A row for each issue: check, column, n. None means that the table passed. One aggregate over the table.

    Checks: few_cells, class_balance, missing_column, null, below, above, synthetic_labels, fixture_table.
    """
    n = F.count(F.lit(1))
    rows = [("few_cells", "", n, n < least_cells)]
    if CLASS in cells.columns:
        share = F.avg(F.col(CLASS).cast("double"))
        rows.append(("class_balance", CLASS, F.sum(F.col(CLASS)), (share < least_share) | (share > most_share)))
    for c, (low, high) in FEATURE_RANGES.items():
        if c not in cells.columns:
            rows.append(("missing_column", c, F.lit(1), F.lit(True)))
            continue
        v = F.col(c).cast("double")
        for check, bad in (("null", v.isNull() | F.isnan(v)), ("below", v < low), ("above", ~F.isnan(v) & (v > high))):
            k = F.sum(F.coalesce(bad, F.lit(False)).cast("long"))
            rows.append((check, c, k, k > 0))
    for check, c, word in (("synthetic_labels", "label_source", "synthetic"), ("fixture_table", "assembly_mode", "fixture")):
        if c in cells.columns:
            rows.append((check, c, n, F.min((F.coalesce(F.col(c) == word, F.lit(False))).cast("int")) == 1))
    each = [F.struct(F.lit(a).alias("check"), F.lit(b).alias("column"), F.coalesce(k, F.lit(0)).cast("long").alias("n"), F.coalesce(bad, F.lit(False)).alias("bad")) for a, b, k, bad in rows]
    return cells.agg(F.array(*each).alias("x")).select(F.explode("x").alias("x")).select("x.*").where("bad").drop("bad")
