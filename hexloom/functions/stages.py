"""Expressions in steps, each a set of columns made from those before; the text is plain SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Stages = list[dict[str, str]]


def num(x: float) -> str:
    """A DOUBLE literal: with an exponent it is one in any SQL dialect, without one it may be a decimal."""
    return f"({x!r}e0)" if "e" not in repr(float(x)) and isinstance(x, float) else f"({float(x)!r})" if "e" in repr(float(x)) else f"({x}e0)"


def apply(df: DataFrame, stages: Stages, keep: dict[str, str] | None = None) -> DataFrame:
    """Add the stages' columns; with keep, only the columns of df and those of keep (new name -> stage column) remain.

    What is kept comes out of a generator of one row: a condition on it (a filter's, or one that a join infers) stays
    above, where it reads a column. It would else be pushed through the stages and hold all of them, each as often as it
    is named. Conditions on other columns go on down.
    """
    columns = df.columns
    for stage in stages:
        df = df.withColumns({k: F.expr(v) for k, v in stage.items()})
    if keep is None:
        return df
    row = F.array(F.struct(*[F.col(v).alias(k) for k, v in keep.items()]))
    return df.select(*[F.col(f"`{c}`") for c in columns if c not in keep], F.inline(row))


def to_sql(source: str, stages: Stages) -> str:
    """The same as a nested query."""
    for k, stage in enumerate(stages):
        source = f"(select *, {', '.join(f'{v} as {n}' for n, v in stage.items())} from {source} s{k})"
    return source
