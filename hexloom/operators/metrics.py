"""Exact metrics of classifiers and regressors, over all rows or by group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.order import running_sums


def _f1(tp: Column, predicted: Column, actual: Column) -> Column:
    return F.when(predicted + actual == 0, 0.0).otherwise(tp * 2 / (predicted + actual))


def classification(df: DataFrame, truth: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """n, accuracy and F1 (0 where undefined)."""
    y, p = F.col(truth), F.col(predicted)
    x = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg((y == p).cast("double")).alias("accuracy"), F.sum(y * p).alias("tp"), F.sum(p).alias("pp"), F.sum(y).alias("ap")
    )
    return x.select(*by, "n", "accuracy", _f1(F.col("tp"), F.col("pp"), F.col("ap")).alias("f1"))


def regression(df: DataFrame, truth: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """MAE, RMSE and R squared (null where the truth does not vary)."""
    e = F.col(truth) - F.col(predicted)
    x = df.groupBy(*by).agg(F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.var_pop(truth).alias("v"))
    return x.select(*by, "mae", F.sqrt("mse").alias("rmse"), F.when(F.col("v") > 0, 1 - F.col("mse") / F.col("v")).alias("r2"))


def _by_score(df: DataFrame, truth: str, score: str, by: Sequence[str]) -> DataFrame:
    """Positives and negatives at each score (of each group), with the sums over smaller scores: ties are one row."""
    x = df.where(F.col(score).isNotNull() & F.col(truth).isNotNull()).groupBy(*by, F.col(score).cast("double").alias("s"))
    x = x.agg(F.sum(F.col(truth).cast("long")).alias("pos"), F.sum(1 - F.col(truth).cast("long")).alias("neg"))
    return running_sums(x, "s", ["pos", "neg"], by)


def ranking(df: DataFrame, truth: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """roc_auc and average_precision, one row (for each group): exact, null without both classes.

    AUC counts ties a half; average precision sums each step of recall times the precision there. Both come from one pass
    over the scores, for all groups together. Rows without truth or score do not count; a group of such rows has no row.
    """
    by = list(by)
    x = _by_score(df, truth, score, by)
    # precision at a score is over the rows that are no smaller: p and n are known only at the end, so sums are kept of
    # what is below, and the rest is a second aggregate over the same written rows
    total = x.groupBy(*by).agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")) if by else x.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    if by:
        on = None
        for g in by:
            same = F.col(g).eqNullSafe(F.col(f"hx_of_{g}"))
            on = same if on is None else on & same
        x = x.join(total.select(*[F.col(g).alias(f"hx_of_{g}") for g in by], "p", "n"), on)
    else:
        x = x.crossJoin(F.broadcast(total))
    tp, fp = F.col("p") - F.col("before_pos"), F.col("n") - F.col("before_neg")
    both = (F.max("p") > 0) & (F.max("n") > 0)
    auc = F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2)) / (F.max("p") * F.max("n"))
    out = [F.when(both, auc).alias("roc_auc"), F.when(both, F.sum(F.when(F.col("p") > 0, F.col("pos") / F.col("p") * tp / (tp + fp)))).alias("average_precision")]
    return x.groupBy(*by).agg(*out) if by else x.agg(*out)


def roc_auc(df: DataFrame, truth: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """One row (of each group), roc_auc, as ``ranking`` has it."""
    return ranking(df, truth, score, by).select(*by, "roc_auc")


def average_precision(df: DataFrame, truth: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """One row (of each group), average_precision, as ``ranking`` has it."""
    return ranking(df, truth, score, by).select(*by, "average_precision")


def fold_ranking(df: DataFrame, truth: str, score: str, fold: str) -> DataFrame:
    """fold, roc_auc and pr_auc (average precision) of each fold: null where a fold holds one class."""
    return ranking(df, truth, score, [fold]).withColumnRenamed("average_precision", "pr_auc")


def discrimination(df: DataFrame, truth: str, score: str, fold: str) -> DataFrame:
    """Pooled AUC and AP of a stored table, and the mean and spread over folds of AUC, AP and, where there is a predicted
    class (y_pred), of accuracy and F1, without fitting anything anew. Folds of one class have no AUC or AP, and are left
    out of their means."""
    x = ranking(df, truth, score).crossJoin(fold_spread(fold_ranking(df, truth, score, fold), ["roc_auc", "pr_auc"]))
    return x.crossJoin(fold_spread(classification(df, truth, "y_pred", [fold]), ["accuracy", "f1"])) if "y_pred" in df.columns else x


def fold_spread(folds: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean and population SD over folds; nulls (folds of one class) are left out."""
    return folds.agg(*[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("sd", F.stddev_pop))])


def fold_summary(df: DataFrame, fold: str, block: str, truth: str) -> DataFrame:
    """Rows, blocks, classes and the sorted list of blocks of each fold."""
    return df.groupBy(fold).agg(
        F.count(F.lit(1)).alias("n_test"),
        F.count_distinct(block).alias("n_test_blocks"),
        F.sum(F.col(truth)).cast("long").alias("n_positive_test"),
        F.sum(1 - F.col(truth)).cast("long").alias("n_negative_test"),
        F.array_join(F.array_sort(F.collect_set(F.col(block).cast("string"))), ",").alias("test_block_ids"),
    )


def constant_baselines(df: DataFrame, truth: str, predicted: str, fold: str) -> DataFrame:
    """Accuracy and F1 of always saying yes or no, by fold mean and pooled, the majority class, and whether the model wins.

    Always saying no finds no positive, so its F1 is 0; so is that of yes in a fold without positives.
    """
    y = F.col(truth)
    each = df.groupBy(fold).agg(F.avg(y.cast("double")).alias("share"), F.avg((y == F.col(predicted)).cast("double")).alias("model"))
    f1 = F.col("share") * 2 / (F.col("share") + 1)
    means = each.agg(
        F.avg("share").alias("always_positive_accuracy"),
        F.avg(f1).alias("always_positive_f1"),
        F.avg(1 - F.col("share")).alias("always_negative_accuracy"),
        F.avg(F.lit(0.0)).alias("always_negative_f1"),
        F.avg("model").alias("model_accuracy"),
    )
    pooled = df.agg(F.avg(y.cast("double")).alias("share"), F.avg((y == F.col(predicted)).cast("double")).alias("model"))
    pooled = pooled.select(
        F.col("share").alias("pooled_positive_share"), f1.alias("pooled_positive_f1"), (1 - F.col("share")).alias("pooled_negative_accuracy"), F.col("model").alias("pooled_model_accuracy")
    )
    x = means.crossJoin(pooled)
    return x.withColumns(
        {
            "majority": F.when(F.col("pooled_positive_share") > 0.5, "positive").otherwise("negative"),
            "beats_positive": F.col("model_accuracy") > F.col("always_positive_accuracy"),
            "beats_negative": F.col("model_accuracy") > F.col("always_negative_accuracy"),
        }
    )


def masked_means(df: DataFrame, value: str, masks: dict[str, Column]) -> DataFrame:
    """One row: number and mean of the value under each mask."""
    out = []
    for name, mask in masks.items():
        m = F.coalesce(mask, F.lit(False))
        out += [F.sum(m.cast("long")).alias(f"n_{name}"), F.avg(F.when(m, F.col(value))).alias(f"mean_{name}")]
    return df.agg(*out)
