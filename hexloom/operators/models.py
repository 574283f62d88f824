"""Boosted trees and linear baselines, blocked cross-validation, scenarios."""

from __future__ import annotations

import json
import warnings
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import ponding_score
from ..functions.storage import cut
from ..schema import CLASS, FEATURES, RISK, require
from . import metrics
from .folds import stratified_split


def _front(features: Sequence[str]) -> list:
    return [
        VectorAssembler(inputCols=list(features), outputCol="hx_raw", handleInvalid="error"),
        StandardScaler(inputCol="hx_raw", outputCol="hx_features", withMean=True),
    ]


def boosted_classifier(features: Sequence[str] = FEATURES, trees: int = 80, depth: int = 4, rate: float = 0.08, seed: int = 42) -> Pipeline:
    last = GBTClassifier(featuresCol="hx_features", labelCol=CLASS, predictionCol="hx_class", maxIter=trees, maxDepth=depth, stepSize=rate, seed=seed)
    last = last.setProbabilityCol("hx_probability").setRawPredictionCol("hx_raw_class")
    return Pipeline(stages=[*_front(features), last])


def boosted_regressor(features: Sequence[str] = FEATURES, trees: int = 80, depth: int = 4, rate: float = 0.08, seed: int = 42) -> Pipeline:
    last = GBTRegressor(featuresCol="hx_features", labelCol=RISK, predictionCol="hx_risk", maxIter=trees, maxDepth=depth, stepSize=rate, seed=seed)
    return Pipeline(stages=[*_front(features), last])


def logistic_classifier(n_rows: int, features: Sequence[str] = FEATURES) -> Pipeline:
    """Ridge-penalised with weight 1 on the sum of losses, that is 1 / n on their mean."""
    last = LogisticRegression(featuresCol="hx_features", labelCol=CLASS, predictionCol="hx_class", probabilityCol="hx_probability", rawPredictionCol="hx_raw_class", maxIter=500, regParam=1.0 / max(1, n_rows), elasticNetParam=0.0, standardization=False)
    return Pipeline(stages=[*_front(features), last])


def linear_regressor(features: Sequence[str] = FEATURES) -> Pipeline:
    return Pipeline(stages=[*_front(features), LinearRegression(featuresCol="hx_features", labelCol=RISK, predictionCol="hx_risk", solver="normal")])


@dataclass
class RiskModels:
    """Fitted models; without a classifier (there was one class only) rows have a risk, and neither probability nor class."""

    classifier: PipelineModel | None
    regressor: PipelineModel
    features: list[str]

    def predict(self, cells: DataFrame) -> DataFrame:
        """predicted_risk, flood_probability and predicted_class beside the columns of cells."""
        kept = [c for c in require(cells, *self.features).columns if c not in ("predicted_risk", "flood_probability", "predicted_class")]
        if self.classifier is None:
            x = cells.select(*kept, F.lit(None).cast("int").alias("predicted_class"), F.lit(None).cast("double").alias("flood_probability"))
        else:
            x = self.classifier.transform(cells).select(*kept, F.col("hx_class").cast("int").alias("predicted_class"), vector_to_array("hx_probability")[1].alias("flood_probability"))
        x = self.regressor.transform(x)
        return x.select(*kept, F.col("hx_risk").alias("predicted_risk"), "flood_probability", "predicted_class")

    def save(self, spark: SparkSession, path: str) -> None:
        if self.classifier is not None:
            self.classifier.write().overwrite().save(f"{path}/classifier")
        self.regressor.write().overwrite().save(f"{path}/regressor")
        # a classifier that an earlier model left there is not this one's
        named = self.features if self.classifier is not None else {"features": self.features, "classifier": False}
        spark.createDataFrame([(json.dumps(named),)], "value string").write.mode("overwrite").text(f"{path}/features")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> RiskModels:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/features")
        if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            raise FileNotFoundError(f"no models under {path}: train and save them first")
        named = json.loads(spark.read.text(f"{path}/features").first()[0])
        alone = isinstance(named, dict)
        return cls(None if alone else PipelineModel.load(f"{path}/classifier"), PipelineModel.load(f"{path}/regressor"), named["features"] if alone else named)


def fit_models(cells: DataFrame, features: Sequence[str] = FEATURES, classifier: Pipeline | None = None, regressor: Pipeline | None = None, partition_rows: int = 50_000, one_class: bool = False) -> RiskModels:
    """Both models on all rows. If there is one class only, an error; with ``one_class`` the regressor alone, and a warning.

    Every tree passes over the rows several times, a job each, so rows are written once, in partitions of ``partition_rows``
    or more: no job carries what made them, and a small table is not spread over tasks that cost more than their work.
    """
    require(cells, *features, RISK, CLASS)
    n, kinds = cells.agg(F.count(F.lit(1)), F.count_distinct(CLASS)).first()
    if kinds < 2 and not (one_class and kinds):
        raise ValueError(f"{CLASS} has {'one class only' if kinds else 'no class'}")
    if kinds < 2:
        warnings.warn(f"{CLASS} has one class only: there are predictions of the risk, and none of the class", stacklevel=2)
    cells = cut(cells.select(*features, RISK, CLASS).coalesce(1 + n // partition_rows))
    fitted = (classifier or boosted_classifier(features)).fit(cells) if kinds > 1 else None
    return RiskModels(fitted, (regressor or boosted_regressor(features)).fit(cells), list(features))


def fit_study(cells: DataFrame, features: Sequence[str] = FEATURES) -> RiskModels:
    """The boosted models; the regressor alone where there is one class only."""
    return fit_models(cells, features, one_class=True)


def train(cells: DataFrame, features: Sequence[str] = FEATURES, key: str = "cell", fit: Callable[[DataFrame, Sequence[str]], RiskModels] | None = None) -> tuple[RiskModels, DataFrame]:
    """Models (boosted ones, or those that ``fit`` makes) fitted on four fifths of the rows, stratified by class, and one row
    of metrics on the rest. With one class only, the metrics are those of the risk; the others are null."""
    split = cut(stratified_split(cells, CLASS, key))
    models = (fit or fit_study)(split.where(~F.col("is_test")), features)
    tested = models.predict(split.where("is_test"))
    return models, evaluate(tested)


def evaluate(predicted: DataFrame) -> DataFrame:
    """One row: accuracy, F1, MAE, RMSE, R squared, AUC and average precision of predictions."""
    predicted = cut(predicted.select(CLASS, RISK, "predicted_class", "predicted_risk", "flood_probability"))
    x = metrics.classification(predicted, CLASS, "predicted_class").crossJoin(metrics.regression(predicted, RISK, "predicted_risk"))
    return x.crossJoin(metrics.ranking(predicted, CLASS, "flood_probability"))


def cross_validate(cells: DataFrame, fit: Callable[[DataFrame], RiskModels] = fit_study, threads: int = 2) -> DataFrame:
    """Out-of-fold predictions of cells that have fold_id: each fold by models that have not seen it.

    Folds are fitted side by side; a fold is one filter on rows that are written once. A fold whose training rows hold
    one class only has no classifier: its rows have a predicted risk alone, and a warning says so (``fit`` must take such
    rows). With fewer than two folds no row has any prediction. The result does not depend on what is cached.
    """
    cells = cut(cells)
    kinds = {"predicted_risk": "double", "flood_probability": "double", "predicted_class": "int"}
    without = lambda x: x.withColumns({c: F.lit(None).cast(t) for c, t in kinds.items()})
    seen = cells.groupBy("fold_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(CLASS).cast("long")).alias("p")).collect()
    folds = sorted(r["fold_id"] for r in seen)
    if len(folds) < 2:
        warnings.warn("blocked validation needs two blocks at least: there are no predictions", stacklevel=2)
        return without(cells)
    n, p = sum(r["n"] for r in seen), sum(r["p"] or 0 for r in seen)
    one_class = sorted(r["fold_id"] for r in seen if p - (r["p"] or 0) in (0, n - r["n"]))
    if one_class:
        warnings.warn(f"folds {one_class} leave one class to train on: their rows have a predicted risk, and no predicted class", stacklevel=2)

    def one(fold: int) -> DataFrame:
        held = cells.where(F.col("fold_id") == fold)
        return fit(cells.where(F.col("fold_id") != fold)).predict(held)

    with ThreadPoolExecutor(threads) as pool:
        parts = list(pool.map(one, folds))
    out = parts[0].select(*cells.columns, *kinds)
    for x in parts[1:]:
        out = out.unionByName(x.select(*cells.columns, *kinds))
    return out


def validation_report(oof: DataFrame) -> DataFrame:
    """One row: accuracy, F1, MAE, R squared, ROC-AUC and PR-AUC over folds (mean, sd), pooled AUC and average precision,
    rows and folds.

    Rows without a predicted class (folds that were trained on one class) count in n_rows only; with none left all metrics are null.
    A fold of one class has no AUC, and is left out of the means of AUC alone.
    """
    y = oof.where("predicted_class is not null")
    each = fold_metrics(y)
    spread = metrics.fold_spread(each, FOLD_METRICS).crossJoin(each.agg(F.count(F.lit(1)).alias("n_folds")))
    return spread.crossJoin(metrics.ranking(y, CLASS, "flood_probability")).crossJoin(oof.agg(F.count(F.lit(1)).alias("n_rows")))


FOLD_METRICS = ["accuracy", "f1", "mae", "r2", "roc_auc", "pr_auc"]


def fold_metrics(oof: DataFrame) -> DataFrame:
    """A row for each fold: n, accuracy, f1, mae, rmse, r2, roc_auc, pr_auc."""
    x = metrics.classification(oof, CLASS, "predicted_class", ["fold_id"]).join(metrics.regression(oof, RISK, "predicted_risk", ["fold_id"]), "fold_id")
    return x.join(metrics.fold_ranking(oof, CLASS, "flood_probability", "fold_id"), "fold_id", "left")


def scenarios(models: RiskModels, cells: DataFrame, rates: Sequence[tuple[str, float]] = (("default", 25.0),)) -> DataFrame:
    """Each cell under each rainfall: static features once, only the rain differs; PFI_h is the predicted risk."""
    return models.predict(scenario_cells(cells, rates)).withColumn("PFI_h", F.col("predicted_risk"))


def scenario_cells(cells: DataFrame, rates: Sequence[tuple[str, float]]) -> DataFrame:
    """Each row once for each rainfall, in place of its own: scenario, rainfall_mm_h. The rates are the caller's few."""
    rain = cells.sparkSession.createDataFrame(list(rates), "scenario string, rainfall_mm_h double")
    return cells.drop("rainfall_mm_h", "scenario").crossJoin(F.broadcast(rain))


def joined_scores(observed: DataFrame, oof: DataFrame, scored: DataFrame, scenario: str) -> DataFrame:
    """cell, observed risk, out-of-fold probability and the scenario's PFI_h, where all three are there."""
    x = observed.select("cell", F.col(RISK).alias("observed_risk")).join(oof.select("cell", "flood_probability"), "cell")
    return x.join(scored.where(F.col("scenario") == scenario).select("cell", "PFI_h"), "cell").dropna()


def scenario_range(scored: DataFrame) -> DataFrame:
    """Greatest less least PFI_h of each cell over its scenarios: 0 everywhere if training rain never varied."""
    return scored.groupBy("cell").agg((F.max("PFI_h") - F.min("PFI_h")).alias("pfi_range"))


def linear_models(cells: DataFrame, features: Sequence[str] = FEATURES) -> RiskModels:
    return fit_models(cells, features, logistic_classifier(cells.count(), features), linear_regressor(features), one_class=True)


def linear_coefficients(model: PipelineModel, features: Sequence[str] = FEATURES) -> dict[str, float]:
    """Coefficients of a fitted linear model of either kind on the features as they are, and its intercept."""
    scaler, last = model.stages[-2], model.stages[-1]
    spread = scaler.std.toArray()
    slopes = [w / s if s > 0 else 0.0 for w, s in zip(last.coefficients.toArray(), spread, strict=True)]
    shift = sum(b * m for b, m in zip(slopes, scaler.mean.toArray(), strict=True))
    return {"intercept": float(last.intercept - shift)} | {f: float(b) for f, b in zip(features, slopes, strict=True)}


def gram_sums(cells: DataFrame, target: str, features: Sequence[str] = FEATURES) -> DataFrame:
    """a, b, total: sums of the products of each two of a constant, the features and the target: all that least squares needs,
    from one aggregate. Rows with a missing value are left out."""
    names = ["intercept", *features, target]
    value = {n: F.lit(1.0) if n == "intercept" else F.col(n).cast("double") for n in names}
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    sums = cells.dropna(subset=[*features, target]).agg(*[F.sum(value[a] * value[b]).alias(f"hx_{k}") for k, (a, b) in enumerate(pairs)])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"hx_{k}").alias("total")) for k, (a, b) in enumerate(pairs)])).alias("x")).select("x.*")


def logistic_gradient(cells: DataFrame, model: PipelineModel, features: Sequence[str] = FEATURES) -> DataFrame:
    """a, gradient: of the penalised mean loss of a fitted logistic model in each of its coefficients (on scaled features) and
    its intercept, at its solution, where all should be near 0."""
    x = model.transform(cells).select(vector_to_array("hx_features").alias("x"), (vector_to_array("hx_probability")[1] - F.col(CLASS)).alias("e"))
    last = model.stages[-1]
    weights, penalty = last.coefficients.toArray(), last.getRegParam()
    sums = x.agg(F.avg("e").alias("hx_0"), *[F.avg(F.col("x")[k] * F.col("e")).alias(f"hx_{k + 1}") for k in range(len(features))])
    parts = [F.struct(F.lit("intercept").alias("a"), F.col("hx_0").alias("gradient"))]
    parts += [F.struct(F.lit(f).alias("a"), (F.col(f"hx_{k + 1}") + float(penalty * weights[k])).alias("gradient")) for k, f in enumerate(features)]
    return sums.select(F.explode(F.array(*parts)).alias("x")).select("x.*")


def in_sample_baselines(cells: DataFrame) -> DataFrame:
    """Metrics of the ponding rule (spans over all rows) and of the linear baselines on the rows that they were fitted on."""
    rule = ponding_score(cells).withColumns({"predicted_class": (F.col("rule_score") >= 0.5).cast("int"), "predicted_risk": F.col("rule_score"), "flood_probability": F.col("rule_score")})
    both = [evaluate(x).withColumn("model", F.lit(n)) for n, x in (("rule", rule), ("linear", linear_models(cells).predict(cells)))]
    return both[0].unionByName(both[1])


def rule_by_fold(cells: DataFrame) -> DataFrame:
    """Metrics by fold of the ponding rule, its spans taken within each fold."""
    rule = ponding_score(cells, ["fold_id"]).withColumns({"predicted_risk": F.col("rule_score"), "flood_probability": F.col("rule_score")})
    return fold_metrics(rule.withColumn("predicted_class", (F.col("rule_score") >= 0.5).cast("int")))


def baseline_table(cells: DataFrame) -> DataFrame:
    """Metrics by fold of the ponding rule (spans within each fold) and of the linear baselines out of fold."""
    linear = fold_metrics(cross_validate(cells, linear_models).where("predicted_class is not null"))
    both = [x.withColumn("model", F.lit(n)) for n, x in (("rule", rule_by_fold(cells)), ("linear", linear))]
    return both[0].unionByName(both[1])
