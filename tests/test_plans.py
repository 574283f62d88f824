import pytest
from pyspark.sql import functions as F

from hexloom import queries
from hexloom.operators import models
from hexloom.plans.assemble import Layers, cell_table, demo_table, event_rainfall

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def cells(spark):
    x = demo_table(spark, (-74.0, 40.70, -73.96, 40.74), 9)
    return x.withColumn("rainfall_mm_h", F.pmod("cell", F.lit(50)).cast("double") + 10).cache()


def test_demo_table_is_labelled_as_synthetic(cells):
    assert {tuple(r) for r in cells.select("label_source", "feature_source", "assembly_mode").distinct().collect()} == {("synthetic", "synthetic", "demo")}
    assert cells.where("flood_risk < 0 or flood_risk > 1").count() == 0


def test_models_score_and_save(spark, cells, tmp_path):
    x = cells.withColumn("flood_class", (F.col("impervious_frac") > 0.45).cast("int"))
    fitted = models.fit_models(x, classifier=models.boosted_classifier(trees=3), regressor=models.boosted_regressor(trees=3))
    scored = fitted.predict(x)
    assert scored.count() == x.count() and scored.where("flood_probability < 0 or flood_probability > 1").count() == 0
    fitted.save(spark, str(tmp_path / "m"))
    again = models.RiskModels.load(spark, str(tmp_path / "m")).predict(x)
    assert again.select("cell", "predicted_risk").exceptAll(scored.select("cell", "predicted_risk")).count() == 0
    rows = models.scenarios(fitted, x, (("a", 20.0), ("b", 60.0)))
    assert rows.count() == 2 * x.count() and models.scenario_range(rows).where("pfi_range < 0").count() == 0
    with pytest.raises(ValueError):
        models.fit_models(x.withColumn("flood_class", F.lit(1)))
    with pytest.raises(FileNotFoundError):
        models.RiskModels.load(spark, str(tmp_path / "none"))


def test_event_rain_replaces_or_does_nothing(spark, cells):
    assert event_rainfall(cells, None, 9) is cells
    pixels = cells.limit(1).select(F.col("lon").alias("x"), F.col("lat").alias("y"), F.lit(55.0).alias("value"))
    assert [r.rainfall_mm_h for r in event_rainfall(cells, pixels, 9).where("rainfall_mm_h is not null").collect()] == [55.0]


def test_overlay_leaves_labels_alone(spark, cells):
    spine = cells.select("cell", "lon", "lat")
    plain = cell_table(spine, Layers(flood_points=spine.limit(5)), 9, depth=1)
    ring = spark.createDataFrame([([[(-75.0, 40.0), (-73.0, 40.0), (-73.0, 41.0), (-75.0, 40.0)]],)], "rings array<array<struct<x:double,y:double>>>")
    more = cell_table(spine, Layers(flood_points=spine.limit(5), coastal=ring), 9, depth=1)
    same = ["cell", "flood_risk", "flood_class", "label_source"]
    assert plain.select(same).exceptAll(more.select(same)).count() == 0 and "sandy_class" in more.columns


@pytest.mark.parametrize("name", ["point_mean", "resolution_ladder", "negative_control", "incident_windows", "linear_oof", "linear_holdout", "blocked_report"])
def test_queries_match_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in ("events", "supplier", "part", "labels", "customer"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF).toPandas()
    want = c.execute(queries.SQL[name]).df()[list(got.columns)]
    key = list(got.columns)
    text = lambda df: sorted(tuple(str(float(v)) if isinstance(v, (int, float)) else str(v) for v in r) for r in df[key].itertuples(index=False, name=None))
    assert text(got) == text(want)


def test_registered_models_are_whole(spark, monkeypatch):
    class Stop(Exception):
        pass

    trees, n_folds = [], []

    def watch(make):
        def made(*args, **more):
            trees.append(make(*args, **more).getStages()[-1].getMaxIter())
            raise Stop

        return made

    monkeypatch.setattr(models, "boosted_classifier", watch(models.boosted_classifier))
    for name in ("train_score", "scenarios_pfi", "study_comparison", "live_risk", "cv_oof"):
        with pytest.raises(Stop):
            queries.QUERIES[name](spark, SF)
    assert len(trees) >= 5 and set(trees) == {80}

    def count(cells, *rest):
        n_folds.append(cells.select("fold_id").distinct().count())
        raise Stop

    monkeypatch.setattr(models, "cross_validate", count)
    monkeypatch.setattr(models, "baseline_table", count)
    for name in ("cv_oof", "baselines_cv"):
        with pytest.raises(Stop):
            queries.QUERIES[name](spark, SF)
    assert n_folds == [5, 5]


def test_registered_cell_table_covers_exactly(spark, monkeypatch):
    from hexloom.operators import overlay

    depths = []
    monkeypatch.setattr(overlay, "coverage", lambda spine, polygons, res, depth, grid, name: depths.append(depth) or spine.select("cell", F.lit(0.0).alias(name)))
    queries.QUERIES["cell_table"](spark, SF)
    assert depths == [None]


def test_layers_meet_the_spine_in_one_exchange(spark, cells):
    from hexloom.plans import assemble

    spine = cells.select("cell", "lon", "lat").limit(20)
    a = spine.limit(5).select("cell", F.lit(2.5).alias("v")).union(spark.createDataFrame([(7, 1.0), (None, 3.0)], "cell long, v double"))
    layers = {f"l{k}": a.withColumnRenamed("v", f"l{k}") for k in range(6)} | {"none": a.limit(0).withColumnRenamed("v", "none"), "count": a.select("cell", F.lit(3).alias("count"))}
    x = assemble.on_spine(spine, layers)
    rows = x.collect()
    assert len(rows) == 20 and sum(r.l3 == 2.5 for r in rows) == 5 and all(r.none is None for r in rows) and sum(r["count"] or 0 for r in rows) == 15
    assert all(r.lon is not None for r in rows) and assemble.on_spine(spine, {}).count() == 20
    plan = assemble.on_spine(spark.range(9).selectExpr("id as cell", "0D as lon", "0D as lat"), {f"l{k}": spark.range(9).selectExpr("id as cell", f"1D as l{k}") for k in range(8)})
    assert plan._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_live_risk_runs_to_its_last_row(spark, monkeypatch):
    monkeypatch.setattr(models, "boosted_classifier", lambda features: models.logistic_classifier(100, features))
    monkeypatch.setattr(models, "boosted_regressor", models.linear_regressor)
    rows = queries.QUERIES["live_risk"](spark, SF).collect()
    errors = spark.read.parquet(f"{SF}/events.parquet").where("event_type = 'error'")
    assert len(rows) == errors.count() == len({r.event_id for r in rows}) and all(r.PFI_h is not None for r in rows)


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() == 9


def test_validation_without_folds_or_classes_warns_and_has_no_predictions(cells):
    few = models.linear_models
    one = cells.withColumn("fold_id", F.lit(0))
    with pytest.warns(UserWarning, match="two blocks"):
        oof = models.cross_validate(one, few)
    assert oof.count() == cells.count() and oof.where("predicted_class is not null").count() == 0
    report = models.validation_report(oof).first()
    assert report.n_rows == cells.count() and report.accuracy_mean is None and report.roc_auc is None and report.roc_auc_mean is None
    split = cells.withColumn("fold_id", F.pmod("cell", F.lit(2)).cast("int")).withColumn("flood_class", (F.pmod("cell", F.lit(2)) == 0).cast("int"))
    with pytest.warns(UserWarning, match="one class"):
        assert models.cross_validate(split, few).where("predicted_class is not null").count() == 0


def test_reports_of_linear_models(spark, cells):
    from hexloom.plans import study

    x = cells.withColumn("fold_id", F.pmod("cell", F.lit(3)).cast("int")).withColumn("flood_class", (F.col("impervious_frac") > 0.45).cast("int"))
    fitted = models.linear_models(x)
    oof = models.cross_validate(x, models.linear_models)
    got = {r.metric: r.value for r in study.evaluation(fitted, x, oof).unionByName(study.baselines(x)).collect()}
    assert got["blocked_cv_n_folds"] == 3 and 0.9 <= got["in_sample_accuracy"] <= 1 and 0 <= got["rule_in_sample_accuracy"] <= 1
    assert {"linear_blocked_cv_accuracy_mean", "rule_blocked_cv_f1_sd", "blocked_cv_roc_auc"} <= set(got)
    assert all(0 <= got[f"{m}_{k}"] <= 1 for m in ("blocked_cv", "linear_blocked_cv", "rule_blocked_cv") for k in ("roc_auc_mean", "roc_auc_sd", "pr_auc_mean", "pr_auc_sd"))


def test_a_holdout_by_other_models_than_trees(cells):
    x = cells.withColumn("flood_class", (F.col("impervious_frac") > 0.45).cast("int"))
    fitted, found = models.train(x, ["impervious_frac", "slope_deg"], fit=models.linear_models)
    assert fitted.features == ["impervious_frac", "slope_deg"] and set(models.linear_coefficients(fitted.regressor, fitted.features)) == {"intercept", *fitted.features}
    row = found.first()
    assert row.accuracy > 0.9 and row.mae <= row.rmse


def test_a_whole_study_of_linear_models(spark, monkeypatch):
    """Models come before refinement, and every part reports numbers."""
    from hexloom.plans import study

    monkeypatch.setattr(models, "boosted_classifier", lambda features: models.logistic_classifier(100, features))
    monkeypatch.setattr(models, "boosted_regressor", models.linear_regressor)
    from hexloom.functions.hexgrid import GRID

    spine = GRID.cover(spark, (-74.0, 40.70, -73.98, 40.72), 9)
    box = spark.createDataFrame([([[(-74.0, 40.70), (-73.99, 40.70), (-73.99, 40.71), (-74.0, 40.70)]],)], "rings array<array<struct<x:double,y:double>>>")
    layers = Layers(flood_points=spine.where("cell % 2 = 0").select("lon", "lat"), coastal=box)
    one = study.run_study(spine, layers, 9, depth=1)
    got = study.summary(one).collect()
    assert {r.part for r in got} == {"table", "ladder", "metrics", "comparison", "control"}
    assert one.scored.count() == 3 * spine.count() and one.mixed.count() >= spine.count()


def test_one_class_leaves_the_predictions_of_risk(spark, cells, tmp_path):
    from hexloom.plans import study

    x = cells.withColumns({"flood_class": F.lit(1), "fold_id": F.pmod("cell", F.lit(2)).cast("int")})
    few = lambda y, features=("impervious_frac", "slope_deg"): models.linear_models(y, list(features))
    with pytest.warns(UserWarning, match="one class"):
        fitted, found = models.train(x, ["impervious_frac", "slope_deg"], fit=models.linear_models)
    row = found.first()
    assert row.mae is not None and row.rmse is not None and row.accuracy is None and row.roc_auc is None
    with pytest.warns(UserWarning, match="one class"):
        oof = models.cross_validate(x, few)
    assert oof.where("predicted_risk is not null and predicted_class is null and flood_probability is null").count() == x.count()
    fitted.save(spark, str(tmp_path / "m"))
    again = models.RiskModels.load(spark, str(tmp_path / "m"))
    assert again.classifier is None and again.features == fitted.features
    assert again.predict(x).select("cell", "predicted_risk").exceptAll(fitted.predict(x).select("cell", "predicted_risk")).count() == 0
    got = {r.metric: r.value for r in study.evaluation(fitted, x, oof).collect()}
    assert got["in_sample_mae"] is not None and got["in_sample_accuracy"] is None and got["blocked_cv_n_rows"] == x.count()


def test_a_whole_study_where_every_cell_flooded(spark, monkeypatch):
    from hexloom.functions.hexgrid import GRID
    from hexloom.plans import study

    monkeypatch.setattr(models, "boosted_regressor", models.linear_regressor)
    spine = GRID.cover(spark, (-74.0, 40.70, -73.98, 40.72), 9)
    one = study.run_study(spine, Layers(flood_points=spine.select("lon", "lat")), 9)
    got = {(r.part, r.metric): r.value for r in study.summary(one).collect()}
    assert got["table", "n_cells"] == spine.count() and got["metrics", "in_sample_accuracy"] is None and got["metrics", "in_sample_mae"] is not None


def test_models_are_fitted_on_rows_that_are_written_once(spark, cells, monkeypatch):
    from hexloom.schema import CLASS, FEATURES, RISK

    written, write = [], models.cut
    monkeypatch.setattr(models, "cut", lambda x: written.append(x.columns) or write(x))
    models.linear_models(cells)
    assert written == [[*FEATURES, RISK, CLASS]]


def test_raster_tiles_find_the_package_on_executors(tmp_path):
    """Executors whose PYTHONPATH lacks this package are sent it, as the study's raster layers need it there."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    code = f"""import sys
sys.path.insert(0, {str(root)!r})
from pyspark.sql import SparkSession
from hexloom.operators import raster
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
x = spark.createDataFrame([(0, 0, 2.0), (0, 1, 1.0)], "row int, col int, value double")
print(raster.d8_receiver(x).where("to_row is not null").collect())"""
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "SPARK_HOME")}
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "to_row=0, to_col=1" in out.stdout, out.stderr[-2000:]
