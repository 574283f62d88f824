import math
import random

import pytest
from pyspark.sql import functions as F

from hexloom.functions.hexgrid import GRID
from hexloom.functions.order import quantile, running_sums
from hexloom.operators import adaptive, control, folds, hotspot, metrics, nearest, overlay, points, quality, raster
from hexloom.schema import FEATURES, require


def test_published_folds(spark):
    sizes = spark.createDataFrame([(k, n) for k, n in enumerate((49, 25, 22, 17, 14, 10, 4))], "block long, n long")
    got = {r.n: r.fold_id for r in folds.greedy_folds(sizes, 5).collect()}
    assert got == {49: 0, 25: 1, 22: 2, 17: 3, 14: 4, 10: 4, 4: 3}
    assert {r.fold_id for r in folds.greedy_folds(sizes.limit(2), 5).collect()} == {0, 1}


def test_published_set_formulas(spark):
    a, b = spark.range(24).withColumnRenamed("id", "cell"), spark.range(4).withColumnRenamed("id", "cell")
    row = hotspot.set_agreement(a, b).first()
    assert math.isclose(row.jaccard, 4 / 24) and math.isclose(row.f1, 8 / 28)
    none = hotspot.set_agreement(a.limit(0), b.limit(0)).first()
    assert none.jaccard == 1 and none.f1 == 1
    apart = hotspot.set_agreement(a, b.select((F.col("cell") + 100).alias("cell"))).first()
    assert apart.jaccard == 0 and apart.f1 == 0


def test_published_adaptive_counts(spark):
    near = GRID.disk(spark.createDataFrame([(-74.0, 40.7)], "lon double, lat double").transform(lambda d: GRID.with_cell(d)).select("cell"), 7).select(F.col("near").alias("cell")).limit(141)
    x = near.orderBy("cell").withColumn("score", F.row_number().over(__import__("pyspark").sql.Window.orderBy("cell")).cast("double"))
    refined = x.orderBy("cell").limit(79).select("cell")
    assert adaptive.mixed_cells(x, refined, 9, 11).count() == 79 * 49 + 62


def test_quantile_is_exact_with_ties_and_missing(spark):
    rows = [(float(i % 37),) for i in range(1000)] + [(None,), (float("nan"),)]
    x = spark.createDataFrame(rows, "v double")
    for q in (0.0, 0.1, 0.5, 0.9, 1.0):
        want = x.where("v is not null and not isnan(v)").agg(F.percentile("v", q)).first()[0]
        assert math.isclose(quantile(x, "v", q).first()[0], want)
    assert quantile(x.limit(0), "v", 0.5).first()[0] is None


def test_running_sums(spark):
    x = spark.createDataFrame([(float(i), i) for i in range(200)], "s double, n long")
    for rows in (7, 1000):
        assert all(r.before_n == sum(range(r.n)) for r in running_sums(x, "s", ["n"], slice_rows=rows).collect())


def test_running_sums_of_groups(spark):
    rows = [(g, float(i), i) for i in range(300) for g in ("a", "b", None) if g != "b" or i < 9]  # one small group, and no name
    x = spark.createDataFrame(rows, "g string, s double, n long")
    got = running_sums(x, "s", ["n"], ["g"], slice_rows=40).collect()
    assert len(got) == len(rows) and all(r.before_n == sum(range(r.n)) for r in got)


def test_ranking_of_folds_of_one_class(spark):
    rows = [(0, 1, 0.9), (0, 0, 0.1), (0, 0, 0.9), (1, 1, 0.3), (1, 1, 0.2), (2, 0, 0.5), (3, 1, None), (3, None, 0.5), (None, 1, 0.7), (None, 0, 0.6)]
    x = spark.createDataFrame(rows, "fold int, y int, s double")
    got = {r.fold: (r.roc_auc, r.pr_auc) for r in metrics.fold_ranking(x, "y", "s", "fold").collect()}
    assert got == {0: (0.75, 0.5), 1: (None, None), 2: (None, None), None: (1.0, 1.0)}
    both = metrics.discrimination(x, "y", "s", "fold").first()
    assert both.roc_auc_mean == 0.875 and both.roc_auc_sd == 0.125 and both.pr_auc_mean == 0.75


def test_auc_and_precision_with_ties_and_one_class(spark):
    x = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.1), (0, 0.1), (1, 0.1)], "y int, s double")
    assert math.isclose(metrics.roc_auc(x, "y", "s").first()[0], (2.5 + 2 + 1) / 9)
    assert math.isclose(metrics.average_precision(x, "y", "s").first()[0], 1 / 3 * 1 / 2 + 1 / 3 * 2 / 3 + 1 / 3 * 3 / 6)
    assert metrics.roc_auc(x.where("y = 1"), "y", "s").first()[0] is None
    assert metrics.roc_auc(x.limit(0), "y", "s").first()[0] is None


def test_pit_drains_all_nine(spark):
    rows = [(r, c, 1.0 if (r, c) == (1, 1) else 3.0) for r in range(3) for c in range(3)]
    x = spark.createDataFrame(rows, "row int, col int, value double")
    flow = {(r.row, r.col): r.flow for r in raster.d8_accumulation(x).collect()}
    assert flow[1, 1] == 9 and flow[0, 0] == 1
    flat = {(r.row, r.col): r.slope_deg for r in raster.slope(x.withColumn("value", F.lit(2.0)), 0.001, 0.001, 40.7).collect()}
    assert set(flat.values()) == {0.0}


def test_long_valley(spark):
    x = spark.createDataFrame([(0, c, float(c)) for c in range(40)], "row int, col int, value double")
    assert [r.flow for r in raster.d8_accumulation(x).orderBy("col").collect()] == list(range(40, 0, -1))


def test_missing_pixel_in_a_row(spark):
    x = spark.createDataFrame([(0, 0, 1.0), (0, 1, None), (0, 2, 5.0), (0, 3, 7.0)], "row int, col int, value double")
    got = [r.slope_deg for r in raster.slope(x, 0.001, 0.001, 0.0).orderBy("col").collect()]
    assert got[1] is None and got[0] == 0.0 and got[2] > 0


def cells_around(spark, k=3):
    x = GRID.with_cell(spark.createDataFrame([(-74.0, 40.7)], "lon double, lat double"))
    cells = GRID.disk(x.select("cell"), k).select(F.col("near").alias("cell"))
    lon, lat = GRID.centre("cell", 9)
    return cells.select("cell", F.expr(lon).alias("lon"), F.expr(lat).alias("lat"))


def test_no_extent_is_dropped(spark):
    pts = spark.createDataFrame([(k, -74.0 + k * 1e-3, 40.7 + k * 7e-4) for k in range(40)], "id int, lon double, lat double")
    boxes = [(f"b{k}", -74.01 + k * 4e-5, 40.69 + k * 3e-5, -74.008 + k * 4e-5, 40.693 + k * 3e-5) for k in range(1200)]
    boxes += [("wide", -180.0, -90.0, 180.0, 90.0), ("endless", float("-inf"), -90.0, float("inf"), 90.0), ("turned", -73.0, 40.0, -75.0, 41.0), ("none", None, 40.0, -73.0, 41.0)]
    boxes += [("dot", -74.0, 40.7, -74.0, 40.7)]
    extents = spark.createDataFrame(boxes, "name string, west double, south double, east double, north double")
    want = sorted((r.id, b[0]) for r in pts.collect() for b in boxes if b[1] is not None and b[1] <= r.lon <= b[3] and b[2] <= r.lat <= b[4])
    got = overlay.profile_filter(pts, extents)
    assert got.columns == ["id", "lon", "lat", "name"] and sorted((r.id, r.name) for r in got.collect()) == want
    assert {"wide", "endless", "dot"} < {n for _, n in want} and len(want) > 100


def test_overlapping_polygons_count_once_and_holes_not(spark):
    cells = cells_around(spark)
    box = spark.createDataFrame([(-75.0, 40.0, -73.0, 41.0)] * 2, "w double, s double, e double, n double")
    whole = overlay.box_rings(box, "w", "s", "e", "n").select("rings")
    assert {r.area_frac for r in overlay.coverage(cells, whole, depth=1).collect()} == {1.0}
    pair = whole.limit(1).select(F.flatten(F.array("rings", "rings")).alias("rings"))  # a hole as large as the polygon
    assert {r.area_frac for r in overlay.coverage(cells, pair, depth=1).collect()} == {0.0}
    assert {r.area_frac for r in overlay.coverage(cells, whole.limit(0), depth=1).collect()} == {0.0}


def test_nearest_matches_all_pairs(spark):
    cells = cells_around(spark, 4)
    seg = spark.createDataFrame([(-74.0, 40.7, -73.99, 40.7), (-73.8, 40.9, -73.7, 40.9), (-74.02, 40.69, -74.02, 40.69)], "x1 double, y1 double, x2 double, y2 double")
    got = {r.cell: r.dist_m for r in nearest.nearest_distance(cells, seg).collect()}
    d, lon, lat = nearest.foot(F.col("lon"), F.col("lat"))
    want = cells.crossJoin(seg).groupBy("cell").agg(F.min(d).alias("d")).collect()
    assert all(abs(got[r.cell] - r.d) < 0.01 * r.d + 1 for r in want)
    assert nearest.nearest_distance(cells, seg.limit(0)).where("dist_m is not null").count() == 0


def test_clip_segments(spark):
    seg = spark.createDataFrame([(-1.0, 0.5, 2.0, 0.5), (5.0, 5.0, 6.0, 6.0), (0.2, 0.2, 0.4, 0.4)], "x1 double, y1 double, x2 double, y2 double")
    got = sorted(tuple(round(v, 9) for v in r) for r in overlay.clip_segments(seg, (0.0, 0.0, 1.0, 1.0), 0.0).collect())
    assert got == [(0.0, 0.5, 1.0, 0.5), (0.2, 0.2, 0.4, 0.4)]


def test_labels_ignore_points_outside_the_spine(spark):
    cells = cells_around(spark, 1)
    pts = spark.createDataFrame([(-74.0, 40.7), (-74.0, 40.7), (-70.0, 45.0), (None, 1.0)], "lon double, lat double")
    x = points.point_label(cells, pts)
    assert x.count() == 7 and x.agg(F.sum("flood_point_count"), F.sum("flood_class")).first() == (2, 1)
    with_area = points.point_label(cells, None, cells.select("cell", F.lit(0.25).alias("area_frac")))
    assert {r.flood_risk for r in with_area.collect()} == {0.25}


def test_control_of_nothing_and_of_all(spark):
    x = spark.createDataFrame([(1, 0.9, 1.0, 0.0), (2, 0.1, 0.0, 0.5), (3, None, 0.0, 0.0)], "cell long, s double, sandy_area_frac double, flood_area_frac double")
    row = control.negative_control(x, "s").first()
    assert (row.n_coastal_only, row.n_pluvial_only, row.n_neither, row.n_high_score) == (1, 1, 1, 1)
    assert control.negative_control(x.limit(0), "s").first().n_cells == 0


def test_quality_of_an_empty_table(spark):
    x = spark.createDataFrame([], ", ".join(f"{c} double" for c in FEATURES) + ", flood_class int")
    assert {(r.check, r.column) for r in quality.issues(x).collect()} == {("few_cells", "")}
    with pytest.raises(KeyError):
        require(x, "cell")


def test_inherit_zero_where_the_parent_is_missing(spark):
    coarse = cells_around(spark, 0).select("cell", F.lit(0.7).alias("v"))
    fine = GRID.children(cells_around(spark, 1).select("cell"), 9, 10).select(F.col("child").alias("cell"))
    got = adaptive.inherit_parent(fine, coarse, "v", 10, 9).groupBy("v").count().collect()
    assert {(r.v, r["count"]) for r in got} == {(0.7, 7), (0.0, 42)}


def test_folds_as_by_a_plain_loop(spark):
    rng = random.Random(3)
    for trial in range(40):
        blocks = [(k, rng.choice([1, 1, 1, 2, 3, 7, 50])) for k in range(rng.randint(1, 60))]
        load, want = [0] * min(4, len(blocks)), {}
        for n, k in sorted(((n, k) for k, n in blocks), reverse=True):
            want[k] = load.index(min(load))
            load[want[k]] += n
        got = {}
        by_size = {s: sorted((k for k, n in blocks if n == s), reverse=True) for s in {n for _, n in blocks}}
        for n, first, many, turn in folds.fold_runs([(s, len(x)) for s, x in by_size.items()], 4):
            for r in range(first, first + many):
                got[by_size[n][r]] = turn[(r - first) % len(turn)]
        assert got == want
    assert folds.greedy_folds(spark.createDataFrame([], "block long, n long"), 5).count() == 0


def test_nearest_is_found_however_far(spark):
    cells = cells_around(spark, 2)
    far = spark.createDataFrame([(-60.0, 50.0, -60.0, 50.001), (-100.0, 20.0, -99.9, 20.0)], "x1 double, y1 double, x2 double, y2 double")
    got = {r.cell: r.dist_m for r in nearest.nearest_distance(cells, far).collect()}
    d, lon, lat = nearest.foot(F.col("lon"), F.col("lat"))
    want = cells.crossJoin(far).groupBy("cell").agg(F.min_by(F.struct(lon.alias("x"), lat.alias("y")), d).alias("p"), F.first("lon").alias("lon"), F.first("lat").alias("lat"))
    from hexloom.functions.scalars import haversine

    want = want.select("cell", haversine(F.col("lon"), F.col("lat"), F.col("p.x"), F.col("p.y")).alias("m")).collect()
    assert len(got) == 19 and all(math.isclose(got[r.cell], r.m, rel_tol=1e-9) for r in want)


def test_rasters_of_one_table_do_not_mix(spark):
    one = [("a", 0, c, float(c)) for c in range(6)]
    two = [("b", 0, c, float(-c)) for c in range(6)]
    x = spark.createDataFrame(one + two, "raster_id string, row int, col int, value double")
    flow = {(r.raster_id, r.col): r.flow for r in raster.d8_accumulation(x).collect()}
    assert [flow["a", c] for c in range(6)] == [6, 5, 4, 3, 2, 1] and [flow["b", c] for c in range(6)] == [1, 2, 3, 4, 5, 6]
    scaled = {(r.raster_id, r.col): r.value for r in raster.fraction_scale(x.withColumn("value", F.when(F.col("raster_id") == "a", F.col("value") * 20).otherwise(F.abs("value") / 5))).collect()}
    assert scaled["a", 5] == 1.0 and scaled["a", 1] == 0.2 and scaled["b", 5] == 1.0 and scaled["b", 1] == 0.2


def test_centroids(spark):
    square = [[(10.0, 50.0), (12.0, 50.0), (12.0, 52.0), (10.0, 52.0), (10.0, 50.0)], [(10.0, 50.0), (10.0, 51.0), (11.0, 51.0), (11.0, 50.0), (10.0, 50.0)]]
    x = spark.createDataFrame([(1, square), (2, [[(1.0, 2.0)]]), (3, square[:1])], "id int, rings array<array<struct<x:double,y:double>>>")
    got = {r.id: (round(r.lon, 9), round(r.lat, 9)) for r in points.centroids(x).collect()}
    assert got == {1: (round((44 - 10.5) / 3, 9), round((204 - 50.5) / 3, 9)), 2: (1.0, 2.0), 3: (11.0, 51.0)}


def test_quantiles_by_group_and_of_many_values(spark):
    x = spark.range(30_000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 30011).cast("double").alias("v"))
    for few in (20_000, 100):
        got = {r.g: r.threshold for r in quantile(x, "v", 0.9, by=["g"], few=few, margin=0.01).collect()}
        want = {r.g: r.p for r in x.groupBy("g").agg(F.percentile("v", 0.9).alias("p")).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)


def test_late_and_repeated_rows_of_a_stream(spark, tmp_path):
    from hexloom.streaming.incidents import run_available, windowed_counts

    rows = [[("a", "2024-01-01 00:10:00"), ("b", "2024-01-01 00:20:00"), ("a", "2024-01-01 00:10:00")], [("c", "2024-01-01 05:00:00")], [("x", "2024-01-01 05:10:00")], [("d", "2024-01-01 00:30:00"), ("c", "2024-01-01 05:00:00"), ("e", "2024-01-01 04:30:00")]]
    for k, part in enumerate(rows):
        spark.createDataFrame([(i, t, -74.0, 40.7) for i, t in part], "id string, t string, lon double, lat double").select("id", F.col("t").cast("timestamp").alias("ts"), "lon", "lat").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        import os
        import time

        for f in os.listdir(f"{tmp_path}/in/{k}"):
            os.utime(f"{tmp_path}/in/{k}/{f}", (time.time() + k, time.time() + k))
    stream = spark.readStream.schema("id string, ts timestamp, lon double, lat double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    counts = windowed_counts(stream, "1 hour", late="1 hour", once="id")
    got = {str(r.window_start)[11:13]: r.n for r in run_available(counts, str(tmp_path / "out"), ["window_start", "cell"]).collect()}
    assert got == {"00": 2, "05": 2, "04": 1}  # d came after its window had ended, a and c came twice


def test_index_of_a_cell_that_holds_half_of_all_points(spark):
    x = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, F.lit(1)).otherwise(F.col("id") % 97).alias("cell"), F.when(F.col("id") % 11 != 0, F.col("id") * 7919 % 30011 / 30011.0).alias("hx_score"))
    from hexloom.operators.shapes import index_by

    got = {r.cell: r for r in index_by(x, "cell", 0.8).collect()}
    want = x.groupBy("cell").agg(F.percentile("hx_score", 0.95).alias("p"), F.avg("hx_score").alias("m"), F.count(F.lit(1)).alias("n")).collect()
    assert len(got) == len(want) and max(r.n for r in want) > 20_000
    assert all(math.isclose(got[r.cell].score_p95, r.p) and math.isclose(got[r.cell].score_mean, r.m) and got[r.cell].n == r.n for r in want)


def test_folds_of_many_blocks_of_one_size(spark):
    sizes = spark.range(3000).select(F.col("id").alias("block"), F.when(F.col("id") < 10, 7).otherwise(1).cast("long").alias("n"))
    got = folds.greedy_folds(sizes, 4).collect()
    load = {}
    for r in got:
        load[r.fold_id] = load.get(r.fold_id, 0) + r.n
    assert len(got) == 3000 and max(load.values()) - min(load.values()) <= 1


def test_tiles_meet_without_a_seam(spark, monkeypatch):
    """A raster in small tiles gives what one tile gives; pixels may be missing, absent, or at negative places."""
    rng = random.Random(4)
    rows = [(a, r, c, None if rng.random() < 0.05 else float("nan") if rng.random() < 0.03 else float(rng.randint(0, 9)), "kept") for a in ("a", None) for r in range(-7, 9) for c in range(-5, 12) if rng.random() > 0.05]
    x = spark.createDataFrame(rows, "raster_id string, row int, col int, value double, note string").repartition(3)
    whole = raster.by_tiles
    results = {}
    for size in (256, 4, 1):
        monkeypatch.setattr(raster, "by_tiles", lambda *args, size=size, **more: whole(*args, size=size))
        tilt, to = raster.slope(x, 0.001, 0.001, 40.7), raster.d8_receiver(x)
        assert tilt.columns == [*x.columns, "slope_deg"]
        results[size] = sorted(map(str, tilt.collect())), sorted(map(str, to.collect()))
    assert results[256] == results[4] == results[1] and len(results[4][0]) == len(rows)
    z = {(a, r, c): v for a, r, c, v, _ in rows}
    top = {a: max(v for (b, _, _), v in z.items() if b == a and v is not None and v == v) for a in ("a", None)}
    for r in raster.d8_receiver(x).collect():
        high = lambda k, a=r.raster_id: top[a] if z[k] is None or z[k] != z[k] else z[k]
        near = [(high((r.raster_id, r.row + i, r.col + j)), k, r.row + i, r.col + j) for k, (i, j) in enumerate(raster.NEIGHBOURS) if (r.raster_id, r.row + i, r.col + j) in z]
        best = min(near, default=None)
        want = best[2:] if best and best[0] < high((r.raster_id, r.row, r.col)) else (None, None)
        assert (r.to_row, r.to_col) == want
    assert raster.slope(x.limit(0), 0.001, 0.001, 40.7).count() == 0 and raster.d8_receiver(x.limit(0)).count() == 0
