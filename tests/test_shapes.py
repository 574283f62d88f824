import math
import random

import pytest
from pyspark.sql import functions as F

from hexloom.functions.hexgrid import GRID, M_PER_LAT
from hexloom.operators import nearest, overlay, raster, shapes

RINGS = "rings array<array<struct<x:double,y:double>>>"


def blob(rng, x, y, r, n):
    out = [(x + r * rng.uniform(0.4, 1) * math.cos(2 * math.pi * k / n), y + r * rng.uniform(0.4, 1) * math.sin(2 * math.pi * k / n)) for k in range(n)]
    return [*out, out[0]]


def box(w, s, e, n):
    return [(w, s), (e, s), (e, n), (w, n), (w, s)]


def cells_around(spark, res, k):
    x = GRID.with_cell(spark.createDataFrame([(-74.0, 40.7)], "lon double, lat double"), res=res)
    return GRID.disk(x.select("cell"), k).select(F.col("near").alias("cell"))


@pytest.fixture(scope="module")
def polygons():
    rng = random.Random(7)
    out = [[blob(rng, -74 + rng.uniform(-0.02, 0.02), 40.7 + rng.uniform(-0.02, 0.02), rng.choice([5e-4, 2e-3, 1e-2, 2e-2]), rng.choice([3, 4, 9, 120]))] for _ in range(20)]
    out += [[blob(rng, -74.01, 40.71, 0.02, 40), box(-74.012, 40.708, -74.008, 40.712)]]  # with a hole
    out += [[box(-74.0, 40.69, -73.99, 40.70)], [box(-74.0, 40.69, -73.99, 40.70)]]  # sides through centres, twice
    out += [[box(-74.02, 40.68, -74.018, 40.682), box(-73.98, 40.715, -73.978, 40.717)]]  # in two parts
    out += [[box(-74.0, 40.7, -73.997, 40.703)[:-1]], [[(-74.0, 40.7), (-73.99, 40.71), (-74.0, 40.7)]], [[(-74.0, 40.7)]], [], None]  # not closed, no area, a point, none
    return out


def even_odd(rings, x, y):
    inside = False
    for ring in rings or []:
        for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True):
            if (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
                inside = not inside
    return inside


@pytest.mark.parametrize("res", [8, 9])
def test_centres_by_scan_lines(spark, polygons, res):
    x = spark.createDataFrame([(k, p) for k, p in enumerate(polygons)], "shape long, " + RINGS)
    got = {(r.shape, r.cell) for r in shapes.centre_cells(shapes.shape_edges(x, res), res).collect()}
    lon, lat = GRID.centre("cell", res)
    near = cells_around(spark, res, 16 if res == 9 else 7).select("cell", F.expr(lon).alias("x"), F.expr(lat).alias("y")).collect()
    sides = {k for k, p in enumerate(polygons) if p and p[0][0] == (-74.0, 40.69)}  # a centre on a side is in or out
    want = {(k, c.cell) for k, p in enumerate(polygons) for c in near if even_odd(p, c.x, c.y)}
    assert {g for g in got if g[0] not in sides} == {w for w in want if w[0] not in sides} and len(want) > 40


def clipped(ring, a, b):
    """The part of a convex polygon left of the line from a to b."""
    side = lambda p: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])
    out = []
    for p, q in zip(ring, [*ring[1:], ring[0]], strict=True):
        s, t = side(p), side(q)
        if s >= 0:
            out.append(p)
        if (s >= 0) != (t >= 0):
            out.append((p[0] + (q[0] - p[0]) * s / (s - t), p[1] + (q[1] - p[1]) * s / (s - t)))
    return out


def area(ring):
    x, y = ring[0]
    return sum((p[0] - x) * (q[1] - y) - (q[0] - x) * (p[1] - y) for p, q in zip(ring, [*ring[1:], ring[0]], strict=True)) / 2


@pytest.mark.parametrize("res, few", [(9, 64), (9, 3), (8, 64)])
def test_one_triangle_covers_what_clipping_says(spark, res, few):
    rng = random.Random(3)
    for _ in range(2):
        t = [(-74 + rng.uniform(-0.02, 0.02), 40.7 + rng.uniform(-0.02, 0.02)) for _ in range(3)]
        t = t if area(t) > 0 else t[::-1]
        x = spark.createDataFrame([([[*t, t[0]]],)], RINGS)
        got = {r.cell: r.area_frac for r in shapes.covered_fraction(cells_around(spark, res, 6), x, res, few=few).collect()}
        rings = cells_around(spark, res, 6).select("cell", GRID.boundary(F.col("cell"), res).alias("r")).collect()
        assert len(got) == len(rings)
        for r in rings:
            part = [(p.x, p.y) for p in r.r][:-1]
            for a, b in zip(t, [*t[1:], t[0]], strict=True):
                part = clipped(part, a, b) if part else part
            want = area(part) * GRID.kx * M_PER_LAT / (GRID.area_km2(res) * 1e6) if part else 0.0
            assert math.isclose(got[r.cell], want, abs_tol=1e-9)


def test_union_against_samples_and_strips(spark, polygons):
    cells, x = cells_around(spark, 9, 8), spark.createDataFrame([(p,) for p in polygons], RINGS)
    got = {r.cell: r.area_frac for r in overlay.coverage(cells, x).collect()}
    near = {r.cell: r.area_frac for r in overlay.coverage(cells, x, depth=3).collect()}
    assert len(got) == 217 and max(abs(got[c] - near[c]) for c in got) < 0.06
    assert abs(sum(got.values()) - sum(near.values())) < 0.01 * sum(got.values())  # descendants of all cells cover the ground of all cells
    strips = {r.cell: r.area_frac for r in shapes.covered_fraction(cells, x, few=2).collect()}
    assert all(math.isclose(got[c], strips[c], abs_tol=1e-12) for c in got)
    keyed = shapes.covered_fraction(cells, x.withColumn("id", F.monotonically_increasing_id()).where("rings is not null"), key="id")
    assert all(math.isclose(got[r.cell], r.area_frac, abs_tol=1e-12) for r in keyed.collect())
    assert {r.area_frac for r in shapes.covered_fraction(cells, x.limit(0)).collect()} == {0.0}


def test_square_whose_side_runs_through_centres(spark):
    """At an even level a column of centres lies at the grid's longitude exactly; a square that ends there holds none of it."""
    west, east = box(-74.004, 40.70, -74.0, 40.72), box(-74.0, 40.70, -73.996, 40.72)
    cells = cells_around(spark, 10, 9)
    for depth in (None, 3):
        one, other, both = ({r.cell: r.area_frac for r in overlay.coverage(cells, spark.createDataFrame([(p,) for p in x], RINGS), 10, depth).collect()} for x in ([[west]], [[east]], [[west], [east]]))
        assert all(math.isclose(one[c] + other[c], both[c], abs_tol=1e-9) for c in both) and any(one.values())


def test_no_row_holds_a_whole_polygon(spark):
    n = 3000
    ring = [(-74 + 0.05 * math.cos(2 * math.pi * k / n), 40.7 + 0.04 * math.sin(2 * math.pi * k / n)) for k in range(n)]
    x = spark.createDataFrame([(1, [ring])], "shape long, " + RINGS)
    whole, along = shapes.local_shapes(shapes.shape_edges(x, 9), 9)
    sizes = [r[0] for r in along.select(F.size("edges")).collect()]
    assert sum(sizes) < 3 * n and max(sizes) < 100 and len(sizes) > 80  # edges go to the cells along them, about once
    assert whole.join(along, "cell").count() == 0 and whole.count() > 200
    wide = spark.createDataFrame([(1, [box(-80.0, 38.0, -70.0, 42.0)])], "shape long, " + RINGS)
    assert shapes.edge_cells(shapes.shape_edges(wide, 7), 7).count() < 10_000  # a long edge meets the cells along it, not its box


def test_points_in_zones(spark, polygons):
    rng = random.Random(5)
    pts = [(k, -74 + rng.uniform(-0.03, 0.03), 40.7 + rng.uniform(-0.03, 0.03)) for k in range(1500)] + [(-1, None, 40.7), (-2, -74.0, None)]
    x = spark.createDataFrame(pts, "id long, lon double, lat double").withColumn("cell", F.lit("clash"))
    zones = spark.createDataFrame([(k, p) for k, p in enumerate(polygons)], "zone_id long, " + RINGS)
    for res in (8, 9):
        found = shapes.point_zones(x, zones, res)
        assert found.columns == ["id", "lon", "lat", "cell", "zone_id"]
        got = sorted((r.id, r.zone_id) for r in found.collect())
        assert got == sorted((i, k) for i, lon, lat in pts if i >= 0 for k, p in enumerate(polygons) if even_odd(p, lon, lat))
    scored = x.withColumn("score", F.col("id") / 1500.0)
    index = {r.zone_id: r for r in shapes.zone_index(scored, zones).collect()}
    held = [i / 1500 for i, k in got if k == 20]
    assert len(index) == len(polygons) and index[20].n == len(held) and math.isclose(index[20].score_mean, sum(held) / len(held))
    assert index[len(polygons) - 1].n == 0 and index[len(polygons) - 1].score_mean is None
    assert shapes.point_zones(x, zones.limit(0)).count() == 0 and shapes.point_zones(x.limit(0), zones).count() == 0


def test_clipped_rings(spark):
    outer, hole = box(-1.0, -1.0, 3.0, 3.0), box(0.5, 0.5, 2.0, 2.0)
    tooth = [(0.2, 0.2), (5.0, 0.2), (5.0, 0.4), (2.0, 0.4), (2.0, 0.6), (5.0, 0.6), (5.0, 0.8), (0.2, 0.8)]  # leaves and comes back, not closed
    rows = [(1, [outer, hole]), (2, [box(4.0, 4.0, 5.0, 5.0)]), (3, [tooth]), (4, [box(1.0, 0.0, 2.0, 1.0)]), (5, []), (6, None), (7, [[(0.0, 0.0)], box(0.25, 0.25, 0.5, 0.5)]), (8, [box(-9.0, -9.0, 9.0, 9.0)])]
    x = spark.createDataFrame(rows, "id long, " + RINGS).withColumn("area", F.lit("clash"))
    cut = overlay.clip_rings(x, (0.0, 0.0, 1.0, 1.0), 0.0)
    got = {r.id: r.rings for r in cut.collect()}
    size = lambda ring: abs(area([(p.x, p.y) for p in ring][:-1]))
    assert cut.columns == x.columns and set(got) == {1, 3, 7, 8}
    assert [round(size(r), 12) for r in got[1]] == [1.0, 0.25] and [round(size(r), 12) for r in got[7]] == [0.0625] and size(got[8][0]) == 1.0
    assert math.isclose(size(got[3][0]), 0.8 * 0.6)  # of the two teeth only what lies in the box, where they are one
    assert all(r[0] == r[-1] for rings in got.values() for r in rings)


def test_cells_of_small_and_large_polygons(spark):
    rows = [(1, "Polygon", [box(-74.0005, 40.6995, -73.9995, 40.7005)]), (2, "Polygon", [box(-73.9985, 40.7005, -73.9983, 40.7007)]), (3, "MultiPolygon", [box(-74.02, 40.69, -74.0001, 40.71), box(-73.9, 40.8, -73.88, 40.81)])]
    x = spark.createDataFrame(rows, "feature_id long, geom_type string, " + RINGS)
    got: dict = {}
    for r in overlay.geometry_cells(x, 9).collect():
        got.setdefault(r.feature_id, set()).add(r.cell)
    near = GRID.cover(spark, (-74.05, 40.65, -73.85, 40.85), 9).select("cell", F.col("lon").alias("x"), F.col("lat").alias("y")).collect()
    assert got[3] == {c.cell for c in near if even_odd(rows[2][2], c.x, c.y)}
    spots = spark.createDataFrame([(k, w + (e - w) * i / 11, s + (n - s) * j / 11) for k, (w, s, e, n) in ((1, (-74.0005, 40.6995, -73.9995, 40.7005)), (2, (-73.9985, 40.7005, -73.9983, 40.7007))) for i in range(12) for j in range(12)], "k long, lon double, lat double")
    seen = {(r.k, r.cell) for r in GRID.with_cell(spots).collect()}
    assert got[2] == {c for k, c in seen if k == 2} and got[1] == {c.cell for c in near if even_odd(rows[0][2], c.x, c.y)}


def test_a_centre_on_an_edge_is_held(spark):
    """The origin is a centre; boxes with a side or a corner there hold it, whichever way the turn of the lattice rounds."""
    box = lambda w, s, e, n: [[(w, s), (e, s), (e, n), (w, n), (w, s)]]
    around = [(-74.0042, 40.698, -74.0, 40.702), (-74.0, 40.698, -73.9958, 40.702), (-74.002, 40.7, -73.998, 40.7042), (-74.002, 40.6958, -73.998, 40.7), (-74.0, 40.7, -73.996, 40.704)]
    x = spark.createDataFrame([(k, "Polygon", box(*b)) for k, b in enumerate(around)], "feature_id long, geom_type string, " + RINGS)
    for res in (8, 9):
        there = GRID.with_cell(spark.createDataFrame([(-74.0, 40.7)], "lon double, lat double"), res=res).first().cell
        assert overlay.geometry_cells(x, res).where(F.col("cell") == there).count() == len(around)
        assert shapes.centre_cells(shapes.shape_edges(x, res, GRID, "feature_id"), res, "feature_id").where(F.col("cell") == there).count() < len(around)


def test_polygons_inside_what_others_hold_are_left_out(spark, monkeypatch):
    """Three hundred boxes over one cell: only those along the border of their union are compared by pairs."""
    seen, real = [], shapes.cut
    monkeypatch.setattr(shapes, "cut", lambda x: seen.append(real(x)) or seen[-1])
    cell = GRID.with_cell(spark.createDataFrame([(-73.99, 40.71)], "lon double, lat double")).select("cell")
    lon, lat = cell.select(*[F.expr(e) for e in GRID.centre("cell", 9)]).first()
    draw = random.Random(5)
    boxes = []
    for _ in range(300):
        x, y, h = lon + draw.uniform(-0.001, 0.0), lat + draw.uniform(-0.001, 0.001), draw.uniform(0.0005, 0.0015)
        boxes.append([[(x - h, y - h), (x + h, y - h), (x + h, y + h), (x - h, y + h), (x - h, y - h)]])
    got = overlay.coverage(cell, spark.createDataFrame([(b,) for b in boxes], RINGS), 9).first().area_frac
    corners = [(x - lon, y - lat) for x, y in [(p.x, p.y) for p in cell.select(GRID.boundary(F.col("cell"), 9).alias("b")).first().b]]
    ring = [[(lon + x, lat + y) for x, y in corners]]
    n = hit = 0
    for i in range(120):
        for j in range(120):
            x, y = lon + (i - 59.5) * 4e-5, lat + (j - 59.5) * 4e-5
            if even_odd(ring, x, y):
                n, hit = n + 1, hit + any(b[0][0][0] <= x <= b[0][2][0] and b[0][0][1] <= y <= b[0][2][1] for b in boxes)
    assert abs(got - hit / n) < 0.01 and 0 < got < 1
    counts = [x.count() for x in seen]
    assert len(counts) == 4 and 0 < counts[3] < counts[1] / 4


def test_zones_count_equal_points_and_equal_zones_by_number(spark, monkeypatch):
    """Sixty of each: the same index, from no more pairs than one of each gives."""
    seen, real = [], shapes.cut
    monkeypatch.setattr(shapes, "cut", lambda x: seen.append(real(x)) or seen[-1])
    ring = [[(-74.01, 40.69), (-73.99, 40.69), (-73.99, 40.71), (-74.01, 40.71), (-74.01, 40.69)]]
    places = [(-74.0 + k / 1000, 40.7, None if k == 3 else k / 10) for k in range(-9, 9)]
    zones = spark.createDataFrame([(k, ring) for k in range(60)] + [(60, None)], "zone_id long, " + RINGS)
    got = shapes.zone_index(spark.createDataFrame(places * 60, "lon double, lat double, score double"), zones, limit=0.35).collect()
    assert len(got) == 61 and seen[0].count() == len(places)
    values = sorted(s for _, _, s in places for _ in range(60) if s is not None)
    at = 0.95 * (len(values) - 1)
    p95 = values[int(at)] + (values[math.ceil(at)] - values[int(at)]) * (at - int(at))
    for r in got:
        if r.zone_id == 60:
            assert r.n == 0 and r.score_mean is None
        else:
            assert r.n == len(places) * 60 and abs(r.score_p95 - p95) < 1e-9 and abs(r.score_sum - sum(values)) < 1e-6
            assert abs(r.score_mean - sum(values) / len(values)) < 1e-9 and abs(r.share_above - sum(v > 0.35 for v in values) / len(values)) < 1e-9 and r.score_max == 0.8


def test_small_shapes_are_not_broadcast(spark, tmp_path):
    """Cells and pieces that come of a small table of shapes may be many: by no estimate of sizes does a join bring them to the driver."""
    draw = random.Random(7)
    corners = lambda: [(-74 + draw.uniform(-0.02, 0.02), 40.7 + draw.uniform(-0.02, 0.02)) for _ in range(3)]
    rings = [[[*c, c[0]]] for c in (corners() for _ in range(8))]
    spots = [(k, -74 + draw.uniform(-0.02, 0.02), 40.7 + draw.uniform(-0.02, 0.02)) for k in range(200)]

    def stored(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    zones = stored("zones", list(enumerate(rings)), "zone_id long, " + RINGS)
    points = stored("points", spots, "id long, lon double, lat double")
    segments = stored("segments", [(*r[0][0], *r[0][1]) for r in rings], "x1 double, y1 double, x2 double, y2 double")
    cells = GRID.with_cell(points).select("cell").distinct()
    pixels = stored("pixels", [(i, j, draw.random()) for i in range(9) for j in range(9)], "row int, col int, value double")
    for x in (raster.d8_accumulation(pixels), shapes.point_zones(points, zones), nearest.nearest_distance(points, segments, "id"), overlay.coverage(cells, zones, 9), overlay.coverage(cells, zones, 9, 2)):
        assert x.count() > 0 and len(x.collect()) == x.count()
        assert "BroadcastHashJoin" not in x._jdf.queryExecution().executedPlan().toString()


def test_equal_points_and_zones_are_compared_once(spark):
    """Forty points at each place and thirty zones of each kind give all their pairs, from one comparison of each place and kind."""
    rings = [[box(-74.01, 40.69, -73.99, 40.71)], [box(-74.0, 40.7, -73.98, 40.72)]]
    zones = spark.createDataFrame([(k, rings[k % 2]) for k in range(60)] + [(60, None)], "zone_id long, " + RINGS)
    places = [(-74.005, 40.695), (-73.995, 40.705), (-73.985, 40.715), (-73.9, 40.7), (None, 40.7)]
    points = spark.createDataFrame([(k, *places[k % 5], None if k % 3 else "a") for k in range(200)], "id long, lon double, lat double, note string")
    got = shapes.point_zones(points, zones, most=7)
    assert got.columns == ["id", "lon", "lat", "note", "zone_id"]
    rows = got.collect()
    want = [(k, z) for k in range(200) for z in range(60) if k % 5 < 3 and even_odd(rings[z % 2], *places[k % 5])]
    assert sorted((r.id, r.zone_id) for r in rows) == sorted(want) and all((r.lon, r.lat) == places[r.id % 5] and r.note == (None if r.id % 3 else "a") for r in rows)
    lists = shapes.lists_of(points.select("lon", "lat", "id"), ["lon", "lat"], "of", 7).where("lon is not null").select(F.size("of").alias("n")).collect()
    assert sum(r.n for r in lists) == 160 and max(r.n for r in lists) < 40 and len(lists) < 40


def test_cells_of_few_edges_are_compared_without_a_lambda(spark, polygons):
    """Only cells of more edges walk through a lambda for each place; both ways agree on edges and on the middle line, too."""
    rng = random.Random(11)
    half = lambda: rng.choice([-0.5, -0.25, 0.0, 0.25, 0.5])
    ends = lambda: (lambda a, b: (*a, *(a if rng.random() < 0.2 else b)))((half(), half()), (half(), half()))
    rows = [(half(), half(), rng.random() < 0.5, [ends() for _ in range(rng.randrange(1, shapes.FEW + 1))]) for _ in range(4000)]
    x = spark.createDataFrame(rows, "a double, b double, centre boolean, edges array<struct<a1:double,b1:double,a2:double,b2:double>>")
    x = x.select("*", *shapes.few_edges(F.col("edges")))
    a, b, centre = F.col("a"), F.col("b"), F.col("centre")
    both = x.select(shapes.holds(a, b, centre, F.col("edges")).alias("one"), shapes.holds_few(a, b, centre).alias("few")).groupBy("one", "few").count().collect()
    assert {(r.one, r.few) for r in both} == {(True, True), (False, False)}
    points = spark.createDataFrame([(None if k % 5 == 0 else k, -74 + rng.uniform(-0.03, 0.03), 40.7 + rng.uniform(-0.03, 0.03)) for k in range(300)], "id long, lon double, lat double")
    zones = spark.createDataFrame(list(enumerate(polygons)), "zone_id long, " + RINGS)
    found = shapes.point_zones(points, zones, columns=["id"])
    assert found.columns == ["id", "zone_id"]
    want = [(r.id, k) for r in points.collect() for k, p in enumerate(polygons) if even_odd(p, r.lon, r.lat)]
    in_order = lambda pairs: sorted((-1 if i is None else i, k) for i, k in pairs)
    assert in_order(map(tuple, found.collect())) == in_order(want) and any(i is None for i, _ in want)
    joins = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line and "hx_a" in line]
    assert sorted("lambdafunction" in line for line in joins) == [False, True]
