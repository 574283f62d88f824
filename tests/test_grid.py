import random

from pyspark.sql import functions as F

from hexloom.functions import h3bits
from hexloom.functions.hexgrid import GRID


def test_centre_of_a_cell_is_in_it(spark):
    rng = random.Random(1)
    rows = [(rng.uniform(-74.05, -73.9), rng.uniform(40.6, 40.8)) for _ in range(500)]
    for res in (8, 9):
        x = GRID.with_cell(spark.createDataFrame(rows, "lon double, lat double"), res=res)
        lon, lat = GRID.centre("cell", res)
        x = x.select("cell", F.expr(lon).alias("lon"), F.expr(lat).alias("lat"))
        assert GRID.with_cell(x, res=res, name="again").where("again <> cell").count() == 0


def test_seven_children_and_back(spark):
    cells = GRID.with_cell(spark.createDataFrame([(-74.0, 40.7), (-73.95, 40.75)], "lon double, lat double"), res=7).select("cell")
    kids = GRID.children(cells, 7, 9)
    assert kids.count() == 2 * 49 and kids.select("child").distinct().count() == 98
    assert GRID.with_parent(kids, 9, 7, "child", "up").where("up <> cell").count() == 0
    assert GRID.disk(cells, 2).groupBy("cell").count().select("count").distinct().collect()[0][0] == 19


def test_missing_coordinates_have_no_cell(spark):
    x = GRID.with_cell(spark.createDataFrame([(None, 40.7), (-74.0, None)], "lon double, lat double"))
    assert [r.cell for r in x.collect()] == [None, None]


def test_published_parent(spark):
    x = spark.createDataFrame([("892a1072c03ffff",)], "h string").select(h3bits.from_hex(F.col("h")).alias("c"))
    row = x.select(h3bits.resolution(F.col("c")), h3bits.to_hex(h3bits.parent(F.col("c"), 7)), h3bits.to_hex(h3bits.parent(F.col("c"), 12))).first()
    assert tuple(row) == (9, "872a1072cffffff", "892a1072c03ffff")


def test_pentagons_have_six_children(spark):
    x = spark.createDataFrame([("8009fffffffffff",), ("8001fffffffffff",)], "h string").select(h3bits.from_hex(F.col("h")).alias("c"))
    n = [r[0] for r in x.select(F.size(h3bits.children_once(F.col("c")))).collect()]
    assert n == [6, 7]


def test_cover_holds_all_points_cells_whose_centre_is_inside(spark):
    box = (-74.0, 40.7, -73.98, 40.72)
    cover = {r.cell for r in GRID.cover(spark, box, 10).collect()}
    pts = spark.createDataFrame([(-74.0 + i * 0.0005, 40.7 + j * 0.0005) for i in range(41) for j in range(41)], "lon double, lat double")
    cells = GRID.with_cell(pts, res=10).select("cell").distinct()
    lon, lat = GRID.centre("cell", 10)
    inner = cells.where(F.expr(lon).between(box[0], box[2]) & F.expr(lat).between(box[1], box[3]))
    assert {r.cell for r in inner.collect()} <= cover


def test_conditions_on_computed_cells_do_not_unfold_them(spark):
    x = GRID.with_cell(spark.createDataFrame([(-74.0, 40.7)] * 10, "lon double, lat double"))
    lon, lat = GRID.centre("cell", 9)
    again = GRID.with_cell(x.select("cell", F.expr(lon).alias("lon"), F.expr(lat).alias("lat")), name="again").where("again <> cell")
    up = GRID.with_parent(again, 9, 7).where("parent > 0").join(x.select("cell"), "cell")
    assert len(again._jdf.queryExecution().optimizedPlan().toString()) < 20_000
    assert len(up._jdf.queryExecution().optimizedPlan().toString()) < 20_000 and up.count() == 0
