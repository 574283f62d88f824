import json

from pyspark.sql import functions as F

from hexloom.sources import geojson, tables


def test_geojson_of_every_kind(spark, tmp_path):
    shapes = [
        {"type": "Point", "coordinates": [1, 2]},
        {"type": "MultiPoint", "coordinates": [[1, 2], [3, 4]]},
        {"type": "LineString", "coordinates": [[0, 0], [1, 1]]},
        {"type": "MultiLineString", "coordinates": [[[0, 0], [1, 1]], [[2, 2], [3, 3]]]},
        {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]], [[0.1, 0.1], [0.2, 0.1], [0.2, 0.2], [0.1, 0.1]]]},
        {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1], [0, 0]]], [[[5, 5], [6, 5], [6, 6], [5, 5]]]]},
        {"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [9, 9]}]},
        None,
        {"type": "Polygon", "coordinates": []},
    ]
    features = [{"type": "Feature", "geometry": g, "properties": {"k": str(i)}} for i, g in enumerate(shapes)]
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=1))
    got = {r.props["k"]: (r.geom_type, len(r.rings)) for r in geojson.read_geojson(spark, str(tmp_path / "a.geojson")).collect()}
    assert got == {"0": ("Point", 1), "1": ("MultiPoint", 1), "2": ("LineString", 1), "3": ("MultiLineString", 2), "4": ("Polygon", 2), "5": ("MultiPolygon", 2), "6": ("Point", 1)}
    (tmp_path / "b.geojson").write_text(json.dumps(shapes[2]))
    back = geojson.read_geojson(spark, str(tmp_path / "b.geojson"))
    assert back.first().geom_type == "LineString"
    again = geojson.parse(geojson.features_text(geojson.read_geojson(spark, str(tmp_path / "a.geojson"))))
    assert again.count() == 7
    geojson.write_geojson(geojson.features_text(back), str(tmp_path / "out"), single=True)
    assert geojson.read_geojson(spark, str(tmp_path / "out")).count() == 1
    geojson.write_geojson(geojson.features_text(again), str(tmp_path / "lines"))
    assert geojson.parse(spark.read.text(str(tmp_path / "lines"))).count() == 7
    (tmp_path / "c.geojson").write_text(json.dumps(shapes[2]))
    two = geojson.read_geojson(spark, str(tmp_path / "[bc].geojson"))
    assert two.count() == 2 and two.select("feature_id").distinct().count() == 2  # equal files are two
    assert [r.source for r in geojson.sensor_points(back.union(geojson.read_geojson(spark, str(tmp_path / "a.geojson")))).collect()] == ["sensor"] * 3


def test_cited_csv_and_loose_headers(spark, tmp_path):
    (tmp_path / "c.csv").write_text("# cited as\n# someone, 2020\nid,Latitude,LONGITUDE\n1,40.5,-74\n2,x,-74\n")
    got = tables.read_cited_csv(spark, str(tmp_path / "c.csv")).select("lon", "lat", "id").collect()
    assert [tuple(r) for r in got] == [(-74.0, 40.5, "1")]
    x = spark.createDataFrame([("bad", "1.5", "2"), (None, None, "3")], "lon string, X string, lat string")
    assert [tuple(r) for r in tables.points_of(x).select("lon", "lat").collect()] == [(1.5, 2.0)]


def test_tables_round_trip(spark, tmp_path):
    x = spark.createDataFrame([(1, 9, 0.5), (2, 10, float("nan"))], "cell long, cell_res int, v double")
    tables.write_cells(x, str(tmp_path / "cells"))
    assert tables.read_cells(spark, str(tmp_path / "cells"), "v").count() == 2
    tables.write_metrics(x, str(tmp_path / "m"), "json")
    assert spark.read.json(str(tmp_path / "m")).where(F.col("v").isNull()).count() == 1
    both = tables.union_layers({"a": x.select("cell"), "b": x.select("v")})
    assert both.count() == 4 and set(both.columns) == {"cell", "v", "source"}


def test_one_collection_in_many_blocks(spark, tmp_path):
    """The features of a file that is read by many tasks are those of the file read whole, whatever its strings hold."""
    import json
    import random

    from hexloom.sources import geojson

    rng = random.Random(2)
    notes = ["plain", "a } b", 'quote " and { brace', "back \\ slash", 'ends with \\"', "{}}{", "", "é 字", "x" * 900, None]
    shape = lambda k: rng.choice([{"type": "Point", "coordinates": [k * 0.5, 1.25]}, {"type": "LineString", "coordinates": [[0, k], [1.5, 2]]}, {"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [1, 2]}, {"type": "MultiPoint", "coordinates": [[3, 4], [5, 6]]}]}, None])
    features = [{"type": "Feature", "id": k, "properties": {"k": str(k), "note": rng.choice(notes)}, "geometry": shape(k)} for k in range(400)]
    whole = {"type": "FeatureCollection", "name": 'with { brace, \\ and " quote', "crs": {"type": "name", "properties": {"name": "CRS84"}}, "features": features, "after": {"a": 1}}
    texts = {"compact": json.dumps(whole, separators=(",", ":")), "pretty": json.dumps(whole, indent=2, ensure_ascii=False) + "\n\n", "none": json.dumps({"type": "FeatureCollection", "features": []})}
    rows = lambda x: sorted((r.geom_type, str(r.rings), str(sorted(r.props.items(), key=str))) for r in x.collect())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for name, text in texts.items():
        (tmp_path / f"{name}.geojson").write_text(text)
        want = rows(geojson.read_geojson(spark, f"{tmp_path}/{name}.geojson"))
        for size in (str(1 << 20), "3000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            found = geojson.read_large_geojson(spark, f"{tmp_path}/{name}.geojson")
            assert rows(found) == want and found.select("feature_id").distinct().count() == len(want)
            if size == "3000" and name != "none":
                assert spark.read.option("lineSep", "}").text(f"{tmp_path}/{name}.geojson").rdd.getNumPartitions() > 10 and len(want) > 300
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    one = rows(geojson.read_geojson(spark, f"{tmp_path}/compact.geojson"))
    assert rows(geojson.read_large_geojson(spark, f"{tmp_path}/*.geojson")) == sorted(one + one)  # files don't mix
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_pieces_of_large_collections_are_written_once_and_without_paths(spark, tmp_path, monkeypatch):
    feature = '{"type":"Feature","geometry":{"type":"Point","coordinates":[1.0,2.0]},"properties":{"note":"a } \\" {"}}'
    (tmp_path / "one.geojson").write_text('{"type":"FeatureCollection","features":[' + ",".join([feature] * 50) + "]}")
    written = []
    monkeypatch.setattr(geojson, "cut", lambda x: written.append(x.dtypes) or x)
    assert geojson.read_large_geojson(spark, f"{tmp_path}/one.geojson").count() == 50
    assert [[c for c, kind in columns if kind == "string"] for columns in written] == [["value"]]
