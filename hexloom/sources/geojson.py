"""GeoJSON in and out."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.hexgrid import GRID, HexGrid
from ..functions.storage import cut

_PAIR = "array<double>"


def _points(a: Column) -> Column:
    return F.transform(a, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))


def rings_of(kind: Column, coordinates: Column) -> Column:
    """The vertices of a geometry, given its coordinates as JSON text, as an array of parts."""
    read = lambda depth: F.from_json(coordinates, "array<" * depth + _PAIR + ">" * depth)
    return (
        F.when(kind == "Point", F.array(_points(F.array(F.from_json(coordinates, _PAIR)))))
        .when(kind.isin("MultiPoint", "LineString"), F.array(_points(read(1))))
        .when(kind.isin("MultiLineString", "Polygon"), F.transform(read(2), _points))
        .when(kind == "MultiPolygon", F.transform(F.flatten(read(3)), _points))
    )


def parse(text: DataFrame, column: str = "value") -> DataFrame:
    """feature_id, geom_type, rings, props from JSON texts: collections, features, collections of geometries, or bare ones.

    Null and empty geometries drop out; the id is a hash of the text, of its file if it has a column of that name, and of
    the feature's place in it.
    """
    source = [F.col("file")] if "file" in text.columns else []
    doc = F.from_json(column, f"type string, features array<string>, geometry string, geometries array<string>, coordinates string, crs string, properties map<string,string>")
    x = text.select(F.col(column), F.xxhash64(column, *source).alias("file"), doc.alias("d"))
    listed = F.when(F.col("d.type") == "FeatureCollection", F.col("d.features")).otherwise(F.array(F.col(column)))
    return _records(x.select(F.posexplode(listed).alias("pos", "one"), "file"))


def _records(texts: DataFrame) -> DataFrame:
    """Vector records of the texts of single features or geometries: one, at place pos of its file."""
    feature = "type string, geometry string, properties map<string,string>"
    x = texts.select("pos", "file", F.from_json("one", feature).alias("f"), "one")
    bare = F.col("f.type") != "Feature"
    x = x.select("pos", "file", F.when(bare, F.col("one")).otherwise(F.col("f.geometry")).alias("g"), F.when(~bare, F.col("f.properties")).alias("props"))
    geometry = "type string, coordinates string, geometries array<string>"
    x = x.withColumn("h", F.from_json("g", geometry))
    parts = F.when(F.col("h.type") == "GeometryCollection", F.col("h.geometries")).otherwise(F.array(F.col("g")))
    x = x.select("pos", "file", "props", F.posexplode(parts).alias("part", "g")).withColumn("h", F.from_json("g", geometry))
    x = x.withColumn("rings", rings_of(F.col("h.type"), F.col("h.coordinates"))).where("rings is not null").where(F.exists("rings", lambda r: F.size(r) > 0))
    x = x.where(F.exists("rings", lambda r: F.exists(r, lambda p: p["x"].isNotNull() & p["y"].isNotNull())))
    return x.select(F.xxhash64("file", "pos", "part").alias("feature_id"), F.col("h.type").alias("geom_type"), "rings", "props")


#: What stands before an object: anything but braces, and whole strings, in which braces do not count.
_BEFORE = r'^(?:[^"{]|"(?:[^"\\]|\\.)*+")*+'


#: A file, by 128 bits that stand for its path, and a block of it.
_FILE = ["file", "path"]
_BLOCK = [*_FILE, "block"]


def _of_blocks(x: DataFrame, blocks: DataFrame) -> DataFrame:
    """The pieces with what is known of their blocks (columns hx_*)."""
    named = blocks.select(*[F.col(c).alias(f"hx_of_{c}") for c in _BLOCK], *[c for c in blocks.columns if c not in _BLOCK])
    on = [F.col(c) == F.col(f"hx_of_{c}") for c in _BLOCK]
    return x.join(named, on[0] & on[1] & on[2]).drop(*[f"hx_of_{c}" for c in _BLOCK])


def split_features(spark: SparkSession, path: str) -> DataFrame:
    """file, path (two hashes of the file's path), pos, one: the text of each object in the collections of the files, read in
    blocks by as many tasks as there are.

    Text is read in pieces that end at a closing brace; a file's blocks are tasks of their own, and a piece belongs to the
    block in which it starts. Whether a piece starts inside a string, and how many braces are open before it, are running
    sums, within a block and then over the sums of blocks. As a block does not know whether it starts inside a string, its
    braces are summed for both cases, so that one pass over its pieces is enough, and they are written once. An object of the
    collection ends where one brace is left open; its pieces are brought together by the number of such ends before them, so
    it may lie across blocks.
    """
    pieces = spark.read.option("lineSep", "}").text(path)
    at = F.col("_metadata.file_path")
    x = pieces.select("value", F.xxhash64(at).alias("file"), F.xxhash64(F.lit(977), at).alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    bare = F.regexp_replace("value", r"\\.", "")  # escaped characters neither end a string nor open a brace
    count = lambda text, c: F.char_length(text) - F.char_length(F.replace(text, F.lit(c), F.lit("")))
    even = F.array_join(F.filter(F.split("bare", '"'), lambda t, i: i % 2 == 0), "")
    x = x.withColumn("bare", bare).select("value", *_BLOCK, "n", count(F.col("bare"), '"').alias("quotes"), count(F.col("bare"), "{").alias("braces"), count(even, "{").alias("even"))
    within = Window.partitionBy(*_BLOCK).orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(within), F.lit(0))
    x = x.withColumn("odd", before("quotes") % 2 == 1)
    # outside strings are the even parts of a piece that starts outside one, and the odd parts of another
    opens = [F.when(F.col("odd") == odd, F.col("even")).otherwise(F.col("braces") - F.col("even")) for odd in (False, True)]
    last = F.col("odd") == (F.col("quotes") % 2 == 1)
    closes = [last.cast("int"), (~last).cast("int")]
    x = x.select("value", *_BLOCK, "n", "quotes", *[c.alias(f"closes{k}") for k, c in enumerate(closes)], *[(o - c).alias(f"turn{k}") for k, (o, c) in enumerate(zip(opens, closes, strict=True))])
    x = cut(x.select("*", *[before(f"turn{k}").alias(f"depth{k}") for k in (0, 1)]))

    earlier = Window.partitionBy(*_FILE).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    blocks = x.groupBy(*_BLOCK).agg(*[F.sum(c).alias(c) for c in ("quotes", "turn0", "turn1")]).withColumn("hx_odd", sums("quotes") % 2 == 1)
    case = lambda c: F.when(F.col("hx_odd"), F.col(f"{c}1")).otherwise(F.col(f"{c}0"))
    blocks = blocks.withColumn("turn", case("turn")).select(*_BLOCK, "hx_odd", sums("turn").alias("hx_depth"))
    x = _of_blocks(x, blocks).select("value", *_BLOCK, "n", (case("depth") + F.col("hx_depth")).alias("depth"), case("turn").alias("turn"), case("closes").alias("closes"))
    x = x.select("value", *_BLOCK, "n", "depth", ((F.col("closes") == 1) & (F.col("depth") + F.col("turn") == 1)).cast("long").alias("ends"))

    blocks = x.groupBy(*_BLOCK).agg(F.sum("ends").alias("ends")).select(*_BLOCK, sums("ends").alias("hx_ends"))
    x = _of_blocks(x.withColumn("pos", before("ends")), blocks).withColumn("pos", F.col("pos") + F.col("hx_ends"))
    one = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "n", "value"))), lambda p: F.concat(p["value"], F.lit("}"))), "")
    x = x.groupBy(*_FILE, "pos").agg(one.alias("one"), F.min(F.struct("block", "n", "depth"))["depth"].alias("depth"), F.max("ends").alias("ends")).where("ends = 1")
    # the first object of a file stands behind the brace of the collection itself
    inner = F.when(F.col("depth") == 0, F.regexp_replace("one", _BEFORE + r"\{", "")).otherwise(F.col("one"))
    return x.select(*_FILE, "pos", F.regexp_replace(inner, _BEFORE, "").alias("one"))


def read_large_geojson(spark: SparkSession, path: str) -> DataFrame:
    """``read_geojson`` of files that hold one large FeatureCollection each: a file is read by many tasks, and no text is longer
    than a feature. Members of the collection that are no features are left out. Ids come from the file's name and the
    feature's place; without files of other kinds the records are those of ``read_geojson``."""
    x = split_features(spark, path).where(F.get_json_object("one", "$.type") == "Feature")
    return _records(x.select("pos", "file", "one"))


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Files of GeoJSON in longitude and latitude; a warning if one names another reference system. A file is one text, in one
    task; ``read_large_geojson`` is for files that are too large for that."""
    text = spark.read.text(path, wholetext=True)
    foreign = text.where(F.col("value").rlike(r'"crs"\s*:') & ~F.col("value").rlike(r"CRS84|4326")).limit(1).count()
    if foreign:
        warnings.warn(f"{path} names a reference system other than longitude and latitude; coordinates are read as they are", stacklevel=2)
    return parse(text.withColumn("file", F.input_file_name()))


def sensor_points(features: DataFrame, default_source: str = "sensor") -> DataFrame:
    """lon, lat and source of point features: the first point of several; the default source where none is given."""
    p = F.col("rings")[0][0]
    x = features.where(F.col("geom_type").isin("Point", "MultiPoint"))
    return x.select("feature_id", p["x"].alias("lon"), p["y"].alias("lat"), F.coalesce(F.col("props")["source"], F.lit(default_source)).alias("source"))


def feature_text(geometry: Column, properties: Column) -> Column:
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties")), {"ignoreNullFields": "false"})


def cells_text(cells: DataFrame, value: str, res: int, grid: HexGrid = GRID, fallback: str = "flood_risk") -> DataFrame:
    """One feature text for each cell: its boundary, and value, class and probability (0 where null).

    The fallback column is used where the value column does not exist.
    """
    value = value if value in cells.columns else fallback
    ring = F.transform(grid.boundary(F.col("cell"), res), lambda p: F.array(p["x"], p["y"]))
    number = lambda c, kind: F.coalesce(F.col(c).cast(kind), F.lit(0).cast(kind)) if c in cells.columns else F.lit(0).cast(kind)
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    properties = F.struct(F.lower(F.hex("cell")).alias("cell"), number(value, "double").alias(value), number("predicted_class", "int").alias("predicted_class"), number("flood_probability", "double").alias("flood_probability"))
    return cells.select(feature_text(geometry, properties).alias("value"))


def features_text(features: DataFrame) -> DataFrame:
    """One feature text for each vector record."""
    pairs = F.transform("rings", lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"])))
    kind = F.col("geom_type")
    as_text = (
        F.when(kind == "Point", F.to_json(pairs[0][0]))
        .when(kind.isin("MultiPoint", "LineString"), F.to_json(pairs[0]))
        .when(kind == "MultiPolygon", F.to_json(F.transform(pairs, lambda r: F.array(r))))
        .otherwise(F.to_json(pairs))
    )
    geometry = F.concat(F.lit('{"type":"'), kind, F.lit('","coordinates":'), as_text, F.lit("}"))
    return features.select(F.concat(F.lit('{"type":"Feature","geometry":'), geometry, F.lit(',"properties":'), F.coalesce(F.to_json("props"), F.lit("{}")), F.lit("}")).alias("value"))


def write_geojson(texts: DataFrame, path: str, single: bool = False) -> None:
    """One feature a line in as many files as there are tasks; with ``single`` one collection in one file, for few features."""
    if not single:
        texts.write.mode("overwrite").text(path)
        return
    whole = texts.agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.collect_list("value"), ","), F.lit("]}")).alias("value"))
    whole.write.mode("overwrite").text(path)
