"""Coverage of cells by polygons, geometry to cells, and clipping to boxes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hexgrid import GRID, HALF, M_PER_LAT, HexGrid, children_of, i_of, j_of, pack
from ..functions.storage import by_sorting
from .shapes import centre_cells, centroids, covered_fraction, edge_centres, edges, shape_edges

Box = tuple[float, float, float, float]


def box_rings(df: DataFrame, west: str, south: str, east: str, north: str) -> DataFrame:
    """df with rings: one closed ring for each box."""
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ring = F.array(corner(west, south), corner(east, south), corner(east, north), corner(west, north), corner(west, south))
    return df.withColumn("rings", F.array(ring))


def inside(x: Column, y: Column, edge_list: Column) -> Column:
    """Even-odd rule: a ray to the east crosses an odd number of edges, holes included."""

    def crosses(e):
        spans = (e["y1"] > y) != (e["y2"] > y)
        return spans & (x < e["x1"] + (y - e["y1"]) * (e["x2"] - e["x1"]) / F.when(spans, e["y2"] - e["y1"]))

    return F.size(F.filter(edge_list, lambda e: F.coalesce(crosses(e), F.lit(False)))) % 2 == 1


def window_cells(df: DataFrame, west: Column, south: Column, east: Column, north: Column, res: int, grid: HexGrid = GRID, name: str = "cell") -> DataFrame:
    """A row for each cell that can touch the box of each row."""
    c, s, space = math.cos(grid.turn(res)), math.sin(grid.turn(res)), grid.spacing(res)
    i, j = [], []
    for lon in (west, east):
        for lat in (south, north):
            x, y = (lon - grid.lon0) * grid.kx, (lat - grid.lat0) * M_PER_LAT
            b = (y * c - x * s) / (space * math.sqrt(3) / 2)
            i.append((x * c + y * s) / space + b / 2)
            j.append(b)
    span = lambda v: F.sequence((F.floor(F.least(*v)) - 1).cast("bigint"), (F.ceil(F.greatest(*v)) + 1).cast("bigint"))
    x = df.withColumn("hx_i", F.explode(span(i))).withColumn("hx_j", F.explode(span(j)))
    packed = F.lit(res << 56) + F.call_function("shiftleft", F.col("hx_i") + HALF, F.lit(28)) + (F.col("hx_j") + HALF)
    return x.withColumn(name, packed).drop("hx_i", "hx_j")


def ring_box(rings: Column) -> tuple[Column, Column, Column, Column]:
    xs = F.flatten(F.transform(rings, lambda r: F.transform(r, lambda p: p["x"])))
    ys = F.flatten(F.transform(rings, lambda r: F.transform(r, lambda p: p["y"])))
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


def _level_with(ry: float):
    """Whether an edge comes within ry of the latitude lat."""
    return lambda e: (F.least(e["y1"], e["y2"]) <= F.col("lat") + ry) & (F.greatest(e["y1"], e["y2"]) >= F.col("lat") - ry)


def _close(rx: float, ry: float):
    """Whether the box of an edge comes within rx and ry of the place (lon, lat)."""
    level = _level_with(ry)
    return lambda e: level(e) & (F.least(e["x1"], e["x2"]) <= F.col("lon") + rx) & (F.greatest(e["x1"], e["x2"]) >= F.col("lon") - rx)


def coverage(spine: DataFrame, polygons: DataFrame, res: int = 9, depth: int | None = None, grid: HexGrid = GRID, name: str = "area_frac") -> DataFrame:
    """The fraction of each cell of the spine that the polygons (rings) cover, overlaps counted once.

    Exact (``shapes.covered_fraction``) unless a depth is given. With one, the share of the cell's 7**depth descendants
    whose centre a polygon holds, a centre on a western or southern edge included and one on an eastern or northern edge
    not; as descendants cover not quite the same ground as their cell, that is an estimate.

    The centres of the 7**depth descendants sample a cell. Polygons meet cells by an equi-join on the cells that their
    bounding box can touch, ids alone. A cell is then parted level by level: a part that no edge of a polygon comes near
    is all inside it or all outside, as its centre says, so only parts along edges are parted on. A sample counts once
    however many polygons hold it. Cells without any get 0.
    """
    if depth is None:
        return covered_fraction(spine, polygons, res, grid, name)
    shapes = polygons.select(edges(F.col("rings")).alias("edges"), *[c.alias(n) for c, n in zip(ring_box(F.col("rings")), "wsen", strict=True)]).where("w is not null")
    shapes = shapes.withColumn("shape", F.xxhash64("edges"))
    near = window_cells(shapes.select("shape", *"wsen"), *[F.col(c) for c in "wsen"], res, grid).select("cell", "shape").distinct()
    near = near.join(by_sorting(spine.select("cell").distinct()), "cell", "left_semi")
    x = near.join(by_sorting(shapes.select("shape", "edges").dropDuplicates(["shape"])), "shape").groupBy("cell").agg(F.collect_list("edges").alias("shapes"))
    x = x.withColumns({"part": F.col("cell"), "held": F.lit(None).cast("long")})
    none = F.expr("cast(array() as array<array<struct<x1:double,y1:double,x2:double,y2:double>>>)")
    for level in range(res, res + depth + 1):
        lon, lat = (F.expr(e) for e in grid.centre("part", level))
        x = x.withColumns({"lon": lon, "lat": lat})
        if level == res + depth:
            in_any = F.exists("shapes", lambda e: inside(F.col("lon"), F.col("lat"), e))
            x = x.select("cell", F.coalesce("held", in_any.cast("long")).alias("held"))
            break
        # samples of a part lie within the steps from level to level of its centre
        reach = sum(grid.spacing(r) for r in range(level + 1, res + depth + 1)) * (1 + 1e-9)
        close, level_with = _close(reach / grid.kx, reach / M_PER_LAT), _level_with(reach / M_PER_LAT)
        along = F.filter("shapes", lambda s: F.exists(s, close))
        whole = F.exists("shapes", lambda s: ~F.exists(s, close) & inside(F.col("lon"), F.col("lat"), s))
        # of a shape that goes on, the edges that a ray from any sample can cross
        x = x.select("cell", "part", "held", whole.alias("whole"), F.transform(along, lambda s: F.filter(s, level_with)).alias("shapes"))
        done = F.when(F.col("whole"), 7 ** (res + depth - level)).when(F.size("shapes") == 0, 0).cast("long")
        x = x.select("cell", "part", F.coalesce("held", done).alias("held"), "shapes")
        seven = F.array(*[F.expr(pack(level + 1, a, b)) for a, b in children_of(i_of("part"), j_of("part"), level + 1)])
        parts = F.when(F.col("held").isNull(), seven).otherwise(F.array("part"))
        x = x.select("cell", "held", F.when(F.col("held").isNull(), F.col("shapes")).otherwise(none).alias("shapes"), F.explode(parts).alias("part"))
    share = x.groupBy("cell").agg((F.sum("held") / float(7**depth)).alias(name))
    return spine.select("cell").join(by_sorting(share), "cell", "left").fillna(0.0, [name])


def coastal_overlay(cells: DataFrame, polygons: DataFrame, res: int = 9, prefix: str = "sandy", depth: int | None = None, grid: HexGrid = GRID) -> DataFrame:
    """<prefix>_area_frac and <prefix>_class beside the labels, which stay as they are."""
    share = coverage(cells, polygons, res, depth, grid, f"{prefix}_area_frac")
    return cells.drop(f"{prefix}_area_frac", f"{prefix}_class").join(by_sorting(share), "cell", "left").withColumn(f"{prefix}_class", (F.col(f"{prefix}_area_frac") >= 1e-9).cast("int"))


def _on_edge(x: Column, y: Column, edge_list: Column) -> Column:
    def on(e):
        level = (F.least(e["x1"], e["x2"]) <= x) & (x <= F.greatest(e["x1"], e["x2"])) & (F.least(e["y1"], e["y2"]) <= y) & (y <= F.greatest(e["y1"], e["y2"]))
        return level & ((e["x2"] - e["x1"]) * (y - e["y1"]) == (e["y2"] - e["y1"]) * (x - e["x1"]))

    return F.exists(edge_list, on)


def geometry_cells(features: DataFrame, res: int = 9, step: float = 0.00015, buffer_k: int = 0, samples: int = 12, grid: HexGrid = GRID) -> DataFrame:
    """feature_id, cell: cells of points, of lines sampled every ``step`` degrees, and of polygons by centre.

    The cells whose centre a polygon holds come from scan lines over its edges (``shapes.centre_cells``); a centre on an
    edge, in degrees, counts as held, as a sample does. A polygon that holds no centre gives the cell of its centroid, and those of the samples of its bounding box, ``samples`` a side, that
    it holds or that lie on its edges. With buffer_k, neighbours as well. The id must be the feature's own.
    """
    parts = features.select("feature_id", "geom_type", "rings", F.explode("rings").alias("part"))
    points = parts.where(F.col("geom_type").isin("Point", "MultiPoint")).select("feature_id", F.explode("part").alias("p"))
    line = parts.where(F.col("geom_type").isin("LineString", "MultiLineString")).select("feature_id", F.explode(edges(F.array("part"))).alias("e"))
    n = F.greatest(F.ceil(F.sqrt(F.pow(F.col("e.x2") - F.col("e.x1"), 2) + F.pow(F.col("e.y2") - F.col("e.y1"), 2)) / step), F.lit(1))
    at = F.transform(F.sequence(F.lit(0), n.cast("int")), lambda k: F.struct((F.col("e.x1") + (F.col("e.x2") - F.col("e.x1")) * k / n).alias("x"), (F.col("e.y1") + (F.col("e.y2") - F.col("e.y1")) * k / n).alias("y")))
    points = points.union(line.select("feature_id", F.explode(at).alias("p")))
    out = grid.with_cell(points.select("feature_id", F.col("p.x").alias("lon"), F.col("p.y").alias("lat")), res=res).select("feature_id", "cell")
    polygons = features.where(F.col("geom_type").isin("Polygon", "MultiPolygon")).select("feature_id", "rings")
    sides = shape_edges(polygons, res, grid, "feature_id")
    held = centre_cells(sides, res, "feature_id").union(edge_centres(sides, res, grid, "feature_id"))
    small = polygons.join(by_sorting(held.select("feature_id").distinct()), "feature_id", "left_anti")
    middle = centroids(small).select("feature_id", "lon", "lat")
    few = small.select("feature_id", edges(F.col("rings")).alias("edges"), *[c.alias(k) for c, k in zip(ring_box(F.col("rings")), "wsen", strict=True)])
    # no sample is rounded out of the box: one beyond its edges would be neither held nor on them
    spread = lambda low, high: F.explode(F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda k: F.when(k == samples - 1, F.col(high)).otherwise(F.least(F.col(low) + (F.col(high) - F.col(low)) * k / (samples - 1), F.col(high)))))
    few = few.withColumn("lon", spread("w", "e")).withColumn("lat", spread("s", "n"))
    few = few.where(inside(F.col("lon"), F.col("lat"), F.col("edges")) | _on_edge(F.col("lon"), F.col("lat"), F.col("edges"))).select("feature_id", "lon", "lat")
    out = out.union(held).union(grid.with_cell(middle.union(few), res=res).select("feature_id", "cell")).where("cell is not null").distinct()
    if not buffer_k:
        return out
    return grid.disk(out, buffer_k).select("feature_id", F.col("near").alias("cell")).distinct()


def meets_box(df: DataFrame, box: Box, pad: float = 0.002) -> DataFrame:
    """Features whose bounding box meets the padded box."""
    w, s, e, n = ring_box(F.col("rings"))
    return df.where((w <= box[2] + pad) & (e >= box[0] - pad) & (s <= box[3] + pad) & (n >= box[1] - pad))


def _one_side(axis: str, bound: float, sign: int):
    """From a ring (not closed) its corners on one side of a line, and those where it crosses the line."""
    other = "y" if axis == "x" else "x"
    kept = lambda p: p[axis] * sign <= bound * sign

    def meets(p: Column, q: Column) -> Column:
        along = p[other] + (q[other] - p[other]) * ((F.lit(bound) - p[axis]) / (q[axis] - p[axis]))
        return F.struct(*[(F.lit(bound) if c == axis else along).alias(c) for c in "xy"])

    none = F.expr("cast(array() as array<struct<x:double,y:double>>)")
    step = lambda p, q: F.when(kept(q), F.when(kept(p), F.array(q)).otherwise(F.array(meets(p, q), q))).when(kept(p), F.array(meets(p, q))).otherwise(none)

    def cut(ring: Column) -> Column:
        before = F.concat(F.slice(ring, F.size(ring), 1), F.slice(ring, F.lit(1), F.size(ring) - 1))
        return F.when(F.size(ring) > 0, F.flatten(F.zip_with(before, ring, step))).otherwise(none)

    return cut


def _bound(x: Column, f) -> Column:
    """f(x) with x computed once, however often f names it."""
    return F.transform(F.array(x), f)[0]


def ring_area(ring: Column) -> Column:
    """Twice the signed area of a closed ring, from its first corner, so that a ring without area has exactly none."""
    turn = lambda e: (e["x1"] - ring[0]["x"]) * (e["y2"] - ring[0]["y"]) - (e["x2"] - ring[0]["x"]) * (e["y1"] - ring[0]["y"])
    return F.aggregate(edges(F.array(ring)), F.lit(0.0), lambda s, e: s + turn(e))


def clip_rings(features: DataFrame, box: Box, pad: float = 0.002) -> DataFrame:
    """Polygons (rings) cut to the padded box, each ring by the box's four sides in turn; holes stay holes.

    Rings without area inside drop out, and features of which no ring is left. Other columns stay. A ring that leaves the
    box and comes back is one ring still, with its way along the side there and back; its area is right. Rings that are
    not closed are closed; corners without coordinates are left out, and a null or empty list of rings drops out.
    """
    sides = (("x", box[0] - pad, -1), ("x", box[2] + pad, 1), ("y", box[1] - pad, -1), ("y", box[3] + pad, 1))

    def one(ring: Column) -> Column:
        there = F.filter(ring, lambda p: p["x"].isNotNull() & p["y"].isNotNull())
        x = _bound(there, lambda r: F.when((F.size(r) > 1) & (F.element_at(r, 1) == F.element_at(r, -1)), F.slice(r, F.lit(1), F.size(r) - 1)).otherwise(r))
        for side in sides:
            x = _bound(x, _one_side(*side))
        return _bound(x, lambda r: F.when(F.size(r) > 2, F.concat(r, F.slice(r, 1, 1))))

    cut = F.filter(F.transform("rings", one), lambda r: r.isNotNull())
    x = features.withColumn("hx_rings", F.filter(cut, lambda r: ring_area(r) != 0))
    return x.where(F.size("hx_rings") > 0).withColumn("rings", F.col("hx_rings")).drop("hx_rings")


def clip_segments(segments: DataFrame, box: Box, pad: float = 0.002) -> DataFrame:
    """Segments (x1, y1, x2, y2) cut to the padded box by their entry and exit parameters; those outside drop out."""
    west, south, east, north = box[0] - pad, box[1] - pad, box[2] + pad, box[3] + pad
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    enter, leave, miss = [F.lit(0.0)], [F.lit(1.0)], F.lit(False)
    for p, q in ((-dx, F.col("x1") - west), (dx, F.lit(east) - F.col("x1")), (-dy, F.col("y1") - south), (dy, F.lit(north) - F.col("y1"))):
        enter.append(F.when(p < 0, q / p))
        leave.append(F.when(p > 0, q / p))
        miss = miss | ((p == 0) & (q < 0))
    x = segments.withColumns({"hx_a": F.greatest(*enter), "hx_b": F.least(*leave), "hx_miss": miss}).where("not hx_miss and hx_a <= hx_b")
    ends = {f"{c}{k}": F.col(f"{c}1") + (F.col(f"{c}2") - F.col(f"{c}1")) * F.col(t) for c in "xy" for k, t in ((1, "hx_a"), (2, "hx_b"))}
    return x.withColumns(ends).drop("hx_a", "hx_b", "hx_miss")


def profile_filter(points: DataFrame, profiles: DataFrame, few: int = 1000, res: int = 9, most_steps: int = 16, grid: HexGrid = GRID) -> DataFrame:
    """A row for each point and each named extent (name, west, south, east, north) that holds it.

    Up to ``few`` extents are broadcast. More are listed under the cells that they can touch, and points meet them by
    their cell; those wider than ``most_steps`` cells, or off the globe, are compared with all points.
    """
    inside_box = (F.col("lon").between(F.col("west"), F.col("east"))) & (F.col("lat").between(F.col("south"), F.col("north")))
    if profiles.limit(few + 1).count() <= few:
        return points.join(F.broadcast(profiles), inside_box).drop("west", "south", "east", "north")
    step = most_steps * grid.spacing(res)
    narrow = ((F.col("east") - F.col("west")) * grid.kx <= step) & ((F.col("north") - F.col("south")) * M_PER_LAT <= step)
    on_globe = (F.col("west") >= -360) & (F.col("east") <= 360) & (F.col("south") >= -90) & (F.col("north") <= 90)
    x = profiles.where("west <= east and south <= north").withColumn("hx_narrow", narrow & on_globe)
    near = window_cells(x.where("hx_narrow").drop("hx_narrow"), *[F.col(c) for c in ("west", "south", "east", "north")], res, grid, "hx_at")
    by_cell = grid.with_cell(points, res=res, name="hx_at").join(near, "hx_at").where(inside_box).drop("hx_at")
    whole = points.join(x.where("not hx_narrow").drop("hx_narrow"), inside_box)
    return by_cell.unionByName(whole).drop("west", "south", "east", "north")
