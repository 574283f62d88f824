"""Polygons on the grid by their edges: an index of edges by cell, cells by scan lines, exact covered areas, zones of points.

Everything happens in the plane of the lattice: u in spacings along a row, v in rows, so that cell (i, j) has its centre
at (i - j / 2, j), the area 1, and the half width min(1/2, 1 - 3/2 |v|) at height v over its centre. A polygon is the
even-odd interior of all rings of its row; it is known by a key, and no table here but the first holds a whole one.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hexgrid import GRID, HALF, M_PER_LAT, HexGrid
from ..functions.order import quantile
from ..functions.scalars import clean
from ..functions.storage import by_sorting, cut

#: Half the height of a cell, and what edges are let in beyond it so that rounding leaves none out.
TOP, SLACK = 2 / 3, 1e-9
#: Edges of a zone in a cell that are columns of their own.
FEW = 2


def edges(rings: Column) -> Column:
    """All edges of the rings as an array of (x1, y1, x2, y2)."""
    one = lambda r: F.zip_with(
        F.slice(r, F.lit(1), F.greatest(F.size(r) - 1, F.lit(0))),
        F.slice(r, F.lit(2), F.greatest(F.size(r) - 1, F.lit(0))),
        lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")),
    )
    return F.flatten(F.transform(rings, one))


def centroids(features: DataFrame) -> DataFrame:
    """lon and lat of each vector record: the area's centroid of its rings, holes taken off; the mean of the vertices of
    records without area."""
    x1, y1 = lambda e: e["x1"], lambda e: e["y1"]
    turn = lambda e: e["x1"] * e["y2"] - e["x2"] * e["y1"]
    total = lambda f: F.aggregate("hx_e", F.lit(0.0), lambda s, e: s + f(e))
    # about the first vertex, so that small shapes far from the origin lose no digits
    first = F.col("rings")[0][0]
    x = features.withColumns({"hx_0": first, "hx_r": F.transform("rings", lambda r: F.transform(r, lambda p: F.struct((p["x"] - first["x"]).alias("x"), (p["y"] - first["y"]).alias("y"))))})
    x = x.withColumn("hx_e", edges(F.col("hx_r")))
    area = total(turn)
    cx, cy = total(lambda e: (x1(e) + e["x2"]) * turn(e)) / (area * 3), total(lambda e: (y1(e) + e["y2"]) * turn(e)) / (area * 3)
    flat = F.flatten("hx_r")
    mean = lambda c: F.aggregate(flat, F.lit(0.0), lambda s, p: s + p[c]) / F.size(flat)
    some = F.abs(area) > 0
    x = x.withColumns({"lon": F.col("hx_0.x") + F.when(some, cx).otherwise(mean("x")), "lat": F.col("hx_0.y") + F.when(some, cy).otherwise(mean("y"))})
    return x.drop("hx_0", "hx_r", "hx_e")


def shape_edges(polygons: DataFrame, res: int, grid: HexGrid = GRID, key: str = "shape") -> DataFrame:
    """key, u1, v1, u2, v2, and the same ends in degrees, x1, y1, x2, y2: a row for each edge of each polygon (key, rings).
    Rings that are not closed are closed."""
    ring = F.filter("ring", lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    x = polygons.select(F.col(key), F.explode("rings").alias("ring")).select(key, ring.alias("ring")).where(F.size("ring") > 2)
    pairs = F.zip_with("ring", F.concat(F.slice("ring", F.lit(2), F.size("ring") - 1), F.slice("ring", 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    x = x.select(key, F.explode(pairs).alias("e")).select(key, "e.a", "e.b").where("a.x <> b.x or a.y <> b.y")
    c, s, space = math.cos(grid.turn(res)), math.sin(grid.turn(res)), grid.spacing(res)
    out = []
    for n, p in (("1", "a"), ("2", "b")):
        e, m = (F.col(f"{p}.x") - grid.lon0) * grid.kx, (F.col(f"{p}.y") - grid.lat0) * M_PER_LAT
        out += [((e * c + m * s) / space).alias(f"u{n}"), ((m * c - e * s) / (space * math.sqrt(3) / 2)).alias(f"v{n}")]
    return x.select(key, *out, *[F.col(f"{p}.{c}").alias(f"{c}{n}") for n, p in (("1", "a"), ("2", "b")) for c in "xy"])


def _pack(res: int, i: Column, j: Column) -> Column:
    return F.lit(res << 56) + F.call_function("shiftleft", i + HALF, F.lit(28)) + (j + HALF)


def _whole(x: Column) -> Column:
    return x.cast("bigint")


def _turn(a1: Column, b1: Column, a2: Column, b2: Column) -> Column:
    """On which side of an edge the origin lies: its sign decides both where the edge meets the row's line and where it meets
    the middle line, so the two never contradict each other."""
    return a1 * b2 - a2 * b1


def _local(i: Column, j: Column) -> list[Column]:
    """An edge's ends seen from the centre of cell (i, j)."""
    u, v = i - j / F.lit(2.0), j.cast("double")
    return [F.col("u1") - u, F.col("v1") - v, F.col("u2") - u, F.col("v2") - v]


def centre_runs(edges: DataFrame, key: str = "shape") -> DataFrame:
    """key, j, first, last: the runs of cells in a row whose centres a polygon holds.

    Where an edge crosses a row's line it parts the cells east of it from those west of it; between the first and the
    second crossing, the third and the fourth, and so on, the polygon holds the centres. An edge is sent to the rows that it
    crosses, once each; no cell is looked at. A centre on an edge counts as east of it in the lattice's plane; at turned
    levels the rounding of the turn decides, alike for all polygons that have this edge, so of two neighbours one holds it.
    """
    low, high = F.least("v1", "v2"), F.greatest("v1", "v2")
    # rows with low <= j < high: an edge along a row crosses none, and a corner belongs to one of its edges
    x = edges.where("v1 <> v2").withColumns({"j0": _whole(F.ceil(low)), "j1": _whole(F.ceil(high)) - 1}).where("j0 <= j1")
    x = x.withColumn("j", F.explode(F.sequence("j0", "j1")))
    at = F.col("u1") + (F.col("u2") - F.col("u1")) * ((F.col("j") - F.col("v1")) / (F.col("v2") - F.col("v1")))
    x = x.withColumn("near", _whole(F.ceil(at + F.col("j") / F.lit(2.0))) - 1)

    def crossed(i: Column) -> Column:
        """Whether the edge crosses east of that centre."""
        ends = _local(i, F.col("j"))
        return (_turn(*ends) > 0) == (ends[3] > ends[1])

    # the tie of a centre on the edge is no crossing east of it
    on = lambda i: _turn(*_local(i, F.col("j"))) == 0
    east = lambda i: crossed(i) & ~on(i)
    near = F.col("near")
    x = x.select(key, "j", F.when(east(near + 1), near + 1).when(east(near), near).otherwise(near - 1).alias("last"))
    w = Window.partitionBy(key, "j").orderBy("last")
    x = x.select(key, "j", "last", F.lead("last").over(w).alias("next"), F.row_number().over(w).alias("nth"))
    return x.where("nth % 2 = 1 and next > last").select(key, "j", (F.col("last") + 1).alias("first"), F.col("next").alias("last"))


def centre_cells(edges: DataFrame, res: int, key: str = "shape") -> DataFrame:
    """key, cell: the cells whose centre a polygon holds."""
    x = centre_runs(edges, key).select(key, "j", F.explode(F.sequence("first", "last")).alias("i"))
    return x.select(key, _pack(res, F.col("i"), F.col("j")).alias("cell"))


def edge_cells(edges: DataFrame, res: int, key: str = "shape", more: Sequence[str] = ()) -> DataFrame:
    """key, cell, a1, b1, a2, b2: each edge beside each cell that it may cross, its ends seen from the cell's centre; and the
    columns of ``more``.

    An edge meets the rows that it comes near, and of a row the cells along that part of it, so that a long edge is sent to
    as many cells as lie along it, not to those of its box.
    """
    low, high = F.least("v1", "v2"), F.greatest("v1", "v2")
    x = edges.withColumn("j", F.explode(F.sequence(_whole(F.ceil(low - TOP - SLACK)), _whole(F.floor(high + TOP + SLACK)))))
    flat, rise = F.col("v1") == F.col("v2"), F.col("v2") - F.col("v1")

    def along(edge: float) -> Column:
        """Where the edge enters or leaves the row."""
        t = (F.col("j") + edge - F.col("v1")) / F.when(~flat, rise)
        return F.col("u1") + (F.col("u2") - F.col("u1")) * F.when(flat, float(edge > 0)).when(t < 0, 0.0).when(t > 1, 1.0).otherwise(t)

    x = x.withColumns({"p": along(-TOP - SLACK), "q": along(TOP + SLACK)})
    half = F.col("j") / F.lit(2.0)
    x = x.withColumn("i", F.explode(F.sequence(_whole(F.ceil(F.least("p", "q") + half - 0.5 - SLACK)), _whole(F.floor(F.greatest("p", "q") + half + 0.5 + SLACK)))))
    ends = [e.alias(n) for e, n in zip(_local(F.col("i"), F.col("j")), ("a1", "b1", "a2", "b2"), strict=True)]
    return x.select(key, _pack(res, F.col("i"), F.col("j")).alias("cell"), *ends, *more)


def edge_centres(edges: DataFrame, res: int, grid: HexGrid = GRID, key: str = "shape") -> DataFrame:
    """key, cell: the cells whose centre, in degrees, lies on an edge of the polygon itself.

    In the lattice's plane the rounding of the turn throws such a centre to either side of the edge.
    """
    x = edge_cells(edges, res, key, ["x1", "y1", "x2", "y2"])
    # an edge that goes by the centre goes by it closely
    side = _turn(F.col("a1"), F.col("b1"), F.col("a2"), F.col("b2"))
    x = x.where(F.abs(side) <= 1e-6 * (F.abs(F.col("a2") - F.col("a1")) + F.abs(F.col("b2") - F.col("b1"))))
    lon, lat = (F.expr(e) for e in grid.centre("cell", res))
    x = x.withColumns({"lon": lon, "lat": lat})
    there = F.col("lon").between(F.least("x1", "x2"), F.greatest("x1", "x2")) & F.col("lat").between(F.least("y1", "y2"), F.greatest("y1", "y2"))
    on = (F.col("x2") - F.col("x1")) * (F.col("lat") - F.col("y1")) == (F.col("y2") - F.col("y1")) * (F.col("lon") - F.col("x1"))
    return x.where(there & on).select(key, "cell").distinct()


def _middle(e: Column) -> Column:
    """Whether an edge crosses the cell's middle line, a = 0; an end on it lies west of it."""
    return (e["a1"] > 0) != (e["a2"] > 0)


def _over(e: Column, y: Column) -> Column:
    """Whether an edge that crosses the middle line does so above height y. An edge through that very place goes above it on
    the side that counts (just east of it) if it rises eastwards."""
    side = _turn(e["a1"], e["b1"] - y, e["a2"], e["b2"] - y)
    up = (side > 0) == (e["a1"] > e["a2"])
    return F.when(side == 0, (e["a2"] - e["a1"]) * (e["b2"] - e["b1"]) > 0).otherwise(up)


def local_shapes(edges: DataFrame, res: int, key: str = "shape", cells: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """What a cell needs to know of the polygons near it, as two tables.

    (key, cell) of the cells that lie in a polygon whole, and (key, cell, centre, edges) of those along its edges: whether
    it holds the cell's centre, and the edges that the cell may touch, no others. With ``cells``, of those cells only.
    """
    along, held = edge_cells(edges, res, key), centre_cells(edges, res, key)
    if cells is not None:
        wanted = by_sorting(cells.select("cell").distinct())
        along, held = along.join(wanted, "cell", "left_semi"), held.join(wanted, "cell", "left_semi")
    along = along.groupBy(key, "cell").agg(F.collect_list(F.struct("a1", "b1", "a2", "b2")).alias("edges"))
    both = along.join(by_sorting(held.withColumn("centre", F.lit(True))), [key, "cell"], "full")
    whole = both.where("edges is null").select(key, "cell")
    return whole, both.where("edges is not null").select(key, "cell", F.coalesce("centre", F.lit(False)).alias("centre"), "edges")


def holds(a: Column, b: Column, centre: Column, edges: Column) -> Column:
    """Whether a polygon holds the place (a, b) of a cell: it changes sides with each edge on the way from the centre up or
    down the middle line, and from there along the row. All of the way is in the cell, so its own edges are enough."""

    def met(e: Column) -> Column:
        up = _middle(e) & (_over(e, F.lit(0.0)) != _over(e, b))
        spans = (e["b1"] > b) != (e["b2"] > b)
        side = _turn(e["a1"], e["b1"] - b, e["a2"], e["b2"] - b)
        east = (side != 0) & ((side > 0) == (e["b2"] > e["b1"]))
        at = e["a1"] + (b - e["b1"]) * (e["a2"] - e["a1"]) / F.when(spans, e["b2"] - e["b1"])
        flat = F.coalesce(F.when(spans, east != (at > a)), F.lit(False))
        return up != flat

    return centre != (F.size(F.filter(edges, met)) % 2 == 1)


def few_edges(edges: Column) -> list[Column]:
    """What ``holds_few`` needs to know of ``FEW`` edges at most, as columns that are never null; an edge that isn't there is a
    place and meets nothing."""
    out = []
    for k in range(FEW):
        e = F.get(edges, F.lit(k))
        one = {c: F.coalesce(e[c], F.lit(0.0)) for c in ("a1", "b1", "a2", "b2")}
        rises = one["b2"] - one["b1"]
        one |= {"da": one["a2"] - one["a1"], "db": F.when(rises == 0, 1.0).otherwise(rises), "up": rises > 0, "back": one["a1"] > one["a2"]}
        one |= {"middle": _middle(one), "over": _over(one, F.lit(0.0)), "climbs": (one["a2"] - one["a1"]) * rises > 0}
        out += [x.alias(f"hx_{c}{k}") for c, x in one.items()]
    return out


def holds_few(a: Column, b: Column, centre: Column) -> Column:
    """``holds`` by the columns of ``few_edges``: Spark compiles these short expressions into the join, while it walks through
    a lambda's for each pair."""
    for k in range(FEW):
        e = {c: F.col(f"hx_{c}{k}") for c in ("a1", "b1", "a2", "b2", "da", "db", "up", "back", "middle", "over", "climbs")}
        side = _turn(e["a1"], e["b1"] - b, e["a2"], e["b2"] - b)
        over = F.when(side == 0, e["climbs"]).otherwise((side > 0) == e["back"])
        spans = (e["b1"] > b) != (e["b2"] > b)
        at = e["a1"] + (b - e["b1"]) * e["da"] / e["db"]
        flat = spans & (((side != 0) & ((side > 0) == e["up"])) != (at > a))
        centre = centre != ((e["middle"] & (e["over"] != over)) != flat)
    return centre


def keyed(polygons: DataFrame, key: str | None) -> DataFrame:
    """shape, rings: under the polygons' key, or under a hash of the rings, which equal polygons share and have once."""
    if key is not None:
        return polygons.select(F.col(key).alias("shape"), "rings")
    return polygons.select(F.xxhash64("rings").alias("shape"), "rings").where("rings is not null").dropDuplicates(["shape"])


def _steps(spots: DataFrame, by: list[str]) -> DataFrame:
    """by, y0, y1: the slabs between neighbouring heights."""
    w = Window.partitionBy(*by).orderBy("y")
    x = spots.select(*by, "y").distinct().withColumn("y1", F.lead("y").over(w))
    return x.where("y1 is not null").select(*by, F.col("y").alias("y0"), "y1")


def _intervals(x: DataFrame) -> DataFrame:
    """m: what a polygon (edges that reach into a strip; foot, whether it holds the middle line at lo) holds of height y, as
    the ends of intervals from west to east; west and east: whether the outer ones go on to the ends, -wide and wide."""
    spans = lambda e: (e["b1"] > F.col("y")) != (e["b2"] > F.col("y"))
    meets = F.transform(F.filter("edges", spans), lambda e: e["a1"] + (F.col("y") - e["b1"]) * (e["a2"] - e["a1"]) / (e["b2"] - e["b1"]))
    climbs = lambda e: _middle(e) & (_over(e, F.col("lo")) != _over(e, F.col("y")))
    x = x.withColumns({"m": F.array_sort(meets), "middle": F.col("foot") != (F.size(F.filter("edges", climbs)) % 2 == 1)})
    x = x.withColumn("west", F.col("middle") != (F.size(F.filter("m", lambda u: u < 0)) % 2 == 1))
    x = x.withColumn("m", F.when(F.col("west"), F.concat(F.array(-F.col("wide")), "m")).otherwise(F.col("m")))
    x = x.withColumn("east", F.size("m") % 2 == 1)
    return x.withColumn("m", F.when(F.col("east"), F.concat("m", F.array(F.col("wide")))).otherwise(F.col("m"))).drop("middle")


def covered_fraction(spine: DataFrame, polygons: DataFrame, res: int = 9, grid: HexGrid = GRID, name: str = "area_frac", key: str | None = None, few: int = 16) -> DataFrame:
    """cell, name: the exact fraction of each cell of the spine that the polygons (rings, and key if there is one) cover.

    Overlaps count once. A cell inside a polygon is 1. One along edges is cut into slabs at the heights of all corners and
    crossings (of edges with one another, with the cell's sides and with its middle line); in a slab every edge is one slanted
    line that meets no other, so what the polygons hold of it is as wide on average as at half its height. The union of
    their intervals there, times the slab's height, adds up to the area: no samples. Cells of over ``few`` edges are cut into
    strips first, in proportion to their edges, so crossings are looked for among the edges of a strip only. What a polygon
    holds over a strip's whole height between two of its edges is an interval; a polygon that lies in the union of all
    polygons' intervals adds nothing and goes, so where many overlap only those along the union's border are looked at. The
    strips are written once, with the edges that reach into each; all that follows reads them.

    Equal polygons count once, if they have no key. Cells that none touches get 0; polygons without area cover nothing.
    """
    whole, along = local_shapes(shape_edges(keyed(polygons, key), res, grid), res, cells=spine)
    full = cut(whole.select("cell").distinct())
    along = along.join(by_sorting(full), "cell", "left_anti")
    size = along.groupBy("cell").agg(F.sum(F.size("edges")).alias("n")).select("cell", (1 + F.floor(F.col("n") / few)).cast("int").alias("strips"))
    x = along.join(by_sorting(size), "cell")
    high = 2 * TOP / F.col("strips")
    x = x.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("strips") - 1)))
    x = x.withColumns({"lo": F.col("k") * high - TOP, "hi": (F.col("k") + 1) * high - TOP})
    # of each polygon in each strip: whether it holds the middle line at the strip's foot, and the edges that reach into it
    up = lambda e: _middle(e) & (_over(e, F.lit(0.0)) != _over(e, F.col("lo")))
    x = x.withColumn("foot", F.col("centre") != (F.size(F.filter("edges", up)) % 2 == 1))
    x = x.withColumn("edges", F.filter("edges", lambda e: (F.least(e["b1"], e["b2"]) < F.col("hi")) & (F.greatest(e["b1"], e["b2"]) > F.col("lo"))))
    strip = ["cell", "k"]
    # half of the strip's greatest width, and how far each edge goes to the west and the east inside the strip
    x = x.withColumn("wide", F.least(F.lit(0.5), 1 - 1.5 * F.when((F.col("lo") <= 0) & (F.col("hi") >= 0), 0.0).otherwise(F.least(F.abs("lo"), F.abs("hi")))))

    def within(e: Column) -> Column:
        rise = F.when(e["b1"] != e["b2"], e["b2"] - e["b1"])
        share = lambda v: F.coalesce(F.least(F.greatest((v - e["b1"]) / rise, F.lit(0.0)), F.lit(1.0)), F.lit(float(v is ends[1])))
        p, q = (e["a1"] + (e["a2"] - e["a1"]) * share(v) for v in ends)
        return F.struct(*[e[c].alias(c) for c in ("a1", "b1", "a2", "b2")], (F.least(p, q) - SLACK).alias("w"), (F.greatest(p, q) + SLACK).alias("e"))

    ends = F.col("lo"), F.col("hi")
    x = x.withColumn("edges", F.filter(F.transform("edges", within), lambda e: (e["w"] < F.col("wide")) & (e["e"] > -F.col("wide"))))
    x = _intervals(x.withColumn("y", (F.col("lo") + F.col("hi")) / 2)).where("size(m) > 0 or size(edges) > 0")

    def throughout(t: Column) -> Column:
        """What stays of an interval at the middle height where no edge comes, at any height of the strip."""
        mid = (F.col("m")[t] + F.col("m")[t + 1]) / 2
        beside = [F.array_max(F.transform(F.filter("edges", lambda e: e["e"] <= mid), lambda e: e["e"])), F.array_min(F.transform(F.filter("edges", lambda e: e["w"] >= mid), lambda e: e["w"]))]
        free = ~F.exists("edges", lambda e: (e["w"] < mid) & (e["e"] > mid))
        return F.when(free, F.struct(F.greatest(-F.col("wide"), beside[0]).alias("l"), F.least(F.col("wide"), beside[1]).alias("r")))

    x = x.withColumn("inner", F.when(F.size("m") > 0, F.transform(F.sequence(F.lit(0), F.size("m") - 2, F.lit(2)), throughout)))
    # how far the polygon goes in the strip: up to its edges, or to the cell's sides and beyond
    x = x.withColumns({"hw": F.when(F.col("west"), -F.col("wide")).otherwise(F.greatest(-F.col("wide"), F.array_min(F.transform("edges", lambda e: e["w"])))), "he": F.when(F.col("east"), F.col("wide")).otherwise(F.least(F.col("wide"), F.array_max(F.transform("edges", lambda e: e["e"]))))})
    parts = cut(x.select(*strip, "lo", "hi", "shape", "foot", "edges", "inner", "hw", "he"))
    held = parts.select(*strip, "lo", "hi", F.explode("inner").alias("i")).where("i.l < i.r").select(*strip, "lo", "hi", "i.*").distinct()
    row = Window.partitionBy(*strip).orderBy("l", "r")
    held = held.withColumn("upto", F.max("r").over(row.rowsBetween(Window.unboundedPreceding, -1)))
    held = held.withColumn("run", F.sum(F.when(F.col("l") <= F.col("upto"), 0).otherwise(1)).over(row.rowsBetween(Window.unboundedPreceding, 0)))
    held = cut(held.groupBy(*strip, "lo", "hi", "run").agg(F.min("l").alias("l"), F.max("r").alias("r")).drop("run"))
    found = held.select(*[F.col(c).alias(f"o_{c}") for c in (*strip, "l", "r")])
    rest = parts.join(by_sorting(found), F.expr("cell = o_cell and k = o_k and o_l <= hw and o_r >= he"), "left_anti")
    rest = cut(rest.select(*strip, "lo", "hi", "shape", "foot", "edges"))
    one = rest.select(*strip, "lo", "hi", "shape", F.posexplode("edges").alias("n", "e")).select(*strip, "lo", "hi", "shape", "n", "e.a1", "e.b1", "e.a2", "e.b2")

    y = lambda s: F.col("b1") + (F.col("b2") - F.col("b1")) * s
    cuts = [F.col("b1"), F.col("b2")]
    for slope, shift in ((0.0, 0.0), (0.0, 0.5), (0.0, -0.5), (-1.5, 1.0), (1.5, 1.0), (1.5, -1.0), (-1.5, -1.0)):  # the middle line and the six sides: a = slope * b + shift
        p, q = F.col("a1") - slope * F.col("b1") - shift, F.col("a2") - slope * F.col("b2") - shift
        cuts.append(F.when((p > 0) != (q > 0), y(p / F.when(p != q, p - q))))
    spots = one.select(*strip, "lo", "hi", F.explode(F.array(*cuts)).alias("y"))
    other = one.select(*strip, *[F.col(c).alias(f"o_{c}") for c in ("shape", "n", "a1", "b1", "a2", "b2")])
    pairs = one.join(by_sorting(other), strip).where("(shape < o_shape or shape = o_shape and n < o_n) and least(b1, b2) < greatest(o_b1, o_b2) and least(o_b1, o_b2) < greatest(b1, b2) and least(a1, a2) <= greatest(o_a1, o_a2) and least(o_a1, o_a2) <= greatest(a1, a2)")
    side = lambda a, b: (F.col("a2") - F.col("a1")) * (F.col(b) - F.col("b1")) - (F.col("b2") - F.col("b1")) * (F.col(a) - F.col("a1"))
    pairs = pairs.withColumns({"p": side("o_a1", "o_b1"), "q": side("o_a2", "o_b2")}).where("(p > 0) <> (q > 0)")
    crossing = F.col("o_b1") + (F.col("o_b2") - F.col("o_b1")) * (F.col("p") / F.when(F.col("p") != F.col("q"), F.col("p") - F.col("q")))
    spots = spots.unionByName(pairs.select(*strip, "lo", "hi", crossing.alias("y")))
    # the intervals' ends are upright lines: where edges and the cell's slanted sides meet them
    sides = held.select(*strip, "lo", "hi", F.explode(F.array("l", "r")).alias("at"))
    met = one.join(by_sorting(sides.drop("lo", "hi")), strip).where("(a1 > at) <> (a2 > at)")
    spots = spots.unionByName(met.select(*strip, "lo", "hi", y((F.col("at") - F.col("a1")) / F.when(F.col("a1") != F.col("a2"), F.col("a2") - F.col("a1"))).alias("y")))
    slant = (1 - F.abs("at")) / 1.5
    spots = spots.unionByName(sides.select(*strip, "lo", "hi", F.explode(F.array(slant, -slant)).alias("y")))
    fixed = F.array(F.col("lo"), F.col("hi"), F.lit(-TOP / 2), F.lit(TOP / 2))
    strips = rest.select(*strip, "lo", "hi").unionByName(held.select(*strip, "lo", "hi"))
    spots = spots.unionByName(strips.select(*strip, "lo", "hi", F.explode(fixed).alias("y"))).where("y between lo and hi")
    slabs = _steps(spots, strip)

    # what each polygon holds of a slab's middle height, as intervals from west to east
    at = (F.col("y0") + F.col("y1")) / 2
    slabs = slabs.withColumns({"y": at, "wide": F.least(F.lit(0.5), 1 - 1.5 * F.abs(at))})
    z = _intervals(slabs.join(by_sorting(rest.select(*strip, "lo", "shape", "foot", "edges")), strip)).where(F.size("m") > 0)
    z = z.withColumn("t", F.explode(F.sequence(F.lit(0), F.size("m") - 2, F.lit(2))))
    z = z.select(*strip, "y0", "y1", F.col("m")[F.col("t")].alias("l"), F.col("m")[F.col("t") + 1].alias("r"), "wide")
    z = z.unionByName(slabs.join(by_sorting(held.select(*strip, "l", "r")), strip).select(*strip, "y0", "y1", "l", "r", "wide"))
    z = z.select(*strip, "y0", "y1", F.greatest(F.col("l"), -F.col("wide")).alias("l"), F.least(F.col("r"), F.col("wide")).alias("r")).where("l < r")
    before = Window.partitionBy(*strip, "y0").orderBy("l", "r").rowsBetween(Window.unboundedPreceding, -1)
    z = z.withColumn("done", F.coalesce(F.max("r").over(before), F.lit(-1.0)))
    area = z.groupBy("cell").agg(F.sum(F.greatest(F.col("r") - F.greatest("l", "done"), F.lit(0.0)) * (F.col("y1") - F.col("y0"))).alias(name))
    found = area.select("cell", F.least(F.col(name), F.lit(1.0)).alias(name)).unionByName(full.select("cell", F.lit(1.0).alias(name)))
    return spine.select("cell").join(by_sorting(found), "cell", "left").fillna(0.0, [name])


def point_shapes(points: DataFrame, zones: DataFrame, res: int, grid: HexGrid, key: str, names: DataFrame | None = None) -> DataFrame:
    """A row for each point (lon, lat) and each zone (key, rings) that holds it: the point's columns and the key; with ``names``
    (key and more columns), these in place of the key.

    Both sides are dealt by cell into as many parts as the session has, which are not put together by their size: what
    comes of a cell is not what goes in. Nearly all cells have ``FEW`` edges of a zone at most; those that have more are
    compared apart.
    """
    whole, along = local_shapes(shape_edges(zones, res, grid, key), res, key)
    made = [key]
    if names is not None:
        made = [c for c in names.columns if c != key]
        whole, along = (x.join(by_sorting(names), key).drop(key) for x in (whole, along))
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = grid.with_cell(points.where("lon is not null and lat is not null"), res=res, name="hx_cell")
    c, s, space = math.cos(grid.turn(res)), math.sin(grid.turn(res)), grid.spacing(res)
    j = (F.col("hx_cell").bitwiseAND(268435455) - HALF).cast("double")
    i = (F.shiftright("hx_cell", 28).bitwiseAND(268435455) - HALF).cast("double")
    e, m = (F.col("lon") - grid.lon0) * grid.kx, (F.col("lat") - grid.lat0) * M_PER_LAT
    x = x.withColumns({"hx_a": (e * c + m * s) / space - (i - j / 2), "hx_b": (m * c - e * s) / (space * math.sqrt(3) / 2) - j})
    x = x.repartition(parts, "hx_cell")
    whole = whole.withColumnRenamed("cell", "hx_cell").repartition(parts, "hx_cell")
    inner = x.join(by_sorting(whole), "hx_cell").select(*points.columns, *made)
    along = along.select(*made, F.col("cell").alias("hx_cell"), F.col("centre").alias("hx_centre"), F.col("edges").alias("hx_edges"))
    few = along.where(F.size("hx_edges") <= FEW).repartition(parts, "hx_cell").select(*made, "hx_cell", "hx_centre", *few_edges(F.col("hx_edges")))
    few = x.join(by_sorting(few), "hx_cell").where(holds_few(F.col("hx_a"), F.col("hx_b"), F.col("hx_centre")))
    many = along.where(F.size("hx_edges") > FEW)
    many = x.join(by_sorting(many.repartition(parts, "hx_cell")), "hx_cell").where(holds(F.col("hx_a"), F.col("hx_b"), F.col("hx_centre"), F.col("hx_edges")))
    for found in (few, many):
        inner = inner.unionByName(found.select(*points.columns, *made))
    return inner


def kinds_of(zones: DataFrame, key: str) -> DataFrame:
    """key, hx_kind, rings: equal rings are of one kind."""
    return zones.select(key, F.struct(F.xxhash64("rings"), F.crc32(F.to_json(F.struct("rings")).cast("binary"))).alias("hx_kind"), "rings")


def lists_of(rows: DataFrame, by: Sequence[str], name: str, most: int) -> DataFrame:
    """by, name: the other columns of the rows of each group, as structs in lists of ``most`` or a few more; a group of more
    rows has several lists."""
    n = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("hx_n"))
    x = rows.join(by_sorting(n), list(by)).withColumn("hx_part", F.pmod(F.monotonically_increasing_id(), 1 + F.floor(F.col("hx_n") / most)))
    rest = [F.col(f"`{c}`") for c in rows.columns if c not in by]
    return x.groupBy(*by, "hx_part").agg(F.collect_list(F.struct(*rest)).alias(name)).drop("hx_part")


def point_zones(
    points: DataFrame, zones: DataFrame, res: int = 9, grid: HexGrid = GRID, key: str = "zone_id", most: int = 1000, columns: Sequence[str] | None = None
) -> DataFrame:
    """A row for each point (lon, lat) and each zone (key, rings) that holds it: the point's columns (those of ``columns``, if
    they are given) and the key.

    Points meet zones on their cell. A cell inside a zone needs no test; in one along a zone's edges a point is tested
    against the edges of that cell only. Points without coordinates are in no zone. A point on an edge is in by the
    even-odd rule of a ray: of two zones that share the edge, in one.

    What is compared are places and kinds of zones, not points and zones: the points of a place and the zones of equal
    rings are lists, of about ``most`` at the most, which are parted behind the comparison. The lists hold no more than what
    is returned, and of one column its bare values.
    """
    columns = list(columns or points.columns)
    there = points.where("lon is not null and lat is not null").select("lon", "lat", F.struct(*[F.col(f"`{c}`") for c in columns]).alias("hx_point"))
    bare = lambda p: p["hx_point"].getField(columns[0]) if len(columns) == 1 else p["hx_point"]
    places = lists_of(there, ["lon", "lat"], "hx_points", most).withColumn("hx_points", F.transform("hx_points", bare))
    kinds = kinds_of(zones.where("rings is not null"), key)
    one = kinds.groupBy("hx_kind").agg(F.first("rings").alias("rings"))
    names = lists_of(kinds.select("hx_kind", F.col(key).alias("hx_zone")), ["hx_kind"], "hx_zones", most).withColumn("hx_zones", F.transform("hx_zones", lambda z: z["hx_zone"]))
    x = point_shapes(places, one, res, grid, "hx_kind", names)
    x = x.select("hx_points", F.explode("hx_zones").alias("hx_z")).select("hx_z", F.explode("hx_points").alias("hx_p"))
    return x.select(*[(F.col("hx_p") if len(columns) == 1 else F.col("hx_p").getField(c)).alias(c) for c in columns], F.col("hx_z").alias(key))


def index_by(scored: DataFrame, key: str, limit: float, weight: str | None = None) -> DataFrame:
    """key, score_mean, n, score_sum, share_above the limit, score_p95, score_max of hx_score by key; a row counts ``weight``
    times, if there is one."""
    s, w = F.col("hx_score"), F.lit(1) if weight is None else F.col(weight)
    there = F.sum(F.when(s.isNotNull(), w))
    found = scored.groupBy(key).agg(
        (F.sum(s * w) / there).alias("score_mean"), F.sum(w).alias("n"), F.sum(s * w).alias("score_sum"), (F.sum(F.when(s > limit, w).when(s.isNotNull(), 0)) / there).alias("share_above"), F.max(s).alias("score_max")
    )
    found = found.join(quantile(scored, "hx_score", 0.95, "score_p95", by=[key], weight=weight), key, "left")
    return found.select(key, "score_mean", "n", "score_sum", "share_above", "score_p95", "score_max")


def zone_index(points: DataFrame, zones: DataFrame, score: str = "score", limit: float = 0.8, res: int = 9, grid: HexGrid = GRID, key: str = "zone_id") -> DataFrame:
    """The index of ``points.score_index`` for polygons in place of cells: a row for each zone, with n = 0 if it holds no point.

    Points of one place and score are one row with their number, and zones of equal rings one zone, so the pairs that are
    looked at are those of different places and different zones; the numbers come back as weights in every aggregate.
    """
    x = points.select("lon", "lat", clean(F.col(score)).alias("hx_score")).groupBy("lon", "lat", "hx_score").agg(F.count(F.lit(1)).alias("hx_n"))
    kinds = kinds_of(zones, key)
    one = kinds.where("rings is not null").groupBy("hx_kind").agg(F.first("rings").alias("rings"))
    x = point_shapes(x, one, res, grid, "hx_kind")
    # many points of a zone share a score, too
    x = cut(x.groupBy("hx_kind", "hx_score").agg(F.sum("hx_n").alias("hx_n")))  # read twice
    found = index_by(x, "hx_kind", limit, "hx_n")
    found = kinds.select(key, "hx_kind").join(found, "hx_kind", "left").drop("hx_kind")
    return found.fillna(0, ["n"])
