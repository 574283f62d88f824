"""The registered queries of the grid engine, each with the SQL that checks it where SQL can say it."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import h3bits, hexgrid, scalars
from .functions.hexgrid import GRID
from .functions.stages import num
from .functions.storage import cut, shared_dir
from .operators import adaptive, control, folds, hotspot, metrics, models, nearest, overlay, points, quality, raster, rollup, shapes
from .plans import assemble, study
from .schema import CLASS, FEATURE_RANGES, FEATURES, RISK
from .sources import geojson, tables
from .streaming import incidents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
PLACES = 6
BOX = (-74.0, 40.70, -73.97, 40.73)
#: Rainfall of the named scenarios, in millimetres an hour.
RATES = (("moderate", 25.0), ("heavy", 40.0), ("ida_like", 75.0), ("extreme", 100.0))


def query(sql: str | None = None):
    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
            return out.select(*[F.round(c, PLACES).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])

        run.__name__ = f.__name__
        QUERIES[f.__name__] = run
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def r(x: str, name: str | None = None) -> str:
    return f"round({x}, {PLACES}) as {name or x}"


# ---- the lattice, as SQL ---------------------------------------------------------------------------------------------
# Written from its definition and from none of the grid's own expressions: centres lie at spacing * (i - j / 2, j * sqrt(3) / 2),
# turned at odd levels; a point's cell is the one of the nearest centre, and so is a cell's parent.

#: Where the grid lies, the metres of a degree, and the area of a cell of level 9.
LON0, LAT0, PER_LON, PER_LAT, AREA9 = -74.0, 40.7, 111_320.0, 110_540.0, 0.1
KX = PER_LON * math.cos(math.radians(LAT0))
ROW = math.sqrt(3) / 2


def spacing(level: int) -> float:
    return math.sqrt(AREA9 * 1e6 / ROW) * 7 ** ((9 - level) / 2)


def turned(level: int) -> tuple[float, float]:
    angle = math.asin(math.sqrt(3 / 28)) if level % 2 else 0.0
    return math.cos(angle), math.sin(angle)


def i_of(cell: str) -> str:
    return f"((({cell}) >> 28) % 268435456 - 134217728)"


def j_of(cell: str) -> str:
    return f"(({cell}) % 268435456 - 134217728)"


def pack(level: int, i: str, j: str) -> str:
    return f"({level << 56} + (({i})::bigint + 134217728) * 268435456 + ({j})::bigint + 134217728)"


def middle(cell: str, level: int) -> tuple[str, str]:
    """Metres from the origin to a cell's centre."""
    (c, t), a = turned(level), spacing(level)
    u, v = f"({num(a)} * ({i_of(cell)} - {j_of(cell)} / 2e0))", f"({num(a * ROW)} * {j_of(cell)})"
    return f"({u} * {num(c)} - {v} * {num(t)})", f"({u} * {num(t)} + {v} * {num(c)})"


def centre(cell: str, level: int) -> tuple[str, str]:
    x, y = middle(cell, level)
    return f"({num(LON0)} + {x} / {num(KX)})", f"({num(LAT0)} + {y} / {num(PER_LAT)})"


def nearest_centre(source: str, x: str, y: str, level: int, name: str) -> str:
    """source with the cell whose centre is nearest to (x, y) metres: the nearer of the nearest in the rows below and above."""
    (c, t), a = turned(level), spacing(level)
    steps = [
        {"lx": x, "ly": y},
        {"lu": f"(lx * {num(c)} + ly * {num(t)}) / {num(a)}", "lv": f"(ly * {num(c)} - lx * {num(t)}) / {num(a)}"},
        {"lj": f"floor(lv / {num(ROW)})"},
        {"la": "floor(lu + lj / 2e0 + 5e-1)", "lb": "floor(lu + (lj + 1) / 2e0 + 5e-1)"},
        {"ld": f"pow(lu - la + lj / 2e0, 2) + pow(lv - lj * {num(ROW)}, 2)", "le": f"pow(lu - lb + (lj + 1) / 2e0, 2) + pow(lv - (lj + 1) * {num(ROW)}, 2)"},
    ]
    for k, step in enumerate(steps):
        source = f"(select *, {', '.join(f'{v} as {n}' for n, v in step.items())} from {source} s{k})"
    found = pack(level, "case when ld <= le then la else lb end", "case when ld <= le then lj else lj + 1 end")
    return f"(select * exclude (lx, ly, lu, lv, lj, la, lb, ld, le), {found} as {name} from {source} n)"


def located_cells(source: str, lon: str, lat: str, level: int, name: str = "cell") -> str:
    return nearest_centre(source, f"({lon} - {num(LON0)}) * {num(KX)}", f"({lat} - {num(LAT0)}) * {num(PER_LAT)}", level, name)


def lineage(source: str, level: int, to: int) -> str:
    """source with the ancestors of its cell: hx_p<level> for each level down to ``to``."""
    cell = "cell"
    for k in range(level, to, -1):
        source = nearest_centre(source, *middle(cell, k), k - 1, f"hx_p{k - 1}")
        cell = f"hx_p{k - 1}"
    return source


def children_sql(source: str, level: int, to: int) -> str:
    """A row for each descendant of source's child: at each level those of the cells around it whose nearest parent it is."""
    for k in range(level + 1, to + 1):
        near = nearest_centre(source, *middle("child", k - 1), k, "lm")
        around = f"(select * exclude (child, lm), child as lp, lm + di * 268435456 + dj as child from {near} m, generate_series(-1, 1) g(di), generate_series(-1, 1) h(dj))"
        source = f"(select * exclude (lp, lq, di, dj) from {nearest_centre(around, *middle('child', k), k - 1, 'lq')} q where lq = lp)"
    return source


#: Steps to the cells whose centres are one spacing away, and none.
STEPS = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a - b / 2) ** 2 + (ROW * b) ** 2 < 1.01]


# ---- inputs ---------------------------------------------------------------------------------------------------------

LON = "(-74.03e0 + (({k} * 7919) % 9000) / 1e5)"
LAT = "(40.68e0 + (({k} * 104729) % 12000) / 1e5)"
P = f"(select event_id, ts, event_type, value, {LON.format(k='event_id')} as lon, {LAT.format(k='event_id')} as lat from events)"
C9 = located_cells(P, "lon", "lat", 9)
MEANS = f"(select cell, avg(value) as value, count(*) as n from {C9} group by cell)"
SUP = f"(select s_suppkey as id, s_nationkey, {LON.format(k='s_suppkey')} as lon, {LAT.format(k='s_suppkey')} as lat, {LON.format(k='(s_suppkey + 1)')} as lon2, {LAT.format(k='(s_suppkey + 1)')} as lat2 from supplier)"


def located(df: DataFrame, key: str) -> DataFrame:
    return df.withColumns({"lon": F.expr(LON.format(k=key)), "lat": F.expr(LAT.format(k=key))})


def event_points(read) -> DataFrame:
    return located(read("events").select("event_id", "ts", "event_type", "value"), "event_id")


def event_cells(read) -> DataFrame:
    return points.point_mean(event_points(read).select("lon", "lat", "value"))


# ---- grid -----------------------------------------------------------------------------------------------------------


@query(f"select event_id, cell from {C9}")
def point_cell(read):
    return GRID.with_cell(event_points(read), res=9).select("event_id", "cell")


@query(f"select distinct cell, hx_p8 as parent8, hx_p7 as parent7 from {lineage(C9, 9, 7)}")
def cell_parent(read):
    x = GRID.with_cell(event_points(read), res=9).select("cell").distinct()
    x = GRID.with_parent(x, 9, 8, name="parent8")
    return GRID.with_parent(x, 9, 7, name="parent7").select("cell", "parent8", "parent7")


@query(f"select cell, child from {children_sql(f'(select distinct hx_p7 as cell, hx_p7 as child from {lineage(C9, 9, 7)})', 7, 9)}")
def cell_children(read):
    x = GRID.with_parent(GRID.with_cell(event_points(read), res=9), 9, 7).select(F.col("parent").alias("cell")).distinct()
    return GRID.children(x, 7, 9).select("cell", "child")


_DISK = ", ".join(f"cell + ({a} * 268435456 + {b})" for a, b in STEPS)


@query(f"select cell, unnest([{_DISK}]) as near from (select distinct cell from {C9})")
def cell_disk(read):
    return GRID.disk(GRID.with_cell(event_points(read), res=9).select("cell").distinct(), 1).select("cell", "near")


@query(f"select cell, (cell >> 56)::int as res, {r(centre('cell', 9)[0], 'lon')}, {r(centre('cell', 9)[1], 'lat')}, {r(num(AREA9), 'area_km2')} from (select distinct cell from {C9})")
def cell_centre(read):
    x = GRID.with_cell(event_points(read), res=9).select("cell").distinct()
    lon, lat = (F.expr(e) for e in GRID.centre("cell", 9))
    return x.select("cell", F.expr(hexgrid.res_of("cell")).alias("res"), lon.alias("lon"), lat.alias("lat"), F.lit(GRID.area_km2(9)).alias("area_km2"))


#: Corners lie at the hexagon's radius, 30 degrees off its six neighbours.
_AT = [math.asin(math.sqrt(3 / 28)) + math.radians(60 * k + 30) for k in (*range(6), 0)]
_CORNERS = ", ".join(f"({k}, {num(spacing(9) / math.sqrt(3) * math.cos(t) / KX)}, {num(spacing(9) / math.sqrt(3) * math.sin(t) / PER_LAT)})" for k, t in enumerate(_AT))


@query(f"select cell, k::int as k, {r(centre('cell', 9)[0] + ' + dx', 'x')}, {r(centre('cell', 9)[1] + ' + dy', 'y')} from (select distinct cell from {C9}), (values {_CORNERS}) v(k, dx, dy)")
def cell_boundary(read):
    x = GRID.with_cell(event_points(read), res=9).select("cell").distinct()
    return x.select("cell", F.posexplode(GRID.boundary(F.col("cell"), 9)).alias("k", "p")).select("cell", "k", "p.x", "p.y")


_COVER = f"(select cell, {centre('cell', 9)[0]} as lon, {centre('cell', 9)[1]} as lat from (select {pack(9, 'i', 'j')} as cell from generate_series(-60, 60) a(i), generate_series(-60, 60) b(j)))"
_SPINE = f"(select * from {_COVER} where lon between {BOX[0]}e0 and {BOX[2]}e0 and lat between {BOX[1]}e0 and {BOX[3]}e0)"


@query(f"select s.cell, {r('s.lon', 'lon')}, {r('s.lat', 'lat')}, coalesce(n, 0) as point_count from {_SPINE} s left join (select cell, count(*) as n from {C9} group by cell) p on s.cell = p.cell")
def bbox_cover(read):
    spine = GRID.cover(event_points(read).sparkSession, BOX, 9)
    return points.join_column(spine, points.point_count(event_points(read)), "point_count").fillna(0, ["point_count"])


@query(f"select name, count(*) as n from {P}, (values ('core', -74.0e0, 40.70e0, -73.97e0, 40.73e0), ('wide', -74.03e0, 40.68e0, -73.94e0, 40.80e0)) b(name, w, s, e, n2) where lon between w and e and lat between s and n2 group by name")
def bbox_profiles(read):
    spark = read("events").sparkSession
    boxes = spark.createDataFrame([("core", *BOX), ("wide", -74.03, 40.68, -73.94, 40.80)], "name string, west double, south double, east double, north double")
    return overlay.profile_filter(event_points(read), boxes).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


_PREFIX = (1 << 59) + (9 << 52) + (21 << 45) + sum(d << (45 - 3 * k) for k, d in enumerate((0, 1, 2, 3), 1)) + sum(7 << (45 - 3 * k) for k in range(10, 16))
_DIGITS = [(7 ** (9 - k), 45 - 3 * k) for k in range(5, 10)]
_H3 = f"({_PREFIX} + " + " + ".join(f"(((event_id // {n}) % 7) << {at})" for n, at in _DIGITS) + ")"


def h3_ids(read) -> DataFrame:
    e = F.col("event_id")
    digit = lambda n, at: F.shiftleft(F.floor(e / n) % 7, at)
    total = F.lit(_PREFIX)
    for n, at in _DIGITS:
        total = total + digit(n, at)
    return read("events").select("event_id", total.alias("h3"))


def _h3_up(x: str, to: int) -> str:
    return f"((({x}) & {~(15 << 52) & ((1 << 63) - 1)}) | {to << 52} | {(1 << (45 - 3 * to)) - 1})"


@query(f"select event_id, lower(to_hex(h3)) as h3, 9 as res, lower(to_hex({_h3_up('h3', 8)})) as parent8, lower(to_hex({_h3_up('h3', 5)})) as parent5 from (select event_id, {_H3} as h3 from events)")
def h3_parent_bits(read):
    c = F.col("h3")
    return h3_ids(read).select("event_id", h3bits.to_hex(c).alias("h3"), h3bits.resolution(c).alias("res"), h3bits.to_hex(h3bits.parent(c, 8)).alias("parent8"), h3bits.to_hex(h3bits.parent(c, 5)).alias("parent5"))


@query(f"select lower(to_hex(p)) as parent, lower(to_hex((p & {~(7 << 18)}) + {1 << 52} + (d << 18))) as child from (select distinct {_h3_up(_H3, 8)} as p from events), generate_series(0, 6) g(d)")
def h3_children_bits(read):
    x = h3_ids(read).select(h3bits.parent(F.col("h3"), 8).alias("p")).distinct()
    return x.select(h3bits.to_hex(F.col("p")).alias("parent"), F.explode(h3bits.children_once(F.col("p"))).alias("c")).select("parent", h3bits.to_hex(F.col("c")).alias("child"))


@query(f"select count(*) as n_ancestors, count(distinct a) as n_cells from (select unnest([h3, {', '.join(_h3_up('h3', k) for k in range(9))}]) as a from (select {_H3} as h3 from events))")
def h3_ancestors(read):
    x = h3_ids(read).select(F.explode(h3bits.ancestors(F.col("h3"))).alias("a"))
    return x.agg(F.count(F.lit(1)).alias("n_ancestors"), F.count_distinct("a").alias("n_cells"))


# ---- points ---------------------------------------------------------------------------------------------------------


@query(f"select cell, count(*) as point_count from {C9} group by cell")
def point_count(read):
    return points.point_count(event_points(read))


@query(f"select cell, {r('avg(value)', 'value')} from {C9} group by cell")
def point_mean(read):
    return event_cells(read)


_ORD = f"(select o_orderkey, (o_orderkey * 7919 % 1000) / 999e0 as score, {LON.format(k='o_orderkey')} as lon, {LAT.format(k='o_orderkey')} as lat from orders)"


@query(
    f"select hx_cell as cell, {r('avg(score)', 'score_mean')}, count(*) as n, {r('sum(score)', 'score_sum')}, {r('avg((score > 8e-1)::int::double)', 'share_above')}, {r('quantile_cont(score, 0.95)', 'score_p95')}, {r('max(score)', 'score_max')} from {located_cells(_ORD, 'lon', 'lat', 9, 'hx_cell')} group by hx_cell"
)
def building_index(read):
    o = located(read("orders").select("o_orderkey"), "o_orderkey").withColumn("score", (F.col("o_orderkey") * 7919 % 1000) / 999.0)
    return points.score_index(o)


@query(f"select event_type as zone, {r('avg(value)', 'mean')}, count(*) as n, {r('min(value)', 'least')}, {r('max(value)', 'most')}, {r('stddev_pop(value)', 'spread')} from events group by event_type")
def zone_means(read):
    return points.mean_by(read("events").withColumnRenamed("event_type", "zone"), "zone", "value")


_ERR = f"(select cell, count(*) as n from {C9} where event_type = 'error' group by cell)"
_LABEL = f"(select s.cell, coalesce(n, 0) as flood_point_count, (coalesce(n, 0) > 0)::int::double as flood_risk from (select distinct cell from {C9}) s left join {_ERR} e on s.cell = e.cell)"


@query(f"select cell, flood_point_count, 0e0 as flood_area_frac, flood_risk, flood_risk::int as flood_class, 'observed' as label_source from {_LABEL}")
def point_label(read):
    x = points.point_label(event_cells(read).select("cell"), event_points(read).where("event_type = 'error'"))
    return x.select("cell", "flood_point_count", "flood_area_frac", RISK, CLASS, "label_source")


@query(f"select {r('count(*) / ' + num(AREA9), 'building_density')}, cell from {C9} group by cell")
def building_density(read):
    return points.density(event_points(read), event_cells(read)).select("cell", "building_density")


@query("select event_type, count(*) as n from events where event_type like '%Flood%' or event_type like '%rr%' and event_type not like '%Sewer%' group by event_type")
def incident_text(read):
    x = read("events").withColumn("kind", F.when(F.col("event_type").like("%rr%"), F.concat(F.lit("Sewer "), "event_type")).otherwise(F.col("event_type")))
    return x.where(scalars.is_incident(F.col("event_type"), F.col("kind"))).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"select count(*) as n, {r('min(value)', 'least')} from {P} where lon between {BOX[0]}e0 and {BOX[2]}e0 and lat between {BOX[1]}e0 and {BOX[3]}e0")
def bbox_filter(read):
    x = event_points(read).where(F.col("lon").between(BOX[0], BOX[2]) & F.col("lat").between(BOX[1], BOX[3]))
    return x.agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("least"))


# ---- rollups and hotspots -------------------------------------------------------------------------------------------

_ROLL = lambda to: f"select hx_p{to} as parent, {r('avg(value)', 'mean')}, {r('max(value)', 'max')}, {r('quantile_cont(value, 0.9)', 'p90')}, count(*) as n_children from {lineage(MEANS, 9, to)} group by hx_p{to}"


@query(_ROLL(8))
def parent_rollup(read):
    return rollup.parent_rollup(event_cells(read), "value", 9, 8)


@query(" union all ".join(f"select {k} as coarse_res, * from ({_ROLL(k)})" for k in (6, 7, 8)))
def pyramid(read):
    return rollup.pyramid(event_cells(read), "value", 9, [6, 7, 8])


_RAW_LEVELS = " union all ".join(f"select {k} as coarse_res, avg(value) as mean from {lineage(MEANS, 9, k)} group by hx_p{k}" for k in (6, 7, 8))


@query(
    f"select coarse_res, count(*) as n, {r('avg(mean)', 'avg')}, {r('var_pop(mean)', 'variance')}, {r('min(mean)', 'least')}, {r('max(mean)', 'most')}, {r('quantile_cont(mean, 0.1)', 'q10')}, {r('quantile_cont(mean, 0.5)', 'q50')}, {r('quantile_cont(mean, 0.9)', 'q90')} from ({_RAW_LEVELS}) group by coarse_res"
)
def resolution_stats(read):
    return rollup.level_statistics(rollup.pyramid(event_cells(read), "value", 9, [6, 7, 8]))


_HOT = f"(select m.*, t from {MEANS} m, (select quantile_cont(value, 0.9) as t from {MEANS}) where value >= t)"


@query(f"select cell, {r('value')}, {r('t', 'threshold')} from {_HOT}")
def hotspots(read):
    return hotspot.hotspots(event_cells(read), "value")


_SETS = f"with a as (select cell from {_HOT}), b as (select m.cell from {MEANS} m, (select quantile_cont(value, 0.8) as t from {MEANS}) where n >= 3 and value >= t)"


def _two_sets(read):
    x = points.point_mean(event_points(read).select("lon", "lat", "value")).join(points.point_count(event_points(read)), "cell")
    return hotspot.hotspots(x, "value", 0.9), hotspot.hotspots(x, "value", 0.8).where("point_count >= 3")


@query(
    f"{_SETS}, n as (select (select count(*) from a) as n_a, (select count(*) from b) as n_b, (select count(*) from a join b using (cell)) as n_both) select n_a, n_b, n_both, n_a + n_b - n_both as n_any, {r('n_both / (n_a + n_b - n_both)', 'jaccard')}, {r('2 * n_both / (n_a + n_b)', 'f1')} from n"
)
def set_agreement(read):
    return hotspot.set_agreement(*_two_sets(read))


@query(f"{_SETS} select 'union' as kind, cell from (select cell from a union select cell from b) union all select 'intersection', cell from (select cell from a intersect select cell from b) union all select 'difference', cell from (select cell from a except select cell from b)")
def set_operations(read):
    a, b = _two_sets(read)
    kinds = [hotspot.set_operation(a, b, k).select(F.lit(k).alias("kind"), "cell") for k in ("union", "intersection", "difference")]
    return kinds[0].union(kinds[1]).union(kinds[2])


def _ladder_sql(quantiles: tuple[float, ...], levels=(6, 7, 8)) -> str:
    parts = []
    for q in quantiles:
        for k in levels:
            for a, agg in (("mean", "avg(value)"), ("max", "max(value)"), ("p90", "quantile_cont(value, 0.9)")):
                parts.append(
                    f"""select {k} as coarse_res, '{a}' as aggregation, {q}e0 as hotspot_quantile, (select count(*) from {MEANS}) as n_fine, count(*) as n_coarse,
                    (select count(*) from {MEANS}, f where value >= f.t{round(100 * q)}) as n_hotspot_fine, sum(hot)::bigint as n_hotspot_fine_parents, sum((v >= t)::int)::bigint as n_hotspot_coarse,
                    (select t{round(100 * q)} from f) as fine_hotspot_threshold, max(t) as coarse_hotspot_threshold, sum(hot * (v >= t)::int) as both_n, sum(greatest(hot, (v >= t)::int)) as any_n
                    from (select *, quantile_cont(v, {q}) over () as t from (select hx_p{k}, {agg} as v, max((value >= (select t{round(100 * q)} from f))::int) as hot from {lineage(MEANS, 9, k)} group by hx_p{k}))"""
                )
    cuts = ", ".join(f"quantile_cont(value, {q}) as t{round(100 * q)}" for q in quantiles)
    return f"""with f as (select {cuts} from {MEANS}), x as ({" union all ".join(parts)}),
    y as (select *, case when any_n = 0 then 1e0 else both_n / any_n end as j, case when n_hotspot_coarse + n_hotspot_fine_parents = 0 then 1e0 else 2 * both_n / (n_hotspot_coarse + n_hotspot_fine_parents) end as f1x from x)
    select 9 as fine_res, coarse_res, aggregation, hotspot_quantile, n_fine, n_coarse, n_hotspot_fine, n_hotspot_fine_parents, n_hotspot_coarse, {r("fine_hotspot_threshold")}, {r("coarse_hotspot_threshold")}, {r("j", "jaccard")}, {r("f1x", "f1")},
    round(max(case when aggregation = 'max' then j end) over (partition by coarse_res, hotspot_quantile) - max(case when aggregation = 'mean' then j end) over (partition by coarse_res, hotspot_quantile), {PLACES}) as extrema_smoothing from y"""


@query(_ladder_sql((0.9,)))
def resolution_ladder(read):
    return hotspot.resolution_ladder(event_cells(read), "value", 9, [6, 7, 8])


@query(_ladder_sql((0.8, 0.9, 0.95)))
def quantile_sweep(read):
    return hotspot.resolution_ladder(event_cells(read), "value", 9, [6, 7, 8], (0.8, 0.9, 0.95))


def _matrix_sql() -> str:
    hot = lambda k: f"(select p from (select hx_p{k} as p, avg(value) as v from {lineage(MEANS, 9, k)} group by hx_p{k}) qualify v >= quantile_cont(v, 0.9) over ())"
    parts = []
    for fine in (7, 8):
        for coarse in range(6, fine):
            a = f"(select distinct hx_p{coarse} as p from {lineage(f'(select p as cell from {hot(fine)})', fine, coarse)})"
            parts.append(f"select {fine} as fine_res, {coarse} as coarse_res, round((select count(*) from {a} a join {hot(coarse)} b on a.p = b.p) / (select count(*) from (select p from {a} union select p from {hot(coarse)})), {PLACES}) as jaccard")
    return " union all ".join(parts)


@query(_matrix_sql())
def jaccard_matrix(read):
    return hotspot.jaccard_matrix(event_cells(read), "value", 9, [6, 7, 8])


# ---- refinement -----------------------------------------------------------------------------------------------------

_PROB = "((cell % 1009 + 1009) % 1009) / 1008e0"
_M2 = f"(select *, {_PROB} as p from {MEANS})"
_CORE = f"select cell from {_M2}, (select quantile_cont(value, 0.8) as t from {MEANS}) where value >= t or 1 - abs(p - 5e-1) * 2 >= 9e-1"
_REFINED = f"(select cell from ({_CORE}) union select near from (select unnest([{_DISK}]) as near from ({_CORE})) where near in (select cell from {MEANS}))"


def _scored(read):
    return event_cells(read).withColumn("p", F.pmod("cell", F.lit(1009)) / 1008.0)


def _refined(read):
    return adaptive.refine_parents(_scored(read), "value", "p", 0.8, 0.9, 1)


@query(f"select cell from {_REFINED}")
def refine_parents(read):
    return _refined(read)


_MIXED = f"(select cell from {MEANS} where cell not in (select cell from {_REFINED}) union select child from {children_sql(f'(select cell, cell as child from {_REFINED})', 9, 10)})"


@query(f"select cell from {_MIXED}")
def mixed_cells(read):
    return adaptive.mixed_cells(event_cells(read), _refined(read), 9, 10)


_U10 = f"(select child as cell, (child % 997) / 996e0 as score from {children_sql(f'(select cell, cell as child from {MEANS})', 9, 10)})"
_HOT10 = f"(select cell from {_U10} qualify score >= quantile_cont(score, 0.9) over ())"


def _uniform(read):
    return GRID.children(event_cells(read).select("cell"), 9, 10).select(F.col("child").alias("cell"), (F.col("child") % 997 / 996.0).alias("score"))


@query(
    f"""with n as (select (select count(*) from {_MIXED}) as n_adaptive, (select count(*) from {_U10}) as n_uniform_fine, (select count(*) from {_HOT10}) as n_hotspot_uniform,
    (select count(*) from (select cell, hx_p9, hx_p8 from {lineage(_HOT10, 10, 8)}) where cell in (select cell from {_MIXED}) or hx_p9 in (select cell from {_MIXED}) or hx_p8 in (select cell from {_MIXED})) as held)
    select n_adaptive, n_uniform_fine, {r("n_adaptive / n_uniform_fine", "cell_count_ratio")}, n_hotspot_uniform, {r("held / n_hotspot_uniform", "hotspot_recall")}, 9e-1 as hotspot_quantile from n"""
)
def adaptive_metrics(read):
    mixed = adaptive.mixed_cells(event_cells(read), _refined(read), 9, 10)
    return adaptive.adaptive_metrics(mixed, _uniform(read), "score", 10, coarsest=8)


@query(f"select cell from {lineage(_HOT10, 10, 9)} where hx_p9 in (select cell from {_REFINED}) or cell in (select cell from {_REFINED})")
def ancestor_cover(read):
    hot = hotspot.hotspots(_uniform(read), "score").select("cell")
    return adaptive.covered(hot, _refined(read), 10, 8)


@query(
    f"with n as (select (select count(*) from {MEANS}) as a, (select count(*) from {_REFINED}) as b) select a as n_fixed_coarse, b as n_parents_refined, a - b + 49 * b as n_adaptive_mixed, a * 49 as n_uniform_fine, {r('(a + 48 * b) / (a * 49)', 'cell_count_ratio')}, {r('(a + 48 * b) / a', 'cell_count_ratio_vs_fixed')} from n"
)
def adaptive_comparison(read):
    return adaptive.adaptive_run(_scored(read), 9, 11, "value", "p", 0.8, 0.9, 1)[1]


@query(f"select c.child as cell, {r('coalesce(m.value, 0)', 'value')} from {children_sql(f'(select cell, cell as child from (select cell from {MEANS} union all select cell + 268435456000 from {MEANS}))', 9, 10)} c left join {MEANS} m on c.cell = m.cell")
def parent_inherit(read):
    cells = event_cells(read)
    wide = cells.select("cell").union(cells.select(F.col("cell") + 268435456000))
    fine = GRID.children(wide, 9, 10).select(F.col("child").alias("cell"))
    return adaptive.inherit_parent(fine, cells, "value", 10, 9)


_NC = f"(select cell, value, (cell % 5 = 0)::int * 5e-1 as sandy_area_frac, (cell % 3 = 0)::int * 25e-2 as flood_area_frac from {MEANS})"
_NCM = {"coastal_only": "c and not e", "pluvial_only": "e and not c", "both": "c and e", "neither": "not c and not e"}


@query(
    f"""with x as (select *, sandy_area_frac > 0 as c, flood_area_frac > 0 as e, value >= quantile_cont(value, 0.8) over () as high, quantile_cont(value, 0.8) over () as t from {_NC})
    select count(*) as n_cells, sum(c::int)::bigint as n_coastal, sum(e::int)::bigint as n_pluvial, {", ".join(f"sum(({m})::int)::bigint as n_{k}" for k, m in _NCM.items())},
    {", ".join(r(f"avg(case when {m} then value end)", f"mean_score_{k}") for k, m in _NCM.items())}, {r("max(t)", "high_score_threshold")}, sum(high::int)::bigint as n_high_score,
    {r("avg(case when high then (c and not e)::int end)", "coastal_only_among_high_score")}, {r("avg(case when high then e::int end)", "pluvial_among_high_score")},
    {r("avg(case when e and not c then value end) - avg(case when c and not e then value end)", "pluvial_minus_coastal_mean_score")} from x"""
)
def negative_control(read):
    x = event_cells(read)
    x = x.withColumns({"sandy_area_frac": (F.col("cell") % 5 == 0).cast("int") * 0.5, "flood_area_frac": (F.col("cell") % 3 == 0).cast("int") * 0.25})
    return control.negative_control(x, "value")


# ---- scores ---------------------------------------------------------------------------------------------------------

_SEED = "(list_sum(list_transform(string_split(c_name, ''), lambda x: ascii(x)))::bigint % 2147483647)"
_U = lambda k: f"(((seed * 1103515245 + {k}) % 2147483647) / 2147483647e0)"
_HF = f"""(select c_custkey, 5e0 + 80e0 * {_U(1)} + 20e0 * ((seed % 1000) / 1000e0) as elevation_m, 5e-1 + 12e0 * {_U(2)} as slope_deg,
 -2e0 * ln(1e0 - least(greatest({_U(3)}, 1e-9), 1e0 - 1e-9)) as flow_accum_proxy, least(1e0, 1e-1 + 7e-1 * {_U(4)}) as impervious_frac, least(1e0, 1e-1 + 7e-1 * {_U(4)}) * (50e0 + 200e0 * {_U(5)}) as building_density,
 20e0 + 800e0 * {_U(6)} as dist_stream_m, 25e0 as rainfall_mm_h, (1e-1 + 7e-1 * {_U(4)} > 45e-2)::int::double as land_cover_urban from (select c_custkey, {_SEED} as seed from customer))"""
_SYN = "least(1e0, greatest(0e0, 25e-2 * (100e0 - least(greatest(elevation_m, 0e0), 100e0)) / 100e0 + 15e-2 * (1e0 - least(slope_deg, 15e0) / 15e0) + 25e-2 * impervious_frac + 15e-2 * rainfall_mm_h / 50e0 + 1e-1 * building_density / 250e0 + 1e-1 * (1e0 - least(dist_stream_m, 500e0) / 500e0)))"


def customer_features(read):
    return scalars.hash_features(read("customer").select("c_custkey", "c_name"), "c_name").drop("c_name")


@query(f"select c_custkey, {', '.join(r(c) for c in FEATURES)} from {_HF}")
def hash_features(read):
    return customer_features(read).select("c_custkey", *FEATURES)


@query(f"select c_custkey, {r(_SYN, 'score')}, ({_SYN} >= 5e-1)::int as class from {_HF}")
def synthetic_score(read):
    x = customer_features(read).select("c_custkey", scalars.synthetic_score().alias("score"))
    return x.withColumn("class", scalars.threshold_class(F.col("score"), 0.5))


_WET = "ln(1e0 + flow_accum_proxy / (tan(radians(least(greatest(slope_deg, 5e-2), 89e0))) + 1e-6))"


@query(
    f"""with x as (select *, {_WET} as wet from {_HF}), y as (select min(elevation_m) as a, max(elevation_m) as b, min(wet) as c, max(wet) as d from x)
    select c_custkey, {r("4e-1 * (1e0 - (elevation_m - a) / (b - a + 1e-9)) + 35e-2 * impervious_frac + 15e-2 * (1e0 - least(slope_deg, 15e0) / 15e0) + 1e-1 * (wet - c) / (d - c + 1e-9)", "rule_score")} from x, y"""
)
def ponding_rule(read):
    return scalars.ponding_score(customer_features(read)).select("c_custkey", "rule_score")


@query("select event_id, case when v < 19e-2 then 1 when v < 4e-1 then 2 when v < 6e-1 then 3 when v <= 8e-1 then 4 else 5 end::int as band, round(1e0 - abs(v - 5e-1) * 2e0, 6) as uncertainty from (select event_id, (event_id * 7919 % 1000) / 999e0 as v from events)")
def risk_band(read):
    v = F.col("event_id") * 7919 % 1000 / 999.0
    return read("events").select("event_id", scalars.risk_band(v).cast("int").alias("band"), scalars.uncertainty(v).alias("uncertainty"))


_HAV = "2 * 6371000e0 * asin(sqrt(least(1e0, pow(sin(radians(lat2 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon) / 2), 2))))"


@query(f"select id, {r(_HAV, 'dist_m')} from {SUP}")
def haversine(read):
    x = supplier_segments(read)
    return x.select("id", scalars.haversine(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")).alias("dist_m"))


def _checks_sql() -> str:
    rows = ["select 'few_cells' as \"check\", '' as \"column\", count(*) as n, count(*) < 50 as bad from t", "select 'class_balance', 'flood_class', sum(flood_class)::bigint, avg(flood_class) < 5e-2 or avg(flood_class) > 95e-2 from t"]
    for c, (low, high) in FEATURE_RANGES.items():
        rows += [f"select '{k}', '{c}', count(*), count(*) > 0 from t where {w}" for k, w in (("null", f"{c} is null"), ("below", f"{c} < {num(low)}"), ("above", f"{c} > {num(high)}"))]
    rows.append("select 'synthetic_labels', 'label_source', count(*), true from t")
    return f'with t as (select *, 1 as flood_class from (select * replace (case when c_custkey % 10 = 0 then null else elevation_m end as elevation_m, slope_deg * 10 as slope_deg) from {_HF})) select "check", "column", n from ({" union all ".join(rows)}) where bad'


@query(_checks_sql())
def validation(read):
    x = customer_features(read).withColumns({"elevation_m": F.when(F.col("c_custkey") % 10 != 0, F.col("elevation_m")), "slope_deg": F.col("slope_deg") * 10, CLASS: F.lit(1), "label_source": F.lit("synthetic")})
    return quality.issues(x)


@query("select case when count(distinct event_type) = 1 then min(event_type) else 'mixed' end as verdict from events")
def provenance(read):
    return scalars.provenance(read("events").select(F.col("event_type").alias("label_source"), F.lit("opendata").alias("assembly_mode")))


# ---- folds and metrics ----------------------------------------------------------------------------------------------


def _blocks(read):
    return folds.with_block(event_cells(read), 9, 3)


@query(f"select cell, hx_p6 as block from {lineage(MEANS, 9, 6)}")
def block_id(read):
    return _blocks(read).select("cell", "block")


@query(
    f"""with recursive b as (select block, n, row_number() over (order by n desc, block desc) as k from (select hx_p6 as block, count(*) as n from {lineage(MEANS, 9, 6)} group by hx_p6)),
    g(k, load, block, n, fold_id) as (select 0::bigint, [0::bigint for x in range((select least(5, count(*)) from b))], null::bigint, null::bigint, null::int
    union all select b.k, [case when i = list_position(g.load, list_min(g.load)) then g.load[i] + b.n else g.load[i] end for i in range(1, len(g.load) + 1)], b.block, b.n, (list_position(g.load, list_min(g.load)) - 1)::int from g join b on b.k = g.k + 1)
    select block, n, fold_id from g where k > 0"""
)
def group_folds(read):
    return folds.greedy_folds(_blocks(read).groupBy("block").agg(F.count(F.lit(1)).alias("n")))


_LAB = "(select doc_id, quality as y, (doc_id * 7919 % 1000) / 1000e0 as s, (doc_id % 5)::int as fold, doc_id // 97 as block from labels where quality is not null)"


def _labels(read):
    x = read("labels").where("quality is not null")
    return x.select("doc_id", F.col("quality").alias("y"), (F.col("doc_id") * 7919 % 1000 / 1000.0).alias("s"), (F.col("doc_id") % 5).cast("int").alias("fold"), F.expr("doc_id div 97").alias("block")).withColumn("y_pred", (F.col("s") >= 0.5).cast("int"))


@query(f"select fold, count(*) as n_test, count(distinct block) as n_test_blocks, sum(y)::bigint as n_positive_test, sum(1 - y)::bigint as n_negative_test, array_to_string(list_sort(list_distinct(list(block::varchar))), ',') as test_block_ids from {_LAB} group by fold")
def fold_summary(read):
    return metrics.fold_summary(_labels(read), "fold", "block", "y")


_CM = f"(select fold, count(*) as n, avg((y = (s >= 5e-1)::int)::int) as accuracy, 2 * sum(y * (s >= 5e-1)::int) / (sum(y) + sum((s >= 5e-1)::int)) as f1 from {_LAB} group by fold)"


@query(f"select fold, n, {r('accuracy')}, {r('f1')} from {_CM}")
def classification_metrics(read):
    return metrics.classification(_labels(read), "y", "y_pred", ["fold"])


@query(f"select {r('avg(accuracy)', 'accuracy_mean')}, {r('stddev_pop(accuracy)', 'accuracy_sd')}, {r('avg(f1)', 'f1_mean')}, {r('stddev_pop(f1)', 'f1_sd')} from {_CM}")
def fold_spread(read):
    return metrics.fold_spread(metrics.classification(_labels(read), "y", "y_pred", ["fold"]), ["accuracy", "f1"])


@query(f"select fold, {r('avg(abs(y - s))', 'mae')}, {r('sqrt(avg((y - s) * (y - s)))', 'rmse')}, {r('1 - avg((y - s) * (y - s)) / var_pop(y)', 'r2')} from {_LAB} group by fold")
def regression_metrics(read):
    return metrics.regression(_labels(read), "y", "s", ["fold"])


_CUM = f"(select s, sum(y) as pos, sum(1 - y) as neg from {_LAB} group by s)"


@query(f"select {r('sum(pos * (coalesce(below, 0) + neg / 2)) / (sum(pos) * sum(neg))', 'roc_auc')} from (select *, sum(neg) over (order by s rows between unbounded preceding and 1 preceding) as below from {_CUM})")
def roc_auc(read):
    return metrics.roc_auc(_labels(read), "y", "s")


@query(f"select {r('sum(pos * tp / (tp + fp)) / sum(pos)', 'average_precision')} from (select *, sum(pos) over (order by s desc) as tp, sum(neg) over (order by s desc) as fp from {_CUM})")
def average_precision(read):
    return metrics.average_precision(_labels(read), "y", "s")


@query(
    f"""with e as (select fold, avg(y) as share, avg((y = (s >= 5e-1)::int)::int) as model from {_LAB} group by fold), m as (select avg(share) as ap, avg(2 * share / (1 + share)) as f, avg(1 - share) as an, avg(model) as mo from e), p as (select avg(y) as s, avg((y = (s >= 5e-1)::int)::int) as pm from {_LAB})
    select {r("ap", "always_positive_accuracy")}, {r("f", "always_positive_f1")}, {r("an", "always_negative_accuracy")}, 0e0 as always_negative_f1, {r("mo", "model_accuracy")}, {r("s", "pooled_positive_share")}, {r("2 * s / (1 + s)", "pooled_positive_f1")}, {r("1 - s", "pooled_negative_accuracy")}, {r("pm", "pooled_model_accuracy")}, case when s > 5e-1 then 'positive' else 'negative' end as majority, mo > ap as beats_positive, mo > an as beats_negative from m, p"""
)
def constant_baselines(read):
    return metrics.constant_baselines(_labels(read), "y", "y_pred", "fold")


@query(f"select sum((s > 5e-1)::int)::bigint as n_high, {r('avg(case when s > 5e-1 then y end)', 'mean_high')}, sum((fold = 0)::int)::bigint as n_first, {r('avg(case when fold = 0 then y end)', 'mean_first')} from {_LAB}")
def masked_means(read):
    return metrics.masked_means(_labels(read), "y", {"high": F.col("s") > 0.5, "first": F.col("fold") == 0})


_SPLIT = f"(select doc_id, y, row_number() over (partition by y order by (doc_id * 7919 + 104729) % 1000003, doc_id) as k, count(*) over (partition by y) as n from {_LAB})"


@query(f"select doc_id, y, k <= floor(n * 2e-1) as is_test from {_SPLIT}")
def stratified_split(read):
    return folds.stratified_split(_labels(read), "y", "doc_id").select("doc_id", "y", "is_test")


# ---- rasters --------------------------------------------------------------------------------------------------------

_PX = "(select (p_partkey // 50)::int as row, (p_partkey % 50)::int as col, case when p_partkey % 97 = 0 then null else ((p_partkey * 7919) % 1000) / 10e0 + p_size end as value from part)"
_PXY = f"(select *, -74.0e0 + (col + 5e-1) * 1e-3 as x, 40.7e0 + (row + 5e-1) * 1e-3 as y from {_PX})"


def pixels(read):
    raw = read("part").select(F.expr("cast(p_partkey div 50 as int)").alias("row"), (F.col("p_partkey") % 50).cast("int").alias("col"), F.when(F.col("p_partkey") % 97 == 0, -9999.0).otherwise(F.col("p_partkey") * 7919 % 1000 / 10.0 + F.col("p_size")).alias("value"))
    return tables.pixel_table(raw, -74.0, 40.7, 0.001, 0.001, nodata=-9999.0)


@query(f"select row, col, {r('x')}, {r('y')}, {r('value')} from {_PXY}")
def pixel_table(read):
    return pixels(read)


@query(f"select row, col, round(least(1e0, greatest(0e0, value / 100)), {PLACES}) as value from {_PX}")
def fraction_scale(read):
    return raster.fraction_scale(pixels(read)).select("row", "col", "value")


@query(f"select hx_cell as cell, {r('avg(value)', 'zonal')} from {located_cells(f'(select * from {_PXY} where value is not null)', 'x', 'y', 9, 'hx_cell')} group by hx_cell")
def zonal_mean(read):
    return raster.zonal_mean(pixels(read))


def _gradient_sql(dr: int, dc: int) -> str:
    return f"coalesce((b{dr}{dc}.value - a{dr}{dc}.value) / 2, b{dr}{dc}.value - p.value, p.value - a{dr}{dc}.value, 0)"


_EAST, _NORTH = PER_LON * math.cos(math.radians(40.7)) * 0.001, PER_LAT * 0.001


@query(
    f"with p as (select * from {_PX}) select p.row, p.col, case when p.value is not null then round(degrees(atan(sqrt(pow({_gradient_sql(0, 1)} / {num(_EAST)}, 2) + pow({_gradient_sql(1, 0)} / {num(_NORTH)}, 2)))), {PLACES}) end as slope_deg from p "
    + " ".join(f"left join p {n}{dr}{dc} on {n}{dr}{dc}.row = p.row + {s * dr} and {n}{dr}{dc}.col = p.col + {s * dc}" for dr, dc in ((0, 1), (1, 0)) for n, s in (("a", -1), ("b", 1)))
)
def slope(read):
    return raster.slope(pixels(read), 0.001, 0.001, 40.7).select("row", "col", "slope_deg")


_OFFSETS = ", ".join(f"({k}, {a}, {b})" for k, (a, b) in enumerate((a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b))
_RECV = f"""(with z as (select row, col, coalesce(value, (select max(value) from {_PX})) as z from {_PX}),
 n as (select z.row, z.col, z.z, m.z as nz, k, m.row as to_row, m.col as to_col, row_number() over (partition by z.row, z.col order by m.z, k) as rank from z, (values {_OFFSETS}) o(k, dr, dc), z m where m.row = z.row + dr and m.col = z.col + dc)
 select z.row, z.col, case when nz < z.z then to_row end as to_row, case when nz < z.z then to_col end as to_col from z left join (select * from n where rank = 1) n on n.row = z.row and n.col = z.col)"""


@query(f"select row, col, to_row, to_col from {_RECV}")
def d8_receiver(read):
    return raster.d8_receiver(pixels(read))


@query(
    f"with recursive v as (select * from {_RECV}), w(row, col, at_row, at_col) as (select row, col, row, col from v union all select w.row, w.col, v.to_row, v.to_col from w join v on v.row = w.at_row and v.col = w.at_col where v.to_row is not null), f as (select at_row as row, at_col as col, count(*) as flow from w group by 1, 2) select p.row, p.col, case when p.value is not null then flow end as flow from {_PX} p join f on f.row = p.row and f.col = p.col"
)
def d8_accumulation(read):
    return raster.d8_accumulation(pixels(read))


_RAIN = f"(select hx_cell as cell, avg(value) as rain from {located_cells(f'(select * from {_PXY} where value is not null)', 'x', 'y', 9, 'hx_cell')} group by hx_cell)"


@query(f"select cell, {r('rain', 'rainfall_mm_h')} from {MEANS} left join {_RAIN} using (cell)")
def event_rain(read):
    cells = event_cells(read).select("cell", F.lit(25.0).alias("rainfall_mm_h"))
    return assemble.event_rainfall(cells, pixels(read), 9).select("cell", "rainfall_mm_h")


@query(f"select 'r' || half as raster_id, row, col, to_row, to_col from (select 0 as half, * from {_RECV} union all select 1 as half, * from {_RECV.replace(_PX, f'(select row, col, -value as value from {_PX})')})")
def rasters_apart(read):
    """Two rasters in one table: the second upside down."""
    x = pixels(read).select("row", "col", "value")
    both = x.withColumn("raster_id", F.lit("r0")).unionByName(x.withColumns({"raster_id": F.lit("r1"), "value": -F.col("value")}))
    return raster.d8_receiver(both)


# ---- overlays -------------------------------------------------------------------------------------------------------


def supplier_segments(read):
    x = located(read("supplier").select(F.col("s_suppkey").alias("id"), "s_nationkey"), "id")
    return x.select("id", "s_nationkey", F.col("lon").alias("x1"), F.col("lat").alias("y1"), F.expr(LON.format(k="(id + 1)")).alias("x2"), F.expr(LAT.format(k="(id + 1)")).alias("y2"))


def supplier_boxes(read):
    half = F.col("s_nationkey") % 10 * 0.0001 + 0.002
    x = supplier_segments(read).select("id", *[(F.col(c) + half * s).alias(n) for n, c, s in (("w", "x1", -1), ("s", "y1", -1), ("e", "x1", 1), ("n", "y1", 1))])
    return overlay.box_rings(x, "w", "s", "e", "n").select(F.col("id").alias("feature_id"), F.lit("Polygon").alias("geom_type"), "rings", "w", "s", "e", "n")


_DEPTH = 4
_BOXES = "(select id, lon - h as w, lat - h as s, lon + h as e, lat + h as n from (select *, 2e-3 + 1e-4 * (s_nationkey % 10) as h from " + SUP + "))"
_SAMPLES = f"(select cell, child, {centre('child', 9 + _DEPTH)[0]} as lon, {centre('child', 9 + _DEPTH)[1]} as lat from {children_sql(f'(select cell, cell as child from {MEANS})', 9, 9 + _DEPTH)})"


_HITS = f"(select cell, count(distinct child) / {num(7**_DEPTH)} as area_frac from {_SAMPLES} p join {_BOXES} b on p.lon >= w and p.lon < e and p.lat >= s and p.lat < n group by cell)"


@query(f"select cell, {r('coalesce(area_frac, 0)', 'area_frac')} from {MEANS} left join {_HITS} using (cell)")
def coverage_fraction(read):
    return overlay.coverage(event_cells(read), supplier_boxes(read), 9, _DEPTH)


#: The sides of a cell of level 9 about its centre, in degrees.
_RING = [(spacing(9) / math.sqrt(3) * math.cos(t) / KX, spacing(9) / math.sqrt(3) * math.sin(t) / PER_LAT) for t in _AT]
_SIDES = ", ".join(f"({num(a[0])}, {num(a[1])}, {num(b[0])}, {num(b[1])})" for a, b in zip(_RING, _RING[1:], strict=False))
_REACH = max(abs(x) for x, _ in _RING), max(abs(y) for _, y in _RING)


def covered_sql(boxes: str, cells: str) -> str:
    """The exact fraction of each cell under the union of boxes (w, s, e, n), in degrees: slabs between the heights of boxes and
    corners, the boxes' union in each, and of each piece the width between the cell's two sides, in parts between which no
    two of the four lines cross."""
    lines = [f"coalesce(least(1e0, greatest(0e0, ({v} - {a}) / nullif({b} - {a}, 0))), 0e0)" for v in ("l", "h") for a, b in (("la", "lb"), ("ra", "rb"))]
    f = "greatest(0e0, least(h, ra + (rb - ra) * (ts[k] + ts[k + 1]) / 2) - greatest(l, la + (lb - la) * (ts[k] + ts[k + 1]) / 2))"
    return f"""(with c as (select cell, {centre('cell', 9)[0]} as cx, {centre('cell', 9)[1]} as cy from {cells}),
        near as (select cell, w - cx as w, s - cy as s, e - cx as e, n - cy as n from c join {boxes} on w < cx + {num(_REACH[0])} and e > cx - {num(_REACH[0])} and s < cy + {num(_REACH[1])} and n > cy - {num(_REACH[1])}),
        sides(x1, y1, x2, y2) as (values {_SIDES}),
        ys as (select cell, unnest([s, n]) as y from near union select cell, y1 from near, sides),
        slabs as (select cell, y as y0, lead(y) over (partition by cell order by y) as y1 from ys where y between {num(-_REACH[1])} and {num(_REACH[1])}),
        chords as (select cell, y0, slabs.y1, list((xa, xb) order by xa + xb) as x from (select slabs.*, x1 + (x2 - x1) * (y0 - sides.y1) / (y2 - sides.y1) as xa, x1 + (x2 - x1) * (slabs.y1 - sides.y1) / (y2 - sides.y1) as xb
            from slabs join sides on least(sides.y1, y2) <= y0 and greatest(sides.y1, y2) >= slabs.y1 where y0 < slabs.y1) slabs group by all),
        held as (select cell, y0, y1, w, e, max(e) over (partition by cell, y0 order by w, e rows between unbounded preceding and 1 preceding) as upto from slabs join near using (cell) where s <= y0 and n >= y1 and y0 < y1),
        part as (select cell, y0, h.y1, greatest(w, coalesce(upto, w)) as l, e as h, x[1][1] as la, x[1][2] as lb, x[2][1] as ra, x[2][2] as rb from held h join chords using (cell, y0) where e > coalesce(upto, w)),
        cut as (select *, list_sort([0e0, 1e0, {', '.join(lines)}]) as ts from part)
        select cell, least(1e0, sum((y1 - y0) * list_sum(list_transform([1, 2, 3, 4, 5], lambda k: (ts[k + 1] - ts[k]) * {f}))) * {num(KX * PER_LAT / (AREA9 * 1e6))}) as area_frac from cut group by cell)"""


_EXACT = covered_sql(_BOXES, MEANS)


@query(f"select cell, {r('coalesce(area_frac, 0)', 'area_frac')} from {MEANS} left join {_EXACT} using (cell)")
def coverage_exact(read):
    """Boxes that overlap, by area."""
    return overlay.coverage(event_cells(read), supplier_boxes(read), 9)


@query(f"select cell, flood_risk, {r('coalesce(area_frac, 0)', 'sandy_area_frac')}, (coalesce(area_frac, 0) >= 1e-9)::int as sandy_class from {_LABEL} left join {_EXACT} using (cell)")
def coastal_overlay(read):
    labelled = points.point_label(event_cells(read).select("cell"), event_points(read).where("event_type = 'error'")).select("cell", RISK)
    return overlay.coastal_overlay(labelled, supplier_boxes(read), 9)


_AX, _AY = f"((lon - qx) * {num(KX)})", f"((lat - qy) * {num(PER_LAT)})"
_BX, _BY = f"((lon2 - qx) * {num(KX)})", f"((lat2 - qy) * {num(PER_LAT)})"
_LEN = f"(({_BX} - {_AX}) * ({_BX} - {_AX}) + ({_BY} - {_AY}) * ({_BY} - {_AY}))"


@query(
    f"""with q as (select cell, {centre("cell", 9)[0]} as qx, {centre("cell", 9)[1]} as qy from {MEANS}),
    f as (select cell, qx, qy, {_AX} as ax, {_AY} as ay, {_BX} as bx, {_BY} as b_y, case when {_LEN} > 0 then least(1e0, greatest(0e0, -({_AX} * ({_BX} - {_AX}) + {_AY} * ({_BY} - {_AY})) / {_LEN})) else 0e0 end as t from q, {SUP}),
    d as (select cell, qx as lon, qy as lat, qx + (ax + (bx - ax) * t) / {num(KX)} as lon2, qy + (ay + (b_y - ay) * t) / {num(PER_LAT)} as lat2, row_number() over (partition by cell order by pow(ax + (bx - ax) * t, 2) + pow(ay + (b_y - ay) * t, 2)) as k from f)
    select cell, round({_HAV}, 3) as dist_m from d where k = 1"""
)
def nearest_distance(read):
    lon, lat = (F.expr(e) for e in GRID.centre("cell", 9))
    cells = event_cells(read).select("cell", lon.alias("lon"), lat.alias("lat"))
    return nearest.nearest_distance(cells, supplier_segments(read)).withColumn("dist_m", F.round("dist_m", 3))


_PAD = (BOX[0] - 0.002, BOX[1] - 0.002, BOX[2] + 0.002, BOX[3] + 0.002)


@query(f"select id from {_BOXES} where w <= {num(_PAD[2])} and e >= {num(_PAD[0])} and s <= {num(_PAD[3])} and n >= {num(_PAD[1])}")
def box_features(read):
    return overlay.meets_box(supplier_boxes(read), BOX).select(F.col("feature_id").alias("id"))


_TX = [f"(({num(v)} - lon) / nullif(lon2 - lon, 0))" for v in (_PAD[0], _PAD[2])]
_TY = [f"(({num(v)} - lat) / nullif(lat2 - lat, 0))" for v in (_PAD[1], _PAD[3])]


@query(
    f"""with t as (select *, greatest(0e0, coalesce(least({_TX[0]}, {_TX[1]}), 0e0), coalesce(least({_TY[0]}, {_TY[1]}), 0e0)) as a, least(1e0, coalesce(greatest({_TX[0]}, {_TX[1]}), 1e0), coalesce(greatest({_TY[0]}, {_TY[1]}), 1e0)) as b from {SUP})
    select id, s_nationkey, {r("lon + (lon2 - lon) * a", "x1")}, {r("lat + (lat2 - lat) * a", "y1")}, {r("lon + (lon2 - lon) * b", "x2")}, {r("lat + (lat2 - lat) * b", "y2")} from t
    where a <= b and (lon <> lon2 or lon between {num(_PAD[0])} and {num(_PAD[2])}) and (lat <> lat2 or lat between {num(_PAD[1])} and {num(_PAD[3])})"""
)
def clip_segments(read):
    return overlay.clip_segments(supplier_segments(read), BOX)


_MID = located_cells(f"(select *, (w + e) / 2 as mx, (s + n) / 2 as my from {_BOXES})", "mx", "my", 9, "mid")
_NEARBY = f"(select id, w, s, e, n, mid, mid + i * 268435456 + j as cell from {_MID}, generate_series(-4, 4) a(i), generate_series(-4, 4) b(j))"
_IN = f"(select id, cell from {_NEARBY} where {centre('cell', 9)[0]} between w and e and {centre('cell', 9)[1]} between s and n)"


_GRIDDED = located_cells(f"(select id, w + (e - w) * a / 11e0 as sx, s + (n - s) * b / 11e0 as sy from {_BOXES}, generate_series(0, 11) g(a), generate_series(0, 11) h(b))", "sx", "sy", 9, "sampled")


@query(f"with inner_cells as {_IN}, kept as (select id, cell from inner_cells union select id, mid from {_MID} where id not in (select id from inner_cells) union select id, sampled from {_GRIDDED} where id not in (select id from inner_cells)) select distinct id as feature_id, unnest([{_DISK}]) as cell from kept")
def geometry_cells(read):
    return overlay.geometry_cells(supplier_boxes(read), 9, buffer_k=1)


_HOUSE = f"(select c_custkey as id, {LON.format(k='c_custkey')} as lon, {LAT.format(k='c_custkey')} as lat from customer)"


def houses(read) -> DataFrame:
    x = located(read("customer").select("c_custkey"), "c_custkey")
    x = x.select("c_custkey", *[(F.col(c) + 0.0003 * d).alias(n) for n, c, d in (("w", "lon", -1), ("s", "lat", -1), ("e", "lon", 1), ("n", "lat", 1))])
    return overlay.box_rings(x, "w", "s", "e", "n")


_FOOTPRINTS = f"(select id, lon - 3e-4 as w, lat - 3e-4 as s, lon + 3e-4 as e, lat + 3e-4 as n from {_HOUSE})"


@query(f"select cell, {r('coalesce(area_frac, 0)', 'footprint_frac')} from {MEANS} left join {covered_sql(_FOOTPRINTS, MEANS)} using (cell)")
def footprint_fraction(read):
    """The share of each cell under buildings, which overlap."""
    return overlay.coverage(event_cells(read), houses(read), 9, name="footprint_frac")


@query(f"select m.cell, {r('coalesce(h.n, 0) / ' + num(AREA9), 'building_density')} from {MEANS} m left join (select cell as there, count(*) as n from {located_cells(_HOUSE, 'lon', 'lat', 9)} group by cell) h on there = m.cell")
def house_density(read):
    """Density of polygons by their centroids."""
    return points.density(points.centroids(houses(read)).select("lon", "lat"), event_cells(read).select("cell"))


# corners off the places of the points, so that no point lies on an edge
_TRI = f"(select id, lon + 37e-7 as ax, lat + 23e-7 as ay, lon2 + 37e-7 as bx, lat2 + 23e-7 as b_y, lon + 100037e-7 as cx, lat - 70011e-7 as cy from {SUP})"
_SIDE = lambda x, y: [f"(({b} - {a}) * ({y} - {c}) - ({d} - {c}) * ({x} - {a}))" for a, c, b, d in (("ax", "ay", "bx", "b_y"), ("bx", "b_y", "cx", "cy"), ("cx", "cy", "ax", "ay"))]


def _in_triangle(x: str, y: str) -> str:
    p, q, t = _SIDE(x, y)
    return f"(({p} > 0) = ({q} > 0) and ({q} > 0) = ({t} > 0))"


def supplier_triangles(read):
    """Long thin and wide triangles, which overlap and cross many cells."""
    corner = lambda x, y, dx, dy: F.struct((F.col(x) + dx).alias("x"), (F.col(y) + dy).alias("y"))
    a, b, c = corner("x1", "y1", 37e-7, 23e-7), corner("x2", "y2", 37e-7, 23e-7), corner("x1", "y1", 100037e-7, -70011e-7)
    return supplier_segments(read).select(F.col("id").alias("zone_id"), F.array(F.array(a, b, c, a)).alias("rings"))


@query(f"select event_id, id as zone_id from {P} join {_TRI} on {_in_triangle('lon', 'lat')}")
def zone_points(read):
    """The zones that hold each event."""
    return shapes.point_zones(event_points(read).select("event_id", "lon", "lat"), supplier_triangles(read), 9, columns=["event_id"])


@query(
    f"select id as zone_id, {r('avg(score)', 'score_mean')}, count(score) as n, {r('sum(score)', 'score_sum')}, {r('avg((score > 8e-1)::int::double)', 'share_above')}, {r('quantile_cont(score, 0.95)', 'score_p95')}, {r('max(score)', 'score_max')} from {_TRI} left join {_ORD} on {_in_triangle('lon', 'lat')} group by id"
)
def zone_index(read):
    """The building index by polygon zone, beside that by cell."""
    o = located(read("orders").select("o_orderkey"), "o_orderkey").withColumn("score", (F.col("o_orderkey") * 7919 % 1000) / 999.0)
    return shapes.zone_index(o, supplier_triangles(read))


_CORNER4 = ", ".join(f"({num(_PAD[i])}, {num(_PAD[j])})" for i, j in ((0, 1), (2, 1), (2, 3), (0, 3)))
_EDGES3 = f"(select id, unnest([(ax, ay, bx, b_y), (bx, b_y, cx, cy), (cx, cy, ax, ay)]) as g from {_TRI})"
_MEETS = " union all ".join(
    f"select id, {f'{num(v)} as x, g[2] + (g[4] - g[2]) * t as y' if k == 0 else f'g[1] + (g[3] - g[1]) * t as x, {num(v)} as y'} from (select id, g, ({num(v)} - g[{k + 1}]) / nullif(g[{k + 3}] - g[{k + 1}], 0) as t from {_EDGES3}) where t between 0 and 1"
    for k, v in ((0, _PAD[0]), (0, _PAD[2]), (1, _PAD[1]), (1, _PAD[3]))
)


@query(
    f"""with p as (select * from ({_MEETS}) where x between {num(_PAD[0])} and {num(_PAD[2])} and y between {num(_PAD[1])} and {num(_PAD[3])}
        union all select id, x, y from {_TRI}, (values {_CORNER4}) v(x, y) where {_in_triangle('x', 'y')}
        union all select id, unnest([ax, bx, cx]) as x, unnest([ay, b_y, cy]) as y from {_TRI}),
    q as (select * from p where x between {num(_PAD[0])} and {num(_PAD[2])} and y between {num(_PAD[1])} and {num(_PAD[3])}),
    o as (select q.id, x - mx as x, y - my as y, row_number() over (partition by q.id order by atan2(y - my, x - mx)) as k, count(*) over (partition by q.id) as m from q join (select id, avg(x) as mx, avg(y) as my from q group by id) c on c.id = q.id)
    select id as zone_id, 1 as n_rings, {r('sum(a.x * b.y - b.x * a.y) * 5e5', 'area')} from (select *, k % m + 1 as nx from o) a join (select id as bid, x, y, k as bk from o) b on bid = id and bk = nx group by id having sum(a.x * b.y - b.x * a.y) > 1e-15"""
)
def clip_rings(read):
    """Triangles cut to a box: how much of each is left, in millionths of a square degree."""
    x = overlay.clip_rings(supplier_triangles(read), BOX)
    return x.select("zone_id", F.size("rings").alias("n_rings"), F.abs(F.aggregate("rings", F.lit(0.0), lambda t, r: t + overlay.ring_area(r)) * 5e5).alias("area"))


@query(f"select layer, count(*) as n, {r('avg(lon)', 'lon')} from (select 'events' as layer, lon from {P} union all select 'suppliers', lon from {SUP}) group by layer")
def layer_union(read):
    x = tables.union_layers({"events": event_points(read).select("lon", "value"), "suppliers": supplier_segments(read).select(F.col("x1").alias("lon"), "s_nationkey")})
    return x.groupBy(F.col("source").alias("layer")).agg(F.count(F.lit(1)).alias("n"), F.avg("lon").alias("lon"))


@query(f"select count(*) as n, {r('avg(lon)', 'lon')}, {r('avg(lat)', 'lat')} from {P} where event_id % 7 <> 0")
def loose_points(read):
    text = lambda c: F.when(F.col("event_id") % 7 == 0, F.lit("n/a")).when(F.col("event_id") % 2 == 0, F.col(c).cast("string"))
    x = event_points(read).select("event_id", text("lon").alias("LONGITUDE"), F.col("lat").cast("string").alias("Latitude"), F.when(F.col("event_id") % 7 != 0, F.col("lon")).alias("X"))
    return tables.points_of(x).agg(F.count(F.lit(1)).alias("n"), F.avg("lon").alias("lon"), F.avg("lat").alias("lat"))


@query(f"select lower(to_hex(cell)) as cell, 'Polygon' as geom_type, 7 as n_points, {r('value')} from {MEANS}")
def geojson_round_trip(read):
    texts = geojson.cells_text(event_cells(read), "value", 9)
    back = geojson.parse(texts)
    return back.select(F.col("props")["cell"].alias("cell"), "geom_type", F.size(F.col("rings")[0]).alias("n_points"), F.col("props")["value"].cast("double").alias("value"))


@query(f"select cell, {r('value')} from {MEANS}")
def cells_round_trip(read):
    spark, path = read("events").sparkSession, _stream_path(read("events").sparkSession)
    tables.write_cells(event_cells(read).withColumn("cell_res", F.lit(9)), path)
    return tables.read_cells(spark, path, "value").select("cell", "value")


@query(f"select id::varchar as id, {r('lon', 'x')}, {r('lat2', 'y2')} from {SUP}")
def features_round_trip(read):
    """Line features written as text, a feature a line, and read back."""
    path = _stream_path(read("supplier").sparkSession)
    line = F.array(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))))
    x = supplier_segments(read).select(F.lit("LineString").alias("geom_type"), line.alias("rings"), F.create_map(F.lit("id"), F.col("id").cast("string")).alias("props"))
    geojson.write_geojson(geojson.features_text(x), path)
    back = geojson.parse(read("supplier").sparkSession.read.text(path))
    return back.select(F.col("props")["id"].alias("id"), F.col("rings")[0][0]["x"].alias("x"), F.col("rings")[0][1]["y"].alias("y2"))


@query(f"select event_id::varchar as id, {r('lon', 'x')}, {r('lat', 'y')}, case when event_id % 3 = 0 then 'a }} \"{{' else event_type end as note from {P}")
def large_collection(read):
    """All events as points of collections of a thousand, a file each, with braces and quotes in strings, read back in blocks."""
    spark, path = read("events").sparkSession, _stream_path(read("events").sparkSession)
    place = F.array(F.array(F.struct(F.col("lon").alias("x"), F.col("lat").alias("y"))))
    note = F.when(F.col("event_id") % 3 == 0, F.lit('a } "{')).otherwise(F.col("event_type"))
    x = event_points(read).select(F.lit("Point").alias("geom_type"), place.alias("rings"), F.create_map(F.lit("id"), F.col("event_id").cast("string"), F.lit("note"), note).alias("props"))
    one = F.concat(F.lit('{"type":"FeatureCollection","crs":{"type":"name","properties":{"name":"CRS84"}},"features":['), F.array_join(F.collect_list("value"), ","), F.lit("]}"))
    texts = geojson.features_text(x).groupBy(F.pmod(F.xxhash64("value"), F.lit(1 + x.count() // 1000))).agg(one.alias("value"))
    texts.select("value").write.option("maxRecordsPerFile", 1).text(path)
    back = geojson.read_large_geojson(spark, path)
    return back.select(F.col("props")["id"].alias("id"), F.col("rings")[0][0]["x"].alias("x"), F.col("rings")[0][0]["y"].alias("y"), F.col("props")["note"].alias("note"))


@query(f"select id::varchar as id, {r('lon')}, {r('lat')}, case when id % 2 = 0 then 'agency' else 'sensor' end as source from {SUP}")
def sensor_source(read):
    """Sensors by the first of their points; half of them name their source."""
    points_of = F.array(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))))
    props = F.map_concat(F.create_map(F.lit("id"), F.col("id").cast("string")), F.when(F.col("id") % 2 == 0, F.create_map(F.lit("source"), F.lit("agency"))).otherwise(F.create_map().cast("map<string,string>")))
    x = supplier_segments(read).select(F.col("id").alias("feature_id"), F.lit("MultiPoint").alias("geom_type"), points_of.alias("rings"), props.alias("props"))
    return geojson.sensor_points(x).select(F.col("feature_id").cast("string").alias("id"), "lon", "lat", "source")


@query(f"select event_id::varchar as id, {r('lon')}, {r('lat')} from {P}")
def cited_points(read):
    """Written below two lines of citation, and read back."""
    spark, path = read("events").sparkSession, _stream_path(read("events").sparkSession)
    x = event_points(read)
    head = spark.createDataFrame([("# source: test tables",), ("# made up, no real places",), ("id,Latitude,LONGITUDE",)], "value string")
    head.coalesce(1).union(x.select(F.concat_ws(",", "event_id", "lat", "lon").alias("value"))).write.text(path)
    return tables.read_cited_csv(spark, path).select("id", "lon", "lat")


@query(f"select fold, n::bigint as n, {r('accuracy')}, case when fold > 0 then round(f1, {PLACES}) end as f1 from {_CM}")
def metrics_round_trip(read):
    """A table of metrics written as JSON, where NaN is null, and read back."""
    spark, path = read("labels").sparkSession, _stream_path(read("labels").sparkSession)
    x = metrics.classification(_labels(read), "y", "y_pred", ["fold"])
    tables.write_metrics(x.withColumn("f1", F.when(F.col("fold") > 0, F.col("f1")).otherwise(float("nan"))), path, "json")
    return spark.read.schema("fold int, n long, accuracy double, f1 double").json(path)


_AUC = SQL["roc_auc"]
_APS = SQL["average_precision"]
def ranked_by(g: str) -> str:
    """By group, from the definitions: pairs of a positive and a negative, and the precision at each positive's score."""
    auc = f"(select p.{g}, avg(case when p.s > n.s then 1e0 when p.s = n.s then 5e-1 else 0e0 end) as roc_auc from {_LAB} p join {_LAB} n on n.{g} = p.{g} and p.y = 1 and n.y = 0 group by p.{g})"
    ap = f"(select {g}, avg(hit) as pr_auc from (select p.{g}, p.doc_id, avg(o.y) as hit from {_LAB} p join {_LAB} o on o.{g} = p.{g} and o.s >= p.s where p.y = 1 group by p.{g}, p.doc_id) where {g} in (select {g} from {_LAB} where y = 0) group by {g})"
    return f"(select {g}, roc_auc, pr_auc from (select distinct {g} from {_LAB}) left join {auc} using ({g}) left join {ap} using ({g}))"


@query(f"select fold, {r('roc_auc')}, {r('pr_auc')} from {ranked_by('fold')}")
def fold_ranking(read):
    """AUC and average precision of each fold."""
    return metrics.fold_ranking(_labels(read), "y", "s", "fold")


@query(f"select block, {r('roc_auc')}, {r('pr_auc')} from {ranked_by('block')}")
def block_ranking(read):
    """The same of many small groups, some of one class only."""
    return metrics.fold_ranking(_labels(read), "y", "s", "block")


_SPREAD = ", ".join(f"{r(f'avg({c})', f'{c}_mean')}, {r(f'stddev_pop({c})', f'{c}_sd')}" for c in ("accuracy", "f1"))
_RANK_SPREAD = ", ".join(f"{r(f'avg({c})', f'{c}_mean')}, {r(f'stddev_pop({c})', f'{c}_sd')}" for c in ("roc_auc", "pr_auc"))


@query(f"select * from ({_AUC}), ({_APS}), (select {_SPREAD} from {_CM}), (select {_RANK_SPREAD} from {ranked_by('fold')})")
def discrimination_report(read):
    """Pooled and by fold, from stored predictions."""
    return metrics.discrimination(_labels(read), "y", "s", "fold")


# ---- models and plans -----------------------------------------------------------------------------------------------

_RATES = ", ".join(f"('{n}', {num(v)})" for n, v in RATES)


@query(f"select c_custkey, scenario, mm_h as rainfall_mm_h from customer, (values {_RATES}) v(scenario, mm_h)")
def scenario_grid(read):
    return models.scenario_cells(read("customer").select("c_custkey", F.lit(1.0).alias("rainfall_mm_h")), RATES)


def training_cells(read):
    x = event_cells(read).withColumn("hx_name", F.lower(F.hex("cell")))
    x = scalars.hash_features(x, "hx_name").drop("hx_name")
    x = x.withColumn("rainfall_mm_h", F.pmod("cell", F.lit(76)).cast("double") + 25)
    return cut(assemble.synthetic_labels(x, 0.5))


@query()
def train_score(read):
    cells = training_cells(read)
    return models.fit_models(cells).predict(cells).select("cell", "predicted_risk", "flood_probability", "predicted_class")


@query()
def cv_oof(read):
    x = folds.with_folds(folds.with_block(training_cells(read), 9, 3))
    return models.cross_validate(x).select("cell", "block", "fold_id", CLASS, "flood_probability", "predicted_class", "predicted_risk")


@query()
def baselines_cv(read):
    x = folds.with_folds(folds.with_block(training_cells(read), 9, 3))
    return models.baseline_table(x)


@query()
def scenarios_pfi(read):
    cells = training_cells(read)
    scored = models.scenarios(models.fit_models(cells), cells.drop(RISK, CLASS), RATES)
    return scored.select("cell", "scenario", "rainfall_mm_h", "PFI_h", "flood_probability")


@query(f"select e.cell, {r('e.value', 'observed_risk')}, {r('(e.cell % 1009 + 1009) % 1009 / 1008e0', 'flood_probability')}, {r('e.n / 100e0', 'PFI_h')} from {MEANS} e where e.n > 1 and e.value > 5")
def score_join(read):
    x = event_cells(read)
    oof = x.where("value > 5").select("cell", (F.pmod("cell", F.lit(1009)) / 1008.0).alias("flood_probability"))
    n = points.point_count(event_points(read)).where("point_count > 1")
    scored = n.select("cell", F.lit("heavy").alias("scenario"), (F.col("point_count") / 100.0).alias("PFI_h"))
    return models.joined_scores(x.withColumnRenamed("value", RISK), oof, scored, "heavy")


_CELLS = f"(select cell, {centre('cell', 9)[0]} as lon, {centre('cell', 9)[1]} as lat, list_sum(list_transform(string_split(lower(to_hex(cell)), ''), lambda x: ascii(x)))::bigint % 2147483647 as seed from {MEANS})"
_BACKUP = _HF.replace("c_custkey", "cell")
_BACKUP = _BACKUP[: _BACKUP.rindex("(select cell")] + _CELLS + ")"


@query(f"select cell, {', '.join(r(c) for c in FEATURES)} from {_BACKUP}")
def demo_table(read):
    """The cells of all events, their features drawn from their names. Risk has noise from a hash that SQL lacks; it is left out."""
    return assemble.cell_table(study_spine(read), assemble.Layers(mode="demo"), 9).select("cell", *FEATURES)


def _ranked_rows(rows: str, g: str, y: str, score: str) -> str:
    """AUC and average precision by group, from the definitions, as in ``ranked_by``."""
    x = f"(select {g} as g, {y} as y, {score} as s, row_number() over () as k from {rows})"
    auc = f"(select p.g, avg(case when p.s > n.s then 1e0 when p.s = n.s then 5e-1 else 0e0 end) as roc_auc from x p join x n on n.g = p.g and p.y = 1 and n.y = 0 group by p.g)"
    ap = "(select g, avg(hit) as pr_auc from (select p.g, p.k, avg(o.y) as hit from x p join x o on o.g = p.g and o.s >= p.s where p.y = 1 group by p.g, p.k) where g in (select g from x where y = 0) group by g)"
    return f"(with x as {x} select g as {g}, roc_auc, pr_auc from (select distinct g from x) left join {auc} using (g) left join {ap} using (g))"


_RULED = f"""(with x as (select *, (cell % 5 + 5) % 5 as fold_id, {_SYN} as risk, {_WET} as wet from {_BACKUP}),
    e as (select fold_id, min(elevation_m) as a, max(elevation_m) as b, min(wet) as c, max(wet) as d from x group by fold_id)
    select fold_id::int as fold_id, risk, (risk >= 5e-1)::int as y, 4e-1 * (1e0 - (elevation_m - a) / (b - a + 1e-9)) + 35e-2 * impervious_frac + 15e-2 * (1e0 - least(slope_deg, 15e0) / 15e0) + 1e-1 * (wet - c) / (d - c + 1e-9) as s from x join e using (fold_id))"""


@query(
    f"""select fold_id, n, accuracy, f1, mae, rmse, r2, {r('roc_auc')}, {r('pr_auc')} from (select fold_id, count(*) as n, {r('avg((y = (s >= 5e-1)::int)::int)', 'accuracy')}, {r('coalesce(2 * sum(y * (s >= 5e-1)::int) / nullif(sum(y) + sum((s >= 5e-1)::int), 0), 0)', 'f1')},
    {r('avg(abs(risk - s))', 'mae')}, {r('sqrt(avg((risk - s) * (risk - s)))', 'rmse')}, {r('1 - avg((risk - s) * (risk - s)) / var_pop(risk)', 'r2')} from {_RULED} group by fold_id) join {_ranked_rows(_RULED, 'fold_id', 'y', 's')} using (fold_id)"""
)
def rule_baseline(read):
    """The ponding rule against risks without noise, by fold."""
    x = assemble.features(study_spine(read), assemble.Layers(mode="demo"), 9)
    return models.rule_by_fold(assemble.synthetic_labels(x, 0.5, 0.0).withColumn("fold_id", F.pmod("cell", F.lit(5)).cast("int")))


def study_layers(read) -> assemble.Layers:
    return assemble.Layers(dem=pixels(read), buildings=event_points(read).select("lon", "lat"), streams=supplier_segments(read), flood_points=event_points(read).where("event_type = 'error'").select("lon", "lat"), coastal=supplier_boxes(read), mode="opendata")


def study_spine(read) -> DataFrame:
    lon, lat = (F.expr(e) for e in GRID.centre("cell", 9))
    return event_cells(read).select("cell", lon.alias("lon"), lat.alias("lat"))


def _zonal(source: str, value: str, name: str) -> str:
    return f"(select hx_cell as cell, avg({value}) as {name} from {located_cells(f'(select * from {source} where {value} is not null)', 'x', 'y', 9, 'hx_cell')} group by hx_cell)"


_AT_PIXEL = f"(select q.*, p.x, p.y from ({{}}) q join {_PXY} p on p.row = q.row and p.col = q.col)"
_STREAM = SQL["nearest_distance"]
_STREAM = f"({_STREAM.replace('round(' + _HAV + ', 3) as dist_m', _HAV + ' as dist_m')})"
_TILT = SQL["slope"].replace("round(degrees(", "(degrees(").replace(f", {PLACES}) end as slope_deg", ") end as slope_deg")
_SEEN = {"elevation_m": _zonal(_PXY, "value", "v"), "slope_deg": _zonal(_AT_PIXEL.format(_TILT), "slope_deg", "v"), "flow_accum_proxy": _zonal(_AT_PIXEL.format(SQL["d8_accumulation"]), "flow", "v"), "dist_stream_m": f"(select cell, dist_m as v from {_STREAM})"}
_TABLE = ["cell", "lon", "lat", *FEATURES, "cell_res", "feature_source", "assembly_mode", "rainfall_source", "observed_feature_cols", "flood_point_count", "flood_area_frac", "observed_risk", RISK, CLASS, "label_source", "sandy_area_frac", "sandy_class"]
_KNOWN = {c: f"coalesce({c}_l.v, b.{c})" for c in _SEEN} | {"building_density": f"m.n / {num(AREA9)}"} | {c: f"b.{c}" for c in FEATURES if c not in _SEEN and c != "building_density"}


@query(
    f"""select m.cell, {r('g.lon', 'lon')}, {r('g.lat', 'lat')}, {', '.join(f"round({v}, {3 if c == 'dist_stream_m' else PLACES}) as {c}" for c, v in _KNOWN.items())}, 9 as cell_res, 'mixed' as feature_source, 'opendata' as assembly_mode, 'scenario_or_config' as rainfall_source,
    'building_density,dist_stream_m,elevation_m,flow_accum_proxy,slope_deg' as observed_feature_cols, coalesce(f.n, 0) as flood_point_count, 0e0 as flood_area_frac, (coalesce(f.n, 0) > 0)::int::double as observed_risk, (coalesce(f.n, 0) > 0)::int::double as {RISK}, (coalesce(f.n, 0) > 0)::int as {CLASS},
    'observed' as label_source, {r('coalesce(area_frac, 0)', 'sandy_area_frac')}, (coalesce(area_frac, 0) >= 1e-9)::int as sandy_class
    from {MEANS} m join {_CELLS} g on g.cell = m.cell join {_BACKUP} b on b.cell = m.cell {' '.join(f'left join {q} {c}_l on {c}_l.cell = m.cell' for c, q in _SEEN.items())}
    left join (select cell, count(*) as n from {C9} where event_type = 'error' group by cell) f on f.cell = m.cell left join {_EXACT} x on x.cell = m.cell"""
)
def cell_table(read):
    x = assemble.cell_table(study_spine(read), study_layers(read), 9)
    x = x.withColumns({"observed_feature_cols": F.array_join("observed_feature_cols", ","), "dist_stream_m": F.round("dist_stream_m", 3)})
    return x.select(*_TABLE)


_VIEWS = f"(select cell as child, count(*) as n from {located_cells(P, 'lon', 'lat', 10)} where event_type = 'view' group by cell)"
_FINE = f"(select c.child as cell, greatest((coalesce(v.n, 0) > 0)::int::double, coalesce(l.flood_risk, 0)) as flood_risk from {children_sql(f'(select cell, cell as child from {MEANS})', 9, 10)} c left join {_VIEWS} v on v.child = c.child left join {_LABEL} l on l.cell = c.cell)"


@query(f"select cell, {r('flood_risk')}, (flood_risk > 0)::int as flood_class, 'observed_points_plus_parent' as label_source, 'points_plus_parent_inherit' as label_scale_mode from {_FINE}")
def label_scale(read):
    spine = GRID.children(event_cells(read).select("cell"), 9, 10).select(F.col("child").alias("cell"))
    parents = points.point_label(event_cells(read).select("cell"), event_points(read).where("event_type = 'error'"))
    x = assemble.label_scale_table(spine, assemble.Layers(flood_points=event_points(read).where("event_type = 'view'")), 10, parents, 9)
    return x.select("cell", RISK, CLASS, "label_source", "label_scale_mode")


_FITTED = f"(select [1e0, {', '.join('(cell % 76 + 76) % 76 + 25e0' if c == 'rainfall_mm_h' else c for c in FEATURES)}, m.value] as x from {MEANS} m join {_BACKUP} using (cell))"
_LETTER = "[" + ", ".join(f"'{c}'" for c in ("intercept", *FEATURES, RISK)) + "]"
_GRAM = f"(select i, j, sum(x[i] * x[j]) as g from {_FITTED}, generate_series(1, 10) a(i), generate_series(1, 10) b(j) group by i, j)"


def fitted_cells(read):
    """The cells' features, and the mean of their events in place of a risk."""
    return training_cells(read).withColumn(RISK, F.col("value"))


@query(f"select {_LETTER}[i] as a, {_LETTER}[j] as b, {r('g / 1e6', 'total')} from {_GRAM} where i <= j")
def linear_sums(read):
    """The sums that least squares needs, in millions."""
    return models.gram_sums(fitted_cells(read), RISK).withColumn("total", F.col("total") / 1e6)


#: Of the drawn features most are one number in another scale; these three are told apart.
_APART = ["elevation_m", "impervious_frac", "rainfall_mm_h"]
_KEPT = [1, *[FEATURES.index(c) + 2 for c in _APART], len(FEATURES) + 2]


@query(
    f"""with recursive start as (select list(r order by i) as m from (select i, list(g order by list_position({_KEPT}, j)) as r from {_GRAM} where i in {tuple(_KEPT[:-1])} and j in {tuple(_KEPT)} group by i)),
    e(k, m) as (select 0, m from start union all
        select k + 1, list_transform(m, lambda r, i: case when i = k + 1 then list_transform(r, lambda v: v / m[k + 1][k + 1]) else list_transform(r, lambda v, j: v - r[k + 1] * m[k + 1][j] / m[k + 1][k + 1]) end) from e where k < {len(_APART) + 1})
    select {['intercept', *sorted(_APART, key=FEATURES.index)]}[i] as feature, {r(f'm[i][{len(_APART) + 2}]', 'coefficient')} from e, generate_series(1, {len(_APART) + 1}) a(i) where k = {len(_APART) + 1}"""
)
def linear_fit(read):
    """The linear baseline's coefficients on three features as they are; SQL solves the normal equations by elimination."""
    cells = fitted_cells(read)
    found = models.linear_coefficients(models.linear_regressor(_APART).fit(cells), _APART)
    return cells.sparkSession.createDataFrame(list(found.items()), "feature string, coefficient double")


#: Each cell's constant, its three features and its value; whether the value is high; the least squares solution by group.
_LINE = f"(select cell, m.value >= 4e1 as y, [1e0, {', '.join('(cell % 76 + 76) % 76 + 25e0' if c == 'rainfall_mm_h' else c for c in sorted(_APART, key=FEATURES.index))}, m.value] as x from {MEANS} m join {_BACKUP} using (cell))"


def solved(rows: str) -> str:
    """(g, b): the coefficients of x[5] on x[1] to x[4] over the rows of each g, by elimination in the normal equations."""
    return f"""(with recursive gram as (select g, i, j, sum(x[i] * x[j]) as s from {rows}, generate_series(1, 4) a(i), generate_series(1, 5) b(j) group by g, i, j),
        e(g, k, m) as (select g, 0, list(r order by i) from (select g, i, list(s order by j) as r from gram group by g, i) group by g union all
            select g, k + 1, list_transform(m, lambda r, i: case when i = k + 1 then list_transform(r, lambda v: v / m[k + 1][k + 1]) else list_transform(r, lambda v, j: v - r[k + 1] * m[k + 1][j] / m[k + 1][k + 1]) end) from e where k < 4)
        select g, list_transform(m, lambda r: r[5]) as b from e where k = 4)"""


_DOT = "(b[1] + b[2] * x[2] + b[3] * x[3] + b[4] * x[4])"
_FOLDED = f"(select l.cell, x, fold_id from {_LINE} l join {lineage(MEANS, 9, 6)} p on p.cell = l.cell join ({SQL['group_folds']}) f on f.block = p.hx_p6)"
_OTHER_FOLDS = f"(select f.fold_id as g, x from {_FOLDED} c join (select distinct fold_id from {_FOLDED}) f on f.fold_id <> c.fold_id)"


def graded_cells(read):
    """fitted_cells, of which those with a high value are a class."""
    return fitted_cells(read).withColumn(CLASS, (F.col(RISK) >= 40).cast("int"))


def few_features(x, features=None):
    return models.linear_models(x, _APART)


@query(f"select cell, fold_id, round({_DOT}, 3) as predicted_risk from {_FOLDED} join {solved(_OTHER_FOLDS)} on g = fold_id")
def linear_oof(read):
    """Out-of-fold predictions of the linear baseline over folds of whole blocks; SQL solves the equations of each fold."""
    x = folds.with_folds(folds.with_block(graded_cells(read), 9, 3))
    return models.cross_validate(x, few_features).select("cell", "fold_id", F.round("predicted_risk", 3).alias("predicted_risk"))


_HELD = f"(select *, k <= floor(n * 2e-1) as is_test from (select *, row_number() over (partition by y order by ((cell % 1000003) * 7919 + 104729) % 1000003, cell) as k, count(*) over (partition by y) as n from {_LINE}))"


@query(
    f"""select round(avg(abs(x[5] - p)), 4) as mae, round(sqrt(avg(pow(x[5] - p, 2))), 4) as rmse, round(1 - avg(pow(x[5] - p, 2)) / var_pop(x[5]), 4) as r2
    from (select x, {_DOT} as p from {_HELD} cross join {solved(f"(select 0 as g, x from {_HELD} where not is_test)")} where is_test)"""
)
def linear_holdout(read):
    """The linear baseline fitted on four fifths of the cells, and its errors on the rest."""
    found = models.train(graded_cells(read), fit=few_features)[1]
    return found.select(*[F.round(c, 4).alias(c) for c in ("mae", "rmse", "r2")])


@query(
    f"""with s as (select cell, scenario, mm_h, {_DOT.replace('x[4]', 'mm_h')} as pfi from {_LINE} cross join {solved(f"(select 0 as g, x from {_LINE})")} cross join (values {_RATES}) v(scenario, mm_h))
    select cell, scenario, mm_h as rainfall_mm_h, round(pfi, 3) as "PFI_h", round(max(pfi) over (partition by cell) - min(pfi) over (partition by cell), 3) as pfi_range from s"""
)
def linear_scenarios(read):
    """Scores of each cell under each rainfall by the linear baseline, and how far they lie apart."""
    cells = graded_cells(read)
    scored = models.scenarios(few_features(cells), cells.drop(RISK, CLASS), RATES)
    x = scored.join(models.scenario_range(scored), "cell")
    return x.select("cell", "scenario", "rainfall_mm_h", *[F.round(c, 3).alias(c) for c in ("PFI_h", "pfi_range")])


_FOUND = f"(select (cell % 5)::int as fold_id, (cell % 5 <> 4 and value >= 4e1)::int as y, value / 1e2 as risk, (cell % 1009) / 1008e0 as s, cell % 5 <> 3 as fitted from {MEANS})"
_FOLD_MEANS = ", ".join(f"{r(f'avg({c})', f'{c}_mean')}, {r(f'stddev_pop({c})', f'{c}_sd')}" for c in models.FOLD_METRICS)


@query(
    f"""with f as (select * from {_FOUND} where fitted), each as (select fold_id, avg((y = (s >= 5e-1)::int)::int) as accuracy, coalesce(2 * sum(y * (s >= 5e-1)::int) / nullif(sum(y) + sum((s >= 5e-1)::int), 0), 0) as f1,
        avg(abs(risk - s)) as mae, 1 - avg(pow(risk - s, 2)) / var_pop(risk) as r2 from f group by fold_id)
    select {_FOLD_MEANS}, count(*) as n_folds, (select {r('roc_auc')} from {_ranked_rows('(select *, 0 as pool from f)', 'pool', 'y', 's')}) as roc_auc, (select {r('pr_auc')} from {_ranked_rows('(select *, 0 as pool from f)', 'pool', 'y', 's')}) as average_precision, (select count(*) from {_FOUND}) as n_rows
    from each join {_ranked_rows('f', 'fold_id', 'y', 's')} using (fold_id)"""
)
def blocked_report(read):
    """The report of stored out-of-fold predictions: one fold could not be fitted, and one holds a single class."""
    fold = F.pmod("cell", F.lit(5)).cast("int")
    x = event_cells(read).withColumns({"fold_id": fold, "p": F.when(fold != 3, F.pmod("cell", F.lit(1009)) / 1008.0)})
    y = ((F.col("fold_id") != 4) & (F.col("value") >= 40)).cast("int")
    x = x.select("fold_id", y.alias(CLASS), (F.col("value") / 100).alias(RISK), F.col("p").alias("flood_probability"), F.col("p").alias("predicted_risk"), (F.col("p") >= 0.5).cast("int").alias("predicted_class"))
    return models.validation_report(x)


@query(f"select unnest({_LETTER[: _LETTER.rindex(',')]}]) as a, true as settled")
def logistic_fit(read):
    """Whether the logistic baseline's penalised loss is flat at its solution, in each coefficient."""
    cells = training_cells(read)
    model = models.logistic_classifier(cells.count()).fit(cells)
    return models.logistic_gradient(cells, model).select("a", (F.abs("gradient") < 1e-4).alias("settled"))


@query(f"select cell, true as same from {MEANS}")
def models_round_trip(read):
    """Whether models that were saved and loaded again score each cell as before."""
    cells = training_cells(read)
    fitted, path = models.linear_models(cells), _stream_path(cells.sparkSession)
    fitted.save(cells.sparkSession, path)
    again = models.RiskModels.load(cells.sparkSession, path).predict(cells).select("cell", *[F.col(c).alias(f"again_{c}") for c in ("predicted_risk", "flood_probability")])
    x = fitted.predict(cells).join(again, "cell")
    return x.select("cell", ((F.col("predicted_risk") == F.col("again_predicted_risk")) & (F.col("flood_probability") == F.col("again_flood_probability"))).alias("same"))


@query()
def holdout_metrics(read):
    """One row: models fitted on four fifths of the cells, and how they do on the rest."""
    return models.train(training_cells(read))[1]


@query()
def box_inference(read):
    """Scores of all cells of a box by models fitted on the cells of all events."""
    fitted = models.fit_models(training_cells(read))
    layers = assemble.Layers(dem=pixels(read), buildings=event_points(read).select("lon", "lat"), streams=supplier_segments(read))
    x = study.infer(fitted, read("events").sparkSession, BOX, layers, 9, 40.0)
    return x.select("cell", "rainfall_mm_h", "feature_source", "predicted_risk", "flood_probability", "predicted_class")


@query()
def evaluation_report(read):
    """metric, value: in the sample, out of fold, and the baselines in the sample and out of fold."""
    cells = cut(folds.with_folds(folds.with_block(training_cells(read), 9, 3)))  # every part of the report reads them
    fitted = models.fit_models(cells)
    return study.evaluation(fitted, cells, models.cross_validate(cells)).unionByName(study.baselines(cells))


@query()
def study_run(read):
    """A whole study over the cells of all events: part, metric, value of everything that it reports as a number."""
    layers = study_layers(read)
    return study.summary(study.run_study(study_spine(read), layers, rates=RATES))


@query()
def in_sample_baselines(read):
    return models.in_sample_baselines(training_cells(read))


@query()
def study_comparison(read):
    spine = study_spine(read)
    cells = cut(assemble.cell_table(spine, assemble.Layers(dem=pixels(read), mode="demo"), 9))
    fitted = models.fit_models(cells)
    return adaptive.adaptive_run(fitted.predict(cells), 9, 11, "predicted_risk", "flood_probability")[1]


# ---- streams --------------------------------------------------------------------------------------------------------


def _stream(read):
    """Error events as a stream: of the files of a folder, or of the one file of that name."""
    table = read("events")
    folder, _, file = table.inputFiles()[0].rpartition("/")
    reader = table.sparkSession.readStream.schema(table.schema)
    stream = reader.parquet(folder) if folder.endswith(".parquet") else reader.option("pathGlobFilter", file).parquet(folder)
    return located(stream.where("event_type = 'error'"), "event_id")


def _stream_path(spark) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


_WIN = f"select time_bucket(interval 1 hour, ts) as window_start, cell, count(*) as n from {C9} where event_type = 'error' group by 1, 2"


def _as_windows(counts: DataFrame, read) -> DataFrame:
    rows = incidents.run_available(counts, _stream_path(read("events").sparkSession), ["window_start", "cell"])
    return rows.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(_WIN)
def incident_windows(read):
    """Over a stream that is read in one batch no row comes late, so the answer is the table's."""
    return _as_windows(incidents.windowed_counts(_stream(read), "1 hour", late="2 hours"), read)


@query(_WIN)
def incident_windows_once(read):
    """Repeated incidents are counted once: the stream holds each twice."""
    return _as_windows(incidents.windowed_counts(_stream(read).union(_stream(read)), "1 hour", late="2 hours", once="event_id"), read)


@query(f"select cell, w as window_start, count(*) as n from (select cell, unnest([time_bucket(interval 1 hour, ts), time_bucket(interval 1 hour, ts) - interval 30 minutes, time_bucket(interval 1 hour, ts) + interval 30 minutes]) as w, ts from {C9} where event_type = 'error') where ts >= w and ts < w + interval 1 hour group by 1, 2")
def incident_windows_sliding(read):
    """The batch form, with windows that overlap by half."""
    x = located(read("events").where("event_type = 'error'"), "event_id")
    return incidents.windowed_counts(x, "1 hour", "30 minutes").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query()
def live_risk(read):
    cells = training_cells(read)
    fitted = models.fit_models(cells)
    readings = _stream(read).select("event_id", "ts", "lon", "lat", (F.col("value") + 20).alias("rainfall_mm_h"))
    scored = incidents.live_risk(readings, cells.drop(RISK, CLASS, "value"), fitted).select("event_id", "cell", "rainfall_mm_h", "PFI_h")
    return incidents.run_available(scored, _stream_path(cells.sparkSession), mode="append")
