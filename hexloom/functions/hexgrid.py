"""A hexagonal grid of aperture seven for city or region extents, in plain column arithmetic.

Longitude and latitude become metres on a plane that touches the sphere at the grid's origin, so cells stretch away
from the origin's latitude: use one grid for each region. A cell of resolution r is a lattice point (i, j) of a basis
with 120 degrees between its vectors; lattices of odd resolutions are turned against even ones so that each cell is the
middle of exactly seven of the next. A cell id packs resolution, i and j in a BIGINT.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stages import Stages, apply, num

HALF = 1 << 27
#: The middle child and its six neighbours; also the six directions of the lattice.
SEVEN = [(0, 0), (1, 0), (0, 1), (-1, 0), (0, -1), (1, 1), (-1, -1)]
TURN = math.asin(math.sqrt(3 / 28))
M_PER_LON, M_PER_LAT = 111_320.0, 110_540.0


def i_of(cell: str) -> str:
    return f"((({cell}) >> 28) & 268435455) - {HALF}"


def j_of(cell: str) -> str:
    return f"(({cell}) & 268435455) - {HALF}"


def res_of(cell: str) -> str:
    return f"cast((({cell}) >> 56) & 15 as int)"


def pack(res: int | str, i: str, j: str) -> str:
    level = (res << 56) if isinstance(res, int) else f"(cast({res} as bigint) << 56)"
    return f"({level} + ((cast({i} as bigint) + {HALF}) << 28) + (cast({j} as bigint) + {HALF}))"


def parent_once(cell: str, res: int) -> str:
    """The parent of a cell of resolution res, one level up. Whole numbers only: no ties."""
    i, j = f"({i_of(cell)})", f"({j_of(cell)})"
    a, b = (f"3 * {i} - {j}", f"{i} + 2 * {j}") if res % 2 else (f"2 * {i} + {j}", f"3 * {j} - {i}")
    near = lambda x: f"floor((2 * ({x}) + 7) / 14e0)"
    return pack(res - 1, near(a), near(b))


def children_of(i: str, j: str, res: int) -> list[tuple[str, str]]:
    """The seven children, at resolution res, of the cell (i, j) one level above."""
    a, b = (f"2 * ({i}) + ({j})", f"3 * ({j}) - ({i})") if res % 2 else (f"3 * ({i}) - ({j})", f"({i}) + 2 * ({j})")
    return [(f"{a} + ({di})", f"{b} + ({dj})") for di, dj in SEVEN]


def disk_offsets(k: int) -> list[tuple[int, int]]:
    return [(a, b) for a in range(-k, k + 1) for b in range(-k, k + 1) if max(abs(a), abs(b), abs(a - b)) <= k]


@dataclass(frozen=True)
class HexGrid:
    lon0: float = -74.0
    lat0: float = 40.7
    area9_km2: float = 0.1

    def spacing(self, res: int) -> float:
        """Metres between neighbouring centres."""
        return math.sqrt(self.area9_km2 * 1e6 * 2 / math.sqrt(3)) * math.sqrt(7) ** (9 - res)

    def turn(self, res: int) -> float:
        return TURN if res % 2 else 0.0

    def area_km2(self, res: int) -> float:
        return self.area9_km2 * 7.0 ** (9 - res)

    @property
    def kx(self) -> float:
        return M_PER_LON * math.cos(math.radians(self.lat0))

    def point_stages(self, lon: str, lat: str, res: int) -> Stages:
        """Ends with hx_cell. A point without coordinates has no cell."""
        c, s, space = math.cos(self.turn(res)), math.sin(self.turn(res)), self.spacing(res)
        return [
            {"hx_x": f"({lon} - {num(self.lon0)}) * {num(self.kx)}", "hx_y": f"({lat} - {num(self.lat0)}) * {num(M_PER_LAT)}"},
            {"hx_u": f"hx_x * {num(c)} + hx_y * {num(s)}", "hx_b": f"(hx_y * {num(c)} - hx_x * {num(s)}) / {num(space * math.sqrt(3) / 2)}"},
            {"hx_a": f"hx_u / {num(space)} + hx_b / 2e0"},
            {"hx_q": "floor(hx_a - hx_b + 5e-1)", "hx_r": "floor(hx_b + 5e-1)", "hx_t": "floor(5e-1 - hx_a)"},
            {"hx_dq": "abs(hx_q - (hx_a - hx_b))", "hx_dr": "abs(hx_r - hx_b)", "hx_dt": "abs(hx_t + hx_a)"},
            {
                "hx_i": "case when (hx_dq > hx_dr and hx_dq > hx_dt) or hx_dr > hx_dt then -hx_t else hx_q + hx_r end",
                "hx_j": "case when hx_dq > hx_dr and hx_dq > hx_dt then hx_r when hx_dr > hx_dt then -hx_q - hx_t else hx_r end",
            },
            {"hx_cell": pack(res, "hx_i", "hx_j")},
        ]

    def with_cell(self, df: DataFrame, lon: str = "lon", lat: str = "lat", res: int = 9, name: str = "cell") -> DataFrame:
        return apply(df, self.point_stages(lon, lat, res), {name: "hx_cell"})

    def centre(self, cell: str, res: int) -> tuple[str, str]:
        """Longitude and latitude of a cell's centre, as SQL text."""
        return self.centre_of(i_of(cell), j_of(cell), res)

    def centre_of(self, i: str, j: str, res: int) -> tuple[str, str]:
        c, s, space = math.cos(self.turn(res)), math.sin(self.turn(res)), self.spacing(res)
        # no divisions: what is made of a cell that is never null is then never null, and no test of it is pushed down
        u = f"({num(space)} * (({i}) - ({j}) * 5e-1))"
        v = f"({num(space * math.sqrt(3) / 2)} * ({j}))"
        x, y = f"({u} * {num(c)} - {v} * {num(s)})", f"({u} * {num(s)} + {v} * {num(c)})"
        return f"({num(self.lon0)} + {x} * {num(1 / self.kx)})", f"({num(self.lat0)} + {y} * {num(1 / M_PER_LAT)})"

    def corners(self, res: int) -> list[tuple[float, float]]:
        """Offsets of the six corners from the centre, in degrees."""
        radius = self.spacing(res) / math.sqrt(3)
        angles = [self.turn(res) + math.radians(30 + 60 * k) for k in range(6)]
        return [(radius * math.cos(a) / self.kx, radius * math.sin(a) / M_PER_LAT) for a in angles]

    def boundary(self, cell: Column, res: int) -> Column:
        """The closed ring of a cell: seven points, the first again at the end."""
        i = (F.shiftright(cell, 28).bitwiseAND(268435455) - HALF).cast("double")
        j = (cell.bitwiseAND(268435455) - HALF).cast("double")
        c, s, space = math.cos(self.turn(res)), math.sin(self.turn(res)), self.spacing(res)
        u, v = (i - j / 2) * space, j * (space * math.sqrt(3) / 2)
        x = (u * c - v * s) / self.kx + self.lon0
        y = (u * s + v * c) / M_PER_LAT + self.lat0
        ring = self.corners(res)
        return F.array(*[F.struct((x + dx).alias("x"), (y + dy).alias("y")) for dx, dy in [*ring, ring[0]]])

    def parent_stages(self, cell: str, res: int, to: int) -> Stages:
        """One level at a time from res up to ``to``: whole lattice coordinates, packed into hx_p<level> for each level.

        At or above res the cell itself.
        """
        if to >= res:
            return [{f"hx_p{to}": cell}]
        out = [{f"hx_i{res}": i_of(cell), f"hx_j{res}": j_of(cell)}]
        for r in range(res, to, -1):
            i, j = f"hx_i{r}", f"hx_j{r}"
            a, b = (f"3 * {i} - {j}", f"{i} + 2 * {j}") if r % 2 else (f"2 * {i} + {j}", f"3 * {j} - {i}")
            out.append({f"hx_i{r - 1}": f"cast(floor((2 * ({a}) + 7) / 14e0) as bigint)", f"hx_j{r - 1}": f"cast(floor((2 * ({b}) + 7) / 14e0) as bigint)"})
        out.append({f"hx_p{r}": pack(r, f"hx_i{r}", f"hx_j{r}") for r in range(res - 1, to - 1, -1)})
        return out

    def with_parent(self, df: DataFrame, res: int, to: int, cell: str = "cell", name: str = "parent") -> DataFrame:
        return apply(df, self.parent_stages(cell, res, to), {name: f"hx_p{to}"})

    def with_ancestors(self, df: DataFrame, res: int, levels: list[int], cell: str = "cell") -> DataFrame:
        """A row for each row of df and each of the levels: coarse_res, parent."""
        stages = self.parent_stages(cell, res, min(levels))
        x = apply(df, stages)
        pairs = F.array(*[F.struct(F.lit(r).alias("coarse_res"), F.col(f"hx_p{r}" if r < res else cell).alias("parent")) for r in levels])
        return x.select(*[F.col(f"`{c}`") for c in df.columns], F.explode(pairs).alias("hx")).select(*[F.col(f"`{c}`") for c in df.columns], "hx.*")

    def children(self, df: DataFrame, res: int, to: int, cell: str = "cell", name: str = "child") -> DataFrame:
        """A row for each descendant at resolution ``to``; a cell at or below it stays."""
        x = df.withColumn(name, F.col(cell))
        for r in range(res + 1, to + 1):
            seven = F.array(*[F.expr(pack(r, a, b)) for a, b in children_of(i_of(name), j_of(name), r)])
            x = x.withColumn(name, F.explode(seven))
        return x

    def disk(self, df: DataFrame, k: int, cell: str = "cell", name: str = "near") -> DataFrame:
        """A row for each cell within k steps, the cell itself included."""
        return df.withColumn(name, F.explode(F.array(*[F.col(cell) + ((a << 28) + b) for a, b in disk_offsets(k)])))

    def cover_window(self, box: tuple[float, float, float, float], res: int) -> tuple[int, int, int, int]:
        """Bounds of i and j that hold every cell whose centre lies in the box (west, south, east, north)."""
        c, s, space = math.cos(self.turn(res)), math.sin(self.turn(res)), self.spacing(res)
        found = []
        for lon in (box[0], box[2]):
            for lat in (box[1], box[3]):
                x, y = (lon - self.lon0) * self.kx, (lat - self.lat0) * M_PER_LAT
                b = (y * c - x * s) / (space * math.sqrt(3) / 2)
                found.append(((x * c + y * s) / space + b / 2, b))
        i, j = [f[0] for f in found], [f[1] for f in found]
        return math.floor(min(i)) - 1, math.ceil(max(i)) + 1, math.floor(min(j)) - 1, math.ceil(max(j)) + 1

    def cover(self, spark, box: tuple[float, float, float, float], res: int) -> DataFrame:
        """The cells whose centre lies in the box: cell, lon, lat."""
        i0, i1, j0, j1 = self.cover_window(box, res)
        wide = j1 - j0 + 1
        x = spark.range((i1 - i0 + 1) * wide).select(F.expr(f"{i0} + id div {wide}").alias("i"), F.expr(f"{j0} + id % {wide}").alias("j"))
        # positions come from i and j: what is said of a cell's position would be inferred for the cells it is joined with
        lon, lat = self.centre_of("i", "j", res)
        x = x.select(F.expr(pack(res, "i", "j")).alias("cell"), F.expr(lon).alias("lon"), F.expr(lat).alias("lat"))
        return x.where(F.col("lon").between(box[0], box[2]) & F.col("lat").between(box[1], box[3]))


GRID = HexGrid()
