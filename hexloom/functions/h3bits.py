"""Resolution, parents and children of ids in the public H3 index layout, by bit arithmetic on a BIGINT.

Bits 52 to 55 hold the resolution; each level has a digit of three bits, the first level's at bit 42 and each further
one's three bits lower; digits below the resolution are 7.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The twelve base cells that are pentagons; they have no child digit 1.
PENTAGONS = [4, 14, 24, 38, 49, 58, 63, 72, 83, 97, 107, 117]
RES_MASK = 15 << 52


def from_hex(text: Column) -> Column:
    return F.conv(text, 16, 10).cast("bigint")


def to_hex(cell: Column) -> Column:
    return F.lower(F.hex(cell))


def resolution(cell: Column) -> Column:
    return F.shiftright(cell, 52).bitwiseAND(15).cast("int")


def parent(cell: Column, res: Column | int) -> Column:
    """The ancestor at res; a cell at or above it stays."""
    to = F.lit(res).cast("int") if isinstance(res, int) else res.cast("int")
    level = to.cast("bigint")
    unused = (F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.lit(45) - 3 * to)) - 1).cast("bigint")
    up = F.call_function("shiftleft", level, F.lit(52)).bitwiseOR(cell.bitwiseAND(~RES_MASK & ((1 << 63) - 1))).bitwiseOR(unused)
    return F.when(resolution(cell) <= to, cell).otherwise(up)


def base_cell(cell: Column) -> Column:
    return F.shiftright(cell, 45).bitwiseAND(127).cast("int")


def is_pentagon(cell: Column) -> Column:
    """A pentagon: a pentagon base cell whose digits are all 0 down to its resolution."""
    used = F.call_function("shiftleft", F.lit(1).cast("bigint"), 3 * resolution(cell)) - 1
    digits = F.call_function("shiftright", cell, F.lit(45) - 3 * resolution(cell)).bitwiseAND(used)
    return base_cell(cell).isin(PENTAGONS) & (digits == 0)


def children_once(cell: Column) -> Column:
    """The array of children one level down: seven, six of a pentagon."""
    res = resolution(cell)
    at = F.lit(42) - 3 * res
    clear = cell.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(7).cast("bigint"), at)))
    down = clear + F.lit(1 << 52)
    digits = F.when(is_pentagon(cell), F.array(*[F.lit(d) for d in (0, 2, 3, 4, 5, 6)])).otherwise(F.array(*[F.lit(d) for d in range(7)]))
    return F.transform(digits, lambda d: down.bitwiseOR(F.call_function("shiftleft", d.cast("bigint"), at)))


def ancestors(cell: Column) -> Column:
    """The cell and all coarser cells that hold it, finest first."""
    return F.transform(F.sequence(resolution(cell), F.lit(0), F.lit(-1)), lambda r: parent(cell, r))
