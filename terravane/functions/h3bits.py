"""Real H3 cell ids: resolution, parent, children, base cell, pentagons and text, by bit arithmetic alone.

The public layout of an id, from the top: one zero bit, mode (4 bits, 1 for cells), three zero bits, resolution (4), base
cell (7) and fifteen digits of three bits, 7 where the resolution is coarser. Turning a point into an id needs the
projection tables, which are not here; ``hexgrid`` is the lattice that the engine lays itself.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the base cells that are pentagons
PENTAGONS = (4, 14, 24, 38, 49, 58, 63, 72, 83, 97, 107, 117)


def resolution(cell: Column) -> Column:
    return F.shiftrightunsigned(cell, 52).bitwiseAND(F.lit(15)).cast("int")


def base_cell(cell: Column) -> Column:
    return F.shiftrightunsigned(cell, 45).bitwiseAND(F.lit(127)).cast("int")


def digit(cell: Column, r: int) -> Column:
    """The digit of resolution ``r``, 1 to 15."""
    return F.shiftrightunsigned(cell, 3 * (15 - r)).bitwiseAND(F.lit(7)).cast("int")


def parent(cell: Column, r: int) -> Column:
    """The cell's ancestor of resolution ``r``; NULL if the cell is coarser."""
    unused, level = (1 << 3 * (15 - r)) - 1, 15 << 52
    up = cell.bitwiseAND(F.lit(~level)).bitwiseOR(F.lit(r << 52)).bitwiseOR(F.lit(unused))
    return F.when(resolution(cell) >= r, up)


def is_pentagon(cell: Column) -> Column:
    used = F.expr("true")
    for r in range(1, 16):
        used = used & ((F.lit(r) > resolution(cell)) | (digit(cell, r) == 0))
    return base_cell(cell).isin(*PENTAGONS) & used


def children(cell: Column, r: int) -> Column:
    """The seven cells one finer than a cell of resolution ``r``; a pentagon has six, as digit 1 is left out."""
    place = 3 * (14 - r)
    first = cell.bitwiseAND(F.lit(~((15 << 52) | (7 << place)))).bitwiseOR(F.lit((r + 1) << 52))
    each = F.array(*(first.bitwiseOR(F.lit(d << place)) for d in range(7)))
    six = F.array(*(first.bitwiseOR(F.lit(d << place)) for d in range(7) if d != 1))
    return F.when(resolution(cell) == r, F.when(is_pentagon(cell), six).otherwise(each))


def is_cell(cell: Column) -> Column:
    """Whether mode, zero bits, base cell and digits are those of a cell; the pentagons' missing digit is not looked at."""
    ok = (F.shiftrightunsigned(cell, 59) == 1) & (F.shiftrightunsigned(cell, 56).bitwiseAND(F.lit(7)) == 0) & (base_cell(cell) < 122)
    for r in range(1, 16):
        ok = ok & F.when(F.lit(r) <= resolution(cell), digit(cell, r) < 7).otherwise(digit(cell, r) == 7)
    return F.coalesce(ok, F.lit(False))


def to_text(cell: Column) -> Column:
    return F.lower(F.hex(cell))


def from_text(text: Column) -> Column:
    return F.conv(text, 16, -10).cast("long")
