"""A ladder of grids for turning box and containment tests into equi-joins.

Rung ``k`` has cells of ``4^k`` degrees, chosen separately for the two axes, so that a
wide and flat box (a polar search box, one band of a large polygon) still touches few
cells.  A rung and a cell are packed into one ``bigint``: joins on it use the compact
long-keyed hash table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_RUNG = -8  # 4^-8 degrees, under two metres
MAX_RUNG = 4  # 4^4 degrees, wider than the globe
RUNGS = MAX_RUNG - MIN_RUNG + 1

_AXIS_BITS = 27
_AXIS_SHIFT = 1 << (_AXIS_BITS - 1)


def _rung(extent: str, finer: int) -> str:
    exact = f"cast(ceil(log2(greatest({extent}, 1e-9D)) / 2) AS int) - {finer}"
    return f"least(greatest({exact}, {MIN_RUNG}), {MAX_RUNG})"


def rung(extent: str, finer: int) -> Column:
    """Rung whose cell is at most ``extent`` wide, so that a box touches 2 to 5 cells per
    axis (``finer=1``), or at least as wide, so that it touches at most 2
    (``finer=0``).  ``extent`` is SQL text."""
    return F.expr(_rung(extent, finer))


def split_pair(pair: int) -> tuple[int, int]:
    """The rungs of both axes from their combined number."""
    return pair // RUNGS + MIN_RUNG, pair % RUNGS + MIN_RUNG


def join_pair(x_rung: int, y_rung: int) -> int:
    return (x_rung - MIN_RUNG) * RUNGS + (y_rung - MIN_RUNG)


def _pack(pair: str, cx: str, cy: str) -> str:
    return (
        f"(shiftleft(cast({pair} AS bigint), {2 * _AXIS_BITS}) "
        f"+ shiftleft({cx} + {_AXIS_SHIFT}L, {_AXIS_BITS}) + ({cy} + {_AXIS_SHIFT}L))"
    )


def _cell_at(pair: int, x: str, y: str) -> str:
    kx, ky = split_pair(pair)
    return _pack(str(pair), f"floor({x} * {4.0**-kx}D)", f"floor({y} * {4.0**-ky}D)")


def cell_at(pair: int, x: str, y: str) -> Column:
    """Cell of one position on a given rung pair; positions are SQL text."""
    return F.expr(_cell_at(pair, x, y))


def cells_at(pairs: list[int], x: str, y: str) -> Column:
    """Cells of one position on several rung pairs."""
    return F.expr(f"array({', '.join(_cell_at(p, x, y) for p in pairs)})")


def with_rungs(
    df: DataFrame,
    box: tuple[str, str, str, str],
    finer: int,
    extent: tuple[str, str] | None = None,
) -> DataFrame:
    """Add ``rungs`` and the cell ranges of a box ``(xmin, xmax, ymin, ymax)``.

    ``extent``, SQL text of a width and a height, overrides the size the rungs are
    chosen by, where boxes of slightly different size must share one."""
    xmin, xmax, ymin, ymax = box
    width, height = extent or (f"{xmax} - {xmin}", f"{ymax} - {ymin}")
    df = df.withColumns({"_kx": rung(width, finer), "_ky": rung(height, finer)})
    added = {
        "rungs": f"(_kx - {MIN_RUNG}) * {RUNGS} + (_ky - {MIN_RUNG})",
        "_cx0": f"floor({xmin} * pow(4D, -_kx))",
        "_cx1": f"floor({xmax} * pow(4D, -_kx))",
        "_cy0": f"floor({ymin} * pow(4D, -_ky))",
        "_cy1": f"floor({ymax} * pow(4D, -_ky))",
    }
    return df.withColumns({c: F.expr(text) for c, text in added.items()}).drop("_kx", "_ky")


def covered_cells() -> Column:
    """All cells of a box prepared by :func:`with_rungs`."""
    return F.expr(
        "flatten(transform(sequence(_cx0, _cx1), cx -> "
        f"transform(sequence(_cy0, _cy1), cy -> {_pack('rungs', 'cx', 'cy')})))"
    )


def covered_count() -> Column:
    return F.expr("(_cx1 - _cx0 + 1) * (_cy1 - _cy0 + 1)")


SCRATCH = ("rungs", "_cx0", "_cx1", "_cy0", "_cy1")
