"""Flat-top hexagon grid as column arithmetic: axial id and centre of a point's hexagon."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import col

# Side lengths offered by default, in metres.
DEFAULT_SIDES_M = (50, 100, 200, 400, 800)

# The hexagon itself and its six neighbours, as axial offsets.
HEX_AND_NEIGHBOURS = ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1), (1, -1), (-1, 1))


def hex_of(x, y, side: float, x0: float = 0.0, y0: float = 0.0) -> tuple[Column, Column]:
    """Axial (q, r) of the hexagon of side ``side`` that holds (x, y)."""
    px = (col(x).cast("double") - F.lit(float(x0))) / F.lit(float(side))
    py = (col(y).cast("double") - F.lit(float(y0))) / F.lit(float(side))
    q = px * F.lit(2.0 / 3.0)
    r = py * F.lit(math.sqrt(3.0) / 3.0) - px * F.lit(1.0 / 3.0)
    s = -q - r
    rq, rr, rs = (F.floor(v + F.lit(0.5)).cast("double") for v in (q, r, s))
    eq, er, es = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
    fix_q = (eq > er) & (eq > es)
    fix_r = ~fix_q & (er > es)
    return (
        F.when(fix_q, -rr - rs).otherwise(rq).cast("long"),
        F.when(fix_r, -rq - rs).otherwise(rr).cast("long"),
    )


def hex_centre(q, r, side: float, x0: float = 0.0, y0: float = 0.0) -> tuple[Column, Column]:
    q, r = col(q).cast("double"), col(r).cast("double")
    cx = F.lit(float(x0)) + F.lit(float(side)) * F.lit(1.5) * q
    cy = F.lit(float(y0)) + F.lit(float(side)) * F.lit(math.sqrt(3.0)) * (r + q / F.lit(2.0))
    return cx, cy
