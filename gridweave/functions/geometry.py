"""Geometry as column expressions: scales, frames, points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def resize_scale(w: Column, h: Column, mode: str, value: float, other: float = 0.0) -> Column:
    """Scale to a width, height, box, long or short edge, or as given; nearly 1 is 1."""
    s = {"width": value / w, "height": value / h, "box": F.least(value / w, other / h), "long": value / F.greatest(w, h), "short": value / F.least(w, h), "scale": F.lit(value)}[mode]
    return F.when(F.abs(s - 1) <= 1e-5, 1.0).otherwise(s)


def frame_size(w: Column, h: Column, border: float) -> tuple[Column, Column]:
    """Size with a border that is a share of the short edge."""
    edge = 2 * F.floor(F.least(w, h) * border + 0.5)
    return w + edge, h + edge


def auto_crop(w: Column, h: Column, fill: Column, aspect: float | None = None) -> tuple[Column, Column]:
    """The centred rectangle of a scale, reduced to an aspect ratio."""
    cw, ch = F.floor(w * fill), F.floor(h * fill)
    if aspect is None:
        return cw, ch
    return F.least(cw, F.floor(ch * aspect)), F.least(ch, F.floor(cw / aspect))


def polar(y: Column, x: Column) -> tuple[Column, Column]:
    return F.hypot(x, y), F.atan2(y, x)


def cartesian(r: Column, angle: Column) -> tuple[Column, Column]:
    return r * F.sin(angle), r * F.cos(angle)


def transform(y: Column, x: Column, size: int, angle: float, distortion: float, scale: float = 1.0) -> tuple[Column, Column]:
    """Where a place of the result comes from: turned about the centre, scaled, and moved along the radius by its square."""
    from math import cos, sin

    c = (size - 1) / 2
    u, v = (x - c) / scale, (y - c) / scale
    xr, yr = u * cos(angle) - v * sin(angle), u * sin(angle) + v * cos(angle)
    factor = 1 + distortion * (xr * xr + yr * yr) / (c * c)
    return yr * factor + c, xr * factor + c


def tile_count(length: Column, tile: int, overlap: int) -> tuple[Column, Column]:
    """Tiles that cover a length, and their even step: an image that a tile holds is one tile; else as many as fit with the overlap."""
    n = F.when(length <= tile, 1).otherwise(F.ceil((length - overlap) / F.lit(float(tile - overlap)))).cast("int")
    step = F.ceil((length - overlap) / n)
    return n, F.when(n == 1, length).otherwise(step + step % 2).cast("int")
