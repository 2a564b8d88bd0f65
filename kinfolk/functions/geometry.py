"""Image and crop arithmetic as columns (SRC5, MAP9). Casts to int truncate toward zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def scaled_size(width: Column, height: Column, max_dim: int) -> tuple[Column, Column]:
    """Size after downscaling so that the longer side is ``max_dim``; smaller images, or 0, are unchanged."""
    longest = F.greatest(width, height)
    small = F.lit(max_dim <= 0) | (longest <= max_dim)
    scale = F.lit(float(max_dim)) / longest
    return (
        F.when(small, width.cast("int")).otherwise((width * scale).cast("int")),
        F.when(small, height.cast("int")).otherwise((height * scale).cast("int")),
    )


def crop_box(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Column:
    """Struct (left, top, right, bottom, empty) of a box padded by a quarter of its sides and held to the image."""
    a, b, c, d = (v.cast("int") for v in (x1, y1, x2, y2))
    pad_x, pad_y = ((c - a) * F.lit(0.25)).cast("int"), ((d - b) * F.lit(0.25)).cast("int")
    left, top = F.greatest(F.lit(0), a - pad_x), F.greatest(F.lit(0), b - pad_y)
    right, bottom = F.least(width.cast("int"), c + pad_x), F.least(height.cast("int"), d + pad_y)
    return F.struct(
        left.alias("left"), top.alias("top"), right.alias("right"), bottom.alias("bottom"),
        ((right <= left) | (bottom <= top)).alias("empty"),
    )
