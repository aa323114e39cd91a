"""Boxes, colours and layout arithmetic as Columns. A box is a struct or prefix of left, top, right and bottom."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(prefix: str = "") -> dict[str, Column]:
    return {k: F.col(f"{prefix}{k}") for k in ("left", "top", "right", "bottom")}


def area(b: dict[str, Column]) -> Column:
    return F.greatest(F.lit(0.0), b["right"] - b["left"]) * F.greatest(F.lit(0.0), b["bottom"] - b["top"])


def overlap_ratio(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Shared area over the smaller area; 0 if that is 0."""
    w = F.greatest(F.lit(0.0), F.least(a["right"], b["right"]) - F.greatest(a["left"], b["left"]))
    h = F.greatest(F.lit(0.0), F.least(a["bottom"], b["bottom"]) - F.greatest(a["top"], b["top"]))
    least = F.least(area(a), area(b))
    return F.when(least > 0, w * h / least).otherwise(0.0)


def center_inside(a: dict[str, Column], b: dict[str, Column]) -> Column:
    x, y = (a["left"] + a["right"]) / 2, (a["top"] + a["bottom"]) / 2
    return x.between(b["left"], b["right"]) & y.between(b["top"], b["bottom"])


def horizontal_overlap(a: dict[str, Column], b: dict[str, Column]) -> Column:
    shared = F.greatest(F.lit(0.0), F.least(a["right"], b["right"]) - F.greatest(a["left"], b["left"]))
    least = F.least(F.greatest(F.lit(0.0), a["right"] - a["left"]), F.greatest(F.lit(0.0), b["right"] - b["left"]))
    return F.when(least > 0, shared / least).otherwise(0.0)


def vertical_gap(a: dict[str, Column], b: dict[str, Column]) -> Column:
    return F.when(a["bottom"] < b["top"], b["top"] - a["bottom"]).when(b["bottom"] < a["top"], a["top"] - b["bottom"]).otherwise(0.0)


def rgb(c: Column) -> tuple[Column, Column, Column]:
    return tuple(F.shiftright(c, k).bitwiseAND(F.lit(255)) / 255.0 for k in (16, 8, 0))


def luminance(c: Column) -> Column:
    r, g, b = rgb(c)
    return 0.2126 * r + 0.7152 * g + 0.0722 * b


def snapped_rotation(x: Column, y: Column, within: float = 2.0) -> Column:
    """The direction (x, y) in degrees, at a right angle if within so many degrees of it."""
    d = F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))
    out = F.round(d, 4)
    for right in (360, 270, 180, 90, 0):
        out = F.when(F.abs(d - right) <= within, F.lit(float(right % 360))).otherwise(out)
    return out


def layout_limit(units: Column, spaces: Column) -> Column:
    return F.greatest((units + spaces * 0.25) * 0.9, F.lit(1.0))


def shrunk_size(ratio: Column, size: Column) -> Column:
    """Font size for a text that is `ratio` times as long: from 1.3 on, not below 0.85 of it or 10, and only for half a point."""
    new = F.greatest(size / ratio, size * 0.85, F.lit(10.0))
    return F.when((ratio > 1.3) & (size - new >= 0.5), new).otherwise(size)
