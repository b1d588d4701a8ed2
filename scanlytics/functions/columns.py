"""Column functions: numbers from text, transforms, circular differences, buckets. All built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_int(x: Column) -> Column:
    """The number in ``x`` cut towards zero; 0 where there is none."""
    number = F.when(x.cast("string").rlike(r"^\s*[-+]?[0-9]"), x.try_cast("double"))
    return F.coalesce(number.try_cast("int"), F.lit(0))


def yaw_deg(t: Column) -> Column:
    """Rotation about y of a column-major 4 x 4 transform, in degrees."""
    return F.degrees(F.atan2(t[8], t[0]))


def translation(t: Column) -> Column:
    return F.struct(t[12].alias("x"), t[13].alias("y"), t[14].alias("z"))


def rotation_angle_deg(a: Column, b: Column) -> Column:
    """Angle of the rotation between two transforms: the trace is the sum of the nine products of the 3 x 3 parts."""
    trace = sum((a[i] * b[i] for i in (0, 1, 2, 4, 5, 6, 8, 9, 10)), F.lit(0.0))
    return F.degrees(F.acos(F.least(F.greatest((trace - 1) / 2, F.lit(-1.0)), F.lit(1.0))))


def circular_difference(a: Column, b: Column, period: float = 360.0) -> Column:
    """Least distance of two angles on a circle of ``period`` degrees (180 for axes, 90 for right-angled grids)."""
    apart = F.pmod(a - b, F.lit(float(period)))
    return F.abs(F.least(apart, period - apart))


def bin_right_closed(x: Column, edges: list[float]) -> Column:
    """``<= e`` for the first edge that is not below ``x``, ``> e`` beyond the last, ``nan`` for null and NaN."""
    out = F.when(x.isNull() | F.isnan(x.cast("double")), "nan")
    for e in edges:
        out = out.when(x <= e, f"<= {e:g}")
    return out.otherwise(f"> {edges[-1]:g}")


def bin_left_closed(x: Column, edges: list[float], labels: list[str]) -> Column:
    """The label of the first edge above ``x``; the last label (one more than edges) is for all the rest. Null stays null."""
    if len(labels) != len(edges) + 1:
        raise ValueError("one label more than edges")
    out = F.when(x.isNull(), F.lit(None).cast("string"))
    for e, label in zip(edges, labels):
        out = out.when(x < e, label)
    return out.otherwise(labels[-1])
