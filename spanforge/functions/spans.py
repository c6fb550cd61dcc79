"""Scalar interval algebra over Columns: a span is two doubles, closed, in one unit of time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def overlap(a0, a1, b0, b1) -> Column:
    """Length that two spans share; 0 if they only touch, NULL if a bound is missing."""
    a0, a1, b0, b1 = map(col, (a0, a1, b0, b1))
    known = a0.isNotNull() & a1.isNotNull() & b0.isNotNull() & b1.isNotNull()
    return F.when(known, F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0)))


def iou(a0, a1, b0, b1) -> Column:
    """Shared length over joint length; 0 for disjoint, touching and empty spans."""
    both = overlap(a0, a1, b0, b1)
    joint = (col(a1) - col(a0)) + (col(b1) - col(b0)) - both
    return F.when(both.isNull(), None).when((both <= 0) | (joint <= 0), 0.0).otherwise(both / joint)


def within(a0, a1, b0, b1, tolerance: float) -> Column:
    """Whether both ends lie within the tolerance of each other."""
    return (F.abs(col(a0) - col(b0)) <= tolerance) & (F.abs(col(a1) - col(b1)) <= tolerance)


def problem(class_name, t0, t1, classes: list[str]) -> Column:
    """Why a row is no valid event; NULL if it is one. No bounds at all are allowed."""
    c, a, b = map(col, (class_name, t0, t1))
    return (
        F.when(c.isNull() | ~c.isin(classes), "unknown class")
        .when(a.isNull() != b.isNull(), "one bound missing")
        .when(F.isnan(a) | F.isnan(b), "not a number")
        .when(b <= a, "ends before it starts")
    )


def ratio(part: Column, whole: Column, empty=1.0) -> Column:
    """part / whole; `empty` (or NULL) where the whole is 0."""
    return F.when(whole == 0, F.lit(empty).cast("double")).otherwise(part / F.nullif(whole, F.lit(0)))


def precision(tp, fa, empty=1.0) -> Column:
    return ratio(col(tp), col(tp) + col(fa), empty)


def recall(tp, miss, empty=1.0) -> Column:
    return ratio(col(tp), col(tp) + col(miss), empty)


def f1(tp, fa, miss) -> Column:
    p, r = precision(tp, fa), recall(tp, miss)
    return F.when(p + r == 0, 0.0).otherwise(2 * p * r / F.nullif(p + r, F.lit(0.0)))


Credit = Callable[[Column, Column, Column], Column]


def credit_f1(tp: Column, fa: Column, miss: Column) -> Column:
    clean = (fa == 0) & (miss == 0)
    return F.when(tp == 0, clean.cast("double")).otherwise(2.0 * tp / (2 * tp + fa + miss))


def credit_exact(tp: Column, fa: Column, miss: Column) -> Column:
    return ((fa == 0) & (miss == 0)).cast("double")


def credit_recall(tp: Column, fa: Column, miss: Column) -> Column:
    return F.when(tp + miss == 0, (fa == 0).cast("double")).otherwise(ratio(tp, tp + miss))


def confident(confidence, least: float, per_class: dict[str, float] | None = None, class_name="class_name") -> Column:
    """Confidence filter; a class may ask for more than the common least."""
    asked = F.lit(least)
    if per_class:
        table = F.create_map(*[F.lit(x) for kv in per_class.items() for x in kv])
        asked = F.greatest(asked, F.coalesce(F.element_at(table, col(class_name)), F.lit(0.0)))
    return col(confidence) >= asked


def nearest_rank(values, q: float) -> Column:
    """The element of a collected list at rank int(q (n - 1)) of its order; not an interpolated percentile."""
    xs = F.sort_array(col(values))
    return F.element_at(xs, F.floor(q * (F.size(xs) - 1)).cast("int") + 1)


def sample_times(t0, t1, n: int) -> Column:
    """n times, evenly spaced inside the span."""
    a, length = col(t0), F.greatest(col(t1) - col(t0), F.lit(1e-3))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: a + length * (i + 0.5) / n)


def clamp_span(t0, t1, duration, least: float = 0.5) -> tuple[Column, Column]:
    """A span cut to the duration and at least `least` long where the duration allows it."""
    d = col(duration)
    a = F.least(F.greatest(F.lit(0.0), col(t0)), F.greatest(F.lit(0.0), d - least))
    b = F.least(col(t1), d)
    return a, F.when(b <= a, F.least(d, a + least)).otherwise(b)


def timecode(t) -> Column:
    """m:ss.s"""
    t = col(t)
    return F.format_string("%d:%04.1f", F.floor(t / 60).cast("int"), t - 60 * F.floor(t / 60))
