"""Predicates on intervals as columns.

Lengths are ``rb - lb``, without the end; ratios are single precision, as exact
ties between whole lengths and thresholds do occur.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def f32(c: Column | float) -> Column:
    return (c if isinstance(c, Column) else F.lit(c)).cast("float")


def ratio(a: Column, b: Column) -> Column:
    """a / b in single precision; where b is 0: infinity, or null (never over a threshold) if a is 0 too."""
    return F.when(b != 0, f32(f32(a) / f32(b))).when(a > 0, F.lit(float("inf")).cast("float")).when(a < 0, F.lit(float("-inf")).cast("float"))


def overlap(lb1: Column, rb1: Column, lb2: Column, rb2: Column) -> Column:
    return F.least(rb1, rb2) - F.greatest(lb1, lb2)


def covers(lb1: Column, rb1: Column, lb2: Column, rb2: Column, cutoff: float, double: bool = False) -> Column:
    """Whether the overlap is ``cutoff`` of the shorter interval (or, if ``double``, of both); sequences are compared elsewhere."""
    shared = overlap(lb1, rb1, lb2, rb2)
    first, second = (F.coalesce(ratio(shared, rb - lb) >= f32(cutoff), F.lit(False)) for lb, rb in ((lb1, rb1), (lb2, rb2)))
    return first & second if double else first | second


def full_length(lb: Column, rb: Column, ele_lb: Column, ele_rb: Column, cutoff: float = 0.9, slack: int = 10) -> Column:
    """Whether an interval spans nearly all of its element; it may reach beyond."""
    share = F.coalesce(ratio(f32(rb) - f32(lb), ele_rb - ele_lb) > f32(cutoff), F.lit(False))
    return (lb - ele_lb < slack) & (rb - ele_rb > -slack) & share


def too_short(lb: Column, rb: Column, limit: int = 30) -> Column:
    return rb - lb <= limit


def collinear(lb1: Column, plb1: Column, prb1: Column, lb2: Column, plb2: Column, prb2: Column, direction: Column) -> Column:
    """Whether two alignments of one pair and direction stand in the same order on both sides."""
    step = lb1.cast("long") - lb2.cast("long")
    return F.when(direction == 1, step * (plb1.cast("long") - plb2.cast("long")) > 0).otherwise(step * (prb1.cast("long") - prb2.cast("long")) < 0)
