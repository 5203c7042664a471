"""Null-aware comparison of two values: what is missing on which side, and the distance if nothing is."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BOTH_MISSING, ADDED, REMOVED, BOTH_PRESENT = "both_missing", "added", "removed", "both_present"


def difference(left: Column, right: Column, distance: Callable[[Column, Column], Column]) -> Column:
    """struct<state, dist>; ``removed`` is a left value alone, ``added`` a right one; dist is null unless both are present."""
    state = F.when(left.isNull() & right.isNull(), BOTH_MISSING).when(left.isNull(), ADDED).when(right.isNull(), REMOVED).otherwise(BOTH_PRESENT)
    return F.struct(state.alias("state"), F.when(left.isNotNull() & right.isNotNull(), distance(left, right)).cast("double").alias("dist"))


def to_distance(diff: Column) -> Column:
    """0 if both are missing, 1 if one is, else the distance."""
    return F.when(diff["state"] == BOTH_MISSING, F.lit(0.0)).when(diff["state"] != BOTH_PRESENT, F.lit(1.0)).otherwise(diff["dist"])


def distance_if_present(diff: Column) -> Column:
    return diff["dist"]


def is_present_left(diff: Column) -> Column:
    return diff["state"].isin(REMOVED, BOTH_PRESENT)


def is_equal(diff: Column) -> Column:
    return (diff["state"] == BOTH_MISSING) | F.coalesce(diff["dist"] == 0, F.lit(False))


def between_or_minmax(left: Column, right: Column, distance: Callable[[Column, Column], Column]) -> Column:
    return to_distance(difference(left, right, distance))


def bool_distance(equal: Column) -> Column:
    """0 for equal, 1 for different."""
    return F.when(equal, F.lit(0.0)).otherwise(F.lit(1.0))


def ratio_distance(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def number_distance(a: Column, b: Column) -> Column:
    """0 for equal numbers, 1 for others."""
    return bool_distance(a == b)
