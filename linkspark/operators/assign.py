"""Optimal one-to-one assignment of two lists, as a join: pairs, unmatched items, and enrichment of the matched."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkspark.functions.distance import COST_STEPS

ASSIGNMENT = "struct<left_idx:array<int>,right_idx:array<int>,cost:array<double>,unmatched:array<int>,unmatched_side:string>"


def hungarian(cost: np.ndarray) -> np.ndarray:
    """Column of each row in an assignment of least total cost; there must not be more rows than columns.

    Shortest augmenting paths with potentials, O(rows² · columns).
    """
    n, m = cost.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    row_of = np.zeros(m + 1, dtype=np.int64)
    for i in range(1, n + 1):
        row_of[0], j = i, 0
        least = np.full(m + 1, np.inf)
        came = np.zeros(m + 1, dtype=np.int64)
        used = np.zeros(m + 1, dtype=bool)
        while True:
            used[j] = True
            i0 = row_of[j]
            free = ~used[1:]
            reduced = cost[i0 - 1] - u[i0] - v[1:]
            better = free & (reduced < least[1:])
            least[1:][better] = reduced[better]
            came[1:][better] = j
            j1 = 1 + int(np.where(free, least[1:], np.inf).argmin())
            delta = least[j1]
            u[row_of[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j = j1
            if row_of[j] == 0:
                break
        while j:
            row_of[j], j = row_of[came[j]], came[j]
    out = np.full(n, -1, dtype=np.int64)
    for j in range(1, m + 1):
        if row_of[j]:
            out[row_of[j] - 1] = j - 1
    return out


def solve(flat: np.ndarray, n: int, m: int) -> dict:
    """Assignment of n left and m right items by their distances, row by row; costs are quantised before."""
    if n == 0 or m == 0:
        side, rest = ("left", list(range(n))) if n > m else ("right", list(range(m)))
        return {"left_idx": [], "right_idx": [], "cost": [], "unmatched": rest, "unmatched_side": side}
    cost = np.floor(np.asarray(flat, dtype=np.float64).reshape(n, m) * COST_STEPS)
    if n <= m:
        right = hungarian(cost)
        left = np.arange(n)
    else:
        left = hungarian(cost.T)
        right = np.arange(m)
        order = np.argsort(left)
        left, right = left[order], right[order]
    if n > m:
        side, rest = "left", sorted(set(range(n)) - set(left.tolist()))
    else:
        side, rest = "right", sorted(set(range(m)) - set(right.tolist()))
    return {"left_idx": left.tolist(), "right_idx": right.tolist(), "cost": (cost[left, right] / COST_STEPS).tolist(), "unmatched": rest, "unmatched_side": side}


def _solved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        b["a"] = [solve(f, int(n), int(m)) for f, n, m in zip(b["_matrix"], b["_n"], b["_m"])]
        yield b.drop(columns=["_matrix", "_n", "_m"])


def assignment(df: DataFrame, keys: list[str], left: str, right: str, distance) -> DataFrame:
    """keys, a: the optimal assignment of two array columns; ``distance`` maps two items to a Column of 0 to 1.

    The matrix is built by higher-order functions in the JVM, so that a batch of pairs goes to Python as numbers. An
    empty side leaves the other unmatched; with equal sizes nothing is unmatched and the side is "right".
    """
    matrix = F.flatten(F.transform(left, lambda x: F.transform(right, lambda y: distance(x, y))))
    rows = df.select(*keys, matrix.alias("_matrix"), F.size(left).alias("_n"), F.size(right).alias("_m"))
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    return rows.mapInPandas(_solved, f"{kinds}, a {ASSIGNMENT}")


def matched_mean(a: Column) -> Column:
    """Mean cost of the matched pairs; null without pairs."""
    return F.when(F.size(a["cost"]) > 0, F.aggregate(a["cost"], F.lit(0.0), lambda s, x: s + x) / F.size(a["cost"]))


def pairs(df: DataFrame, keys: list[str], a: str) -> DataFrame:
    """keys, left_idx, right_idx, cost: one row per matched pair."""
    zipped = F.arrays_zip(F.col(a)["left_idx"].alias("left_idx"), F.col(a)["right_idx"].alias("right_idx"), F.col(a)["cost"].alias("cost"))
    return df.select(*keys, F.inline(zipped))


def unmatched(df: DataFrame, keys: list[str], a: str) -> DataFrame:
    """keys, side, idx: one row per item without counterpart."""
    return df.select(*keys, F.col(a)["unmatched_side"].alias("side"), F.explode(F.col(a)["unmatched"]).alias("idx"))


def enriched(items: DataFrame, matched: DataFrame, source: DataFrame, keys: list[str], fields: list[str], keep_existing: bool = False) -> DataFrame:
    """Matched items with the fields of their counterparts; a null there clears the item's value unless it is kept.

    Items without counterpart are dropped. ``items`` has keys and left_idx, ``source`` keys and right_idx, both fields.
    """
    new = source.select(*keys, "right_idx", *[F.col(f).alias(f"_new_{f}") for f in fields])
    joined = items.join(matched.select(*keys, "left_idx", "right_idx"), [*keys, "left_idx"]).join(new, [*keys, "right_idx"])
    for f in fields:
        joined = joined.withColumn(f, F.coalesce(f"_new_{f}", f) if keep_existing else F.col(f"_new_{f}"))
    return joined.drop(*[f"_new_{f}" for f in fields])
