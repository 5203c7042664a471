"""Candidate generation: entities that share a clause of a query meet by equi-joins, never by comparing all with all."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def candidates(left: DataFrame, right: DataFrame, left_id: str, right_id: str, clauses: dict[str, tuple[Column, Column]], limit: int = 5, offset: int = 0) -> DataFrame:
    """left id, right id, clauses, rank: the rows of ``right`` that fulfil most clauses of each row of ``left``.

    A clause is a pair of array columns of text keys; it holds if they share one. The result is the page of ``limit``
    ranks after ``offset`` by number of clauses, then id. Null keys and "" never meet; a clause that is null on either
    side does not hold.

    Every set of clauses has compound keys of its own, and of each compound key only its first rows by id take part: a
    row behind them is behind them in the result, too, since they fulfil at least as many clauses. So a hot artist or
    a common number of tracks costs each row of ``left`` no more than that many pairs, and the result is exact.
    """
    names = list(clauses)
    most = limit + offset

    def side(df: DataFrame, id_col: str, which: int) -> DataFrame:
        keys = [F.array_distinct(F.filter(F.coalesce(clauses[n][which], F.array().cast("array<string>")), lambda k: k.isNotNull() & (k != ""))).alias(f"_{i}") for i, n in enumerate(names)]
        return df.select(F.col(id_col), *keys)

    def compound(df: DataFrame, picked: tuple[int, ...]) -> DataFrame:
        out = df
        for i in picked:
            out = out.withColumn(f"_{i}", F.explode(f"_{i}"))
        return out.select(out.columns[0], F.lit(",".join(map(str, picked))).alias("_set"), F.to_json(F.array(*[F.col(f"_{i}") for i in picked])).alias("_key")).distinct()

    sets = [c for k in range(1, len(names) + 1) for c in combinations(range(len(names)), k)]
    x, y = side(left, left_id, 0), side(right, right_id, 1)
    every_x = reduce(DataFrame.unionByName, [compound(x, c) for c in sets])
    every_y = reduce(DataFrame.unionByName, [compound(y, c) for c in sets])
    first = Window.partitionBy("_set", "_key").orderBy(right_id)
    leading = every_y.withColumn("_place", F.row_number().over(first)).where(F.col("_place") <= most).drop("_place")
    met = every_x.join(leading, ["_set", "_key"])
    counted = met.groupBy(left_id, right_id).agg(F.max(F.size(F.split("_set", ","))).cast("bigint").alias("clauses"))
    order = Window.partitionBy(left_id).orderBy(F.col("clauses").desc(), F.col(right_id))
    return counted.withColumn("rank", F.row_number().over(order)).where((F.col("rank") <= most) & (F.col("rank") > offset))


def group_extended(found: DataFrame, catalogue: DataFrame, key: str, candidate: str, group: str) -> DataFrame:
    """key, candidate, found_by: the candidates found and all others of their groups, each once; without a group none is added."""
    groups = catalogue.where(F.col(group).isNotNull() & (F.col(group) != "")).select(candidate, group)
    others = found.select(key, candidate).join(groups, candidate).select(key, group).distinct().join(groups, group).select(key, candidate, F.lit("group").alias("found_by"))
    both = found.select(key, candidate, F.lit("found").alias("found_by")).unionByName(others)
    return both.groupBy(key, candidate).agg(F.min("found_by").alias("found_by"))  # "found" comes before "group"


def with_short_circuit(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_key: str, right_key: str, searched) -> DataFrame:
    """left id, right id, found_by: rows whose key exists on the right get exactly that row; the others are searched.

    ``searched`` is a function of the remaining left rows that gives left id and right id.
    """
    keyed = right.where(F.col(right_key).isNotNull()).select(F.col(right_key).alias("_k"), right_id)
    direct = left.where(F.col(left_key).isNotNull()).select(left_id, F.col(left_key).alias("_k")).join(keyed, "_k").select(left_id, right_id, F.lit("id").alias("found_by"))
    rest = left.join(direct.select(left_id).distinct(), left_id, "left_anti")
    return direct.unionByName(searched(rest).select(left_id, right_id, F.lit("search").alias("found_by")))


def pairs_in_blocks(left: DataFrame, right: DataFrame, block: str | list[str]) -> DataFrame:
    """All pairs of two different sets within a block, as a hash join on the block key."""
    return left.join(right, block)
