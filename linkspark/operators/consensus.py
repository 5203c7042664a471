"""Aggregates that describe a group: mode by first occurrence, consensus, runs, ordered joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mode_first_seen(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """keys, item, count, total: the most frequent value that is not null; ties go to the one seen first.

    Groups of nulls only give no row. Two levels of aggregation, so that a hot group is reduced before it is moved.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("n"), F.min(order).alias("first_seen"))
    return counted.groupBy(*keys).agg(F.max_by("v", F.struct(F.col("n"), -F.col("first_seen"))).alias("item"), F.max("n").alias("count"), F.sum("n").alias("total"))


def consensus(value: Column) -> Column:
    """Aggregate: the value that all rows with one share; null if they differ or have none."""
    return F.when(F.min(value) == F.max(value), F.max(value))


def consensus_or(first: Column, second: Column) -> Column:
    """Consensus of one column, else that of another."""
    return F.coalesce(consensus(first), consensus(second))


def run_lengths(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """keys, run, value, n: consecutive equal values; nulls are equal to each other and counted as a value."""
    w = Window.partitionBy(*keys).orderBy(order)
    change = F.coalesce((~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int"), F.lit(0))
    first = F.row_number().over(w) == 1
    runs = df.withColumn("_start", F.when(first, F.lit(1)).otherwise(change)).withColumn("run", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "run").agg(F.first(value).alias("value"), F.count("*").alias("n"))


def format_runs(runs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, format: runs joined like "2×CD+DVD"; null for a group without values."""
    part = F.when(F.col("n") > 1, F.concat(F.col("n").cast("string"), F.lit("×"), F.col("value"))).otherwise(F.col("value"))
    listed = F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("run", part.alias("t")))))
    text = F.array_join(F.transform(listed, lambda x: x["t"]), "+")
    return runs.groupBy(*keys).agg(F.when(text != "", text).alias("format"))


def format_list(values: Column) -> Column:
    """The same for an array column."""
    start = F.struct(F.lit("").alias("text"), F.lit(None).cast("string").alias("last"), F.lit(0).alias("n"))

    def shown(acc: Column) -> Column:
        part = F.when(acc["n"] > 1, F.concat(acc["n"].cast("string"), F.lit("×"), acc["last"])).otherwise(acc["last"])
        return F.when(acc["n"] == 0, acc["text"]).when(acc["text"] == "", part).otherwise(F.concat(acc["text"], F.lit("+"), part))

    def step(acc: Column, x: Column) -> Column:
        same = (acc["n"] > 0) & acc["last"].eqNullSafe(x)
        return F.when(same, F.struct(acc["text"].alias("text"), x.alias("last"), (acc["n"] + 1).alias("n"))).otherwise(F.struct(shown(acc).alias("text"), x.alias("last"), F.lit(1).alias("n")))

    out = F.aggregate(F.filter(values, lambda x: x.isNotNull()), start, step, shown)
    return F.when(out != "", out)


def media_of(df: DataFrame, keys: list[str], disc: str, order: str, item: Column) -> DataFrame:
    """keys, disc, items: items of a group by disc, in their order; a null disc is a group of its own, first."""
    return df.groupBy(*keys, F.col(disc).alias("disc")).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), item.alias("i")))), lambda x: x["i"]).alias("items"))


def collect_map(df: DataFrame, keys: list[str], name: str, value: str) -> DataFrame:
    """keys, entries: map from each name to its sorted values."""
    listed = df.groupBy(*keys, name).agg(F.array_sort(F.collect_list(value)).alias("v"))
    return listed.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(name), F.col("v"))))).alias("entries"))


def joined_credit(credits: Column, name: str = "name", phrase: str = "joinphrase") -> Column:
    """Names of an artist credit with their join phrases; "" for an empty list."""
    return F.array_join(F.transform(credits, lambda c: F.concat(c[name], F.coalesce(c[phrase], F.lit("")))), "")


def any_of(flag: Column) -> Column:
    return F.coalesce(F.bool_or(flag), F.lit(False))


def all_of(flag: Column) -> Column:
    return F.coalesce(F.bool_and(flag), F.lit(True))


def item_counts(df: DataFrame, keys: list[str], place: list[str]) -> DataFrame:
    """keys, items, parts: distinct items of a collection and the parts they stand in; ``place`` is part, then item."""
    return df.select(*keys, *place).distinct().groupBy(*keys).agg(F.count("*").alias("items"), F.count_distinct(place[0]).alias("parts"))


def missing_from(have: Column, wanted: Column) -> Column:
    """Elements of ``wanted`` that the array ``have`` lacks, in order, each once."""
    return F.array_except(wanted, have)
