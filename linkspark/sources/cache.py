"""Cached entities in envelopes {created, item}: keys, reading with an age limit, writing by key, deletion, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspark.functions import temporal
from linkspark.functions import text as X
from linkspark.runtime import forget, written

#: Kinds of cached entities and how the key of each is made.
KEYS = {
    "release": lambda c: c,
    "release_group": lambda c: c,
    "search": lambda c: X.query_key(c, 5, 0),
}


def cache_path(kind: str, key: Column) -> Column:
    return F.concat(F.lit(f"{kind}/"), KEYS[kind](key), F.lit(".json"))


def write(df: DataFrame, path: str, kind: str, key: str, item: Column, now: Column) -> None:
    """One JSON envelope per row, below kind=...; it takes the place of an older one of its key, and of no other."""
    rows = df.select(F.col(key).alias("key"), F.struct(now.alias("created"), item.alias("item")).alias("e"))
    rows.select("key", "e.created", "e.item").write.mode("append").json(f"{path}/kind={kind}")


def _envelopes(spark: SparkSession, path: str, item_schema: str) -> DataFrame:
    raw = spark.read.schema(f"key string, created timestamp, item {item_schema}, _corrupt_record string").option("mode", "PERMISSIVE").option("basePath", path).json(path)
    return raw.select("*", F.col("_metadata.file_modification_time").alias("modified"))


def read(spark: SparkSession, path: str, item_schema: str, now: Column, max_weeks: int = 2, max_days: int = 7) -> DataFrame:
    """kind, key, created, item of the newest envelope of each key, within both age limits; older ones are misses.

    Lines that are no envelope are misses, too; ``unreadable`` shows them.
    """
    raw = _envelopes(spark, path, item_schema).where("_corrupt_record is null and key is not null")
    newest = raw.groupBy("kind", "key").agg(F.max_by(F.struct("created", "item", "modified"), F.struct("created", "modified")).alias("e")).select("kind", "key", "e.*")
    return newest.where(temporal.is_fresh(F.col("created"), F.col("modified"), now, max_weeks, max_days)).select("kind", "key", "created", "item")


def unreadable(spark: SparkSession, path: str, item_schema: str) -> DataFrame:
    """kind, line of what is no envelope."""
    return _envelopes(spark, path, item_schema).where("_corrupt_record is not null or key is null").select("kind", F.col("_corrupt_record").alias("line"))


def compact(spark: SparkSession, path: str, kind: str, item_schema: str, now: Column, max_weeks: int = 2, max_days: int = 7) -> None:
    """Delete expired, replaced and unreadable envelopes of a kind; the others keep their age."""
    kept = written(read(spark, path, item_schema, now, max_weeks, max_days).where(F.col("kind") == kind).select("key", "created", "item"), "cache")
    kept.write.mode("overwrite").json(f"{path}/kind={kind}")
    forget(kept)


def stats(files: DataFrame, kind: str, size: str) -> DataFrame:
    """kind, entries, bytes."""
    return files.groupBy(kind).agg(F.count("*").alias("entries"), F.sum(size).alias("bytes"))
