"""Candidates in order: rank, top k, selection, and sets of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, key: str, distance: str, tie: str) -> DataFrame:
    """With ``rank`` from 1 by rising distance within a key; ties by ``tie``. A filter on it becomes a group limit."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.col(distance), F.col(tie))))


def top_k(df: DataFrame, key: str, distance: str, tie: str, k: int = 5) -> DataFrame:
    return ranked(df, key, distance, tie).where(F.col("rank") <= k)


def auto_selected(df: DataFrame, key: str, distance: str, limit: float = 0.05) -> DataFrame:
    """With ``decision``: a single candidate within the limit is selected, anything else is for review."""
    alone = F.count("*").over(Window.partitionBy(key)) == 1
    return df.withColumn("decision", F.when(alone & (F.col(distance) <= limit), "auto_select").otherwise("needs_review"))


def without_repeats(df: DataFrame, key: str, candidate: str, distance: str) -> DataFrame:
    """One row per candidate of a key: the nearest."""
    least = df.groupBy(key, candidate).agg(F.min(distance).alias(distance))
    return least


def extended(df: DataFrame, more: DataFrame, key: str, candidate: str, distance: str) -> DataFrame:
    """Both sets of candidates together, each once."""
    return without_repeats(df.select(key, candidate, distance).unionByName(more.select(key, candidate, distance)), key, candidate, distance)


def path_order(path: Column) -> Column:
    """Sort key of a path by components, so that "a/b" precedes "a-b"."""
    return F.split(path, "/")


def disc_order(disc: Column, path: Column) -> list[Column]:
    """Sort keys of tracks: the disc as text, missing first, then the path."""
    return [F.coalesce(disc.cast("string"), F.lit("")), path]


def page(df: DataFrame, order: list[str], limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def chosen(df: DataFrame, id_col: str, value) -> DataFrame:
    """The candidate of an id."""
    return df.where(F.col(id_col) == F.lit(value))


def item_at(array: Column, index: int) -> Column:
    """Item at a 0-based index; null beyond the end."""
    return F.get(array, F.lit(index))
