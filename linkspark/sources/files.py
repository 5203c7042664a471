"""Folders of audio files: listing, grouping into releases, and the plan of moving them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspark.functions import text as X

#: Extensions of supported files.
AUDIO = ("mp3", "flac")


def walk(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length, modified of all files below a folder, in no order; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "length", F.col("modificationTime").alias("modified"))


def is_track(path: Column) -> Column:
    return X.has_extension(path, *AUDIO)


def release_directory(path: Column) -> Column:
    """Folder of a file; a folder named like a disc counts as its parent."""
    folder = F.regexp_replace(path, r"/[^/]*$", "")
    leaf = F.regexp_extract(folder, r"([^/]*)$", 1)
    return F.when(X.is_disc_directory(leaf) & folder.contains("/"), F.regexp_replace(folder, r"/[^/]*$", "")).otherwise(folder)


def grouped(files: DataFrame, path: str = "path") -> DataFrame:
    """directory, paths, tracks: the tracks of each release folder, by component-wise path order."""
    rows = files.where(is_track(F.col(path))).select(release_directory(F.col(path)).alias("directory"), F.split(path, "/").alias("parts"), F.col(path).alias("p"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("parts", "p"))), lambda x: x["p"])
    return rows.groupBy("directory").agg(listed.alias("paths"), F.count("*").alias("tracks"))


def move_plan(df: DataFrame, source: str, target: str) -> DataFrame:
    """src, dst, conflict: files whose place changes; a conflict is a target that several files share."""
    moves = df.where(F.col(source) != F.col(target)).select(F.col(source).alias("src"), F.col(target).alias("dst"))
    taken = moves.groupBy("dst").agg((F.count("*") > 1).alias("conflict"))
    return moves.join(taken, "dst").select("src", "dst", "conflict")
