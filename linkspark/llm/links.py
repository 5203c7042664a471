"""Connected groups of linked records, and blocks of any size cut into cells, by joins only."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from linkspark.runtime import forget, written


def components(members: DataFrame, keys: DataFrame) -> DataFrame:
    """``id, label``: everything that shares keys, directly or through others, gets the least label of the group.

    ``members`` is id, label, a label being an id (of the same type) or the id itself; ``keys`` is id, key. In a round
    the least label of each key passes to its ids, to the id that gave its name to their old label, and each id takes
    over the label of its label: the length of a chain shrinks by a factor, so that a chain of n links takes about
    log n rounds. Rounds go on until nothing moves; no group is gathered in one place.
    """
    label = members.select("id", "label")
    while True:  # ends: labels only fall, and none below the least of the group
        low = keys.join(label, "id").groupBy("key").agg(F.min("label").alias("low"))
        lower = keys.join(low, "key").groupBy("id").agg(F.min("low").alias("low"))
        heard = label.join(lower, "id", "left").select("id", "label", F.least("label", "low").alias("low"))
        hooked = heard.where("low < label").groupBy(F.col("label").alias("id")).agg(F.min("low").alias("hook"))
        first = written(heard.join(hooked, "id", "left").select("id", F.col("label").alias("old"), F.least("low", "hook").alias("label")), "hooked")
        seen, before = Observation(), label
        parent = first.select(F.col("id").alias("label"), F.col("label").alias("top"))
        label = first.join(parent, "label", "left").select("id", "old", F.least("label", "top").alias("label"))
        label = written(label.observe(seen, F.count_if(F.col("label") < F.col("old")).alias("moved")).select("id", "label"), "labels")
        forget(first)
        forget(before)
        if not seen.get["moved"]:
            return label


def cells(x: DataFrame, y: DataFrame, key: str, own: str, most: int) -> tuple[DataFrame, DataFrame]:
    """``own, key`` of both sides with every key of more than ``most`` pairs cut into cells of about that many.

    Both sides of such a key are salted by ``own`` and each part stands in the cells of all parts of the other side, so
    every pair meets in exactly one cell and no task gets a whole hot key. Changes no result. A key is text or a hash.
    """
    numbered = x.schema[key].dataType.typeName() == "long"
    side = max(1, math.isqrt(most))
    n = x.groupBy(key).agg(F.count("*").alias("n")).join(y.groupBy(key).agg(F.count("*").alias("m")), key).where(f"n * m > {most}")
    heavy = written(n.select(key, F.ceil(F.col("n") / side).alias("rows"), F.ceil(F.col("m") / side).alias("columns")), "heavy")
    if heavy.isEmpty():
        return x, y

    def cut(blocks: DataFrame, mine: str, other: str) -> DataFrame:
        parts = blocks.join(heavy, key).withColumn(mine, F.pmod(F.xxhash64(own), F.col(mine))).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        cell = F.xxhash64(key, "rows", "columns") if numbered else F.concat_ws("\u001e", key, "rows", "columns")
        parts = parts.withColumn(key, cell).select(blocks.columns)
        return blocks.join(heavy, key, "left_anti").select(blocks.columns).unionByName(parts)

    return cut(x, "rows", "columns"), cut(y, "columns", "rows")
