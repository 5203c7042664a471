"""Traversal of nested relations and projections of nested entities; higher-order functions throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Relation types behind each role.
ROLES = {
    "arranger": ["arranger", "instrument arranger", "orchestrator", "vocal arranger"],
    "conductor": ["conductor"],
    "director": ["audio director", "video director", "creative direction", "art direction"],
    "dj_mixer": ["mix-DJ"],
    "engineer": ["engineer", "audio", "mastering", "sound", "mix", "recording", "field recordist", "programming", "editor", "balance"],
    "mixer": ["mix"],
    "producer": ["producer"],
    "remixer": ["remixer"],
    "composer": ["composer"],
    "lyricist": ["lyricist"],
    "writer": ["writer"],
}
#: Relation types of performers.
PERFORMER_TYPES = ["performer", "instrument", "vocal"]

RELATION = "struct<type:string,direction:string,artist:string,attributes:array<string>,work:struct<title:string,relations:array<struct<type:string,artist:string>>>>"


def of_types(relations: Column, types: list[str]) -> Column:
    return F.filter(relations, lambda r: r["type"].isin(*types))


def works(relations: Column) -> Column:
    """Works that a recording performs."""
    performed = F.filter(relations, lambda r: (r["type"] == "performance") & (r["direction"] == "forward") & r["work"].isNotNull())
    return F.transform(performed, lambda r: r["work"])


def one_or_two_hops(relations: Column, types: list[str]) -> Column:
    """Artists related by the types directly, then those related to the works performed."""
    direct = F.transform(of_types(relations, types), lambda r: r["artist"])
    through = F.flatten(F.transform(works(relations), lambda w: F.transform(F.filter(w["relations"], lambda r: r["type"].isin(*types)), lambda r: r["artist"])))
    return F.concat(direct, through)


def role_artists(relations: Column, role: str) -> Column:
    found = F.transform(of_types(relations, ROLES[role]), lambda r: r["artist"])
    return one_or_two_hops(relations, ROLES[role]) if role in ("composer", "lyricist", "writer") else F.filter(found, lambda a: a.isNotNull())


def performers(relations: Column) -> Column:
    """array<struct<involvement, involvee>>: attributes joined, and the artist."""
    return F.transform(of_types(relations, PERFORMER_TYPES), lambda r: F.struct(F.array_join(r["attributes"], ", ").alias("involvement"), r["artist"].alias("involvee")))


def first_non_null(values: Column) -> Column:
    return F.get(F.filter(values, lambda x: x.isNotNull()), F.lit(0))


def all_non_null(values: Column) -> Column:
    return F.filter(values, lambda x: x.isNotNull())


def mapped(value: Column, table: dict[str, str]) -> Column:
    """Value by a fixed table; null for what it lacks."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), value)


def any_credit(credits: Column, field: str, value: str) -> Column:
    """Whether a nested credit has the value; false for null."""
    return F.coalesce(F.exists(credits, lambda c: c[field] == value), F.lit(False))


def fallback(*columns: Column) -> Column:
    return F.coalesce(*columns)


def flattened(df: DataFrame, id_col: str, parts: str, items: str) -> DataFrame:
    """id, part_idx, item_idx, position, item: items of nested parts in order; position runs through all parts, from 0."""
    parts_df = df.select(id_col, F.posexplode(parts).alias("part_idx", "part"))
    rows = parts_df.select(id_col, "part_idx", F.posexplode(F.col("part")[items]).alias("item_idx", "item"))
    w = Window.partitionBy(id_col).orderBy("part_idx", "item_idx")
    return rows.withColumn("position", F.row_number().over(w) - 1)


def merged_people(left: DataFrame, right: DataFrame, key: str, name: str, value: str) -> DataFrame:
    """key, involvement, n, left, right: full outer merge of two lists of people by involvement.

    Within one involvement people are paired by rank of their names; extras stand alone.
    """
    w = Window.partitionBy(key, name).orderBy(value)
    a = left.select(key, F.col(name).alias("involvement"), F.row_number().over(w).alias("n"), F.col(value).alias("left"))
    b = right.select(key, F.col(name).alias("involvement"), F.row_number().over(w).alias("n"), F.col(value).alias("right"))
    return a.join(b, [key, "involvement", "n"], "full_outer")


def replaced(people: Column, involvement: Column, names: Column) -> Column:
    """A list of people in which those of one involvement are replaced, the new ones at the end."""
    kept = F.filter(people, lambda p: ~p["involvement"].eqNullSafe(involvement))
    return F.concat(kept, F.transform(names, lambda n: F.struct(involvement.alias("involvement"), n.alias("involvee"))))
