"""Fields to show so that candidates with one title and artist can be told apart."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sets of fields in the order in which they are tried.
FIELD_SETS = [
    ["media_format"], ["release_country"], ["release_year"],
    ["media_format", "release_country"], ["media_format", "release_year"], ["release_country", "release_year"],
    ["media_format", "release_country", "release_year"],
    ["record_label"], ["media_format", "record_label"], ["record_label", "catalog_number"],
    ["media_format", "record_label"], ["record_label", "release_year"], ["barcode"],
    ["media_format", "release_country", "release_year", "record_label", "catalog_number", "barcode"],
]


def bitmask(fields: list[str], names: list[str]) -> int:
    """Set of fields as a bit mask over the names."""
    return reduce(lambda m, f: m | 1 << names.index(f), fields, 0)


def contains_all(mask: Column, other: int) -> Column:
    return mask.bitwiseAND(F.lit(other)) == other


def distinguishing_fields(df: DataFrame, keys: list[str], sets: list[list[str]] = FIELD_SETS) -> DataFrame:
    """keys, n, needs: the first set whose values, nulls included, differ in all rows of a group; the last if none.

    Groups of one row need no field.
    """
    texts = {i: F.count_distinct(F.struct(*s)) for i, s in enumerate(sets)}
    grouped = df.groupBy(*keys).agg(F.count("*").alias("n"), *[t.alias(f"_d{i}") for i, t in texts.items()])
    needs = F.when(F.col("n") == 1, F.lit("").cast("string"))
    for i, s in enumerate(sets):
        needs = needs.when(F.col(f"_d{i}") == F.col("n"), F.lit(",".join(s)))
    return grouped.select(*keys, "n", needs.otherwise(F.lit(",".join(sets[-1]))).alias("needs"))
