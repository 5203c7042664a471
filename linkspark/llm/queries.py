"""Queries of this subpackage for the driver, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspark.runtime import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def _canonical_sql(c: str) -> str:
    """DuckDB's version of ``ledger.canonical_field``."""
    from linkspark.llm.ledger import ARTICLES

    out = f"upper(replace(regexp_replace(nfc_normalize({c}), '\\p{{Cf}}', '', 'g'), 'ß', 'SS'))"
    out = f"regexp_replace({out}, '^[^\\p{{L}}\\p{{N}}\\p{{M}}]+|[^\\p{{L}}\\p{{N}}\\p{{M}}]+$', '', 'g')"
    out = f"regexp_replace({out}, '\\s+[-–—]\\s+', ',', 'g')"
    out = f"regexp_replace({out}, '(?s)^(.*[^,]),[^\\p{{L}}\\p{{N}}]*({'|'.join(ARTICLES)})$', '\\2 \\1')"
    out = f"regexp_replace({out}, '(?s)^([^,]+),([^,]+)$', '\\2 \\1')"
    return f"regexp_replace({out}, '[^\\p{{L}}\\p{{N}}\\p{{M}}]+', '', 'g')"


_KEYS_SQL = f"""
k AS (SELECT release_id, release_title, release_artist, ingested_at, {_canonical_sql('release_title')} AS t, {_canonical_sql('release_artist')} AS a FROM releases WHERE release_title <> '' AND release_artist <> ''),
g AS (SELECT *, least(t, a) || chr(31) || greatest(t, a) AS key FROM k WHERE t <> '' AND a <> '')"""

SQL["p2_found"] = f"WITH {_KEYS_SQL} SELECT x.release_id AS release_id_a, y.release_id AS release_id_b FROM g x JOIN g y ON x.key = y.key AND x.release_id < y.release_id"
SQL["p2_ledger"] = f"""WITH {_KEYS_SQL}, n AS (SELECT *, count(*) OVER (PARTITION BY key) AS copies, row_number() OVER (PARTITION BY key ORDER BY ingested_at NULLS FIRST, release_id) AS i FROM g)
SELECT release_id, nfc_normalize(release_title) AS release_title, nfc_normalize(release_artist) AS release_artist, copies FROM n WHERE i = 1"""


@query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    from linkspark.llm import ledger

    rows = ledger.keyed(table(spark, d, "releases"), "release_id", ["release_title", "release_artist"], "ingested_at")
    pairs = ledger.duplicate_pairs(rows, ledger.ledger_of(rows))
    return pairs.select(F.col("a").alias("release_id_a"), F.col("b").alias("release_id_b"))


@query
def p2_ledger(spark: SparkSession, d: str) -> DataFrame:
    from linkspark.llm import ledger

    rows = ledger.keyed(table(spark, d, "releases"), "release_id", ["release_title", "release_artist"], "ingested_at")
    return ledger.ledger_of(rows).table().select(F.col("first.id").alias("release_id"), F.col("first.title").alias("release_title"), F.col("first.artist").alias("release_artist"), "copies")


@query
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_restored(spark, d).select("field_name", "record_id")


@query
def p6_restored(spark: SparkSession, d: str) -> DataFrame:
    from linkspark.llm import encoding

    return encoding.find_garbled([(table(spark, d, "tracks"), "track_id", ["track_title", "track_artist"]), (table(spark, d, "releases"), "release_id", ["release_title"])])


@query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_forms(spark, d).select("field_name", "record_id")


@query
def p5_forms(spark: SparkSession, d: str) -> DataFrame:
    from linkspark.llm import lookalikes

    return lookalikes.find_lookalikes([(table(spark, d, "tracks"), "track_id", ["track_title"]), (table(spark, d, "releases"), "release_id", ["release_artist", "release_title"])])


@query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    from linkspark.llm import names

    return names.variant_pairs(_resolved_names(spark, d))


def _resolved_names(spark: SparkSession, d: str) -> DataFrame:
    from linkspark.llm import names

    return names.resolve(names.name_values([(table(spark, d, "tracks"), ["track_artist", "composer"]), (table(spark, d, "releases"), ["record_label"])]))


@query
def p3_entities(spark: SparkSession, d: str) -> DataFrame:
    spelled = F.struct(F.length("name").alias("len"), "name")
    return _resolved_names(spark, d).groupBy("field_name", "cluster").agg(F.max(spelled)["name"].alias("longest"), F.count("*").alias("spellings"))


@query
def p3_members(spark: SparkSession, d: str) -> DataFrame:
    """Every spelling with the id of its entity; one row a spelling, however many an entity has."""
    return _resolved_names(spark, d)


@query
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_leaks(spark, d).select("doc_id", "item_id")


@query
def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    from linkspark.llm import leakage

    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


@query
def p8_cleaned(spark: SparkSession, d: str) -> DataFrame:
    from linkspark.llm import leakage

    return leakage.remove_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


@query
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _languages(spark, d).where("segment = -1 and written and not label_fits").select("doc_id", "lang")


def _languages(spark: SparkSession, d: str) -> DataFrame:
    from linkspark.llm import languages

    return languages.identify(table(spark, d, "documents"))


@query
def p9_segments(spark: SparkSession, d: str) -> DataFrame:
    return _languages(spark, d).where("segment >= 0").select("doc_id", "segment", "lang", "confidence")


@query
def p9_documents(spark: SparkSession, d: str) -> DataFrame:
    return _languages(spark, d).where("segment = -1").select("doc_id", "lang", "confidence", "share", "label", "label_fits", "written")


@query
def p7_packing(spark: SparkSession, d: str) -> DataFrame:
    from linkspark.llm import packing

    return packing.pack(table(spark, d, "documents"), table(spark, d, "pack_specs"))


@query
def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    from linkspark.llm import packing

    return packing.fill_report(p7_packing(spark, d), table(spark, d, "pack_specs"))


@query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_matches(spark, d).select("release_id", "catalogue_id")


@query
def p1_matches(spark: SparkSession, d: str) -> DataFrame:
    from linkspark.llm import linkage

    return linkage.match_sources(table(spark, d, "releases"), "release_id", table(spark, d, "catalogue_releases"), "catalogue_id")


@query
def p1_editions(spark: SparkSession, d: str) -> DataFrame:
    """Membership: every record of both sources with its edition; matching editions have one number, the local one's."""
    from linkspark.llm import linkage

    likely, a, b = linkage.matched_editions(table(spark, d, "releases"), "release_id", table(spark, d, "catalogue_releases"), "catalogue_id")
    best = likely.groupBy("r").agg(F.max(F.struct("confidence", -F.col("l")))["col2"].alias("minus"))
    theirs = b.join(best, "r", "left").select(F.lit("catalogue").alias("source"), F.col("catalogue_id").alias("record_id"), F.coalesce(-F.col("minus"), F.col("r")).alias("edition"))
    return a.select(F.lit("local").alias("source"), F.col("release_id").alias("record_id"), F.col("l").alias("edition")).unionByName(theirs)
