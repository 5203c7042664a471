"""Queries over the driver's tables, one or more for each operator, and the SQL each must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linkspark.operators import nested
from linkspark.plans import adapter_queries, enrich_queries, group_queries, link_queries, source_queries, text_queries  # noqa: F401 - they register
from linkspark.plans.registry import QUERIES, SQL, query
from linkspark.runtime import table


@query
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.track_positions(table(spark, d, "snapshots"))


@query
def p4_releases(spark: SparkSession, d: str) -> DataFrame:
    return nested.flat_table(table(spark, d, "snapshots"), "releases")


@query
def p4_media(spark: SparkSession, d: str) -> DataFrame:
    return nested.flat_table(table(spark, d, "snapshots"), "media")


@query
def p4_tracks(spark: SparkSession, d: str) -> DataFrame:
    return nested.flat_table(table(spark, d, "snapshots"), "tracks")


#: Members of the bodies down to their tracks, as JSON, for DuckDB.
BODIES_SQL = """
b AS (SELECT snapshot_id, CASE WHEN json_valid(body) THEN body::JSON END AS j FROM snapshots),
e AS (SELECT snapshot_id, CASE WHEN json_type(j) <> 'OBJECT' THEN NULL WHEN json_type(j, '$.media') IS NULL AND json_type(j, '$.item') = 'OBJECT' THEN j->'$.item' ELSE j END AS j FROM b),
l AS (SELECT snapshot_id, CASE json_type(j, '$.media') WHEN 'ARRAY' THEN CAST(j->'$.media' AS JSON[]) WHEN 'OBJECT' THEN [j->'$.media'] ELSE [] END AS l FROM e),
m AS (SELECT snapshot_id, media_idx, o FROM (SELECT snapshot_id, UNNEST(range(len(l))) AS media_idx, UNNEST(l) AS o FROM l) WHERE json_type(o) = 'OBJECT'),
k AS (SELECT snapshot_id, media_idx, CASE json_type(o, '$.media_tracks') WHEN 'ARRAY' THEN CAST(o->'$.media_tracks' AS JSON[]) WHEN 'OBJECT' THEN [o->'$.media_tracks'] ELSE [] END AS l FROM m),
t AS (SELECT snapshot_id, media_idx, track_idx, o FROM (SELECT snapshot_id, media_idx, UNNEST(range(len(l))) AS track_idx, UNNEST(l) AS o FROM k) WHERE json_type(o) = 'OBJECT')"""


def _members_sql(o: str, fields: dict[str, str]) -> str:
    out = []
    for f, kind in fields.items():
        text = f"{o}->>'$.{f}'"
        lone = f"WHEN {o}->>'$.{f}' IS NOT NULL THEN "
        if kind.startswith("array<array"):
            text = f"CASE WHEN json_type({o}, '$.{f}') = 'ARRAY' THEN CAST({o}->'$.{f}' AS VARCHAR[][]) {lone} [[{text}]] END"
        elif kind.startswith("array"):
            inner = kind[6:-1].replace("string", "VARCHAR")
            text = f"CASE WHEN json_type({o}, '$.{f}') = 'ARRAY' THEN CAST({o}->'$.{f}' AS {inner}[]) {lone} [CAST({text} AS {inner})] END"
        elif kind != "string":
            text = f"TRY_CAST({text} AS {kind})"
        out.append(f"{text} AS {f}")
    return ", ".join(out)


SQL["p4_releases"] = f"WITH {BODIES_SQL} SELECT snapshot_id, {_members_sql('j', nested.RELEASE)} FROM e WHERE json_type(j) = 'OBJECT'"
SQL["p4_media"] = f"WITH {BODIES_SQL} SELECT snapshot_id, CAST(media_idx AS INTEGER) AS media_idx, {_members_sql('o', nested.MEDIA)} FROM m"
SQL["p4_tracks"] = f"WITH {BODIES_SQL} SELECT snapshot_id, CAST(media_idx AS INTEGER) AS media_idx, CAST(track_idx AS INTEGER) AS track_idx, {_members_sql('o', nested.TRACK)} FROM t"
SQL["p4_found"] = f"""
WITH {BODIES_SQL}
SELECT snapshot_id, CAST(media_idx AS INTEGER) AS media_idx, CAST(track_idx AS INTEGER) AS track_idx FROM t
UNION ALL SELECT snapshot_id, CAST(media_idx AS INTEGER), -1 FROM m WHERE (snapshot_id, media_idx) NOT IN (SELECT snapshot_id, media_idx FROM t)"""
