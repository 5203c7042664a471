"""Queries of sources, containers, analyzers and streams."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspark.functions import text as X
from linkspark.operators import analyzers
from linkspark.plans import link_queries
from linkspark.plans.registry import query
from linkspark.plans.text_queries import sql_escape
from linkspark.runtime import shared_path, table
from linkspark.sources import cache, files, snapshots, tags
from linkspark.streaming import imports

FIXED_NOW = datetime.datetime(2024, 2, 15)


@query(sql="""
WITH p AS (SELECT DISTINCT r.source_path || CASE t.media_idx WHEN 0 THEN '' ELSE '/CD ' || (t.media_idx + 1) END || '/' || t.track_idx || CASE t.track_idx % 3 WHEN 0 THEN '.mp3' WHEN 1 THEN '.FLAC' ELSE '.txt' END AS path FROM tracks t JOIN releases r USING (release_id)),
f AS (SELECT path, regexp_replace(path, '/[^/]*$', '') AS dir FROM p WHERE lower(regexp_extract(path, '\\.([^./]*)$', 1)) IN ('mp3', 'flac')),
g AS (SELECT path, CASE WHEN regexp_matches(regexp_extract(dir, '([^/]*)$', 1), '(?i)^(?:CD|Disc)\\s*\\d+$') THEN regexp_replace(dir, '/[^/]*$', '') ELSE dir END AS directory FROM f)
SELECT directory, list(path ORDER BY string_split(path, '/')) AS paths, count(*) AS tracks FROM g GROUP BY directory""")
def q_dir_group(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "tracks").select("release_id", "media_idx", "track_idx").distinct().join(table(spark, d, "releases").select("release_id", "source_path"), "release_id")
    folder = F.concat("source_path", F.when(F.col("media_idx") == 0, "").otherwise(F.concat(F.lit("/CD "), (F.col("media_idx") + 1).cast("string"))))
    ext = F.when(F.col("track_idx") % 3 == 0, ".mp3").when(F.col("track_idx") % 3 == 1, ".FLAC").otherwise(".txt")
    p = t.select(F.concat(folder, F.lit("/"), F.col("track_idx").cast("string"), ext).alias("path")).distinct()
    return files.grouped(p)


@query
def q_walk_files(spark: SparkSession, d: str) -> DataFrame:
    f = files.walk(spark, d, "*.parquet")
    return f.select(X.file_name(F.col("path")).alias("name"), "length")


@query(sql="""
WITH m AS (SELECT source_path AS src, '/library/' || coalesce(release_year, '0000') || '/' || regexp_extract(source_path, '([^/]*)$', 1) AS dst FROM releases), c AS (SELECT dst, count(*) > 1 AS conflict FROM m GROUP BY dst)
SELECT src, dst, conflict FROM m JOIN c USING (dst)""")
def q_move_plan(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "releases").select("source_path", F.concat(F.lit("/library/"), F.coalesce("release_year", F.lit("0000")), F.lit("/"), X.file_name(F.col("source_path"))).alias("target"))
    return files.move_plan(r, "source_path", "target")


@query(sql="""
SELECT event_id, user_id, event_type FROM events WHERE epoch(TIMESTAMP '2024-02-15') - epoch(ts) < 2 * 7 * 86400 AND floor((epoch(TIMESTAMP '2024-02-15') - floor(epoch(ts))) / (7 * 86400)) < 2 AND (epoch(TIMESTAMP '2024-02-15') - floor(epoch(ts))) / 86400 <= 7""")
def q_cache_ttl(spark: SparkSession, d: str) -> DataFrame:
    from linkspark.functions import temporal

    e = table(spark, d, "events")
    return e.where(temporal.is_fresh(F.col("ts"), F.col("ts"), F.lit(FIXED_NOW))).select("event_id", "user_id", "event_type")


@query(sql="SELECT source AS kind, count(*) AS entries, CAST(sum(n_chars) AS BIGINT) AS bytes FROM documents GROUP BY source")
def q_cache_stats(spark: SparkSession, d: str) -> DataFrame:
    return cache.stats(table(spark, d, "documents").withColumnRenamed("source", "kind"), "kind", "n_chars")


@query(sql="SELECT p_partkey AS key, p_name AS name, p_size AS size FROM part WHERE p_partkey % 2 = 0")
def q_cache_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Parts written into the cache as envelopes and read back; those of odd keys are too old and missed."""
    path = shared_path(spark, "cache")
    now = F.current_timestamp()
    p = table(spark, d, "part").withColumn("key", F.col("p_partkey").cast("string"))
    item = F.struct(F.col("p_name").alias("name"), F.col("p_size").alias("size"))
    cache.write(p, path, "release", "key", item, now - F.expr("interval 15 days"))
    cache.write(p.where("p_partkey % 2 = 0"), path, "release", "key", item, now)
    cache.write(p.where("p_partkey % 2 = 1"), path, "search", "key", item, now - F.expr("interval 15 days"))
    got = cache.read(spark, path, "struct<name:string,size:int>", now)
    return got.select(F.col("key").cast("bigint").alias("key"), F.col("item.name").alias("name"), F.col("item.size").alias("size"))


@query(sql="SELECT release_title, release_artist, count(*) AS n FROM releases GROUP BY 1, 2")
def q_snapshot_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Releases written as JSON snapshots and read back with the explicit schema."""
    path = shared_path(spark, "snapshots")
    snapshots.write(table(spark, d, "releases").select("release_title", "release_artist", "barcode", "is_compilation"), path)
    return spark.read.schema(snapshots.RELEASE).json(path).groupBy("release_title", "release_artist").agg(F.count("*").alias("n"))


def _versions(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    names = {"click": "id3v2.2", "view": "id3v2.3", "error": "id3v2.4", "purchase": "vorbis"}
    version = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("event_type")), F.lit("vorbis"))
    return e.groupBy((F.col("user_id") * 1000 + F.col("event_id") % 97).alias("path")).agg(F.array_sort(F.collect_set(version)).alias("versions"))


@query(sql="""
WITH v AS (SELECT user_id * 1000 + event_id % 97 AS path, CASE event_type WHEN 'click' THEN 'id3v2.2' WHEN 'view' THEN 'id3v2.3' WHEN 'error' THEN 'id3v2.4' ELSE 'vorbis' END AS c FROM events), s AS (SELECT path, list(DISTINCT c ORDER BY c) AS l FROM v GROUP BY path),
a AS (SELECT path, list_filter(list_transform(l, lambda c: c || ':' || CASE WHEN c = 'vorbis' OR c = 'id3v2.3' THEN 'keep' WHEN list_contains(l, 'id3v2.3') THEN 'drop' WHEN c = 'id3v2.4' THEN 'migrate' WHEN list_contains(l, 'id3v2.4') THEN 'drop' ELSE 'migrate' END), lambda x: x NOT LIKE '%drop') AS actions FROM s)
SELECT path, array_to_string(actions, ',') AS actions FROM a""")
def q_container_pick(spark: SparkSession, d: str) -> DataFrame:
    kept = tags.kept_containers(F.col("versions"))
    return _versions(spark, d).select("path", F.array_join(F.transform(kept, lambda k: F.concat_ws(":", k["container"], k["action"])), ",").alias("actions"))


KEYS_SQL = ", ".join(f"('{k['key']}', '{k['level']}', '{c}', '{k[c]}')" for k in tags.KEYS for c in tags.CONTAINERS if k[c] != "-")


@query(sql=f"SELECT key, level, container, name FROM (VALUES {KEYS_SQL}) t(key, level, container, name)")
def q_key_mapping(spark: SparkSession, d: str) -> DataFrame:
    return tags.key_table(spark).select("key", "level", "container", "name")


@query(sql="""
WITH t AS (SELECT DISTINCT track_id, track_title, track_number, bpm FROM tracks WHERE track_title IS NOT NULL)
SELECT track_id, track_title AS title, coalesce(bpm, 'none') AS bpm, CAST(1 + CASE WHEN bpm IS NOT NULL THEN 1 ELSE 0 END AS INTEGER) AS n, split_part(track_number, '/', 1) AS number FROM t""")
def q_container_edit(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "tracks").where("track_title is not null").select("track_id", "track_title", "track_number", "bpm").distinct()
    m = F.create_map(F.lit("TIT2"), F.array(F.lit("old")), F.lit("TRCK"), F.array("track_number"))
    m = tags.set_values(m, "TIT2", F.array("track_title"))
    m = tags.set_or_clear(tags.clear(m, "TRCK"), "TBPM", F.col("bpm"))
    t = t.withColumn("m", m)
    return t.select("track_id", tags.get(F.col("m"), tags.physical_name(F.lit("TrackTitle"), "id3v2.4")).alias("title"), F.coalesce(tags.get(F.col("m"), F.lit("TBPM")), F.lit("none")).alias("bpm"), F.size("m").alias("n"), X.first_of_pair(F.col("track_number")).alias("number"))


@query(sql="""
WITH t AS (SELECT DISTINCT track_id, original_release_date, track_title FROM tracks WHERE track_title IS NOT NULL), f AS (SELECT track_id, 'TDOR' AS frame, original_release_date AS value FROM t WHERE original_release_date IS NOT NULL UNION ALL SELECT track_id, 'TIT2', track_title FROM t UNION ALL SELECT track_id, 'TMOO', 'x' FROM t)
SELECT track_id, CASE frame WHEN 'TDOR' THEN 'TORY' ELSE frame END AS frame, value FROM f WHERE frame <> 'TMOO'""")
def q_frame_migration(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "tracks").where("track_title is not null").select("track_id", "original_release_date", "track_title").distinct()
    frames = t.select("track_id", F.explode(F.create_map(F.lit("TDOR"), F.col("original_release_date"), F.lit("TIT2"), F.col("track_title"), F.lit("TMOO"), F.lit("x"))).alias("frame", "value")).where("value is not null")
    return tags.migrated(frames, "id3v2.4", "id3v2.3").select("track_id", "frame", "value")


@query(sql="""
WITH t AS (SELECT DISTINCT track_id, track_title, bpm FROM tracks WHERE track_title IS NOT NULL)
SELECT track_id AS path, 'TBPM' AS key, NULL AS old_value, bpm AS new_value FROM t WHERE bpm IS NOT NULL UNION ALL SELECT track_id, 'TIT2', track_title, upper(track_title) FROM t WHERE regexp_full_match(track_title, '[ -~]*') AND upper(track_title) <> track_title""")
def q_write_plan(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "tracks").where("track_title is not null").select(F.col("track_id").alias("path"), "track_title", "bpm").distinct()
    old = F.create_map(F.lit("TIT2"), F.array("track_title"))
    title = F.when(F.col("track_title").rlike("^[ -~]*$"), F.upper("track_title")).otherwise(F.col("track_title"))
    new = tags.set_or_clear(tags.set_values(old, "TIT2", F.array(title)), "TBPM", F.col("bpm"))
    plan = tags.write_plan(t.select("path", old.alias("tags")), t.select("path", new.alias("tags")))
    return plan.select("path", "key", F.col("old")[0].alias("old_value"), F.col("new")[0].alias("new_value"))


@query
def q_r128(spark: SparkSession, d: str) -> DataFrame:
    """Loudness, length and errors of the embeddings taken as signals of 100 samples a second."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding", F.lit(100).alias("rate"))
    out = analyzers.analyze(e, "vec_id", "embedding", "rate", ["track_length", "ebu_r128"])
    return out.select("vec_id", "length_ms", F.round("lufs", 6).alias("lufs"), "peak", "blocks")


@query
def q_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", "embedding", F.lit(8000).alias("rate"))
    out = analyzers.analyze(e, "vec_id", "embedding", "rate", ["chromaprint_fingerprint"])
    return out.select("vec_id", X.base64_url(F.col("fingerprint")).alias("fingerprint"))


@query(sql="""
WITH s AS (SELECT user_id || '/' || event_type AS key, event_id, abs(value - 10) AS distance FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY distance, event_id) AS rank FROM s)
SELECT key, event_id, distance, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3""")
def q_stream_topk(spark: SparkSession, d: str) -> DataFrame:
    """Events streamed from their files; the three of each user and type with the values nearest to 10, over all batches."""
    source = shared_path(spark, "arrivals")
    e = table(spark, d, "events")
    e.repartition(4, "user_id").write.parquet(source)
    key = F.concat_ws("/", "user_id", "event_type").alias("key")
    score = lambda b: b.select(key, "event_id", F.abs(F.col("value") - 10).alias("distance"))
    return imports.best_matches(spark, source, e._jdf.schema().toDDL(), shared_path(spark, "best"), shared_path(spark, "progress"), score, "key", "distance", "event_id", 3)


@query(sql="SELECT vec_id, CAST(len(embedding) * 1000 // 100 AS BIGINT) AS length_ms FROM embeddings")
def q_track_length(spark: SparkSession, d: str) -> DataFrame:
    """Length of the embeddings taken as signals of 100 samples a second."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding", F.lit(100).alias("rate"))
    return analyzers.analyze(e, "vec_id", "embedding", "rate", ["track_length"]).select("vec_id", "length_ms")


@query(sql=f"""
WITH s AS ({link_queries.SCORED_SQL}), b AS (SELECT *, row_number() OVER (PARTITION BY release_id ORDER BY distance, catalogue_id) AS rank FROM s)
SELECT release_id, catalogue_id, distance, CASE WHEN distance <= 0.05 THEN 'auto_select' ELSE 'needs_review' END AS decision, source_path AS src,
    concat_ws('/', '/library', {sql_escape("coalesce(c.release_artist, '[unknown artist]')")}, {sql_escape("concat_ws(' - ', c.release_year, coalesce(c.release_title, '[unknown album]'))")}) AS dst
FROM b JOIN releases r USING (release_id) JOIN catalogue_releases c USING (catalogue_id) WHERE rank = 1""")
def q_import_plan(spark: SparkSession, d: str) -> DataFrame:
    """Dry run of an import: candidates by blocking, best by distance, decision, target path."""
    from linkspark.operators import rank
    from linkspark.plans.link_queries import q_release_total_distance

    scored = q_release_total_distance(spark, d)
    best = rank.auto_selected(rank.top_k(scored, "release_id", "distance", "catalogue_id", 1), "release_id", "distance")
    r = table(spark, d, "releases").select("release_id", "source_path")
    c = table(spark, d, "catalogue_releases").select("catalogue_id", "release_title", "release_artist", "release_year")
    target = F.concat_ws("/", F.lit("/library"), X.escape_path_chars(F.coalesce("release_artist", F.lit("[unknown artist]"))), X.escape_path_chars(F.concat_ws(" - ", "release_year", F.coalesce("release_title", F.lit("[unknown album]")))))
    return best.join(r, "release_id").join(c, "catalogue_id").select("release_id", "catalogue_id", "distance", "decision", F.col("source_path").alias("src"), target.alias("dst"))
