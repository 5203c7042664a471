"""Queries of the projections onto the release schema, and of scalar functions that no other query shows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspark.functions import temporal as T
from linkspark.functions import text as X
from linkspark.operators import adapters
from linkspark.plans.registry import query
from linkspark.plans.text_queries import PARTIAL_SQL
from linkspark.runtime import table


def _entities(spark: SparkSession, d: str) -> DataFrame:
    """Releases and their tracks as catalogue entities."""
    t = table(spark, d, "tracks").dropDuplicates(["track_id"])
    none = "cast(null as string)"
    track = (
        f"named_struct('id', musicbrainz_track_id, 'number', track_number, 'title', track_title, 'length', track_length[0] * 1000, 'artist-credit', array(named_struct('name', track_artist, 'joinphrase', '', 'artist', named_struct('id', {none}, 'name', track_artist, 'sort-name', track_artist_sort_order))), "
        f"'recording', named_struct('id', musicbrainz_recording_id, 'title', track_title, 'first-release-date', original_release_date, 'isrcs', isrc, 'genres', transform(genre, g -> named_struct('name', g)), "
        f"'relations', cast(transform(coalesce(producer, array()), p -> named_struct('type', 'producer', 'direction', 'backward', 'artist', p, 'attributes', array(), 'work', cast(null as {adapters.WORK}))) as {adapters.RELATIONS})))"
    )
    tracks = t.selectExpr("release_id", "media_idx", "track_idx", f"cast({track} as {adapters.TRACK}) as t").groupBy("release_id", "media_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("track_idx", "t"))), lambda x: x["t"]).alias("tracks"))
    media = table(spark, d, "media").dropDuplicates(["release_id", "media_idx"]).join(tracks, ["release_id", "media_idx"], "left")
    medium = f"cast(named_struct('position', disc_number, 'title', media_title, 'format', media_format, 'track-count', cast(size(tracks) as int), 'tracks', tracks) as {adapters.MEDIUM}) as m"
    media = media.selectExpr("release_id", "media_idx", medium).groupBy("release_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("media_idx", "m"))), lambda x: x["m"]).alias("media"))
    r = table(spark, d, "releases").join(media, "release_id", "left")
    entity = (
        "named_struct('id', musicbrainz_release_id, 'title', release_title, 'asin', asin, 'barcode', barcode, 'country', release_country, 'date', release_date, 'status', initcap(release_status), "
        "'artist-credit', array(named_struct('name', release_artist, 'joinphrase', '', 'artist', named_struct('id', musicbrainz_release_artist_id, 'name', release_artist, 'sort-name', release_artist_sort_order))), "
        "'label-info', array(named_struct('catalog-number', cast(null as string), 'label', cast(null as struct<name:string>)), named_struct('catalog-number', catalog_number, 'label', named_struct('name', record_label))), "
        "'release-group', named_struct('id', musicbrainz_release_group_id, 'primary-type', if(release_type = 'ep', 'EP', initcap(release_type)), 'secondary-types', array('Live')), 'text-representation', named_struct('script', script), 'media', media)"
    )
    return r.selectExpr("release_id", f"cast({entity} as {adapters.ENTITY}) as e")


@query(sql=f"""
WITH m AS (SELECT release_id, count(*) AS discs FROM (SELECT DISTINCT release_id, media_idx FROM media) GROUP BY 1), x AS (SELECT *, release_date AS d FROM releases)
SELECT release_id, release_title, coalesce(release_artist, '') AS release_artist, catalog_number, record_label, strftime({PARTIAL_SQL}, '%Y-%m-%d') AS release_date, strftime({PARTIAL_SQL}, '%Y') AS release_year,
    CASE WHEN lower(release_status) IN ('official', 'promotion', 'bootleg') THEN lower(release_status) WHEN release_status = 'pseudo-release' THEN 'pseudo-release' END AS release_status,
    CASE WHEN release_type IN ('album', 'single', 'ep', 'broadcast', 'other') THEN release_type ELSE 'live' END AS release_type, CAST(discs AS VARCHAR) AS total_discs FROM x LEFT JOIN m USING (release_id)""")
def q_adapter_release(spark: SparkSession, d: str) -> DataFrame:
    fields = adapters.release_of_entity(F.col("e"))
    shown = ("release_title", "release_artist", "catalog_number", "record_label", "release_date", "release_year", "release_status", "release_type", "total_discs")
    return _entities(spark, d).select("release_id", *[fields[f].alias(f) for f in shown])


@query(sql="""
WITH t AS (SELECT release_id, media_idx, CAST(count(DISTINCT track_id) AS INTEGER) AS n FROM tracks GROUP BY 1, 2), m AS (SELECT DISTINCT ON (release_id, media_idx) release_id, media_idx, disc_number, media_format FROM media)
SELECT release_id, CAST(row_number() OVER (PARTITION BY release_id ORDER BY media_idx) - 1 AS INTEGER) AS media_idx, disc_number, media_format, n AS track_count FROM m LEFT JOIN t USING (release_id, media_idx)""")
def q_adapter_media(spark: SparkSession, d: str) -> DataFrame:
    return adapters.media_of_entity(_entities(spark, d), "release_id", "e").select("release_id", "media_idx", "disc_number", "media_format", F.when(F.col("track_count") >= 0, F.col("track_count")).alias("track_count"))


@query(sql=f"""
WITH t AS (SELECT DISTINCT ON (track_id) *, original_release_date AS d FROM tracks JOIN (SELECT DISTINCT release_id, media_idx FROM media) USING (release_id, media_idx)),
o AS (SELECT *, dense_rank() OVER (PARTITION BY release_id ORDER BY media_idx) - 1 AS m, row_number() OVER (PARTITION BY release_id ORDER BY media_idx, track_idx) - 1 AS position, row_number() OVER (PARTITION BY release_id, media_idx ORDER BY track_idx) - 1 AS i FROM t),
x AS (SELECT release_id, list(DISTINCT media_idx ORDER BY media_idx) AS l FROM media GROUP BY 1)
SELECT release_id, CAST(list_position(x.l, media_idx) - 1 AS INTEGER) AS media_idx, CAST(i AS INTEGER) AS track_idx, CAST(position AS INTEGER) AS position, track_title, coalesce(track_artist, '') AS track_artist, coalesce(track_artist_sort_order, '') AS track_artist_sort_order, track_number,
    track_length[1] * 1000 AS length_ms, musicbrainz_track_id, musicbrainz_recording_id, strftime({PARTIAL_SQL}, '%Y-%m-%d') AS original_release_date, strftime({PARTIAL_SQL}, '%Y') AS original_release_year, genre, isrc, coalesce(producer, []) AS producer FROM o JOIN x USING (release_id)""")
def q_adapter_tracks(spark: SparkSession, d: str) -> DataFrame:
    return adapters.tracks_of_entity(_entities(spark, d), "release_id", "e").select("release_id", "media_idx", "track_idx", "position", "track_title", "track_artist", "track_artist_sort_order", "track_number", "length_ms", "musicbrainz_track_id", "musicbrainz_recording_id", "original_release_date", "original_release_year", "genre", "isrc", "producer")


def _files(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "tracks").select("track_id", "release_id", "media_idx", "track_title", "track_artist", "track_number", "genre").distinct().join(table(spark, d, "releases").select("release_id", "release_title", "release_artist", "source_path"), "release_id")
    value = lambda c: F.when(F.col(c).isNotNull(), F.array(c))
    v2 = F.map_filter(F.create_map(F.lit("TrackTitle"), value("track_title"), F.lit("Artist"), F.when(F.col("track_id") % 3 > 0, value("track_artist")), F.lit("AlbumArtist"), value("release_artist")), lambda k, v: v.isNotNull())
    other = F.map_filter(F.create_map(F.lit("Album"), F.array(F.concat("release_title", F.lit(" (Disc "), (F.col("media_idx") + 1).cast("string"), F.lit(")"))), F.lit("Genre"), F.col("genre"), F.lit("DiscNumber"), F.array(F.concat((F.col("media_idx") + 1).cast("string"), F.lit("/9"))), F.lit("Compilation"), F.array(F.lit("Yes"))), lambda k, v: F.get(v, F.lit(0)).isNotNull())
    fields = adapters.track_of_file(F.array(v2, other), F.concat("source_path", F.lit("/"), F.col("track_id").cast("string"), F.lit(".flac")))
    return t.select("track_id", "release_id", *[c.alias(k) for k, c in fields.items()])


@query(sql="""
WITH t AS (SELECT DISTINCT track_id, release_id, media_idx, track_title, track_artist, track_number, genre FROM tracks)
SELECT track_id, track_title, CASE WHEN track_id % 3 > 0 THEN coalesce(track_artist, release_artist) ELSE release_artist END AS track_artist, CAST(media_idx + 1 AS BIGINT) AS disc_number, true AS is_compilation, CAST(track_id AS VARCHAR) AS track_file_stem FROM t JOIN releases USING (release_id)""")
def q_file_tracks(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).select("track_id", "track_title", "track_artist", "disc_number", "is_compilation", "track_file_stem")


@query(sql="""
WITH t AS (SELECT DISTINCT track_id, release_id, media_idx, track_title, track_artist, track_number, genre FROM tracks)
SELECT release_id, any_value(regexp_replace(release_title || ' (Disc ' || (media_idx + 1) || ')', '(?i)\\s*(?:[\\(\\[]|-)?\\s*(?:CD|Disc)\\s*\\d+\\s*[\\)\\]]?\\s*$', '')) AS release_title, coalesce(any_value(release_artist), CASE WHEN min(CASE WHEN track_id % 3 > 0 THEN track_artist END) = max(CASE WHEN track_id % 3 > 0 THEN track_artist END) THEN max(CASE WHEN track_id % 3 > 0 THEN track_artist END) END) AS release_artist,
    CASE WHEN min(media_idx) = max(media_idx) THEN CAST(max(media_idx) + 1 AS BIGINT) END AS disc_number, count(*) AS track_count FROM t JOIN releases USING (release_id) GROUP BY release_id""")
def q_collection_release(spark: SparkSession, d: str) -> DataFrame:
    return adapters.release_of_collection(_files(spark, d), ["release_id"], ["disc_number"])


@query(sql="""
SELECT l_orderkey, l_linenumber, l_partkey, l_partkey || '.' || l_linenumber AS numbered, l_partkey * 1000 * 1 // 44100 AS ms, CASE WHEN l_quantity = floor(l_quantity) AND l_quantity >= 0 THEN CAST(l_quantity AS BIGINT) END AS whole, split_part(l_partkey || '/' || l_suppkey, '/', 1) AS without_second FROM lineitem""")
def q_misc_scalars(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    key = F.col("l_partkey").cast("string")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", X.numbered_extension(key, F.col("l_linenumber")).alias("numbered"), T.ticks_to_ms(F.col("l_partkey"), F.lit(1), F.lit(44100)).alias("ms"), X.exact_unsigned(F.col("l_quantity")).alias("whole"), X.clear_second_of_pair(F.concat_ws("/", key, F.col("l_suppkey").cast("string"))).alias("without_second"))
