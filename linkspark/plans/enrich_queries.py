"""Queries of enrichment, and of functions that no other query shows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspark.functions import difference as D
from linkspark.functions import distance as M
from linkspark.functions import text as X
from linkspark.functions.template import COMPILATION_FORMAT, formatted_path
from linkspark.operators import enrichment, rank, relations
from linkspark.plans.registry import query
from linkspark.plans.text_queries import sql_escape
from linkspark.runtime import table
from linkspark.sources import cache, tags

#: Fields that the flat tables lack.
_ABSENT = {"grouping", "comment", "language"}


def _present(fields: dict[str, str]) -> dict[str, str]:
    return {k: f for k, f in fields.items() if f not in _ABSENT}


def _tags_sql() -> str:
    texts = _present(enrichment.RELEASE_FIELDS | enrichment.TRACK_FIELDS) | {"DiscSubtitle": "media_title", "Media": "media_format", "MusicBrainzDiscId": "musicbrainz_disc_id"}
    cells = [f"('{k}', CASE WHEN {f} IS NOT NULL THEN [CAST({f} AS VARCHAR)] END)" for k, f in texts.items()] + [f"('{k}', CASE WHEN len({f}) > 0 THEN {f} END)" for k, f in enrichment.TRACK_LISTS.items()]
    cells += ["('GaplessPlayback', CASE WHEN gapless_playback THEN ['1'] WHEN NOT gapless_playback THEN ['0'] END)", "('TotalTracks', [CAST(n AS VARCHAR)])", "('DiscNumber', [CAST(media_idx + 1 AS VARCHAR)])"]
    cells += ["('ReplayGainAlbumGain', CASE WHEN replay_gain_album_gain_analyzed IS NOT NULL THEN [replay_gain_album_gain_analyzed] END)", "('ReplayGainAlbumPeak', CASE WHEN replay_gain_album_peak_analyzed IS NOT NULL THEN [replay_gain_album_peak_analyzed] END)", "('Mine', ['x'])"]
    listed = ", ".join(f"{{'key': {c.split(',', 1)[0][1:]}, 'v': {c.split(',', 1)[1][:-1]}}}" for c in cells)
    return f"""
WITH t AS (SELECT DISTINCT ON (track_id) * EXCLUDE (ingested_at, tagged_at) FROM tracks), m AS (SELECT DISTINCT ON (release_id, media_idx) * EXCLUDE (ingested_at) FROM media),
n AS (SELECT release_id, media_idx, count(DISTINCT track_idx) AS n FROM tracks GROUP BY 1, 2),
j AS (SELECT * FROM t JOIN m USING (release_id, media_idx) JOIN n USING (release_id, media_idx) JOIN releases USING (release_id)),
c AS (SELECT track_id, unnest([{listed}]) AS e FROM j),
p AS (SELECT track_id, unnest(performers) AS p, unnest(range(len(performers))) AS i FROM j)
SELECT track_id, e.key AS key, array_to_string(e.v, '; ') AS value FROM c WHERE e.v IS NOT NULL
UNION ALL SELECT track_id, 'Performer:' || p[1], string_agg(p[2], '; ' ORDER BY i) FROM p GROUP BY 1, 2"""


@query(sql=_tags_sql())
def q_assign_tags(spark: SparkSession, d: str) -> DataFrame:
    """Every track as a file that held other tags takes over its release, medium and track; one row a key."""
    t = table(spark, d, "tracks").drop("ingested_at", "tagged_at").dropDuplicates(["track_id"])
    m = table(spark, d, "media").drop("ingested_at").dropDuplicates(["release_id", "media_idx"])
    n = t.groupBy("release_id", "media_idx").agg(F.count_distinct("track_idx").alias("n"))
    j = t.join(m, ["release_id", "media_idx"]).join(n, ["release_id", "media_idx"]).join(table(spark, d, "releases").drop("ingested_at", "tagged_at"), "release_id")
    columns = {f: F.col(f) for f in j.columns}
    media = columns | {"gapless_playback": enrichment.gapless_text(F.col("gapless_playback")), "media_track_count": F.col("n"), "media_position": F.col("media_idx") + 1}
    analyzed = {"replay_gain_album_gain": F.col("replay_gain_album_gain_analyzed"), "replay_gain_album_peak": F.col("replay_gain_album_peak_analyzed")}
    old = F.create_map(*[F.lit(x) if isinstance(x, str) else x for k in ("TrackTitle", "Lyricist", "Performer:kazoo", "AcoustIdFingerprint", "Grouping", "Mine") for x in (k, F.array(F.lit("x")))])
    made = enrichment.assigned_tags(old, columns, media, columns, analyzed)
    return j.select("track_id", F.explode(made).alias("key", "v")).select("track_id", "key", F.array_join("v", "; ").alias("value"))


@query(sql=f"""
WITH t AS (SELECT DISTINCT track_id, release_id, media_idx, track_idx, track_title, track_artist FROM tracks), n AS (SELECT release_id, count(*) AS tracks, max(media_idx) + 1 AS discs FROM t GROUP BY 1),
f AS (SELECT * FROM t JOIN n USING (release_id) JOIN releases USING (release_id) WHERE is_compilation),
e AS (SELECT track_id, {sql_escape("coalesce(release_artist, '')")} AS a, {sql_escape("coalesce(release_title, '')")} AS r, {sql_escape("coalesce(track_title, '')")} AS t, {sql_escape("coalesce(track_artist, '')")} AS c, release_year AS y, CAST(track_idx + 1 AS VARCHAR) AS i, length(CAST(tracks AS VARCHAR)) AS w, CAST(media_idx + 1 AS VARCHAR) AS m, length(CAST(discs AS VARCHAR)) AS dw, discs FROM f)
SELECT track_id, a || '/' || CASE WHEN y IS NULL OR y IN ('', '0', 'false') THEN '' ELSE CASE WHEN length(y) >= 4 THEN y ELSE lpad(y, 4, '0') END || ' - ' END || r || '/' || CASE WHEN discs > 1 THEN CASE WHEN length(m) >= dw THEN m ELSE lpad(m, CAST(dw AS INTEGER), '0') END || '-' ELSE '' END
    || CASE WHEN length(i) >= w THEN i ELSE lpad(i, CAST(w AS INTEGER), '0') END || ' - ' || c || ' - ' || t || '.mp3' AS path FROM e""")
def q_compilation_path(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "tracks").select("track_id", "release_id", "media_idx", "track_idx", "track_title", "track_artist").distinct()
    n = t.groupBy("release_id").agg(F.count("*").alias("tracks"), (F.max("media_idx") + 1).alias("discs"))
    j = t.join(n, "release_id").join(table(spark, d, "releases").where("is_compilation").select("release_id", "release_title", "release_artist", "release_year"), "release_id")
    text = lambda c: F.coalesce(c, F.lit(""))
    values = {
        "album_artist": text("release_artist"), "album_title": text("release_title"), "year": F.col("release_year"), "track_title": text("track_title"), "artist_credit": text("track_artist"), "disc_index": F.when(F.col("discs") > 1, F.col("media_idx") + 1),
        "disc_count_width": X.decimal_width(F.col("discs")), "track_index": F.col("track_idx") + 1, "track_count_width": X.decimal_width(F.col("tracks")),
    }
    return j.select("track_id", formatted_path(COMPILATION_FORMAT, values, F.lit("mp3")).alias("path"))


@query(sql="""
WITH t AS (SELECT DISTINCT track_id, release_id, track_number, track_title, track_artist, composer, performers FROM tracks)
SELECT track_id, array_to_string(composer, ' / ') AS composers, concat_ws(' ', track_number || '.', concat_ws(' - ', track_artist, coalesce(track_title, '[unknown title]')), '(1:00)') AS line,
    coalesce(regexp_replace(track_title, chr(0) || '$', ''), '') AS bare, list_transform(list_filter(coalesce(performers, []), lambda p: p[1] = 'guitar'), lambda p: p[2]) AS guitarists,
    split_part(track_number || '/12', '/', 1) AS number, CASE WHEN track_number IS NOT NULL THEN '12' END AS total, coalesce(list_contains(composer, track_artist), false) AS composed FROM t""")
def q_track_lines(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "tracks").select("track_id", "release_id", "track_number", "track_title", "track_artist", "composer", "performers").distinct()
    people = F.transform(F.coalesce("performers", F.array().cast("array<array<string>>")), lambda p: F.struct(p[0].alias("involvement"), p[1].alias("involvee")))
    number, total = tags.total_and_number(F.concat("track_number", F.lit("/12")))
    credits = F.transform("composer", lambda c: F.struct(c.alias("name")))
    composed = F.exists(credits, lambda c: c["name"] == F.col("track_artist"))
    return t.select(
        "track_id", X.join_values(F.col("composer")).alias("composers"), X.track_line(F.col("track_number"), F.col("track_title"), F.col("track_artist"), F.lit("1:00")).alias("line"),
        F.coalesce(X.strip_trailing_nul(F.concat("track_title", F.lit("\0"))), F.lit("")).alias("bare"), tags.performers_of(people, F.lit("guitar")).alias("guitarists"), number.alias("number"), total.alias("total"),
        F.coalesce(composed, F.lit(False)).alias("composed"),
    )


@query(sql="SELECT release_id, coalesce(list_contains([release_artist, record_label], 'Cholwewon Records'), false) AS credited, 'release/' || release_id || '.json' AS path, sha256(coalesce(release_title, '') || chr(124) || chr(5) || chr(124) || chr(0) || chr(0)) || '.json' AS search FROM releases")
def q_cache_paths(spark: SparkSession, d: str) -> DataFrame:
    credits = F.array(F.struct(F.col("release_artist").alias("name")), F.struct(F.col("record_label").alias("name")))
    search = F.regexp_replace(cache.cache_path("search", F.coalesce("release_title", F.lit(""))), "^search/", "")
    return table(spark, d, "releases").select("release_id", relations.any_credit(credits, "name", "Cholwewon Records").alias("credited"), cache.cache_path("release", F.col("release_id").cast("string")).alias("path"), search.alias("search"))


@query(sql="""
SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'N' THEN 0::DOUBLE ELSE 1::DOUBLE END AS flag_distance, CASE WHEN l_quantity = 0 THEN 0::DOUBLE ELSE l_discount / l_quantity END AS ratio,
    CAST(floor(l_discount * 100000) AS BIGINT) AS steps, CASE WHEN l_linenumber > 3 AND l_linestatus = 'F' THEN 1::DOUBLE WHEN l_linenumber > 3 THEN 1::DOUBLE WHEN l_linestatus = 'F' THEN 1::DOUBLE ELSE 0::DOUBLE END AS between FROM lineitem""")
def q_plain_distances(spark: SparkSession, d: str) -> DataFrame:
    """Distances of flags, ratios and optional values; optional ones are equal, or missing on one side or both."""
    li = table(spark, d, "lineitem")
    number = F.when(F.col("l_linenumber") <= 3, F.col("l_linenumber"))
    other = F.when(F.col("l_linestatus") != "F", F.col("l_linenumber"))
    between = F.when(number.isNull(), D.between_or_minmax(F.lit(1), F.lit(None).cast("int"), D.number_distance)).otherwise(D.between_or_minmax(number, other, D.number_distance))
    return li.select("l_orderkey", "l_linenumber", D.bool_distance(F.col("l_returnflag") == "N").alias("flag_distance"), D.ratio_distance(F.col("l_discount"), F.col("l_quantity")).alias("ratio"), M.quantised_cost(F.col("l_discount")).alias("steps"), between.alias("between"))


@query(sql="""
WITH t AS (SELECT DISTINCT t.release_id, track_id, disc_number, source_path || '/' || track_id AS path FROM tracks t JOIN (SELECT DISTINCT release_id, media_idx, disc_number FROM media) m USING (release_id, media_idx) JOIN releases r USING (release_id))
SELECT release_id, track_id, CAST(row_number() OVER (PARTITION BY release_id ORDER BY coalesce(CAST(disc_number AS VARCHAR), ''), path) AS INTEGER) AS place FROM t""")
def q_disc_order(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    m = table(spark, d, "media").select("release_id", "media_idx", "disc_number").distinct()
    t = table(spark, d, "tracks").select("release_id", "media_idx", "track_id").distinct().join(m, ["release_id", "media_idx"]).join(table(spark, d, "releases").select("release_id", "source_path"), "release_id")
    order = rank.disc_order(F.col("disc_number"), F.concat_ws("/", "source_path", F.col("track_id").cast("string")))
    return t.select("release_id", "track_id", F.row_number().over(Window.partitionBy("release_id").orderBy(*order)).alias("place"))


@query(sql="SELECT catalogue_id, release_title FROM catalogue_releases WHERE catalogue_id = (SELECT min(catalogue_id) FROM catalogue_releases)")
def q_chosen(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "catalogue_releases").select("catalogue_id", "release_title")
    return rank.chosen(c, "catalogue_id", c.agg(F.min("catalogue_id")).first()[0])
