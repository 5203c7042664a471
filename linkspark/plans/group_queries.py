"""Queries of the aggregates, windows, nested traversals and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspark.functions import loudness as L
from linkspark.functions import text as X
from linkspark.operators import consensus as A
from linkspark.operators import disambiguate, rank, relations
from linkspark.plans.registry import query
from linkspark.runtime import table


@query(sql="""
WITH c AS (SELECT user_id, event_type AS v, count(*) AS n, min(event_id) AS f FROM events WHERE event_type IS NOT NULL GROUP BY 1, 2)
SELECT user_id, arg_max(v, row(n, -f)) AS item, max(n) AS count, CAST(sum(n) AS BIGINT) AS total FROM c GROUP BY user_id""")
def q_mode_first_seen(spark: SparkSession, d: str) -> DataFrame:
    return A.mode_first_seen(table(spark, d, "events"), ["user_id"], "event_type", "event_id")


@query(sql="""
SELECT release_id, CASE WHEN min(track_artist) = max(track_artist) THEN max(track_artist) END AS artist,
    coalesce(CASE WHEN min(work_title) = max(work_title) THEN max(work_title) END, CASE WHEN min(mood) = max(mood) THEN max(mood) END) AS work_or_mood FROM tracks GROUP BY release_id""")
def q_consensus(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "tracks")
    return t.groupBy("release_id").agg(A.consensus(F.col("track_artist")).alias("artist"), A.consensus_or(F.col("work_title"), F.col("mood")).alias("work_or_mood"))


@query(sql="""
WITH x AS (SELECT release_id, CASE disc_number % 3 WHEN 0 THEN 'Live (CD ' || disc_number || ')' WHEN 1 THEN 'Live [Disc ' || disc_number || ']' ELSE 'Live - Disc ' || disc_number END AS t FROM media WHERE disc_number IS NOT NULL),
s AS (SELECT release_id, regexp_replace(t, '(?i)\\s*(?:[\\(\\[]|-)?\\s*(?:CD|Disc)\\s*\\d+\\s*[\\)\\]]?\\s*$', '') AS t FROM x)
SELECT release_id, CASE WHEN min(t) = max(t) THEN max(t) END AS title FROM s GROUP BY release_id""")
def q_title_consensus_stripped(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("disc_number")
    t = F.when(n % 3 == 0, F.format_string("Live (CD %d)", n)).when(n % 3 == 1, F.format_string("Live [Disc %d]", n)).otherwise(F.format_string("Live - Disc %d", n))
    m = table(spark, d, "media").where("disc_number is not null").select("release_id", X.strip_disc_suffix(t).alias("t"))
    return m.groupBy("release_id").agg(A.consensus(F.col("t")).alias("title"))


@query(sql="""
WITH o AS (SELECT DISTINCT release_id, media_idx, media_format AS v FROM media), l AS (SELECT *, lag(v) OVER w AS p, row_number() OVER w AS i FROM o WINDOW w AS (PARTITION BY release_id ORDER BY media_idx)),
r AS (SELECT release_id, v, sum(CASE WHEN i = 1 OR v IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (PARTITION BY release_id ORDER BY media_idx) AS run FROM l),
g AS (SELECT release_id, run, any_value(v) AS v, count(*) AS n FROM r GROUP BY 1, 2)
SELECT release_id, string_agg(CASE WHEN n > 1 THEN n || '×' || v ELSE v END, '+' ORDER BY run) AS format FROM g GROUP BY release_id""")
def q_run_length_format(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "media").select("release_id", "media_idx", "media_format").distinct()
    return A.format_runs(A.run_lengths(m, ["release_id"], "media_format", "media_idx"), ["release_id"])


@query(sql="""
WITH o AS (SELECT release_id, list(media_format ORDER BY media_idx) FILTER (WHERE media_format IS NOT NULL) AS l FROM (SELECT DISTINCT release_id, media_idx, media_format FROM media) GROUP BY release_id),
u AS (SELECT release_id, unnest(l) AS v, unnest(range(len(l))) AS i FROM o), g AS (SELECT *, lag(v) OVER (PARTITION BY release_id ORDER BY i) AS p FROM u),
r AS (SELECT release_id, v, sum(CASE WHEN v IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (PARTITION BY release_id ORDER BY i) AS run FROM g), c AS (SELECT release_id, run, any_value(v) AS v, count(*) AS n FROM r GROUP BY 1, 2)
SELECT o.release_id, (SELECT string_agg(CASE WHEN n > 1 THEN n || '×' || v ELSE v END, '+' ORDER BY run) FROM c WHERE c.release_id = o.release_id) AS format FROM o""")
def q_run_length_nested(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "media").select("release_id", "media_idx", "media_format").distinct()
    n = m.groupBy("release_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("media_idx", "media_format"))), lambda x: x["media_format"]).alias("l"))
    return n.select("release_id", A.format_list(F.col("l")).alias("format"))


@query(sql="""
SELECT l_orderkey, l_linestatus AS disc, list(l_partkey ORDER BY l_linenumber, l_partkey) AS items FROM lineitem GROUP BY 1, 2""")
def q_media_split(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return A.media_of(li, ["l_orderkey"], "l_linestatus", "l_linenumber", F.col("l_partkey"))


@query(sql="""
WITH t AS (SELECT DISTINCT release_id, media_idx, track_idx, track_title FROM tracks)
SELECT release_id, CAST(media_idx AS INTEGER) AS part_idx, CAST(track_idx AS INTEGER) AS item_idx, CAST(row_number() OVER (PARTITION BY release_id ORDER BY media_idx, track_idx) - 1 AS INTEGER) AS position, track_title AS item
FROM (SELECT release_id, media_idx, row_number() OVER (PARTITION BY release_id, media_idx ORDER BY track_idx, track_title NULLS FIRST) - 1 AS track_idx, track_title FROM (SELECT release_id, dense_rank() OVER (PARTITION BY release_id ORDER BY media_idx) - 1 AS media_idx, track_idx, track_title FROM t))""")
def q_nested_flatten(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "tracks").select("release_id", "media_idx", "track_idx", "track_title").distinct()
    by_medium = t.groupBy("release_id", "media_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("track_idx", "track_title"))), lambda x: x["track_title"]).alias("media_tracks"))
    nested = by_medium.groupBy("release_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("media_idx", "media_tracks"))), lambda x: F.struct(x["media_tracks"].alias("media_tracks"))).alias("media"))
    return relations.flattened(nested, "release_id", "media", "media_tracks").select("release_id", "part_idx", "item_idx", "position", "item")


def _related(spark: SparkSession, d: str) -> DataFrame:
    """Relations of each track, built from its flat fields."""
    t = table(spark, d, "tracks").select("track_id", "producer", "engineer", "arranger", "writer", "composer", "performers", "track_title").dropDuplicates(["track_id"])
    work = "cast(null as struct<title:string,relations:array<struct<type:string,artist:string>>>)"
    plain = lambda c, kind: f"transform({c}, x -> named_struct('type', '{kind}', 'direction', 'backward', 'artist', x, 'attributes', array(), 'work', {work}))"
    people = f"transform(coalesce(performers, array()), x -> named_struct('type', 'instrument', 'direction', 'backward', 'artist', x[1], 'attributes', array(x[0], 'solo'), 'work', {work}))"
    written = "array(named_struct('type', 'performance', 'direction', 'forward', 'artist', cast(null as string), 'attributes', array(), 'work', named_struct('title', track_title, 'relations', transform(coalesce(composer, array()), x -> named_struct('type', 'composer', 'artist', x)))))"
    parts = ", ".join(f"cast({x} as array<{relations.RELATION}>)" for x in (plain("coalesce(producer, array())", "producer"), plain("coalesce(engineer, array())", "mastering"), plain("coalesce(arranger, array())", "orchestrator"), plain("coalesce(writer, array())", "composer"), people, written))
    return t.selectExpr("track_id", f"concat({parts}) AS rel")


@query(sql="""
WITH t AS (SELECT DISTINCT ON (track_id) track_id, producer, engineer, arranger, writer, composer, performers, track_title FROM tracks)
SELECT track_id, coalesce(producer, []) AS producers, coalesce(engineer, []) AS engineers, coalesce(arranger, []) AS arrangers, list_concat(coalesce(writer, []), coalesce(composer, [])) AS composers,
    list_transform(coalesce(performers, []), lambda x: x[1] || ', solo: ' || x[2]) AS players, track_title AS first_work FROM t""")
def q_relation_roles(spark: SparkSession, d: str) -> DataFrame:
    r = F.col("rel")
    players = F.transform(relations.performers(r), lambda p: F.concat(p["involvement"], F.lit(": "), p["involvee"]))
    return _related(spark, d).select(
        "track_id", relations.role_artists(r, "producer").alias("producers"), relations.role_artists(r, "engineer").alias("engineers"), relations.role_artists(r, "arranger").alias("arrangers"),
        relations.role_artists(r, "composer").alias("composers"), players.alias("players"), relations.first_non_null(F.transform(relations.works(r), lambda w: w["title"])).alias("first_work"),
    )


@query(sql="""
SELECT catalogue_id, coalesce(catalog_number, barcode, release_date) AS first_value, list_filter([catalog_number, barcode, release_date], lambda x: x IS NOT NULL) AS all_values,
    CASE release_status WHEN 'official' THEN 'Official' WHEN 'promotion' THEN 'Promotion' WHEN 'bootleg' THEN 'Bootleg' WHEN 'pseudo-release' THEN 'PseudoRelease' END AS status, [catalog_number, barcode][2] AS second_value FROM catalogue_releases""")
def q_first_non_null(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "catalogue_releases")
    values = F.array("catalog_number", "barcode", "release_date")
    names = {"official": "Official", "promotion": "Promotion", "bootleg": "Bootleg", "pseudo-release": "PseudoRelease"}
    return c.select("catalogue_id", relations.first_non_null(values).alias("first_value"), relations.all_non_null(values).alias("all_values"), relations.mapped(F.col("release_status"), names).alias("status"), rank.item_at(F.array("catalog_number", "barcode"), 1).alias("second_value"))


@query(sql="""
SELECT user_id, string_agg(event_type || '=' || n || ':' || first_k, ';' ORDER BY event_type) AS entries FROM (SELECT user_id, event_type, count(*) AS n, min(props) AS first_k FROM events GROUP BY 1, 2) GROUP BY user_id""")
def q_group_to_map(spark: SparkSession, d: str) -> DataFrame:
    m = A.collect_map(table(spark, d, "events"), ["user_id"], "event_type", "props")
    shown = F.transform(F.map_entries("entries"), lambda e: F.concat(e["key"], F.lit("="), F.size(e["value"]).cast("string"), F.lit(":"), e["value"][0]))
    return m.select("user_id", F.array_join(shown, ";").alias("entries"))


@query(sql="""
WITH a AS (SELECT s_nationkey % 5 AS k, s_nationkey AS involvement, s_name AS l, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_name) AS n FROM supplier),
b AS (SELECT c_nationkey % 5 AS k, c_nationkey AS involvement, c_name AS r, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name) AS n FROM customer)
SELECT coalesce(a.k, b.k) AS k, coalesce(a.involvement, b.involvement) AS involvement, CAST(coalesce(a.n, b.n) AS INTEGER) AS n, l AS "left", r AS "right" FROM a FULL JOIN b ON a.k = b.k AND a.involvement = b.involvement AND a.n = b.n""")
def q_person_merge_join(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "supplier").select((F.col("s_nationkey") % 5).alias("k"), F.col("s_nationkey").alias("role"), F.col("s_name").alias("who"))
    b = table(spark, d, "customer").select((F.col("c_nationkey") % 5).alias("k"), F.col("c_nationkey").alias("role"), F.col("c_name").alias("who"))
    return relations.merged_people(a, b, "k", "role", "who")


def _sql_needs() -> str:
    cases = " ".join(f"WHEN count(DISTINCT row({', '.join(s)})) = count(*) THEN '{','.join(s)}'" for s in disambiguate.FIELD_SETS)
    return f"SELECT release_artist, release_title, count(*) AS n, CASE WHEN count(*) = 1 THEN '' {cases} ELSE '{','.join(disambiguate.FIELD_SETS[-1])}' END AS needs FROM catalogue_releases GROUP BY 1, 2"


@query(sql=_sql_needs())
def q_disambiguation(spark: SparkSession, d: str) -> DataFrame:
    return disambiguate.distinguishing_fields(table(spark, d, "catalogue_releases"), ["release_artist", "release_title"])


@query(sql="""
SELECT l_orderkey, max(l_extendedprice) AS album_peak, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS album_blocks, round(10 * log10(sum(l_tax + 0.01) / sum(CAST(l_quantity AS BIGINT))) - 0.691, 6) AS album_lufs FROM lineitem
GROUP BY l_orderkey HAVING count(*) FILTER (WHERE l_returnflag = 'N') = 0
UNION ALL SELECT l_orderkey, NULL, NULL, NULL FROM lineitem GROUP BY l_orderkey HAVING count(*) FILTER (WHERE l_returnflag = 'N') > 0""")
def q_album_loudness(spark: SparkSession, d: str) -> DataFrame:
    ok = F.col("l_returnflag") != "N"
    li = table(spark, d, "lineitem").select("l_orderkey", F.when(ok, F.col("l_extendedprice")).alias("p"), F.when(ok, F.col("l_quantity").cast("bigint")).alias("b"), F.when(ok, F.col("l_tax") + 0.01).alias("e"))
    g = li.groupBy("l_orderkey").agg(*L.album_aggregates(F.col("p"), F.col("b"), F.col("e")))
    return g.withColumn("album_lufs", F.round("album_lufs", 6))


@query(sql="SELECT l_orderkey, l_linenumber, l_partkey, printf('%.2f', -18.0::DOUBLE + l_discount * 100) || ' dB' AS gain, printf('%.6f', l_tax) AS peak FROM lineitem")
def q_gain_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", L.gain_text(-F.col("l_discount") * 100).alias("gain"), L.peak_text(F.col("l_tax")).alias("peak"))


@query(sql="SELECT vec_id, list_max(list_transform(embedding, lambda x: abs(x))) AS peak, list_transform(embedding, lambda x: CAST(least(greatest(trunc(x::DOUBLE * 32768), -32768), 32767) AS INTEGER)) AS quantised FROM embeddings")
def q_sample_peak(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", L.channel_peak(F.col("embedding")).alias("peak"), L.quantise(F.col("embedding")).alias("quantised"))


@query(sql="SELECT vec_id, round(20 * log10(list_max(list_transform(embedding, lambda x: abs(x)))::DOUBLE), 6) AS db, round(pow(10, label / 20.0::DOUBLE), 9) AS ratio FROM embeddings")
def q_decibels(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select("vec_id", F.round(L.ratio_to_db(L.channel_peak(F.col("embedding")).cast("double")), 6).alias("db"), F.round(L.db_to_ratio(F.col("label").cast("double")), 9).alias("ratio"))


@query(sql="SELECT release_id, bool_or(gapless_playback) AS any_gapless, coalesce(bool_and(gapless_playback), true) AS all_gapless, count(*) AS media FROM media GROUP BY release_id".replace("bool_or(gapless_playback)", "coalesce(bool_or(gapless_playback), false)"))
def q_flag_folds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "media").groupBy("release_id").agg(A.any_of(F.col("gapless_playback")).alias("any_gapless"), A.all_of(F.col("gapless_playback")).alias("all_gapless"), F.count("*").alias("media"))


@query(sql="""
WITH p AS (SELECT DISTINCT track_id, performers FROM tracks WHERE len(performers) > 0)
SELECT track_id, list_concat(list_transform(list_filter(performers, lambda x: x[1] <> 'violin'), lambda x: x[1] || ':' || x[2]), ['violin:A', 'violin:B']) AS people FROM p""")
def q_replace_people(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "tracks").where("size(performers) > 0").select("track_id", "performers").distinct()
    people = F.transform("performers", lambda x: F.struct(x[0].alias("involvement"), x[1].alias("involvee")))
    new = relations.replaced(people, F.lit("violin"), F.array(F.lit("A"), F.lit("B")))
    return p.select("track_id", F.transform(new, lambda x: F.concat_ws(":", x["involvement"], x["involvee"])).alias("people"))


@query(sql="""
WITH t AS (SELECT release_id, max(media_idx) AS m FROM tracks GROUP BY 1), s AS (SELECT release_id, list(DISTINCT media_idx) AS have FROM tracks GROUP BY 1)
SELECT release_id, list_sort(list_filter(range(10), lambda x: NOT list_contains(list_transform(have, lambda h: CAST(h AS BIGINT)), x))) AS missing FROM s""")
def q_set_difference(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "tracks").groupBy("release_id").agg(F.collect_set(F.col("media_idx").cast("bigint")).alias("have"))
    return s.select("release_id", A.missing_from(F.col("have"), F.sequence(F.lit(0).cast("bigint"), F.lit(9).cast("bigint"))).alias("missing"))


@query(sql="SELECT release_id, CAST(count(*) AS BIGINT) AS tracks, CAST(count(DISTINCT media_idx) AS BIGINT) AS media FROM (SELECT DISTINCT release_id, media_idx, track_idx FROM tracks) GROUP BY release_id")
def q_track_counts(spark: SparkSession, d: str) -> DataFrame:
    return A.item_counts(table(spark, d, "tracks"), ["release_id"], ["media_idx", "track_idx"]).withColumnsRenamed({"items": "tracks", "parts": "media"})


@query(sql="""
SELECT catalogue_id, 1 | CASE WHEN media_format IS NOT NULL THEN 2 ELSE 0 END | CASE WHEN barcode IS NOT NULL THEN 32 ELSE 0 END AS mask, media_format IS NOT NULL AND barcode IS NOT NULL AS both_shown FROM catalogue_releases""")
def q_field_masks(spark: SparkSession, d: str) -> DataFrame:
    names = ["release_year", "media_format", "release_country", "record_label", "catalog_number", "barcode"]
    mask = F.lit(disambiguate.bitmask(["release_year"], names)).bitwiseOR(F.when(F.col("media_format").isNotNull(), disambiguate.bitmask(["media_format"], names)).otherwise(0)).bitwiseOR(F.when(F.col("barcode").isNotNull(), disambiguate.bitmask(["barcode"], names)).otherwise(0))
    c = table(spark, d, "catalogue_releases").select("catalogue_id", mask.alias("mask"))
    return c.withColumn("both_shown", disambiguate.contains_all(F.col("mask"), disambiguate.bitmask(["media_format", "barcode"], names)))


@query(sql="""
SELECT release_id, array_to_string(list_transform(l, lambda x: x), '; ') AS sort_names, array_to_string(l, '') AS credit FROM (SELECT release_id, list(DISTINCT track_artist ORDER BY track_artist) FILTER (WHERE track_artist IS NOT NULL) AS l FROM tracks GROUP BY 1) WHERE l IS NOT NULL""")
def q_joined_credit(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "tracks").where("track_artist is not null").groupBy("release_id").agg(F.array_sort(F.collect_set("track_artist")).alias("l"))
    credits = F.transform("l", lambda x: F.struct(x.alias("name"), F.lit(None).cast("string").alias("joinphrase")))
    return t.select("release_id", F.array_join("l", "; ").alias("sort_names"), A.joined_credit(credits).alias("credit"))
