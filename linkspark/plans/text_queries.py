"""Queries of the scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspark.functions import difference as D
from linkspark.functions import distance as M
from linkspark.functions import temporal as T
from linkspark.functions import text as X
from linkspark.functions import textdiff, transliterate
from linkspark.functions.template import ALBUM_FORMAT, formatted_path
from linkspark.plans.registry import query
from linkspark.runtime import table


def sql_fold(c: str) -> str:
    """DuckDB's version of ``fold_latin``."""
    source, target = X.latin_fold_table()
    out = f"translate({c}, '{source}', '{target}')"
    for letter, ascii_form in X.DIGRAPHS.items():
        out = f"replace({out}, '{letter}', '{ascii_form}')"
    return out


def sql_normalize(c: str) -> str:
    return f"replace(regexp_replace(lower({sql_fold(c)}), '(?s)^(.*), (the|a|an)$', '\\2 \\1'), '&', 'and')"


def sql_ascii(c: str) -> str:
    return f"regexp_replace({c}, '[^\\x00-\\x7F]', '', 'g')"


def sql_distance(a: str, b: str) -> str:
    return f"CASE WHEN greatest(length({a}), length({b})) = 0 THEN 0::DOUBLE ELSE levenshtein({a}, {b})::DOUBLE / greatest(length({a}), length({b})) END"


PARTIAL_SQL = """coalesce(
    try_strptime(CASE WHEN regexp_full_match(d, '[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}') THEN d END, '%Y-%m-%d')::DATE,
    try_strptime(CASE WHEN regexp_full_match(d, '[0-9]{4}-[0-9]{1,2}') THEN d || '-01' END, '%Y-%m-%d')::DATE,
    try_strptime(CASE WHEN regexp_full_match(d, '[0-9]{8}') THEN d END, '%Y%m%d')::DATE,
    try_strptime(CASE WHEN regexp_full_match(d, '[0-9]{6}') THEN d || '01' END, '%Y%m%d')::DATE,
    try_strptime(CASE WHEN regexp_full_match(d, '[0-9]{4}') THEN d || '0101' END, '%Y%m%d')::DATE)"""


@query(sql=f"SELECT release_id, {sql_ascii(sql_normalize('release_title'))} AS title, {sql_ascii(sql_normalize('release_artist'))} AS artist FROM releases")
def q_normalize(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "releases")
    return r.select("release_id", *[X.strip_non_ascii(X.normalize(F.col(f"release_{c}"))).alias(c) for c in ("title", "artist")])


@query
def q_transliterate(spark: SparkSession, d: str) -> DataFrame:
    titles = table(spark, d, "tracks").select("track_title").distinct()
    return titles.select("track_title", transliterate.transliterate("track_title").alias("ascii_title"))


@query(sql=f"""
WITH a AS (SELECT catalogue_id, {sql_ascii(sql_normalize('release_title'))} AS t, barcode AS k FROM catalogue_releases WHERE barcode <> '' AND barcode <> '0000000000000'),
b AS (SELECT release_id, {sql_ascii(sql_normalize('release_title'))} AS t, barcode AS k FROM releases)
SELECT release_id, catalogue_id, round({sql_distance('b.t', 'a.t')}, 6) AS distance FROM a JOIN b USING (k)""")
def q_string_distance(spark: SparkSession, d: str) -> DataFrame:
    form = X.strip_non_ascii(X.normalize(F.col("release_title"))).alias("t")
    a = table(spark, d, "catalogue_releases").where("barcode <> '' and barcode <> '0000000000000'").select("catalogue_id", form.alias("a"), "barcode")
    b = table(spark, d, "releases").select("release_id", form.alias("b"), "barcode")
    return a.join(b, "barcode").select("release_id", "catalogue_id", F.round(X.normalized_distance(F.col("b"), F.col("a")), 6).alias("distance"))


@query(sql="""
SELECT a.release_id, a.track_id AS left_id, b.track_id AS right_id,
    CASE WHEN trim(a.musicbrainz_artist_id) = trim(b.musicbrainz_artist_id) AND trim(a.musicbrainz_artist_id) <> '' THEN 0::DOUBLE ELSE 1::DOUBLE END AS id_distance,
    CASE WHEN regexp_replace(a.track_number, '^0+', '') = regexp_replace(b.track_number, '^0+', '') THEN 0 ELSE 1 END AS number_differs
FROM tracks a JOIN tracks b ON a.release_id = b.release_id AND a.media_idx = b.media_idx AND b.track_idx = a.track_idx + 1
WHERE a.musicbrainz_artist_id IS NOT NULL AND b.musicbrainz_artist_id IS NOT NULL AND a.track_number IS NOT NULL AND b.track_number IS NOT NULL""")
def q_id_distance(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "tracks").where("musicbrainz_artist_id is not null and track_number is not null").select("release_id", "media_idx", "track_idx", "track_id", "musicbrainz_artist_id", "track_number")
    a, b = t.alias("a"), t.withColumn("track_idx", F.col("track_idx") - 1).alias("b")
    j = a.join(b, ["release_id", "media_idx", "track_idx"])
    number = F.when(X.trim_leading_zeros(F.col("a.track_number")) == X.trim_leading_zeros(F.col("b.track_number")), 0).otherwise(1)
    return j.select("release_id", F.col("a.track_id").alias("left_id"), F.col("b.track_id").alias("right_id"), M.identifier_distance(F.col("a.musicbrainz_artist_id"), F.col("b.musicbrainz_artist_id")).alias("id_distance"), number.alias("number_differs"))


@query(sql="""
SELECT a.l_orderkey, a.l_linenumber, least(greatest(abs(CAST(round(a.l_extendedprice) AS BIGINT) - CAST(round(b.l_extendedprice) AS BIGINT)) - 10000, 0), 30000) // 1000 / 30.0::DOUBLE AS distance
FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1""")
def q_duration_distance(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round("l_extendedprice").cast("bigint").alias("ms"))
    j = li.alias("a").join(li.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("ms").alias("b_ms")), ["l_orderkey", "l_linenumber"])
    return j.select("l_orderkey", "l_linenumber", M.length_distance(F.col("ms"), F.col("b_ms")).alias("distance"))


@query(sql="""
WITH x AS (SELECT release_id, catalog_number AS l, barcode AS r FROM releases),
s AS (SELECT *, CASE WHEN l IS NULL AND r IS NULL THEN 'both_missing' WHEN l IS NULL THEN 'added' WHEN r IS NULL THEN 'removed' ELSE 'both_present' END AS state, CASE WHEN l IS NOT NULL AND r IS NOT NULL THEN CASE WHEN l = r THEN 0::DOUBLE ELSE 1::DOUBLE END END AS dist FROM x)
SELECT release_id, state, dist, CASE WHEN state = 'both_missing' THEN 0 WHEN state <> 'both_present' THEN 1 ELSE dist END::DOUBLE AS total, state IN ('removed', 'both_present') AS left_present, state = 'both_missing' OR coalesce(dist = 0, false) AS equal FROM s""")
def q_difference_states(spark: SparkSession, d: str) -> DataFrame:
    diff = D.difference(F.col("catalog_number"), F.col("barcode"), D.number_distance)
    r = table(spark, d, "releases").select("release_id", diff.alias("d"))
    c = F.col("d")
    return r.select("release_id", c["state"].alias("state"), D.distance_if_present(c).alias("dist"), D.to_distance(c).alias("total"), D.is_present_left(c).alias("left_present"), D.is_equal(c).alias("equal"))


@query(sql="SELECT l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 9) AS mean_discount FROM lineitem GROUP BY l_returnflag")
def q_weighted_mean_set(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(M.weighted_mean_agg(F.col("l_discount"), F.col("l_quantity")), 9).alias("mean_discount"))


@query(sql=f"""
WITH x AS (SELECT release_id, release_date AS d FROM releases WHERE release_date IS NOT NULL), p AS (SELECT release_id, d, {PARTIAL_SQL} AS day FROM x)
SELECT release_id, d AS release_date, day, strftime(day, '%Y') AS year FROM p""")
def q_partial_date(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "releases").where("release_date is not null")
    return r.select("release_id", "release_date", T.partial_date(F.col("release_date")).alias("day"), T.partial_year(F.col("release_date")).alias("year"))


@query(sql="SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS date_text, strftime(o_orderdate, '%Y') AS year_text FROM orders")
def q_date_format(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", T.date_text(F.col("o_orderdate")).alias("date_text"), T.year_text(F.col("o_orderdate")).alias("year_text"))


@query(sql=f"""
WITH x AS (SELECT track_id, ingested_at, original_release_date AS d FROM tracks WHERE original_release_date IS NOT NULL)
SELECT track_id, ingested_at, strftime({PARTIAL_SQL}, '%Y') AS original_year FROM x""")
def q_year_derived(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "tracks").where("original_release_date is not null")
    return t.select("track_id", "ingested_at", T.partial_year(F.col("original_release_date")).alias("original_year"))


@query(sql="""
WITH x AS (SELECT track_id, ingested_at, track_length[1] * 1000 + track_length[2] // 1000000 AS ms FROM tracks WHERE len(track_length) = 2), s AS (SELECT *, ms // 1000 AS t FROM x)
SELECT track_id, ingested_at, ms, CASE WHEN t >= 3600 THEN printf('%d:%02d:%02d', t // 3600, t % 3600 // 60, t % 60) ELSE printf('%d:%02d', t // 60, t % 60) END AS shown FROM s""")
def q_duration_format(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "tracks").where("size(track_length) = 2").select("track_id", "ingested_at", T.length_ms(F.col("track_length")).alias("ms"))
    return t.withColumn("shown", T.duration_text(F.col("ms")))


UUID_SQL = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12)"
HOST = "catalogue.example"
CASES_SQL = f"""CASE p_partkey % 6 WHEN 0 THEN u WHEN 1 THEN 'https://{HOST}/recording/' || u WHEN 2 THEN 'http://{HOST}/ws/2/release-group/' || u || '?inc=x'
    WHEN 3 THEN 'https://other.example/release/' || u WHEN 4 THEN 'see ' || u ELSE 'https://{HOST}/release/' || u END"""


@query(sql=f"""
WITH h AS (SELECT p_partkey, md5(CAST(p_partkey AS VARCHAR)) AS h FROM part), u AS (SELECT p_partkey, {UUID_SQL} AS u FROM h), t AS (SELECT p_partkey, {CASES_SQL} AS link FROM u),
e AS (SELECT p_partkey, link, regexp_extract(link, '{X.entity_pattern(HOST)}', 2) AS i, regexp_extract(link, '{X.entity_pattern(HOST)}', 1) AS k FROM t)
SELECT p_partkey, nullif(i, '') AS entity_id, CASE WHEN i = '' THEN NULL WHEN k = '' THEN 'release' ELSE k END AS entity_kind,
    CASE WHEN i = '' THEN 'not an id' WHEN k IN ('', 'release', 'release-group') THEN NULL ELSE 'expected a release, not: ' || k END AS problem FROM e""")
def q_entity_id(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "part").select("p_partkey", F.md5(F.col("p_partkey").cast("string")).alias("h"))
    u = h.selectExpr("p_partkey", f"{UUID_SQL} AS u").selectExpr("p_partkey", f"{CASES_SQL} AS link")
    c = F.col("link")
    return u.select("p_partkey", X.entity_id(c, HOST).alias("entity_id"), X.entity_kind(c, HOST).alias("entity_kind"), X.entity_problem(c, HOST).alias("problem"))


@query(sql="SELECT p_partkey, sha256(encode(p_name) || '\\x7C\\x05\\x7C\\x00\\x00'::BLOB) AS cache_key FROM part")
def q_cache_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", X.query_key(F.col("p_name"), 5, 0).alias("cache_key"))


@query(sql="""
SELECT release_id, regexp_replace(regexp_replace(regexp_replace(release_title, '[\\x00-\\x1F\\x7F-\\x{9F}]', '', 'g'), '[\\s\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]', ' ', 'g'), '/', '_', 'g') AS safe FROM releases WHERE release_title IS NOT NULL""")
def q_escape(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "releases").where("release_title is not null").select("release_id", X.escape_path_chars(F.col("release_title")).alias("safe"))


@query(sql="SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN length(CAST(l_partkey AS VARCHAR)) >= 3 THEN CAST(l_partkey AS VARCHAR) ELSE lpad(CAST(l_partkey AS VARCHAR), 3, '0') END AS padded, CAST(length(CAST(l_partkey AS VARCHAR)) AS INTEGER) AS digits FROM lineitem")
def q_zfill(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", X.zfill(F.col("l_partkey"), 3).alias("padded"), X.decimal_width(F.col("l_partkey")).alias("digits"))


def sql_escape(c: str) -> str:
    """DuckDB's version of ``escape_path_chars``."""
    white = X._WHITE[1:-1].replace("\\s", "\\t\\n\\f\\r ")
    return f"replace(regexp_replace(regexp_replace({c}, '[\\x00-\\x1F\\x{{7F}}-\\x{{9F}}]', '', 'g'), '[{white}]', ' ', 'g'), '/', '_')"


@query(sql=f"""
WITH n AS (SELECT release_id, media_idx, count(*) AS tracks FROM (SELECT DISTINCT release_id, media_idx, track_idx FROM tracks) GROUP BY 1, 2),
f AS (SELECT DISTINCT t.track_id, t.release_id, t.media_idx, t.track_idx, t.track_title, r.release_title, r.release_artist, r.release_year, n.tracks FROM tracks t JOIN releases r USING (release_id) JOIN n USING (release_id, media_idx) WHERE t.track_title IS NOT NULL AND r.release_title IS NOT NULL AND r.release_artist IS NOT NULL),
e AS (SELECT track_id, {sql_escape('release_artist')} AS a, {sql_escape('release_title')} AS r, {sql_escape('track_title')} AS t, release_year AS y, CAST(track_idx + 1 AS VARCHAR) AS i, length(CAST(tracks AS VARCHAR)) AS w, CAST(media_idx + 1 AS VARCHAR) AS m FROM f)
SELECT track_id, a || '/' || CASE WHEN y IS NULL OR y IN ('', '0', 'false') THEN '' ELSE CASE WHEN length(y) >= 4 THEN y ELSE lpad(y, 4, '0') END || ' - ' END || r || '/' || m || '-' || CASE WHEN length(i) >= w THEN i ELSE lpad(i, CAST(w AS INTEGER), '0') END || ' - ' || t || '.flac' AS path FROM e""")
def q_path_template(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "tracks").select("track_id", "release_id", "media_idx", "track_idx", "track_title").distinct()
    n = t.select("release_id", "media_idx", "track_idx").distinct().groupBy("release_id", "media_idx").agg(F.count("*").alias("tracks"))
    r = table(spark, d, "releases").select("release_id", "release_title", "release_artist", "release_year")
    j = t.join(n, ["release_id", "media_idx"]).join(r, "release_id").where("track_title is not null and release_title is not null and release_artist is not null")
    values = {
        "album_artist": F.col("release_artist"), "album_title": F.col("release_title"), "year": F.col("release_year"), "track_title": F.col("track_title"),
        "disc_number": F.col("media_idx") + 1, "disc_count_width": F.lit(1), "track_index": F.col("track_idx") + 1, "track_count_width": X.decimal_width(F.col("tracks")),
    }
    return j.select("track_id", formatted_path(ALBUM_FORMAT, values, F.lit("flac")).alias("path"))


@query(sql="""
SELECT l_orderkey, l_linenumber, v, split_part(v, '/', 1) AS first_part, CASE WHEN instr(v, '/') > 0 THEN substr(v, instr(v, '/') + 1) END AS second_part,
    CASE WHEN instr(v, '/') > 0 THEN '9/' || substr(v, instr(v, '/') + 1) ELSE '9' END AS with_first, split_part(v, '/', 1) || '/9' AS with_second
FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_linenumber AS VARCHAR) ELSE l_linenumber || '/' || CAST(l_quantity AS INTEGER) END AS v FROM lineitem)""")
def q_split_combined(spark: SparkSession, d: str) -> DataFrame:
    v = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linenumber").cast("string")).otherwise(F.concat_ws("/", F.col("l_linenumber"), F.col("l_quantity").cast("int")))
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", v.alias("v"))
    c = F.col("v")
    return li.select("*", X.first_of_pair(c).alias("first_part"), X.second_of_pair(c).alias("second_part"), X.set_first_of_pair(c, F.lit("9")).alias("with_first"), X.set_second_of_pair(c, F.lit("9")).alias("with_second"))


@query(sql="""
WITH p AS (SELECT DISTINCT track_id, unnest(performers) AS x FROM tracks), t AS (SELECT track_id, x[1] AS role, x[2] AS who, x[2] || ' (' || x[1] || ')' AS v FROM p)
SELECT track_id, v, regexp_extract(v, '^(.*?) \\((.*)\\)$', 1) AS involvee, regexp_extract(v, '^(.*?) \\((.*)\\)$', 2) AS involvement FROM t""")
def q_performer_parse(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "tracks").select("track_id", "performers").distinct().select("track_id", F.explode("performers").alias("x"))
    v = p.select("track_id", X.performer_text(F.col("x")[1], F.col("x")[0]).alias("v")).distinct()
    return v.select("track_id", "v", X.performer_name(F.col("v")).alias("involvee"), X.performer_role(F.col("v")).alias("involvement"))


@query(sql="SELECT release_id, coalesce(lower(release_artist) IN ('', 'various artists', 'various', 'va', 'v.a.', '[various]', '[various artists]', 'unknown'), false) AS is_va FROM releases")
def q_va_artist(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "releases").select("release_id", X.is_various_artists(F.col("release_artist")).alias("is_va"))


@query(sql="""
SELECT o_orderkey, coalesce(lower(s) IN ('1', 'on', 'true', 'yes'), false) AS truthy, TRY_CAST(CASE WHEN regexp_full_match(n, '[0-9]+') THEN n END AS UINTEGER)::BIGINT AS number, trim(s) AS trimmed, replace(s, '/', '') AS no_slash
FROM (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'Yes' WHEN 1 THEN 'on' WHEN 2 THEN '1' WHEN 3 THEN 'no' ELSE ' x / ' END AS s, CASE o_orderkey % 3 WHEN 0 THEN CAST(o_orderkey * 1000000 AS VARCHAR) WHEN 1 THEN 'A1' ELSE '-4' END AS n FROM orders)""")
def q_parse_scalars(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    s = F.when(k % 5 == 0, "Yes").when(k % 5 == 1, "on").when(k % 5 == 2, "1").when(k % 5 == 3, "no").otherwise(" x / ")
    n = F.when(k % 3 == 0, (k * 1000000).cast("string")).when(k % 3 == 1, "A1").otherwise("-4")
    return table(spark, d, "orders").select("o_orderkey", F.coalesce(X.is_truthy(s), F.lit(False)).alias("truthy"), X.parse_unsigned(n).alias("number"), X.trim_unicode(s).alias("trimmed"), F.replace(s, F.lit("/"), F.lit("")).alias("no_slash"))


@query(sql="""
WITH p AS (SELECT DISTINCT source_path AS path FROM releases UNION SELECT DISTINCT source_path || '/Track.' || (release_id % 7) || '.FLAC' FROM releases UNION SELECT DISTINCT source_path || '/.hidden' FROM releases),
n AS (SELECT path, regexp_extract(path, '([^/]*)$', 1) AS name FROM p)
SELECT path, name, CASE WHEN regexp_matches(name, '^.+\\.[^.]*$') THEN regexp_extract(name, '^(.+)\\.[^.]*$', 1) ELSE name END AS stem, CASE WHEN regexp_matches(name, '^.+\\.[^.]*$') THEN regexp_extract(name, '\\.([^.]*)$', 1) END AS extension FROM n""")
def q_file_names(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "releases").select("release_id", "source_path")
    p = r.select(F.col("source_path").alias("path")).union(r.select(F.concat("source_path", F.lit("/Track."), (F.col("release_id") % 7).cast("string"), F.lit(".FLAC")))).union(r.select(F.concat("source_path", F.lit("/.hidden")))).distinct()
    c = F.col("path")
    return p.select("path", X.file_name(c).alias("name"), X.file_stem(c).alias("stem"), X.file_extension(c).alias("extension"))


@query(sql="SELECT DISTINCT release_artist, list_transform(regexp_split_to_array(release_artist, '[,&/]'), lambda x: trim(x, ' ')) AS artists FROM releases WHERE release_artist IS NOT NULL")
def q_split_artists(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "releases").where("release_artist is not null").select("release_artist").distinct().select("release_artist", X.split_artists(F.col("release_artist")).alias("artists"))


def _budget_sql(items: list[str], limit: int) -> str:
    out, used = "''", "0"
    ctes = [f"s0 AS (SELECT release_id, CAST('' AS VARCHAR) AS text, {', '.join(items)} FROM releases)"]
    for i, c in enumerate(items):
        joined = f"CASE WHEN text = '' THEN {c} ELSE text || ' | ' || {c} END"
        ctes.append(f"s{i + 1} AS (SELECT * REPLACE (CASE WHEN {c} IS NOT NULL AND octet_length(encode({joined})) <= {limit} THEN {joined} ELSE text END AS text) FROM s{i})")
    return f"WITH {', '.join(ctes)} SELECT release_id, text AS meta FROM s{len(items)}"


@query(sql=_budget_sql(["release_country", "release_year", "record_label", "catalog_number", "barcode"], 40))
def q_meta_budget_join(spark: SparkSession, d: str) -> DataFrame:
    items = F.array_compact(F.array("release_country", "release_year", "record_label", "catalog_number", "barcode"))
    return table(spark, d, "releases").select("release_id", X.budget_join(items, 40).alias("meta"))


@query(sql="SELECT release_id, coalesce(release_artist, '[unknown artist]') || ' - ' || coalesce(release_title, '[unknown album]') AS line, 'https://catalogue.example/release/' || musicbrainz_release_id AS url, base64(encode(coalesce(barcode, 'x'))) AS b64 FROM releases")
def q_display_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "releases").select("release_id", X.artist_and_title(F.col("release_artist"), F.col("release_title")).alias("line"), X.entity_url(f"https://{HOST}", "release", F.col("musicbrainz_release_id")).alias("url"), F.base64(F.coalesce("barcode", F.lit("x")).cast("binary")).alias("b64"))


@query(sql="SELECT o_orderkey, translate(base64(unhex(md5(CAST(o_orderkey AS VARCHAR)))), '+/=', '-_') AS fingerprint FROM orders")
def q_base64_url(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", X.base64_url(F.unhex(F.md5(F.col("o_orderkey").cast("string")))).alias("fingerprint"))


@query
def q_text_diff(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "catalogue_releases").where("barcode <> '' and barcode <> '0000000000000'").select("barcode", "catalogue_id", F.col("release_title").alias("new"))
    b = table(spark, d, "releases").select("barcode", "release_id", F.col("release_title").alias("old"))
    return a.join(b, "barcode").select("release_id", "catalogue_id", textdiff.text_diff("old", "new").alias("edit"))


@query
def q_text_layout(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "releases").where("release_title is not null")
    c = F.col("release_title")
    return r.select("release_id", textdiff.text_width(c).alias("width"), F.octet_length(c).alias("bytes"), textdiff.text_ellipsis(c, F.lit(12)).alias("short"), textdiff.text_lines(c, F.lit(12)).alias("lines"), textdiff.text_filled(c, F.lit(40)).alias("filled"))
