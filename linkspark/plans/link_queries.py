"""Queries of candidate generation, scoring, assignment, ranking and enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkspark.functions import distance as M
from linkspark.functions import temporal as T
from linkspark.functions import text as X
from linkspark.operators import assign, blocking, consensus, profiles, rank
from linkspark.plans.registry import query
from linkspark.plans.text_queries import sql_ascii, sql_distance, sql_normalize
from linkspark.runtime import spread, table


def parts_scored(spark: SparkSession, d: str) -> DataFrame:
    """left, right, distance of parts of one brand and type: names and clamped sizes."""
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_type", X.normalize(F.col("p_name")).alias("n"), "p_size")
    a = spread(p.select("p_brand", "p_type", F.col("p_partkey").alias("left_key"), F.col("n").alias("ln"), F.col("p_size").alias("ls")))
    b = p.select("p_brand", "p_type", F.col("p_partkey").alias("right_key"), F.col("n").alias("rn"), F.col("p_size").alias("rs"))
    j = blocking.pairs_in_blocks(a, b, ["p_brand", "p_type"])
    size = M.length_distance(F.col("ls") * 1000, F.col("rs") * 1000)
    score = M.weighted_mean([(X.normalized_distance(F.col("ln"), F.col("rn")), 3.0), (size, 1.0)])
    return j.where("left_key <> right_key").select("left_key", "right_key", F.round(score, 6).alias("distance"))


def _part_distance(left: profiles.Side, right: profiles.Side) -> Column:
    size = M.length_distance(left("p_size") * 1000, right("p_size") * 1000)
    return F.round(M.weighted_mean([(X.normalized_distance(left("n"), right("n")), 3.0), (size, 1.0)]), 6)


def _name_distance(left: profiles.Side, right: profiles.Side) -> Column:
    """Distance of parts of these names whose sizes are as good as equal."""
    return F.round(M.weighted_mean([(X.normalized_distance(left("n"), right("n")), 3.0), (F.lit(0.0), 1.0)]), 6)


#: Parts of one brand and type by their names and clamped sizes.
PARTS = profiles.Comparison(["p_brand", "p_type"], ["n"], ["p_size"], "p_partkey", _part_distance, _name_distance)


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return profiles.prepared(table(spark, d, "part").withColumn("n", X.normalize(F.col("p_name"))), PARTS)


PARTS_SQL = """
p AS (SELECT p_partkey, p_brand, p_type, p_name AS n, p_size FROM part),
s AS (SELECT a.p_partkey AS left_key, b.p_partkey AS right_key, round((3.0::DOUBLE * CASE WHEN greatest(length(a.n), length(b.n)) = 0 THEN 0::DOUBLE ELSE levenshtein(a.n, b.n)::DOUBLE / greatest(length(a.n), length(b.n)) END
    + 1.0::DOUBLE * (least(greatest(abs(a.p_size - b.p_size) * 1000 - 10000, 0), 30000) // 1000 / 30.0::DOUBLE)) / 4.0::DOUBLE, 6) AS distance FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_partkey <> b.p_partkey),
r AS (SELECT *, row_number() OVER (PARTITION BY left_key ORDER BY distance, right_key) AS rank FROM s)"""


@query(sql=f"WITH {PARTS_SQL} SELECT left_key, right_key, distance, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5")
def q_topk_parts(spark: SparkSession, d: str) -> DataFrame:
    return profiles.top_k(_parts(spark, d), PARTS, 5)


@query(sql=f"WITH {PARTS_SQL} SELECT left_key, right_key, round((1 - distance) * 100, 2) AS percent, CASE WHEN distance <= 0.1 THEN 'green' WHEN distance <= 0.5 THEN 'yellow' ELSE 'red' END AS colour FROM r WHERE rank <= 5")
def q_similarity_pct(spark: SparkSession, d: str) -> DataFrame:
    top = profiles.top_k(_parts(spark, d), PARTS, 5)
    return top.select("left_key", "right_key", X.similarity_percent(F.col("distance")).alias("percent"), X.similarity_colour(F.col("distance")).alias("colour"))


@query(sql=f"""
WITH {PARTS_SQL}, n AS (SELECT * FROM s WHERE distance < 0.1)
SELECT left_key, right_key, distance, CASE WHEN count(*) OVER (PARTITION BY left_key) = 1 AND distance <= 0.05 THEN 'auto_select' ELSE 'needs_review' END AS decision FROM n""")
def q_auto_select(spark: SparkSession, d: str) -> DataFrame:
    return profiles.auto_selected(_parts(spark, d), PARTS, 0.1)


@query(sql=f"""
WITH {PARTS_SQL}, u AS (SELECT left_key, right_key, distance FROM r WHERE rank <= 3 UNION ALL SELECT left_key, right_key, distance + 0.1 FROM s)
SELECT left_key, right_key, min(distance) AS distance FROM u GROUP BY 1, 2""")
def q_dedupe_union(spark: SparkSession, d: str) -> DataFrame:
    return profiles.extended(_parts(spark, d), PARTS, 3, 0.1)


VARIOUS = "various artists"


def _releases(spark: SparkSession, d: str) -> DataFrame:
    """Releases with their number of tracks and the formats of their media."""
    r = table(spark, d, "releases")
    counts = consensus.item_counts(table(spark, d, "tracks"), ["release_id"], ["media_idx", "track_idx"]).select("release_id", F.col("items").alias("track_count"))
    media = table(spark, d, "media").select("release_id", "media_idx", "media_format").distinct()
    formats = consensus.format_runs(consensus.run_lengths(media, ["release_id"], "media_format", "media_idx"), ["release_id"]).withColumnRenamed("format", "media_format")
    return r.join(counts, "release_id", "left").join(formats, "release_id", "left")


def _clauses() -> dict[str, tuple[Column, Column]]:
    """Title, artist and number of tracks; a compilation also asks for the artist that stands for several."""
    title, artist = F.trim(X.normalize(F.col("release_title"))), X.normalize(F.col("release_artist"))
    several = F.when(F.col("is_compilation"), F.array(F.trim(artist), F.lit(VARIOUS))).otherwise(X.split_artists(artist))
    theirs = F.concat(X.split_artists(artist), F.array(F.trim(artist)))
    theirs = F.when(X.is_various_artists(F.col("release_artist")), F.array(F.lit(VARIOUS))).otherwise(theirs)
    count = F.array(F.col("track_count").cast("string"))
    return {"title": (F.array(title), F.array(title)), "artist": (F.coalesce(several, F.when(F.col("is_compilation"), F.array(F.lit(VARIOUS)))), theirs), "tracks": (count, count)}


def _split_sql(c: str) -> str:
    return f"list_transform(regexp_split_to_array({sql_normalize(c)}, '[,&/]'), lambda x: trim(x, ' '))"


BLOCK_SQL = f"""
rc AS (SELECT release_id, CAST(count(*) AS VARCHAR) AS n FROM (SELECT DISTINCT release_id, media_idx, track_idx FROM tracks) GROUP BY 1),
lk AS (SELECT release_id AS id, 'title' AS clause, trim({sql_normalize('release_title')}, ' ') AS k FROM releases
    UNION ALL SELECT release_id, 'artist', unnest(CASE WHEN is_compilation THEN [trim({sql_normalize('release_artist')}, ' '), '{VARIOUS}'] ELSE {_split_sql('release_artist')} END) FROM releases
    UNION ALL SELECT release_id, 'tracks', n FROM rc),
rk AS (SELECT catalogue_id AS id, 'title' AS clause, trim({sql_normalize('release_title')}, ' ') AS k FROM catalogue_releases
    UNION ALL SELECT catalogue_id, 'artist', unnest(CASE WHEN lower(release_artist) IN ({', '.join(f"'{v}'" for v in X.VARIOUS_ARTISTS)}) THEN ['{VARIOUS}'] ELSE list_concat({_split_sql('release_artist')}, [trim({sql_normalize('release_artist')}, ' ')]) END) FROM catalogue_releases WHERE release_artist IS NOT NULL
    UNION ALL SELECT catalogue_id, 'tracks', CAST(track_count AS VARCHAR) FROM catalogue_releases),
c AS (SELECT DISTINCT a.id AS release_id, b.id AS catalogue_id, clause FROM lk a JOIN rk b USING (clause, k) WHERE k <> ''),
n AS (SELECT release_id, catalogue_id, count(*) AS clauses FROM c GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY release_id ORDER BY clauses DESC, catalogue_id) AS rank FROM n)"""


@query(sql=f"WITH {BLOCK_SQL} SELECT release_id, catalogue_id, clauses, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 5")
def q_blocking_candidates(spark: SparkSession, d: str) -> DataFrame:
    return blocking.candidates(_releases(spark, d), table(spark, d, "catalogue_releases"), "release_id", "catalogue_id", _clauses())


@query(sql=f"WITH {BLOCK_SQL} SELECT release_id, catalogue_id, clauses, CAST(rank AS INTEGER) AS rank FROM k WHERE rank BETWEEN 4 AND 6")
def q_blocking_page(spark: SparkSession, d: str) -> DataFrame:
    """The second page of three candidates."""
    return blocking.candidates(_releases(spark, d), table(spark, d, "catalogue_releases"), "release_id", "catalogue_id", _clauses(), 3, 3)


@query(sql="""
WITH f AS (SELECT a.release_id AS key, b.release_id AS candidate FROM releases a JOIN releases b ON a.barcode = b.barcode WHERE a.barcode <> '' AND a.barcode <> '0000000000000'),
g AS (SELECT release_id, musicbrainz_release_group_id AS grp FROM releases WHERE musicbrainz_release_group_id <> ''),
o AS (SELECT DISTINCT f.key, g.grp FROM f JOIN g ON g.release_id = f.candidate)
SELECT key, candidate, min(found_by) AS found_by FROM (SELECT key, candidate, 'found' AS found_by FROM f UNION ALL SELECT o.key, g.release_id, 'group' FROM o JOIN g USING (grp)) GROUP BY 1, 2""")
def q_group_extension(spark: SparkSession, d: str) -> DataFrame:
    """Releases found by their barcode, and those of the same release groups."""
    r = table(spark, d, "releases")
    coded = r.where("barcode <> '' and barcode <> '0000000000000'")
    found = coded.select(F.col("release_id").alias("key"), "barcode").join(coded.select(F.col("release_id").alias("candidate"), "barcode"), "barcode").drop("barcode")
    return blocking.group_extended(found, r.select(F.col("release_id").alias("candidate"), "musicbrainz_release_group_id"), "key", "candidate", "musicbrainz_release_group_id")


@query(sql="""
WITH b AS (SELECT catalogue_id, regexp_replace(barcode, '[^0-9]', '', 'g') AS k FROM catalogue_releases WHERE regexp_replace(barcode, '[^0-9]', '', 'g') NOT IN ('', '0000000000000')),
a AS (SELECT release_id, release_title, barcode FROM releases), m AS (SELECT release_id, catalogue_id, 'id' AS found_by FROM a JOIN b ON a.barcode = b.k)
SELECT * FROM m UNION ALL SELECT release_id, c.catalogue_id, 'search' FROM a JOIN catalogue_releases c ON a.release_title = c.release_title WHERE release_id NOT IN (SELECT release_id FROM m)""")
def q_id_short_circuit(spark: SparkSession, d: str) -> DataFrame:
    cat = table(spark, d, "catalogue_releases")
    right = cat.withColumn("k", F.regexp_replace("barcode", "[^0-9]", "")).withColumn("k", F.when(~F.col("k").isin("", "0" * 13), F.col("k")))
    return blocking.with_short_circuit(table(spark, d, "releases"), right, "release_id", "catalogue_id", "barcode", "k", lambda rest: rest.join(cat.select("catalogue_id", "release_title"), "release_title"))


def _norm(c: str) -> Column:
    return X.strip_non_ascii(X.normalize(F.col(c)))


def _track_view(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "tracks").dropDuplicates(["track_id"])
    return t.select("release_id", "media_idx", "track_idx", "track_id", _norm("track_title").alias("title"), _norm("track_artist").alias("artist"), F.col("track_number").alias("number"), T.length_ms(F.col("track_length")).alias("length"), F.col("musicbrainz_recording_id").alias("recording_id"))


def _track_cols(prefix: str) -> dict[str, Column]:
    return {k: F.col(f"{prefix}.{k}") for k in ("title", "artist", "number", "length", "recording_id")}


@query(sql=f"""
WITH t AS (SELECT DISTINCT track_id, release_id, media_idx, track_idx, {sql_ascii(sql_normalize('track_title'))} AS title, {sql_ascii(sql_normalize('track_artist'))} AS artist, track_number AS number,
    CASE WHEN len(track_length) = 2 THEN track_length[1] * 1000 + track_length[2] // 1000000 END AS length, musicbrainz_recording_id AS rid FROM tracks),
p AS (SELECT a.track_id AS left_id, b.track_id AS right_id,
    CASE WHEN a.title IS NULL AND b.title IS NULL THEN 0 WHEN a.title IS NULL OR b.title IS NULL THEN 1 ELSE {sql_distance('a.title', 'b.title')} END AS d1, {sql_distance('a.artist', 'b.artist')} AS d2,
    {sql_distance("regexp_replace(a.number, '^0+', '')", "regexp_replace(b.number, '^0+', '')")} AS d3, least(greatest(abs(a.length - b.length) - 10000, 0), 30000) // 1000 / 30.0::DOUBLE AS d4,
    CASE WHEN a.rid IS NULL OR b.rid IS NULL THEN NULL WHEN trim(a.rid) = trim(b.rid) AND trim(a.rid) <> '' THEN 0::DOUBLE ELSE 1::DOUBLE END AS d5,
    a.artist IS NOT NULL AND b.artist IS NOT NULL AS p2, a.number IS NOT NULL AND b.number IS NOT NULL AS p3, a.length IS NOT NULL AND b.length IS NOT NULL AS p4 FROM t a JOIN t b ON a.release_id = b.release_id AND a.media_idx = b.media_idx AND b.track_idx = a.track_idx + 1)
SELECT left_id, right_id, round((3 * d1 + CASE WHEN p2 THEN 3 * d2 ELSE 0 END + CASE WHEN p3 THEN d3 ELSE 0 END + CASE WHEN p4 THEN d4 ELSE 0 END + coalesce(5 * d5, 0)) / (3 + CASE WHEN p2 THEN 3 ELSE 0 END + CASE WHEN p3 THEN 1 ELSE 0 END + CASE WHEN p4 THEN 1 ELSE 0 END + CASE WHEN d5 IS NULL THEN 0 ELSE 5 END), 6) AS distance,
    concat_ws(', ', CASE WHEN p3 AND d3 <> 0 THEN '#' END, CASE WHEN d1 <> 0 THEN 'title' END, CASE WHEN p4 AND d4 <> 0 THEN 'length' END, CASE WHEN d5 <> 0 THEN 'id' END) AS changes FROM p""")
def q_track_total_distance(spark: SparkSession, d: str) -> DataFrame:
    t = _track_view(spark, d)
    nxt = t.withColumn("track_idx", F.col("track_idx") - 1)
    j = t.alias("a").join(nxt.alias("b"), ["release_id", "media_idx", "track_idx"])
    diffs = M.track_differences(_track_cols("a"), _track_cols("b"))
    zero = {k: v["dist"] == 0 for k, v in diffs.items()}
    title_same = F.coalesce(zero["title"], diffs["title"]["state"] == "both_missing")
    return j.select(F.col("a.track_id").alias("left_id"), F.col("b.track_id").alias("right_id"), F.round(M.track_distance(diffs), 6).alias("distance"), X.change_list(title_same, zero["number"], zero["length"], zero["recording_id"]).alias("changes"))


RELEASE_KEYS = {"title": "release_title", "artist": "release_artist", "media_format": "media_format", "label": "record_label", "catalog_number": "catalog_number", "barcode": "barcode"}
TEXT_WEIGHTS = {"artist": 3, "media_format": 1, "label": 0.5, "catalog_number": 0.5, "barcode": 0.5}

FORMAT_SQL = """
mo AS (SELECT DISTINCT release_id, media_idx, media_format AS v FROM media), ml AS (SELECT *, lag(v) OVER w AS p, row_number() OVER w AS i FROM mo WINDOW w AS (PARTITION BY release_id ORDER BY media_idx)),
mr AS (SELECT release_id, v, sum(CASE WHEN i = 1 OR v IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (PARTITION BY release_id ORDER BY media_idx) AS run FROM ml),
mg AS (SELECT release_id, run, any_value(v) AS v, count(*) AS n FROM mr GROUP BY 1, 2),
mf AS (SELECT release_id, string_agg(CASE WHEN n > 1 THEN n || '×' || v ELSE v END, '+' ORDER BY run) AS media_format FROM mg GROUP BY release_id)"""


def _texts_sql(rows: str) -> str:
    return ", ".join(f"{sql_ascii(sql_normalize(c))} AS {k}" for k, c in RELEASE_KEYS.items()) + f", musicbrainz_release_id AS rid FROM {rows}"


def _distance_sql() -> str:
    """The distance of releases a and b of ``_texts_sql``."""
    parts = {k: sql_distance(f"a.{k}", f"b.{k}") for k in RELEASE_KEYS}
    present = {k: f"(a.{k} IS NOT NULL AND b.{k} IS NOT NULL)" for k in RELEASE_KEYS}
    title = f"CASE WHEN a.title IS NULL AND b.title IS NULL THEN 0 WHEN a.title IS NULL OR b.title IS NULL THEN 1 ELSE {parts['title']} END"
    known = "(a.rid IS NOT NULL AND b.rid IS NOT NULL)"
    same = f"CASE WHEN {known} AND NOT (trim(a.rid) = trim(b.rid) AND trim(a.rid) <> '') THEN 5::DOUBLE ELSE 0 END"
    top = " + ".join([f"3 * ({title})", *(f"CASE WHEN {present[k]} THEN {w}::DOUBLE * ({parts[k]}) ELSE 0 END" for k, w in TEXT_WEIGHTS.items()), same])
    low = " + ".join(["3", *(f"CASE WHEN {present[k]} THEN {w}::DOUBLE ELSE 0 END" for k, w in TEXT_WEIGHTS.items()), f"CASE WHEN {known} THEN 5 ELSE 0 END"])
    return f"round(({top}) / ({low}), 6)"


def _scored_releases(pairs: DataFrame, left: DataFrame, left_id: str, right: DataFrame, right_id: str, assigned: DataFrame | None = None) -> DataFrame:
    """The pairs with ``distance``; ``assigned`` gives the distance and the number of tracks of the best assignment."""

    def texts(df: DataFrame, id_col: str, name: str) -> DataFrame:
        rid = F.col("musicbrainz_release_id") if "musicbrainz_release_id" in df.columns else F.lit(None).cast("string")
        return df.select(F.col(id_col).alias(name), *[_norm(c).alias(k) for k, c in RELEASE_KEYS.items()], rid.alias("id"))

    first, second = pairs.columns
    j = pairs.join(texts(left, left_id, first).alias("a"), first).join(texts(right, right_id, second).alias("b"), second)
    names = (*RELEASE_KEYS, "id")
    diffs = M.release_differences({k: F.col(f"a.{k}") for k in names}, {k: F.col(f"b.{k}") for k in names})
    tracks = None
    if assigned is not None:
        j = j.join(assigned, [first, second], "left")
        tracks = (F.col("assignment_distance"), F.coalesce("assignment_tracks", F.lit(0)).cast("double"))
    return j.withColumn("distance", F.round(M.release_distance(diffs, tracks), 6)).select(first, second, "distance")


SCORED_SQL = f"""
WITH {BLOCK_SQL}, {FORMAT_SQL}, l AS (SELECT release_id, {_texts_sql('releases LEFT JOIN mf USING (release_id)')}), r AS (SELECT catalogue_id, {_texts_sql('(SELECT *, NULL::VARCHAR AS musicbrainz_release_id FROM catalogue_releases)')})
SELECT k.release_id, k.catalogue_id, {_distance_sql()} AS distance FROM k JOIN l a ON a.release_id = k.release_id JOIN r b ON b.catalogue_id = k.catalogue_id WHERE k.rank <= 5"""


@query(sql=SCORED_SQL)
def q_release_total_distance(spark: SparkSession, d: str) -> DataFrame:
    rel, cat = _releases(spark, d), table(spark, d, "catalogue_releases")
    top = blocking.candidates(rel, cat, "release_id", "catalogue_id", _clauses()).select("release_id", "catalogue_id")
    return _scored_releases(top, rel, "release_id", cat, "catalogue_id")


def _reimports(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Releases, and pairs of neighbouring imports of one title and artist."""
    rel = _releases(spark, d)
    w = Window.partitionBy(_norm("release_title"), _norm("release_artist")).orderBy("release_id")
    pairs = rel.where("release_title <> '' and release_artist <> ''").select(F.col("release_id").alias("left_id"), F.lead("release_id").over(w).alias("right_id")).where("right_id is not null")
    return rel, pairs


REIMPORT_SQL = f"i AS (SELECT release_id AS left_id, lead(release_id) OVER (PARTITION BY {sql_ascii(sql_normalize('release_title'))}, {sql_ascii(sql_normalize('release_artist'))} ORDER BY release_id) AS right_id FROM releases WHERE release_title <> '' AND release_artist <> '')"


@query(sql=f"""
WITH {FORMAT_SQL}, {REIMPORT_SQL}, l AS (SELECT release_id, {_texts_sql('releases LEFT JOIN mf USING (release_id)')})
SELECT left_id, right_id, {_distance_sql()} AS distance FROM i JOIN l a ON a.release_id = left_id JOIN l b ON b.release_id = right_id""")
def q_reimport_distance(spark: SparkSession, d: str) -> DataFrame:
    """Distance of neighbouring imports of a release, with ids and formats on both sides, but without tracks."""
    rel, pairs = _reimports(spark, d)
    return _scored_releases(pairs, rel, "release_id", rel, "release_id")


@query
def q_reimport_distance_tracks(spark: SparkSession, d: str) -> DataFrame:
    """The same with all eight terms: the best assignment of the tracks of both counts by their number."""
    rel, pairs = _reimports(spark, d)
    t = _track_view(spark, d).groupBy("release_id").agg(F.array_sort(F.collect_list(F.struct("media_idx", "track_idx", "title", "artist", "number", "length", "recording_id"))).alias("tracks"))
    j = pairs.join(t.select(F.col("release_id").alias("left_id"), F.col("tracks").alias("l")), "left_id").join(t.select(F.col("release_id").alias("right_id"), F.col("tracks").alias("r")), "right_id")

    def distance(x: Column, y: Column) -> Column:
        fields = ("title", "artist", "number", "length", "recording_id")
        return M.track_distance(M.track_differences({f: x[f] for f in fields}, {f: y[f] for f in fields}))

    a = F.col("a")
    matched, spare = F.size(a["cost"]), F.size(a["unmatched"])
    solved = assign.assignment(j, ["left_id", "right_id"], "l", "r", distance)
    assigned = solved.select("left_id", "right_id", M.assignment_distance(matched, spare, assign.matched_mean(a)).alias("assignment_distance"), (matched + spare).alias("assignment_tracks"))
    return _scored_releases(pairs, rel, "release_id", rel, "release_id", assigned)


def _assigned(spark: SparkSession, d: str, size: str) -> DataFrame:
    """Titles of a release assigned to those of its repeated import or next medium: small lists of neighbouring media."""
    t = _track_view(spark, d).where("title is not null").select("release_id", "media_idx", "track_idx", "title")
    lists = t.groupBy("release_id", "media_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("track_idx", "title"))), lambda x: x["title"]).alias("titles"))
    b = lists.select("release_id", (F.col("media_idx") - 1).alias("media_idx"), F.col("titles").alias("others"))
    j = lists.join(b, ["release_id", "media_idx"]).where(size)
    return assign.assignment(j, ["release_id", "media_idx"], "titles", "others", X.normalized_distance)


LISTS_SQL = f"""
t AS (SELECT DISTINCT track_id, release_id, media_idx, track_idx, {sql_ascii(sql_normalize('track_title'))} AS title FROM tracks WHERE track_title IS NOT NULL),
l AS (SELECT release_id, media_idx, list(title ORDER BY track_idx, title) AS titles FROM t GROUP BY 1, 2),
j AS (SELECT a.release_id, a.media_idx, a.titles AS x, b.titles AS y FROM l a JOIN l b ON a.release_id = b.release_id AND b.media_idx = a.media_idx + 1)"""


def _cost_sql(i: str, k: str) -> str:
    return f"floor(({sql_distance(f'x[{i}]', f'y[{k}]')}) * 100000)"


@query(sql=f"""
WITH {LISTS_SQL}, three AS (SELECT * FROM j WHERE len(x) = 3 AND len(y) = 3), perm AS (SELECT * FROM (VALUES (1, 2, 3), (1, 3, 2), (2, 1, 3), (2, 3, 1), (3, 1, 2), (3, 2, 1)) v(p, q, r))
SELECT release_id, media_idx, CAST(min({_cost_sql('1', 'p')} + {_cost_sql('2', 'q')} + {_cost_sql('3', 'r')}) AS BIGINT) AS total_cost FROM three, perm GROUP BY 1, 2""")
def q_assignment_total(spark: SparkSession, d: str) -> DataFrame:
    """Lists of three only, as far as the SQL with its six permutations goes; ``q_assignment_total_all`` takes all."""
    return _total_cost(_assigned(spark, d, "size(titles) = 3 and size(others) = 3"))


@query
def q_assignment_total_all(spark: SparkSession, d: str) -> DataFrame:
    """Total cost of the assignment of all neighbouring media, whatever their sizes."""
    return _total_cost(_assigned(spark, d, "true"))


def _total_cost(a: DataFrame) -> DataFrame:
    total = F.aggregate(F.col("a.cost"), F.lit(0).cast("bigint"), lambda s, x: s + F.round(x * M.COST_STEPS).cast("bigint"))
    return a.select("release_id", "media_idx", total.alias("total_cost"))


@query(sql=f"""
WITH {LISTS_SQL} SELECT release_id, media_idx, CAST(least(len(x), len(y)) AS INTEGER) AS matched, CAST(abs(len(x) - len(y)) AS INTEGER) AS unmatched, CASE WHEN len(x) > len(y) THEN 'left' ELSE 'right' END AS side FROM j""")
def q_assignment_rect(spark: SparkSession, d: str) -> DataFrame:
    a = F.col("a")
    return _assigned(spark, d, "true").select("release_id", "media_idx", F.size(a["cost"]).alias("matched"), F.size(a["unmatched"]).alias("unmatched"), a["unmatched_side"].alias("side"))


@query
def q_assignment_distance(spark: SparkSession, d: str) -> DataFrame:
    a = F.col("a")
    n = F.size(a["cost"]), F.size(a["unmatched"])
    return _assigned(spark, d, "true").select("release_id", "media_idx", F.round(M.assignment_distance(n[0], n[1], assign.matched_mean(a)), 6).alias("distance"), M.problems(n[1], F.lit(0), F.lit("a"), F.lit("b")).alias("problems"))


@query
def q_unmatched(spark: SparkSession, d: str) -> DataFrame:
    return assign.unmatched(_assigned(spark, d, "true"), ["release_id", "media_idx"], "a")


@query
def q_enrich(spark: SparkSession, d: str) -> DataFrame:
    """Tracks of a medium take over number and recording id of the tracks assigned to them."""
    keys = ["release_id", "media_idx"]
    matched = assign.pairs(_assigned(spark, d, "true"), keys, "a")
    t = _track_view(spark, d).where("title is not null").select(*keys, "track_id", "track_idx", "number", "recording_id")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("track_idx")) - 1
    items = t.withColumn("left_idx", place).drop("track_idx")
    source = t.withColumn("right_idx", place).select("release_id", (F.col("media_idx") - 1).alias("media_idx"), "right_idx", "number", "recording_id")
    return assign.enriched(items, matched, source, keys, ["number", "recording_id"]).select("track_id", "number", "recording_id")


@query(sql=f"""
WITH {PARTS_SQL} SELECT left_key, right_key, list_filter([CASE WHEN right_key % 7 > 0 THEN (right_key % 7) || ' missing tracks' END, CASE WHEN left_key % 3 > 0 THEN (left_key % 3) || ' residual tracks' END, CASE WHEN left_key % 2 <> right_key % 2 THEN 'wrong id' END], lambda x: x IS NOT NULL) AS problems FROM r WHERE rank = 1""")
def q_problems(spark: SparkSession, d: str) -> DataFrame:
    top = profiles.top_k(_parts(spark, d), PARTS, 1)
    l, r = F.col("left_key"), F.col("right_key")
    return top.select("left_key", "right_key", M.problems(r % 7, l % 3, (l % 2).cast("string"), (r % 2).cast("string")).alias("problems"))


@query(sql="SELECT p_partkey, p_name FROM part ORDER BY p_name, p_partkey LIMIT 10 OFFSET 5")
def q_page(spark: SparkSession, d: str) -> DataFrame:
    return rank.page(table(spark, d, "part").select("p_partkey", "p_name"), ["p_name", "p_partkey"], 10, 5)


@query(sql="""
WITH p AS (SELECT DISTINCT source_path AS path FROM releases)
SELECT path, CAST(row_number() OVER (PARTITION BY regexp_replace(path, '/[^/]*$', '') ORDER BY string_split(path, '/')) AS INTEGER) AS place FROM p""")
def q_path_order(spark: SparkSession, d: str) -> DataFrame:
    """Order of paths by components, within their folder."""
    p = table(spark, d, "releases").select(F.col("source_path").alias("path")).distinct()
    w = Window.partitionBy(F.regexp_replace("path", r"/[^/]*$", "")).orderBy(rank.path_order(F.col("path")))
    return p.select("path", F.row_number().over(w).alias("place"))
