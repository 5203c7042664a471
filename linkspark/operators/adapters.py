"""Projections of other shapes onto the release, medium and track schema: catalogue entities, tagged files, file collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkspark.functions import temporal as T
from linkspark.functions import text as X
from linkspark.operators import consensus as A
from linkspark.operators import relations as R

CREDIT = "array<struct<name:string,joinphrase:string,artist:struct<id:string,name:string,`sort-name`:string>>>"
WORK = "struct<id:string,title:string,relations:array<struct<type:string,artist:string>>>"
RELATIONS = f"array<struct<type:string,direction:string,artist:string,attributes:array<string>,work:{WORK}>>"
RECORDING = f"struct<id:string,title:string,`first-release-date`:string,isrcs:array<string>,genres:array<struct<name:string>>,relations:{RELATIONS}>"
TRACK = f"struct<id:string,number:string,title:string,length:bigint,`artist-credit`:{CREDIT},recording:{RECORDING}>"
MEDIUM = f"struct<position:int,title:string,format:string,`track-count`:int,tracks:array<{TRACK}>>"
#: Schema of a catalogue entity as its public JSON interface gives it.
ENTITY = (
    f"struct<id:string,title:string,asin:string,barcode:string,country:string,date:string,status:string,`artist-credit`:{CREDIT},`label-info`:array<struct<`catalog-number`:string,label:struct<name:string>>>,"
    f"`release-group`:struct<id:string,`primary-type`:string,`secondary-types`:array<string>>,`text-representation`:struct<script:string>,media:array<{MEDIUM}>>"
)
#: Statuses and types of releases by their names in the catalogue.
STATUSES = {"Official": "official", "Promotion": "promotion", "Bootleg": "bootleg", "Pseudo-Release": "pseudo-release"}
PRIMARY_TYPES = {"Album": "album", "Single": "single", "EP": "ep", "Broadcast": "broadcast", "Other": "other"}
SECONDARY_TYPES = {"Audio drama": "audiodrama", "Audiobook": "audiobook", "Compilation": "compilation", "DJ-mix": "djmix", "Demo": "demo", "Interview": "interview", "Live": "live", "Mixtape/Street": "mixtapestreet", "Remix": "remix", "Soundtrack": "soundtrack", "Spokenword": "spokenword"}


def credited(credits: Column) -> Column:
    """Names with join phrases; "" for an entity without credits, as the catalogue's adapter gives it."""
    return F.coalesce(A.joined_credit(credits), F.lit(""))


def sort_names(credits: Column, separator: str) -> Column:
    return F.coalesce(F.array_join(F.transform(credits, lambda c: c["artist"]["sort-name"]), separator), F.lit(""))


def artist_ids(credits: Column) -> Column:
    return R.first_non_null(F.transform(credits, lambda c: c["artist"]["id"]))


def release_of_entity(e: Column, various_id: str = "") -> dict[str, Column]:
    """Release fields of a catalogue entity; what the catalogue does not supply is null."""
    credits, labels, group = e["artist-credit"], e["label-info"], e["release-group"]
    types = F.concat(F.array(R.mapped(group["primary-type"], PRIMARY_TYPES)), F.coalesce(F.transform(group["secondary-types"], lambda t: R.mapped(t, SECONDARY_TYPES)), F.array().cast("array<string>")))
    missing = F.lit(None).cast("string")
    return {
        "release_title": e["title"], "release_artist": credited(credits), "release_artist_sort_order": sort_names(credits, "; "), "release_sort_order": missing, "asin": e["asin"], "barcode": e["barcode"],
        "catalog_number": R.first_non_null(F.transform(labels, lambda x: x["catalog-number"])), "compilation": missing, "grouping": missing, "musicbrainz_release_artist_id": artist_ids(credits),
        "musicbrainz_release_group_id": group["id"], "musicbrainz_release_id": e["id"], "record_label": R.first_non_null(F.transform(labels, lambda x: x["label"]["name"])), "release_country": e["country"],
        "release_date": T.date_text(T.partial_date(e["date"])), "release_year": T.partial_year(e["date"]), "release_status": R.mapped(e["status"], STATUSES), "release_type": R.first_non_null(types),
        "script": e["text-representation"]["script"], "total_discs": F.when(e["media"].isNotNull(), F.size(e["media"]).cast("string")),
        "is_compilation": F.coalesce(F.exists(credits, lambda c: c["artist"]["id"] == various_id), F.lit(False)),
        "media_format": A.format_list(F.transform(e["media"], lambda m: m["format"])), "track_count": F.aggregate(F.coalesce(e["media"], F.array().cast(f"array<{MEDIUM}>")), F.lit(0), lambda n, m: n + F.coalesce(m["track-count"], F.size(m["tracks"]))),
    }


def media_of_entity(df: DataFrame, id_col: str, entity: str) -> DataFrame:
    """id, media_idx and the fields of each medium; disc id and gapless flag are not supplied."""
    rows = df.select(id_col, F.posexplode(F.col(entity)["media"]).alias("media_idx", "m"))
    m = F.col("m")
    return rows.select(id_col, "media_idx", m["position"].alias("disc_number"), m["title"].alias("media_title"), m["format"].alias("media_format"), F.coalesce(m["track-count"], F.size(m["tracks"])).alias("track_count"), F.lit(None).cast("string").alias("musicbrainz_disc_id"), F.lit(None).cast("boolean").alias("gapless_playback"))


def tracks_of_entity(df: DataFrame, id_col: str, entity: str) -> DataFrame:
    """id, media_idx, track_idx and the fields of each track, people by their roles in the relations."""
    rows = R.flattened(df.select(id_col, F.col(entity)["media"].alias("media")), id_col, "media", "tracks")
    t = F.col("item")
    rec = t["recording"]
    rel = F.coalesce(rec["relations"], F.array().cast(RELATIONS))
    works = R.works(rel)
    roles = [R.role_artists(rel, r).alias(r) for r in R.ROLES]
    return rows.select(
        id_col, F.col("part_idx").alias("media_idx"), F.col("item_idx").alias("track_idx"), "position", t["title"].alias("track_title"), credited(t["artist-credit"]).alias("track_artist"), sort_names(t["artist-credit"], "; ").alias("track_artist_sort_order"),
        t["number"].alias("track_number"), t["length"].alias("length_ms"), t["id"].alias("musicbrainz_track_id"), rec["id"].alias("musicbrainz_recording_id"), R.first_non_null(F.transform(works, lambda w: w["id"])).alias("musicbrainz_work_id"),
        R.first_non_null(F.transform(works, lambda w: w["title"])).alias("work_title"), T.date_text(T.partial_date(rec["first-release-date"])).alias("original_release_date"), T.partial_year(rec["first-release-date"]).alias("original_release_year"),
        F.transform(rec["genres"], lambda g: g["name"]).alias("genre"), rec["isrcs"].alias("isrc"), R.performers(rel).alias("performers"), *roles,
    )


def track_of_file(containers: Column, path: Column) -> dict[str, Column]:
    """Track fields of a file: the first value of a key in its containers (array<map<string,array<string>>>), with fallbacks."""

    def first(key: str) -> Column:
        return R.first_non_null(F.transform(containers, lambda m: F.get(F.try_element_at(m, F.lit(key)), F.lit(0))))

    def every(key: str) -> Column:
        return F.flatten(F.filter(F.transform(containers, lambda m: F.try_element_at(m, F.lit(key))), lambda v: v.isNotNull()))

    return {
        "track_title": first("TrackTitle"), "track_artist": F.coalesce(first("Artist"), first("Artists"), first("AlbumArtist")), "track_number": first("TrackNumber"), "disc_number": X.parse_unsigned(X.first_of_pair(first("DiscNumber"))),
        "release_title": first("Album"), "release_artist": first("AlbumArtist"), "artist": first("Artist"), "composer": every("Composer"), "genre": every("Genre"), "is_compilation": F.coalesce(X.is_truthy(first("Compilation")), F.lit(False)),
        "musicbrainz_recording_id": first("MusicBrainzRecordingId"), "musicbrainz_release_id": first("MusicBrainzReleaseId"), "track_file_stem": X.file_stem(path),
    }


def release_of_collection(files: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Release fields that all files of a collection agree on; title without disc suffix, artist by album artist or artist."""
    title = A.consensus(X.strip_disc_suffix(F.col("release_title"))).alias("release_title")
    artist = A.consensus_or(F.col("release_artist"), F.col("artist")).alias("release_artist")
    return files.groupBy(*keys).agg(title, artist, *[A.consensus(F.col(f)).alias(f) for f in fields], F.count("*").alias("track_count"))
