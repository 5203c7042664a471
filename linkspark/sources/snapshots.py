"""Snapshots of releases as JSON files with an explicit schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TRACK_TEXTS = (
    "acoustid acoustid_fingerprint track_artist track_artist_sort_order bpm comment composer_sort_order copyright encoded_by encoder_settings initial_key language "
    "license lyrics mood movement movement_count movement_number musicbrainz_artist_id musicbrainz_original_artist_id musicbrainz_original_release_id "
    "musicbrainz_recording_id musicbrainz_track_id musicbrainz_trm_id musicbrainz_work_id musicip_fingerprint musicip_puid original_album original_artist "
    "original_filename original_release_date original_release_year rating replay_gain_album_gain replay_gain_album_peak replay_gain_album_range "
    "replay_gain_reference_loudness replay_gain_track_gain replay_gain_track_peak replay_gain_track_range track_number track_title track_title_sort_order "
    "artist_website work_title"
).split()
TRACK_LISTS = "arranger composer conductor director dj_mixer engineer genre isrc lyricist mixer producer remixer writer".split()
RELEASE_TEXTS = (
    "release_title release_artist release_artist_sort_order release_sort_order asin barcode catalog_number compilation grouping musicbrainz_release_artist_id "
    "musicbrainz_release_group_id musicbrainz_release_id record_label release_country release_date release_year release_status release_type script total_discs "
    "replay_gain_album_gain_analyzed replay_gain_album_peak_analyzed"
).split()

TRACK = ", ".join([*(f"{c}: string" for c in TRACK_TEXTS), *(f"{c}: array<string>" for c in TRACK_LISTS), "performers: array<array<string>>", "track_length: array<bigint>"])
MEDIA = f"disc_number: int, media_title: string, media_format: string, musicbrainz_disc_id: string, media_tracks: array<struct<{TRACK}>>, gapless_playback: boolean"
RELEASE = ", ".join([*(f"{c} string" for c in RELEASE_TEXTS), f"media array<struct<{MEDIA}>>", "is_compilation boolean"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """Releases of multi-line JSON files; a malformed file gives a row with its text in ``_corrupt_record``."""
    return spark.read.schema(RELEASE + ", _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def write(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
