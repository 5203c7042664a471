"""Enrichment: the tags that a file takes over from the release, the medium and the track it was matched with."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keys and the fields of the release, the medium and the track that they take over.
RELEASE_FIELDS = {
    "Album": "release_title", "AlbumArtist": "release_artist", "AlbumArtistSortOrder": "release_artist_sort_order", "AlbumSortOrder": "release_sort_order", "Asin": "asin", "Barcode": "barcode", "CatalogNumber": "catalog_number",
    "Compilation": "compilation", "Grouping": "grouping", "MusicBrainzReleaseArtistId": "musicbrainz_release_artist_id", "MusicBrainzReleaseGroupId": "musicbrainz_release_group_id", "MusicBrainzReleaseId": "musicbrainz_release_id",
    "RecordLabel": "record_label", "ReleaseCountry": "release_country", "ReleaseDate": "release_date", "ReleaseYear": "release_year", "ReleaseStatus": "release_status", "ReleaseType": "release_type", "Script": "script", "TotalDiscs": "total_discs",
}
MEDIA_FIELDS = {"DiscSubtitle": "media_title", "GaplessPlayback": "gapless_playback", "Media": "media_format", "MusicBrainzDiscId": "musicbrainz_disc_id", "TotalTracks": "media_track_count", "DiscNumber": "media_position"}
TRACK_FIELDS = {
    "AcoustId": "acoustid", "Artist": "track_artist", "ArtistSortOrder": "track_artist_sort_order", "Artists": "track_artist", "Bpm": "bpm", "Comment": "comment", "ComposerSortOrder": "composer_sort_order", "Copyright": "copyright",
    "EncodedBy": "encoded_by", "EncoderSettings": "encoder_settings", "InitialKey": "initial_key", "Language": "language", "License": "license", "Lyrics": "lyrics", "Mood": "mood", "Movement": "movement",
    "MovementCount": "movement_count", "MovementNumber": "movement_number", "MusicBrainzArtistId": "musicbrainz_artist_id", "MusicBrainzOriginalArtistId": "musicbrainz_original_artist_id",
    "MusicBrainzOriginalReleaseId": "musicbrainz_original_release_id", "MusicBrainzRecordingId": "musicbrainz_recording_id", "MusicBrainzTrackId": "musicbrainz_track_id", "MusicBrainzTrmId": "musicbrainz_trm_id",
    "MusicBrainzWorkId": "musicbrainz_work_id", "MusicIpFingerprint": "musicip_fingerprint", "MusicIpPuid": "musicip_puid", "OriginalAlbum": "original_album", "OriginalArtist": "original_artist", "OriginalFilename": "original_filename",
    "OriginalReleaseDate": "original_release_date", "OriginalReleaseYear": "original_release_year", "Rating": "rating", "ReplayGainReferenceLoudness": "replay_gain_reference_loudness", "TrackNumber": "track_number",
    "TrackTitle": "track_title", "TrackTitleSortOrder": "track_title_sort_order", "ArtistWebsite": "artist_website", "WorkTitle": "work_title",
}
TRACK_LISTS = {
    "Arranger": "arranger", "Composer": "composer", "Conductor": "conductor", "Director": "director", "DjMixer": "dj_mixer", "Engineer": "engineer", "Genre": "genre", "Isrc": "isrc", "Lyricist": "lyricist", "Mixer": "mixer",
    "Producer": "producer", "Remixer": "remixer", "Writer": "writer",
}
#: Keys that only an analysis of the file itself may set: what a candidate says about them is never taken over.
ANALYZED_FIELDS = {
    "AcoustIdFingerprint": "acoustid_fingerprint", "ReplayGainTrackGain": "replay_gain_track_gain", "ReplayGainTrackPeak": "replay_gain_track_peak", "ReplayGainTrackRange": "replay_gain_track_range",
    "ReplayGainAlbumGain": "replay_gain_album_gain", "ReplayGainAlbumPeak": "replay_gain_album_peak", "ReplayGainAlbumRange": "replay_gain_album_range",
}
PERFORMER = "Performer:"


def assigned_tags(old: Column, release: dict[str, Column], media: dict[str, Column], track: dict[str, Column], analyzed: dict[str, Column]) -> Column:
    """map<string,array<string>> of a file that takes over a matched track with its medium and release.

    Each argument gives Columns by field name; a field that is null, or not given, clears its key. Performers come as
    array<array<string>> of involvement and name, one key an involvement; those of ``old`` are dropped. Analysed values
    win over any others. Keys of ``old`` that nothing assigns stay.
    """
    none = F.lit(None).cast("array<string>")

    def one(source: dict[str, Column], field: str) -> Column:
        return F.when(source[field].isNotNull(), F.array(source[field].cast("string"))) if field in source else none

    values: dict[str, Column] = {}
    for fields, source in ((RELEASE_FIELDS, release), (MEDIA_FIELDS, media), (TRACK_FIELDS, track), (ANALYZED_FIELDS, analyzed)):
        values |= {key: one(source, field) for key, field in fields.items()}
    for key, field in TRACK_LISTS.items():
        values[key] = F.when(F.size(track[field]) > 0, track[field]) if field in track else none
    new = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in values.items()]), lambda e: e["value"].isNotNull())
    if "performers" in track:
        people = F.filter(F.coalesce(track["performers"], F.array().cast("array<array<string>>")), lambda p: F.size(p) == 2)
        roles = F.array_distinct(F.transform(people, lambda p: p[0]))
        new = F.concat(new, F.transform(roles, lambda r: F.struct(F.concat(F.lit(PERFORMER), r).alias("key"), F.transform(F.filter(people, lambda p: p[0] == r), lambda p: p[1]).alias("value"))))
    kept = F.filter(F.map_entries(old), lambda e: ~e["key"].isin(*values) & ~e["key"].startswith(PERFORMER) & (e["key"] != "Performers"))
    return F.map_from_entries(F.concat(kept, new))


def gapless_text(flag: Column) -> Column:
    return F.when(flag, "1").when(~flag, "0")
