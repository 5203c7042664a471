"""Tags of audio files: key catalogue, containers as maps, editing, conversion between versions, and readers of both formats."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspark.functions import text as X

#: Every key with its level, cardinality, and its names in ID3v2.2, ID3v2.3, ID3v2.4 and Vorbis comments;
#: "-" where a container does not store it, "[...]" the item of a combined frame, "year of" a derived value.
KEY_TABLE = """
AcoustId|track|one|TXXX:Acoustid Id|TXXX:Acoustid Id|TXXX:Acoustid Id|ACOUSTID_ID
AcoustIdFingerprint|track|one|TXXX:Acoustid Fingerprint|TXXX:Acoustid Fingerprint|TXXX:Acoustid Fingerprint|ACOUSTID_FINGERPRINT
Arranger|track|many|-|IPLS[arranger]|TIPL[arranger]|ARRANGER
Artist|track|one|TPE1|TPE1|TPE1|ARTIST
ArtistSortOrder|track|one|TSOP|TSOP|TSOP|ARTISTSORT
Artists|track|one|TXXX:ARTISTS|TXXX:ARTISTS|TXXX:ARTISTS|ARTISTS
Bpm|track|one|TBPM|TBPM|TBPM|BPM
Comment|track|one|COMM:eng:description|COMM:eng:description|COMM:eng:description|COMMENT
Composer|track|many|TCOM|TCOM|TCOM|COMPOSER
ComposerSortOrder|track|one|TSOC|TSOC|TSOC|COMPOSERSORT
Conductor|track|many|TPE3|TPE3|TPE3|CONDUCTOR
Copyright|track|one|TCOP|TCOP|TCOP|COPYRIGHT
Director|track|many|TXXX:DIRECTOR|TXXX:DIRECTOR|TXXX:DIRECTOR|DIRECTOR
DjMixer|track|many|-|IPLS[DJ-mix]|TIPL[DJ-mix]|DJMIXER
EncodedBy|track|one|TENC|TENC|TENC|ENCODEDBY
EncoderSettings|track|one|TSSE|TSSE|TSSE|ENCODERSETTINGS
Engineer|track|many|-|IPLS[engineer]|TIPL[engineer]|ENGINEER
Genre|track|many|TCON|TCON|TCON|GENRE
InitialKey|track|one|TKEY|TKEY|TKEY|KEY
Isrc|track|many|TSRC|TSRC|TSRC|ISRC
Language|track|one|TLAN|TLAN|TLAN|LANGUAGE
License|track|one|-|-|-|LICENSE
Lyricist|track|many|TEXT|TEXT|TEXT|LYRICIST
Lyrics|track|one|-|-|-|LYRICS
Mixer|track|many|-|IPLS[mix]|TIPL[mix]|MIXER
Mood|track|one|-|-|TMOO|MOOD
Movement|track|one|MVNM|MVNM|MVNM|MOVEMENTNAME
MovementCount|track|one|MVIN|MVIN|MVIN|MOVEMENTTOTAL
MovementNumber|track|one|MVIN|MVIN|MVIN|MOVEMENT
MusicBrainzArtistId|track|one|TXXX:MusicBrainz Artist Id|TXXX:MusicBrainz Artist Id|TXXX:MusicBrainz Artist Id|MUSICBRAINZ_ARTISTID
MusicBrainzOriginalArtistId|track|one|TXXX:MusicBrainz Original Artist Id|TXXX:MusicBrainz Original Artist Id|TXXX:MusicBrainz Original Artist Id|MUSICBRAINZ_ORIGINALARTISTID
MusicBrainzOriginalReleaseId|track|one|TXXX:MusicBrainz Original Album Id|TXXX:MusicBrainz Original Album Id|TXXX:MusicBrainz Original Album Id|MUSICBRAINZ_ORIGINALALBUMID
MusicBrainzRecordingId|track|one|UFID:http://musicbrainz.org|UFID:http://musicbrainz.org|UFID:http://musicbrainz.org|MUSICBRAINZ_TRACKID
MusicBrainzTrackId|track|one|TXXX:MusicBrainz Release Track Id|TXXX:MusicBrainz Release Track Id|TXXX:MusicBrainz Release Track Id|MUSICBRAINZ_RELEASETRACKID
MusicBrainzTrmId|track|one|TXXX:MusicBrainz TRM Id|TXXX:MusicBrainz TRM Id|TXXX:MusicBrainz TRM Id|MUSICBRAINZ_TRMID
MusicBrainzWorkId|track|one|TXXX:MusicBrainz Work Id|TXXX:MusicBrainz Work Id|TXXX:MusicBrainz Work Id|MUSICBRAINZ_WORKID
MusicIpFingerprint|track|one|TXXX:MusicMagic Fingerprint|TXXX:MusicMagic Fingerprint|TXXX:MusicMagic Fingerprint|-
MusicIpPuid|track|one|TXXX:MusicIP PUID|TXXX:MusicIP PUID|TXXX:MusicIP PUID|MUSICIP_PUID
OriginalAlbum|track|one|TOAL|TOAL|TOAL|-
OriginalArtist|track|one|TOPE|TOPE|TOPE|-
OriginalFilename|track|one|TOFN|TOFN|TOFN|ORIGINALFILENAME
OriginalReleaseDate|track|one|-|TORY|TDOR|ORIGINALDATE
OriginalReleaseYear|track|one|year of OriginalReleaseDate|year of OriginalReleaseDate|year of OriginalReleaseDate|ORIGINALYEAR
Performers|track|many|-|IPLS[list]|TMCL[list]|PERFORMER
Performer|track|many|-|IPLS[<instrument>]|TMCL[<instrument>]|PERFORMER
Producer|track|many|-|IPLS[producer]|TIPL[producer]|PRODUCER
Rating|track|one|POPM|POPM|POPM|-
Remixer|track|many|TPE4|TPE4|TPE4|REMIXER
ReplayGainAlbumGain|track|one|TXXX:REPLAYGAIN_ALBUM_GAIN|TXXX:REPLAYGAIN_ALBUM_GAIN|TXXX:REPLAYGAIN_ALBUM_GAIN|REPLAYGAIN_ALBUM_GAIN
ReplayGainAlbumPeak|track|one|TXXX:REPLAYGAIN_ALBUM_PEAK|TXXX:REPLAYGAIN_ALBUM_PEAK|TXXX:REPLAYGAIN_ALBUM_PEAK|REPLAYGAIN_ALBUM_PEAK
ReplayGainAlbumRange|track|one|TXXX:REPLAYGAIN_ALBUM_RANGE|TXXX:REPLAYGAIN_ALBUM_RANGE|TXXX:REPLAYGAIN_ALBUM_RANGE|REPLAYGAIN_ALBUM_RANGE
ReplayGainReferenceLoudness|track|one|TXXX:REPLAYGAIN_REFERENCE_LOUDNESS|TXXX:REPLAYGAIN_REFERENCE_LOUDNESS|TXXX:REPLAYGAIN_REFERENCE_LOUDNESS|REPLAYGAIN_REFERENCE_LOUDNESS
ReplayGainTrackGain|track|one|TXXX:REPLAYGAIN_TRACK_GAIN|TXXX:REPLAYGAIN_TRACK_GAIN|TXXX:REPLAYGAIN_TRACK_GAIN|REPLAYGAIN_TRACK_GAIN
ReplayGainTrackPeak|track|one|TXXX:REPLAYGAIN_TRACK_PEAK|TXXX:REPLAYGAIN_TRACK_PEAK|TXXX:REPLAYGAIN_TRACK_PEAK|REPLAYGAIN_TRACK_PEAK
ReplayGainTrackRange|track|one|TXXX:REPLAYGAIN_TRACK_RANGE|TXXX:REPLAYGAIN_TRACK_RANGE|TXXX:REPLAYGAIN_TRACK_RANGE|REPLAYGAIN_TRACK_RANGE
TrackNumber|track|one|TRCK[1st]|TRCK[1st]|TRCK[1st]|TRACKNUMBER
TrackTitle|track|one|TIT2|TIT2|TIT2|TITLE
TrackTitleSortOrder|track|one|TSOT|TSOT|TSOT|TITLESORT
ArtistWebsite|track|one|WOAR|WOAR|WOAR|WEBSITE
WorkTitle|track|one|TXXX:WORK|TXXX:WORK|TXXX:WORK|WORK
Writer|track|many|TXXX:Writer|TXXX:Writer|TXXX:Writer|WRITER
DiscNumber|media|one|TPOS[1st]|TPOS[1st]|TPOS[1st]|DISCNUMBER
DiscSubtitle|media|one|-|-|TSST|DISCSUBTITLE
GaplessPlayback|media|one|-|-|-|-
Media|media|one|TMED|TMED|TMED|MEDIA
MusicBrainzDiscId|media|one|TXXX:MusicBrainz Disc Id|TXXX:MusicBrainz Disc Id|TXXX:MusicBrainz Disc Id|MUSICBRAINZ_DISCID
TotalTracks|media|one|TRCK[2nd]|TRCK[2nd]|TRCK[2nd]|TOTALTRACKS
Album|release|one|TALB|TALB|TALB|ALBUM
AlbumArtist|release|one|TPE2|TPE2|TPE2|ALBUMARTIST
AlbumArtistSortOrder|release|one|TSO2|TSO2|TSO2|ALBUMARTISTSORT
AlbumSortOrder|release|one|TSOA|TSOA|TSOA|ALBUMSORT
Asin|release|one|TXXX:ASIN|TXXX:ASIN|TXXX:ASIN|ASIN
Barcode|release|one|TXXX:BARCODE|TXXX:BARCODE|TXXX:BARCODE|BARCODE
CatalogNumber|release|one|TXXX:CATALOGNUMBER|TXXX:CATALOGNUMBER|TXXX:CATALOGNUMBER|CATALOGNUMBER
Compilation|release|one|TCMP|TCMP|TCMP|COMPILATION
Grouping|release|one|TIT1|TIT1|TIT1|GROUPING
MusicBrainzReleaseArtistId|release|one|TXXX:MusicBrainz Album Artist Id|TXXX:MusicBrainz Album Artist Id|TXXX:MusicBrainz Album Artist Id|MUSICBRAINZ_ALBUMARTISTID
MusicBrainzReleaseGroupId|release|one|TXXX:MusicBrainz Release Group Id|TXXX:MusicBrainz Release Group Id|TXXX:MusicBrainz Release Group Id|MUSICBRAINZ_RELEASEGROUPID
MusicBrainzReleaseId|release|one|TXXX:MusicBrainz Album Id|TXXX:MusicBrainz Album Id|TXXX:MusicBrainz Album Id|MUSICBRAINZ_ALBUMID
RecordLabel|release|one|TPUB|TPUB|TPUB|LABEL
ReleaseCountry|release|one|TXXX:MusicBrainz Album Release Country|TXXX:MusicBrainz Album Release Country|TXXX:MusicBrainz Album Release Country|RELEASECOUNTRY
ReleaseDate|release|one|-|TDAT|TDRC|DATE
ReleaseYear|release|one|-|TYER|year of ReleaseDate|-
ReleaseStatus|release|one|TXXX:MusicBrainz Album Status|TXXX:MusicBrainz Album Status|TXXX:MusicBrainz Album Status|RELEASESTATUS
ReleaseType|release|one|TXXX:MusicBrainz Album Type|TXXX:MusicBrainz Album Type|TXXX:MusicBrainz Album Type|RELEASETYPE
Script|release|one|TXXX:SCRIPT|TXXX:SCRIPT|TXXX:SCRIPT|SCRIPT
TotalDiscs|release|one|TPOS[2nd]|TPOS[2nd]|TPOS[2nd]|TOTALDISCS
Podcast|misc|one|-|-|-|-
PodcastUrl|misc|one|-|-|-|-
ShowName|misc|one|-|-|-|-
ShowNameSortOrder|misc|one|-|-|-|-
ShowMovement|misc|one|TXXX:SHOWMOVEMENT|TXXX:SHOWMOVEMENT|TXXX:SHOWMOVEMENT|SHOWMOVEMENT
Subtitle|misc|one|TIT3|TIT3|TIT3|SUBTITLE
"""

KEYS = [dict(zip(("key", "level", "cardinality", "id3v2.2", "id3v2.3", "id3v2.4", "vorbis"), line.split("|"))) for line in KEY_TABLE.strip().split("\n")]
CONTAINERS = ["id3v2.2", "id3v2.3", "id3v2.4", "vorbis"]
#: Involvements of the combined people frame that are no performers.
NOT_PERFORMERS = ["arranger", "engineer", "DJ-mix", "mix", "producer"]


def key_table(spark: SparkSession) -> DataFrame:
    """key, level, cardinality, container, name: one row per key and container that stores it; bounded by the catalogue."""
    rows = [(k["key"], k["level"], k["cardinality"], c, k[c]) for k in KEYS for c in CONTAINERS if k[c] != "-"]
    return spark.createDataFrame(rows, "key string, level string, cardinality string, container string, name string")


def physical_name(key: Column, container: str) -> Column:
    """Name under which a container stores a key; null if it does not."""
    table = [F.lit(x) for k in KEYS if k[container] != "-" for x in (k["key"], k[container])]
    return F.try_element_at(F.create_map(*table), key)


def get(tags: Column, name: Column) -> Column:
    """First value of a key in a map<string,array<string>>."""
    return F.get(F.try_element_at(tags, name), F.lit(0))


def set_values(tags: Column, name: str, values: Column) -> Column:
    """Map with the key set to the values; null or an empty list clears it."""
    rest = clear(tags, name)
    return F.when(values.isNull() | (F.size(values) == 0), rest).otherwise(F.map_concat(rest, F.create_map(F.lit(name), values)))


def clear(tags: Column, name: str) -> Column:
    return F.map_filter(tags, lambda k, _: k != name)


def set_or_clear(tags: Column, name: str, value: Column) -> Column:
    return set_values(tags, name, F.when(value.isNotNull(), F.array(value)))


def performers(people: Column, combined: bool) -> Column:
    """People who perform; a combined frame also holds other involvements, which are left out."""
    return F.filter(people, lambda p: ~p["involvement"].isin(*NOT_PERFORMERS)) if combined else people


def performers_of(people: Column, instrument: Column) -> Column:
    return F.transform(F.filter(people, lambda p: p["involvement"] == instrument), lambda p: p["involvee"])


def kept_containers(versions: Column) -> Column:
    """Containers of a file that a conversion keeps, as array<struct<container, action>>.

    With ID3v2.3 the other ID3 versions are dropped; else v2.4 is migrated to it and v2.2 dropped; else v2.2 migrated.
    """
    has = lambda v: F.array_contains(versions, v)
    def action(v: Column) -> Column:
        return (
            F.when(~v.startswith("id3"), "keep").when(v == "id3v2.3", "keep").when(has("id3v2.3"), "drop")
            .when(v == "id3v2.4", "migrate").when(has("id3v2.4"), "drop").otherwise("migrate")
        )
    return F.filter(F.transform(versions, lambda v: F.struct(v.alias("container"), action(v).alias("action"))), lambda s: s["action"] != "drop")


def migrated(frames: DataFrame, source: str, target: str) -> DataFrame:
    """Frames (id, value) of one version as those of another: same or new id, dropped where the target has none.

    A conversion to v2.2 is not supported and leaves nothing.
    """
    pairs = sorted({(k[source], k[target]) for k in KEYS if k[source] != "-" and k[target] != "-" and "[" not in k[source] and not k[source].startswith("year") and not k[target].startswith("year")})
    if target == "id3v2.2":
        return frames.limit(0)
    table = frames.sparkSession.createDataFrame(pairs, "frame string, to string")
    return frames.join(F.broadcast(table), "frame").withColumn("frame", F.col("to")).drop("to")


def write_plan(old: DataFrame, new: DataFrame, key: str = "path") -> DataFrame:
    """path, key, old, new: what writing the new tags would change; both have path and tags map<string,array<string>>."""
    a = old.select(key, F.explode("tags").alias("key", "old"))
    b = new.select(key, F.explode("tags").alias("key", "new"))
    return a.join(b, [key, "key"], "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))


def _text(data: bytes) -> list[str]:
    """Values of a text frame: an encoding byte, then texts with NULs between."""
    if not data:
        return []
    codec = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(data[0], "latin-1")
    text = data[1:].decode(codec, "replace").rstrip("\0")
    return text.split("\0")


def _syncsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


#: Three-letter frame ids of ID3v2.2 and their later names.
V22 = dict(p.split("=") for p in "TT2=TIT2 TT1=TIT1 TT3=TIT3 TP1=TPE1 TP2=TPE2 TP3=TPE3 TP4=TPE4 TAL=TALB TRK=TRCK TPA=TPOS TCM=TCOM TCO=TCON TYE=TYER TDA=TDAT TOR=TORY TBP=TBPM TCR=TCOP TEN=TENC TSS=TSSE TKE=TKEY TRC=TSRC TLA=TLAN TXT=TEXT TPB=TPUB TMT=TMED TOT=TOAL TOA=TOPE TOF=TOFN TXX=TXXX COM=COMM UFI=UFID IPL=IPLS POP=POPM TCP=TCMP TSP=TSOP TSA=TSOA TST=TSOT TSC=TSOC TS2=TSO2".split())


def read_id3(data: bytes) -> dict[str, list[str]] | None:
    """Frames of an ID3v2 tag: texts, user texts as TXXX:name, comments as COMM:language:name, ids as UFID:owner, people.

    A file without a tag has an empty one; None for a cut-off tag.
    """
    if data[:3] != b"ID3" or len(data) < 10:
        return {}
    major, flags = data[3], data[5]
    end = 10 + _syncsafe(data[6:10])
    if end > len(data):
        return None
    body = data[10:end]
    if flags & 0x80 and major < 4:
        body = body.replace(b"\xff\x00", b"\xff")
    at = 0
    if flags & 0x40:
        at = _syncsafe(body[:4]) if major == 4 else 4 + int.from_bytes(body[:4], "big")
    out: dict[str, list[str]] = {}
    head = 6 if major == 2 else 10
    while at + head <= len(body) and body[at]:
        name = body[at : at + (3 if major == 2 else 4)].decode("latin-1")
        size = int.from_bytes(body[at + 3 : at + 6], "big") if major == 2 else _syncsafe(body[at + 4 : at + 8]) if major == 4 else int.from_bytes(body[at + 4 : at + 8], "big")
        frame = body[at + head : at + head + size]
        at += head + size
        name = V22.get(name, name)
        if name == "TXXX":
            values = _text(frame)
            if values:
                out.setdefault(f"TXXX:{values[0]}", []).extend(values[1:])
        elif name in ("COMM", "USLT") and len(frame) > 4:
            values = _text(frame[:1] + frame[4:])
            out.setdefault(f"{name}:{frame[1:4].decode('latin-1')}:{values[0]}", []).extend(values[1:])
        elif name == "UFID":
            owner, _, ident = frame.partition(b"\0")
            out.setdefault(f"UFID:{owner.decode('latin-1')}", []).append(ident.decode("latin-1"))
        elif name in ("IPLS", "TIPL", "TMCL"):
            values = _text(frame)
            for role, person in zip(values[::2], values[1::2]):
                out.setdefault(f"{name}[{role}]", []).append(person)
        elif name.startswith("T"):
            out.setdefault(name, []).extend(_text(frame))
        elif name.startswith("W"):
            out.setdefault(name, []).append(frame.decode("latin-1"))
    return out


def read_vorbis(data: bytes) -> dict[str, list[str]] | None:
    """Vorbis comments of a FLAC file, names in upper case; None if it is no such file or cut off."""
    if data[:4] != b"fLaC":
        return None
    at = 4
    try:
        while True:
            kind, size = data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
            if kind == 4:
                body = data[at + 4 : at + 4 + size]
                skip = 4 + struct.unpack_from("<I", body)[0]
                n = struct.unpack_from("<I", body, skip)[0]
                skip += 4
                out: dict[str, list[str]] = {}
                for _ in range(n):
                    length = struct.unpack_from("<I", body, skip)[0]
                    if skip + 4 + length > len(body):
                        return None
                    name, _, value = body[skip + 4 : skip + 4 + length].decode("utf-8", "replace").partition("=")
                    out.setdefault(name.upper(), []).append(value)
                    skip += 4 + length
                return out
            if data[at] & 0x80:
                return {}
            at += 4 + size
    except (IndexError, struct.error):
        return None


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for path, content in zip(b["path"], b["content"]):
            kind = path.rsplit(".", 1)[-1].lower()
            tags = None if content is None else read_id3(bytes(content)) if kind == "mp3" else read_vorbis(bytes(content)) if kind == "flac" else None
            container = None if tags is None else "vorbis" if kind == "flac" else f"id3v2.{content[3]}" if bytes(content[:3]) == b"ID3" else "id3v2.4"
            out.append((path, container, tags))
        yield pd.DataFrame(out, columns=["path", "container", "tags"])


def read_tags(files: DataFrame) -> DataFrame:
    """path, container, tags of files with ``path`` and ``content``; tags are null for unreadable and unknown files."""
    return files.select("path", "content").mapInPandas(_read, "path string, container string, tags map<string,array<string>>")


def total_and_number(number: Column) -> tuple[Column, Column]:
    """Number and total of a combined "3/12" value."""
    return X.first_of_pair(number), X.second_of_pair(number)
