"""Scalar text functions as Column expressions; what Catalyst lacks is an Arrow UDF in ``transliterate``/``textdiff``."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Artists that stand for no single artist.
VARIOUS_ARTISTS = ["", "various artists", "various", "va", "v.a.", "[various]", "[various artists]", "unknown"]
#: Strings read as true.
TRUTHY = ["1", "on", "true", "yes"]
#: Kinds of entities that an address of the catalogue names.
ENTITY_KINDS = ["area", "artist", "event", "genre", "instrument", "label", "place", "recording", "release", "release-group", "series", "work"]
#: Fixed value: letters that decompose to more than one ASCII letter.
DIGRAPHS = {"ß": "ss", "æ": "ae", "œ": "oe", "Æ": "AE", "Œ": "OE", "þ": "th", "Þ": "Th", "ĳ": "ij", "Ĳ": "IJ"}
#: Fixed value: letters with strokes, which do not decompose.
STROKES = {"ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "ħ": "h", "Ħ": "H", "ı": "i", "ŧ": "t", "Ŧ": "T"}

_WHITE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def latin_fold_table() -> tuple[str, str]:
    """Letters of U+00C0 to U+024F and the ASCII letters below their marks, built from their decompositions."""
    pairs = dict(STROKES)
    for code in range(0xC0, 0x250):
        base = unicodedata.normalize("NFKD", chr(code))[0]
        if base.isascii() and base.isalpha():
            pairs[chr(code)] = base
    return "".join(pairs), "".join(pairs.values())


def fold_latin(c: Column) -> Column:
    """ASCII form of Latin letters; other scripts stay."""
    source, target = latin_fold_table()
    out = F.translate(c, source, target)
    for letter, ascii_form in DIGRAPHS.items():
        out = F.replace(out, F.lit(letter), F.lit(ascii_form))
    return out


def normalize(c: Column) -> Column:
    """Comparison form: folded, lower case, a trailing article moved to the front, "&" spelled out. Nothing is trimmed."""
    out = F.lower(fold_latin(c))
    out = F.regexp_replace(out, r"(?s)^(.*), (the|a|an)$", "$2 $1")
    return F.replace(out, F.lit("&"), F.lit("and"))


def strip_non_ascii(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\x00-\x7F]", "")


def normalized_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance of two normalised texts over the longer length; 0 for two empty ones."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(0.0)).otherwise(F.levenshtein(a, b) / longest)


def trim_unicode(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, f"^{_WHITE}+|{_WHITE}+$", "")


def same_identifier(a: Column, b: Column) -> Column:
    """Whether two identifiers are equal once trimmed and not empty."""
    return (trim_unicode(a) == trim_unicode(b)) & (trim_unicode(a) != "")


def trim_leading_zeros(c: Column) -> Column:
    return F.regexp_replace(c, "^0+", "")


def strip_disc_suffix(c: Column) -> Column:
    """A title without a trailing disc designation such as "(CD 1)", "[Disc 2]" or "- Disc 3"."""
    return F.regexp_replace(c, r"(?i)\s*(?:[\(\[]|-)?\s*(?:CD|Disc)\s*\d+\s*[\)\]]?\s*$", "")


def is_disc_directory(c: Column) -> Column:
    return c.rlike(r"(?i)^(?:CD|Disc)\s*\d+$")


def escape_path_chars(c: Column, windows: bool = False) -> Column:
    """Control characters removed, white space made spaces, separators underscores."""
    out = F.regexp_replace(c, r"[\x00-\x1F\x7F-\x9F]", "")
    out = F.regexp_replace(out, _WHITE, " ")
    return F.regexp_replace(out, r'[/\\:*?"<>|]' if windows else "/", "_")


def zfill(c: Column, width: Column | int) -> Column:
    """At least ``width`` characters, zeros in front; never cut off."""
    width = F.lit(width) if isinstance(width, int) else width
    text = c.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def decimal_width(c: Column) -> Column:
    """Decimal digits of a count; 1 for 0."""
    return F.length(c.cast("string"))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def file_stem(path: Column) -> Column:
    """Name without its last extension; a leading dot starts no extension."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def file_extension(path: Column) -> Column:
    """Last extension without the dot; null where there is none."""
    name = file_name(path)
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_extract(name, r"\.([^.]*)$", 1))


def has_extension(path: Column, *extensions: str) -> Column:
    return F.coalesce(F.lower(file_extension(path)).isin(*extensions), F.lit(False))


def first_of_pair(c: Column) -> Column:
    """What stands before the first "/"; the whole value without one."""
    return F.split_part(c, F.lit("/"), F.lit(1))


def second_of_pair(c: Column) -> Column:
    """What stands after the first "/"; null without one."""
    at = F.instr(c, "/")
    return F.when(at > 0, F.substr(c, at + 1))


def set_first_of_pair(c: Column, value: Column) -> Column:
    second = second_of_pair(c)
    return F.when(second.isNull(), value).otherwise(F.concat(value, F.lit("/"), second))


def set_second_of_pair(c: Column, value: Column) -> Column:
    """Null (no frame) when there is no first part to keep."""
    return F.when(c.isNotNull(), F.concat(first_of_pair(c), F.lit("/"), value))


def clear_second_of_pair(c: Column) -> Column:
    return first_of_pair(c)


PERFORMER = r"(?s)^(.*?) \((.*)\)$"


def performer_name(c: Column) -> Column:
    """Name in "Name (role)", split at the first " ("; the whole value if it has no such form."""
    return F.when(c.rlike(PERFORMER), F.regexp_extract(c, PERFORMER, 1)).otherwise(c)


def performer_role(c: Column) -> Column:
    return F.when(c.rlike(PERFORMER), F.regexp_extract(c, PERFORMER, 2)).otherwise(F.lit(""))


def performer_text(name: Column, role: Column) -> Column:
    return F.concat(name, F.lit(" ("), role, F.lit(")"))


def join_values(c: Column) -> Column:
    """Values of a list in one text, as containers without lists keep them."""
    return F.array_join(c, " / ")


def strip_trailing_nul(c: Column) -> Column:
    return F.regexp_replace(c, "\\x00$", "")


def split_artists(c: Column) -> Column:
    return F.transform(F.split(c, "[,&/]"), lambda x: F.trim(x))


UUID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"


def entity_pattern(host: str) -> str:
    return rf"^(?:https?://{host.replace('.', '[.]')}/(?:ws/2/)?({'|'.join(sorted(ENTITY_KINDS, key=len, reverse=True))})/)?\b({UUID})\b"


def entity_id(c: Column, host: str) -> Column:
    """Id in a bare id or an address of the catalogue at ``host``; null if the text is neither."""
    found = F.regexp_extract(c, entity_pattern(host), 2)
    return F.when(found != "", found)


def entity_kind(c: Column, host: str) -> Column:
    """Kind of the entity; a bare id is a release."""
    kind = F.regexp_extract(c, entity_pattern(host), 1)
    return F.when(entity_id(c, host).isNotNull(), F.when(kind == "", F.lit("release")).otherwise(kind))


def entity_problem(c: Column, host: str) -> Column:
    """Message if a text names no release or release group; null if it is fine or empty."""
    kind = entity_kind(c, host)
    return F.when((c == "") | kind.isin("release", "release-group"), F.lit(None)).when(kind.isNull(), F.lit("not an id")).otherwise(F.concat(F.lit("expected a release, not: "), kind))


def budget_join(items: Column, limit: int, separator: str = " | ") -> Column:
    """Items joined while they fit into ``limit`` bytes; one that does not is skipped, later shorter ones may still fit."""
    extra = len(separator.encode())
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("used"))

    def step(acc: Column, x: Column) -> Column:
        need = F.octet_length(x) + F.when(acc["used"] > 0, F.lit(extra)).otherwise(F.lit(0))
        fits = acc["used"] + need <= limit
        text = F.when(acc["used"] > 0, F.concat(acc["text"], F.lit(separator), x)).otherwise(x)
        return F.struct(F.when(fits, text).otherwise(acc["text"]).alias("text"), F.when(fits, acc["used"] + need).otherwise(acc["used"]).cast("int").alias("used"))

    return F.aggregate(items, start, step, lambda acc: acc["text"])


def artist_and_title(artist: Column, title: Column) -> Column:
    return F.concat(F.coalesce(artist, F.lit("[unknown artist]")), F.lit(" - "), F.coalesce(title, F.lit("[unknown album]")))


def track_line(number: Column, title: Column, artist: Column, length: Column) -> Column:
    """Line of a track list: number, title, artist and length, without what is missing."""
    shown = F.concat_ws(" - ", artist, F.coalesce(title, F.lit("[unknown title]")))
    return F.concat_ws(" ", F.concat(number, F.lit(".")), shown, F.concat(F.lit("("), length, F.lit(")")))


def similarity_percent(distance: Column) -> Column:
    return F.round((1 - distance) * 100, 2)


def similarity_colour(distance: Column) -> Column:
    return F.when(distance <= 0.1, "green").when(distance <= 0.5, "yellow").otherwise("red")


def change_list(title_equal: Column, number_equal: Column, length_equal: Column, id_equal: Column) -> Column:
    """Names of the parts that differ; a null flag differs in nothing."""
    parts = [F.when(~ok, F.lit(name)) for ok, name in ((number_equal, "#"), (title_equal, "title"), (length_equal, "length"), (id_equal, "id"))]
    return F.concat_ws(", ", *parts)


def numbered_extension(path: Column, n: Column) -> Column:
    return F.concat(path, F.lit("."), n.cast("string"))


def is_truthy(c: Column) -> Column:
    return F.lower(c).isin(*TRUTHY)


def parse_unsigned(c: Column) -> Column:
    """Whole number of 32 bits without sign; null for other texts."""
    n = F.when(c.rlike(r"^\+?[0-9]+$"), c.try_cast("bigint"))
    return F.when(n <= 4294967295, n)


def exact_unsigned(c: Column) -> Column:
    """A float as a whole number; null unless it is finite, not negative and whole."""
    return F.when((c >= 0) & (c < float(1 << 63)) & (c == F.floor(c)), c.cast("bigint"))


def entity_url(base: str, kind: str, c: Column) -> Column:
    return F.concat(F.lit(f"{base}/{kind}/"), c)


def base64_url(c: Column) -> Column:
    """Base64 of binary in the URL alphabet, without padding."""
    return F.translate(F.base64(c), "+/=\r\n", "-_")


def query_key(query: Column, limit: int, offset: int) -> Column:
    """SHA-256 of a query with its page: text, "|", limit as a byte, "|", offset as two bytes."""
    return F.sha2(F.concat(F.encode(query, "utf-8"), F.unhex(F.lit(f"7C{limit:02X}7C{offset:04X}"))), 256)


def is_various_artists(c: Column) -> Column:
    return F.coalesce(F.lower(c).isin(*VARIOUS_ARTISTS), F.lit(False))
