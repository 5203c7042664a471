"""Visually identical text of different characters: one consistent form by look-alike mapping and Unicode collation.

Values are mapped letter by letter to look-alike prototypes and grouped in SQL under an accent-sensitive Unicode
collation, which by itself ignores width, style, composition and invisible characters. Each class gets one canonical
member, which is joined back to its members.
"""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkspark.llm.encoding import garbled_values
from linkspark.runtime import written

#: Letters of other scripts and the Latin letters they look like, in pairs.
TO_LATIN = dict(zip(
    "аеорсухіјѕԁһԛԝӏАВЕКМНОРСТХУІЈЅԌԚԜҮ" "ονυραιϲΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹ" "օցսոհզ" "ᎪᏟᎬᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃ" "ɑɡ",
    "aeopcyxijsdhqwlABEKMHOPCTXYIJSGQWY" "ovupaicABEZHIKMNOPTYXC" "ogunhq" "ACEHJKLMPRSTVWZ" "ag",
))
#: Latin letters and the Cyrillic or Greek letters they look like.
TO_CYRILLIC = dict(zip("aeopcyxijsdhqwlABEKMHOPCTXYIJS", "аеорсухіјѕԁһԛԝӏАВЕКМНОРСТХУІЈЅ"))
TO_GREEK = dict(zip("ovpuaiABEZHIKMNOPTYXkytnw", "ονρυαιΑΒΕΖΗΙΚΜΝΟΡΤΥΧκγτηω"))
#: Superscripts, fractions and ordinals that are ordinary characters although Unicode maps them to others.
ORDINARY = set("ªº²³¹¼½¾µ")

#: Times by which one reading of a word must outnumber the other to be what was meant.
MIN_RATIO = 3


@lru_cache(maxsize=1 << 16)
def script(ch: str) -> str:
    name = unicodedata.name(ch, "?").split(" ")[0]
    return "LATIN" if ch.isascii() and ch.isalpha() else name if name in ("CYRILLIC", "GREEK", "ARMENIAN", "CHEROKEE", "LATIN") else "OTHER"


def _plain_char(ch: str, east: bool) -> str:
    category = unicodedata.category(ch)
    if ch in "ɑɡ":  # Latin letters themselves, but of no word's spelling
        return TO_LATIN[ch]
    if category == "Cf" or 0xFE00 <= ord(ch) <= 0xFE0F or ch in "ᅟᅠㅤ͏":
        return ""
    if category == "Zs":
        return " "
    if category in ("Cc", "Co", "Cs", "Cn"):
        return ch
    if ch in TO_LATIN and script(ch) != "LATIN" or ch in ORDINARY:
        return ch
    wide = 0xFF01 <= ord(ch) <= 0xFF5E
    if category[0] in "LN" or wide and not east:
        return unicodedata.normalize("NFKC", ch)
    return ch


def _words(text: str) -> Iterator[tuple[bool, str]]:
    """Runs of letters and marks, and what stands between them."""
    start = 0
    for i in range(1, len(text) + 1):
        if i == len(text) or (unicodedata.category(text[i])[0] in "LM") != (unicodedata.category(text[start])[0] in "LM"):
            yield unicodedata.category(text[start])[0] in "LM", text[start:i]
            start = i


def readings(word: str) -> dict[str, str]:
    """The word written wholly in each script that look-alikes allow, by script."""
    out = {}
    for target, table in (("LATIN", None), ("CYRILLIC", TO_CYRILLIC), ("GREEK", TO_GREEK)):
        chars = []
        for ch in word:
            base = unicodedata.normalize("NFD", ch)
            s = script(base[0])
            if s == target and base[0] not in "ɑɡ" or unicodedata.category(ch)[0] == "M":
                chars.append(ch)
                continue
            latin = TO_LATIN.get(base[0], base[0] if s == "LATIN" else None)
            new = latin if table is None else table.get(latin) if latin else None
            if new is None:
                break
            chars.append(new + base[1:])
        else:
            out[target] = unicodedata.normalize("NFC", "".join(chars))
    return out


def _own_script(word: str) -> str | None:
    found = {script(unicodedata.normalize("NFD", c)[0]) for c in word if unicodedata.category(c)[0] == "L"}
    return found.pop() if len(found) == 1 else None


def consistent(text: str, context: dict[str, str] | None = None) -> str:
    """``text`` in ordinary precomposed letters of the script each word is meant to be in, plain spaces, nothing invisible.

    A word of several scripts is read in the script that allows all its letters; where two do, in that of most of the
    value's other letters. ``context`` gives the meant form of words that are written wholly in look-alikes.
    """
    if text.isascii() and not context:
        return text
    east = any(script(c) == "OTHER" and unicodedata.category(c) == "Lo" for c in text)
    text = unicodedata.normalize("NFC", "".join(_plain_char(c, east) for c in text))
    parts = list(_words(text)) if text else []
    sure: dict[str, int] = {}
    for is_word, w in parts:
        if is_word and len(r := readings(w)) == 1:
            k = next(iter(r))
            sure[k] = sure.get(k, 0) + len(w)
    out = []
    for is_word, w in parts:
        if is_word:
            r = readings(w)
            own = _own_script(w)
            if own not in ("LATIN", "CYRILLIC", "GREEK", "OTHER") and r:
                share: dict[str, int] = {}
                for c in w:
                    share[script(c)] = share.get(script(c), 0) + 1
                w = r[max(r, key=lambda k: (len(r) == 1, sure.get(k, 0), share.get(k, 0), k == "LATIN"))]
            elif context and w in context:
                w = context[w]
            elif own in r and len(r) > 1 and len(w) <= 2 and sure and own not in sure and own != "LATIN" and len(sure) == 1 and next(iter(sure)) in r:
                w = r[next(iter(sure))]
        out.append(w)
    return "".join(out)


def _candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Words written wholly in look-alikes of one other script, with that other reading."""
    for b in batches:
        out = []
        for w in b["word"]:
            own = _own_script(w)
            out += [(w, form) for s, form in readings(w).items() if own in ("LATIN", "CYRILLIC", "GREEK") and s != own and form != w]
        yield pd.DataFrame(out, columns=["word", "reading"])


def _forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        context = [{} if w is None else dict(zip(w, r)) for w, r in zip(b["words"], b["meant"])]
        b["form"] = [consistent(v, c) for v, c in zip(b["value"], context)]
        yield b[["value", "form"]]


def _squashed(col: str) -> F.Column:
    return F.trim(F.lower(F.regexp_replace(col, r"[ \t\r\n]+", " ")))


def canonical_forms(values: DataFrame) -> DataFrame:
    """``value, form, canonical`` for the distinct ``value, n`` that differ in characters from what their class is meant to be.

    Classes are built by GROUP BY on the look-alike-mapped text COLLATE UNICODE_CI (accents count, case, width, style
    and invisible characters do not); members that the collation alone makes equal, such as kana of both kinds, stay
    apart by the mapped letters of their forms. Every member votes for its consistent form. The canonical member is the
    most frequent one of those that are consistent themselves in the reading of the most votes, then the least in
    code-point order; a class without a consistent member takes the consistent form of each.
    """
    spark = values.sparkSession
    letters = values.select("n", F.explode(F.array_distinct(F.regexp_extract_all("value", F.lit(r"[\p{L}\p{M}]+"), 0))).alias("word")).groupBy("word").agg(F.sum("n").alias("n"))
    letters = written(letters, "letters")
    foreign = letters.where(r"word rlike '^[\\p{IsCyrillic}\\p{IsGreek}]+$' or (word rlike '^[A-Za-z]+$' and length(word) >= 3)")
    other = foreign.mapInPandas(_candidates, "word string, reading string")
    meant = other.join(letters.select("word", "n"), "word").join(letters.select(F.col("word").alias("reading"), F.col("n").alias("m")), "reading").where(f"m >= {MIN_RATIO} * n")
    meant = meant.groupBy("word").agg(F.max(F.struct("m", "reading")).alias("top")).select("word", F.col("top.reading").alias("reading"))

    odd = values.where(r"value rlike '[^\\x00-\\x7F]'")
    in_value = odd.select("value", F.explode(F.array_distinct(F.regexp_extract_all("value", F.lit(r"[\p{L}\p{M}]+"), 0))).alias("word")).join(meant, "word").groupBy("value").agg(F.collect_list(F.struct("word", "reading")).alias("l")).select("value", F.col("l.word").alias("words"), F.col("l.reading").alias("meant"))
    mapped = odd.select("value").join(in_value, "value", "left").mapInPandas(_forms, "value string, form string")
    formed = written(values.join(mapped, "value", "left").select("value", "n", F.coalesce("form", "value").alias("form")), "forms")

    sources, targets = "".join(TO_LATIN), "".join(TO_LATIN.values())

    def plain(c: str) -> F.Column:
        return F.translate(F.regexp_replace(c, r"[\p{Cf}]", ""), sources, targets)

    view = f"lookalike_forms_{uuid.uuid4().hex}"
    formed.select("value", "n", "form", plain("value").alias("mapped"), _squashed(plain("form")).alias("shape"), _squashed("form").alias("reading")).createTempView(view)
    classes = spark.sql(f"""
        WITH readings AS (
            SELECT mapped COLLATE UNICODE_CI AS class, shape, reading, sum(n) AS m, min_by(value, struct(-n, value)) FILTER (WHERE value = form) AS member
            FROM {view} GROUP BY mapped COLLATE UNICODE_CI, shape, reading)
        SELECT class, shape, min_by(member, struct(-m, member)) AS canonical FROM readings WHERE member IS NOT NULL GROUP BY class, shape""")
    members = spark.sql(f"SELECT value, form, shape, mapped COLLATE UNICODE_CI AS class FROM {view}")
    spark.catalog.dropTempView(view)  # the plans above keep what they read
    joined = members.join(classes, ["class", "shape"], "left")
    chosen = F.when(_squashed("canonical") != _squashed("value"), F.col("canonical")).otherwise(F.col("form"))
    return joined.select("value", "form", chosen.alias("canonical")).where(_squashed("value") != _squashed("canonical"))


def find_lookalikes(tables: list[tuple[DataFrame, str, list[str]]]) -> DataFrame:
    """``field_name, record_id, value, form, canonical`` of the values that differ from the canonical member of their class.

    ``form`` is the value's own consistent form and keeps its case; where the class has no consistent member, ``canonical``
    is that form. Nulls, empty values and wrongly decoded values (see ``encoding``) never count; stray plain spaces,
    tabs, line breaks and letter case make no difference. Record ids that occur twice with one content give one row.
    """
    rows = None
    for df, id_col, columns in tables:
        pairs = F.inline(F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).cast("string").alias("value")) for c in columns]))
        part = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("record_id"), pairs).where("value <> ''").select("field_name", "record_id", "value")
        rows = part if rows is None else rows.unionByName(part)
    values = written(rows.groupBy("value").agg(F.count("*").alias("n")), "values")
    garbled = garbled_values(values.where(r"value rlike '[^\\x00-\\x7F]'")).select("value")
    sound = written(values.join(garbled, "value", "left_anti"), "sound")
    return rows.join(canonical_forms(sound), "value").select("field_name", "record_id", "value", "form", "canonical").distinct()
