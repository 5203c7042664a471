"""Transliteration to ASCII of scripts that tables for Catalyst would be too large for; an Arrow UDF, rule based."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Cyrillic letters in alphabetical order and their Latin forms.
CYRILLIC = dict(zip("абвгдеёжзийклмнопрстуфхцчшщъыьэюяіїєґјљњћџђѓќўѕ", "a b v g d e io zh z i i k l m n o p r s t u f kh ts ch sh shch ' y ' e iu ia i yi ye g j lj nj c dz dj gj kj u dz".split()))
#: Greek letters and their Latin forms.
GREEK = dict(zip("αβγδεζηθικλμνξοπρςστυφχψω", "a b g d e z e th i k l m n x o p r s s t u ph kh ps o".split()))
OTHERS = {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ı": "i", "ħ": "h", "–": "-", "—": "--", "‘": "'", "’": "'", "“": '"', "”": '"', "…": "...", "•": "*", "€": "EUR", "™": "(tm)"}


@lru_cache(maxsize=1 << 16)
def letter(ch: str) -> str:
    """ASCII form of one character; "" where none is known."""
    if ch.isascii():
        return ch
    low = ch.lower()
    for table in (CYRILLIC, GREEK, OTHERS):
        if low in table:
            out = table[low]
            return out[:1].upper() + out[1:] if ch != low else out
    # names of kana end in their romanisation
    kana = re.fullmatch(r"(?:HIRAGANA|KATAKANA) LETTER (?:SMALL )?(\w+)", unicodedata.name(ch, ""))
    if kana:
        return kana.group(1).lower()
    base = unicodedata.normalize("NFKD", ch)
    return "".join(letter(c) for c in base if not unicodedata.combining(c)) if base != ch else ""


def to_ascii(text: str) -> str:
    return "".join(letter(c) for c in text)


@F.pandas_udf(T.StringType())
def transliterate(c: pd.Series) -> pd.Series:
    return c.map(lambda v: None if v is None else v if v.isascii() else to_ascii(v))
