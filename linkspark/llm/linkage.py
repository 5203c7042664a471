"""Matching entities of two sources without keys: loopy belief propagation with one-to-one factors.

Records of each source are first grouped into editions (repeated imports and listings). Editions of the two sources
that share a block become candidate pairs with log-odds from noisy attributes. An edition belongs to at most one of
the other source: messages of these factors pass along the pairs by joins until they settle, and each pair's marginal
probability is its confidence.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from linkspark.llm.links import cells, components
from linkspark.llm.lookalikes import consistent
from linkspark.llm.names import ADDRESS, WHOLE_LETTERS, one_edit
from linkspark.runtime import forget, written

#: Words that listings add to titles and artists without telling editions apart.
TITLE_NOISE = set("album import deluxe edition remastered remaster reissue expanded bonus the".split())
ARTIST_NOISE = set("feat featuring guests friends et al and with the".split()) | ADDRESS

#: Log-odds of the attributes: equal, one edit apart, different. Missing on either side tells nothing.
WEIGHTS = {
    "catalog": (6.0, 1.0, -5.0),
    "barcode": (7.0, 4.5, -4.0),
    "title": (3.0, 2.5, -4.0),
    "artist": (2.0, 1.5, -2.5),
    "label": (0.7, 0.5, -0.7),
    "country": (0.6, 0.0, -0.4),
    "date": (2.0, 0.8, -1.5),
    "kind": (0.2, 0.0, -0.2),
    "discs": (0.3, 0.0, -0.5),
}
PRIOR = -5.0
#: Largest change of a confidence at which the propagation ends.
TOLERANCE = 1e-4
#: Rounds in which it must have ended; more are an error. The damped messages of one-to-one factors settle in some tens.
MOST_ROUNDS = 400
#: Log-odds up to which a pair is impossible: alone it would reach a confidence of 0.05 only, and moves no message more.
IMPOSSIBLE = -3.0
#: Different titles from which a code that stands with no title in half of its rows is a placeholder.
PLACEHOLDER_TITLES = 20
#: Pairs of a block from which it is cut into cells of about that many; changes no result.
HEAVY = 20_000
THRESHOLD = 0.5

FIELDS = ["title", "artist", "barcode", "catalog", "label", "country", "date", "kind", "discs"]
FEATURES = "id long, title array<string>, artist array<string>, barcode string, catalog string, label array<string>, country string, date string, kind string, discs int"


def _fold(text: str | None) -> str:
    text = unicodedata.normalize("NFKD", consistent(text or "").casefold()).translate(WHOLE_LETTERS)
    return "".join(c for c in text if not unicodedata.combining(c)).replace("'", "")


MEDIUM_NOTE = re.compile(r"[(\[]\s*\d*\s*x?\s*(?:cd|lp|ep|dvd|vinyl|discs?)s?\s*[)\]]")


def title_tokens(text: str | None) -> list[str]:
    tokens = re.findall(r"[^\W_]+", MEDIUM_NOTE.sub(" ", _fold(text)))
    return sorted(t for t in tokens if t not in TITLE_NOISE) or sorted(tokens)


def artist_tokens(text: str | None) -> list[str]:
    tokens = re.findall(r"[^\W_]+", _fold(text))
    return sorted(t for t in tokens if t not in ARTIST_NOISE) or sorted(tokens)


def barcode_of(text: str | None) -> str | None:
    """Digits without leading zeros; null for missing and placeholder codes."""
    digits = re.sub(r"\D", "", text or "").lstrip("0")
    return digits if len(digits) >= 8 and len(set(digits)) > 2 else None


def catalog_of(text: str | None) -> str | None:
    """Letters and number of a catalogue number without separators, leading zeros and what follows."""
    m = re.match(r"\W*([^\W\d_]+)\W*0*(\d+)", (text or "").upper())
    return f"{m.group(1)}-{m.group(2)}" if m else None


def date_of(text: str | None, year: str | None) -> str | None:
    """Digits of a date, as far as known: yyyy, yyyymm or yyyymmdd."""
    for v in (text, year):
        digits = re.sub(r"\D", "", v or "")[:8]
        if len(digits) >= 4 and digits[:4] != "0000":
            return digits[: len(digits) // 2 * 2]
    return None


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({
            "id": b["id"],
            "title": [title_tokens(v) for v in b["release_title"]],
            "artist": [artist_tokens(v) for v in b["release_artist"]],
            "barcode": [barcode_of(v) for v in b["barcode"]],
            "catalog": [catalog_of(v) for v in b["catalog_number"]],
            "label": [artist_tokens(v) for v in b["record_label"]],
            "country": [v or None for v in b["release_country"]],
            "date": [date_of(d, y) for d, y in zip(b["release_date"], b["release_year"])],
            "kind": [v or None for v in b["release_type"]],
            "discs": pd.array([int(d) if (d := re.sub(r"\D", "", v or "")[:4]) else None for v in b["total_discs"]], dtype="Int32"),
        })


COLUMNS = ["release_title", "release_artist", "barcode", "catalog_number", "record_label", "release_country", "release_date", "release_year", "release_type", "total_discs"]


def features(df: DataFrame, id_col: str) -> DataFrame:
    return df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), *[F.col(c).cast("string").alias(c) for c in COLUMNS]).mapInPandas(_features, FEATURES)


def _words_key(col: str) -> F.Column:
    return F.when(F.size(col) > 0, F.array_join(col, " "))


#: Log-odds from which two editions of one source are taken for one that is listed or imported again.
SAME_SOURCE = 2.0


def without_placeholders(rows: DataFrame) -> DataFrame:
    """``rows`` of ``features`` with codes nulled that identify nothing: those of many titles, none of which is most frequent.

    So a bogus code of a third of all rows makes no block, while one edition that is imported so often keeps its code.
    """
    for code in ("barcode", "catalog"):
        per_title = rows.where(F.col(code).isNotNull() & (F.size("title") > 0)).groupBy(code, _words_key("title").alias("t")).agg(F.count("*").alias("n"))
        bogus = per_title.groupBy(code).agg(F.count("*").alias("titles"), F.max("n").alias("top"), F.sum("n").alias("all")).where(f"titles > {PLACEHOLDER_TITLES} and top * 2 < all")
        bogus = written(bogus.select(F.col(code).alias("bogus")), "placeholders")
        if not bogus.isEmpty():
            rows = rows.join(bogus, F.col(code) == F.col("bogus"), "left").withColumn(code, F.when(F.col("bogus").isNull(), F.col(code))).drop("bogus")
    return rows


def editions(rows: DataFrame) -> DataFrame:
    """``id, edition``: records of one source that describe one edition get one number, the least of their ids.

    Records that agree in two of catalogue number, barcode and title are one; records of equal title and artist
    without number and code join the edition of those if there is only one. Editions whose log-odds are beyond
    ``SAME_SOURCE`` are then joined, too.
    """
    text = F.when((F.size("title") > 0) & (F.size("artist") > 0), F.array_join(F.array_sort(F.array(_words_key("title"), _words_key("artist"))), "\u001f"))
    base = rows.select("id", "barcode", "catalog", text.alias("text"), _words_key("title").alias("t"))

    def key(tag: str, first: str, second: str) -> F.Column:
        return F.when(F.col(first).isNotNull() & F.col(second).isNotNull(), F.concat_ws("\u001f", F.lit(tag), first, second))

    each = F.array_compact(F.array(key("k", "barcode", "catalog"), key("b", "barcode", "t"), key("c", "catalog", "t")))
    keys = written(base.select("id", F.explode(F.transform(each, lambda k: F.md5(k))).alias("key")), "editionkeys")
    label = components(rows.select("id", F.col("id").alias("label")), keys).withColumnRenamed("label", "edition")
    named = label.join(base.select("id", "text", F.coalesce("barcode", "catalog").isNotNull().alias("named")), "id")
    only = named.where("named and text is not null").groupBy("text").agg(F.min("edition").alias("only"), F.max("edition").alias("last")).where("only = last").select("text", "only")
    bare = named.where("not named and text is not null").groupBy("text").agg(F.min("id").alias("own"))
    joined = named.join(only, "text", "left").join(bare, "text", "left")
    exact = written(joined.select("id", F.when(F.col("named"), F.col("edition")).otherwise(F.coalesce("only", "own", "edition")).alias("edition")), "exact")
    p = written(profiles(rows, exact), "profiles")
    same = candidate_pairs(p, p, below=True).where(F.col("odds") >= float(np.exp(SAME_SOURCE)))
    ties = written(same.select(F.explode(F.array("l", "r")).alias("id"), F.concat_ws("-", "l", "r").alias("key")), "ties")
    joined = components(ties.select("id", F.col("id").alias("label")).distinct(), ties)
    return exact.withColumnRenamed("edition", "e").join(joined.select(F.col("id").alias("e"), F.col("label").alias("edition")), "e", "left").select("id", F.coalesce("edition", "e").alias("edition"))


LISTS = ("title", "artist", "label")


def profiles(rows: DataFrame, grouped: DataFrame) -> DataFrame:
    """One row per edition with the most frequent value of each attribute, nulls aside (dates: the fullest; ties: the greatest)."""
    values = [F.struct(F.lit(c).alias("attribute"), (_words_key(c) if c in LISTS else F.col(c).cast("string")).alias("v")) for c in FIELDS]
    cells = rows.join(grouped, "id").select("edition", F.inline(F.array(*values)))
    counted = cells.groupBy("edition", "attribute", "v").agg(F.count("*").alias("n"))
    rated = F.struct(F.when(F.col("attribute") == "date", F.length("v")).otherwise(F.lit(0)), "n", "v")
    best = counted.groupBy("edition").agg(*[F.max(F.when((F.col("attribute") == c) & F.col("v").isNotNull(), rated))["v"].alias(c) for c in FIELDS])
    return best.select("edition", *[F.split(c, " ").alias(c) if c in LISTS else F.col(c).cast("int").alias(c) if c == "discs" else F.col(c) for c in FIELDS])


def _blocks(p: DataFrame) -> DataFrame:
    """``edition, block``: keys on which true pairs meet although attributes are damaged or missing."""
    words = F.array_union(F.coalesce("title", F.array()), F.coalesce("artist", F.array()))
    long_words = F.filter("artist", lambda t: F.length(t) >= 4)
    def key(tag: str, *cols: F.Column) -> F.Column:
        return F.concat_ws("\u001f", F.lit(tag), *cols)
    each = lambda tag, array, *more: F.transform(array, lambda t: key(tag, t, *more))
    none = F.array().cast("array<string>")
    both = F.array_join(F.array_sort(F.array_distinct(words)), " ")
    full_date = F.when(F.length("date") == 8, F.col("date"))
    lists = [
        F.when(F.col("barcode").isNotNull(), F.array(key("b", F.col("barcode")))),
        F.when(F.col("catalog").isNotNull(), F.array(key("c", F.col("catalog")))),
        F.when(F.size("title") > 0, each("t", long_words, _words_key("title"))),
        F.array(key("w", both)),
        F.when(full_date.isNotNull(), each("d", long_words, F.col("date"))),
        F.when(full_date.isNotNull(), each("e", F.filter("title", lambda t: F.length(t) >= 3), F.col("date"))),
        F.when(full_date.isNotNull(), each("l", F.filter("label", lambda t: F.length(t) >= 5), F.col("date"))),
        F.when(F.length("date") >= 4, F.flatten(F.transform(F.filter("title", lambda t: F.length(t) >= 3), lambda t: each("y", long_words, t, F.substring("date", 1, 4))))),
    ]
    # as hashes: two blocks of one hash would only add pairs that the score then refuses
    hashes = F.transform(F.flatten(F.array(*[F.coalesce(x, none) for x in lists])), lambda k: F.xxhash64(k))
    return p.select("edition", F.explode(F.array_distinct(hashes)).alias("block"))


def _agree(a, b) -> int:
    """0 equal, 1 one edit apart, 2 different, -1 unknown."""
    if a is None or b is None:
        return -1
    return 0 if a == b else 1 if one_edit(a, b) else 2


def _near_token(a: str, b: str) -> bool:
    return a == b or len(a) >= 4 and len(b) >= 4 and one_edit(a, b) or len(min(a, b, key=len)) <= 5 and (a.startswith(b) or b.startswith(a))


def token_agreement(a, b, numbers: bool) -> int:
    """Like ``_agree`` for token lists; with ``numbers``, a number on one side only makes them different."""
    if a is None or b is None or not len(a) or not len(b):
        return -1
    a, b = list(a), list(b)
    if a == b or "".join(a) == "".join(b):
        return 0
    left, rest = [], list(b)
    for t in a:
        if t in rest:
            rest.remove(t)
        else:
            left.append(t)
    spare = []
    for t in left:
        near = next((u for u in rest if _near_token(t, u)), None)
        if near is None:
            spare.append(t)
        else:
            rest.remove(near)
    odd = spare + rest
    if not numbers and (not spare or not rest):  # one name is part of the other
        return 1
    if numbers and any(t.isdigit() or re.fullmatch(r"i{1,3}|iv|vi{0,3}|vol|part|ii|iii", t) for t in odd):
        return 2
    return 1 if sum(map(len, odd)) <= 0.34 * min(sum(map(len, a)), sum(map(len, b))) or one_edit("".join(a), "".join(b)) else 2


def pair_score(x: dict, y: dict) -> float:
    """Log-odds that two editions are the same, of the attributes in ``WEIGHTS``."""
    title = token_agreement(x["title"], y["title"], True)
    artist = token_agreement(x["artist"], y["artist"], False)
    if title == 2 or artist == 2:  # the fields may be swapped
        crossed = token_agreement(x["title"], y["artist"], True), token_agreement(x["artist"], y["title"], False)
        if 2 not in crossed:
            title, artist = crossed
    dates = (x["date"], y["date"])
    if None in dates:
        date = -1
    else:
        k = min(map(len, dates))
        date = 2 if dates[0][:4] != dates[1][:4] else 0 if k == 8 and dates[0] == dates[1] else 1 if dates[0][:k] == dates[1][:k] else 2
    states = {
        "catalog": _agree(x["catalog"], y["catalog"]), "barcode": _agree(x["barcode"], y["barcode"]), "title": title, "artist": artist,
        "label": token_agreement(x["label"], y["label"], False), "country": min(2, 2 * _agree(x["country"], y["country"])) if x["country"] and y["country"] else -1, "date": date,
        "kind": -1 if not x["kind"] or not y["kind"] else 2 * (x["kind"] != y["kind"]), "discs": -1 if x["discs"] is None or y["discs"] is None else 2 * (x["discs"] != y["discs"]),
    }
    return PRIOR + sum(WEIGHTS[k][s] for k, s in states.items() if s >= 0)


def _scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        b = b.astype(object).where(b.notna(), None)
        left = b[[f"l_{f}" for f in FIELDS]].to_numpy()
        right = b[[f"r_{f}" for f in FIELDS]].to_numpy()
        score = [pair_score(dict(zip(FIELDS, x)), dict(zip(FIELDS, y))) for x, y in zip(left, right)]
        out = pd.DataFrame({"l": b["l"].astype("int64"), "r": b["r"].astype("int64"), "odds": np.exp(np.clip(score, -30, 30))})
        yield out[np.array(score) > IMPOSSIBLE]


def _at_most(l: str, r: str) -> F.Column:
    """An upper bound of ``pair_score`` from the attributes that the JVM compares; titles and names count as equal."""

    def state(field: str, differ: F.Column) -> F.Column:
        x, y = F.col(f"{l}_{field}"), F.col(f"{r}_{field}")
        equal, _, different = WEIGHTS[field]
        return F.when(x.isNull() | y.isNull(), 0.0).when(differ, different).otherwise(equal)

    def code(field: str) -> F.Column:
        x, y = F.col(f"{l}_{field}"), F.col(f"{r}_{field}")
        equal, near, different = WEIGHTS[field]
        # two neighbours swapped are one edit to the score and two here
        return F.when(x.isNull() | y.isNull(), 0.0).when(x == y, equal).when(F.levenshtein(x, y, 2) >= 0, near).otherwise(different)

    year = F.substring(F.col(f"{l}_date"), 1, 4) != F.substring(F.col(f"{r}_date"), 1, 4)
    parts = [code("catalog"), code("barcode"), state("date", year), *[state(f, F.col(f"{l}_{f}") != F.col(f"{r}_{f}")) for f in ("country", "kind", "discs")]]
    total = F.lit(PRIOR + sum(max(WEIGHTS[f][0], 0.0) for f in ("title", "artist", "label")))
    for p in parts:
        total = total + p
    return total


def candidate_pairs(left: DataFrame, right: DataFrame, below: bool = False) -> DataFrame:
    """``l, r, odds`` of the editions that share a block and are not impossible; ``below`` asks for l < r."""
    x = written(_blocks(left), "blocks")
    y = x if right is left else written(_blocks(right), "blocks")
    x, y = cells(x, y, "block", "edition", HEAVY)
    met = x.withColumnRenamed("edition", "l").join(y.withColumnRenamed("edition", "r"), "block").where("l < r" if below else "true").select("l", "r").distinct()
    a = left.select(F.col("edition").alias("l"), *[F.col(f).alias(f"l_{f}") for f in FIELDS])
    b = right.select(F.col("edition").alias("r"), *[F.col(f).alias(f"r_{f}") for f in FIELDS])
    possible = met.join(a, "l").join(b, "r").where(_at_most("l", "r") > IMPOSSIBLE)
    return possible.mapInPandas(_scored, "l long, r long, odds double")


def propagate(pairs: DataFrame, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """``l, r, confidence``: marginal probabilities of ``l, r, odds`` under one-to-one factors on both sides.

    The message of a side is the probability, up to scale, that it is free for the pair: 1 / (1 + the odds of its other
    pairs times their messages). Rounds of joins update both directions, halfway in logarithms so that they do not
    swing, until no confidence moves by the tolerance. Such messages have one fixed point; if they have not settled in
    ``most_rounds``, that is an error. Pairs whose two sides have no other need no message.
    """
    every = written(pairs.select("l", "r", "odds"), "scored")
    rivals = every.groupBy("l").agg(F.count("*").alias("at_l")), every.groupBy("r").agg(F.count("*").alias("at_r"))
    told = written(every.join(rivals[0], "l").join(rivals[1], "r").select("l", "r", "odds", ((F.col("at_l") > 1) | (F.col("at_r") > 1)).alias("rivalled")), "rivals")
    alone = told.where("not rivalled").select("l", "r", (F.col("odds") / (1.0 + F.col("odds"))).alias("confidence"))
    state = written(told.where("rivalled").select("l", "r", "odds", F.lit(1.0).alias("from_l"), F.lit(1.0).alias("from_r"), F.lit(0.0).alias("confidence")), "messages")
    for _ in range(most_rounds):
        at_l = state.groupBy("l").agg(F.sum(F.col("odds") * F.col("from_r")).alias("at_l"))
        at_r = state.groupBy("r").agg(F.sum(F.col("odds") * F.col("from_l")).alias("at_r"))
        new_l = F.sqrt(F.col("from_l") / (1.0 + F.greatest(F.lit(0.0), F.col("at_l") - F.col("odds") * F.col("from_r"))))
        new_r = F.sqrt(F.col("from_r") / (1.0 + F.greatest(F.lit(0.0), F.col("at_r") - F.col("odds") * F.col("from_l"))))
        seen, old = Observation(), state
        weight = F.col("odds") * F.col("from_l") * F.col("from_r")
        moved = state.join(at_l, "l").join(at_r, "r").select("l", "r", "odds", new_l.alias("from_l"), new_r.alias("from_r"), F.col("confidence").alias("before"))
        moved = moved.withColumn("confidence", weight / (1.0 + weight)).observe(seen, F.max(F.abs(F.col("confidence") - F.col("before"))).alias("change"))
        state = written(moved.drop("before"), "messages")
        forget(old)
        if (seen.get["change"] or 0.0) < TOLERANCE:
            return alone.unionByName(state.select("l", "r", "confidence"))
    raise RuntimeError(f"messages have not settled in {most_rounds} rounds")


def matched_editions(left: DataFrame, left_id: str, right: DataFrame, right_id: str, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(``l, r, confidence``, members of left, members of right): the same result as pairs of editions and membership.

    Members are the record id and the number of its edition, ``l`` or ``r``; a record that matches nothing has one, too.
    """
    sides = []
    for df, id_col, name in ((left, left_id, "l"), (right, right_id, "r")):
        rows = written(without_placeholders(written(features(df, id_col), "features")), "rows")
        grouped = written(editions(rows), "grouped")
        sides.append((written(profiles(rows, grouped), "profiles"), grouped.select(F.col("id").alias(id_col), F.col("edition").alias(name))))
    (a, a_members), (b, b_members) = sides
    return propagate(candidate_pairs(a, b)).where(F.col("confidence") >= threshold), a_members, b_members


def match_sources(left: DataFrame, left_id: str, right: DataFrame, right_id: str, threshold: float = THRESHOLD) -> DataFrame:
    """``left id, right id, confidence`` of all pairs of records that are the same edition with at least ``threshold``.

    Every record of an edition counts, repeated imports and listings too. Records with no usable attribute match
    nothing; empty tables give no rows. Ties between equal candidates share their probability.
    """
    likely, a_members, b_members = matched_editions(left, left_id, right, right_id, threshold)
    return likely.join(a_members, "l").join(b_members, "r").select(left_id, right_id, "confidence")
