"""Text garbled by decoding with a wrong character encoding: find it and restore it.

Words are compared, since often only part of a value is garbled. A word and the most frequent word with the same text
stripped of non-ASCII characters are near-twins. Their ASCII characters are aligned one by one, so that each run of
other characters stands beside the run it was made of. From these pairs of runs the transformations are learned:
decoding mistakes between any two encodings that Python knows, and plain substitutions where no encodings explain a
pair that recurs. What is learned is applied to all words: forward, to find garbled forms of known words, and backward,
judged by a model of character pairs, where the clean word is unknown.
"""

from __future__ import annotations

import codecs
import re
import unicodedata
import zlib
from collections.abc import Iterator
from encodings.aliases import aliases
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkspark.runtime import written

#: Encodings that text is most often written in, and those that it is most often wrongly read in. Mistakes
#: among them are preferred where they explain the same runs as others.
WRITTEN_IN = ["utf-8", "cp1252", "cp1250", "iso8859-2", "cp1251", "koi8-r", "cp866", "mac-roman", "cp850", "cp1253", "iso8859-7", "shift_jis", "euc-jp"]
READ_IN = ["cp1252", "latin-1", "mac-roman", "cp437", "cp850", "cp1251", "cp1250", "iso8859-2", "koi8-r", "cp866"]

#: Distinct near-twin words that must agree on a mistake before it is applied to others.
MIN_SUPPORT = 3
#: Share of the words with a run that must have a near-twin with one other run, before that substitution is learned.
MIN_SHARE = 0.5
#: Characters from which a word alone is evidence; shorter ones need their value's context.
STRONG_LENGTH = 3
#: Times by which the clean word must outnumber its garbled form.
MIN_RATIO = 2.0
#: Gain in mean log-probability of a character pair for restoring to a word that does not occur.
MIN_GAIN = 1.5
#: Plain characters between words.
SEPARATOR = r'[ \t\r\n,.!?;:()"/]'
#: Size of the hashed table of character pairs; fixed, so that it may be broadcast.
PAIR_BUCKETS = 1 << 18


def _keep_byte(error: UnicodeError) -> tuple[str | bytes, int]:
    if isinstance(error, UnicodeDecodeError):
        return "".join(map(chr, error.object[error.start : error.end])), error.end
    if isinstance(error, UnicodeEncodeError):
        text = error.object[error.start : error.end]
        if all(0x80 <= ord(c) <= 0x9F for c in text):
            return bytes(map(ord, text)), error.end
    raise error


def _register() -> None:
    codecs.register_error("keepbyte", _keep_byte)


def mistakes() -> list[str]:
    """Names ``written>read:mode``, also applied twice; mode says what became of bytes that the reader lacks."""
    out = []
    for w in WRITTEN_IN:
        for r in READ_IN:
            if w != r and {w, r} != {"cp1252", "latin-1"}:
                out += [f"{w}>{r}:keepbyte", f"{w}>{r}:ignore"]
    twice = [f"utf-8>{r}:{m}" for r in ("cp1252", "latin-1", "mac-roman", "cp1251", "cp850") for m in ("keepbyte", "ignore")]
    return out + [f"{a}+{a}" for a in twice] + ["utf-8>cp1252:keepbyte+utf-8>latin-1:keepbyte", "utf-8>latin-1:keepbyte+utf-8>cp1252:keepbyte"]


def garble(text: str, mistake: str) -> str | None:
    """``text`` after the decoding mistake; None where it can't be written so, or does not change."""
    out = text
    for step in mistake.split("+"):
        pair, mode = step.split(":")
        w, r = pair.split(">")
        try:
            out = out.encode(w).decode(r, mode)
        except (UnicodeError, LookupError):
            return None
    return None if out == text else out


def restore(text: str, mistake: str) -> str | None:
    """The text from which ``mistake`` makes ``text``; None where there is none."""
    out = text
    for step in reversed(mistake.split("+")):
        w, r = step.split(":")[0].split(">")
        try:
            out = out.encode(r, "keepbyte").decode(w)
        except (UnicodeError, LookupError):
            return None
    return None if out == text else out


def pair_slots(word: str) -> list[int]:
    padded = f" {word} "
    return [zlib.crc32(padded[i : i + 2].encode("utf-8", "replace")) & (PAIR_BUCKETS - 1) for i in range(len(padded) - 1)]


def _pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts = np.zeros(PAIR_BUCKETS, dtype=np.int64)
    for b in batches:
        for word, n in zip(b["word"], b["n"]):
            for s in pair_slots(word):
                counts[s] += n
    at = np.flatnonzero(counts)
    yield pd.DataFrame({"slot": at.astype(np.int64), "n": counts[at]})


@lru_cache(maxsize=1)
def encodings() -> list[str]:
    """Every text encoding of Python that leaves ASCII as it is and shifts by no escape sequences."""
    plain = bytes(range(32, 127))
    out = []
    for name in sorted(set(aliases.values())):
        try:
            if codecs.lookup(name)._is_text_encoding and plain.decode(name) == plain.decode("ascii") and not name.startswith("iso2022") and name not in ("ascii", "punycode", "idna", "mbcs", "oem", "utf_7", "hz"):
                out.append(name)
        except (LookupError, UnicodeError, ValueError):
            continue
    return out


def runs(word: str) -> list[str]:
    """The runs of non-ASCII characters before, between and after the ASCII ones, empty where there are none."""
    return re.split(r"[\x00-\x7F]", word)


def aligned(word: str, twin: str) -> list[tuple[str, str]]:
    """Different runs of two words with the same ASCII characters, one beside the other; runs on one side alone left out.

    Neighbouring characters that each became equally many are parted, so that a pair is as short as it can be.
    """
    out = []
    for g, c in zip(runs(word), runs(twin)):
        if g == c or not g or not c:
            continue
        k, odd = divmod(len(g), len(c))
        out += [(g, c)] if odd or not k else [(g[i * k : i * k + k], c[i]) for i in range(len(c))]
    return [(g, c) for g, c in dict.fromkeys(out) if g != c]


def _aligned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = [(word, g, c, len(found)) for word, twin in zip(b["word"], b["twin"]) for found in [aligned(word, twin)] for g, c in found]
        yield pd.DataFrame(out, columns=["word", "run", "meant", "runs"])


def explanations(run: str, meant: str) -> set[str]:
    """Mistakes that make ``run`` of ``meant``: the usual ones, and between any two encodings."""
    out = {m for m in mistakes() if garble(meant, m) == run}
    read: dict[bytes, list[str]] = {}
    for r in encodings():
        try:
            read.setdefault(run.encode(r, "keepbyte"), []).append(r)
        except UnicodeError:
            continue
    for w in encodings():
        try:
            out.update(f"{w}>{r}:keepbyte" for r in read.get(meant.encode(w), ()) if r != w)
        except UnicodeError:
            continue
    return out


def _explained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    _register()
    usual = set(mistakes())
    for b in batches:
        out = [(g, c, m, m in usual) for g, c in zip(b["run"], b["meant"]) for m in explanations(g, c)]
        yield pd.DataFrame(out, columns=["run", "meant", "mistake", "usual"])


def _bare(text: str) -> str:
    folded = unicodedata.normalize("NFKD", text.casefold())
    return "".join(c for c in folded if unicodedata.category(c) not in ("Cf", "Mn", "Zs"))


def _substituting(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs of runs that are no other case, accent or spacing of the same letters, nor lost characters."""
    for b in batches:
        keep = [not re.search("[\ufffd\x80-\x9f]", g) and _bare(g) != _bare(c) for g, c in zip(b["run"], b["meant"])]
        yield b[keep]


def learned_from(twins: DataFrame, words: DataFrame) -> tuple[list[str], dict[str, str]]:
    """Decoding mistakes and substitutions of runs learned from the aligned ``word, twin``.

    A mistake counts the words all of whose runs it explains. One between unusual encodings must explain ``MIN_SUPPORT``
    words that no usual one explains; of several that explain the same runs the first by name is kept. A pair of runs
    that nothing explains becomes a substitution if it recurs and most words with the run have it. The driver gets
    names of pairs of encodings and substitutions, whose number is that of the alphabet, not of the data.
    """
    pieces = written(twins.mapInPandas(_aligned, "word string, run string, meant string, runs int"), "aligned")
    distinct = pieces.groupBy("run", "meant").agg(F.count_distinct("word").alias("k"))
    known = written(distinct.mapInPandas(_explained, "run string, meant string, mistake string, usual boolean"), "explained")
    whole = pieces.join(known, ["run", "meant"]).groupBy("word", "mistake", "usual").agg(F.count("*").alias("n"), F.first("runs").alias("runs"), F.sum(F.xxhash64("run", "meant").cast("decimal(20,0)")).alias("what")).where("n = runs")
    plain = whole.where("usual").select("word").distinct().withColumn("plain", F.lit(True))
    votes = whole.join(plain, "word", "left").where("usual or plain is null").groupBy("mistake", "usual").agg(F.count("*").alias("k"), F.sum("what").alias("what")).where(f"k >= {MIN_SUPPORT}")
    chosen: dict[tuple, str] = {}
    names = []
    for r in votes.orderBy("mistake").collect():
        if r.usual:
            names.append(r.mistake)
        else:
            chosen.setdefault((r.k, r.what), r.mistake)
    odd = distinct.join(known.select("run", "meant").distinct(), ["run", "meant"], "left_anti").where(f"k >= {MIN_SUPPORT}")
    odd = odd.mapInPandas(_substituting, odd.schema)
    having = words.select("word", F.explode(F.array_distinct(F.regexp_extract_all("word", F.lit(r"[^\x00-\x7F]+"), 0))).alias("run")).groupBy("run").agg(F.count("*").alias("all"))
    table = odd.join(having, "run").where(f"k >= {MIN_SHARE} * all").groupBy("run").agg(F.max(F.struct("k", "meant"))["meant"].alias("meant"))
    return sorted({*names, *chosen.values()}), {r.run: r.meant for r in table.collect()}


def _forward(learned: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _register()
        for b in batches:
            out = [(g, word, n, m) for word, n in zip(b["word"], b["n"]) for m in learned if (g := garble(word, m)) is not None and g]
            yield pd.DataFrame(out, columns=["word", "clean", "n_clean", "mistake"])

    return run


def substituted(word: str, table: dict[str, str]) -> str | None:
    """The word with its learned runs replaced; None where it has none."""
    out = re.sub(r"[^\x00-\x7F]+", lambda m: table.get(m.group(), m.group()), word)
    return None if out == word else out


def _replaced(table: dict[str, str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(word, clean, "substitution") for word in b["word"] if (clean := substituted(word, table))]
            yield pd.DataFrame(out, columns=["word", "clean", "mistake"])

    return run


def _backward(learned: list[str], model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _register()
        logs = model.value

        def score(word: str) -> float:
            return float(np.mean(logs[pair_slots(word)]))

        for b in batches:
            out = []
            for word in b["word"]:
                here, best = score(word), None
                for m in learned:
                    clean = restore(word, m)
                    if clean and clean.isprintable() and any(c.isalpha() for c in clean):
                        gain = score(clean) - here
                        if gain >= MIN_GAIN and (best is None or gain > best[0]):
                            best = (gain, clean, m)
                if best:
                    out.append((word, best[1], best[2]))
            yield pd.DataFrame(out, columns=["word", "clean", "mistake"])

    return run


def values_of(df: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """``field_name, record_id, value`` of the columns; nulls and pure ASCII, which no such mistake changes, left out."""
    pairs = F.inline(F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).cast("string").alias("value")) for c in columns]))
    return df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("record_id"), pairs).where(r"value rlike '[^\\x00-\\x7F]'").select("field_name", "record_id", "value")


def _words(values: DataFrame) -> DataFrame:
    """``value, word`` for each non-ASCII word of the distinct values."""
    return values.select("value", F.explode(F.array_distinct(F.split("value", f"{SEPARATOR}+"))).alias("word")).where(r"word rlike '[^\\x00-\\x7F]'")


def garbled_words(words: DataFrame) -> DataFrame:
    """``word, clean, mistake, evidence, strong`` of the garbled ones among ``word, n``.

    ``evidence`` is ``twin`` where the clean word occurs, ``mapping`` where a learned transformation gives a likelier
    word that does not, ``lost`` where replacement or control characters show that text is gone. ``clean`` is null where
    it cannot be restored. ``strong`` tells words that need no context. Ties between clean words go to the most
    frequent, then the least in code-point order.
    """
    from linkspark.llm.lookalikes import TO_LATIN

    spark = words.sparkSession
    # a Latin word with nothing foreign but look-alike letters was not decoded wrongly; see ``lookalikes``
    letters = "".join(f"\\x{{{ord(c):X}}}" for c in TO_LATIN)
    words = words.where(f"not (word rlike '^[\\\\x00-\\\\x7F{letters}]+$' and word rlike '[A-Za-z]')".replace("\\x{", "\\\\x{"))
    lost = r"[\\x{FFFD}\\x{80}-\\x{9F}]"
    ascii_text = F.regexp_replace("word", r"[^\x00-\x7F]+", "")
    shaped = words.withColumn("stripped", ascii_text)
    anchored = shaped.where(F.length(F.regexp_replace("stripped", "[^A-Za-z]", "")) >= 2)
    best = anchored.where(f"not word rlike '{lost}'").groupBy("stripped").agg(F.max(F.struct(F.col("n"), F.col("word").alias("w"))).alias("top"))
    twins = anchored.join(best, "stripped").where("word <> top.w and n * 2 <= top.n").select("word", F.col("top.w").alias("twin"))
    twins = written(twins, "twins")
    mistaken, table = learned_from(twins, words)
    # words of which stripping leaves nothing to join on: their mistakes are inferred from words equal after garbling
    bare = shaped.where("stripped rlike '^[^A-Za-z]*$' and length(word) >= 4")
    one_byte = [m for m in mistakes() if m.endswith(":keepbyte") and "+" not in m]
    same = bare.mapInPandas(_forward(one_byte), "word string, clean string, n_clean long, mistake string").join(words, "word").where(f"n_clean >= n * {MIN_RATIO}")
    learned = sorted({*mistaken, *(r.mistake for r in same.groupBy("mistake").agg(F.countDistinct("word").alias("k")).where(f"k >= {MIN_SUPPORT}").collect())})

    found = words.where(f"not word rlike '{lost}'").mapInPandas(_forward(learned), "word string, clean string, n_clean long, mistake string") if learned else None
    pairs = words.mapInPandas(_pairs, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    counts = np.zeros(PAIR_BUCKETS)
    for r in pairs.toLocalIterator():
        counts[r.slot] = r.n
    model = spark.sparkContext.broadcast(np.log((counts + 0.5) / (counts.sum() + 0.5 * PAIR_BUCKETS)).astype(np.float32))

    by_twin = (
        words.join(found, "word").where(f"n_clean >= n * {MIN_RATIO}")
        .groupBy("word").agg(F.max(F.struct("n_clean", "clean", "mistake")).alias("m"))
        .select("word", "m.clean", "m.mistake", F.lit("twin").alias("evidence"), (F.length("word") >= STRONG_LENGTH).alias("strong"))
    ) if found is not None else spark.createDataFrame([], "word string, clean string, mistake string, evidence string, strong boolean")
    if table:
        clear = words.where(f"not word rlike '{lost}'").mapInPandas(_replaced(table), "word string, clean string, mistake string").join(by_twin.select("word"), "word", "left_anti")
        by_twin = by_twin.unionByName(clear.select("*", F.lit("mapping").alias("evidence"), F.lit(True).alias("strong")))
    by_twin = written(by_twin, "garbled")
    rest = words.join(by_twin.select("word"), "word", "left_anti")
    # a word that is more frequent in other letter case is that word
    cased = words.groupBy(F.lower("word").alias("low")).agg(F.max("n").alias("top"))
    odd_cased = rest.withColumn("low", F.lower("word")).join(cased, "low").where(f"top < n * {MIN_RATIO}").select("word", "n")
    by_model = odd_cased.mapInPandas(_backward(learned, model), "word string, clean string, mistake string").select("*", F.lit("mapping").alias("evidence"), (F.length("word") >= STRONG_LENGTH).alias("strong"))
    unsure = rest.where(f"word rlike '{lost}'").withColumn("stripped", ascii_text)
    by_loss = unsure.join(best, "stripped", "left").select("word", F.col("top.w").alias("clean"), F.lit("lost").alias("mistake"), F.lit("lost").alias("evidence"), F.lit(True).alias("strong"))
    both = by_model.unionByName(by_loss).groupBy("word").agg(F.min(F.struct((F.col("evidence") == "lost").alias("last"), "clean", "mistake", "evidence", "strong")).alias("m")).select("word", "m.clean", "m.mistake", "m.evidence", "m.strong")
    return by_twin.unionByName(both)


def garbled_values(values: DataFrame) -> DataFrame:
    """``value, restored, evidence`` of the garbled ones among the distinct ``value, n``; ``restored`` null where not possible.

    ``evidence`` is the best of its words': ``twin``, then ``mapping``, then ``lost`` (see ``garbled_words``).
    Very long values count like others; empty tables give none. A value whose only evidence are short words counts if
    its restored text occurs as a value more often.
    """
    cells = _words(values.select("value"))
    words = written(cells.join(values, "value").groupBy("word").agg(F.sum("n").alias("n")), "words")
    bad = written(garbled_words(words), "badwords")
    hit = cells.join(bad.select("word"), "word", "left_semi").select("value").distinct()
    parts = values.join(hit, "value", "left_semi").select("value", "n", F.posexplode(F.split("value", f"(?<={SEPARATOR})|(?={SEPARATOR})")).alias("at", "word"))
    mapped = parts.join(bad, "word", "left")
    whole = mapped.groupBy("value", "n").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("clean", "word").alias("w")))), lambda x: x["w"]), "").alias("restored"),
        F.max(F.coalesce("strong", F.lit(False))).alias("strong"),
        F.max(F.col("mistake").isNotNull() & F.col("clean").isNull()).alias("beyond"),
        F.max("evidence").alias("evidence"),  # by name: twin, mapping, lost
    )
    known = values.select(F.col("value").alias("restored"), F.col("n").alias("m"))
    sure = whole.join(known, "restored", "left").where("strong or m > n")
    return sure.select("value", F.when(~F.col("beyond"), F.col("restored")).alias("restored"), "evidence")


def find_garbled(tables: list[tuple[DataFrame, str, list[str]]]) -> DataFrame:
    """``field_name, record_id, value, restored, evidence`` of every garbled value in the columns of the tables ``(df, id, columns)``.

    Nulls, empty strings and pure ASCII never count. Record ids that occur twice with one content give one row.
    """
    rows = None
    for df, id_col, columns in tables:
        part = values_of(df, id_col, columns)
        rows = part if rows is None else rows.unionByName(part)
    values = written(rows.groupBy("value").agg(F.count("*").alias("n")), "values")
    bad = garbled_values(values)
    return rows.join(bad, "value").select("field_name", "record_id", "value", "restored", "evidence").distinct()
