"""Evaluation texts in training text: a broadcast hash set of test n-grams, scanned windows, verified hits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkspark.llm import mail
from linkspark.runtime import spread

#: Consecutive words that make a passage.
PASSAGE_WORDS = 15
#: Characters of test text that one broadcast holds; more test text is scanned for in several passes.
BROADCAST_CHARS = 50_000_000

_BASE = np.uint64(0x9E3779B97F4A7C15)


def window_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """Hash of every window of ``n`` word numbers."""
    if len(ids) < n:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(len(ids) - n + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out = out * _BASE + ids[i : len(ids) - n + 1 + i].astype(np.uint64)
    return out


class TestSet:
    """Vocabulary, window hashes and places of the test items; what the scan broadcasts."""

    __test__ = False

    def __init__(self, items: list[tuple[int, str]], n: int):
        self.n = n
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple[int, np.ndarray]] = []
        places: list[tuple[np.ndarray, int]] = []
        for item_id, text in items:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in mail.words(text or "")], dtype=np.int64)
            places.append((window_hashes(ids, n), len(self.items)))
            self.items.append((item_id, ids))
        hashes = np.concatenate([h for h, _ in places]) if places else np.zeros(0, dtype=np.uint64)
        owner = np.concatenate([np.full(len(h), k) for h, k in places]) if places else np.zeros(0, dtype=np.int64)
        offset = np.concatenate([np.arange(len(h)) for h, _ in places]) if places else np.zeros(0, dtype=np.int64)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.owner, self.offset = hashes[order], owner[order].astype(np.int64), offset[order].astype(np.int64)

    def passages(self, words: list[str]) -> Iterator[tuple[int, int, int]]:
        """Every verified passage in the words, as item id, first word and number of words; each as long as it goes."""
        get = self.vocabulary.get
        ids = np.array([get(w, 0) for w in words], dtype=np.int64)
        n = self.n
        if len(ids) < n or not len(self.hashes):
            return
        known = np.concatenate([[0], np.cumsum(ids > 0)])
        full = np.flatnonzero(known[n:] - known[:-n] == n)
        if not len(full):
            return
        hashes = window_hashes(ids, n)[full]
        left = np.searchsorted(self.hashes, hashes, side="left")
        hit = np.flatnonzero((left < len(self.hashes)) & (self.hashes[np.minimum(left, len(self.hashes) - 1)] == hashes))
        reached: dict[tuple[int, int], int] = {}  # (item, diagonal) -> word up to which its passage was followed
        for h in hit:
            at = int(full[h])
            k = int(left[h])
            while k < len(self.hashes) and self.hashes[k] == hashes[h]:
                owner, offset = int(self.owner[k]), int(self.offset[k])
                k += 1
                if reached.get((owner, at - offset), -1) >= at + n:
                    continue
                item_id, item = self.items[owner]
                length = min(len(item) - offset, len(ids) - at)
                same = item[offset : offset + length] == ids[at : at + length]
                run = length if same.all() else int(np.argmin(same))
                if run >= n:
                    reached[owner, at - offset] = at + run
                    yield item_id, at, run

    def spans(self, words: list[str]) -> dict[int, tuple[int, int]]:
        """Longest verified passage of each item in the words, as (first word, number of words) by item id."""
        best: dict[int, tuple[int, int]] = {}
        for item_id, at, run in self.passages(words):
            if run > best.get(item_id, (0, 0))[1]:
                best[item_id] = (at, run)
        return best

    def covered(self, words: list[str]) -> list[tuple[int, int]]:
        """Words in any passage of any item, as rising (first word, word after the last) without overlaps."""
        edge = np.zeros(len(words) + 1, dtype=np.int64)
        for _, at, run in self.passages(words):
            edge[at] += 1
            edge[at + run] -= 1
        inside = np.concatenate([[False], np.cumsum(edge)[:-1] > 0, [False]])
        turns = np.flatnonzero(inside[1:] != inside[:-1])
        return [(int(a), int(z)) for a, z in zip(turns[::2], turns[1::2])]


def _scan(test):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tests = test.value
        for b in batches:
            out = []
            for doc_id, text in zip(b["doc_id"], b["text"]):
                if not text:
                    continue
                best: dict[int, tuple[int, int, int]] = {}
                for k, part in enumerate(mail.parts_of(text)):
                    if part.text:
                        for item_id, (at, run_) in tests.spans(mail.words(mail.visible(part))).items():
                            if run_ > best.get(item_id, (0, 0, 0))[2]:
                                best[item_id] = (k, at, run_)
                out += [(doc_id, item_id, k, at, r) for item_id, (k, at, r) in best.items()]
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "part", "word", "n_words"])

    return run


def _test_sets(items: DataFrame, item_id: str, item_text: str, n: int) -> Iterator:
    """Broadcast test sets, each of bounded size."""
    rows = items.where(F.col(item_text).isNotNull()).select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t"))
    total = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    passes = max(1, -(-total // BROADCAST_CHARS))
    for p in range(passes):
        block = rows.where(F.pmod(F.xxhash64("i"), F.lit(passes)) == p) if passes > 1 else rows
        yield items.sparkSession.sparkContext.broadcast(TestSet([(r.i, r.t) for r in block.toLocalIterator()], n))


def find_leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = PASSAGE_WORDS) -> DataFrame:
    """``doc_id, item_id, part, word, n_words``: the longest passage of every item in every document.

    A passage has at least ``n`` consecutive words (runs of letters and digits, case-folded) of an item, in one body
    part or text attachment after decoding and without markup. Null and empty texts leak nothing; an item of fewer
    than ``n`` words cannot leak; of several equal passages the first counts; repeated rows give rows each.
    """
    docs = spread(documents.where(F.col(text).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")))
    found = None
    for test in _test_sets(items, item_id, item_text, n):
        part = docs.mapInPandas(_scan(test), "doc_id long, item_id long, part int, word long, n_words long")
        found = part if found is None else found.unionByName(part)
    return found


def _spots(text: str) -> list[tuple[int, int]]:
    """Places in ``text`` of the words of ``mail.words``, which are those of the folded text."""
    folded = text.casefold()
    spots = [(m.start(), m.end()) for m in mail.WORD.finditer(folded)]
    if len(folded) == len(text):
        return spots
    source = [k for k, c in enumerate(text) for _ in c.casefold()]  # some letters fold to several
    return [(source[a], source[z - 1] + 1) for a, z in spots]


CUTS = "array<struct<part:int,first:long,last:long>>"


def _mark(test):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tests = test.value
        for b in batches:
            out = []
            for text, before in zip(b["text"], b["cuts"]):
                cuts = [(c["part"], c["first"], c["last"]) for c in before]
                for k, part in enumerate(mail.parts_of(text or "")):
                    cuts += [(k, a, z) for a, z in tests.covered(mail.words(mail.visible(part)))]
                out.append([{"part": k, "first": a, "last": z} for k, a, z in cuts])
            yield b.assign(cuts=out)

    return run


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for doc_id, text, cuts in zip(b["doc_id"], b["text"], b["cuts"]):
            of: dict[int, list[tuple[int, int]]] = {}
            for c in cuts:
                of.setdefault(c["part"], []).append((c["first"], c["last"]))
            clean, removed = [], 0
            for k, part in enumerate(mail.parts_of(text or "")):
                shown = mail.visible(part)
                if k in of:
                    spots = _spots(shown)
                    kept, end, after = [], 0, 0  # characters and words up to which the part is done
                    for a, z in sorted(of[k]):
                        a = max(a, after)
                        if a < z:
                            kept.append(shown[end : max(end, spots[a][0])])
                            removed += z - a
                            end, after = spots[z - 1][1], z
                    shown = "".join(kept) + shown[end:]
                if shown:
                    clean.append(shown)
            out.append((doc_id, "\n\n".join(clean), removed))
        yield pd.DataFrame(out, columns=["doc_id", "clean_text", "words_removed"])


def remove_leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = PASSAGE_WORDS) -> DataFrame:
    """``doc_id, clean_text, words_removed``: the readable text of every document without any passage of any item.

    Passages are those of the given text: all are marked, in as many passes as there are broadcasts, before the words
    they cover are cut once. A word in several passages counts once; words outside of passages stay.
    """
    docs = spread(documents.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")))
    marked = docs.withColumn("cuts", F.array().cast(CUTS))
    for test in _test_sets(items, item_id, item_text, n):
        marked = marked.mapInPandas(_mark(test), f"doc_id long, text string, cuts {CUTS}")
    return marked.mapInPandas(_cut, "doc_id long, clean_text string, words_removed long")
