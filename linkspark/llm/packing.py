"""Filling windows of fixed token capacity with documents: lexical retrieval packing.

Documents are measured in tokens of a public tokenizer and indexed by hashed words. They are sorted by content, so that
those with many words in common come to stand in one shard; each shard of bounded size holds an inverted BM25 index.
The largest unused document seeds a window, and its best-scoring unused neighbours that fit fill it. Only a document
larger than the capacity is split.
"""

from __future__ import annotations

import base64
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkspark.llm import mail
from linkspark.runtime import forget, spread, written

#: Vocabulary file (ranks of a byte-level BPE) and its word pattern; both are parameters of ``pack``.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Documents of a shard, and distinct words over its documents; they bound the memory of a packing task at any input size.
SHARD_DOCS, SHARD_WORDS = 1500, 3_000_000
#: Documents, picked by hash of the id, each of which draws the documents that score best against it; bounds a broadcast.
PIVOTS = 64
#: Tasks up to which each packs one shard; beyond, tasks take several shards one after the other.
SHARD_TASKS = 512
#: Slots of hashed words; fixed, so that the document frequencies may be broadcast.
SLOTS = 1 << 18
#: Unused share of a window with which an item may end it.
SLACK = 0.02
K1, B = 1.2, 0.75


@lru_cache(maxsize=4)
def tokenizer(vocabulary: str, pattern: str):
    """The tokenizer of a file of base64 tokens and ranks; one a Python worker."""
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _measure(vocabulary: str, pattern: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = tokenizer(vocabulary, pattern).encode_ordinary
        slot_of: dict[str, int] = {}
        for b in batches:
            out = []
            for doc_id, text in zip(b["doc_id"], b["text"]):
                words: Counter[str] = Counter()
                for part in mail.parts_of(text):
                    if part.text:
                        words.update(mail.words(mail.visible(part)))
                if len(slot_of) > 500_000:
                    slot_of.clear()
                slots = np.empty(len(words), dtype=np.int64)
                for k, w in enumerate(words):
                    slot = slot_of.get(w)
                    if slot is None:
                        slot = slot_of[w] = zlib.crc32(w.encode("utf-8", "replace")) & (SLOTS - 1)
                    slots[k] = slot
                own, place = np.unique(slots, return_inverse=True)
                counts = np.bincount(place, weights=np.fromiter(words.values(), np.float64, len(words)), minlength=len(own))
                out.append((doc_id, len(encode(text)), own.astype(np.int32), counts.astype(np.int32)))
            yield pd.DataFrame(out, columns=["doc_id", "n_tokens", "slots", "counts"])

    return run


def _slot_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts = np.zeros(SLOTS, dtype=np.int64)
    docs = length = 0
    for b in batches:
        for slots, n in zip(b["slots"], b["counts"]):
            counts[slots] += 1
            docs += 1
            length += int(np.sum(n))
    at = np.flatnonzero(counts)
    yield pd.DataFrame({"slot": np.append(at, [-1, -2]).astype(np.int64), "n": np.append(counts[at], [docs, length])})


def bm25(tf: np.ndarray, idf: np.ndarray, length: float | np.ndarray, mean_length: float) -> np.ndarray:
    """Weights of words in a document."""
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / max(mean_length, 1.0)))


def _mixed(slots: np.ndarray, salt: int) -> np.ndarray:
    """A number between 0 and 1 for each slot, as if at random."""
    with np.errstate(over="ignore"):
        x = (slots.astype(np.uint64) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return ((x ^ (x >> np.uint64(32))).astype(np.float64) + 1.0) / 2.0**64


class Places:
    """Where a document stands in the order by content: the pivot that scores it best, then two of its words.

    The words are drawn by weighted min-hash: two documents draw the same one as often as they have words in common,
    rare words counting more. So replies, copies and documents of one subject come to stand together.
    """

    def __init__(self, pivots: list[tuple[np.ndarray, np.ndarray]], df: np.ndarray, idf: np.ndarray, mean_length: float):
        with np.errstate(divide="ignore"):
            every = np.arange(SLOTS)
            # a word of one document alone brings it together with none
            self.draws = [np.where(df >= 2, -np.log(_mixed(every, salt)) / idf, np.inf).astype(np.float32) for salt in (1, 2)]
        words = np.unique(np.concatenate([s for s, _ in pivots])) if pivots else np.zeros(0, dtype=np.int64)
        self.row = np.full(SLOTS, len(words), dtype=np.int32)
        self.row[words] = np.arange(len(words))
        self.weight = np.zeros((len(words) + 1, max(len(pivots), 1)), dtype=np.float32)
        for k, (slots, counts) in enumerate(pivots):
            w = bm25(counts.astype(np.float64), idf[slots], counts.sum(), mean_length)
            self.weight[self.row[slots], k] = w / max(float(np.sum(w * w)) ** 0.25, 1e-9)

    def of(self, slots: np.ndarray) -> tuple[int, int, int]:
        if not len(slots):
            return -1, -1, -1
        known = self.row[slots]
        pivot = int(self.weight[known[known < len(self.weight) - 1]].sum(axis=0).argmax())
        return pivot, *(int(slots[np.argmin(draw[slots])]) for draw in self.draws)


def _placed(places):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = places.value.of
        for b in batches:
            b[["pivot", "first", "second"]] = np.array([of(np.asarray(s)) for s in b["slots"]], dtype=np.int32).reshape(len(b), 3)
            yield b

    return run


class ShardIndex:
    """Inverted BM25 index of one shard; items stand in rising order of size."""

    def __init__(self, slots: list[np.ndarray], counts: list[np.ndarray], idf: np.ndarray, mean_length: float):
        owner = np.repeat(np.arange(len(slots)), [len(s) for s in slots])
        slot = np.concatenate(slots).astype(np.int64) if slots else np.zeros(0, dtype=np.int64)
        tf = np.concatenate(counts).astype(np.float64) if counts else np.zeros(0)
        length = np.array([c.sum() for c in counts], dtype=np.float64)
        weight = bm25(tf, idf[slot], length[owner], mean_length) if len(tf) else tf
        order = np.argsort(slot, kind="stable")
        self.words, self.first = np.unique(slot[order], return_index=True)
        self.last = np.append(self.first[1:], len(slot))
        self.owner, self.weight = owner[order].astype(np.intp), weight[order]  # as bincount takes it, without a copy
        self.queries = [np.searchsorted(self.words, s) for s in slots]
        self.scored: dict[int, np.ndarray] = {}

    def scores(self, item: int, n: int) -> np.ndarray:
        """Ratings of all ``n`` items by the words of one; kept, since a seed of one capacity mostly is one of others."""
        if item not in self.scored:
            self.scored[item] = self._rated(item, n)
        return self.scored[item]

    def _rated(self, item: int, n: int) -> np.ndarray:
        q = self.queries[item]
        if not len(q):
            return np.zeros(n)
        lengths = self.last[q] - self.first[q]
        starts = np.repeat(self.first[q] - np.append(0, np.cumsum(lengths)[:-1]), lengths)
        at = np.arange(lengths.sum()) + starts
        return np.bincount(self.owner[at], weights=self.weight[at], minlength=n)


def fill(sizes: np.ndarray, capacity: int, scores) -> list[list[int]]:
    """Windows as lists of items; ``sizes`` rise, none is beyond the capacity; ``scores(item)`` rates all items.

    The largest unused item seeds a window. While no unused item would end it within the slack, the best-scoring one
    that fits is added; then the best-scoring of those that end it. Ties go to the larger, then the later item.
    """
    n = len(sizes)
    unused = np.ones(n, dtype=bool)
    slack = int(capacity * SLACK)
    windows = []
    top = n - 1
    while True:
        while top >= 0 and not unused[top]:
            top -= 1
        if top < 0:
            return windows
        seed, unused[top] = top, False
        window, room, rated = [seed], capacity - int(sizes[seed]), None
        while room > 0:
            end = int(np.searchsorted(sizes, room, side="right"))
            free = np.flatnonzero(unused[:end])
            if not len(free):
                break
            if rated is None:
                rated = scores(seed)
            low = int(np.searchsorted(sizes, room - slack, side="left"))
            ending = free[free >= low]
            choice = ending if len(ending) else free
            if not len(ending) and sizes[free[-1]] * 2 > room:
                # only one more fits beside the largest: then one of the larger half of those, so that little space is left
                big = free[sizes[free] * 2 > room]
                choice = big[len(big) // 2 :]
            values = rated[choice]
            pick = int(choice[len(choice) - 1 - int(np.argmax(values[::-1]))])
            unused[pick] = False
            window.append(pick)
            room -= int(sizes[pick])
        windows.append(window)


def _pack_shard(pdf: pd.DataFrame, specs: list[tuple[int, int]], idf: np.ndarray, mean_length: float, window: int) -> list[tuple]:
    """Rows of the windows of one shard; the windows are numbered from ``window``."""
    pdf = pdf.sort_values(["n_tokens", "doc_id"], kind="stable")
    doc, total = pdf["doc_id"].to_numpy(), pdf["n_tokens"].to_numpy()
    index = ShardIndex(list(pdf["slots"]), list(pdf["counts"]), idf, mean_length)
    out = []
    for spec_id, capacity in specs:
        rest = np.where(total > capacity, total % capacity, total)
        pieces = np.where(total > capacity, total // capacity, 0)
        for i in np.flatnonzero(pieces):
            for k in range(int(pieces[i])):
                out.append((spec_id, window, int(doc[i]), k, k * capacity, capacity))
                window += 1
        item = np.flatnonzero(rest > 0)
        item = item[np.argsort(rest[item], kind="stable")]
        for members in fill(rest[item], capacity, lambda k: index.scores(int(item[k]), len(doc))[item]):
            for m in members:
                i = item[m]
                out.append((spec_id, window, int(doc[i]), int(pieces[i]), int(pieces[i]) * capacity, int(rest[i])))
            window += 1
    return out


def shards_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows in order, cut into shards; what is left at the end of a task joins the last shard or is halved with it."""
    waiting: list[pd.DataFrame] = []

    def full(pdf: pd.DataFrame) -> int:
        words = np.cumsum(pdf["slots"].map(len).to_numpy())
        return max(1, min(SHARD_DOCS, int(np.searchsorted(words, SHARD_WORDS, side="right"))))

    for b in batches:
        for begin in range(0, len(b), SHARD_DOCS):
            waiting.append(b.iloc[begin : begin + SHARD_DOCS])
            pdf = pd.concat(waiting)
            while (cut := full(pdf)) * 2 <= len(pdf):
                yield pdf.iloc[:cut]
                pdf = pdf.iloc[cut:]
            waiting = [pdf]
    pdf = pd.concat(waiting) if waiting else pd.DataFrame()
    while len(pdf):
        cut = full(pdf)
        if len(pdf) <= 1.3 * cut:
            cut = len(pdf)
        elif len(pdf) < 2 * cut:
            cut = -(-len(pdf) // 2)
        yield pdf.iloc[:cut]
        pdf = pdf.iloc[cut:]


def _packed(specs: list[tuple[int, int]], shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        idf, mean_length = shared.value
        window = TaskContext.get().partitionId() << 40
        for shard in shards_of(batches):
            out = _pack_shard(shard, specs, idf, mean_length, window)
            window = max((r[1] for r in out), default=window - 1) + 1
            yield pd.DataFrame(out, columns=["spec_id", "container_id", "doc_id", "piece", "token_start", "n_tokens"])

    return run


def pack(documents: DataFrame, specs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``spec_id, container_id, doc_id, piece, token_start, n_tokens``: every document in windows of every capacity.

    A document larger than the capacity gives full windows and a rest, which is packed like others; others have piece 0
    alone. Null and empty texts have no tokens and stand in no window. Repeated rows are packed each. Specs without a
    positive capacity give nothing. Document frequencies are counted over all documents. The order by content ends with
    the id, so that no source, subject or group of copies can make a shard large.
    """
    spark = documents.sparkSession
    docs = spread(documents.where(F.col(text).isNotNull() & (F.col(text) != "") & F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")))
    items = written(docs.mapInPandas(_measure(vocabulary, pattern), "doc_id long, n_tokens long, slots array<int>, counts array<int>"), "items")
    table = items.select("slots", "counts").mapInPandas(_slot_counts, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    slot, n = table.column("slot").to_numpy(), table.column("n").to_numpy()  # at most SLOTS + 2 rows
    df = np.zeros(SLOTS)
    df[slot[slot >= 0]] = n[slot >= 0]
    total = int(n[slot == -1].sum())
    idf = np.log(1 + (total - df + 0.5) / (df + 0.5)).astype(np.float32)
    shared = spark.sparkContext.broadcast((idf, float(n[slot == -2].sum()) / max(total, 1)))
    wanted = [(int(r.spec_id), int(r.capacity_tokens)) for r in specs.where("spec_id is not null and capacity_tokens > 0").select("spec_id", "capacity_tokens").distinct().orderBy("spec_id", "capacity_tokens").toLocalIterator()]
    picked = items.orderBy(F.xxhash64("doc_id"), "doc_id").select("slots", "counts").limit(PIVOTS).collect()
    pivots = [(np.array(r.slots, dtype=np.int64), np.array(r.counts, dtype=np.int64)) for r in picked if r.slots]
    places = spark.sparkContext.broadcast(Places(pivots, df, idf, float(n[slot == -2].sum()) / max(total, 1)))
    shards = max(1, -(-total // SHARD_DOCS))
    # written, because the ranges of the shuffle are found by reading it once more
    placed = written(items.mapInPandas(_placed(places), "doc_id long, n_tokens long, slots array<int>, counts array<int>, pivot int, first int, second int"), "placed")
    forget(items)
    order = ["pivot", "first", "second", "doc_id"]
    sharded = placed.repartitionByRange(min(shards, max(SHARD_TASKS, shards // 16)), *order).sortWithinPartitions(*order)
    return sharded.mapInPandas(_packed(wanted, shared), "spec_id long, container_id long, doc_id long, piece int, token_start long, n_tokens long")


def fill_report(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """``spec_id, capacity_tokens, containers, documents, used_share`` of a packing."""
    sums = packed.groupBy("spec_id").agg(F.countDistinct("container_id").alias("containers"), F.countDistinct("doc_id").alias("documents"), F.sum("n_tokens").alias("tokens"))
    return sums.join(specs.select("spec_id", "capacity_tokens"), "spec_id").select("spec_id", "capacity_tokens", "containers", "documents", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6).alias("used_share"))
