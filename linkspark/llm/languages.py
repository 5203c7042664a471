"""Languages of mixed documents: mixture inference over character n-gram likelihoods.

Each written paragraph of a document is drawn from one of a few languages. Expectation-maximisation estimates the
shares of a set of languages; the set itself grows while the penalised likelihood does.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkspark.llm import mail
from linkspark.runtime import spread, written

LANGUAGES = ["en", "de", "fr", "es", "it", "pt", "nl", "pl", "ru"]
#: Labelled documents, at most about, from which the n-gram models are fitted (a sample by hash of the id).
SAMPLE_DOCS = 4000
#: Hashed n-grams of a model; fixed, so that all models together are a broadcast of a few MB.
BUCKETS = 1 << 17
#: Characters whose n-grams are looked up at once.
CHUNK_CHARS = 400_000
#: Log-likelihood that a further language must gain.
PENALTY = 8.0
#: Neighbouring n-grams overlap; their summed log-likelihoods are divided by this.
TEMPER = 2.0
EM_STEPS = 12
#: Different addresses with which a paragraph's text stands in the archive, from which it is a disclaimer.
DISCLAIMER_ADDRESSES = 3

_NOT_LETTERS = re.compile(r"[\W\d_]+")


def ngram_slots(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all 2- and 3-grams of the texts, one text after the other, and where each text begins."""
    cleaned = [" " + _NOT_LETTERS.sub(" ", t.lower()).strip() + "  " for t in texts]
    codes = np.frombuffer("".join(cleaned).encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)
    lengths = np.array([len(c) for c in cleaned], dtype=np.int64)
    with np.errstate(over="ignore"):
        two = codes[:-2] * np.uint64(1_000_003) + codes[1:-1]
        three = two * np.uint64(1_000_003) + codes[2:]
        slots = np.empty(2 * len(two), dtype=np.int64)
        slots[0::2] = (two * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(47)).astype(np.int64)
        slots[1::2] = (three * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(47)).astype(np.int64)
    return slots, 2 * np.concatenate([[0], np.cumsum(lengths)[:-1]])


def likelihoods(texts: list[str], model: np.ndarray) -> np.ndarray:
    """Log-likelihood of each text under each language; ``model`` is slots x languages."""
    out = np.zeros((len(texts), model.shape[1]))
    begin = 0
    while begin < len(texts):
        stop, size = begin, 0
        while stop < len(texts) and (stop == begin or size + len(texts[stop]) <= CHUNK_CHARS):
            size += len(texts[stop])
            stop += 1
        slots, starts = ngram_slots(texts[begin:stop])
        for at in range(0, len(slots), 4 * CHUNK_CHARS):  # a single text may be longer than a chunk
            piece = model[slots[at : at + 4 * CHUNK_CHARS]]
            first = np.searchsorted(starts, at, side="right") - 1
            inside = starts[(starts > at) & (starts < at + len(piece))] - at
            sums = np.add.reduceat(piece, np.concatenate([[0], inside]).astype(np.int64), axis=0)
            out[begin + first : begin + first + len(sums)] += sums
        begin = stop
    return out / TEMPER


def _log_sum(a: np.ndarray) -> np.ndarray:
    top = a.max(axis=1, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=1, keepdims=True)))[:, 0]


def fit_shares(ll: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """EM over paragraphs x languages: shares, posteriors and log-likelihood."""
    share = np.full(ll.shape[1], 1.0 / ll.shape[1])
    for _ in range(EM_STEPS):
        joint = ll + np.log(share)
        total = _log_sum(joint)
        posterior = np.exp(joint - total[:, None])
        new = np.maximum(posterior.mean(axis=0), 1e-9)
        done = np.abs(new - share).max() < 1e-6
        share = new
        if done:
            break
    return share, posterior, float(total.sum())


def language_set(ll: np.ndarray, penalty: float = PENALTY) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(languages, shares, posteriors) of a document by penalised likelihood, grown one language at a time."""
    chosen = [int(ll.sum(axis=0).argmax())]
    share, posterior, best = fit_shares(ll[:, chosen])
    open_ = set(ll.argmax(axis=1).tolist()) - set(chosen)
    while open_:
        tried = [(fit_shares(ll[:, chosen + [k]]), k) for k in sorted(open_)]
        (s, p, value), k = max(tried, key=lambda x: x[0][2])
        if value - best < penalty:
            break
        chosen, share, posterior, best = chosen + [k], s, p, value
        open_.discard(k)
    return chosen, share, posterior


PARSED = "row long, doc_id long, lang string, paragraphs array<string>, held array<struct<text:string,template:string,address:string>>, whole string"


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        both = [mail.paragraphs(t) for t in b["text"]]
        b["paragraphs"] = [p for p, _ in both]
        b["held"] = [[h._asdict() for h in held] for _, held in both]
        b["whole"] = [None if p else mail.whole_text(t) for (p, _), t in zip(both, b["text"])]
        yield b[["row", "doc_id", "lang", "paragraphs", "held", "whole"]]


def written_text(documents: DataFrame) -> DataFrame:
    """``doc_id, lang, paragraphs, whole`` of ``doc_id, lang, text``: what people wrote, without disclaimers.

    A paragraph with an address is a disclaimer if its other words stand in the archive with at least
    ``DISCLAIMER_ADDRESSES`` different addresses, and else counts like all. ``whole`` is all visible text where nothing
    else is there. Messages are parsed once, into a table of the shared folder.
    """
    numbered = spread(documents).withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "lang", "text")
    parsed = written(numbered.mapInPandas(_parsed, PARSED), "paragraphs")
    held = parsed.where("size(held) > 0")
    each = held.select("row", F.inline("held"))
    disclaimers = each.select("template", "address").distinct().groupBy("template").agg(F.count("*").alias("n")).where(f"n >= {DISCLAIMER_ADDRESSES}").select("template")
    own = each.join(written(disclaimers, "disclaimers"), "template", "left_anti").groupBy("row").agg(F.collect_list("text").alias("more"))
    joined = held.join(own, "row", "left").select("doc_id", "lang", F.concat("paragraphs", F.coalesce("more", F.array().cast("array<string>"))).alias("paragraphs"), "whole")
    return parsed.where("size(held) = 0").select("doc_id", "lang", "paragraphs", "whole").unionByName(joined)


def _counts(model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros((len(LANGUAGES), BUCKETS), dtype=np.int64)
        for b in batches:
            label = np.array([LANGUAGES.index(x) for x in b["lang"]], dtype=np.int64)
            texts = list(b["paragraph"])
            keep = np.ones(len(texts), dtype=bool) if model is None else likelihoods(texts, model.value).argmax(axis=1) == label
            for k in np.unique(label[keep]):
                slots, _ = ngram_slots([t for t, l, ok in zip(texts, label, keep) if ok and l == k])
                counts[k] += np.bincount(slots, minlength=BUCKETS)
        lang, slot = np.nonzero(counts)
        yield pd.DataFrame({"lang": lang.astype(np.int32), "slot": slot.astype(np.int32), "n": counts[lang, slot]})

    return run


def fit_models(documents: DataFrame) -> np.ndarray:
    """Log-probabilities (slots x languages) of hashed n-grams, fitted on a bounded sample of labelled ``written_text``.

    Paragraphs that a first model takes for another language than their label are left out of the second and third.
    A language without labelled documents gets no n-grams and is never found.
    """
    spark = documents.sparkSession
    labelled = documents.where(F.col("lang").isin(LANGUAGES))
    every = max(1, labelled.count() // SAMPLE_DOCS)
    sample = written(labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).select("lang", F.explode("paragraphs").alias("paragraph")), "langsample")
    model = None
    for _ in range(3):
        shared = None if model is None else spark.sparkContext.broadcast(model)
        counts = np.zeros((BUCKETS, len(LANGUAGES)))
        grouped = sample.mapInPandas(_counts(shared), "lang int, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
        for b in grouped.toArrow().to_batches():  # at most slots x languages rows
            counts[b.column("slot").to_numpy(), b.column("lang").to_numpy()] = b.column("n").to_numpy()
        total = counts.sum(axis=0)
        model = np.log((counts + 0.1) / (total + 0.1 * BUCKETS)).astype(np.float32)
        model[:, total == 0] = -100.0
    return model


def _infer(model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = model.value
        for b in batches:
            out = []
            for begin in range(0, len(b), 500):
                block = b.iloc[begin : begin + 500]
                authored = [len(ps) > 0 for ps in block["paragraphs"]]
                per_doc = [list(ps) if len(ps) else [w] if isinstance(w, str) and _NOT_LETTERS.sub("", w) else [] for ps, w in zip(block["paragraphs"], block["whole"])]
                ll = likelihoods([p for ps in per_doc for p in ps], table)
                at = 0
                for doc_id, label, ps, by_people in zip(block["doc_id"], block["lang"], per_doc, authored):
                    if ps:
                        own = ll[at : at + len(ps)]
                        at += len(ps)
                        chosen, share, posterior = language_set(own)
                        pick = posterior.argmax(axis=1)
                        used = sorted(set(pick.tolist()))
                        fits = len(used) == 1 and LANGUAGES[chosen[used[0]]] == label
                        for k in used:
                            out.append((doc_id, label, fits, by_people, -1, LANGUAGES[chosen[k]], float(posterior[pick == k, k].max()), float(share[k])))
                        for i, k in enumerate(pick):
                            out.append((doc_id, label, fits, by_people, i, LANGUAGES[chosen[k]], float(posterior[i, k]), float(share[k])))
            yield pd.DataFrame(out, columns=["doc_id", "label", "label_fits", "written", "segment", "lang", "confidence", "share"])

    return run


def identify(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "lang") -> DataFrame:
    """``doc_id, label, label_fits, written, segment, lang, confidence, share``: the languages of documents and their segments.

    Rows with segment -1 give the languages of the whole document with their shares; the others one language for each
    written paragraph. ``label_fits`` tells whether the document's set of languages is exactly its label. A document
    without a written paragraph is one segment, all its visible text, and has ``written`` false. Documents that are
    null or have no letters give no row; repeated rows give rows each.
    """
    docs = documents.where(F.col(text).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(label).cast("string").alias("lang"))
    texts = written_text(docs)
    model = documents.sparkSession.sparkContext.broadcast(fit_models(texts))
    return texts.mapInPandas(_infer(model), "doc_id long, label string, label_fits boolean, written boolean, segment int, lang string, confidence double, share double")
