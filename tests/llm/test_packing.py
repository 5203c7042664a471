import random

import numpy as np
import pandas as pd
import pytest

from linkspark.llm import packing


@pytest.mark.parametrize("seed", range(6))
def test_fill_is_a_partition_within_capacity(seed):
    rng = np.random.default_rng(seed)
    sizes = np.sort(rng.integers(1, 101, size=int(rng.integers(0, 200))))
    windows = packing.fill(sizes, 100, lambda k: rng.random(len(sizes)))
    assert sorted(i for w in windows for i in w) == list(range(len(sizes))) and all(sizes[w].sum() <= 100 for w in windows)


def frames(spark, docs, specs=((1, 64), (2, 1000))):
    d = spark.createDataFrame([(i, t, "x", 0) for i, t in docs], "doc_id long, text string, shard string, n_tokens int")
    return d, spark.createDataFrame(list(specs), "spec_id long, capacity_tokens long")


def test_packing_of_documents(spark):
    rng = random.Random(4)
    topics = ["stone water ash".split(), "katalog gerät bitte".split(), "liste facture vérifié".split()]
    docs = [(i, " ".join(rng.choice(topics[i % 3]) for _ in range(rng.randint(1, 90)))) for i in range(400)] + [(900, ""), (901, None), (902, "long " * 5000), (5, "repeated row")]
    d, specs = frames(spark, docs, [(1, 64), (2, 1000), (3, None), (4, 0)])
    rows = packing.pack(d, specs).collect()
    encode = packing.tokenizer(packing.VOCABULARY, packing.PATTERN).encode_ordinary
    want = {}
    for i, t in docs:
        if t:
            want[i] = want.get(i, 0) + len(encode(t))
    for spec, capacity in ((1, 64), (2, 1000)):
        mine = [r for r in rows if r.spec_id == spec]
        got, load = {}, {}
        for r in mine:
            got[r.doc_id] = got.get(r.doc_id, 0) + r.n_tokens
            load[r.container_id] = load.get(r.container_id, 0) + r.n_tokens
        assert got == want and max(load.values()) <= capacity
        assert all(r.piece == 0 and r.token_start == 0 for r in mine if r.doc_id != 5 and want[r.doc_id] <= capacity)
        assert sum(load.values()) / (len(load) * capacity) > 0.9
    pieces = sorted((r.token_start, r.n_tokens) for r in rows if r.spec_id == 2 and r.doc_id == 902)
    assert [p[0] for p in pieces] == list(np.cumsum([0, *[p[1] for p in pieces]])[:-1])
    assert {r.spec_id for r in rows} == {1, 2}


def test_neighbours_share_words(spark):
    rng = random.Random(6)
    topics = ["stone water ash river".split(), "katalog bitte liste heft".split()]
    docs = [(i, " ".join(rng.choice(topics[i % 2]) for _ in range(rng.randint(10, 60)))) for i in range(400)]
    rows = packing.pack(*frames(spark, docs, [(1, 1000)])).collect()
    by = {}
    for r in rows:
        by.setdefault(r.container_id, []).append(r.doc_id % 2)
    alike = sum(max(v.count(0), v.count(1)) for v in by.values()) / len(docs)
    assert alike > 0.8


def test_empty(spark):
    assert packing.pack(*frames(spark, [])).count() == 0
    assert packing.fill_report(packing.pack(*frames(spark, [(1, "a b c")])), frames(spark, [])[1]).count() == 2


def test_index_agrees_with_plain_bm25():
    rng = np.random.default_rng(0)
    slots = [np.unique(rng.integers(0, 40, size=12)).astype(np.int32) for _ in range(30)]
    counts = [rng.integers(1, 5, size=len(s)).astype(np.int32) for s in slots]
    idf = rng.random(packing.SLOTS).astype(np.float32)
    index = packing.ShardIndex(slots, counts, idf, 20.0)
    for item in (0, 7):
        plain = np.zeros(30)
        for d in range(30):
            for s, c in zip(slots[d], counts[d]):
                if s in slots[item]:
                    plain[d] += idf[s] * c * (packing.K1 + 1) / (c + packing.K1 * (1 - packing.B + packing.B * counts[d].sum() / 20.0))
        assert np.allclose(index.scores(item, 30), plain, rtol=1e-5)


def test_all_words_of_a_long_seed_count():
    slots = [np.arange(200, dtype=np.int32), *(np.array([k], dtype=np.int32) for k in range(200))]
    counts = [np.ones(len(s), dtype=np.int32) for s in slots]
    index = packing.ShardIndex(slots, counts, np.linspace(1, 2, packing.SLOTS).astype(np.float32), 2.0)
    assert (index.scores(0, 201) > 0).all()


@pytest.mark.parametrize("sizes", [[], [1], [1500], [1501], [1900, 2000], [700] * 9, [10_000]])
def test_shards_cut_without_losing_rows(sizes):
    at, batches = 0, []
    for n in sizes:
        batches.append(pd.DataFrame({"doc_id": range(at, at + n), "slots": [[1, 2]] * n}))
        at += n
    shards = list(packing.shards_of(iter(batches)))
    assert [i for s in shards for i in s["doc_id"]] == list(range(at)) and all(len(s) <= 1.3 * packing.SHARD_DOCS for s in shards)
    assert len(shards) <= at / packing.SHARD_DOCS + 1.5


def test_many_words_make_a_shard_smaller(monkeypatch):
    monkeypatch.setattr(packing, "SHARD_WORDS", 100)
    shards = list(packing.shards_of(iter([pd.DataFrame({"doc_id": range(10), "slots": [list(range(60))] * 10})])))
    assert [len(s) for s in shards] == [1] * 10


def test_documents_of_one_subject_share_a_shard(spark, monkeypatch):
    rng = random.Random(7)
    subjects = [[f"w{s}x{k}" for k in range(30)] for s in range(24)]
    docs = [(i, " ".join(rng.choice(subjects[i % 24]) for _ in range(40))) for i in range(4800)]
    rows = packing.pack(*frames(spark, docs, [(1, 2000)])).collect()
    shard = {r.doc_id: r.container_id >> 40 for r in rows}
    assert len(set(shard.values())) > 1
    together = [max(np.bincount([shard[i] for i in range(s, 4800, 24)])) / 200 for s in range(24)]
    assert np.mean(together) > 0.6  # subjects that a boundary cuts have two shards; by chance it would be 0.3


def test_scores_and_places_are_computed_once(spark):
    slots = [np.array([1, 2], dtype=np.int32), np.array([2], dtype=np.int32)]
    index = packing.ShardIndex(slots, [np.ones(len(s), dtype=np.int32) for s in slots], np.ones(packing.SLOTS, dtype=np.float32), 2.0)
    assert index.scores(0, 2) is index.scores(0, 2)
    plan = packing.pack(*frames(spark, [(1, "a b c"), (2, "a b")]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1  # places are read, where the shuffle would compute them twice
