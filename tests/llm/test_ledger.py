import datetime
import random
import unicodedata

from linkspark.llm import ledger

T = datetime.datetime(2024, 1, 1)


def rows(spark, items):
    data = [(i, t, a, T + datetime.timedelta(days=i) if i is not None else None, "k", 1) for i, t, a in items]
    df = spark.createDataFrame(data, "release_id long, release_title string, release_artist string, ingested_at timestamp, key string, copies int")
    return ledger.keyed(df, "release_id", ["release_title", "release_artist"], "ingested_at")


def found(spark, items, **kw):
    r = rows(spark, items)
    return sorted(map(tuple, ledger.duplicate_pairs(r, ledger.ledger_of(r, **kw)).collect()))


def test_formatting_only(spark):
    items = [
        (1, "Dawn and Lanterns", "Yolanda Brumvaro"), (2, "  dAWN AND lANTERNS...", "Brumvaro, Yolanda"), (3, "YOLANDA BRUMVARO", "*Dawn and Lanterns*"), (4, "Dawn.and_Lanterns", "Yolanda​ Brumvaro"),
        (5, "DawnandLanterns", "Yolanda Brumvaro -"), (6, "Dawn and Lantern", "Yolanda Brumvaro"), (7, "Dawn and Lanterns 2", "Yolanda Brumvaro"), (8, "Dawn and Lanterns", "Yolanda Bramvuro"),
        (9, "Die Straße, The", "X"), (10, "THE DIE STRASSE", "x"), (11, None, "x"), (12, "", "x"), (13, None, "x"), (14, "", "x"), (15, "!!", "x"), (16, "!!", "x"),
        (17, "Été", "Y"), (18, unicodedata.normalize("NFD", "Été"), "Y"), (19, "Op, 4", "Z"), (20, "Op - 4", "Z"),
    ]
    same = [{1, 2, 3, 4, 5}, {9, 10}, {17, 18}, {19, 20}]
    assert found(spark, items) == sorted((a, b) for s in same for a in s for b in s if a < b)


def test_ties_repeated_long_and_empty(spark):
    assert found(spark, []) == []
    long = "word " * 20_000
    assert found(spark, [(1, long, "a"), (2, long.upper(), "A"), (2, long, "a")]) == [(1, 2), (1, 2)]
    assert found(spark, [(None, "a", "b"), (1, "a", "b")]) == []


def test_batches_and_buckets_agree_with_brute_force(spark):
    rng = random.Random(5)
    items = [(i, rng.choice(["A b", "a.B", "c", "C!", "d e f"]), rng.choice(["x", "X ", "y z", "Z, Y"])) for i in range(300)]
    letters = lambda s: "".join(sorted("".join(c for c in s.upper() if c.isalnum())))  # noqa: E731 - enough for these words
    groups = {}
    for i, t, a in items:
        groups.setdefault(tuple(sorted([letters(t), letters(a)])), []).append(i)
    expected = sorted((a, b) for g in groups.values() for a in g for b in g if a < b)
    assert found(spark, items, batches=1, least_buckets=1) == found(spark, items, batches=4, least_buckets=7) == expected
    r = rows(spark, items)
    table = ledger.ledger_of(r, batches=4, least_buckets=2, bucket_keys=2).table().collect()
    assert sorted((x.copies, x["first"].id) for x in table) == sorted((len(g), min(g)) for g in groups.values())


def test_hot_group_is_salted(spark, monkeypatch):
    monkeypatch.setattr(ledger, "PAIR_BLOCK", 7)
    items = [(i, "Live", "A") for i in range(60)]
    assert len(found(spark, items)) == 60 * 59 // 2


def test_only_touched_buckets_are_rewritten(spark):
    book = ledger.Ledger(spark, least_buckets=8).apply(rows(spark, [(i, f"t{i}", "a") for i in range(40)]))
    before = dict(book.manifest)
    book.apply(rows(spark, [(99, "T3", "A")]))
    assert sum(before[k] != v for k, v in book.manifest.items()) == 1 and sum(r.copies for r in book.table().collect()) == 41
    book.apply(rows(spark, []))
    assert book.table().count() == 40


def test_a_second_session_goes_on_and_buckets_grow(spark, tmp_path):
    path = f"file://{tmp_path}/book"
    first = ledger.Ledger(spark, path, least_buckets=2, bucket_keys=10).apply(rows(spark, [(i, f"t{i}", "a") for i in range(15)]))
    assert first.n_buckets == 2
    later = ledger.Ledger(spark.newSession(), path, bucket_keys=10)
    assert (later.version, later.keys, later.n_buckets) == (1, 15, 2)
    again = ledger.Ledger(spark, path, bucket_keys=10).apply(rows(spark, [(100 + i, f"T{i}!", "A") for i in range(30)]))
    assert (again.n_buckets, again.keys, again.version) == (8, 30, 2)
    assert sorted((r.copies, r["first"].id) for r in again.table().collect()) == sorted([(2, i) for i in range(15)] + [(1, 100 + i) for i in range(15, 30)])
    again.apply(rows(spark, [(500, "new", "b")]))
    left = {p.parent.name for p in tmp_path.rglob("bucket=*")}
    assert "batch-000001" not in left and len(list(tmp_path.rglob("manifest-*.json"))) == 1 and ledger.Ledger(spark, path).table().count() == 31
