import random

from linkspark.llm import leakage, mail


def frames(spark, docs, items):
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, item_id int, part string")
    return d, spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")


def found(spark, docs, items, **kw):
    return sorted((r.doc_id, r.item_id) for r in leakage.find_leaks(*frames(spark, docs, items), **kw).collect())


def brute(docs, items, n):
    out = set()
    for d, text in docs:
        for part in mail.parts_of(text or ""):
            w = mail.words(mail.visible(part))
            grams = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
            for i, t in items:
                x = mail.words(t or "")
                if any(tuple(x[k : k + n]) in grams for k in range(len(x) - n + 1)):
                    out.add((d, i))
    return sorted(out)


def test_against_brute_force(spark):
    rng = random.Random(3)
    word = lambda: rng.choice("ab cd ef gh ij kl".split())
    items = [(i, " ".join(word() for _ in range(rng.randint(0, 12)))) for i in range(12)] + [(90, None), (91, "")]
    docs = [(i, " ".join(rng.choice([word(), word().upper() + ",", "zz"]) for _ in range(rng.randint(0, 60)))) for i in range(80)] + [(900, None), (901, ""), (902, "ab " * 30_000)]
    for n in (1, 4, 6):
        assert found(spark, docs, items, n=n) == brute(docs, items, n)


def test_edges_quotes_repeats_and_clashing_columns(spark):
    item = " ".join(f"word{k}" for k in range(40))
    w = item.split()
    docs = [
        (1, "x " + " ".join(w[3:18]) + " y"), (2, " ".join(w[3:17])), (3, "> " + "\n> ".join(" ".join(w[k : k + 5]).upper() for k in range(0, 40, 5))), (4, " ".join(w[:14]) + " gap " + " ".join(w[14:28])),
        (5, "From: a\nContent-Type: text/html\n\n<p>" + " ".join(w[:10]) + "</p><p>wo<i>rd10</i> " + " ".join(w[11:20]) + "</p>"), (1, " ".join(w[3:18])),
    ]
    assert found(spark, docs, [(7, item), (8, item)]) == sorted([(1, 7), (1, 8), (3, 7), (3, 8), (5, 7), (5, 8), (1, 7), (1, 8)])
    assert found(spark, [], [(7, item)]) == [] and found(spark, docs, []) == []


def test_several_test_sets(spark, monkeypatch):
    monkeypatch.setattr(leakage, "BROADCAST_CHARS", 60)
    items = [(i, f"t{i} " * 5) for i in range(9)]
    docs = [(i, f"t{i} " * 6) for i in range(9)]
    assert found(spark, docs, items, n=5) == [(i, i) for i in range(9)]
    clean = {r.doc_id: (r.clean_text.strip(), r.words_removed) for r in leakage.remove_leaks(*frames(spark, [(3, "keep this " + "t3 " * 5 + "and that")], items), n=5).collect()}
    assert clean[3][0].split() == "keep this and that".split()


def cleaned(spark, docs, items, **kw):
    return {r.doc_id: (r.clean_text.split(), r.words_removed) for r in leakage.remove_leaks(*frames(spark, docs, items), **kw).collect()}


def test_every_passage_is_removed_and_nothing_else(spark):
    w = [f"word{k}" for k in range(40)]
    v = [*w[30:], *(f"other{k}" for k in range(20))]
    docs = [
        (1, " ".join(["a", *w, "b\n>", *w, "c"])), (2, " ".join(["a", *w[:16], "b", *w[20:36], "c"])),
        (3, " ".join(["a", *w, *v[10:], "b c d e f g h"])), (4, "only clean words"), (5, None), (6, " ".join(["İİ ŉ straße", *w[:15], "c"])),
    ]
    got = cleaned(spark, docs, [(7, " ".join(w)), (8, " ".join(v))])
    assert got == {1: (["a", "b", ">", "c"], 80), 2: (["a", "b", "c"], 32), 3: ("a b c d e f g h".split(), 60), 4: (["only", "clean", "words"], 0), 5: ([], 0), 6: (["İİ", "ŉ", "straße", "c"], 15)}


def test_removal_is_the_same_in_several_passes(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda: rng.choice("ab cd ef gh".split())
    items = [(i, " ".join(word() for _ in range(8))) for i in range(12)]
    docs = [(i, " ".join(rng.choice([word(), word(), "zz"]) for _ in range(80))) for i in range(60)]
    once = cleaned(spark, docs, items, n=4)
    monkeypatch.setattr(leakage, "BROADCAST_CHARS", 60)
    assert cleaned(spark, docs, items, n=4) == once
    grams = {tuple(t.split()[k : k + 4]) for _, t in items for k in range(5)}
    for i, text in docs:
        x = text.split()
        hit = {k + j for k in range(len(x) - 3) if tuple(x[k : k + 4]) in grams for j in range(4)}
        assert once[i] == ([t for k, t in enumerate(x) if k not in hit], len(hit))
