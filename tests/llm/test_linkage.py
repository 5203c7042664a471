import itertools
import random

import pytest

from linkspark.llm import linkage

COLUMNS = "release_title string, release_artist string, barcode string, catalog_number string, record_label string, release_country string, release_date string, release_year string, release_type string, total_discs string"


def source(spark, id_name, rows, extra=""):
    """Rows of id, title, artist, barcode, number, label, date; extra columns with names the operator uses inside."""
    full = [(i, t, a, b, c, l, None, d, None, None, None, "x", "y") for i, t, a, b, c, l, d in rows]
    return spark.createDataFrame(full, f"{id_name} long, {COLUMNS}, edition string, odds string")


def pairs(spark, left, right):
    got = linkage.match_sources(source(spark, "release_id", left), "release_id", source(spark, "catalogue_id", right), "catalogue_id")
    return {(r.release_id, r.catalogue_id): r.confidence for r in got.collect()}


def test_noisy_pairs_editions_repeats_and_gaps(spark):
    left = [
        (1, "Stone and Sparrows", "Yolanda Brumvaro", "2900000000017", "CHO 01234", "Cholwewon Records", "2001-02-03"),
        (2, "STONE AND SPARROWS", "Brumvaro, Yolanda", None, "CHO/1234", None, "2001"),
        (3, "Quiet Rivers", "Trio Zarteizit", "2900000000024", None, "Nolwiner Music", "1999-05-06"),
        (4, None, None, None, None, None, None),
        (5, "", "", "0000000000000", "", "", ""),
        (6, "Quiet Rivers", "Los Vuljakit", None, None, None, None),
        (7, "x" * 50_000, "y", None, "LON 77", None, None),
    ]
    right = [
        (101, "Stone & Sparrows (Album)", "Y. Brumvaro", "290-000000001-7", "CHO.001234 CD", None, "20010203"),
        (102, "Stone and Sparrows", "Yolanda Brumvaro", "2911111111112", "CHO 05555", "Cholwewon Records", "2011-09-09"),
        (103, "Qiuet Rivers", "Trio Zarteizit", None, "NOL 777", "Nolwiner Music", "1999-05-06"),
        (104, None, None, None, None, None, None),
        (105, "Stone and Sparrows", "Yolanda Brumvaro", "2900000000017", None, None, None),
    ]
    got = pairs(spark, left, right)
    assert set(got) == {(1, 101), (2, 101), (1, 105), (2, 105), (3, 103)} and all(0.5 <= c <= 1 for c in got.values())


def test_empty_and_repeated_rows(spark):
    row = (1, "Stone and Sparrows", "Yolanda Brumvaro", "2900000000017", "CHO 1234", None, None)
    assert pairs(spark, [], [row]) == {} and pairs(spark, [row], []) == {}
    assert set(pairs(spark, [row, row], [(9, *row[1:])])) == {(1, 9)}


@pytest.mark.parametrize("seed", range(4))
def test_marginals_are_exact_on_trees(spark, seed):
    rng = random.Random(seed)
    edges, nodes = [], [("l", 0)]
    for k in range(1, 7):  # a random tree between the two sides
        side, at = rng.choice(nodes)
        new = ("r" if side == "l" else "l", 10 + k)
        nodes.append(new)
        l, r = (at, new[1]) if side == "l" else (new[1], at)
        edges.append((l, r, float(rng.choice([0.5, 2.0, 8.0]))))
    total, share = 0.0, dict.fromkeys([e[:2] for e in edges], 0.0)
    for chosen in itertools.product([0, 1], repeat=len(edges)):
        picked = [e for e, c in zip(edges, chosen) if c]
        if len({e[0] for e in picked}) == len(picked) == len({e[1] for e in picked}):
            w = 1.0
            for e in picked:
                w *= e[2]
            total += w
            for e in picked:
                share[e[:2]] += w
    got = linkage.propagate(spark.createDataFrame(edges, "l long, r long, odds double"))
    for row in got.collect():
        assert row.confidence == pytest.approx(share[row.l, row.r] / total, abs=0.01)


def test_ties_share_their_probability(spark):
    got = linkage.propagate(spark.createDataFrame([(1, 2, 1e6), (1, 3, 1e6)], "l long, r long, odds double")).collect()
    assert [round(r.confidence, 3) for r in got] == [0.5, 0.5]


def test_attribute_readings():
    assert linkage.barcode_of("0 466289-295894") == "466289295894" and linkage.barcode_of("0000000000000") is None and linkage.barcode_of(None) is None
    assert linkage.catalog_of("ner.004127 LP") == "NER-4127" == linkage.catalog_of("NER - 04127") and linkage.catalog_of("") is None
    assert linkage.date_of("19930716", None) == "19930716" and linkage.date_of("", "1993") == "1993" and linkage.date_of("x", None) is None
    assert linkage.token_agreement(["rivers", "part", "ii"], ["rivers"], True) == 2 and linkage.token_agreement(["a"], [], True) == -1


def test_hot_blocks_are_split_without_losing_pairs(spark, monkeypatch):
    left = [(i, f"Song {w} rivers", "Trio Zarteizit", "2900000000017", f"NOL {1000 + i}", None, f"1999-05-{10 + i}") for i, w in enumerate("stone water ash moss glass frost".split())]
    right = [(100 + i, *row[1:]) for i, row in enumerate(left)]
    plain = set(pairs(spark, left, right))
    monkeypatch.setattr(linkage, "HEAVY", 3)
    assert set(pairs(spark, left, right)) == plain == {(i, 100 + i) for i in range(6)}


def test_hot_blocks_keep_misspelt_undated_and_swapped_pairs(spark, monkeypatch):
    code = "2900000000017"
    left = [(1, "Rivers", "Zarteizit", code, None, None, "2001"), (2, "Brumvaro", "Glassware", code, None, None, None), (3, "Mountains", "Vuljakit", code, None, None, "1980"), (4, "Quillhaven", "Jandotrin", code, None, None, "1971")]
    right = [(101, "Rivrs", "Zarteizit", code, None, None, "20010101"), (102, "Glassware", "Brumvaroo", code, None, None, None), (103, "Mountans", "Vuljakit", code, None, None, None)]
    want = {(1, 101), (2, 102), (3, 103)}
    for heavy in (20_000, 3, 1):
        monkeypatch.setattr(linkage, "HEAVY", heavy)
        assert set(pairs(spark, left, right)) == want


def test_a_code_of_many_titles_is_a_placeholder_and_a_hot_edition_keeps_its_code(spark):
    rows = [(i, f"Title{i % 40} river", "Zarteizit", "2900000000017", "HOT 1", None, None) for i in range(80)] + [(100 + i, "Stone", "Brumvaro", "2911111111112", None, None, None) for i in range(60)]
    rows += [(200 + i, f"Ash{i}", "Vuljakit", "2911111111112", None, None, None) for i in range(25)]
    got = linkage.without_placeholders(linkage.features(source(spark, "release_id", rows), "release_id")).collect()
    assert {(r.barcode, r.catalog) for r in got if r.id < 100} == {(None, None)} and {r.barcode for r in got if r.id >= 100} == {"2911111111112"}


def test_strong_chains_settle_and_endless_rounds_are_an_error(spark):
    odds = [1e9, 1e6, 1e9, 1e6, 1e9, 1e9, 1e3]
    chain = spark.createDataFrame([(k // 2 + k % 2, 100 + k // 2, w) for k, w in enumerate(odds)], "l long, r long, odds double")
    assert all(0 <= r.confidence <= 1 for r in linkage.propagate(chain).collect())
    with pytest.raises(RuntimeError, match="settled"):
        linkage.propagate(chain, 1)


def test_the_bound_of_a_score_holds(spark):
    rng = random.Random(4)
    pick = lambda *v: rng.choice([None, *v])

    def one():
        return {"title": pick(["stone"], ["stone", "ash"]), "artist": pick(["brumvaro"], ["zarteizit", "trio"]), "barcode": pick("29000017", "29000071", "2900001", "55555555"), "catalog": pick("CHO-12", "CHO-21", "NOL-7"), "label": pick(["cho"]),
                "country": pick("DE", "FR"), "date": pick("2001", "20010203", "1999"), "kind": pick("album", "ep"), "discs": pick(1, 2)}

    sides = [(one(), one()) for _ in range(400)]
    rows = [(k, *[x[f] for f in linkage.FIELDS], *[y[f] for f in linkage.FIELDS]) for k, (x, y) in enumerate(sides)]
    kinds = {"title": "array<string>", "artist": "array<string>", "label": "array<string>", "discs": "int"}
    schema = "k int, " + ", ".join(f"{s}_{f} {kinds.get(f, 'string')}" for s in "lr" for f in linkage.FIELDS)
    for r in spark.createDataFrame(rows, schema).select("k", linkage._at_most("l", "r").alias("most")).collect():
        assert r.most >= linkage.pair_score(*sides[r.k]) - 1e-9


def test_membership_gives_matching_editions_one_number(spark, tmp_path):
    from linkspark.llm.queries import p1_editions

    row = ("Stone and Sparrows", "Yolanda Brumvaro", "2900000000017", "CHO 1234", None, None)
    source(spark, "release_id", [(1, *row), (2, *row), (3, None, None, None, None, None, None)]).write.parquet(f"{tmp_path}/releases.parquet")
    source(spark, "catalogue_id", [(9, *row), (10, "Other", "Trio Jeltrelit", "2911111111112", "X 1", None, None)]).write.parquet(f"{tmp_path}/catalogue_releases.parquet")
    assert {(r.source, r.record_id): r.edition for r in p1_editions(spark, str(tmp_path)).collect()} == {("local", 1): 1, ("local", 2): 1, ("local", 3): 3, ("catalogue", 9): 1, ("catalogue", 10): 10}
