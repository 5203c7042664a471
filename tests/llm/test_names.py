import random

from linkspark.llm import names

PEOPLE = {
    "Ursula Zarteizit": ["U. Zarteizit", "Zarteizit, Ursula", "Uschi Zarteizit", "URSULA ZARTEIZIT", "Ursula K. Zarteizit", "Ursula Zartezit", "Dr. Ursula Zarteizit"],
    "Henry Zarteizit": ["Hank Zarteizit", "H. Zarteizit"],
    "Ursula Brumvaro": ["Uschi Brumvaro", "Ursula Brumvraro"],
    "Henry Brumvaro": [],
    "Chloé Relskiahir": ["Chloe Relskiahir", "Chl. Relskiahir", "C Relskiahir"],
    "Relskiahir Ensemble": ["Relskiahir Ens.", "relskiahir ensemble"],
    "Die Vuljakit Brüder": ["Die Vuljakit Brueder", "Vuljakit Brüder, Die"],
    "Månса".replace("са", "s") + " Vuljakit": ["Mans Vuljakit"],
    "Оливер Друргреграр": ["Друргреграр, Оливер", "О. Друргреграр"],
}


def test_variants_are_linked_and_persons_kept_apart(spark):
    spelled = [("track_artist", n, 5 if n in PEOPLE else 1, "c", "t") for k, v in PEOPLE.items() for n in [k, *v]]
    # given names and kinds of groups go with many families, a family with few of them, as in any catalogue
    families = [f"{x}{y}" for x in ("Gansk", "Trist", "Jusb", "Mans", "Stinf", "Kresb", "Dumb", "Wimb") for y in ("aveby", "roapr", "eapil", "iochu", "uedron")]
    given = ["Ursula", "Henry", "Chloé", "Måns", "Оливер"]
    filler = [n for k, f in enumerate(families) for n in (f"{given[k % 5]} {f}", f"{given[(k + k // 5 + 1) % 5]} {f}", *([f"{f} Ensemble"] if k % 3 == 0 else []), *([f"Die {f} Brüder"] if k % 3 == 1 else []))]
    rows = spelled + [("track_artist", n, 3, "c", "t") for n in filler]
    df = spark.createDataFrame(rows, "field_name string, name string, n long, cluster string, token string").select("field_name", "name", "n")
    got = {(r.name_a, r.name_b) for r in names.variant_pairs(names.resolve(df)).collect()}
    truth = {(a, b) for k, v in PEOPLE.items() for a in [k, *v] for b in [k, *v] if a < b}
    assert not got - truth, got - truth
    assert len(got & truth) >= 0.9 * len(truth), truth - got


def test_values_of_columns(spark):
    df = spark.createDataFrame([("A B", ["C D", None, ""], 1), (None, None, 2), ("  ", [], 3), ("A B", ["C D"], 4), ("ZoÃ« X", ["Zoë X"] * 5, 5)], "track_artist string, composer array<string>, n int")
    got = {(r.field_name, r.name): r.n for r in names.name_values([(df, ["track_artist", "composer"])]).collect()}
    assert got[("track_artist", "A B")] == 2 and got[("composer", "C D")] == 2 and ("track_artist", "  ") not in got and ("composer", "") not in got


def test_empty_long_and_tied(spark):
    schema = "field_name string, name string, n long"
    assert names.resolve(spark.createDataFrame([], schema)).count() == 0
    long = "x" * 20_000
    got = names.variant_pairs(names.resolve(spark.createDataFrame([("f", long, 1), ("f", long.upper(), 1), ("f", "Q. Only", 1), ("g", "q only", 1)], schema))).collect()
    assert [(r.name_a, r.name_b) for r in got] == [(long.upper(), long)]


def test_token_rules():
    assert names.name_tokens("Dr. Ångström-Ødegård, Søren K.") == ["angstrom", "odegard", "soren"] and names.name_tokens("K.") == ["k"]
    assert names.one_edit("abcd", "abdc") and names.one_edit("abc", "abxc") and names.one_edit("abc", "axc") and not names.one_edit("abc", "abc") and not names.one_edit("abcd", "badc")
    assert names.abbreviates("u", "ursula", "x") and not names.abbreviates("t", "trio", "x") and names.abbreviates("rcds", "records", "record_label") and not names.abbreviates("ana", "alexandra", "x")


def catalogue(seed):
    """Names of persons and groups that no list here holds, and the truth: each entity's spellings."""
    rng = random.Random(seed)
    syllables = [a + b for a in "b d f g k l m p r s t v z".split() for b in "a e i o u an el ir os un".split()]
    word = lambda k: "".join(rng.choice(syllables) for _ in range(k)).capitalize()
    families = sorted({word(4) for _ in range(160)})
    given = sorted({word(3) for _ in range(18)})
    short = {g: g[:2] + rng.choice(["xi", "mek", "ju"]) for g in given[:9]}
    kinds = ["Wanderkapelle", "Tanzbund", "Lautenchor"]
    entities = {}
    for f in families:
        for g in rng.sample(given, 3):
            spelled = [f"{g} {f}", f"{f}, {g}", f"{g} {rng.choice('HJKW')}. {f}", f"{f} {g}", f"{g.upper()} {f}"]
            if g in short and rng.random() < 0.5:
                spelled.append(f"{short[g]} {f}")
            at = rng.randrange(1, len(f) - 1)
            spelled.append(f"{g} {f[:at]}{f[at + 1:]}")
            entities[f"{g} {f}"] = [spelled[0], *rng.sample(spelled[1:], rng.randrange(1, 6))]
        if rng.random() < 0.4:
            k = rng.choice(kinds)
            entities[f"{f} {k}"] = [f"{f} {k}", f"{k} {f}", f"the {f} {k}"][: rng.randrange(1, 4)]
    return entities


def test_names_on_no_list_are_linked(spark):
    entities = catalogue(5)
    rows = [("composer", n, 12 if n == k else 2) for k, v in entities.items() for n in v]
    df = spark.createDataFrame(rows, "field_name string, name string, n long")
    got = {(r.name_a, r.name_b) for r in names.variant_pairs(names.resolve(df)).collect()}
    truth = {(a, b) for v in entities.values() for a in v for b in v if a < b}
    assert len(got & truth) >= 0.9 * len(truth), sorted(truth - got)[:40]
    assert len(got & truth) >= 0.97 * len(got), sorted(got - truth)[:40]


def test_long_words_one_edit_apart_share_a_key():
    rng = random.Random(3)
    for n in (4, 30, 62, 63, 64, 65, 66, 200):
        w = "".join(rng.choice("abcdefgh") for _ in range(n))
        for i in range(n):
            for other in (w[:i] + w[i + 1 :], w[:i] + "x" + w[i + 1 :], w[:i] + "x" + w[i:], w[: max(i - 1, 0)] + w[max(i - 1, 0) : i + 1][::-1] + w[i + 1 :]):
                assert names.typo_keys(w) & names.typo_keys(other), (n, i)


def test_what_stands_behind_a_comma():
    assert names.behind_comma("Zarteizit, Ursula") == "ursula" == names.behind_comma("Zarteizit, Dr. Ursula K.")
    assert [names.behind_comma(v) for v in ("Ursula", "A, B, C", ", Ursula", "Zarteizit,", "Brüder, Die Vuljakit", "X, U.")] == [None] * 6
