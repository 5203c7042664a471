import random

import pytest

from linkspark.llm import encoding

TITLES = ["São Canções", "Über Wölfe", "Après les Marées", "Píseň pod Vítr", "Kůň a Řeka", "Ohne Wärme", "Mañana, Otoño", "Où vont les Fêtes", "Ещё Берег", "Тихий Поезд", "Χρυσό Κύμα", "Die Gärten am Fluß", "As Balões Também", "Íñigo Basboaflo", "Wiesława Krirprilin", "Ã, Sertão", "NÃO, Angela", "とおいひかり", "Plain Words"]
MISTAKES = ["utf-8>cp1252:keepbyte", "utf-8>latin-1:keepbyte", "utf-8>mac-roman:keepbyte", "utf-8>cp1251:keepbyte", "utf-8>cp437:keepbyte", "utf-8>cp1252:keepbyte+utf-8>cp1252:keepbyte"]


@pytest.fixture(autouse=True)
def handlers():
    encoding._register()


def test_round_trip():
    for t in TITLES:
        for m in MISTAKES:
            g = encoding.garble(t, m)
            assert g is None and t.isascii() or encoding.restore(g, m) == t


def tracks(spark, rows):
    return spark.createDataFrame([(i, v, "w", 1) for i, v in rows], "track_id long, track_title string, word string, n int")


def test_planted_mistakes_are_found_and_restored(spark):
    rng = random.Random(2)
    rows, truth = [], {}
    for k in range(600):
        rows.append((k, rng.choice(TITLES)))
    for k in range(600, 720):
        t = rng.choice([t for t in TITLES if not t.isascii()])
        m = rng.choice(MISTAKES)
        g = encoding.garble(t, m)
        rows.append((k, g))
        truth[k] = t
    rows += [(800, "Ver�es"), (801, None), (802, ""), (803, "Plain Words"), (None, "SÃ£o")]
    got = {r.record_id: r.restored for r in encoding.find_garbled([(tracks(spark, rows), "track_id", ["track_title"])]).collect()}
    assert set(got) - set(truth) == {800}, {dict(rows)[k] for k in set(got) - set(truth) - {800}}
    assert len(set(got) & set(truth)) >= 0.97 * len(truth), [dict(rows)[k] for k in set(truth) - set(got)]
    assert sum(got.get(k) == t for k, t in truth.items()) >= 0.95 * len(truth)


def test_partly_garbled_value(spark):
    rows = [(k, t) for k, t in enumerate(["São Canções", "Até Sertão", "Ã, Sertão"] * 8)] + [(100 + k, v) for k, v in enumerate(["SÃ£o Canções", "AtÃ© Sertão", "Até SertÃ£o", "SÃ£o CanÃ§Ãµes"])]
    got = {r.record_id: r.restored for r in encoding.find_garbled([(tracks(spark, rows), "track_id", ["track_title"])]).collect()}
    assert got == {100: "São Canções", 101: "Até Sertão", 102: "Até Sertão", 103: "São Canções"}


def test_empty_long_and_repeated(spark):
    assert encoding.find_garbled([(tracks(spark, []), "track_id", ["track_title"])]).count() == 0
    long = "plain é " * 10_000
    rows = [(1, long), (2, long + "Ã©"), (2, long + "Ã©"), (3, long + "�")]
    got = sorted(r.record_id for r in encoding.find_garbled([(tracks(spark, rows), "track_id", ["track_title"])]).collect())
    assert 3 in got and got.count(2) <= 1 and 1 not in got


def test_alignment_parts_runs_as_far_as_it_can():
    assert encoding.aligned("MaÃ±ana", "Mañana") == [("Ã±", "ñ")]
    assert encoding.aligned("ÃµÃ£x", "õãx") == [("Ãµ", "õ"), ("Ã£", "ã")]
    assert encoding.aligned("¡Sueños", "Sueños") == [] == encoding.aligned("caf", "caf")
    assert encoding.aligned("aÃ©bè", "aébè") == [("Ã©", "é")]


@pytest.mark.parametrize("reader", ["cp1257"])
def test_mistakes_outside_the_usual_encodings_are_learned(spark, reader):
    mistake = f"utf-8>{reader}:keepbyte"
    assert mistake not in encoding.mistakes()
    words = ["São", "Canções", "Sertão", "Até", "Mañana", "Otoño", "Fêtes", "Après", "Gärten", "Wölfe", "Müde", "Köln"]
    rows = [(k, w) for k, w in enumerate(words * 40)] + [(500 + k, encoding.garble(w, mistake)) for k, w in enumerate(words)]
    rows += [(600, encoding.garble("Sertãoño", mistake))]  # has no twin: only the learned mapping tells
    got = {r.record_id: (r.restored, r.evidence) for r in encoding.find_garbled([(tracks(spark, rows), "track_id", ["track_title"])]).collect()}
    assert {k: got[500 + k] for k in range(len(words))} == {k: (w, "twin") for k, w in enumerate(words)}
    assert got[600] == ("Sertãoño", "mapping") and len(got) == len(words) + 1


def test_substitutions_that_no_encoding_explains_are_learned(spark):
    words = ["São", "Canções", "Sertão", "Irmão", "Verão", "Pão"]
    rows = [(k, w) for k, w in enumerate(words * 12)] + [(500 + k, w.replace("ã", "§¶")) for k, w in enumerate(words) if "ã" in w] + [(600, "Manh§¶")]
    got = {r.record_id: r.restored for r in encoding.find_garbled([(tracks(spark, rows), "track_id", ["track_title"])]).collect()}
    assert got == {500: "São", 502: "Sertão", 503: "Irmão", 504: "Verão", 505: "Pão", 600: "Manhã"}


def test_nothing_is_found_without_alignment(spark, monkeypatch):
    monkeypatch.setattr(encoding, "learned_from", lambda twins, words: ([], {}))
    rows = [(k, "São") for k in range(20)] + [(100, "SÃ£o"), (101, "S�o")]
    got = {r.record_id: r.evidence for r in encoding.find_garbled([(tracks(spark, rows), "track_id", ["track_title"])]).collect()}
    assert got == {101: "lost"}
