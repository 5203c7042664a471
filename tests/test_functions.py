import datetime

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linkspark.config import Config, load
from linkspark.functions import difference as D
from linkspark.functions import distance as M
from linkspark.functions import fingerprint, loudness, temporal, textdiff, transliterate
from linkspark.functions import text as X
from linkspark.functions.template import ALBUM_FORMAT, TemplateError, compile_template, formatted_path


def one(spark, column, **values):
    kinds = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'bigint'}" for k, v in values.items())
    df = spark.createDataFrame([tuple(values.values())], kinds) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize("text, expected", [("FoO bAr", "foo bar"), ("Foo, The", "the foo"), ("chopin's étude", "chopin's etude"), ("A & B", "a and b"), ("Straße", "strasse"), ("x, an", "an x"), ("", ""), (None, None)])
def test_normalize(spark, text, expected):
    assert one(spark, X.normalize(F.col("t")), t=text) == expected


@pytest.mark.parametrize("a, b, expected", [("foo", "foo", 0.0), ("foo", "bar", 1.0), ("foo", "foobar", 0.5), ("Foo & Bar, The", "The Foo and Bar", 0.0), ("", "", 0.0)])
def test_string_distance(spark, a, b, expected):
    assert one(spark, X.normalized_distance(X.normalize(F.col("a")), X.normalize(F.col("b"))), a=a, b=b) == expected


def test_difference_states(spark):
    rows = [(None, None), (None, "a"), ("a", None), ("a", "a"), ("a", "b")]
    df = spark.createDataFrame(rows, "l string, r string").select(D.difference(F.col("l"), F.col("r"), X.normalized_distance).alias("d"))
    got = df.select("d.state", D.to_distance(F.col("d")).alias("t"), D.is_equal(F.col("d")).alias("e"), D.is_present_left(F.col("d")).alias("p")).collect()
    assert [tuple(r) for r in got] == [("both_missing", 0.0, True, False), ("added", 1.0, False, False), ("removed", 1.0, False, True), ("both_present", 0.0, True, True), ("both_present", 1.0, False, True)]


def test_weighted_mean(spark):
    rows = [(1.0, 2.5), (0.2, 5.0), (0.5, 0.5), (0.45, 3.0), (0.55, 5.0)]
    df = spark.createDataFrame(rows, "d double, w double")
    assert df.agg(M.weighted_mean_agg(F.col("d"), F.col("w")).alias("x")).first().x == pytest.approx(0.490625)
    assert one(spark, M.weighted_mean([(F.lit(d), w) for d, w in rows] + [(F.lit(None).cast("double"), 9.0)])) == pytest.approx(0.490625)
    assert one(spark, M.weighted_mean([(F.lit(None).cast("double"), 1.0)])) is None


@pytest.mark.parametrize("a, b, expected", [(0, 10_000, 0.0), (0, 25_000, 0.5), (0, 100_000, 1.0), (100_000, 89_001, 0.0)])
def test_length_distance(spark, a, b, expected):
    assert one(spark, M.length_distance(F.col("a"), F.col("b")), a=a, b=b) == expected


@pytest.mark.parametrize("text, expected", [("1962-01-17", (1962, 1, 17)), ("19620117", (1962, 1, 17)), ("1986-04", (1986, 4, 1)), ("198604", (1986, 4, 1)), ("1986", (1986, 1, 1)), ("1986-4", (1986, 4, 1)), ("1986-13-01", None), ("x", None), ("", None), (None, None)])
def test_partial_date(spark, text, expected):
    assert one(spark, temporal.partial_date(F.col("t")), t=text) == (datetime.date(*expected) if expected else None)


@pytest.mark.parametrize("ms, expected", [(0, "0:00"), (61_999, "1:01"), (3_600_000, "1:00:00"), (487_533, "8:07")])
def test_duration_text(spark, ms, expected):
    assert one(spark, temporal.duration_text(F.col("ms")), ms=ms) == expected


@pytest.mark.parametrize("n, expected", [(0, 1), (9, 1), (10, 2), (99, 2), (100, 3), (10000, 5)])
def test_decimal_width(spark, n, expected):
    assert one(spark, X.decimal_width(F.col("n")), n=n) == expected


def test_zfill_never_cuts(spark):
    assert one(spark, X.zfill(F.col("n"), 2), n=123) == "123" and one(spark, X.zfill(F.col("n"), 4), n=7) == "0007"


@pytest.mark.parametrize("value, who, role", [("A B (guitar)", "A B", "guitar"), ("A (b (c))", "A", "b (c)"), ("A B", "A B", ""), ("A (b", "A (b", ""), ("A (b) c", "A (b) c", "")])
def test_performer(spark, value, who, role):
    assert one(spark, X.performer_name(F.col("v")), v=value) == who and one(spark, X.performer_role(F.col("v")), v=value) == role


@pytest.mark.parametrize("value, expected", [("Live (CD 1)", "Live"), ("Live [Disc 2]", "Live"), ("Live - Disc 3", "Live"), ("Live CD 4", "Live"), ("Discovery", "Discovery"), ("Disco", "Disco")])
def test_disc_suffix(spark, value, expected):
    assert one(spark, X.strip_disc_suffix(F.col("v")), v=value) == expected


def test_entity_ids(spark):
    u = "0008f765-032b-46cd-ab69-2220edab1837"
    cases = {u: ("release", u), f"https://h.example/release/{u}": ("release", u), f"http://h.example/ws/2/recording/{u}?inc=x": ("recording", u), f"https://h.example/release-group/{u}": ("release-group", u), f"https://other.example/release/{u}": (None, None), "junk": (None, None), f"https://hxexample/release/{u}": (None, None)}
    for text, expected in cases.items():
        assert (one(spark, X.entity_kind(F.col("t"), "h.example"), t=text), one(spark, X.entity_id(F.col("t"), "h.example"), t=text)) == expected


def test_budget_join(spark):
    items = F.array(F.lit("aaaa"), F.lit("bbbbbbbbbb"), F.lit("cc"))
    assert one(spark, X.budget_join(items, 9)) == "aaaa | cc" and one(spark, X.budget_join(items, 3)) == "cc" and one(spark, X.budget_join(items, 1)) == ""


def test_escape_and_trim(spark):
    assert one(spark, X.escape_path_chars(F.col("t")), t="a/b\tc d") == "a_bc d"
    assert one(spark, X.trim_unicode(F.col("t")), t="　 x ") == "x"
    assert one(spark, X.same_identifier(F.col("a"), F.col("b")), a=" ", b="") is False


def test_template(spark):
    values = {"album_artist": F.lit("The Trio"), "year": F.lit("1958"), "album_title": F.lit("Live/At"), "disc_number": F.lit(1), "disc_count_width": F.lit(2), "track_index": F.lit(1), "track_count_width": F.lit(1), "track_title": F.lit("But Not for Me")}
    assert one(spark, formatted_path(ALBUM_FORMAT, values, F.lit("mp3"), "/m/")) == "/m/The Trio/1958 - Live_At/1-1 - But Not for Me.mp3"
    assert one(spark, compile_template("{{#if y}}a{{else}}b{{/if}}", {"y": F.lit("")})) == "b"
    for bad in ("{{nope}}", "{{#if y}}", "{{/if}}", "{{upper y}}"):
        with pytest.raises(TemplateError):
            compile_template(bad, {"y": F.lit("1")})


@given(st.text("abcé", max_size=14), st.text("abcé", max_size=14))
@settings(max_examples=200, deadline=None)
def test_shortest_edit(a, b):
    steps = textdiff.shortest_edit(a, b)
    assert "".join(o for op, o, _ in steps if op != "insert") == a and "".join(n for op, _, n in steps if op != "delete") == b
    n, m = len(a), len(b)
    lcs = np.zeros((n + 1, m + 1), int)
    for i in range(n):
        for j in range(m):
            lcs[i + 1, j + 1] = lcs[i, j] + 1 if a[i] == b[j] else max(lcs[i, j + 1], lcs[i + 1, j])
    assert sum(len(o) for op, o, _ in steps if op == "equal") == lcs[n, m]


def test_layout():
    assert textdiff.display_width("青い́a") == 5 and textdiff.wrap("青い雨", 4) == ["青い", "雨"] and textdiff.ellipsize("abcdef", 4) == "abc…" and textdiff.fill_right("a", 3) == "a  "
    assert textdiff.wrap("青", 1) == ["青"] and textdiff.two_columns("ab", "c", 7) == ["ab | c "]


def test_transliteration():
    assert transliterate.to_ascii("Žádná Šeď") == "Zadna Sed" and transliterate.to_ascii("Ещё") == "Eshchio" and transliterate.to_ascii("かぜ") == "kaze" and transliterate.to_ascii("Ωμέγα") == "Omega"


def test_loudness_of_a_sine():
    rate = 8000
    tone = np.sin(2 * np.pi * 997 * np.arange(3 * rate) / rate)
    lufs, peak, blocks, _ = loudness.measure(tone, rate)
    assert lufs == pytest.approx(-3.01, abs=0.1) and peak == pytest.approx(1.0, abs=0.01) and blocks > 20
    half, *_ = loudness.measure(tone / 2, rate)
    assert lufs - half == pytest.approx(6.02, abs=0.01)
    assert loudness.measure(np.zeros(rate), rate) == (None, 0.0, 0, 0.0)


def test_exact_decimals(spark):
    assert one(spark, loudness.exact_decimal(F.col("v"), F.lit(2)), v=0.125) == "0.12" and one(spark, loudness.exact_decimal(F.col("v"), F.lit(2)), v=2.675) == "2.67"


def test_fingerprint_is_stable_against_volume():
    rng = np.random.default_rng(1)
    x = rng.normal(size=40_000)
    assert fingerprint.words(x, 11025) == fingerprint.words(x * 0.5, 11025) != fingerprint.words(rng.normal(size=40_000), 11025)
    assert fingerprint.words(np.zeros(0), 11025) == []


def test_config(tmp_path):
    assert load() == Config()
    p, q = tmp_path / "a.toml", tmp_path / "b.toml"
    p.write_text("[analyzers]\nnum_parallel_jobs = 3\nenabled = [\"ebu_r128\"]\n[weights.track]\ntrack_title = 1\n")
    q.write_text("[analyzers]\nnum_parallel_jobs = 4\n")
    c = load(p, q)
    assert c.analyzers.num_parallel_jobs == 4 and c.analyzers.enabled == ["ebu_r128"] and c.weights.track.track_title == 1.0 and c.weights.track.track_artist == 3.0
    q.write_text("nope = 1\n")
    with pytest.raises(KeyError):
        load(q)
    q.write_text("[weights.track]\ntrack_title = -1.0\n")
    with pytest.raises(ValueError):
        load(q)


def test_default_path_formats_compile(spark):
    from linkspark.config import Config
    from linkspark.functions.template import formatted_path

    values = {"album_artist": "A", "album_title": "B/C", "year": "1958", "track_title": "T", "disc_number": 1, "disc_index": 2, "disc_count_width": 2, "track_index": 3, "track_count_width": 2, "artist_credit": "X"}
    columns = {k: F.lit(v) for k, v in values.items()}
    paths = Config().paths
    got = spark.range(1).select(formatted_path(paths.album_format, columns, F.lit("mp3")).alias("a"), formatted_path(paths.compilation_format, columns, F.lit("mp3")).alias("c"), formatted_path(paths.compilation_format, columns | {"disc_index": F.lit(None).cast("int")}, F.lit("mp3")).alias("n")).first()
    assert tuple(got) == ("A/1958 - B_C/1-03 - T.mp3", "A/1958 - B_C/02-03 - X - T.mp3", "A/1958 - B_C/03 - X - T.mp3")
