import itertools
import json
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linkspark.functions import distance as M
from linkspark.functions import text as X
from linkspark.operators import analyzers, assign, blocking, consensus, disambiguate, nested, rank, relations
from linkspark.sources import cache, files, tags


def test_mode_first_seen(spark):
    words = "frog dog horse dog cat cat dog mouse".split()
    df = spark.createDataFrame([(1, i, w) for i, w in enumerate(words)] + [(2, i, w) for i, w in enumerate("c b a".split())] + [(3, 0, None)], "g int, i int, v string")
    got = {r.g: (r.item, r["count"], r.total) for r in consensus.mode_first_seen(df, ["g"], "v", "i").collect()}
    assert got == {1: ("dog", 3, 8), 2: ("c", 1, 3)}


def test_consensus_and_runs(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (1, "a"), (2, "a"), (2, "b"), (3, None)], "g int, v string")
    assert {r.g: r.c for r in df.groupBy("g").agg(consensus.consensus(F.col("v")).alias("c")).collect()} == {1: "a", 2: None, 3: None}
    media = spark.createDataFrame([(1, 0, "CD"), (1, 1, "CD"), (1, 2, "DVD"), (1, 3, "CD"), (2, 0, None)], "g int, i int, v string")
    runs = consensus.run_lengths(media, ["g"], "v", "i")
    assert {r.g: r.format for r in consensus.format_runs(runs, ["g"]).collect()} == {1: "2×CD+DVD+CD", 2: None}
    assert spark.range(1).select(consensus.format_list(F.array(F.lit("CD"), F.lit("CD"), F.lit("DVD"), F.lit("CD"))).alias("x")).first().x == "2×CD+DVD+CD"


def brute(cost):
    n, m = cost.shape
    if n <= m:
        return min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))
    return brute(cost.T)


@given(st.integers(1, 5), st.integers(1, 5), st.integers(0, 10**6))
@settings(max_examples=120, deadline=None)
def test_assignment_is_optimal(n, m, seed):
    rng = np.random.default_rng(seed)
    d = rng.integers(0, 5, size=(n, m)) / 4 if seed % 2 else rng.random((n, m))
    got = assign.solve(d.ravel(), n, m)
    q = np.floor(d * M.COST_STEPS)
    assert sum(q[i, j] for i, j in zip(got["left_idx"], got["right_idx"])) == brute(q)
    assert len(set(got["left_idx"])) == len(set(got["right_idx"])) == min(n, m) and len(got["unmatched"]) == abs(n - m)


@pytest.mark.parametrize("left, right, distance, weight, side", [
    (list("abcde"), list("abcde"), 0.0, 5, "right"), (list("abcde"), list("edcba"), 0.0, 5, "right"), (["foo", "bar"], ["qrst", "xyz"], 1.0, 2, "right"),
    (["foo", "bar", "baz"], ["foo", "bar"], 1 / 3, 3, "left"), (["foo", "bar"], ["foo", "bar", "baz"], 1 / 3, 3, "right"), (["foo", "bar"], [], 1.0, 2, "left"), ([], [], None, 0, "right"),
])
def test_assignment_join(spark, left, right, distance, weight, side):
    df = spark.createDataFrame([(1, left, right)], "k int, l array<string>, r array<string>")
    a = assign.assignment(df, ["k"], "l", "r", X.normalized_distance)
    c = F.col("a")
    n = F.size(c["cost"]), F.size(c["unmatched"])
    row = a.select(M.assignment_distance(n[0], n[1], assign.matched_mean(c)).alias("d"), (n[0] + n[1]).alias("w"), c["unmatched_side"].alias("s")).first()
    assert (row.d if distance is None else row.d == pytest.approx(distance, abs=1e-5)) in (None, True) and row.w == weight and row.s == side


def test_enrichment_clears_and_drops(spark):
    items = spark.createDataFrame([(1, 0, "a", "x"), (1, 1, "b", None), (1, 2, "c", "z")], "k int, left_idx int, title string, mood string")
    matched = spark.createDataFrame([(1, 0, 1), (1, 1, 0)], "k int, left_idx int, right_idx int")
    source = spark.createDataFrame([(1, 0, "B", "m"), (1, 1, "A", None)], "k int, right_idx int, title string, mood string")
    got = {r.left_idx: (r.title, r.mood) for r in assign.enriched(items, matched, source, ["k"], ["title", "mood"]).collect()}
    assert got == {0: ("A", None), 1: ("B", "m")}
    kept = {r.left_idx: r.mood for r in assign.enriched(items, matched, source, ["k"], ["mood"], keep_existing=True).collect()}
    assert kept == {0: "x", 1: "m"}


def test_blocking_and_short_circuit(spark):
    left = spark.createDataFrame([(1, "k1", "a"), (2, None, "b"), (3, "zz", "b")], "l int, key string, t string")
    right = spark.createDataFrame([(10, "k1", "b"), (11, None, "b"), (12, "k9", None)], "r int, rkey string, t string")
    got = blocking.with_short_circuit(left, right, "l", "r", "key", "rkey", lambda rest: rest.join(right.select("r", "t"), "t"))
    assert sorted(map(tuple, got.collect())) == [(1, 10, "id"), (2, 10, "search"), (2, 11, "search"), (3, 10, "search"), (3, 11, "search")]
    c = blocking.candidates(left, right, "l", "r", {"t": (F.array("t"), F.array("t")), "k": (F.array("key"), F.array("rkey"))}, limit=1)
    assert sorted((r.l, r.r, r.clauses) for r in c.collect()) == [(1, 10, 1), (2, 10, 1), (3, 10, 1)]


def test_ranking(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.1), ("a", 3, 0.1), ("b", 1, 0.01)], "k string, c int, d double")
    assert [(r.k, r.c) for r in rank.top_k(df, "k", "d", "c", 2).orderBy("k", "rank").collect()] == [("a", 2), ("a", 3), ("b", 1)]
    assert {r.k: r.decision for r in rank.auto_selected(df, "k", "d").collect()} == {"a": "needs_review", "b": "auto_select"}
    assert rank.without_repeats(df.unionByName(df), "k", "c", "d").count() == 4


def test_disambiguation(spark):
    fields = ["media_format", "release_country", "release_year", "record_label", "catalog_number", "barcode"]
    rows = [("t", "CD", "DE"), ("t", "CD", None), ("u", "CD", "DE"), ("v", None, "x"), ("v", None, "x")]
    df = spark.createDataFrame([(t, m, c, "1", "l", "n", "b") for t, m, c in rows], "title string, " + ", ".join(f"{f} string" for f in fields))
    got = {r.title: r.needs for r in disambiguate.distinguishing_fields(df, ["title"]).collect()}
    assert got == {"t": "release_country", "u": "", "v": ",".join(fields)}


def test_merge_of_people(spark):
    a = spark.createDataFrame([(1, "g", "x"), (1, "g", "y"), (1, "d", "z")], "k int, role string, who string")
    b = spark.createDataFrame([(1, "g", "x"), (1, "p", "q")], "k int, role string, who string")
    got = sorted((r.involvement, r.n, r.left, r.right) for r in relations.merged_people(a, b, "k", "role", "who").collect())
    assert got == [("d", 1, "z", None), ("g", 1, "x", "x"), ("g", 2, "y", None), ("p", 1, None, "q")]


def test_release_folders(spark):
    rows = [("/m/A/CD 1/1.mp3",), ("/m/A/cd2/1.FLAC",), ("/m/A/x.txt",), ("/m/B/1.mp3",), ("/m/B-C/1.mp3",)]
    got = {r.directory: r.paths for r in files.grouped(spark.createDataFrame(rows, "path string")).collect()}
    assert got == {"/m/A": ["/m/A/CD 1/1.mp3", "/m/A/cd2/1.FLAC"], "/m/B": ["/m/B/1.mp3"], "/m/B-C": ["/m/B-C/1.mp3"]}


def test_cache_ages(spark, tmp_path):
    now = F.lit("2030-01-15 00:00:00").cast("timestamp")
    df = spark.createDataFrame([("a", 1), ("b", 2)], "key string, v int")
    cache.write(df, str(tmp_path), "release", "key", F.struct("v"), now - F.expr("interval 3 days"))
    assert cache.read(spark, str(tmp_path), "struct<v:int>", now, max_days=10**5).count() == 2
    assert cache.read(spark, str(tmp_path), "struct<v:int>", now + F.expr("interval 12 days"), max_days=10**5).count() == 0
    assert cache.read(spark, str(tmp_path), "struct<v:int>", now).count() == 0


def id3_frame(name, payload, major):
    size = struct.pack(">I", len(payload)) if major == 3 else bytes([len(payload) >> 21 & 127, len(payload) >> 14 & 127, len(payload) >> 7 & 127, len(payload) & 127])
    return name.encode() + size + b"\0\0" + payload


def id3_tag(frames, major):
    body = b"".join(frames) + b"\0" * 20
    return b"ID3" + bytes([major, 0, 0]) + bytes([len(body) >> 21 & 127, len(body) >> 14 & 127, len(body) >> 7 & 127, len(body) & 127]) + body


def test_id3_and_vorbis(spark):
    v24 = id3_tag([id3_frame("TIT2", b"\x03Caf\xc3\xa9", 4), id3_frame("TXXX", b"\x03ASIN\0B1", 4), id3_frame("TMCL", b"\x03piano\0A\0bass\0B", 4), id3_frame("UFID", b"http://x\0id1", 4), id3_frame("COMM", b"\x03engd\0hi", 4)], 4)
    v23 = id3_tag([id3_frame("TIT2", b"\x01" + "Été".encode("utf-16"), 3)], 3)
    assert tags.read_id3(v24) == {"TIT2": ["Café"], "TXXX:ASIN": ["B1"], "TMCL[piano]": ["A"], "TMCL[bass]": ["B"], "UFID:http://x": ["id1"], "COMM:eng:d": ["hi"]}
    assert tags.read_id3(v23) == {"TIT2": ["Été"]} and tags.read_id3(b"\xff\xfbxx") == {} and tags.read_id3(v24[:20]) is None
    comments = [b"TITLE=One", b"artist=A", b"ARTIST=B"]
    block = struct.pack("<I", 1) + b"v" + struct.pack("<I", 3) + b"".join(struct.pack("<I", len(c)) + c for c in comments)
    flac = b"fLaC" + b"\x00\x00\x00\x02xx" + b"\x84" + len(block).to_bytes(3, "big") + block
    assert tags.read_vorbis(flac) == {"TITLE": ["One"], "ARTIST": ["A", "B"]} and tags.read_vorbis(b"RIFF") is None and tags.read_vorbis(flac[:20]) is None
    df = spark.createDataFrame([("a.mp3", bytearray(v23)), ("b.FLAC", bytearray(flac)), ("c.ogg", bytearray(b"x")), ("d.mp3", None)], "path string, content binary")
    got = {r.path: (r.container, r.tags) for r in tags.read_tags(df).collect()}
    assert got["a.mp3"] == ("id3v2.3", {"TIT2": ["Été"]}) and got["b.FLAC"][0] == "vorbis" and got["c.ogg"] == (None, None) and got["d.mp3"] == (None, None)


@pytest.mark.parametrize("container", tags.CONTAINERS)
def test_every_key_sets_gets_and_clears(spark, container):
    stored = [k for k in tags.KEYS if k[container] != "-"]
    df = spark.createDataFrame([(k["key"],) for k in tags.KEYS], "key string").select("key", tags.physical_name(F.col("key"), container).alias("name"))
    assert {r.key: r.name for r in df.where("name is not null").collect()} == {k["key"]: k[container] for k in stored}
    m = F.create_map(F.lit("a"), F.array(F.lit("1")))
    m = tags.set_values(m, "b", F.array(F.lit("2"), F.lit("3")))
    row = spark.range(1).select(tags.get(m, F.lit("b")).alias("b"), F.size(tags.clear(m, "b")).alias("n"), F.size(tags.set_values(m, "b", F.array().cast("array<string>"))).alias("c"), tags.get(m, F.lit("zz")).alias("z")).first()
    assert tuple(row) == ("2", 1, 1, None)


def test_analyzers_keep_going_and_report_errors(spark):
    df = spark.createDataFrame([(1, [0.1] * 100, 100), (2, None, 0)], "id int, s array<double>, rate int")
    got = {r.id: r for r in analyzers.analyze(df, "id", "s", "rate").collect()}
    assert got[1].length_ms == 1000 and got[1].errors == {} and got[1].peak == pytest.approx(0.1)
    assert got[2].length_ms is None and "track_length" in got[2].errors


def expected_tracks(rows):
    out = []
    for i, body in rows:
        try:
            j = json.loads(body, parse_constant=lambda _: 1 / 0)
        except Exception:
            continue
        if not isinstance(j, dict):
            continue
        if "media" not in j and isinstance(j.get("item"), dict):
            j = j["item"]
        as_list = lambda v: [(0, v)] if isinstance(v, dict) else [(k, x) for k, x in enumerate(v) if isinstance(x, dict)] if isinstance(v, list) else []
        for m, part in as_list(j.get("media")):
            items = as_list(part.get("media_tracks"))
            out += [(i, m, t) for t, _ in items] or [(i, m, -1)]
    return sorted(out)


def test_nested_edge_cases(spark):
    bodies = [
        None, "", "   ", "{}", "[]", '"media"', "null", '{"media": null}', '{"media": []}', '{"media": {}}', '{"media": [{}, null, {"media_tracks": []}]}',
        '{"media": {"media_tracks": {"t": 1}}}', '{"media": [{"media_tracks": [{}, 3, {"a": "]}"}]}]}', '{"item": {"media": [{"media_tracks": [{}]}]}, "created": 1}',
        '{"x": {"media": [{}]}}', '{"media": [{"media_tracks": [{}]}', '{"media": [{"media_tracks": [{}]}]} x', '{"media": [{"media_tracks": [{},]}]}', '{"media": [{"media_tracks": [{"k": NaN}]}]}',
        '{"title": "a \\" \\\\", "media": [{"media_tracks": [{"t": "{[\\"media\\":"}]}]}', '{"\\u006dedia": [{"media_tracks": [{}]}]}', '{"media": [{"media_tracks": [{}]}], "media": [{}, {}]}',
        '{"media": [{"media_tracks": [{"media": [{"media_tracks": [{}]}]}]}]}', '{"media":[{"disc_number":1,"media_tracks":[' + ",".join('{"t":"é"}' for _ in range(3000)) + "]}]}", "[" * 5000, '{"media": "CD"}',
    ]
    rows = list(enumerate(bodies)) + [(0, '{"media": [{}]}'), (0, '{"media": [{}]}')]
    df = spark.createDataFrame([(i, b, "x", "y") for i, b in rows] + [(None, '{"media": [{}]}', "x", "y")], "snapshot_id long, body string, level string, json string")
    got = sorted(map(tuple, nested.track_positions(df).collect()))
    assert got == expected_tracks([(i, b) for i, b in rows if b is not None])
    assert nested.track_positions(df.limit(0)).count() == 0


json_values = st.recursive(st.none() | st.booleans() | st.integers(-5, 5) | st.text('a"\\{}[],: é', max_size=5), lambda c: st.lists(c, max_size=4) | st.dictionaries(st.sampled_from(["media", "media_tracks", "item", "x", 'q"']), c, max_size=3), max_leaves=25)


def test_nested_random_documents(spark):
    docs = []

    @given(json_values, st.integers(0, 3))
    @settings(max_examples=300, deadline=None)
    def collect(v, cut):
        text = json.dumps(v if isinstance(v, dict) else {"media": v}, ensure_ascii=False)
        docs.append(text[: len(text) - cut])

    collect()
    df = spark.createDataFrame(list(enumerate(docs)), "snapshot_id long, body string")
    assert sorted(map(tuple, nested.track_positions(df).collect())) == expected_tracks(enumerate(docs))


def test_flat_tables(spark):
    body = json.dumps({"release_title": "", "is_compilation": "true", "media": [{"disc_number": "2", "media_tracks": [{"composer": "A", "track_length": [1, 2], "track_title": None}, {"composer": ["B", "C"]}]}]})
    t = nested.flat_tables(spark.createDataFrame([(7, body)], "snapshot_id long, body string"))
    assert t["releases"].select("release_title", "barcode", "is_compilation").first() == ("", None, True)
    assert t["media"].select("media_idx", "disc_number").first() == (0, 2)
    assert [tuple(r) for r in t["tracks"].orderBy("track_idx").select("track_idx", "composer", "track_length").collect()] == [(0, ["A"], [1, 2]), (1, ["B", "C"], None)]


def test_catalogue_entity(spark):
    from linkspark.operators import adapters

    credit = [{"name": "A", "joinphrase": " & ", "artist": {"id": "a1", "name": "A", "sort-name": "A, The"}}, {"name": "B", "joinphrase": None, "artist": {"id": "v", "name": "B", "sort-name": "B"}}]
    work = {"id": "w1", "title": "Work", "relations": [{"type": "composer", "artist": "C2"}, {"type": "writer", "artist": "W"}]}
    relations_ = [
        {"type": "composer", "direction": "backward", "artist": "C1", "attributes": [], "work": None}, {"type": "performance", "direction": "forward", "artist": None, "attributes": [], "work": work},
        {"type": "instrument", "direction": "backward", "artist": "P", "attributes": ["bass", "solo"], "work": None}, {"type": "mastering", "direction": "backward", "artist": "E", "attributes": [], "work": None},
    ]
    track = {"id": "t1", "number": "A1", "title": "Poinciana", "length": 487533, "artist-credit": credit[:1], "recording": {"id": "r1", "title": "Poinciana", "first-release-date": "1958-01", "isrcs": ["I"], "genres": [{"name": "jazz"}], "relations": relations_}}
    media = [{"position": 1, "title": "", "format": "CD", "track-count": None, "tracks": [track]}, {"position": 2, "title": None, "format": "CD", "track-count": 3, "tracks": []}, {"position": 3, "title": None, "format": "DVD", "track-count": 1, "tracks": []}]
    entity = {"id": "e1", "title": "T", "date": "1958", "status": "Pseudo-Release", "artist-credit": credit, "label-info": [{"catalog-number": None, "label": None}, {"catalog-number": "X1", "label": {"name": "L"}}], "release-group": {"id": "g", "primary-type": "Unknown", "secondary-types": ["nope", "Live"]}, "media": media}
    df = spark.createDataFrame([(1, json.dumps(entity)), (2, json.dumps({"id": "e2"}))], "i int, j string").select("i", F.from_json(F.concat(F.lit('{"e":'), "j", F.lit("}")), f"e {adapters.ENTITY}")["e"].alias("e"))
    fields = adapters.release_of_entity(F.col("e"), various_id="v")
    got = {r.i: r.asDict() for r in df.select("i", *[c.alias(k) for k, c in fields.items()]).collect()}
    one, two = got[1], got[2]
    assert (one["release_artist"], one["release_artist_sort_order"], one["catalog_number"], one["record_label"], one["release_status"], one["release_type"]) == ("A & B", "A, The; B", "X1", "L", "pseudo-release", "live")
    assert (one["release_date"], one["release_year"], one["media_format"], one["total_discs"], one["track_count"], one["is_compilation"], one["musicbrainz_release_artist_id"]) == ("1958-01-01", "1958", "2×CD+DVD", "3", 5, True, "a1")
    assert two["release_artist"] == "" and two["release_type"] is None and two["track_count"] == 0 and two["total_discs"] is None and two["is_compilation"] is False
    t = adapters.tracks_of_entity(df, "i", "e").collect()
    assert len(t) == 1 and (t[0].track_title, t[0].track_artist, t[0].composer, t[0].engineer, t[0].writer, t[0].work_title, t[0].original_release_year) == ("Poinciana", "A & ", ["C1", "C2"], ["E"], ["W"], "Work", "1958")
    assert [tuple(p) for p in t[0].performers] == [("bass, solo", "P")]
    assert [(r.media_idx, r.track_count) for r in adapters.media_of_entity(df, "i", "e").orderBy("media_idx").collect()] == [(0, 1), (1, 3), (2, 1)]


def test_total_cost_of_lists_of_any_size(spark, tmp_path):
    from linkspark.plans import catalogue

    lists = {(1, 0): ["alpha", "beta", "gamma"], (1, 1): ["gamme", "alpha", "bta"], (2, 0): ["river"], (2, 1): ["ash", "rivers", "moss", "rivet"], (3, 0): ["ash", "stone", "moss", "glass"], (3, 1): ["stne", "mos"]}
    rows = [(f"{r}-{m}-{k}", r, m, k, t, None, None, None, None) for (r, m), titles in lists.items() for k, t in enumerate(titles)]
    spark.createDataFrame(rows, "track_id string, release_id long, media_idx int, track_idx int, track_title string, track_artist string, track_number string, track_length array<long>, musicbrainz_recording_id string").write.parquet(f"{tmp_path}/tracks.parquet")
    words = [(t, u) for r in (1, 2, 3) for t in lists[r, 0] for u in lists[r, 1]]
    pairs = spark.createDataFrame(words, "t string, u string")
    cost = {(p.t, p.u): int(p.d * 100000) for p in pairs.select("t", "u", X.normalized_distance(F.col("t"), F.col("u")).alias("d")).collect()}
    want = {}
    for r in (1, 2, 3):
        x, y = lists[r, 0], lists[r, 1]
        pick = [zip(x, p) for p in itertools.permutations(y, len(x))] if len(x) <= len(y) else [zip(p, y) for p in itertools.permutations(x, len(y))]
        want[r, 0] = min(sum(cost[p] for p in chosen) for chosen in pick)
    got = {(g.release_id, g.media_idx): g.total_cost for g in catalogue.QUERIES["q_assignment_total_all"](spark, str(tmp_path)).collect()}
    assert got == want and len(catalogue.QUERIES["q_assignment_total"](spark, str(tmp_path)).collect()) == 1
