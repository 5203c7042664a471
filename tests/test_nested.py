import json
import random

import numpy as np

from linkspark.operators import nested

WHOLE = ['{"a":[1,2.5e-3,{"b":null}],"c":"x\\"y\\\\"}', "[]", "{}", "[[],{},[{}]]", '"s"', "12", "-0.5E+3", "true", '{"a":{"b":{"c":[[[["d"]]]]}}}', '{"k":"\\u00e9\\n"}', ' [ 1 , "a,b:{}[]" ] ', '{"":""}', '[{"a":1},{"a":[]}]']
BROKEN = ["", "   ", "nul", "tru e", "01", "-", "1.", ".5", "1e", "[1,]", '{"a":1,}', "{,}", '{"a"}', '{"a":}', "{1:2}", '["a" "b"]', "[1 2]", '{"a":1 "b":2}', "[}", "{]", "}{", "[1]]", "[[1]", "1 2", "{} {}", '"a\nb"', '"\\x"', '"\\u12g4"', '"abc', "NaN", "[Infinity]", "[,1]", '{"a"::1}', "{:1}", "[1:2]", '{"a":1:2}', ","]


def complete(docs):
    raw = [d.encode() for d in docs]
    real = [i for i, b in enumerate(raw) if b]
    ends = np.cumsum([len(raw[i]) for i in real])
    found = nested.StructuralIndex(np.frombuffer(b"".join(raw), dtype=np.uint8), ends - [len(raw[i]) for i in real], ends).complete()
    out = [False] * len(docs)
    for k, i in enumerate(real):
        out[i] = bool(found[k])
    return out


def parses(text):
    def refuse(_):
        raise ValueError

    try:
        json.loads(text, parse_constant=refuse)
    except ValueError:
        return False
    return True


def test_completeness_agrees_with_a_parser():
    rng = random.Random(1)
    docs = WHOLE + BROKEN
    signs = '{}[]:,"\\ \n01ae.-tnu'
    for _ in range(8000):  # whole documents with characters put in, taken out or replaced
        d = list(rng.choice(WHOLE))
        for _ in range(rng.randrange(1, 4)):
            i = rng.randrange(len(d) + 1)
            d[i : i + rng.randrange(2)] = rng.choice([[], [rng.choice(signs)]])
        docs.append("".join(d))
    docs += ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 9))) for _ in range(4000)]
    assert complete(docs) == [parses(d) for d in docs]


def test_nesting_has_no_limit():
    n = 100_000
    assert complete(["[" * n + "]" * n, "[" * n + "]" * (n - 1), '{"a":' * n + "1" + "}" * n, "7" * n]) == [True, False, True, True]


def test_deep_unknown_members_keep_their_document(spark):
    body = '{"media":[{"media_tracks":[{}]}],"x":' + "[" * 50_000 + "]" * 50_000 + "}"
    assert nested.track_positions(spark.createDataFrame([(1, body)], "snapshot_id long, body string")).collect() == [(1, 0, 0)]


def test_all_declared_fields_of_lone_and_listed_values(spark):
    track = {"track_title": "T", "composer": "One", "genre": ["a", "b"], "performers": [["voice", "X"], ["", "Y"]], "track_length": [61, 5], "rating": 5, "lyrics": "", "mood": None}
    body = json.dumps({"item": {"release_title": "R", "asin": "A1", "is_compilation": "true", "media": {"disc_number": "2", "gapless_playback": False, "media_tracks": track}}})
    tables = nested.flat_tables(spark.createDataFrame([(7, body)], "snapshot_id long, body string"))
    assert [len(tables[k].columns) for k in ("releases", "media", "tracks")] == [1 + 23, 2 + 5, 3 + 60]
    r, m, t = (tables[k].first() for k in ("releases", "media", "tracks"))
    assert (r.release_title, r.asin, r.is_compilation, r.barcode) == ("R", "A1", True, None) and (m.disc_number, m.gapless_playback) == (2, False)
    assert (t.composer, t.genre, t.performers, t.track_length) == (["One"], ["a", "b"], [["voice", "X"], ["", "Y"]], [61, 5])
    assert (t.rating, t.lyrics, t.mood, t.isrc) == ("5", "", None, None)
