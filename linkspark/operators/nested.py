"""Flatten nested JSON records (entity > parts > items) into related tables by vectorised structural indexing.

For a block of bodies one numpy pass builds the bitmaps of unescaped quotes, brackets and delimiters, turns quotes
into an in-string mask by a running parity, nesting depth into a prefix sum, and reads every parent-child link off
the positions. Whether a body is one complete document is told from the same tokens: by what may follow what in which
container, at any depth. No record is parsed or walked in Python.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkspark.sources import snapshots

#: Bytes indexed at once; bounds the working memory of a task. A longer single body is indexed alone.
BLOCK_BYTES = 2_000_000

QUOTE, BACKSLASH, COLON, COMMA = 34, 92, 58, 44
OPEN_OBJECT, CLOSE_OBJECT, OPEN_LIST, CLOSE_LIST = 123, 125, 91, 93
#: Levels below the root that may hold a link: envelope, list of parts, part, list of items, item.
LINK_LEVELS = 6

LINK_SCHEMA = "id long, level string, media_idx int, track_idx int, json string"


def _scalar_automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state by state and byte, accepting states) of numbers, true, false and null; state 0 refuses for good."""
    states = ["refuse", "start", "minus", "zero", "whole", "point", "fraction", "e", "sign", "exponent"]
    step = np.zeros((len(states) + 13, 256), dtype=np.uint8)
    at = {name: i for i, name in enumerate(states)}
    digits, nonzero = list(b"0123456789"), list(b"123456789")

    def go(source: str, chars, target: str) -> None:
        step[at[source], list(chars)] = at[target]

    go("start", b"-", "minus")
    for source in ("start", "minus"):
        go(source, b"0", "zero")
        go(source, nonzero, "whole")
    go("whole", digits, "whole")
    for source in ("zero", "whole"):
        go(source, b".", "point")
        go(source, b"eE", "e")
    for source in ("point", "fraction"):
        go(source, digits, "fraction")
    go("fraction", b"eE", "e")
    go("e", b"+-", "sign")
    for source in ("e", "sign", "exponent"):
        go(source, digits, "exponent")
    accepting = np.zeros(len(step), dtype=bool)
    accepting[[at["zero"], at["whole"], at["fraction"], at["exponent"]]] = True
    free = len(states)
    for word in (b"true", b"false", b"null"):
        state = at["start"]
        for byte in word:
            step[state, byte] = free
            state, free = free, free + 1
        accepting[state] = True
    return step, accepting


SCALAR_STEP, SCALAR_ENDS = _scalar_automaton()
HEX = np.zeros(256, dtype=bool)
HEX[list(b"0123456789abcdefABCDEF")] = True
ESCAPABLE = np.zeros(256, dtype=bool)
ESCAPABLE[list(b'"\\/bfnrtu')] = True
BLANK = np.zeros(256, dtype=bool)
BLANK[list(b" \t\n\r")] = True


class StructuralIndex:
    """Tokens of many concatenated bodies: position, kind, nesting depth, document and enclosing token of each."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.data, self.starts, self.ends = data, starts, ends
        n = len(data)
        at = np.arange(n, dtype=np.int32)
        slash = data == BACKSLASH
        plain_before = np.maximum.accumulate(np.where(slash, -1, at)) if n else at
        plain_before = np.maximum(plain_before, np.repeat(starts - 1, ends - starts))  # no run reaches into the next document
        quote = data == QUOTE
        where = np.flatnonzero(quote)
        before = where - 1
        run = np.where((before >= 0) & ~np.isin(where, starts), before - plain_before[np.maximum(before, 0)], 0)
        quote[where[run % 2 == 1]] = False
        parity = np.cumsum(quote, dtype=np.int32)
        #: Backslashes that begin an escape: every other one of a run.
        where = np.flatnonzero(slash)
        self.escape = where[(where - plain_before[where]) % 2 == 1] if len(where) else where

        kind = np.zeros(256, dtype=bool)
        kind[[QUOTE, COLON, COMMA, OPEN_OBJECT, CLOSE_OBJECT, OPEN_LIST, CLOSE_LIST]] = True
        pos = np.flatnonzero(kind[data])
        pos = pos[(data[pos] != QUOTE) | quote[pos]]
        doc = np.searchsorted(starts, pos, side="right") - 1
        base = np.where(starts > 0, parity[np.maximum(starts - 1, 0)], 0) if n else starts
        odd = (parity[pos] - base[doc]) & 1
        is_quote = data[pos] == QUOTE
        opening = is_quote & (odd == 1)
        closing = is_quote & (odd == 0)
        keep = opening | (~is_quote & (odd == 0))

        #: Whether a byte stands in a string, its quotes included.
        before = np.repeat(base, ends - starts) if n else parity
        self.inside = ((parity - before) & 1 == 1) | quote
        self.unclosed = np.zeros(len(starts), dtype=bool)
        if n:
            self.unclosed = (parity[ends - 1] - base) & 1 == 1

        self.string_end = np.full(len(pos), -1, dtype=np.int64)
        close_at = np.where(closing, pos, n)
        if len(pos):
            self.string_end = np.minimum.accumulate(close_at[::-1])[::-1]
        self.pos, self.doc = pos[keep], doc[keep]
        self.string_end = self.string_end[keep]
        self.char = data[self.pos]
        opens = (self.char == OPEN_OBJECT) | (self.char == OPEN_LIST)
        closes = (self.char == CLOSE_OBJECT) | (self.char == CLOSE_LIST)
        delta = opens.astype(np.int32) - closes
        after = np.cumsum(delta)
        first = np.searchsorted(self.doc, np.arange(len(starts)))
        last = np.searchsorted(self.doc, np.arange(len(starts)), side="right")
        self.first, self.last = first, last
        total = np.concatenate([[0], after])
        after = after - total[first][self.doc] if len(after) else after
        #: Depth of the container that holds the token; 0 for the root value.
        self.depth = after - opens
        self.balanced = (total[last] - total[first] == 0) & (last > first)
        self.parent = np.full(len(self.pos), -1, dtype=np.int64)
        index = np.arange(len(self.pos))
        for level in range(1, LINK_LEVELS + 1):
            holder = np.maximum.accumulate(np.where(opens & (self.depth == level - 1), index, -1)) if len(index) else index
            here = self.depth == level
            self.parent[here] = holder[here]

    def end_of(self, token: np.ndarray) -> np.ndarray:
        """Position just after the container that opens at ``token``."""
        closes = (self.char == CLOSE_OBJECT) | (self.char == CLOSE_LIST)
        out = np.empty(len(token), dtype=np.int64)
        for level in np.unique(self.depth[token]):
            at = np.flatnonzero(closes & (self.depth == level))
            here = self.depth[token] == level
            out[here] = self.pos[at[np.searchsorted(at, token[here])]] + 1
        return out

    def complete(self) -> np.ndarray:
        """Whether each document is one complete JSON value, at any depth of nesting."""
        data, n = self.data, len(self.data)
        good = ~self.unclosed
        doc_of = np.repeat(np.arange(len(self.starts)), self.ends - self.starts)

        def refuse(at: np.ndarray) -> None:
            good[doc_of[at]] = False

        refuse(np.flatnonzero(self.inside & (data < 32)))
        follow = np.minimum(self.escape + 1, n - 1)
        refuse(self.escape[~ESCAPABLE[data[follow]]])
        wide = self.escape[data[follow] == 117]
        for k in range(2, 6):
            at = np.minimum(wide + k, n - 1)
            refuse(wide[~HEX[data[at]] | (wide + k >= n)])

        # runs of bytes outside of strings that are neither blank nor structural are numbers and constants
        structural = np.zeros(256, dtype=bool)
        structural[[COLON, COMMA, OPEN_OBJECT, CLOSE_OBJECT, OPEN_LIST, CLOSE_LIST]] = True
        word = ~self.inside & ~BLANK[data] & ~structural[data]
        for k, byte in enumerate(b"\xef\xbb\xbf"):  # a byte order mark may stand before the document
            word[self.starts[(self.ends - self.starts > 3) & (data[np.minimum(self.starts + k, n - 1)] == byte)] + k] = False
        first = np.zeros(n, dtype=bool)
        first[self.starts] = True
        begins = np.flatnonzero(word & (first | ~np.append(False, word[:-1])))
        last = np.append(first[1:], True)
        stops = np.flatnonzero(word & (last | ~np.append(word[1:], False))) + 1
        state = np.ones(len(begins), dtype=np.uint8)
        active, k = np.arange(len(begins)), 0
        while len(active):
            state[active] = SCALAR_STEP[state[active], data[begins[active] + k]]
            k += 1
            active = active[(stops[active] - begins[active] > k) & (state[active] > 0)]
        refuse(begins[~SCALAR_ENDS[state]])

        # all tokens in order, each with the container it stands in: the last one opened a level above
        pos = np.concatenate([self.pos, begins])
        order = np.argsort(pos, kind="stable")
        pos = pos[order]
        char = np.concatenate([self.char, np.full(len(begins), 48, dtype=np.uint8)])[order]
        doc = doc_of[pos] if n else pos
        opens = (char == OPEN_OBJECT) | (char == OPEN_LIST)
        closes = (char == CLOSE_OBJECT) | (char == CLOSE_LIST)
        after = np.cumsum(opens.astype(np.int32) - closes)
        head = np.append(True, doc[1:] != doc[:-1]) if len(doc) else np.zeros(0, dtype=bool)
        begin = np.flatnonzero(head)
        before = np.append(0, after[:-1])[begin] if len(doc) else after
        depth = after - np.repeat(before, np.diff(np.append(begin, len(doc)))) if len(doc) else after
        level = np.where(opens, depth - 1, np.where(closes, depth + 1, depth))  # of the container a token stands in or closes
        good[doc[depth < 0]] = False
        where = np.flatnonzero(opens)
        at = np.concatenate([np.arange(len(pos)), where])
        height = np.concatenate([level, depth[where]])
        # the opening of a level comes just before the tokens in it
        rank = np.lexsort((np.concatenate([np.ones(len(pos)), np.zeros(len(where))]), at, height))
        opened = np.where(rank >= len(pos), at[rank], -1)
        opened = np.maximum.accumulate(np.where(rank >= len(pos), np.arange(len(rank)), -1)) if len(rank) else opened
        holder = np.full(len(pos), -1, dtype=np.int64)
        token = rank < len(pos)
        found = opened[token]
        source = np.where(found >= 0, at[rank[np.maximum(found, 0)]], -1)
        mine = rank[token]
        holder[mine] = np.where((source >= 0) & (height[rank[np.maximum(found, 0)]] == level[mine]), source, -1)
        kind = np.where((holder >= 0) & (level > 0), char[np.maximum(holder, 0)], 0)
        in_object, in_list = kind == OPEN_OBJECT, kind == OPEN_LIST

        prev = np.append(0, char[:-1])
        prev[head] = 0
        string, scalar = char == QUOTE, char == 48
        key = string & in_object & ((prev == OPEN_OBJECT) | (prev == COMMA))
        value = (string | scalar | opens) & ~key
        ends_value = (string & ~key) | scalar | closes
        prev_ends = np.append(False, ends_value[:-1]) & ~head
        prev_key = np.append(False, key[:-1]) & ~head
        fine = key | (value & (head | (prev == COLON) | (in_list & ((prev == OPEN_LIST) | (prev == COMMA)))))
        fine |= (char == COLON) & prev_key
        fine |= (char == COMMA) & prev_ends & (level > 0)
        fine |= (char == CLOSE_OBJECT) & in_object & ((prev == OPEN_OBJECT) | prev_ends)
        fine |= (char == CLOSE_LIST) & in_list & ((prev == OPEN_LIST) | prev_ends)
        good[doc[~fine]] = False
        final = np.append(head[1:], True) if len(head) else head
        good[doc[final & ~(ends_value & (depth == 0))]] = False
        present = np.zeros(len(good), dtype=bool)
        present[doc] = True
        return good & present

    def member(self, name: str) -> tuple[np.ndarray, np.ndarray]:
        """(holder token, value token) of each member ``name``; the last one counts where a holder repeats it."""
        word = np.frombuffer(name.encode(), dtype=np.uint8)
        n = len(self.pos)
        key = np.flatnonzero((self.char[: max(n - 2, 0)] == QUOTE) & (self.char[1 : max(n - 1, 1)] == COLON)) if n > 2 else np.array([], dtype=np.int64)
        key = key[self.doc[key] == self.doc[key + 2]]
        start, length = self.pos[key] + 1, self.string_end[key] - self.pos[key] - 1
        same = length == len(word)
        candidate, at = key[same], start[same]
        for i, byte in enumerate(word):
            hit = self.data[at + i] == byte
            candidate, at = candidate[hit], at[hit]
        escaped = [k for k, s, m in zip(key[length > len(word)], start[length > len(word)], length[length > len(word)]) if self._spells(s, m, name)]
        if escaped:
            candidate = np.sort(np.concatenate([candidate, np.array(escaped, dtype=np.int64)]))
        holder = self.parent[candidate]
        found = holder >= 0
        candidate, holder = candidate[found], holder[found]
        if len(candidate):
            order = np.argsort(holder, kind="stable")
            holder, candidate = holder[order], candidate[order]
            final = np.append(holder[1:] != holder[:-1], True)
            holder, candidate = holder[final], candidate[final]
        return holder, candidate + 2

    def _spells(self, start: int, length: int, name: str) -> bool:
        """Whether the letters of an ASCII name stand there, some of them as escapes of four digits."""
        if length > 6 * len(name):
            return False
        return re.sub(rb"\\u00([0-9a-fA-F]{2})", lambda m: bytes([int(m.group(1), 16)]), self.data[start : start + length].tobytes()) == name.encode()

    def objects_of(self, holder: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(owner, object token, position) of the objects in each value: list elements by position, a lone object at 0."""
        lone = self.char[value] == OPEN_OBJECT
        lists = self.char[value] == OPEN_LIST
        owner_of = np.full(len(self.pos), -1, dtype=np.int64)
        owner_of[value[lists]] = holder[lists]
        inside = np.flatnonzero((self.parent >= 0) & ((self.char == COMMA) | (self.char == OPEN_OBJECT)))
        inside = inside[owner_of[self.parent[inside]] >= 0]
        inside = inside[np.argsort(self.parent[inside], kind="stable")]
        commas = (self.char[inside] == COMMA).astype(np.int64)
        running = np.cumsum(commas)
        group = self.parent[inside]
        begin = np.append(True, group[1:] != group[:-1]) if len(group) else np.array([], dtype=bool)
        base = (running - commas)[np.flatnonzero(begin)]
        place = running - base[np.cumsum(begin) - 1] if len(group) else running
        is_object = self.char[inside] == OPEN_OBJECT
        token = np.concatenate([inside[is_object], value[lone]])
        owner = np.concatenate([owner_of[group[is_object]], holder[lone]])
        at = np.concatenate([place[is_object], np.zeros(lone.sum(), dtype=np.int64)])
        order = np.argsort(token, kind="stable")
        return owner[order], token[order], at[order]


def _links(data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, parts: str, items: str, envelope: str, spans: bool, levels: set[str]) -> Iterator[pa.RecordBatch]:
    starts, ends = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
    data = data[offsets[0] : offsets[-1]]
    # searchsorted by start must not meet two documents with one start
    real = ends > starts
    starts, ends, ids = starts[real], ends[real], ids[real]
    if not len(starts):
        return
    ix = StructuralIndex(data, starts, ends)
    if not len(ix.char):
        return
    whole = ix.balanced & ix.complete() & (ix.char[np.minimum(ix.first, len(ix.char) - 1)] == OPEN_OBJECT)
    root = np.full(len(starts), -1, dtype=np.int64)
    root[whole] = ix.first[whole]
    holder, value = ix.member(envelope)
    enveloped = np.zeros(len(starts), dtype=np.int64) - 1
    ok = (ix.depth[holder] == 0) & (ix.char[value] == OPEN_OBJECT)
    enveloped[ix.doc[holder[ok]]] = value[ok]
    part_holder, part_value = ix.member(parts)
    direct = np.zeros(len(starts), dtype=bool)
    direct[ix.doc[part_holder[ix.depth[part_holder] == 0]]] = True
    entity = np.where(direct | (enveloped < 0) | (root < 0), root, enveloped)

    is_entity = np.zeros(len(ix.pos) + 1, dtype=bool)
    is_entity[entity[entity >= 0]] = True
    take = is_entity[part_holder]
    p_owner, p_token, p_at = ix.objects_of(part_holder[take], part_value[take])
    part_at = np.full(len(ix.pos), -1, dtype=np.int64)
    part_at[p_token] = p_at
    item_holder, item_value = ix.member(items)
    take = part_at[item_holder] >= 0
    i_owner, i_token, i_at = ix.objects_of(item_holder[take], item_value[take])

    # the span of an object leaves out the list of its children, which have spans of their own
    child = np.full(len(ix.pos), -1, dtype=np.int64)
    for holders, values in ((part_holder, part_value), (item_holder, item_value)):
        nested = (ix.char[values] == OPEN_LIST) | (ix.char[values] == OPEN_OBJECT)
        child[holders[nested]] = values[nested]

    def rows(level: str, token: np.ndarray, part: np.ndarray, item: np.ndarray) -> pa.RecordBatch:
        text = pa.nulls(len(token), pa.string())
        if spans and len(token):
            stop = ix.end_of(token)
            inner = child[token] if level in ("release", "media") else np.full(len(token), -1)
            cut = np.where(inner >= 0, ix.pos[inner], stop)
            resume = stop.copy()
            resume[inner >= 0] = ix.end_of(inner[inner >= 0])
            out = []
            for a, b, c, d in zip(ix.pos[token], cut, resume, stop):
                piece = data[a:b].tobytes() if b == d else data[a:b].tobytes() + b"null" + data[c:d].tobytes()
                out.append(piece.decode("utf-8", "replace"))
            text = pa.array(out, pa.string())
        return pa.RecordBatch.from_arrays([pa.array(ids[ix.doc[token]], pa.int64()), pa.array([level] * len(token), pa.string()), pa.array(part, pa.int32()), pa.array(item, pa.int32()), text], names=["id", "level", "media_idx", "track_idx", "json"])

    has_items = np.zeros(len(ix.pos), dtype=bool)
    has_items[i_owner] = True
    bare = ~has_items[p_token]
    entity = entity[entity >= 0]
    none = lambda token: np.full(len(token), -1)
    found = {"release": (entity, none(entity), none(entity)), "media": (p_token, p_at, none(p_token)), "track": (i_token, part_at[i_owner], i_at), "bare": (p_token[bare], p_at[bare], none(p_token[bare]))}
    for level in levels:
        yield rows(level, *found[level])


def nested_links(df: DataFrame, id_col: str, body_col: str, parts: str = "media", items: str = "media_tracks", envelope: str = "item", spans: bool = True, levels: tuple[str, ...] = ("release", "media", "track", "bare")) -> DataFrame:
    """Rows of ``id, level, media_idx, track_idx, json``: one for each release, medium and track of a body.

    ``level`` is ``release``, ``media``, ``track`` or ``bare`` (a medium without tracks, once more). Indexes are 0-based
    positions, -1 where a level has none; ``json`` is the span of the object without its children, null unless
    ``spans``; ``levels`` names the levels that are wanted. A lone object in
    place of a list has position 0. An entity may stand in the member ``envelope`` of the root. Null, empty, cut-off or
    otherwise incomplete bodies, and bodies whose root is no object, give no row. List elements that are no objects
    count as positions but give no row. Of a repeated member the last counts. Repeated ids give rows each.
    """

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            body = batch.column(1)
            body = body.cast(pa.large_string()).fill_null("")
            offsets = np.frombuffer(body.buffers()[1], dtype=np.int64, count=len(body) + 1 + body.offset)[body.offset :]
            raw = body.buffers()[2]
            data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
            begin = 0
            while begin < len(body):
                stop = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + BLOCK_BYTES, side="right")) - 1)
                yield from _links(data, offsets[begin : stop + 1], ids[begin:stop], parts, items, envelope, spans, set(levels))
                begin = stop

    return df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long"), F.col(body_col).cast("string")).mapInArrow(index, LINK_SCHEMA)


def track_positions(df: DataFrame, id_col: str = "snapshot_id", body_col: str = "body") -> DataFrame:
    """``snapshot_id, media_idx, track_idx`` of every track, and of every medium without tracks with track_idx -1."""
    links = nested_links(df, id_col, body_col, spans=False, levels=("track", "bare"))
    return links.select(F.col("id").alias(id_col), "media_idx", "track_idx")


def _typed(name: str, kind: str) -> Column:
    """A member, given as text, in its declared type: a lone value in place of a list becomes a list of one."""
    raw = F.col(f"`{name}`")
    if kind.startswith("array"):
        lone = F.array(F.array(raw)) if kind.startswith("array<array") else F.array(raw)
        raw = F.when(raw.startswith("["), F.from_json(raw, kind)).when(raw.isNotNull(), lone.try_cast(kind))
    elif kind != "string":
        raw = raw.try_cast(kind)
    return raw.alias(name)


RELEASE = {c: "string" for c in snapshots.RELEASE_TEXTS} | {"is_compilation": "boolean"}
MEDIA = {"disc_number": "int", "media_title": "string", "media_format": "string", "musicbrainz_disc_id": "string", "gapless_playback": "boolean"}
TRACK = {c: "string" for c in snapshots.TRACK_TEXTS} | {c: "array<string>" for c in snapshots.TRACK_LISTS} | {"performers": "array<array<string>>", "track_length": "array<bigint>"}


def flat_table(df: DataFrame, name: str, id_col: str = "snapshot_id", body_col: str = "body") -> DataFrame:
    """The table ``releases``, ``media`` or ``tracks`` of the bodies, linked by ``snapshot_id, media_idx, track_idx``.

    It has all declared fields. Numbers written as strings are cast, a lone string in place of a list becomes a list of
    one, values that fit no declared type become null; null and ``""`` stay different. Each span is parsed once.
    """
    level, keys, fields = {"releases": ("release", [], RELEASE), "media": ("media", ["media_idx"], MEDIA), "tracks": ("track", ["media_idx", "track_idx"], TRACK)}[name]
    texts = ", ".join(f"{f} string" for f in fields)
    rows = nested_links(df, id_col, body_col, levels=(level,)).select(F.col("id").alias(id_col), *keys, F.inline(F.array(F.from_json("json", texts))))
    return rows.select(id_col, *keys, *[_typed(f, kind) for f, kind in fields.items()])


def flat_tables(df: DataFrame, id_col: str = "snapshot_id", body_col: str = "body") -> dict[str, DataFrame]:
    """All three tables by name (see ``flat_table``)."""
    return {name: flat_table(df, name, id_col, body_col) for name in ("releases", "media", "tracks")}
