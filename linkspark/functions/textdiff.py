"""Character diff and terminal layout of text, as Arrow UDFs: Catalyst has neither."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

EDIT = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("op", "old", "new")]))


def shortest_edit(a: str, b: str) -> list[tuple[str, str, str]]:
    """Segments of a shortest edit of ``a`` into ``b`` (greedy search by diagonals): equal, delete, insert, replace."""
    n, m = len(a), len(b)
    reach = {1: 0}
    trace = []
    for d in range(n + m + 1):
        trace.append(dict(reach))
        for k in range(-d, d + 1, 2):
            x = reach[k + 1] if k == -d or (k != d and reach[k - 1] < reach[k + 1]) else reach[k - 1] + 1
            y = x - k
            while x < n and y < m and a[x] == b[y]:
                x, y = x + 1, y + 1
            reach[k] = x
            if x >= n and y >= m:
                break
        else:
            continue
        break
    steps: list[tuple[str, str]] = []
    x, y = n, m
    for d in range(len(trace) - 1, -1, -1):
        reach, k = trace[d], x - y
        before = k + 1 if k == -d or (k != d and reach.get(k - 1, -1) < reach.get(k + 1, -1)) else k - 1
        px = reach.get(before, 0)
        py = px - before
        while x > px and y > py and x > 0 and y > 0:
            steps.append(("equal", a[x - 1]))
            x, y = x - 1, y - 1
        if d:
            steps.append(("insert", b[y - 1]) if x == px else ("delete", a[x - 1]))
            x, y = px, py
    out: list[tuple[str, str, str]] = []
    old = new = same = ""
    for op, ch in [*reversed(steps), ("end", "")]:
        if op != "equal" and same:
            out.append(("equal", same, same))
            same = ""
        if op in ("equal", "end") and (old or new):
            out.append(("replace" if old and new else "delete" if old else "insert", old, new))
            old = new = ""
        if op == "equal":
            same += ch
        elif op == "delete":
            old += ch
        elif op == "insert":
            new += ch
    return out


def display_width(text: str) -> int:
    """Terminal cells: wide East Asian characters take two, combining and invisible ones none."""
    return sum(0 if unicodedata.combining(c) or unicodedata.category(c) in ("Cf", "Cc") else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def split_at_width(text: str, width: int) -> tuple[str, str]:
    used = 0
    for i, c in enumerate(text):
        used += display_width(c)
        if used > width:
            return text[:i], text[i:]
    return text, ""


def wrap(text: str, width: int) -> list[str]:
    """Lines of at most ``width`` cells, broken anywhere; a wider character has a line of its own."""
    lines = []
    while text:
        line, rest = split_at_width(text, width)
        if not line:
            line, rest = text[0], text[1:]
        lines.append(line)
        text = rest
    return lines


def fill_right(text: str, width: int) -> str:
    return text + " " * max(0, width - display_width(text))


def ellipsize(text: str, width: int) -> str:
    if display_width(text) <= width:
        return text
    return split_at_width(text, max(width - 1, 0))[0] + "…" if width > 0 else ""


def two_columns(left: str, right: str, width: int, height: int = 0, gap: str = " | ") -> list[str]:
    """Both texts wrapped side by side; ``height`` limits the lines, 0 does not."""
    each = max(1, (width - display_width(gap)) // 2)
    a, b = wrap(left, each), wrap(right, each)
    n = max(len(a), len(b)) if not height else min(height, max(len(a), len(b)))
    return [fill_right(a[i] if i < len(a) else "", each) + gap + fill_right(b[i] if i < len(b) else "", each) for i in range(n)]


@F.pandas_udf(EDIT)
def text_diff(a: pd.Series, b: pd.Series) -> pd.Series:
    """Edit segments; a missing side counts as the placeholder "<missing>"."""
    return pd.Series([[{"op": o, "old": x, "new": y} for o, x, y in shortest_edit("<missing>" if p is None else p, "<missing>" if q is None else q)] for p, q in zip(a, b)])


@F.pandas_udf(T.IntegerType())
def text_width(a: pd.Series) -> pd.Series:
    return a.map(lambda v: None if v is None else display_width(v)).astype("Int32")


@F.pandas_udf(T.ArrayType(T.StringType()))
def text_lines(a: pd.Series, width: pd.Series) -> pd.Series:
    return pd.Series([None if v is None else wrap(v, int(w)) for v, w in zip(a, width)])


@F.pandas_udf(T.StringType())
def text_ellipsis(a: pd.Series, width: pd.Series) -> pd.Series:
    return pd.Series([None if v is None else ellipsize(v, int(w)) for v, w in zip(a, width)])


@F.pandas_udf(T.StringType())
def text_filled(a: pd.Series, width: pd.Series) -> pd.Series:
    return pd.Series([None if v is None else fill_right(v, int(w)) for v, w in zip(a, width)])
