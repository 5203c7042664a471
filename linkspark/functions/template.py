"""Path templates compiled to Column expressions: variables, conditions, helpers, and escaping of path characters."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkspark.functions import text as X

#: Helpers by name; each takes its value and named arguments, of which it ignores unknown ones.
HELPERS: dict[str, Callable[..., Column]] = {}


def helper(fn: Callable[..., Column]) -> Callable[..., Column]:
    HELPERS[fn.__name__] = fn
    return fn


@helper
def zfill(value: Column, width: Column | None = None, **_: Column) -> Column:
    return X.zfill(value, width) if width is not None else value.cast("string")


TAG = re.compile(r"\{\{(#if|/if|else)?\s*([^{}]*?)\s*\}\}")


class TemplateError(ValueError):
    pass


def _argument(word: str, values: dict[str, Column]) -> Column:
    if re.fullmatch(r"-?\d+", word):
        return F.lit(int(word))
    if word.startswith('"') and word.endswith('"'):
        return F.lit(word[1:-1])
    if word not in values:
        raise TemplateError(f"unknown variable: {word}")
    return values[word]


def _truthy(c: Column) -> Column:
    """Neither null nor empty, zero or false."""
    return F.coalesce(~c.cast("string").isin("", "0", "false"), F.lit(False))


def compile_template(template: str, values: dict[str, Column]) -> Column:
    """String column of the template; a variable it names but ``values`` lacks is an error, a null value gives null."""
    stack: list[tuple[Column | None, list[Column], list[Column] | None]] = [(None, [], None)]
    at = 0

    def add(c: Column) -> None:
        condition, yes, no = stack[-1]
        (yes if no is None else no).append(c)

    def joined(parts: list[Column]) -> Column:
        return F.concat(*parts) if parts else F.lit("")

    for m in TAG.finditer(template):
        if m.start() > at:
            add(F.lit(template[at : m.start()]))
        at = m.end()
        kind, body = m.groups()
        if kind == "#if":
            stack.append((_truthy(_argument(body, values)), [], None))
        elif kind == "else":
            condition, yes, no = stack.pop()
            if condition is None or no is not None:
                raise TemplateError("else without if")
            stack.append((condition, yes, []))
        elif kind == "/if":
            condition, yes, no = stack.pop()
            if condition is None:
                raise TemplateError("end without if")
            add(F.when(condition, joined(yes)).otherwise(joined(no or [])))
        else:
            words = re.findall(r'(?:\w+=)?(?:"[^"]*"|\S+)', body)
            if len(words) == 1:
                value = _argument(words[0], values).cast("string")
            elif words and words[0] in HELPERS:
                named = dict(w.split("=", 1) for w in words[2:])
                value = HELPERS[words[0]](_argument(words[1], values), **{k: _argument(v, values) for k, v in named.items()})
            else:
                raise TemplateError(f"unknown helper: {body}")
            add(X.escape_path_chars(value))
    if len(stack) != 1:
        raise TemplateError("if without end")
    if at < len(template):
        add(F.lit(template[at:]))
    return joined(stack[0][1])


def formatted_path(template: str, values: dict[str, Column], extension: Column, prefix: str = "") -> Column:
    """The path with its extension added after a dot, below a prefix."""
    out = F.concat(compile_template(template, values), F.lit("."), extension)
    return F.concat(F.lit(prefix.rstrip("/") + "/"), out) if prefix else out


#: Fixed value: default template of album paths. The disc number is not padded, as its helper has no width there.
ALBUM_FORMAT = "{{album_artist}}/{{#if year}}{{zfill year width=4}} - {{/if}}{{album_title}}/{{#if disc_number}}{{zfill disc_number number=disc_count_width}}-{{/if}}{{zfill track_index width=track_count_width}} - {{track_title}}"
#: Fixed value: default template of paths of compilations.
COMPILATION_FORMAT = "{{album_artist}}/{{#if year}}{{zfill year width=4}} - {{/if}}{{album_title}}/{{#if disc_index}}{{zfill disc_index width=disc_count_width}}-{{/if}}{{zfill track_index width=track_count_width}} - {{artist_credit}} - {{track_title}}"
