"""Variant spellings of names: merge-and-rematch resolution.

Names become canonical tokens (typos join the spelling they are one edit from), and one token of a name is its core
(the family of a person, the proper name of a group or label). Names of equal tokens are the first profiles. Profiles
then meet in blocks of core and initials; a shorter one (initial, abbreviation, nickname) merges with the one fuller
profile it fits, the merged profile has the spellings and initials of both, and re-enters blocking until no profile
merges any more. Which words name kinds of groups and which given names are familiar forms of others is learned from
the corpus, beside short general lists.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkspark.llm.encoding import garbled_values
from linkspark.llm.links import cells, components
from linkspark.llm.lookalikes import consistent
from linkspark.runtime import forget, written

#: Forms of address, legal forms and articles that name nobody.
ADDRESS = set("dr prof sir dame mr mrs ms maestro dj mc don проф др маэстро".split())
LEGAL = set("ltd limited gmbh inc intl international llc kg ag srl plc oy ab".split())
ARTICLES = {"the"}
#: Words that join the parts of a name.
CONJUNCTIONS = set("and und et".split())
#: Short forms of kinds of groups that are no beginnings of the word.
GROUP_SHORT = {"gebr": "bruder", "gebruder": "bruder", "bros": "brothers"}
#: Words for kinds of ensembles and companies and their articles in common languages; a lone initial never
#: stands for one. Others are learned (``kind_words``).
GROUP_WORDS = set(
    "trio quartet quartett quartetto quatuor cuarteto kvartet quintet quintett sextet septet octet ensemble orchestra orquesta orquestra orchestre orchester orkester philharmonic philharmonie symphony sinfonia "
    "chor choir chorus choeur coro kor kammerchor kammerorchester band group gruppe grupo brothers sisters bruder schwestern hermanos irmaos freres fratelli company compagnie gesellschaft society "
    "records recordings music musik musique musica tapes disques discos dischi edition editions ediciones editora verlag works sound sounds studio studios entertainment productions schallplatten phonographic publishing "
    "the los las les die der das el la le il gli os as".split()
)
#: Letters that decomposition leaves whole.
WHOLE_LETTERS = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "ð": "d", "ı": "i"})
#: Common English familiar forms of given names. Ambiguous ones and those of other languages are learned
#: (``learned_nicknames``).
NICKNAMES = dict(p.split(":") for p in (
    "abby:abigail alex:alexander andy:andrew bella:isabella beth:elizabeth betty:elizabeth bill:william billy:william bob:robert bobby:robert charlie:charles chris:christopher chuck:charles dan:daniel dave:david "
    "debbie:deborah dick:richard dolly:dorothy dot:dorothy dottie:dorothy eddie:edward edie:edith frank:francis fred:frederick gabe:gabriel gene:eugene greg:gregory hank:henry harry:henry jack:john jenny:jennifer "
    "jim:james jimmy:james jon:jonathan kate:katherine kathy:katherine ken:kenneth kit:christopher larry:lawrence leo:leonardo liz:elizabeth maggie:margaret meg:margaret mike:michael nat:nathaniel nate:nathaniel "
    "nick:nicholas ollie:oliver peggy:margaret penny:penelope rick:richard rob:robert ron:ronald sam:samuel sandy:alexandra sasha:alexander steve:stephen sue:susan theo:theodore tom:thomas tony:anthony vic:victoria "
    "vicky:victoria will:william zach:zachary zack:zachary").split())

#: An initial or abbreviation that fits several profiles joins the one with this many times the rows of the next.
DOMINANCE = 4.0
#: Words of a name beyond which it is a text, not a name: it is its own core and pairs its words with nothing.
MAX_WORDS = 40
#: Letters of a word from which typos meet on its first and last letters instead of on deletions; both are exact.
LONG_WORD = 64
#: Probability by chance below which a given name that always stands beside another one is its familiar form; with
#: other first letters, and beside a longer beginning that few given names share.
CHANCE, CHANCE_SAME_LETTER = 1e-4, 2e-3
#: Times a word would stand alone behind a comma if it were a given name, from which never standing there tells that
#: it is none.
EXPECTED_BEHIND_COMMA = 5.0
#: Pairs of a block from which it is cut into cells; changes no result.
HEAVY = 20_000


def name_tokens(name: str) -> list[str]:
    """Sorted folded tokens of a name without forms of address, legal forms, articles and middle initials."""
    text = unicodedata.normalize("NFKD", consistent(name).casefold()).translate(WHOLE_LETTERS)
    text = "".join(c for c in text if not unicodedata.combining(c)).replace("'", "").replace("’", "")
    every = re.findall(r"[^\W_]+", text)
    cut = set(re.findall(r"([^\W_]+)\.", text)) & (ARTICLES | CONJUNCTIONS)  # "The." is short for a given name
    tokens = [t for t in every if t not in ADDRESS and t not in LEGAL and (t not in ARTICLES | CONJUNCTIONS or t in cut)] or every
    tokens = [GROUP_SHORT.get(t, t) for t in tokens]
    if sum(len(t) > 1 for t in tokens) > 1:
        tokens = [t for t in tokens if len(t) > 1]
    return sorted(tokens)


def one_edit(a: str, b: str) -> bool:
    """Whether one insertion, deletion, substitution or swap of neighbours turns ``a`` into ``b``."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i:] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])


def abbreviates(short: str, full: str, field: str, kind: bool = False) -> bool:
    """Whether one token is an initial or abbreviation of the other; ``kind`` tells that ``full`` names a kind of group."""
    if short == full or len(short) >= len(full) or short[0] != full[0]:
        return False
    kind = kind or full in GROUP_WORDS
    if len(short) == 1:
        return field == "record_label" or not kind
    if full.startswith(short) or NICKNAMES.get(short) == full:
        return True
    if field != "record_label" and not kind and any(c in "aeiouyаеиоуыэюя" for c in short[1:]):
        return False
    rest = iter(full)
    return all(c in rest for c in short)


def behind_comma(name: str) -> str | None:
    """The token that stands alone behind the only comma of a name, as given names do in "Family, Given"."""
    head, comma, tail = name.partition(",")
    if not comma or "," in tail or not head.strip():
        return None
    tokens = [t for t in name_tokens(tail) if len(t) > 1] if tail.strip() else []
    return tokens[0] if len(tokens) == 1 else None


def _tokenised(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        b["tokens"] = [name_tokens(v) for v in b["name"]]
        b["tail"] = [behind_comma(v) for v in b["name"]]
        yield b[["field_name", "name", "n", "tokens", "tail"]]


def typo_keys(word: str) -> set[str]:
    """Keys of which two words one edit apart share one: the word less one letter; of long words the first or last letters."""
    half = LONG_WORD // 2 - 1
    keys = {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))} if len(word) <= LONG_WORD else set()
    return keys | {f"<{word[:half]}", f"{word[-half:]}>"} if len(word) >= LONG_WORD else keys


def _deletions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = [(f, t, d, n, k) for f, t, d, n in zip(b["field_name"], b["token"], b["df"], b["n"]) for k in typo_keys(t)]
        yield pd.DataFrame(out, columns=["field_name", "token", "df", "n", "part"])


def _one_edit_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        keep = [one_edit(x, y) or x.replace("ue", "u").replace("oe", "o").replace("ae", "a") == y for x, y in zip(b["token"], b["other"])]
        yield b[keep]


def corrected_tokens(tokens: DataFrame) -> DataFrame:
    """``field_name, token, right``: tokens one edit from a token of more names; ``tokens`` has ``df`` and ``n`` of each.

    Candidates meet on a shared deletion of one letter, so no token is compared with all others. A typo occurs in few
    names, so the spelling it joins must be in four times as many, or both be in one or two; short words, which may be
    nicknames, join only one in eight times as many.
    """
    parts = tokens.where("length(token) >= 4").mapInPandas(_deletions, "field_name string, token string, df long, n long, part string")
    other = parts.select("field_name", "part", F.col("token").alias("other"), F.col("df").alias("o_df"), F.col("n").alias("o_n"))
    close = parts.join(other, ["field_name", "part"]).where("token <> other and df <= if(length(token) < 6, o_df div 8, greatest(2, o_df div 4)) and (df < o_df or (df = o_df and (n < o_n or (n = o_n and token > other))))")
    close = close.select("field_name", "token", "other", "o_df", "o_n").distinct().mapInPandas(_one_edit_pairs, "field_name string, token string, other string, o_df long, o_n long")
    step = written(close.groupBy("field_name", "token").agg(F.max(F.struct("o_df", "o_n", "other")).alias("m")).select("field_name", "token", F.col("m.other").alias("right")), "typos")
    return _followed(step, ["field_name"], "token", "right")


def _followed(step: DataFrame, within: list[str], start: str, end: str) -> DataFrame:
    """``step`` with each end replaced by where its own steps end; steps must lead to ever more frequent words."""
    while True:  # ends: such an order admits no cycle, and each round doubles the steps
        further = step.select(*within, F.col(start).alias(end), F.col(end).alias("next"))
        seen, old = Observation(), step
        step = written(step.join(further, [*within, end], "left").observe(seen, F.count("next").alias("moved")).select(*within, start, F.coalesce("next", end).alias(end)), "followed")
        forget(old)
        if not seen.get["moved"]:
            return step


def kind_words(tokens: DataFrame, tails: DataFrame) -> DataFrame:
    """``field_name, token``: words that would stand behind a comma if they were given names, and never do.

    ``tokens`` is field_name, name, token; ``tails`` field_name, token of each name with one behind a comma. How often a
    given name does is the share of such names in the field. In a small corpus the expectation is low and nothing is
    learned.
    """
    df = tokens.groupBy("field_name", "token").agg(F.count("*").alias("df"))
    rate = tokens.groupBy("field_name").agg(F.count_distinct("name").alias("names")).join(tails.groupBy("field_name").agg(F.count("*").alias("behind")), "field_name")
    often = df.join(F.broadcast(rate), "field_name").where(F.col("df") * F.col("behind") / F.col("names") >= EXPECTED_BEHIND_COMMA)  # one row a field
    return often.join(tails.select("field_name", "token").distinct(), ["field_name", "token"], "left_anti").select("field_name", "token")


def learned_nicknames(forms: DataFrame) -> DataFrame:
    """``short, full``: given names that, where they occur, occur beside another one with the same core.

    ``forms`` is field_name, core, rest; the cores of all fields count together. A familiar form is no longer than its
    full name, is rarer, and stands beside it in four fifths of its cores. How probable that is by chance follows from
    how many cores have the full name, and, where both begin alike, from how many given names begin so. One core alone
    is evidence only for names with two first letters in common.
    """
    one = forms.where("size(rest) = 1 and length(rest[0].token) >= 2 and not rest[0].kind").select(F.concat_ws("\u001f", "field_name", "core").alias("block"), F.col("rest")[0]["token"].alias("g")).distinct()
    one = written(one, "given")
    df = written(one.groupBy("g").agg(F.count("*").alias("df")), "givencount")
    x, y = cells(one, one, "block", "g", HEAVY)
    both = x.join(y.select("block", F.col("g").alias("full")), "block").where("g <> full and length(g) <= length(full)").groupBy("g", "full").agg(F.count("*").alias("co"))
    rated = both.join(df, "g").join(df.select(F.col("g").alias("full"), F.col("df").alias("f_df")), "full").where("f_df > df and co >= 0.8 * df")
    alike = F.lit(0)
    for k in (1, 2, 3):
        alike = F.when(F.substring("g", 1, k) == F.substring("full", 1, k), k).otherwise(alike)
    begins = df.select(F.explode(F.array(*[F.substring("g", 1, k) for k in range(4)])).alias("start")).groupBy("start").agg(F.count("*").alias("sharing"))
    totals = one.agg(F.count_distinct("block").alias("cores"), F.count_distinct("g").alias("givens"))  # one row
    rated = rated.withColumn("start", F.substring(F.col("full"), F.lit(1), alike)).join(begins, "start").join(F.broadcast(totals))
    chance = F.pow(F.col("f_df") / F.col("cores"), F.col("co")) * F.col("sharing") / F.col("givens")
    fits = rated.withColumn("chance", chance).where("co > 1 or length(start) > 1").where(F.col("chance") <= F.when(F.col("start") != "", CHANCE_SAME_LETTER).otherwise(CHANCE))
    step = fits.groupBy("g").agg(F.min(F.struct("chance", -F.col("co"), "full"))["full"].alias("full")).select(F.col("g").alias("short"), "full")
    return _followed(written(step, "familiar"), [], "short", "full")


def _fits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Directed pairs: every token of a form of ``a`` equals or abbreviates its counterpart in a form of ``b``."""
    for b in batches:
        keep = [len(x) == len(y) and all(s == t or abbreviates(s, t, f, k) for s, t, k in zip(x, y, kinds)) for f, x, y, kinds in zip(b["field_name"], b["a_rest"], b["b_rest"], b["b_kinds"])]
        yield b[keep][["a", "b", "b_n"]]


def resolve(names: DataFrame) -> DataFrame:
    """``field_name, name, cluster`` of the distinct ``field_name, name, n``: one cluster per entity."""
    spelled = written(names.where("trim(name) <> ''").mapInPandas(_tokenised, "field_name string, name string, n long, tokens array<string>, tail string"), "names")
    flat = spelled.select("field_name", "name", "n", F.posexplode("tokens").alias("at", "token"))
    counted = written(flat.groupBy("field_name", "token").agg(F.count("*").alias("df"), F.sum("n").alias("n")), "tokens")
    right = corrected_tokens(counted)
    fixed = written(flat.join(right, ["field_name", "token"], "left").select("field_name", "name", "n", F.coalesce("right", "token").alias("token")), "fixed")
    tails = spelled.where("tail is not null").select("field_name", F.col("tail").alias("token")).join(right, ["field_name", "token"], "left").select("field_name", F.coalesce("right", "token").alias("token"))
    kinds = written(kind_words(fixed, tails), "kinds")

    # The core of a name is the token whose partners go with many others: given names and kinds of groups have many
    # families as partners, a family few of either, and an abbreviation or nickname only its one family.
    few = fixed.groupBy("field_name", "name").agg(F.count("*").alias("words")).where(f"words <= {MAX_WORDS}").select("field_name", "name")
    long = fixed.join(few, ["field_name", "name"], "left_semi").where("length(token) >= 2").select("field_name", "name", "n", "token")
    beside = written(long.join(long.select("field_name", "name", F.col("token").alias("with")), ["field_name", "name"]).where("token <> with").groupBy("field_name", "token", "with").agg(F.sum("n").alias("n")), "beside")
    spread = beside.groupBy("field_name", "token").agg(F.count("*").alias("spread"))
    hub = beside.join(spread.withColumnRenamed("token", "with"), ["field_name", "with"]).groupBy("field_name", "token").agg((F.sum(F.col("n") * F.col("spread")) / F.sum("n")).alias("hub"))
    marked = fixed.join(hub, ["field_name", "token"], "left").join(kinds.withColumn("kind", F.lit(True)), ["field_name", "token"], "left")
    core = marked.groupBy("field_name", "name", "n").agg(
        F.max(F.struct(F.length("token") >= 4, F.round(F.coalesce("hub", F.lit(0.0)), 6), F.length("token"), F.col("token").alias("token"))).alias("m"),
        F.collect_list(F.struct("token", F.coalesce("kind", F.lit(False)).alias("kind"))).alias("all"),
    )
    rest = F.filter("all", lambda t: t["token"] != F.col("m.token"))
    forms = written(core.select("field_name", "name", "n", F.col("m.token").alias("core"), F.array_sort(rest).alias("rest")), "forms")

    given = learned_nicknames(forms)
    usual = F.create_map(*[F.lit(x) for pair in sorted(NICKNAMES.items()) for x in pair])
    spoken = forms.select("field_name", "name", "n", "core", F.explode_outer("rest").alias("r")).withColumn("short", F.col("r.token")).join(given, "short", "left")
    meant = F.when(F.col("field_name") == "record_label", F.coalesce("full", "short")).otherwise(F.coalesce("full", F.try_element_at(usual, F.col("short")), "short"))
    spoken = spoken.groupBy("field_name", "name", "n", "core").agg(F.array_sort(F.collect_list(F.when(F.col("short").isNotNull(), F.struct(meant.alias("token"), F.col("r.kind").alias("kind"))))).alias("rest"))
    tokens = F.transform("rest", lambda t: t["token"])
    spoken = spoken.select("field_name", "name", "n", "core", tokens.alias("rest"), F.transform("rest", lambda t: t["kind"]).alias("kinds"))
    sig = F.array_join(F.array_sort(F.transform("rest", lambda t: F.substring(t, 1, 1))), "")
    state = written(spoken.select("*", F.when(sig != "", F.concat_ws("\u001f", "field_name", "core", sig)).alias("block"), F.concat_ws("\u001f", "field_name", "core", F.array_join("rest", " ")).alias("cluster")), "profiles")

    active = state
    while True:  # ends: every round but the last has fewer clusters than the one before
        weight = state.groupBy("cluster").agg(F.sum("n").alias("rows"))
        profile = written(active.where("block is not null").select("field_name", "block", "cluster", "rest", "kinds").distinct().join(weight, "cluster"), "active")
        a = profile.select("block", F.col("cluster").alias("id"), F.col("rest").alias("a_rest"))
        b = profile.select("field_name", "block", F.col("cluster").alias("id"), F.col("rest").alias("b_rest"), F.col("kinds").alias("b_kinds"), F.col("rows").alias("b_n"))
        a, b = cells(a, b, "block", "id", HEAVY)
        letters = lambda c: F.length(F.array_join(c, ""))  # noqa: E731 - the shorter form of a pair has fewer letters
        pairs = a.withColumnRenamed("id", "a").join(b.withColumnRenamed("id", "b"), "block").where(F.col("a") != F.col("b")).where(letters("a_rest") < letters("b_rest"))
        pairs = written(pairs.select("a", "b", "b_n", "field_name", "a_rest", "b_rest", "b_kinds").mapInPandas(_fits, "a string, b string, b_n long").distinct(), "fits")
        # the best fit of each, and the rows of the next one, by two aggregations: no profile's fits are gathered
        best = pairs.groupBy("a").agg(F.min(F.struct((-F.col("b_n")).alias("minus"), "b")).alias("m")).select("a", F.col("m.b").alias("best"), (-F.col("m.minus")).alias("n"))
        nxt = pairs.join(best.select("a", "best"), "a").where("b <> best").groupBy("a").agg(F.max("b_n").alias("next"))
        choice = written(best.join(nxt, "a", "left").where(f"next is null or n >= {DOMINANCE} * next").select("a", F.col("best").alias("b")), "merges")
        if choice.isEmpty():
            return state.select("field_name", "name", "cluster")
        ids = choice.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        joined = components(ids.select("id", F.col("id").alias("label")), choice.select(F.explode(F.array("a", "b")).alias("id"), F.concat_ws("\u001d", "a", "b").alias("key")))
        old = state
        state = written(state.join(joined.withColumnRenamed("id", "cluster"), "cluster", "left").withColumn("cluster", F.coalesce("label", "cluster")).drop("label"), "profiles")
        # richer profiles re-enter blocking, with all that share a core with them
        moved = state.join(joined.select(F.col("label").alias("cluster")).distinct(), "cluster", "left_semi").select("field_name", "core").distinct()
        active = state.join(moved, ["field_name", "core"], "left_semi")
        for done in (old, profile, pairs, choice):
            forget(done)


def name_values(tables: list[tuple[DataFrame, list[str]]]) -> DataFrame:
    """``field_name, name, n`` of the distinct strings in the columns (elements of array columns), not null or blank.

    Wrongly decoded strings are left out.
    """
    every = None
    for df, columns in tables:
        for c in columns:
            value = F.explode(c) if isinstance(df.schema[c].dataType, T.ArrayType) else F.col(c)
            part = df.select(F.lit(c).alias("field_name"), value.alias("name"))
            every = part if every is None else every.unionByName(part)
    counted = written(every.where(r"name is not null and name rlike '[\\p{L}\\p{N}]'").groupBy("field_name", "name").agg(F.count("*").alias("n")), "counted")
    odd = counted.where(r"name rlike '[^\\x00-\\x7F]'").groupBy(F.col("name").alias("value")).agg(F.sum("n").alias("n"))
    garbled = garbled_values(written(odd, "odd")).select(F.col("value").alias("name"))
    return counted.join(garbled, "name", "left_anti").select("field_name", "name", "n")


def variant_pairs(resolved: DataFrame) -> DataFrame:
    """``field_name, name_a, name_b`` with name_a < name_b by code point: every two spellings of one entity."""
    a = resolved.select("field_name", "cluster", F.col("name").alias("name_a"))
    b = resolved.select("field_name", "cluster", F.col("name").alias("name_b"))
    return a.join(b, ["field_name", "cluster"]).where("name_a < name_b").select("field_name", "name_a", "name_b")
