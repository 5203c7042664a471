"""Raw mail messages as text: decoded parts, visible text of markup, words, and the paragraphs people wrote."""

from __future__ import annotations

import base64
import binascii
import html
import quopri
import re
import unicodedata
from typing import NamedTuple

BLOCK_TAG = re.compile(r"</?(?:p|div|tr|table|ul|ol|li|h[1-6]|blockquote|body|html|head|section|article|pre|hr)\b[^>]*>", re.I)
BREAK_TAG = re.compile(r"<br\b[^>]*>", re.I)
UNSEEN = re.compile(r"<(script|style|title)\b.*?</\1\s*>|<!--.*?-->", re.I | re.S)
ANY_TAG = re.compile(r"<[a-zA-Z/!?][^<>]*>")
MBOX_LINE = re.compile(r"\A>?From [^\n:]*@[^\n]*\n")
HEADER_LINE = re.compile(r"([\w-]+)[ \t]*:[ \t]*(.*)", re.S)
WORD = re.compile(r"[^\W_]+")
LETTERS = re.compile(r"\b[^\W\d_]{2,}\b")
BASE64_RUBBISH = re.compile(rb"[^A-Za-z0-9+/]")


class Part(NamedTuple):
    kind: str  # content type, lower case
    attached: bool
    text: str  # decoded; "" for parts that hold no text


def _headers(block: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in re.sub(r"\n[ \t]+", " ", block).split("\n"):
        m = HEADER_LINE.match(line)
        if m:
            out.setdefault(m.group(1).lower(), m.group(2))
    return out


def _parameter(value: str, name: str) -> str:
    m = re.search(rf";\s*{name}\*?\s*=\s*(?:\"([^\"]*)\"|([^\s;]+))", value, re.I)
    return (m.group(1) if m.group(1) is not None else m.group(2)) if m else ""


def _unhelped(data: bytes) -> str:
    """Bytes of an unknown charset: UTF-8 if they are that (but for a cut-off end), else the reading with most letters."""
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError as e:
        if e.start >= len(data) - 3:
            return data[: e.start].decode("utf-8")
    best = None
    for charset in ("cp1252", "cp1250", "iso8859-2", "cp1251", "koi8-r"):
        text = data.decode(charset, "replace")
        odd = sum(1 for c in text if ord(c) > 127 and not c.isalpha())
        # capitals inside words and letters foreign to their neighbours speak against a reading
        odd += len(re.findall(r"(?<=[^\W\d_])(?<![A-Z])[А-ЯЁÀ-ÖØ-Þ](?=[а-яёa-zß-ÿ])", text)) + 2 * len(re.findall(r"[A-Za-z][а-яё]|[а-яё][A-Za-z]", text)) + len(re.findall(r"[À-ÿ]{3,}", text))
        if best is None or odd < best[0]:
            best = (odd, text)
    return best[1]


def _decoded(body: str, encoding: str, charset: str) -> str:
    encoding = encoding.strip().lower()
    if encoding == "base64":
        raw = BASE64_RUBBISH.sub(b"", body.encode("ascii", "ignore"))
        raw = raw[: len(raw) - (len(raw) % 4 == 1)]
        try:
            data = binascii.a2b_base64(raw + b"=" * (-len(raw) % 4))
        except binascii.Error:
            return ""
    elif encoding == "quoted-printable":
        data = quopri.decodestring(body.encode("utf-8"))
    else:
        return body
    if charset.lower() in ("", "us-ascii", "ascii", "unknown-8bit", "x-unknown", "unknown"):
        return _unhelped(data)
    try:
        return data.decode(charset)
    except LookupError:
        return _unhelped(data)
    except UnicodeDecodeError:
        return _unhelped(data) if charset.lower().replace("_", "-") in ("utf-8", "utf8") else data.decode(charset, "replace")


def parts_of(text: str) -> list[Part]:
    """Leaf parts of a raw message, cut-off ones included, however deep they are nested; a text without headers is one plain part."""
    out: list[Part] = []
    waiting = [(MBOX_LINE.sub("", text.replace("\r\n", "\n").replace("\r", "\n")), False)]
    while waiting:
        part, nested = waiting.pop()
        found, inner = _opened(part, nested)
        out += found
        waiting += [(p, True) for p in reversed(inner)]
    return out


def _opened(text: str, nested: bool) -> tuple[list[Part], list[str]]:
    """The leaf that a part is, or the texts of the parts in it."""
    head, blank, body = text.partition("\n\n")
    if text.startswith("\n"):
        head, body = "", text[1:]
    elif not blank or not HEADER_LINE.match(head):
        if nested or HEADER_LINE.match(head) and "content-type:" in head.lower():
            return [], []
        return [Part("text/plain", False, text)], []
    headers = _headers(head)
    content = headers.get("content-type", "text/plain")
    kind = content.split(";")[0].strip().lower()
    if kind.startswith("multipart/"):
        boundary = _parameter(content, "boundary")
        if boundary:
            pieces = re.split(rf"(?m)^--{re.escape(boundary)}(--)?[ \t]*$\n?", body)
            return [], [piece for closed, piece in zip(pieces[1::2], pieces[2::2]) if not closed]
    if kind == "message/rfc822":
        return [], [_decoded(body, headers.get("content-transfer-encoding", ""), "utf-8")]
    disposition = headers.get("content-disposition", "").lower()
    attached = disposition.startswith("attachment") or bool(_parameter(content, "name"))
    if not kind.startswith("text/"):
        return [Part(kind, attached, "")], []
    return [Part(kind, attached, _decoded(body, headers.get("content-transfer-encoding", ""), _parameter(content, "charset")))], []


def visible(part: Part) -> str:
    """Text of a part as a reader sees it: tags dropped, blocks and breaks as line ends, entities resolved."""
    text = part.text
    if part.kind == "text/html":
        text = UNSEEN.sub(" ", text).replace("\n", " ")
        text = BREAK_TAG.sub("\n", BLOCK_TAG.sub("\n\n", text))
        text = html.unescape(ANY_TAG.sub("", text))
    return text


def words(text: str) -> list[str]:
    """Runs of letters and digits, case-folded, composed; invisible characters do not part a word."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", re.sub("[­​-‏⁠﻿]", "", text))
    return WORD.findall(text.casefold())


QUOTE_MARK = re.compile(r"^(?:[ \t]*[>|])+[ \t]?")
RULE = re.compile(r"^\s*[-_=*]{3,}.*?[-_=*]*\s*$")
DELIMITER = re.compile(r"^\s*(?:--|_{2,}|-{2,}|\*{3,})\s*$")
FIELD_LINE = re.compile(r"^\s*\**[^\W\d_][\w -]{0,20}\**\s?:\s")
DOMAIN = re.compile(r"(?<![@\w.-])[\w-]+(?:\.[\w-]+)*\.(?:example|invalid|test|localhost|[a-z]{2,6})\b(?!\.?[\w@])")
ADDRESS = re.compile(r"[\w.+-]+@[\w-]+\.[\w.-]+")
SENTENCE_END = re.compile(r"[.?!。…][\"'»”)]*\s*$|[.?!]\s")

#: A paragraph of fewer words is a greeting, a closing or a heading.
MIN_WORDS = 6
#: Words from which a paragraph needs no end of a sentence, as where a passage is cut off.
LONG_WORDS = 12
#: Labels ("From: ") from which a paragraph with an address is a forwarded header block that was run together.
FIELD_LABELS = 3
LABEL = re.compile(r"(?:^|[\s*])[^\W\d_][\w-]{0,20}\**\s?:\s")


class Held(NamedTuple):
    """A paragraph with an address: it is a disclaimer if its text stands in the archive with other addresses, too."""

    text: str  # addresses and domains left out
    template: str  # its words
    address: str


def paragraphs(text: str) -> tuple[list[str], list[Held]]:
    """Paragraphs somebody wrote, own and quoted, of the body parts of a raw message, and those that may be disclaimers.

    Left out are headers, attachments, attribution lines, forwarded header blocks, greetings, closings and signatures.
    Paragraphs of several body parts with one text are given once.
    """
    out: dict[str, None] = {}
    held: dict[Held, None] = {}
    for part in parts_of(text):
        if part.attached or part.kind not in ("text/plain", "text/html"):
            continue
        for lines in _split(visible(part)):
            kept, addresses = _kept(lines)
            if kept and addresses:
                held[Held(kept, " ".join(words(kept)), " ".join(addresses).lower())] = None
            elif kept:
                out[kept] = None
    return list(out), list(held)


def whole_text(text: str) -> str:
    """All visible text of the body parts of a raw message."""
    return "\n".join(visible(p) for p in parts_of(text) if not p.attached and p.kind in ("text/plain", "text/html")).strip()


def _split(text: str) -> list[list[str]]:
    """Blocks of lines between blank lines or where quoting gets deeper, without quote marks."""
    blocks: list[list[str]] = [[]]
    depth = 0
    for line in text.split("\n"):
        m = QUOTE_MARK.match(line)
        here = len(re.sub(r"[^>|]", "", m.group())) if m else 0
        bare = line[m.end() :] if m else line
        if not bare.strip():
            blocks.append([])
        elif not blocks[-1] or here <= depth:  # rewrapped quotes lose the marks of some lines
            if not blocks[-1]:
                depth = here
            blocks[-1].append(bare)
        else:
            blocks.append([bare])
            depth = here
    return [b for b in blocks if b]


def _kept(lines: list[str]) -> tuple[str, list[str]]:
    """(the paragraph without addresses, or "" if nobody wrote it, its addresses)."""
    at = 0
    if RULE.match(lines[0]):  # of a forwarded message or a signature
        if DELIMITER.match(lines[0]) and not (len(lines) > 1 and FIELD_LINE.match(lines[1])):
            return "", []
        at = 1
    fields = at
    while fields < len(lines) and FIELD_LINE.match(lines[fields]) and len(lines[fields]) < 200:
        fields += 1
    if fields - at >= 2:
        at = fields
    elif at:
        return "", []
    body = []
    for line in lines[at:]:
        if DELIMITER.match(line):
            break
        body.append(line.strip())
    paragraph = " ".join(body)
    addresses = ADDRESS.findall(paragraph) + DOMAIN.findall(ADDRESS.sub(" ", paragraph))
    if addresses:
        if len(LABEL.findall(paragraph)) >= FIELD_LABELS:
            return "", []
        paragraph = " ".join(DOMAIN.sub(" ", ADDRESS.sub(" ", paragraph)).split())
    if paragraph.rstrip().endswith(":"):
        return "", []
    if len(WORD.findall(paragraph)) < MIN_WORDS:
        return "", []
    if not SENTENCE_END.search(paragraph) and len(LETTERS.findall(paragraph)) < LONG_WORDS:
        return "", []
    return paragraph, addresses
