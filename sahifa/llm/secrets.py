"""Secret scans by assignment-aware lexing.

Base kinds are three fixed patterns. The method adds a lexer for source and configuration syntax: lines that hold an
assignment sign or an element are cut into names, operators, literals of all quotes (also triple, also joined) and
marks; a reader of these tokens makes pairs of name and literal, binds names to the literals they stand for when they
are assigned, and names that are used before they are assigned at the end. Each literal is scored by how sensitive the
names are that reach it and by its own shape. A literal at or above the threshold is reported at its own place as kind
``lexed``, even when the sensitive name stands elsewhere (``K = "..."`` and later ``password = K``).

Each character is looked at a bounded number of times, whatever the text, so a line of a megabyte takes its share only.
Spans are counted in code points, end exclusive. Defined cases: a null text is an empty one (no spans); repeated
rows give repeated results; an empty table gives an empty result; only the identifier and text columns are read,
so further columns may have any names and are not carried along.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sahifa.llm.arrow import field, map_slices

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Runs are maximal, so the ones that would fail the length test are left out by the pattern itself.
HEX = re.compile(r"[0-9a-f]{16,}")
MIN_ASSIGN, MIN_ACCESS = 12, 18
KINDS = ("assign", "access", "hex", "lexed")
#: Without one of these in the lower-cased text, ASSIGN can't match.
STEMS = ("passw", "secret", "token", "api")

#: A literal's mark that is not closed on its line gives an ``open`` token, which is cut again without that mark.
TOKENS = r"""
  (?P<space>[\x20\t\r]++)
| (?P<triple>(?:\"{3}(?s:.*?)\"{3}|'{3}(?s:.*?)'{3}))
| (?P<literal>%s)
| <(?P<tag>[A-Za-z_][\w.:\-]*+)>(?P<text>[^<>\n]*+)</
| (?P<word>[^\s"'`=:,;(){}\[\]<>+]++(?:'\w{1,2}+(?![\w']))*+)
| (?P<sign>:=|=>|={1,3}|:)
| (?P<plus>\+)
| (?P<close>[\])"'])
| (?P<line>\n)
| (?P<other>.)
"""
QUOTED = {q: rf"{q}(?:[^{q}\\\n]|\\.)*+(?:{q}|(?P<open{i}>))" for i, q in enumerate("\"'`")}
LEXERS: dict[str, re.Pattern] = {}
ASSIGNING = re.compile(r"[=:]|</")
#: What may stand before a literal's marks.
PREFIXES = {a + b for a in ("", *"rbfuRBFU") for b in ("", *"rbfuRBFU")}
IDENTIFIER = re.compile(r"[A-Za-z_][\w.]*\Z", re.A)
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
#: How much a part of a name says that its value is secret.
NAME_WEIGHTS = {
    "password": 3, "passwd": 3, "passphrase": 3, "pwd": 3, "pass": 2, "secret": 3, "secrets": 3, "token": 2, "apikey": 3, "credential": 3,
    "credentials": 3, "auth": 2, "authorization": 2, "bearer": 2, "private": 1, "access": 1, "api": 1, "key": 1, "signing": 1, "encryption": 1, "salt": 1, "cert": 1,
}
PLACEHOLDER = re.compile(r"(?i)^(?:<.*>|\$\{.*\}|\$\w+|%\w+%|\{\{.*\}\}|x+|\*+|none|null|true|false|changeme|example|placeholder|your[-_ ].*|todo)$")
THRESHOLD = 5


def name_score(name: str) -> int:
    """Sum of the weights of a name's parts, at most 4: a longer name isn't a more sensitive one."""
    return min(4, sum(NAME_WEIGHTS.get(part.lower(), 0) for part in NAME_PARTS.findall(name)))


def literal_score(value: str) -> int:
    """What the value itself says: length, mixed character classes, variety; a placeholder or prose says no."""
    if len(value) < 8 or " " in value or PLACEHOLDER.match(value):
        return -9
    classes = sum(bool(re.search(c, value)) for c in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return (len(value) >= 12) + (len(value) >= 20) + (classes >= 2) + (classes >= 3) + (len(set(value)) >= 8) - 2 * (len(set(value)) < 5)


def lexer(marks: str) -> re.Pattern:
    """The pattern of tokens whose literals are between these marks."""
    if marks not in LEXERS:
        LEXERS[marks] = re.compile(TOKENS % ("|".join(QUOTED[q] for q in marks) or "(?!)"), re.A | re.X)
    return LEXERS[marks]


def tokens(text: str, start: int, end: int, marks: str = "\"'`") -> Iterator[tuple[str, str, int, int]]:
    """(kind, value, start, end) of the tokens of ``text[start:end]``, without space."""
    for m in lexer(marks).finditer(text, start, end):
        kind = m.lastgroup
        if kind == "word":
            yield kind, m[0], m.start(), m.end()
        elif kind == "space":
            continue
        elif kind == "triple":
            yield "literal", m[0][3:-3], m.start() + 3, m.end() - 3
        elif kind == "text":
            yield "tag", m["tag"], *m.span("tag")
            yield "sign", "<", m.end("tag"), m.start("text")
            yield "literal", m["text"].strip(), *m.span("text")
            yield "line", "", m.end(), m.end()
        elif kind == "literal":
            if text[m.start()] == text[m.end() - 1] and m.end() - m.start() > 1 and not any(m[g] is not None for g in m.groupdict() if g.startswith("open")):
                yield kind, m[0][1:-1], m.start() + 1, m.end() - 1
            else:
                yield "other", text[m.start()], m.start(), m.start() + 1
                yield from tokens(text, m.start() + 1, m.end(), marks.replace(text[m.start()], ""))
        else:
            yield kind, m[0], m.start(), m.end()


def runs(text: str) -> Iterator[tuple[int, int]]:
    """What is worth cutting into tokens: lines that assign, or a whole text that has literals of several lines."""
    if '"""' in text or "'''" in text:
        yield 0, len(text)
        return
    at = 0
    for m in ASSIGNING.finditer(text):
        if m.start() < at:
            continue
        start = text.rfind("\n", at, m.start()) + 1 or at
        at = text.find("\n", m.end())
        at = len(text) if at < 0 else at
        yield start, at


def pairs(text: str) -> Iterator[tuple[str, str, int, int, bool]]:
    """(name, value, start, end, quoted) of every assignment, literals that are joined by + or nothing being one."""
    for start, end in runs(text):
        name: str | None = None  # the name that was read last, if only closing marks have followed
        target: str | None = None  # the name that a value is to go to
        value: tuple[str, int, int, bool] | None = None
        joins = False
        for kind, token, s, e in tokens(text, start, end):
            if target is not None and value is None and kind in ("literal", "word"):
                if kind == "word" and token in PREFIXES:
                    continue
                value, joins = (token, s, e, kind == "literal"), kind == "literal"
                name = token if IDENTIFIER.match(token) else None
            elif value is not None and joins and kind == "literal":
                value = (value[0] + token, value[1], e, True)
                name = None
            elif value is not None and joins and kind == "plus":
                continue
            elif kind == "sign" and value is not None and not value[3] and token.startswith("=") and target is not None:
                value = None  # a type stood between name and value
            else:
                if value is not None:
                    yield target, *value
                    value = target = None
                if kind == "sign":
                    target, name = name, None
                elif kind in ("word", "tag", "literal"):
                    target, name = None, token if IDENTIFIER.match(token) else None
                elif kind != "close":
                    name = target = None
        if value is not None:
            yield target, *value


def lexed(text: str) -> list[tuple[int, int]]:
    """Spans of the literals that sensitive names reach, directly or through constants."""
    bound: dict[str, tuple[str, int, int] | str] = {}  # a name to its literal, or to a name not yet assigned
    reached: list[tuple[int, tuple[str, int, int] | str]] = []
    for name, value, start, end, quoted in pairs(text):
        literal: tuple[str, int, int] | str = (value, start, end)
        sensitive = name_score(name)
        if not quoted and IDENTIFIER.match(value):
            if value in bound:
                literal = bound[value]
            elif sensitive >= 2:
                reached.append((sensitive, value))
                bound[name] = value
            else:
                bound[name] = value
                continue
        if name not in bound or bound[name] != value:
            bound[name] = literal
        if sensitive >= 2:
            reached.append((sensitive, literal))
    ends: dict[str, tuple[str, int, int] | None] = {}
    best: dict[tuple[int, int], int] = {}
    for sensitive, literal in reached:
        if isinstance(literal, str):
            literal = followed(literal, bound, ends)
            if literal is None:
                continue
        best[literal[1:]] = max(best.get(literal[1:], 0), sensitive + literal_score(literal[0]))
    return sorted(span for span, score in best.items() if score >= THRESHOLD)


def followed(name: str, bound: dict[str, tuple[str, int, int] | str], ends: dict[str, tuple[str, int, int] | None]) -> tuple[str, int, int] | None:
    """The literal at the end of a chain of names; none if it's never assigned or leads back to itself."""
    chain, at = [], name
    while at not in ends:
        ends[at] = None  # met again, the chain is a loop
        chain.append(at)
        up = bound.get(at)
        if isinstance(up, str):
            at = up
            continue
        ends[at] = up
    found = ends[at]
    for n in chain:
        ends[n] = found
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind's place in KINDS) of the three fixed patterns, in order."""
    found = [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    lower = text.lower()
    if any(stem in lower for stem in STEMS):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    return sorted(found, key=lambda s: (s[0], s[2]))


def scan(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans: a lexed literal inside a base span adds nothing and is left out."""
    if not text:
        return [], []
    base = base_spans(text)
    if not ASSIGNING.search(text):
        return base, base
    more = [(s, e, 3) for s, e in lexed(text) if not any(b <= s and e <= f for b, f, _ in base)]
    return base, sorted(base + more, key=lambda s: (s[0], s[2]))


def rendered(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the identifier, its base spans and all its spans as arrays of (kind, start, end)."""
    span = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([field(df, id_col), T.StructField("base", span), T.StructField("spans", span)])

    def run(batch):
        as_rows = lambda found: [{"kind": KINDS[k], "start": s, "end": e} for s, e, k in found]
        both = [scan(t) for t in batch.column(1).to_pylist()]
        return {id_col: batch.column(0), "base": [as_rows(b) for b, _ in both], "spans": [as_rows(a) for _, a in both]}

    return map_slices(df.select(id_col, text_col), run, schema)


def redact(df: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """The table with every span of every text replaced by ``mark``; overlapping spans are replaced as one."""

    def clean(text):
        out, end = [], 0
        for s, e, _ in scan(text)[1]:
            if s >= end:
                out += [text[end:s], mark]
            end = max(end, e)
        return None if text is None else "".join(out) + text[end:]

    def run(batch):
        return {n: [clean(t) for t in batch.column(n).to_pylist()] if n == text_col else batch.column(n) for n in batch.schema.names}

    return map_slices(df, run, df.schema)


def secret_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: counts by base kind, the digest of the base spans, and all spans as text."""
    counts = ("n_assign", "n_access", "n_hex")
    schema = T.StructType([field(df, id_col), *(T.StructField(c, T.LongType()) for c in counts), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])

    def run(batch):
        both = [scan(t) for t in batch.column(1).to_pylist()]
        out = {c: [sum(x[2] == k for x in b) for b, _ in both] for k, c in enumerate(counts)}
        return out | {id_col: batch.column(0), "base_sha256": [hashlib.sha256(rendered(b).encode()).hexdigest() for b, _ in both], "spans": [rendered(a) for _, a in both]}

    return map_slices(df.select(id_col, text_col), run, schema)
