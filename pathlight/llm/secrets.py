"""Secrets in text: fixed patterns, and literals that are assigned to names which tell that they are secret."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package

# The patterns, their order, and the least length of a match (of its literal for the first).
KINDS = ("assign", "access", "hex", "lexed")
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII
)
ASSIGN_LEAST, ACCESS_LEAST = 12, 18
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")

# How much a part of a name says that its value is secret; the parts of a name count together.
NAME_WEIGHTS = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 1.0, "pass": 0.7, "secret": 1.0, "token": 0.9,
    "credential": 0.9, "credentials": 0.9, "apikey": 1.0, "auth": 0.6, "bearer": 0.8, "private": 0.5, "access": 0.4,
    "api": 0.4, "signing": 0.5, "encryption": 0.5, "key": 0.5, "salt": 0.5, "session": 0.3,
}
PLACEHOLDER = re.compile(r"://|change.?me|example|placeholder|redacted|your[_-]|dummy|^(.)\1*$|^(none|null|true|false|todo)$", re.I)
LEAST_SCORE = 0.5
LEAST_LITERAL, LEAST_ENTROPY = 8, 2.5

_OPERATOR = re.compile(r"[:=]")
_STRING = re.compile(r"\"((?:[^\"\\\n]|\\.)*)\"|'((?:[^'\\\n]|\\.)*)'|`([^`\n]*)`")
_REFERENCE = re.compile(r"\$\{?([A-Za-z_][\w.]*)\}?|([A-Za-z_$][\w$.]*)", re.ASCII)
_BARE = re.compile(r"[^\s\"'`,;(){}\[\]<>#|]+")
_TYPE_CHARACTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.[]")
_NAME_CHARACTERS = _TYPE_CHARACTERS - frozenset("[]") | frozenset("$-")
_NAME_STARTS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_$")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int
    name: str = ""
    score: float = 1.0


def base_spans(text: str) -> list[Span]:
    """Matches of the fixed patterns, leftmost and without overlaps for each kind."""
    found = []
    if ":" in text or "=" in text:
        found += [
            Span("assign", m.start(), m.end(), m[1]) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST
        ]
    if "AKIA" in text:
        found += [Span("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [Span("hex", *m.span()) for m in HEX.finditer(text)]
    return found


def name_weight(name: str) -> float:
    """From 0 to 1: how much a name says that what it holds is secret."""
    parts = [part.lower() for part in _PARTS.findall(name)]
    joined = [a + b for a, b in zip(parts, parts[1:], strict=False)]
    return min(1.0, sum(NAME_WEIGHTS.get(part, 0.0) for part in dict.fromkeys(parts + joined)))


def entropy(value: str) -> float:
    counts = Counter(value)
    return -sum(n / len(value) * math.log2(n / len(value)) for n in counts.values())


def literal_weight(value: str, quoted: bool) -> float:
    """From 0 to 1: how much a literal looks like a secret and not like a word, a path or a placeholder."""
    if len(value) < LEAST_LITERAL or PLACEHOLDER.search(value) or any(c.isspace() for c in value):
        return 0.0
    kinds = sum(map(any, zip(*((c.islower(), c.isupper(), c.isdigit(), not c.isalnum()) for c in value), strict=True)))
    if not quoted and (kinds < 2 or not any(c.isdigit() for c in value)):
        return 0.0
    bits = entropy(value)
    return 0.0 if bits < LEAST_ENTROPY else min(1.0, bits / 3.5) * (1.0 if kinds > 1 else 0.7)


@dataclass
class _Value:
    """What a name stands for: literals of its own, and the values of other names. Kept by reference, so sums of sums stay small."""

    pieces: list[tuple[str, int, int, bool]]
    parts: list[_Value]

    def literals(self) -> list[tuple[str, int, int, bool]]:
        """``(text, start, end, quoted)`` of every literal in it, each once."""
        found: dict[tuple[int, int], tuple[str, int, int, bool]] = {}
        pending, seen = [self], set()
        while pending:
            value = pending.pop()
            if id(value) not in seen:
                seen.add(id(value))
                found |= {piece[1:3]: piece for piece in value.pieces}
                pending += value.parts
        return [found[place] for place in sorted(found)]


def _blanks(text: str, at: int, also: str = "") -> int:
    while at < len(text) and (text[at] in " \t" or text[at] in also):
        at += 1
    return at


def _value(text: str, at: int, constants: dict[str, _Value]) -> _Value | None:
    """The value that starts at ``at``: strings, constants, sums of them - in brackets over several lines - or a bare word.

    A string, or an indented word, may stand on the next line. None if it is anything else.
    """
    found = _Value([], [])
    at = _blanks(text, at)
    lines = ""
    if text[at : at + 1] == "(":
        lines = "\r\n"
        at = _blanks(text, at + 1, lines)
    elif text[at : at + 1] in ("\\", "\r", "\n"):
        following = _blanks(text, at + (text[at] == "\\"), "\r\n")
        indented = following > at and text[following - 1] in " \t"
        if not indented and _STRING.match(text, following) is None:
            return None
        at = following
    while True:
        some = found.pieces or found.parts
        if (m := _STRING.match(text, at)) is not None:
            found.pieces.append((m[m.lastindex], *m.span(m.lastindex), True))
        elif (m := _REFERENCE.match(text, at)) is not None and (known := constants.get(m[1] or m[2])) is not None:
            found.parts.append(known)
        elif not some and (m := _BARE.match(text, at)) is not None:
            return _Value([(m[0], *m.span(), False)], [])
        else:
            return found if some and lines and text[at : at + 1] == ")" else None
        at = _blanks(text, m.end(), lines)
        if lines and text[at : at + 1] in ("'", '"', "`"):
            continue
        if at >= len(text) or text[at] not in "+." or text.startswith("+=", at):
            return found
        at = _blanks(text, at + 1, lines)


def _name_before(text: str, at: int) -> str:
    """The name that ends before ``at``: plain, quoted or the last one in square brackets, with a type after it or not."""

    def back(i: int, characters) -> int:
        while i > 0 and text[i - 1] in characters:
            i -= 1
        return i

    def name(i: int) -> str:
        i = back(i, " \t")
        i -= i > 0 and text[i - 1] == "]"
        i -= i > 0 and text[i - 1] in "\"'"
        start = back(i, _NAME_CHARACTERS)
        while start < i and text[start] not in _NAME_STARTS:
            start += 1
        return text[start:i]

    end = back(at, " \t")
    colon = back(back(end, _TYPE_CHARACTERS), " \t")
    if colon < end and colon > 1 and text[colon - 1] == ":" and text[colon - 2] != ":":
        typed = name(colon - 1)
        if typed:
            return typed
    return name(at)


def lexed_spans(text: str) -> list[Span]:
    """Literals of sensitive names. Reads the text as source or configuration: ``name = value``, ``name: value``, ``name := value``,
    ``"name" => value``, ``x["name"] = value``, with values that are strings, bare words, constants or sums of them, also in
    brackets and on the next line.

    A constant has the literals last assigned to it before. Every literal that reaches a sensitive name is a span.
    """
    if ":" not in text and "=" not in text:
        return []
    constants: dict[str, _Value] = {}
    found: dict[tuple[int, int], Span] = {}
    for m in _OPERATOR.finditer(text):
        at = m.start()
        before, after = text[at - 1 : at], text[at + 1 : at + 2]
        # The second half of an operator, or a comparison, an address or an augmented assignment.
        if before in "=!<>+*/%&|^~" and before or (m[0] == "=" and after == "=") or (m[0] == ":" and after in "/:" and after):
            continue
        skip = 2 if after == ">" or (m[0] == ":" and after == "=") else 1
        name = _name_before(text, at - 1 if before == ":" else at)
        if not name:
            continue
        value = _value(text, at + skip, constants)
        if value is None:
            continue
        weight = name_weight(name)
        if weight:
            literals = value.literals()
            quoted = all(piece[3] for piece in literals)
            score = weight * literal_weight("".join(piece[0] for piece in literals), quoted)
            if score >= LEAST_SCORE:
                for _, start, end, _ in literals:
                    if end > start:
                        found.setdefault((start, end), Span("lexed", start, end, name, round(score, 4)))
        constants[name] = value
        constants.setdefault(name.rpartition(".")[2], value)
    return list(found.values())


def scan_text(text: str | None) -> list[Span]:
    """All spans by start and kind, in code points with exclusive ends. A lexed literal inside a matched assignment adds nothing."""
    if not text:
        return []
    base = base_spans(text)
    covered = [(span.start, span.end) for span in base]
    extra = [s for s in lexed_spans(text) if not any(a <= s.start and s.end <= b for a, b in covered)]
    return sorted(base + extra, key=lambda span: (span.start, KINDS.index(span.kind), span.end))


_SPANS = T.ArrayType(
    T.StructType(
        [
            T.StructField("kind", T.StringType()),
            T.StructField("start", T.LongType()),
            T.StructField("end", T.LongType()),
            T.StructField("name", T.StringType()),
            T.StructField("score", T.DoubleType()),
        ]
    )
)


@F.arrow_udf(_SPANS)
def _scan(texts: pa.Array) -> pa.Array:
    kind = pa.list_(
        pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("name", pa.string()), ("score", pa.float64())])
    )
    return pa.array([[vars(span) for span in scan_text(text.as_py())] for text in texts], kind)


def scan(docs: DataFrame, text: str = "text", into: str = "spans") -> DataFrame:
    """Add the array of spans ``(kind, start, end, name, score)`` found in every whole text.

    NULL and empty texts have none; repeated rows get equal results; nothing is shuffled. An existing column of that name
    is replaced.
    """
    ship_package(docs.sparkSession)
    return docs.withColumn(into, _scan(F.col(text)))


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """Replace what was found; overlapping spans are replaced together."""
    ship_package(docs.sparkSession)

    @F.arrow_udf(T.StringType())
    def cut(texts: pa.Array) -> pa.Array:
        return pa.array([redact_text(text.as_py(), mark) for text in texts], pa.string())

    return docs.withColumn(text, cut(F.col(text)))


def redact_text(text: str | None, mark: str) -> str | None:
    if not text:
        return text
    out, at = [], 0
    for span in scan_text(text):
        if span.start >= at:
            out += [text[at : span.start], mark]
        at = max(at, span.end)
    return "".join([*out, text[at:]])
