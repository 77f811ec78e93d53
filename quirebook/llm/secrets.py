"""Secret scan by assignment-aware lexing.

Three base patterns always count. Beyond them, the text is read as source and configuration syntax, giving pairs of a
name and a literal: assignments with or without a type (name = literal, name: str = literal, name: literal, "name":
literal, name := literal, name => literal), options (--name=literal), calls with a name and a default (getenv("NAME",
literal)), XML elements (<name>literal</name>), indented blocks after name: | or name: >, and strings over several lines
(triple quotes, backticks). Where a value begins with a bracket, a call or a condition, or on the next line, its tokens are
read with their brackets up to its end, and all strings in it are literals of the name, or of the names that arguments
and elements have themselves. Passwords in URLs and private keys between their BEGIN and END lines are literals of a
sensitive name by themselves. Literals joined with + are read as one.

Names that hold a literal are constants; an assignment from a constant (X, $X, ${X}, or ${X} inside a string) passes its
literal on, through any number of steps. A name that is assigned in an indented line below a function's head belongs to
that function, and is looked up there before it is looked up in the rest of the text. A literal is scored by the words
of the most sensitive name that it reaches, times its own strength (length, spread of characters, not a placeholder);
from THRESHOLD on it is reported, unless a base span holds it.

Spans are in code points, end exclusive. Defined cases: a null text is an empty one; repeated rows are scanned alike;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quirebook.llm.common import read

KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

#: Fixed weights of the words of a name.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.8, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "auth": 0.7, "bearer": 0.8, "private": 0.7, "signing": 0.7, "encryption": 0.7, "key": 0.6, "cookie": 0.5, "session": 0.5, "salt": 0.5}
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|-+|changeme|change_me|your[-_ ].*|example.*|placeholder.*|none|null|nil|true|false|undefined|todo|test|password|secret|token|<.*>|\$\{.*\}|%.*%|\{\{.*\}\})$")
THRESHOLD = 0.45

#: Lengths are unbounded; possessive repeats keep the scan linear.
_TRIPLE = r"""\"{3}(?:[^"\\]|\\.|"(?!""))*+\"{3}|'{3}(?:[^'\\]|\\.|'(?!''))*+'{3}"""
_STRING = rf"""{_TRIPLE}|"(?:[^"\\\n]|\\.)++"|'(?:[^'\\\n]|\\.)++'|`(?:[^`\\]|\\.)++`"""
_NAME = r"[A-Za-z_$][A-Za-z0-9_.$-]*+"
#: A type between a name and its =, as in name: str = or name: Optional[str] =.
_TYPE = r"(?:[ \t]*+:[ \t]*+[A-Za-z_][A-Za-z0-9_.\[\]|, \t]*+(?==))?"
#: A bare value: a reference or an unquoted literal.
_BARE = r"""[^\s"'`;,(){}\[\]<>#]++"""
_PAIR = re.compile(rf"""(?s)(?<![A-Za-z0-9_.$-])(?:--)?["']?({_NAME})["']?{_TYPE}[ \t]*(?::=|=>|==?|:(?!//))[ \t]*((?:{_STRING}|\$\{{{_NAME}\}}|{_BARE})(?:[ \t]*\+[ \t]*(?:{_STRING}|{_NAME}))*)""")
#: A name whose value begins with a bracket, with a call, with a condition of up to 200 characters, or on the next line.
_OPENING = re.compile(rf"""(?<![A-Za-z0-9_.$-])["']?({_NAME})["']?{_TYPE}[ \t]*+(?::=|=>|=(?!=)|:(?!//))[ \t]*+(?=[(\[\n]|[A-Za-z_$][A-Za-z0-9_.$]*+[ \t]*+[(\[]|[^\n"'`?]{{1,200}}+\?)""")
_TOKEN = re.compile(rf"""(?s)(?P<string>{_STRING})|(?P<name>{_NAME})|(?P<assign>:=|=>|=(?!=)|:)|(?P<more>[+?])|(?P<open>[(\[])|(?P<close>[)\]])|(?P<line>\n)|(?P<comma>,)|(?P<end>[;{{}}])|[^\S\n]++|.""")
_CALL = re.compile(rf"""(?s)\(\s*+["']({_NAME})["']\s*+,\s*+({_STRING})""")
_BLOCK = re.compile(rf"""(?m)^([ \t]*+)["']?({_NAME})["']?[ \t]*+:[ \t]*+[|>][+-]?[ \t]*+\n((?:\1[ \t]++[^\n]*+(?:\n|\Z))++)""")
_XML = re.compile(rf"<({_NAME})>([^<>\n]++)</\1>")
_URL = re.compile(r"(?<=[A-Za-z0-9+.-])://[^\s:/@]*+:([^\s:/@]++)@")
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]++ ){0,3}?PRIVATE KEY-----((?:[^-]|-(?!----))*+)-----END (?:[A-Z0-9]++ ){0,3}?PRIVATE KEY-----")
_FUNCTION = re.compile(r"(?m)^[ \t]*+(?:[a-z]++[ \t]++)*?(?:def|function|func|fn)\b")
_PART = re.compile(rf"(?s){_STRING}|\$\{{{_NAME}\}}|[^\s+]+")
_REFERENCE = re.compile(rf"\$?\{{?({_NAME})\}}?$")
_INSIDE = re.compile(rf"\$\{{({_NAME})\}}")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of kind, end) of the base patterns, in order."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def sensitivity(name: str) -> float:
    words = [w.lower() for w in _WORDS.findall(name)]
    pairs = [a + b for a, b in zip(words, words[1:])]
    return max((SENSITIVE.get(w, 0.0) for w in words + pairs), default=0.0)


def strength(literal: str) -> float:
    """From 0 to 1: bits in the literal by its own distribution of characters, 32 of them being enough."""
    if len(literal) < 6 or PLACEHOLDER.match(literal):
        return 0.0
    n = len(literal)
    bits = -sum(c * math.log2(c / n) for c in Counter(literal).values())
    return min(1.0, bits / 32)


def _scopes(text: str):
    """The function of a place in text: 0 outside of any, else a number."""
    heads = [m.start() for m in _FUNCTION.finditer(text)]

    def of(at: int) -> int:
        line = text.rfind("\n", 0, at) + 1
        return bisect_right(heads, at) if text[line : line + 1] in (" ", "\t") else 0

    return of if heads else lambda at: 0


def _pairs(text: str) -> list[tuple[str, int, str]]:
    """(name, place of the value, value) of all syntax that pairs them; values as written, or as a string in quotes
    of its own where the syntax has none."""
    found = []
    if "=" in text or ":" in text:
        found += [(m[1], m.start(2), m[2]) for m in _PAIR.finditer(text)]
        found += [(m[2], m.start(3), f'"{m[3]}"') for m in _BLOCK.finditer(text)] if "|" in text or ">" in text else []
        found += _expressions(text) if any(q in text for q in "\"'`") else []
    found += [(m[1], m.start(2), m[2]) for m in _CALL.finditer(text)] if "(" in text else []
    found += [(m[1], m.start(2), f'"{m[2]}"') for m in _XML.finditer(text)] if "</" in text else []
    return found


def _expressions(text: str) -> list[tuple[int, int, str]]:
    """(name, place, value) of the strings, and of the names that aren't called, in values that brackets, calls or
    conditions hold. A bracket's content belongs to the name that it is the value of, up to a name of its own in it; a
    value ends with its line, but within brackets, after + or ?, and before anything was read. Read once from left to right."""
    found, done = [], 0
    for opening in _OPENING.finditer(text):
        if opening.start() < done:
            continue
        names, held, last, asked = [opening[1]], None, None, False
        for m in _TOKEN.finditer(text, opening.end()):
            kind, done = m.lastgroup, m.end()
            if kind is None and m[0].isspace():
                continue
            if kind == "string":
                if held and last in ("string", "line", "more") and found and found[-1][0] == names[-1]:
                    found[-1] = (names[-1], held, text[held : m.end()])  # strings that follow each other are one
                else:
                    held = m.start()
                    found.append((names[-1], held, m[0]))
                last = kind
                continue
            if kind == "line":
                if len(names) == 1 and last not in (None, "more"):
                    break
                continue
            if kind == "name" and len(names) > 1 and not text[m.end() : m.end() + 1] == "(":
                found.append((names[-1], m.start(), m[0]))
            elif kind == "assign" and len(names) == 1 and not asked or kind == "end":
                break
            elif kind == "assign" and len(names) > 1 and last == "name":
                if found and found[-1][1:] == (before.start(), before[0]):
                    found.pop()
                names[-1] = before[0]
            elif kind == "open":
                names.append(names[-1])
            elif kind == "close":
                if len(names) == 1:
                    break
                names.pop()
            elif kind == "comma":
                if len(names) == 1:
                    break
                names[-1] = names[-2]
            asked |= m[0] == "?"
            if kind != "more":
                held = None
            before, last = m, kind
    return found


def literal_spans(text: str) -> list[tuple[int, int]]:
    """Literals that are scored at THRESHOLD or more, by the most sensitive name that they reach."""
    held: dict[tuple[int, str], list[tuple[int, int, str]]] = {}  # literals of a name in its scope
    refers: dict[tuple[int, str], set[tuple[int, str]]] = {}  # names that a name's value is made of
    found = [(0.9, m.span(1), m[1]) for m in _URL.finditer(text)] if "://" in text else []
    found += [(1.0, m.span(1), m[1]) for m in _PEM.finditer(text)] if "-----BEGIN" in text else []
    pairs = _pairs(text)
    scope = _scopes(text) if pairs else None
    pairs = [((scope(at), name), at, value) for name, at, value in pairs]
    names = {key for key, _, _ in pairs}

    def refer(key: tuple[int, str], name: str) -> bool:
        target = (key[0], name) if (key[0], name) in names else (0, name)
        if name == key[1] or target not in names:
            return False
        refers.setdefault(key, set()).add(target)
        return True

    for key, at, value in pairs:
        shift = 1 if text[at : at + 1] != value[:1] or value[-1:] != text[at + len(value) - 1 : at + len(value)] else 0  # quotes of our own
        parts = [(0, len(value), 1)] if shift else [(m.start(), m.end(), next((n for n in (3, 1) if m[0][:n] in ('"' * n, "'" * n, "`") and len(m[0]) >= 2 * n), 0)) for m in _PART.finditer(value)]
        joined, start, end = [], None, None
        for a, b, quotes in parts:
            part = value[a:b]
            reference = None if quotes else _REFERENCE.match(part)
            if quotes:
                for inside in _INSIDE.findall(part):
                    refer(key, inside)
            if reference and refer(key, reference[1]):
                continue
            if quotes or not reference or part[0] != "$" and any(map(str.isdigit, part)):  # no bare words
                joined.append(value[a + quotes : b - quotes])
                start, end = a + quotes if start is None else start, b - quotes
        if joined:
            held.setdefault(key, []).append((at + start - shift, at + end - shift, "".join(joined)))
    reach = {key: sensitivity(key[1]) for key in held.keys() | refers.keys()}
    todo = sorted(refers)
    while todo:  # a sensitive name makes the constants that it is made of sensitive
        key = todo.pop()
        for constant in refers.get(key, ()):
            if constant in reach and reach[constant] < reach[key]:
                reach[constant] = reach[key]
                todo.append(constant)
    found += [(reach[key], (a, b), literal) for key, literals in held.items() if reach[key] for a, b, literal in literals]
    return sorted({span for weight, span, literal in found if weight * strength(literal) >= THRESHOLD})


def scan(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans, as (start, number of kind, end) in order."""
    text = text or ""
    base = base_spans(text)
    starts, furthest = [s for s, _, _ in base], list(accumulate((e for _, _, e in base), max))
    # of the base spans that begin at a literal's start or before, the one that ends last
    inside = lambda a, b: (i := bisect_right(starts, a)) and furthest[i - 1] >= b
    more = [(a, 3, b) for a, b in literal_spans(text) if not inside(a, b)]
    return base, sorted(base + more)


def _told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_literal, base_sha256, spans) for each row of docs (doc_id, text, ...)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan(t.as_py()) for t in batch.column(1)]
            counts = [pa.array([sum(k == i for _, k, _ in spans) for _, spans in found], pa.int64()) for i in range(len(KINDS))]
            digests = pa.array([hashlib.sha256(_told(base).encode()).hexdigest() for base, _ in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digests, pa.array([_told(spans) for _, spans in found], pa.string())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3_secrets: see the README for its columns."""
    return find(read(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_literal")
