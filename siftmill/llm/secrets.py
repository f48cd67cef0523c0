"""Secret scans: three fixed patterns, and the guess cost of values that stand where credentials stand.

A value is given a cost in bits by the cheapest way to say it as segments: a listed word (by its
place in the list, with its upper case and its swapped digits), a date or a year, a copy of what
stands 1 to 8 characters before (repeats, whatever their number), a walk over neighbouring keys, a
run along the alphabet or the digits, or single characters guessed by brute force. The segmentation is found by
dynamic programming over the value's places and a state for each kind of run that may go on, so the
work grows with the value's length, however long it is. Values in a credential's context that cost
LEAST_BITS or more are secrets; `password = hunter` isn't, `password = vR7#qLz!0pTw` is.

Rows are independent: no shuffle, no state, any partitioning.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import lru_cache
from math import inf, log2

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmill.llm.shared import fresh

#: The kinds of spans, in the order of their listing. guess is this method's own.
KINDS = ("assign", "access", "hex", "guess")
#: Patterns of the first three and the least length of what must be long (fixed values).
ASSIGN = r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS, HEX = r"AKIA[A-Z0-9]+", r"[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 8, 16, 32

#: Names that announce a credential, and what may stand between a name and its value.
CONTEXT = (
    r"(?:pass(?:word|wd|phrase|code|key)?|pwd|secret|token|credentials?|bearer|authorization|(?:api|access|private|auth|encryption|signing)[_-]?key)"
    r"[\"']?[\x20\t]*(?::=|=>|[:=])[\x20\t]*(?:\"(?P<double>[^\"\n]+)\"|'(?P<single>[^'\n]+)'|(?P<bare>[^\s\"',;]+))"
)
#: A password in an address.
USERINFO = r"://[^/\s:@]*:(?P<user>[^/\s@]+)@"
LEAST_BITS = 45.0

#: Words that make up passwords, the likelier ones first.
WORDS = (
    "password pass admin welcome login user test guest root master secret letmein changeme default hello monkey dragon shadow sunshine princess football "
    "baseball hunter superman batman trustno love money power access server system network computer internet database service account public private demo "
    "example sample dummy token null none true false undefined empty your enter here insert value string name email home work office spring summer autumn "
    "winter january february march april june july august september october november december monday tuesday wednesday thursday friday saturday sunday "
    "black white green yellow orange purple silver golden tiger lion eagle horse correct battery staple apple banana cherry flower garden forest river ocean "
    "mountain star moon night light dark fire water earth wind happy lucky super cool best good first last new old big little king queen angel devil"
).split()

#: Signs that stand for letters in words.
_SWAPS = str.maketrans({"4": "a", "@": "a", "8": "b", "3": "e", "6": "g", "1": "l", "!": "i", "0": "o", "5": "s", "$": "s", "7": "t"})
_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
_SHIFTED = str.maketrans('~!@#$%^&*()_+{}|:"<>?', "`1234567890-=[]\\;',./")
#: How rows of keys are set off to the right, in half keys, and the six ways to a neighbour.
_OFFSETS, _WAYS = (0, 3, 4, 5), ((2, 0), (-2, 0), (1, 1), (-1, -1), (-1, 1), (1, -1))
_DATE = re.compile(r"(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d", re.ASCII)

#: Bits: to begin a segment; a date in 200 years with its order and separator, and a year; how far back a copy
#: begins and how long it is; where a walk or run begins; a step that keeps or takes a direction.
SEGMENT, DATE, YEAR, BACK, START, KEEP, TURN = 1.0, log2(200 * 365 * 8), log2(200), 3.0 + 4.0, log2(94), 0.5, log2(6) + 0.5
COPIES, LONGEST_DATE = 8, 10
_CLASSES = ((str.isdigit, log2(10)), (lambda c: "a" <= c <= "z", log2(26)), (lambda c: "A" <= c <= "Z", log2(26) + 0.5), (str.isascii, log2(33)))


@lru_cache(maxsize=4096)
def brute(char: str) -> float:
    """Bits to guess a character within its class."""
    return next((bits for holds, bits in _CLASSES if char.isascii() and holds(char)), log2(1 << 11))


@lru_cache(maxsize=1)
def _keys() -> dict[str, tuple[int, int]]:
    return {c: (2 * x + _OFFSETS[y], y) for y, row in enumerate(_ROWS) for x, c in enumerate(row)}


def _key_way(a: str, b: str) -> int | None:
    """The direction from key a to key b if they are neighbours."""
    keys = _keys()
    one, two = keys.get(a), keys.get(b)
    if one is None or two is None:
        return None
    step = two[0] - one[0], two[1] - one[1]
    return _WAYS.index(step) if step in _WAYS else None


def _run_way(a: str, b: str) -> int | None:
    """+1 or -1 if b follows or precedes a in the alphabet or among the digits."""
    step = ord(b) - ord(a)
    return step if step in (1, -1) and (a.isdigit() and b.isdigit() or a.isalpha() and b.isalpha()) and a.isascii() and b.isascii() else None


def ranked(words: list[str]) -> dict[str, float]:
    """Bits of each word by its place in the list."""
    found: dict[str, float] = {}
    for i, w in enumerate(words):
        found.setdefault(w.lower(), log2(i + 2))
    return found


def word_bits(part: str, low: str, plain: str, known: dict[str, float]) -> float:
    """Bits of a part as a word, inf if it isn't one. low: in lower case; plain: its signs taken as letters."""
    bits = known.get(low)
    swapped = 0
    if bits is None:
        bits = known.get(plain)
        if bits is None:
            return inf
        swapped = sum(a != b for a, b in zip(low, plain))
    upper = sum(a != b for a, b in zip(part, low))
    cased = 0.0 if not upper else 1.0 if upper == len(part) or (upper == 1 and part[0] != low[0]) else 1.0 + upper
    return bits + cased + 1.5 * swapped


def guess_bits(value: str, known: dict[str, float], longest: int) -> float:
    """The least bits of any segmentation of value; longest: of the known words."""
    n = len(value)
    lowered = value.lower()
    low = lowered if len(lowered) == n else "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    plain = low.translate(_SWAPS)
    keys = low.translate(_SHIFTED)
    ahead: dict[int, float] = {}  # best costs at places not reached yet
    best = 0.0
    copy = [inf] * (COPIES + 1)  # inside a copy from so far back
    walk: dict[int, float] = {}  # inside a walk in this direction; -1: at its first key
    run: dict[int, float] = {}  # inside a run upwards or downwards; 0: at its first character
    for i in range(n):
        begin = best + SEGMENT
        # Segments of bounded length.
        for end in range(i + 3, min(n, i + longest) + 1):
            bits = word_bits(value[i:end], low[i:end], plain[i:end], known)
            if bits < inf:
                ahead[end] = min(ahead.get(end, inf), begin + bits)
        if value[i].isdigit():
            for end in range(i + 4, min(n, i + LONGEST_DATE) + 1):
                if _DATE.fullmatch(value, i, end):
                    ahead[end] = min(ahead.get(end, inf), begin + (YEAR if end == i + 4 else DATE))
        # Runs, a character at a time.
        after = best + brute(value[i])
        for back in range(1, min(COPIES, i) + 1):
            copy[back] = min(copy[back], begin + BACK) if value[i] == value[i - back] else inf
            after = min(after, copy[back])
        shift = 0.5 if value[i] != keys[i] else 0.0
        way = _key_way(keys[i - 1], keys[i]) if i else None
        walk = _stepped(walk, way, shift)
        run = _stepped(run, _run_way(value[i - 1], value[i]) if i else None, 0.0)
        after = min(after, *walk.values(), *run.values(), inf)
        first = begin + START
        walk[-1] = first + shift if keys[i] in _keys() else inf
        run[0] = first
        best = min(after, ahead.pop(i + 1, inf))
    return best


def _stepped(held: dict[int, float], way: int | None, shift: float) -> dict[int, float]:
    """The states of a walk or run after a step in a direction; none without one."""
    if way is None or not held:
        return {}
    turned = min(bits for bits in held.values())
    return {way: min(held.get(way, inf) + KEEP, turned + TURN) + shift}


# Spans


_BASE = [(k, re.compile(p, f), least, group) for k, p, f, least, group in (
    ("assign", ASSIGN, re.ASCII | re.IGNORECASE, ASSIGN_LEAST, 2), ("access", ACCESS, re.ASCII, ACCESS_LEAST, 0), ("hex", HEX.replace("+", "{%d,}" % HEX_LEAST), re.ASCII, HEX_LEAST, 0),
)]
#: Patterns of contexts; a text in which none of the words beside one occurs can't match it.
_CONTEXTS = [(re.compile(p, re.ASCII | re.IGNORECASE), signs) for p, signs in ((CONTEXT, ("pass", "pwd", "secret", "token", "credential", "bearer", "authorization", "key")), (USERINFO, ("://",)))]
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")


def base_spans(text: str) -> list[tuple[int, int, str, float | None]]:
    """(start, end, kind, None) of the three patterns' matches, long enough ones; leftmost ones that don't
    overlap for each kind."""
    found, low = [], text.lower()
    for kind, pattern, least, group in _BASE:
        if kind == "assign" and not any(w in low for w in _ASSIGN_WORDS) or kind == "access" and "AKIA" not in text:
            continue
        found += [(m.start(), m.end(), kind, None) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return found


def guessed_spans(text: str, known: dict[str, float], longest: int, least: float) -> list[tuple[int, int, str, float]]:
    """(start, end, guess, bits) of the values in a credential's context that cost enough."""
    found, low = {}, text.lower()
    for pattern, signs in _CONTEXTS:
        if not any(w in low for w in signs):
            continue
        for m in pattern.finditer(text):
            start, end = m.span(m.lastgroup)
            bits = guess_bits(m[m.lastgroup], known, longest)
            if bits >= least:
                found[start, end] = bits
    return [(a, b, "guess", bits) for (a, b), bits in found.items()]


def spans(text: str, known: dict[str, float], longest: int, least: float = LEAST_BITS) -> list[tuple[int, int, str, float | None]]:
    """All spans of a text by start and kind. A guessed value that one base span holds wholly adds none."""
    base = base_spans(text)
    # Base spans of one kind don't overlap, so for each kind only the last that begins before can hold a value.
    by_kind = [sorted(s for s in base if s[2] == k) for k in KINDS[:3]]
    starts = [[s[0] for s in each] for each in by_kind]

    def held(a: int, b: int) -> bool:
        return any((at := bisect_right(first, a)) and each[at - 1][1] >= b for first, each in zip(starts, by_kind))

    added = [g for g in guessed_spans(text, known, longest, least) if not held(g[0], g[1])]
    return sorted(base + added, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


_KIND = "array<struct<kind: string, start: long, end: long, bits: double>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("bits", pa.float64())]))


def scanned(df: DataFrame, text_col: str = "text", name: str = "spans", words: list[str] = WORDS, least_bits: float = LEAST_BITS) -> DataFrame:
    """df with the column `name` (in the place of one of this name): array<struct<kind, start, end, bits>>
    of the secrets in each whole text, in code points, end exclusive, by start and then by kind as in
    KINDS. bits is the guess cost, of guessed spans only.

    A null text counts as an empty one and has no spans, bytes that aren't UTF-8 count as one code point
    each; repeated rows each keep a row; df may be empty; texts may be of any length. words: a bounded
    list for the guesses, the likelier ones first, which travels with the tasks.
    """
    known = ranked(words)
    longest = max(map(len, known), default=0)

    def run(texts: pa.Array) -> pa.Array:
        rows = []
        for t in texts.cast(pa.binary()).to_pylist():
            found = spans((t or b"").decode("utf-8", "replace"), known, longest, least_bits)
            rows.append([{"kind": k, "start": a, "end": b, "bits": bits} for a, b, k, bits in found])
        return pa.array(rows, _ARROW)

    found, = fresh(df, "found")
    made = df.withColumn(found, F.arrow_udf(run, _KIND)(F.col(text_col).cast("string")))
    return made.select(*(c for c in df.columns if c != name), F.col(found).alias(name))


def redacted(df: DataFrame, text_col: str = "text", mark: str = "[secret]", words: list[str] = WORDS, least_bits: float = LEAST_BITS) -> DataFrame:
    """df with each secret in its texts replaced by the mark; spans that touch or overlap are one. Texts
    without secrets, and null ones, stay as they are."""
    own, = fresh(df, "own_spans")
    rows = scanned(df, text_col, own, words, least_bits)
    # Joins overlapping spans in order, then copies what lies between them.
    pair = "array<struct<start: long, end: long>>"
    joined = F.aggregate(
        F.sort_array(F.transform(own, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))), F.array().cast(pair),
        lambda held, s: F.when((F.size(held) > 0) & (F.element_at(held, -1)["end"] >= s["start"]), F.concat(F.slice(held, 1, F.size(held) - 1), F.array(F.struct(F.element_at(held, -1)["start"].alias("start"), F.greatest(F.element_at(held, -1)["end"], s["end"]).alias("end"))))).otherwise(F.concat(held, F.array(s))),
    )
    text = F.col(text_col).cast("string")
    begins = F.concat(F.array(F.lit(0).cast("long")), F.transform(joined, lambda s: s["end"]))
    ends = F.concat(F.transform(joined, lambda s: s["start"]), F.array(F.length(text).cast("long")))
    between = F.zip_with(begins, ends, lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int")))
    clean = F.when(F.size(own) > 0, F.array_join(between, mark)).otherwise(text)
    return rows.select(*(clean.alias(c) if c == text_col else F.col(c) for c in df.columns))


def listed(found: Column) -> Column:
    """Spans as `kind:start:end` with commas between them."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
