"""Secrets in texts: fixed patterns, and values in credential contexts that are expensive to guess."""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from datetime import date
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from .text import slices, small_batches, texts

KINDS = ("assign", "access", "hex")
SPANS = "doc_id long, spans array<struct<kind: string, start: int, stop: int, base: boolean>>"

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Credential contexts beyond the fixed ones, or with looser punctuation, up to their value.
CONTEXT = re.compile(r"""(?:password|passwd|passphrase|passcode|pwd|secret|token|api[_-]?key|access[_-]?key|credentials?|auth|bearer)["']?\x20{0,3}(?:[:=]>?|\x20is\x20|\x20)\x20{0,3}["']?(?=[^\s"',;<>]{6})""", re.I | re.A)
VALUE = re.compile(r"""[^\s"',;<>]+""", re.A)
HINTS = ("pass", "pwd", "secret", "token", "key", "credential", "auth", "bearer")

#: Frequent words of passwords, most frequent first, and the rows of a keyboard.
WORDS = ("password", "qwerty", "admin", "welcome", "monkey", "dragon", "letmein", "login", "master", "hello", "freedom", "whatever", "shadow", "sunshine", "princess", "football", "baseball", "superman", "batman", "secret", "token", "test", "user", "root", "pass", "love", "abc", "changeme", "default", "example", "sample", "demo", "guest", "public", "private", "server", "summer", "winter", "spring", "autumn", "company", "system", "access", "change", "value", "string", "none", "null", "true", "false", "your", "here", "the", "and", "this", "that", "with", "for", "key", "api")
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")

RANK = {w: i + 1 for i, w in enumerate(WORDS)}
LONGEST = max(map(len, WORDS))
LEET = str.maketrans("013457@$!", "oieastasi")
BESIDE = {(a, b) for row in ROWS for a, b in zip(row, row[1:])} | {(b, a) for row in ROWS for a, b in zip(row, row[1:])}
DATE = re.compile(r"(?=(?:(\d{4})[-/._]?(\d{2})[-/._]?(\d{2})|(\d{2})[-/._]?(\d{2})[-/._]?(\d{4})))")


def _alphabet(piece: str) -> int:
    size = 10 * any(c.isdigit() for c in piece) + 26 * any("a" <= c <= "z" for c in piece) + 26 * any("A" <= c <= "Z" for c in piece)
    return max(2, size + 33 * any(not c.isalnum() or ord(c) > 127 for c in piece))


def _segments(value: str) -> Iterator[tuple[int, int, float]]:
    """(start, stop, log10 guesses) of words, dates, repeats and keyboard or alphabet walks."""
    low = value.lower()
    plain = low.translate(LEET)
    n = len(value)
    for i in range(n):
        for j in range(i + 3, min(n, i + LONGEST) + 1):
            if rank := RANK.get(low[i:j]) or RANK.get(plain[i:j]):
                cased = sum(c.isupper() for c in value[i:j])
                swapped = low[i:j] != plain[i:j]
                yield i, j, math.log10(rank + 1) + 0.3 * min(cased, 3) + 0.5 * swapped
        m = DATE.match(low, i)
        if m:
            y, mo, d = (m[1], m[2], m[3]) if m[1] else (m[6], m[5], m[4])
            if 1900 <= int(y) <= 2099 and 1 <= int(mo) <= 12 and 1 <= int(d) <= 31:
                stop = m.end(3) if m[1] else m.end(6)
                yield i, stop, math.log10(365 * max(20, abs(int(y) - date(2020, 1, 1).year))) + 0.6 * (stop - i > 8)
    i = 0
    while i < n:
        j = i + 1
        while j < n and value[j] == value[i]:
            j += 1
        if j - i >= 3:
            yield i, j, math.log10(_alphabet(value[i]) * (j - i))
        i = max(j, i + 1)
    for size in range(2, 9):  # repeated blocks
        i = 0
        while i + 2 * size <= n:
            j = i + size
            while j < n and value[j] == value[j - size]:
                j += 1
            if j - i >= 2 * size:
                yield i, j, math.log10(_alphabet(value[i : i + size])) * size + math.log10((j - i) / size)
                i = j
            else:
                i += 1
    for step in (lambda a, b: (a, b) in BESIDE, lambda a, b: ord(b) - ord(a) == 1, lambda a, b: ord(a) - ord(b) == 1):
        i = 0
        while i < n:
            j = i + 1
            while j < n and step(low[j - 1], low[j]):
                j += 1
            if j - i >= 3:
                yield i, j, math.log10(40.0 * (j - i))
            i = max(j, i + 1)


def guess_cost(value: str) -> float:
    """log10 of the guesses of the cheapest segmentation; text between segments costs brute force by its own alphabet.

    best[k][i]: the cheapest way to cover the first i characters with k segments plus a factor k! for their order would
    be exact but quadratic; here each further segment costs log10(2), which keeps one linear pass over stops.
    """
    n = len(value)
    if not n:
        return 0.0
    ends: dict[int, list[tuple[int, float]]] = {}
    for i, j, cost in _segments(value):
        ends.setdefault(j, []).append((i, cost))
    brute = math.log10(_alphabet(value))
    best = [0.0] + [math.inf] * n
    for j in range(1, n + 1):
        best[j] = best[j - 1] + brute
        for i, cost in ends.get(j, ()):
            best[j] = min(best[j], best[i] + cost + math.log10(2))
    return best[n]


def base_spans(body: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each fixed pattern.

    Runs of the two open classes are matched as long as they go, so asking for the least length inside the pattern
    drops the same matches as filtering them afterwards.
    """
    out = []
    low = body.lower()
    if any(h in low for h in ("passw", "secret", "token", "api")) or not low.isascii():
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(body) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in body:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(body)]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(body)]
    return out


def context_values(body: str, least: float) -> list[tuple[int, int]]:
    """Values in credential contexts whose guess cost reaches 10^least; a value without digit or mixed case is no secret.

    A value reaches to its end, however long. Contexts inside a value belong to it, so each character is scored once; but a
    context that ends a value (`auth: Bearer ...`) still opens the next one.
    """
    low = body.lower()
    if not any(h in low for h in HINTS):
        return []
    out, end = [], 0
    for m in CONTEXT.finditer(body):
        start = m.end()
        if start < end:
            continue
        end = VALUE.match(body, start).end()
        value = body[start:end].rstrip(".)]}")
        kinds = sum((any(c.isdigit() for c in value), any(c.islower() for c in value), any(c.isupper() for c in value), any(not c.isalnum() for c in value)))
        if len(value) >= 6 and kinds >= 2 and any(c.isdigit() or not c.isalnum() for c in value) and guess_cost(value) >= least:
            out.append((start, start + len(value)))
    return out


def beyond(values: list[tuple[int, int]], spans: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """The values that no single span holds whole."""
    ordered = sorted((i, j) for _, i, j in spans)
    starts, reach = [i for i, _ in ordered], list(accumulate((j for _, j in ordered), max))
    return [(i, j) for i, j in values if not (n := bisect_right(starts, i)) or reach[n - 1] < j]


def find(docs: DataFrame, text: str = "text", least: float = 8.0) -> DataFrame:
    """doc_id and spans (kind, start, stop, base) in code points.

    Base spans are the fixed patterns. Beyond them, values in wider credential contexts are added as kind `guess` where the
    cheapest segmentation into words, dates, repeats, keyboard walks and brute-force spans needs 10^least guesses or more
    and no base span holds the whole value; a value that only partly lies in base spans is added as a whole. Values are
    scored to their end, and the work is linear in the text, as segments have bounded sizes or are runs.

    Null is empty text, with no spans; repeated rows repeat; other columns are ignored.
    """

    small_batches(docs.sparkSession)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in slices(batches):
            rows = []
            for body in texts(table):
                base = base_spans(body)
                spans = [dict(kind=k, start=i, stop=j, base=True) for k, i, j in base]
                spans += [dict(kind="guess", start=i, stop=j, base=False) for i, j in beyond(context_values(body, least), base)]
                rows.append(spans)
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("base", pa.bool_())]))
            yield from pa.table([table.column("doc_id"), pa.array(rows, kind)], names=["doc_id", "spans"]).to_batches()

    return docs.selectExpr("doc_id", f"`{text}` AS text").mapInArrow(run, SPANS)
