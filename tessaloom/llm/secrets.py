"""Secret scans with multipart credential linking.

Strong parts are secrets by themselves: assignments, access identifiers and hexadecimal runs.
Weak parts say nothing alone: a bare 40-character key-like token, or an endpoint (a URL or
host with a port: a dotted name, an IP or localhost; or a name under one of six usual
domains. Other names without a dot don't count, as any word before a colon and number would be
one). Within a text, a scope is a block of lines without an empty line between
them. Every part spans an interval widened by ``reach`` characters and clipped to its scope;
an interval join by a sweep over sorted starts (memory and time follow the parts of one text)
links each weak part to the complementary parts it overlaps. A bare key is reported only if
an access identifier or an endpoint co-occurs, an endpoint only if a secret does, an
assignment, bare key or access identifier being such. A bare key inside or across any base
span is no part of its own.

Null and empty texts have no spans; an empty table gives no rows. A text of any length is
scanned in one piece, in memory that follows its parts. Offsets are code points, ends exclusive. Spans come in
order of start, then of the kinds in KINDS, then of end. Rows are independent, so repeated
ids, null ids and repeated rows each give their row; other columns aren't read. Nothing is
shuffled, and whole texts are scanned.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .runtime import arrow_map

KINDS = ("assign", "access", "hex", "key", "endpoint")
BASE = KINDS[:3]
REACH = 240
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
BARE = re.compile(r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])")
ENDPOINT = re.compile(r"(?:https?|postgres(?:ql)?|mysql|mongodb|redis|amqp|ftp|s3)://[A-Za-z0-9._~:/?#@!$&*+,;=%-]+|(?<![A-Za-z0-9.-])(?:localhost|\d{1,3}(?:\.\d{1,3}){3}|(?:[A-Za-z0-9-]++\.)+[A-Za-z][A-Za-z0-9-]*+):\d{1,5}\b|\[[0-9A-Fa-f:.]*:[0-9A-Fa-f:.]*\]:\d{1,5}\b|(?<![A-Za-z0-9.-])(?:[a-z0-9-]++\.)+(?:com|net|org|io|internal|local)(?::\d{2,5})?\b")
SCOPE_BREAK = re.compile(r"\n\s*\n")

Span = tuple[int, int, int]  # start, kind's place in KINDS, end


def base_spans(text: str) -> list[Span]:
    """The strong parts, leftmost and non-overlapping within each kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12] if ":" in text or "=" in text else []
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _overlaps(weak: list[Span], complements: list[Span], scopes: list[int], reach: int) -> list[tuple[Span, Span]]:
    """Interval join: each weak part with its nearest complement, if their widened intervals
    overlap inside one scope. Complements are sorted; of kinds that may overlap each other, the
    largest end so far bounds the look back."""
    starts = [c[0] for c in complements]
    reach_end, furthest = [], 0
    for c in complements:
        furthest = max(furthest, c[2])
        reach_end.append(furthest)
    links = []
    for w in weak:
        lo = scopes[bisect_right(scopes, w[0]) - 1]
        hi = scopes[bisect_right(scopes, w[0])]
        left, right = max(lo, w[0] - 2 * reach), min(hi, w[2] + 2 * reach)
        best = None
        for i in range(bisect_left(starts, right) - 1, -1, -1):
            if reach_end[i] <= left:
                break
            c = complements[i]
            gap = max(c[0] - w[2], w[0] - c[2], 0)
            if c[2] > left and lo <= c[0] < hi and (c[0], c[2]) != (w[0], w[2]) and (best is None or gap < best[0]):
                best = (gap, c)
                if gap == 0:
                    break
        if best:
            links.append((w, best[1]))
    return links


def scan(text: str | None, reach: int = REACH) -> tuple[list[Span], list[Span], list[tuple[Span, Span]]]:
    """Base spans, all spans, and the links (weak part, complement)."""
    text = text or ""
    base = base_spans(text)
    access = [s for s in base if s[1] == 1]
    starts, reached, furthest = [s[0] for s in base], [0], 0  # the greatest end of the first i base spans
    for s in base:
        furthest = max(furthest, s[2])
        reached.append(furthest)
    keys = []
    for m in BARE.finditer(text):
        covered = reached[bisect_left(starts, m.end())] > m.start()
        if not covered and re.search(r"[0-9]", m[0]) and re.search(r"[A-Z]", m[0]) and re.search(r"[a-z]", m[0]):
            keys.append((m.start(), 3, m.end()))
    if not keys and all(s[1] == 2 for s in base):
        return base, base, []  # an endpoint needs one of those
    endpoints = [(m.start(), 4, m.end()) for m in ENDPOINT.finditer(text)]
    scopes = [0, *(m.end() for m in SCOPE_BREAK.finditer(text)), len(text) + 1]
    links = _overlaps(keys, sorted(access + endpoints), scopes, reach)
    linked = sorted({w for w, _ in links})
    links += _overlaps(endpoints, sorted([s for s in base if s[1] < 2] + linked), scopes, reach)
    return base, sorted({*base, *(w for w, _ in links)}), links


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_spans, spans and n_links."""
    schema = StructType([StructField("doc_id", docs.schema[id_col].dataType), *(StructField(f"n_{k}", LongType()) for k in BASE), StructField("base_spans", StringType()), StructField("spans", StringType()), StructField("n_links", LongType())])

    def run(c: dict) -> dict:
        found = [scan(t, reach) for t in c["t"]]
        counts = {f"n_{k}": [sum(s[1] == i for s in b) for b, _, _ in found] for i, k in enumerate(BASE)}
        return {"doc_id": c["d"], "base_spans": [joined(b) for b, _, _ in found], "spans": [joined(s) for _, s, _ in found], "n_links": [len(x) for _, _, x in found]} | counts

    return arrow_map(docs.select(F.col(id_col).alias("d"), F.col(text_col).cast("string").alias("t")), run, schema)


def redact(text: str | None, mark: str = "[{}]") -> str | None:
    """The text with every reported span replaced by its kind; overlapping spans fall together."""
    if not text:
        return text
    out, end, kind = [], 0, None
    for a, k, b in scan(text)[1]:
        if a >= end:
            out += [text[end:a], mark.format(KINDS[k].upper())]
        end = max(end, b)
    return "".join(out) + text[end:]


def redact_documents(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """All rows and columns, with secrets of the text replaced and its length counted anew."""

    def run(c: dict) -> dict:
        texts = [redact(t) for t in c[text_col]]
        lengths = {length_col: [n if a == b else len(b) for n, a, b in zip(c[length_col], c[text_col], texts)]} if length_col in c else {}
        return c | {text_col: texts} | lengths

    return arrow_map(docs, run, docs.schema)


def digest(found: DataFrame) -> DataFrame:
    return found.withColumn("base_sha256", F.sha2(F.col("base_spans"), 256)).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_links")
