"""Repeated passages by sparse suffix arrays.

Of each text's suffixes (by words), only those at minimisers are kept: the positions whose
KMER-word hash is least in some window of WINDOW such hashes. Equal stretches choose equal
positions, so a passage of MIN_WORDS words has a kept suffix within its first WINDOW words, and
both copies agree with it for RUN = MIN_WORDS - WINDOW + 1 words at least. So:

1. kept suffixes whose first RUN words occur in one document only are dropped (a hash
   aggregation and a join, both on the hash);
2. of the others, the words that follow the run and those before it come along, as many as can
   decide (WINDOW - 1 each way), as 32-bit hashes;
3. suffixes are sorted by (run, words that follow, words before). A suffix lies in the 50-word
   windows of i words before the run and j after it, i + j = MIN_WORDS - RUN; a window is repeated
   if its hash comes from different documents. Suffixes that agree in the j words that follow are
   neighbours, so a task decides their windows by itself;
4. the windows of neighbours that may go on in another task (or another stretch of CHUNK rows) are
   decided by an aggregation on their hashes, to which a stretch gives a row a hash, and a row a
   place only for windows of one document there;
5. a document's repeated windows are united.

Every window of MIN_WORDS words is decided, however many documents hold a run. Range partitions
may split a run's suffixes anywhere, so hot passages spread over tasks.

Result: one row per document that has repeated passages: doc_id, n_spans, n_words (words in
them) and spans (start:end in words, end exclusive, comma-joined, in order). Null and empty
texts, and texts of fewer words, have none. Repeats within one document alone aren't reported.
Rows without an id take no part; rows that repeat an id count as one document. Empty tables
give no rows; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .runtime import arrow_map, cut, join_groups, release
from .textops import Words, mix, runs

MIN_WORDS, WINDOW, KMER, CHUNK = 50, 26, 8, 1 << 14
RUN = MIN_WORDS - WINDOW + 1
SIDE = WINDOW - 1


def minimisers(hashes: np.ndarray, kmer: int = KMER, window: int = WINDOW) -> np.ndarray:
    """Positions whose k-mer is the least (the leftmost of equals) of some window."""
    keys = runs(hashes, kmer)
    n = len(keys) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least, width = keys.copy(), 1
    while width < window:  # sliding minimum by doubling; least[i] covers keys[i : i + width]
        step = min(width, window - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    view = np.lib.stride_tricks.sliding_window_view(keys, window)
    is_least = np.zeros(len(keys), bool)
    changed = np.ones(n, bool)
    changed[1:] = least[1:] != least[:-1]
    # a window's leftmost least position moves only where the minimum or its first place leaves
    at = np.flatnonzero(changed)
    first = at + view[at].argmin(1)
    is_least[first] = True
    bounds = np.append(at[1:], n)
    for a, b, f in zip(at.tolist(), bounds.tolist(), first.tolist()):
        while f + 1 < b:  # equal minima further on: the window has passed the first of them
            a = f + 1
            f = a + int(view[a].argmin())
            is_least[f] = True
    return np.flatnonzero(is_least)


def kept_suffixes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, pos (word), run (hash of the RUN words from there)."""
    schema = StructType([StructField("run", LongType()), StructField("doc", LongType()), StructField("pos", IntegerType())])

    def pick(c: dict) -> dict:
        words, run, doc, pos = Words(c["t"]), [], [], []
        for i in range(len(words)):
            h = words.of(i)
            if len(h) < MIN_WORDS:
                continue
            at = minimisers(h)
            at = at[at + RUN <= len(h)]
            run.append(runs(h, RUN)[at].view(np.int64))
            pos.append(at)
            doc.append(np.full(len(at), c["d"][i], np.int64))
        if not run:
            return {"run": [], "doc": [], "pos": []}
        return {"run": np.concatenate(run), "doc": np.concatenate(doc), "pos": np.concatenate(pos).astype(np.int32)}

    return arrow_map(_texts(docs, id_col, text_col), pick, schema)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("d"), F.col(text_col).cast("string").alias("t"))


CONTEXT = "run long, after binary, before binary, doc long, pos int"
MATCH = "doc long, lo int, hi int, key long, least long, most long"


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(d, t, at: array of (pos, run)) to the runs' contexts. A text's end is padded with 0,
    which no neighbour's padding may match: lengths are checked against it."""
    for batch in batches:
        for i in range(batch.num_rows):
            part = batch.slice(i, 1)
            at = part.column("at").to_pylist()[0]
            h = (Words(part.column("t").to_pylist()).hashes >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
            padded = np.concatenate((np.zeros(SIDE, np.uint32), h, np.zeros(SIDE, np.uint32)))
            rows = [(p["run"], padded[q + RUN : q + RUN + SIDE].tobytes(), padded[q - SIDE : q][::-1].tobytes(), p["pos"]) for p in at for q in [p["pos"] + SIDE] if p["pos"] + RUN <= len(h)]
            if rows:
                run, after, before, pos = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(run, pa.int64()), pa.array(after, pa.binary()), pa.array(before, pa.binary()), pa.array([part.column("d")[0].as_py()] * len(rows), pa.int64()), pa.array(pos, pa.int32())], names=["run", "after", "before", "doc", "pos"])
    release()


def _fresh(key: np.ndarray, doc: np.ndarray, pos: np.ndarray, after: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before it, but for its position."""
    out = np.ones(len(key), bool)
    out[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]) | (after[1:] != after[:-1]).any(1) | (before[1:] != before[:-1]).any(1)
    return out


def _heads(first: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Row n: a hash of ``first`` and the first n words."""
    out = [mix(first.view(np.uint64))]
    for n in range(words.shape[1]):
        out.append(mix(out[-1] * np.uint64(0x9E3779B97F4A7C15) + words[:, n]))
    return np.stack(out)


def _decide(rows: tuple[np.ndarray, ...], opens: bool, goes_on: bool) -> Iterator[pa.RecordBatch]:
    """Repeated windows of sorted rows, and what is left to decide of the first run, if it
    ``opens`` before them, and of the last, if it ``goes_on``."""
    key, doc, pos, after, before = rows
    fresh = _fresh(key, doc, pos, after, before)
    row = np.cumsum(fresh) - 1
    k, d, r, l = key[fresh], doc[fresh], after[fresh], before[fresh]
    right, left = np.full(len(k), -1), np.full(len(k), -1)
    follow, precede = _heads(k, r), _heads(np.zeros(len(k), np.int64), l)
    shared, alone = [], []
    for i in range(SIDE + 1):
        j = SIDE - i
        whole = np.ones(len(k), bool)  # not cut off by the text's start or end
        if i:
            whole &= l[:, i - 1] != 0
        if j:
            whole &= r[:, j - 1] != 0
        at = np.flatnonzero(whole)
        if not len(at):
            continue
        window = mix(follow[j][at] * np.uint64(0xC2B2AE3D27D4EB4F) + precede[i][at] + np.uint64(i))
        order = np.argsort(window, kind="stable")
        at, window = at[order], window[order]
        starts = np.flatnonzero(np.append(True, window[1:] != window[:-1]))
        least, most = np.minimum.reduceat(d[at], starts), np.maximum.reduceat(d[at], starts)
        many = np.repeat(least < most, np.diff(np.append(starts, len(at))))
        left[at[many]], right[at[many]] = np.maximum(left[at[many]], i), np.maximum(right[at[many]], j)
        beyond = np.zeros(len(at), bool)
        if opens:
            beyond |= follow[j][at] == follow[j][0]
        if goes_on:
            beyond |= follow[j][at] == follow[j][-1]
        some = (least < most) & beyond[starts]
        shared.append((window[starts[some]], least[some], most[some]))
        lone = beyond & ~many
        alone.append((at[lone], window[lone], np.full(int(lone.sum()), i)))
    hit = left[row] >= 0
    if hit.any():
        yield _found(doc[hit], pos[hit] - left[row][hit], pos[hit] + RUN + right[row][hit])
    if not shared:
        return
    window, least, most = (np.concatenate(x) for x in zip(*shared))
    at, own, i = (np.concatenate(x) for x in zip(*alone))
    known = (left[at] >= i) & (right[at] >= SIDE - i)  # the document's windows around cover it
    window, least, most = np.append(window, own[known]), np.append(least, d[at[known]]), np.append(most, d[at[known]])
    if len(window):
        yield _found(None, None, None, window, least, most)
    at, own, i = at[~known], own[~known], i[~known]
    first = np.append(np.flatnonzero(fresh), len(row))  # the rows of a content
    for a in range(0, len(at), CHUNK):
        part = at[a : a + CHUNK]
        n = first[part + 1] - first[part]
        spread = np.repeat(np.arange(len(part)), n)
        rows_of = np.repeat(first[part] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(len(spread))
        lo = pos[rows_of] - i[a : a + CHUNK][spread]
        yield _found(doc[rows_of], lo, lo + MIN_WORDS, own[a : a + CHUNK][spread], doc[rows_of], doc[rows_of])


def _found(doc, lo, hi, key=None, least=None, most=None) -> pa.RecordBatch:
    n = len(doc if doc is not None else key)
    columns = [(doc, pa.int64()), (lo, pa.int32()), (hi, pa.int32()), (key if key is None else key.view(np.int64), pa.int64()), (least, pa.int64()), (most, pa.int64())]
    return pa.RecordBatch.from_arrays([pa.nulls(n, t) if x is None else pa.array(x.astype(t.to_pandas_dtype())) for x, t in columns], names=[x.split()[0] for x in MATCH.split(", ")])


def _windows(chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, opens = [], 0, True
        for batch in batches:
            if not batch.num_rows:
                continue
            key, doc, pos = (batch.column(c).to_numpy() for c in ("run", "doc", "pos"))
            after = np.frombuffer(b"".join(batch.column("after").to_pylist()), np.uint32).reshape(-1, SIDE)
            before = np.frombuffer(b"".join(batch.column("before").to_pylist()), np.uint32).reshape(-1, SIDE)
            held.append((key, doc, pos, after, before))
            n += len(key)
            if n < chunk:
                continue
            rows = tuple(np.concatenate(x) for x in zip(*held))
            last = int(np.argmax(rows[0] == rows[0][-1]))
            if last:  # the last run waits for the rest of it
                yield from _decide(tuple(x[:last] for x in rows), opens, False)
                held, n, opens = [tuple(x[last:].copy() for x in rows)], n - last, False
            if n >= chunk:
                yield from _decide(tuple(np.concatenate(x) for x in zip(*held)), opens, True)
                held, n, opens = [], 0, True
        if held:
            yield from _decide(tuple(np.concatenate(x) for x in zip(*held)), opens, True)
        held = batch = key = doc = pos = after = before = rows = None
        release()

    return run


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_spans, n_words, spans."""
    kept = cut(kept_suffixes(docs, id_col, text_col))
    shared = kept.groupBy("run").agg(F.min("doc").alias("least"), F.max("doc").alias("most"), F.count("*").alias("rows")).filter("least < most").select("run", "rows")
    per_doc = join_groups(kept, shared, "run", "rows", "left_semi").groupBy("doc").agg(F.collect_list(F.struct("pos", "run")).alias("at"))
    contexts = _texts(docs, id_col, text_col).join(per_doc.withColumnRenamed("doc", "d"), "d").mapInArrow(_contexts, CONTEXT)
    parts = max(2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = ("run", "after", "before", "doc", "pos")
    found = cut(contexts.repartitionByRange(parts, *order[:-1]).sortWithinPartitions(*order).mapInArrow(_windows(chunk), MATCH))
    open_ends = found.filter("key is not null")
    repeated = open_ends.groupBy("key").agg(F.min("least").alias("least"), F.max("most").alias("most")).filter("least < most").select("key")
    across = open_ends.filter("doc is not null").join(repeated, "key", "left_semi")
    matches = found.filter("key is null").unionByName(across).select("doc", "lo", "hi")
    spans = matches.groupBy("doc").agg(F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias("s"))
    united = F.expr("""aggregate(s, cast(array() as array<struct<lo: int, hi: int>>), (u, x) ->
        case when size(u) > 0 and element_at(u, -1).hi >= x.lo
             then concat(slice(u, 1, size(u) - 1), array(named_struct('lo', element_at(u, -1).lo, 'hi', greatest(element_at(u, -1).hi, x.hi))))
             else concat(u, array(x)) end)""")
    return spans.select(F.col("doc").alias("doc_id"), united.alias("u")).select(
        "doc_id",
        F.size("u").cast("long").alias("n_spans"),
        F.expr("aggregate(u, 0L, (n, x) -> n + x.hi - x.lo)").alias("n_words"),
        F.array_join(F.transform("u", lambda x: F.concat_ws(":", x.lo, x.hi)), ",").alias("spans"),
    )


def without_spans(text: str, spans: str) -> str:
    """The text without the passages of ``spans`` (as above)."""
    words, out, end = Words([text]), [], 0
    for s in filter(None, spans.split(",")):
        lo, hi = map(int, s.split(":"))
        out.append(text[end : words.starts[lo]])
        end = int(words.ends[hi - 1])
    return "".join(out) + text[end:]
