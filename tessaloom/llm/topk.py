"""Exact top-k inner-product search: tiled matrix products, partial selection in every tile,
and a merge of the per-query top lists by a tree of windows.

``exact_topk`` takes queries and candidates (id, vector). Vectors are compared only with
vectors of the same length. Components become floor(scale * x), x as double; the score is
their integer inner product. Null vectors, vectors with null or non-finite components, empty
vectors and rows without an id take no part. Every other row of ``queries`` is a query, repeated
ids too, and every row of ``candidates`` a candidate, but the query's own: of the candidate rows
that have the query's id and vector, one is left out (which one can't matter, as they give equal
rows). So k + 1 rows are kept on the way, and the own one goes at the end. Ties go to the smaller
id; rows repeated in the candidates are ranked each. Scores beyond the range of a long end at
2 ** 63 - 1, or its negative. An empty table gives no rows. Other columns of the inputs aren't read.

Queries go out in blocks of ``block_values`` components at most (or one query): the bound of a
broadcast. Beyond one block the lists of each are written before the next is made, so the driver
holds one at a time; every block meets every candidate once, where the candidate lies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import cut

FOUND = "query_no long, query_id long, vec_id long, score long, own boolean, shard int"
TILE_ROWS = 2048
MOST = (1 << 63) - 1


def _usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and components as doubles, of rows that take part."""
    vector = F.col(vector_col).cast("array<double>")
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.filter(F.col(id_col).isNotNull() & (F.size(vector) > 0) & fine).select(F.col(id_col).cast("long").alias("id"), vector.alias("v"))


def _whole(vectors: list, scale: int) -> np.ndarray:
    return np.floor(scale * np.asarray(vectors, np.float64))


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products: BLAS while every sum stays below 2**53, else Python integers."""
    top = float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1]
    if top < 2.0**53:
        return (a @ b.T).astype(np.int64)
    whole = np.array([[int(x) for x in r] for r in a], object) @ np.array([[int(x) for x in r] for r in b], object).T
    return np.clip(whole, -MOST, MOST).astype(np.int64)


def select(owner: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of each owner's k best by (score descending, id ascending), in that order."""
    order = np.lexsort((ids, -scores, owner))
    of = owner[order]
    starts = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, np.int64)
    place = np.arange(len(of)) - np.repeat(starts, np.diff(np.append(starts, len(of))))
    return order[place < k]


class TopLists:
    """The k best so far of a block of queries; tiles of candidates come in."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.owner, self.scores, self.found = (np.zeros(0, np.int64) for _ in range(3))
        self.own = np.zeros(0, bool)
        self.floor = np.full(len(ids), -MOST)  # a query's k-th score so far

    def add(self, tile: np.ndarray, ids: np.ndarray) -> None:
        for lo in range(0, len(self.ids), TILE_ROWS):
            scores = _product(self.vectors[lo : lo + TILE_ROWS], tile)
            floor = self.floor[lo : lo + TILE_ROWS, None]
            if len(ids) > self.k:  # partial selection: nothing below a row's k-th score can stay
                floor = np.maximum(floor, np.partition(scores, len(ids) - self.k, 1)[:, len(ids) - self.k, None])
            q, c = np.nonzero(scores >= floor)
            own = ids[c] == self.ids[q + lo]
            own[own] = (tile[c[own]] == self.vectors[q[own] + lo]).all(1)
            self._keep(q + lo, scores[q, c], ids[c], own)

    def _keep(self, owner: np.ndarray, scores: np.ndarray, found: np.ndarray, own: np.ndarray) -> None:
        parts = [np.concatenate(x) for x in ((self.owner, owner), (self.scores, scores), (self.found, found), (self.own, own))]
        at = select(*parts[:3], self.k)
        self.owner, self.scores, self.found, self.own = (x[at] for x in parts)
        ends = np.flatnonzero(np.append(self.owner[1:] != self.owner[:-1], True)) if len(at) else np.zeros(0, np.int64)
        full = np.diff(np.append(-1, ends)) == self.k
        self.floor[self.owner[ends[full]]] = self.scores[ends[full]]


def _blocks(queries: DataFrame, block_values: int) -> Iterator[tuple[dict[int, tuple[list, list, list]], bool]]:
    """Bounded blocks of queries (numbers, ids, vectors by vector length), and whether each is the
    only one."""
    held, values, before = {}, 0, False
    for number, row in enumerate(queries.toLocalIterator(prefetchPartitions=False)):
        n = len(row.v)
        if values and values + n > block_values:
            yield held, False
            held, values, before = {}, 0, True
        for part, x in zip(held.setdefault(n, ([], [], [])), (number, row.id, row.v)):
            part.append(x)
        values += n
    if held:
        yield held, not before


def exact_topk(queries: DataFrame, candidates: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024, block_values: int = 1 << 20) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best candidates."""
    usable = _usable(candidates, id_col, vector_col)
    out = candidates.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    for block, only in _blocks(_usable(queries, id_col, vector_col), block_values):
        part = _merged(_search(usable, {n: (np.array(numbers, np.int64), np.array(ids, np.int64), _whole(v, scale)) for n, (numbers, ids, v) in block.items()}, k + 1, scale), k)
        out = part if only else cut(out.unionByName(cut(part)))
    return out


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The tree: first within groups of shards, then per query; then one own row goes."""
    order = (F.col("score").desc(), F.col("vec_id"), F.col("own").desc())
    for keys in (("query_no", "shard"), ("query_no",)):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k + 1)
    own = F.min(F.when(F.col("own"), F.col("rank"))).over(Window.partitionBy("query_no"))
    ranked = found.withColumn("out", F.coalesce(own, F.lit(k + 1))).filter(F.col("rank") != F.col("out"))
    return ranked.select("query_id", (F.col("rank") - (F.col("rank") > F.col("out")).cast("int")).alias("rank"), "vec_id", "score")


def _search(candidates: DataFrame, block: dict, k: int, scale: int) -> DataFrame:
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {n: TopLists(ids, vectors, k) for n, (_, ids, vectors) in block.items()}
        for batch in batches:
            all_ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            lengths, flat, starts = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False), lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy(zero_copy_only=False)
            for n in set(lengths.tolist()) & set(block):
                at = np.flatnonzero(lengths == n)
                for lo in range(0, len(at), TILE_ROWS):
                    rows = at[lo : lo + TILE_ROWS]
                    best[n].add(np.floor(scale * flat[starts[rows][:, None] + np.arange(n)]), all_ids[rows])
        context = TaskContext.get()
        shard = (context.partitionId() if context else 0) % 64
        for n, (numbers, ids, _) in block.items():
            b, m = best[n], len(best[n].owner)
            columns = [(numbers[b.owner], pa.int64()), (ids[b.owner], pa.int64()), (b.found, pa.int64()), (b.scores, pa.int64()), (b.own, pa.bool_()), (np.full(m, shard), pa.int32())]
            for lo in range(0, m, 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + (1 << 16)], t) for x, t in columns], names=[x.split()[0] for x in FOUND.split(", ")])

    return candidates.mapInArrow(run, FOUND)
