"""Benchmark decontamination: size-partitioned MinHash containment search.

Items are partitioned by their number of distinct shingles, in powers of two. In the class of
items of up to u shingles, an item is sketched by its ``k(u)`` least shingle hashes (bottom-k
MinHash); a document that holds at least ``threshold`` of an item's shingles misses at most
floor((1 - threshold) * n) of them, so with k = floor((1 - threshold) * u) + 1 some sketched
shingle is in the document: no loss. Documents are long and items short, so the document side
isn't sketched: its shingles probe the sketches, items that are too large for the document are
skipped, and candidates are verified by exact shingle containment.

A shingle is five words; an item of one to four words has one, all its words, and is looked for
among the runs of so many words of every document. So short items are found inside long texts,
too, and documents of one to four words hold short items only.

Results: one row per (document row, item) with containment >= threshold. Null and empty texts
hold nothing and are contained nowhere. Items that repeat are reported each; rows without an id
are searched and reported with a null id. Empty tables give no rows. Other columns of the inputs
aren't read. Texts of any length are searched whole.

Items go to the executors in blocks of ``block_shingles`` at most (or one item): the bound of a
broadcast. Beyond one block the outcome of each is written before the next is made, so the driver
holds one at a time; every document is read once per block, and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, LongType, StructField, StructType

from .runtime import arrow_map, cut
from .textops import SHINGLE_WORDS, Words, runs

THRESHOLD = 0.8
_BITS = 20


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n words; those of different n differ."""
    return runs(words, n) ^ np.uint64(n % SHINGLE_WORDS)


def item_shingles(words: np.ndarray) -> np.ndarray:
    """Sorted distinct shingles of an item."""
    return np.unique(grams(words, min(len(words), SHINGLE_WORDS))) if len(words) else np.zeros(0, np.uint64)


class ItemIndex:
    """Sketches of one block of items, by size class, and their whole shingle sets."""

    def __init__(self, ids: list, sets: list[np.ndarray], lengths: list[int], threshold: float):
        """``lengths``: the items' numbers of words."""
        self.runs = sorted({min(n, SHINGLE_WORDS) for n in lengths})
        self.ids, self.sizes, self.threshold = ids, np.array([len(s) for s in sets], np.int64), threshold
        self.needed = np.ceil(threshold * self.sizes - 1e-9).astype(np.int64)
        sketch, owner, whole, whole_owner = [], [], [], []
        for i, s in enumerate(sets):
            k = int((1 - threshold) * self.size_class(len(s)) + 1e-9) + 1
            sketch.append(s[:k])  # sets are sorted, so these are the k least
            owner.append(np.full(len(s[:k]), i))
            whole.append(s)
            whole_owner.append(np.full(len(s), i))
        self.sketch, self.sketch_owner = self._sorted(sketch, owner)
        self.whole, self.whole_owner = self._sorted(whole, whole_owner)
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[(self.whole >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        self.least = int(self.needed.min()) if len(self.needed) else 1 << 62

    @staticmethod
    def size_class(n: int) -> int:
        return 1 << max(0, n - 1).bit_length()

    @staticmethod
    def _sorted(parts: list, owners: list) -> tuple[np.ndarray, np.ndarray]:
        if not parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        values, owner = np.concatenate(parts), np.concatenate(owners)
        order = np.argsort(values, kind="stable")
        return values[order], owner[order]

    @staticmethod
    def _owners(values: np.ndarray, owner: np.ndarray, probe: np.ndarray) -> np.ndarray:
        """The owners of every probe's entries, with repeats."""
        lo, hi = np.searchsorted(values, probe, "left"), np.searchsorted(values, probe, "right")
        n = hi - lo
        if not n.any():
            return np.zeros(0, np.int64)
        at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        return owner[at]

    def search(self, words: np.ndarray) -> list[tuple[int, int]]:
        """(item position, shared shingles) of the items that the document contains."""
        if len(words) < self.least:
            return []
        doc = np.concatenate([grams(words, n) for n in self.runs])
        doc = doc[self.seen[(doc >> np.uint64(64 - _BITS)).astype(np.int64)]]
        if not len(doc):
            return []
        doc = np.unique(doc)
        candidates = np.unique(self._owners(self.sketch, self.sketch_owner, doc))
        candidates = candidates[self.needed[candidates] <= len(doc)]
        if not len(candidates):
            return []
        shared = np.bincount(self._owners(self.whole, self.whole_owner, doc), minlength=len(self.sizes))
        return [(int(i), int(shared[i])) for i in candidates if shared[i] >= self.needed[i]]


def item_blocks(items: DataFrame, threshold: float = THRESHOLD, id_col: str = "item_id", text_col: str = "text", block_shingles: int = 1 << 20) -> Iterator[tuple[ItemIndex, bool]]:
    """The items' blocks, and whether each is the only one."""
    schema = StructType([StructField("i", items.schema[id_col].dataType), StructField("s", BinaryType()), StructField("n", LongType())])

    def cut_up(c: dict) -> dict:
        words = Words(c["t"])
        return {"i": c["i"], "s": [item_shingles(words.of(k)).tobytes() for k in range(len(words))], "n": np.diff(words.offsets)}

    shingled = arrow_map(items.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")), cut_up, schema).filter("n > 0")
    ids, sets, lengths, held, before = [], [], [], 0, False
    for row in shingled.toLocalIterator(prefetchPartitions=False):
        s = np.frombuffer(row.s, np.uint64)
        if held and held + len(s) > block_shingles:
            yield ItemIndex(ids, sets, lengths, threshold), False
            ids, sets, lengths, held, before = [], [], [], 0, True
        ids.append(row.i)
        sets.append(s)
        lengths.append(row.n)
        held += len(s)
    if held:
        yield ItemIndex(ids, sets, lengths, threshold), not before


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text", block_shingles: int = 1 << 20) -> DataFrame:
    """doc_id, item_id, n_shared, n_item, containment."""
    schema = StructType([StructField("doc_id", docs.schema[doc_id].dataType), StructField("item_id", items.schema[item_id].dataType), StructField("n_shared", LongType()), StructField("n_item", LongType()), StructField("containment", DoubleType())])
    texts = docs.select(F.col(doc_id).alias("d"), F.col(text_col).cast("string").alias("t"))
    out = docs.sparkSession.createDataFrame([], schema)
    for index, only in item_blocks(items, threshold, item_id, text_col, block_shingles):

        def find(c: dict, index: ItemIndex = index) -> dict:
            words = Words(c["t"])
            hits = [(c["d"][i], index.ids[j], n, int(index.sizes[j])) for i in range(len(words)) for j, n in index.search(words.of(i))]
            return {"doc_id": [h[0] for h in hits], "item_id": [h[1] for h in hits], "n_shared": [h[2] for h in hits], "n_item": [h[3] for h in hits], "containment": [h[2] / h[3] for h in hits]}

        part = arrow_map(texts, find, schema)
        out = part if only else cut(out.unionByName(cut(part)))
    return out


def clean_documents(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, item_id: str = "item_id", text_col: str = "text", block_shingles: int = 1 << 20) -> DataFrame:
    """The rows of ``docs`` that contain no item; all columns as they are."""
    flag = "_contaminated"
    while flag in docs.columns:
        flag += "_"
    schema = StructType([*docs.schema.fields, StructField(flag, LongType())])
    for index, only in item_blocks(items, threshold, item_id, text_col, block_shingles):

        def judge(c: dict, index: ItemIndex = index) -> dict:
            words = Words(c[text_col])
            return c | {flag: [len(index.search(words.of(i))) for i in range(len(words))]}

        docs = arrow_map(docs, judge, schema).filter(F.col(flag) == 0).drop(flag)
        docs = docs if only else cut(docs)
    return docs
