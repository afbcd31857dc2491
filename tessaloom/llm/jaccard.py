"""N-gram Jaccard join: an LSH forest over MinHash signatures, then exact verification.

1. Texts with the same word sequence fall together; their least doc_id represents them.
2. A representative's set of five-word shingles gets TREES x DEPTH MinHash values, DEPTH to
   each tree. A tree's label is the string of its values.
3. A row's prefixes begin at the whole labels and are shortened, one tree after the other, until a
   row of its number of shingles finds each of its partners in some tree with probability
   ``recall`` (``prefix_lengths``): a set of n shingles can't have every similarity, and the least
   one at or above the threshold that it can have decides. A row stands in a tree under its own
   prefix and under the shorter ones at which other rows may look for it. If the target is out of
   reach, that is an error.
4. The tries are sorted; partitions walk them in order and tie rows that share a prefix with the
   row before. Where a prefix group goes on into the next partition, the partitions' first rows
   are tied, too, so that a group of any size spreads over tasks.
5. Components of ties hold every pair that meets in a tree. All pairs of a component are
   verified exactly, by tiles: its rows are dealt over tiles of bounded rows and shingles, each
   pair of tiles is one cell, and a cell counts the shared shingles of all its pairs at once
   through an inverted index, so rows that share nothing cost nothing. Out of a cell come each
   row's number of links and a spanning forest of the links, never the pairs, so what is written
   grows with rows and tiles.
6. Components of verified links are the classes.

The result has one row per distinct doc_id: doc_id, class_id (least doc_id of the class),
n_links (different texts that its text is linked to), n_copies (ids with the same word
sequence). Texts without words, null ones included, are alike to nothing: each is
its own class. A text of one to four words has one shingle. Rows without an id are left out.
Ids are integers, or strings of them; others are an error. Rows that repeat an id count as one
document, linked to whatever any of its texts is linked to. Texts of any length are used whole
(some 20 bytes a character of the longest are held). Empty tables give no rows; other columns
aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from .components import components
from .runtime import arrow_map, bounded_batches, cut, join_groups, release
from .textops import Words, mix, shingle_sets, shingles

TREES, DEPTH = 20, 6
THRESHOLD, RECALL = 0.8, 0.9999
TILE_ROWS, TILE_SHINGLES = 128, 1 << 18
OWN_SIZES = 32


def least_similarity(n: int, threshold: float) -> float:
    """The least similarity from ``threshold`` on that a set of n can have with another; the
    threshold itself from OWN_SIZES on."""
    if n >= OWN_SIZES:
        return threshold
    # sharing i of n with a set of m gives i / (n + m - i): the greatest m that still reaches it
    unions = [(i, int(i / threshold + 1e-9)) for i in range(1, n + 1)]
    return min(i / union for i, union in unions if union >= n)


@lru_cache(256)
def prefix_lengths(n: int, threshold: float, recall: float, trees: int = TREES, depth: int = DEPTH) -> tuple[int, ...]:
    """The prefix of each tree by which a row of n shingles finds a partner with ``recall``: from
    whole labels, the longest is shortened again and again, but no more than it takes."""
    similarity, lengths = least_similarity(n, threshold), [depth] * trees
    while 1 - math.prod(1 - similarity**d for d in lengths) < recall:
        longest = max(lengths)
        if longest == 1:
            raise ValueError(f"{trees} trees don't reach a recall of {recall} at {threshold}")
        lengths[lengths.index(longest)] -= 1
    return tuple(lengths)


_rng = np.random.default_rng(20240607)
_A = _rng.integers(1, 1 << 63, TREES * DEPTH, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, TREES * DEPTH, np.uint64)


def signature(shingle_hashes: np.ndarray) -> np.ndarray:
    """The MinHash values (upper 32 bits), big-endian so that bytes sort as numbers."""
    least = np.full(len(_A), np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(shingle_hashes), 512):
        np.minimum(least, (shingle_hashes[lo : lo + 512, None] * _A + _B).min(0), out=least)
    return (least >> np.uint64(32)).astype(">u4")


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, key (128 bits of the word sequence; null without words), n (shingles), labels."""
    schema = StructType([StructField("doc_id", LongType()), StructField("key", BinaryType()), StructField("n", IntegerType()), StructField("labels", BinaryType())])

    def run(c: dict) -> dict:
        words, keys, n, labels = Words(c["t"]), [], [], []
        for i in range(len(words)):
            w = words.of(i)
            s = np.unique(shingles(w))
            n.append(len(s))
            if not len(s):
                keys.append(None)
                labels.append(None)
                continue
            at = np.arange(1, len(w) + 1, dtype=np.uint64)
            key = [mix(w ^ mix(at * np.uint64(0x9E3779B97F4A7C15))).sum(dtype=np.uint64), mix(w + mix(at * np.uint64(0xC2B2AE3D27D4EB4F))).sum(dtype=np.uint64)]
            keys.append(np.array(key, np.uint64).tobytes())
            labels.append(signature(s).tobytes())
        return {"doc_id": c["d"], "key": keys, "n": n, "labels": labels}

    return arrow_map(docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("d"), F.col(text_col).cast("string").alias("t")), run, schema)


def trie_rows(rows: DataFrame, threshold: float, recall: float) -> DataFrame:
    """(tree, prefix, id): each representative (doc_id, n, labels) under its own prefix of each
    tree, and under the shorter ones of larger rows. ``tree`` counts the prefix lengths apart."""
    step = 4 * DEPTH
    whole = prefix_lengths(OWN_SIZES, threshold, recall)
    own = "".join(str(d) for n in range(1, OWN_SIZES + 1) for d in prefix_lengths(n, threshold, recall))
    shortest = "".join(map(str, whole))
    places = f"""flatten(transform(sequence(0, {TREES - 1}), i -> transform(
        sequence(int(substring('{shortest}', i + 1, 1)), int(substring('{own}', (least(n, {OWN_SIZES}) - 1) * {TREES} + i + 1, 1))),
        d -> struct(i * {DEPTH + 1} + d as tree, substring(labels, i * {step} + 1, 4 * d) as prefix))))"""
    return rows.select(F.explode(F.expr(places)).alias("at"), F.col("doc_id").alias("id")).select("at.tree", "at.prefix", "id")


TIES = "a long, b long, tree int, prefix binary, edge boolean"


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ties of neighbours in a stretch of the sorted tries, and its first and last groups."""
    import pyarrow.compute as pc

    last = first = head = None  # last: key and id of the row before; head: the open group's first row
    for batch in batches:
        if not batch.num_rows:
            continue
        tree, prefix, ids = batch.column("tree"), batch.column("prefix"), batch.column("id").to_numpy()
        same = pc.and_(pc.equal(tree[1:], tree[:-1]), pc.equal(prefix[1:], prefix[:-1])).to_numpy(zero_copy_only=False)
        key = tree[0].as_py(), prefix[0].as_py()
        same = np.append(last is not None and last[0] == key, same)
        neighbour = np.append(last[1] if last else ids[0], ids[:-1])
        if first is None:
            first = (*key, int(ids[0]))
        if not same.all():
            head = int(ids[np.flatnonzero(~same)[-1]])
        last = (tree[-1].as_py(), prefix[-1].as_py()), int(ids[-1])
        tied = same & (neighbour != ids)
        pairs = np.unique(np.column_stack((np.minimum(ids, neighbour), np.maximum(ids, neighbour)))[tied], axis=0)
        m = len(pairs)
        if m:
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0], pa.int64()), pa.array(pairs[:, 1], pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary()), pa.array([False] * m)], names=["a", "b", "tree", "prefix", "edge"])
    if first is not None:  # the stretch's first and last groups may go on next door
        edges = sorted({first, (*last[0], head)})
        yield pa.RecordBatch.from_arrays([pa.array([e[2] for e in edges], pa.int64()), pa.nulls(len(edges), pa.int64()), pa.array([e[0] for e in edges], pa.int32()), pa.array([e[1] for e in edges], pa.binary()), pa.array([True] * len(edges))], names=["a", "b", "tree", "prefix", "edge"])


def ties(rows: DataFrame, threshold: float, recall: float) -> DataFrame:
    """Distinct (a, b), a < b, of representatives (doc_id, n, labels): rows of one prefix group
    are in one component of them."""
    parts = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    walked = cut(trie_rows(rows, threshold, recall).repartitionByRange(parts, "tree", "prefix", "id").sortWithinPartitions("tree", "prefix", "id").mapInArrow(_walk, TIES))
    ends = walked.filter("edge")
    heads = ends.groupBy("tree", "prefix").agg(F.min("a").alias("h"), F.count("*").alias("k")).filter("k > 1")
    across = ends.join(heads, ["tree", "prefix"]).filter("a != h").select(F.least("a", "h").alias("a"), F.greatest("a", "h").alias("b"))
    return walked.filter("not edge").select("a", "b").unionByName(across).distinct()


def linked(left: list[np.ndarray], right: list[np.ndarray], threshold: float, most: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in ``left``, in ``right``) of the pairs of shingle sets that reach the
    threshold. Shared shingles are counted for ``most`` postings at a time, one row at least."""
    sizes, others = np.array([len(s) for s in left], np.int64), np.array([len(s) for s in right], np.int64)
    values, owner = np.concatenate(left), np.repeat(np.arange(len(left)), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    probe = np.concatenate(right)
    lo = np.searchsorted(values, probe, "left")
    hits = np.searchsorted(values, probe, "right") - lo
    ends = np.cumsum(others)
    load = np.append(0, np.cumsum(hits))[np.append(0, ends)]  # postings before each row of ``right``
    a, b, start = [], [], 0
    while start < len(right):
        stop = max(start + 1, int(np.searchsorted(load, load[start] + most, "right")) - 1)
        part = slice(ends[start] - others[start], ends[stop - 1])
        n, row = hits[part], np.repeat(np.arange(stop - start), others[start:stop])
        at = np.repeat(lo[part] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        shared = np.bincount(np.repeat(row, n) * len(left) + owner[at], minlength=(stop - start) * len(left)).reshape(stop - start, len(left))
        union = others[start:stop, None] + sizes[None] - shared
        y, x = np.nonzero((shared > 0) & (shared >= threshold * union - 1e-9))
        a.append(x)
        b.append(y + start)
        start = stop
    return np.concatenate(a), np.concatenate(b)


def spanning(a: np.ndarray, b: np.ndarray, nodes: int) -> list[tuple[int, int]]:
    """A forest of links (a, b) over nodes 0 to ``nodes`` - 1: in rounds, each node takes its
    first link into another tree."""
    root, chosen = np.arange(nodes), []
    while len(a):
        picks = {*np.unique(root[a], return_index=True)[1].tolist(), *np.unique(root[b], return_index=True)[1].tolist()}
        parent = {}

        def find(x: int) -> int:
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        for k in sorted(picks):
            x, y = find(int(root[a[k]])), find(int(root[b[k]]))
            if x != y:
                parent[max(x, y)] = min(x, y)
                chosen.append((int(a[k]), int(b[k])))
        to = np.arange(nodes)
        for x in list(parent):
            to[x] = find(x)
        root = to[root]
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return chosen


def _cells(threshold: float):
    """Streams (group, i, j, tile, id, text) by cell; gives links (a, b) and counts (a, null, k)."""
    import pyarrow.compute as pc

    def flush(cell: tuple, tiles: dict) -> pa.RecordBatch | None:
        left, right = tiles.get(cell[1], ([], [])), tiles.get(cell[2], ([], []))
        if not left[0] or not right[0]:
            return None
        a, b = linked(left[1], right[1], threshold)
        one, two = np.array(left[0], np.int64), np.array(right[0], np.int64)
        if cell[1] == cell[2]:
            a, b = a[a < b], b[a < b]
            ids, shift = one, 0
        else:
            ids, shift = np.concatenate((one, two)), len(one)
        other = one[a] != two[b]  # an id that repeats is one document
        a, b = a[other], b[other] + shift
        if not len(a):
            return None
        links = spanning(a, b, len(ids))
        k = np.bincount(np.concatenate((a, b)), minlength=len(ids))
        at = np.flatnonzero(k)
        return pa.RecordBatch.from_arrays([pa.array([*(int(ids[x]) for x, _ in links), *ids[at].tolist()], pa.int64()), pa.array([*(int(ids[y]) for _, y in links), *[None] * len(at)], pa.int64()), pa.array([*[0] * len(links), *k[at].tolist()], pa.int64())], names=["a", "b", "k"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, tiles = None, {}
        for batch in batches:
            lengths = np.nan_to_num(pc.binary_length(batch.column("t")).to_numpy(zero_copy_only=False)).astype(np.int64)
            group = np.cumsum(lengths) >> 20
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                part = batch.slice(lo, hi - lo)
                sets = shingle_sets(part.column("t").to_pylist())
                for at, tile, i, s in zip(zip(*(part.column(c).to_pylist() for c in ("group", "i", "j"))), part.column("tile").to_pylist(), part.column("id").to_pylist(), sets):
                    if at != cell:
                        if cell is not None and (out := flush(cell, tiles)) is not None:
                            yield out
                        cell, tiles = at, {}
                    ids, held = tiles.setdefault(tile, ([], []))
                    ids.append(i)
                    held.append(s)
        if cell is not None and (out := flush(cell, tiles)) is not None:
            yield out
        tiles = out = None
        release()

    return run


def verified(tied: DataFrame, sizes: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b, k = 0) that span the components of exact links, and (a, null, k) with row
    a's number of links in one cell. ``sizes``: doc_id, n; ``texts``: id, t.

    Tiles hold TILE_ROWS rows (in groups of over 32 tiles a 32nd of the group, up to 16 times as
    many) and about TILE_SHINGLES shingles."""
    grouped = cut(components(tied).join(sizes.groupBy(F.col("doc_id").alias("node")).agg(F.sum("n").alias("n")), "node"))
    tiles = grouped.groupBy("component").agg(F.count("*").alias("rows"), F.sum("n").alias("n")).withColumn("tiles", F.greatest(F.ceil(F.col("rows") / F.least(F.lit(16 * TILE_ROWS), F.greatest(F.lit(TILE_ROWS), F.col("rows") / 32))), F.ceil(F.col("n") / TILE_SHINGLES)).cast("int")).drop("n")
    placed = join_groups(grouped.select("node", "component"), tiles, "component", "rows").select(F.col("node").alias("id"), F.col("component").alias("group"), F.pmod(F.xxhash64("node"), "tiles").cast("int").alias("tile"), "tiles")
    dealt = texts.join(placed, "id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select("group", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "id", "t")
    parts = max(2, int(tied.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return bounded_batches(dealt.repartition(parts, "group", "i", "j").sortWithinPartitions("group", "i", "j", "tile", "id")).mapInArrow(_cells(threshold), "a long, b long, k long")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id, n_links, n_copies."""
    signed = cut(signatures(docs, id_col, text_col))
    keyed = signed.filter("key is not null")
    groups = keyed.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count_distinct("doc_id").alias("n_copies"), F.first("n").alias("n"), F.first("labels").alias("labels"), F.count("*").alias("rows"))
    reps = groups.select(F.col("rep").alias("doc_id"), "n", "labels")
    tied = cut(ties(reps, threshold, recall))
    texts = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    found = cut(verified(tied, reps, texts, threshold))
    links = found.filter("b is not null").select("a", "b")
    several = keyed.groupBy("doc_id").agg(F.min("key").alias("x"), F.max("key").alias("y")).filter("x < y")
    same_id = keyed.join(several, "doc_id", "left_semi").join(groups.select("key", "rep"), "key").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    classes = components(links.unionByName(same_id))
    counted = found.filter("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("k").alias("n_links"))
    known = classes.select(F.col("node").alias("rep"), "component").join(counted, "rep", "left")
    # a class is known by key before the copies come in, so no join meets them all in one task
    by_key = groups.select("key", "rep", "n_copies", "rows").join(known, "rep", "left").select("key", F.coalesce("component", "rep").alias("class_id"), "n_links", "n_copies", "rows")
    members = join_groups(keyed.select("doc_id", "key"), by_key, "key", "rows").drop("key")
    wordless = signed.filter("key is null").select("doc_id")
    return members.unionByName(wordless, allowMissingColumns=True).groupBy("doc_id").agg(
        F.coalesce(F.min("class_id"), F.col("doc_id")).alias("class_id"),
        F.coalesce(F.sum("n_links"), F.lit(0)).cast("long").alias("n_links"),
        F.coalesce(F.max("n_copies"), F.lit(1)).cast("long").alias("n_copies"),
    )


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row of the least doc_id of every class (where an id repeats, the row of the least hash
    of all columns), and the rows without an id; all columns as they are."""
    kept = near_duplicates(docs, threshold, recall, id_col, text_col).filter("doc_id = class_id").select(F.col("doc_id").alias("kept"))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    single = docs.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("kept")).agg(F.min_by(row, F.xxhash64(row)).alias("row"))
    clean = single.join(kept, "kept", "left_semi").select("row.*")
    return clean.unionByName(docs.filter(F.col(id_col).isNull()))
