"""Language identification by language-bitmask n-gram filters.

A bit-sliced Bloom filter has one bitmask of languages in every slot: the AND of an n-gram's
slots gives all languages that contain it. A text's n-grams (2 to 4 code points of lower-cased
words, word edges included) vote: per language, the popcount of the masks, less the false
positives that the language's fill predicts. The language of the greatest corrected share wins
(ties: the more frequent in training, then by name); the score is its share.

A language contains an n-gram if it occurs MIN_COUNT times in its training rows, and at a rate
of at least DOMINANCE of the n-gram's greatest rate, so that stray foreign words don't count.
All such n-grams of all values of lang are learned. N-grams are counted, compared and turned
into slots on the executors; to the driver come the languages' names and the filter's slots that
aren't empty, at most FILTER_BYTES of masks: with more than 256 languages the filter has fewer
slots, and more false positives to correct.

The fit uses, of each language, about MAX_ROWS ids by hash (a documented bound; whole texts),
of documents outside the held-out fold, with text and lang; an id that repeats in a language
counts once, with its least text. Rows without an id belong to neither fold and aren't learned
from. ``lang``, ``source`` and ids are never inputs of a prediction. Texts that are null or have
no letter are ``und`` with score 0; so is every text when nothing could be learned. A text
without any known n-gram gets the most frequent language, score 0. An empty table gives no rows.
Rows are independent: repeated ids and rows each give their row; other columns aren't read. Texts
go through by slices of a quarter of a million characters, one text at least, in some 60 bytes a
character.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from .runtime import arrow_map, cut
from .textops import mix

MAX_ROWS = 1500
MIN_COUNT = 3
DOMINANCE = 0.1
SIZES = (2, 3, 4)
SLOT_BITS = 21
FILTER_BYTES = 1 << 26
SMALL = 1 << 16  # languages whose table is broadcast
UNKNOWN = "und"
_MUL = [np.uint64(pow(0x9E3779B97F4A7C15, i + 1, 1 << 64)) for i in range(max(SIZES))]
_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _letters:
        out = np.zeros(0x110000, np.uint32)
        for code in range(0x110000):
            c = chr(code)
            if c.isalpha():
                out[code] = ord(c.lower()[0])
        _letters.append(out)
    return _letters[0]


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of all texts, and the text number of each. A run of other
    characters counts as one edge; an edge stands first or last in an n-gram only."""
    joined = "\n" + "\n".join(t or "" for t in texts) + "\n"
    letters = _letter_table()[np.frombuffer(joined.encode("utf-32-le"), np.uint32)]
    ends = np.cumsum([len(t or "") + 1 for t in texts])
    keep = letters != 0
    keep[1:] |= letters[:-1] != 0  # the first of every run of edges
    keep[0] = True
    at = np.flatnonzero(keep)
    codes = letters[at].astype(np.uint64)
    owner = np.searchsorted(ends, at, "left")
    filled = codes != 0
    out, owners = [], []
    for n in SIZES:
        m = len(codes) - n + 1
        if m <= 0:
            continue
        fine = np.ones(m, bool)
        for i in range(1, n - 1):
            fine &= filled[i : i + m]
        if n == 2:
            fine = filled[:m] | filled[1 : 1 + m]
        h = np.zeros(m, np.uint64)
        for i in range(n):
            h += (codes[i : i + m] + np.uint64(n)) * _MUL[i]
        out.append(mix(h[fine]))
        # a letter's text: an n-gram starts at an edge before its text at the earliest
        owners.append(owner[n - 2 : n - 2 + m][fine] if n > 2 else np.where(filled[:m], owner[:m], owner[1 : 1 + m])[fine])
    return (np.concatenate(out), np.concatenate(owners)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


@dataclass
class LanguageFilter:
    languages: list[str]  # by falling frequency
    slots: np.ndarray  # masks of languages, words of a mask side by side
    false_rate: np.ndarray

    def votes(self, hashes: np.ndarray, owner: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
        """Corrected share of n-grams by text and language; n-grams by text."""
        total = np.bincount(owner, minlength=texts)
        out = np.zeros((texts, len(self.languages)))
        bits = len(self.slots).bit_length() - 1
        mask = self.slots[_slot(hashes, 0, bits)] & self.slots[_slot(hashes, 1, bits)]
        for i in range(len(self.languages)):
            word, bit = divmod(i, 64)
            hit = (mask[:, word] >> mask.dtype.type(bit)) & mask.dtype.type(1)
            out[:, i] = np.bincount(owner, hit, texts)
        return np.maximum(0, out - total[:, None] * self.false_rate) / (1 - self.false_rate) / np.maximum(1, total)[:, None], total

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        share, _ = self.votes(*grams(texts), len(texts))
        best = share.argmax(1)
        score = share[np.arange(len(texts)), best]
        letters = np.array([any(map(str.isalpha, set(t))) if t else False for t in texts], bool)
        return [self.languages[b] if fine else UNKNOWN for b, fine in zip(best, letters)], np.where(letters, np.clip(score, 0, 1), 0.0)


def _slot(hashes: np.ndarray, k: int, bits: int) -> np.ndarray:
    return ((hashes >> np.uint64(SLOT_BITS * k)) & np.uint64((1 << bits) - 1)).astype(np.int64)


def shape(languages: int) -> tuple[int, int, type]:
    """Bits of a slot's number, words of a mask, and their type, within FILTER_BYTES."""
    words = -(-languages // 64)
    dtype = next(t for t, bits in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 1 << 60)) if languages <= bits)
    most = FILTER_BYTES // (words * np.dtype(dtype).itemsize)
    return max(1, min(SLOT_BITS, most.bit_length() - 1)), words, dtype


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def language_grams(docs: DataFrame, max_rows: int, id_col: str, text_col: str, lang_col: str) -> tuple[list[str], DataFrame | None]:
    """The languages by falling frequency, and l (number of a language), gram of what they contain."""
    rows = docs.filter(F.col(id_col).isNotNull() & ~held_out(id_col) & F.col(lang_col).isNotNull()).select(F.col(id_col).cast("string").alias("d"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("t"))
    frequent = rows.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("d", 0.02).alias("ids")).orderBy(F.desc("n"), "lang").collect()
    if not frequent:
        return [], None
    small = F.broadcast if len(frequent) <= SMALL else lambda x: x
    numbers = docs.sparkSession.createDataFrame([(r.lang, i, max_rows / max(1, r.ids)) for i, r in enumerate(frequent)], "lang string, l int, share double")
    chosen = rows.join(small(numbers), "lang").filter(F.pmod(F.xxhash64("d"), F.lit(1 << 20)) < F.col("share") * (1 << 20)).groupBy("l", "d").agg(F.min("t").alias("t")).select("l", "t")
    schema = StructType([StructField("l", IntegerType()), StructField("gram", LongType()), StructField("n", LongType())])

    def count(c: dict) -> dict:
        out = {"l": [], "gram": [], "n": []}
        for l in sorted(set(c["l"])):
            h, n = np.unique(grams([t for t, x in zip(c["t"], c["l"]) if x == l])[0], return_counts=True)
            out["l"] += [l] * len(h)
            out["gram"] += h.view(np.int64).tolist()
            out["n"] += n.tolist()
        return out

    counts = cut(arrow_map(chosen, count, schema).groupBy("l", "gram").agg(F.sum("n").alias("n")).filter(F.col("n") >= MIN_COUNT))
    totals = counts.groupBy("l").agg(F.sum("n").alias("total"))
    rates = counts.join(small(totals), "l").select("l", "gram", (F.col("n") / F.col("total")).alias("rate"))
    greatest = rates.groupBy("gram").agg(F.max("rate").alias("greatest"))
    return [r.lang for r in frequent], rates.join(greatest, "gram").filter(F.col("rate") >= DOMINANCE * F.col("greatest")).select("l", "gram")


def fit(docs: DataFrame, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageFilter:
    languages, kept = language_grams(docs, max_rows, id_col, text_col, lang_col)
    if not languages:
        return LanguageFilter([], np.zeros((1, 1), np.uint64), np.zeros(0))
    bits, words, dtype = shape(len(languages))
    places = F.array(*(F.shiftrightunsigned("gram", SLOT_BITS * k).bitwiseAND(F.lit((1 << bits) - 1)) for k in range(2)))
    masks = kept.select(F.explode(places).alias("slot"), F.floor(F.col("l") / 64).alias("word"), F.expr("shiftleft(1L, l % 64)").alias("bit")).groupBy("slot", "word").agg(F.bit_or("bit").alias("mask"))
    found = masks.toArrow()  # a row for each part of the filter that isn't empty
    slots = np.zeros((1 << bits, words), dtype)
    slot, word, mask = (found.column(c).to_numpy() for c in ("slot", "word", "mask"))
    slots[slot, word] = mask.view(np.uint64).astype(dtype)
    fill = np.array([np.count_nonzero(slots[:, i // 64] & dtype(1 << i % 64)) for i in range(len(languages))]) / len(slots)
    return LanguageFilter(languages, slots, np.minimum(fill**2, 0.5))


def identify(docs: DataFrame, model: LanguageFilter, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    schema = StructType([StructField("doc_id", docs.schema[id_col].dataType), StructField("held_out", BooleanType()), StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def run(c: dict) -> dict:
        lang, score = model.predict(c["t"])
        return {"doc_id": c["d"], "held_out": c["h"], "lang_pred": lang, "score": score}

    return arrow_map(docs.select(F.col(id_col).alias("d"), held_out(id_col).alias("h"), F.col(text_col).cast("string").alias("t")), run, schema, 1 << 18)
