"""Unigram token counts by trie-shared dynamic programming.

Pre-tokens are stretches between white space, led by the piece alphabet's word mark. The
distinct pre-tokens of a slice are inserted in a trie; a walk over it computes the unigram
forward score of every prefix once (the best sum of log-probabilities of pieces that spell it,
ties to fewer pieces), however many pre-tokens share it, and stores the number of pieces at the
terminal nodes. Characters outside the vocabulary fall back to their bytes, one piece a byte.

Pieces come from a public vocabulary. No unigram file is at hand, so its order gives their
log-probabilities, by Zipf's law: the counts are those of that model, not of the file's own
tokenizer; nothing is trained. Results: doc_id, n_pretokens, n_tokens of every row; null and empty texts
count 0. Rows are independent: repeated ids and rows each give their row; other columns aren't
read, and an empty table gives no rows. A pre-token of any length is scored whole, in some 16
bytes a character. Nothing is shuffled; counts of words seen before come from a cache of bounded
size.
"""

from __future__ import annotations

import math
from array import array

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .runtime import arrow_map

MARK = "▁"
CACHE_WORDS = 400_000
CACHE_LENGTH = 64
SCALE = 1 << 20
END = ""


def zipf_pieces(path: str) -> dict[str, int]:
    """Pieces of a sentencepiece file and the logarithms of their probabilities, proportional to
    1 / rank, in units of 1 / SCALE: whole numbers add up without error, so ties are exact."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    norm = math.log(sum(1 / (i + 1) for i in range(len(names))))
    return {t: round(SCALE * (-math.log(i + 1) - norm)) for i, t in enumerate(names)}


def shared_prefixes(words: list[str]) -> list[int]:
    """For sorted distinct words, how many characters each shares with the one before."""
    out, before = [], ""
    for word in words:
        n, most = 0, min(len(word), len(before))
        if word[:most] == before[:most]:
            n = most
        else:
            while word[n] == before[n]:
                n += 1
        out.append(n)
        before = word
    return out


class TrieCounter:
    """The trie of pre-tokens is kept in depth-first order: sorted distinct words, each with the
    depth at which it leaves the path of the one before; its edge is the rest of the word. So a
    node costs no object, and memory follows the words and the longest of them."""

    def __init__(self, pieces: dict[str, int]):
        self.backward: dict = {}  # the pieces' trie, read from their ends
        for piece, score in pieces.items():
            node = self.backward
            for c in reversed(piece):
                node = node.setdefault(c, {})
            node[END] = score
        self.byte_score = min(pieces.values(), default=0) - 10 * SCALE
        self.cache: dict[str, int] = {}

    def count(self, words) -> dict[str, int]:
        """Word to number of pieces, each shared prefix scored once."""
        words = sorted(set(words))
        byte_score, backward, out = self.byte_score, self.backward, {}
        scores, counts = array("q", [0]), array("q", [0])  # of the prefixes on the path
        for word, depth in zip(words, shared_prefixes(words)):
            del scores[depth + 1 :], counts[depth + 1 :]
            for end in range(depth, len(word)):
                c = word[end]
                size = 1 if c < "\x80" else len(c.encode("utf-8"))
                best, least = scores[end] + size * byte_score, counts[end] + size
                place, begin = backward.get(c), end
                while place is not None:
                    score = place.get(END)
                    if score is not None:
                        score += scores[begin]
                        if score > best or (score == best and counts[begin] + 1 < least):
                            best, least = score, counts[begin] + 1
                    if not begin:
                        break
                    begin -= 1
                    place = place.get(word[begin])
                scores.append(best)
                counts.append(least)
            out[word] = counts[-1]
        return out

    def totals(self, texts: list[str | None]) -> tuple[list[int], list[int]]:
        split = [[MARK + w for w in t.split()] if t else [] for t in texts]
        cache = self.cache
        new = {w for words in split for w in words if w not in cache}
        if new:
            if len(cache) + len(new) > CACHE_WORDS:
                cache.clear()
                new = {w for words in split for w in words}
            cache.update(self.count(new))
        totals = [len(w) for w in split], [sum(map(cache.__getitem__, w)) for w in split]
        for w in new:  # long words aren't kept
            if len(w) > CACHE_LENGTH:
                del cache[w]
        return totals


_loaded: dict[str, TrieCounter] = {}


def counter(path: str) -> TrieCounter:
    if path not in _loaded:
        _loaded[path] = TrieCounter(zipf_pieces(path))
    return _loaded[path]


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    schema = StructType([StructField("doc_id", docs.schema[id_col].dataType), StructField("n_pretokens", LongType()), StructField("n_tokens", LongType())])

    def run(c: dict) -> dict:
        words, tokens = counter(path).totals(c["t"])
        return {"doc_id": c["d"], "n_pretokens": words, "n_tokens": tokens}

    return arrow_map(docs.select(F.col(id_col).alias("d"), F.col(text_col).cast("string").alias("t")), run, schema)
