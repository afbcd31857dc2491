"""BPE encoding by a bounded-lookahead streaming transducer, and incremental decoding.

The vocabulary is a tokenizers file of the word-end kind (lower case, white space dropped).

Encoding. A pre-token's symbols enter a buffer. A token at the buffer's left is stable, and is
emitted and forgotten, once as many symbols follow it as can bear on it. ``lookaheads`` computes
that number for every token from the merge list; the greatest is the list's sufficient lookahead,
which bounds the buffer. Merges act in the order of their ranks. A rule (u, v) needs v to form, and
v not to be taken by an earlier rule (v, y); likewise u, less the width of v. A formed token can
still be taken by any rule (t, y), if y forms. Ranks fall along these chains, so one pass over the
rules gives the numbers. This holds where every rule makes a token of its own from parts made
before it; other lists have no bound, and their pre-tokens are emitted at their ends. The buffer
is looked at every STEP symbols and at the pre-token's end. The merges inside it take the pair of
least rank, leftmost first, by scanning or, in longer buffers, from a heap over a linked list.

Decoding feeds the tokens' bytes, in order, into an incremental UTF-8 state machine whose state
goes on from token to token, so characters split over tokens come out whole, and invalid bytes as
U+FFFD. ``decode`` gives the text (a word end is a space); ``render`` gives what the file's own
decoder gives (the file here names none: token strings joined by a space).

Special tokens in a text are recognised as the library does; none are added. Null counts as
empty: no tokens. An empty table gives no rows. Rows are independent: repeated ids, null ids and
repeated rows each give their row; other columns aren't read. Whole texts of any length are
encoded. Nothing is shuffled. Words seen before come from a cache of bounded size.
"""

from __future__ import annotations

import codecs
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from hashlib import sha256
from itertools import chain, islice

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .runtime import arrow_map

#: The code points of white space.
_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACES = re.compile(f"[{_SPACE}]+")
CACHE_WORDS = 500_000
CACHE_LENGTH = 64
SHORT = 24
STEP = 32
FEED = 4096  # words whose bytes enter the decoder at once
NEVER = 1 << 60
ID_BITS = 20
ID_MASK = (1 << ID_BITS) - 1


def byte_alphabet() -> list[str]:
    """The printable stand-in of every byte, as byte-level vocabularies write it."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def lookaheads(merges: list[tuple[str, str]], width) -> dict[str, int] | None:
    """By token, the symbols right of its end that can bear on it, at most (0 if not listed);
    ``width`` of a token. None if the list gives no bound."""
    need: dict[str, int] = {}
    made = {u + v for u, v in merges}
    if len(made) < len(merges):
        return None
    for u, v in merges:
        beyond, wide = need.get(v, 0), width(v)
        if u in made or v in made or u + v not in made:
            return None  # a part is made later
        made.discard(u + v)
        forms = max(beyond, need.get(u, 0) - wide)
        need[u] = max(need.get(u, 0), wide + beyond)
        need[u + v] = max(need.get(u + v, 0), forms)
    return need


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.names = {i: t for t, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names |= {i: t for t, i in self.special.items()}
        self.name_bytes = {i: t.encode("utf-8") for i, t in self.names.items()}
        self.prepare([tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]], model["vocab"], model["end_of_word_suffix"] or "")
        alphabet = byte_alphabet()
        self.byte_ids = [self.vocab[c] for c in alphabet]
        self.last_ids = [self.vocab[c + self.end] for c in alphabet]
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", _SPACE))
        self.recent: dict[str, list[int]] = {}
        bytes_of = {c: b for b, c in enumerate(alphabet)}
        self.token_bytes = {i: t.encode() if t in self.special else bytes(bytes_of[c] for c in t.removesuffix(self.end)) + b" " * bool(self.end and t.endswith(self.end)) for i, t in self.names.items()}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def prepare(self, merges: list[tuple[str, str]], vocab: dict[str, int], end: str) -> None:
        """Merges by the ids of a pair, as one number: rank, then the made token's id."""
        self.vocab, self.end = vocab, end
        width = lambda t: len(t.removesuffix(end))
        need = lookaheads(merges, width)
        self.pairs = {vocab[u] << ID_BITS | vocab[v]: r << ID_BITS | vocab[u + v] for r, (u, v) in enumerate(merges)}
        self.width = {i: width(t) for t, i in vocab.items()}
        self.need = {i: need.get(t, 0) for t, i in vocab.items()} if need is not None else None
        self.lookahead = max(self.need.values(), default=0) if need is not None else None

    # --- encoding

    def merge(self, symbols: list[int]) -> list[int]:
        """Merges of a bounded buffer of ids: always the pair of least rank, leftmost first."""
        n = len(symbols)
        if n < 2:
            return symbols
        if n <= SHORT:
            return self._merge_short(symbols[:])
        parts, after, before = list(symbols), [*range(1, n), -1], [*range(-1, n - 1)]
        pairs = self.pairs
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := pairs.get(parts[i] << ID_BITS | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], parts[j] = rank & ID_MASK, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := pairs.get(parts[i] << ID_BITS | parts[k])) is not None:
                    heapq.heappush(heap, (r, i, parts[i], parts[k]))
            h = before[i]
            if h >= 0 and (r := pairs.get(parts[h] << ID_BITS | parts[i])) is not None:
                heapq.heappush(heap, (r, h, parts[h], parts[i]))
        return [p for p in parts if p >= 0]

    def _merge_short(self, parts: list[int]) -> list[int]:
        """The same by scanning, which is quicker than a heap for a few symbols."""
        get = self.pairs.get
        ranks = [get(a << ID_BITS | b, NEVER) for a, b in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == NEVER:
                break
            i = ranks.index(least)
            made = least & ID_MASK
            parts[i : i + 2] = (made,)
            del ranks[i]
            if i < len(ranks):
                ranks[i] = get(made << ID_BITS | parts[i + 1], NEVER)
            if i:
                ranks[i - 1] = get(parts[i - 1] << ID_BITS | made, NEVER)
        return parts

    def stream(self, symbols: Iterable[int], step: int = STEP) -> Iterator[int]:
        """Tokens of one pre-token from its symbols, each soon after it is stable."""
        buffer: list[int] = []
        symbols, need, width = iter(symbols), self.need, self.width
        while more := list(islice(symbols, step)):
            buffer += more
            if len(more) < step or need is None:
                continue
            used = 0
            for token in self.merge(buffer):
                end = used + width[token]
                if len(buffer) - end < need[token]:
                    break
                used = end
                yield token
            del buffer[:used]
        yield from self.merge(buffer)

    def symbols(self, piece: str) -> Iterator[int]:
        data = piece.encode("utf-8")
        return chain(map(self.byte_ids.__getitem__, data[:-1]), (self.last_ids[data[-1]],))

    def piece(self, piece: str) -> list[int]:
        """Ids of one pre-token."""
        return list(self.stream(self.symbols(piece)))

    def word(self, word: str) -> list[int]:
        """Ids of a stretch without white space, normalised already."""
        pieces = [word] if word.isalpha() else self.pattern.findall(word)
        if len(pieces) == 1:
            return self.piece(pieces[0])
        out: list[int] = []
        for p in pieces:
            ids = self.recent.get(p)
            if ids is None:
                ids = self.piece(p)
                if len(self.recent) >= CACHE_WORDS:
                    self.recent.clear()
                if len(p) <= CACHE_LENGTH:
                    self.recent[p] = ids
            out += ids
        return out

    @staticmethod
    def normal(text: str) -> str:
        text = unicodedata.normalize("NFC", text)
        return text.replace("\u03a3", "\u03c3").lower()  # one code point at a time: no final sigma

    @staticmethod
    def stretches(text: str) -> list[str]:
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # str.split parts there, too
            return [w for w in _SPACES.split(text) if w]
        return text.split()

    def segments(self, text: str) -> Iterator[tuple[int | None, str]]:
        """(id of a special token or None, text between special tokens)."""
        for part in self.split.split(text) if self.split else [text]:
            if part in self.special:
                yield self.special[part], part
            elif part:
                yield None, part

    # --- decoding

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """Pieces of text; a word end gives a space."""
        return decoded(map(self.token_bytes.__getitem__, ids))

    def render(self, ids: list[int]) -> str:
        """The file's own decoding: the token strings, joined by a space."""
        return "".join(decoded(x for k, i in enumerate(ids) for x in ((b" ", self.name_bytes[i]) if k else (self.name_bytes[i],))))


def decoded(chunks: Iterable[bytes]) -> Iterator[str]:
    """Pieces of text from bytes cut anywhere: the state machine carries what is incomplete."""
    machine = codecs.getincrementaldecoder("utf-8")("replace")
    feed = machine.decode
    for chunk in chunks:
        if piece := feed(chunk):
            yield piece
    if piece := feed(b"", True):
        yield piece


class _Cache(dict):
    """What ``make`` gives for a word; forgets all when full."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word: str):
        made = self.make(word)
        if len(word) <= CACHE_LENGTH:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = made
        return made


_loaded: dict[str, tuple[Bpe, _Cache, _Cache]] = {}


def forget() -> None:
    """Drops the loaded vocabularies and the words seen."""
    _loaded.clear()


def loaded(path: str) -> tuple[Bpe, _Cache, _Cache]:
    """The vocabulary, and by word: (ids as text, bytes of their names), (ids, bytes of their text)."""
    if path not in _loaded:
        bpe = Bpe(path)
        names, raw = bpe.name_bytes.__getitem__, bpe.token_bytes.__getitem__

        def shown(word: str) -> tuple[str, bytes]:
            ids = bpe.word(word)
            return " ".join(map(str, ids)), b" ".join(map(names, ids))

        def plain(word: str) -> tuple[list[int], bytes]:
            ids = bpe.word(word)
            return ids, b"".join(map(raw, ids))

        _loaded[path] = bpe, _Cache(shown), _Cache(plain)
    return _loaded[path]


def _words(bpe: Bpe, text: str | None, cache: _Cache, of_special) -> Iterator[tuple]:
    """Of a text's words in order, what the cache has of each."""
    for special, part in bpe.segments(text or ""):
        if special is not None:
            yield of_special(special)
        else:
            yield from map(cache.__getitem__, bpe.stretches(bpe.normal(part)))


def _fed(chunks: list[bytes], between: bytes) -> Iterator[bytes]:
    """The words' bytes, some thousand words at once, as the state machine takes any cut."""
    for lo in range(0, len(chunks), FEED):
        yield between * bool(lo) + between.join(chunks[lo : lo + FEED])


def encoded(path: str, text: str | None) -> tuple[str, Iterator[str]]:
    """Ids of a whole text, joined by a space, and pieces of the file's own decoding of them."""
    bpe, shown, _ = loaded(path)
    words = list(_words(bpe, text, shown, lambda i: (str(i), bpe.name_bytes[i])))
    return " ".join([w[0] for w in words]), decoded(_fed([w[1] for w in words], b" "))


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""
    schema = StructType([StructField("doc_id", docs.schema[id_col].dataType), StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())])

    def run(c: dict) -> dict:
        n, a, b = [], [], []
        for t in c["t"]:
            ids, pieces = encoded(path, t)
            digest = sha256()
            for piece in pieces:
                digest.update(piece.encode())
            n.append(ids.count(" ") + 1 if ids else 0)
            a.append(sha256(ids.encode()).hexdigest())
            b.append(digest.hexdigest())
        return {"doc_id": c["d"], "n_tokens": n, "ids_sha256": a, "decoded_sha256": b}

    return arrow_map(docs.select(F.col(id_col).alias("d"), F.col(text_col).cast("string").alias("t")), run, schema)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the token ids, their number, and the text decoded from them, of every row."""
    schema = StructType([StructField("doc_id", docs.schema[id_col].dataType), StructField("ids", ArrayType(IntegerType())), StructField("n_tokens", LongType()), StructField("decoded", StringType())])

    def run(c: dict) -> dict:
        bpe, _, plain = loaded(path)
        ids, texts = [], []
        for t in c["t"]:
            words = list(_words(bpe, t, plain, lambda i: ([i], bpe.token_bytes[i])))
            ids.append(np.fromiter(chain.from_iterable(w[0] for w in words), np.int32))
            texts.append("".join(decoded(_fed([w[1] for w in words], b""))))
        return {"doc_id": c["d"], "ids": ids, "n_tokens": list(map(len, ids)), "decoded": texts}

    return arrow_map(docs.select(F.col(id_col).alias("d"), F.col(text_col).cast("string").alias("t")), run, schema)
