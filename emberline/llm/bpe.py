"""BPE encoding and decoding with an explicit merge queue.

A word starts as one symbol per byte in a doubly linked list.  Every adjacent pair that has a merge rank enters a
priority queue; the lowest rank (then the leftmost position) is merged first, the two neighbouring pairs enter the
queue, and entries whose symbols have changed meanwhile are skipped when they surface.  Decoding looks ids up in the
vocabulary and concatenates the strings, as the tokenizers library does for a file without a decoder.

The vocabulary file (``word_bpe_49k.json`` layout: NFC, white space to one space, lower case, a splitting pattern,
byte-level symbols and a word-end suffix) is a parameter and is read where it is used.
"""

from __future__ import annotations

import heapq
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import pandas as pd
import regex
import unicodedata
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.shared import arrow_rows

#: The Unicode white space that the splitting pattern's \s stands for.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: Width of a symbol in the key of a pair, and of a position in an entry of the queue.
_BITS, _PLACE = 20, 40
_MASK = (1 << _PLACE) - 1


class Remembered(dict):
    """A bounded memory of two generations: when the young one is full it becomes the old one, and what is used again is carried over."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.old = most, {}

    def recall(self, key):
        """A value of the old generation, made young again, or None."""
        found = self.old.get(key)
        return found and self.put(key, found)

    def put(self, key, value):
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if printable Latin-1, else the next free one from U+0100."""
    free = iter(range(256, 512))
    shown = set(range(33, 127)) | set(range(161, 173)) | set(range(174, 256))
    return [chr(b) if b in shown else chr(next(free)) for b in range(256)]


class MergeQueueBpe:
    """Encoder and decoder over one vocabulary file; ``cache_words`` bounds the remembered words (twice that many at most)."""

    def __init__(self, path: str, cache_words: int = 300_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"] or ""
        self.strings = {i: s for s, i in vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = byte_symbols()
        self.inner = [vocab[c] for c in names]
        self.final = [vocab[c + suffix] for c in names]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.left = [vocab[a] for a, _ in pairs]
        self.right = [vocab[b] for _, b in pairs]
        self.made = [vocab[a + b] for a, b in pairs]
        self.rank = {(a << _BITS) | b: r for r, (a, b) in enumerate(zip(self.left, self.right, strict=True))}
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.pieces = regex.compile(next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"])
        self.cut = regex.compile(f"[{SPACES}]+")
        self.words, self.parts = Remembered(cache_words), Remembered(cache_words)
        self.digits = {i: str(i).encode() for i in self.strings}
        self.shown = {i: t.encode() for i, t in self.strings.items()}

    def merge(self, symbols: list[int]) -> list[int]:
        """The symbols after all merges, lowest rank first, leftmost first among equals."""
        n = len(symbols)
        get = self.rank.get
        heap = [(r << _PLACE) | i for i in range(n - 1) if (r := get((symbols[i] << _BITS) | symbols[i + 1])) is not None]
        if not heap:
            return symbols
        if n == 2:
            return [self.made[heap[0] >> _PLACE]]
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pop, push, left, right, made = heapq.heappop, heapq.heappush, self.left, self.right, self.made
        while heap:
            entry = pop(heap)
            r, i = entry >> _PLACE, entry & _MASK
            j = after[i]
            if j >= n or symbols[i] != left[r] or symbols[j] != right[r]:
                continue  # stale: a neighbour was merged since
            symbols[i] = new = made[r]
            symbols[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := get((new << _BITS) | symbols[k])) is not None:
                    push(heap, (r << _PLACE) | i)
            h = before[i]
            if h >= 0:
                if (r := get((symbols[h] << _BITS) | new)) is not None:
                    push(heap, (r << _PLACE) | h)
        return [s for s in symbols if s >= 0]

    def _piece(self, piece: str) -> bytes:
        data = piece.encode("utf-8", "surrogatepass")
        inner = self.inner
        symbols = [inner[b] for b in data]
        symbols[-1] = self.final[data[-1]]
        return self.parts.put(piece, array("I", self.merge(symbols) if len(symbols) > 1 else symbols).tobytes())

    def _plain(self, word: str) -> bytes:
        """A word that holds no special token and no white space."""
        text = word.lower() if word.isascii() else "".join([c.lower() for c in unicodedata.normalize("NFC", word)])
        parts = self.parts
        if text.isalpha() and text.isascii():
            return parts.get(text) or parts.recall(text) or self._piece(text)
        return b"".join([parts.get(p) or parts.recall(p) or self._piece(p) for p in self.pieces.findall(text)])

    def packed(self, text: str) -> bytes:
        """Ids as unsigned 32-bit integers.  White space never belongs to an id, so words are encoded alone and remembered."""
        known, found = self.words, []
        for part in self.specials.split(text) if any(t in text for t in self.special) else [text]:
            if part in self.special:
                found.append(array("I", [self.special[part]]).tobytes())
                continue
            words = [w for w in self.cut.split(part) if w] if _UNUSUAL.search(part) else part.split()
            ids = list(map(known.get, words))
            if None in ids:
                for i, w in enumerate(words):
                    if ids[i] is None:
                        ids[i] = known.get(w) or known.recall(w) or known.put(w, self._plain(w))
            found += ids
        return b"".join(found)

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text; special tokens that stand in it become their ids."""
        return array("I", self.packed(text)).tolist()

    def decode(self, ids: list[int]) -> str:
        """The vocabulary strings of the ids, with one space between (no decoder is set in the file)."""
        return " ".join([self.strings[i] for i in ids])

    def digests(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """(number of ids, SHA-256 of the ids, SHA-256 of the decoded text) of each text."""
        digits, shown = self.digits.__getitem__, self.shown.__getitem__
        for text in texts:
            ids = array("I", self.packed(text))
            yield len(ids), sha256(b" ".join(map(digits, ids))).hexdigest(), sha256(b" ".join(map(shown, ids))).hexdigest()


#: str.split() also cuts at these, which the pattern's \s does not (or only in some versions): such texts take the pattern.
_UNUSUAL = regex.compile("[\x1c-\x1f\x85]")


@lru_cache(maxsize=2)
def load(path: str) -> MergeQueueBpe:
    """One encoder for each vocabulary and Python worker."""
    return MergeQueueBpe(path)


def encode_decode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Encode and decode every text: doc_id, n_tokens, ids_sha256, decoded_sha256, one row for each input row.

    A null text counts as empty (no ids, digests of the empty string); a null doc_id is passed on; repeated rows are
    each encoded.  Other columns of ``docs``, whatever their names, are ignored.  An empty table gives an empty result.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = load(vocabulary)
        for batch in batches:
            rows = list(bpe.digests(batch["text"].tolist()))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "doc_id", batch["doc_id"].array)
            yield out.astype({"n_tokens": "int64"})

    arrow_rows(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = dict(docs.select("doc_id").dtypes)["doc_id"]
    return rows.mapInPandas(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def token_ids(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id and the ids themselves (array<int>) with the decoded text: the operator's full output."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = load(vocabulary)
        for batch in batches:
            ids = [bpe.encode(t) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].array, "ids": ids, "decoded": [bpe.decode(i) for i in ids]})

    arrow_rows(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = dict(docs.select("doc_id").dtypes)["doc_id"]
    return rows.mapInPandas(run, f"doc_id {kind}, ids array<int>, decoded string")
