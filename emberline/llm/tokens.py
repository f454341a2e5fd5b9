"""Ids of whole texts as the tokenizers library gives them, several times faster.

tiktoken gets the vocabulary file's merges as ranks.  For a vocabulary with word ends a mark stands in the text for the
end of each piece, and the file's splitting pattern is applied by replacing characters, many texts at a time.  Texts
where that is not certain (special tokens, control characters, unusual white space, apostrophes before word ends) go to
the tokenizers library, one by one.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core

import numpy as np  # noqa: E402
import sentencepiece  # noqa: E402
import tiktoken  # noqa: E402
import unicodedata  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from emberline.llm.bpe import byte_symbols  # noqa: E402

#: The marks for the end of a piece and the end of a text.
_PIECE, _END = "\x01", "\x02"
#: White space other than the space and the line feed, by any library's reckoning, and the marks.
_ODD = re.compile("[\x00-\x09\x0b-\x1f\x7f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Fixed value: the public pattern of byte-level vocabularies, with the mark alone, for texts whose white space comes one at a time.
_SINGLE = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^\s\p{{L}}\p{{N}}{_END}]+|{_END}|\s"
#: Texts that one call encodes.
_TOGETHER = 64


class TextIds:
    """Ids (uint32) of whole texts, without special tokens added."""

    def __init__(self, path: str, plain_specials: bool = False):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = plain_specials  # their strings in a text are then ordinary text
        self.special = [] if plain_specials else [t["content"] for t in spec["added_tokens"]]
        vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"] or ""
        self.word_ends = bool(suffix)
        names = byte_symbols()
        value = {c: bytes([b]) for b, c in enumerate(names)}

        def raw(symbol: str) -> bytes:
            whole = symbol.removesuffix(suffix) if suffix else symbol
            return b"".join([value[c] for c in whole]) + (_PIECE.encode() if whole != symbol else b"")

        # Single bytes, those at a word's end, then what each merge makes: a merge's rank is its place.
        order = [*names, *([c + suffix for c in names] if suffix else []), *("".join(m if isinstance(m, list) else m.split(" ")) for m in spec["model"]["merges"])]
        ranks = {raw(s): i for i, s in enumerate(order)}
        self.ids = np.array([vocab[s] for s in order], dtype=np.uint32)
        self.end = ranks[_END.encode()]
        self.fast = tiktoken.Encoding("texts", pat_str=f"[^{_PIECE}{_END} \n]+{_PIECE}|{_END}" if suffix else _SINGLE, mergeable_ranks=ranks, special_tokens={})
        self.kinds: dict[int, str] = {}

    def _sure(self, text: str) -> bool:
        if _ODD.search(text) or any(s in text for s in self.special):
            return False
        if self.word_ends:
            return "'" not in text
        return not ("  " in text or " \n" in text or "\n " in text or "\n\n" in text)

    def _marked(self, text: str) -> str:
        """Lower case, with a mark after each piece: runs of letters, single numbers, runs of anything else but white space."""
        if text.isascii():
            text = text.lower()
        else:
            text = unicodedata.normalize("NFC", text)
            text = "".join([c.lower() for c in text]) if "Σ" in text else text.lower()
        present = np.flatnonzero(np.bincount(np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)))
        numbers = []
        for code in present.tolist():
            kind = self.kinds.get(code)
            if kind is None:
                kind = self.kinds[code] = unicodedata.category(chr(code))[0]
            if kind == "N":
                numbers.append(chr(code))
            elif kind != "L" and chr(code) not in f" \n{_END}":
                text = text.replace(chr(code), f"{_PIECE}{chr(code)}{_PIECE}")
        text = text.replace(_PIECE + _PIECE, "")  # joins neighbours to one run
        for c in numbers:
            text = text.replace(c, f"{_PIECE}{c}{_PIECE}")
        return text.replace(" ", f"{_PIECE} ").replace("\n", f"{_PIECE}\n")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        out: list[np.ndarray | None] = [None] * len(texts)
        for at in range(0, len(texts), _TOGETHER):
            sure = []
            for i in range(at, min(at + _TOGETHER, len(texts))):
                if self._sure(texts[i]):
                    sure.append(i)
                else:
                    out[i] = np.array(self.library.encode(texts[i], add_special_tokens=False).ids, dtype=np.uint32)
            if not sure:
                continue
            if self.word_ends:
                text = self._marked("".join([f"{texts[i]}\n{_END}" for i in sure]))
            else:
                text = "".join([texts[i] + _END for i in sure])
            ranks = self.fast.encode_to_numpy(text)
            ends = np.flatnonzero(ranks == self.end).tolist()
            ids, start = self.ids[ranks], 0
            for i, e in zip(sure, ends, strict=True):
                out[i], start = ids[start:e], e + 1
        return out


#: What the shortcut for pieces leaves to the library: characters of three bytes, control characters, more spaces than one.
_NOT_PLAIN = re.compile("[^\n\x20-\x7e\xa0-\u07ff]|  ")


class PieceIds:
    """Ids of whole texts by a sentencepiece model of merges, as the library gives them, about twice as fast.

    Merges never reach over a space that follows another character, as no piece does, so words can be taken alone.
    tiktoken gets the pieces of characters of one or two bytes as ranks, in the order of their scores; what makes a
    character of its two bytes comes before them, as the model starts from whole characters.  Bytes of characters that
    the model doesn't know stay bytes.  Other texts go to the library.
    """

    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.library.get_piece_size()
        pieces = [self.library.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (self.library.is_byte(i) or self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_unused(i))]
        text = {i: pieces[i].replace("▁", " ").encode() for i in normal if not _NOT_PLAIN.search(pieces[i].replace("▁", " "))}
        byte = {int(pieces[i][3:-1], 16): i for i in range(n) if self.library.is_byte(i)}
        known = {t: i for i, t in text.items()}
        singles = [known.get(bytes([b]), byte.get(b)) if b < 0x80 else byte.get(b) for b in range(256)]
        scores = [self.library.get_score(i) for i in text]
        self.fast = None
        if None not in singles and len(set(scores)) == len(scores) and not any("▁" in p.lstrip("▁") for p in pieces):
            characters = [i for i, t in text.items() if len(t) == 2 and len(t.decode()) == 1]
            merged = sorted((i for i, t in text.items() if len(t.decode()) > 1), key=self.library.get_score, reverse=True)
            order = [*((bytes([b]), i) for b, i in enumerate(singles)), *((text[i], i) for i in [*characters, *merged])]
            self.ids = np.array([i for _, i in order], dtype=np.uint32)
            self.fast = tiktoken.Encoding("pieces", pat_str=" ?[^ ]+| ", mergeable_ranks={t: k for k, (t, _) in enumerate(order)}, special_tokens={})

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, with the space that the model puts before it."""
        sure = [self.fast is not None and not (t.startswith(" ") or _NOT_PLAIN.search(t)) and t != "" for t in texts]
        rest = iter(self.library.encode([t for t, s in zip(texts, sure, strict=True) if not s], num_threads=1))
        return [self.ids[self.fast.encode_to_numpy(" " + t, disallowed_special=())] if s else np.array(next(rest), dtype=np.uint32) for t, s in zip(texts, sure, strict=True)]


@lru_cache(maxsize=2)
def load(path: str) -> TextIds:
    """One for each vocabulary and Python worker."""
    return TextIds(path)
