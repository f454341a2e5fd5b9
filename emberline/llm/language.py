"""Language identification: multinomial naive Bayes over hashed character n-grams.

Trigrams of lower-cased texts are hashed into ``BUCKETS``; smoothed log probabilities, one row of all languages for
each bucket, are broadcast, and a batch is scored by gathering the rows of its n-grams and summing them text by text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm.shared import arrow_rows, crc_mod, scored

BUCKETS, GRAM = 1 << 16, 3
UNKNOWN = "und"
#: Languages of a model: its table is 256 kB for each.
MOST_LANGUAGES = 400
_PART = 1 << 18
_LETTER = re.compile(r"[^\W\d_]")


def _grams(parts: list[tuple[int, str, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the n-gram at each position of some parts (owner, text with what follows, positions), and the positions of each."""
    codes = np.frombuffer("".join([p[1] for p in parts]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    h = codes[: len(codes) - GRAM + 1] * np.uint32(2654435761)
    for k in range(1, GRAM):
        h = (h ^ codes[k : len(codes) - GRAM + 1 + k]) * np.uint32(2246822519 + 2 * k)
        h ^= h >> np.uint32(15)
    buckets = (h & np.uint32(BUCKETS - 1)).astype(np.int32)
    lengths = np.array([len(p[1]) for p in parts])
    used = np.array([p[2] for p in parts])
    starts = np.cumsum(lengths) - lengths
    keep = np.zeros(len(codes) + 1, dtype=np.int8)
    np.add.at(keep, starts, 1)
    np.add.at(keep, starts + used, -1)
    return buckets[np.cumsum(keep[: len(buckets)], dtype=np.int8) > 0], used


def _parts(texts: list[str]) -> Iterator[list[tuple[int, str, int]]]:
    """The texts in groups of bounded length; long ones in parts that overlap by an n-gram less one; ends are padded."""
    held, size = [], 0
    for owner, text in enumerate(texts):
        text = text.lower()
        for at in range(0, len(text), _PART):
            part = text[at : at + _PART + GRAM - 1]
            positions = min(_PART, len(text) - at)
            held.append((owner, part + "\0" * (positions + GRAM - 1 - len(part)), positions))
            size += positions
            if size >= _PART:
                yield held
                held, size = [], 0
    if held:
        yield held


def gram_counts(docs: DataFrame, language: str = "lang", text: str = "text") -> DataFrame:
    """lang, bucket, n over all rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, rows in batch.groupby("lang"):
                for parts in _parts(rows["text"].tolist()):
                    own = counts.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
                    own += np.bincount(_grams(parts)[0], minlength=BUCKETS)
        for lang, n in counts.items():
            at = np.flatnonzero(n)
            yield pd.DataFrame({"lang": lang, "bucket": at, "n": n[at]})

    rows = docs.select(F.col(language).alias("lang"), F.col(text).alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    return rows.mapInPandas(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """Languages and the log probability of each bucket in each of them (float32, buckets x languages)."""

    def __init__(self, counts: pd.DataFrame, smoothing: float = 0.5):
        self.languages = sorted(counts["lang"].unique())
        n = np.full((BUCKETS, max(1, len(self.languages))), smoothing)
        for k, lang in enumerate(self.languages):
            own = counts[counts["lang"] == lang]
            n[own["bucket"].to_numpy(), k] += own["n"].to_numpy()
        self.log = np.log(n / n.sum(axis=0)).astype(np.float32)

    def sums(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The log probability of each text in each language, and its number of n-grams."""
        sums, grams = np.zeros((len(texts), self.log.shape[1])), np.zeros(len(texts), dtype=np.int64)
        for parts in _parts([t or "" for t in texts]):
            buckets, used = _grams(parts)
            got = np.add.reduceat(self.log[buckets], np.cumsum(used) - used, axis=0, dtype=np.float64)
            owners = [p[0] for p in parts]
            np.add.at(sums, owners, got)
            np.add.at(grams, owners, used)
        return sums, grams

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The likeliest language of each text and its posterior."""
        return self.judged(texts)[:2]

    def judged(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """The likeliest language of each text, its posterior (equal priors), by how much log probability an n-gram it leads, and the number of n-grams.

        UNKNOWN, 0 and 0 without a letter or a model; a single language leads by no finite margin.
        """
        sums, grams = self.sums(texts)
        order = np.sort(sums, axis=1)
        lead = order[:, -1] - order[:, -2] if order.shape[1] > 1 else np.full(len(texts), np.inf)
        score = 1 / np.exp(sums - order[:, -1:]).sum(axis=1)
        known = np.array([bool(self.languages) and t is not None and bool(_LETTER.search(t)) for t in texts], dtype=bool)
        lang = [self.languages[b] if k else UNKNOWN for b, k in zip(sums.argmax(axis=1), known, strict=True)]
        return lang, np.where(known, score, 0.0), np.where(known, lead / np.maximum(grams, 1), 0.0), grams


def learn(docs: DataFrame, learnable: Column, most: int = 20_000) -> Model:
    """A model of rows that are learnable and have a language; of more than ``most``, about that many, chosen by a hash of id and text."""
    arrow_rows(docs.sparkSession)
    rows = docs.filter(learnable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    n = docs.filter(learnable & F.col("lang").isNotNull()).count()
    if n > most:
        rows = rows.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int(most / n * (1 << 30)))
    counts = gram_counts(rows)
    languages = counts.select("lang").distinct().limit(MOST_LANGUAGES + 1).count()
    if languages > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages: their table would be broadcast to every executor")
    return Model(counts.toPandas())  # at most buckets x languages rows


def identify(docs: DataFrame, held_out: Column | None = None, most: int = 20_000, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, held_out, lang_pred, score, margin, n_grams of each row, and the columns to carry.

    Rows that are held out (by default crc32 of the doc_id mod 3 = 1; null ids are held out) teach nothing.  A null text
    or one without a letter is ``und`` with score 0, as is every text if there is nothing to learn from.  Repeated rows
    count each; an empty table gives an empty result.  lang, source and doc_id are no inputs of a prediction.  margin is
    by how much log probability, an n-gram, the language leads the next; over MOST_LANGUAGES languages are an error.
    """
    out = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(True)) if held_out is None else held_out
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, ~out, most))

    def score(texts: pa.Array) -> list:
        return list(model.value.judged(texts.to_pylist()))

    return scored(docs, score, "lang_pred string, score double, margin double, n_grams long", carry, held_out=out)
