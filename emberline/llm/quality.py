"""Quality classifier: a generalised additive model with pairwise interactions.

Features of a text are binned; cyclic boosting fits one shallow tree after another to each feature in turn and adds it
to that feature's lookup table, then does the same for the pairs whose residuals are best explained together.  A text is
scored by adding the table entries of its bins.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm.shared import arrow_rows, crc_mod, scored, written

FEATURES = ["log_bytes", "log_words", "word_length", "distinct_words", "upper", "digits", "symbols", "stops", "exclamations", "other_ascii", "beyond_ascii", "repeated_lines", "words_a_line", "most_frequent_word", "same_word_again", "letters"]
BINS, PAIR_BINS = 32, 8


def _classes() -> np.ndarray:
    """For each byte, which of six counts it belongs to (6: none)."""
    out = np.full(256, 5)
    out[[*range(ord("A"), ord("Z") + 1)]] = 0
    out[[*range(ord("0"), ord("9") + 1)]] = 1
    out[[ord(c) for c in "#*$%&|<>{}[]~^\\=_+@/"]] = 2
    out[[ord(c) for c in ".,;:'\"-()"]] = 3
    out[[ord(c) for c in "!?"]] = 4
    out[[*range(ord("a"), ord("z") + 1), *range(9, 14), 32]] = 6
    out[128:] = 7
    return out


_CLASS = _classes()


def text_features(data: bytes) -> list[float]:
    """The features of a text's UTF-8 bytes, all defined for empty ones."""
    n = max(1, len(data))
    by = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    kinds = np.bincount(_CLASS, weights=by, minlength=8)
    words = data.split()
    w = max(1, len(words))
    counts = Counter(words)
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    again = sum(map(bytes.__eq__, words, words[1:]))
    letters = by[65:91].sum() + by[97:123].sum() + kinds[7]
    return [np.log1p(len(data)), np.log1p(len(words)), sum(map(len, words)) / w, len(counts) / w, kinds[0] / n, kinds[1] / n, kinds[2] / n, kinds[3] / n, kinds[4] / n, kinds[5] / n, kinds[7] / n, 1 - len(set(lines)) / max(1, len(lines)), len(words) / max(1, len(lines)), max(counts.values(), default=0) / w, again / w, letters / n]


def features_of(texts: pa.Array) -> np.ndarray:
    """The features of each text of a batch; a null text is an empty one."""
    data = texts.cast(pa.binary()).to_pylist()
    return np.array([text_features(d or b"") for d in data], dtype=np.float64).reshape(-1, len(FEATURES))


def featured(docs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id and x (array of FEATURES) of each row, and the columns to carry."""
    arrow_rows(docs.sparkSession)
    return scored(docs, lambda texts: [list(features_of(texts))], "x array<double>", carry)


def _leaf(g: np.ndarray, h: np.ndarray) -> float:
    return float(g.sum() / (h.sum() + 1.0))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """What each cut after position i gains."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    return gl**2 / (hl + 1) + gr**2 / (hr + 1)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 3) -> np.ndarray:
    """A tree of so many leaves over a feature's bins: the step of each bin."""
    cuts = [0, len(g)]
    for _ in range(leaves - 1):
        best = None
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b - a > 1:
                gain = _gain(g[a:b], h[a:b])
                at = int(np.argmax(gain))
                worth = gain[at] - g[a:b].sum() ** 2 / (h[a:b].sum() + 1)
                if best is None or worth > best[0]:
                    best = (worth, a + at + 1)
        if best is None or best[0] <= 1e-9:
            break
        cuts = sorted([*cuts, best[1]])
    return np.concatenate([np.full(b - a, _leaf(g[a:b], h[a:b])) for a, b in zip(cuts, cuts[1:], strict=False)])


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut of a pair's grid into four: what it gains, and the step of each cell."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    tg, th = cg[-1, -1], ch[-1, -1]

    def four(c: np.ndarray, t: float) -> np.ndarray:
        a = c[:-1, :-1]
        top, side = c[:-1, -1:], c[-1:, :-1]
        return np.stack([a, top - a, side - a, t - top - side + a])

    fg, fh = four(cg, tg), four(ch, th)
    gain = (fg**2 / (fh + 1)).sum(axis=0)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    step = fg[:, i, j] / (fh[:, i, j] + 1)
    out = np.empty_like(g)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = step
    return float(gain[i, j] - tg**2 / (th + 1)), out


class Gam:
    """Cuts of each feature, its table, the pairs and theirs."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 150, pair_rounds: int = 60, pairs: int = 8, rate: float = 0.15):
        x, y = np.asarray(x, dtype=np.float64).reshape(-1, len(FEATURES)), np.asarray(y, dtype=np.float64)
        even = np.linspace(0, 1, BINS + 1)[1:-1]
        self.cuts = [np.unique(np.quantile(c, even)) if len(c) else np.zeros(0) for c in x.T]
        self.coarse = [np.unique(np.quantile(c, np.linspace(0, 1, PAIR_BINS + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T]
        self.tables, self.pairs = [np.zeros(len(c) + 1) for c in self.cuts], []
        p = (y.sum() + 1) / (len(y) + 2)
        self.base = float(np.log(p / (1 - p)))
        if not len(y):
            return
        bins, coarse = self._bins(x, self.cuts), self._bins(x, self.coarse)
        total = np.full(len(y), self.base)

        def slopes() -> tuple[np.ndarray, np.ndarray]:
            p = 1 / (1 + np.exp(-total))
            return y - p, p * (1 - p)

        for _ in range(rounds):
            for k, own in enumerate(bins):
                g, h = slopes()
                n = len(self.tables[k])
                step = rate * _tree(np.bincount(own, g, n), np.bincount(own, h, n))
                self.tables[k] += step
                total += step[own]
        g, h = slopes()
        found = []
        for a in range(len(bins)):
            for b in range(a + 1, len(bins)):
                shape = (len(self.coarse[a]) + 1, len(self.coarse[b]) + 1)
                if min(shape) > 1:
                    cell = coarse[a] * shape[1] + coarse[b]
                    found.append((_quadrants(np.bincount(cell, g, shape[0] * shape[1]).reshape(shape), np.bincount(cell, h, shape[0] * shape[1]).reshape(shape))[0], a, b, cell, shape))
        found.sort(key=lambda f: (-f[0], f[1], f[2]))
        chosen = [[a, b, cell, np.zeros(shape)] for _, a, b, cell, shape in found[:pairs]]
        for _ in range(pair_rounds):
            for _, _, cell, table in chosen:
                g, h = slopes()
                step = rate * _quadrants(np.bincount(cell, g, table.size).reshape(table.shape), np.bincount(cell, h, table.size).reshape(table.shape))[1]
                table += step
                total += step.ravel()[cell]
        self.pairs = [(a, b, table) for a, b, _, table in chosen]

    @staticmethod
    def _bins(x: np.ndarray, cuts: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(c, x[:, k], side="right") for k, c in enumerate(cuts)]

    def score(self, x: np.ndarray) -> np.ndarray:
        bins, coarse = self._bins(x, self.cuts), self._bins(x, self.coarse)
        total = np.full(len(x), self.base)
        for own, table in zip(bins, self.tables, strict=True):
            total += table[own]
        for a, b, table in self.pairs:
            total += table[coarse[a], coarse[b]]
        return 1 / (1 + np.exp(-total))


def learn(docs: DataFrame, labels: DataFrame, learnable: Column, most: int = 20_000) -> Gam:
    """A model of labelled rows; of more than ``most``, about that many, chosen by their doc_id's hash.

    Of several labels of one document the smallest counts, and of several rows with one doc_id the smallest features.
    The chosen labels, about ``most`` at most, go to every executor, so that no other document's features are made.
    """
    own = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).filter(learnable).groupBy("doc_id").agg(F.min("quality").alias("y"))
    own = written(own, "quality-labels")
    n = own.count()
    if n > most:
        own = own.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(most / n * (1 << 30)))
    labelled = featured(docs.select("doc_id", "text").join(F.broadcast(own.select("doc_id")), "doc_id", "left_semi"))
    rows = labelled.groupBy("doc_id").agg(F.min("x").alias("x")).join(own, "doc_id").select("x", "y").toPandas() if n else None
    if rows is None or not len(rows):
        return Gam(np.zeros((0, len(FEATURES))), np.zeros(0))
    order = np.lexsort((*np.stack(rows["x"]).T, rows["y"]))  # the same sums in whatever order rows come
    return Gam(np.stack(rows["x"])[order], rows["y"].to_numpy()[order])


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, most: int = 20_000, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted of each row, and the columns to carry.

    Rows whose crc32 of the doc_id mod 4 is 2 are held out (null ids too) and teach nothing.  Null and empty texts are
    scored like any; without labels every score is 0.5.  Repeated rows are each scored; an empty table gives an empty
    result.  Labels, lang, source and doc_id are no inputs of a score.
    """
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, crc_mod("doc_id", 4) != 2, most))

    def score(texts: pa.Array) -> list:
        found = model.value.score(features_of(texts))
        return [found, (found >= threshold).astype(np.int32)]

    return scored(docs, score, "score double, predicted int", carry, held_out=F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(True)))
