"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text's features are the hashed byte n-grams (2 to 4) of its lower-cased UTF-8; their embeddings
are averaged and a linear layer gives a score for each language. Both layers are trained by
stochastic gradient descent in numpy. As both are linear, their product is one table of
(bucket, language), so predicting is a gather and a mean.

Calibration on rows that training has not seen: a temperature makes the probabilities honest, and
a threshold rejects predictions below the confidence at which the rest reach ``precision``.

Learning sees at most ``most_rows`` rows, shared evenly among the languages as far as they have rows,
and of each a window of at most ``most_chars`` characters from anywhere in the text; prediction
always sees whole texts, in pieces of bounded size that overlap, so that no n-gram is lost.

Cases: null texts and texts without a letter are ``und`` with score 0; null languages are not
learned; with nothing to learn from everything is ``und``; ids that repeat are predicted each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import fold, map_arrow
from lodestar.llm.sampling import labelled_texts

BUCKETS, DIMENSION, ORDERS = 1 << 15, 16, (2, 3, 4)
PIECE = 1 << 19
_LETTER = regex.compile(r"\p{L}")
UND = "und"


def grams(raw: bytes, first: int = 0, end: int | None = None) -> np.ndarray:
    """Buckets of the n-grams of raw, which is padded with a space at both ends. first, end: only
    n-grams that start within this piece; all pieces together give each n-gram of the whole once."""
    end = len(raw) if end is None else min(end, len(raw))
    last = end == len(raw)  # the n-grams that start before the first byte belong to the first piece
    padded = (b" " if first == 0 else b"") + raw[first : end + ORDERS[-1] - 1] + (b" " if end + ORDERS[-1] > len(raw) else b"")
    b = np.frombuffer(padded, np.uint8).astype(np.uint32)
    starts = end - first + (first == 0) + last
    out = []
    for n in ORDERS:
        count = min(starts, len(b) - n + 1)
        if count <= 0:
            continue
        h = np.full(count, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        for k in range(n):
            h = (h ^ b[k : count + k]) * np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        out.append(h >> np.uint32(32 - 15))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    table: np.ndarray  # (BUCKETS, languages)
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, text: str) -> np.ndarray:
        raw = text.lower().encode("utf-8", "surrogatepass")
        total, n = np.zeros(len(self.languages)), 0
        for at in range(0, max(1, len(raw)), PIECE):
            g = grams(raw, at, at + PIECE)
            total += self.table.take(g, axis=0).sum(axis=0, dtype=np.float64)
            n += len(g)
        return total / max(1, n)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, probability, rejected)"""
        if not self.languages or text is None or not _LETTER.search(text):
            return UND, 0.0, True
        z = self.logits(text) / self.temperature
        p = np.exp(z - z.max())
        k = int(p.argmax())
        best = float(p[k] / p.sum())
        return self.languages[k], best, best < self.threshold


def train(rows: list[tuple[str, str, int]], epochs: int = 4, rate: float = 1.0, seed: int = 5, precision: float = 0.99) -> Model:
    """rows: (text, language, dice). A fifth of the rows calibrates, the rest trains."""
    languages = tuple(sorted({y for _, y, _ in rows}))
    rows = [r for r in rows if _LETTER.search(r[0])]
    if not languages or not rows:
        return Model((), np.zeros((BUCKETS, 0), np.float32))
    place = {y: k for k, y in enumerate(languages)}
    rest = [r for r in rows if r[2] % 5 == 0]
    learn = [r for r in rows if r[2] % 5] or rows
    dice = np.random.default_rng(seed)
    e = dice.uniform(-1 / DIMENSION, 1 / DIMENSION, (BUCKETS, DIMENSION)).astype(np.float32)
    w = np.zeros((DIMENSION, len(languages)), np.float32)
    share = np.bincount([place[y] for _, y, _ in learn], minlength=len(languages))
    weight = np.sqrt(len(learn) / np.maximum(1, share) / len(languages))  # rarer languages count more
    steps, done = epochs * len(learn), 0
    for _ in range(epochs):
        for k in dice.permutation(len(learn)):
            text, y, _ = learn[k]
            raw = text.lower().encode("utf-8", "surrogatepass")
            most = int(np.exp(dice.uniform(np.log(12), np.log(800))))  # short and long pieces alike
            at = int(dice.integers(0, max(1, len(raw) - most)))
            g = grams(raw[at : at + most])
            h = e[g].mean(axis=0)
            z = h @ w
            p = np.exp(z - z.max())
            p /= p.sum()
            p[place[y]] -= 1
            pull = rate * (1 - done / steps) * weight[place[y]] * p
            back = w @ pull
            w -= np.outer(h, pull)
            used, n = np.unique(g, return_counts=True)
            e[used] -= (n / len(g))[:, None].astype(np.float32) * back
            done += 1
    model = Model(languages, (e @ w).astype(np.float32))
    return _calibrated(model, rest or learn, place, dice, precision)


def _calibrated(model: Model, rows, place, dice, precision: float) -> Model:
    """Temperature by least log loss, threshold by precision, on pieces of the rows."""
    z, y = [], []
    for text, lang, _ in rows:
        for piece in (text, text[: int(np.exp(dice.uniform(np.log(8), np.log(200))))]):
            z.append(model.logits(piece))
            y.append(place[lang])
    z, y = np.array(z), np.array(y)

    def probabilities(t):
        p = np.exp((z - z.max(axis=1, keepdims=True)) / t)
        return p / p.sum(axis=1, keepdims=True)

    loss = lambda t: -np.log(probabilities(t)[np.arange(len(y)), y] + 1e-12).mean()
    t = min(np.geomspace(0.05, 20, 60), key=loss)
    p = probabilities(t)
    best, right = p.max(axis=1), p.argmax(axis=1) == y
    order = np.argsort(-best)
    share = np.cumsum(right[order]) / np.arange(1, len(y) + 1)
    enough = np.flatnonzero(share >= precision)
    threshold = float(best[order][enough[-1]]) if len(enough) else 1.0
    return Model(model.languages, model.table, float(t), threshold)


def fit(docs: DataFrame, most_rows: int = 6_000, most_chars: int = 4_000) -> Model:
    return train([(t, str(y), d) for t, y, d in labelled_texts(docs, F.col("lang"), most_rows, most_chars, each=True)])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [model.predict(t.as_py()) for t in b.column(2)]
            columns = [pa.array([g[k] for g in got], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    seen = docs.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "text")
    return map_arrow(seen, run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")
