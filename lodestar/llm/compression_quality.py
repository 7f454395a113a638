"""Quality classifier by compression: a text resembles what compresses it better.

Two zstandard dictionaries are trained, one on good and one on bad labelled text. A text is
compressed whole with each; the difference of the compressed sizes over the text's own size says
which kind it resembles. A rising curve over that difference alone turns it into a probability; it
is fitted by isotonic regression on labelled rows that the dictionaries have not seen.

Learning sees at most ``most_rows`` labelled rows, of each a window of at most ``most_chars``
characters; scoring always sees whole texts. The dictionaries (at most ``dictionary_bytes`` each) and the curve
travel to the tasks with the function.

Cases: null and empty texts get the score of an empty text; ids that repeat are scored each, and
learned from each with the id's least label that is not null; with one class or no labels the score is the smoothed share of good labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import fold, map_arrow
from lodestar.llm.sampling import labelled_texts

LEVEL = 3
#: Bytes added to a text's size, so that very short texts stay near nought; bytes of a training sample.
BLANK, SAMPLE = 16, 500


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; of too few samples, their plain content."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    curve: tuple[tuple[float, float], ...]  # (difference, probability), rising; none: everything has the prior
    prior: float

    def compressors(self):
        out = []
        for d in (self.good, self.bad):
            held = zstandard.ZstdCompressionDict(d)
            held.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False))
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        if not self.curve:
            return np.full(len(x), self.prior)
        at, p = zip(*self.curve, strict=True)
        return np.interp(x, at, p)


def differences(texts: list[bytes], compressors) -> np.ndarray:
    """Difference of the compressed sizes of each text over its size, which BLANK bytes are added to;
    positive: it resembles good text."""
    good, bad = (np.fromiter((len(c.compress(t)) for t in texts), float, len(texts)) for c in compressors)
    return (bad - good) / (np.fromiter(map(len, texts), float, len(texts)) + BLANK)


def _isotonic(x: np.ndarray, y: np.ndarray, prior: float) -> list[tuple[float, float]]:
    """The rising step function of least squares, as the centre and the share of each step. Each share
    counts one more row, which is good by the prior, so none is 0 or 1 on little evidence."""
    order = np.argsort(x, kind="stable")
    at, place = np.unique(x[order], return_inverse=True)
    steps: list[list[float]] = []  # [rows, good ones, sum of differences]
    for row in np.stack([np.bincount(place), np.bincount(place, y[order]), np.bincount(place, x[order])], axis=1).tolist():
        steps.append(row)
        while len(steps) > 1 and steps[-2][1] * steps[-1][0] >= steps[-1][1] * steps[-2][0]:
            last = steps.pop()
            steps[-1] = [a + b for a, b in zip(steps[-1], last, strict=True)]
    share = np.maximum.accumulate([(good + prior) / (n + 1) for n, good, _ in steps])
    return [(total / n, float(p)) for (n, _, total), p in zip(steps, share, strict=True)]


def train(rows: list[tuple[str, int, int]], dictionary_bytes: int = 64 << 10) -> Model:
    """rows: (text, label 0 or 1, dice). Two thirds make the dictionaries, one third the curve."""
    encoded = [(t.encode("utf-8", "surrogatepass"), y, d) for t, y, d in rows]
    n_good = sum(y for _, y, _ in encoded)
    prior = (n_good + 1) / (len(encoded) + 2)
    samples = [[t[k : k + SAMPLE] for t, y, d in encoded if y == c and d % 3 for k in range(0, len(t), SAMPLE)] for c in (1, 0)]
    rest = [(t, y) for t, y, d in encoded if d % 3 == 0]
    if not all(samples) or len({y for _, y in rest}) < 2:
        return Model(b"", b"", (), prior)
    good, bad = (_dictionary(s, dictionary_bytes) for s in samples)
    x = differences([t for t, _ in rest], Model(good, bad, (), prior).compressors())
    return Model(good, bad, tuple(_isotonic(x, np.array([y for _, y in rest], float), prior)), prior)


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = 9_000, most_chars: int = 16_000, label: str = "quality") -> Model:
    rows = labelled_texts(docs, F.col(label).cast("int"), most_rows, most_chars, labels)
    return train([(t, int(y), d) for t, y, d in rows if y in (0, 1)])


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = model.compressors() if model.curve else None
        for b in batches:
            texts = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in b.column(2)]
            p = model.probabilities(differences(texts, both) if both else np.empty(len(texts)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    seen = docs.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "text")
    return map_arrow(seen, run, "doc_id long, held_out boolean, score double, predicted int")
