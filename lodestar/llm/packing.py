"""Best-fit packing of token sequences into bins with several capacities.

Tokens: each text is encoded whole by a public tokenizer and ended by one separator id. Only
documents longer than a bin are cut, into pieces of a full bin and a shorter last one.

Plan: pieces of one length are alike, so the plan needs only how many there are of each length, a
table of at most ``tokens`` rows whatever the corpus. The driver runs vector best-fit decreasing on
it: a piece goes to the open bin that can take it under every capacity (tokens, documents,
attention cost) and has the least weighted residual norm after it, or the least weighted dot
product of residual and demand. Bins of one content are handled as one group, so the plan's size
follows the number of lengths, not the number of pieces. Pieces then find their bin from their rank
among the pieces of their length; ranks come from bounded chunks of each length.

Cases: null and empty texts are one piece of the separator alone; rows that share a doc_id are
packed each; an empty table gives an empty result; a demand beyond a capacity of an empty bin
raises ValueError. Results are the same on every run but for the order among equal rows.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.llm.common import map_arrow, saved

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"

# --- tokens ---


class Words(dict):
    """Ids of words as little-endian unsigned 32-bit numbers, encoded when first asked for.

    Two generations: when the younger is full it becomes the older one and what is asked for again
    moves over, so frequent words stay and memory is bounded.

    A run of lower-case Latin letters is one piece to the tokenizer, and so is a run of ASCII
    punctuation without an apostrophe after it; such pieces go to its merge model at once, in the
    alphabet that byte-level models use for bytes. All other words go through the whole tokenizer."""

    _plain = re.compile(r"([a-z\xdf-\xf6\xf8-\xff]+)([!-&(-/:-@\[-`{-~]+)?")
    # the rule of byte-level alphabets: printable bytes stand for themselves, the rest from 256 on
    _hidden = [*range(33), *range(127, 161), 173]
    _alphabet = {x: 256 + k for k, x in enumerate(_hidden)}

    def __init__(self, tokenizer, most: int):
        super().__init__({"": b""})
        self.tokenizer, self.most, self.old = tokenizer, most, {}
        self.merge = tokenizer.model.tokenize

    def _merged(self, piece: str) -> bytes:
        seen = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self._alphabet)
        ids = [t.id for t in self.merge(seen)]
        return _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else np.array(ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        got = self.old.get(word)
        if got is None:
            if m := self._plain.fullmatch(word):
                core, tail = m.groups()
                got = self[core] + self._merged(tail) if tail else self._merged(core)
            else:
                got = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[word] = got
        return got


class WordEncoder:
    """The tokenizer behind a table of words it has met.

    The tokenizer parts text at white space before anything else and no rule reaches across it, so
    a text's ids are those of its space-separated words in a row; other white space stays inside
    the words for the tokenizer itself to part. It lower-cases, letter by letter; texts within
    Latin-1, where that has no special cases, are lower-cased beforehand, but for words with '<|':
    its added tokens, such as <|endoftext|>, are found in the raw text only. That holds for the file
    word_bpe_49k.json; another file is used as it is (``by_word`` false)."""

    def __init__(self, path: str, most: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are parallel already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_word = self._parts_at_spaces(path)
        self.words = Words(self.tokenizer, most)

    @staticmethod
    def _parts_at_spaces(path: str) -> bool:
        """Whether the file has the normalizers and pre-tokenizers that the shortcuts rely on."""
        with open(path, "rb") as f:
            made = json.load(f)
        steps = lambda x, k: [s["type"] for s in ((x or {}).get(k) or [x or {"type": ""}])]
        return steps(made.get("normalizer"), "normalizers") == ["NFC", "Replace", "Lowercase"] and steps(made.get("pre_tokenizer"), "pretokenizers") == ["Split", "ByteLevel"]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        if not self.by_word:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        try:
            text.encode("latin-1")
            latin = True
        except UnicodeEncodeError:
            latin = False
        if latin and "<|" not in text:
            text, latin = text.lower(), False
        words = text.replace("\n", " ").split(" ")
        if latin:
            words = [w if "<|" in w else w.lower() for w in words]
        return b"".join(map(self.words.__getitem__, words))


_PACK = [struct.Struct(f"<{n}I").pack for n in range(24)]
_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One for each worker process and file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def cut(ids: bytes, tokens: int) -> Iterator[tuple[int, int, bytes]]:
    """(piece, start, ids) of a document's encoded ids."""
    for k, at in enumerate(range(0, len(ids), 4 * tokens)):
        yield k, k * tokens, ids[at : at + 4 * tokens]


def pieces(docs: DataFrame, tokenizer: str, tokens: int = 2048, separator: int = 0, keep_ids: bool = False) -> DataFrame:
    """A row for each piece of each document. keep_ids: with the ids themselves, else null.
    tokenizer: path of a tokenizer file that every executor can open."""
    end = int(separator).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            rows: list[tuple] = []
            weight = 0
            for i, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for k, start, raw in cut(enc.encode(text.as_py() or "") + end, tokens):
                    rows.append((i, k, start, len(raw) // 4, zlib.crc32(raw), raw if keep_ids else None))
                    weight += len(raw) * keep_ids
                if weight > 4 << 20:
                    yield _batch(rows)
                    rows, weight = [], 0
            if rows:
                yield _batch(rows)

    return map_arrow(docs.select("doc_id", "text"), run, PIECES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])


# --- plan ---


@dataclass(frozen=True)
class Capacity:
    """What a bin holds at most. Attention cost of a piece is its length squared."""

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05)
    choose: str = "norm"  # or "dot"


@dataclass(frozen=True)
class Run:
    """Pieces of one length with ranks first..first+count-1 fill bins from bin_from on, each_ in a bin, from offset on."""

    length: int
    first: int
    count: int
    bin_from: int
    each_: int
    offset: int


def plan(histogram: dict[int, int], cap: Capacity) -> tuple[list[Run], int]:
    """Vector best-fit decreasing over (length -> number). Returns the runs and the number of bins."""
    full = np.array([cap.tokens, cap.documents, cap.attention], float)
    weights = np.array(cap.weights)
    # groups of equal bins: first bin, number, and what is left of tokens, documents, attention
    where: list[tuple[int, int]] = []
    left = np.zeros((0, 3))
    runs: list[Run] = []
    bins = 0
    for length in sorted(histogram, reverse=True):
        need = np.array([length, 1, length * length], float)
        if (need > full).any():
            raise ValueError(f"a piece of {length} tokens fits no empty bin")
        count, first = histogram[length], 0
        while first < count:
            fits = np.flatnonzero((left >= need).all(axis=1))
            if len(fits):
                if cap.choose == "dot":
                    score = ((left[fits] / full) * (need / full)) @ weights
                else:
                    score = (((left[fits] - need) / full) ** 2) @ weights
                g = int(fits[score.argmin()])
                bin_from, number = where[g]
                room = left[g]
            else:
                g, room, bin_from = None, full, bins
                number = -(-(count - first) // int((full // need).min()))
                bins += number
            each = int((room // need).min())
            filled = min(number, (count - first) // each)
            rest = (count - first) % each if filled < number else 0
            offset = int(full[0] - room[0])
            changed = []  # (first bin, number, left) of what the group becomes
            if filled:
                runs.append(Run(length, first, filled * each, bin_from, each, offset))
                changed.append((bin_from, filled, room - each * need))
                first += filled * each
            if rest and first < count:
                runs.append(Run(length, first, rest, bin_from + filled, rest, offset))
                changed.append((bin_from + filled, 1, room - rest * need))
                first += rest
                filled += 1
            if filled < number:
                changed.append((bin_from + filled, number - filled, room))
            if g is not None:
                where.pop(g)
                left = np.delete(left, g, axis=0)
            kept = [c for c in changed if (c[2] >= 1).all()]
            where += [(a, n) for a, n, _ in kept]
            left = np.concatenate([left, np.array([c[2] for c in kept]).reshape(-1, 3)])
    return runs, bins


# --- placing ---

CHUNK = 256  # pieces of one length that are ranked together, about


def pack(items: DataFrame, cap: Capacity = Capacity()) -> DataFrame:
    """items (doc_id, piece, length, ...) -> with sequence_id and offset."""
    spark = items.sparkSession
    counts = items.groupBy("length").count()
    histogram = {int(r["length"]): int(r["count"]) for r in counts.collect()}  # at most cap.tokens rows
    runs, _ = plan(histogram, cap)
    by_length: dict[int, list] = {}
    for r in runs:
        by_length.setdefault(r.length, []).append((r.first, r.count, r.bin_from, r.each_, r.offset))
    table = spark.createDataFrame(
        [(n, -(-histogram[n] // CHUNK), got) for n, got in by_length.items()],
        "__length long, chunks long, runs array<struct<first: long, count: long, bin: long, each: long, at: long>>",
    )
    # At most cap.tokens rows: one for each length.
    chunked = items.join(F.broadcast(table.select("__length", "chunks")), F.col("length") == F.col("__length")).drop("__length")
    chunked = chunked.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("chunks")))
    sizes = chunked.groupBy(F.col("length").alias("__l"), F.col("chunk").alias("__c")).agg(F.count("*").alias("__n"))
    before = W.partitionBy("__l").orderBy("__c").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0).cast("long"))).drop("__n")
    ranked = chunked.withColumn("__in", F.row_number().over(W.partitionBy("length", "chunk").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(sizes, (F.col("length") == F.col("__l")) & (F.col("chunk") == F.col("__c"))).withColumn("__rank", F.col("__before") + F.col("__in"))
    placed = ranked.join(F.broadcast(table.select("__length", "runs")), F.col("length") == F.col("__length"))
    run = F.filter("runs", lambda r: (F.col("__rank") >= r["first"]) & (F.col("__rank") < r["first"] + r["count"]))[0]
    placed = placed.withColumn("__run", run).withColumn("__k", F.col("__rank") - F.col("__run.first"))
    sequence = F.col("__run.bin") + F.floor(F.col("__k") / F.col("__run.each"))
    offset = F.col("__run.at") + F.col("__k") % F.col("__run.each") * F.col("length")
    return placed.select(*items.columns, sequence.cast("long").alias("sequence_id"), offset.cast("long").alias("offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """Packed pieces with their ids -> a row for each sequence: its ids as one binary in order. A
    sequence holds a bounded number of tokens, so no group is large."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.expr("count(distinct doc_id)").alias("n_docs"), parts.alias("__p")).select(
        "sequence_id", "length", "n_docs", F.aggregate("__p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids")
    )


def pack_documents(docs: DataFrame, tokenizer: str, cap: Capacity = Capacity(), keep_ids: bool = False) -> DataFrame:
    """Tokenize, cut and pack whole documents. The pieces are written once and read three times."""
    return pack(saved(pieces(docs, tokenizer, cap.tokens, keep_ids=keep_ids), "pieces"), cap)
