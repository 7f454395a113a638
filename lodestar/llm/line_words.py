"""Lines of whole texts as sets of words in the order of rarity, by DataFrame functions alone.

A word is a 63-bit token: six bits of how common it is, then 57 bits of its hash. Sorted, the tokens
of a line run from its rarest word to its most common one. How common a word is, is counted over all
words of all documents by the first 16 bits of their hashes, in half powers of two; words with equal
counts follow in the order of their hashes. The counts are a table of fixed size, whatever the
corpus; any order that is the same for all lines gives the same matches.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import SPACES
from lodestar.llm.shingles import _BYTES, _table, mixed

U = np.uint64
COUNTERS = 1 << 16
#: Bytes hashed together, about.
PIECE = 1 << 17
_APART = np.isin(np.arange(256), np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8))


def words_of(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(line, hash) of every word `[^\\x20\\x09-\\x0D]+`, in order; lines are counted from 0. The plain
    version that tests hold the columns below against; no query runs it."""
    b = np.frombuffer(raw, np.uint8)
    inside = np.zeros(len(b) + 2, bool)
    np.logical_not(_APART[b], out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    line = np.searchsorted(np.flatnonzero(b == 10), start)
    out = np.empty(len(start), U)
    k = 0
    while k < len(start):
        stop = max(k + 1, int(np.searchsorted(end, start[k] + PIECE, "right")))
        a, z = int(start[k]), int(end[stop - 1])
        up, down = _table(z - a + 1)
        sums = np.zeros(z - a + 1, U)
        np.cumsum(_BYTES[b[a:z]] * up[: z - a], dtype=U, out=sums[1:])
        first, last = start[k:stop] - a, end[k:stop] - a
        out[k:stop] = mixed((sums[last] - sums[first]) * down[first] + (last - first).astype(U))
        k = stop
    return line, out


def _hashes(text: Column, regex: str, plain: str) -> Column:
    """64-bit hashes of the words of a text without null; parted by plain, a pattern that is quick to
    split by, where no other character than its own parts words."""
    rare = [s for s in SPACES if s not in plain]
    odd = F.lit(False)
    for s in rare:
        odd = odd | F.contains(text, F.lit(s))
    parts = F.when(odd, F.split(text, regex)).otherwise(F.split(text, plain))
    return F.transform(F.array_remove(parts, ""), lambda w: F.xxhash64(w))


def _counter(h: Column) -> Column:
    return F.shiftrightunsigned(h, 48).cast("int")


def word_counts(docs: DataFrame) -> list[int]:
    """Words of all documents by the first 16 bits of their hashes: COUNTERS numbers."""
    spaces = f"[{SPACES}]"
    words = docs.filter("text is not null").select(F.explode(F.split("text", spaces)).alias("w"))
    counts = words.filter("w <> ''").groupBy(_counter(F.xxhash64("w")).alias("at")).agg(F.count("*").alias("n"))
    out = [0] * COUNTERS
    for r in counts.collect():  # at most COUNTERS rows
        out[r["at"]] = r["n"]
    return out


def commonness(counts: list[int]) -> list[int]:
    """0 (rarest) to 63 for each counter."""
    return [min(63, int(2 * math.log2(max(n, 1)))) for n in counts]


def prefix_lengths(n: np.ndarray, share: tuple[int, int]) -> np.ndarray:
    """Of a set of n in order, how many of its first neighbouring pairs must hold one that any other
    set which matches it has as neighbours too; 0 if only an equal set matches.

    A word that the other lacks parts two pairs at most and one that only the other has parts one,
    so sets of n and m with o words in common share n - 1 - 2 (n - o) - (m - o) pairs at least. The
    most is needed for the least m, or one or two more, as the overlap required goes by whole words."""
    num, den = share
    out = np.zeros(len(n), np.int64)
    least = -(-n * num // den)
    for m in (least, least + 1, least + 2):
        o = -(-(n + m) * num // (num + den))
        some = (m * num <= n * den) & ((o < n) | (o < m))
        out = np.maximum(out, np.where(some, 2 * (n - o) + (m - o) + 1, 0))
    return np.minimum(out, np.maximum(n - 1, 0))


def prefix_length(n: Column, share: tuple[int, int]) -> Column:
    """prefix_lengths() of a column."""
    num, den = F.lit(share[0]).cast("long"), F.lit(share[1]).cast("long")
    n, out = n.cast("long"), F.lit(0).cast("long")
    for more in (0, 1, 2):
        m = F.floor((n * num + den - 1) / den) + more
        o = F.floor(((n + m) * num + (num + den - 1)) / (num + den))
        some = (m * num <= n * den) & ((o < n) | (o < m))
        out = F.greatest(out, F.when(some, (n - o) * 2 + (m - o) + 1).otherwise(0))
    return F.least(out, F.greatest(n - 1, F.lit(0))).cast("int")


def line_records(docs: DataFrame, counts: list[int], share: tuple[int, int]) -> DataFrame:
    """(doc_id, key, line, cls, n, bits, more, prefix) of docs (doc_id, key, text): of every line with
    words its class (a digest of its set), the size of the set, the parity of its tokens by their last
    six bits (bits), the same of those tokens alone whose seventh bit is set (more), and the tokens of
    the neighbouring pairs of its prefix, from which prefix_pairs() makes these."""
    common = F.split(F.lit(",".join(str(c << 57) for c in commonness(counts))), ",").cast("array<bigint>")  # one constant
    lines = docs.select("doc_id", "key", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    lines = lines.filter(F.ltrim("t", F.lit(SPACES)) != "")  # from one end: btrim() looks at all characters
    hashes = F.array_distinct(_hashes(F.col("t"), f"[{SPACES}]+", " "))
    rarity = lambda h: F.coalesce(F.get(common, _counter(h)), F.lit(0).cast("long"))  # noqa: E731 (never null, so that longs are sorted)
    tokens = F.transform(hashes, lambda h: rarity(h).bitwiseOR(F.shiftrightunsigned(h, 7)))
    df = lines.select("doc_id", "key", "line", F.sort_array(tokens).alias("t"))
    bit = lambda t: t.bitwiseAND(F.lit(63)).cast("int")
    parity = lambda of: F.aggregate("t", F.lit(0).cast("long"), lambda a, t: a.bitwiseXOR(F.call_function("shiftleft", of(t), bit(t))))
    length = prefix_length(F.size("t"), share)
    return df.select(
        "doc_id",
        "key",
        "line",
        F.xxhash64("t").alias("cls"),
        F.size("t").alias("n"),
        parity(lambda t: F.lit(1).cast("long")).alias("bits"),
        parity(lambda t: F.shiftrightunsigned(t, 6).bitwiseAND(F.lit(1).cast("long"))).alias("more"),
        F.slice("t", F.lit(1), F.when(length > 0, length + 1).otherwise(0)).alias("prefix"),
    )


def prefix_pairs(records: DataFrame, *columns: str) -> DataFrame:
    """(*columns, place, pair) of the neighbouring pairs of each prefix, as hashes. Made one by one as
    rows, where the code is compiled, and not in an array."""
    places = records.filter(F.size("prefix") > 1).select(*columns, "prefix", F.explode(F.sequence(F.lit(0), F.size("prefix") - 2)).alias("place"))
    return places.select(*columns, "place", F.xxhash64(F.get("prefix", F.col("place")), F.get("prefix", F.col("place") + 1)).alias("pair"))
