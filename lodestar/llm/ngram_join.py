"""N-gram Jaccard join: documents whose sets of word shingles overlap enough, by T-occurrence search.

1. Sets. Each text becomes a set of shingle hashes; equal sets are one class, so copies are one row
   from here on. (A class is a 64-bit digest, and only classes of equal size are compared.)
2. Rarity. Shingles are counted over all classes. Tokens travel as packed arrays, one row for each
   part of the hash space and batch of documents, not as rows. A shingle that one class alone has
   links nothing and is dropped. A class that keeps too few shingles for the required overlap has
   no partner at all; most documents end here.
3. Neighbourhoods. The shingles of a class are ordered by rarity; two classes that link share one in
   the prefix of each that the overlap bound leaves. Classes joined by prefix shingles form
   neighbourhoods. Within a batch a shingle is represented by its first class, so a shingle that
   very many classes share is one row for each batch.
4. Search. In each neighbourhood DivideSkip finds the partners of each class (tooccurrence.py).
   Neighbourhoods larger than ``block`` are searched in blocks, then among the representatives of
   what was connected, and then between all pairs of blocks that are not wholly one component.
   This is exact, and pieces that one component fills need no search between each other.
5. Components of the links, mapped back to documents.

The bounds are whole numbers: sets link when share[1] * |x & y| >= share[0] * |x | y|.

Cases: a null text, or one without words, has an empty set and links with nothing, not even with
another such; a text with fewer words than a shingle has its whole sequence as its one shingle;
rows that share a doc_id are each placed by their own text; null ids are placed too but name no
component; ties need no rule, as components do not depend on order; an empty table gives an empty
result; columns besides doc_id and text play no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import drop_saved, free_shuffles, map_arrow, saved
from lodestar.llm.components import connected_components
from lodestar.llm.shingles import set_class, shingle_set
from lodestar.llm.tooccurrence import connect

SHARE = (80, 100)
U = np.uint64
_LOW = U((1 << 48) - 1)
#: Tokens of one part of the hash space, of one batch, and of one part of the classes, about.
PART, BATCH = 1_000_000, 1 << 18


def _rows(schema: str, *columns) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    of = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, of[k]) for c, k in zip(columns, kinds, strict=True)], names=list(names))


# --- 1: sets ---

SETS = "doc_id long, n int, cls long, hash long"


def document_sets(docs: DataFrame, width: int = 5) -> DataFrame:
    """(doc_id, size of the set, class, hash of the text) of every document; the class of an empty
    set is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t.as_py(), width) for t in b.column(1)]
            yield _rows(SETS, b.column(0), [len(s) for s in sets], [set_class(s) if len(s) else None for s in sets], b.column(2))

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text")), run, SETS)


# --- 2: rarity, on packed arrays ---
# A blob is: number of classes (int64), classes (int64), tokens of each (uint32), then low 32 and
# next 16 bits of each token, then 16 bits of its count where counts are known.

BLOBS = "part int, place int, blob binary"


def _pack(classes: np.ndarray, each: np.ndarray, tokens: np.ndarray, counts: np.ndarray | None = None) -> bytes:
    parts = [np.array([len(classes)], np.int64), classes.astype(np.int64), each.astype(np.uint32), (tokens & U(0xFFFFFFFF)).astype(np.uint32), (tokens >> U(32) & U(0xFFFF)).astype(np.uint16)]
    return b"".join(x.tobytes() for x in (parts if counts is None else [*parts, counts.astype(np.uint16)]))


def _unpack(blob: bytes, counted: bool = False):
    k = int(np.frombuffer(blob, np.int64, 1)[0])
    classes = np.frombuffer(blob, np.int64, k, 8)
    each = np.frombuffer(blob, np.uint32, k, 8 + 8 * k).astype(np.int64)
    n, at = int(each.sum()), 8 + 12 * k
    tokens = np.frombuffer(blob, np.uint32, n, at).astype(U) | np.frombuffer(blob, np.uint16, n, at + 4 * n).astype(U) << U(32)
    return classes, each, tokens, np.frombuffer(blob, np.uint16, n, at + 6 * n) if counted else None


def _part_of(tokens: np.ndarray, parts: int) -> np.ndarray:
    return ((tokens ^ tokens >> U(29)) * U(0x9E3779B97F4A7C15) >> U(33)) % U(parts)


def _dealt(classes: np.ndarray, tokens: np.ndarray, to: np.ndarray, counts: np.ndarray | None = None) -> Iterator[tuple[int, bytes]]:
    """(part, blob) of tokens and their classes, dealt by ``to``. Tokens of a class lie together."""
    order = np.argsort(to, kind="stable")
    to, classes, tokens = to[order], classes[order], tokens[order]
    counts = None if counts is None else counts[order]
    edges = np.flatnonzero(np.r_[True, to[1:] != to[:-1], True]) if len(to) else np.zeros(1, int)
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        c = classes[a:b]
        starts = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
        yield int(to[a]), _pack(c[starts], np.diff(np.r_[starts, len(c)]), tokens[a:b], None if counts is None else counts[a:b])


def _token_blobs(docs: DataFrame, parts: int, width: int) -> DataFrame:
    def flush(held: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        tokens = np.concatenate([*held.values()])
        classes = np.repeat(np.fromiter(held, np.int64, len(held)), [len(s) for s in held.values()])
        got = [*_dealt(classes, tokens, _part_of(tokens, parts).astype(np.int64))]
        for k in range(0, len(got), 64):
            yield _rows(BLOBS, [p for p, _ in got[k : k + 64]], [0] * len(got[k : k + 64]), [x for _, x in got[k : k + 64]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        weight = 0
        for b in batches:
            for t in b.column(0):
                s = shingle_set(t.as_py(), width)
                if len(s) and (c := set_class(s)) not in held:
                    held[c] = s
                    weight += len(s)
                    if weight >= BATCH:
                        yield from flush(held)
                        held, weight = {}, 0
        if held:
            yield from flush(held)

    return map_arrow(docs.select("text"), run, BLOBS)


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    """Rows sorted by part -> (part, [(place, blob)])."""
    now, held = None, []
    for b in batches:
        for part, place, blob in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            if part != now and held:
                yield now, held
                held = []
            now = part
            held.append((place, blob))
    if held:
        yield now, held


def _shared_tokens(blobs: DataFrame, parts: int, places: int) -> DataFrame:
    """Tokens that several classes have, with their count, dealt by class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _by_part(batches):
            got = [_unpack(blob) for _, blob in rows]
            tokens = np.concatenate([g[2] for g in got])
            classes = np.concatenate([np.repeat(g[0], g[1]) for g in got])
            order = np.argsort(tokens, kind="stable")
            t = tokens[order]
            same = t[1:] == t[:-1]
            order = order[np.r_[False, same] | np.r_[same, False]]
            order = order[np.lexsort((classes[order], tokens[order]))]
            t, c = tokens[order], classes[order]
            if len(t):
                new = np.r_[True, (t[1:] != t[:-1]) | (c[1:] != c[:-1])]  # a class may come from several batches
                t, c = t[new], c[new]
                starts = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
                n = np.diff(np.r_[starts, len(t)])
                n = np.repeat(n, n)
                t, c, n = t[n > 1], c[n > 1], n[n > 1]
            order = np.argsort(c, kind="stable")
            t, c, n = t[order], c[order], np.minimum(n[order], 65535) if len(t) else t
            to = (mixed_place(c, places)).astype(np.int64)
            for place, blob in _dealt(c, t, to, n):
                yield _rows(BLOBS, [place], [part], [blob])

    return map_arrow(blobs.repartition(parts, "part").sortWithinPartitions("part"), run, BLOBS)


def mixed_place(classes: np.ndarray, places: int) -> np.ndarray:
    return (classes.view(U) * U(0xD6E8FEB86659FD93) >> U(32)) % U(places)


def _class_blobs(sets: DataFrame, places: int) -> DataFrame:
    """(class, size of its set) as blobs, dealt by class; place -1 marks them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c, n = np.array(b.column(0).to_pylist(), np.int64), np.array(b.column(1).to_pylist(), np.int64)
            c, first = np.unique(c, return_index=True)
            n, to = n[first], mixed_place(c, places)
            for place in np.unique(to):
                at = to == place
                yield _rows(BLOBS, [int(place)], [-1], [c[at].tobytes() + n[at].tobytes()])

    return map_arrow(sets.filter("cls is not null").select("cls", "n"), run, BLOBS)


RECORDS = "cls long, n int, prefix int, tokens binary"


def _records(blobs: DataFrame, places: int, share: tuple[int, int]) -> DataFrame:
    """Classes that can have a partner: their shared tokens in the order of rarity, and how many of
    them the prefix holds. The tokens that no other class has come first of all and are left out."""
    num, den = share

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_part(batches):
            sizes: dict[int, int] = {}
            for place, blob in rows:
                if place < 0:
                    x = np.frombuffer(blob, np.int64)
                    sizes.update(zip(x[: len(x) // 2].tolist(), x[len(x) // 2 :].tolist(), strict=True))
            got = [(part, *_unpack(blob, True)) for part, blob in rows if part >= 0]
            if not got:
                continue
            c = np.concatenate([np.repeat(g[1], g[2]) for g in got])
            t = np.concatenate([g[3] | U(g[0] & 0xFFFF) << U(48) for g in got])
            n = np.concatenate([g[4] for g in got])
            order = np.lexsort((t, n, c))
            c, t = c[order], t[order]
            starts = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
            out: list[tuple] = []
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(c)], strict=True):
                cls, size = int(c[a]), sizes[int(c[a])]
                least = -(-num * size // den)
                if b - a >= least:
                    out.append((cls, size, b - a - least + 1, t[a:b].tobytes()))
                if len(out) >= 512:
                    yield _rows(RECORDS, *zip(*out, strict=True))
                    out = []
            if out:
                yield _rows(RECORDS, *zip(*out, strict=True))

    return map_arrow(blobs.repartition(places, "part").sortWithinPartitions("part"), run, RECORDS)


# --- 3: neighbourhoods ---

CELLS = "token long, a long, b long"


def _cells(records: DataFrame) -> DataFrame:
    """Star edges (null, a, b) of the prefix tokens within each batch, and (token, first class, null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, int]] = []
        weight = 0

        def flush() -> Iterator[pa.RecordBatch]:
            t = np.concatenate([x for x, _ in held])
            c = np.repeat(np.array([k for _, k in held], np.int64), [len(x) for x, _ in held])
            order = np.lexsort((c, t))
            t, c = t[order], c[order]
            new = np.r_[True, t[1:] != t[:-1]]
            lead = c[new][np.cumsum(new) - 1]
            edges = np.unique(np.stack([lead, c], axis=1)[lead != c], axis=0)
            tokens = t[new].view(np.int64)
            yield _rows(CELLS, pa.nulls(len(edges), pa.int64()), edges[:, 0], edges[:, 1])
            yield _rows(CELLS, tokens, c[new], pa.nulls(len(tokens), pa.int64()))

        for b in batches:
            for cls, prefix, raw in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                held.append((np.frombuffer(raw, U, prefix), cls))
                weight += prefix
                if weight >= BATCH:
                    yield from flush()
                    held, weight = [], 0
        if held:
            yield from flush()

    return map_arrow(records.select("cls", "prefix", "tokens"), run, CELLS)


def neighbourhoods(records: DataFrame) -> DataFrame:
    """(node, label): classes that prefix tokens connect."""
    cells = saved(_cells(records), "cells")
    # a token has one row for each batch that it occurs in
    firsts = cells.filter("token is not null").groupBy("token").agg(F.collect_set("a").alias("all")).filter(F.size("all") > 1)
    between = firsts.select(F.array_min("all").alias("a"), F.explode("all").alias("b"))
    return connected_components(cells.filter("token is null").select("a", "b").union(between))


# --- 4: search ---

LINKS = "a long, b long"
GROUPED = "task long, side int, cls long, n int, tokens binary, label long"


def _search(grouped: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Rows of GROUPED -> links that connect each task's records. side 0 and 1: records of one side
    are only searched for on the other; side 2: all against all."""

    def links(rows: list[tuple]) -> list[tuple[int, int]]:
        sides = [r[0] for r in rows]
        split = None if 2 in sides else sides.count(0)
        tokens = [np.frombuffer(r[3], U).tolist() for r in rows]
        found = connect([r[2] for r in rows], tokens, [r[4] for r in rows], share, split)
        return [(rows[x][1], rows[y][1]) for x, y in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            for task, *row in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                if task != now and held:
                    if got := links(held):
                        yield _rows(LINKS, *zip(*got, strict=True))
                    held = []
                now = task
                held.append(tuple(row))
        if held and (got := links(held)):
            yield _rows(LINKS, *zip(*got, strict=True))

    names = [x.split()[0] for x in GROUPED.split(", ")]
    return map_arrow(grouped.select(*names).repartition("task").sortWithinPartitions("task", "side", "cls"), run, LINKS)


def _labelled(records: DataFrame, links: DataFrame) -> DataFrame:
    """records with the label that links give them (their own class where none does)."""
    found = connected_components(links).select(F.col("node").alias("__n"), F.col("label").alias("__l"))
    return records.drop("label").join(found, F.col("cls") == F.col("__n"), "left").withColumn("label", F.coalesce("__l", "cls")).drop("__n", "__l")


def _blocks(size, block: int):
    return F.greatest(F.ceil(size / F.lit(block)), F.lit(1)).cast("long")


def find_links(records: DataFrame, share: tuple[int, int] = SHARE, block: int = 200) -> DataFrame:
    """(a, b) links between classes, enough to connect all that link."""
    around = neighbourhoods(records)
    sizes = saved(around.groupBy(F.col("label").alias("nb")).agg(F.count("*").alias("size")).filter(F.col("size") > block), "large")
    placed = around.join(sizes, F.col("label") == F.col("nb"), "left").select(F.col("node"), F.col("label").alias("nb"), "size")
    own = saved(records.join(placed, F.col("cls") == F.col("node")).drop("node"), "placed")
    dice = F.pmod(F.xxhash64("cls", F.lit(5)), _blocks(F.coalesce("size", F.lit(1)), block))
    first = own.withColumns({"task": F.xxhash64("nb", dice), "side": F.lit(2), "label": F.col("cls")})
    links = saved(_search(first, share), "links")
    if sizes.isEmpty():
        drop_saved(own)
        return links

    # Neighbourhoods of several blocks. Representatives of what is connected so far: those of the
    # larger components meet each other first.
    big = own.filter("size is not null")
    big = saved(_labelled(big, links), "big")
    drop_saved(own)
    weights = saved(big.groupBy(F.col("label").alias("l")).agg(F.count("*").alias("weight")), "weights")
    heads = big.filter("cls = label").join(weights, F.col("label") == F.col("l")).withColumn("heavy", F.col("weight") >= 4)
    n_heads = saved(heads.groupBy(F.col("nb").alias("b"), F.col("heavy").alias("h")).agg(F.count("*").alias("heads")), "heads")
    heads = heads.join(n_heads, (F.col("nb") == F.col("b")) & (F.col("heavy") == F.col("h")))
    dice = F.pmod(F.xxhash64("cls", F.lit(6)), _blocks(F.col("heads"), block))
    heads = heads.withColumns({"task": F.xxhash64("nb", "heavy", dice), "side": F.lit(2)})
    links = saved(links.union(_search(heads, share)), "links")

    # All pairs of blocks but those of one component. A component of half a block or more fills
    # blocks of its own; smaller ones share blocks, whole.
    big = saved(_labelled(big, links), "big")
    weights = saved(big.groupBy(F.col("nb").alias("b"), F.col("label").alias("l")).agg(F.count("*").alias("weight")), "weights")
    rest = saved(weights.filter(F.col("weight") * 2 < block).groupBy(F.col("b").alias("r")).agg(F.sum("weight").alias("mixed")), "rest")
    big = big.join(weights, (F.col("nb") == F.col("b")) & (F.col("label") == F.col("l"))).join(rest, F.col("nb") == F.col("r"), "left")
    pure = F.col("weight") * 2 >= block
    whole = F.when(pure, F.col("label"))
    at = F.when(pure, F.pmod(F.xxhash64("cls", F.lit(7)), _blocks(F.col("weight"), block))).otherwise(F.pmod(F.xxhash64("label", F.lit(8)), _blocks(F.col("mixed"), block)))
    big = saved(big.select("cls", "n", "tokens", "nb", "label", whole.alias("whole"), at.alias("at")), "blocks")
    blocks = saved(big.select("nb", "whole", "at").distinct().withColumn("block", F.xxhash64("nb", "whole", "at")), "block-list")
    left, right = (blocks.select(*[F.col(c).alias(f"{c}_{k}") for c in blocks.columns]) for k in "xy")
    pairs = left.join(right, (F.col("nb_x") == F.col("nb_y")) & (F.col("block_x") <= F.col("block_y")))
    pairs = pairs.filter(F.col("whole_x").isNull() | F.col("whole_y").isNull() | (F.col("whole_x") != F.col("whole_y")))
    task = F.xxhash64("block_x", "block_y")
    alone = F.col("block_x") == F.col("block_y")
    # mixed blocks ask, pure ones are searched: the side that asks has the more labels
    asks_x = F.col("whole_x").isNull()
    to = pairs.select(F.col("block_x").alias("k"), task.alias("task"), F.when(alone, 2).when(asks_x, 0).otherwise(1).alias("side")).union(
        pairs.filter(~alone).select("block_y", task, F.when(asks_x, 1).otherwise(0))
    )
    to = saved(to, "pairs")
    spread = big.withColumn("block", F.xxhash64("nb", "whole", "at")).join(to, F.col("block") == F.col("k"))
    links = saved(links.union(_search(spread, share)), "links")
    drop_saved(big, to)
    return links


# --- 5: documents ---


def join(docs: DataFrame, share: tuple[int, int] = SHARE, width: int = 5, block: int = 200) -> DataFrame:
    """(doc_id, n_shingles, component_id, cls, hash, grp): component_id is the least doc_id that links
    reach; hash is of the text; grp is the same for rows that links reach, null for those without."""
    spark = docs.sparkSession
    sets = saved(document_sets(docs, width), "sets")
    total = sets.agg(F.sum(F.col("n").cast("long"))).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts, places = max(least, -(-total // PART)), max(least, -(-total // (4 * PART)))
    shared = _shared_tokens(_token_blobs(docs, parts, width), parts, places)
    records = saved(_records(shared.union(_class_blobs(sets, places)), places, share), "records")
    free_shuffles(spark)
    links = find_links(records, share, block)
    drop_saved(records)
    free_shuffles(spark)

    label = connected_components(links).select(F.col("node").alias("__n"), F.col("label").alias("__l"))
    classes = sets.filter("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    classes = classes.join(label, F.col("cls") == F.col("__n"), "left").filter("copies > 1 or __l is not null")
    classes = saved(classes.select("cls", "first", F.coalesce("__l", "cls").alias("label")), "classes")
    groups = saved(classes.groupBy(F.col("label").alias("g")).agg(F.min("first").alias("component")), "groups")
    named = classes.join(groups, F.col("label") == F.col("g")).select(F.col("cls").alias("__c"), "component", F.col("label").alias("grp"))
    named = saved(named, "named")
    out = sets.join(named, F.col("cls") == F.col("__c"), "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), "cls", "hash", "grp")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One document of each group of linked documents, all columns as they were: the row of least id,
    null ids last, then of least hash of its text, then of least hash of all its columns. Rows go by
    id and text, so others of the same id stay. The join is with the rows that go, which are the
    fewer where copies are the exception."""
    rows = join(docs, **options).filter("grp is not null").groupBy("grp", "doc_id", "hash").agg(F.count("*").alias("times"))
    rows = saved(rows, "linked")
    place = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("hash"))
    firsts = saved(rows.groupBy(F.col("grp").alias("g")).agg(F.min(place).alias("first")), "firsts")
    rows = rows.join(firsts, F.col("grp") == F.col("g"))
    gone = rows.filter((place != F.col("first")) | (F.col("times") > 1))
    gone = saved(gone.select(F.col("doc_id").alias("__id"), F.col("hash").alias("__hash"), (place == F.col("first")).alias("__stays")), "gone")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__hash"))
    kept = docs.join(gone, same, "left_anti")
    repeated = gone.filter("__stays")
    if repeated.isEmpty():
        return kept
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    again = docs.join(repeated, same).groupBy("__id", "__hash").agg(F.min_by(whole, F.xxhash64(F.to_json(whole))).alias("__row"))
    return kept.union(again.select("__row.*"))
