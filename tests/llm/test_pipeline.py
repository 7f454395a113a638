import hashlib
import zlib
from collections import Counter
from itertools import combinations

import numpy as np

import corpus_pipeline as cp
from lodestar.llm import apportionment, line_dedup
from lodestar.llm.common import saved
from lodestar.llm.registry import tokenizer_path
from tests.llm.test_apportionment import plain_targets, quotients
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_ngram_join import brute, plain_set
from tests.llm.test_quality_rules import plain as plain_counts


def test_stages_one_by_one(spark, data):
    sf = f"{data}/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [docs]
    for name, stage in cp.STAGES:
        seen.append(saved(stage(spark, seen[-1], sf), name.replace(" ", "-")))
    start, good, lines, one, mixed, packed = seen
    for df in (good, lines, one, mixed):
        assert df.columns == list(cp.COLUMNS)
    assert good.count() < start.count()
    gone = {r["doc_id"]: {*r["removed"]} for r in line_dedup.removals(good).collect()}
    want = {r["doc_id"]: "\n".join(x for k, x in enumerate(r["text"].split("\n")) if k not in gone.get(r["doc_id"], ())) for r in good.collect()}
    got = {r["doc_id"]: r["text"] for r in lines.collect()}
    assert all(want[i] == t for i, t in got.items()) and all(not want[i].split() for i in want.keys() - got.keys())
    found = brute([(r["doc_id"], r["text"]) for r in lines.collect()])
    assert sorted(r["doc_id"] for r in one.collect()) == sorted(i for i, (_, c) in found.items() if c == i)
    times = {r["doc_id"]: int(r["taken"] / r["size"] + 0.5) for r in apportionment.mix(apportionment.sized(one)).collect() if r["size"]}
    counts = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert counts == {i: n for i, n in times.items() if n}
    assert packed.filter("piece = 0").count() == mixed.count()
    assert cp.run(spark, sf).count() == packed.count()
    assert [name for name, _ in cp.STAGES][0] == "quality rules" and len(cp.STAGES) == 5


# Every stage once more in plain Python, on rows (doc_id, text, lang, source, n_chars).


def plain_quality(rows):
    """Without labels there are no learned rules."""
    counts = [plain_counts(r[1]) for r in rows]
    return [r for r, n in zip(rows, counts, strict=True) if n[0] >= 50 and 100 * n[4] <= 50 * n[0]]


def plain_lines(rows):
    """Rows of one id and text are one document; each other row is one of its own."""
    texts = sorted({r[:2] for r in rows}, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    gone = brute_lines([(k, t) for k, (_, t) in enumerate(texts)])
    left = {x: "\n".join(line for at, line in enumerate(x[1].split("\n")) if at not in gone[k]) for k, x in enumerate(texts)}
    return [(r[0], left[r[:2]], *r[2:4], r[4] if left[r[:2]] == r[1] else len(left[r[:2]])) for r in rows if left[r[:2]].split()]


def plain_join(rows):
    """The first row of each group of linked rows."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    sets, up = [plain_set(r[1]) for r in rows], [*range(len(rows))]
    for x, y in combinations(range(len(rows)), 2):
        if 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
            p, q = sorted((up[x], up[y]))
            up = [p if u == q else u for u in up]
    return [r for k, r in enumerate(rows) if up[k] == k]


def plain_mix(rows):
    """Sources of one shard each, in blocks of 32 words."""
    size = [len(r[1].split()) for r in rows]
    sizes = Counter()
    for r, n in zip(rows, size, strict=True):
        sizes[r[3]] += n
    target = plain_targets(sizes)
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    blocks = dict(zip(names, quotients([target[s] for s in names], int(sum(target.values()) / 32 + 0.5)), strict=True))
    dice = [int(hashlib.md5(f"1:{'null' if r[0] is None else r[0]}".encode()).hexdigest()[16:24], 16) for r in rows]
    start, out = Counter(), []
    for k in sorted(range(len(rows)), key=lambda k: (dice[k], rows[k][0] is not None, rows[k][0] or 0, size[k])):
        s = rows[k][3]
        whole, rest = divmod(min(32 * blocks[s], 2 * sizes[s]), sizes[s])
        taken = whole * size[k] + max(0, min(size[k], rest - start[s]))
        start[s] += size[k]
        out += [rows[k]] * int(taken / size[k] + 0.5)
    return out


def plain_pieces(rows):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(tokenizer_path())
    ids = [(r[0], [*made.encode(r[1], add_special_tokens=False).ids, 0]) for r in rows]
    return [(i, k, at, len(x[at : at + 2048]), zlib.crc32(np.array(x[at : at + 2048], "<u4").tobytes())) for i, x in ids for k, at in enumerate(range(0, len(x), 2048))]


def test_stages_and_run_equal_plain_python(spark, make, prose, tmp_path):
    """With null and repeated ids, texts that are alike but for their lines, and long ones. What
    reaches mixing has each id once: repeat() takes rows that share an id together."""
    one = lambda k, n=70: prose(300 + k, n)
    parted = lambda t: t.replace(" ", "\n", 40).replace("\n", " ", 39)  # noqa: E731  same words, another line break
    a, b, c, d, e = (one(k) for k in range(5))
    rows = [(3, a), (9, parted(a)), (9, one(10)), (None, b), (5, parted(b)), (None, one(11)), (None, one(11)), (4, c), (4, c), (2, d), (6, parted(d))]
    rows += [(20, e), (21, f"{one(12)}\n{e}\n{one(13)}"), (22, e), (23, None), (24, ""), (25, "a few words"), (26, "x y z " * 40), (27, one(14, 2500)), (28, one(15))]
    rows += [(40 + k, one(20 + k, 50 + 3 * k)) for k in range(30)]
    rows = [(i, t, "en", ("s0", "s1", "s2", None)[(i or 0) % 4]) for i, t in rows]
    df = make(rows)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got, want = df, [tuple(r) for r in df.collect()]
    for (name, stage), plain in zip(cp.STAGES[:4], (plain_quality, plain_lines, plain_join, plain_mix), strict=True):
        got, before, want = saved(stage(spark, got, str(tmp_path)), "plain"), len(want), plain(want)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr), name
        assert len(want) != before, name
    pieces = lambda f: sorted([(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in f.collect()], key=repr)
    assert pieces(cp.STAGES[4][1](spark, got, str(tmp_path))) == sorted(plain_pieces(want), key=repr)
    assert pieces(cp.run(spark, str(tmp_path))) == sorted(plain_pieces(want), key=repr)
