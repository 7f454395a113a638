import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import line_dedup, line_words
from tests.llm.conftest import ODD
from tests.llm.test_ngram_join import edited


def brute(rows):
    """Removed line numbers of each document, by comparing every line with all earlier ones."""
    out, earlier = {}, []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        out[i] = []
        for k, line in enumerate((text or "").split("\n")):
            s = {*line.encode().split()}
            if not s:
                continue
            if any(100 * len(s & e) >= 80 * len(s | e) for e in earlier):
                out[i].append(k)
            earlier.append(s)
    return out


def removed(df):
    return {r["doc_id"]: list(r["removed"]) for r in line_dedup.removals(df).collect()}


@pytest.fixture(scope="module")
def corpus(prose):
    dice = random.Random(2)
    base = [prose(k, dice.choice((3, 5, 8, 20, 60, 61, 120))) for k in range(40)]
    rows = []
    for i in range(80):
        lines = [dice.choice(base) if dice.random() < 0.4 else edited(dice.choice(base), dice, dice.choice((1, 1, 2))) if dice.random() < 0.6 else prose(1000 + i * 50 + k, 12) for k in range(dice.randrange(1, 9))]
        rows.append((i, "\n".join(lines)))
    return [*rows, *((200 + k, t) for k, t in enumerate(ODD) if t is None or len(t) < 100_000)]


def test_equals_brute_force(make, corpus):
    want = {i: x for i, x in brute(corpus).items()}
    got = removed(make(corpus))
    assert {i: got.get(i, []) for i in want} == want


def test_a_group_of_near_copies(make, prose):
    """Every line has prefix tokens in common with all others, and few match."""
    dice = random.Random(6)
    base = prose(77, 58)
    rows = [(i, edited(base, dice, dice.choice((0, 1, 1, 1, 2, 4)))) for i in range(150)]
    want, got = brute(rows), removed(make(rows))
    assert {i: got.get(i, []) for i in want} == want


def test_crowded_pairs(make, prose):
    """Near copies of a line that is not there itself, and lines that share a passage and do not match."""
    dice = random.Random(8)
    base, passage = prose(78, 40), prose(79, 30)
    rows = [(i, edited(base, dice, dice.choice((2, 3, 4, 5)))) for i in range(60)]
    rows += [(100 + i, f"{passage} {prose(900 + i, 20)}") for i in range(40)]
    want, got = brute(rows), removed(make(rows))
    assert {i: got.get(i, []) for i in want} == want
    assert 20 < sum(map(len, want.values())) < 60


def test_one_changed_word_is_caught(make, prose):
    """Planted edits: lines of nine words and more, each once more with one inner word changed."""
    dice = random.Random(9)
    base = [prose(4000 + k, dice.choice((9, 12, 20, 27, 40, 57, 99))) for k in range(120)]
    edited_ = []
    for line in base:
        w = line.split()
        w[dice.randrange(1, len(w) - 1)] = "altered"
        edited_.append(" ".join(w))
    rows = [(k, t) for k, t in enumerate([*base, *edited_])]
    got = removed(make(rows))
    assert not any(got[k] for k in range(120))
    caught = [got[120 + k] == [0] for k in range(120)]
    long = [c for c, line in zip(caught, base, strict=True) if len({*line.split()}) >= 9]
    assert len(long) > 100 and all(long)


def test_prefixes_hold_a_pair_of_any_match():
    """Over all sizes and all ways to differ: the shared pairs left are as many as the bound says."""
    dice = random.Random(4)
    for _ in range(4000):
        n = dice.randrange(1, 40)
        x = sorted(dice.sample(range(200), n))
        gone, added = dice.randrange(0, 1 + n // 4), dice.randrange(0, 1 + n // 4)
        y = sorted({*x} - {*dice.sample(x, gone)} | {*dice.sample(range(200), added)})
        if not y or 100 * len({*x} & {*y}) < 80 * len({*x} | {*y}) or x == y:
            continue
        (a, b) = line_words.prefix_lengths(np.array([len(x), len(y)]), (80, 100))
        pairs = lambda s, k: {(s[i], s[i + 1]) for i in range(k)}
        assert pairs(x, a) & pairs(y, b), (x, y)


def test_words_and_lines_of_bytes(prose):
    for raw in (b"", b"\n", b" a\tb\x0b\x0cc\r\nd  \n\ne", prose(3, 50_000).replace(" the", "\n").encode(), b"x" * 400_000 + b" y"):
        line, h = line_words.words_of(raw)
        want = [(k, w) for k, part in enumerate(raw.split(b"\n")) for w in part.split()]
        assert line.tolist() == [k for k, _ in want]
        assert h.tolist() == [int(line_words.words_of(w)[1][0]) for _, w in want[:50]] + h.tolist()[50:]
        assert len({*h.tolist()}) == len({w for _, w in want})


def test_lines_without_words_long_ones_and_bounds(make, prose):
    assert removed(make([(1, " "), (2, ""), (3, "\n\t\n")])) == {}
    rows = [(1, prose(1, 30_000)), (2, prose(1, 30_000) + " more"), (3, "\n".join(prose(50 + k, 3) for k in range(3000)))]
    want, got = brute(rows), removed(make(rows))
    assert {i: got.get(i, []) for i in want} == want and want[2] == [0]
    with pytest.raises(ValueError, match="three quarters"):
        line_dedup.lines_of(make(rows), (70, 100))


def test_texts_are_put_together_again(make, prose):
    a, b, c = prose(1, 12), prose(2, 12), prose(3, 12)
    rows = [(1, f"{a}\n\n{b}\n"), (2, f"{b}\n{c}\n\n{a}"), (3, a), (4, ""), (5, None), (6, "\n \n")]
    df = make(rows, extra=True)
    out = line_dedup.dedup(df)
    assert out.columns == df.columns
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    assert got == {1: (f"{a}\n\n{b}\n", len(a) + len(b) + 3), 2: (f"{c}\n", len(c) + 1), 4: ("", 0), 5: (None, 0), 6: ("\n \n", 3)}


def test_repeats_null_ids_and_empty_tables(make, prose):
    a, b = prose(4, 15), prose(5, 15)
    rows = [(1, a), (1, a), (2, f"{a}\n{b}"), (2, b), (None, b)]
    got = sorted((r["doc_id"] or -1, r["text"]) for r in line_dedup.dedup(make(rows)).collect())
    assert got == [(-1, b), (1, a), (1, a)]  # b goes to the null id, which comes first
    assert line_dedup.dedup(make([])).count() == 0


def test_no_python_on_executors(make, prose, monkeypatch):
    from pyspark.sql import DataFrame

    def refuse(*_, **__):
        raise AssertionError("Python on the executors")

    for name in ("mapInArrow", "mapInPandas"):
        monkeypatch.setattr(DataFrame, name, refuse)
    a, b = prose(6, 20), prose(7, 20)
    assert removed(make([(1, f"{a}\n{b}"), (2, f"{b} more\n{prose(8, 20)}")])) == {1: [], 2: [0]}


@pytest.mark.parametrize("share", [(80, 100), (75, 100), (9, 10), (1, 1)])
def test_prefix_length_of_a_column(spark, share):
    got = spark.range(1, 3000).select("id", line_words.prefix_length(F.col("id"), share).alias("k")).collect()
    n = np.array([r["id"] for r in got])
    assert [r["k"] for r in got] == line_words.prefix_lengths(n, share).tolist()


def test_records_hold_all_words(make, prose):
    """Lines, sizes and equal sets, against words_of()."""
    texts = [t for t in ODD if t] + [prose(3, 400).replace(" s", "\n"), "b a\ta\x0bb\n\r\na b", "a b"]
    docs = line_dedup.keyed(make(list(enumerate(texts))).select("doc_id", "text")).withColumnRenamed("__key", "key")
    counts = line_words.word_counts(docs)
    assert sum(counts) == sum(len(line_words.words_of(t.encode())[0]) for t in texts)
    want = {}
    for i, t in enumerate(texts):
        for k, w in zip(*line_words.words_of(t.encode()), strict=True):
            want.setdefault((i, int(k)), set()).add(int(w))
    got = {(r["doc_id"], r["line"]): r for r in line_words.line_records(docs, counts, (80, 100)).collect()}
    assert {k: r["n"] for k, r in got.items()} == {k: len(v) for k, v in want.items()}
    assert len({r["cls"] for r in got.values()}) == len({frozenset(v) for v in want.values()})
    same = {}
    for k, r in got.items():
        same.setdefault(r["cls"], set()).add(frozenset(want[k]))
    assert all(len(v) == 1 for v in same.values())


def test_prefixes_are_rows_of_neighbouring_tokens(make, prose):
    """Tokens without nulls, which are sorted as longs; pairs made as rows, as many as the bound says."""
    docs = line_dedup.keyed(make([(k, prose(60 + k, n)) for k, n in enumerate((1, 2, 9, 40, 300))]).select("doc_id", "text")).withColumnRenamed("__key", "key")
    records = line_words.line_records(docs, line_words.word_counts(docs), (80, 100))
    assert not records.schema["prefix"].dataType.containsNull
    rows = {r["doc_id"]: r for r in records.collect()}
    want = {i: int(line_words.prefix_lengths(np.array([r["n"]]), (80, 100))[0]) for i, r in rows.items()}
    assert {i: len(r["prefix"]) for i, r in rows.items()} == {i: k + 1 if k else 0 for i, k in want.items()}
    assert all(list(r["prefix"]) == sorted(r["prefix"]) for r in rows.values())
    places = {}
    for r in line_words.prefix_pairs(records, "doc_id").collect():
        places.setdefault(r["doc_id"], []).append(r["place"])
    assert {i: sorted(p) for i, p in places.items()} == {i: [*range(k)] for i, k in want.items() if k}


def test_only_wanted_texts_are_shuffled(spark):
    """Verification reads all texts and passes on those that hold a wanted line, and few others."""
    wanted, all_ = (spark.range(n).select(F.xxhash64("id").alias("key")) for n in (5000, 100_000))
    holds = line_dedup._among(wanted)
    assert wanted.filter(holds(F.col("key"))).count() == 5000
    assert all_.filter(holds(F.col("key"))).count() < 5500
    assert all_.filter(line_dedup._among(wanted.limit(0))(F.col("key"))).count() == 0
