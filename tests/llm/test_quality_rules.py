import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import quality_rules as q
from tests.llm.conftest import ODD


def plain(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len({*lines}), len(covered)


TEXTS = [*ODD, "a b c a b c", "a a a a a", "a b c d a b c e b c d", "x\nx\n x\n\ny", "a | b # $1% <i>", "a b\ta b\na b a", "A a A a A a"]


def test_counts_equal_brute_force(make):
    rows = list(enumerate(TEXTS))
    got = {r["doc_id"]: tuple(r[c] for c in q.COUNTS) for r in q.statistics(make(rows, extra=True)).collect()}
    for i, t in rows:
        assert got[i] == plain(t), i


def test_windows_are_told_apart_by_whole_hashes(make, monkeypatch):
    """Hashes that differ in their highest bits only, which packing drops."""
    monkeypatch.setattr(F, "xxhash64", lambda w: F.call_function("shiftleft", F.element_at(w, 1).cast("long"), F.lit(60)))
    text = "1 2 3 4 5 6 7 1 2 3"
    assert q.statistics(make([(1, text)])).first()["n_repeat_words"] == plain(text)[-1] == 6


def test_base_rule(make, prose):
    words = prose(1, 60).split()
    rows = [(1, " ".join(words[:49])), (2, " ".join(words[:50])), (3, " ".join(words[:25] * 2)), (4, None)]
    out = {r["doc_id"]: r for r in q.judge(make(rows), q.DecisionList()).collect()}
    assert [out[k]["base_failed"] for k in (1, 2, 3, 4)] == [True, False, True, True]
    assert [out[k]["kept"] for k in (1, 2, 3, 4)] == [False, True, False, False]


def test_covering_finds_a_planted_conjunction():
    dice = np.random.default_rng(1)
    x = dice.integers(0, 1000, (3000, 3))
    bad = (x[:, 0] > 700) & (x[:, 2] <= 300)
    rules = q.learn(x, bad, dice.random(3000) < 2 / 3, ["a", "b", "c"])
    hit = np.zeros(3000, bool)
    for r in rules.rules:
        hit |= q._holds(x, ["a", "b", "c"], r.conditions)
    assert (hit & bad).sum() > 0.9 * bad.sum() and (hit & ~bad).sum() < 0.02 * (~bad).sum()


def test_noise_gives_no_rules():
    dice = np.random.default_rng(2)
    x = dice.integers(0, 1000, (2000, 3))
    bad = dice.random(2000) < 0.15
    assert not q.learn(x, bad, dice.random(2000) < 2 / 3, ["a", "b", "c"]).rules
    assert not q.learn(x[:0], bad[:0], bad[:0], ["a", "b", "c"]).rules


def test_list_is_one_ordered_expression(make, prose):
    rules = q.DecisionList([q.Rule((("symbol_share", ">", 100),)), q.Rule((("n_words", "<=", 70), ("symbol_share", ">", 10)))])
    rows = [(1, "### " * 40 + prose(3, 60)), (2, "# " + prose(4, 60)), (3, prose(5, 90))]
    got = {r["doc_id"]: r["rule"] for r in q.judge(make(rows), rules).collect()}
    assert got == {1: 1, 2: None, 3: None}
    assert "symbol_share > 100" in str(rules.rules[0])


def test_no_labels_repeated_labels_and_empty_tables(spark, make, prose):
    docs = make([(1, prose(1, 80)), (2, None)])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert q.fit(docs, none).rules == []
    some = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, None, 0), (None, 0, 0), (9, 0, 0)], none.schema)
    assert q.fit(docs, some).rules == []
    assert q.judge(make([]), q.DecisionList()).count() == 0


@pytest.mark.parametrize("sf", ["sf0.1"])
def test_labelled_junk_goes_and_good_documents_stay(spark, data, sf):
    docs, labels = (spark.read.parquet(f"{data}/{sf}/{t}.parquet") for t in ("documents", "labels"))
    out = q.judge(docs, q.fit(docs, labels)).filter(~F.col("base_failed")).join(labels, "doc_id")
    r = out.agg(F.avg(F.when(F.col("quality") == 1, F.col("kept").cast("int"))).alias("good"), F.avg(F.when(F.col("quality") == 0, F.col("kept").cast("int"))).alias("junk")).first()
    assert r["good"] > 0.99 and r["junk"] < 0.05
