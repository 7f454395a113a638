import random
import re
from itertools import combinations

import numpy as np
import pytest

from lodestar.llm import ngram_join
from lodestar.llm.components import connected_components
from lodestar.llm.shingles import shingle_set
from lodestar.llm.tooccurrence import connect, divide_skip, merge_skip
from tests.llm.conftest import ODD


def plain_set(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(rows, num=80, den=100):
    sets = {i: plain_set(t) for i, t in rows}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and den * len(x & y) >= num * len(x | y):
            p, q = sorted((find(a), find(b)))
            up[q] = p
    return {i: (len(sets[i]), find(i)) for i in sets}


def edited(text, dice, edits):
    w = text.split()
    for _ in range(edits):
        w[dice.randrange(len(w))] = f"new{dice.randrange(10**6)}"
    return " ".join(w)


def got(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


@pytest.mark.parametrize("text", ODD, ids=range(len(ODD)))
def test_sets_have_the_right_size(text):
    assert len(shingle_set(text)) == len(plain_set(text))


def test_sets_of_long_texts_do_not_depend_on_pieces(prose):
    text = prose(1, 300_000)  # several pieces
    half = text[: len(text) // 2]
    assert len(text) > 1 << 20 and len(shingle_set(text)) == len(plain_set(text))
    assert np.isin(shingle_set(half.rsplit(" ", 1)[0]), shingle_set(text)).all()
    assert (shingle_set("A b\tC\nd  E f") == shingle_set("a B c D e F")).all()


def test_components_equal_brute_force(make, prose):
    dice = random.Random(4)
    base = [prose(k, 60 + 7 * k) for k in range(12)]
    texts = [b for b in base for _ in range(2)] + [edited(dice.choice(base), dice, dice.randrange(1, 6)) for _ in range(150)]
    texts += ODD[:8] + ["", None, "one", "ONE", "one two three four five", "One two three four five"]
    texts += [base[0] + " " + base[1], " ".join(base[:5]), base[2].upper()]
    dice.shuffle(texts)
    rows = list(enumerate(texts))
    assert got(ngram_join.join(make(rows))) == brute(rows)


@pytest.mark.parametrize("block", [5, 16])
def test_large_neighbourhoods_in_blocks(make, prose, block):
    """Many near copies of one text, some linked and some not, searched in small blocks."""
    dice = random.Random(block)
    base = prose(99, 80)
    rows = list(enumerate([edited(base, dice, dice.choice((0, 1, 1, 2, 3))) for _ in range(120)]))
    dice.shuffle(rows)
    assert got(ngram_join.join(make(rows), block=block)) == brute(rows)


def test_bound_is_exact(make):
    # 20 words have 16 shingles, a changed last word leaves 15 of 17; 9 of 11 against 8 of 10 at 8/10
    w = [f"w{k}" for k in range(14)]
    rows = [(1, " ".join(w[:13])), (2, " ".join(w[:14])), (3, " ".join([*w[:12], "x"])), (4, " ".join(w[:9])), (5, " ".join(w[:8]))]
    assert got(ngram_join.join(make(rows))) == brute(rows)


def test_empty_table_clashing_columns_and_repeats(make, prose):
    text = prose(5, 40)
    assert ngram_join.join(make([])).count() == 0
    rows = [(7, text), (7, text), (3, text + " more"), (None, text), (9, None), (9, "")]
    df = ngram_join.join(make(rows, extra=True))
    assert sorted((r["doc_id"] or -1, r["component_id"]) for r in df.collect()) == [(-1, 3), (3, 3), (7, 3), (7, 3), (9, 9), (9, 9)]
    kept = ngram_join.keep_one(make(rows, extra=True))
    assert kept.columns == make([], extra=True).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 9, 9]


def test_keep_one_takes_rows_not_ids(make, prose):
    """Only linked rows go, whatever else has their id, and one row of each group stays."""
    a, b, c, d, e, f = (prose(20 + k, 40) for k in range(6))
    near = a + " more"
    rows = [(3, a), (9, a), (9, c), (None, a), (None, d), (None, ""), (3, a), (3, near)]  # 3, 9 and null are also ids of other texts
    rows += [(None, b), (None, b), (None, e), (5, e), (5, e), (3, f), (7, f), (9, None)]
    kept = [(r["doc_id"], r["text"]) for r in ngram_join.keep_one(make(rows)).collect()]
    alone = [(9, c), (None, d), (None, ""), (9, None), (3, f), (5, e), (None, b)]
    assert sum(t in (a, near) and i == 3 for i, t in kept) == 1  # the least hash of text decides between rows of the least id
    assert sorted((x for x in kept if x[1] not in (a, near)), key=repr) == sorted(alone, key=repr) and len(kept) == len(alone) + 1


def test_merge_skip_and_divide_skip_equal_counting():
    dice = random.Random(3)
    for _ in range(200):
        lists = [sorted(dice.sample(range(60), dice.randrange(0, 30))) for _ in range(dice.randrange(1, 12))]
        lists = [x for x in lists if x]
        count = {r: sum(r in x for x in lists) for r in range(60)}
        least = dice.randrange(1, 8)
        assert dict(merge_skip(lists, least)) == {r: n for r, n in count.items() if n >= least}
        assert sorted(divide_skip(lists, least, lambda r: least, lambda r: False)) == [r for r, n in count.items() if n >= least]


def test_connect_finds_all_components():
    dice = random.Random(8)
    for _ in range(60):
        base = [dice.sample(range(40), 20) for _ in range(3)]
        sets = [sorted({t if dice.random() > 0.06 else dice.randrange(40, 60) for t in dice.choice(base)}) for _ in range(25)]
        sizes = [len(s) for s in sets]
        links = connect(sizes, sets, list(range(25)), (80, 100))
        up = list(range(25))

        def find(x, up=up):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in links:
            assert 100 * len({*sets[a]} & {*sets[b]}) >= 80 * len({*sets[a]} | {*sets[b]})
            up[find(a)] = find(b)
        for a, b in combinations(range(25), 2):
            if 100 * len({*sets[a]} & {*sets[b]}) >= 80 * len({*sets[a]} | {*sets[b]}):
                assert find(a) == find(b)


def test_connected_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (102, 100), (7, 7), (None, 3), (500, 200), (200, 300)]
    out = {r["node"]: r["label"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {k: 0 for k in range(41)} | {100: 100, 101: 100, 102: 100, 200: 200, 300: 200, 500: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
