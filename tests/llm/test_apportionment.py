import heapq
import random
from collections import defaultdict

import pytest

from lodestar.llm import apportionment as a
from tests.llm.conftest import ODD


def quotients(weights, seats):
    """Seats one by one to the highest quotient; ties to the first."""
    got = [0] * len(weights)
    heap = [(-w, k) for k, w in enumerate(weights) if w > 0]
    heapq.heapify(heap)
    for _ in range(seats if heap else 0):
        _, k = heapq.heappop(heap)
        got[k] += 1
        heapq.heappush(heap, (-weights[k] / (2 * got[k] + 1), k))
    return got


def test_seats_equal_the_plain_method(spark):
    dice = random.Random(5)
    rows, want = [], {}
    for g in range(40):
        weights = [float(dice.choice((0, 1, 1, 3, dice.randrange(1, 1000)))) for _ in range(dice.randrange(1, 9))]
        seats = dice.choice((0, 1, 2, 7, 50, 1001))
        rows += [(g, k, w, seats) for k, w in enumerate(weights)]
        want |= {(g, k): s for k, s in enumerate(quotients(weights, seats))}
    items = spark.createDataFrame(rows, "g int, k int, w double, seats long")
    got = {(r["g"], r["k"]): r["won"] for r in a.sainte_lague(items, ["g"], ["k"], "w", "seats", "won").collect()}
    assert got == want


def plain_targets(sizes):
    """Share by weight; what is above twice a source's size is shared again, until none is."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, full, total = set(names), {}, 1.5 * sum(sizes.values())
    while left:
        rest, by = total - sum(full.values()), sum(weight[s] for s in left)
        over = [s for s in left if rest * weight[s] / by > 2 * sizes[s]]
        if not over:
            return full | {s: rest * weight[s] / by for s in left}
        full |= {s: 2.0 * sizes[s] for s in over}
        left -= set(over)
    return full


@pytest.mark.parametrize("seed", range(3))
def test_targets(spark, seed):
    dice = random.Random(seed)
    sizes = {f"s{k}": dice.choice((0, 5, 100, 100, dice.randrange(1, 50_000))) for k in range(14)} | {None: 77, "é": 12, "Z": 900}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in a.targets(df).collect()}
    assert got == pytest.approx(plain_targets(sizes))


def test_mix_meets_its_targets(make, prose):
    dice = random.Random(9)
    rows = [(i, prose(i, dice.choice((1, 9, 60, 200))), "en", dice.choice(["hot"] * 6 + ["b", "c", "d", None])) for i in range(400)]
    rows += [(900 + k, t, "en", "odd") for k, t in enumerate(ODD)]
    df = make(rows, extra=True)
    out = a.mix(a.sized(df), shard=2000).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(r[0] for r in rows)
    want = {r[0]: len((r[1] or "").encode().split()) for r in rows}
    taken, target, size = defaultdict(int), {}, defaultdict(int)
    for r in out:
        assert r["size"] == want[r["doc_id"]] and 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
        size[r["source"]] += r["size"]
        target[r["source"]] = r["target"]
    assert target == pytest.approx(plain_targets(dict(size)))
    for s in taken:
        assert abs(taken[s] - target[s]) <= max(64, 0.01 * target[s]), s
    again = a.mix(a.sized(df.repartition(3)), shard=2000).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in again) == sorted((r["doc_id"], r["taken"]) for r in out)


def test_empty_tables_nulls_and_repeats(make):
    assert a.mix(a.sized(make([]))).count() == 0
    out = a.mix(a.sized(make([(1, None), (2, "")]))).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in out] == [(0, 0.0, 0)] * 2
    out = a.mix(a.sized(make([(1, "a b c d " * 40)] * 3 + [(None, "x y")]))).collect()
    assert len(out) == 4 and all(r["taken"] <= 2 * r["size"] for r in out)
