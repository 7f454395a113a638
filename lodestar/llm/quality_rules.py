"""Quality rules [native]: learned decision lists over text statistics.

Statistics of each text are counted by built-in expressions in one pass, without a shuffle.
A decision list for the reject class is learned by sequential covering: a conjunction of
thresholds grows by FOIL gain on two thirds of the labelled rows, is pruned on the other third,
and stays if it is precise enough there; the rows that it covers leave and the next rule is
sought. The list becomes one ordered CASE expression.

Learning sees a bounded sample: the labelled rows of least hash, at most ``max_labelled`` of them;
rows of one id and different texts count each, repeated rows once.

Cases: a null or empty text has no words, all counts 0, and is rejected by the base rule; null
labels, null texts and labels without a document are not learned from; a doc_id labelled twice has
its lowest label; no labels at all give an empty list, which keeps what the base rule keeps;
further columns pass through untouched, and statistics named like one of them replace it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import SPACES, let, text_of, words
from lodestar.llm.sampling import picked_rows, with_rows

#: Characters that count as symbols, as a class of a regular expression (fixed value).
SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(w: Column) -> Column:
    """Words in windows of three that occur twice or more in the text, the first one included.

    Windows are hashed; a sort of (hash, place) packed into one long brings equal ones together.
    Packing drops bits of the hash; where that makes different hashes equal, structs are sorted.
    The places of repeated windows, sorted, give the covered words: each adds three, less what
    the next one covers as well. Most texts stop at the count of distinct windows.
    """
    windows = F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.xxhash64(F.slice(w, i, F.lit(3))))

    def covered(h: Column) -> Column:
        bits = F.length(F.bin(F.size(h).cast("long")))
        short = F.transform(h, lambda x: F.call_function("shiftleft", x, bits))
        packed = F.sort_array(F.transform(h, lambda x, i: F.call_function("shiftleft", x, bits).bitwiseOR(i.cast("long"))))
        whole = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("hash"), i.cast("long").alias("place"))))
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1

        def places(p: Column, of, place) -> Column:
            key = lambda at: of(F.get(p, at))
            hit = F.filter(
                F.sequence(F.lit(0), F.size(p) - 1),
                lambda at: ((at > 0) & (key(at - 1) == key(at))) | ((at < F.size(p) - 1) & F.coalesce(key(at + 1) == key(at), F.lit(False))),
            )
            return F.sort_array(F.transform(hit, lambda at: place(F.get(p, at))))

        by_short = let(packed, lambda p: places(p, lambda x: F.call_function("shiftright", x, bits), lambda x: x.bitwiseAND(mask)))
        by_whole = let(whole, lambda p: places(p, lambda x: x["hash"], lambda x: x["place"]))
        found = F.when(F.size(F.array_distinct(short)) == F.size(F.array_distinct(h)), by_short).otherwise(by_whole)

        def span(s: Column) -> Column:
            gaps = F.transform(s, lambda x, i: F.least(F.lit(3).cast("long"), F.coalesce(F.get(s, i + 1) - x, F.lit(3).cast("long"))))
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

        return let(found, span)

    zero = F.lit(0).cast("long")
    return F.when(F.size(w) < 4, zero).otherwise(let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), zero).otherwise(covered(h))))


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the counts of COUNTS and n_lines, n_upper, n_distinct (all long).

    The counts leave through a generator of one row. A filter on them stays above it; pushed below,
    it would have every count worked out again for every place that names one."""
    t = text_of(F.col(text))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    made = {
        "n_words": lambda w, l: F.size(w),
        "word_chars": lambda w, l: F.length(F.array_join(w, "")),
        "n_symbols": lambda w, l: F.length(F.regexp_replace(t, f"[^{SYMBOLS}]+", "")),
        "n_dup_lines": lambda w, l: F.size(l) - F.size(F.array_distinct(l)),
        "n_repeat_words": lambda w, l: repeated_words(w),
        "n_lines": lambda w, l: F.size(l),
        "n_upper": lambda w, l: F.length(F.regexp_replace(t, "[^A-Z!]+", "")),
        "n_distinct": lambda w, l: F.size(F.array_distinct(w)),
    }
    count = lambda w: F.struct(*[f(w, F.col("__l")).cast("long").alias(c) for c, f in made.items()])
    held = docs.withColumns({"__w": words(F.col(text)), "__l": lines})
    held = held.select(*[F.col(c) for c in docs.columns if c not in made], F.explode(F.transform(F.array("__w"), count)).alias("__s"))
    return held.withColumns({c: F.col(f"__s.{c}") for c in made}).drop("__s")


def features() -> dict[str, Column]:
    """What rules may test: counts, and shares in thousandths (whole numbers, so a threshold means
    the same in training and in the expression)."""

    def share(a: str, b: str) -> Column:
        return F.floor(F.col(a) * 1000 / F.greatest(F.col(b), F.lit(1))).cast("long")

    return {
        "n_words": F.col("n_words"),
        "symbol_share": share("n_symbols", "word_chars"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "upper_share": share("n_upper", "word_chars"),
        "distinct_share": share("n_distinct", "n_words"),
        "word_length": share("word_chars", "n_words"),
    }


@dataclass(frozen=True)
class Rule:
    """All conditions (feature, '<=' or '>', threshold) hold: reject."""

    conditions: tuple[tuple[str, str, int], ...]
    covered: int = 0
    precision: float = 0.0

    def __str__(self) -> str:
        return " and ".join(f"{f} {op} {t}" for f, op, t in self.conditions)


@dataclass
class DecisionList:
    rules: list[Rule] = field(default_factory=list)

    def rejects(self) -> Column:
        """Number (from 1) of the first rule that fires; null if none does: an ordered CASE."""
        made, out = features(), None
        for k, rule in enumerate(self.rules, start=1):
            hit = F.lit(True)
            for f, op, t in rule.conditions:
                hit = hit & (made[f] <= t if op == "<=" else made[f] > t)
            out = F.when(hit, F.lit(k)) if out is None else out.when(hit, F.lit(k))
        return F.lit(None).cast("int") if out is None else out


def _holds(x: np.ndarray, names: list[str], conditions) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, op, t in conditions:
        v = x[:, names.index(f)]
        out &= v <= t if op == "<=" else v > t
    return out


def learn(x: np.ndarray, bad: np.ndarray, grow: np.ndarray, names: list[str], max_rules: int = 12, max_conditions: int = 4, cuts: int = 64, precision: float = 0.9) -> DecisionList:
    """Sequential covering. x: rows by features; bad: the class to cover; grow: rows to grow on,
    the others prune. A rule stays if, on the pruning rows, it covers two bad rows or more and at
    least ``precision`` of what it covers is bad."""
    thresholds = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, cuts + 1), method="lower")) if len(x) else np.array([], int) for j in range(len(names))]
    left, rules = np.ones(len(x), bool), []
    while len(rules) < max_rules:
        g = left & grow
        conditions: list[tuple[str, str, int]] = []
        at = g.copy()
        while len(conditions) < max_conditions and (at & bad).any() and (at & ~bad).any():
            p0, n0 = (at & bad).sum(), (at & ~bad).sum()
            base, best = np.log2(p0 / (p0 + n0)), (1e-9, None)
            for j, name in enumerate(names):
                v, b = x[at, j], bad[at]
                for t in thresholds[j]:
                    low = v <= t
                    p, n = (low & b).sum(), (low & ~b).sum()
                    for op, pp, nn in (("<=", p, n), (">", p0 - p, n0 - n)):
                        if pp and (gain := pp * (np.log2(pp / (pp + nn)) - base)) > best[0]:
                            best = (gain, (name, op, int(t)))
            if best[1] is None:
                break
            conditions.append(best[1])
            at &= _holds(x, names, [best[1]])
        if not conditions:
            break

        def worth(cs):
            hit = _holds(x, names, cs) & left & ~grow
            p, n = (hit & bad).sum(), (hit & ~bad).sum()
            return ((p - n) / (p + n) if p + n else -1.0), p, n

        kept = max((conditions[:k] for k in range(len(conditions), 0, -1)), key=lambda cs: worth(cs)[0])
        score, p, n = worth(kept)
        if p < 2 or p / (p + n) < precision:
            break
        rules.append(Rule(tuple(kept), int(p), float(p / (p + n))))
        left &= ~_holds(x, names, kept)
    return DecisionList(rules)


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, label: str = "quality", **options) -> DecisionList:
    """A decision list from the labelled documents; see the module for the bound on the sample."""
    picked = picked_rows(docs, F.col(label).cast("int"), max_labelled, labels)
    base = with_rows(docs, picked, F.col("text"))
    made = features()
    rows = statistics(base).select("__label", (F.xxhash64(F.col("__key"), F.lit(7)) % 3 == 0).alias("__prune"), *[c.alias(f) for f, c in made.items()], "__key").collect()
    rows = [r[:-1] for r in sorted(rows, key=lambda r: r[-1])]
    x = np.array([r[2:] for r in rows], np.int64).reshape(len(rows), len(made))
    bad = np.array([r[0] == 0 for r in rows], bool)
    grow = ~np.array([r[1] for r in rows], bool)
    return learn(x, bad, grow, list(made), **options)


def base_failed() -> Column:
    """Too short, or more than half of the words in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """docs with statistics, base_failed, the rule that rejected (or null) and kept."""
    return (
        statistics(docs)
        .withColumns({"base_failed": base_failed(), "rule": rules.rejects()})
        .withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
    )
