"""Line dedup: an exact set-similarity join of lines that removes later matches.

A line's tokens are its distinct words `[^\\x20\\x09-\\x0D]+`, as they are spelled. Two lines match when
share[1] * |x & y| >= share[0] * |x | y|. A line is removed if an earlier line, in the order of
(doc_id, text, place), matches it, whether or not that one is removed itself. Lines without words are
left alone and match nothing.

1. Rarity. All words are counted, and every line's tokens are put in order, rarest first
   (line_words.py). A digest of the set names the line's class. A class stands where its first line
   stands; all its later lines go at once, so copies are one row from here on.
2. Prefix. Two sets that match have many neighbours in common: two words that follow each other in
   both orders, with no word of either line between. So some such pair stands in the prefix of each,
   and it is pairs, not words, that the join is on; a pair of rare words is far rarer than either. A
   pair that one class alone has in its prefix links nothing and is dropped, most classes with it.
3. Join on prefix pairs under the positional filter (the prefix that this length and the other's leave),
   the length filter and a filter by the parity of tokens; verification on whole sets of words. First
   each class meets the earliest class of each of its pairs, which is linear however many share a
   pair; only what no such class removes meets the earlier others, in pairs that more than two have.
   Of pairs that follow each other in both sets only the first brings them together, so a passage that
   two lines have in common is one candidate, not one for each of its words. Lines that share a rare
   passage and do not match therefore meet each other, as far as the filters let them.

All of it is DataFrame operations. Digests are 64 bits wide, tokens 57 bits and how common they are.

Cases: null and empty texts have no lines; a document left without any word that had some is
dropped by apply(); repeated rows (same id, same text) are one document and each keep the same
lines; rows of one id and different texts are different documents; a null id comes first in order;
an empty table gives an empty result; other columns pass through, whatever their names. A share below
three quarters is an error: below it matching sets need not have neighbours in common.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import drop_saved, free_shuffles, let, saved, text_of, words
from lodestar.llm.line_words import line_records, prefix_pairs, word_counts

SHARE = (80, 100)
#: Bits of a place in a prefix; later places count as the last one, which the positional filter lets pass more.
_PLACE_BITS = 12
_LAST = (1 << _PLACE_BITS) - 1
#: Columns that hold hashes, as Parquet names them.
_HASHES = ("cls", "bits", "more", "prefix.list.element", "pair")


def _overlap(n: Column, m: Column, share: tuple[int, int]) -> Column:
    """Tokens that matching sets of n and m have in common, at least."""
    both = share[0] + share[1]
    return F.floor(((n + m) * share[0] + (both - 1)) / both).cast("int")


def keyed(docs: DataFrame) -> DataFrame:
    """docs with __key, which tells rows of one id and different texts apart."""
    return docs.withColumn("__key", F.xxhash64("doc_id", "text"))


def lines_of(docs: DataFrame, share: tuple[int, int] = SHARE) -> DataFrame:
    """LINES of every line with words."""
    if share[0] * 4 < share[1] * 3 or share[0] > share[1]:
        raise ValueError("a share from three quarters to one")
    docs = keyed(docs.select("doc_id", "text")).withColumnRenamed("__key", "key")
    return line_records(docs, word_counts(docs), share)


def _classes(lines: DataFrame) -> DataFrame:
    """(cls, first, n, bits, more, prefix, ord): ord grows with first, the place of the class."""
    own = F.first(F.struct("n", "bits", "more", "prefix")).alias("own")
    out = saved(lines.groupBy("cls").agg(F.min(F.struct("doc_id", "key", "line")).alias("first"), own), "classes", _HASHES)
    drop_saved(lines)
    free_shuffles(lines.sparkSession)
    numbered = out.orderBy("first").select("cls", "first", "own.*", F.monotonically_increasing_id().alias("ord"))
    numbered = saved(numbered, "numbered", _HASHES)
    drop_saved(out)
    free_shuffles(lines.sparkSession)
    return numbered


def _shared(classes: DataFrame) -> DataFrame:
    """(pair, ord, place, other, posts) of the pairs that several classes have: how many have it, and the
    earliest. Place and ord are one number while they are dealt out by pair."""
    at = F.shiftleft("ord", _PLACE_BITS).bitwiseOR(F.least(F.col("place"), F.lit(_LAST)).cast("long"))
    posts = prefix_pairs(classes, "ord").select("pair", at.alias("at"))
    same = Window.partitionBy("pair")
    posts = posts.select("pair", "at", F.min("at").over(same).alias("low"), F.count("*").over(same).alias("posts")).filter("posts > 1")
    place = F.col("at").bitwiseAND(F.lit(_LAST).cast("long")).cast("int")
    return posts.select("pair", F.shiftright("at", _PLACE_BITS).alias("ord"), place.alias("place"), F.shiftright("low", _PLACE_BITS).alias("other"), "posts")


def _may_match(share: tuple[int, int], fine: bool = False) -> Column:
    """The length filter and the parity filter, on columns of one class and, marked e_, of another.

    Behind each bit in which the parities differ stands a token that only one set has. 64 bits tell by
    tokens' last six bits, 128 (fine) by the last seven."""
    n, m = F.col("n"), F.col("e_n")
    length = (F.least(n, m) * share[1]) >= (F.greatest(n, m) * share[0])
    differ = F.col("bits").bitwiseXOR(F.col("e_bits"))
    apart = F.bit_count(differ)
    if fine:
        upper = F.col("more").bitwiseXOR(F.col("e_more"))
        apart = F.bit_count(upper) + F.bit_count(differ.bitwiseXOR(upper))
    return length & (apart <= n + m - 2 * _overlap(n, m, share))


def _in_prefix(share: tuple[int, int]) -> Column:
    """The positional filter: the pair stands within the prefixes that the two sizes leave."""
    n, m = F.col("n"), F.col("e_n")
    overlap = _overlap(n, m, share)
    return (F.col("place") <= 2 * (n - overlap) + m - overlap) & (F.col("e_place") <= 2 * (m - overlap) + n - overlap)


def _among(keys: DataFrame) -> Callable[[Column], Column]:
    """A test that all keys (a column of 64-bit hashes) pass and most others fail, as long as there are
    fewer than its four million bits; with more it only lets more pass."""
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("key").bitwiseAND(63).cast("int"))
    at = lambda key: F.shiftrightunsigned(key, 48).cast("int")
    bits = [0] * (1 << 16)
    for r in keys.groupBy(at(F.col("key")).alias("at")).agg(F.bit_or(one).alias("bits")).collect():  # at most 65536 rows
        bits[r["at"]] = r["bits"]
    table = F.split(F.lit(",".join(map(str, bits))), ",").cast("array<bigint>")  # one constant
    return lambda key: F.call_function("bit_get", F.get(table, at(key)), key.bitwiseAND(63).cast("int")) == 1


def _verified(docs: DataFrame, classes: DataFrame, tries: DataFrame, share: tuple[int, int]) -> DataFrame:
    """(ord, other) that match, of the candidates: one other for each ord."""
    pairs = saved(tries.distinct(), "pairs")
    free_shuffles(docs.sparkSession)
    wanted = pairs.select("ord").union(pairs.select("other")).distinct().join(classes.select(F.col("ord").alias("c"), "first"), F.col("ord") == F.col("c"))
    wanted = wanted.groupBy(F.col("first.doc_id").alias("__d"), F.col("first.key").alias("__k")).agg(F.collect_list(F.struct("ord", F.col("first.line").alias("line"))).alias("wanted"))
    wanted = saved(wanted, "wanted")
    free_shuffles(docs.sparkSession)
    holds = _among(wanted.select(F.col("__k").alias("key")))  # so that few other texts are shuffled
    df = keyed(docs.select("doc_id", "text")).filter(holds(F.col("__key"))).join(wanted, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__key") == F.col("__k")))
    picked = let(F.split(text_of(F.col("text")), "\n"), lambda l: F.transform("wanted", lambda w: F.struct(w["ord"].alias("ord"), F.get(l, w["line"]).alias("t"))))
    df = df.select(F.explode(picked).alias("p")).select("p.ord", F.array_distinct(F.transform(words(F.col("p.t")), lambda w: F.xxhash64(w))).alias("tokens"))
    sets = saved(df.dropDuplicates(["ord"]), "sets")  # repeated rows of a document give a class again
    free_shuffles(docs.sparkSession)
    own, other = sets.select(F.col("ord").alias("c1"), F.col("tokens").alias("t1")), sets.select(F.col("ord").alias("c2"), F.col("tokens").alias("t2"))
    df = pairs.join(own, F.col("ord") == F.col("c1")).join(other, F.col("other") == F.col("c2"))
    both = share[0] + share[1]
    df = df.filter(F.size(F.array_intersect("t1", "t2")) * both >= (F.size("t1") + F.size("t2")) * share[0])
    out = saved(df.groupBy("ord").agg(F.min("other").alias("other")), "verified")
    drop_saved(pairs, wanted, sets)
    free_shuffles(docs.sparkSession)
    return out


def later_matches(docs: DataFrame, lines: DataFrame, share: tuple[int, int] = SHARE) -> tuple[DataFrame, DataFrame]:
    """All classes, and (ord, other): classes whose first line matches an earlier one, and one that it
    matches. The lines are dropped once their pairs have been dealt out."""
    spark = docs.sparkSession
    classes = _classes(lines)
    shared = saved(_shared(classes), "shared", _HASHES)
    free_shuffles(spark)

    own = classes.select(F.col("ord").alias("c"), "n", "bits", "more")
    earlier = classes.select(F.col("ord").alias("e_ord"), F.col("n").alias("e_n"), F.col("bits").alias("e_bits"), F.col("more").alias("e_more"))
    tries = shared.filter(F.col("other") < F.col("ord")).select("ord", "other").distinct()
    tries = tries.join(own, F.col("ord") == F.col("c")).join(earlier, (F.col("other") == F.col("e_ord")) & _may_match(share, fine=True))
    done = _verified(docs, classes, tries.select("ord", "other"), share)

    # The earliest class of a pair has met all others of it. Of what is left a post knows the pair before
    # it (prev): two classes with the same one have met there, or where that run of pairs begins.
    same = F.col("pair") == F.col("e_pair")
    state = own.join(done.select(F.col("ord").alias("d")), F.col("c") == F.col("d"), "left")
    left = shared.filter((F.col("posts") > 2) & (F.col("other") != F.col("ord"))).select("pair", "ord", "place")
    left = left.withColumn("prev", F.lag("pair").over(Window.partitionBy("ord").orderBy("place", "pair")))
    left = left.join(state, F.col("ord") == F.col("c")).withColumn("open", F.col("d").isNull()).drop("c", "d")
    marked = saved(left, "marked", _HASHES)
    drop_saved(shared)
    free_shuffles(spark)
    others = marked.select(*[F.col(c).alias(f"e_{c}") for c in ("pair", "ord", "n", "bits", "more", "place", "prev")])
    new = F.col("prev").isNull() | F.col("e_prev").isNull() | (F.col("prev") != F.col("e_prev"))
    met = same & (F.col("e_ord") < F.col("ord")) & new & _may_match(share, fine=True) & _in_prefix(share)
    tries = marked.filter("open").join(others, met)
    more = _verified(docs, classes, tries.select("ord", F.col("e_ord").alias("other")), share)
    drop_saved(marked)
    return classes, done.union(more)


def removals(docs: DataFrame, share: tuple[int, int] = SHARE) -> DataFrame:
    """(doc_id, key, n_lines, removed): of each document with words the number of its lines with
    words, and the numbers (from 0, blank lines count) of those that go."""
    records = saved(lines_of(docs, share), "records", _HASHES)
    lines = saved(records.select("doc_id", "key", "line", "cls"), "lines")
    classes, matched = later_matches(docs, records, share)
    gone = classes.join(matched.select(F.col("ord").alias("m")), F.col("ord") == F.col("m"), "left")
    gone = saved(gone.select(F.col("cls").alias("c"), "first", F.col("m").isNotNull().alias("gone")), "verdicts")
    drop_saved(classes)
    free_shuffles(docs.sparkSession)
    own = F.struct("doc_id", "key", "line")
    judged = lines.select("doc_id", "key", "line", "cls").join(gone, F.col("cls") == F.col("c"))
    judged = judged.withColumn("out", F.col("gone") | ~own.eqNullSafe(F.col("first")))
    out = judged.groupBy("doc_id", "key").agg(F.size(F.collect_set("line")).cast("long").alias("n_lines"), F.sort_array(F.collect_set(F.when(F.col("out"), F.col("line")))).alias("removed"))
    out = saved(out, "removals")
    drop_saved(lines, gone)
    free_shuffles(docs.sparkSession)
    return out


def apply(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """docs without the removed lines and without documents that lost all their words; n_chars, if
    there is such a column, is counted anew."""
    columns = docs.columns
    some = removed.filter(F.size("removed") > 0).select(F.col("doc_id").alias("__d"), F.col("key").alias("__k"), F.col("n_lines").alias("__n"), F.col("removed").alias("__r"))
    df = keyed(docs).join(some, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__key") == F.col("__k")), "left")
    df = df.filter(F.col("__r").isNull() | (F.size("__r") < F.col("__n")))
    left = let(F.split("text", "\n"), lambda l: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(l) - 1), F.col("__r")), lambda i: F.get(l, i)), "\n"))
    df = df.withColumn("text", F.when(F.col("__r").isNull(), F.col("text")).otherwise(left))
    if "n_chars" in columns:
        df = df.withColumn("n_chars", F.when(F.col("__r").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return df.select(*columns)


def dedup(docs: DataFrame, share: tuple[int, int] = SHARE) -> DataFrame:
    return apply(docs, removals(docs, share))
