"""Mixing sources to target weights [native]: Sainte-Lague apportionment.

Targets: weights share a budget of words; a target stops at a number of passes over its source,
and what is left over is shared again by weight (water filling, in closed form from one sort).
Quotas: equal blocks of words go to the sources by highest quotients target / (2 seats + 1), then
from each source to its buckets and from each bucket to its shards by the same rule, so that no
step handles more than a bounded group. Selection: within a shard documents follow in seeded
order; the shard's blocks are taken from the front, whole passes first.

The highest quotients are found without listing all blocks: a divisor a little too large gives
every item the seats it certainly has, one a little too small bounds what it can still get, and
only the few quotients between are ranked.

Cases: a null text has size 0 and takes 0; the null source is a source of its own, last in order;
empty sources get a target of 0; an empty table gives an empty mix; rows that share a doc_id are
mixed each; columns of the input besides doc_id, source and the size do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.llm.common import SPACES, saved, text_of, words

#: Words of a block, of a shard (about), and buckets of a source.
BLOCK, SHARD, BUCKETS = 32, 100_000, 1024


def targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), budget: float = 1.5, passes: int = 2) -> DataFrame:
    """(source, source_size) -> with weight and target. A row for each source meets in one task."""
    every = W.partitionBy(F.lit(0))
    place = F.row_number().over(every.orderBy(F.col("source").asc_nulls_last()))
    cycle = F.array(*[F.lit(w) for w in weights])
    df = sources.withColumn("weight", F.get(cycle, (place - 1) % len(weights)).cast("long"))
    cap = F.col("source_size") * passes
    upto = every.orderBy(F.col("ratio"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    df = df.withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("weight"))
    below_cap = F.coalesce(F.sum("cap").over(upto), F.lit(0).cast("long"))
    weight_left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(upto), F.lit(0).cast("long"))
    # The level if exactly the sources before this one are full. It rises while a source lies below
    # the level and falls once none does, so its largest value is the level that leaves none above.
    level = (F.sum("source_size").over(every) * F.lit(budget) - below_cap) / weight_left
    df = df.withColumn("level", level).withColumn("level", F.max("level").over(every))
    return df.select("source", "source_size", "weight", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def sainte_lague(items: DataFrame, group: list[str], order: list[str], weight: str, seats: str, out: str) -> DataFrame:
    """items with their seats by highest quotients. seats: the group's number, on each row; ties go
    to the first in order. Items of weight 0 get none."""
    whole = W.partitionBy(*group) if group else W.partitionBy(F.lit(0))
    half = F.sum(F.when(F.col(weight) > 0, 1).otherwise(0)).over(whole) / 2.0
    total = F.sum(F.col(weight)).over(whole)
    df = items.withColumns({"__half": half, "__total": total.cast("double")})
    seats_at = lambda divisor: F.floor(F.col(weight) / divisor + 0.5).cast("long")
    least = F.when((F.col(seats) > F.col("__half")) & (F.col(weight) > 0), F.greatest(F.lit(0).cast("long"), seats_at(F.col("__total") / (F.col(seats) - F.col("__half"))) - 1)).otherwise(F.lit(0).cast("long"))
    most = F.when((F.col(weight) > 0) & (F.col(seats) > 0), seats_at(F.col("__total") / (F.col(seats) + F.col("__half"))) + 1).otherwise(F.lit(0).cast("long"))
    df = df.withColumns({"__least": least, "__most": most})
    df = df.withColumn("__left", F.col(seats) - F.sum("__least").over(whole))
    open_ = df.withColumn("__j", F.explode(F.sequence("__least", F.greatest("__least", "__most"))))
    quotient = F.when(F.col("__j") < F.greatest("__least", "__most"), F.col(weight) / (2 * F.col("__j") + 1))
    ranked = open_.withColumn("__q", quotient).withColumn("__rank", F.row_number().over(whole.orderBy(F.col("__q").desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in order])))
    won = F.col("__q").isNotNull() & (F.col("__rank") <= F.col("__left"))
    keys = items.columns
    # every item has its last row of the sequence, whose quotient is null: one row an item remains
    wins = F.sum(F.when(won, 1).otherwise(0)).over(W.partitionBy(*group, *order))
    return ranked.withColumn(out, (F.col("__least") + wins).cast("long")).filter(F.col("__q").isNull()).select(*keys, out)


def _dice(seed: int, of: int, length: int = 8) -> Column:
    """A number below 16^length from the id and the seed, the same in any engine that has md5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, of, length), 16, 10).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"))


def _dealt(docs: DataFrame, goals: DataFrame, seed: int) -> DataFrame:
    """docs (with doc_id and source) with their bucket, shard and place in it. goals has a row for each source."""
    goal = goals.select(F.col("source").alias("__source"), "source_size", "target", "source_blocks", F.greatest("buckets", F.lit(1)).alias("buckets"), F.greatest("shards", F.lit(1)).alias("shards"))
    dealt = docs.join(goal, F.col("source").eqNullSafe(F.col("__source")))
    return dealt.withColumns({"__bucket": _dice(seed, 1) % F.col("buckets"), "__shard": _dice(seed, 9) % F.col("shards"), "__dice": _dice(seed, 17)})


def _same_shard() -> Column:
    return F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__bucket") == F.col("__b")) & (F.col("__shard") == F.col("__h"))


def _placed(sizes: DataFrame, weights, budget, passes, block, shard, seed) -> tuple[DataFrame, DataFrame]:
    """sizes with start (words before it in its shard), whole (passes over the shard) and rest
    (words taken beyond them); and the goals of the sources."""
    sizes = saved(sizes.select("doc_id", "source", "size"), "sizes")
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = targets(by_source, weights, budget, passes)
    total = F.floor(F.sum("target").over(W.partitionBy(F.lit(0))) / block + 0.5).cast("long")
    goals = sainte_lague(goals.withColumn("all_blocks", total), [], ["source"], "target", "all_blocks", "source_blocks")
    goals = saved(goals.withColumns({"shards": F.ceil(F.col("source_size") / F.lit(shard * BUCKETS)).cast("long"), "buckets": F.least(F.lit(BUCKETS).cast("long"), F.ceil(F.col("source_size") / F.lit(shard)).cast("long"))}), "goals")

    dealt = _dealt(sizes, goals, seed)
    shards = dealt.groupBy("__source", "__bucket", "__shard", "source_blocks").agg(F.sum("size").alias("shard_size"))
    buckets = shards.groupBy("__source", "__bucket", "source_blocks").agg(F.sum("shard_size").alias("bucket_size"))
    buckets = sainte_lague(buckets, ["__source"], ["__bucket"], "bucket_size", "source_blocks", "bucket_blocks")
    buckets = buckets.select(F.col("__source").alias("__s"), F.col("__bucket").alias("__b"), "bucket_blocks")
    shards = shards.drop("source_blocks").join(buckets, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__bucket") == F.col("__b"))).drop("__s", "__b")
    shards = sainte_lague(shards, ["__source", "__bucket"], ["__shard"], "shard_size", "bucket_blocks", "blocks")
    quotas = saved(shards.select(F.col("__source").alias("__s"), F.col("__bucket").alias("__b"), F.col("__shard").alias("__h"), "shard_size", "blocks"), "quotas")

    at = W.partitionBy("__source", "__bucket", "__shard").orderBy("__dice", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = dealt.withColumn("start", F.coalesce(F.sum("size").over(at), F.lit(0).cast("long"))).join(quotas, _same_shard())
    quota = F.least(F.col("blocks") * block, F.col("shard_size") * passes)
    placed = placed.withColumn("whole", F.when(F.col("shard_size") > 0, F.floor(quota / F.col("shard_size"))).otherwise(F.lit(0)).cast("long"))
    return placed.withColumn("rest", quota - F.col("whole") * F.col("shard_size")), goals


def mix(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), budget: float = 1.5, passes: int = 2, block: int = BLOCK, shard: int = SHARD, seed: int = 1) -> DataFrame:
    """(doc_id, source, size) -> doc_id, source, size, source_size, target, blocks (of its shard), taken."""
    placed, _ = _placed(sizes, weights, budget, passes, block, shard, seed)
    taken = F.col("whole") * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("rest") - F.col("start")))
    return placed.select("doc_id", "source", "size", "source_size", "target", "blocks", taken.cast("long").alias("taken"))


def repeat(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), budget: float = 1.5, passes: int = 2, block: int = BLOCK, shard: int = SHARD, seed: int = 1) -> DataFrame:
    """docs as often as the mix takes them, to the nearest whole time; those without words go.

    A shard's rest ends at one place in its seeded order, so a table with a row for each shard (one
    for about ``shard`` words) tells every document its number; texts need not move for it."""
    placed, goals = _placed(sized(docs), weights, budget, passes, block, shard, seed)
    once_more = (F.col("size") > 0) & (2 * F.col("start") + F.col("size") <= 2 * F.col("rest"))
    cuts = placed.groupBy("__source", "__bucket", "__shard").agg(F.max("whole").alias("whole"), F.max(F.when(once_more, F.struct("__dice", "doc_id"))).alias("cut"))
    cuts = saved(cuts.select(F.col("__source").alias("__s"), F.col("__bucket").alias("__b"), F.col("__shard").alias("__h"), F.col("whole").alias("__whole"), F.col("cut").alias("__cut")), "cuts")
    own = docs.filter(F.btrim(text_of(F.col("text")), F.lit(SPACES)) != "").select(F.struct(*docs.columns).alias("__row"), "doc_id", "source")
    df = _dealt(own, goals, seed).join(cuts, _same_shard())
    more = F.coalesce(F.struct("__dice", "doc_id") <= F.col("__cut"), F.lit(False))
    df = df.withColumn("__times", (F.col("__whole") + more.cast("long")).cast("int")).filter("__times > 0")
    return df.withColumn("__time", F.explode(F.sequence(F.lit(1), F.col("__times")))).select("__row.*")
