"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame operations only.

Target words go to sources as equal blocks, by highest quotient target / (2 * blocks had + 1), with as many blocks in each shard of the
mix: whole quotas for each shard and source. A source's documents, shuffled by a seeded hash, form a line of words that is cut in blocks of that
size. A seeded permutation of the blocks, (prime * block + start) modulo their number, is the order in which shards select: each takes the next
blocks of its quota, so that no block is taken a second time before all are taken once, and none a third time.

Defined cases: null text has no words. A null source is the last source. Documents without words take nothing. An empty table gives an
empty result. Rows with equal ids are placed each by a checksum of its text; rows that are equal in both stand next to each
other, in the order of a checksum of the carried columns. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._scratch import Scratch
from ._spread import running, seeded

GROUP_ROWS = 2048
#: The largest block, in words, and the blocks that the smallest target has at least (if it has as many words).
BLOCK, LEAST_BLOCKS = 64, 64
#: Primes a little over 2**20, more than can divide one number of blocks.
PRIMES = (1048583, 1048589, 1048601, 1048609, 1048613, 1048627, 1048633, 1048661, 1048681)


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Adds weight and target to rows (source, source_size): `share` of all words by weight, none above `most` times its size.

    The level at which the excess is used up is found from running sums over sources in the order in which they reach their limit.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(ordered) - 1) % len(weights)
    filling = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    out = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    out = out.withColumn("_limit", F.col("source_size") * most).withColumn("_ratio", F.col("_limit") / F.col("weight"))
    left = share * F.sum("source_size").over(everything) - F.coalesce(F.sum("_limit").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    out = out.withColumn("_level", left / F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing)))
    out = out.withColumn("_level", F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_level"))).over(everything)["_level"])
    return out.withColumn("target", F.least(F.col("weight") * F.col("_level"), F.col("_limit"))).drop("_limit", "_ratio", "_level")


def quotas(votes: DataFrame, seats: Column, shards: int) -> DataFrame:
    """(source, shard, quota) for rows (source, target): `seats` blocks in all, dealt to `shards` shards of equal size.

    The first j shards together have the Sainte-Lague share of their seats. Divisors a little over and under the true one give each
    source's seats but for about one; only the seats between are ranked by quotient.
    """
    everything = Window.partitionBy("shard")
    v = votes.filter("target > 0").withColumn("shard", F.explode(F.sequence(F.lit(1), F.lit(shards))))
    v = v.withColumn("_seats", F.floor(seats * F.col("shard") / shards)).withColumn("_all", F.sum("target").over(everything)).withColumn("_half", F.count("*").over(everything) / 2)
    least = F.floor(F.col("target") * (F.col("_seats") - F.col("_half")) / F.col("_all") + 0.5) - 1
    most = F.floor(F.col("target") * (F.col("_seats") + F.col("_half")) / F.col("_all") + 0.5) + 1
    v = v.withColumn("_least", F.greatest(least, F.lit(0))).withColumn("_most", F.greatest(most, F.lit(1)))
    v = v.withColumn("_open", F.col("_seats") - F.sum("_least").over(everything))
    asked = v.withColumn("_k", F.explode(F.sequence("_least", F.col("_most") - 1)))
    asked = asked.withColumn("_turn", F.row_number().over(everything.orderBy((F.col("target") / (2 * F.col("_k") + 1)).desc(), F.col("source").asc_nulls_last())))
    got = asked.groupBy("source", "shard").agg((F.max("_least") + F.sum(F.when(F.col("_turn") <= F.col("_open"), 1).otherwise(0))).alias("_had"))
    before = F.lag("_had", 1, 0).over(Window.partitionBy("source").orderBy("shard"))
    return got.select("source", "shard", (F.col("_had") - before).cast("long").alias("quota"))


def plan(rows: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0, shards: int = 8, seed: int = 29) -> DataFrame:
    """One row for each source of `rows` (source, size): its size, target, block size and number of blocks; how many blocks the shards up to each
    have selected (`cuts`); and the prime and start of its seeded order of blocks.
    """
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows"))
    aims = targets(sources, weights, share, most)
    everything = Window.partitionBy()
    smallest = F.min(F.when(F.col("target") > 0, F.col("target"))).over(everything)
    aims = aims.withColumn("block", F.coalesce(F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(smallest / LEAST_BLOCKS))), F.lit(1)).cast("long"))
    aims = aims.withColumn("_total", F.round(F.sum("target").over(everything) / F.col("block")))
    by_shard = quotas(aims, F.col("_total"), shards).groupBy("source").agg(F.sort_array(F.collect_list(F.struct("shard", "quota"))).alias("_quotas")).withColumnRenamed("source", "_s")
    out = aims.join(by_shard, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s", "_total")
    out = out.withColumn("blocks", F.greatest(F.ceil(F.col("source_size") / F.col("block")), F.lit(1)).cast("long"))
    upto = F.transform(F.sequence(F.lit(1), F.lit(shards)), lambda j: F.aggregate(F.filter(F.coalesce("_quotas", F.array().cast("array<struct<shard:int,quota:bigint>>")), lambda q: q["shard"] <= j), F.lit(0).cast("long"), lambda had, q: had + q["quota"]))
    out = out.withColumn("cuts", F.transform(upto, lambda c: F.least(c, F.col("blocks") * int(most))))
    primes = F.filter(F.array(*[F.lit(p).cast("long") for p in PRIMES]), lambda p: F.col("blocks") % p != 0)
    out = out.withColumn("prime", F.element_at(primes, (F.floor(seeded(seed + 2, "source") * F.size(primes)) + 1).cast("int")))
    return out.withColumn("first", F.floor(seeded(seed, "source") * F.col("blocks")).cast("long")).drop("_quotas")


def mix_sources(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: tuple = (), seed: int = 29, pieces: bool = False, **shape) -> DataFrame:
    """One row for each of `df`'s: id, source, `carry`, size, source_size, target, taken (its words in the mix, repeats counted).

    With `pieces` also which blocks of the source's line lie in the document and which shard takes them: (block, shard, words).
    """
    tmp = Scratch(df.sparkSession)
    carried = [F.col(c).alias(f"_carry_{i}") for i, c in enumerate(carry)]
    tie = F.xxhash64(F.col(text_col), *[F.col(c) for c in carry])
    rows = df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words_in(F.col(text_col)).alias("size"), F.xxhash64(F.col(text_col)).alias("_text"), tie.alias("_tie"), *carried)
    rows = tmp.put(rows.withColumn("_key", seeded(seed + 1, "id", "_text")).drop("_text"), "rows")
    sources = tmp.put(plan(rows, seed=seed, **shape).withColumnRenamed("source", "_s"), "sources")
    placed = rows.join(sources, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    line = running(placed, ["source"], "_key", ["id", "size", "_tie"], F.col("size"), F.ceil(F.col("_rows") / GROUP_ROWS), "_start")
    block, blocks, cuts = F.col("block"), F.col("blocks"), F.col("cuts")
    end, quota = F.col("_start") + F.col("size"), F.element_at(cuts, -1)
    own = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("_start") / block), F.floor((end - 1) / block))).otherwise(F.array().cast("array<bigint>"))

    def words(b: Column) -> Column:
        return F.least(end, (b + 1) * block) - F.greatest(F.col("_start"), b * block)

    def turn(b: Column) -> Column:
        return (F.col("prime") * b + F.col("first")) % blocks

    def times(b: Column) -> Column:
        return F.when(turn(b) >= quota, 0).when(turn(b) + blocks >= quota, 1).otherwise(2)

    taken = F.aggregate(own, F.lit(0).cast("long"), lambda had, b: had + words(b) * times(b))

    def selected(round_: int) -> Column:
        at = lambda b: turn(b) + round_ * blocks
        shard = lambda b: F.size(F.filter(cuts, lambda c: c <= at(b))) + 1
        return F.transform(F.filter(own, lambda b: at(b) < quota), lambda b: F.struct(b.alias("block"), shard(b).alias("shard"), words(b).alias("words")))

    more = [F.concat(selected(0), selected(1)).alias("pieces")] if pieces else []
    return line.select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), *[F.col(f"_carry_{i}").alias(c) for i, c in enumerate(carry)], "size", "source_size", F.col("target").cast("double").alias("target"), taken.cast("long").alias("taken"), *more
    )
