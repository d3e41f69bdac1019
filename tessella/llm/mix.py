"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: A source's target is at least so many blocks, of one word if need be.
FINE = 64


def sainte_lague(parts: DataFrame, group: list[str], weight: str, seats: str, out: str) -> DataFrame:
    """Share ``seats`` (equal within a group) among the parts of a group by highest quotients w / (2j + 1).

    The quotients above a common level are counted in closed form: rounding w * seats / sum(w)
    gives them but for a few. Those are won or returned one by one, by the highest (or lowest)
    quotients next in line, ties to the part that comes first in the row order ``_rank``.
    Rounding is off by half a seat a part at most, so the level moves so little that a part of weight w changes by
    n / 2 * w / sum(w) seats and one at most: the quotients looked at are a few times the n parts of a group.
    """
    whole = Window.partitionBy(*group)
    near = parts.withColumn("_sum", F.sum(weight).over(whole)).withColumn(
        out, F.when(F.col("_sum") > 0, F.floor(F.col(weight) * F.col(seats) / F.col("_sum") + F.lit(0.5))).otherwise(F.lit(0)).cast("long")
    )
    near = near.withColumn("_most", F.ceil(F.count("*").over(whole) * F.col(weight) / F.col("_sum") / 2).cast("int") + 2)
    near = near.withColumn("_off", F.when(F.col("_sum") > 0, F.col(seats) - F.sum(out).over(whole)).otherwise(F.lit(0)))
    step = (
        near.where("_off <> 0")
        .select(*group, "_rank", "_off", F.col(weight).alias("_w"), F.col(out).alias("_q"), F.explode(F.sequence(F.lit(1), F.least(F.abs("_off").cast("int"), "_most"))).alias("_i"))
        .withColumn("_j", F.when(F.col("_off") > 0, F.col("_q") + F.col("_i") - 1).otherwise(F.col("_q") - F.col("_i")))
        .where("_j >= 0")
        .withColumn("_quotient", F.col("_w") / (2 * F.col("_j") + 1))
    )
    order = Window.partitionBy(*group).orderBy(F.when(F.col("_off") > 0, -F.col("_quotient")).otherwise(F.col("_quotient")), F.when(F.col("_off") > 0, F.col("_rank")).otherwise(-F.col("_rank")), "_i")
    moved = step.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= F.abs("_off")).groupBy(*group, "_rank").agg(F.sum(F.signum("_off")).cast("long").alias("_move"))
    keys = [*group, "_rank"]
    moved = moved.select(*[F.col(k).alias(f"{k}__m") for k in keys], "_move")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}__m"))
    return near.join(moved, same, "left").withColumn(out, F.col(out) + F.coalesce("_move", F.lit(0))).drop("_sum", "_off", "_most", "_move", *[f"{k}__m" for k in keys])


def source_targets(sources: DataFrame, weights: tuple[int, ...], max_repeat: int) -> DataFrame:
    """(_source, _size) -> with _rank, _weight and _target: weighted shares of all words, none above ``max_repeat`` times its size.

    Water filling in closed form: in the order of size per weight the sources below the
    common level stop at their limit, and the level is what is left per weight left.
    The source table is an aggregate of one row a source; its windows are over that.
    """
    # one group for all sources, a column rather than none so that Spark sees the key
    every = sources.withColumn("_all", F.lit(1))
    ranked = every.withColumn("_rank", F.row_number().over(Window.partitionBy("_all").orderBy(F.col("_source").asc_nulls_last())).cast("long"))
    ranked = ranked.withColumn("_weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("_rank") - 1) % len(weights) + 1).cast("int")))
    by = Window.partitionBy("_all").orderBy(F.col("_size") / F.col("_weight"), "_rank")
    whole = Window.partitionBy("_all")
    total = F.sum("_size").over(whole)
    before = F.coalesce(F.sum(F.col("_size") * max_repeat).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("_weight").over(by.rowsBetween(0, Window.unboundedFollowing))
    level = ranked.withColumn("_total", total).withColumn("_level", (F.col("_total") - before) / left)
    level = level.withColumn("_fill", F.max(F.when(F.col("_size") * max_repeat / F.col("_weight") > F.col("_level"), F.col("_level"))).over(whole))
    limit = (F.col("_size") * max_repeat).cast("double")
    return level.withColumn("_target", F.when(F.col("_fill").isNull(), limit).otherwise(F.least(limit, F.col("_weight") * F.col("_fill")))).drop("_level", "_fill")


def _upto(t: Column) -> Column:
    """Words that the extra round takes from the first ``t`` words of a shard's stream."""
    block = F.col("_block")
    k = F.floor(t / block)
    chosen = lambda k: F.floor((k + F.col("_u")) * F.col("_rest") / F.col("_blocks"))
    return (chosen(k) - chosen(F.lit(0))) * block + (t - k * block) * (chosen(k + 1) - chosen(k))


def mix_sources(docs: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3, block_words: int = 64, shard_docs: int = 1_000, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """How many words of each document a mix takes whose sources meet target weights.

    Sources weigh ``weights`` in turn, by code point, null last (null is a source of its own),
    and share all words; a target stops at ``max_repeat`` times its source's words. Sainte-Laguë
    shares blocks of equal length among sources, and each source's among its shards, of about
    ``shard_docs`` documents drawn by hash: no window holds more than a shard. Blocks have ``block_words`` words, or
    less where that is over 1 / FINE of a target: those shared among sources by the least target, a source's own by its.
    In a shard the documents stand in a seeded order; its quota is so many whole rounds, and blocks at even
    distances from a seeded start for the rest. A document is taken as often as the blocks that it covers.

    Returns one row per input row: the id and source columns, those named in ``carry``, size, source_size, target, taken.
    Null, empty or blank texts have size 0 and taken 0; repeated rows count each on their own;
    an empty table gives no rows; other columns are not read.
    """
    sizes = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("_words"), *[F.col(c).alias(f"_carried_{c}") for c in carry])
    sizes = materialize(sizes)
    sources = sizes.groupBy("_source").agg(F.sum("_words").alias("_size"), F.count("*").alias("_docs"))
    sources = source_targets(sources, weights, max_repeat)
    block = lambda target: F.greatest(F.lit(1), F.least(F.lit(block_words), F.floor(target / FINE))).cast("long")
    least = F.min(F.when(F.col("_target") > 0, F.col("_target"))).over(Window.partitionBy("_all"))
    sources = sources.withColumn("_unit", block(F.coalesce(least, F.lit(0.0)))).withColumn("_seats", F.round(F.col("_total") / F.col("_unit")).cast("long"))
    sources = sainte_lague(sources, ["_all"], "_target", "_seats", "_shared").withColumn("_block", block(F.col("_target")))
    sources = sources.withColumn("_quota", F.round(F.col("_shared") * F.col("_unit") / F.col("_block")).cast("long"))
    sources = materialize(sources.select("_source", "_size", "_target", "_quota", "_block", F.ceil(F.col("_docs") / shard_docs).alias("_shards"), F.col("_rank").alias("_source_rank")))
    mark = F.col("_source").eqNullSafe(F.col("_of"))
    named = sources.withColumnRenamed("_source", "_of")
    rows = sizes.join(named, mark).withColumn("_shard", F.pmod(F.xxhash64("_id", F.lit(seed)), F.col("_shards")))
    shards = rows.groupBy("_source_rank", "_shard").agg(F.sum("_words").alias("_in_shard"), F.max("_quota").alias("_quota"), F.max("_block").alias("_block")).withColumn("_rank", F.col("_shard"))
    shards = sainte_lague(shards, ["_source_rank"], "_in_shard", "_quota", "_given")
    # the last block of a shard may be shorter: rounds are told by words, so that it doesn't count as a whole one each time
    words = F.least(F.col("_given") * F.col("_block"), F.col("_in_shard") * max_repeat)
    shards = shards.withColumn("_rounds", F.when(F.col("_in_shard") > 0, F.floor(words / F.col("_in_shard"))).otherwise(F.lit(0)))
    shards = shards.withColumn("_blocks", F.greatest(F.ceil(F.col("_in_shard") / F.col("_block")), F.lit(1)))
    shards = shards.select(
        F.col("_source_rank").alias("_r"), F.col("_shard").alias("_s"), "_blocks", "_rounds",
        F.least(F.round((words - F.col("_rounds") * F.col("_in_shard")) / F.col("_block")).cast("long"), F.col("_blocks")).alias("_rest"),
        F.pmod(F.xxhash64("_source_rank", "_shard", F.lit(seed)), F.col("_blocks")).alias("_u"),
    )
    rows = rows.join(shards, (F.col("_source_rank") == F.col("_r")) & (F.col("_shard") == F.col("_s")))
    stream = Window.partitionBy("_source_rank", "_shard").orderBy(F.xxhash64("_id", F.lit(seed + 1)), "_id", "_words")
    upto = F.sum("_words").over(stream.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_to", upto).withColumn("_from", F.col("_to") - F.col("_words"))
    taken = F.col("_rounds") * F.col("_words") + _upto(F.col("_to")) - _upto(F.col("_from"))
    return rows.select(
        F.col("_id").alias(id_col), F.col("_source").alias(source_col), *[F.col(f"_carried_{c}").alias(c) for c in carry], F.col("_words").alias("size"), F.col("_size").alias("source_size"), F.col("_target").alias("target"), taken.cast("long").alias("taken"),
    )
