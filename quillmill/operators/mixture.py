"""Mixture plans, sampling weights, tiled blocks and curricula."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import hashed, rank

def every():
    """All rows of a short table of sources."""
    return Window.partitionBy()


def budget_plan(sources: DataFrame, total: int) -> DataFrame:
    """target and repeat (infinite without tokens) of each source with a positive weight."""
    return sources.filter("weight > 0").withColumn("target", F.col("weight") * total).withColumn("repeat", F.when(F.col("avail") > 0, F.col("weight") * total / F.col("avail")).otherwise(F.lit(float("inf"))))


def category_rollup(plan: DataFrame) -> DataFrame:
    """Sums by category, and of all under TOTAL."""
    rows = plan.rollup("category").agg(F.sum("weight").alias("weight"), F.sum("target").alias("target"), F.sum("avail").alias("avail"))
    return rows.withColumn("category", F.coalesce("category", F.lit("TOTAL"))).withColumn("ratio", F.col("target") / F.col("avail"))


def available(registry: DataFrame, caches: DataFrame, sft: bool = False) -> DataFrame:
    """Registered sources with tokens, their weights shared anew among them."""
    w = F.coalesce(F.col("sft_weight"), F.col("weight")) if sft else F.col("weight")
    rows = registry.withColumn("weight", w).join(caches.filter("avail > 0"), "key")
    return rows.withColumn("share", F.col("weight") / F.sum("weight").over(every()))


def capped_plan(sources: DataFrame, total: int, val_fraction: float) -> DataFrame:
    """want = round(share * total), half to even; take what is there; the tail of it is held out."""
    want = F.bround(F.col("weight") / F.sum("weight").over(every()) * total).cast("long")
    rows = sources.withColumn("want", want).withColumn("take", F.least("want", "avail"))
    rows = rows.withColumn("n_val", F.floor(F.col("take") * val_fraction)).withColumn("n_train", F.col("take") - F.col("n_val"))
    return rows.withColumn("capped", F.col("want") > F.col("avail"))


def blocks(plan: DataFrame, block: int, seed: int) -> DataFrame:
    """(key, start, length, place): training blocks of each source, in hashed order."""
    rows = plan.filter("n_train > 0").select("key", "n_train", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_train") - 1, F.lit(block).cast("long"))).alias("start"))
    return rows.select("key", "start", F.least(F.lit(block).cast("long"), F.col("n_train") - F.col("start")).alias("length"), hashed(seed, F.col("key"), F.col("start")).alias("place"))


def oversampled_plan(sources: DataFrame, total: int, val_fraction: float) -> DataFrame:
    """The tail of each source is held out; the rest is repeated, or cut, to its share of the training tokens."""
    rows = sources.withColumn("n_val", F.floor(F.col("avail") * val_fraction)).withColumn("unique", F.col("avail") - F.col("n_val"))
    want = F.bround(F.col("weight") / F.sum("weight").over(every()) * total * (1 - val_fraction)).cast("long")
    return rows.withColumn("want_train", want).withColumn("oversampled", F.col("want_train") > F.col("unique"))


def tiled_blocks(plan: DataFrame, block: int) -> DataFrame:
    """(key, lap, start, length): laps over each source's unique tokens until want_train is reached."""
    rows = plan.filter("unique > 0 and want_train > 0")
    rows = rows.withColumn("lap", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(want_train - 1) div unique"))))
    rows = rows.withColumn("_n", F.least(F.col("unique"), F.col("want_train") - F.col("lap") * F.col("unique")))
    rows = rows.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(block).cast("long"))))
    return rows.select("key", "lap", "start", F.least(F.lit(block).cast("long"), F.col("_n") - F.col("start")).alias("length"))


def sampler_weights(sources: DataFrame) -> DataFrame:
    """(key, n, item_weight): w / max(1, n) of each item; sources without weight count by items. Errors for weights that can't be."""
    w = F.coalesce(F.col("weight"), F.col("n").cast("double"))
    rows = sources.select("key", "n", w.alias("w"))
    bad = rows.agg(F.min("w").alias("least"), F.sum("w").alias("sum"), F.max(((F.col("w") > 0) & (F.col("n") == 0)).cast("int")).alias("empty")).first()
    if bad["least"] is None or bad["least"] < 0 or not bad["sum"]:
        raise ValueError("sampling weights must be non-negative with a positive sum")
    if bad["empty"]:
        raise ValueError("a source with positive weight has no items")
    return rows.select("key", "n", (F.col("w") / F.greatest(F.lit(1), F.col("n"))).alias("item_weight"))


def draws(spark, sources: list[tuple[str, int, float]], samples: int, seed: int, epoch: int = 0) -> DataFrame:
    """(draw, key, item): hashed draws with replacement, by source weight and then evenly; sources is a short literal list."""
    total = sum(w for _, _, w in sources)
    u = F.pmod(hashed(seed * 1_000_003 + epoch, F.col("id")), F.lit(1 << 52)) / F.lit(float(1 << 52))
    at, pick = 0.0, F.struct(F.lit(sources[-1][0]).alias("key"), F.lit(sources[-1][1]).alias("n"))
    conditions = []
    for key, n, w in sources:
        at += w / total
        conditions.append((at, key, n))
    for bound, key, n in reversed(conditions[:-1]):
        pick = F.when(u < bound, F.struct(F.lit(key).alias("key"), F.lit(n).alias("n"))).otherwise(pick)
    rows = spark.range(samples).select(F.col("id").alias("draw"), "id", pick.alias("s"))
    return rows.select("draw", "s.key", F.pmod(hashed(seed + 1, F.col("id"), F.lit(epoch)), F.col("s.n")).alias("item"))


def curriculum(df: DataFrame, window: str, n: int, first: float = 0.0, second: float = 0.0) -> DataFrame:
    """df with phase 1 for the head's share of windows and 2 for the rest; half without shares."""
    share = first / (first + second) if first + second else 0.5
    return df.withColumn("phase", F.when(F.col(window) < int(n * share), 1).otherwise(2))


def unique_names(df: DataFrame, name: str, ordinal: str) -> DataFrame:
    """Repeated names get -2, -3 and so on, in order."""
    k = F.row_number().over(Window.partitionBy(name).orderBy(ordinal))
    return df.withColumn("unique_name", F.when(k == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("-"), k.cast("string"))))


# The shares of short and long windows by context length, and the mixes' ratios and caps.
STAGE_SHARES = {2048: (0.35, 0.65), 4096: (0.27, 0.73), 8192: (0.25, 0.75)}
PRETRAIN_RATIOS = {"tiny-textbooks": 0, "cosmopedia-v2": 30, "fineweb-edu": 34, "tinystories-v2": 30, "tiny-webtext": 0, "gooaq": 5, "squad": 1}
PRETRAIN_RATIOS_4B = {"tiny-textbooks": 0, "cosmopedia-v2": 42, "fineweb-edu": 43, "tinystories-v2": 11, "tiny-webtext": 0, "gooaq": 3, "squad": 1}
SFT_CAPS = {"coqa.sft": 15_000_000, "quac.sft": 12_000_000, "no-robots.sft": 8_000_000, "squad.sft": 6_000_000, "soda.sft": 4_000_000, "gooaq.sft": 3_000_000, "smoltalk.everyday.sft": None}


def ratio_caps(sources: DataFrame, pool: int) -> DataFrame:
    """df with cap, a whole percent ratio's share of a pool of tokens; sources of ratio 0 go. Ratios must sum to 100."""
    if (total := sources.agg(F.coalesce(F.sum("ratio"), F.lit(0))).first()[0]) != 100:
        raise ValueError(f"ratios must sum to 100, not {total}")
    return sources.filter("ratio > 0").withColumn("cap", F.floor(F.col("ratio") * F.lit(pool) / 100).cast("long"))


def concat(parts: list[tuple[str, DataFrame]], ordinal: str) -> DataFrame:
    """One numbered set of the parts' rows: item from 0, by the parts' order and then by the ordinal; part and part_index tell
    where a row is from. All parts have the same columns."""
    sets = [df.withColumn("part", F.lit(name)).withColumn("part_index", F.lit(i)) for i, (name, df) in enumerate(parts)]
    rows = sets[0]
    for df in sets[1:]:
        rows = rows.unionByName(df)
    sizes = rows.groupBy("part_index").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("part_index").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select(F.col("part_index").alias("_i"), before.alias("_start")))  # a row a part
    rows = rank(rows, ordinal, ("part_index",), "_r")
    return rows.join(starts, F.col("part_index") == F.col("_i")).withColumn("item", F.col("_start") + F.col("_r") - 1).drop("_i", "_start", "_r")


def pool_weights(short: DataFrame, long: DataFrame, short_share: float, long_share: float) -> DataFrame:
    """(pool, n, item_weight): what each item of a short and a long pool is drawn by, so that the pools' shares come out.

    Shares needn't sum to 1, but must have a positive sum; an empty long pool is an error.
    """
    if short_share + long_share <= 0:
        raise ValueError("shares must be positive")
    if long.isEmpty():
        raise ValueError("the long pool has no windows")
    rows = short.agg(F.count(F.lit(1)).alias("n")).withColumn("pool", F.lit("short")).unionByName(long.agg(F.count(F.lit(1)).alias("n")).withColumn("pool", F.lit("long")))
    share = F.when(F.col("pool") == "short", F.lit(short_share)).otherwise(F.lit(long_share)) / F.lit(short_share + long_share)
    return rows.select("pool", "n", (share / F.greatest(F.lit(1), F.col("n"))).alias("item_weight"))
