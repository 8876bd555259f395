"""Mixing sources to target weights by systematic sampling, with DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, saved, small

WEIGHTS, MOST = (1, 2, 3), 3
#: Groups of neighbouring documents for the prefix sum: about this many altogether, however many documents there are.
GROUPS, LEAST_ROWS = 65_536, 64
#: Planning tables are broadcast up to this many rows.
BROADCAST_ROWS = 200_000
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target double) from (source, source_size), one row a source.

    Sources by code point, null last, weigh 1, 2, 3 and so on again; the whole size is shared by weight, no source above three
    times its own, and what is left over is shared by weight among the others. With the sources in order of size to weight,
    the ones held at three times their size are a prefix, so running sums find it; the table has a row a source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), ((F.row_number().over(order) - 1) % len(WEIGHTS)) + 1).cast("long")
    s = sizes.withColumn("w", weight)
    every = Window.partitionBy()
    by = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    s = s.select(
        "*",
        F.sum("source_size").over(every).alias("total"),
        (F.sum("w").over(every) - F.coalesce(F.sum("w").over(by), F.lit(0))).alias("w_left"),
        F.coalesce(F.sum("source_size").over(by), F.lit(0)).alias("before"),
    )
    s = s.withColumn("level", (F.col("total") - MOST * F.col("before")) / F.col("w_left"))
    s = s.withColumn("held", MOST * F.col("source_size") <= F.col("level") * F.col("w"))
    level = F.max(F.when(~F.col("held"), F.col("level"))).over(every)
    return s.select("source", "source_size", F.when(F.col("held"), (MOST * F.col("source_size")).cast("double")).otherwise(level * F.col("w")).alias("target"))


def _band(size: str) -> Column:
    """Sizes within an eighth of each other share a band; larger sizes have larger bands."""
    return F.expr(f"length(bin({size})) * 16L + shiftright({size}, greatest(length(bin({size})) - 4, 0))")


def _same(*names: str) -> Column:
    return F.expr(" and ".join(f"l.{n} <=> r.{n}" for n in names))


def copies(docs: DataFrame, size: str, seed: int = 0, out_col: str = "mix") -> DataFrame:
    """docs with a struct (source_size long, target double, copies long); size: the column of the documents' sizes.

    Every document of a source is expected target / source_size times. Within a source, in order of size band and hashed id,
    these expectations are summed up from one random offset, and a document comes once for each integer passed by its share; so
    neighbours of like size stand for each other, and the words taken come near the target. The running sum never gathers a
    source in one task: documents are counted in small groups of consecutive ranks, the groups' counts are summed up, and ranks
    are given within groups. A source of size 0 has target 0. Null sources are a source of their own, the last. Repeated rows
    are separate documents. Empty docs give none. Needs columns doc_id and source; all others pass, but one named out_col gives way.
    """
    md5 = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    row = F.struct(*docs.columns)
    rows = docs.select(row.alias("row"), F.col("source").alias("source"), F.col(size).alias("size"), md5.alias("h")).withColumn("band", _band("size"))
    slim = saved(rows.select("source", "band", "size", F.substring("h", 1, 8).alias("h8")))
    bands = slim.groupBy("source", "band").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
    most = F.greatest(F.lit(float(LEAST_ROWS)), F.sum("n").over(Window.partitionBy()) / GROUPS)
    bands = saved(bands.withColumn("parts", F.ceil(F.col("n") / most)))
    part = F.floor(F.conv("h8", 16, 10).cast("long") * F.col("parts") / F.lit(float(1 << 32)))
    some = small(bands.select("source", "band", "parts"), BROADCAST_ROWS).alias("r")
    groups = slim.alias("l").join(some, _same("source", "band")).select("l.source", "l.band", part.alias("part")).groupBy("source", "band", "part").agg(F.count(F.lit(1)).alias("n"))
    so_far = Window.partitionBy("source").orderBy("band", "part").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("before", F.coalesce(F.sum("n").over(so_far), F.lit(0)))
    start = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce("source", F.lit(""))).cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    share = targets(bands.groupBy("source").agg(F.sum("words").alias("source_size"))).withColumn("start", start)
    plan = saved(groups.alias("l").join(share.alias("r"), _same("source")).select("l.*", "r.source_size", "r.target", "r.start"))
    rows = rows.withColumn("h8", F.substring("h", 1, 8)).alias("l").join(some, _same("source", "band")).select("l.*", part.alias("part"))
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("source", "band", "part").orderBy("h", "size")))
    rows = rows.alias("l").join(small(plan, BROADCAST_ROWS).alias("r"), _same("source", "band", "part")).select("l.row", "r.source_size", "r.target", "r.start", (F.col("l.k") + F.col("r.before")).alias("rank"))
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    n = F.floor(F.col("rank") * each + F.col("start")) - F.floor((F.col("rank") - 1) * each + F.col("start"))
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c.lower() != out_col.lower()]
    return rows.select(*kept, F.struct("source_size", "target", n.alias("copies")).alias(out_col))


def mix(docs: DataFrame, seed: int = 0) -> DataFrame:
    """Each row of docs as often as the mix takes it, all columns; size is counted in words, null texts have none."""
    size, how = free_name(docs), free_name(docs, free_name(docs)) + "m"
    taken = copies(docs.withColumn(size, n_words(F.col("text"))), size, seed, how)
    again = free_name(taken)
    return taken.filter(F.col(how)["copies"] > 0).withColumn(again, F.explode(F.sequence(F.lit(1).cast("long"), F.col(how)["copies"]))).drop(size, how, again)
