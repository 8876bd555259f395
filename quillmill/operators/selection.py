"""Splits, filters and caps, all by an explicit ordinal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import hashed, prefix_sum, rank


def native_split(df: DataFrame, split: str, names: dict[str, str], column: str = "split") -> DataFrame:
    """Rows of the named split of a logical one (train, validation)."""
    if split not in names:
        raise ValueError(f"unknown split: {split}")
    return df.filter(F.col(column) == names[split])


def carve(df: DataFrame, ordinal: str, fraction: float, out: str = "split") -> DataFrame:
    """df marked validation for the head's whole percents, at least one, and train for the rest."""
    if not 0 < fraction < 1:
        raise ValueError("fraction must be between 0 and 1")
    percent = max(1, round(100 * fraction))
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    rows = rank(df, ordinal, out="_rank").crossJoin(F.broadcast(n))
    return rows.withColumn(out, F.when(F.col("_rank") <= F.bround(F.col("_n") * percent / 100), "validation").otherwise("train")).drop("_rank", "_n")


def tail(df: DataFrame, ordinal: str, size: str, fraction: float, out: str = "val_tokens") -> DataFrame:
    """df with how many of each row's tokens lie in the held-out tail of int(total * fraction) tokens."""
    total = df.agg(F.sum(size).alias("_total"))
    rows = prefix_sum(df, size, ordinal, end="_end").crossJoin(F.broadcast(total))
    cut = F.col("_total") - F.floor(F.col("_total") * fraction)
    return rows.withColumn(out, F.least(F.col(size).cast("long"), F.greatest(F.lit(0).cast("long"), F.col("_end") - cut))).drop("_end", "_total")


def hash_split(df: DataFrame, key: str, fraction: float, seed: int) -> Column:
    """Whether a row is held out: a hashed draw under the fraction."""
    return F.pmod(hashed(seed, F.col(key)), F.lit(1_000_003)) < int(fraction * 1_000_003)


def long_documents(df: DataFrame, ordinal: str, least: int = 8192, n: int = 200) -> DataFrame:
    """The last n texts with so many characters, last first."""
    return df.filter(F.length("text") >= least).orderBy(F.desc(ordinal)).limit(n)


def min_length(df: DataFrame, size: str, seq_len: int, min_doc: int = 0) -> DataFrame:
    return df.filter(F.col(size) >= max(seq_len + 1, min_doc))


def eligible(sources: DataFrame) -> DataFrame:
    """Sources that may feed a tokenizer; an error if there are none."""
    kept = sources.filter(~F.coalesce(F.col("exclude_from_tokenizer"), F.lit(False)))
    if kept.isEmpty():
        raise ValueError("no eligible tokenizer source")
    return kept


def cap_documents(df: DataFrame, size: str, ordinal: str, cap: int) -> DataFrame:
    """The documents that fit whole, up to the first that doesn't; later smaller ones aren't considered. start and end are their places.

    Where the very first is longer, it alone stays, with its size cut to the cap. A cap of 0 or less keeps none.
    """
    rows = prefix_sum(df, size, ordinal, end="end").withColumn("start", F.col("end") - F.col(size))
    first = df.filter(F.col(size) > 0).agg(F.min(ordinal).alias("_first"))
    rows = rows.crossJoin(F.broadcast(first)).withColumn("kept", F.least(F.col("end"), F.lit(cap)) - F.col("start"))
    return rows.filter((F.lit(cap) > 0) & ((F.col("end") <= cap) | (F.col(ordinal) == F.col("_first")))).drop("_first")


def cap_hard(df: DataFrame, size: str, ordinal: str, cap: int) -> DataFrame:
    """Exactly cap tokens: the last document is cut. kept: tokens of each."""
    rows = prefix_sum(df, size, ordinal, end="end").withColumn("start", F.col("end") - F.col(size))
    return rows.filter(F.col("start") < cap).withColumn("kept", F.least(F.col("end"), F.lit(cap)) - F.col("start"))


def cap_inclusive(df: DataFrame, size: str, ordinal: str, cap: Column | int, by: tuple[str, ...] = ()) -> DataFrame:
    """Documents until the sum reaches the cap; the one that crosses it is whole."""
    rows = prefix_sum(df, size, ordinal, by, "end")
    return rows.filter(F.col("end") - F.col(size) < cap)


def held_out_after(df: DataFrame, size: str, ordinal: str, cap: int, held_out: int) -> DataFrame:
    """The documents after those of cap_inclusive until they sum up to held_out."""
    rows = prefix_sum(df, size, ordinal, end="end")
    edge = rows.filter(F.col("end") - F.col(size) < cap).agg(F.coalesce(F.max("end"), F.lit(0)).alias("_edge"))
    rows = rows.crossJoin(F.broadcast(edge))
    return rows.filter((F.col("end") - F.col(size) >= cap) & (F.col("end") - F.col(size) - F.col("_edge") < held_out)).drop("_edge")


def shares(sources: DataFrame, weight: str, total: int, headroom: float = 1.15) -> DataFrame:
    """Caps of sources: by weight, equal, and with headroom rounded up."""
    every = Window.partitionBy()
    share = F.col(weight) / F.sum(weight).over(every)
    return sources.withColumns({"cap_weighted": F.floor(total * F.col(weight) / F.sum(weight).over(every)), "cap_equal": F.greatest(F.lit(1).cast("long"), F.floor(F.lit(total) / F.count(F.lit(1)).over(every))), "cap_headroom": F.ceil(share * total * headroom)})


def proportional_split(df: DataFrame, size: str, ordinal: str, shares: tuple[float, float, float] = (0.9, 0.05, 0.05)) -> DataFrame:
    """df with how many of each row's tokens are in train, validation and test: intervals of the stream of all, cut at whole tokens."""
    total = df.agg(F.sum(F.col(size).cast("long")).alias("_total"))
    rows = prefix_sum(df, size, ordinal, end="_end").crossJoin(F.broadcast(total)).withColumn("_start", F.col("_end") - F.col(size))
    whole = sum(shares)
    cuts = [F.lit(0).cast("long"), F.floor(F.col("_total") * (shares[0] / whole)), F.floor(F.col("_total") * ((shares[0] + shares[1]) / whole)), F.col("_total")]
    part = lambda i: F.greatest(F.lit(0).cast("long"), F.least(F.col("_end"), cuts[i + 1]) - F.greatest(F.col("_start"), cuts[i]))
    return rows.withColumns({name: part(i).cast("long") for i, name in enumerate(("train", "validation", "test"))}).drop("_end", "_start", "_total")


def first_texts(df: DataFrame, ordinal: str, n: int = 500, join: str = "\n\n") -> DataFrame:
    """One row (text, documents, bytes) of the first n texts, joined: a held-out text of bounded size."""
    rows = df.orderBy(ordinal).limit(n).agg(F.array_sort(F.collect_list(F.struct(F.col(ordinal).alias("o"), F.col("text").alias("t")))).alias("d"))
    text = F.array_join(F.transform("d", lambda x: x["t"]), join)
    return rows.select(text.alias("text"), F.size("d").alias("documents"), F.octet_length(text).alias("bytes"))
