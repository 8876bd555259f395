"""Search in texts: counts, frequencies, places and snippets."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def occurrences(df: DataFrame, needle: str, text: str = "text", regex: bool = False, ignore_case: bool = False, out: str = "hits") -> DataFrame:
    """df with how often a needle occurs: overlapping for plain strings, else as a pattern finds it, one after the other."""
    if regex or ignore_case:
        pattern = ("(?i)" if ignore_case else "") + (needle if regex else re.escape(needle))
    else:
        pattern = f"(?={re.escape(needle)})"
    rows = df if regex or ignore_case else df.withColumn(out, F.lit(0))
    count = F.regexp_count(F.col(text), F.lit(pattern)).cast("long")
    return rows.withColumn(out, F.when(F.contains(F.col(text), F.lit(needle)), count).otherwise(0) if not regex and not ignore_case else count)


def frequency(df: DataFrame, needle: str, tokens: str, **how) -> DataFrame:
    rows = occurrences(df, needle, **how)
    return rows.agg(F.sum("hits").alias("hits"), F.sum(tokens).alias("tokens")).withColumn("per_million", F.col("hits") * 1_000_000 / F.col("tokens"))


def places(df: DataFrame, needle: str, text: str = "text", out: str = "at") -> DataFrame:
    """A row for each occurrence of a needle, overlapping ones too, with its first character's number from 0."""
    if not needle:
        raise ValueError("an empty needle is everywhere")
    parts = F.split(F.col(text), f"(?={re.escape(needle)})")  # every part but perhaps the first begins at an occurrence
    ends = F.transform(parts, lambda p, i: F.struct(((i > 0) | F.startswith(F.col(text), F.lit(needle))).alias("hit"), F.length(p).alias("n"), i.alias("i")))
    rows = df.filter(F.contains(F.col(text), F.lit(needle))).withColumn("_parts", ends)
    rows = rows.select("*", F.explode(F.filter("_parts", lambda p: p["hit"])).alias("_p"))
    at = F.aggregate(F.slice("_parts", F.lit(1), F.col("_p.i")), F.lit(0).cast("long"), lambda a, p: a + p["n"])
    return rows.withColumn(out, at).drop("_parts", "_p")


def all_snippets(df: DataFrame, needle: str, key: str, context: int = 80, most: int = -1, whole: bool = False, reach: int = 4000, text: str = "text") -> DataFrame:
    """(key, at, snippet) of every occurrence, or the first `most` by key and place.

    A snippet has `context` characters on both sides, or with `whole` the line about the occurrence up to `reach` characters on
    both sides. Line ends become ⏎ between blanks; … stands where text is left out.
    """
    rows = places(df, needle, text)
    n, size = F.length(text), len(needle)
    if whole:
        left = F.substring(F.col(text), F.greatest(F.lit(1), F.col("at") + 1 - reach).cast("int"), F.least(F.col("at"), F.lit(reach)).cast("int"))
        right = F.substring(F.col(text), (F.col("at") + 1).cast("int"), F.lit(reach))
        before = F.length(F.substring_index(left, "\n", -1))
        after = F.length(F.substring_index(right, "\n", 1))
        start, end = F.col("at") - before, F.col("at") + after
    else:
        start, end = F.greatest(F.lit(0), F.col("at") - context), F.least(n, F.col("at") + size + context)
    rows = rows.withColumn("_s", start.cast("int")).withColumn("_e", end.cast("int"))
    body = F.replace(F.substring(F.col(text), F.col("_s") + 1, F.col("_e") - F.col("_s")), F.lit("\n"), F.lit(" ⏎ "))
    shown = F.concat(F.when(F.col("_s") > 0, "…").otherwise(""), body, F.when(F.col("_e") < n, "…").otherwise(""))
    rows = rows.select(key, "at", shown.alias("snippet"))
    return rows if most < 0 else rows.orderBy(key, "at").limit(most)


def decode_cache(spark: SparkSession, tokens: DataFrame, decode: Callable[[list[int]], str], marks: list[str], path: str, stamp: str, rebuild: bool = False) -> DataFrame:
    """(ordinal, text) of token documents (ordinal, ids), decoded once into a table that is used again while the stamp of what it
    was made from stays the same; the marks of starts and ends become line ends."""
    from .artifacts import exists

    here = f"{path}/{hashlib.blake2b(stamp.encode(), digest_size=8).hexdigest()}"
    if rebuild or not exists(spark, f"{here}/_SUCCESS"):

        def run(ids):
            import pyarrow as pa

            return pa.array([None if x is None else decode(x) for x in ids.to_pylist()], pa.string())

        text = F.arrow_udf(run, "string")("ids")
        for m in marks:
            text = F.replace(text, F.lit(m), F.lit("\n"))
        tokens.select("ordinal", text.alias("text")).write.mode("overwrite").parquet(here)
    return spark.read.parquet(here)
