"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table, read by Spark alone so that any store it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: what spark.checkpoint.dir names, or in local mode, as in tests, one made here."""
    sc = spark.sparkContext
    if named := sc.getConf().get("spark.checkpoint.dir", None):
        return named
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return sc.getCheckpointDir() or tempfile.mkdtemp(prefix="quillmill-checkpoint-")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that no later step reads."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def saved(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value made once for each row, however often it is named and whatever the optimizer puts together."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def free_name(df: DataFrame, *taken: str) -> str:
    """A column name that df doesn't have."""
    used, name = {c.lower() for c in (*df.columns, *taken)}, "_q"
    while name in used:
        name += "q"
    return name


def ascii_lower(c: Column) -> Column:
    """A-Z alone in lower case; other letters stay."""
    return F.translate(c, UPPER, LOWER)


def utf8(array) -> tuple:
    """An Arrow string array as (bytes, int64 offsets) without a copy of the text; null counts as empty."""
    import numpy as np
    import pyarrow as pa

    array = array.fill_null("").cast(pa.large_string())
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1] if len(array) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def runs(offsets, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most limit bytes each; a longer row is a range by itself."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(offsets.searchsorted(offsets[at] + limit, "right")) - 1)
        yield at, min(to, n)
        at = to


def small(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """df, a checkpoint of a few numbers a row, to be broadcast if it has at most so many rows."""
    return F.broadcast(df) if df.count() <= rows else df


#: Keys with more than this part of all rows are joined by broadcast; there are fewer of them than this.
HOT_KEYS = 10_000
FEW_ROWS = 1_000_000


def join_hot(rows: DataFrame, keyed: DataFrame, key: str, n: str) -> DataFrame:
    """rows joined with keyed, a checkpoint of one row a key, by key; n: the column of keyed that counts the rows of a key.

    Rows of a hot key stay where they are and get the key's row by broadcast; there are fewer than HOT_KEYS such keys. All
    other rows meet their keys by shuffle.
    """
    total = keyed.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    hot = F.broadcast(keyed.filter(F.col(n) > total / HOT_KEYS).drop(n))
    cold = keyed.filter(F.col(n) <= total / HOT_KEYS).drop(n)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key))


def look_up(rows: DataFrame, keyed: DataFrame, key: str, total: int) -> DataFrame:
    """rows, checkpointed, left-joined with keyed, of at most one row a key and one more column, by key, without a task that
    gets all rows of a hot key.

    Keys with more than total / HOT_KEYS of the rows are fewer than HOT_KEYS; theirs are broadcast, and such rows take part in
    the shuffle under no key. total: about the number of rows; up to FEW_ROWS any task can take them all.
    """
    if total <= FEW_ROWS:
        return rows.join(keyed, key, "left")
    (value,) = (c for c in keyed.columns if c != key)
    hot = rows.groupBy(key).count().filter(F.col("count") > total / HOT_KEYS).select(key)
    hot = F.broadcast(keyed.join(F.broadcast(hot), key).select(F.col(key).alias("_hot"), F.col(value).alias("_known")))
    met = rows.join(hot, F.col(key) == F.col("_hot"), "left")
    # a hot key's rows are dealt out by a number that is below any part a plain key has
    met = met.withColumn("_part", F.when(F.col("_hot").isNull(), F.lit(0).cast("long")).otherwise(-1 - F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 30))))
    cold = keyed.select(F.col(key).alias("_key"), value, F.lit(0).cast("long").alias("_zero"))
    met = met.join(cold, (F.col(key) == F.col("_key")) & (F.col("_part") == F.col("_zero")), "left")
    return met.withColumn(value, F.coalesce("_known", value)).drop("_hot", "_known", "_part", "_key", "_zero")
