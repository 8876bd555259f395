"""Sources and views of them, pinned by a lock."""

from __future__ import annotations

import fnmatch
import re
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Source:
    """Files of one format under a path."""

    key: str
    path: str
    format: str = "parquet"
    files: tuple[str, ...] | str | None = None
    license: str = ""

    def select(self, files=None, format=None) -> Source:
        """The source with other files or another format; None keeps what it has."""
        return replace(self, files=files if files is not None else self.files, format=format or self.format)

    def read(self, spark: SparkSession, columns: list[str] | None = None) -> DataFrame:
        """The rows; of the columns asked for those that are there."""
        paths = [f"{self.path}/{f}" for f in sorted([self.files] if isinstance(self.files, str) else self.files)] if self.files else [self.path]
        reader = spark.read.option("multiLine", "true") if self.format == "json" else spark.read
        df = reader.format("json" if self.format == "jsonl" else self.format).load(paths)
        return df.select([c for c in columns if c in df.columns]) if columns else df


def local_documents(spark: SparkSession, directory: str, glob: str = "*.md", repeat: int = 1, train: bool = True) -> DataFrame:
    """(ordinal struct<rep, path>, text, path): one row a file; in training the whole set comes `repeat` times."""
    if repeat < 1:
        raise ValueError("repeat must be at least 1")
    df = spark.read.option("pathGlobFilter", glob).text(directory, wholetext=True).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("path"))
    if df.isEmpty():
        raise FileNotFoundError(f"no documents in {directory}")
    n = repeat if train else 1
    return df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select(F.struct("rep", "path").alias("ordinal"), "text", "path")


def text_chunks(df: DataFrame, text: str = "text", size: int = 1_000_000) -> DataFrame:
    """A text in pieces of so many characters: chunk from 0."""
    rows = df.filter(F.length(text) > 0).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.expr(f"(length({text}) - 1) div {size}"))))
    return rows.withColumn("piece", F.substring(F.col(text), F.col("chunk") * size + 1, F.lit(size)))


def decode_blobs(df: DataFrame, blobs: DataFrame) -> DataFrame:
    """Rows with blob_id and src_encoding joined to (blob_id, content): gunzipped and decoded, undecodable bytes as U+FFFD.

    Rows without a blob, with one that isn't whole gzip, or with an unknown encoding have no text and are dropped; any other
    failure stops the query.
    """
    import gzip
    import zlib

    @F.pandas_udf("string")
    def decode(content, encoding):
        import pandas as pd

        def one(c, e):
            if c is None:
                return ""
            try:
                return gzip.decompress(c).decode(e or "utf-8", "replace")
            except (gzip.BadGzipFile, EOFError, zlib.error, LookupError):
                return ""

        return pd.Series([one(c, e) for c, e in zip(content, encoding, strict=True)])

    return df.join(blobs, "blob_id", "left").withColumn("text", decode("content", "src_encoding")).drop("content").filter("text <> ''")


def json_rows(spark: SparkSession, paths: list[str], columns: list[str] | None = None) -> DataFrame:
    """Rows of files that hold a JSON array each or, where one can't be read as such, JSON lines; of the columns those that are there."""
    first = spark.read.text(paths, wholetext=True).select(F.substring(F.ltrim("value"), 1, 1).alias("c"), F.col("_metadata.file_path").alias("p"))
    lines = [r.p for r in first.filter("c <> '['").collect()]  # a row a file
    arrays = [r.p for r in first.filter("c = '['").collect()]
    parts = ([spark.read.option("multiLine", "true").json(arrays)] if arrays else []) + ([spark.read.json(lines)] if lines else [])
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p, allowMissingColumns=True)
    return df.select([c for c in columns if c in df.columns]) if columns else df


def listed(files: DataFrame, prefix: str = "", suffix: str = ".parquet", first: int | None = None) -> DataFrame:
    """(path, bytes) of the files with a prefix and a suffix, by path, or the first so many of these."""
    rows = files.filter(F.startswith("path", F.lit(prefix)) & F.endswith("path", F.lit(suffix))).orderBy("path")
    return rows if first is None else rows.limit(first)


def file_sizes(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, bytes): names under a folder, without what Spark wrote about its own work."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    name = F.substring_index("path", "/", -1)
    return rows.filter(~F.startswith(name, F.lit("_")) & ~F.startswith(name, F.lit("."))).select(name.alias("path"), F.col("length").alias("bytes"))


def peek(spark: SparkSession, folder: str, n: int = 5, suffix: str = ".parquet") -> DataFrame:
    """The first n rows of the smallest file."""
    least = listed(file_sizes(spark, folder), suffix=suffix).agg(F.min_by("path", F.struct("bytes", "path")).alias("p")).first().p
    if least is None:
        raise FileNotFoundError(f"no {suffix} files in {folder}")
    return spark.read.parquet(f"{folder}/{least}").limit(n)


def raw_text(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, text): one continuous document a file, in order of the paths."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("ordinal"), F.col("value").alias("text"))
    return rows.orderBy("ordinal")


def stage_report(spark: SparkSession, folder: str, text: str = "text", first: int | None = None) -> DataFrame:
    """(path, rows, bytes, columns, est_tokens, has_text) of the first files of a folder by path; tokens are a quarter of the bytes."""
    files = listed(file_sizes(spark, folder), first=first)
    names = [r.path for r in files.select("path").collect()]  # a row a file
    if not names:
        raise FileNotFoundError(f"no files in {folder}")
    df = spark.read.parquet(*[f"{folder}/{n}" for n in names])
    rows = df.groupBy(F.col("_metadata.file_name").alias("path")).agg(F.count(F.lit(1)).alias("rows"))
    out = files.join(rows, "path", "left").select("path", F.coalesce("rows", F.lit(0)).alias("rows"), "bytes", F.lit(len(df.columns)).alias("columns"))
    return out.withColumn("est_tokens", F.floor(F.col("bytes") / 4)).withColumn("has_text", F.lit(text in df.columns))


def update_lock(previous: list[str], selected: list[str], repository: list[str]) -> list[str]:
    """Files to lock: selected patterns and what was locked before, of those that exist; an error for what doesn't."""
    chosen: set[str] = set()
    for pattern in selected:
        found = fnmatch.filter(repository, pattern)
        if not found:
            raise ValueError(f"no file matches {pattern}")
        chosen |= set(found)
    return sorted((chosen | set(previous)) & set(repository))


def require_lock(lock: dict, key: str, repo: str) -> dict:
    entry = lock.get(key)
    if entry is None:
        raise RuntimeError(f"source not locked: {key}")
    if entry["repo"] != repo:
        raise RuntimeError(f"lock names another repository for {key}")
    if not re.fullmatch(r"[0-9a-f]{40}", entry["revision"]):
        raise RuntimeError(f"lock of {key} has no full revision")
    return entry


def check_selection(files, locked: list[str], local: bool = False) -> None:
    """An override must be among the locked files; local views allow none; a pattern passes."""
    if files is None or isinstance(files, str):
        return
    if local:
        raise ValueError("a local view allows no file override")
    if rest := set(files) - set(locked):
        raise ValueError(f"files not locked: {sorted(rest)}")
