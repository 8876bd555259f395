"""Versioned artifacts: sharded token documents, with a manifest that is written last."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 3
SAFE = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]*")


def content_hash(value, size: int = 16) -> str:
    """blake2b of bytes or of sorted JSON."""
    data = value if isinstance(value, bytes) else json.dumps(value, sort_keys=True, default=str).encode()
    return hashlib.blake2b(data, digest_size=size).hexdigest()


def directory(root: str, view: str, descriptor: dict) -> str:
    """Where the artifact of a view and its build descriptor belongs."""
    if not SAFE.fullmatch(view):
        raise ValueError(f"unsafe text view key: {view}")
    return f"{root}/{view}/{content_hash(descriptor)}"


def shard_plan(sizes: list[tuple[int, int]], shard_tokens: int) -> list[tuple[int, int]]:
    """(ordinal, shard): a shard ends before a document that would pass the limit, and at it; empty documents go.

    The rule is sequential; it takes (ordinal, size) pairs in order, of one build.
    """
    out, shard, n = [], 0, 0
    for ordinal, size in sizes:
        if size <= 0:
            continue
        if n and n + size > shard_tokens:
            shard, n = shard + 1, 0
        out.append((ordinal, shard))
        n += size
        if n >= shard_tokens:
            shard, n = shard + 1, 0
    return out


def assign_shards(df: DataFrame, size: str, ordinal: str, shard_tokens: int) -> DataFrame:
    """df with its shard; only ordinals and sizes travel to the one place where the rule runs."""
    slim = df.select(F.col(ordinal).cast("long").alias("o"), F.col(size).cast("long").alias("n"))

    def plan(pdf):
        import pandas as pd

        pdf = pdf.sort_values("o")
        return pd.DataFrame(shard_plan(list(zip(pdf.o, pdf.n, strict=True)), shard_tokens), columns=["o", "shard_id"])

    shards = slim.withColumn("one", F.lit("")).groupBy("one").applyInPandas(plan, "o long, shard_id long")
    return df.join(shards, F.col(ordinal) == F.col("o")).drop("o")


def _file(spark: SparkSession, path: str):
    jvm, p = spark.sparkContext._jvm, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """Written beside and put in place by one rename over what is there, so that one of the two is always there whole."""
    jvm, tmp, fs = _file(spark, path + ".tmp")
    stream = fs.create(tmp, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    gateway = spark.sparkContext._gateway
    kind = jvm.org.apache.hadoop.fs.Options.Rename
    over = gateway.new_array(kind, 1)
    over[0] = kind.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(tmp), fs.makeQualified(jvm.org.apache.hadoop.fs.Path(path)), over)


def exists(spark: SparkSession, path: str) -> bool:
    _, p, fs = _file(spark, path)
    return fs.exists(p)


def fingerprint(adapter: str, options: dict, files: list[str] | None, splits: dict, version: int = VERSION) -> str:
    """Names what decides the documents of a view beside its source's revision: adapter, options, files, splits and the engine's version."""
    return content_hash({"adapter": adapter, "options": options, "files": sorted(files) if files else None, "splits": splits, "engine": version}, 6)


def remove(spark: SparkSession, path: str) -> None:
    _, p, fs = _file(spark, path)
    fs.delete(p, True)


def files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(name, bytes) of the files under a path, in order of their names; those that begin with a sign of Spark's own go."""
    _, p, fs = _file(spark, path)
    found, each, base = [], fs.listFiles(p, True), str(fs.getFileStatus(p).getPath().toString())
    while each.hasNext():
        f = each.next()
        name = f.getPath().toString()[len(base) + 1 :] or f.getPath().getName()
        if not f.getPath().getName().startswith(("_", ".")):
            found.append((name, int(f.getLen())))
    return sorted(found)


def read_text(spark: SparkSession, path: str) -> str:
    """A small file's text; one that isn't there is an error."""
    _, p, fs = _file(spark, path)
    if not fs.exists(p):
        raise FileNotFoundError(path)
    return "\n".join(r.value for r in spark.read.text(path).collect())


def read_manifest(spark: SparkSession, path: str) -> dict | None:
    _, p, fs = _file(spark, f"{path}/manifest.json")
    if not fs.exists(p):
        return None
    return json.loads("\n".join(r.value for r in spark.read.text(f"{path}/manifest.json").collect()))


def digests(df: DataFrame, labelled: bool) -> DataFrame:
    """(shard_id, documents, tokens, checksum) that no order of rows or files changes."""
    parts = [F.col("ordinal").cast("string"), F.array_join("ids", ",")] + ([F.array_join("labels", ",")] if labelled else [])
    row = F.sha2(F.concat_ws("|", *parts).cast("binary"), 256)
    return df.groupBy("shard_id").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.size("ids")).alias("tokens"), F.sha2(F.array_join(F.array_sort(F.collect_list(row)), "").cast("binary"), 256).alias("checksum"))


def write(df: DataFrame, path: str, descriptor: dict, shard_tokens: int, vocab_size: int, labelled: bool = False) -> dict:
    """Write documents (ordinal, ids, labels) as shards and then the manifest, which this returns; one that is there is a hit."""
    spark = df.sparkSession
    if (found := read_manifest(spark, path)) is not None:
        return found
    if not labelled and "labels" in df.columns:
        raise ValueError("an artifact without labels refuses them")
    if labelled and not df.filter(F.size("ids") != F.size("labels")).isEmpty():
        raise ValueError("labels must be as long as ids")
    kind = "smallint" if vocab_size - 1 <= 32767 else "int"
    rows = assign_shards(df.withColumn("_n", F.size("ids")), "_n", "ordinal", shard_tokens).drop("_n").withColumn("ids", F.col("ids").cast(f"array<{kind}>"))
    rows.repartition("shard_id").sortWithinPartitions("shard_id", "ordinal").write.mode("overwrite").partitionBy("shard_id").parquet(f"{path}/shards")
    made = digests(spark.read.schema(rows.schema).parquet(f"{path}/shards"), labelled).orderBy("shard_id").collect()
    manifest = {"version": VERSION, "build": descriptor, "dtype": "int16" if kind == "smallint" else "int32", "stores_labels": labelled, "tokens": sum(r.tokens for r in made), "documents": sum(r.documents for r in made), "shards": [r.asDict() for r in made]}
    _write_text(spark, f"{path}/manifest.json", json.dumps(manifest, sort_keys=True, default=str))
    return manifest


def verify(spark: SparkSession, path: str) -> dict:
    """The manifest, if its version is known and every shard is there as it was written."""
    manifest = read_manifest(spark, path)
    if manifest is None:
        raise FileNotFoundError(f"no manifest in {path}")
    if manifest["version"] != VERSION:
        raise ValueError("unsupported text artifact version")
    found = {r.shard_id: r.checksum for r in digests(spark.read.parquet(f"{path}/shards"), manifest["stores_labels"]).collect()} if manifest["shards"] else {}
    for s in manifest["shards"]:
        if s["shard_id"] not in found:
            raise FileNotFoundError(f"missing artifact shard: {s['shard_id']}")
        if found[s["shard_id"]] != s["checksum"]:
            raise ValueError(f"checksum mismatch: {s['shard_id']}")
    return manifest
