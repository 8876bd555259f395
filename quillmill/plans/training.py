"""Training data in one call: compiled views of a mixture, their windows, one numbered set, draws and batches."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.chat import SPECIAL_TOKENS
from ..operators import artifacts, mixture, stats, windows
from ..operators.tokenizer import BytePairs, Pretrained
from ..sources.registry import OBJECTIVES, Catalog
from . import build


@dataclass(frozen=True)
class Packed:
    """Windows one after the other over the stream of all documents."""

    def windows(self, docs: DataFrame, length: int, labels: str | None, epoch: int, index: int) -> DataFrame:
        return windows.packed(docs, "ids", "ordinal", length, labels)


@dataclass(frozen=True)
class DocumentWindows:
    """Windows within documents that are long enough, at places anew each epoch."""

    min_doc: int = 0
    most: int = 4
    seed: int = 0

    def windows(self, docs: DataFrame, length: int, labels: str | None, epoch: int, index: int) -> DataFrame:
        rows = docs.withColumn("n", F.size("ids"))
        at = windows.document_windows(rows, "n", "ordinal", length, self.min_doc, self.most, self.seed + index, epoch)
        cut = lambda c, shift: F.slice(F.col(c), (F.col("offset") + 1 + shift).cast("int"), F.lit(length))
        made = at.join(docs, "ordinal").select("ordinal", "k", cut("ids", 0).alias("x"), cut(labels or "ids", 1).alias("y"))
        return made.select((F.col("ordinal") * self.most + F.col("k")).alias("window_id"), "x", "y")


#: Sampling policies by name.
SAMPLING: dict[str, Callable] = {"packed": Packed, "document-window": DocumentWindows}


@dataclass(frozen=True)
class Part:
    """A view of a mixture, with its weight (None: by its number of windows), caps and sampling."""

    view: str
    weight: float | None = None
    max_train_tokens: int | None = None
    max_validation_tokens: int | None = None
    sampling: Packed | DocumentWindows = field(default_factory=Packed)


@dataclass
class TrainingData:
    """What compile_mixture() made: artifacts by view and split, and the windows over them."""

    spark: SparkSession
    parts: list[Part]
    length: int
    paths: dict[tuple[str, str], str]
    manifests: dict[tuple[str, str], dict]
    seed: int = 0

    def documents(self, view: str, split: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.paths[view, split]}/shards")

    def tokens(self) -> dict[str, dict[str, int]]:
        """Tokens of each view's splits."""
        return {p.view: {s: self.manifests[p.view, s]["tokens"] for s in ("train", "validation")} for p in self.parts}

    def windows(self, split: str = "train", epoch: int = 0, views: list[str] | None = None) -> DataFrame:
        """(part, part_index, window_id, item, x, y): all parts' windows as one numbered set; validation is packed always."""
        made = []
        for i, p in enumerate(self.parts):
            if (views is None or p.view in views) and self.manifests[p.view, split]["shards"]:
                sampling = p.sampling if split == "train" else Packed()
                labels = "labels" if self.manifests[p.view, split]["stores_labels"] else None
                made.append((p.view, sampling.windows(self.documents(p.view, split), self.length, labels, epoch, i)))
        if not made:
            raise ValueError(f"no tokens in split {split}")
        return mixture.concat(made, "window_id")

    def batches(self, size: int, split: str = "train", epoch: int = 0, samples: int | None = None) -> DataFrame:
        """(batch_id, place, part, x, y). Training draws with replacement by weight, or where no part has one takes every window
        once in hashed order, and drops a last short batch; validation takes all in order."""
        rows = self.windows(split, epoch)
        if split == "train" and any(p.weight is not None for p in self.parts):
            sizes = {r.part: r.n for r in rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a part
            weighed = [(p.view, sizes.get(p.view, 0), p.weight) for p in self.parts]
            mixture.sampler_weights(self.spark.createDataFrame(weighed, "key string, n long, weight double")).count()
            plan = [(k, n, float(n) if w is None else w) for k, n, w in weighed if n]
            draws = mixture.draws(self.spark, plan, samples or sum(sizes.values()), self.seed, epoch)
            first = rows.groupBy("part").agg(F.min("item").alias("first"))
            picked = draws.join(F.broadcast(first), F.col("key") == F.col("part")).select("draw", (F.col("first") + F.col("item")).alias("item"))
            rows = picked.join(rows, "item").withColumn("order", F.col("draw"))
        elif split == "train":
            rows = rows.withColumn("order", F.xxhash64(F.lit(self.seed * 1_000_003 + epoch), "item"))
        else:
            rows = rows.withColumn("order", F.col("item"))
        made = windows.batches(rows, "order", size, drop_last=split == "train")
        return made.select("batch_id", F.col("order").alias("place"), "part", "x", "y")


def compile_mixture(spark: SparkSession, catalog: Catalog, parts: list[Part], tokenizer: BytePairs | Pretrained, root: str, length: int, add_bos: bool = False, seed: int = 0, shard_tokens: int = 20_000_000) -> TrainingData:
    """Compile all parts' train and validation splits; what is there already is used again."""
    if not parts:
        raise ValueError("a mixture needs a part")
    if any(OBJECTIVES[catalog.view(p.view).objective] for p in parts) and add_bos:
        tokenizer.special_id(SPECIAL_TOKENS[1])
    paths, manifests = {}, {}
    for p in parts:
        for split, most in (("train", p.max_train_tokens), ("validation", p.max_validation_tokens)):
            paths[p.view, split], manifests[p.view, split] = build.compile_view(spark, catalog, p.view, split, tokenizer, root, most, add_bos, shard_tokens=shard_tokens)
    return TrainingData(spark, parts, length, paths, manifests, seed)


def token_counts(data: TrainingData) -> DataFrame:
    """(source, train, validation) of a mixture's tokens."""
    rows = [(v, s, n) for v, of in data.tokens().items() for s, n in of.items()]
    return stats.token_counts(data.spark.createDataFrame(rows, "source string, split string, n long"), "n")


def verify(data: TrainingData) -> None:
    """An error unless all artifacts are there as they were written."""
    for path in data.paths.values():
        artifacts.verify(data.spark, path)
