"""Views of sources: which rows, as which documents, with which labels."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chat, messages
from ..functions.text import path
from ..operators import adapters, selection
from .catalog import Source, check_selection, local_documents, require_lock


@dataclass(frozen=True)
class NativeSplit:
    """A column names the split of each row."""

    names: dict[str, str] = field(default_factory=lambda: {"train": "train", "validation": "validation"})
    column: str = "split"

    def apply(self, df: DataFrame, split: str, ordinal: str) -> DataFrame:
        return selection.native_split(df, split, self.names, self.column)


@dataclass(frozen=True)
class CarvedSplit:
    """The head's whole percents are for validation."""

    fraction: float = 0.01

    def apply(self, df: DataFrame, split: str, ordinal: str) -> DataFrame:
        if split not in ("train", "validation"):
            raise ValueError(f"unknown split: {split}")
        return selection.carve(df, ordinal, self.fraction, "_split").filter(F.col("_split") == split).drop("_split")


def _text(df: DataFrame) -> DataFrame:
    return df.withColumn("segments", F.array(F.struct(F.col("text").alias("text"), F.lit(True).alias("supervised"))))


def _chat(df: DataFrame, full: bool = False) -> DataFrame:
    return df.filter(F.size("messages") > 0).withColumn("segments", chat.segments(F.col("messages"), full=full))


def _rooted(df: DataFrame, ordinal: str) -> DataFrame:
    """The paths of reply trees, each with the ordinal of its root."""
    roots = df.select(F.col("message_id").alias("root"), F.col(ordinal))
    return adapters.reply_trees(df, ordinal).join(roots, "root")


#: Adapters by name: a frame of source rows and options to one with segments.
ADAPTERS: dict[str, Callable[..., DataFrame]] = {
    "plain": lambda df, columns=("text",), join="\n\n": _text(adapters.plain_text(df, tuple(columns), join)),
    "pair": lambda df, question="question", answer="answer": _text(adapters.pair_text(df, question, answer)),
    "joined": lambda df, left="left", right="right": _text(adapters.joined_pair(df, left, right)),
    "math": lambda df: _text(adapters.math_text(df)),
    "any": lambda df: _text(adapters.any_text(df).filter("text <> ''")),
    "story": lambda df, story="story", questions="questions", answers="answers.input_text": _text(adapters.story_questions(df, story, questions, answers)),
    "passages": lambda df, ordinal="ordinal", context="context", question="question", answer="answer": _text(adapters.passages(df.withColumn("_a", path(answer)), ordinal, context, question, "_a").withColumnRenamed("first", ordinal)),
    "single_turn": lambda df, question="question", answer="answer", context=None: _chat(adapters.single_turn(df, question, answer, context)),
    "conversational_qa": lambda df, context="context", questions="questions", answers="answers", cannot_answer=None: _chat(adapters.conversational_qa(df, context, questions, answers, cannot_answer)),
    "alternating": lambda df, column="dialogue": _chat(adapters.alternating(df, column)),
    "turns": lambda df, column="messages": _chat(df.withColumn("messages", F.col(column))),
    "reply_trees": lambda df, ordinal="ordinal": _chat(_rooted(df, ordinal)),
    "messages": lambda df, column="messages": _chat(messages.normalize(df, column), True),
}
#: Objectives by name: whether labels are kept.
OBJECTIVES = {"next-token": False, "assistant-only": True}


@dataclass(frozen=True)
class View:
    """Documents of a source. ordinal: the unique integer column that gives their order."""

    key: str
    source: str
    adapter: str = "plain"
    options: dict = field(default_factory=dict)
    objective: str = "next-token"
    ordinal: str = "ordinal"
    unit: str = "doc"
    exclude_from_tokenizer: bool = False
    split: NativeSplit | CarvedSplit | None = None


@dataclass(frozen=True)
class Catalog:
    """Sources and views by key, and the lock of the sources."""

    sources: dict[str, Source]
    views: dict[str, View]
    lock: dict = field(default_factory=dict)
    splits: dict[str, NativeSplit | CarvedSplit] = field(default_factory=dict)

    @classmethod
    def from_json(cls, text: str) -> Catalog:
        """{"sources": {key: {path, format, files, license}}, "views": {key: {source, adapter, options, objective, ordinal,
        carve}}, "lock": {key: {repo, revision, files}}}; carve is the share of the head for validation."""
        data = json.loads(text)
        sources = {k: Source(key=k, **s) for k, s in data["sources"].items()}
        views = {k: View(key=k, split=CarvedSplit(v["carve"]) if "carve" in v else None, **{n: x for n, x in v.items() if n != "carve"}) for k, v in data["views"].items()}
        return cls(sources, views, data.get("lock", {}))

    def view(self, key: str) -> View:
        if key not in self.views:
            raise KeyError(f"unknown text view {key!r}")
        return self.views[key]

    def source(self, key: str) -> Source:
        if key not in self.sources:
            raise KeyError(f"unknown text source {key!r}")
        return self.sources[key]

    def inspect(self, key: str) -> dict:
        """The view, if the key is one's, its source and the source's lock; else the source and its lock."""
        if key not in self.views and key not in self.sources:
            raise KeyError(f"unknown text source or view: {key}")
        found = {"view": self.views[key]} if key in self.views else {}
        source = self.source(self.views[key].source if key in self.views else key)
        return found | {"source": source, "lock": require_lock(self.lock, source.key, source.path)}

    def rows(self, spark: SparkSession, key: str, split: str, files=None) -> DataFrame:
        """Source rows of a view and a logical split, each with its ordinal; the view's split goes before the source's."""
        view = self.view(key)
        source = self.source(view.source)
        if files is not None:
            check_selection(files, self.lock.get(view.source, {}).get("files", []))
        df = source.select(files).read(spark)
        policy = view.split or self.splits.get(view.source) or (NativeSplit() if "split" in df.columns else CarvedSplit())
        return policy.apply(df, split, view.ordinal)

    def documents(self, spark: SparkSession, key: str, split: str, files=None) -> DataFrame:
        """(ordinal, segments, text) of a view's documents."""
        view = self.view(key)
        made = ADAPTERS[view.adapter](self.rows(spark, key, split, files), **view.options)
        text = F.array_join(F.transform("segments", lambda s: s["text"]), "")
        return made.select(F.col(view.ordinal).cast("long").alias("ordinal"), "segments", text.alias("text"))

    def sample(self, spark: SparkSession, key: str, n: int = 3) -> list[str]:
        """The first n documents' texts."""
        return [r.text for r in self.documents(spark, key, "train").orderBy("ordinal").limit(n).collect()]

    def listing(self, spark: SparkSession) -> DataFrame:
        """(source, pin, views) in order of the source."""
        from ..operators.stats import listing

        pins = [(k, s.path, require_lock(self.lock, k, s.path)["revision"]) for k, s in self.sources.items()]
        views = [(v.source, v.key) for v in self.views.values()]
        return listing(spark.createDataFrame(pins, "source string, repo string, revision string"), spark.createDataFrame(views, "source string, view string")).orderBy("source")

    def locked(self, key: str, revision: str, files: list[str]) -> Catalog:
        """The catalog with a source's lock renewed."""
        return replace(self, lock=self.lock | {key: {"repo": self.source(key).path, "revision": revision, "files": files}})


def local_view(spark: SparkSession, directory: str, glob: str = "*.md", repeat: int = 1, train: bool = True) -> DataFrame:
    """(ordinal, segments, text) of local files, numbered by repetition and path."""
    from pyspark.sql import Window

    rows = local_documents(spark, directory, glob, repeat, train)
    rows = rows.withColumn("n", F.row_number().over(Window.orderBy("ordinal")).cast("long") - 1)  # files of one folder
    return _text(rows).select(F.col("n").alias("ordinal"), "segments", "text")


def supervises(objective: str, segment: Column) -> Column:
    """Whether a segment's tokens are labels."""
    if objective not in OBJECTIVES:
        raise ValueError(f"unknown objective: {objective}")
    return segment["supervised"] if OBJECTIVES[objective] else F.lit(False)
