"""Source rows to documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import in_ranges, prefix_sum
from ..functions.text import path, strip


def text_of(c: Column) -> Column:
    """A value as text; null reads None."""
    return F.coalesce(c.cast("string"), F.lit("None"))


def plain_text(df: DataFrame, columns: tuple[str, ...] = ("text",), join: str = "\n\n", out: str = "text") -> DataFrame:
    """Columns joined; empty texts go."""
    return df.withColumn(out, F.concat_ws(join, *[text_of(path(c)) for c in columns])).filter(F.col(out) != "")


def pair_text(df: DataFrame, question: str, answer: str, prefixes: tuple[str, str] = ("Question: ", "Answer: "), out: str = "text") -> DataFrame:
    """Question and answer on two lines; never drops."""
    return df.withColumn(out, F.concat(F.lit(prefixes[0]), text_of(path(question)), F.lit("\n" + prefixes[1]), text_of(path(answer))))


def joined_pair(df: DataFrame, left: str, right: str, join: str = "\n\n", out: str = "text") -> DataFrame:
    return df.withColumn(out, F.concat(text_of(path(left)), F.lit(join), text_of(path(right))))


def passages(df: DataFrame, ordinal: str, context: str = "context", question: str = "question", answer: str = "answer") -> DataFrame:
    """(first, n, text): consecutive rows of equal context are one document; a context that comes again later starts a new one.

    A row's predecessor is looked up by a window within ranges of the ordinal and over their edges, so no task gets all rows.
    """
    lagged = F.lag(context).over(Window.partitionBy("_p").orderBy(ordinal))
    rows = in_ranges(df, ordinal, "_p")
    ends = rows.groupBy("_p").agg(F.max_by(context, ordinal).alias("_last"), F.min(ordinal).alias("_first"))
    ends = ends.select("_first", F.lag("_last").over(Window.orderBy("_p")).alias("_before"))
    rows = rows.withColumn("_prev", lagged).join(F.broadcast(ends), F.col(ordinal) == F.col("_first"), "left")
    start = (~F.col(context).eqNullSafe(F.coalesce(F.col("_before"), F.col("_prev")))).cast("int")
    rows = prefix_sum(rows.withColumn("_new", start).drop("_p", "_first", "_before", "_prev"), "_new", ordinal, end="_island")
    qa = F.concat(F.lit("Question: "), F.col(question), F.lit("\nAnswer: "), F.col(answer))
    told = F.transform(F.array_sort(F.collect_list(F.struct(F.col(ordinal).alias("o"), qa.alias("qa")))), lambda x: x["qa"])
    return rows.groupBy("_island").agg(F.min(ordinal).alias("first"), F.count(F.lit(1)).alias("n"), F.concat_ws("\n\n", F.first(context), told).alias("text")).drop("_island")


def _zip(a: Column, b: Column) -> Column:
    """Pairs up to the shorter array's end."""
    n = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: F.struct(x.alias("q"), y.alias("a")))


def story_questions(df: DataFrame, story: str, questions: str, answers: str, out: str = "text") -> DataFrame:
    """A story, then its question and answer pairs, up to the shorter list's end."""
    pairs = F.transform(_zip(path(questions), path(answers)), lambda p: F.concat(F.lit("Question: "), p["q"], F.lit("\nAnswer: "), p["a"]))
    return df.withColumn(out, F.concat_ws("\n\n", path(story), pairs))


def _message(role: str | Column, content: Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"), content.alias("content"))


def message_list(df: DataFrame, column: str = "messages") -> DataFrame:
    """Rows whose list of messages isn't empty."""
    return df.filter(F.size(column) > 0)


def single_turn(df: DataFrame, question: str, answer: str, context: str | None = None, out: str = "messages") -> DataFrame:
    q = text_of(path(question)) if context is None else F.concat(text_of(path(context)), F.lit("\n\n"), text_of(path(question)))
    return df.withColumn(out, F.array(_message("user", q), _message("assistant", text_of(path(answer)))))


def conversational_qa(df: DataFrame, context: str, questions: str, answers: str, cannot_answer: str | None = None, refusal: str = "I don't know based on the passage.", out: str = "messages") -> DataFrame:
    """Pairs of turns; the first question comes after the context, and unanswerable ones get a refusal. Without pairs no row."""

    def turns(p: Column, i: Column) -> Column:
        a = F.when(strip(p["a"]) == cannot_answer, F.lit(refusal)).otherwise(p["a"]) if cannot_answer else p["a"]
        return F.array(_message("user", F.when(i == 0, F.concat(path(context), F.lit("\n\n"), p["q"])).otherwise(p["q"])), _message("assistant", a))

    return df.withColumn(out, F.flatten(F.transform(_zip(path(questions), path(answers)), turns))).filter(F.size(out) > 0)


def alternating(df: DataFrame, column: str = "dialogue", out: str = "messages") -> DataFrame:
    """Roles by a text's place in the whole list; then blank texts go, and rows without any left."""
    turns = F.transform(F.col(column), lambda t, i: _message(F.when(i % 2 == 0, "user").otherwise("assistant"), t))
    return df.withColumn(out, F.filter(turns, lambda m: strip(m["content"]) != "")).filter(F.size(out) > 0)


def reply_trees(df: DataFrame, ordinal: str, max_depth: int = 10_000) -> DataFrame:
    """(root, messages): from each root of the reviewed English messages, the best-ranked reply of each, and so on.

    A message whose parent isn't among them is a root. Best is the least rank, null last, ties in input order. Paths of one
    message go. Each round takes all trees a level deeper, by joins.
    """
    kept = df.filter((F.col("lang") == "en") & F.coalesce(F.col("review_result"), F.lit(False)))
    ids = kept.select(F.col("message_id").alias("_id"))
    roots = kept.join(ids, F.col("parent_id") == F.col("_id"), "left_anti")
    best = Window.partitionBy("parent_id").orderBy(F.col("rank").asc_nulls_last(), ordinal)
    replies = kept.withColumn("_k", F.row_number().over(best)).filter("_k = 1 and parent_id is not null").select(F.col("parent_id").alias("_parent"), "message_id", "role", "text")
    level = roots.select(F.col("message_id").alias("root"), "message_id", "role", "text", F.lit(0).alias("depth"))
    every = level
    for depth in range(1, max_depth):
        level = level.select("root", F.col("message_id").alias("_at")).join(replies, F.col("_at") == F.col("_parent")).select("root", "message_id", "role", "text", F.lit(depth).alias("depth"))
        if level.isEmpty():
            break
        every = every.unionByName(level)
    said = F.when(F.col("role") == "prompter", "user").otherwise("assistant")
    path_ = F.array_sort(F.collect_list(F.struct("depth", said.alias("role"), F.col("text").alias("content"))))
    return every.groupBy("root").agg(F.transform(path_, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages")).filter(F.size("messages") >= 2)


def math_text(df: DataFrame, out: str = "text") -> DataFrame:
    """Problem and solution, by their other names where the first are null or empty."""
    first = lambda *names: F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names if n in df.columns], F.lit(""))
    return df.withColumn(out, F.concat(F.lit("Problem:\n"), first("problem", "question"), F.lit("\n\nSolution:\n"), first("generated_solution", "solution")))


def any_text(df: DataFrame, out: str = "text") -> DataFrame:
    """The first of text, content and markdown that is there, else the longest of the text columns."""
    names = [c for c, t in df.dtypes if t == "string"]
    known = [F.nullif(F.col(c), F.lit("")) for c in ("text", "content", "markdown") if c in names]
    longest = F.array_max(F.array(*[F.struct(F.length(c).alias("n"), F.lit(-i).alias("i"), F.col(c).alias("t")) for i, c in enumerate(names)]))["t"]
    return df.withColumn(out, F.coalesce(*known, longest))


def preview(messages: Column, tools: Column | None = None) -> Column:
    """Turns as <role> and content, blank lines between, after the tools if any."""
    turns = F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<"), m["role"], F.lit(">\n"), m["content"])), "\n\n")
    return turns if tools is None else F.concat_ws("\n\n", F.when(tools != "", F.concat(F.lit("<tools>\n"), tools)), turns)
