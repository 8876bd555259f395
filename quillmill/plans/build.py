"""Builds: documents of views to token artifacts, and tokenizers of several sizes with their report."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.chat import IGNORE, SPECIAL_TOKENS
from ..functions.ordered import prefix_sum
from ..operators import artifacts, selection, stats
from ..operators.tokenizer import BytePairs, Pretrained, encode_column, word_counts
from ..sources.registry import OBJECTIVES, Catalog

#: What a tokenizer must give back as it was.
PROBES = ["Hello, world!", "  two  spaces ", "tab\tand\nlines\n\n", "3.14159 + 2,718 = ?", "naïve café, Größe, 東京", "def f(x):\n    return x ** 2", "🙂👍🏽 é"]


def token_documents(examples: DataFrame, tokenizer: BytePairs, bos: int | None = None, eos: int | None = None, labelled: bool = False) -> DataFrame:
    """(ordinal, ids, and labels if asked for) of (ordinal, segments): each segment is encoded on its own, between the marks."""
    shared = examples.sparkSession.sparkContext.broadcast(tokenizer)

    def run(batches):
        import pyarrow as pa

        ids_of = shared.value.encode
        for batch in batches:
            ids, labels = [], []
            for row in batch.column(1).to_pylist():
                pieces = [(ids_of(s["text"] or ""), s["supervised"]) for s in row or []]
                marks = [[m] if m is not None else [] for m in (bos, eos)]
                ids.append(marks[0] + [i for piece, _ in pieces for i in piece] + marks[1])
                labels.append([IGNORE] * len(marks[0]) + [i if own else IGNORE for piece, own in pieces for i in piece] + [IGNORE] * len(marks[1]))
            kind = pa.list_(pa.int32())
            columns = [batch.column(0).cast(pa.int64()), pa.array(ids, kind)] + ([pa.array(labels, kind)] if labelled else [])
            yield pa.RecordBatch.from_arrays(columns, ["ordinal", "ids", "labels"][: len(columns)])

    # a step of its own rather than a function of a column, whose argument could be as large an expression as an adapter makes
    return examples.select("ordinal", "segments").mapInArrow(run, "ordinal long, ids array<int>" + (", labels array<int>" if labelled else ""))


def cap(docs: DataFrame, tokens: int | None, bos: int | None = None, eos: int | None = None) -> DataFrame:
    """Token documents up to a number of tokens. A first one that is longer is cut so that its marks still fit."""
    if tokens is None:
        return docs
    labelled = "labels" in docs.columns
    kept = selection.cap_documents(docs.withColumn("_n", F.size("ids")), "_n", "ordinal", tokens).withColumn("kept", F.greatest(F.lit(0), F.col("kept").cast("int")))
    head = 0 if bos is None else 1
    room = F.greatest(F.lit(0), F.col("kept") - head - (0 if eos is None else 1))
    cut = F.slice("ids", F.lit(1), room + head)
    ids = F.slice(F.concat(cut, F.array(F.lit(eos))) if eos is not None else cut, F.lit(1), F.col("kept"))
    if eos is not None:
        ids = F.concat(F.slice(ids, F.lit(1), F.greatest(F.lit(0), F.size(ids) - 1)), F.array(F.lit(eos)))
    long = F.col("kept") < F.col("_n")
    out = kept.withColumn("_ids", F.when(long, ids).otherwise(F.col("ids")))
    if labelled:
        labels = F.concat(F.slice("labels", F.lit(1), F.greatest(F.lit(0), F.size("_ids") - 1)), F.array(F.lit(IGNORE)))
        out = out.withColumn("labels", F.when(long, labels).otherwise(F.col("labels")))
    return out.select("ordinal", F.col("_ids").alias("ids"), *(["labels"] if labelled else []))


def compile_documents(examples: DataFrame, path: str, descriptor: dict, tokenizer: BytePairs, max_tokens: int | None = None, bos: int | None = None, eos: int | None = None, objective: str = "next-token", shard_tokens: int = 20_000_000) -> dict:
    """Write an artifact of (ordinal, segments) and return its manifest; one that is there is a hit. Texts are encoded once, into a staging table."""
    spark = examples.sparkSession
    if (found := artifacts.read_manifest(spark, path)) is not None:
        return found
    if objective not in OBJECTIVES:
        raise ValueError(f"unknown objective: {objective}")
    labelled = OBJECTIVES[objective]
    docs = token_documents(examples, tokenizer, bos, eos, labelled)
    docs.write.mode("overwrite").parquet(f"{path}/staging")
    capped = cap(spark.read.parquet(f"{path}/staging"), max_tokens, bos, eos)
    made = artifacts.write(capped, path, descriptor, shard_tokens, tokenizer.vocab_size, labelled)
    artifacts.remove(spark, f"{path}/staging")
    return made


def compile_view(spark: SparkSession, catalog: Catalog, key: str, split: str, tokenizer: BytePairs, root: str, max_tokens: int | None = None, add_bos: bool = False, add_eos: bool = True, files=None, shard_tokens: int = 20_000_000) -> tuple[str, dict]:
    """(directory, manifest) of a view: the directory follows from all that decides the content."""
    view = catalog.view(key)
    bos, eos = (tokenizer.special_id(t) if on else None for t, on in ((SPECIAL_TOKENS[1], add_bos), (SPECIAL_TOKENS[0], add_eos)))
    lock = catalog.lock.get(view.source, {})
    descriptor = {
        "schema": 3, "view": key, "source": view.source, "repo": catalog.source(view.source).path, "revision": lock.get("revision"), "files": files or lock.get("files"), "split": split,
        "adapter": [view.adapter, view.options], "objective": view.objective, "tokenizer": tokenizer.fingerprint, "max_tokens": max_tokens, "bos": bos, "eos": eos, "shard_tokens": shard_tokens,
    }
    path = artifacts.directory(root, key, descriptor)
    if (found := artifacts.read_manifest(spark, path)) is not None:
        return path, found
    examples = catalog.documents(spark, key, split, files)
    return path, compile_documents(examples, path, descriptor, tokenizer, max_tokens, bos, eos, view.objective, shard_tokens)


def corpus(spark: SparkSession, catalog: Catalog, keys: list[str], chars: int, weights: dict[str, float] | None = None) -> DataFrame:
    """(source_view, ordinal, text) to train a tokenizer on: of each eligible view documents until its share of the characters is
    reached, equal shares or by weight. Views that are excluded from tokenizers give none; without any left that is an error."""
    eligible = [k for k in keys if not catalog.view(k).exclude_from_tokenizer]
    if not eligible:
        raise ValueError("no eligible tokenizer source")
    total = sum(weights[k] for k in eligible) if weights else 0
    out = None
    for k in eligible:
        share = int(chars * weights[k] / total) if weights else max(1, chars // len(eligible))
        rows = catalog.documents(spark, k, "train").withColumn("n", F.length("text").cast("long"))
        rows = selection.cap_inclusive(rows, "n", "ordinal", share).select(F.lit(k).alias("source_view"), "ordinal", "text", "n", F.lit(share).alias("requested"))
        out = rows if out is None else out.unionByName(rows)
    return out


def corpus_meta(rows: DataFrame) -> DataFrame:
    """(source_view, requested, chars, documents): what was asked for and what came."""
    return rows.groupBy("source_view", "requested").agg(F.sum("n").alias("chars"), F.count(F.lit(1)).alias("documents"))


def held_out_text(df: DataFrame, ordinal: str, taken: int, chars: int) -> DataFrame:
    """(ordinal, text): the documents after the first `taken` characters, the text cut where they sum up to `chars`."""
    rows = selection.held_out_after(df.withColumn("n", F.length("text").cast("long")), "n", ordinal, taken, chars)
    rows = prefix_sum(rows.withColumn("_n1", F.col("n") + 1), "_n1", ordinal, end="_e")  # a line end between documents counts
    room = F.least(F.col("n"), F.lit(chars) - (F.col("_e") - F.col("_n1")))
    return rows.filter(room > 0).select(ordinal, F.substring(F.col("text"), F.lit(1), room.cast("int")).alias("text"))


#: Different words that a tokenizer is trained on at most; a corpus with more is to be capped by corpus().
MOST_WORDS = 20_000_000


def counted_words(rows: DataFrame) -> list[tuple[str, int]]:
    """The words of a capped corpus with their counts, in order; an error where they are too many for one place."""
    counts = word_counts(rows).limit(MOST_WORDS + 1).collect()
    if len(counts) > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} different words: cap the corpus")
    return sorted((r.word, r.n) for r in counts)


def tokenizer_path(root: str, sources: dict, mode: str, size: int, chars: int) -> str:
    """Where a trained tokenizer belongs: sources (with their revisions), mode, size and sample decide it."""
    return f"{root}/tokenizer-{artifacts.content_hash({'sources': sources, 'mode': mode, 'size': size, 'chars': chars})}.json"


def resolve(spark: SparkSession, rows: DataFrame | None, size: int, pinned: str | None = None, specials: list[str] = SPECIAL_TOKENS, pretrained: str | None = None, path: str | None = None) -> BytePairs | Pretrained:
    """The tokenizer of a pinned file, which must be there, a pretrained one of a public file, or one trained on (text); with a
    path, which tokenizer_path() gives, that is written there, and what is there already is taken."""
    if pretrained is not None:
        return Pretrained(pretrained)
    if pinned is not None:
        return BytePairs.from_json(artifacts.read_text(spark, pinned))
    if path is not None and artifacts.exists(spark, path):
        return BytePairs.from_json(artifacts.read_text(spark, path))
    made = BytePairs.train(counted_words(rows), size, specials)
    if path is not None:
        artifacts._write_text(spark, path, made.to_json())
    return made


def report(held_out: DataFrame, tokenizer: BytePairs) -> dict:
    """How a tokenizer does on (ordinal, text): compression, lines, use of the vocabulary, probes and special tokens."""
    encode = encode_column(held_out.sparkSession, tokenizer)
    rows = held_out.select("text", encode("text").alias("ids"))
    sums = rows.agg(F.sum(F.length("text")).alias("c"), F.sum(F.octet_length("text")).alias("b"), F.sum(F.size("ids")).alias("t")).first()
    use = stats.vocabulary_use(rows, "ids", tokenizer.vocab_size).first()
    lines = held_out.select(F.explode(F.split("text", "\n")).alias("text")).filter("text <> ''").select(F.size(encode("text")).alias("n"))
    return {
        "vocab_size": tokenizer.vocab_size, "chars_per_token": round(sums.c / sums.t, 3) if sums.t else None, "bytes_per_token": round(sums.b / sums.t, 3) if sums.t else None,
        "utilization": use.utilization, "tokens_per_line": lines.agg(F.avg("n")).first()[0],
        "round_trip": all(tokenizer.decode(tokenizer.encode(p)) == p for p in PROBES), "atomic": all(tokenizer.encode(s) == [i] for i, s in enumerate(tokenizer.specials)),
    }


def suite(spark: SparkSession, train: DataFrame, held_out: DataFrame, sizes: list[int], specials: list[str] = SPECIAL_TOKENS) -> dict[str, tuple[BytePairs, dict]]:
    """Tokenizers of several sizes from one corpus, whose words are counted once, each with its report, under tags such as 8k."""
    if max(sizes) > 65_535:
        raise ValueError("vocabulary sizes must fit 16 bits")
    counts = counted_words(train)
    most = BytePairs.train(counts, max(sizes), specials)
    made = {}
    for size in sorted(sizes):  # merges of a smaller size are the first ones of the largest
        t = BytePairs(most.merges[: max(0, size - 256 - len(specials))], specials)
        made[f"{size // 1000}k" if size >= 1000 else str(size)] = (t, report(held_out, t))
    return made


def same_tokenizer(sources: list[dict]) -> dict:
    """The first source's tokenizer settings, which those of all must equal: seq_len, add_bos, add_eos."""
    if not sources:
        raise ValueError("no sources")
    for key in ("seq_len", "add_bos", "add_eos"):
        if len({json.dumps(s.get(key)) for s in sources}) > 1:
            raise ValueError(f"sources differ in {key}")
    return sources[0]


def request_pairs(df: DataFrame, tokenizer: BytePairs, context: str, answer: str, prefix: int, bos: int | None = None) -> DataFrame:
    """df with context_ids and answer_ids of evaluation requests.

    White space at a context's end goes to the answer, whose tokens are those of both texts after as many as the context has; bos
    comes before the context. An empty context is the prefix token, which an answer that begins with it gives itself.
    """
    shared = df.sparkSession.sparkContext.broadcast(tokenizer)

    def one(c: str, a: str) -> tuple[list[int], list[int]]:
        encode = shared.value.encode
        if not c:
            ids = encode(a)
            return (ids[:1], ids[1:]) if ids[:1] == [prefix] else ([prefix], ids)
        head = encode(c.rstrip())
        return ([] if bos is None else [bos]) + head, encode(c + a)[len(head) :]

    def run(contexts, answers):
        import pyarrow as pa

        made = [one(c or "", a or "") for c, a in zip(contexts.to_pylist(), answers.to_pylist(), strict=True)]
        return pa.array([{"c": c, "a": a} for c, a in made], pa.struct([("c", pa.list_(pa.int32())), ("a", pa.list_(pa.int32()))]))

    pair = F.arrow_udf(run, "struct<c array<int>, a array<int>>")(F.col(context), F.col(answer))
    return df.withColumn("_pair", pair).withColumns({"context_ids": F.col("_pair.c"), "answer_ids": F.col("_pair.a")}).drop("_pair")


def valid_tags(tags, subjects: list[str], formats: list[str]):
    """Whether an array of tags holds 1 to 4 different known ones, a subject first, at most three subjects and one format; null is not."""
    known = lambda names: F.size(F.array_intersect(tags, F.array(*map(F.lit, names))))
    fits = (F.size(tags) == F.size(F.array_distinct(tags))) & F.size(tags).between(1, 4) & (known([*subjects, *formats]) == F.size(tags))
    return F.coalesce(fits & F.coalesce(F.get(tags, F.lit(0)).isin(subjects), F.lit(False)) & (known(subjects) <= 3) & (known(formats) <= 1), F.lit(False))
