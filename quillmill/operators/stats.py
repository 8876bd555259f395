"""Statistics of corpora and evaluations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LN2 = math.log(2)


def compression(df: DataFrame, text: str, tokens: Column, by: str) -> DataFrame:
    """Characters and bytes a token by source and, under TOTAL, of all; sums over sums, three decimals."""
    rows = df.select(F.col(by).alias("key"), F.length(text).alias("c"), F.octet_length(text).alias("b"), tokens.alias("t"))
    agg = rows.rollup("key").agg(F.sum("c").alias("chars"), F.sum("b").alias("bytes"), F.sum("t").alias("tokens"))
    return agg.select(F.coalesce("key", F.lit("TOTAL")).alias("key"), "tokens", F.round(F.col("chars") / F.col("tokens"), 3).alias("chars_per_token"), F.round(F.col("bytes") / F.col("tokens"), 3).alias("bytes_per_token"))


def line_lengths(df: DataFrame, text: str, bounds: tuple[int, ...] = (512, 2048, 8192)) -> DataFrame:
    """Mean, 95th percentile by rank and shares under bounds of the lengths of non-empty lines."""
    rows = df.select(F.explode(F.split(text, "\n")).alias("line")).filter("line <> ''").select(F.length("line").alias("n"))
    counts = rows.groupBy("n").agg(F.count(F.lit(1)).alias("k"))  # different lengths are few
    up = F.sum("k").over(Window.orderBy("n"))
    total = F.sum("k").over(Window.partitionBy())
    ranked = counts.select("n", "k", up.alias("up"), total.alias("total"))
    at = F.least(F.col("total") - 1, F.floor(F.col("total") * 0.95))
    p95 = F.min(F.when(F.col("up") > at, F.col("n")))
    return ranked.agg(F.sum("k").alias("lines"), F.round(F.sum(F.col("n") * F.col("k")) / F.sum("k"), 1).alias("mean"), p95.alias("p95"), *[F.round(F.sum(F.when(F.col("n") <= b, F.col("k")).otherwise(0)) / F.sum("k"), 4).alias(f"within_{b}") for b in bounds])


def vocabulary_use(df: DataFrame, ids: str, size: int) -> DataFrame:
    used = df.select(F.explode(F.array_distinct(F.col(ids))).alias("t")).distinct().agg(F.count(F.lit(1)).alias("used"))
    return used.withColumn("utilization", F.round(F.col("used") / size, 4))


def quantiles(df: DataFrame, value: Column, by: str) -> DataFrame:
    """Mean, and exact percentiles with linear interpolation, by key."""
    rows = df.select(F.col(by).alias("key"), value.alias("v"))
    p = F.percentile("v", F.array(*[F.lit(x) for x in (0.1, 0.5, 0.9, 0.99)]))
    agg = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), p.alias("p"), F.min("v").alias("least"), F.max("v").alias("most"))
    return agg.select("key", "n", F.round("mean", 6).alias("mean"), *[F.round(F.col("p")[i], 6).alias(name) for i, name in enumerate(("p10", "p50", "p90", "p99"))], "least", "most")


def log_histogram(df: DataFrame, value: Column, low: float, high: float, bins: int = 40) -> DataFrame:
    """(bin, n) over bins of equal width in log10, from 0; values outside go to the first and last."""
    at = F.floor((F.log10(value) - math.log10(low)) / ((math.log10(high) - math.log10(low)) / bins))
    return df.filter(value > 0).select(F.least(F.lit(bins - 1).cast("long"), F.greatest(F.lit(0).cast("long"), at)).alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def bits_per_byte(nats: Column, bytes_per_token: Column) -> Column:
    return nats / (LN2 * bytes_per_token)


def nll_summary(df: DataFrame, nll: str, size: str, by: str) -> DataFrame:
    return df.groupBy(by).agg((F.sum(nll) / F.sum(size) / LN2).alias("bpb"))


def request_scores(requests: DataFrame, tokens: DataFrame) -> DataFrame:
    """(request, logprob, greedy): sums and conjunctions over a request's tokens; without tokens 0 and true."""
    agg = tokens.groupBy("request").agg(F.sum("logprob").alias("s"), F.bool_and("greedy").alias("g"))
    return requests.join(agg, "request", "left").select("request", F.coalesce("s", F.lit(0.0)).alias("logprob"), F.coalesce("g", F.lit(True)).alias("greedy"))


def headline(results: DataFrame, preference: tuple[str, ...] = ("acc_norm", "acc", "perplexity")) -> DataFrame:
    """(task, metric, value): of each task the first metric of the preference, else the first listed; errors and texts don't count."""
    rows = results.filter(~F.col("metric").endswith("_stderr") & (F.col("metric") != "alias") & F.col("value").isNotNull())
    order = F.coalesce(F.array_position(F.array(*[F.lit(p) for p in preference]), F.col("metric")), F.lit(0))
    k = F.row_number().over(Window.partitionBy("task").orderBy(F.when(order == 0, 99).otherwise(order), "ordinal"))
    return rows.withColumn("_k", k).filter("_k = 1").select("task", "metric", "value")


def results_table(found: DataFrame, chance: DataFrame, reference: DataFrame) -> DataFrame:
    """Values, percents unless a perplexity, beside chance and a reference; best marks the better of the two."""
    rows = found.join(chance, "task", "left").join(reference, "task", "left")
    ppl = F.col("metric") == "perplexity"
    value = F.when(ppl, F.col("value")).otherwise(F.col("value") * 100)
    best = F.when(F.col("reference").isNull(), None).when(ppl, value <= F.col("reference")).otherwise(value >= F.col("reference"))
    return rows.select("task", "metric", value.alias("value"), "chance", "reference", best.alias("best"))


def weighted_mean(df: DataFrame, value: str, weight: str) -> DataFrame:
    return df.agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("weighted"), F.avg(value).alias("plain"))


def listing(sources: DataFrame, views: DataFrame) -> DataFrame:
    """(source, pin, views): source@revision cut to 12 signs, and its sorted views, - without any."""
    names = views.groupBy("source").agg(F.array_join(F.array_sort(F.collect_list("view")), ", ").alias("views"))
    return sources.join(names, "source", "left").select("source", F.concat(F.col("repo"), F.lit("@"), F.substring("revision", 1, 12)).alias("pin"), F.coalesce("views", F.lit("-")).alias("views"))


def loss_of(bpb: Column, bytes_per_token: Column) -> Column:
    """The inverse of bits_per_byte()."""
    return bpb * (LN2 * bytes_per_token)


def masked_bytes(df: DataFrame, text: str, tokens: str, supervised: Column, by: str) -> DataFrame:
    """(key, tokens, bytes_per_token) of the rows that are supervised alone; sums over sums."""
    rows = df.filter(supervised).groupBy(F.col(by).alias("key")).agg(F.sum(tokens).alias("tokens"), F.sum(F.octet_length(text)).alias("bytes"))
    return rows.select("key", "tokens", F.round(F.col("bytes") / F.col("tokens"), 6).alias("bytes_per_token"))


def source_totals(sources: DataFrame) -> DataFrame:
    """(key, start, finish, bytes_per_token) of sources (ordinal, key, tokens, bytes) whose tokens lie one after the other in that
    order, and under TOTAL of all: sums over sums. Sources without tokens have no ratio; a source is a row, so these are few."""
    end = F.sum("tokens").over(Window.orderBy("ordinal"))
    each = sources.select("key", (end - F.col("tokens")).alias("start"), end.alias("finish"), F.when(F.col("tokens") > 0, F.col("bytes") / F.col("tokens")).alias("bytes_per_token"))
    every = sources.filter("tokens > 0").agg(F.lit("TOTAL").alias("key"), F.lit(0).cast("long").alias("start"), F.sum("tokens").alias("finish"), (F.sum("bytes") / F.sum("tokens")).alias("bytes_per_token"))
    return each.unionByName(every)


def recall(trials: DataFrame) -> DataFrame:
    """(distance, n, recall) of trials (distance, target, predicted): how often the target was predicted."""
    hit = (F.col("target") == F.col("predicted")).cast("int")
    return trials.groupBy("distance").agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce(hit, F.lit(0))).alias("recall"))


def token_counts(documents: DataFrame, size: str, source: str = "source", split: str = "split") -> DataFrame:
    """(source, train, validation): tokens of each source's splits."""
    of = lambda name: F.coalesce(F.sum(F.when(F.col(split) == name, F.col(size))), F.lit(0)).cast("long").alias(name)
    return documents.groupBy(source).agg(of("train"), of("validation"))


def staging_summary(staged: DataFrame) -> DataFrame:
    """(sources, rows, bytes, est_tokens, pretrain_tokens) of staged sources; those of weight 0 don't count as pretraining."""
    return staged.agg(F.count(F.lit(1)).alias("sources"), F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"), F.sum("est_tokens").alias("est_tokens"), F.coalesce(F.sum(F.when(F.col("weight") > 0, F.col("est_tokens"))), F.lit(0)).alias("pretrain_tokens"))


def banded_bits(windows: DataFrame, documents: DataFrame, widths: tuple[int, ...] = (512, 2048, 4096, 8192)) -> DataFrame:
    """(width, documents, scored, bpb): bits per byte of documents (key, size, bytes) that have so many tokens.

    windows: (key, width, scored, nll), what scoring the windows that band_windows() gives has summed up.
    """
    bands = documents.withColumn("width", F.explode(F.array(*[F.lit(w) for w in widths]))).filter(F.col("size") >= F.col("width"))
    scored = windows.groupBy("key", "width").agg(F.sum("nll").alias("nll"), F.sum("scored").alias("scored"))
    rows = bands.join(scored, ["key", "width"])
    return rows.groupBy("width").agg(F.count(F.lit(1)).alias("documents"), F.sum("scored").alias("scored"), (F.sum("nll") / F.sum("bytes") / F.lit(LN2)).alias("bpb"))
