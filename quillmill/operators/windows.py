"""Training and evaluation windows by interval arithmetic over documents; no token ever is a row of its own."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import hashed, in_ranges, prefix_sum


def spans(df: DataFrame, size: str, ordinal: str) -> DataFrame:
    """df with start and end of each document in the stream of all."""
    return prefix_sum(df, size, ordinal, end="end").withColumn("start", F.col("end") - F.col(size))


def packed(df: DataFrame, ids: str, ordinal: str, length: int, labels: str | None = None) -> DataFrame:
    """(window_id, x, y): max(0, (T - 1) // length) windows of the stream, y a token later than x; the rest is dropped.

    A document gives each window it reaches into a slice; a window gathers its slices, at most length + 1 tokens.
    """
    names = [ids] + ([labels] if labels else [])
    rows = spans(df.withColumn("_n", F.size(ids)), "_n", ordinal).filter("_n > 0")
    at = F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), F.expr(f"(start - 1) div {length}")), F.expr(f"(end - 1) div {length}")))
    rows = rows.select(*names, "start", "end", at.alias("window_id"))
    lo = F.greatest(F.col("start"), F.col("window_id") * length)
    n = F.least(F.col("end"), F.col("window_id") * length + length + 1) - lo
    cut = [F.slice(c, (lo - F.col("start") + 1).cast("int"), n.cast("int")).alias(f"_{i}") for i, c in enumerate(names)]
    parts = rows.filter(n > 0).groupBy("window_id").agg(F.array_sort(F.collect_list(F.struct(lo.alias("lo"), *cut))).alias("p"))
    whole = [_joined("p", i) for i in range(len(names))]
    out = parts.select("window_id", *[w.alias(f"_{i}") for i, w in enumerate(whole)]).filter(F.size("_0") == length + 1)
    return out.select("window_id", F.slice("_0", 1, length).alias("x"), F.slice(f"_{len(names) - 1}", 2, length).alias("y"))


def _joined(column: str, i: int) -> Column:
    return F.flatten(F.transform(column, lambda s: s[f"_{i}"]))


def token_slice(df: DataFrame, ids: str, ordinal: str, start: int, end: int) -> DataFrame:
    """One row with the stream's tokens from start to end; an error for bounds outside the stream."""
    rows = spans(df.withColumn("_n", F.size(ids)), "_n", ordinal)
    total = rows.agg(F.coalesce(F.max("end"), F.lit(0))).first()[0]
    if not 0 <= start <= end <= total:
        raise IndexError("slice out of bounds")
    lo, hi = F.greatest(F.col("start"), F.lit(start)), F.least(F.col("end"), F.lit(end))
    part = F.struct(lo.alias("lo"), F.slice(ids, (lo - F.col("start") + 1).cast("int"), (hi - lo).cast("int")).alias("_0"))
    return rows.filter(lo < hi).agg(F.array_sort(F.collect_list(part)).alias("p")).select(_joined("p", 0).alias("ids"))


def document_windows(df: DataFrame, size: str, key: str, length: int, min_doc: int = 0, most: int = 4, seed: int = 0, epoch: int = 0) -> DataFrame:
    """(key, k, offset): windows of length + 1 tokens within documents that are long enough, at hashed places anew each epoch."""
    rows = df.filter(F.col(size) >= max(length + 1, min_doc)).withColumn("_w", F.greatest(F.lit(1), F.least(F.lit(most), F.floor(F.col(size) / (length + 1)).cast("int"))))
    rows = rows.select(key, size, F.explode(F.sequence(F.lit(0), F.col("_w") - 1)).alias("k"))
    return rows.select(key, "k", F.pmod(hashed(seed * 1_000_003 + epoch, F.col(key), F.col("k")), F.col(size) - length).alias("offset"))


def doc_positions(ids: Column, eos: int) -> Column:
    """array<struct<doc, pos>> of a window: documents count up after each end mark, which belongs to the one it ends."""
    marks = F.filter(F.transform(ids, lambda t, i: F.when(t == eos, i)), lambda i: i.isNotNull())
    first = F.concat(F.array(F.lit(0)), F.transform(marks, lambda m: m + 1))
    last = F.concat(marks, F.array(F.size(ids) - 1))
    found = F.filter(F.zip_with(first, last, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda d: d["a"] <= d["b"])
    return F.flatten(F.transform(found, lambda d, k: F.transform(F.sequence(d["a"], d["b"]), lambda i: F.struct(k.alias("doc"), (i - d["a"]).alias("pos")))))


def attention_pairs(df: DataFrame, key: str, ids: str, eos: int) -> DataFrame:
    """(key, q, k): positions q of a window and the k up to it in the same document."""
    rows = df.select(key, F.posexplode(doc_positions(F.col(ids), eos)).alias("q", "d"))
    return rows.select(key, "q", F.explode(F.sequence(F.col("q") - F.col("d.pos"), F.col("q"))).alias("k"))


def padded(df: DataFrame, ids: str, length: int, batch: int, ignore: int = -100) -> DataFrame:
    """(…, w, x, y): windows of a text without overlap, the last filled up with 0 and ignored labels, and whole batches of them."""
    n = F.ceil((F.size(ids) - 1) / F.lit(length))
    rows = df.filter(F.size(ids) > 1).withColumn("w", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(n / batch) * batch - 1)))
    at = (F.col("w") * length).cast("int")
    have = lambda shift: F.when(at + shift < F.size(ids), F.slice(ids, at + (1 + shift), F.lit(length))).otherwise(F.slice(ids, 1, 0))
    m = F.greatest(F.lit(0), F.least(F.lit(length), F.size(ids) - 1 - at))
    x = F.concat(F.slice(have(0), F.lit(1), m), F.array_repeat(F.lit(0), F.lit(length) - m))
    y = F.concat(F.slice(have(1), F.lit(1), m), F.array_repeat(F.lit(ignore), F.lit(length) - m))
    return rows.withColumn("x", x).withColumn("y", y)


def rolling(df: DataFrame, size: str, length: int, stride: int) -> DataFrame:
    """(…, begin, finish, counted, scored): sliding windows to a text's end; each counts its new tokens. The first scores one fewer."""
    last = F.greatest(F.lit(0).cast("long"), F.ceil((F.col(size) - length) / F.lit(stride)))
    rows = df.filter(F.col(size) > 0).withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    begin = F.col("_k") * stride
    end = F.least(begin + length, F.col(size).cast("long"))
    before = F.when(F.col("_k") > 0, F.least(begin - stride + length, F.col(size).cast("long"))).otherwise(0)
    rows = rows.withColumns({"begin": begin, "finish": end, "counted": end - F.greatest(begin, before)})
    return rows.withColumn("scored", F.col("counted") - (F.col("_k") == 0).cast("int")).drop("_k")


def length_bands(df: DataFrame, size: str, widths: tuple[int, ...] = (512, 2048, 4096, 8192)) -> DataFrame:
    """(width, documents, tokens) of the documents that have so many tokens."""
    rows = df.withColumn("width", F.explode(F.array(*[F.lit(w) for w in widths]))).filter(F.col(size) >= F.col("width"))
    return rows.groupBy("width").agg(F.count(F.lit(1)).alias("documents"), F.sum(size).alias("tokens"))


def continuation(df: DataFrame, context: str, answer: str, block: int) -> DataFrame:
    """(…, k, inp, target): a long answer in blocks; the input is what the block's last block_size + 1 tokens are, without the last."""
    n = F.size(answer)
    rows = df.filter(n > 0).withColumn("k", F.explode(F.sequence(F.lit(0), F.ceil(n / F.lit(block)).cast("int") - 1)))
    target = F.slice(answer, F.col("k") * block + 1, F.lit(block))
    seen = F.concat(F.col(context), F.slice(answer, F.lit(1), F.col("k") * block + F.size(target)))
    width = F.least(F.size(seen), F.lit(block + 1))
    return rows.withColumn("target", target).withColumn("inp", F.slice(seen, F.size(seen) - width + 1, width - 1))


def induction_probe(spark, n: int, distance: int, prefix: int, vocab: int, seed: int = 0) -> DataFrame:
    """(row, ids, target): a prefix, A B, a gap of low ids, and A again; the target is B."""
    rows = spark.range(n).select(F.col("id").alias("row"))
    draw = lambda k, m: (F.pmod(hashed(seed, F.col("row"), F.lit(k)), F.lit(m))).cast("int")
    a = draw(1, vocab - vocab // 2) + vocab // 2
    b = F.when((draw(2, vocab - vocab // 2) + vocab // 2) == a, a - 1).otherwise(draw(2, vocab - vocab // 2) + vocab // 2)
    filler = lambda k, m: F.transform(F.sequence(F.lit(1), F.lit(m)), lambda i: F.pmod(F.xxhash64(F.lit(seed), F.col("row"), F.lit(k), i), F.lit(vocab // 2)).cast("int"))
    return rows.select("row", F.concat(filler(3, prefix), F.array(a, b), filler(4, distance), F.array(a)).alias("ids"), b.alias("target"))


def token_batches(sizes: list[tuple[int, int]], budget: int) -> list[tuple[int, int]]:
    """(id, batch): longest first, a batch as wide as its first row; planned on the driver over (id, length) of one evaluation."""
    out, batch, width, n = [], 0, 0, 0
    for i, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        if n and max(width, size) * (n + 1) > budget:
            batch, width, n = batch + 1, 0, 0
        width, n = max(width, size), n + 1
        out.append((i, batch))
    return out


def batches(df: DataFrame, ordinal: str, size: int, drop_last: bool = True) -> DataFrame:
    """df with batch numbers; a last short batch goes in training."""
    from ..functions.ordered import rank

    rows = rank(df, ordinal, out="_r").withColumn("batch_id", F.floor((F.col("_r") - 1) / size))
    if drop_last:
        n = df.agg(F.floor(F.count(F.lit(1)) / size).alias("_n"))
        rows = rows.crossJoin(F.broadcast(n)).filter(F.col("batch_id") < F.col("_n")).drop("_n")
    return rows.drop("_r")


def spans_from_marks(df: DataFrame, key: str, ids: str, eos: int) -> DataFrame:
    """(key, doc, start, finish) of the documents that an end mark closes in a stream; back-to-back marks close empty ones."""
    marks = F.filter(F.transform(F.col(ids), lambda t, i: F.when(t == eos, i)), lambda i: i.isNotNull())
    rows = df.select(key, F.posexplode(marks).alias("doc", "finish"))
    start = F.coalesce(F.lag("finish").over(Window.partitionBy(key).orderBy("doc")) + 1, F.lit(0))
    return rows.select(key, "doc", start.alias("start"), "finish")


def band_windows(df: DataFrame, size: str, widths: tuple[int, ...] = (512, 2048, 4096, 8192)) -> DataFrame:
    """rolling() windows of each width, half a width apart, over the documents that have so many tokens."""
    out = None
    for w in widths:
        rows = rolling(df.filter(F.col(size) >= w), size, w, w // 2).withColumn("width", F.lit(w))
        out = rows if out is None else out.unionByName(rows)
    return out


def budget_batches(df: DataFrame, key: str, ids: str, budget: int, pad: int) -> DataFrame:
    """df with batch_id and padded, the tokens filled up to the batch's longest: rows of a batch by their width are budget at most.

    Longest rows come first, ties by key; a batch is as wide as its first row, so how many rows it takes follows from that row's
    length alone. The plan is made over the different lengths, of which there are few, and rows get their batch by their rank.
    """
    rows = df.withColumn("_n", F.size(ids))
    lengths = rows.groupBy("_n").agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("_n")).collect()
    segments, at, batch, ahead = [], 0, 0, 0  # (first rank, rows a batch, first batch, width); ahead: rows that the last batch took of later lengths
    for r in lengths:
        left = r.k - ahead
        if left <= 0:
            at, ahead = at + r.k, ahead - r.k
            continue
        at, ahead = at + ahead, 0
        per = max(1, budget // r["_n"]) if r["_n"] else left
        n = -(-left // per)
        segments.append((at, per, batch, r["_n"]))
        at, batch, ahead = at + left, batch + n, n * per - left
    if not segments:
        return df.withColumn("batch_id", F.lit(0).cast("long")).withColumn("padded", F.col(ids))
    plan = F.from_json(F.lit(json.dumps([dict(zip(("at", "per", "batch", "width"), x, strict=True)) for x in segments])), "array<struct<at:bigint,per:bigint,batch:bigint,width:int>>")
    counts = F.broadcast(rows.sparkSession.createDataFrame([(r["_n"], sum(x.k for x in lengths if x["_n"] > r["_n"])) for r in lengths], "_len int, _longer long"))
    place = F.row_number().over(Window.partitionBy("_n", "_slice").orderBy(key))
    # rows of one length are numbered in ranges of their keys, so that a common length isn't one task
    rows = in_ranges(rows, key, "_slice")
    slices = rows.groupBy("_n", "_slice").agg(F.count(F.lit(1)).alias("_k"))
    before = F.coalesce(F.sum("_k").over(Window.partitionBy("_n").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    slices = slices.select(F.col("_n").alias("_sn"), F.col("_slice").alias("_ss"), before.alias("_before"))
    rows = rows.withColumn("_place", place).join(slices, (F.col("_n") == F.col("_sn")) & (F.col("_slice") == F.col("_ss"))).join(counts, F.col("_n") == F.col("_len"))
    rank_ = F.col("_longer") + F.col("_before") + F.col("_place") - 1
    seg = lambda r: F.element_at(F.filter(plan, lambda s: s["at"] <= r), -1)
    rows = rows.withColumn("_rank", rank_).withColumn("_seg", seg(F.col("_rank")))
    batch_id = F.col("_seg.batch") + F.expr("(_rank - _seg.at) div _seg.per")
    full = F.concat(F.col(ids), F.array_repeat(F.lit(pad), F.greatest(F.lit(0), F.col("_seg.width") - F.col("_n"))))
    return rows.withColumn("batch_id", batch_id).withColumn("padded", full).drop("_n", "_slice", "_sn", "_ss", "_before", "_place", "_len", "_longer", "_rank", "_seg")
