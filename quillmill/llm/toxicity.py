"""Toxicity: a linear classifier on character n-grams, each feature scaled by its naive Bayes log-count ratio."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name

SIZES = (4, 6, 8)
BITS = 22
#: Bounds of the training sample: rows of each class, characters of a text that may be in it, characters altogether.
ROWS_PER_CLASS, TEXT_CHARS, ALL_CHARS = 2500, 100_000, 20_000_000
#: Features with less evidence than this chi-square take no part, or in a smaller sample as much less as it has fewer rows;
#: at most FEATURES of them do.
CHI2, FEATURES = 30.0, 8192
WINDOW = 1 << 20
STEPS, RIDGE = 400, 1e-5


@dataclass
class Model:
    """lut: from a hashed n-gram to its feature, 0 for none; weights: by feature, ratio and coefficient multiplied; bias."""

    lut: object
    weights: object
    bias: float

    def score(self, text: str) -> float:
        import numpy as np

        found = np.zeros(len(self.weights), bool)
        for bins in ngram_bins(text):
            at = self.lut[bins]
            found[at[at > 0]] = True
        return float(1 / (1 + np.exp(-(self.bias + self.weights[found].sum()))))


def ngram_bins(text: str):
    """Hashed character n-grams of a whole text, window after window; letters in lower case, ASCII punctuation as blanks."""
    import numpy as np

    blank = np.arange(128, dtype=np.uint32)
    blank[[c for c in range(128) if not chr(c).isalnum()]] = 32
    for at in range(0, max(1, len(text)), WINDOW):
        code = np.frombuffer((" " + text[at : at + WINDOW + max(SIZES)].lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
        code = np.where(code < 128, blank[np.minimum(code, 127)], code)
        gram = code
        for n in range(2, max(SIZES) + 1):
            gram = gram[:-1] * np.uint32(0x01000193) + code[n - 1 :]
            if n in SIZES and len(gram):
                mixed = (gram ^ (gram >> np.uint32(15))) * np.uint32(0x9E3779B1) + np.uint32(n)
                yield (mixed * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)


def fit_texts(rows: list[tuple[str, int]]) -> Model:
    """The model of labelled texts. Without rows of both classes every score is the only class seen, or 0."""
    import numpy as np

    y = np.array([label for _, label in rows], np.float64)
    lut = np.zeros(1 << BITS, np.int16)
    if not len(y) or y.min() == y.max():
        return Model(lut, np.zeros(1), 20.0 if len(y) and y[0] else -20.0)
    counts = np.zeros((2, 1 << BITS), np.float32)
    for text, label in rows:  # n-grams are made again below, as those of all rows would take much memory
        counts[int(label), np.unique(np.concatenate(list(ngram_bins(text))))] += 1
    n = np.array([(y == 0).sum(), (y == 1).sum()])
    both = counts.sum(0)
    expected = both * n[1] / n.sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        chi2 = np.where(both > 1, (counts[1] - expected) ** 2 * n.sum() / (expected * np.maximum(n.sum() - both, 1) * n[0] / n.sum()), 0)
    kept = np.flatnonzero(chi2 >= CHI2 * min(1.0, n.sum() / (2 * ROWS_PER_CLASS)))
    kept = kept[np.argsort(-chi2[kept], kind="stable")[:FEATURES]]
    if not len(kept):
        return Model(lut, np.zeros(1), float(np.log((n[1] + 1) / (n[0] + 1))))
    lut[kept] = np.arange(1, len(kept) + 1)
    p, q = counts[1, kept] + 1, counts[0, kept] + 1
    ratio = np.concatenate([[0], np.log(p / (n[1] + 2) / (q / (n[0] + 2)))])
    del both, expected, chi2, counts
    column = [np.unique(np.concatenate([lut[bins] for bins in ngram_bins(text)])) for text, _ in rows]
    column = [c[c > 0].astype(np.int32) for c in column]
    row = np.repeat(np.arange(len(y), dtype=np.int32), [len(c) for c in column])
    column = np.concatenate(column)
    value = ratio.astype(np.float32)[column] * np.float32(1 / np.sqrt(1 + len(column) / len(y)))
    scale = 1 / np.sqrt(1 + len(column) / len(y))
    w, b, seen = np.zeros(len(ratio)), float(np.log(n[1] / n[0])), np.full(len(ratio), 1e-6)
    for _ in range(STEPS):
        z = np.bincount(row, value * w[column], len(y)) + b
        miss = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        slope = np.bincount(column, value * miss[row], len(ratio)) / len(y) + RIDGE * w
        seen += slope**2
        w -= 0.5 * slope / np.sqrt(seen)
        b -= 0.5 * miss.mean()
    return Model(lut, w * ratio * scale, b)


def held_out(c):
    """Whether a row is kept from training: crc32 of its id as text leaves no remainder by 5."""
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of at most ROWS_PER_CLASS labelled rows a class, chosen by a hash of their ids, never held-out ones; of these,
    texts of more than TEXT_CHARS characters are left out."""
    known = labels.filter("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(~held_out(F.col("doc_id")))
    order = [F.md5(F.col("doc_id").cast("string").cast("binary")), F.col("doc_id")]
    ids = [known.filter(F.col("toxic") == c).orderBy(*order).limit(ROWS_PER_CLASS) for c in (0, 1)]
    picked = docs.select("doc_id", "text").filter(F.length("text") <= TEXT_CHARS).join(F.broadcast(ids[0].unionByName(ids[1])), "doc_id")
    return picked.orderBy(*order, "text").limit(2 * ROWS_PER_CLASS).select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Train on the bounded sample; past ALL_CHARS characters no more rows are taken."""
    rows, total = [], 0
    for text, toxic in sample(docs, labels).toLocalIterator():
        if (total := total + len(text)) > ALL_CHARS:
            break
        rows.append((text, toxic))
    return fit_texts(rows)


def with_score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with a column of scores from 0 to 1 for each whole text; null counts as empty, and an empty text gets the score of no evidence."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scores(texts):
        import pyarrow as pa

        m = shared.value
        return pa.array([m.score(t.as_py() or "") for t in texts], pa.float64())

    return docs.withColumn(score_col, F.arrow_udf(scores, T.DoubleType())(F.col(text_col)))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; repeated rows stay repeated, no rows give no rows."""
    scored = with_score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs, all columns, without the rows scored 0.5 or more."""
    score = free_name(docs)
    return with_score(docs, fit(docs, labels), score_col=score).filter(F.col(score) < 0.5).drop(score)
