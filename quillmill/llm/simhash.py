"""Near-duplicate documents by SimHash fingerprints and pivot distance tables."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import join_hot, saved, utf8
from .components import components

SHINGLE, RADIUS, SEED = 3, 2, 42
#: Reference fingerprints of the distance tables: one bit block set in each, then mixed ones.
PIVOTS = [0x00000000FFFFFFFF, 0x0000FFFF0000FFFF, 0x00FF00FF00FF00FF, 0x0F0F0F0F0F0F0F0F, 0x3333333333333333, 0x5555555555555555, 0x0, 0x0123456789ABCDEF]
BLOCKS = 4
#: Keys with more fingerprints than this aren't compared pair by pair but linked through the middle points between them.
HOT_KEY = 64
CHUNK = 1 << 22


def _hashes(text: bytes, shingle: int):
    """XXH64 of each shingle of a text, in pieces, so that a very long text needs little memory."""
    from itertools import accumulate

    import numpy as np
    from xxhash import xxh64_intdigest as xxh64

    carry: list[bytes] = []
    seen, at = 0, 0
    while at < len(text) or not seen:
        to = at + CHUNK
        while to < len(text) and text[to] not in b" \t\n\v\f\r":
            to += 1
        words = carry + text[at:to].lower().split()
        at = to
        if len(words) < shingle:
            carry = words
            if at < len(text):
                continue
            if not seen and words:
                yield np.array([xxh64(b" ".join(words), SEED)], np.uint64)
            return
        joined = b" ".join(words)
        ends = list(accumulate(len(w) + 1 for w in words))
        yield np.array([xxh64(joined[a : b - 1], SEED) for a, b in zip([0, *ends], ends[shingle - 1 :], strict=False)], np.uint64)
        seen, carry = 1, words[len(words) - shingle + 1 :]


def fingerprint_udf(shingle: int = SHINGLE):
    """A scalar Arrow function from text to its 64-bit fingerprint as a signed long."""

    def fingerprints(texts):
        import numpy as np
        import pyarrow as pa

        data, offsets = utf8(texts)
        bits = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
        out = np.zeros(len(texts), np.uint64)
        for i in range(len(texts)):
            counts, n = np.zeros(64, np.int64), 0
            for h in _hashes(data[offsets[i] : offsets[i + 1]].tobytes(), shingle):
                n += len(h)
                each = h.view(np.uint8).reshape(-1, 8)
                for b in range(8):
                    counts[8 * b : 8 * b + 8] += np.bincount(each[:, b], minlength=256) @ bits
            if n:
                out[i] = np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0]
        return pa.array(out.view(np.int64))

    return F.arrow_udf(fingerprints, T.LongType())


def _xor_bits(a, b):
    return F.bit_count(a.bitwiseXOR(b))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(fps: DataFrame, fp: str = "fp") -> DataFrame:
    """Pairs (a, b), a < b, that connect every two different fingerprints at RADIUS (2) or fewer differing bits, directly or in steps.

    Each fingerprint gets its distances to PIVOTS. Two fingerprints within 2 bits agree on 2 of 4 blocks, so pairs form only
    under the six keys of two blocks; a pair with a pivot distance differing by more than 2 goes, and the rest is verified.
    Under a key with more than HOT_KEY fingerprints no pairs form: those fingerprints meet at the 65 points within one bit of
    each (two are within 2 bits if and only if they share such a point, and a point has 65 fingerprints at most).
    """
    width = 64 // BLOCKS
    block = [F.shiftrightunsigned(F.col(fp), width * i).bitwiseAND(F.lit((1 << width) - 1)) for i in range(BLOCKS)]
    keys = [F.lit(k).cast("long") * (1 << 2 * width) + block[i] * (1 << width) + block[j] for k, (i, j) in enumerate(combinations(range(BLOCKS), BLOCKS - RADIUS))]
    near = F.array(*[_xor_bits(F.col(fp), F.lit(_signed(p))).cast("byte") for p in PIVOTS])
    rows = fps.select(F.col(fp).alias("fp"), near.alias("d"), F.explode(F.array(*keys)).alias("key"))
    met = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = saved(rows.join(met, "key"))
    few = met.filter(f"n <= {HOT_KEY}").drop("n")
    close = F.lit(True)
    for i in range(len(PIVOTS)):
        close = close & (F.abs(F.col("d")[i] - F.col("e")[i]) <= RADIUS)
    pairs = (
        few.withColumnRenamed("fp", "a")
        .join(few.select("key", F.col("fp").alias("b"), F.col("d").alias("e")), "key")
        .filter((F.col("a") < F.col("b")) & close & (_xor_bits(F.col("a"), F.col("b")) <= RADIUS))
        .select("a", "b")
    )
    hot = met.filter(f"n > {HOT_KEY}").select("fp").distinct()
    points = hot.select("fp", F.explode(F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)])).alias("point"))
    hubs = points.groupBy("point").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).filter("a < z").drop("z")
    stars = points.join(hubs, "point").filter("a < fp").select("a", F.col("fp").alias("b"))
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp long, component_id) for each row of docs: rows whose fingerprints link, directly or in steps, share the smallest id.

    Null and empty texts have fingerprint 0 and link like any other; repeated rows come back as often as they are in docs; a
    null id takes no part in the choice of component_id. No rows give no rows. Other columns of docs don't matter.
    """
    fps = saved(docs.select(F.col(id_col).alias("doc_id"), fingerprint_udf(shingle)(F.col(text_col)).alias("fp")))
    first = saved(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")))
    classes = saved(components(links(first)).join(first.select(F.col("fp").alias("node"), "first_id"), "node"))
    least = saved(classes.groupBy("label").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("n")))
    linked = join_hot(classes, least, "label", "n").select(F.col("node").alias("fp"), "component_id")
    ids = saved(first.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id"), "n"))
    return join_hot(fps, ids, "fp", "n").select(F.col("doc_id").alias(id_col), "fp", "component_id")


def hex16(c):
    """A long as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(c), 16, "0"))
