"""Near-duplicate groups at a shingle similarity, by wide SimHash fingerprints, banded keys and pivot distance tables."""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, saved, small, utf8
from .components import components
from .simhash import _hashes

SHINGLE, SIMILARITY = 5, 0.8
#: Bits of a fingerprint, keys of a document, bits of a key. At similarity 0.8 two fingerprints differ in 15 % of the bits, so
#: 64 keys of 18 bits meet with probability 0.97 (0.995 at 0.85, 0.999 at 0.9). keys_for() takes more of both for more documents.
BITS, KEYS, KEY_BITS = 256, 64, 18
#: Documents that may share a key by chance.
CHANCE = 64
#: A key with more members than this is dealt over several tasks.
HOT_KEY = 4096
#: Most differing bits of a link that is worth a comparison of shingle sets: expected at 0.8 is 38.7 with a deviation of 5.7.
#: Members of a key at SURE bits or fewer of its leader are linked with it alone; at 0.8 that is a matter of 1 in 200.
RADIUS, SURE = 52, 24
N_PIVOTS = 4
#: Bytes that name a shingle set.
SET = 16


def keys_for(n: int) -> tuple[int, int]:
    """(keys, bits a key) for n fingerprints: as many bits as let CHANCE of them meet by chance, as many keys as keep the recall."""
    bits = max(KEY_BITS, math.ceil(math.log2(max(n, 1) / CHANCE)))
    return math.ceil(KEYS / 0.85 ** (bits - KEY_BITS)), bits


def _keys_udf(keys: int, key_bits: int):
    """fp to its keys, array<long>."""

    def keys_of(fps):
        import numpy as np
        import pyarrow as pa

        r = random.Random(5)
        chosen = [r.sample(range(BITS), key_bits) for _ in range(keys)]
        on = np.unpackbits(np.frombuffer(b"".join(fps.to_pylist()), np.uint8).reshape(-1, BITS // 8), axis=1, bitorder="little")
        out = np.empty((len(fps), keys), np.int64)
        for k, bits in enumerate(chosen):
            out[:, k] = on[:, bits].astype(np.int64) @ (np.int64(1) << np.arange(key_bits, dtype=np.int64)) + (k << key_bits)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(fps) + 1, dtype=np.int32) * keys), pa.array(out.reshape(-1)))

    return F.arrow_udf(keys_of, "array<long>")


def _near_udf():
    """Whether two fingerprints differ in SURE bits or fewer."""

    def near(a, b):
        import numpy as np
        import pyarrow as pa

        x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint64).reshape(-1, BITS // 64) for c in (a, b))
        return pa.array(np.bitwise_count(x ^ y).sum(1) <= SURE)

    return F.arrow_udf(near, "boolean")


def _shingles(text: bytes, shingle: int):
    """The distinct shingle hashes of a text, in order."""
    import numpy as np

    return np.unique(np.concatenate([np.zeros(0, np.uint64), *_hashes(text, shingle)]))


def _fingerprint_udf(shingle: int):
    """text to the fingerprint of its shingle set and, in the same binary, SET bytes that only texts of one set share."""

    def fingerprints(texts):
        import hashlib

        import numpy as np
        import pyarrow as pa

        data, offsets = utf8(texts)
        bits = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
        factors = [np.uint64(2 * f + 1) for f in random.Random(7).sample(range(1 << 62), BITS // 64)]
        fps = []
        for i in range(len(texts)):
            h = _shingles(data[offsets[i] : offsets[i + 1]].tobytes(), shingle)
            counts = np.zeros(BITS, np.int64)
            for k, f in enumerate(factors):
                m = (h ^ (h >> np.uint64(32))) * f
                each = (m ^ (m >> np.uint64(29))).view(np.uint8).reshape(-1, 8)
                for b in range(8):
                    at = 64 * k + 8 * b
                    counts[at : at + 8] += np.bincount(each[:, b], minlength=256) @ bits
            fps.append(np.packbits(2 * counts > len(h), bitorder="little").tobytes() + hashlib.blake2b(h.tobytes(), digest_size=SET).digest())
        return pa.array(fps, pa.binary())

    return F.arrow_udf(fingerprints, "binary")


def _least(edges):
    """Of edges, a list of arrays (a, b, d), a forest that connects the same nodes by the edges of least d."""
    import numpy as np

    a, b, d = (np.concatenate([e[i] for e in edges]) for i in range(3))
    order = np.argsort(d, kind="stable")
    parent: dict[int, int] = {}

    def root(x):
        while (y := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(y, y)
        return x

    keep = []
    for k, x, y in zip(order.tolist(), a[order].tolist(), b[order].tolist(), strict=True):
        if x != y and (p := root(x)) != (q := root(y)):
            parent[max(p, q)] = min(p, q)
            keep.append(k)
    return np.minimum(a[keep], b[keep]), np.maximum(a[keep], b[keep]), d[keep]


class _Edges:
    """Edges of a partition, reduced to their forest each time they have doubled."""

    def __init__(self):
        self.parts, self.n, self.most = [], 0, 1 << 20

    def add(self, a, b, d):
        import numpy as np

        if len(a):
            self.parts.append((a, b, d.astype(np.int32)))
            self.n += len(a)
        if self.n > self.most:
            self.parts = [_least(self.parts)]
            self.n = len(self.parts[0][0])
            self.most = max(1 << 20, 2 * self.n)

    def batches(self):
        import pyarrow as pa

        if self.parts:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _least(self.parts)], ["a", "b", "d"])


def _linked(batches):
    """From rows (key, part, id, fp, home, near, leader) in order of key and part, a forest (a, b, d) of the links within parts.

    Members near the leader of a key are of one set from the start, and so are those near a part's first member where none is
    near a leader; pairs within a set aren't compared. All other members are compared with the members that are at home in the
    part: distances to the first members are a pivot table, pairs whose distances to some pivot differ by more than RADIUS
    go, survivors are verified. d: differing bits, 0 for two members near one leader.
    """
    import numpy as np

    edges = _Edges()

    def forest(a, b, d=None):
        edges.add(a, b, np.zeros(len(a), np.int32) if d is None else d)

    def group(ids, fps, home, near, leaders):
        if near.any():  # a tree: the leader, one member of each part, the part's others that are near that one too
            one = near.argmax()
            far = np.bitwise_count(fps ^ fps[one]).sum(1)
            tree = near & (far <= SURE)
            forest(np.broadcast_to(ids[one], tree.sum()), ids[tree], far[tree])
            direct = near & (far > SURE)
            direct[one] = True
            forest(ids[direct], leaders[direct], np.full(direct.sum(), SURE, np.int32))
        elif home.any():
            one = home.argmax()
            far = np.bitwise_count(fps ^ fps[one]).sum(1)
            near = home & (far <= SURE)
            forest(np.broadcast_to(ids[one], near.sum()), ids[near], far[near])
        else:
            return
        table = np.bitwise_count(fps[:, None, :] ^ fps[None, :N_PIVOTS, :]).sum(2, dtype=np.int16)
        order = np.argsort(table[:, 0], kind="stable")
        ids, fps, table, home, near = ids[order], fps[order], table[order], home[order], near[order]
        other, at_home = np.flatnonzero(~near), np.flatnonzero(home)
        first = table[at_home, 0]
        for at in range(0, len(other), 256):
            block = other[at : at + 256]
            low, high = np.searchsorted(first, [table[block[0], 0] - RADIUS, table[block[-1], 0] + RADIUS + 1], "left")
            with_ = at_home[low:high]
            keep = (block[:, None] < with_[None, :]) | near[with_][None, :] | ~home[block][:, None]  # two members that both are other and at home meet once
            for p in range(table.shape[1]):
                keep &= np.abs(table[block, p][:, None] - table[with_, p][None, :]) <= RADIUS
            i, j = np.nonzero(keep)
            for part in range(0, len(i), 1 << 16):
                x, y = block[i[part : part + (1 << 16)]], with_[j[part : part + (1 << 16)]]
                far = np.bitwise_count(fps[x] ^ fps[y]).sum(1)
                close = far <= RADIUS
                forest(ids[x[close]], ids[y[close]], far[close])

    rest = None
    for batch in [*batches, None]:
        if batch is not None:
            fp = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint64).reshape(-1, BITS // 64)
            new = tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2)) + (fp,) + tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in (4, 5, 6))
            rest = new if rest is None else tuple(np.concatenate(x) for x in zip(rest, new, strict=True))
        if rest is None or not len(rest[0]):
            continue
        keys, parts, ids, fps, home, near, leaders = rest
        starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (parts[1:] != parts[:-1])]))
        ends = np.append(starts[1:], len(keys))
        done = len(starts) if batch is None else len(starts) - 1  # the last key may go on in the next batch
        size = (ends - starts)[:done]
        for step in range(1, 8):  # keys of up to 8 members, all keys at a time; comparing every two of them is never too much
            first = np.concatenate([np.arange(a, b - step) for a, b in zip(starts[:done][(size > step) & (size <= 8)], ends[:done][(size > step) & (size <= 8)], strict=True)] or [np.zeros(0, np.int64)])
            far = np.bitwise_count(fps[first] ^ fps[first + step]).sum(1)
            close = first[far <= RADIUS]
            forest(ids[close], ids[close + step], far[far <= RADIUS])
        tied = np.flatnonzero(near[: ends[done - 1]] if done else near[:0])
        tied = tied[np.repeat(size <= 8, size)[tied]] if len(tied) else tied
        forest(ids[tied], leaders[tied])
        for a, b in zip(starts[:done][size > 8], ends[:done][size > 8], strict=True):
            group(ids[a:b], fps[a:b], home[a:b], near[a:b], leaders[a:b])
        at = len(keys) if batch is None else starts[-1]
        rest = tuple(r[at:] for r in rest)
    yield from edges.batches()


def _forest(batches):
    """A forest of the links (a, b, d) of a partition, by least d."""
    edges = _Edges()
    for batch in batches:
        edges.add(*(batch.column(i).to_numpy() for i in range(3)))
    yield from edges.batches()


def _set_udf(shingle: int):
    """text to its distinct shingle hashes in order, 8 bytes each."""

    def sets(texts):
        import pyarrow as pa

        data, offsets = utf8(texts)
        return pa.array([_shingles(data[a:b].tobytes(), shingle).tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())

    return F.arrow_udf(sets, "binary")


def _jaccard_udf():
    def jaccard(a, b):
        import numpy as np
        import pyarrow as pa

        out = []
        for x, y in zip(a, b, strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(both / max(1, len(x) + len(y) - both))
        return pa.array(out, pa.float64())

    return F.arrow_udf(jaccard, "double")


def similar(docs: DataFrame, pairs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Those of pairs (a, b) whose shingle sets have SIMILARITY or more. docs: (doc_id, text); of texts with one id any may count."""
    ids = saved(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct())
    sets = saved(docs.join(small(ids), "doc_id", "left_semi").select("doc_id", _set_udf(shingle)("text").alias("s")))
    met = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("s").alias("y")), "b")
    return met.select("a", "b", _jaccard_udf()("x", "y").alias("j")).filter(F.col("j") >= SIMILARITY).select("a", "b").distinct()


#: Links that one task reduces to a forest.
LINKS = 2_000_000


def links(first: DataFrame, n: int, hot_key: int = HOT_KEY) -> DataFrame:
    """Pairs (a, b, d) of ids that connect the fingerprints that share a key and differ in RADIUS bits or fewer. first: n rows (id, fp).

    A key of more than hot_key members is dealt over as many parts as hold that number. Its member with the smallest id leads:
    members near the leader are linked with it and go to one part each; the rest, whose links could be to anyone, go to every
    part. So each pair is compared or already linked, and a group of copies costs as much as it has members.
    """
    keys, bits = keys_for(n)
    rows = first.select(F.explode(_keys_udf(keys, bits)("fp")).alias("key"), "id", "fp")
    hot = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("leader")).filter(F.col("n") > hot_key)
    hot = saved(hot.join(first.select(F.col("id").alias("leader"), F.col("fp").alias("leader_fp")), "leader"))
    plain = rows.join(small(hot, 100_000).select("key"), "key", "left_anti")
    plain = plain.select("key", F.lit(0).alias("part"), "id", "fp", F.lit(True).alias("home"), F.lit(False).alias("near"), F.col("id").alias("leader"))
    split = rows.join(small(hot, 100_000), "key").withColumn("near", _near_udf()("fp", "leader_fp")).withColumn("parts", F.ceil(F.col("n") / hot_key).cast("int"))
    split = split.withColumn("own", F.pmod(F.xxhash64("id"), "parts").cast("int"))
    split = split.withColumn("part", F.explode(F.when(F.col("near"), F.array("own")).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))))
    split = split.select("key", "part", "id", "fp", (F.col("part") == F.col("own")).alias("home"), "near", "leader")
    return plain.unionByName(split).repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(_linked, "a long, b long, d int").groupBy("a", "b").agg(F.min("d").alias("d"))


def groups(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id): documents that link at a similarity of SIMILARITY or more, directly or in steps.

    Fingerprints over the distinct shingles of words tell which documents may link; of these links a forest of the least
    distances stays, and all its links are checked by the shingle sets. Documents of one shingle set, such as exact copies and
    texts without words, are one from the start. Null ids take no part. No documents give no rows.
    """
    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), _fingerprint_udf(shingle)(F.col(text_col)).alias("fp"))
    fps = saved(rows)
    first = saved(fps.groupBy("fp").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("n")))
    pairs = saved(links(first.select("id", F.substring("fp", 1, BITS // 8).alias("fp")), first.count()))
    # each task of the step before had its own forest
    pairs = saved(pairs.repartition(max(4, pairs.count() // LINKS)).mapInArrow(_forest, "a long, b long, d int"))
    checked = similar(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), pairs.select("a", "b"), shingle)
    labels = components(saved(checked))
    ids = saved(first.join(labels, F.col("id") == F.col("node"), "left").select("fp", F.coalesce("label", "id").alias("component_id"), "n"))
    return join_hot(fps.select("doc_id", "fp"), ids, "fp", "n").select("doc_id", "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """docs, all columns, with the smallest id of each near-duplicate group; of rows with one id, one stays. Rows without id stay."""
    found = saved(groups(docs, shingle))
    gone = found.filter("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(small(saved(gone)), "doc_id", "left_anti").select(docs.columns)
    again = saved(found.filter("doc_id = component_id").groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    if again.isEmpty():
        return kept
    return kept.join(small(again), "doc_id", "left_anti").unionByName(kept.join(small(again), "doc_id", "left_semi").dropDuplicates(["doc_id"]))
