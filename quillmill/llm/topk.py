"""Exact top-k search by inner product, block at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K, EVERY, SCALE = 5, 50, 256
BLOCK = 256
#: Bytes of queries that one pass over the vectors takes; more go in further passes.
PASS_BYTES = 64 << 20
#: Vectors scored first, on the driver, so that each query starts with a bound that its kth score reaches; and their bytes.
SEEDS, SEED_BYTES = 2_048, 32 << 20


def quantised(vectors):
    """floor(256 x) of equally long vectors as a float matrix, exact; or None where sums could pass 2 ** 53."""
    import numpy as np

    x = np.floor(np.asarray(vectors, np.float64) * SCALE)
    return x if x.size == 0 or np.abs(x).max() ** 2 * x.shape[1] < 2**53 else x.astype(object)


def best(ids, scores, k: int):
    """Positions of the k highest scores, ties to the smaller id, in order."""
    import numpy as np

    if len(ids) > 4 * k and scores.dtype != object:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return at[np.lexsort((ids[at], -scores[at]))][:k]
    return np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k], np.int64)


class Best:
    """The k best of each query among the vectors seen so far, and how many blocks were scored and skipped."""

    def __init__(self, q_ids, q, floors, k: int):
        import numpy as np

        self.q_ids, self.q, self.k = q_ids, q, k
        self.kth = list(floors)
        self.found = [(np.zeros(0, np.int64), np.zeros(0, q.dtype)) for _ in q_ids]
        self.scored = self.skipped = 0

    def add(self, ids, matrix, block: int = BLOCK):
        """Take in some vectors, in order of id; each range of `block` of them has every component's greatest and least.

        A query takes the blocks in order of the sum of its largest products with these, scores a block's vectors, and stops
        where the next sum is below its kth score, or below its floor as long as it has fewer than k.
        """
        import numpy as np

        starts = np.arange(0, len(ids), block)
        top, low = np.maximum.reduceat(matrix, starts), np.minimum.reduceat(matrix, starts)
        sums = np.maximum(self.q, 0) @ top.T + np.minimum(self.q, 0) @ low.T
        order = np.argsort(-sums, axis=1, kind="stable")
        for n, q_id in enumerate(self.q_ids):
            have_ids, have = self.found[n]
            for place, b in enumerate(order[n]):
                if sums[n, b] < self.kth[n]:
                    self.skipped += len(starts) - place
                    break
                self.scored += 1
                at = slice(starts[b], starts[b] + block)
                scores = matrix[at] @ self.q[n]
                keep = (scores >= self.kth[n]) & (ids[at] != q_id)
                if keep.any():
                    have_ids, have = np.concatenate([have_ids, ids[at][keep]]), np.concatenate([have, scores[keep]])
                    sel = best(have_ids, have, self.k)
                    have_ids, have = have_ids[sel], have[sel]
                    if len(have) == self.k:
                        self.kth[n] = max(self.kth[n], have[-1])
            self.found[n] = have_ids, have

    def rows(self):
        """(query id, id, score) of all found."""
        for q_id, (ids, scores) in zip(self.q_ids, self.found, strict=True):
            for i, s in zip(ids.tolist(), scores.tolist(), strict=True):
                yield int(q_id), i, int(s)


def floors_of(q_ids, q, ids, matrix, k: int) -> list:
    """Of each query, the kth best score among some vectors; no bound where these are too few."""
    import numpy as np

    out = [-np.inf] * len(q_ids)
    if len(ids) > k:
        for at in range(0, len(q_ids), 1024):
            scores = q[at : at + 1024] @ matrix.T
            if scores.dtype == object:
                out[at : at + 1024] = [sorted(s[ids != i])[-k] for i, s in zip(q_ids[at : at + 1024], scores, strict=True)]
            else:
                scores[q_ids[at : at + 1024][:, None] == ids[None, :]] = -np.inf
                out[at : at + 1024] = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k].tolist()
    return out


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    x = F.col(vector_col).cast("array<double>")
    ok = F.col(vector_col).isNotNull() & F.col(id_col).isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).filter(F.coalesce(ok, F.lit(False)))


def search(vectors: DataFrame, k: int = K, every: int = EVERY, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each query with all rows but those of its own id.

    Queries are the rows whose id is divisible by `every`; components are floor(256 x). Ties go to the smaller id. Vectors
    that are null or hold nulls, NaN or infinities take no part, nor do null ids; vectors meet only such of their own length.
    A repeated id is a row like any other; as a query it counts once, with its greatest vector. Null columns beside these two
    and columns with any other names don't matter; no vectors or no queries give no rows. Queries go in passes of a bounded
    number of bytes against all rows, which stay where they are read; each partition carries every query's k best from batch
    to batch and gives those at its end.
    """
    import numpy as np

    rows = usable(vectors, id_col, vector_col)
    asked = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.max("x").alias("x"))
    total, widest = asked.agg(F.sum(F.size("x") * 8 + 64), F.max(F.size("x"))).first()
    passes = -(-(total or 0) // PASS_BYTES) or 1
    spark, found = vectors.sparkSession, None
    seeds = [(r.vec_id, r.x) for r in rows.limit(max(1, min(SEEDS, SEED_BYTES // (8 * (widest or 1) + 64)))).collect()]
    ordered = rows.sortWithinPartitions("vec_id")
    for p in range(passes):
        by: dict[int, tuple[list, list]] = {}
        for r in asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == p).toLocalIterator():
            i, x = by.setdefault(len(r.x), ([], []))
            i.append(r.vec_id)
            x.append(np.array(r.x))
        queries = {}
        for d, (i, x) in by.items():
            q_ids, q = np.array(i, np.int64), quantised(x)
            near = [(s, v) for s, v in seeds if len(v) == d]
            s_ids, s_x = np.array([s for s, _ in near], np.int64), quantised([v for _, v in near]) if near else np.zeros((0, d))
            queries[d] = (q_ids, q, floors_of(q_ids, q, s_ids, s_x, k))
        shared = spark.sparkContext.broadcast(queries)

        def run(batches, shared=shared):
            import numpy as np
            import pyarrow as pa

            state = {}
            for batch in batches:
                ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
                sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
                flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes)
                for d, (q_ids, q, floors) in shared.value.items():
                    mine = np.flatnonzero(sizes == d)
                    if len(mine):
                        if d not in state:
                            state[d] = Best(q_ids, q, floors, k)
                        state[d].add(ids[mine], quantised(flat[(ends[mine] - d)[:, None] + np.arange(d)]))
            for each in state.values():
                out = list(each.rows())
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(3)], ["query_id", "vec_id", "score"])

        part = ordered.mapInArrow(run, "query_id long, vec_id long, score long")
        found = part if found is None else found.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
