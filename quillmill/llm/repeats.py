"""Removal of byte strings that an earlier document has, by enhanced suffix arrays over buckets of suffixes.

Suffixes are dealt into buckets by the least hashed k-gram of their first `LEAST` bytes, so suffixes with a common prefix of
that length meet in one bucket. Neighbouring suffixes with the same least k-gram travel as one string. A bucket's suffixes
are sorted, and one scan with a stack over their common prefixes finds the intervals of the suffix array; those whose
occurrences are preceded by different bytes are the maximal repeats, with all occurrences.

What travels is packed: numbers by bytes of equal weight, sorted hashes as differences, all of it compressed. The k-gram is so long
that few repeat by chance, since those that do send their strings for nothing, and their share grows with the input.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, runs, saved, small, utf8

LEAST, GRAM = 50, 26
#: Bytes of text in a batch of documents, and of hashes in a bucket; at least GROUPS of each.
BATCH, BUCKET, GROUPS = 8 << 20, 8 << 20, 64
#: A k-gram with more different surroundings than this is dealt out by the hashes of whole windows instead.
HOT = 512
CHUNK = 1 << 20
FACTOR = 0x9E3779B97F4A7C15
#: Sets strings apart from windows of other bytes; the number of windows alone is no more than another first byte.
APART = 0xD6E8FEB86659FD93


@lru_cache(maxsize=1)
def _powers():
    import numpy as np

    power, back = np.full(CHUNK + 1, np.uint64(FACTOR)), np.full(CHUNK + 1, np.uint64(pow(FACTOR, -1, 1 << 64)))
    power[0] = back[0] = 1
    return np.multiply.accumulate(power), np.multiply.accumulate(back)


def _mix(h):
    import numpy as np

    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def strings(data, offsets):
    """Runs of windows of LEAST bytes with the same least k-gram: (start, windows, k-gram hash, content hash, text number).

    Which k-gram is least depends on a window's bytes alone, so equal windows in any texts have equal k-gram hashes.
    """
    import numpy as np

    power, back = _powers()
    wide = LEAST - GRAM + 1
    low = np.uint64((1 << 24) - 1)
    out = []
    for at in range(int(offsets[0]), int(offsets[-1]), CHUNK - LEAST + 1):
        x = data[at : min(at + CHUNK, int(offsets[-1]))]
        n = len(x) - LEAST + 1
        if n <= 0:
            break
        total = np.zeros(len(x) + 1, np.uint64)
        np.cumsum((x.astype(np.uint64) + np.uint64(1)) * power[: len(x)], out=total[1:])
        gram = _mix((total[GRAM:] - total[:-GRAM]) * back[: len(total) - GRAM])
        best = (gram & ~low) | np.arange(len(gram), dtype=np.uint64)
        for step in (1, 2, 4, 8):
            best = np.minimum(best[:-step], best[step:])
        best = np.minimum(best[: n], best[wide - 16 : wide - 16 + n])
        where = (best & low).astype(np.int32)
        a, b = np.searchsorted(offsets, [at, at + len(x)], "right")
        edges = offsets[a:b] - at  # texts that begin within the piece
        whole = np.ones(n, bool)
        for e in edges:
            whole[max(0, int(e) - LEAST + 1) : int(e)] = False
        first = whole.copy()
        first[1:] &= (where[1:] != where[:-1]) | ~whole[:-1]
        start = np.flatnonzero(first)
        if not len(start):
            continue
        stop = whole.copy()
        stop[:-1] &= ~whole[1:] | first[1:]
        count = np.flatnonzero(stop) - start + 1
        end = start + count + LEAST - 1
        content = _mix((total[end] - total[start]) * back[start] + count.astype(np.uint64) * np.uint64(APART))
        out.append((start + at, count, gram[where[start]], content, np.searchsorted(offsets, start + at, "right") - 1))
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, z.astype(np.uint64), z.astype(np.uint64), z
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def windows(data, start, count):
    """(position, hash) of every window of these runs."""
    import numpy as np

    at = np.repeat(start - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(int(count.sum()))
    h = np.zeros(len(at), np.uint64)
    for part in range(0, len(at), 1 << 16):
        some = at[part : part + (1 << 16)]
        x = data[some[:, None] + np.arange(LEAST)].astype(np.uint64) + np.uint64(1)
        h[part : part + (1 << 16)] = _mix(x @ _powers()[0][:LEAST])
    return at, h


def maximal_repeats(texts: list[bytes], least: int = LEAST):
    """(length, [(text, position), ...]) of every left-diverse interval with a common prefix of `least` bytes or more.

    The start of a text differs from every preceding byte. Only suffixes of `least` bytes or more take part.
    """
    order = sorted(((t, i) for t, x in enumerate(texts) for i in range(len(x) - least + 1)), key=lambda s: texts[s[0]][s[1] :])
    if len(order) < 2:
        return
    stack: list[list] = []  # [common prefix, first suffix of the interval, preceding byte or -1 for different ones]
    before = [texts[t][i - 1] if i else -1 for t, i in order]
    for k in range(1, len(order) + 1):
        depth = 0
        if k < len(order):
            (t, i), (u, j) = order[k - 1], order[k]
            a, b = texts[t][i:], texts[u][j:]
            n = min(len(a), len(b))
            differ = int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])
            depth = n - (differ.bit_length() + 7) // 8
            depth = depth if depth >= least else 0
        left, byte = k - 1, before[k - 1]
        while stack and stack[-1][0] > depth:
            length, left, b = stack.pop()
            byte = b if b == byte else -1
            if byte == -1:
                yield length, order[left:k]
        if depth:
            if stack and stack[-1][0] == depth:
                stack[-1][2] = stack[-1][2] if stack[-1][2] == byte else -1
            else:
                stack.append([depth, left, byte])
        elif stack:
            stack.clear()


def contents(data, size):
    """The content hashes, as those of strings(), of strings that follow each other in data."""
    import numpy as np

    power, back = _powers()
    edges = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(len(size), np.uint64)
    for a, b in runs(edges, CHUNK):
        x, at = data[edges[a] : edges[b]], edges[a : b + 1] - edges[a]
        total = np.zeros(len(x) + 1, np.uint64)
        np.cumsum((x.astype(np.uint64) + np.uint64(1)) * power[: len(x)], out=total[1:])
        out[a:b] = _mix((total[at[1:]] - total[at[:-1]]) * back[at[:-1]] + (size[a:b] - LEAST + 1).astype(np.uint64) * np.uint64(APART))
    return out


def _packed(tables):
    """The rows of each batch of documents in a table as one blob."""
    import numpy as np
    import pyarrow as pa

    for table in tables:
        if not table.num_rows:
            continue
        data, offsets = utf8(table["text"])
        ids, number = table["doc_id"].to_numpy(zero_copy_only=False), table["batch"].to_numpy(zero_copy_only=False)
        order = np.argsort(number, kind="stable")
        found = []
        for rows in np.split(order, np.flatnonzero(np.diff(number[order])) + 1):
            texts = np.concatenate([data[offsets[i] : offsets[i + 1]] for i in rows])
            found.append((int(number[rows[0]]), _blob(ids[rows], offsets[rows + 1] - offsets[rows], texts)))
        yield from _rows(found, ["batch", "blob"], [pa.int64(), pa.binary()]).to_batches()


class Batch:
    """The texts of a batch of blobs, as one array of bytes."""

    def __init__(self, table):
        import numpy as np

        parts = [_unblob(b.as_py(), np.int64, np.int64, np.uint8) for b in table["blob"]]
        none = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)]
        self.ids, size, self.data = (np.concatenate([p[i] for p in [none, *parts]]) for i in range(3))
        self.offsets = np.concatenate([[0], np.cumsum(size)])
        self.start, self.count, self.gram, self.content, text = strings(self.data, self.offsets)
        self.doc = self.ids[text] if len(text) else text

    def hashes(self, buckets: int):
        """By bucket: the different k-gram hashes in order, their numbers of contents (65535 at most), 8 bits of the first content, and
        whether two documents have them."""
        import numpy as np

        order = np.lexsort((self.doc, self.content, self.gram))
        g, c, d = self.gram[order], self.content[order], self.doc[order]
        new = np.concatenate([[True], g[1:] != g[:-1]])[: len(g)]
        at = np.flatnonzero(new)
        if not len(at):
            return {}
        other = np.concatenate([[True], (c[1:] != c[:-1])])[: len(g)] | new
        contents = np.minimum(np.add.reduceat(other.astype(np.int64), at), 65535).astype(np.uint16)
        many = np.minimum.reduceat(d, at) != np.maximum.reduceat(d, at)
        g, c = g[at], (c[at] >> np.uint64(56)).astype(np.uint8)
        b = (g % np.uint64(buckets)).astype(np.int64)
        by = np.argsort(b, kind="stable")
        cut = np.flatnonzero(np.concatenate([[True], b[by][1:] != b[by][:-1]]))
        return {int(b[x[0]]): (g[x], contents[x], c[x], many[x]) for x in np.split(by, cut[1:])}


def _rows(found, names, kinds):
    import pyarrow as pa

    return pa.table([pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)], names=names)


def _blob(*arrays) -> bytes:
    """Arrays as compressed bytes, those of equal weight together, after the lengths of all this and of each array."""
    import numpy as np
    import pyarrow as pa

    raw = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes() for a in arrays)
    return np.array([len(raw), *(len(a) for a in arrays)], np.int64).tobytes() + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def _unblob(blob: bytes, *kinds):
    import numpy as np
    import pyarrow as pa

    head = 8 * len(kinds) + 8
    size, *lengths = np.frombuffer(blob[:head], np.int64).tolist()
    raw = np.frombuffer(pa.Codec("zstd").decompress(pa.py_buffer(blob).slice(head), size), np.uint8) if size else np.zeros(0, np.uint8)
    at, out = 0, []
    for n, k in zip(lengths, kinds, strict=True):
        wide = np.dtype(k).itemsize
        out.append(np.ascontiguousarray(raw[at : at + n * wide].reshape(wide, n).T).view(k).ravel())
        at += n * wide
    return out


def _steps(sorted_hashes):
    """The upper halves of sorted 64-bit hashes, as differences; np.cumsum with dtype uint32 undoes these."""
    import numpy as np

    return np.diff((sorted_hashes >> np.uint64(32)).astype(np.uint32), prepend=np.uint32(0))


def _first(buckets: int):
    def hashes(key, table):
        import numpy as np
        import pyarrow as pa

        batch = key[0].as_py()
        found = [(b, batch, _blob(_steps(g), n, c, many)) for b, (g, n, c, many) in Batch(table).hashes(buckets).items()]
        return _rows(found, ["bucket", "batch", "blob"], [pa.int32(), pa.int64(), pa.binary()])

    return hashes


def _flags(key, table):
    """For each hash: 0 if one document has it, 1 if more, 2 if also in many surroundings."""
    import numpy as np
    import pyarrow as pa

    parts = [_unblob(b, np.uint32, np.uint16, np.uint8, np.bool_) for b in table["blob"].to_pylist()]
    parts = [(np.cumsum(h, dtype=np.uint32), *other) for h, *other in parts]
    h, n, c, many = (np.concatenate([p[i] for p in parts]) for i in range(4))
    order = np.lexsort((c, h))
    h_, c_ = h[order], c[order]
    new = np.concatenate([[True], h_[1:] != h_[:-1]])
    at = np.flatnonzero(new)
    # different contents over all batches: the first ones as estimated from how many of 256 values they take, and the further ones of each batch
    other = np.concatenate([[True], c_[1:] != c_[:-1]]) | new
    taken = np.minimum(np.add.reduceat(other.astype(np.int64), at), 255.9)
    contents = -256 * np.log1p(-taken / 256) + np.add.reduceat(n[order].astype(np.int64) - 1, at)
    times = np.diff(np.append(at, len(h)))
    both = np.logical_or.reduceat(many[order], at)
    flag = np.where((times > 1) | both, np.where(contents > HOT, 2, 1), 0).astype(np.uint8)
    out = np.zeros(len(h), np.uint8)
    out[order] = np.repeat(flag, times)
    ends = np.cumsum([len(p[0]) for p in parts])
    found = [(batch, key[0].as_py(), _blob(out[e - len(p[0]) : e])) for batch, p, e in zip(table["batch"].to_pylist(), parts, ends, strict=True)]
    return _rows(found, ["batch", "bucket", "blob"], [pa.int64(), pa.int32(), pa.binary()])


def _second(buckets: int):
    """From a batch and its flags: each different string that may repeat, and the hash of each different window of hot k-grams, once, with
    its least and greatest document."""

    def send(key, table, flags):
        import numpy as np
        import pyarrow as pa

        if not table.num_rows:
            return _rows([], ["bucket", "batch", "blob"], [pa.int32(), pa.int64(), pa.binary()])
        x = Batch(table)
        known = dict(zip(flags["bucket"].to_pylist(), flags["blob"].to_pylist(), strict=True))
        marks = np.zeros(len(x.gram), np.uint8)
        order = np.argsort(x.gram, kind="stable")
        grams = x.gram[order]
        for b, (g, *_) in x.hashes(buckets).items():
            (flag,) = _unblob(known[b], np.uint8)
            g, flag = g[flag > 0], flag[flag > 0]
            lo, hi = np.searchsorted(grams, g), np.searchsorted(grams, g, "right")
            n = hi - lo
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum())) if len(n) else np.zeros(0, np.int64)
            marks[order[at]] = np.repeat(flag, n)
        plain, hot = np.flatnonzero(marks == 1), np.flatnonzero(marks == 2)
        at, h = windows(x.data, x.start[hot], x.count[hot])
        sent: dict[int, list] = {}

        def deal(group, content, doc):
            """By bucket: the rows of its different contents, their least documents and how far the greatest ones are from these."""
            order = np.lexsort((doc, content, group))
            g, c = group[order], content[order]
            new = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (c[1:] != c[:-1])])[: len(order)])
            if not len(new):
                return
            least, most = np.minimum.reduceat(doc[order], new), np.maximum.reduceat(doc[order], new)
            b = (g[new] % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(b, kind="stable")
            for part in np.split(by, np.flatnonzero(np.diff(b[by])) + 1):
                yield int(b[part[0]]), order[new[part]], least[part], most[part] - least[part]

        for b, one, least, more in deal(x.gram[plain], x.content[plain], x.doc[plain]):
            one = plain[one]
            s, n = x.start[one], x.count[one] + LEAST - 1
            pick = np.repeat(s - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
            sent[b] = [_steps(x.gram[one]), least, more, n.astype(np.uint8), x.data[pick]]
        none = [np.zeros(0, k) for k in (np.uint32, np.int64, np.int64, np.uint8, np.uint8)]
        for b, one, least, more in deal(h, h, np.repeat(x.doc[hot], x.count[hot])):
            sent[b] = [*sent.get(b, none), h[one], least, more]
        none = [np.zeros(0, k) for k in (np.uint64, np.int64, np.int64)]
        found = [(b, key[0].as_py(), _blob(*(a if len(a) == 8 else [*a, *none]))) for b, a in sent.items()]
        return _rows(found, ["bucket", "batch", "blob"], [pa.int32(), pa.int64(), pa.binary()])

    return send


def _covers(key, table):
    """From a bucket's strings, back to each batch: (content, offset, length, document) of the bytes a smaller document has too."""
    import numpy as np
    import pyarrow as pa

    kinds = (np.uint32, np.int64, np.int64, np.uint8, np.uint8, np.uint64, np.int64, np.int64)
    parts = [_unblob(b, *kinds) for b in table["blob"].to_pylist()]
    found: list[list] = [[] for _ in parts]
    whole, least, more = (np.concatenate([p[i] for p in parts]) for i in (5, 6, 7))
    if len(whole):
        order = np.argsort(whole, kind="stable")
        at = np.flatnonzero(np.concatenate([[True], whole[order][1:] != whole[order][:-1]]))
        smallest = np.zeros(len(whole), np.int64)
        smallest[order] = np.repeat(np.minimum.reduceat(least[order], at), np.diff(np.append(at, len(whole))))
        sender = np.repeat(np.arange(len(parts)), [len(p[5]) for p in parts])
        for k in np.flatnonzero(smallest < least + more).tolist():
            found[sender[k]].append((whole[k], 0, LEAST, smallest[k]))
    sizes = [len(p[0]) for p in parts]
    group = np.concatenate([np.cumsum(p[0], dtype=np.uint32) for p in parts])
    least, more, size, data = (np.concatenate([p[i] for p in parts]) for i in (1, 2, 3, 4))
    most, size = least + more, size.astype(np.int64)
    content = contents(data, size)
    ends = np.cumsum(size)
    sender = np.repeat(np.arange(len(parts)), sizes)
    order = np.lexsort((content, group))
    g, c = group[order], content[order]
    new = np.concatenate([[True], (g[1:] != g[:-1]) | (c[1:] != c[:-1])])[: len(order)]
    at = np.flatnonzero(new)
    which = np.cumsum(new) - 1  # the different string of each row of order
    smallest, greatest = (np.minimum.reduceat(least[order], at), np.maximum.reduceat(most[order], at)) if len(at) else (at, at)
    covers: dict[int, list[tuple[int, int, int]]] = {}
    for k in np.flatnonzero(smallest < greatest).tolist():
        covers[k] = [(0, int(size[order[at[k]]]), int(smallest[k]))]
    first = np.flatnonzero(np.concatenate([[True], g[at][1:] != g[at][:-1]])[: len(at)])
    last = np.append(first[1:], len(at))[: len(first)]
    raw = data.tobytes()
    for a, b in zip(first[last - first > 1].tolist(), last[last - first > 1].tolist(), strict=True):
        texts = [raw[ends[i] - size[i] : ends[i]] for i in order[at[a:b]]]
        for length, seen in maximal_repeats(texts):
            m = min(int(smallest[a + t]) for t, _ in seen)
            for t, i in seen:
                if m < greatest[a + t]:
                    covers.setdefault(a + t, []).append((i, length, m))
    for row, k in zip(order.tolist(), which.tolist(), strict=True):
        for i, n, m in covers.get(k, ()):
            if m < most[row]:
                found[sender[row]].append((content[row], i, n, m))
    out = []
    for batch, f in zip(table["batch"].to_pylist(), found, strict=True):
        if f:
            x = [np.array([e[i] for e in f], k) for i, k in enumerate((np.uint64, np.uint8, np.uint8, np.int64))]
            out.append((batch, key[0].as_py(), _blob(*x)))
    return _rows(out, ["batch", "bucket", "blob"], [pa.int64(), pa.int32(), pa.binary()])


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<first:long,length:long>>"


def _apply(key, table, covers):
    """Results of a batch's documents: covered bytes of each go where a smaller document covers them."""
    import hashlib

    import numpy as np
    import pyarrow as pa

    x = Batch(table)
    gone = np.zeros(len(x.data) + 1, np.int32)
    parts = [_unblob(b, np.uint64, np.uint8, np.uint8, np.int64) for b in covers["blob"].to_pylist()]
    if parts and len(x.start):
        content, first, length, owner = (np.concatenate([p[i] for p in parts]) for i in range(4))
        order = np.argsort(content, kind="stable")
        content, first, length, owner = content[order], first[order].astype(np.int64), length[order].astype(np.int64), owner[order]

        def mark(keys, start, doc):
            lo, hi = np.searchsorted(content, keys), np.searchsorted(content, keys, "right")
            n = hi - lo
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
            s, d = np.repeat(start, n), np.repeat(doc, n)
            ok = owner[at] < d
            np.add.at(gone, s[ok] + first[at[ok]], 1)
            np.add.at(gone, s[ok] + first[at[ok]] + length[at[ok]], -1)

        mark(x.content, x.start, x.doc)
        some = np.zeros(1 << 16, bool)
        some[content >> np.uint64(48)] = True
        power, back = _powers()
        for at in range(int(x.offsets[0]), int(x.offsets[-1]), CHUNK - LEAST + 1):
            piece = x.data[at : min(at + CHUNK, int(x.offsets[-1]))]
            if len(piece) < LEAST:
                break
            total = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * power[: len(piece)], out=total[1:])
            h = _mix((total[LEAST:] - total[:-LEAST]) * back[: len(total) - LEAST])
            s = np.flatnonzero(some[h >> np.uint64(48)])
            a = np.searchsorted(content, h[s])
            s = s[content[np.minimum(a, len(content) - 1)] == h[s]]
            text = np.searchsorted(x.offsets, s + at, "right") - 1
            inside = s + at + LEAST <= x.offsets[text + 1]
            mark(h[s][inside], s[inside] + at, x.ids[text[inside]])
    gone = np.cumsum(gone)[:-1] > 0
    out = []
    for i in range(len(x.ids)):
        a, b = int(x.offsets[i]), int(x.offsets[i + 1])
        m = gone[a:b]
        edge = np.flatnonzero(np.diff(np.concatenate([[0], m.view(np.int8), [0]])))
        spans = [{"first": int(p), "length": int(q - p)} for p, q in zip(edge[::2], edge[1::2], strict=True)]
        out.append((int(x.ids[i]), b - a, int(m.sum()), len(spans), hashlib.sha256(x.data[a:b][~m].tobytes()).hexdigest(), spans))
    span = pa.list_(pa.struct([("first", pa.int64()), ("length", pa.int64())]))
    return _rows(out, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"], [pa.int64()] * 4 + [pa.string(), span])


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """RESULT for each row of docs: the bytes covered by a string of LEAST bytes that also starts in a document with a smaller id.

    Texts are UTF-8 bytes; null counts as empty. A document whose text a smaller id has goes as a whole, or stays as a whole
    if it is shorter than LEAST. The others go through the suffix arrays. Rows of one id don't remove each other's bytes; rows
    with a null id keep all theirs and remove none. Repeated rows come back as often as they are in docs; no rows give none.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    key = F.sha2(F.col("text").cast("binary"), 256)
    slim = saved(docs.select("doc_id", key.alias("h"), F.octet_length("text").cast("long").alias("n")))
    first = saved(slim.filter("doc_id is not null").groupBy("h").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("k")))
    copies = saved(join_hot(slim.filter("doc_id is not null"), first, "h", "k").filter("doc_id > first_id").select("doc_id", "h", "n"))
    apart = small(saved(copies.select("doc_id", F.unhex("h").alias("h")).distinct()), 500_000)  # 40 bytes a row
    total = slim.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n_batches, n_buckets = max(GROUPS, total // BATCH + 1), max(GROUPS, total // (BUCKET * 4) + 1)
    rest = docs.filter("doc_id is not null").withColumn("h", F.unhex(key)).join(apart, ["doc_id", "h"], "left_anti")
    by_batch = rest.select(F.pmod(F.xxhash64("doc_id", "h"), F.lit(n_batches)).alias("batch"), "doc_id", "text")
    by_batch = by_batch.mapInArrow(_packed, "batch long, blob binary").groupBy("batch")
    sent, back = "bucket int, batch long, blob binary", "batch long, bucket int, blob binary"
    flags = by_batch.applyInArrow(_first(n_buckets), sent).groupBy("bucket").applyInArrow(_flags, back)
    strings_ = by_batch.cogroup(flags.groupBy("batch")).applyInArrow(_second(n_buckets), sent)
    covers = strings_.groupBy("bucket").applyInArrow(_covers, back)
    found = by_batch.cogroup(covers.groupBy("batch")).applyInArrow(_apply, RESULT)

    def at_once(rows: DataFrame, gone) -> DataFrame:
        zero, none = F.lit(0).cast("long"), F.array().cast("array<struct<first:bigint,length:bigint>>")
        sha = F.when(gone, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.col("h"))
        spans = F.when(gone, F.array(F.struct(zero.alias("first"), F.col("n").alias("length")))).otherwise(none)
        return rows.select("doc_id", F.col("n").alias("n_bytes"), F.when(gone, F.col("n")).otherwise(zero).alias("n_removed"), gone.cast("long").alias("n_spans"), sha.alias("kept_sha256"), spans.alias("spans"))

    return found.unionByName(at_once(copies, F.col("n") >= LEAST)).unionByName(at_once(slim.filter("doc_id is null"), F.lit(False)))
