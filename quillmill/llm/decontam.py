"""Benchmark decontamination by winnowed word k-grams."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, runs, utf8

WINDOW, GRAM = 10, 5
#: Characters of benchmark text that one broadcast index holds; a larger benchmark goes through the documents in blocks.
BLOCK_CHARS = 16_000_000
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
RESULT = "n_words long, items array<string>, spans array<struct<first:long,last:long>>"


class Words:
    """Word hashes of many texts at once. data: bytes; offsets: where texts begin and end; text i has words first[i]:first[i + 1]."""

    FACTOR = 0x9E3779B97F4A7C15

    def __init__(self, data, offsets):
        import numpy as np

        size = int(offsets[-1] - offsets[0])
        data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        kind = np.zeros(256, np.uint8)
        for c in range(256):
            if WORD.fullmatch(bytes([c]).lower()):
                kind[c] = bytes([c]).lower()[0]
        low = kind[data]
        word = low > 0
        begin = word.copy()
        begin[1:] &= ~word[:-1]
        at = offsets[:-1][offsets[:-1] < offsets[1:]]
        begin[at] = word[at]
        self.starts = np.flatnonzero(begin)
        stop = np.zeros(size + 1, bool)
        stop[1:] = word
        stop[1:-1] &= ~word[1:] | begin[1:]
        self.ends = np.flatnonzero(stop)
        self.first = np.searchsorted(self.starts, offsets)
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        self.text = text
        # a word's hash: the sum of its bytes times powers of an odd factor, moved to the word's start by the inverse power
        f = np.uint64(self.FACTOR)
        power = np.full(size + 1, f)
        back = np.full(size + 1, np.uint64(pow(self.FACTOR, -1, 1 << 64)))
        power[0] = back[0] = 1
        np.multiply.accumulate(power, out=power)
        np.multiply.accumulate(back, out=back)
        total = np.zeros(size + 1, np.uint64)
        np.cumsum((low.astype(np.uint64) + np.uint64(1)) * power[:-1], out=total[1:])
        h = (total[self.ends] - total[self.starts]) * back[self.starts]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        self.hash = h ^ (h >> np.uint64(32))

    def grams(self, n: int):
        """Hashes of n consecutive words, and which of them lie in one text."""
        import numpy as np

        m = max(0, len(self.hash) - n + 1)
        total = np.zeros(m, np.uint64)
        for j in range(n):
            total = total * np.uint64(0xD6E8FEB86659FD93) + self.hash[j : j + m]
        total ^= total >> np.uint64(31)
        total *= np.uint64(0x94D049BB133111EB)
        return total, self.text[:m] == self.text[n - 1 : n - 1 + m]

    def winnowed(self):
        """Positions and hashes of the GRAM-grams that are least in some window of WINDOW words; of equal ones, all."""
        import numpy as np

        g, whole = self.grams(GRAM)
        wide = WINDOW - GRAM + 1
        if len(g) < wide:
            return np.zeros(0, np.int64), g[:0]
        g = np.where(whole, g, np.uint64(0xFFFFFFFFFFFFFFFF))
        m = len(g) - wide + 1
        least = g[:m].copy()
        for j in range(1, wide):
            np.minimum(least, g[j : j + m], out=least)
        kept = np.zeros(len(g), bool)
        for j in range(wide):
            kept[j : j + m] |= g[j : j + m] == least
        kept &= whole
        at = np.flatnonzero(kept)
        return at, g[at]


class Index:
    """Fingerprints of benchmark items (id, text)."""

    def __init__(self, items: list[tuple[str, str]]):
        import numpy as np

        self.ids = [str(i) for i, _ in items]
        texts = [(t or "").encode("utf-8", "surrogatepass") for _, t in items]
        self.words = [WORD.findall(t.lower()) for t in texts]
        w = Words(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64))
        at, g = w.winnowed()
        pairs: dict[int, list[tuple[int, int]]] = {}
        for p, h in zip(at.tolist(), g.tolist(), strict=True):
            i = int(w.text[p])
            pairs.setdefault(h, []).append((i, p - int(w.first[i])))
        self.sizes = {GRAM: pairs}
        for i, words in enumerate(self.words):  # an item shorter than a window is looked up as a whole
            if 0 < (n := len(words)) < WINDOW:
                p = int(w.first[i])
                self.sizes.setdefault(-n, {}).setdefault(int(w.grams(n)[0][p]), []).append((i, 0))
        self.sorted = {n: np.array(sorted(x), np.uint64) for n, x in self.sizes.items() if x}
        self.marks = {}
        for n, hashes in self.sorted.items():
            self.marks[n] = np.zeros(1 << 16, bool)
            self.marks[n][hashes >> np.uint64(48)] = True

    def hits(self, w: Words):
        """(position, size, hash) of words of w that begin a fingerprint of this index."""
        import numpy as np

        out = []
        for n, hashes in self.sorted.items():
            if n > 0:
                at, g = w.winnowed()
            else:
                g, whole = w.grams(-n)
                at = np.flatnonzero(whole)
                g = g[at]
            maybe = self.marks[n][g >> np.uint64(48)]
            at, g = at[maybe], g[maybe]
            found = hashes[np.minimum(np.searchsorted(hashes, g), len(hashes) - 1)] == g
            out += [(p, n, h) for p, h in zip(at[found].tolist(), g[found].tolist(), strict=True)]
        return sorted(out)

    def extend(self, words: list[bytes], hits: list[tuple[int, int, int]]):
        """Items that occur in a text of these words, and the spans of words hit. hits: as of hits(), from the text's start."""
        items, spans, done = set(), [], {}
        for p, n, h in hits:
            for i, j in self.sizes[n][h]:
                item, shift = self.words[i], p - j
                if done.get((i, shift), -1) > p:
                    continue
                a = b = p
                if n < 0:
                    if words[p : p - n] == item:
                        spans.append((p, p - n))
                        items.add(i)
                    continue
                while a > 0 and a > shift and words[a - 1] == item[a - 1 - shift]:
                    a -= 1
                while b < len(words) and b - shift < len(item) and words[b] == item[b - shift]:
                    b += 1
                done[i, shift] = b
                if b - a >= WINDOW:
                    spans.append((a, b))
                    items.add(i)
        joined: list[list[int]] = []
        for a, b in sorted(spans):
            if joined and a <= joined[-1][1]:
                joined[-1][1] = max(joined[-1][1], b)
            else:
                joined.append([a, b])
        return sorted({self.ids[i] for i in items}), joined

    def find(self, texts) -> list[dict]:
        data, offsets = utf8(texts)
        out = []
        for a, b in runs(offsets):
            w = Words(data, offsets[a : b + 1])
            by: dict[int, list] = {}
            for p, n, h in self.hits(w):
                i = int(w.text[p])
                by.setdefault(i, []).append((p - int(w.first[i]), n, h))
            for i in range(b - a):
                items, spans = [], []
                if i in by:
                    items, spans = self.extend(WORD.findall(data[offsets[a + i] : offsets[a + i + 1]].tobytes().lower()), by[i])
                out.append({"n_words": int(w.first[i + 1] - w.first[i]), "items": items, "spans": [{"first": x, "last": y - 1} for x, y in spans]})
        return out


def overlaps(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", out_col: str = "overlap") -> DataFrame:
    """docs with a struct (n_words, items, spans): ids of the benchmark items that share a window, and the words hit.

    Ten consecutive words of an item are a window; an item of fewer, but not none, is one. Null and wordless texts on either
    side share nothing. Repeated documents each get their result; of repeated item ids one is named, and a null id counts as "".
    An empty benchmark hits nothing. A column of docs named out_col gives way. The index of a benchmark up to BLOCK_CHARS is broadcast; a larger one goes in blocks of
    about that size, one after the other, and the blocks' results are joined row by row.
    """
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), F.coalesce("text", F.lit("")).alias("t"))
    size = items.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    blocks = -(-size // BLOCK_CHARS) or 1
    kept = [c for c in docs.columns if c.lower() != out_col.lower()]
    parts, names = docs, []
    for k in range(blocks):
        index = docs.sparkSession.sparkContext.broadcast(Index([tuple(r) for r in items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k).orderBy("i", "t").collect()]))

        def find(texts, index=index):
            import pyarrow as pa

            return pa.array(index.value.find(texts), pa.struct([("n_words", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))]))

        names.append(free_name(parts, out_col))
        parts = parts.withColumn(names[-1], F.arrow_udf(find, RESULT)(F.col(text_col)))
    if blocks == 1:
        return parts.select(*kept, F.col(names[0]).alias(out_col))
    every = lambda f: F.flatten(F.array(*[F.col(n)[f] for n in names]))
    words = F.array_sort(F.array_distinct(F.flatten(F.transform(every("spans"), lambda s: F.sequence(s["first"], s["last"])))))
    spans = F.transform(words, lambda x: F.struct(x.alias("first"), x.alias("last")))
    merged = F.struct(F.col(names[0])["n_words"].alias("n_words"), F.array_sort(F.array_distinct(every("items"))).alias("items"), spans.alias("spans"))
    return parts.select(*kept, merged.alias(out_col))


def n_hit(overlap):
    """Words within the spans of an overlap."""
    return F.aggregate(overlap["spans"], F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs, all columns, without the rows that share a window with a benchmark item."""
    name = free_name(docs)
    return overlaps(docs, benchmark, out_col=name).filter(F.size(F.col(name)["items"]) == 0).drop(name)
