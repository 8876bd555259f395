"""Character and byte-pair tokenizers."""

from __future__ import annotations

import hashlib
import heapq
import json
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words that pairs never cross: endings, letters, numbers, signs with a space before, and white space.
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def char_vocabulary(df: DataFrame, text: str = "text") -> DataFrame:
    """(ch, token): the different characters, numbered in order."""
    from pyspark.sql import Window

    chars = df.select(F.explode(F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))).alias("ch")).distinct()
    return chars.withColumn("token", F.row_number().over(Window.orderBy("ch")) - 1)


def pair_counts(df: DataFrame, ids: str) -> DataFrame:
    """(a, b, n): neighbouring pairs, overlapping ones counted each. Pairs are counted within batches first, so a row for each
    different pair of a batch is what is shuffled. Tokens are ints; null documents have none."""

    def counted(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            lists = batch.column(0)
            flat, n = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            if len(flat) < 2:
                continue
            first = np.ones(len(flat) - 1, bool)  # where the next token is of the same document
            ends = np.cumsum(n)
            first[ends[(ends > 0) & (ends < len(flat))] - 1] = False
            pairs, k = np.unique((flat[:-1][first] << 32) | flat[1:][first], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array((pairs >> 32).astype(np.int32)), pa.array((pairs & 0xFFFFFFFF).astype(np.int32)), pa.array(k.astype(np.int64))], ["a", "b", "k"])

    return df.select(ids).mapInArrow(counted, "a int, b int, k long").groupBy("a", "b").agg(F.sum("k").alias("n"))


def word_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): the distributed part of training; what is left is as large as the vocabulary of words."""
    return df.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(WORDS), F.lit(0))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def merge(ids: list[int], pair: tuple[int, int], new: int) -> list[int]:
    """Left to right, without overlap."""
    out, i = [], 0
    while i < len(ids):
        if i + 1 < len(ids) and (ids[i], ids[i + 1]) == pair:
            out.append(new)
            i += 2
        else:
            out.append(ids[i])
            i += 1
    return out


def _first(pair: tuple[int, int], among: set[int], words: list[list[int]]) -> tuple[int, int]:
    """Where a pair occurs first: word and place."""
    for i in sorted(among):
        for k, p in enumerate(zip(words[i], words[i][1:], strict=False)):
            if p == pair:
                return i, k
    return len(words), 0


class BytePairs:
    """Byte-pair merges: specials first, then the 256 bytes, then merges in order."""

    def __init__(self, merges: list[tuple[int, int]], specials: list[str] = ()):
        self.merges, self.specials = [tuple(m) for m in merges], list(specials)
        self.base = len(self.specials)
        self.rank = {m: self.base + 256 + i for i, m in enumerate(self.merges)}
        self.bytes = {self.base + b: bytes([b]) for b in range(256)}
        for (a, b), i in self.rank.items():
            self.bytes[i] = self.bytes[a] + self.bytes[b]
        self.word = lru_cache(maxsize=65_536)(self._word)

    @classmethod
    def train(cls, counts: list[tuple[str, int]], size: int, specials: list[str] = (), least: int = 2) -> BytePairs:
        """Most frequent pair first, ties by first occurrence in the words' order; ends at the size or below `least`."""
        if size < 256 + len(specials):
            raise ValueError("vocabulary size must be at least 256 and the specials")
        base = len(specials)
        words = [[base + b for b in w.encode("utf-8", "replace")] for w, _ in counts]
        times = [n for _, n in counts]
        seen: dict[tuple[int, int], int] = {}
        at: dict[tuple[int, int], set[int]] = {}  # words that may hold a pair
        for i, ids in enumerate(words):
            for p in zip(ids, ids[1:], strict=False):
                seen[p] = seen.get(p, 0) + times[i]
                at.setdefault(p, set()).add(i)
        heap = [(-n, p) for p, n in seen.items()]
        heapq.heapify(heap)
        merges: list[tuple[int, int]] = []
        while base + 256 + len(merges) < size and heap:
            n = -heap[0][0]
            tied: set[tuple[int, int]] = set()
            while heap and -heap[0][0] == n:
                p = heapq.heappop(heap)[1]
                if seen.get(p) == n:  # older counts are stale
                    tied.add(p)
            if not tied:
                continue
            if n < least:
                break
            best = min(tied, key=lambda p: _first(p, at[p], words)) if len(tied) > 1 else next(iter(tied))
            new, changed = base + 256 + len(merges), tied - {best}
            merges.append(best)
            for i in at.pop(best):
                ids = words[i]
                words[i] = merged = merge(ids, best, new)
                if len(merged) == len(ids):
                    continue
                for sign, form in ((-1, ids), (1, merged)):
                    for p in zip(form, form[1:], strict=False):
                        seen[p] = seen.get(p, 0) + sign * times[i]
                        changed.add(p)
                        if sign > 0:
                            at.setdefault(p, set()).add(i)
            seen.pop(best, None)
            for p in changed - {best}:
                if seen.get(p, 0) > 0:
                    heapq.heappush(heap, (-seen[p], p))
        return cls(merges, specials)

    @classmethod
    def train_stream(cls, texts, size: int, specials: list[str] = (), least: int = 2) -> BytePairs:
        """As train(), over one stream of all texts, in which pairs cross words and documents; ties by first occurrence.

        The stream is held on the driver, so it is for samples of some millions of bytes.
        """
        import numpy as np

        if size < 256 + len(specials):
            raise ValueError("vocabulary size must be at least 256 and the specials")
        base, merges = len(specials), []
        ids = np.frombuffer("".join(texts).encode("utf-8", "replace"), np.uint8).astype(np.int64) + base
        while base + 256 + len(merges) < size and len(ids) > 1:
            pairs, first, n = np.unique((ids[:-1] << 32) | ids[1:], return_index=True, return_counts=True)
            if n.max() < least:
                break
            best = pairs[n == n.max()][first[n == n.max()].argmin()]
            a, b = int(best >> 32), int(best & 0xFFFFFFFF)
            at = np.flatnonzero((ids[:-1] == a) & (ids[1:] == b))
            if a == b:  # of a run of places one after the other every second one counts
                start = np.concatenate([[True], np.diff(at) > 1])
                run = np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - run) % 2 == 0]
            ids[at] = base + 256 + len(merges)
            ids = np.delete(ids, at + 1)
            merges.append((a, b))
        return cls(merges, specials)

    @property
    def vocab_size(self) -> int:
        return self.base + 256 + len(self.merges)

    def _word(self, word: str) -> tuple[int, ...]:
        ids = [self.base + b for b in word.encode("utf-8", "replace")]
        while len(ids) > 1:
            pair = min(zip(ids, ids[1:], strict=False), key=lambda p: self.rank.get(p, 1 << 60))
            if pair not in self.rank:
                break
            ids = merge(ids, pair, self.rank[pair])
        return tuple(ids)

    def encode(self, text: str) -> list[int]:
        """Special strings are one token each; the rest word by word."""
        import regex

        parts = regex.split("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")", text) if self.specials else [text]
        out: list[int] = []
        for p in parts:
            if p in self.specials:
                out.append(self.specials.index(p))
            else:
                for w in regex.findall(WORDS, p):
                    out.extend(self.word(w))
        return out

    def decode(self, ids: list[int], skip_special: bool = False) -> str:
        return b"".join((b"" if skip_special else self.specials[i].encode()) if i < self.base else self.bytes[i] for i in ids).decode("utf-8", "replace")

    def to_json(self) -> str:
        return json.dumps({"merges": self.merges, "specials": self.specials})

    @classmethod
    def from_json(cls, text: str) -> BytePairs:
        data = json.loads(text)
        if "merges" not in data:
            raise ValueError("not a byte-pair tokenizer")
        return cls([tuple(m) for m in data["merges"]], data["specials"])

    def __reduce__(self):
        return BytePairs, (self.merges, self.specials)

    @property
    def fingerprint(self) -> str:
        return hashlib.blake2b(self.to_json().encode(), digest_size=6).hexdigest()

    def special_id(self, token: str) -> int:
        if token not in self.specials:
            raise ValueError(f"missing special token: {token}")
        return self.specials.index(token)


class Pretrained:
    """A public tokenizer file (tokenizer.json) with the same methods as BytePairs."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.path, self._model = path, Tokenizer.from_file(path)

    @property
    def vocab_size(self) -> int:
        return self._model.get_vocab_size()

    def encode(self, text: str) -> list[int]:
        return self._model.encode(text, add_special_tokens=False).ids

    def decode(self, ids: list[int], skip_special: bool = False) -> str:
        return self._model.decode(list(ids), skip_special_tokens=skip_special)

    def special_id(self, token: str) -> int:
        if (found := self._model.token_to_id(token)) is None:
            raise ValueError(f"missing special token: {token}")
        return found

    @property
    def fingerprint(self) -> str:
        return hashlib.blake2b(self._model.to_str().encode(), digest_size=6).hexdigest()

    def __reduce__(self):  # executors read the file's content, not its path
        return _pretrained, (self.path, self._model.to_str())


def _pretrained(path: str, content: str) -> Pretrained:
    from tokenizers import Tokenizer

    made = Pretrained.__new__(Pretrained)
    made.path, made._model = path, Tokenizer.from_str(content)
    return made


def encode_column(spark, tokenizer: BytePairs):
    """A function from a text column to its tokens, in Arrow batches, with the tokenizer broadcast."""
    shared = spark.sparkContext.broadcast(tokenizer)

    def run(texts):
        import pyarrow as pa

        t = shared.value
        return pa.array([None if x is None else t.encode(x) for x in texts.to_pylist()], pa.list_(pa.int32()))

    return F.arrow_udf(run, T.ArrayType(T.IntegerType()))
