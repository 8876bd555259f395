"""Cleaning of text, all in the JVM but for Unicode normalisation and escapes."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What right results need.
ZERO_WIDTH = "​‌‍⁠﻿"
WIDE_SPACES = "    "
BOILERPLATE = [
    r".*copyright\s*(©|\(c\)).*",
    r".*all\s+rights\s+reserved.*",
    r".*smashwords.*",
    r".*cover\s+art\s+(created|by|design).*",
    r"this\s+ebook\s+is\s+licensed.*",
    r".*may\s+not\s+be\s+re-?sold.*",
    r".*no\s+part\s+of\s+this\s+(book|publication)\s+may\s+be\s+reproduced.*",
    r"(isbn[- ]?(1[03])?[:\s].*)",
    r"(https?://\S+|www\.\S+)",
    r"\d{6,10}",
]
BOILERPLATE_SOURCES = ("bookcorpus", "gutenberg", "pg19")
#: White space of any script.
BLANK = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value made once for each row, however often it is named and whatever the optimizer puts together."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def where_it_has(c: Column, part: str, use: Callable[[Column], Column]) -> Column:
    """use(c) where the text has a part, a quick search; other texts stay."""
    return once(c, lambda t: F.when(F.contains(t, F.lit(part)), use(t)).otherwise(t))


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


@F.arrow_udf(T.StringType())
def _nfc(texts):
    import pyarrow as pa

    return pa.array([None if t is None else unicodedata.normalize("NFC", t) for t in texts.to_pylist()], pa.string())


def nfc(c: Column) -> Column:
    """NFC; of ASCII texts Python gets a null instead."""
    return F.when(is_ascii(c), c).otherwise(_nfc(F.when(~is_ascii(c), c)))


def strip(c: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.btrim(c, F.lit(BLANK))


def collapse_blank_lines(c: Column) -> Column:
    return where_it_has(c, "\n\n\n", lambda t: F.regexp_replace(t, r"\n{3,}", "\n\n"))


def normalize(c: Column, unicode: bool = True) -> Column:
    """NFC, zero-width characters away, wide spaces to spaces, line ends, blanks at line ends, blank runs, ends; null stays."""
    c = nfc(c) if unicode else c
    # characters without a counterpart go
    c = once(c, lambda t: F.when(is_ascii(t), t).otherwise(F.when(F.regexp_like(t, F.lit(f"[{WIDE_SPACES}{ZERO_WIDTH}]")), F.translate(t, WIDE_SPACES + ZERO_WIDTH, " " * len(WIDE_SPACES))).otherwise(t)))
    c = where_it_has(c, "\r", lambda t: F.regexp_replace(t, r"\r\n?", "\n"))
    c = once(c, lambda t: F.when(F.contains(t, F.lit(" \n")) | F.contains(t, F.lit("\t\n")), F.regexp_replace(t, r"(?<![ \t])[ \t]+(?=\n)", "")).otherwise(t))
    return strip(collapse_blank_lines(c))


#: What a line of boilerplate has at least.
HINT = r"(?iU)copyright|rights|smashwords|cover|ebook|sold|reproduced|isbn|http|www|\d{6}"


def strip_boilerplate(c: Column) -> Column:
    """Without whole lines of publishing boilerplate."""
    pattern = r"(?iU)^\s*(" + "|".join(BOILERPLATE) + r")\s*$"
    lines = lambda t: F.array_join(F.filter(F.split(t, "\n"), lambda line: ~F.when(F.regexp_like(line, F.lit(HINT)), F.regexp_like(line, F.lit(pattern))).otherwise(False)), "\n")
    return once(c, lambda t: F.when(F.regexp_like(t, F.lit(HINT)), lines(t)).otherwise(t))


def clean(c: Column, source: Column, unicode: bool = True) -> Column:
    """normalize() for all; sources of ebooks also lose their boilerplate lines."""
    n = normalize(c, unicode)
    return F.when(source.isin(*BOILERPLATE_SOURCES), strip(collapse_blank_lines(strip_boilerplate(n)))).otherwise(n)


def unescape(text: str) -> str:
    r"""Runs of \uXXXX in one text decoded as UTF-16."""
    return re.sub(r"(?:\\u[0-9a-fA-F]{4})+", lambda m: bytes.fromhex(m.group(0).replace("\\u", "")).decode("utf-16-be", "replace"), text)


@F.arrow_udf(T.StringType())
def _unescape(texts):
    import pyarrow as pa

    return pa.array([None if t is None else unescape(t) for t in texts.to_pylist()], pa.string())


def decode_escapes(c: Column) -> Column:
    r"""Runs of \uXXXX decoded as UTF-16; unpaired surrogates become U+FFFD. Python gets only the texts that have some."""
    has = F.contains(c, F.lit("\\u"))
    return F.when(has, _unescape(F.when(has, c))).otherwise(c)


def code_points(c: Column) -> Column:
    """The text's code points, an array of ints."""
    return F.when(c == "", F.array().cast("array<int>")).otherwise(F.transform(F.split(c, ""), lambda x: F.ascii(x)))


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def code_point_ids(texts):
    """As code_points(), a batch at a time."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    n = pc.utf8_length(texts)
    data = np.frombuffer("".join(t for t in texts.to_pylist() if t).encode("utf-32-le", "surrogatepass"), np.int32)
    ends = np.concatenate([[0], np.cumsum(n.fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(data), mask=n.is_null() if n.null_count else None)


def path(name: str) -> Column:
    """A dotted path; numbers index arrays from 0, null where there is no such element."""
    first, *rest = name.split(".")
    c = F.col(first)
    for p in rest:
        c = F.get(c, F.lit(int(p))) if p.isdigit() else c[p]
    return c
