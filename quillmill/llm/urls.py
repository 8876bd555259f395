"""URL filters: rules by host and path, and a logistic regression on hashed character n-grams of both."""

from __future__ import annotations

import hashlib
import random
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

#: (host/path, verdict)
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
SIZES, BUCKETS, SCALE = (3, 4, 5), 4096, 10_000
#: Words of the labelled table's hosts and paths: what to block, what to allow, and what stands beside both.
BLOCKED = "casino poker slots jackpot bets betting roulette gambling lottery bookmaker pills pharmacy viagra cialis steroids porn xxx adult escort hookup webcam payday loan debt crypto forex doubler replica fakes warez crack keygen torrent phish spam clickbait adserver popup tracker banner malware prize freebie weightloss cheap free win bonus ads farm rich".split()
ALLOWED = "museum library university garden recipes weather history science journal gazette herald tribune hospital council railway theatre orchestra gallery archive observatory botany cycling hiking cooking knitting carpentry astronomy geology chemistry grammar poetry novels github stackoverflow wikipedia nytimes python kernel docs school news travel maps health sports music film photo kitchen house market road mountain river forest island village bridge harbour".split()
BESIDE = "my the online hub daily city open top best world club zone net web live now shop site blog land life".split()
SUBS, TOPS = ["", "", "www.", "blog.", "m.", "en."], ["example.com", "example.org", "example.net", "com", "org", "net", "de", "co.uk"]
ALLOWED_PATHS = ["/", "/en/12", "/fr/345/", "/de/67.html", "/es/890", "/news/2020/05/", "/about", "/wiki/Main_Page", "/questions/1/how-to", "/torvalds/linux", "/section/world", "/docs/api.html", ""]
BLOCKED_PATHS = ["/casino/bonus", "/buy-pills/cheap", "/free-bets/win", "/ads/click", "/xxx/video", "/win/prize", "/payday-loan", "/torrent/get"]
#: A row of the table counts its n-grams in parts of NORM, for even steps.
ROWS, SEED, STEPS, RATE, RIDGE, NORM = 2400, 17, 300, 0.1, 0.0001, 5.0


def host_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z in lower case, and path; both empty for null or without ://."""
    url = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(url, "://([^/?#]*)", 1)), F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1)


def labelled(rows: int = ROWS) -> list[tuple[str, str, int]]:
    """The small labelled table, made by rules: (host, path, 1 to block). A host is a made-up name or holds a word; a host or a
    path with a word of BLOCKED is to be blocked, an address without either isn't."""
    r = random.Random(SEED)

    def made_up() -> str:
        parts = ["".join(r.sample(["", r.choice("bcdfghklmnprstvw"), r.choice(["th", "st", "nd", "ch", "tr", ""])], 2)) + r.choice(["a", "e", "i", "o", "u", "ea", "ou", "io"]) + r.choice(["", "", "n", "r", "s", "l", "t", "d"]) for _ in range(r.randint(1, 4))]
        return "".join(parts)

    def host(words: list[str]) -> str:
        name = [r.choice(words), *r.sample([r.choice(BESIDE), made_up(), r.choice(words)], r.randint(0, 1))]
        r.shuffle(name)
        return r.choice(SUBS) + r.choice(["", "-"]).join(name) + "." + r.choice(TOPS)

    out = []
    for i in range(rows):
        if i % 12 == 11:  # a harmless host, and a path that isn't
            out.append((host(ALLOWED), r.choice(BLOCKED_PATHS), 1))
        elif i % 3 == 1:
            out.append((host(BLOCKED), r.choice(ALLOWED_PATHS), 1))
        else:
            out.append((host(ALLOWED if i % 2 else [made_up()]), r.choice(ALLOWED_PATHS), 0))
    return out + [("", "", 0)] * 40


def parts(host: str, path: str) -> list[str]:
    """Each n-gram of the marked host and path, with the sign of its part before."""
    return [k + s[i : i + n] for k, s in (("h", f"^{host}$"), ("p", f"^{path}$")) for n in SIZES for i in range(len(s) - n + 1)]


def bucket(gram: str) -> int:
    return int(hashlib.md5(gram.encode()).hexdigest()[:3], 16)


def fit_rows(table: list[tuple[str, str, int]]) -> tuple[list[int], int]:
    """(weight of each bucket, bias), in units of 1 / SCALE, so that sums are exact; gradient descent over the table, with steps
    that shrink where slopes have been steep."""
    import numpy as np

    grams = [[bucket(g) for g in parts(host, path)] for host, path, _ in table]
    row, column = np.repeat(np.arange(len(table)), [len(g) for g in grams]), np.array([b for g in grams for b in g])
    y = np.array([label for *_, label in table], np.float64)
    w, b, seen = np.zeros(BUCKETS), 0.0, np.full(BUCKETS, 1e-8)
    for _ in range(STEPS):
        miss = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[column], len(y)) / NORM + b, -30, 30))) - y
        slope = np.bincount(column, miss[row], BUCKETS) / (NORM * len(y)) + RIDGE * w
        seen += slope**2
        w -= RATE * slope / np.sqrt(seen)
        b -= miss.mean()
    return [round(v / NORM * SCALE) for v in w.tolist()], round(b * SCALE)


@lru_cache(maxsize=1)
def fit() -> tuple[list[int], int]:
    """The regression over the whole labelled table."""
    return fit_rows(labelled())


def logit(host: Column, path: Column) -> Column:
    """The regression's sum in units of 1 / SCALE, a long."""
    w, bias = fit()
    weights = F.from_json(F.lit(str(w)), "array<bigint>")

    def grams(k: str, s: Column, n: int) -> Column:
        s = F.concat(F.lit("^"), s, F.lit("$"))
        last = F.length(s) - (n - 1)
        each = F.transform(F.sequence(F.lit(1), last), lambda i: F.concat(F.lit(k), F.substring(s, i, F.lit(n))))
        return F.when(last > 0, each).otherwise(F.array().cast("array<string>"))

    every = F.concat(*[grams(k, s, n) for k, s in (("h", host), ("p", path)) for n in SIZES])
    at = lambda g: F.conv(F.substring(F.md5(g.cast("binary")), 1, 3), 16, 10).cast("int")
    return F.aggregate(every, F.lit(bias).cast("bigint"), lambda a, g: a + F.get(weights, at(g)))


def rule(host: Column, path: Column, rules: list[tuple[str, str]] = RULES) -> Column:
    """The longest rule that fits: its host is the url's or above it, and the url's path starts with its path; else null."""
    out = F.lit(None).cast("string")
    for r in sorted((r for r, _ in rules), key=len):
        h, _, p = r.partition("/")
        out = F.when(((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit("/" + p)), F.lit(r)).otherwise(out)
    return out


def judge(pages: DataFrame, url_col: str = "url", rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """(all columns, and host, path, rule, logit, verdict): the rule's verdict, else block where the regression's sum is above 0.

    Null urls and such without :// have empty host and path, which no rule fits and the regression allows. Columns of pages
    with these names give way. rules is a short literal list; of rules of one length that fit, the later one counts.
    """
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "logit", "verdict")]
    host, path = host_path(F.col(url_col))
    rows = pages.select(*kept, host.alias("host"), path.alias("path"))
    rows = rows.select("*", rule(F.col("host"), F.col("path"), rules).alias("rule"), logit(F.col("host"), F.col("path")).alias("logit"))
    verdict = F.when(F.col("logit") > 0, "block").otherwise("allow")
    for r, v in rules:
        verdict = F.when(F.col("rule") == r, v).otherwise(verdict)
    return rows.select("*", verdict.alias("verdict"))
