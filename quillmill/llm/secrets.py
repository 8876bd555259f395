"""Secret scans: candidate tokens judged by a random forest that is trained here on labelled findings."""

from __future__ import annotations

import random
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, once

#: A candidate of one kind: a run of key characters, after white space or one of the signs that stand before values, with
#: further such runs after full stops. Signs = after it are its padding, unless a value follows them.
LEAST = 12
#: Stand before and after each candidate while a text is taken apart; no text has a meaning for them.
OPEN, SHUT = "﷐", "﷑"
RUN = rf"[A-Za-z0-9+/_-]{{{LEAST},}}+"
VALUE = rf"(?:^|(?<=[\s=:\"'`(\[{{<,;]))({RUN}(?:\.{RUN})*(?:={{1,2}}(?!=|[\"'`]?[A-Za-z0-9+/_\-{OPEN}]))?)"
#: A candidate of the other kind: whatever is assigned to a name that speaks of secrets, at any length and with signs in it.
NAME = r"(?:passw(?:or)?d|passphrase|pwd|secret|token|api_?-?key|access_?-?key|auth|credential|private_?-?key)[A-Za-z0-9_-]{0,32}+"
ASSIGNED = rf"(?i)({NAME}[\"'`\]]{{0,2}}\s{{0,4}}(?:=>|:=|[=:])\s{{0,4}}[\"'`]?)([^\s\"'`,;&<>(){{}}\[\]\\|]+)"
#: Candidates of the first kind beside those of the second, which are marked already.
EITHER = rf"{OPEN}([^{SHUT}]*){SHUT}|{VALUE}"
#: Characters before a candidate, and words of them, and characters after it that its neighbouring words come from.
BEFORE, BEFORE_WORDS, AFTER = 160, 3, 80
#: Parts of a text whose lengths are summed up at a time.
STEP = 256
KEYWORD = r"(?i)(passw|passphrase|pwd|secret|token|api_?-?key|access_?-?key|auth|credential|private)"
DECOY = r"(?i)(?<![@./A-Za-z0-9])(example|sample|dummy|placeholder|changeme|your|xxxx|sha\d|md5|checksum|digest|commit|uuid|etag|integrity|revision|http|www)"
PATHS = r"(?i)(test|example|sample|doc|fixture|mock)"
#: Words that tell names and paths from keys, and letter pairs that are common in words.
WORDS = "about account action address admin agent alpha application archive backup button cache check class client cloud code column comment common config connection content context control count create custom data default delete detail device document domain editor element email engine error event example export feature field file filter folder format function general global group handler header helper history image import index input install instance interface internal item label language layout level library license link list local location login manager master memory message method model module monitor name network node number object option order output package page panel parameter parent password path pattern platform plugin policy port process product profile project property provider public query queue reader record region release remote report request resource response result role route sample schema script search section security select server service session setting simple source stage standard start state status storage stream string style system table target task template test text theme time token tool tree type update upload user util value version view widget window worker write".split()
PAIRS = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur".split()
FEATURES = ["length", "switches", "digits", "upper", "pairs", "words", "variety", "keyword", "decoy", "assigned", "path", "hex", "signs", "kinds"]
TREES, DEPTH, TRIED, SEED = 25, 7, 5, 11


def _share(part: Column, whole: Column) -> Column:
    return part.cast("double") / F.greatest(whole, F.lit(1))


def features(value: Column, before: Column, after: Column, path: Column) -> list[Column]:
    """FEATURES of a candidate, its neighbouring words and its path, as doubles."""
    n = F.length(value)
    near = F.concat_ws(" ", before, after)
    left = F.regexp_replace(value, f"(?i)({'|'.join(sorted(WORDS, key=len, reverse=True))})", "")
    letters = F.lower(F.regexp_replace(value, "[^A-Za-z]", ""))
    return [
        n.cast("double"),
        _share(F.regexp_count(value, F.lit(r"(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[0-9]|[A-Z][a-z])|(?<=[0-9])(?=[A-Za-z])")), n),
        _share(F.regexp_count(value, F.lit("[0-9]")), n),
        _share(F.regexp_count(value, F.lit("[A-Z]")), n),
        _share(F.regexp_count(letters, F.lit(f"(?={'|'.join(PAIRS)})")), F.length(letters)),
        _share(n - F.length(left), n),
        _share(F.size(F.array_distinct(F.split(value, ""))), F.least(n, F.lit(24))),
        F.regexp_like(before, F.lit(KEYWORD)).cast("double"),
        F.regexp_like(near, F.lit(DECOY)).cast("double"),
        F.regexp_like(before, F.lit(r"[=:]\s*[\"'`]?$")).cast("double"),
        F.coalesce(F.regexp_like(path, F.lit(PATHS)), F.lit(False)).cast("double"),
        F.regexp_like(value, F.lit("^([0-9a-f]+|[0-9A-F]+)$")).cast("double"),
        _share(F.regexp_count(value, F.lit("[^A-Za-z0-9]")), n),
        sum((F.regexp_like(value, F.lit(kind)).cast("double") for kind in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]")), F.lit(0.0)),
    ]


def findings(rows: int = 3000) -> list[tuple[str, str, str, str, int]]:
    """Labelled findings (value, before, after, path, secret 0/1), made by rules: keys of known forms, passwords and hashes beside
    the names that give them away, against words, identifiers, paths, checksums, numbers and placeholders."""
    r = random.Random(SEED)
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    draw = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    syllables = [a + b for a in "th st ch en er in on an le re de ge ver ment cion est ou qu tr pl".split() for b in ("", "e", "a", "i", "o", "heit", "ung", "keit", "tion", "ad", "os")]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 3)))
    long_word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(5, 9)))
    key = lambda: r.choice(["password", "passwd", "secret", "token", "api_key", "apikey", "access_key", "auth_token", "client_secret", "DB_PASSWORD", "SECRET_KEY", "private_key"])
    sign = lambda: r.choice(["=", " = ", ": ", ":", '="', ' = "', ': "', "='"])
    path = lambda: r.choice(["src0", "src7", "config.py", "main.go", "settings.yaml", "web", None])

    def password():  # a word or some letters with digits and signs in it, 6 to 16 characters
        stem = r.choice([word(), word().capitalize(), draw(low + up, r.randint(3, 8))])[:9]
        chars = list(stem + draw(dig, r.randint(1, 4)) + draw("!@#$%^*.-_?+~", r.randint(0, 2)))
        if r.random() < 0.5:
            r.shuffle(chars)
        return "".join(chars + list(draw(low + dig, max(0, 6 - len(chars)))))

    after = lambda: r.choice([word(), word(), f"{word()}@{word()}.example.com", f"{word()}.example.org"])
    good = [
        lambda: ("AKIA" + draw(up + dig, 16), word() + " " + word(), after(), path()),
        lambda: ("AKIA" + draw(up + dig, 16), "aws_access_key_id" + sign(), after(), path()),
        lambda: (r.choice(["ghp_", "gho_", "sk-", "xoxb-", "glpat-", "AIza"]) + draw(low + up + dig, r.randint(24, 40)), r.choice([word() + " " + word(), key() + sign()]), after(), path()),
        lambda: (draw("0123456789abcdef", r.choice([16, 18, 20, 24, 32, 40, 48, 64])), r.choice(["", word() + " "]) + key() + sign(), after(), path()),
        lambda: (draw(low + up + dig + "+/_-", r.randint(14, 64)), r.choice(["", word() + " "]) + key() + sign(), after(), path()),
        lambda: (draw(low + up + dig, r.randint(30, 44)), r.choice(["Authorization: Bearer", "auth" + sign()]), after(), path()),
        lambda: (password(), r.choice(["", word() + " "]) + key() + sign(), after(), path()),
        lambda: (".".join(["eyJ" + draw(low + up + dig, r.randint(12, 40)), "eyJ" + draw(low + up + dig + "_-", r.randint(20, 80)), draw(low + up + dig + "_-", 43)]), r.choice(["Authorization: Bearer", key() + sign(), word()]), after(), path()),
    ]
    bad = [
        lambda: (long_word(), word() + " " + word(), word(), path()),
        lambda: (long_word().capitalize(), word() + " " + word(), word(), path()),
        lambda: (long_word().upper(), word().upper(), word().upper(), path()),
        lambda: (long_word().upper()[: r.randint(12, 18)], word().upper(), word().upper(), path()),
        lambda: (long_word(), r.choice(["the token", "password" + sign(), "secret", "auth"]), word(), path()),
        lambda: (draw(dig, r.randint(12, 19)), word() + " " + word(), word(), path()),
        lambda: ("_".join(r.choice(WORDS) for _ in range(r.randint(3, 5))), r.choice([word(), key() + sign(), "name" + sign()]), word(), path()),
        lambda: ("".join(r.choice(WORDS).capitalize() for _ in range(r.randint(3, 5))), r.choice([word(), "class", "new"]), word(), path()),
        lambda: ("/".join(r.choice(WORDS) for _ in range(r.randint(3, 6))), r.choice([word(), "file" + sign(), "import"]), word(), path()),
        lambda: ("-".join(word() for _ in range(r.randint(3, 6))), word(), word(), path()),
        lambda: (draw("0123456789abcdef", r.choice([32, 40, 64])), r.choice(["sha256:", "md5" + sign(), "commit", "checksum" + sign(), "etag: ", "revision"]), word(), path()),
        lambda: ("-".join(draw("0123456789abcdef", n) for n in (8, 4, 4, 4, 12)), r.choice(["uuid" + sign(), "id" + sign(), word()]), word(), path()),
        lambda: (draw(low + up + dig, r.randint(16, 40)), key() + sign(), r.choice(["# example", "(placeholder)", "dummy"]), r.choice(["tests/test_x.py", "docs/example.md", "fixtures/mock.json"])),
        lambda: (r.choice(["your_", "YOUR-", "my_"]) + r.choice(["secret_key_here", "api_token_here", "password_goes_here"]), key() + sign(), r.choice(["example", "here"]), path()),
        lambda: (r.choice("x*0-_=") * 1 + "x" * r.randint(14, 30), key() + sign(), word(), path()),
        lambda: (r.choice("-_+=") * r.randint(12, 40), word(), word(), path()),
        lambda: (r.choice([word(), word(), r.choice(WORDS), word().capitalize(), long_word()]) + r.choice(["", "", ".", "!", "?", ":"]), key() + r.choice([": ", "="]), word(), path()),
        lambda: (r.choice(["none", "None", "null", "true", "false", "nil", "undefined", "required", "optional", "string", "str", "basic", "Bearer", "0", "1", "%s", "$1", "***", "********", "...", "xxx", "-"]), key() + sign(), word(), path()),
        lambda: (r.choice(["$", "%", "@", "self.", "os.", "config.", "env.", "args.", "settings.", "process.env."]) + "_".join(r.choice([w, w.upper()]) for w in r.sample(WORDS, r.randint(1, 2))), key() + sign(), word(), path()),
        lambda: ("http" + r.choice(["", "s"]) + "://" + word() + "." + r.choice(["com", "org", "net"]) + "/" + r.choice(WORDS), key() + r.choice([": ", "="]), word(), path()),
        lambda: ("/".join(["", *(r.choice(WORDS) for _ in range(r.randint(2, 4)))]) + r.choice(["", ".pem", ".txt", ".key"]), key() + sign(), word(), path()),
        lambda: (".".join(long_word() for _ in range(r.randint(2, 3))), word(), word(), path()),
    ]
    return [(*r.choice(kinds)(), label) for i in range(rows) for kinds, label in [((bad, 0), (good, 1))[i % 2]]]


def grow(x: list[list[float]], y: list[int]) -> list:
    """A forest of binary trees: a leaf is the share of secrets, a node (feature, bound, tree at or under it, tree above)."""
    import numpy as np

    r = random.Random(SEED)
    x, y = np.array(x, np.float64), np.array(y, np.float64)

    def tree(rows, depth: int):
        n, total = len(rows), y[rows].sum()
        share = total / n
        if depth == 0 or share in (0, 1) or n < 6:
            return float(share)
        best = (share * (1 - share) * n - 1e-9, None)
        for f in r.sample(range(len(FEATURES)), TRIED):
            order = np.argsort(x[rows, f], kind="stable")
            v, p = x[rows, f][order], np.cumsum(y[rows][order])
            at = np.flatnonzero(v[1:] > v[:-1])  # a cut after each of these rows
            if len(at):
                left, right = at + 1, n - at - 1
                cost = p[at] * (1 - p[at] / left) + (total - p[at]) * (1 - (total - p[at]) / right)
                k = int(cost.argmin())
                if cost[k] < best[0]:
                    best = (cost[k], (f, float((v[at[k]] + v[at[k] + 1]) / 2)))
        if best[1] is None:
            return float(share)
        f, cut = best[1]
        under = x[rows, f] <= cut
        return (f, cut, tree(rows[under], depth - 1), tree(rows[~under], depth - 1))

    return [tree(np.array([r.randrange(len(y)) for _ in y]), DEPTH) for _ in range(TREES)]


def vote(forest: list, x: list[float]) -> float:
    """The forest's mean for one row, in plain Python."""
    total = 0.0
    for node in forest:
        while isinstance(node, tuple):
            node = node[2] if x[node[0]] <= node[1] else node[3]
        total += node
    return total / len(forest)


def score_sql(forest: list, x: str) -> str:
    """The forest's mean vote as SQL over an array of features."""

    def column(node) -> str:
        if not isinstance(node, tuple):
            return f"{node!r}D"
        return f"CASE WHEN {x}[{node[0]}] <= {node[1]!r}D THEN {column(node[2])} ELSE {column(node[3])} END"

    return f"({' + '.join(map(column, forest))}) / {len(forest)}D"


@lru_cache(maxsize=1)
def _forest(spark: SparkSession) -> list:
    """Trained on the labelled findings, whose features the same columns give as those of candidates."""
    rows = spark.createDataFrame(findings(), "v string, b string, a string, p string, y int").coalesce(1)
    got = rows.select(F.array(*features(F.col("v"), F.col("b"), F.col("a"), F.col("p"))).alias("x"), "y").collect()
    return grow([list(g.x) for g in got], [g.y for g in got])


def _parts(text: Column) -> Column:
    """A text taken apart: every second part is a candidate."""
    clean = F.when(F.contains(text, F.lit(OPEN)) | F.contains(text, F.lit(SHUT)), F.translate(text, OPEN + SHUT, "  ")).otherwise(text)
    marked = F.regexp_replace(clean, ASSIGNED, f"$1{OPEN}$2{SHUT}")
    return F.split(F.regexp_replace(marked, EITHER, f"{OPEN}$1$2{SHUT}"), f"[{OPEN}{SHUT}]")


def _candidates(text: Column, path: Column) -> Column:
    """array<struct<at, value, x>> of the candidates of a text that isn't null; x: their features."""
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, n: a + n)

    def one(parts: Column, lengths: Column, sums: Column, i: Column) -> Column:
        head = F.split(F.right(F.concat(F.coalesce(F.get(parts, i - 2), F.lit("")), F.get(parts, i - 1)), F.lit(BEFORE)), r"\s+")
        before = once(head, lambda h: F.array_join(F.slice(h, F.greatest(F.lit(1), F.size(h) - (BEFORE_WORDS - 1)), F.lit(BEFORE_WORDS)), " "))
        after = F.coalesce(F.get(F.split(F.left(F.get(parts, i + 1), F.lit(AFTER)), r"\s+"), F.lit(1)), F.lit(""))
        whole = F.floor(i / STEP).cast("int")  # the sum of the lengths before: of whole steps, and of the rest
        at = total(F.slice(sums, F.lit(1), whole)) + total(F.slice(lengths, whole * STEP + 1, i - whole * STEP))
        x = once(F.struct(F.get(parts, i).alias("value"), F.regexp_replace(before, r"\s+$", "").alias("before"), after.alias("after")), lambda s: F.array(*features(s["value"], s["before"], s["after"], path)))
        return F.struct(at.alias("at"), F.get(parts, i).alias("value"), x.alias("x"))

    def each(parts: Column) -> Column:
        lengths = F.transform(parts, lambda p: F.length(p))
        steps = lambda n: F.transform(F.sequence(F.lit(0), F.floor(F.size(n) / STEP).cast("int")), lambda b: total(F.slice(n, b * STEP + 1, F.lit(STEP))))
        odd = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 2, F.lit(2))).otherwise(F.array().cast("array<int>"))
        return once(lengths, lambda n: once(steps(n), lambda sums: F.transform(odd, lambda i: one(parts, n, sums, i))))

    return once(_parts(text), each)


def scan(docs: DataFrame, text_col: str = "text", path_col: str = "source", out_col: str = "findings", least: float = 0.5) -> DataFrame:
    """docs with an array of structs (at long, value, score, secret boolean), one for each candidate in the whole text, in order.

    A candidate is any run of 12 or more key characters at the start of a word or after a sign like = or a quote, with more
    such runs after full stops, and whatever is assigned to a name such as password, token or api_key, at any length. at is its
    first character, from 0. Its neighbours are the two words before its own, or back to the candidate before the last, and the
    one after. Its score is the forest's mean vote, and it is a secret from `least` up. Null and empty texts have an empty
    array, a null path counts as none, repeated rows and values stay repeated; a column of docs named out_col gives way. The
    noncharacters U+FDD0 and U+FDD1 count as blanks.
    """
    k = free_name(docs, out_col)
    x = docs.withColumn(k, _candidates(F.coalesce(F.col(text_col), F.lit("")), F.col(path_col).cast("string")))
    judged = F.expr(f"transform({k}, s -> named_struct('at', s.at, 'value', s.value, 'score', {score_sql(_forest(docs.sparkSession), 's.x')}))")
    judged = F.transform(judged, lambda s: F.struct(s["at"], s["value"], F.round(s["score"], 6).alias("score"), (s["score"] >= least).alias("secret")))
    return x.withColumn(out_col, judged).drop(k)


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs, all columns, with every secret in text replaced by a mark where it was found and wherever else a secret of 12 or
    more characters stands; n_chars, if there, follows. Texts without a secret stay as they are."""
    k = free_name(docs)
    found = scan(docs, out_col=k)
    some = F.exists(F.col(k), lambda s: s["secret"])

    def marked(parts: Column, findings: Column) -> Column:
        secret = lambda i: (i % 2 == 1) & F.get(findings, F.floor(i / 2).cast("int"))["secret"]
        text = F.array_join(F.transform(parts, lambda p, i: F.when(secret(i), F.lit(mark)).otherwise(p)), "")
        bad = F.filter(findings, lambda s: s["secret"] & (F.length(s["value"]) >= LEAST))
        # the longest first, as a value can be part of another
        values = F.array_sort(F.array_distinct(F.transform(bad, lambda s: F.struct((-F.length(s["value"])).alias("n"), s["value"].alias("value")))))
        return F.aggregate(values, text, lambda t, s: F.replace(t, s["value"], F.lit(mark)))

    text = once(_parts(F.col("text")), lambda parts: once(F.col(k), lambda findings: marked(parts, findings)))
    out = found.withColumn("text", F.when(some, text).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(some, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(docs.columns)
