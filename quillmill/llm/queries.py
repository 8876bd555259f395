"""The queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, html_text, licenses, mixing, repeats, secrets, simhash, topk, toxicity, urls
from .common import saved, table

ASCII = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    best = F.reduce("licenses", F.lit(0.0), lambda a, x: F.greatest(a, x["score"]))
    names = F.array_sort(F.array_distinct(F.transform("licenses", lambda x: x["license"])))
    return found.select("doc_id", F.size(names).cast("long").alias("n_licenses"), F.array_join(names, ",").alias("licenses"), F.round(best, 9).alias("best_score"))


_NAMES, _TEXTS = [n for n, _ in licenses.TEMPLATES + licenses.PARTS], [" ".join(licenses.words(t)) for _, t in licenses.TEMPLATES + licenses.PARTS]
_GRAMS = "list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1])"
_WORDS = f"list_filter(string_split(regexp_replace(translate({{}}, {ASCII}), '[^\\p{{{{L}}}}\\p{{{{N}}}}]+', ' ', 'g'), ' '), lambda x: x <> '')"
#: Which templates can be in a text at all follows from joined pairs; of these all windows, lines and paragraphs are compared.
OP1 = f"""
WITH t AS (SELECT tid, license, len(w) AS size, list_distinct({_GRAMS}) AS g FROM (SELECT unnest(range({len(_NAMES)})) AS tid, unnest({_NAMES!r}) AS license, string_split(unnest({_TEXTS!r}), ' ') AS w)),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, {_GRAMS} AS g FROM (SELECT r, {_WORDS.format('text')} AS w FROM d)),
f AS (SELECT r, tid FROM (SELECT r, unnest(list_distinct(g)) AS gram FROM w) JOIN (SELECT tid, len(g) AS n, unnest(g) AS gram FROM t) USING (gram) GROUP BY r, tid, n HAVING count(*) * 3 >= n * 2),
p AS (SELECT r, tid, text AS p FROM f JOIN d USING (r) UNION ALL SELECT r, tid, unnest(string_split(text, chr(10))) FROM f JOIN d USING (r)
      UNION ALL SELECT r, tid, unnest(regexp_split_to_array(text, '\\n[ \\t\\r]*\\n\\s*')) FROM f JOIN d USING (r)),
c AS (SELECT r, tid, list_distinct({_GRAMS}) AS g FROM (SELECT r, tid, {_WORDS.format('p')} AS w FROM p)
      UNION ALL SELECT r, tid, list_distinct(w.g[i:i + size - 2]) FROM f JOIN w USING (r) JOIN t USING (tid), unnest(range(1, greatest(1, len(w.g) - size + 2) + 1)) AS u(i)),
m AS (SELECT r, license, 2.0::DOUBLE * len(list_intersect(c.g, t.g)) / (len(c.g) + len(t.g)) AS score FROM c JOIN t USING (tid) WHERE len(c.g) > 0),
x AS (SELECT r, count(DISTINCT license) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS names, max(score) AS best FROM m WHERE score >= 0.8 GROUP BY r)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_licenses, coalesce(names, '') AS licenses, round(coalesce(best, 0), 9)::DOUBLE AS best_score FROM d LEFT JOIN x USING (r)
"""


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def _op5_sql() -> str:
    weights, bias = urls.fit()
    grams = lambda k, c, n: f"list_transform(range(1, length({c}) - {n - 2} + 2), lambda i: '{k}' || substr('^' || {c} || '$', i, {n}))"
    every = " || ".join(grams(k, c, n) for k, c in (("h", "host"), ("p", "path")) for n in urls.SIZES)
    fits = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}') THEN '{h}/{p}'" for h, _, p in (r.partition("/") for r, _ in sorted(urls.RULES, key=lambda r: -len(r[0]))))
    said = " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in urls.RULES)
    return f"""
WITH u AS (SELECT row_number() OVER () AS r, page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), {ASCII}) AS host, regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
g AS (SELECT r, unnest({every}) AS gram FROM u),
w AS (SELECT {weights!r} AS w),
s AS (SELECT r, {bias} + sum(w[('0x' || substr(md5(gram), 1, 3))::INT + 1]) AS logit FROM g, w GROUP BY r),
x AS (SELECT *, CASE {fits} END AS rule FROM u LEFT JOIN s USING (r))
SELECT page_id, host, path, rule, CASE rule {said} ELSE CASE WHEN coalesce(logit, {bias}) > 0 THEN 'block' ELSE 'allow' END END AS verdict FROM x
"""


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"))


OP6 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * v.x[i]))::BIGINT AS score
      FROM v AS q JOIN v ON q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id AND len(q.x) = len(v.x)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex16("fp").alias("fingerprint"), "component_id")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    true = F.filter("findings", lambda s: s["secret"])
    return found.select(
        "doc_id",
        F.size("findings").cast("long").alias("n_candidates"),
        F.size(true).cast("long").alias("n_secrets"),
        F.transform(true, lambda s: s["at"]).alias("starts"),
        F.transform(true, lambda s: s["value"]).alias("secrets"),
        F.transform(true, lambda s: s["score"]).alias("scores"),
    )


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.n_words(F.col("text")).alias("size"))
    how = mixing.copies(saved(docs), "size")
    return how.select("doc_id", "size", "mix.source_size", "mix.target", (F.col("size") * F.col("mix.copies")).alias("taken"))


OP7 = """
WITH s AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size,
                  md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM s GROUP BY source),
u AS (SELECT *, sum(source_size) OVER ()::BIGINT AS total, (sum(w) OVER () - coalesce(sum(w) OVER o, 0))::BIGINT AS w_left,
             coalesce(sum(source_size) OVER o, 0)::BIGINT AS before
      FROM t WINDOW o AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT *, (total - 3 * before) / w_left AS level FROM u),
x AS (SELECT *, 3 * source_size <= level * w AS held FROM v),
y AS (SELECT source, source_size, CASE WHEN held THEN (3 * source_size)::DOUBLE ELSE max(CASE WHEN NOT held THEN level END) OVER () * w END AS target,
             ('0x' || substr(md5('0|' || coalesce(source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS start FROM x),
z AS (SELECT doc_id, size, y.source_size, y.target, start, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS c,
             row_number() OVER (PARTITION BY s.source ORDER BY length(bin(size)) * 16 + (size >> greatest(length(bin(size)) - 4, 0)), h, size) AS k
      FROM s JOIN y ON s.source IS NOT DISTINCT FROM y.source)
SELECT doc_id, size::BIGINT AS size, source_size, target, (size * (floor(k * c + start) - floor((k - 1) * c + start)))::BIGINT AS taken FROM z
"""


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removed(table(spark, sf_dir, "documents")).drop("spans")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.overlaps(docs, table(spark, sf_dir, "benchmark"))
    hit = decontam.n_hit(F.col("overlap"))
    return found.select(
        "doc_id",
        F.col("overlap.n_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size("overlap.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("overlap.items", ",").cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


OP10 = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), {ASCII}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {ASCII}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
g AS (SELECT item_id, least(len(w), 10) AS n, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' '))) AS gram FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM g),
e AS (SELECT r, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM d, sizes WHERE len(w) >= n),
x AS (SELECT r, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS gram FROM e),
m AS (SELECT r, i, x.n, item_id FROM x JOIN g ON x.gram = g.gram AND x.n = g.n),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM m) GROUP BY r),
item AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM m) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN item USING (r)
"""

QUERIES = {f.__name__: f for f in (op1_licenses, op2_simhash, op3_html, op4_secrets, op5_urls, op6_topk, op7_mixing, op8_toxicity, op9_repeats, op10_decontamination)}


def __getattr__(name: str):
    """SQL is put together when it is asked for, as that of op5_urls needs the fitted regression."""
    if name == "SQL":
        return {"op1_licenses": OP1, "op5_urls": _op5_sql(), "op6_topk": OP6, "op7_mixing": OP7, "op10_decontamination": OP10}
    raise AttributeError(name)
