"""The registered queries over the engine's operators, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import chat, messages, text
from ..operators import adapters, artifacts, mixture, search, selection, stats, tokenizer, windows
from ..sources import catalog, registry
from . import build

L = 512
QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def conversations(spark: SparkSession, d: str) -> DataFrame:
    """(conv_id, messages): turns in order."""
    rows = spark.read.parquet(f"{d}/conversations.parquet")
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return rows.groupBy("conv_id").agg(F.transform(turns, lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content"))).alias("messages"))


def tokens(df: DataFrame) -> DataFrame:
    """Code points and the end mark 0."""
    return df.withColumn("ids", F.concat(text.code_point_ids(F.col("text")), F.array(F.lit(0))))


# --- streams and windows -----------------------------------------------------

_STREAM = """t AS (SELECT doc_id, i, c FROM (SELECT doc_id, unnest(range(1, length(text) + 1)) AS i, unnest(list_transform(string_split(text, ''), lambda x: unicode(x))) AS c FROM documents WHERE text <> '') UNION ALL SELECT doc_id, length(text) + 1, 0 FROM documents),
s AS (SELECT row_number() OVER (ORDER BY doc_id, i) - 1 AS p, c::INT AS c FROM t)"""


@query(f"""WITH {_STREAM}, n AS (SELECT greatest(0, (count(*) - 1) // {L}) AS n FROM s),
x AS (SELECT p // {L} AS w, list(c ORDER BY p) AS x FROM s GROUP BY 1), y AS (SELECT (p - 1) // {L} AS w, list(c ORDER BY p) AS y FROM s WHERE p > 0 GROUP BY 1)
SELECT x.w::BIGINT AS window_id, x, y FROM x JOIN y USING (w), n WHERE x.w < n""")
def packed_windows(spark, d):
    return windows.packed(tokens(docs(spark, d)), "ids", "doc_id", L)


@query("""SELECT doc_id, sum(length(text) + 1) OVER (ORDER BY doc_id)::BIGINT - length(text) - 1 AS start_token, sum(length(text) + 1) OVER (ORDER BY doc_id)::BIGINT AS end_token FROM documents""")
def doc_spans(spark, d):
    rows = docs(spark, d).select("doc_id", (F.length("text") + 1).alias("n"))
    return windows.spans(rows, "n", "doc_id").select("doc_id", F.col("start").alias("start_token"), F.col("end").alias("end_token"))


@query(f"""SELECT doc_id, unnest(range(0, greatest(1, least(4, (length(text) + 1) // {L + 1}))))::INT AS k FROM documents WHERE length(text) + 1 >= {L + 1}""")
def document_window_counts(spark, d):
    rows = docs(spark, d).select("doc_id", (F.length("text") + 1).alias("n"))
    return windows.document_windows(rows, "n", "doc_id", L).select("doc_id", "k")


@query()
def document_windows(spark, d):
    rows = docs(spark, d).select("doc_id", (F.length("text") + 1).alias("n"))
    return windows.document_windows(rows, "n", "doc_id", L)


@query("""WITH r AS (SELECT doc_id, length(text) AS n FROM documents WHERE text <> ''),
w AS (SELECT doc_id, n, unnest(range(0, greatest(0, ceil((n - 512) / 256))::BIGINT + 1)) AS k FROM r)
SELECT doc_id, k * 256 AS begin, least(k * 256 + 512, n) AS finish,
       least(k * 256 + 512, n) - greatest(k * 256, CASE WHEN k > 0 THEN least((k - 1) * 256 + 512, n) ELSE 0 END) AS counted,
       least(k * 256 + 512, n) - greatest(k * 256, CASE WHEN k > 0 THEN least((k - 1) * 256 + 512, n) ELSE 0 END) - (k = 0)::INT AS scored FROM w""")
def rolling_windows(spark, d):
    rows = docs(spark, d).select("doc_id", F.length("text").cast("long").alias("n"))
    return windows.rolling(rows, "n", 512, 256).select("doc_id", "begin", "finish", "counted", "scored")


@query("""SELECT w::INT AS width, count(*) AS documents, sum(length(text))::BIGINT AS tokens FROM documents, (SELECT unnest([512, 2048, 4096, 8192]) AS w) WHERE length(text) >= w GROUP BY w""")
def length_bands(spark, d):
    return windows.length_bands(docs(spark, d).select(F.length("text").cast("long").alias("n")), "n")


@query("""WITH t AS (SELECT doc_id, list_transform(string_split(text, ''), lambda x: unicode(x)) AS c FROM documents WHERE length(text) > 1),
n AS (SELECT doc_id, c, unnest(range(0, (ceil(ceil((len(c) - 1) / 256.0) / 4) * 4)::BIGINT)) AS w FROM t)
SELECT doc_id, w, list_transform(range(1, 257), lambda i: (CASE WHEN w * 256 + i < len(c) THEN c[w * 256 + i] ELSE 0 END)::INT) AS x,
       list_transform(range(1, 257), lambda i: (CASE WHEN w * 256 + i < len(c) THEN c[w * 256 + i + 1] ELSE -100 END)::INT) AS y FROM n""")
def padded_windows(spark, d):
    rows = docs(spark, d).select("doc_id", text.code_points(F.col("text")).alias("ids"))
    return windows.padded(rows, "ids", 256, 4).select("doc_id", "w", "x", "y")


_CHARS = """c AS (SELECT conv_id, string_agg(text, chr(9220) ORDER BY turn) AS t FROM conversations GROUP BY conv_id),
p AS (SELECT conv_id, unnest(range(0, length(t))) AS i, unnest(string_split(t, '')) AS ch FROM c),
q AS (SELECT conv_id, i, coalesce(sum((ch = chr(9220))::INT) OVER (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS doc FROM p)"""


def _joined(spark, d) -> DataFrame:
    t = F.array_join(F.transform("messages", lambda m: m["content"]), "␄")
    return conversations(spark, d).select("conv_id", text.code_points(t).alias("ids"))


@query(f"""WITH {_CHARS} SELECT conv_id, doc::INT AS doc, min(i)::INT AS first_token, count(*)::BIGINT AS n FROM q GROUP BY conv_id, doc""")
def doc_positions(spark, d):
    rows = _joined(spark, d).select("conv_id", F.posexplode(windows.doc_positions(F.col("ids"), 0x2404)).alias("i", "p"))
    return rows.groupBy("conv_id", F.col("p.doc").alias("doc")).agg(F.min("i").alias("first_token"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_CHARS}, e AS (SELECT conv_id, i AS finish, row_number() OVER (PARTITION BY conv_id ORDER BY i) - 1 AS doc FROM p WHERE ch = chr(9220))
SELECT conv_id, doc::INT AS doc, coalesce(lag(finish) OVER (PARTITION BY conv_id ORDER BY doc) + 1, 0)::INT AS start, finish::INT AS finish FROM e""")
def spans_from_marks(spark, d):
    return windows.spans_from_marks(_joined(spark, d), "conv_id", "ids", 0x2404)


@query("""WITH p AS (SELECT conv_id, turn, unnest(range(0, length(text))) AS i, unnest(string_split(text, '')) AS ch FROM conversations WHERE text <> ''),
q AS (SELECT *, coalesce(sum((ch = ' ')::INT) OVER (PARTITION BY conv_id, turn ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM p)
SELECT a.conv_id, a.turn, (a.i - b.i)::INT AS distance, count(*) AS n FROM q a JOIN q b ON a.conv_id = b.conv_id AND a.turn = b.turn AND a.g = b.g AND b.i <= a.i GROUP BY ALL""")
def attention_pairs(spark, d):
    """Pairs that a causal document mask lets through, by distance, with a text's words as its documents."""
    rows = spark.read.parquet(f"{d}/conversations.parquet").select(F.struct("conv_id", "turn").alias("key"), text.code_points(F.col("text")).alias("ids"))
    pairs = windows.attention_pairs(rows, "key", "ids", 32)
    return pairs.groupBy("key", (F.col("q") - F.col("k")).alias("distance")).agg(F.count(F.lit(1)).alias("n")).select("key.conv_id", "key.turn", "distance", "n")


@query("""SELECT *, (row_number() OVER (ORDER BY doc_id) - 1) // 32 AS batch_id FROM (SELECT doc_id FROM documents) QUALIFY batch_id < (SELECT count(*) // 32 FROM documents)""")
def loader_batches(spark, d):
    return windows.batches(docs(spark, d).select("doc_id"), "doc_id", 32)


# --- splits and caps ---------------------------------------------------------

_CUM = "SELECT doc_id, source, length(text)::BIGINT AS n, sum(length(text)) OVER (ORDER BY doc_id)::BIGINT AS e FROM documents"


def _sized(spark, d) -> DataFrame:
    return docs(spark, d).select("doc_id", "source", F.length("text").cast("long").alias("n"))


@query("""SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) <= round_even((SELECT count(*) FROM documents) * 5 / 100, 0) THEN 'validation' ELSE 'train' END AS split FROM documents""")
def carve_validation(spark, d):
    return selection.carve(docs(spark, d).select("doc_id"), "doc_id", 0.05)


@query(f"""WITH c AS ({_CUM}), t AS (SELECT sum(n)::BIGINT AS t FROM c) SELECT doc_id, least(n, greatest(0, e - (t - floor(t * 0.1))))::BIGINT AS val_tokens FROM c, t""")
def tail_validation(spark, d):
    return selection.tail(_sized(spark, d), "doc_id", "n", 0.1).select("doc_id", F.col("val_tokens").cast("long").alias("val_tokens"))


@query("""SELECT doc_id, length(text)::BIGINT AS n FROM documents WHERE length(text) >= 8192 ORDER BY doc_id DESC LIMIT 200""")
def long_documents(spark, d):
    return selection.long_documents(docs(spark, d), "doc_id").select("doc_id", F.length("text").cast("long").alias("n"))


@query("""SELECT doc_id FROM documents WHERE length(text) >= 513""")
def min_document_length(spark, d):
    return selection.min_length(_sized(spark, d), "n", 512).select("doc_id")


@query(f"""WITH c AS ({_CUM}) SELECT doc_id, e - n AS start_token, e AS end_token FROM c WHERE e <= 1000000""")
def cap_document_aligned(spark, d):
    return selection.cap_documents(_sized(spark, d), "n", "doc_id", 1_000_000).select("doc_id", F.col("start").alias("start_token"), F.col("end").alias("end_token"))


@query(f"""WITH c AS ({_CUM}) SELECT doc_id, least(e, 1000000) - (e - n) AS kept FROM c WHERE e - n < 1000000""")
def cap_hard(spark, d):
    return selection.cap_hard(_sized(spark, d), "n", "doc_id", 1_000_000).select("doc_id", "kept")


@query(f"""WITH c AS ({_CUM}) SELECT doc_id, n FROM c WHERE e - n < 1000000""")
def cap_inclusive(spark, d):
    return selection.cap_inclusive(_sized(spark, d), "n", "doc_id", 1_000_000).select("doc_id", "n")


@query("""WITH c AS (SELECT doc_id, source, length(text)::BIGINT AS n, sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id)::BIGINT AS e FROM documents) SELECT source, sum(n)::BIGINT AS chars, count(*) AS documents FROM c WHERE e - n < 50000 GROUP BY source""")
def corpus_by_source(spark, d):
    rows = selection.cap_inclusive(_sized(spark, d), "n", "doc_id", 50_000, ("source",))
    return rows.groupBy("source").agg(F.sum("n").alias("chars"), F.count(F.lit(1)).alias("documents"))


@query(f"""WITH c AS ({_CUM}), g AS (SELECT max(e) AS g FROM c WHERE e - n < 1000000) SELECT doc_id, n FROM c, g WHERE e - n >= 1000000 AND e - n - g < 200000""")
def held_out_after_cap(spark, d):
    return selection.held_out_after(_sized(spark, d), "n", "doc_id", 1_000_000, 200_000).select("doc_id", "n")


# --- cleaning ----------------------------------------------------------------


def _noisy(spark, d) -> DataFrame:
    """Texts with what they lack put in: other line ends, zero-width and wide spaces, blanks, blank runs and boilerplate lines."""
    t, k = F.col("text"), F.col("doc_id") % 5
    noise = F.when(k == 0, F.concat(F.lit(" \r\n"), t, F.lit("\r\n\r\nISBN 12-3 \n"))).when(k == 1, F.concat(t, F.lit("  \n\n\n\nAll Rights  Reserved\n x​y "))).when(k == 2, F.concat(F.lit("http://a.b/c\n"), t)).when(k == 3, F.concat(F.lit("\t0221201\n"), t, F.lit("\r"))).otherwise(t)
    return docs(spark, d).select("doc_id", F.when(F.col("doc_id") % 2 == 0, "gutenberg").otherwise("web").alias("source"), noise.alias("text"))


_NOISY = """n AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'gutenberg' ELSE 'web' END AS source, CASE doc_id % 5 WHEN 0 THEN ' ' || chr(13) || chr(10) || text || chr(13) || chr(10) || chr(13) || chr(10) || 'ISBN 12-3 ' || chr(10)
  WHEN 1 THEN text || '  ' || repeat(chr(10), 4) || 'All Rights  Reserved' || chr(10) || chr(160) || 'x' || chr(8203) || 'y' || chr(8201)
  WHEN 2 THEN 'http://a.b/c' || chr(10) || text WHEN 3 THEN chr(9) || '0221201' || chr(10) || text || chr(13) ELSE text END AS text FROM documents)"""
_STRIP = "regexp_replace(regexp_replace({}, '^[\\s\\x{{a0}}\\x{{2009}}]+', ''), '[\\s\\x{{a0}}\\x{{2009}}]+$', '')"
_NORMAL = _STRIP.format("regexp_replace(regexp_replace(regexp_replace(translate(replace(nfc_normalize(text), chr(8203), ''), chr(160) || chr(8201), '  '), '\\r\\n?', chr(10), 'g'), '[ \\t]+\\n', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g')")
_BOILER = "|".join(text.BOILERPLATE).replace("'", "''")


@query(f"WITH {_NOISY} SELECT doc_id, md5({_NORMAL}) AS digest FROM n")
def clean_normalize(spark, d):
    return _noisy(spark, d).select("doc_id", F.md5(text.normalize(F.col("text")).cast("binary")).alias("digest"))


@query(f"""WITH {_NOISY}, m AS (SELECT doc_id, source, {_NORMAL} AS t FROM n),
b AS (SELECT doc_id, array_to_string(list_filter(string_split(t, chr(10)), lambda l: NOT regexp_matches(l, '(?i)^\\s*({_BOILER})\\s*$')), chr(10)) AS b FROM m)
SELECT doc_id, md5(CASE WHEN source = 'gutenberg' THEN {_STRIP.format("regexp_replace(b, '\\n{3,}', chr(10) || chr(10), 'g')")} ELSE t END) AS digest FROM m JOIN b USING (doc_id)""")
def clean_text(spark, d):
    return _noisy(spark, d).select("doc_id", F.md5(text.clean(F.col("text"), F.col("source")).cast("binary")).alias("digest"))


# --- adapters ----------------------------------------------------------------


@query("""SELECT doc_id, md5(coalesce(lang, 'None') || chr(10) || chr(10) || coalesce(text, 'None')) AS digest FROM documents""")
def plain_text(spark, d):
    return adapters.plain_text(docs(spark, d), ("lang", "text"), out="t").select("doc_id", F.md5(F.col("t").cast("binary")).alias("digest"))


def _pairs(spark, d) -> DataFrame:
    """Questions with the answers that follow them, and a document as context."""
    c = spark.read.parquet(f"{d}/conversations.parquet")
    nxt = Window.partitionBy("conv_id").orderBy("turn")
    rows = c.select("conv_id", "turn", "role", F.col("text").alias("question"), F.lead("text").over(nxt).alias("answer"), F.lead("role").over(nxt).alias("next"))
    return rows.filter("role = 'user' and next = 'assistant'").select("conv_id", "turn", "question", "answer", (F.col("conv_id") * 1000 + F.col("turn")).alias("ordinal"))


_PAIRS = """p AS (SELECT conv_id, turn, text AS question, lead(text) OVER w AS answer, role, lead(role) OVER w AS nxt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
q AS (SELECT conv_id, turn, question, answer, conv_id * 1000 + turn AS ordinal FROM p WHERE role = 'user' AND nxt = 'assistant')"""


@query(f"WITH {_PAIRS} SELECT ordinal, 'Question: ' || question || chr(10) || 'Answer: ' || answer AS text FROM q")
def pair_text(spark, d):
    return adapters.pair_text(_pairs(spark, d), "question", "answer").select("ordinal", "text")


@query(f"WITH {_PAIRS} SELECT ordinal, question || chr(10) || chr(10) || answer AS text FROM q")
def joined_pair(spark, d):
    return adapters.joined_pair(_pairs(spark, d), "question", "answer").select("ordinal", "text")


@query(f"""WITH {_PAIRS}, c AS (SELECT *, 'context ' || (conv_id // 3 % 4)::VARCHAR AS context FROM q),
i AS (SELECT *, coalesce((context <> lag(context) OVER (ORDER BY ordinal))::INT, 1) AS new FROM c), g AS (SELECT *, sum(new) OVER (ORDER BY ordinal) AS g FROM i)
SELECT min(ordinal) AS first, count(*) AS n, any_value(context) || chr(10) || chr(10) || string_agg('Question: ' || question || chr(10) || 'Answer: ' || answer, chr(10) || chr(10) ORDER BY ordinal) AS text FROM g GROUP BY g""")
def passage_islands(spark, d):
    rows = _pairs(spark, d).withColumn("context", F.concat(F.lit("context "), F.expr("conv_id div 3 % 4").cast("string")))
    return adapters.passages(rows, "ordinal")


def _lists(spark, d) -> DataFrame:
    """Stories with lists of questions and, a shorter one, of answers."""
    got = F.array_sort(F.collect_list(F.struct("turn", "question", "answer")))
    rows = _pairs(spark, d).groupBy("conv_id").agg(got.alias("p"))
    answers = F.transform("p", lambda x: x["answer"])
    short = F.when(F.col("conv_id") % 3 == 0, F.slice(answers, F.lit(1), F.size(answers) - 1)).otherwise(answers)
    return rows.select("conv_id", F.concat(F.lit("story "), F.col("conv_id").cast("string")).alias("story"), F.transform("p", lambda x: x["question"]).alias("questions"), F.struct(short.alias("input_text")).alias("answers"))


_LISTS = f"""{_PAIRS}, k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM q),
z AS (SELECT * FROM k WHERE k < n OR conv_id % 3 <> 0), ids AS (SELECT DISTINCT conv_id FROM q)"""


@query(f"""WITH {_LISTS} SELECT conv_id, concat_ws(chr(10) || chr(10), 'story ' || conv_id::VARCHAR, t) AS text FROM ids LEFT JOIN (SELECT conv_id, string_agg('Question: ' || question || chr(10) || 'Answer: ' || answer, chr(10) || chr(10) ORDER BY turn) AS t FROM z GROUP BY conv_id) USING (conv_id)""")
def story_questions(spark, d):
    return adapters.story_questions(_lists(spark, d), "story", "questions", "answers.input_text").select("conv_id", "text")


_TURN = "'<|im_start|>' || {r} || chr(10) || {c} || '<|im_end|>' || chr(10)"


@query(f"""WITH {_LISTS} SELECT conv_id, string_agg({_TURN.format(r="'user'", c="CASE WHEN k = 1 THEN 'story ' || conv_id::VARCHAR || chr(10) || chr(10) ELSE '' END || question")} || {_TURN.format(r="'assistant'", c="answer")}, '' ORDER BY turn) AS text FROM z GROUP BY conv_id""")
def conversational_qa(spark, d):
    rows = adapters.conversational_qa(_lists(spark, d), "story", "questions", "answers.input_text", "CANNOTANSWER")
    return rows.select("conv_id", chat.render(F.col("messages")).alias("text"))


@query(f"WITH {_PAIRS} SELECT ordinal, {_TURN.format(r="'user'", c="question")} || {_TURN.format(r="'assistant'", c="answer")} AS text FROM q")
def single_turn_chat(spark, d):
    return adapters.single_turn(_pairs(spark, d), "question", "answer").select("ordinal", chat.render(F.col("messages")).alias("text"))


@query("""WITH t AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN chr(10) || chr(9) || ' ' WHEN turn % 7 = 6 THEN NULL ELSE text END AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations)
SELECT conv_id, string_agg('<' || CASE WHEN i % 2 = 0 THEN 'user' ELSE 'assistant' END || '>' || chr(10) || t, chr(10) || chr(10) ORDER BY turn) AS text FROM t WHERE trim(t, ' ' || chr(9) || chr(10)) <> '' GROUP BY conv_id""")
def alternating_dialogue(spark, d):
    rows = spark.read.parquet(f"{d}/conversations.parquet")
    t = F.when(F.col("turn") % 3 == 1, F.lit("\n\t ")).when(F.col("turn") % 7 != 6, F.col("text"))
    lists = rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", t.alias("t")))), lambda x: x["t"]).alias("dialogue"))
    return adapters.alternating(lists).select("conv_id", adapters.preview(F.col("messages")).alias("text"))


_TREE = """m AS (SELECT conv_id * 100 + turn * 2 AS o, conv_id || '-' || turn AS message_id, CASE WHEN turn > 0 THEN conv_id || '-' || (turn - 1) END AS parent_id, CASE WHEN (conv_id + turn) % 11 = 0 THEN 'de' ELSE 'en' END AS lang, conv_id % 7 <> 0 AS review_result, NULL::INT AS rank, CASE WHEN role = 'assistant' THEN role ELSE 'prompter' END AS role, text FROM conversations
UNION ALL SELECT conv_id * 100 + turn * 2 + 1, conv_id || '-' || turn || 'b', conv_id || '-' || (turn - 1), 'en', true, CASE WHEN turn % 4 = 1 THEN 1 END, 'assistant', 'other' FROM conversations WHERE role = 'assistant' AND turn > 0)"""


@query(f"""WITH RECURSIVE {_TREE}, k AS (SELECT * FROM m WHERE lang = 'en' AND review_result),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY parent_id ORDER BY rank NULLS LAST, o) AS r FROM k WHERE parent_id IS NOT NULL) WHERE r = 1),
w AS (SELECT message_id AS root, message_id, role, text, 0 AS depth FROM k WHERE parent_id IS NULL OR parent_id NOT IN (SELECT message_id FROM k)
      UNION ALL SELECT w.root, b.message_id, b.role, b.text, depth + 1 FROM w JOIN b ON b.parent_id = w.message_id)
SELECT root, count(*) AS n, md5(string_agg(CASE WHEN role = 'prompter' THEN 'user' ELSE 'assistant' END || ':' || text, '|' ORDER BY depth)) AS digest FROM w GROUP BY root HAVING count(*) >= 2""")
def reply_trees(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet")
    at = lambda t, s="": F.concat(F.col("conv_id").cast("string"), F.lit("-"), t.cast("string"), F.lit(s))
    t = F.col("turn")
    main = c.select((F.col("conv_id") * 100 + t * 2).alias("o"), at(t).alias("message_id"), F.when(t > 0, at(t - 1)).alias("parent_id"), F.when((F.col("conv_id") + t) % 11 == 0, "de").otherwise("en").alias("lang"), (F.col("conv_id") % 7 != 0).alias("review_result"), F.lit(None).cast("int").alias("rank"), F.when(F.col("role") == "assistant", F.col("role")).otherwise("prompter").alias("role"), "text")
    other = c.filter("role = 'assistant' and turn > 0").select((F.col("conv_id") * 100 + t * 2 + 1).alias("o"), at(t, "b").alias("message_id"), at(t - 1).alias("parent_id"), F.lit("en").alias("lang"), F.lit(True).alias("review_result"), F.when(t % 4 == 1, 1).alias("rank"), F.lit("assistant").alias("role"), F.lit("other").alias("text"))
    trees = adapters.reply_trees(main.unionByName(other), "o")
    said = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|")
    return trees.select("root", F.size("messages").cast("long").alias("n"), F.md5(said.cast("binary")).alias("digest"))


# --- chat --------------------------------------------------------------------

_CHAT = _TURN.format(r="role", c="text")


@query(f"SELECT conv_id, string_agg({_CHAT}, '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def chat_text(spark, d):
    return conversations(spark, d).select("conv_id", chat.render(F.col("messages")).alias("text"))


@query(f"""SELECT conv_id, sum(length({_CHAT}) + 0)::BIGINT + 2 AS n_tokens, sum(CASE WHEN role = 'assistant' THEN length(text) + 10 ELSE 0 END)::BIGINT AS supervised,
round(sum(CASE WHEN role = 'assistant' THEN length(text) + 10 ELSE 0 END) / (sum(length({_CHAT})) + 2), 4) AS fraction FROM conversations GROUP BY conv_id""")
def supervised_fraction(spark, d):
    x = chat.ids_and_labels(chat.segments(F.col("messages")), 1, 0)
    rows = conversations(spark, d).select("conv_id", x.alias("x"))
    sup = F.size(F.filter("x.labels", lambda v: v != chat.IGNORE)).cast("long")
    return rows.select("conv_id", F.size("x.ids").cast("long").alias("n_tokens"), sup.alias("supervised"), F.round(sup / F.size("x.ids"), 4).alias("fraction"))


# --- mixtures ----------------------------------------------------------------

_SOURCES = "s AS (SELECT source AS key, sum(length(text))::BIGINT AS avail, count(*)::BIGINT AS n, (1 + ascii(substr(source, 4)) % 4) * 0.1::DOUBLE AS weight, 'c' || (ascii(substr(source, 4)) % 3) AS category FROM documents GROUP BY source)"


def _sources(spark, d) -> DataFrame:
    code = F.ascii(F.substring("source", 4, 100))
    rows = docs(spark, d).groupBy("source").agg(F.sum(F.length("text")).alias("avail"), F.count(F.lit(1)).alias("n"))
    return rows.select(F.col("source").alias("key"), "avail", "n", ((1 + code % 4) * F.lit(0.1)).alias("weight"), F.concat(F.lit("c"), (code % 3).cast("string")).alias("category"))


@query(f"WITH {_SOURCES}, p AS (SELECT *, round_even(weight / sum(weight) OVER () * 2000000, 0)::BIGINT AS want FROM s), t AS (SELECT *, least(want, avail) AS take FROM p) SELECT key, want, take, floor(take * 0.05)::BIGINT AS n_val, take - floor(take * 0.05)::BIGINT AS n_train, want > avail AS capped FROM t")
def mixture_capped(spark, d):
    return mixture.capped_plan(_sources(spark, d), 2_000_000, 0.05).select("key", "want", "take", "n_val", "n_train", "capped")


@query(f"WITH {_SOURCES}, p AS (SELECT *, least(round_even(weight / sum(weight) OVER () * 2000000, 0)::BIGINT, avail) AS take FROM s), t AS (SELECT key, take - floor(take * 0.05)::BIGINT AS n FROM p), b AS (SELECT key, n, unnest(range(0, n, 10000)) AS start FROM t) SELECT key, start, least(10000, n - start)::BIGINT AS length FROM b")
def mixture_blocks(spark, d):
    return mixture.blocks(mixture.capped_plan(_sources(spark, d), 2_000_000, 0.05), 10_000, 7).select("key", "start", "length")


_OVER = f"{_SOURCES}, o AS (SELECT key, avail - floor(avail * 0.05)::BIGINT AS u, floor(avail * 0.05)::BIGINT AS n_val, round_even(weight / sum(weight) OVER () * 5000000 * (1 - 0.05::DOUBLE), 0)::BIGINT AS want_train FROM s)"


@query(f"WITH {_OVER} SELECT key, u AS unique, n_val, want_train, want_train > u AS oversampled FROM o")
def mixture_oversampled(spark, d):
    return mixture.oversampled_plan(_sources(spark, d), 5_000_000, 0.05).select("key", "unique", "n_val", "want_train", "oversampled")


@query(f"WITH {_OVER}, l AS (SELECT *, unnest(range(0, (want_train - 1) // u + 1)) AS lap FROM o), m AS (SELECT *, least(u, want_train - lap * u) AS m FROM l), b AS (SELECT *, unnest(range(0, m, 20000)) AS start FROM m) SELECT key, lap, start, least(20000, m - start)::BIGINT AS length FROM b")
def tiled_blocks(spark, d):
    return mixture.tiled_blocks(mixture.oversampled_plan(_sources(spark, d), 5_000_000, 0.05), 20_000)


@query(f"WITH {_SOURCES} SELECT key, n, weight / greatest(1, n) AS item_weight FROM s")
def sampler_weights(spark, d):
    return mixture.sampler_weights(_sources(spark, d))


@query(f"WITH {_SOURCES} SELECT coalesce(category, 'TOTAL') AS category, round(sum(weight), 9) AS weight, round(sum(weight * 1000000), 6) AS target, sum(avail)::BIGINT AS avail, round(sum(weight * 1000000) / sum(avail), 9) AS ratio FROM s GROUP BY ROLLUP (category)")
def category_rollup(spark, d):
    rows = mixture.category_rollup(mixture.budget_plan(_sources(spark, d), 1_000_000))
    return rows.select("category", F.round("weight", 9).alias("weight"), F.round("target", 6).alias("target"), "avail", F.round("ratio", 9).alias("ratio"))


@query("SELECT doc_id, CASE WHEN doc_id < floor((SELECT count(*) FROM documents) * (0.35::DOUBLE / (0.35::DOUBLE + 0.65::DOUBLE))) THEN 1 ELSE 2 END AS phase FROM documents")
def curriculum(spark, d):
    df = docs(spark, d).select("doc_id")
    return mixture.curriculum(df, "doc_id", df.count(), 0.35, 0.65)


@query("SELECT doc_id, CASE WHEN k = 1 THEN source ELSE source || '-' || k END AS unique_name FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents)")
def unique_names(spark, d):
    return mixture.unique_names(docs(spark, d).select("doc_id", "source"), "source", "doc_id").select("doc_id", "unique_name")


# --- statistics, search, tokenizers ------------------------------------------


@query("SELECT coalesce(source, 'TOTAL') AS key, sum(length(text) + 1)::BIGINT AS tokens, round(sum(length(text)) / sum(length(text) + 1), 3) AS chars_per_token, round(sum(strlen(text)) / sum(length(text) + 1), 3) AS bytes_per_token FROM documents GROUP BY ROLLUP (source)")
def compression(spark, d):
    return stats.compression(docs(spark, d), "text", (F.length("text") + 1).cast("long"), "source")


@query("""WITH l AS (SELECT length(x) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS x FROM documents) WHERE x <> ''), r AS (SELECT n, row_number() OVER (ORDER BY n) - 1 AS k, count(*) OVER () AS t FROM l)
SELECT count(*) AS lines, round(sum(n) / count(*), 1) AS mean, max(CASE WHEN k = least(t - 1, floor(t * 0.95)) THEN n END)::INT AS p95, round(sum((n <= 512)::INT) / count(*), 4) AS within_512, round(sum((n <= 2048)::INT) / count(*), 4) AS within_2048, round(sum((n <= 8192)::INT) / count(*), 4) AS within_8192 FROM r""")
def line_lengths(spark, d):
    return stats.line_lengths(docs(spark, d), "text")


@query("SELECT source AS key, count(*) AS n, round(avg(length(text)), 6) AS mean, " + ", ".join(f"round(quantile_cont(length(text), {p}), 6) AS p{round(p * 100)}" for p in (0.1, 0.5, 0.9, 0.99)) + ", min(length(text))::INT AS least, max(length(text))::INT AS most FROM documents GROUP BY source")
def length_quantiles(spark, d):
    return stats.quantiles(docs(spark, d), F.length("text"), "source")


@query("SELECT least(39, greatest(0, floor(log10(length(text)) / (5.0::DOUBLE / 40))))::BIGINT AS bin, count(*) AS n FROM documents WHERE length(text) > 0 GROUP BY 1")
def length_histogram(spark, d):
    return stats.log_histogram(docs(spark, d), F.length("text"), 1.0, 1e5)


@query("SELECT count(DISTINCT c) AS used, round(count(DISTINCT c) / 1000, 4) AS utilization FROM (SELECT unnest(string_split(text, '')) AS c FROM documents) WHERE c <> ''")
def vocabulary_use(spark, d):
    return stats.vocabulary_use(docs(spark, d).select(text.code_point_ids(F.col("text")).alias("ids")), "ids", 1000)


@query("SELECT c AS ch, (row_number() OVER (ORDER BY c) - 1)::INT AS token FROM (SELECT DISTINCT unnest(string_split(text, '')) AS c FROM documents) WHERE c <> ''")
def char_vocabulary(spark, d):
    return tokenizer.char_vocabulary(docs(spark, d))


@query("WITH c AS (SELECT list_transform(string_split(text, ''), lambda x: unicode(x)) AS c FROM documents WHERE length(text) > 1), p AS (SELECT unnest(c[1:len(c) - 1]) AS a, unnest(c[2:]) AS b FROM c) SELECT a::INT AS a, b::INT AS b, count(*) AS n FROM p GROUP BY a, b")
def pair_counts(spark, d):
    return tokenizer.pair_counts(docs(spark, d).select(text.code_point_ids(F.col("text")).alias("ids")), "ids")


@query("SELECT doc_id, ((length(text) - length(replace(text, 'tion', ''))) // 4)::BIGINT AS hits FROM documents")
def substring_count(spark, d):
    return search.occurrences(docs(spark, d), "tion").select("doc_id", "hits")


@query("SELECT doc_id, len(regexp_extract_all(text, '(?i)th[aeiou]'))::BIGINT AS hits FROM documents")
def regex_count(spark, d):
    return search.occurrences(docs(spark, d), "th[aeiou]", regex=True, ignore_case=True).select("doc_id", "hits")


_HITS = "h AS (SELECT doc_id, text, unnest(list_filter(range(0, length(text)), lambda i: substr(text, i + 1, {n}) = '{needle}')) AS \"at\" FROM documents WHERE contains(text, '{needle}'))"


@query(f"""WITH {_HITS.format(needle='License', n=7)}, b AS (SELECT *, greatest(0, "at" - 20) AS s, least(length(text), "at" + 27) AS e FROM h)
SELECT doc_id, "at", CASE WHEN s > 0 THEN '…' ELSE '' END || replace(substr(text, s + 1, e - s), chr(10), ' ⏎ ') || CASE WHEN e < length(text) THEN '…' ELSE '' END AS snippet FROM b""")
def snippets(spark, d):
    return search.all_snippets(docs(spark, d).select("doc_id", "text"), "License", "doc_id", 20)


@query("""SELECT doc_id, p AS "at", CASE WHEN b > 0 THEN '…' ELSE '' END || replace(substr(text, b + 1, e - b), chr(10), ' ⏎ ') || CASE WHEN e < length(text) THEN '…' ELSE '' END AS snippet FROM
(SELECT doc_id, text, p, p - length(regexp_extract(substr(text, greatest(0, p - 4000) + 1, least(p, 4000)), '[^\\n]*$')) AS b, p + length(regexp_extract(substr(text, p + 1, 4000), '^[^\\n]*')) AS e FROM
(SELECT doc_id, text, unnest(list_filter(range(0, length(text)), lambda i: substr(text, i + 1, 3) = 'ion')) AS p FROM documents WHERE contains(text, 'ion'))) ORDER BY doc_id, p LIMIT 200""")
def line_snippets(spark, d):
    """The lines about the first 200 places of a needle."""
    return search.all_snippets(docs(spark, d).select("doc_id", "text"), "ion", "doc_id", most=200, whole=True)


@query("SELECT sum((length(text) - length(replace(text, 'tion', ''))) // 4)::BIGINT AS hits, sum(length(text))::BIGINT AS tokens, sum((length(text) - length(replace(text, 'tion', ''))) // 4) * 1000000.0::DOUBLE / sum(length(text)) AS per_million FROM documents")
def needle_frequency(spark, d):
    return search.frequency(docs(spark, d).withColumn("n", F.length("text")), "tion", "n")


# --- more of selection, adapters and cleaning ----------------------------------


@query(f"WITH {_SOURCES} SELECT key, floor(1000000 * weight / sum(weight) OVER ())::BIGINT AS cap_weighted, greatest(1, 1000000 // count(*) OVER ())::BIGINT AS cap_equal, ceil(weight / sum(weight) OVER () * 1000000 * 1.15::DOUBLE)::BIGINT AS cap_headroom FROM s")
def share_caps(spark, d):
    return selection.shares(_sources(spark, d), "weight", 1_000_000).select("key", "cap_weighted", "cap_equal", "cap_headroom")


@query("SELECT count(*) AS n, true AS near FROM documents")
def hashed_holdout(spark, d):
    """Whether a hashed tenth is about a tenth."""
    held = docs(spark, d).select(selection.hash_split(docs(spark, d), "doc_id", 0.1, 3).alias("h"))
    return held.agg(F.count(F.lit(1)).alias("n"), (F.abs(F.avg(F.col("h").cast("int")) - 0.1) < 0.05).alias("near"))


@query("SELECT doc_id, lang FROM documents WHERE lang = 'de'")
def native_split(spark, d):
    return selection.native_split(docs(spark, d).select("doc_id", "lang"), "validation", {"train": "en", "validation": "de"}, "lang")


@query(f"WITH {_SOURCES} SELECT key, n FROM s WHERE category <> 'c1'")
def eligible_sources(spark, d):
    return selection.eligible(_sources(spark, d).withColumn("exclude_from_tokenizer", F.when(F.col("category") == "c1", True))).select("key", "n")


@query(f"""WITH c AS ({_CUM}), t AS (SELECT sum(n)::BIGINT AS t FROM c), k AS (SELECT floor(t * (0.9::DOUBLE / (0.9::DOUBLE + 0.05::DOUBLE + 0.05::DOUBLE)))::BIGINT AS a, floor(t * ((0.9::DOUBLE + 0.05::DOUBLE) / (0.9::DOUBLE + 0.05::DOUBLE + 0.05::DOUBLE)))::BIGINT AS b, t FROM t)
SELECT doc_id, greatest(0, least(e, a) - (e - n))::BIGINT AS train, greatest(0, least(e, b) - greatest(e - n, a))::BIGINT AS validation, greatest(0, e - greatest(e - n, b))::BIGINT AS test FROM c, k""")
def three_way_split(spark, d):
    return selection.proportional_split(_sized(spark, d), "n", "doc_id").select("doc_id", "train", "validation", "test")


@query("SELECT md5(string_agg(text, chr(10) || chr(10) ORDER BY doc_id)) AS digest, count(*)::INT AS documents, strlen(string_agg(text, chr(10) || chr(10) ORDER BY doc_id))::INT AS bytes FROM (SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 500)")
def held_out_text(spark, d):
    return selection.first_texts(docs(spark, d), "doc_id").select(F.md5(F.col("text").cast("binary")).alias("digest"), "documents", "bytes")


@query("""WITH RECURSIVE r AS (SELECT row_number() OVER (ORDER BY doc_id) AS k, doc_id, length(text)::BIGINT AS n FROM documents WHERE text <> ''),
s AS (SELECT 0::BIGINT AS k, NULL::BIGINT AS doc_id, 0::BIGINT AS shard, 0::BIGINT AS used
      UNION ALL SELECT r.k, r.doc_id, s.shard + (s.used >= 20000 OR s.used > 0 AND s.used + r.n > 20000)::BIGINT, CASE WHEN s.used >= 20000 OR s.used > 0 AND s.used + r.n > 20000 THEN r.n ELSE s.used + r.n END FROM s JOIN r ON r.k = s.k + 1)
SELECT doc_id, shard AS shard_id FROM s WHERE k > 0""")
def shard_plan(spark, d):
    return artifacts.assign_shards(_sized(spark, d), "n", "doc_id", 20_000).select("doc_id", "shard_id")


@query(f"WITH {_STREAM} SELECT list(c ORDER BY p) AS ids FROM s WHERE p >= 1000 AND p < 9000")
def token_slice(spark, d):
    return windows.token_slice(tokens(docs(spark, d)), "ids", "doc_id", 1000, 9000)


@query("""SELECT doc_id, 'Problem:' || chr(10) || coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END, ''), lang, '') || chr(10) || chr(10) || 'Solution:' || chr(10) || coalesce(nullif(CASE WHEN doc_id % 4 = 0 THEN '' ELSE text END, ''), source, '') AS text FROM documents""")
def math_text(spark, d):
    rows = docs(spark, d).select("doc_id", F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("source")).alias("problem"), F.col("lang").alias("question"), F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.col("text")).alias("generated_solution"), F.col("source").alias("solution"))
    return adapters.math_text(rows).select("doc_id", "text")


@query("""SELECT doc_id, md5(CASE WHEN doc_id % 2 = 1 THEN source WHEN length(lang) >= length(text) THEN lang ELSE text END) AS digest FROM documents""")
def any_text(spark, d):
    """The column content where it has something, else the longest of the text columns."""
    rows = docs(spark, d).select("doc_id", F.when(F.col("doc_id") % 2 == 1, F.col("source")).alias("content"), F.col("lang").alias("a"), F.col("text").alias("b"))
    return adapters.any_text(rows, "made").select("doc_id", F.md5(F.col("made").cast("binary")).alias("digest"))


@query("WITH c AS (SELECT doc_id, text, unnest(range(0, (length(text) - 1) // 1000 + 1)) AS chunk FROM documents WHERE length(text) > 0) SELECT doc_id, chunk::INT AS chunk, md5(substr(text, chunk * 1000 + 1, 1000)) AS digest FROM c")
def text_chunks(spark, d):
    return catalog.text_chunks(docs(spark, d), size=1000).select("doc_id", F.col("chunk").cast("int").alias("chunk"), F.md5(F.col("piece").cast("binary")).alias("digest"))


@query("SELECT doc_id, md5(lang || 'é' || text || '😀' || chr(65533)) AS digest FROM documents")
def decoded_escapes(spark, d):
    noisy = F.concat("lang", F.lit("\\u00e9"), "text", F.lit("\\ud83d\\uDE00\\ud800"))
    return docs(spark, d).select("doc_id", F.md5(text.decode_escapes(noisy).cast("binary")).alias("digest"))


@query("""WITH t AS (SELECT conv_id, turn, list_transform(string_split(text, ''), lambda x: unicode(x)) AS c FROM conversations WHERE length(text) > 1)
SELECT conv_id, turn, list_transform(range(2, len(c) + 1), lambda i: (CASE WHEN c[i - 1] = 32 THEN -100 ELSE c[i] END)::INT) AS labels FROM t""")
def boundary_labels(spark, d):
    rows = spark.read.parquet(f"{d}/conversations.parquet").filter(F.length("text") > 1).select("conv_id", "turn", text.code_points(F.col("text")).alias("c"))
    n = F.size("c") - 1
    return rows.select("conv_id", "turn", chat.boundary_labels(F.slice("c", F.lit(1), n), F.slice("c", F.lit(2), n), 32).alias("labels"))


@query(f"""WITH {_PAIRS}, l AS (SELECT conv_id, turn, question, CASE WHEN turn % 4 = 0 THEN chr(9) || 'NONE' || chr(10) ELSE answer END AS answer FROM q), k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM l)
SELECT conv_id, string_agg({_TURN.format(r="'user'", c="CASE WHEN k = 1 THEN 'c' || chr(10) || chr(10) ELSE '' END || question")} || {_TURN.format(r="'assistant'", c="CASE WHEN trim(answer, chr(9) || chr(10) || ' ') = 'NONE' THEN 'I don''t know based on the passage.' ELSE answer END")}, '' ORDER BY turn) AS text FROM k GROUP BY conv_id""")
def unanswerable_qa(spark, d):
    got = _pairs(spark, d).withColumn("answer", F.when(F.col("turn") % 4 == 0, F.lit("\tNONE\n")).otherwise(F.col("answer"))).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "question", "answer"))).alias("p"))
    rows = got.select("conv_id", F.lit("c").alias("context"), F.transform("p", lambda x: x["question"]).alias("questions"), F.transform("p", lambda x: x["answer"]).alias("answers"))
    return adapters.conversational_qa(rows, "context", "questions", "answers", "NONE").select("conv_id", chat.render(F.col("messages")).alias("text"))


def _source_messages(spark, d) -> DataFrame:
    """Conversations as JSON texts with other names of roles, thinking, calls of tools and values that aren't texts."""
    t, own = F.col("turn"), F.col("role") == "assistant"
    quoted = F.expr("substring(to_json(named_struct('t', text)), 6, length(to_json(named_struct('t', text))) - 6)")
    name = F.when(own, "gpt").when(F.col("role") == "user", "human").otherwise("system")
    content = F.when(t % 5 == 2, F.lit('{"ok":true,"n":[1,2]}')).otherwise(quoted)
    call = F.concat(F.lit(',"tool_calls":[{"function":{"name":"find","arguments":{"q":"x","n":'), t.cast("string"), F.lit('}}},{"name":""}]'))
    said = F.concat(F.lit('{"from":"'), name, F.lit('","value":'), content, F.when(own & (t % 4 == 1), call).otherwise(""), F.when(own & (t % 4 == 3), ',"reasoning":" so "').otherwise(""), F.lit("}"))
    rows = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", said.alias("m"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("turn", "m"))), lambda x: x["m"])
    return rows.groupBy("conv_id").agg(F.concat(F.lit("[\"no message\","), F.array_join(listed, ","), F.lit("]")).alias("messages"))


@query(f"""WITH m AS (SELECT conv_id, turn, role, CASE WHEN turn % 5 = 2 THEN '{{"ok": true, "n": [1, 2]}}' ELSE text END AS c FROM conversations)
SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || CASE WHEN role = 'assistant' AND turn % 4 = 3 THEN '<think>' || chr(10) || 'so' || chr(10) || '</think>' || chr(10) ELSE '' END || c
  || CASE WHEN role = 'assistant' AND turn % 4 = 1 THEN CASE WHEN c <> '' THEN chr(10) ELSE '' END || '<tool_call>' || chr(10) || '{{"name": "find", "arguments": {{"q": "x", "n": ' || turn || '}}}}' || chr(10) || '</tool_call>' ELSE '' END
  || '<|im_end|>' || chr(10), '' ORDER BY turn) AS text FROM m GROUP BY conv_id""")
def source_messages(spark, d):
    return messages.normalize(_source_messages(spark, d)).select("conv_id", chat.render(F.col("messages"), full=True).alias("text"))


@query("""SELECT conv_id, string_agg('<' || CASE role WHEN 'assistant' THEN 'gpt' WHEN 'user' THEN 'human' ELSE role END || '>' || chr(10) || CASE WHEN turn % 5 = 2 THEN '{"ok": true, "n": [1, 2]}' ELSE text END, chr(10) || chr(10) ORDER BY turn) AS text
FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT DISTINCT conv_id, -1, '?', 'no message' FROM conversations) GROUP BY conv_id""")
def message_previews(spark, d):
    return messages.coerce(_source_messages(spark, d)).select("conv_id", adapters.preview(F.col("messages")).alias("text"))


@query(f"""SELECT conv_id, '<|im_start|>system' || chr(10) || 'Be brief.' || chr(10) || chr(10) || '# Tools' || chr(10) || '<tools>' || chr(10) || '[]' || chr(10) || '</tools><|im_end|>' || chr(10) || coalesce(string_agg({_CHAT}, '' ORDER BY turn) FILTER (role <> 'system'), '') || '<|im_start|>assistant' || chr(10) AS text FROM conversations GROUP BY conv_id""")
def prompted_chat(spark, d):
    system = chat.system_text(F.lit(" Be brief. "), F.lit("[]"))
    return conversations(spark, d).select("conv_id", chat.render(F.col("messages"), system=system, generation_prompt=True).alias("text"))


# --- more of windows, mixtures and statistics ----------------------------------


@query("""WITH t AS (SELECT doc_id, unnest(range(1, length(text) + 1)) AS i, unnest(list_transform(string_split(text, ''), lambda x: unicode(x))) AS c FROM documents WHERE text <> ''),
s AS (SELECT row_number() OVER (ORDER BY doc_id, i) - 1 AS p, c::INT AS x, (CASE WHEN c = 101 THEN -100 ELSE c END)::INT AS y FROM t), n AS (SELECT greatest(0, (count(*) - 1) // 4096) AS n FROM s),
a AS (SELECT p // 4096 AS w, md5(string_agg(x::VARCHAR, ',' ORDER BY p)) AS x FROM s GROUP BY 1), b AS (SELECT (p - 1) // 4096 AS w, md5(string_agg(y::VARCHAR, ',' ORDER BY p)) AS y FROM s WHERE p > 0 GROUP BY 1)
SELECT a.w::BIGINT AS window_id, x, y FROM a JOIN b USING (w), n WHERE a.w < n""")
def labelled_windows(spark, d):
    rows = docs(spark, d).select("doc_id", text.code_point_ids(F.col("text")).alias("ids"))
    rows = rows.withColumn("labels", F.transform("ids", lambda c: F.when(c == 101, -100).otherwise(c)))
    digest = lambda c: F.md5(F.array_join(c, ",").cast("binary")).alias(c)
    return windows.packed(rows, "ids", "doc_id", 4096, "labels").select("window_id", digest("x"), digest("y"))


@query(f"""WITH {_PAIRS}, t AS (SELECT ordinal, list_transform(string_split(question, ''), lambda x: unicode(x)::INT) AS c, list_transform(string_split(answer, ''), lambda x: unicode(x)::INT) AS a FROM q WHERE answer <> '' AND question <> ''),
k AS (SELECT *, unnest(range(0, (len(a) + 31) // 32)) AS k FROM t), s AS (SELECT *, a[k * 32 + 1:k * 32 + 32] AS target, c || a[1:least(len(a), k * 32 + 32)] AS seen FROM k)
SELECT ordinal, k::INT AS k, target, seen[greatest(1, len(seen) - 32):len(seen) - 1] AS inp FROM s""")
def continuations(spark, d):
    rows = _pairs(spark, d).filter("answer <> '' and question <> ''").select("ordinal", text.code_points(F.col("question")).alias("c"), text.code_points(F.col("answer")).alias("a"))
    return windows.continuation(rows, "c", "a", 32).select("ordinal", "k", "target", "inp")


@query("""WITH RECURSIVE r AS (SELECT row_number() OVER (ORDER BY length(text) DESC, doc_id) AS k, doc_id, length(text)::BIGINT AS n FROM documents),
s AS (SELECT 0::BIGINT AS k, NULL::BIGINT AS doc_id, -1::BIGINT AS batch, 0::BIGINT AS width, 0::BIGINT AS rows, 0::BIGINT AS n
      UNION ALL SELECT r.k, r.doc_id, CASE WHEN s.rows = 0 OR s.width * (s.rows + 1) > 40000 THEN s.batch + 1 ELSE s.batch END, CASE WHEN s.rows = 0 OR s.width * (s.rows + 1) > 40000 THEN r.n ELSE s.width END,
             CASE WHEN s.rows = 0 OR s.width * (s.rows + 1) > 40000 THEN 1 ELSE s.rows + 1 END, r.n FROM s JOIN r ON r.k = s.k + 1)
SELECT doc_id, batch AS batch_id, width::INT AS padded_size, (width - n)::INT AS padding FROM s WHERE k > 0""")
def budget_batches(spark, d):
    rows = docs(spark, d).select("doc_id", text.code_point_ids(F.col("text")).alias("ids"))
    made = windows.budget_batches(rows, "doc_id", "ids", 40_000, -1)
    return made.select("doc_id", "batch_id", F.size("padded").alias("padded_size"), F.size(F.filter("padded", lambda x: x == -1)).alias("padding"))


@query("""WITH r AS (SELECT doc_id, length(text) AS n, strlen(text) AS b FROM documents), w AS (SELECT unnest([512, 2048, 4096, 8192]) AS width), x AS (SELECT * FROM r, w WHERE n >= width),
k AS (SELECT *, unnest(range(0, greatest(0, ceil((n - width) / (width // 2)))::BIGINT + 1)) AS k FROM x),
s AS (SELECT *, least(k * (width // 2) + width, n) - greatest(k * (width // 2), CASE WHEN k > 0 THEN least((k - 1) * (width // 2) + width, n) ELSE 0 END) - (k = 0)::INT AS scored FROM k),
t AS (SELECT width, doc_id, any_value(b) AS b, sum(scored) AS scored, sum(scored * 0.5::DOUBLE * (1 + doc_id % 3)) AS nll FROM s GROUP BY width, doc_id)
SELECT width::INT AS width, count(*) AS documents, sum(scored)::BIGINT AS scored, round(sum(nll) / sum(b) / ln(2), 9) AS bpb FROM t GROUP BY width""")
def banded_bits(spark, d):
    rows = docs(spark, d).select(F.col("doc_id").alias("key"), F.length("text").cast("long").alias("size"), F.octet_length("text").alias("bytes"))
    scored = windows.band_windows(rows, "size").withColumn("nll", F.col("scored") * 0.5 * (1 + F.col("key") % 3))
    return stats.banded_bits(scored.select("key", "width", "scored", "nll"), rows).select("width", "documents", F.col("scored").cast("long").alias("scored"), F.round("bpb", 9).alias("bpb"))


@query(f"""WITH w AS (SELECT lang, doc_id, unnest(range(0, length(text) // {L})) AS k FROM documents WHERE lang IN ('de', 'fr') AND length(text) >= {L}),
o AS (SELECT CASE lang WHEN 'fr' THEN 0 ELSE 1 END AS part_index, lang AS part, doc_id * 1000 + k AS window_id FROM w) SELECT part, part_index::INT AS part_index, window_id, row_number() OVER (ORDER BY part_index, window_id) - 1 AS item FROM o""")
def concat_windows(spark, d):
    """Windows of two languages as one numbered set."""
    def of(lang):
        rows = docs(spark, d).filter((F.col("lang") == lang) & (F.length("text") >= L))
        rows = rows.select("doc_id", F.explode(F.sequence(F.lit(0), F.expr(f"length(text) div {L} - 1"))).alias("k"))
        return rows.select((F.col("doc_id") * 1000 + F.col("k")).cast("long").alias("window_id"))

    return mixture.concat([("fr", of("fr")), ("de", of("de"))], "window_id")


@query("WITH n AS (SELECT count(*) FILTER (length(text) < 2048) AS s, count(*) FILTER (length(text) >= 2048) AS l FROM documents) SELECT 'short' AS pool, s AS n, 0.35::DOUBLE / (0.35::DOUBLE + 0.65::DOUBLE) / greatest(1, s) AS item_weight FROM n UNION ALL SELECT 'long', l, 0.65::DOUBLE / (0.35::DOUBLE + 0.65::DOUBLE) / greatest(1, l) FROM n")
def pool_weights(spark, d):
    rows = _sized(spark, d)
    return mixture.pool_weights(rows.filter("n < 2048"), rows.filter("n >= 2048"), *mixture.STAGE_SHARES[2048])


@query(f"WITH {_SOURCES}, r AS (SELECT key, CASE WHEN row_number() OVER (ORDER BY key) <= 4 THEN 25 ELSE 0 END AS ratio FROM s) SELECT key, ratio::INT AS ratio, floor(ratio * 12345 / 100)::BIGINT AS cap FROM r WHERE ratio > 0")
def ratio_caps(spark, d):
    k = F.row_number().over(Window.orderBy("key"))  # a row a source
    rows = _sources(spark, d).select("key", F.when(k <= 4, 25).otherwise(0).alias("ratio"))
    return mixture.ratio_caps(rows, 12_345)


@query(f"WITH {_SOURCES} SELECT key, s.weight / sum(s.weight) OVER () AS share FROM s WHERE n % 2 = 0 OR category <> 'c0'")
def available_sources(spark, d):
    every = _sources(spark, d)
    caches = every.filter("n % 2 = 0 or category <> 'c0'").select("key", "avail")
    return mixture.available(every.select("key", "weight", F.lit(None).cast("double").alias("sft_weight")), caches).select("key", "share")


@query("WITH s AS (SELECT source AS key, row_number() OVER (ORDER BY source) AS o, sum(length(text))::BIGINT AS t, sum(strlen(text))::BIGINT AS b FROM documents GROUP BY source) SELECT key, (sum(t) OVER (ORDER BY o) - t)::BIGINT AS start, (sum(t) OVER (ORDER BY o))::BIGINT AS finish, round(b / t, 9) AS bytes_per_token FROM s UNION ALL SELECT 'TOTAL', 0, sum(t)::BIGINT, round(sum(b) / sum(t), 9) FROM s")
def source_totals(spark, d):
    rows = docs(spark, d).groupBy(F.col("source").alias("key")).agg(F.sum(F.length("text")).alias("tokens"), F.sum(F.octet_length("text")).alias("bytes"))
    rows = rows.withColumn("ordinal", F.row_number().over(Window.orderBy("key")))
    return stats.source_totals(rows).withColumn("bytes_per_token", F.round("bytes_per_token", 9))


@query("SELECT (doc_id % 5)::BIGINT AS distance, count(*) AS n, avg(coalesce((length(text) % 4 = doc_id % 4)::INT, 0)) AS recall FROM documents GROUP BY 1")
def recall_by_distance(spark, d):
    return stats.recall(docs(spark, d).select((F.col("doc_id") % 5).alias("distance"), (F.length("text") % 4).cast("long").alias("target"), (F.col("doc_id") % 4).alias("predicted")))


@query("SELECT source, sum(CASE WHEN doc_id % 10 <> 0 THEN length(text) ELSE 0 END)::BIGINT AS train, sum(CASE WHEN doc_id % 10 = 0 THEN length(text) ELSE 0 END)::BIGINT AS validation FROM documents GROUP BY source")
def source_tokens(spark, d):
    return stats.token_counts(_sized(spark, d).withColumn("split", F.when(F.col("doc_id") % 10 == 0, "validation").otherwise("train")), "n")


@query(f"WITH {_SOURCES} SELECT count(*) AS sources, sum(n)::BIGINT AS rows, sum(avail)::BIGINT AS bytes, sum(avail // 4)::BIGINT AS est_tokens, coalesce(sum(CASE WHEN category <> 'c0' THEN avail // 4 END), 0)::BIGINT AS pretrain_tokens FROM s")
def staging_summary(spark, d):
    rows = _sources(spark, d).select(F.col("n").alias("rows"), F.col("avail").alias("bytes"), F.expr("avail div 4").alias("est_tokens"), F.when(F.col("category") == "c0", 0.0).otherwise(F.col("weight")).alias("weight"))
    return stats.staging_summary(rows)


@query("SELECT source, round(sum((doc_id % 3 + 1) * 0.5::DOUBLE) / sum(length(text)) / ln(2), 12) AS bpb FROM documents GROUP BY source")
def source_bits(spark, d):
    rows = _sized(spark, d).withColumn("nll", (F.col("doc_id") % 3 + 1) * 0.5)
    return stats.nll_summary(rows, "nll", "n", "source").select("source", F.round("bpb", 12).alias("bpb"))


@query("SELECT doc_id, round(2.5::DOUBLE / (ln(2) * strlen(text) / length(text)), 9) AS bpb, 2.5::DOUBLE AS loss FROM documents WHERE text <> ''")
def nats_and_bits(spark, d):
    ratio = F.octet_length("text") / F.length("text")
    rows = docs(spark, d).filter("text <> ''").select("doc_id", stats.bits_per_byte(F.lit(2.5), ratio).alias("bpb"), ratio.alias("r"))
    return rows.select("doc_id", F.round("bpb", 9).alias("bpb"), F.round(stats.loss_of(F.col("bpb"), F.col("r")), 9).alias("loss"))


@query("SELECT lang AS key, sum(length(text))::BIGINT AS tokens, round(sum(strlen(text)) / sum(length(text)), 6) AS bytes_per_token FROM documents WHERE doc_id % 2 = 0 GROUP BY lang")
def supervised_bytes(spark, d):
    return stats.masked_bytes(docs(spark, d).withColumn("n", F.length("text").cast("long")), "text", "n", F.col("doc_id") % 2 == 0, "lang")


@query("SELECT d.conv_id AS request, coalesce(sum((length(text) % 8) * -0.25::DOUBLE) FILTER (role = 'assistant'), 0) AS logprob, coalesce(bool_and(length(text) % 5 <> 0) FILTER (role = 'assistant'), true) AS greedy FROM conversations d GROUP BY 1")
def request_scores(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet")
    rows = c.filter("role = 'assistant'").select(F.col("conv_id").alias("request"), (F.length("text") % 8 * -0.25).alias("logprob"), (F.length("text") % 5 != 0).alias("greedy"))
    return stats.request_scores(c.select(F.col("conv_id").alias("request")).distinct(), rows)


_RESULTS = "r AS (SELECT source AS task, m AS metric, o::INT AS ordinal, CASE WHEN m = 'alias' THEN NULL ELSE ((count(*) * (o + 3)) % 97) / 128.0::DOUBLE END AS value FROM documents, (SELECT unnest(['alias', 'acc_stderr', 'f1', 'acc', 'acc_norm', 'perplexity']) AS m, unnest(range(6)) AS o) WHERE NOT (m = 'acc_norm' AND ascii(substr(source, 4)) % 2 = 0) AND NOT (m = 'acc' AND ascii(substr(source, 4)) % 3 = 0) GROUP BY source, m, o)"


def _results(spark, d) -> DataFrame:
    m = F.explode(F.array(*[F.struct(F.lit(x).alias("metric"), F.lit(i).alias("ordinal")) for i, x in enumerate(("alias", "acc_stderr", "f1", "acc", "acc_norm", "perplexity"))]))
    rows = docs(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n")).select("source", "n", m.alias("m"))
    code = F.ascii(F.substring("source", 4, 100))
    rows = rows.filter(~((F.col("m.metric") == "acc_norm") & (code % 2 == 0)) & ~((F.col("m.metric") == "acc") & (code % 3 == 0)))
    value = F.when(F.col("m.metric") != "alias", (F.col("n") * (F.col("m.ordinal") + 3)) % 97 / 128.0)
    return rows.select(F.col("source").alias("task"), "m.metric", "m.ordinal", value.alias("value"))


_HEAD = "h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY CASE metric WHEN 'acc_norm' THEN 1 WHEN 'acc' THEN 2 WHEN 'perplexity' THEN 3 ELSE 99 END, ordinal) AS k FROM r WHERE NOT suffix(metric, '_stderr') AND metric <> 'alias' AND value IS NOT NULL) WHERE k = 1)"


@query(f"WITH {_RESULTS}, {_HEAD} SELECT task, metric, value FROM h")
def headline_metrics(spark, d):
    return stats.headline(_results(spark, d))


@query(f"WITH {_RESULTS}, {_HEAD}, c AS (SELECT DISTINCT task, 25.0::DOUBLE AS chance FROM r WHERE ascii(substr(task, 4)) % 4 <> 0), f AS (SELECT DISTINCT task, 40.0::DOUBLE AS reference FROM r WHERE ascii(substr(task, 4)) % 5 <> 0) SELECT task, metric, CASE WHEN metric = 'perplexity' THEN h.value ELSE h.value * 100 END AS value, chance, reference, CASE WHEN reference IS NULL THEN NULL WHEN metric = 'perplexity' THEN h.value <= reference ELSE h.value * 100 >= reference END AS best FROM h LEFT JOIN c USING (task) LEFT JOIN f USING (task)")
def results_table(spark, d):
    code = F.ascii(F.substring("task", 4, 100))
    names = _results(spark, d).select("task").distinct()
    return stats.results_table(stats.headline(_results(spark, d)), names.filter(code % 4 != 0).withColumn("chance", F.lit(25.0)), names.filter(code % 5 != 0).withColumn("reference", F.lit(40.0)))


@query("SELECT sum((doc_id % 8) * 0.125::DOUBLE * length(text)) / sum(length(text)) AS weighted, avg((doc_id % 8) * 0.125::DOUBLE) AS plain FROM documents")
def weighted_loss(spark, d):
    return stats.weighted_mean(_sized(spark, d).withColumn("v", F.col("doc_id") % 8 * 0.125), "v", "n")


@query("SELECT source, 'repo-' || source || '@' || substr(md5(source), 1, 12) AS pin, coalesce(v, '-') AS views FROM (SELECT DISTINCT source FROM documents) LEFT JOIN (SELECT source, string_agg(DISTINCT lang, ', ' ORDER BY lang) AS v FROM documents WHERE ascii(substr(source, 4)) % 3 <> 0 GROUP BY source) USING (source)")
def source_listing(spark, d):
    rows = docs(spark, d).select("source", "lang").distinct()
    views = rows.filter(F.ascii(F.substring("source", 4, 100)) % 3 != 0).select("source", F.col("lang").alias("view"))
    return stats.listing(rows.select("source").distinct().select("source", F.concat(F.lit("repo-"), "source").alias("repo"), F.md5(F.col("source").cast("binary")).alias("revision")), views)


# --- catalogs and tokenizers -----------------------------------------------------


def _catalog(d) -> registry.Catalog:
    source = catalog.Source("docs", d, "parquet", "documents.parquet")
    view = lambda key, **how: registry.View(key, "docs", ordinal="doc_id", split=registry.CarvedSplit(0.05), **how)
    views = [view("text", options={"columns": ["text"]}), view("tagged", options={"columns": ["lang", "text"]}), view("asked", adapter="pair", options={"question": "lang", "answer": "text"}), view("kept", exclude_from_tokenizer=True)]
    return registry.Catalog({"docs": source}, {v.key: v for v in views})


_TRAIN = "r AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS k FROM documents), v AS (SELECT * FROM r WHERE k > round_even((SELECT count(*) FROM documents) * 5 / 100, 0))"


@query(f"WITH {_TRAIN} SELECT doc_id AS ordinal, md5(lang || chr(10) || chr(10) || text) AS digest FROM v")
def catalog_documents(spark, d):
    return _catalog(d).documents(spark, "tagged", "train").select("ordinal", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("SELECT doc_id AS ordinal, md5('Question: ' || lang || chr(10) || 'Answer: ' || text) AS digest FROM (SELECT *, row_number() OVER (ORDER BY doc_id) AS k FROM documents) WHERE k <= round_even((SELECT count(*) FROM documents) * 5 / 100, 0)")
def catalog_validation(spark, d):
    return _catalog(d).documents(spark, "asked", "validation").select("ordinal", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(f"WITH {_TRAIN} SELECT doc_id AS ordinal, text FROM v ORDER BY doc_id LIMIT 7")
def catalog_sample(spark, d):
    """The first rendered documents of a view."""
    return _catalog(d).documents(spark, "text", "train").orderBy("ordinal").limit(7).select("ordinal", "text")


@query(f"""WITH {_TRAIN}, e AS (SELECT 'text' AS source_view, doc_id, length(text)::BIGINT AS n FROM v UNION ALL SELECT 'tagged', doc_id, length(lang || text) + 2 FROM v),
c AS (SELECT *, sum(n) OVER (PARTITION BY source_view ORDER BY doc_id) AS e FROM e) SELECT source_view, 100000::BIGINT AS requested, sum(n)::BIGINT AS chars, count(*) AS documents FROM c WHERE e - n < 100000 GROUP BY source_view""")
def tokenizer_corpus(spark, d):
    made = build.corpus_meta(build.corpus(spark, _catalog(d), ["text", "tagged", "kept"], 200_000))
    return made.withColumn("requested", F.col("requested").cast("long"))


@query("SELECT doc_id, list_transform(range(0, strlen(text)), lambda i: ('0x' || substr(hex(encode(text)), 2 * i + 1, 2))::INT + 11) AS ids FROM documents WHERE length(text) <= 400")
def byte_tokens(spark, d):
    """Tokens of short texts without merges: their bytes, after the special ones."""
    encode = tokenizer.encode_column(spark, tokenizer.BytePairs([], chat.SPECIAL_TOKENS))
    return docs(spark, d).filter(F.length("text") <= 400).select("doc_id", encode("text").alias("ids"))


@query("SELECT w AS word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '\\p{L}+')) AS w FROM documents) GROUP BY w")
def letter_words(spark, d):
    """How often each run of letters is a word of the tokenizer's, with or without the space before it."""
    counts = tokenizer.word_counts(docs(spark, d)).filter(F.regexp_like("word", F.lit(r"^ ?\p{L}+$")))
    return counts.groupBy(F.ltrim("word").alias("word")).agg(F.sum("n").alias("n"))
