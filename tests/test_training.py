import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

import quillmill
from quillmill.functions import chat, messages, text
from quillmill.functions.ordered import in_ranges, prefix_sum
from quillmill.operators import artifacts, mixture, search, windows
from quillmill.operators.tokenizer import BytePairs, Pretrained, merge
from quillmill.plans import build, training
from quillmill.sources import catalog, presets, registry


def test_ranges_have_like_sizes_wherever_ordinals_lie(spark):
    rows = [(i, 1) for i in range(40_000)] + [(1 << 50, 5), ((1 << 50) + 7, 2)]
    df = spark.createDataFrame(rows, "o long, v int")
    sizes = [r["count"] for r in in_ranges(df, "o").groupBy("_part").count().collect()]
    assert max(sizes) <= 40 and len(sizes) > 1000
    got = {r.o: r.end for r in prefix_sum(df.withColumn("t", F.lit("payload")), "v", "o").collect()}
    assert got[39_999] == 40_000 and got[1 << 50] == 40_005 and got[(1 << 50) + 7] == 40_007
    composite = spark.createDataFrame([(c * 1000 + t, 1) for c in range(50) for t in range(c % 7 + 1)], "o long, v int")
    assert sorted(r.end for r in prefix_sum(composite, "v", "o").collect()) == list(range(1, composite.count() + 1))
    assert prefix_sum(df.limit(0), "v", "o").collect() == []
    one = spark.createDataFrame([(3, 4)], "o long, v int")
    assert [r.end for r in prefix_sum(one, "v", "o").collect()] == [4]


def test_strip_and_cleaning_of_odd_texts(spark):
    texts = [None, "", " \u2003\x85a b\u3000\n", "x\u200b\u00a0y", "e\u0301 \t\n\n\n\nz", "a\r\nb\rc", "\x1c"]
    want = [None, "", "a b", "x y", "\u00e9\n\nz", "a\nb\nc", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r.t for r in df.select("i", text.normalize(F.col("t")).alias("t")).orderBy("i").collect()] == want
    ids = df.select("i", text.code_points(F.col("t")).alias("a"), text.code_point_ids(F.col("t")).alias("b")).orderBy("i").collect()
    assert all(r.a == r.b == (None if t is None else [ord(c) for c in t]) for r, t in zip(ids, texts, strict=True))
    rows = spark.createDataFrame([(["\n\t", "a", "\u3000", None, "b"],)], "dialogue array<string>")
    from quillmill.operators import adapters

    assert [(m.role, m.content) for m in adapters.alternating(rows).first().messages] == [("assistant", "a"), ("user", "b")]


def test_messages_of_many_shapes(spark):
    cases = [
        ([{"role": "assistant", "content": "<think> a </think> b", "tool_calls": [{"name": "f", "parameters": {"z": 1, "a": [1.5, None]}}, {"name": "g", "arguments": "not json"}, {"name": "h", "arguments": None}, {"name": ""}]}], [("assistant", "b", "a", ['{"name": "f", "arguments": {"z": 1, "a": [1.5, null]}}', '{"name": "g", "arguments": "not json"}', '{"name": "h", "arguments": null}'])]),
        ([{"role": "", "from": "human", "content": None, "value": "v\\u00e9"}, 5, None, [1], {"value": {"a": 1}}], [("user", "v\u00e9", None, []), ("user", '{"a": 1}', None, [])]),
        ([{"role": "user", "content": "t", "tool_calls": [{"name": "f"}], "thinking": "x"}], [("user", "t", None, [])]),
        ([{"role": "assistant", "content": "c", "thinking": "", "reasoning": {"k": 1}, "function_call": '{"name": "q", "arguments": "{\\"x\\": 1}"}'}], [("assistant", "c", '{"k": 1}', ['{"name": "q", "arguments": {"x": 1}}'])]),
        ([], []),
    ]
    texts = [json.dumps(m) for m, _ in cases] + [repr(cases[1][0]), "{}", "no", "'text'", None]
    want = [w for _, w in cases] + [cases[1][1], [], [], [], []]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [[(m.role, m.content, m.thinking, list(m.calls)) for m in r.t] for r in messages.normalize(df, "t", "t").orderBy("i").collect()]
    assert got == want


def test_training_data_in_one_call(spark, tmp_path):
    r = random.Random(1)
    words = "the cat sat on a mat and then it ran away".split()
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    spark.createDataFrame([(i, say(r.randint(3, 60))) for i in range(300)], "ordinal long, text string").write.parquet(str(tmp_path / "a"))
    spark.createDataFrame([(i, json.dumps([{"role": "user", "content": say(5)}, {"role": "assistant", "content": say(40)}])) for i in range(200)], "ordinal long, messages string").write.parquet(str(tmp_path / "b"))
    views = {"a": registry.View("a", "a", split=registry.CarvedSplit(0.1)), "b": registry.View("b", "b", "messages", objective="assistant-only", split=registry.CarvedSplit(0.1))}
    found = registry.Catalog({k: catalog.Source(k, str(tmp_path / k)) for k in "ab"}, views)
    t = BytePairs.train([(w, 5) for w in words] + [(" " + w, 9) for w in words], 290, chat.SPECIAL_TOKENS)
    parts = [training.Part("a", 0.3), training.Part("b", 0.7, sampling=training.DocumentWindows(most=2))]
    data = training.compile_mixture(spark, found, parts, t, str(tmp_path / "out"), 16, add_bos=True)
    training.verify(data)
    assert {x.source: (x.train, x.validation) for x in training.token_counts(data).collect()} == {v: (n["train"], n["validation"]) for v, n in data.tokens().items()}
    rows = data.windows().collect()
    assert sorted(x.item for x in rows) == list(range(len(rows))) and {x.part for x in rows} == {"a", "b"}
    assert all(len(x.x) == len(x.y) == 16 for x in rows) and all(x.y[:-1] == x.x[1:] for x in rows if x.part == "a")
    assert any(-100 in x.y for x in rows if x.part == "b") and max(x.item for x in rows if x.part == "a") < min(x.item for x in rows if x.part == "b")
    drawn = data.batches(4, samples=4000).collect()
    assert len(drawn) == 4000 and abs(sum(x.part == "b" for x in drawn) / 4000 - 0.7) < 0.04
    plain = training.TrainingData(spark, [training.Part("a")], 16, data.paths, data.manifests)
    took = plain.batches(7).collect()
    assert len(took) % 7 == 0 and len(took) > plain.windows().count() - 7
    assert [x.batch_id for x in plain.batches(7, "validation").orderBy("place").collect()][:8] == [0] * 7 + [1]
    again = training.compile_mixture(spark, found, parts, t, str(tmp_path / "out"), 16, add_bos=True)
    assert again.manifests == data.manifests
    with pytest.raises(ValueError):
        mixture.pool_weights(data.windows(), data.windows().limit(0), 0.3, 0.7)
    with pytest.raises(ValueError):
        mixture.ratio_caps(spark.createDataFrame([("a", 99)], "key string, ratio int"), 10)


def test_presets_and_public_names(spark):
    assert set(presets.views()) == set(presets.PRESETS) and len(presets.PRESETS) == 20
    assert all(v.adapter in registry.ADAPTERS and v.objective in registry.OBJECTIVES for v in presets.views().values())
    assert all(getattr(quillmill, n) is not None for n in quillmill.NAMES) and dir(quillmill) == sorted(quillmill.NAMES)
    squad = spark.createDataFrame([(0, "c", "q1", (["a1"],)), (1, "c", "q2", (["a2", "x"],)), (2, "d", "q3", ([],))], "ordinal long, context string, question string, answers struct<text array<string>>")
    v = presets.views()["squad.pretrain"]
    got = registry.ADAPTERS[v.adapter](squad, **v.options).orderBy("ordinal").collect()
    assert got[0].segments[0].text == "c\n\nQuestion: q1\nAnswer: a1\n\nQuestion: q2\nAnswer: a2" and len(got) == 2
    tree = spark.createDataFrame([(0, "m", None, "en", True, None, "prompter", "hi"), (1, "n", "m", "en", True, 0, "assistant", "yo")], "ordinal long, message_id string, parent_id string, lang string, review_result boolean, rank int, role string, text string")
    assert [m.role for m in registry.ADAPTERS["reply_trees"](tree).first().messages] == ["user", "assistant"]


def test_raw_files(spark, tmp_path):
    d = tmp_path / "raw"
    d.mkdir()
    (d / "a.json").write_text('[{"x": 1, "y": "a"}, {"x": 2}]')
    (d / "b.json").write_text('{"x": 3}\n{"x": 4, "z": 5}\n')
    got = catalog.json_rows(spark, [str(d / "a.json"), str(d / "b.json")], ["x", "z", "none"])
    assert got.columns == ["x", "z"] and sorted((r.x, r.z) for r in got.collect()) == [(1, None), (2, None), (3, None), (4, 5)]
    for name, n in (("p-0", 50), ("p-1", 3), ("q-0", 10)):
        spark.range(n).selectExpr("id", "'t' as text").coalesce(1).write.parquet(str(tmp_path / name))
        next((tmp_path / name).glob("part*.parquet")).rename(d / f"{name}.parquet")
    assert catalog.peek(spark, str(d), 2).count() == 2 and catalog.peek(spark, str(d), 99).count() == 3
    rows = catalog.stage_report(spark, str(d), first=2).collect()
    assert sorted((r.path, r.rows, r.columns, r.has_text, r.est_tokens == r.bytes // 4) for r in rows) == [("p-0.parquet", 50, 2, True, True), ("p-1.parquet", 3, 2, True, True)]
    assert [r.path for r in catalog.listed(catalog.file_sizes(spark, str(d)), "q").collect()] == ["q-0.parquet"]
    with pytest.raises(FileNotFoundError):
        catalog.peek(spark, str(d), suffix=".none")
    (d / "one.txt").write_text("a\nb")
    assert catalog.raw_text(spark, str(d / "one.txt")).first().text == "a\nb"


def test_blobs(spark):
    blobs = spark.createDataFrame([("a", bytearray(gzip.compress("gr\u00fc\u00df".encode("latin-1")))), ("b", bytearray(b"no gzip")), ("c", bytearray(gzip.compress(b"\xff ok"))), ("d", bytearray(gzip.compress(b"x"))), ("e", bytearray(gzip.compress(b"cut off")[:-9]))], "blob_id string, content binary")
    df = spark.createDataFrame([("a", "latin-1"), ("b", "utf-8"), ("c", None), ("d", "no such"), ("e", "utf-8"), ("gone", "utf-8")], "blob_id string, src_encoding string")
    assert {r.blob_id: r.text for r in catalog.decode_blobs(df, blobs).collect()} == {"a": "gr\u00fc\u00df", "c": "\ufffd ok"}


def by_recount(data: str, size: int):
    ids, merges = list(data.encode()), []
    while 256 + len(merges) < size:
        seen = {}
        for p in zip(ids, ids[1:]):
            seen[p] = seen.get(p, 0) + 1
        best = max(seen, key=seen.get, default=None)
        if best is None or seen[best] < 2:
            break
        ids = merge(ids, best, 256 + len(merges))
        merges.append(best)
    return merges


@pytest.mark.parametrize("seed", range(4))
def test_stream_training_crosses_documents(seed):
    r = random.Random(seed)
    texts = ["".join(r.choice("aab \u00e4") for _ in range(r.randint(0, 40))) for _ in range(20)]
    assert BytePairs.train_stream(texts, 300).merges == by_recount("".join(texts), 300)
    assert BytePairs.train_stream(["aaaa", "aaa"], 258).merges == by_recount("aaaaaaa", 258)
    assert BytePairs.train_stream([], 300).merges == []


def test_pretrained_tokenizers(spark, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    model = Tokenizer(models.WordLevel({"[UNK]": 0, "cat": 1, "mat": 2}, unk_token="[UNK]"))
    model.pre_tokenizer = pre_tokenizers.Whitespace()
    model.save(str(tmp_path / "t.json"))
    t = build.resolve(spark, None, 0, pretrained=str(tmp_path / "t.json"))
    assert isinstance(t, Pretrained) and t.encode("cat mat dog") == [1, 2, 0] and t.vocab_size == 3 and t.special_id("cat") == 1
    docs = spark.createDataFrame([(0, [("mat cat", True)])], "ordinal long, segments array<struct<text string, supervised boolean>>")
    assert list(build.token_documents(docs, t).first().ids) == [2, 1]
    with pytest.raises(ValueError):
        t.special_id("dog")
    path = build.tokenizer_path(str(tmp_path), {"s": "rev"}, "own", 300, 1000)
    rows = spark.createDataFrame([("the cat the cat",)], "text string")
    made = build.resolve(spark, rows, 300, path=path)
    assert build.resolve(spark, None, 0, path=path).merges == made.merges != []
    assert path != build.tokenizer_path(str(tmp_path), {"s": "new"}, "own", 300, 1000)


def test_batches_of_a_budget_are_padded(spark):
    r = random.Random(2)
    sizes = [r.choice([0, 1, 2, 3, 3, 3, 9, 20]) for _ in range(200)]
    df = spark.createDataFrame([(i, list(range(n))) for i, n in enumerate(sizes)], "i long, ids array<int>")
    got = {x.i: (x.batch_id, len(x.padded)) for x in windows.budget_batches(df, "i", "ids", 20, -1).collect()}
    want = windows.token_batches(list(enumerate(sizes)), 20)
    assert {i: b for i, (b, _) in got.items()} == dict(want)
    widest = {}
    for i, b in want:
        widest[b] = max(widest.get(b, 0), sizes[i])
    assert all(n == widest[b] for b, n in got.values())
    assert windows.budget_batches(df.limit(0), "i", "ids", 20, -1).collect() == []


def test_places_and_decoded_text(spark, tmp_path):
    df = spark.createDataFrame([(1, "aaab aa"), (2, "b"), (3, None), (4, "\naa\n" + "x" * 5000 + "aa")], "k long, text string")
    assert sorted((r.k, r.at) for r in search.places(df, "aa").collect()) == [(1, 0), (1, 1), (1, 5), (4, 1), (4, 5004)]
    got = {(r.k, r.at): r.snippet for r in search.all_snippets(df, "aa", "k", whole=True).collect()}
    assert got[1, 0] == "aaab aa" and got[4, 1] == "\u2026aa\u2026" and got[4, 5004] == "\u2026" + "x" * 4000 + "aa"
    docs = spark.createDataFrame([(0, [1, 2])], "ordinal long, ids array<int>")
    asked = []

    def decode(ids):
        return "<s>" + "-".join(map(str, ids)) + "<e>"

    for stamp in ("one", "one", "two"):
        rows = search.decode_cache(spark, docs, decode, ["<s>", "<e>"], str(tmp_path / "c"), stamp)
        asked.append(rows.first().text)
    assert asked == ["\n1-2\n"] * 3 and len(list((tmp_path / "c").iterdir())) == 2


def test_texts_are_put_in_place_by_one_rename(spark, tmp_path):
    path = f"{tmp_path}/m.json"
    for value in ("one", "two"):
        artifacts._write_text(spark, path, value)
        assert artifacts.read_text(spark, path) == value
    assert artifacts.fingerprint("plain", {}, ["b", "a"], {}) == artifacts.fingerprint("plain", {}, ["a", "b"], {}) != artifacts.fingerprint("plain", {}, None, {})
