import random

import pytest
from pyspark.sql import functions as F

from quillmill.functions import chat, text
from quillmill.functions.ordered import prefix_sum
from quillmill.operators import artifacts, mixture, selection, stats, windows
from quillmill.operators.tokenizer import BytePairs, encode_column, merge
from quillmill.sources import catalog


def test_prefix_sum_over_uneven_ordinals(spark):
    rows = [(i * i, i % 7, i % 3) for i in range(500)]
    got = {r.o: r.end for r in prefix_sum(spark.createDataFrame(rows, "o long, v int, g int"), "v", "o", ("g",)).collect()}
    for g in range(3):
        total = 0
        for o, v, _ in sorted(r for r in rows if r[2] == g):
            total += v
            assert got[o] == total


def test_artifact_shards_slices_and_manifest(spark, tmp_path):
    df = spark.createDataFrame([(0, [1, 2, 3], [-100, 2, 3]), (1, [4, 5, 6], [-100, 5, 6])], "ordinal long, ids array<int>, labels array<int>")
    path = artifacts.directory(str(tmp_path), "view.a", {"x": 1})
    m = artifacts.write(df, path, {"x": 1}, 4, 300, labelled=True)
    assert (m["tokens"], m["documents"], len(m["shards"]), m["dtype"]) == (6, 2, 2, "int16")
    assert artifacts.verify(spark, path) == artifacts.write(df, path, {}, 4, 300, labelled=True) == m
    assert windows.token_slice(df, "ids", "ordinal", 2, 5).first().ids == [3, 4, 5]
    got = {r.window_id: (r.x, r.y) for r in windows.packed(df, "ids", "ordinal", 2).collect()}
    assert got[1] == ([3, 4], [4, 5]) and len(got) == 2
    assert {r.window_id: (r.x, r.y) for r in windows.packed(df, "ids", "ordinal", 2, "labels").collect()}[0] == ([1, 2], [2, 3])
    with pytest.raises(ValueError, match="unsafe text view key"):
        artifacts.directory("r", "../../outside", {})
    artifacts._write_text(spark, f"{path}/manifest.json", '{"version": 999}')
    with pytest.raises(ValueError, match="unsupported text artifact version"):
        artifacts.verify(spark, path)


def test_shard_plan_ends_before_an_overflow():
    assert artifacts.shard_plan([(0, 3), (1, 0), (2, 3), (3, 9), (4, 1), (5, 3)], 4) == [(0, 0), (2, 1), (3, 2), (4, 3), (5, 3)]


def test_caps_cut_a_long_first_document(spark):
    df = spark.createDataFrame([(0, 7), (1, 2)], "o long, n long")
    assert [(r.o, r.kept) for r in selection.cap_documents(df, "n", "o", 5).collect()] == [(0, 5)]
    assert selection.cap_documents(df, "n", "o", 0).count() == 0


def test_windows_stay_inside_documents(spark):
    df = spark.createDataFrame([(0, 3), (1, 50), (2, 5), (3, 1000)], "d long, n long")
    rows = windows.document_windows(df, "n", "d", 8, most=3).collect()
    assert {r.d for r in rows} == {1, 3} and all(0 <= r.offset <= {1: 50, 3: 1000}[r.d] - 9 for r in rows)
    assert [r for r in rows if r.d == 3].__len__() == 3
    other = windows.document_windows(df, "n", "d", 8, most=3, epoch=1).collect()
    assert [r.offset for r in rows] != [r.offset for r in other]


def test_positions_equal_brute_force(spark):
    for ids in ([5, 3, 0, 7, 7, 7, 0, 2], [0, 0, 4, 4, 4], [9, 8, 7]):
        got = spark.createDataFrame([(ids,)], "x array<int>").select(windows.doc_positions(F.col("x"), 0).alias("p")).first().p
        doc = pos = 0
        for t, p in zip(ids, got, strict=True):
            assert (p.doc, p.pos) == (doc, pos)
            doc, pos = (doc + 1, 0) if t == 0 else (doc, pos + 1)


def test_continuation_probe_and_batches(spark):
    df = spark.createDataFrame([([1, 2], list(range(10, 19)))], "c array<int>, a array<int>")
    rows = windows.continuation(df, "c", "a", 4).orderBy("k").collect()
    assert [r.target for r in rows] == [[10, 11, 12, 13], [14, 15, 16, 17], [18]] and all(len(r.inp) <= 4 for r in rows)
    for r in windows.induction_probe(spark, 20, 32, 8, 256).collect():
        assert len(r.ids) == 8 + 2 + 32 + 1 and r.ids[8] == r.ids[-1] != r.ids[9] == r.target and max(r.ids[:8] + r.ids[10:-1]) < 128
    assert windows.token_batches([(0, 5), (1, 4), (2, 9)], 10) == [(2, 0), (0, 1), (1, 1)]


def test_draws_follow_shares(spark):
    n = mixture.draws(spark, [("a", 400, 0.35), ("b", 40, 0.65)], 20_000, 3).filter("key = 'b'").count()
    assert abs(n / 20_000 - 0.65) < 0.03
    with pytest.raises(ValueError):
        mixture.sampler_weights(spark.createDataFrame([("a", 0, 1.0)], "key string, n long, weight double"))


def test_chat_parts(spark):
    df = spark.createDataFrame([("<think> a </think> b",), ("c",)], "t string")
    got = [tuple(r) for r in df.select(*chat.split_thinking(F.col("t"))).collect()]
    assert got == [("a", "b"), (None, "c")]
    assert df.select(chat.role(F.lit("gpt")), chat.role(F.lit("x")), chat.role(F.lit(None).cast("string"))).first()[:] == ("assistant", "user", "user")
    x = spark.createDataFrame([("a\\u00e9\\ud83d\\ude00b",)], "t string").select(text.decode_escapes(F.col("t"))).first()[0]
    assert x == "aé😀b"


def test_byte_pairs_round_trip(spark):
    r = random.Random(1)
    words = ["the", " cat", " sat", " on", " thé", " mat", "!", "\n\n", " 😀"]
    counts = [(w, r.randint(2, 50)) for w in words]
    t = BytePairs.train(counts, 300, chat.SPECIAL_TOKENS)
    probe = "the cat<|im_end|>\n\n  sat 42's on thé 😀!"
    assert t.decode(t.encode(probe)) == probe and t.encode("<|im_end|>") == [4]
    assert BytePairs.from_json(t.to_json()).encode(probe) == t.encode(probe)
    assert merge([1, 1, 1], (1, 1), 9) == [9, 1]
    with pytest.raises(ValueError):
        BytePairs.train(counts, 100)
    got = spark.createDataFrame([(probe,), (None,)], "t string").select(encode_column(spark, t)("t").alias("i")).collect()
    assert got[0].i == t.encode(probe) and got[1].i is None


def test_headline_and_listing(spark):
    df = spark.createDataFrame([("a", "acc", 0.5, 0), ("a", "acc_norm", 0.6, 1), ("a", "acc_norm_stderr", 0.1, 2), ("b", "f1", 0.3, 0)], "task string, metric string, value double, ordinal int")
    assert {r.task: r.metric for r in stats.headline(df).collect()} == {"a": "acc_norm", "b": "f1"}
    s = spark.createDataFrame([("s", "r", "0123456789abcdef"), ("t", "q", "1" * 40)], "source string, repo string, revision string")
    v = spark.createDataFrame([("s", "z"), ("s", "b")], "source string, view string")
    assert sorted(tuple(r) for r in stats.listing(s, v).collect()) == [("s", "r@0123456789ab", "b, z"), ("t", "q@111111111111", "-")]


def test_local_documents_and_locks(spark, tmp_path):
    (tmp_path / "note.md").write_text("first\n\nline")
    assert [r.text for r in catalog.local_documents(spark, str(tmp_path), repeat=3).collect()] == ["first\n\nline"] * 3
    assert catalog.local_documents(spark, str(tmp_path), repeat=3, train=False).count() == 1
    assert catalog.update_lock(["a", "gone"], ["b*"], ["a", "b1", "b2"]) == ["a", "b1", "b2"]
    with pytest.raises(RuntimeError):
        catalog.require_lock({"k": {"repo": "r", "revision": "short"}}, "k", "r")
    with pytest.raises(ValueError):
        catalog.check_selection(["x"], ["y"])
