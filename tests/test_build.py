import json
import random

import pytest
from pyspark.sql import functions as F

from quillmill.__main__ import main
from quillmill.functions import chat, messages
from quillmill.operators import artifacts
from quillmill.operators.tokenizer import BytePairs, merge
from quillmill.plans import build
from quillmill.sources import registry

RAW = [
    {"from": "human", "value": "a\\u00e9"},
    {"role": "gpt", "content": "<think> t </think> said", "tool_calls": '[{"function": {"name": "f", "arguments": "{\\"x\\": 1}"}}, {"arguments": {}}]'},
    "not a message",
    {"role": "assistant", "content": "", "reasoning": " r ", "function_call": {"name": "g"}},
    {"role": "tool", "content": {"ok": True}},
]


def test_messages_normalize_and_render(spark):
    df = spark.createDataFrame([(json.dumps(RAW),), ("{}",), (None,), ("no list",)], "m string")
    rows = [r.t for r in messages.normalize(df.coalesce(1), "m", "t").collect()]
    assert rows[1:] == [[], [], []]
    user, first, second, tool = rows[0]
    assert (user.role, user.content) == ("user", "aé")
    assert (first.content, first.thinking, first.calls) == ("said", "t", ['{"name": "f", "arguments": {"x": 1}}'])
    assert (second.content, second.thinking, second.calls) == ("", "r", ['{"name": "g", "arguments": {}}'])
    assert (tool.role, tool.content) == ("tool", '{"ok": true}')
    text = messages.normalize(df.limit(1), "m", "t").select(chat.render(F.col("t"), full=True)).first()[0]
    assert text == (
        "<|im_start|>user\naé<|im_end|>\n"
        '<|im_start|>assistant\n<think>\nt\n</think>\nsaid\n<tool_call>\n{"name": "f", "arguments": {"x": 1}}\n</tool_call><|im_end|>\n'
        '<|im_start|>assistant\n<think>\nr\n</think>\n<tool_call>\n{"name": "g", "arguments": {}}\n</tool_call><|im_end|>\n'
        '<|im_start|>tool\n<tool_response>\n{"ok": true}\n</tool_response><|im_end|>\n'
    )


def test_coerced_conversations(spark):
    df = spark.createDataFrame([("[{'from': 'a', 'value': 'b'}]",), ("words",), (None,)], "v string")
    got = [[tuple(m) for m in r.t] for r in messages.coerce(df.coalesce(1), "v", "t").collect()]
    assert got == [[("a", "b")], [("raw", "words")], []]


def by_recount(counts, size, specials):
    """Training that counts all pairs again in each round."""
    base, words, merges = len(specials), [([len(specials) + b for b in w.encode()], n) for w, n in counts], []
    while base + 256 + len(merges) < size:
        seen = {}
        for ids, n in words:
            for p in zip(ids, ids[1:]):
                seen[p] = seen.get(p, 0) + n
        best = max(seen, key=seen.get, default=None)
        if best is None or seen[best] < 2:
            break
        merges.append(best)
        words = [(merge(ids, best, base + 255 + len(merges)), n) for ids, n in words]
    return merges


@pytest.mark.parametrize("seed", range(6))
def test_training_equals_a_recount(seed):
    r = random.Random(seed)
    counts = sorted({"".join(r.choice("abcä") for _ in range(r.randint(1, 9))): r.randint(1, 4) for _ in range(60)}.items())
    assert BytePairs.train(counts, 400, ["<s>"]).merges == by_recount(counts, 400, ["<s>"])


def one_pass(docs, t, bos, eos, most):
    """Documents one after the other until one doesn't fit."""
    out, n = [], 0
    for segs in docs:
        ids, labels = [bos], [-100]
        for text, own in segs:
            piece = t.encode(text)
            ids, labels = ids + piece, labels + (piece if own else [-100] * len(piece))
        ids, labels = ids + [eos], labels + [-100]
        if n + len(ids) > most:
            if n == 0 and most > 0:
                ids = (ids[: max(1, most - 1)] + [eos])[:most]
                out.append((ids[:-1] + [eos], labels[: most - 1] + [-100]))
            break
        n += len(ids)
        out.append((ids, labels))
    return out


@pytest.mark.parametrize("most", [0, 1, 2, 7, 1000])
def test_caps_of_compiled_documents(spark, tmp_path, most):
    t = BytePairs.train([("the", 5), (" cat", 4)], 280, chat.SPECIAL_TOKENS)
    docs = [[("the cat sat", False), (" on the mat", True)], [("the", True)], [], [("cat cat cat", True)]]
    df = spark.createDataFrame([(i * 3, d) for i, d in enumerate(docs)], "ordinal long, segments array<struct<text string, supervised boolean>>")
    path = str(tmp_path / "a")
    made = build.compile_documents(df, path, {}, t, most, 1, 0, "assistant-only", shard_tokens=20)
    want = one_pass(docs, t, 1, 0, most)
    assert (made["documents"], made["tokens"]) == (len(want), sum(len(x) for x, _ in want))
    assert artifacts.verify(spark, path) == made
    if want:
        got = spark.read.parquet(f"{path}/shards").orderBy("ordinal").collect()
        assert [(list(r.ids), list(r.labels)) for r in got] == want
    assert not (tmp_path / "a" / "staging").exists()


def test_catalog_and_command_line(spark, tmp_path, capsys):
    spark.createDataFrame([(i, f"text number {i} " * 5, "[]") for i in range(200)], "ordinal long, text string, messages string").write.parquet(str(tmp_path / "src"))
    data = {"sources": {"s": {"path": str(tmp_path / "src")}}, "views": {"v": {"source": "s", "carve": 0.1}, "w": {"source": "s", "adapter": "messages", "exclude_from_tokenizer": True}}}
    file = tmp_path / "catalog.json"
    file.write_text(json.dumps(data))
    run = lambda *a: main(["--catalog", str(file), *a])
    run("lock", "s", "--files", "*.parquet")
    run("list")
    assert capsys.readouterr().out.strip().endswith("\tv, w")
    run("sample", "v", "--count", "1")
    assert capsys.readouterr().out.startswith("--- 0\ntext number 20 ")
    catalog = registry.Catalog.from_json(file.read_text())
    assert set(catalog.inspect("v")) == {"view", "source", "lock"} and set(catalog.inspect("s")) == {"source", "lock"}
    with pytest.raises(SystemExit):
        run("inspect", "nothing")
    rows = build.corpus(spark, catalog, ["v", "w"], 2000)
    meta = build.corpus_meta(rows).collect()
    assert [(r.source_view, r.requested) for r in meta] == [("v", 2000)] and 2000 <= meta[0].chars < 2100
    with pytest.raises(ValueError):
        build.corpus(spark, catalog, ["w"], 10)
    with pytest.raises(ValueError):
        catalog.rows(spark, "v", "train", ["other.parquet"])
    t = build.resolve(spark, rows, 300)
    (tmp_path / "t.json").write_text(t.to_json())
    run("build", "v", "--tokenizer", str(tmp_path / "t.json"), "--data-dir", str(tmp_path / "out"))
    out = capsys.readouterr().out
    assert "180 documents" in out and "20 documents" in out
    run("validate", out.split("\t")[1])
    assert "180 documents" in capsys.readouterr().out


def test_tokenizer_suite_and_held_out(spark):
    df = spark.createDataFrame([(i, f"the cat {i} sat\non the mat") for i in range(50)], "ordinal long, text string")
    held = build.held_out_text(df, "ordinal", 100, 60)
    texts = [r.text for r in df.orderBy("ordinal").collect()]
    taken, i = 0, 0
    while taken < 100:
        taken, i = taken + len(texts[i]), i + 1
    assert "\n".join(r.text for r in held.orderBy("ordinal").collect()) == "\n".join(texts[i:])[:60]
    made = build.suite(spark, df, held, [290, 300])
    assert list(made) == ["290", "300"] and all(r["round_trip"] and r["atomic"] for _, r in made.values())
    assert made["300"][1]["chars_per_token"] >= made["290"][1]["chars_per_token"]
    assert made["290"][0].merges == build.resolve(spark, df, 290).merges
    with pytest.raises(ValueError):
        build.same_tokenizer([{"seq_len": 1}, {"seq_len": 2}])


def test_request_pairs_and_tags(spark):
    t = BytePairs.train([("the", 5), (" cat", 4)], 280, chat.SPECIAL_TOKENS)
    rows = [("the  ", "cat"), ("", "cat"), ("", ""), ("", "<|startoftext|>cat"), (None, "the")]
    df = build.request_pairs(spark.createDataFrame(rows, "c string, a string"), t, "c", "a", prefix=1, bos=1)
    got = [(list(r.context_ids), list(r.answer_ids)) for r in df.collect()]
    assert got[0] == ([1, *t.encode("the")], t.encode("the  cat")[len(t.encode("the")) :])
    assert got[1:] == [([1], t.encode("cat")), ([1], []), ([1], t.encode("cat")), ([1], t.encode("the"))]
    tags = spark.createDataFrame([(["A", "B", "C", "f"],), (["f", "A"],), (["A", "A"],), ([],), (["A", "f", "g"],), (["A", "x"],), (["A", "B", "C", "D"],), (None,)], "t array<string>")
    assert [r[0] for r in tags.select(build.valid_tags(F.col("t"), list("ABCD"), ["f", "g"])).collect()] == [True] + [False] * 7
