"""Conversations to marked-up text, segments, and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What right results need.
SPECIAL_TOKENS = ["<|endoftext|>", "<|startoftext|>", "<|pad|>", "<|im_start|>", "<|im_end|>", "<think>", "</think>", "<tool_call>", "</tool_call>", "<tool_response>", "</tool_response>"]
ROLES = {
    "human": "user", "user": "user", "prompter": "user",
    "gpt": "assistant", "assistant": "assistant", "model": "assistant", "chatbot": "assistant", "function_call": "assistant",
    "observation": "tool", "tool": "tool", "ipython": "tool", "tool_response": "tool", "function_response": "tool",
    "system": "system",
}
IGNORE = -100


def role(c: Column) -> Column:
    """The canonical role of a source's role name; unknown and null ones are the user's."""
    table = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return F.coalesce(F.element_at(table, F.coalesce(F.nullif(c, F.lit("")), F.lit("user"))), F.lit("user"))


def split_thinking(content: Column) -> tuple[Column, Column]:
    """(thinking, rest): a leading <think> block and what follows it, both stripped; else null and the content as it is."""
    from .text import strip

    has = F.startswith(F.regexp_replace(content, r"^\s+", ""), F.lit("<think>")) & F.contains(content, F.lit("</think>"))
    head = F.substring_index(content, "</think>", 1)
    after = F.substring(content, F.length(head) + F.lit(len("</think>") + 1), F.length(content))
    thinking = F.substring(head, F.instr(head, "<think>") + len("<think>"), F.length(head))
    return F.when(has, strip(thinking)), F.when(has, strip(after)).otherwise(content)


def system_text(system: Column, tools: Column) -> Column:
    """The body of a leading system turn from a prompt and a schema of tools; null without both."""
    from .text import strip

    said = F.when(F.nullif(system, F.lit("")).isNotNull(), strip(system))
    listed = F.when(F.nullif(tools, F.lit("")).isNotNull(), F.concat(F.lit("# Tools\n<tools>\n"), tools, F.lit("\n</tools>")))
    return F.nullif(F.concat_ws("\n\n", said, listed), F.lit(""))


def segments(messages: Column, generation_prompt: bool = False, system: Column | None = None, full: bool = False) -> Column:
    """array<struct<text, supervised>> of messages, an array of structs with role and content, and if `full` thinking and calls.

    Headers, users', systems' and tools' words aren't supervised; the assistant's thinking, words, calls and end mark are. With
    a `system` text that isn't null, that comes first and the messages' own system turns go.
    """

    def seg(text: Column, supervised: Column) -> Column:
        return F.struct(text.alias("text"), supervised.alias("supervised"))

    no = F.lit(False)

    def turn(m: Column) -> Column:
        r, c = role(m["role"]), F.coalesce(m["content"], F.lit(""))
        own = r == "assistant"
        body = F.when(r == "tool", F.concat(F.lit("<tool_response>\n"), c, F.lit("\n</tool_response>"))).otherwise(c)
        thinking, called = [], []
        if full:  # empty where a turn has none
            blocks = F.transform(m["calls"], lambda j: F.concat(F.lit("<tool_call>\n"), j, F.lit("\n</tool_call>")))
            some = own & (F.coalesce(F.size(m["calls"]), F.lit(0)) > 0)
            thought = F.concat(F.lit("<think>\n"), m["thinking"], F.lit("\n</think>\n"))
            thinking = [seg(F.when(own & (F.coalesce(m["thinking"], F.lit("")) != ""), thought).otherwise(""), own)]
            called = [seg(F.when(some, F.concat(F.when(c != "", "\n").otherwise(""), F.array_join(blocks, "\n"))).otherwise(""), own)]
        said = F.filter(F.array(*thinking, seg(body, own), *called), lambda s, i: (s["text"] != "") | (~own & (i == len(thinking))))
        head = F.array(seg(F.concat(F.lit("<|im_start|>"), r, F.lit("\n")), no))
        return F.concat(head, said, F.array(seg(F.lit("<|im_end|>"), own), seg(F.lit("\n"), no)))

    kept = messages if system is None else F.filter(messages, lambda m: system.isNull() | (role(m["role"]) != "system"))
    out = F.flatten(F.transform(kept, turn))
    if system is not None:
        lead = F.array(seg(F.concat(F.lit("<|im_start|>system\n"), system, F.lit("<|im_end|>\n")), no))
        out = F.concat(F.when(system.isNotNull(), lead).otherwise(F.slice(lead, 1, 0)), out)
    if generation_prompt:
        out = F.concat(out, F.array(seg(F.lit("<|im_start|>assistant\n"), no)))
    return out


def render(messages: Column, **how) -> Column:
    """The text of all segments."""
    return F.array_join(F.transform(segments(messages, **how), lambda s: s["text"]), "")


def ids_and_labels(segs: Column, bos: int | None, eos: int | None, masked: bool = True) -> Column:
    """struct<ids, labels>: code points of the segments, each on its own; labels are IGNORE where a segment isn't supervised."""
    from .text import code_points

    edge = lambda x: [F.array(F.lit(x))] if x is not None else []
    ids = F.concat(*edge(bos), F.flatten(F.transform(segs, lambda s: code_points(s["text"]))), *edge(eos))
    ignored = lambda x: [F.array(F.lit(IGNORE))] if x is not None else []
    label = lambda s: F.when(s["supervised"], code_points(s["text"])).otherwise(F.array_repeat(F.lit(IGNORE), F.length(s["text"])))
    labels = F.concat(*ignored(bos), F.flatten(F.transform(segs, label)), *ignored(eos)) if masked else F.lit(None).cast("array<int>")
    return F.struct(ids.alias("ids"), labels.alias("labels"))


def boundary_labels(x: Column, y: Column, eos: int) -> Column:
    """Labels y with IGNORE where the input token is the end of a text."""
    return F.zip_with(x, y, lambda a, b: F.when(a == eos, F.lit(IGNORE)).otherwise(b))
