"""Views of public datasets by name: which adapter reads their rows."""

from __future__ import annotations

from .registry import CarvedSplit, View

# View, source, adapter, its options, objective and unit, as users of these names expect them.
PRESETS = {
    "tinystories-v2.pretrain": ("tinystories-v2", "plain", {}, "next-token", "story"),
    "tiny-textbooks.pretrain": ("tiny-textbooks", "plain", {"columns": ["textbook"]}, "next-token", "doc"),
    "tiny-strange-textbooks.pretrain": ("tiny-strange-textbooks", "plain", {}, "next-token", "doc"),
    "tiny-webtext.pretrain": ("tiny-webtext", "joined", {"left": "human", "right": "bot"}, "next-token", "doc"),
    "fineweb-edu.pretrain": ("fineweb-edu", "plain", {}, "next-token", "doc"),
    "cosmopedia-v2.pretrain": ("cosmopedia-v2", "plain", {}, "next-token", "doc"),
    "gooaq.pretrain": ("gooaq", "pair", {}, "next-token", "pair"),
    "squad.pretrain": ("squad", "passages", {"answer": "answers.text.0"}, "next-token", "passage"),
    "coqa.pretrain": ("coqa", "story", {}, "next-token", "passage"),
    "stackexchange.pretrain": ("stackexchange", "joined", {"left": "INSTRUCTION", "right": "RESPONSE"}, "next-token", "qa"),
    "wikipedia.pretrain": ("wikipedia", "plain", {}, "next-token", "article"),
    "gooaq.sft": ("gooaq", "single_turn", {}, "assistant-only", "pair"),
    "squad.sft": ("squad", "single_turn", {"answer": "answers.text.0", "context": "context"}, "assistant-only", "qa"),
    "coqa.sft": ("coqa", "conversational_qa", {"context": "story"}, "assistant-only", "passage"),
    "quac.sft": ("quac", "conversational_qa", {"answers": "orig_answers.texts", "cannot_answer": "CANNOTANSWER"}, "assistant-only", "dialog"),
    "no-robots.sft": ("no-robots", "turns", {}, "assistant-only", "conv"),
    "smoltalk.everyday.sft": ("smoltalk", "turns", {}, "assistant-only", "conv"),
    "soda.sft": ("soda", "alternating", {}, "assistant-only", "dialog"),
    "oasst1.sft": ("oasst1", "reply_trees", {}, "assistant-only", "conv"),
    "ultrachat-200k.sft": ("ultrachat-200k", "turns", {}, "assistant-only", "conv"),
}
#: Views with a split of their own.
CARVED = {"coqa.sft"}


def views(ordinal: str = "ordinal") -> dict[str, View]:
    """All presets as views over sources of these names, whose rows have such an ordinal."""
    return {k: View(k, source, adapter, dict(options), objective, ordinal, unit, split=CarvedSplit() if k in CARVED else None) for k, (source, adapter, options, objective, unit) in PRESETS.items()}
