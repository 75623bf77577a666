"""Which tokens of a conversation are learned, by the tokenizer's own chat template."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, replace
from typing import Protocol


class ChatTokenizer(Protocol):
    """What is asked of a tokenizer: ids of a text, a text of ids, and the chat template."""

    def __call__(self, text: str, add_special_tokens: bool = ...) -> dict: ...
    def decode(self, ids: list[int], skip_special_tokens: bool = ...) -> str: ...
    def apply_chat_template(self, messages: list[dict], tokenize: bool = ..., add_generation_prompt: bool = ..., **options) -> str: ...


@dataclass(frozen=True)
class MaskedTokens:
    """Ids, a 0/1 mask of the learned ones, and their spans (from, to)."""

    ids: list[int]
    mask: list[int]
    spans: list[tuple[int, int]]

    def labels(self, ignored: int = -100) -> list[int]:
        return [i if on else ignored for i, on in zip(self.ids, self.mask, strict=True)]


def _shared(a: list[int], b: list[int]) -> int:
    """The length of the common beginning."""
    return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def mask_conversation(
    tokenizer: ChatTokenizer, messages: Sequence[dict], learned: Sequence[bool] | None = None, thinking: bool | None = None, most: int | None = None
) -> MaskedTokens:
    """Tokens of the whole conversation; of a learned message those behind the template's header count.

    The conversation is encoded up to each message, so a template that merges tokens across messages can't
    shift the mask. Without ``learned`` the assistant's messages are. Beyond ``most`` tokens the beginning
    is cut off.
    """
    messages = list(messages)
    learned = [m.get("role") == "assistant" for m in messages] if learned is None else list(learned)
    if len(learned) != len(messages):
        raise ValueError("learned must be as long as messages")

    def encoded(upto: int, header: bool) -> list[int]:
        if not upto and not header:
            return []
        options = {} if thinking is None else {"enable_thinking": thinking}
        text = tokenizer.apply_chat_template(messages[:upto], tokenize=False, add_generation_prompt=header, **options) if upto else ""
        return list(tokenizer(text, add_special_tokens=False)["input_ids"])

    ids: list[int] = []
    mask: list[int] = []
    for i, on in enumerate(learned):
        new = encoded(i + 1, False)
        same = _shared(ids, new)
        begin = max(same, _shared(encoded(i, messages[i].get("role") == "assistant"), new))
        ids, mask = new, mask[:same] + [0] * (begin - same) + [int(on)] * (len(new) - begin)
    cut = max(0, len(ids) - most) if most is not None else 0
    ids, mask = ids[cut:], mask[cut:]
    return MaskedTokens(ids, mask, _spans(mask))


def _spans(mask: list[int]) -> list[tuple[int, int]]:
    edges = [i for i in range(len(mask) + 1) if (mask[i] if i < len(mask) else 0) != (mask[i - 1] if i else 0)]
    return list(zip(edges[::2], edges[1::2], strict=True))


#: Blocks of a model's own decisions, and those of the environment.
ACTIONS, ENVIRONMENT = ("plan", "expand", "answer"), ("execute",)


def only_actions(tokenizer: ChatTokenizer, masked: MaskedTokens, actions: Sequence[str] = ACTIONS) -> MaskedTokens:
    """Of the learned tokens those that lie wholly in blocks of ``actions`` and in none of the environment's.

    A span without such a block stays but for the environment's. Places are counted in the texts of single
    tokens, so they can't drift.
    """
    mask = list(masked.mask)
    block = lambda names: re.compile(rf"<({'|'.join(map(re.escape, names))})\s*>.*?</\1\s*>", re.S | re.I)
    for a, b in masked.spans:
        pieces = [tokenizer.decode([i], skip_special_tokens=False) for i in masked.ids[a:b]]
        text = "".join(pieces)
        kept = [m.span() for m in block(actions).finditer(text)] if actions else []
        kept = kept or [(0, len(text))]
        gone = [m.span() for m in block(ENVIRONMENT).finditer(text)]
        at = 0
        for i, piece in enumerate(pieces, a):
            low, high = at, at + len(piece)
            at = high
            inside = any(x <= low and high <= y for x, y in kept) and not any(x < high and low < y for x, y in gone)
            if piece and not inside:
                mask[i] = 0
    return replace(masked, mask=mask, spans=_spans(mask))
