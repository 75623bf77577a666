"""What a model says and what it is told."""

from __future__ import annotations

import json
import re
import time
import urllib.request
from dataclasses import dataclass, field
from typing import Protocol

from millrace.operators import operator_manual

Message = dict[str, str]


@dataclass
class Reply:
    text: str
    prompt_tokens: int = 0
    completion_tokens: int = 0
    cached_tokens: int = 0


class Model(Protocol):
    model: str

    def generate(self, messages: list[Message], temperature: float = 0.01, max_tokens: int = 4096, stop: list[str] | None = None) -> Reply: ...


class ScriptedModel:
    """Replays given replies; the last one repeats."""

    model = "scripted"

    def __init__(self, replies: list[str]):
        self.replies, self.calls = list(replies), []

    def generate(self, messages, temperature=0.01, max_tokens=4096, stop=None) -> Reply:
        self.calls.append(messages)
        text = self.replies[min(len(self.calls), len(self.replies)) - 1] if self.replies else ""
        return Reply(text, sum(len(m["content"]) for m in messages) // 4, len(text) // 4)


class HttpModel:
    """A chat-completions endpoint, with retries that wait longer each time."""

    def __init__(self, model: str, base_url: str, api_key: str, retries: int = 4, timeout: float = 120):
        self.model, self.base_url, self.api_key = model, base_url.rstrip("/"), api_key
        self.retries, self.timeout = retries, timeout

    def generate(self, messages, temperature=0.01, max_tokens=4096, stop=None) -> Reply:
        body = {"model": self.model, "messages": messages, "temperature": temperature, "max_tokens": max_tokens}
        if stop:
            body["stop"] = stop
        request = urllib.request.Request(
            f"{self.base_url}/chat/completions", json.dumps(body).encode(),
            {"Content-Type": "application/json", "Authorization": f"Bearer {self.api_key}"},
        )
        for attempt in range(self.retries + 1):
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as r:  # noqa: S310
                    d = json.load(r)
                use = d.get("usage") or {}
                cached = (use.get("prompt_tokens_details") or {}).get("cached_tokens") or 0
                return Reply(d["choices"][0]["message"]["content"] or "", use.get("prompt_tokens", 0), use.get("completion_tokens", 0), cached)
            except OSError:
                if attempt == self.retries:
                    raise
                time.sleep(2**attempt)
        raise AssertionError


class LocalModel:
    """A causal language model and tokenizer in this process, with the interface of the transformers library."""

    def __init__(self, network, tokenizer, thinking: bool = False):
        self.network, self.tokenizer, self.thinking = network, tokenizer, thinking
        self.model = getattr(getattr(network, "config", None), "_name_or_path", "local")

    def prompt(self, messages: list[Message]) -> str:
        """The chat template's text; templates without a switch for thinking are called without it."""
        ask = self.tokenizer.apply_chat_template
        try:
            return ask(list(messages), tokenize=False, add_generation_prompt=True, enable_thinking=self.thinking)
        except TypeError:
            return ask(list(messages), tokenize=False, add_generation_prompt=True)

    def generate(self, messages, temperature=0.01, max_tokens=4096, stop=None) -> Reply:
        given = self.tokenizer(self.prompt(messages), return_tensors="pt", add_special_tokens=False)
        end = getattr(self.tokenizer, "pad_token_id", None) or getattr(self.tokenizer, "eos_token_id", None)
        out = self.network.generate(**given, do_sample=temperature > 0, temperature=max(temperature, 1e-5), max_new_tokens=max_tokens, pad_token_id=end)
        n = len(given["input_ids"][0])
        made = out[0][n:]
        text = self.tokenizer.decode(made, skip_special_tokens=True)
        ends = [text.find(s) + len(s) for s in stop or [] if s in text]
        return Reply(text[: min(ends)] if ends else text, n, len(made))


@dataclass
class Turn:
    """A model's turn: its plan, and an expansion (prefix, operators) or an answer."""

    plan: str = ""
    prefix: str = ""
    expand: str | None = None
    answer: str | None = None
    error: str | None = None


def _block(text: str, tag: str) -> str | None:
    """The last block of a tag; one that isn't closed goes to the next tag or the end."""
    found = re.findall(rf"<{tag}>(.*?)</{tag}>", text, re.S)
    if found:
        return found[-1].strip()
    m = re.search(rf"<{tag}>(.*?)(?=<(?:plan|prefix|expand|answer)>|\Z)", text, re.S)
    return m[1].strip() if m else None


def parse_turn(text: str) -> Turn:
    """Reads <plan>, <prefix>, <expand> and <answer>; an answer wins over an expansion; thoughts are dropped."""
    text = re.sub(r"<think>.*?(?:</think>|\Z)", "", text, flags=re.S) if "<think>" in text else text.rpartition("</think>")[2]
    turn = Turn(_block(text, "plan") or "", _block(text, "prefix") or "", _block(text, "expand"), _block(text, "answer"))
    if turn.expand is not None and "<ops>" in turn.expand:
        # The form in which an expansion holds where it starts and its operators.
        turn.prefix, turn.expand = _block(turn.expand, "from") or turn.prefix, _block(turn.expand, "ops") or ""
    if turn.answer is not None:
        turn.expand = None
        if not turn.answer:
            turn.error = "EmptyAnswer: the answer holds no operators"
    elif turn.expand is None:
        turn.error = "MissingAction: neither <expand> nor <answer> was found"
    return turn


def system_prompt(categories: list[str] | None = None) -> str:
    return f"""You turn source tables into a target table with a fixed set of operators.
Each turn, write <plan>what to do next</plan> and then either
<prefix>operators that lead to the state to go on from, or its node id; empty for the sources</prefix>
<expand>one operator call a line</expand>
or, when the target is reached,
<answer>the whole pipeline from the sources, one operator call a line, ending in Terminate([table])</answer>

Operators:

{operator_manual(categories)}"""


@dataclass
class Step:
    """One turn of a trajectory."""

    reply: str
    turn: Turn
    feedback: str = ""
    node: str = ""
    #: Whether the turn went on from another state than the one before had reached.
    moved: bool = False


@dataclass
class SolveResult:
    """What a solver returns for a task."""

    task_id: str
    table: object = None
    pipeline: list[str] = field(default_factory=list)
    completed: bool = False
    error: str | None = None
    steps: list[Step] = field(default_factory=list)
    prompt_tokens: int = 0
    completion_tokens: int = 0
    cached_tokens: int = 0
    backtracks: int = 0
    wall_time_s: float = 0.0

    @property
    def turns(self) -> int:
        return len(self.steps)
