"""Causal language models in the Python workers; the optional model packages are imported there.

A worker keeps the model it loaded for the tasks it runs later, so a model is loaded once per worker, not per task, depth and retry.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache
from typing import Any


class Model:
    """A tokenizer and the model it belongs to."""

    def __init__(self, model_id: str, revision: str | None, half: bool) -> None:
        try:
            import torch
            import transformers
        except ImportError as problem:
            raise RuntimeError("local models need the optional packages 'transformers' and 'torch'") from problem
        kind = {"torch_dtype": torch.bfloat16} if half else {}
        self.model = transformers.AutoModelForCausalLM.from_pretrained(model_id, revision=revision, device_map="auto", **kind)
        self.tokenizer = transformers.AutoTokenizer.from_pretrained(model_id, revision=revision)

    def as_chat(self, prompt: str) -> str:
        """The prompt as the only turn of a chat, where the model knows chats."""
        if not getattr(self.tokenizer, "chat_template", None):
            return prompt
        return self.tokenizer.apply_chat_template([{"role": "user", "content": prompt}], tokenize=False, add_generation_prompt=True)

    def text(self, ids: Any, start: int) -> str:
        return self.tokenizer.decode(ids[start:], skip_special_tokens=True)

    def answer(self, prompt: str, settings: dict[str, Any], most_lines: int | None = None) -> str:
        """What follows the prompt; with ``most_lines`` the model is halted at so many line breaks."""
        given = self.tokenizer(prompt, return_tensors="pt").to(self.model.device)
        start = given["input_ids"].shape[-1]
        halt = {} if most_lines is None else {"stopping_criteria": [lambda ids, scores, **_: self.text(ids[0], start).count("\n") >= most_lines]}
        return self.text(self.model.generate(**given, **settings, **halt)[0], start).strip()


@lru_cache(maxsize=2)  # a worker's generator and judge
def loaded(model_id: str, revision: str | None, half: bool) -> Model:
    return Model(model_id, revision, half)


@dataclass(frozen=True)
class LocalGenerator:
    model_id: str
    revision: str | None = None
    settings: dict[str, Any] = field(default_factory=dict)
    max_units: int = 2

    def __call__(self) -> Callable[[dict], str]:
        model = loaded(self.model_id, self.revision, True)
        return lambda row: model.answer(model.as_chat(row["context"]), self.settings, self.max_units)


@dataclass(frozen=True)
class LocalJudge:
    model_id: str
    revision: str | None
    settings: dict[str, Any]
    template: str
    version: str = ""

    def __call__(self) -> Callable[[dict], str]:
        model = loaded(self.model_id, self.revision, False)
        return lambda row: model.answer(self.template.format(prompt_version=self.version, question=row["question"], context=row["context"], reasoning_units=row["listed"]), self.settings)
