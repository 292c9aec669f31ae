"""Broken prompt and response pairs, each with one defect.

``empty``, ``refusal``, ``copies_question``, ``truncated`` and ``other_language``, the first that holds in this order. Copies are found by
aligning the tokens of response and question: shingles of five words (all words of a shorter response) locate the copied stretch
behind a short lead-in, 80 % of its shingles must stand in the question, and the longest common subsequence must cover 90 % of its
words. Refusals are aligned with refusal templates by longest common subsequence, at every word of the response. Cut-off responses come from the endings of
``truncation``, languages from the word scores of ``language``.

One pass over the pairs; only defective ones are shuffled. Facts about a question are kept while a task sees it again.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm import truncation
from tracewright.llm.language import Field, Tagger, tokens
from tracewright.llm.words import words

DEFECTS = ["empty", "refusal", "copies_question", "truncated", "other_language"]
SHINGLE, CONTAINED, COVERED, LEAD_IN = 5, 0.8, 0.9, 4
REFUSAL_ALIGNED = 0.8
LANGUAGE_MARGIN, LANGUAGE_MARGIN_PER_WORD, LANGUAGE_WORDS = 15.0, 2.5, 2
#: Questions from so many characters on aren't kept for the next pair.
LONG = 8000
#: What refusals are built around.
REFUSALS = [
    "I cannot help with that", "I can't help with this", "I can't provide a next step here", "I cannot provide an answer", "I won't be able to assist with this",
    "I am not able to continue this request", "I am not able to answer", "I'm unable to comply", "I am unable to help", "I must decline to solve this", "I have to decline this request",
    "it is not possible for me to answer this", "I cannot answer this question", "I can't assist with this request", "I'm not allowed to answer", "I will not answer this",
    "kann ich dabei nicht helfen", "kann ich nicht beantworten", "darf ich diese Frage nicht beantworten", "ist es mir nicht möglich hier fortzufahren", "ich kann dabei nicht helfen", "ich kann diese Frage nicht beantworten",
    "je ne peux pas répondre à cette demande", "je ne peux pas vous aider", "je ne suis pas en mesure d'aider avec cela", "il m'est impossible de continuer ici", "je ne suis pas autorisé à répondre",
    "no puedo ayudar con esta petición", "no puedo responder a esto", "no estoy autorizado a responder a esto", "no me es posible continuar aquí",
    "no puedo ayudarte con eso", "no puedo ayudarle con esto", "lo siento pero no puedo", "this falls outside what I do", "that is outside of what I can do", "I'm sorry but I can't", "I cannot comply with this request",
    "ich kann Ihnen dabei leider nicht helfen", "es tut mir leid aber ich kann nicht", "das kann ich leider nicht beantworten", "je suis désolé mais je ne peux pas", "je ne peux pas t'aider avec cela",
    "não posso ajudar com isso", "não posso responder a esta pergunta", "não estou autorizado a responder", "ik kan je hier niet mee helpen", "ik kan deze vraag niet beantwoorden", "ik mag deze vraag niet beantwoorden",
    "я не могу помочь с этим", "я не могу ответить на этот вопрос", "мне не разрешено отвечать на этот вопрос",
]
_TEMPLATES = [words(x) for x in REFUSALS]
#: Words of each template that an alignment needs.
_NEEDED = [math.ceil(REFUSAL_ALIGNED * len(t) - 1e-9) for t in _TEMPLATES]
#: For each word the templates that hold it and how often, one counter of a byte per template; what makes a counter with enough words 128.
_SHARED: dict[str, int] = {}
for _k, _t in enumerate(_TEMPLATES):
    for _w in _t:
        _SHARED[_w] = _SHARED.get(_w, 0) + (1 << 8 * _k)
_ENOUGH = sum((128 - n) << 8 * k for k, n in enumerate(_NEEDED))
_CONTINUE = re.compile(r"\s*\n\nContinue with the next useful reasoning step:\s*\Z")


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bit-parallel dynamic programming over the shorter list."""
    if len(a) > len(b):
        a, b = b, a
    where: dict[str, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        hit = row & where.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - bin(row).count("1")


def question_of(prompt: str) -> str:
    """The question of a prompt, with its context, without options and accepted steps."""
    text = _CONTINUE.sub("", prompt)
    text = text.removeprefix("Question:").lstrip("\n")
    head, found, _ = text.partition("\n\nOptions:\n")
    if found:
        return head
    *context, last = text.split("\n\n")
    lines = last.split("\n")
    asked = next((i for i, line in enumerate(lines) if "?" in line), 0)
    return "\n\n".join([*context, "\n".join(lines[: asked + 1])])


def refuses(got: list[str]) -> bool:
    """Whether a template is aligned to 80 % with a stretch of at most two words more, anywhere in ``got``.

    Only templates of which ``got`` holds enough words are aligned. A stretch may begin at its first aligned word, which is one of the
    first of the template, as few are missing."""
    held = _ENOUGH + sum(_SHARED.get(w, 0) for w in set(got))
    for k, (t, needed) in enumerate(zip(_TEMPLATES, _NEEDED)):
        if held >> 8 * k & 128:
            first = t[: len(t) - needed + 1]
            if any(got[i] in first and lcs(t, got[i : i + len(t) + 2]) >= needed for i in range(len(got) - needed + 1)):
                return True
    return False


def is_refusal(text: str) -> bool:
    return refuses(words(text))


class Question:
    def __init__(self, text: str, tagger: Tagger) -> None:
        self.tokens = words(text)
        scores = tagger.total(tokens(text)[0])
        self.language = int(scores.argmax())
        self._grams: dict[int, set] = {}

    def grams(self, n: int) -> set:
        if n not in self._grams:
            self._grams[n] = set(zip(*(self.tokens[k:] for k in range(n))))
        return self._grams[n]

    def copied(self, got: list[str]) -> bool:
        """Nothing in ``got`` but the question or sentences of it, behind a lead-in."""
        if not got:
            return False
        n = min(SHINGLE, len(got))
        hits = [g in self.grams(n) for g in zip(*(got[k:] for k in range(n)))]
        if True not in hits:
            if len(got) > 3 and len(got) <= SHINGLE + LEAD_IN:  # a short sentence behind a lead-in
                return any(tuple(got[k:]) in self.grams(len(got) - k) for k in range(1, min(LEAD_IN, len(got) - 3) + 1))
            return False
        first = hits.index(True)
        rest, hits = got[first:], hits[first:]
        if first > LEAD_IN or sum(hits) < CONTAINED * len(hits) or len(rest) < 3:
            return False
        return lcs(rest, self.tokens) >= COVERED * len(rest)


def text_defect(prompt: str | None, completion: str, tagger: Tagger, question) -> str | None:
    got = words(completion)
    if refuses(got):
        return "refusal"
    if not prompt:
        return None
    asked = question(question_of(prompt))
    if asked.tokens and asked.copied(got):
        return "copies_question"
    spoken = tokens(completion)[0]
    if asked.tokens and len(spoken) >= LANGUAGE_WORDS:
        scores = tagger.total(spoken)
        if scores.max() - scores[asked.language] >= max(LANGUAGE_MARGIN, LANGUAGE_MARGIN_PER_WORD * len(spoken)):
            return "other_language"
    return None


def defective_pairs(pairs: DataFrame, field: Field) -> DataFrame:
    """``pair_table, pair_id, defect`` of every defective pair, once per key.

    ``pairs`` has pair_table, pair_id, source, prompt and completion; other columns are ignored. A null or empty prompt can't be copied
    and has no language; its completion is still judged by itself. Rows that share a key must be the same pair."""
    shared = pairs.sparkSession.sparkContext.broadcast(field)
    empty = truncation.is_empty(F.col("completion"))
    key = pairs.schema["pair_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tagger = Tagger(shared.value)
        kept = lru_cache(maxsize=2048)(lambda text: Question(text, tagger))
        question = lambda text: kept(text) if len(text) < LONG else Question(text, tagger)  # noqa: E731  (what is kept stays small)
        for batch in batches:
            batch = batch.assign(defect=[text_defect(p, c, tagger, question) for p, c in zip(batch["prompt"], batch["completion"])])
            yield batch.loc[batch["defect"].notna(), ["pair_table", "pair_id", "defect"]]

    judged = pairs.where(~empty).select("pair_table", "pair_id", "prompt", "completion").mapInPandas(run, f"pair_table string, pair_id {key}, defect string")
    cut = truncation.truncated(pairs.select("pair_table", "pair_id", "source", F.col("pair_table").alias("field_name"), F.col("completion").alias("text")))
    every = (
        pairs.where(empty).select("pair_table", "pair_id", F.lit("empty").alias("defect"))
        .unionByName(judged)
        .unionByName(cut.select("pair_table", "pair_id", F.lit("truncated").alias("defect")))
    )
    rank = F.array_position(F.array(*[F.lit(d) for d in DEFECTS]), F.col("defect"))
    return every.groupBy("pair_table", "pair_id").agg(F.min_by("defect", rank).alias("defect"))
