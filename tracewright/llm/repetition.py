"""Repeated content inside single documents, by line-first cleaning.

Every line is judged by rules of its own: ``punctuation`` (hardly a letter or digit), ``navigation`` (a short menu line),
``boilerplate`` (stock phrases of web pages and exports) and ``repetition`` (words in a second or later occurrence of a run of
words of the document). Failing lines are removed: whole lines by the first three rules, by the last one the repeated words. A
document that loses too much text is rejected. The share of repeated words is reported by itself, over all words.

One pass, no shuffle; time and memory are linear in a document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.words import LIST_NUMBER, WORD, line_words, plain

RUN = 4
OTHER_BREAKS = re.compile("[\r\x0b\x0c\x1c-\x1e\x85  ]+")
NAVIGATION = re.compile(r"(?m)^[^\w\n]*(?:home|menu|back|next|previous|top|login|log in|sign (?:in|up)|search|share|print|contact|about us|more|read more|page \d+(?: of \d+)?)(?: *[|>»/·•-]+ *[\w ]{1,20})*[^\w\n]*$")
BOILERPLATE = re.compile(r"(?m)^.*(?:all rights reserved|terms of (?:use|service)|privacy policy|accepts? (?:all )?cookies|subscribe to our|click here to|enable javascript|this (?:page|file) was generated).*$")
PUNCTUATION = re.compile(r"(?m)^[^\S\n]*(?:[^\w\s]|_)(?:[^\w\n]|_)*$")
RULES = {"punctuation": PUNCTUATION, "navigation": NAVIGATION, "boilerplate": BOILERPLATE}
SCHEMA = "n_words long, repeated_words long, repeated_share double, lost_words long, lost_share double, n_lines long, punctuation_lines long, navigation_lines long, boilerplate_lines long, repetition_lines long"


def repeated_mask(tokens: list[str], run: int = RUN) -> np.ndarray:
    """True for each word in a second or later occurrence of a run of ``run`` words."""
    n = len(tokens)
    mask = np.zeros(n, dtype=bool)
    if n < run + 1:
        return mask
    if n < 5000:
        grams = list(zip(*(tokens[k:] for k in range(run))))
        if len(set(grams)) == len(grams):
            return mask
        seen: set[tuple[str, ...]] = set()
        for i, gram in enumerate(grams):
            if gram in seen:
                mask[i : i + run] = True
            else:
                seen.add(gram)
        return mask
    ids = np.unique(np.asarray(tokens, dtype=object), return_inverse=True)[1].astype(np.int64)
    key = ids[: n - run + 1]
    for k in range(1, run):  # pairs of ids are numbered anew, so keys never overflow
        key = np.unique(key * (ids.max() + 1) + ids[k : n - run + 1 + k], return_inverse=True)[1].astype(np.int64)
    first = np.unique(key, return_index=True)[1]
    again = np.ones(len(key), dtype=bool)
    again[first] = False
    for k in range(run):
        mask[k : n - run + 1 + k] |= again
    return mask


def line_rule(line: str) -> str | None:
    return next((name for name, rule in RULES.items() if rule.search(line)), None)


def measure(text: str | None, run: int = RUN) -> tuple:
    if not text or text.isspace():
        return (0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 0)
    text = OTHER_BREAKS.sub("\n", plain(text))
    tokens = WORD.findall(LIST_NUMBER.sub(" ", text))
    n = len(tokens)
    mask = repeated_mask(tokens, run)
    if not mask.any() and not any(rule.search(text) for rule in RULES.values()):
        return (n, 0, 0.0, 0, 0.0, sum(1 for x in text.split("\n") if x and not x.isspace()), 0, 0, 0, 0)
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    lost, at, failed = 0, 0, dict.fromkeys([*RULES, "repetition"], 0)
    for line in lines:
        size = len(WORD.findall(LIST_NUMBER.sub(" ", line)))
        rule, again = line_rule(line), int(mask[at : at + size].sum())
        at += size
        lost += size if rule else again
        if rule or again:
            failed[rule or "repetition"] += 1
    repeated = int(mask.sum())
    return (n, repeated, repeated / n if n else 0.0, lost, lost / n if n else 0.0, len(lines), *failed.values())


def repetition(documents: DataFrame, key: str, text: str, run: int = RUN, reject_above: float = 0.35) -> DataFrame:
    """Per document the words, repeated words, their share, what line-first cleaning removes, and the verdict.

    A null or empty text has no words, share 0 and isn't rejected. Case, punctuation, line breaks and list numbers at the start of
    a line don't count. Repeated keys give a row each; other columns are ignored. ``rejected`` says whether cleaning loses more
    than ``reject_above`` of the words."""
    kind = documents.schema[key].dataType.simpleString()

    def run_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for batch in batches:
            out = pd.DataFrame([measure(t, run) for t in batch["t"]], columns=names)
            out.insert(0, "k", batch["k"].to_numpy())
            yield out

    measured = documents.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run_batches, f"k {kind}, {SCHEMA}")
    return measured.withColumn("rejected", F.col("lost_share") > reject_above).withColumnRenamed("k", key)


def cleaned(text: str, run: int = RUN) -> str:
    """What line-first cleaning leaves of one text: failing lines go; of a line with repeats only its fresh words stay."""
    lines = [x for x in OTHER_BREAKS.sub("\n", text).split("\n") if x and not x.isspace()]
    per_line = [line_words(x) for x in lines]
    mask = repeated_mask([w for ws in per_line for w in ws], run)
    out, at = [], 0
    for line, ws in zip(lines, per_line):
        again = mask[at : at + len(ws)]
        at += len(ws)
        if line_rule(plain(line)) or (len(ws) and again.all()):
            continue
        out.append(line if not again.any() else " ".join(w for w, r in zip(ws, again) if not r))
    return "\n".join(out)
