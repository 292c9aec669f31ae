"""Keys under which differently written forms of one question meet.

A question is brought to words; known framing and synonyms are folded; a word that is rare in its language and one slip of the pen
(a letter left out, doubled, wrong, or two swapped) away from common words is read as each of those. Each reading's sentences, sorted,
give a key, so forms with their sentences moved share it. Figures, persons and things stay, in place: other facts give other keys.

A form written in a single sentence, without the points, and one with more than ``MOST_READINGS`` readings are compared instead, with
the forms that have the same words but for words that can be misread for each other. Such bags are small: all that differs is the order
of the sentences, the points and the slips; copies are compared once.

Two passes over the questions. The first counts words; only common words are collected and broadcast, and there are at most
``words per question / COMMON`` of them in a language, whatever the number of questions.
"""

from __future__ import annotations

import itertools
import json
import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.words import plain
from tracewright.runtime import checkpointed

#: A word is common from this share of a language's questions on, and in more than ``LEAST`` of them.
COMMON, LEAST = 0.002, 3
#: A form of more readings isn't keyed by each, but compared.
MOST_READINGS = 16
_WORD = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+(?:'[^\W\d_]+)*")
_SENTENCE = re.compile(r"[.!?¿¡:;\]\[]+(?=\D|$)")
#: Words put around a question, as they stand at its beginning or its end.
OPENINGS = ["exercise", "task", "question", "q", "problem", "word problem", "please solve", "please answer", "can you work this out", "can you solve this", "here is a problem", "here is a question", "solve this", "hello", "hi", "aufgabe", "frage", "exercice", "pregunta", "ejercicio"]
CLOSINGS = ["thanks", "thank you", "explain briefly", "show your work", "no calculator", "give only the number", "answer briefly", "step by step", "please", "danke", "merci", "gracias"]
SYNONYMS = {
    "what number of": "how many", "as well as": "and", "what's": "what is", "removes": "takes away", "remain": "are left", "altogether": "in total", "each": "every", "beside": "next to",
    "purchases": "buys", "there are": "we have", "this past": "last", "evenly": "equally",
}
_OPEN = sorted((x.split() for x in OPENINGS), key=len, reverse=True)
_CLOSE = sorted((x.split() for x in CLOSINGS), key=len, reverse=True)
_FOLD = {tuple(k.split()): v.split() for k, v in SYNONYMS.items()}
_LONGEST = max(map(len, _FOLD))
KNOWN = {w for x in [*OPENINGS, *CLOSINGS, *SYNONYMS, *SYNONYMS.values()] for w in x.split()}


def sentences(text: str) -> list[list[str]]:
    return [ws for part in _SENTENCE.split(plain(text)) if (ws := _WORD.findall(part))]


def unframed(parts: list[list[str]]) -> list[list[str]]:
    """Without framing at the beginning and the end, as often as it is there; a question that is nothing else stays."""
    out = [list(p) for p in parts]
    while True:
        before = sum(map(len, out))
        for frame in _OPEN:
            if out and out[0][: len(frame)] == frame and before > len(frame):
                out[0] = out[0][len(frame) :]
                break
        else:
            for frame in _CLOSE:
                if out and out[-1][-len(frame) :] == frame and before > len(frame):
                    out[-1] = out[-1][: -len(frame)]
                    break
        out = [p for p in out if p]
        if sum(map(len, out)) == before:
            return out


def folded(ws: list[str]) -> list[str]:
    out, i = [], 0
    while i < len(ws):
        for n in range(_LONGEST, 0, -1):
            if (to := _FOLD.get(tuple(ws[i : i + n]))) is not None and len(ws) - i >= n:
                out += to
                i += n
                break
        else:
            out.append(ws[i])
            i += 1
    return out


def one_slip(a: str, b: str) -> bool:
    """Equal but for one letter left out, put in, or replaced, or two neighbours swapped."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    if len(x) == len(y):
        return x[1:] == y[1:] or (len(x) > 1 and x[:2] == y[1::-1] and x[2:] == y[2:])
    return x[1:] == y or x == y[1:]


class Speller:
    """Common words of each language, found from a slip by what is left when one letter is deleted."""

    def __init__(self, common: dict[str, dict[str, int]]) -> None:
        self.common = common
        self.index: dict[str, dict[str, list[str]]] = {}
        for lang, known in common.items():
            index = self.index[lang] = defaultdict(list)
            for w in known:
                for v in self._shorter(w):
                    index[v].append(w)
        self._kept: dict[tuple[str, str], list[str]] = {}

    @staticmethod
    def _shorter(w: str) -> set[str]:
        return {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}

    def readings(self, lang: str, w: str) -> list[str]:
        known = self.common.get(lang, {})
        if w in known or w in KNOWN or w[0].isdigit() or len(w) < 3:
            return [w]
        key = (lang, w)
        if key not in self._kept:
            if len(self._kept) > 200_000:
                self._kept.clear()
            near = {v for s in self._shorter(w) for v in self.index.get(lang, {}).get(s, ()) if not v[0].isdigit() and one_slip(v, w)}
            self._kept[key] = sorted(near, key=lambda v: (-known[v], v)) or [w]
        return self._kept[key]


def classes(common: dict[str, int]) -> dict[str, str]:
    """For every common word the name of its class: words that one word can be read as are in one class, as two deletions bring them
    together. A word's class is the same whichever of its readings is taken."""
    root = {w: w for w in common}

    def find(w: str) -> str:
        while root[w] != w:
            root[w] = w = root[root[w]]
        return w

    met: dict[str, str] = {}
    for w in common:
        if w[0].isdigit() or len(w) < 2:
            continue
        once = Speller._shorter(w)
        for v in once.union(*(Speller._shorter(x) for x in once)):
            if v in met:
                a, b = sorted((find(w), find(met[v])))
                root[b] = a
            elif len(v) > 0:
                met[v] = w
    return {w: find(w) for w in common}


class Form:
    """A question as sentences of words, each with its readings."""

    def __init__(self, text: str, lang: str, speller: Speller) -> None:
        self.parts = [[speller.readings(lang, w) for w in p] for p in unframed(sentences(text))]
        self.count = 1
        for c in itertools.chain(*self.parts):
            self.count *= len(c)

        #: Each word as its most common reading, folded.
        self.plain = [folded([c[0] for c in p]) for p in self.parts]

    def keys(self) -> list[int]:
        """A key for each reading, whatever the order of the sentences; a form of too many readings has one, of the most common ones."""
        if not self.parts:
            return []
        if self.count == 1 or self.count > MOST_READINGS:
            return [_key(self.plain)]
        found: set[int] = set()
        for reading in itertools.product(*itertools.chain(*self.parts)):
            words = iter(reading)
            found.add(_key([folded(list(itertools.islice(words, len(p)))) for p in self.parts]))
        return sorted(found)

    def readings(self) -> list[list[list[str]]]:
        """The sentences with the readings of every word; a sentence whose phrases are folded has its most common reading only."""
        return [p if [c[0] for c in p] == bare else [[w] for w in bare] for p, bare in zip(self.parts, self.plain)]

    def written(self) -> str:
        """The readings as a text; words and sentences alone where there is one reading."""
        return json.dumps(self.readings(), ensure_ascii=False) if self.count > 1 else "\n".join(map(" ".join, self.plain))


def read(written: str) -> list[list[list[str]]]:
    return json.loads(written) if written.startswith("[[") else [[[w] for w in p.split(" ")] for p in written.split("\n")]


def _key(parts: list[list[str]]) -> int:
    return _hash(" ".join(sorted(map(" ".join, parts))))


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def _fits(a: list[list[str]], b: list[list[str]]) -> bool:
    return len(a) == len(b) and all(not set(x).isdisjoint(y) for x, y in zip(a, b))


def _laid(parts: list[list[list[str]]], line: list[list[str]], at: int = 0) -> bool:
    """Whether the sentences, each once and in some order, make up ``line`` from ``at`` on."""
    if not parts:
        return at == len(line)
    tried = []
    for i, p in enumerate(parts):
        if p not in tried and _fits(p, line[at : at + len(p)]):
            tried.append(p)
            if _laid(parts[:i] + parts[i + 1 :], line, at + len(p)):
                return True
    return False


def same(a: list[list[list[str]]], b: list[list[list[str]]]) -> bool:
    """Whether two forms have a reading in common: sentence by sentence in some order, or with one of them in a single sentence."""
    if len(a) == 1:
        return _laid(b, a[0])
    if len(b) == 1:
        return _laid(a, b[0])
    return _paired(a, b)


def _paired(a: list[list[list[str]]], b: list[list[list[str]]]) -> bool:
    if len(a) != len(b):
        return False
    if not a:
        return True
    tried = []
    for i, p in enumerate(b):
        if p not in tried and _fits(a[0], p):
            tried.append(p)
            if _paired(a[1:], b[:i] + b[i + 1 :]):
                return True
    return False


def question_keys(questions: DataFrame, key: str = "question_id", text: str = "question", lang: str = "lang") -> DataFrame:
    """``key, keys ARRAY<BIGINT>``: two rows ask the same if a chain of shared keys joins them.

    Null questions and questions without a word have no keys. A null language is a language of its own."""
    base = questions.select(F.col(key), F.col(text).alias("_t"), F.coalesce(F.col(lang), F.lit("")).alias("_l")).where(F.col(text).isNotNull())

    def distinct_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts: dict[tuple[str, str], int] = defaultdict(int)
            for t, lang_ in zip(batch["_t"], batch["_l"]):
                counts[lang_, ""] += 1
                for w in {w for p in sentences(t) for w in p}:
                    counts[lang_, w] += 1
            yield pd.DataFrame([(a, b, n) for (a, b), n in counts.items()], columns=["l", "w", "n"])

    counted = base.mapInPandas(distinct_words, "l string, w string, n long").groupBy("l", "w").agg(F.sum("n").alias("n"))
    sizes = counted.where("w = ''").select("l", F.col("n").alias("size"))
    common: dict[str, dict[str, int]] = defaultdict(dict)
    for r in counted.where("w <> ''").join(sizes, "l").where((F.col("n") > LEAST) & (F.col("n") > COMMON * F.col("size"))).select("l", "w", "n").collect():
        common[r["l"]][r["w"]] = r["n"]
    shared = questions.sparkSession.sparkContext.broadcast((dict(common), {lang_: classes(known) for lang_, known in common.items()}))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, class_of = shared.value
        speller = Speller(known)
        for batch in batches:
            rows = []
            for k, t, lang_ in zip(batch[key], batch["_t"], batch["_l"]):
                form = Form(t, lang_, speller)
                names = class_of.get(lang_, {})
                bag = " ".join(sorted(names.get(w, w) for p in form.plain for w in p))
                rows.append((k, form.keys(), _hash(lang_ + " " + bag), len(form.parts) == 1, form.count > MOST_READINGS, form.written()))
            yield pd.DataFrame(rows, columns=[key, "keys", "bag", "single", "many", "form"])

    kind = questions.schema[key].dataType.simpleString()
    made = checkpointed(base.mapInPandas(run, f"`{key}` {kind}, keys array<bigint>, bag long, single boolean, many boolean, form string").where(F.size("keys") > 0))
    return with_looked_at(made, key)


def with_looked_at(made: DataFrame, key: str) -> DataFrame:
    """Adds the keys that only a comparison finds, of forms of the same words: one in a single sentence has a key with the forms whose
    sentences it strings together, and one of too many readings with those that share one. Only different forms are compared."""
    open_ = made.groupBy("bag").agg(F.min("single").alias("a"), F.max("single").alias("b"), F.max("many").alias("many"), F.min("form").alias("x"), F.max("form").alias("y")).where("x <> y AND (many OR a <> b)").select("bag")
    forms = made.join(open_, "bag").select("bag", "form", F.col("keys")[0].alias("k")).distinct()

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        rows = [(k, read(f)) for f, k in sorted(zip(group["form"], group["k"]))]
        settled = [i for i, (_, f) in enumerate(rows) if len(f) > 1 and all(len(c) == 1 for p in f for c in p)]
        others = sorted(set(range(len(rows))) - set(settled))
        # forms of several sentences with one reading meet by their keys: what remains is every other form against all
        found = [(rows[i][0], rows[j][0]) for n, i in enumerate(others) for j in (*settled, *others[:n]) if same(rows[i][1], rows[j][1])]
        return pd.DataFrame([(min(p), max(p)) for p in found if p[0] != p[1]], columns=["x", "k"]).astype("int64")

    extra = forms.groupBy("bag").applyInPandas(compare, "x long, k long").groupBy("k").agg(F.collect_set("x").alias("more"))
    first = made.select(key, "keys", F.col("keys")[0].alias("k"))
    return first.join(extra, "k", "left").select(key, F.concat("keys", F.coalesce("more", F.array().cast("array<bigint>"))).alias("keys"))
