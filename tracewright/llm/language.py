"""Language of texts and of stretches of mixed texts: a linear-chain conditional random field over words.

Features of a word are hashed: the word, its prefixes and suffixes of up to three letters, its character trigrams, its script, and
whether the lexicon of a language (words common in that language's training texts) has it. Two learned transition matrices tell
moving on inside a sentence from moving on to the next one; some sentences are learned cut and joined to others, so a label can also
change inside one. Marginals come from forward-backward, run over many texts at once, and label every word; stretches follow the labels
of the words, also inside sentences. A text of whose words the field has seen hardly any is in no language it knows: ``other``.

The model is fitted on the driver on a bounded sample of labelled texts (``per_language`` texts, ``SAMPLE_WORDS`` words of each);
labels in the sample may be wrong: sentences that the words of all other texts put under another label leave the sample first. Everything else covers
every word of every text, without a shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewright.llm.words import plain

LANGUAGES = ["en", "de", "fr", "es", "pt", "nl", "ru"]
#: Spellings that name a language; regions behind ``-`` or ``_`` are dropped first.
SPELLINGS = {
    "en": ["en", "eng", "english", "englisch", "anglais", "inglés"],
    "de": ["de", "deu", "ger", "german", "deutsch", "allemand", "alemán"],
    "fr": ["fr", "fra", "fre", "french", "français", "francais", "französisch"],
    "es": ["es", "spa", "spanish", "español", "espanol", "castellano", "spanisch"],
    "pt": ["pt", "por", "portuguese", "português", "portugues"],
    "nl": ["nl", "nld", "dut", "dutch", "nederlands"],
    "ru": ["ru", "rus", "russian", "русский"],
}
#: Labels that name no language.
NO_LABEL = ["", "unknown", "und", "undetermined", "none", "null", "nan", "n/a", "na", "other", "mixed", "mul", "mis", "zxx", "xx", "xxx"]
BUCKETS = 1 << 17
SAMPLE_WORDS = 128
LENGTH = 32
TOKEN = re.compile(r"<[^<>\n]{1,60}>|&#?\w{1,10};|([^\W\d_]+(?:['’\-‐­​-‍⁠﻿]+[^\W\d_]+)*)|([.!?…]+(?=\W|$)|\n)")
#: A sentence speaks for a language from so many words on, with so much more evidence for it than for the text's main language.
LEAST_WORDS, LEAST_MARGIN, LEAST_CONFIDENCE = 3, 8.0, 0.9
#: All its sentences together must have so much; one clear sentence of five or more words has.
LEAST_PROOF = 45.0
#: A text of so many words is in a language of none of the labels if no larger share of its words, counted once, was seen in fitting.
OTHER, OTHER_WORDS, OTHER_SEEN = "other", 8, 0.3
#: Share of the sentences that are joined, each cut somewhere, to one of another language.
SWITCHED = 0.15


def normal_label(label: Column) -> Column:
    """The code of the seven a label names, ``''`` where it names no language, else the label itself in lower case."""
    bare = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    first = F.regexp_extract(bare, r"^(\p{L}*)", 1)
    code = F.coalesce(*[F.when(first.isin(names), F.lit(k)) for k, names in SPELLINGS.items()])
    return F.when(bare.isin(NO_LABEL) | ~bare.rlike(r"\p{L}"), "").otherwise(F.coalesce(code, bare))


def features(word: str, lexicon: dict[str, tuple[int, ...]]) -> list[int]:
    own = f"^{word}$"
    names = {f"w{word}", *(f"p{word[:k]}" for k in (1, 2, 3)), *(f"s{word[-k:]}" for k in (1, 2, 3)), *(f"g{own[i : i + 3]}" for i in range(len(own) - 2))}
    names.add("c" if "Ѐ" <= word[0] <= "ӿ" else "l" if word[0] < "ɐ" else "o")
    names.update(f"L{k}" for k in lexicon.get(word, ()))
    return [zlib.crc32(x.encode()) % BUCKETS for x in names]


def tokens(text: str) -> tuple[list[str], list[bool]]:
    """Words as they are written, and whether each begins a sentence. Figures and markup are no words; a line break ends a sentence only
    before a capital letter."""
    out, begins, fresh, wrapped = [], [], True, False
    for word, other in TOKEN.findall(text):
        if word:
            out.append(word)
            begins.append(fresh or (wrapped and word[0].isupper()))
            fresh = wrapped = False
        elif other == "\n":
            wrapped = True
        elif other:
            fresh = True
    return out, begins


def places(text: str) -> list[tuple[int, int]]:
    """Where each word of ``tokens`` stands."""
    return [m.span() for m in TOKEN.finditer(text) if m.lastindex == 1]


@dataclass
class Field:
    """A fitted field: emission weights by feature, transitions inside and between sentences, lexicon."""

    labels: list[str]
    weights: np.ndarray
    inside: np.ndarray
    between: np.ndarray
    lexicon: dict[str, tuple[int, ...]]
    seen: frozenset[str] = frozenset()

    def emission(self, word: str) -> np.ndarray:
        return self.weights[features(word, self.lexicon)].sum(0) if word else np.zeros(len(self.labels), np.float32)


def _padded(lists: list[list[int]], fill: int) -> np.ndarray:
    out = np.full((len(lists), max(map(len, lists), default=1)), fill, dtype=np.int64)
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


def forward_backward(emissions: np.ndarray, begins: np.ndarray, inside: np.ndarray, between: np.ndarray, lengths: np.ndarray, pairs: bool = False):
    """Marginals (texts, words, labels) for padded texts; with ``pairs`` also the expected transitions inside and between."""
    n, t, k = emissions.shape
    e = np.exp(emissions - emissions.max(2, keepdims=True))
    step_in, step_out = np.exp(inside), np.exp(between)
    live = np.arange(t)[None, :] < lengths[:, None]
    e[~live] = 1.0
    alpha, beta = np.empty((n, t, k)), np.ones((n, t, k))
    a = e[:, 0] / e[:, 0].sum(1, keepdims=True)
    alpha[:, 0] = a
    for i in range(1, t):
        a = np.where(begins[:, i, None], a @ step_out, a @ step_in) * e[:, i]
        a /= a.sum(1, keepdims=True)
        alpha[:, i] = a
    b = np.ones((n, k))
    for i in range(t - 2, -1, -1):
        x = b * e[:, i + 1]
        x = np.where(begins[:, i + 1, None], x @ step_out.T, x @ step_in.T)
        b = np.where(live[:, i + 1, None], x / x.sum(1, keepdims=True), 1.0)
        beta[:, i] = b
    gamma = alpha * beta
    gamma /= gamma.sum(2, keepdims=True)
    if not pairs:
        return gamma
    totals = []
    for matrix, where in ((step_in, ~begins[:, 1:]), (step_out, begins[:, 1:])):
        use = where & live[:, 1:]
        left, right = alpha[:, :-1][use], (beta[:, 1:] * e[:, 1:])[use]
        whole = ((left @ matrix) * right).sum(1, keepdims=True)  # what the transitions of a place sum to
        totals.append(matrix * ((left / whole).T @ right))
    return gamma, totals


def fit(samples: Iterable[tuple[str, str]], labels: list[str] | None = None, rounds: int = 20, seed: int = 7) -> Field:
    """A field from labelled texts. Sentences of different labels are also strung together, so that transitions are learned."""
    rng = np.random.default_rng(seed)
    labels = labels or LANGUAGES
    texts = []
    for text, label in samples:
        if label in labels:
            ws, begins = tokens(text)
            if ws:
                texts.append(([plain(w) for w in ws[:SAMPLE_WORDS]], begins[:SAMPLE_WORDS], labels.index(label)))
    return _fit(_agreeing(texts, len(labels)), labels, rounds, rng)


def _agreeing(texts: list, k: int) -> list:
    """The texts without the sentences that word counts of all the other texts put under another label."""
    counts: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(k))
    total = np.ones(k)
    for ws, _, y in texts:
        for w in set(ws):
            counts[w][y] += 1
            total[y] += 1
    out = []
    for ws, begins, y in texts:
        own, one = set(ws), np.eye(k)[y]
        proof = {w: np.log((counts[w] - one + 0.1) / (total - one * len(own) + 100)) for w in own}
        at = [i for i, b in enumerate(begins) if b] + [len(ws)]
        kept = [ws[i:j] for i, j in zip(at, at[1:]) if j - i >= LEAST_WORDS and int(np.sum([proof[w] for w in ws[i:j]], axis=0).argmax()) == y]
        if kept:
            out.append(([w for s in kept for w in s], [i == 0 for s in kept for i in range(len(s))], y))
    return out


def _fit(texts: list, labels: list[str], rounds: int, rng: np.random.Generator) -> Field:
    k = len(labels)
    seen: dict[str, Counter] = defaultdict(Counter)
    for ws, _, y in texts:
        for w in set(ws):
            seen[w][y] += 1
    size = Counter(y for _, _, y in texts)
    lexicon = {}
    for w, c in seen.items():
        rate = {y: n / size[y] for y, n in c.items() if n >= 2}
        if rate and (own := tuple(sorted(y for y, r in rate.items() if r >= 0.3 * max(rate.values())))) and len(own) <= 3:
            lexicon[w] = own
    sentences: list[tuple[list[str], int]] = []
    for ws, begins, y in texts:
        at = [i for i, b in enumerate(begins) if b] + [len(ws)]
        sentences += [(ws[i:j], y) for i, j in zip(at, at[1:])]
    order = rng.permutation(len(sentences)) if sentences else []
    sequences: list[tuple[list[str], list[bool], list[int]]] = []
    whole = [([w for w in ws], list(b), [y] * len(ws)) for ws, b, y in texts]
    mixed: tuple[list, list, list] = ([], [], [])
    for i in order:  # strung together in random order: half the labels change at sentence ends
        ws, y = sentences[i]
        mixed[0].extend(ws), mixed[1].extend([True] + [False] * (len(ws) - 1)), mixed[2].extend([y] * len(ws))
    for i, j in zip(order[: int(len(order) * SWITCHED)], order[::-1]):
        (a, x), (b, y) = sentences[i], sentences[j]
        a, b = a[: len(a) - len(a) // 3], b[len(b) // 3 :]
        mixed[0].extend(a + b), mixed[1].extend([True] + [False] * (len(a) + len(b) - 1)), mixed[2].extend([x] * len(a) + [y] * len(b))
    for ws, b, y in [*whole, mixed]:
        sequences += [(ws[i : i + LENGTH], b[i : i + LENGTH], y[i : i + LENGTH]) for i in range(0, len(ws), LENGTH)]
    words = {w: i for i, w in enumerate(sorted(seen))}
    index = _padded([features(w, lexicon) for w in words], BUCKETS)
    used, index = np.unique(index, return_inverse=True)
    index = index.reshape(len(words), -1) if words else np.zeros((0, 1), np.int64)
    weights = np.zeros((len(used), k))
    pad = int(np.searchsorted(used, BUCKETS)) if len(used) and used[-1] == BUCKETS else -1
    inside, between = np.eye(k) * 2.0, np.eye(k) * 0.5
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (weights, inside, between)]
    if sequences:
        ids = _padded([[words[w] for w in s[0]] for s in sequences], 0)
        begins = _padded([list(map(int, s[1])) for s in sequences], 0).astype(bool)
        truth = _padded([s[2] for s in sequences], 0)
        lengths = np.array([len(s[0]) for s in sequences])
        live = np.arange(ids.shape[1])[None, :] < lengths[:, None]
        onehot = np.eye(k)[truth] * live[:, :, None]
        both = live[:, 1:]
        seen_in, seen_out = np.zeros((k, k)), np.zeros((k, k))
        for target, where in ((seen_in, ~begins[:, 1:] & both), (seen_out, begins[:, 1:] & both)):
            np.add.at(target, (truth[:, :-1][where], truth[:, 1:][where]), 1.0)
    for step in range(1, rounds + 1 if sequences else 0):
        per_word = weights[index].sum(1)
        gamma, (got_in, got_out) = forward_backward(per_word[ids], begins, inside, between, lengths, pairs=True)
        diff = (onehot - gamma * live[:, :, None]).reshape(-1, k)
        by_word = np.stack([np.bincount(ids.ravel(), diff[:, y], len(words)) for y in range(k)], 1)
        grad = np.stack([np.bincount(index.ravel(), np.repeat(by_word[:, y], index.shape[1]), len(used)) for y in range(k)], 1)
        total = live.sum()
        grads = [grad / total - 1e-6 * weights, (seen_in - got_in) / total - 1e-5 * inside, (seen_out - got_out) / total - 1e-5 * between]
        for p, g, (m, v) in zip((weights, inside, between), grads, state):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        if pad >= 0:
            weights[pad] = 0
    full = np.zeros((BUCKETS, k), np.float32)
    real = used < BUCKETS
    full[used[real]] = weights[real]
    return Field(labels, full, inside, between, lexicon, frozenset(seen))


class Tagger:
    """Applies a field to texts. Each written form of a word is scored once and keeps a row in a table for the life of a task, up to a
    bound, at which the table begins anew."""

    def __init__(self, field: Field, keep: int = 200_000) -> None:
        self.field, self.keep = field, keep
        self.rows: dict[str, int] = {}
        self.table = np.zeros((1024, len(field.labels) + 1))

    def _row(self, word: str) -> int:
        at = self.rows[word] = len(self.rows)
        if at >= len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        bare = plain(word)
        self.table[at, :-1], self.table[at, -1] = self.field.emission(bare), bare in self.field.seen
        return at

    def ids(self, words: list[str]) -> list[int]:
        rows, new = self.rows, self._row
        return [rows[w] if w in rows else new(w) for w in words]

    def scores(self, words: list[str]) -> np.ndarray:
        """A row per word: its score under each label, and whether fitting saw it. Good until more words are scored."""
        if len(self.rows) > self.keep:
            self.rows.clear()
        ids = self.ids(words)
        return self.table[ids]

    def total(self, words: list[str]) -> np.ndarray:
        return self.scores(words)[:, :-1].sum(0)

    def groups(self, texts: list[str], cells: int = 60_000) -> Iterator[tuple]:
        """Texts of like length together: their numbers, words, and padded emissions, sentence beginnings and lengths."""
        parsed = [tokens(t) for t in texts]
        order = sorted((i for i in range(len(texts)) if parsed[i][0]), key=lambda i: len(parsed[i][0]))
        k, at = len(self.field.labels), 0
        while at < len(order):
            group: list[int] = []
            while at < len(order) and (not group or (len(group) + 1) * len(parsed[order[at]][0]) <= cells):
                group.append(order[at])
                at += 1
            lengths = np.array([len(parsed[i][0]) for i in group])
            scored, begins = np.zeros((len(group), int(lengths.max()), k + 1)), np.zeros((len(group), int(lengths.max())), bool)
            for row, i in enumerate(group):
                scored[row, : lengths[row]] = self.scores(parsed[i][0])
                begins[row, : lengths[row]] = parsed[i][1]
            yield group, [parsed[i][0] for i in group], scored, begins, lengths

    def texts(self, texts: list[str], stretches: bool = True) -> list[tuple[list, list]]:
        """Languages and stretches of each text, as ``describe`` gives them; without stretches unless asked for."""
        f = self.field
        out: list[tuple[list, list]] = [([], []) for _ in texts]
        for group, written, scored, begins, lengths in self.groups(texts):
            emissions = scored[:, :, :-1]
            gamma = forward_backward(emissions, begins, f.inside, f.between, lengths)
            for row, i in enumerate(group):
                n = int(lengths[row])
                starts = np.flatnonzero(begins[row, :n])
                sums, proof = np.add.reduceat(gamma[row, :n], starts), np.add.reduceat(emissions[row, :n], starts)
                found = []
                for a, b, p, q in zip(starts, [*starts[1:], n], sums, proof):
                    y = int(q.argmax())
                    found.append((int(a), int(b), y, float(p[y] / (b - a)), q))
                unknown = f.seen and n >= OTHER_WORDS and self._unknown(written[row], scored[row, :n, -1])
                main, sure = judged(found, len(f.labels))
                if unknown:
                    out[i] = ([(OTHER, unknown, n)], [(*_span(places(texts[i]), 0, n), OTHER, unknown, n)] if stretches else [])
                elif not stretches:
                    out[i] = (languages(found, main, sure, f.labels), [])
                else:
                    cut = by_words(found, main, sure, gamma[row, :n], emissions[row, :n])
                    at = places(texts[i])
                    out[i] = (languages(found, main, sure, f.labels), [(*_span(at, a, b), f.labels[y], float(gamma[row, a:b, y].mean()), b - a) for a, b, y in cut])
        return out

    @staticmethod
    def _unknown(written: list[str], seen: np.ndarray) -> float:
        """How sure it is that the words are of no language that was fitted; 0 if they may be of one. Repeated words count once."""
        first = {w.casefold(): s for w, s in zip(written, seen)}
        share = sum(first.values()) / len(first)
        return float(1 - share) if share <= OTHER_SEEN else 0.0


def _span(at: list[tuple[int, int]], a: int, b: int) -> tuple[int, int]:
    return at[a][0], at[b - 1][1]


SEGMENTS = "languages array<struct<lang:string,confidence:double,n_words:int>>, segments array<struct<start:int,end:int,lang:string,confidence:double,n_words:int>>"


def judged(sentences: list[tuple], k: int) -> tuple[int, list[bool]]:
    """The main language of a text, and which of its sentences (first word, end, label, confidence, evidence) speak for theirs: long and
    sure enough, with evidence against the main language, of which all sentences of a language together need more."""
    share, whole = np.zeros(k), np.sum([s[4] for s in sentences], axis=0)
    for a, b, y, c, _ in sentences:
        share[y] += (b - a) * c
    main = int(share.argmax()) if share.max() > 0 else int(whole.argmax())
    sure = [b - a >= LEAST_WORDS and c >= LEAST_CONFIDENCE and (y == main or q[y] - q[main] >= LEAST_MARGIN) for a, b, y, c, q in sentences]
    proof = np.zeros(k)
    for (_, _, y, _, q), ok in zip(sentences, sure):
        proof[y] += ok * (q[y] - q[main])
    return main, [ok and (s[2] == main or proof[s[2]] >= LEAST_PROOF) for s, ok in zip(sentences, sure)]


def _spoken(sentences: list[tuple], main: int, sure: list[bool]) -> list[int]:
    """The language of each sentence: an unsure one goes with the sure one before it, at the beginning with the first sure one."""
    first = next((s[2] for s, ok in zip(sentences, sure) if ok), main)
    out: list[int] = []
    for s, ok in zip(sentences, sure):
        out.append(s[2] if ok else out[-1] if out else first)
    return out


def languages(sentences: list[tuple], main: int, sure: list[bool], labels: list[str]) -> list[tuple[str, float, int]]:
    """Languages of whole sentences, the largest first, with mean confidence and words."""
    totals: dict[int, list[float]] = defaultdict(lambda: [0.0, 0])
    for y, (a, b, _, c, _) in zip(_spoken(sentences, main, sure), sentences):
        totals[y][0] += c * (b - a)
        totals[y][1] += b - a
    return [(labels[y], c / n, int(n)) for y, (c, n) in sorted(totals.items(), key=lambda x: -x[1][1])]


def by_words(sentences: list[tuple], main: int, sure: list[bool], gamma: np.ndarray, emissions: np.ndarray) -> list[tuple[int, int, int]]:
    """Stretches (first word, end, label) by the labels of the words.

    Inside a sentence another label than the sentence's counts if a run of ``LEAST_WORDS`` words is labelled so, with ``LEAST_MARGIN``
    evidence; shorter runs, as names and loan words are, don't. Between the labels that count the sentence is cut where that fits its
    words best, a cut costing ``LEAST_MARGIN``."""
    label = np.repeat(_spoken(sentences, main, sure), [b - a for a, b, *_ in sentences])
    best = gamma.argmax(1)
    own = emissions[np.arange(len(best)), best] - emissions[np.arange(len(best)), label]
    for a, b, *_ in sentences:
        if (best[a:b] == label[a]).all():
            continue
        edges = [a, *(np.flatnonzero(np.diff(best[a:b])) + a + 1), b]
        others = {int(best[x]) for x, y in zip(edges, edges[1:]) if y - x >= LEAST_WORDS and own[x:y].sum() >= LEAST_MARGIN}
        if others - {int(label[a])}:
            kept = sorted(others | {int(label[a])})
            label[a:b] = np.array(kept)[_cheapest(emissions[a:b, kept])]
    cuts = np.flatnonzero(np.diff(label, prepend=-1))
    return [(int(a), int(b), int(label[a])) for a, b in zip(cuts, [*cuts[1:], len(label)])]


def _cheapest(gains: np.ndarray) -> list[int]:
    """The label of each word that gains most, a change of label costing ``LEAST_MARGIN``."""
    total, back = gains[0].copy(), []
    for row in gains[1:]:
        top = int(total.argmax())
        moved = total < total[top] - LEAST_MARGIN
        back.append(np.where(moved, top, np.arange(len(row))))
        total = np.where(moved, total[top] - LEAST_MARGIN, total) + row
    path = [int(total.argmax())]
    for came in reversed(back):
        path.append(int(came[path[-1]]))
    return path[::-1]


def detect(documents: DataFrame, key: str, text: str, field: Field, *keep: str, stretches: bool = True) -> DataFrame:
    """Per row its ``languages`` (of whole sentences) and ``segments`` (by words; none unless ``stretches``). A null text, or one without a
    word, has none; repeated keys give a row each. A text in none of the field's languages has the language ``other``."""
    shared = documents.sparkSession.sparkContext.broadcast(field)
    columns = [F.col(key).alias("_k"), F.col(text).alias("_t"), *[F.col(c) for c in keep]]
    source = documents.select(*columns)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields if f.name != "_t")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tagger = Tagger(shared.value)
        for batch in batches:
            described = tagger.texts([t or "" for t in batch["_t"]], stretches)
            out = batch.drop(columns="_t")
            out["languages"] = [[dict(zip(("lang", "confidence", "n_words"), x)) for x in d[0]] for d in described]
            out["segments"] = [[dict(zip(("start", "end", "lang", "confidence", "n_words"), x)) for x in d[1]] for d in described]
            yield out

    return source.mapInPandas(run, f"{kinds}, {SEGMENTS}").withColumnRenamed("_k", key)


def labelled_sample(documents: DataFrame, key: str, text: str, label: Column, per_language: int = 200, languages: list[str] | None = None) -> list[tuple[str, str]]:
    """At most ``per_language`` different texts per label, by a hash of key and text: a bounded sample that doesn't depend on how rows are
    stored. Of a text ``12 * SAMPLE_WORDS`` characters are taken, from a place that the hash gives."""
    h = F.pmod(F.xxhash64(F.col(key), F.col(text)), F.lit(1 << 30))
    named = documents.select(F.col(text).alias("t"), label.alias("y"), h.alias("h")).where(F.col("y").isin(languages or LANGUAGES) & F.col("t").isNotNull())
    counts = {r["y"]: r["n"] for r in named.groupBy("y").agg(F.count("*").alias("n")).collect()}
    below = {y: int((1 << 30) * min(1.0, 1.5 * (per_language + 10) / n)) for y, n in counts.items()}
    if not below:
        return []
    near = F.coalesce(*[F.when(F.col("y") == y, F.lit(b)) for y, b in below.items()])
    part = F.substr("t", 1 + F.col("h") % F.greatest(F.lit(1), F.length("t") - 12 * SAMPLE_WORDS), F.lit(12 * SAMPLE_WORDS))
    some = named.where(F.col("h") <= near).select("y", "h", part.alias("t")).distinct()
    rank = F.row_number().over(Window.partitionBy("y").orderBy("h", "t"))  # over a little more than the sample
    return [(r["t"], r["y"]) for r in some.withColumn("r", rank).where(F.col("r") <= per_language).orderBy("y", "r").select("t", "y").collect()]


def fit_documents(documents: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 200) -> Field:
    return fit(labelled_sample(documents, key, text, normal_label(F.col(lang)), per_language))


def mislabelled(detected: DataFrame, key: str, lang: str) -> DataFrame:
    """One row per language of each text whose label is missing, names a language the text isn't in, or that has several.

    A text without words has no language and gives no row, nor does one in a language that the field doesn't know."""
    own = F.transform("languages", lambda x: x["lang"])
    label = normal_label(F.col(lang))
    wrong = (label == "") | ~F.array_contains(own, label) | (F.size(own) > 1)
    return detected.where(wrong).select(key, F.explode("languages").alias("l")).where(F.col("l.lang") != OTHER).select(key, F.col("l.lang").alias("lang"), F.col("l.confidence").alias("confidence"))
