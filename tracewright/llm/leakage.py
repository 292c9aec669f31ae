"""Evaluation passages inside a training corpus, by suffix arrays.

Every task builds suffix arrays over shards of its documents (whole documents, about ``SHARD_WORDS`` words) and looks up every suffix of
every evaluation item by binary search: the interval of suffixes that begin with the item's next words narrows word by word. That gives
all maximal verbatim matches with their places. A match of ``VERBATIM`` words is a leak. Shorter ones are anchors: a passage of
``FUZZY`` words or more with at most one word in five changed holds an anchor of four unchanged words, from which the passage is
aligned exactly. One of ``2 * FUZZY`` words or more can be cut into two of at least ``FUZZY``, and one of these has no more than one
word in five changed either; so whether there is a passage shows within ``WITHIN`` words. Words outside the evaluation items'
vocabulary can't match and are one symbol.

The corpus is read once and never shuffled. Evaluation items are broadcast in blocks of at most ``BLOCK_CHARACTERS`` characters, each a
pass of its own, so the size of a broadcast is bounded whatever the number of items.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.words import INVISIBLE
from tracewright.runtime import checkpointed

VERBATIM, FUZZY, CHANGED, ANCHOR = 12, 25, 0.2, 4
#: The longest passage that can't be cut into two passages.
WITHIN = 2 * FUZZY - 1
SHARD_WORDS, BLOCK_CHARACTERS = 200_000, 8_000_000
#: Places in the items times places in the shard that are looked at together.
PAIRS = 500_000
_TAG = re.compile(r"</?[A-Za-z][^<>]{0,200}>|<!--.*?-->")
_WRAP = re.compile(r"(\w)[-‐‑]\s*\n[ \t>]*(?=[^\W\d_])")
_LINE = re.compile(r"(?m)^[ \t>]*(?:[-*•+#]+|\(?\d{1,3}[.)])(?=[ \t])")
_MARK = re.compile("[̀-ͯ]")
_WORD = re.compile(r"[^\W_]+")
SCHEMA = "item_id long, verbatim_words int, passage_words int, changed_words int, document_word int, item_word int"


def passage_words(text: str) -> list[str]:
    """Words without case, punctuation, markup, list numbers, line wraps, hyphenation and forms of characters."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if not text.isascii():
        text = INVISIBLE.sub("", text)
        text = unicodedata.normalize("NFKD", text)
        text = _MARK.sub("", text)
    if "\n" in text:
        text = _LINE.sub(" ", _WRAP.sub(r"\1", text))
    else:
        text = _LINE.sub(" ", text)
    return _WORD.findall(text.casefold().replace("ß", "ss"))


class Items:
    """Evaluation items as one string of word numbers; 0 stands between them. Number 0 is also any word that no item has."""

    def __init__(self, items: list[tuple[int, str | None, str | None]]) -> None:
        self.numbers: dict[str, int] = {}
        string, owner = [0], [-1]
        self.ids = [i for i, _, _ in items]
        for k, (_, question, solution) in enumerate(items):
            for w in passage_words(question or "") + passage_words(solution or ""):
                string.append(self.numbers.setdefault(w, len(self.numbers) + 1))
                owner.append(k)
            string.append(0)
            owner.append(-1)
        self.string = np.array([*string, *[0] * ANCHOR], dtype=np.int32)
        self.owner = np.array([*owner, *[-1] * ANCHOR], dtype=np.int32)
        self.longest = int(np.bincount(self.owner[self.owner >= 0]).max()) if len(items) and (self.owner >= 0).any() else 1


def suffix_array(string: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of the suffixes that begin there, compared over ``depth`` symbols, by prefix doubling."""
    rank = np.unique(string, return_inverse=True)[1].astype(np.int64)
    span = 1
    while span < depth:
        behind = np.zeros_like(rank)
        behind[:-span] = rank[span:] + 1
        values, rank_new = np.unique(rank * (int(rank.max()) + 2) + behind, return_inverse=True)
        rank = rank_new.astype(np.int64)
        span *= 2
        if len(values) == len(rank):
            break
    return np.argsort(rank, kind="stable")


def _narrow(string: np.ndarray, order: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The part of each interval of the suffix array whose suffixes have ``symbol`` at ``depth``, by binary search."""
    last = len(string) - 1

    def bound(strict: bool) -> np.ndarray:
        a, b = low.copy(), high.copy()
        while True:
            open_ = a < b
            if not open_.any():
                return a
            mid = (a + b) >> 1
            at = string[np.minimum(order[np.minimum(mid, len(order) - 1)] + depth, last)]
            right = open_ & ((at <= symbol) if strict else (at < symbol))
            a = np.where(right, mid + 1, a)
            b = np.where(open_ & ~right, mid, b)

    return bound(False), bound(True)


def matches(string: np.ndarray, items: Items, whole: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All maximal verbatim matches of at least ``ANCHOR`` words: place in the shard, place in the items, length. Unless ``whole``, those
    under ``VERBATIM`` words are left out where no passage can lie around them."""
    order = suffix_array(string, min(items.longest, 1 << 14))
    query = np.flatnonzero((items.string[: len(items.string) - ANCHOR + 1] > 0) & (np.convolve(items.string > 0, np.ones(ANCHOR, int), "valid") == ANCHOR))
    low, high = np.zeros(len(query), np.int64), np.full(len(query), len(order), np.int64)
    for depth in range(ANCHOR):
        low, high = _narrow(string, order, low, high, depth, items.string[query + depth])
        some = low < high
        query, low, high = query[some], low[some], high[some]
    size = high - low
    found = [np.empty((3, 0), np.int64)]
    total = np.cumsum(size)
    edges = np.searchsorted(total, np.arange(0, total[-1], PAIRS)) if len(total) else []
    for a, b in zip(edges, [*edges[1:], len(size)]):  # a run of words that stands everywhere is met in bounded portions
        found.append(_expanded(string, order, items, query[a:b], low[a:b], size[a:b], whole))
    return tuple(np.concatenate(found, axis=1))


def _expanded(string: np.ndarray, order: np.ndarray, items: Items, query: np.ndarray, low: np.ndarray, size: np.ndarray, whole: bool) -> np.ndarray:
    """Maximal matches for intervals of the suffix array, grown word by word."""
    item = np.repeat(query, size)
    place = order[np.repeat(low - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())]
    before = np.where(place > 0, string[place - 1], 0)
    starts = (before == 0) | (before != items.string[item - 1])  # matches that can't be begun one word earlier
    item, place = item[starts], place[starts]
    length = np.full(len(item), ANCHOR, np.int64)
    grow = np.arange(len(item))
    while len(grow):
        x, y = place[grow] + length[grow], item[grow] + length[grow]
        ok = (x < len(string)) & (y < len(items.string))
        grow, x, y = grow[ok], x[ok], y[ok]
        grow = grow[(string[x] == items.string[y]) & (string[x] > 0)]
        length[grow] += 1
    keep = (length >= VERBATIM) | whole
    keep[~keep] = _may_hold(string, place[~keep], items, item[~keep], length[~keep])
    return np.stack([place[keep], item[keep], length[keep]])


def _edits(a: list[int], b: list[int]) -> list[int]:
    """For every number of leading words of ``a`` the fewest changes that turn them into some leading words of ``b``."""
    row, out = list(range(len(b) + 1)), [0]
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        best = i
        for j, y in enumerate(b, 1):
            above = row[j]
            if x == y and x:
                value = diagonal
            else:
                value = diagonal if diagonal < above else above
                if row[j - 1] < value:
                    value = row[j - 1]
                value += 1
            diagonal, row[j] = above, value
            if value < best:
                best = value
        out.append(best)
    return out


def aligned(string: np.ndarray, first: int, last: int, items: Items, place: int, item: int, length: int, reach: int = 3 * FUZZY) -> tuple[int, int] | None:
    """The longest passage around an anchor with at most one word in five changed, as words and changes; None under ``FUZZY`` words.

    ``first`` and ``last`` bound the document. Passages are followed for ``reach`` words to either side; a reach that the passage found
    comes near to is doubled, so it ends only with the passage or the item. To know whether there is one, ``WITHIN - ANCHOR`` are enough."""
    left = items.string[max(0, item - reach) : item][::-1]
    left = left[: int(np.argmax(left == 0)) if (left == 0).any() else len(left)]
    right = items.string[item + length : item + length + reach]
    right = right[: int(np.argmax(right == 0)) if (right == 0).any() else len(right)]
    more = int((len(left) + length + len(right)) * CHANGED)  # all changes may be words put in on one side
    before = _edits(left.tolist(), string[max(first, place - len(left) - more) : place][::-1].tolist())
    most = length + len(right)
    if not any(a + most >= FUZZY and x <= CHANGED * (a + most) for a, x in enumerate(before)):
        return None
    after = _edits(right.tolist(), string[place + length : min(last, place + length + len(right) + more)].tolist())
    x, y = np.array(before), np.array(after)
    words = np.arange(len(x))[:, None] + length + np.arange(len(y))
    changes = x[:, None] + y
    good = (words >= FUZZY) & (changes <= CHANGED * words)
    if not good.any():
        return None
    best = np.where(good, words * (len(x) + len(y) + 1) - changes, -1).argmax()
    a, b = np.unravel_index(best, words.shape)
    near = FUZZY * CHANGED
    if reach > WITHIN and ((len(left) == reach and a >= reach - near) or (len(right) == reach and b >= reach - near)):
        return aligned(string, first, last, items, place, item, length, 2 * reach)
    return int(words[a, b]), int(changes[a, b])


def _may_hold(string: np.ndarray, place: np.ndarray, items: Items, item: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether a passage can lie around an anchor: some ``FUZZY`` to ``WITHIN`` item words with it, of which at most one in five lacks.

    A word lacks if it stands nowhere in the document where it can have been moved by the changes of such a passage. Words that lack are
    no more than the changed ones, so no passage is lost."""
    reach, shift = WITHIN - ANCHOR, int(WITHIN * CHANGED)
    out = np.zeros(len(place), bool)
    steps = np.arange(1, reach + 1)
    for at in range(0, len(place), 4000):
        p, q, n = (z[at : at + 4000, None] for z in (place, item, length))

        def scores(in_items: np.ndarray, in_text: np.ndarray) -> np.ndarray:
            """For every number of words to one side, the words that stand there less four times those that lack."""
            x = items.string[np.clip(in_items, 0, len(items.string) - 1)]
            hit = np.zeros(x.shape, bool)
            for k in range(-shift, shift + 1):
                hit |= x == string[np.clip(in_text + k, 0, len(string) - 1)]
            each = np.where(x == 0, -10 * WITHIN, np.where(hit, 1, round(1 - 1 / CHANGED)))
            return np.concatenate([np.zeros((len(x), 1), np.int64), np.cumsum(each, axis=1)], axis=1)

        before, after = scores(q - steps, p - steps), scores(q + n - 1 + steps, p + n - 1 + steps)
        after = np.maximum.accumulate(after[:, ::-1], axis=1)[:, ::-1]  # the best of so many words or more
        least = FUZZY - n - np.arange(reach + 1)
        best = np.take_along_axis(after, np.clip(least, 0, reach), axis=1)
        out[at : at + 4000] = ((before + n + best >= 0) & (least <= reach)).any(1)
    return out


def search(documents: list[list[str]], items: Items) -> list[tuple]:
    """``(document, item_id, verbatim, words, changes, document_word, item_word)`` for each leaked pair of one shard."""
    number = items.numbers.get
    starts, string = [], [0]
    for ws in documents:
        starts.append(len(string))
        string += [number(w, 0) for w in ws]
        string.append(0)
    text = np.array(string, dtype=np.int32)
    place, item, length = matches(text, items, False)
    if not len(place):
        return []
    bounds = np.array(starts)
    document = np.searchsorted(bounds, place, side="right") - 1
    owner = items.owner[item]
    found: dict[tuple[int, int], list] = {}
    for i in np.argsort(-length, kind="stable"):
        key = (int(document[i]), int(owner[i]))
        if key in found:
            continue
        d = key[0]
        end = bounds[d + 1] - 1 if d + 1 < len(bounds) else len(text) - 1
        n = int(length[i])
        if n < VERBATIM and not aligned(text, int(bounds[d]), int(end), items, int(place[i]), int(item[i]), n, WITHIN - ANCHOR):
            continue
        passage = aligned(text, int(bounds[d]), int(end), items, int(place[i]), int(item[i]), n)
        words, changes = passage or (n, 0)
        begin = int(np.flatnonzero(items.owner == key[1])[0])
        found[key] = [n, max(words, n), changes if words > n else 0, int(place[i] - bounds[d]), int(item[i]) - begin]
    return [(d, items.ids[k], *rest) for (d, k), rest in found.items()]


def _block(items: DataFrame, key: str, fields: tuple[str, str], part: int, parts: int) -> list[tuple]:
    rows = items if parts == 1 else items.where(F.pmod(F.xxhash64(key), F.lit(parts)) == part)
    return sorted(((r[0], r[1], r[2]) for r in rows.select(key, *fields).where(F.col(key).isNotNull()).collect()), key=lambda r: (r[0], r[1] or "", r[2] or ""))


def leaked(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_fields: tuple[str, str] = ("question", "reference_solution"), block_characters: int = BLOCK_CHARACTERS) -> DataFrame:
    """Each pair of a document and an item that leaked into it: longest verbatim match, aligned passage and places (in words from 0).

    Null or empty texts and items match nothing. Rows that share a document key are searched apart and give rows apart. Items with the
    same words are all reported. The driver holds one block of items at a time: with several, each pass is written to the shared folder
    before the next block is fetched."""
    kind = documents.schema[key].dataType.simpleString()
    source = documents.select(F.col(key).alias("k"), F.col(text).alias("t"))
    length = lambda c: F.length(F.coalesce(F.col(c), F.lit("")))
    parts = int((items.agg(F.sum(length(item_fields[0]) + length(item_fields[1])).alias("n")).first()["n"] or 0) // block_characters) + 1

    def run(batches: Iterator[pd.DataFrame], shared) -> Iterator[pd.DataFrame]:
        evaluation = shared.value
        for batch in batches:
            rows, keys, shard, size = [], [], [], 0
            for k, t in zip(batch["k"], batch["t"]):
                ws = passage_words(t or "")
                if len(ws) < VERBATIM:
                    continue
                if size and size + len(ws) > SHARD_WORDS:
                    rows += [(keys[r[0]], *r[1:]) for r in search(shard, evaluation)]
                    keys, shard, size = [], [], 0
                keys.append(k)
                shard.append(ws)
                size += len(ws)
            rows += [(keys[r[0]], *r[1:]) for r in search(shard, evaluation)] if shard else []
            yield pd.DataFrame(rows, columns=["k", *[x.split()[0] for x in SCHEMA.split(", ")]])

    passes = []
    for part in range(parts):
        shared = documents.sparkSession.sparkContext.broadcast(Items(_block(items, item_key, item_fields, part, parts)))
        found = source.mapInPandas(partial(run, shared=shared), f"k {kind}, {SCHEMA}")
        if parts > 1:
            found = checkpointed(found)
            shared.destroy()
        passes.append(found)
    return reduce(DataFrame.unionByName, passes).withColumnRenamed("k", key)


def without_leaks(documents: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents that hold no leaked passage."""
    return documents.join(found.select(key).distinct(), key, "left_anti")
