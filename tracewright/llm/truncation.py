"""Text cut off by field limits.

1. The length of every value is worked out anew under other encodings: UTF-8 bytes, UTF-16 units, HTML entities, JSON escapes,
   ``\\r\\n`` line ends. Per source, field and encoding, values without a final full stop that pile up at a length show a hidden limit;
   a source and field can have several.
   A value without a final full stop at such a length was cut there, whatever its last words look like.
2. Endings of the other values are inspected. Sentences that are followed by more text, or closed by a full stop, teach how sentences end: for the last
   one to three words (figures masked) how often a sentence ends there and how often it goes on. A value without a final full stop
   whose last words nearly always go on was cut; so was one with a cut mark or a broken character.

Counting covers all values. Sentences are first grouped, so only distinct ones reach Python.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewright.runtime import checkpointed

#: Stand-ins for a missing value; compared without case, blanks and brackets.
PLACEHOLDERS = ["", "n/a", "na", "nan", "none", "null", "nil", "undefined", "empty", "noanswer", "missing", "tbd", "todo", "unknown", "-", "--", "?", "..."]
INVISIBLE = "­​-‏ -‮⁠-⁤﻿"
#: Ends are read backwards, letter by letter: a pattern at the beginning of the reversed text is tried once, whatever the length of the text.
#: A mark that says text was cut, or a broken last character.
_SAID = "|".join(x[::-1].replace(" ", r"\s") for x in ("truncated", "cut off", "cut", "more", "continued", "snip", "read more"))
CUT_MARK = rf"^\s*(?:…|\.\.\.+|\]\s*(?:…|\.\.\.|{_SAID})\s*\[|\)\s*(?:…|\.\.\.|{_SAID})\s*\(|�)"
STOP = r"^[\"'”’»“)\]]*[.!?。！？]"
LIST_NUMBER = r"^[.)]\d+\s*(?:\n|\z)"
LEAST_SEEN, END_SHARE = 3, 0.34
PIECE = "\\n+|(?<=[.!?])\\s+"


#: Blanks and invisible characters, one by one: trimming by a set is far cheaper than by a pattern.
BLANKS = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0xAD, 0x1680, 0x180E, *range(0x2000, 0x2010), *range(0x2028, 0x202F), 0x202F, 0x205F, *range(0x2060, 0x2065), 0x3000, 0xFEFF]))


def visible(text: Column) -> Column:
    return F.trim(text, F.lit(BLANKS))


def is_empty(text: Column) -> Column:
    """Null, or nothing but blanks, invisible characters, punctuation or a placeholder for a missing value."""
    around = f"\\s\\p{{Z}}{INVISIBLE}<>\\[\\](){{}}\"'`_*#|"
    short = text.rlike(f"^[{around}]*+(?:[^{around}][{around}]*+){{0,{max(map(len, PLACEHOLDERS))}}}\\z")  # so few others that it can be one
    bare = F.lower(F.regexp_replace(text, f"[{around}]+", ""))
    return text.isNull() | ~text.rlike(r"[\p{L}\p{N}]") | (short & bare.isin(PLACEHOLDERS))


def lengths(text: Column) -> dict[str, Column]:
    """The length of a value under each encoding a store may count in, the plainest first."""
    count = lambda c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    entities = 4 * count("&") + 3 * count("<") + 3 * count(">") + 5 * count('"') + 5 * count("'")
    escapes = count("\\") + count('"') + count("\n") + count("\r") + count("\t")
    non_ascii = F.length(F.regexp_replace(text, r"[\x00-\x7f]", ""))
    return {
        "characters": F.length(text),
        "utf8_bytes": F.octet_length(text),
        "utf16_units": (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int"),
        "html_characters": F.length(text) + entities,
        "html_bytes": F.octet_length(text) + entities,
        "json_characters": F.length(text) + escapes,
        "json_bytes": F.octet_length(text) + escapes,
        "json_ascii": F.length(text) + escapes + 5 * non_ascii,
        "crlf_characters": F.length(text) + count("\n"),
        "crlf_bytes": F.octet_length(text) + count("\n"),
    }


def _ended(visible_text: Column) -> Column:
    """Closed by a full stop that is no cut mark, nor part of a bare list number."""
    end = F.reverse(visible_text)
    return end.rlike(STOP) & ~end.rlike(CUT_MARK) & ~end.rlike(LIST_NUMBER)


def open_values(values: DataFrame) -> DataFrame:
    """Values that are neither empty nor closed by a full stop, with ``_v``, their visible text."""
    return values.where(~is_empty(F.col("text"))).withColumn("_v", visible(F.col("text"))).where(~_ended(F.col("_v")))


def hidden_limits(values: DataFrame, least: int = 12, share: float = 0.12, peak: float = 5.0) -> DataFrame:
    """Per source and field every length at which unfinished values pile up, and the encoding that shows it best.

    ``values`` has source, field_name, text. A length is a limit if at least ``least`` values without a final full stop have it, and
    they are ``peak`` times the mean of the three lengths on either side. Complete values made alike pile up too, with others beside
    them; so where they are less than ``share`` of all such values of the source and field, they must be ``least`` different texts
    and ``peak`` times the largest of those six lengths. The limit with most values comes first; the others are looked for among the
    values that are at none of those before, so the same values don't show a limit again under another encoding. A null source is a
    source of its own."""
    return _limits(open_values(values), least, share, peak)


def _limits(unfinished: DataFrame, least: int = 12, share: float = 0.12, peak: float = 5.0) -> DataFrame:
    names = list(lengths(F.lit("")))
    sizes = unfinished.select("source", "field_name", F.xxhash64("text").alias("h"), *[n.alias(k) for k, n in lengths(F.col("text")).items()])
    rest = checkpointed(sizes.groupBy("source", "field_name", "h", *names).agg(F.count("*").alias("n")))
    group = Window.partitionBy("source", "field_name", "encoding")
    near = group.orderBy("length")
    others = [F.coalesce(F.max("n").over(near.rangeBetween(*side)), F.lit(0)) for side in ((-3, -1), (1, 3))]
    around = (F.sum("n").over(near.rangeBetween(-3, 3)) - F.col("n")) / 6
    wide = _counts(rest).withColumns({"all": F.sum("n").over(group), "around": around, "largest": F.greatest(*others)})
    enough = (F.col("n") >= least) & (F.col("n") >= peak * F.col("around"))
    enough &= (F.col("n") >= share * F.col("all")) | ((F.col("texts") >= least) & (F.col("n") >= peak * F.col("largest")))
    peaks = checkpointed(wide.where(enough))
    beside = peaks.select(F.col("source").alias("_s"), F.col("field_name").alias("_f"), F.col("encoding").alias("_e"), F.col("length").alias("_l"), "all", "around", "largest")
    same_group = F.col("source").eqNullSafe(F.col("_s")) & (F.col("field_name") == F.col("_f"))
    order = F.coalesce(*[F.when(F.col("encoding") == k, F.lit(i)) for i, k in enumerate(names)])
    best = F.max_by(F.struct("encoding", "length", "n"), F.struct("n", -order))
    rounds = []
    while True:
        found = peaks.groupBy("source", "field_name").agg(best.alias("b")).select("source", "field_name", "b.encoding", F.col("b.length").alias("limit"), F.col("b.n").alias("values_at_limit"))
        rounds.append(checkpointed(found))
        if rounds[-1].isEmpty():
            return reduce(DataFrame.unionByName, rounds[:-1] or rounds)
        had = rounds[-1].select(F.col("source").alias("_s"), F.col("field_name").alias("_f"), F.col("encoding").alias("_encoding"), F.col("limit").alias("_limit"))
        at = F.element_at(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*names)), F.col("_encoding"))
        rest = checkpointed(rest.join(had, same_group).where(at != F.col("_limit")).select("source", "field_name", *names, "n"))
        again = _counts(rest).join(beside, same_group & (F.col("encoding") == F.col("_e")) & (F.col("length") == F.col("_l")))
        peaks = checkpointed(again.where(enough).select("source", "field_name", "encoding", "length", "n"))


def _counts(sizes: DataFrame) -> DataFrame:
    """Values and different texts of every length; ``sizes`` has the lengths and number of each text."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("encoding"), F.col(k).alias("length")) for k in lengths(F.lit(""))]))
    counts = sizes.select("source", "field_name", "n", each.alias("e")).groupBy("source", "field_name", F.col("e.encoding").alias("encoding"), F.col("e.length").alias("length"))
    return counts.agg(F.sum("n").alias("n"), F.count("*").alias("texts"))


def masked(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"\p{Nd}+(?:[.,]\p{Nd}+)*", "0")


def _pieces(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, PIECE), lambda p: F.trim(F.regexp_replace(p, r"^\s*(?:[-*•]|\(?0[.)])+\s+", ""))), lambda p: p != "")


def sentence_counts(values: DataFrame) -> DataFrame:
    """Distinct masked sentences of all values, with how often each stood closed or followed by more text, and how often open at the end."""
    v = visible(F.col("text"))
    pieces = values.where(F.col("text").isNotNull()).select(_pieces(masked(v)).alias("p"), _ended(v).alias("closed"))
    each = pieces.select(F.posexplode("p").alias("i", "piece"), F.size("p").alias("n"), "closed")
    done = (F.col("i") + 1 < F.col("n")) | F.col("closed")
    return each.groupBy("piece").agg(F.sum(done.cast("long")).alias("done"), F.sum((~done).cast("long")).alias("open"))


def _tokens(piece: str) -> list[str]:
    out, word = [], ""
    for c in piece + " ":
        if c.isalnum():
            word += c
        else:
            if word:
                out.append(word)
                word = ""
            if c in "=+*/×:-":
                out.append(c)
    return out


def _contexts(tokens: list[str], i: int) -> list[tuple[str, str]]:
    """The two, one and no words before token ``i``, each with the token."""
    return [(" ".join(["^", "^", *tokens[:i]][-k:]) if k else "", tokens[i]) for k in (2, 1, 0)]


def ending_statistics(sentences: DataFrame) -> DataFrame:
    """For a word after its last two, one or no words: how often a sentence is known to end there, stands open there, or goes on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ends, opens, goes = Counter(), Counter(), Counter()
        for batch in batches:
            for piece, done, opened in zip(batch["piece"], batch["done"], batch["open"]):
                tokens = _tokens(piece)
                for i in range(len(tokens) - 1):
                    for c in _contexts(tokens, i):
                        goes[c] += done + opened
                for c in _contexts(tokens, len(tokens) - 1) if tokens else ():
                    ends[c] += done
                    opens[c] += opened
            if len(goes) + len(ends) > 200_000:
                yield from flush(ends, opens, goes)
        yield from flush(ends, opens, goes)

    def flush(ends: Counter, opens: Counter, goes: Counter) -> Iterator[pd.DataFrame]:
        keys = list(ends.keys() | goes.keys())
        if keys:
            yield pd.DataFrame({"before": [k[0] for k in keys], "word": [k[1] for k in keys], "ends": [ends[k] for k in keys], "opens": [opens[k] for k in keys], "goes": [goes[k] for k in keys]})
        ends.clear(), opens.clear(), goes.clear()

    made = sentences.mapInPandas(run, "before string, word string, ends long, opens long, goes long")
    return made.groupBy("before", "word").agg(F.sum("ends").alias("ends"), F.sum("opens").alias("opens"), F.sum("goes").alias("goes"))


def open_verdicts(sentences: DataFrame) -> DataFrame:
    """For every sentence that stands open at the end of a value whether it is unfinished.

    Asked of the last word after the two words before it; after one or none where that was seen less than ``LEAST_SEEN`` times.
    Sentences that end or stand open there speak for a complete value, those that go on, and longer words that begin with the last
    word in its place, for a cut one. A last word seen nowhere else is a broken word."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for piece in batch["piece"]:
                tokens = _tokens(piece)
                rows += [(piece, 2 - k, *c) for k, c in enumerate(_contexts(tokens, len(tokens) - 1) if tokens else [])]
            yield pd.DataFrame(rows, columns=["piece", "k", "before", "last"])

    asked = sentences.where("open > 0").select("piece").mapInPandas(run, "piece string, k int, before string, last string")
    probes = asked.select("before", "last").distinct()
    known = ending_statistics(sentences)
    # Longer words with the same beginning meet by first letters: up to three, and exactly three where no word stands before.
    letters = lambda w: F.least(F.lit(3), F.length(w))
    by_start = probes.where("before <> '' OR length(last) >= 3").withColumn("start", F.substr("last", F.lit(1), letters("last")))
    sizes = F.when(F.col("before") == "", F.array(F.lit(3))).otherwise(F.sequence(F.lit(1), F.greatest(F.lit(1), letters("word"))))
    begun = known.withColumn("size", F.explode(sizes)).where("size <= length(word)").withColumn("start", F.substr("word", F.lit(1), F.col("size"))).drop("size")
    columns = ["before", "last", "word", "ends", "opens", "goes"]
    near = begun.join(by_start, ["before", "start"]).where(F.startswith("word", "last")).select(*columns)
    alone = known.where("before = '' AND length(word) < 3").withColumn("last", F.col("word")).join(probes.where("before = '' AND length(last) < 3"), ["before", "last"]).select(*columns)
    same = F.col("word") == F.col("last")
    seen = near.unionByName(alone).groupBy("before", "last").agg(
        F.max(F.when(same, F.col("ends") + F.col("opens")).otherwise(0)).alias("done"),
        F.max(F.when(same, F.col("ends") + F.col("goes")).otherwise(0)).alias("known"),
        F.sum(F.when(same, F.col("goes")).otherwise(F.col("ends") + F.col("goes"))).alias("goes"),
    )
    weight = F.col("done") + F.col("goes")
    judged = asked.join(seen, ["before", "last"]).groupBy("piece").agg(
        F.max_by(F.col("done") / weight, F.when(weight >= LEAST_SEEN, F.col("k"))).alias("share"), F.max(F.when(F.col("k") == 0, F.col("known"))).alias("known")
    )
    complete = (F.coalesce("known", F.lit(0)) >= LEAST_SEEN) & (F.coalesce("share", F.lit(0.0)) >= END_SHARE)
    return sentences.where("open > 0").select("piece").join(judged, "piece", "left").select("piece", (~complete).alias("unfinished"))


def truncated(values: DataFrame, statistics_from: DataFrame | None = None) -> DataFrame:
    """``values`` (source, field_name, text and any other columns) that were cut, with ``evidence``: limit, mark or ending, the first that holds.

    Null, blank and placeholder values are never cut, nor are values closed by a full stop. Repeated rows come out as often as they
    come in; a column ``evidence`` of theirs is replaced. ``statistics_from`` (a table with text) adds sentences to learn endings from."""
    texts = values.select("text") if statistics_from is None else values.select("text").unionByName(statistics_from.select("text"))
    sentences = checkpointed(sentence_counts(texts))
    verdicts = open_verdicts(sentences)
    names = [c for c in values.columns if c != "evidence"]
    unfinished = checkpointed(open_values(values).select(*names, F.reverse("_v").rlike(CUT_MARK).alias("_marked"), F.try_element_at(_pieces(masked(F.col("_v"))), F.lit(-1)).alias("_piece")))
    limits = _limits(unfinished).groupBy(F.col("source").alias("_s"), F.col("field_name").alias("_f")).agg(F.collect_list(F.struct("encoding", "limit")).alias("_limits"))
    verdicts = verdicts.select(F.col("piece").alias("_piece"), F.col("unfinished").alias("_unfinished"))
    encoded = F.map_from_arrays(F.array(*[F.lit(k) for k in lengths(F.lit(""))]), F.array(*lengths(F.col("text")).values()))
    joined = unfinished.join(verdicts, "_piece", "left").join(limits, F.col("source").eqNullSafe(F.col("_s")) & (F.col("field_name") == F.col("_f")), "left")
    at_limit = F.coalesce(F.exists("_limits", lambda x: F.element_at(encoded, x["encoding"]) == x["limit"]), F.lit(False))
    evidence = F.when(at_limit, "limit").when(F.col("_marked"), "mark").when(F.coalesce("_unfinished", F.lit(False)), "ending")
    return joined.withColumn("evidence", evidence).where(F.col("evidence").isNotNull()).select(*names, "evidence")


def stacked(rows: DataFrame, key: str, source: str, fields: list[str]) -> DataFrame:
    """One row per key and field: key, source, field_name, text."""
    return rows.select(F.col(key), F.col(source).alias("source"), F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("text")) for f in fields])).alias("x")).select(key, "source", "x.field_name", "x.text")


def cut_rates(values: DataFrame, cut: DataFrame) -> DataFrame:
    """Per source and field the values, the cut ones by evidence and their rate; null texts are no values. A null source is a source of
    its own."""
    all_counts = values.where(F.col("text").isNotNull()).groupBy("source", "field_name").agg(F.count("*").alias("n_values"))
    kinds = ["limit", "mark", "ending"]
    by_kind = [F.count(F.when(F.col("evidence") == k, 1)).alias(f"by_{k}") for k in kinds]
    cut_counts = cut.groupBy(F.col("source").alias("_s"), F.col("field_name").alias("_f")).agg(F.count("*").alias("n"), *by_kind)
    joined = all_counts.join(cut_counts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("field_name") == F.col("_f")), "left")
    none = lambda c: F.coalesce(c, F.lit(0))
    return joined.select("source", "field_name", "n_values", none("n").alias("n_cut"), *[none(f"by_{k}").alias(f"by_{k}") for k in kinds], (none("n") / F.col("n_values")).alias("cut_rate"))
