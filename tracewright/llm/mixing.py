"""Mixing sources to target shares of the total size in tokens.

A document belongs to domains: its labelled source or, where the label is missing, the posterior of a classifier fitted on a sample of
labelled rows. Projected gradient descent finds non-negative document rates, at most the cap of their domains, whose expected token
totals by domain come closest to the targets in least squares. Documents of one label have one membership, so one rate: they enter a
step as one class, summed before. Only documents without a label need a pass, which replays the steps so far.

Rates become whole uses by a threshold on the hash of the key, found in two histograms, one inside the other; what a source still lacks
is filled with documents next to the threshold that fit. The size of the mix, if none is given, is the largest at which every target
source that has documents can reach its share. A source without documents, or too small for a size that is given, gives what it can, and
the report shows it.
"""

from __future__ import annotations

import base64
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.functions.text import strip
from tracewright.llm.words import words
from tracewright.runtime import checkpointed

STEPS, BUCKETS, FEATURES = 12, 4096, 1 << 14
#: Documents next to a threshold, per source, among which those are looked for that fill it up. A bound on what the driver fetches.
NEAR = 500
MET = 0.01


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def token_counter(path: str) -> Callable[[list[str]], list[int]]:
    """Counts tokens with a tokenizer file: ranks of byte pairs (``.tiktoken``) or a ``tokenizers`` file. Special tokens are ordinary text."""
    if path.endswith(".tiktoken"):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(own.encode_ordinary(t)) for t in texts]
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(path)
    encoder.encode_special_tokens = True
    return lambda texts: [len(e) for at in range(0, len(texts), 500) for e in encoder.encode_batch(texts[at : at + 500], add_special_tokens=False)]


def features(text: str) -> set[int]:
    return {zlib.crc32(w.encode()) % FEATURES for w in words(text)}


@dataclass
class Domains:
    """Naive Bayes over hashed words: the posterior of each domain for a text."""

    names: list[str]
    prior: np.ndarray
    weights: np.ndarray

    def posterior(self, text: str) -> np.ndarray:
        if not self.names:
            return np.zeros(0)
        score = self.prior.copy()
        if used := features(text):
            score += self.weights[list(used)].sum(0) / np.sqrt(len(used))  # words of a text aren't independent
        score = np.exp(score - score.max())
        return score / score.sum()


def fit_domains(counts: dict[str, Counter], prior: dict[str, float], names: list[str]) -> Domains:
    """From the number of texts with each feature (and of all texts, under -1) by source."""
    if not names:
        return Domains([], np.zeros(0), np.zeros((FEATURES, 0)))
    table, texts = np.full((FEATURES, len(names)), 0.5), np.ones(len(names))
    for k, name in enumerate(names):
        own = Counter(counts.get(name, {}))
        texts[k] += own.pop(-1, 0)
        table[list(own.keys()), k] += list(own.values())
    weights = np.log(table / (texts + 1))
    share = np.array([prior.get(n, 0.0) + 1e-9 for n in names])
    return Domains(names, np.log(share / share.sum()), weights - weights.mean(1, keepdims=True))


def sampled_counts(documents: DataFrame, key: str, text: str, source: str, names: list[str], per_source: int = 400) -> tuple[dict[str, Counter], dict[str, int]]:
    """Texts with each feature by source, in a sample of about ``per_source`` whole texts of each, by a hash of key and text; and the rows
    each source has. Counted on the executors: the driver fetches at most ``FEATURES`` numbers a source."""
    h = F.pmod(F.xxhash64(F.col(key), F.col(text)), F.lit(1 << 30))
    rows = documents.select(F.col(text).alias("t"), F.col(source).alias("s"), h.alias("h")).where(F.col("s").isin(names) & F.col("t").isNotNull())
    sizes = {r["s"]: r["n"] for r in rows.groupBy("s").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return {}, sizes
    below = F.coalesce(*[F.when(F.col("s") == s, F.lit(int((1 << 30) * min(1.0, per_source / n)))) for s, n in sizes.items()])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = Counter((s, f) for s, t in zip(batch["s"], batch["t"]) for f in (*features(t), -1))
            yield pd.DataFrame([(s, f, n) for (s, f), n in found.items()], columns=["s", "f", "n"])

    counted = rows.where(F.col("h") <= below).select("s", "t").mapInPandas(count, "s string, f int, n long").groupBy("s", "f").agg(F.sum("n").alias("n"))
    out: dict[str, Counter] = {s: Counter() for s in sizes}
    table = counted.toArrow()
    for s, f, n in zip(*(table.column(c).to_pylist() for c in ("s", "f", "n"))):
        out[s][f] = n
    return out, sizes


def memberships(documents: DataFrame, key: str, text: str, source: str, model: Domains, tokenizer: str) -> DataFrame:
    """``k, s, tokens, p``: size of every document, and its posterior where the label is missing or blank; null elsewhere."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count, domains = token_counter(tokenizer), shared.value
        for batch in batches:
            texts = [t or "" for t in batch["t"]]
            yield pd.DataFrame({"k": batch["k"], "s": batch["s"], "tokens": count(texts), "p": [domains.posterior(t) if s is None else None for s, t in zip(batch["s"], texts)]})

    label = F.nullif(strip(F.col(source)), F.lit(""))
    named = documents.select(F.col(key).alias("k"), F.when(label.isNotNull(), F.col(source)).alias("s"), F.col(text).alias("t"))
    return named.mapInPandas(run, f"k {kind}, s string, tokens long, p array<double>")


def _rates(p: np.ndarray, caps: np.ndarray, start: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """Every document's rate after the steps so far: each moves along the membership and is projected onto 0..cap."""
    top = p @ caps
    r = np.minimum(p @ start, top)
    for e in steps:
        r = np.clip(r - p @ e, 0.0, top)
    return r


def mix(documents: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", size: float | None = None, tokenizer: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Uses of each document (key, source, tokens, rate, uses) and the report by source. ``actual_share`` counts labelled documents,
    ``expected_share`` also what unlabelled ones are expected to hold of the source.

    ``targets`` has source, target_share, max_repeats (null or negative: no use); shares are scaled to sum to 1. Null texts have no tokens.
    Rows that share a key are documents of their own, used alike. ``source`` of the uses is null where the label is."""
    rows = [r for r in targets.select("source", "target_share", "max_repeats").collect() if r["source"] is not None]  # one row per source of the plan
    names = [r["source"] for r in rows]
    share = np.array([max(0.0, r["target_share"] or 0.0) for r in rows])
    share = share / share.sum() if share.sum() else share
    caps = np.array([float(max(0, r["max_repeats"] or 0)) for r in rows])
    spark, n = documents.sparkSession, len(names)
    features_seen, counts = sampled_counts(documents, key, text, source, names)
    model = fit_domains(features_seen, {name: float(counts.get(name, 0)) for name in names}, names)
    table = checkpointed(memberships(documents, key, text, source, model, tokenizer or default_tokenizer()))
    own = {r["s"]: (r["n"], r["t"]) for r in table.where(F.col("s").isin(names)).groupBy("s").agg(F.count("*").alias("n"), F.sum("tokens").alias("t")).collect()}
    tokens = np.array([float(own[s][1]) if s in own else 0.0 for s in names])
    soft = checkpointed(table.where("s IS NULL"))

    def totals(start: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
        """Expected tokens by domain: the labelled ones as a class a domain, the others one by one."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out = np.zeros(n)
            for batch in batches:
                if len(batch):
                    p = np.stack(batch["p"].to_numpy())
                    out += (p * (_rates(p, caps, start, steps) * batch["tokens"].to_numpy())[:, None]).sum(0)
            yield pd.DataFrame({"d": range(n), "x": out})

        out = _rates(np.eye(n), caps, start, steps) * tokens
        for r in soft.select("tokens", "p").mapInPandas(run, "d int, x double").groupBy("d").agg(F.sum("x").alias("x")).collect():
            out[r["d"]] += r["x"]
        return out

    full = totals(np.full(n, 1e300), []) if n else np.zeros(0)  # every document at its cap
    have = np.where(caps > 0, full / np.maximum(caps, 1), 0.0)
    labelled = tokens > 0
    if size is None:
        reach = [full[i] / share[i] for i in range(n) if share[i] > 0 and labelled[i] and full[i] > 0]
        size = min(reach) if reach else 0.0
    goal = share * size
    start = np.where(have > 0, np.minimum(goal / np.maximum(have, 1e-9), caps), 0.0)
    steps: list[np.ndarray] = []
    for _ in range(STEPS if size else 0):
        miss = totals(start, steps) - goal
        if np.abs(miss)[labelled].max(initial=0.0) < 1e-4 * size:
            break
        steps.append(np.where(have > 0, miss / np.maximum(have, 1e-9), 0.0))
    rates = dict(zip(names, _rates(np.eye(n), caps, start, steps).tolist())) if n else {}

    def with_rates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                p = np.stack(batch["p"].to_numpy()) if n else np.zeros((len(batch), 0))
                yield batch.assign(rate=_rates(p, caps, start, steps) if n else 0.0)

    kind = documents.schema[key].dataType.simpleString()
    by_label = F.coalesce(*[F.when(F.col("s") == s, F.lit(r)) for s, r in rates.items()], F.lit(0.0))
    rated = table.where("s IS NOT NULL").select("k", "s", "tokens", "p", by_label.alias("rate"))
    rated = rated.unionByName(soft.select("k", "s", "tokens", "p").mapInPandas(with_rates, f"k {kind}, s string, tokens long, p array<double>, rate double"))
    h = F.pmod(F.xxhash64(F.lit("mix"), "k"), F.lit(BUCKETS**2))
    rated = checkpointed(rated.withColumns({"h": h, "part": F.col("rate") - F.floor("rate")}))
    level, more = _thresholds(rated, {s: r - int(r) for s, r in rates.items()}, own)
    below = F.coalesce(*[F.when(F.col("s") == s, F.lit(x)) for s, x in level.items()], F.col("part") * BUCKETS**2)
    filled = spark.createDataFrame(more, f"_s string, _k {kind}").withColumn("_more", F.lit(True))
    chosen = rated.join(F.broadcast(filled), (F.col("s") == F.col("_s")) & (F.col("k") == F.col("_k")), "left")
    plus = (F.col("part") > 0) & ((F.col("h") < below) | F.col("_more").isNotNull())
    used = chosen.select(F.col("k").alias(key), F.col("s").alias(source), "tokens", "rate", "p", (F.floor("rate") + plus.cast("int")).cast("int").alias("uses"))

    by = used.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("documents"), F.sum("tokens").alias("own_tokens"), F.sum(F.col("tokens") * F.col("uses")).alias("used_tokens"), F.max("uses").alias("most_uses"))
    unlabelled = used.where(F.col(source).isNull() & (F.col("uses") > 0)).select(F.posexplode("p").alias("d", "x"), (F.col("tokens") * F.col("uses")).alias("t")).groupBy("d").agg(F.sum(F.col("x") * F.col("t")).alias("soft_tokens"))
    expected = spark.createDataFrame(list(enumerate(names)), "d int, source string").join(unlabelled, "d", "left").select("source", F.coalesce("soft_tokens", F.lit(0.0)).alias("soft_tokens"))
    plan = spark.createDataFrame([(s, float(x), int(c), float(g)) for s, x, c, g in zip(names, share, caps, goal)], "source string, target_share double, max_repeats int, goal_tokens double")
    joined = plan.join(expected, "source").join(by, "source", "full_outer")
    whole = used.agg(F.sum(F.col("tokens") * F.col("uses")).alias("all_tokens"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    report = joined.join(F.broadcast(whole)).select(
        "source", "target_share", "max_repeats", zero("documents").alias("documents"), zero("own_tokens").alias("own_tokens"), zero("used_tokens").alias("used_tokens"),
        F.coalesce(F.col("used_tokens") / F.col("all_tokens"), F.lit(0.0)).alias("actual_share"),
        F.coalesce((zero("used_tokens") + F.col("soft_tokens")) / F.col("all_tokens"), F.lit(0.0)).alias("expected_share"), zero("most_uses").alias("most_uses"),
        (zero("used_tokens") + zero("soft_tokens") >= (1 - MET) * F.col("goal_tokens")).alias("met"),
    )
    return used.drop("p"), report


def _thresholds(rated: DataFrame, parts: dict[str, float], own: dict[str, tuple[int, int]]) -> tuple[dict[str, int], list[tuple]]:
    """Below which hash a document of each source is used once more, and the documents (source, key) beyond it that are used, too.

    The hash's range is cut in ``BUCKETS``, and the bucket in which the wanted tokens are reached once more. What is lacking at the
    beginning of that part is filled, largest first, from about ``NEAR`` documents that come next."""
    want = {s: p * own[s][1] for s, p in parts.items() if p > 0 and s in own}
    if not want:
        return {}, []
    level, lacking, width = dict.fromkeys(want, 0), dict(want), BUCKETS
    open_ = rated.where(F.col("s").isin(list(want)))
    at = F.coalesce(*[F.when(F.col("s") == s, F.lit(x)) for s, x in level.items()])
    for _ in range(2):
        inside = F.col("h").between(at, at + width * BUCKETS - 1)
        found = open_.where(inside).groupBy("s", F.floor((F.col("h") - at) / width).alias("b")).agg(F.sum("tokens").alias("n")).collect()
        for s in want:
            for b, n in sorted((r["b"], r["n"]) for r in found if r["s"] == s):
                if n > lacking[s]:
                    level[s] += int(b) * width
                    break
                lacking[s] -= n
            else:
                level[s] += width * BUCKETS
        at = F.coalesce(*[F.when(F.col("s") == s, F.lit(x)) for s, x in level.items()])
        width //= BUCKETS
    reach = F.coalesce(*[F.when(F.col("s") == s, F.lit(x + 1 + int(BUCKETS**2 * NEAR / own[s][0]))) for s, x in level.items()])
    near = open_.where((F.col("h") >= at) & (F.col("h") < reach)).groupBy("s", "k").agg(F.sum("tokens").alias("n"), F.min("h").alias("h")).where("n > 0").collect()
    more = []
    for r in sorted(near, key=lambda r: (-r["n"], r["h"])):
        if r["n"] <= lacking[r["s"]]:
            lacking[r["s"]] -= r["n"]
            more.append((r["s"], r["k"]))
    return level, more
