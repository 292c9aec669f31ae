"""Filling containers of fixed capacity: a grouping genetic algorithm on islands.

Items are dealt to shards of about ``SHARD`` items. For each shard and kind of container some islands breed packings, the first of them
built container by container: the largest item, then what fills the rest exactly, of sizes as even as can be, so that small items are
left for small ones. Parents are chosen by tournament. A child takes whole well-filled containers of one parent into the other, and
containers of the other that hold one of these items are broken up; a mutant has a few badly filled containers and a few of any kind
broken up. What falls out replaces items of containers that it fills better, and the rest is put back by best fit, largest first. Between
epochs an island keeps its packings, and the best ones also move to the next island. A shard is done early only where a lower bound shows
that no packing has fewer containers. The badly filled containers of all shards are then dealt anew to shards of their own and packed
once more, so shards leave no waste of their own.

An item above the capacity is split: full pieces fill containers, the rest is an item. The number of tasks follows the number of shards;
a task works on one shard at a time.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.runtime import checkpointed

SHARD, ISLANDS, EPOCHS, GENERATIONS, POPULATION, CHILDREN, MUTANTS, ELITE = 2000, 2, 2, 5, 4, 3, 2, 2
WELL_FILLED, KEEP_FILLED, LEVELS = 0.97, 0.985, 2
#: Islands a task breeds, one after the other.
PER_TASK = 16
#: Sums of sizes are kept as bits of one number up to this capacity.
BITS = 1 << 14
#: Numbers of items that leave a container and that enter it, in the order tried.
EXCHANGES = sorted(((k, n) for k in range(4) for n in range(1, 4)), key=lambda x: (x[1] - x[0], x[1]))


class Packing:
    """Containers as lists of items, with what is left in each."""

    __slots__ = ("bins", "left", "score")

    def __init__(self, bins: list[list[int]], left: list[int], capacity: int) -> None:
        self.bins, self.left = bins, left
        self.score = sum((1 - x / capacity) ** 2 for x in left) / max(1, len(left))


def _best_fit(bins: list[list[int]], left: list[int], items: list[int], sizes: list[int], capacity: int) -> None:
    """Put ``items`` where they leave least, in the order given; open containers as needed."""
    room = sorted((r, b) for b, r in enumerate(left) if r > 0)
    for i in items:
        s = sizes[i]
        at = bisect_left(room, (s, -1))
        if at < len(room):
            r, b = room.pop(at)
            bins[b].append(i)
            left[b] = r - s
            if r > s:
                insort(room, (r - s, b))
        else:
            bins.append([i])
            left.append(capacity - s)
            if capacity > s:
                insort(room, (capacity - s, len(bins) - 1))


def build(order: list[int], sizes: list[int], capacity: int) -> Packing:
    bins: list[list[int]] = []
    left: list[int] = []
    _best_fit(bins, left, order, sizes, capacity)
    return Packing(bins, left, capacity)


class Stock:
    """Items by size, with the sums that one, two and three sizes in stock have, as bits."""

    def __init__(self, order: list[int], sizes: list[int], capacity: int) -> None:
        self.items: dict[int, list[int]] = {}
        for i in reversed(order):
            if sizes[i] > 0:
                self.items.setdefault(sizes[i], []).append(i)
        self.known = sorted(self.items)  # sizes in stock
        self.total, self.count = sum(sizes), sum(map(len, self.items.values()))
        self.mask, self._sums = (1 << capacity + 1) - 1, ()

    def take(self, size: int) -> int:
        own = self.items[size]
        self.total, self.count = self.total - size, self.count - 1
        if len(own) == 1:
            self.known.remove(size)
            self._sums = ()
        return own.pop()

    @property
    def sums(self) -> tuple[int, ...]:
        if not self._sums:
            made = [1]
            for _ in range(3):
                more = 0
                for s in self.known:
                    more |= made[-1] << s
                made.append(more & self.mask)
            self._sums = tuple(made)
        return self._sums

    def nearest(self, x: float) -> Iterator[int]:
        """Sizes in stock, from the nearest to ``x`` outwards."""
        known = self.known
        j = bisect_left(known, x)
        i = j - 1
        while i >= 0 or j < len(known):
            if i < 0 or (j < len(known) and known[j] - x < x - known[i]):
                yield known[j]
                j += 1
            else:
                yield known[i]
                i -= 1

    def parts(self, room: int, k: int) -> list[int] | None:
        """``k`` sizes in stock that sum to ``room``, as even as can be."""
        if k == 1:
            return [room]
        for a in self.nearest(room / k):
            if a < room and self.sums[k - 1] >> (room - a) & 1 and (rest := self.parts(room - a, k - 1)):
                if all(len(self.items[x]) >= n for x, n in ((x, [a, *rest].count(x)) for x in (a, *rest))):
                    return [a, *rest]
        return None

    def filling(self, room: int) -> list[int]:
        """At most three sizes that leave least of ``room``; their number as near as can be to what the mean size tells."""
        mean = self.total / self.count
        order = sorted((1, 2, 3), key=lambda k: abs(room / mean - k))
        while (room := ((self.sums[1] | self.sums[2] | self.sums[3]) & ((1 << room + 1) - 1)).bit_length() - 1) > 0:
            for k in order:
                if self.sums[k] >> room & 1 and (found := self.parts(room, k)):
                    return found
            room -= 1
        return []


def build_even(order: list[int], sizes: list[int], capacity: int) -> Packing:
    """Container by container: the largest item left, large ones while there is much room, then what fills the rest best."""
    stock = Stock(order, sizes, capacity)
    bins: list[list[int]] = []
    left: list[int] = []
    while stock.known:
        room = capacity - stock.known[-1]
        own = [stock.take(stock.known[-1])]
        while stock.known and room >= stock.known[0]:
            if room > 3.5 * stock.total / stock.count and stock.known[-1] <= room:
                chosen = [stock.known[-1]]
            elif not (chosen := stock.filling(room)):
                break
            own += [stock.take(s) for s in chosen]
            room -= sum(chosen)
        bins.append(own)
        left.append(room)
    if nothing := [i for i in order if sizes[i] <= 0]:  # takes a place but no room
        if not bins:
            bins.append([])
            left.append(capacity)
        bins[0] += nothing
    return Packing(bins, left, capacity)


def _sums(sizes: list[int]) -> list[int]:
    """The sums of none, one, two and three of ``sizes``, as bits."""
    made = [1, 0, 0, 0]
    for s in sizes:
        for k in (3, 2, 1):
            made[k] |= made[k - 1] << s
    return made


def _gain(held: int, offered: int, room: int) -> int:
    """The most, up to ``room``, by which a sum that is offered exceeds one that is held; 0 if none does. Tries the gains or the sums held,
    whichever are fewer."""
    room = min(room, offered.bit_length() - 1)
    if room <= held.bit_count():
        return next((g for g in range(room, 0, -1) if held << g & offered), 0)
    best = 0
    while held and best < room:
        least = (held & -held).bit_length() - 1
        best = max(best, (offered & (1 << least + room + 1) - 1).bit_length() - 1 - least)
        held &= held - 1
    return best


def _picked(sizes: list[int], total: int, k: int) -> list[int]:
    """Places of ``k`` of ``sizes`` that sum to ``total``, the largest as small as can be; there must be some."""
    order = sorted(range(len(sizes)), key=sizes.__getitem__)
    ranked = [sizes[j] for j in order]
    at = {s: j for j, s in reversed(list(enumerate(ranked)))}

    def pick(end: int, total: int, k: int) -> list[int] | None:
        if k < 2:
            return ([] if total == 0 else None) if k == 0 else [order[at[total]]] if at.get(total, end) < end else None
        for j in range(bisect_left(ranked, -(-total // k), 0, end), end):  # the largest of them is their mean or more
            if ranked[j] > total:
                break
            if (rest := pick(j, total - ranked[j], k - 1)) is not None:
                return [order[j], *rest]
        return None

    found = pick(len(sizes), total, k)
    assert found is not None
    return found


def replace(bins: list[list[int]], left: list[int], loose: list[int], sizes: list[int]) -> list[int]:
    """Exchange up to three items of a container for up to three loose ones that fill it most, few for many before many for few, until no
    container gains; what is loose then."""
    made = _sums([sizes[i] for i in loose])
    for b, own in enumerate(bins):
        while left[b] > 0:
            held = _sums([sizes[i] for i in own])
            gain = _gain(held[0] | held[1] | held[2] | held[3], made[1] | made[2] | made[3], left[b])
            if not gain:
                break
            out, into, hit = next((k, n, hit) for k, n in EXCHANGES if (hit := held[k] << gain & made[n]))
            total = hit.bit_length() - 1
            leave, enter = set(_picked([sizes[i] for i in own], total - gain, out)), set(_picked([sizes[i] for i in loose], total, into))
            loose, own[:] = (
                [i for j, i in enumerate(loose) if j not in enter] + [own[j] for j in leave],
                [i for j, i in enumerate(own) if j not in leave] + [loose[j] for j in enter],
            )
            left[b] -= gain
            made = _sums([sizes[i] for i in loose])
    return loose


def put_back(bins: list[list[int]], left: list[int], loose: list[int], sizes: list[int], capacity: int) -> Packing:
    """Loose items into the containers: by exchange where that fills one better, the rest by best fit, largest first."""
    loose = replace(bins, left, loose, sizes)
    _best_fit(bins, left, sorted(loose, key=lambda i: -sizes[i]), sizes, capacity)
    return Packing(bins, left, capacity)


def crossover(a: Packing, b: Packing, sizes: list[int], capacity: int, rng: np.random.Generator) -> Packing:
    """``a`` with some whole well-filled containers of ``b``, up to about half of these."""
    limit = (1 - WELL_FILLED) * capacity
    good = [k for k, r in enumerate(b.left) if r <= limit] or [int(np.argmin(b.left))]
    take = rng.choice(len(good), int(rng.integers(1, len(good) // 2 + 2)), replace=False)
    injected = [b.bins[good[k]] for k in take]
    bins = [list(x) for x in injected]
    left = [b.left[good[k]] for k in take]
    taken = {i for x in injected for i in x}
    loose: list[int] = []
    for x, r in zip(a.bins, a.left):
        if taken.isdisjoint(x):
            bins.append(list(x))
            left.append(r)
        else:
            loose += [i for i in x if i not in taken]
    return put_back(bins, left, loose, sizes, capacity)


def mutate(p: Packing, sizes: list[int], capacity: int, rng: np.random.Generator) -> Packing:
    """``p`` with a few badly filled containers and a few of any kind broken up."""
    few = max(1, len(p.left) // 25)
    worst = sorted(range(len(p.left)), key=lambda k: -p.left[k])[:few]
    broken = {k for k in worst if p.left[k] > 0 and rng.random() < 0.7} | set(rng.integers(0, len(p.left), few).tolist())
    kept = [k for k in range(len(p.left)) if k not in broken]
    return put_back([list(p.bins[k]) for k in kept], [p.left[k] for k in kept], [i for k in sorted(broken) for i in p.bins[k]], sizes, capacity)


def _genome(p: Packing, n: int) -> list[int]:
    out = [0] * n
    for k, x in enumerate(p.bins):
        for i in x:
            out[i] = k
    return out


def _packing(genome: list[int], sizes: list[int], capacity: int) -> Packing:
    bins: list[list[int]] = [[] for _ in range(max(genome, default=-1) + 1)]
    for i, k in enumerate(genome):
        bins[k].append(i)
    return Packing(bins, [capacity - sum(sizes[i] for i in x) for x in bins], capacity)


def least_containers(sizes: list[int], capacity: int) -> int:
    """No packing has fewer containers. For each size up to half of the capacity: items that leave less than it hold a container alone, as do
    others above half; what these can't take of the items from that size on needs more."""
    arr = np.sort(np.array(sizes, dtype=np.int64))
    total = np.concatenate([[0], np.cumsum(arr)])
    n, half = len(arr), int(np.searchsorted(arr, capacity // 2, "right"))
    start = np.searchsorted(arr, small := np.unique(arr[:half]))
    alone = np.searchsorted(arr, capacity - small, "right")  # from here on nothing of that size fits beside
    rest = total[half] - total[start] - ((alone - half) * capacity - (total[alone] - total[half]))
    return int(max(-(-total[-1] // capacity), n - half, *(n - half + np.maximum(0, -(-rest // capacity))), n > 0))


def evolve(sizes: list[int], capacity: int, immigrants: list[list[int]], seed: int) -> list[list[int]]:
    """One epoch of one island, whose packings and those that moved in are ``immigrants``; its packings, best first, as container numbers by
    item. It ends early only where no packing has fewer containers."""
    rng = np.random.default_rng(seed)
    n = len(sizes)
    if not n:
        return []
    least = least_containers(sizes, capacity)
    arr = np.array(sizes)
    first = build_even if capacity <= BITS else build
    rank = lambda p: (len(p.bins), -p.score)
    people = sorted((_packing(g, sizes, capacity) for g in immigrants), key=rank)
    if not people:
        people.append(first([int(i) for i in np.argsort(-arr, kind="stable")], sizes, capacity))
    while len(people) < POPULATION and len(people[0].bins) > least:
        # some containers of the first one are kept, the other items packed by best fit in the order of a noisy size
        kept = rng.random(len(people[0].bins)) < 0.7
        bins = [list(x) for x, k in zip(people[0].bins, kept) if k]
        loose = [i for x, k in zip(people[0].bins, kept) if not k for i in x]
        loose.sort(key=dict(zip(loose, -arr[loose] * rng.uniform(0.8, 1.2, len(loose)))).__getitem__)
        left = [r for r, k in zip(people[0].left, kept) if k]
        _best_fit(bins, left, loose, sizes, capacity)
        people.append(Packing(bins, left, capacity))
    people.sort(key=rank)
    for _ in range(GENERATIONS):
        if len(people[0].bins) <= least:
            break
        born = []
        for _ in range(CHILDREN):
            # the better of any two is a parent, the better of any two others its mate
            x, y = int(rng.integers(0, len(people), 2).min()), int(rng.integers(0, len(people) - 1, 2).min())
            born.append(crossover(people[x], people[y + (y >= x)], sizes, capacity, rng))
        for _ in range(MUTANTS):
            born.append(mutate(people[int(rng.integers(0, len(people), 2).min())], sizes, capacity, rng))
        people = sorted(people + born, key=rank)[:POPULATION]
    return [_genome(p, n) for p in people]


def word_count(text: Column) -> Column:
    """Runs of characters other than white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"(?U)[^\s\x1c-\x1f]++")), F.lit(0))


def _pieces(items: DataFrame, kinds: DataFrame) -> DataFrame:
    """Pieces of every item for every kind: one, or for an item above the capacity as many as it fills; ``full`` ones need no packing."""
    c, w = F.col("capacity"), F.col("words")
    every = items.withColumn("k", F.explode(F.array(*[F.struct(F.lit(r["kind"]).alias("kind"), F.lit(int(r["capacity"])).alias("capacity")) for r in kinds.collect()])))
    every = every.select("item_id", "row", "words", "k.kind", "k.capacity")
    count = F.greatest(F.lit(1), F.ceil(w / c)).cast("int")
    cut = every.withColumn("piece", F.explode(F.sequence(F.lit(0), count - 1)))
    return cut.select("kind", "capacity", "item_id", "row", "piece", (F.col("piece") * c).alias("start_word"), F.least(c, w - F.col("piece") * c).alias("words"))


def _pack(loose: DataFrame, level: int, seed: int) -> DataFrame:
    """Containers ``kind, capacity, shard, bin, filled, content`` (the pieces in each) of pieces that need packing."""
    counts = {r["kind"]: r["n"] for r in loose.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    shards = F.coalesce(*[F.when(F.col("kind") == k, F.lit(-(-n // SHARD))) for k, n in counts.items()], F.lit(1))
    dealt = loose.withColumn("shard", F.pmod(F.xxhash64("row", "piece", F.lit(seed + level)), shards))
    rows = checkpointed(dealt.groupBy("kind", "capacity", "shard").agg(F.sort_array(F.collect_list(F.struct("words", "item_id", "piece", "row", "start_word")), False).alias("items")))
    shape = F.transform("items", lambda x: x["words"].cast("int"))
    islands = rows.select("kind", "capacity", "shard", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])).alias("island"), shape.alias("sizes"), F.array().cast("array<array<int>>").alias("people"))
    tasks = max(1, -(-sum(-(-n // SHARD) for n in counts.values()) * ISLANDS // PER_TASK))
    done = []
    for epoch in range(EPOCHS):

        def run(batches: Iterator[pd.DataFrame], epoch: int = epoch) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for kind, capacity, shard, island, sizes, people in zip(*(batch[c] for c in ("kind", "capacity", "shard", "island", "sizes", "people"))):
                    own = [int(x) for x in sizes]
                    best = evolve(own, int(capacity), [[int(y) for y in x] for x in people], seed * 1009 + int(shard) * 31 + int(island) * 7 + epoch)
                    over = max(best[0]) + 1 - least_containers(own, int(capacity))
                    kept = best if over and epoch < EPOCHS - 1 else best[:1]
                    yield pd.DataFrame({"kind": [kind], "capacity": [capacity], "shard": [shard], "island": [island], "over": [over], "people": [kept]})

        spread = islands.repartition(tasks, "kind", "shard", "island")
        bred = checkpointed(spread.mapInPandas(run, "kind string, capacity int, shard long, island int, over int, people array<array<int>>"))
        if epoch == EPOCHS - 1:
            done.append(bred)
            break
        ring = bred.groupBy("kind", "capacity", "shard").agg(F.min("over").alias("over"), F.sort_array(F.collect_list(F.struct("island", "people"))).alias("all"))
        done.append(ring.where(F.col("over") <= 0).select("kind", "shard", F.explode("all").alias("x")).select("kind", "shard", "x.*"))
        # the elite of an island joins the people of the next one
        moved = F.transform("all", lambda x, i: F.struct(x["island"].alias("island"), F.concat(x["people"], F.slice(F.get(F.col("all"), (i + F.lit(ISLANDS - 1)) % F.lit(ISLANDS))["people"], 1, ELITE)).alias("people")))
        unfinished = ring.where(F.col("over") > 0).select("kind", "shard", F.explode(moved).alias("m")).select("kind", "shard", "m.*")
        islands = unfinished.join(rows.select("kind", "capacity", "shard", shape.alias("sizes")), ["kind", "shard"])
    every = done[0].select("kind", "shard", "island", "people")
    for x in done[1:]:
        every = every.unionByName(x.select("kind", "shard", "island", "people"))
    best = every.groupBy("kind", "shard").agg(F.min_by(F.col("people")[0], F.struct(F.array_max(F.col("people")[0]), "island")).alias("bins"))
    packed = rows.join(best, ["kind", "shard"]).select("kind", "capacity", "shard", F.explode(F.arrays_zip("items", "bins")).alias("x"))
    pieces = F.struct("x.items.row", "x.items.piece", "x.items.item_id", "x.items.start_word", "x.items.words")
    return checkpointed(packed.groupBy("kind", "capacity", "shard", F.col("x.bins").alias("bin")).agg(F.sum("x.items.words").alias("filled"), F.sort_array(F.collect_list(pieces)).alias("content")))


def pack(items: DataFrame, kinds: DataFrame, seed: int = 17) -> DataFrame:
    """``container_kind, container_id, position, item_id, piece, start_word, words``: every item in a container of every kind.

    ``items`` has item_id and words (null counts as 0), ``kinds`` container_kind and capacity_words; kinds without a capacity above 0 are
    left out. Repeated rows are packed each by themselves. An item without words takes a place but no room."""
    small = kinds.select(F.col("container_kind").alias("kind"), F.col("capacity_words").alias("capacity")).where("kind IS NOT NULL AND capacity > 0").distinct()
    if small.isEmpty():
        return items.sparkSession.createDataFrame([], "container_kind string, container_id string, position int, item_id bigint, piece int, start_word int, words int")
    numbered = checkpointed(items.select("item_id", F.coalesce("words", F.lit(0)).cast("int").alias("words")).withColumn("row", F.monotonically_increasing_id()))
    pieces = _pieces(numbered, small)
    full = F.col("words") >= F.col("capacity")
    out = pieces.where(full).select("kind", F.concat_ws("-", "kind", F.lit("full"), F.col("row").cast("string"), F.col("piece").cast("string")).alias("container_id"), F.lit(1).alias("position"), "item_id", "piece", "start_word", "words")
    loose = pieces.where(~full)
    for level in range(LEVELS):
        if loose.isEmpty():
            break
        containers = _pack(loose, level, seed)
        good = F.lit(True) if level == LEVELS - 1 else F.col("filled") >= KEEP_FILLED * F.col("capacity")
        name = F.concat_ws("-", "kind", F.lit(str(level)), F.col("shard").cast("string"), F.col("bin").cast("string"))
        content = containers.where(good).select("kind", name.alias("container_id"), F.posexplode("content").alias("p", "x"))
        out = out.unionByName(content.select("kind", "container_id", (F.col("p") + 1).alias("position"), "x.item_id", "x.piece", "x.start_word", "x.words"))
        loose = containers.where(~good).select("kind", "capacity", F.explode("content").alias("x")).select("kind", "capacity", "x.*")
    return out.withColumnRenamed("kind", "container_kind")


def usage(packed: DataFrame, kinds: DataFrame) -> DataFrame:
    """Per kind: containers, words, unused share, and the least number of containers that could hold the words."""
    per = packed.groupBy("container_kind").agg(F.countDistinct("container_id").alias("containers"), F.sum("words").alias("words"))
    capacity = kinds.select("container_kind", F.col("capacity_words").alias("capacity"))
    unused = 1 - F.col("words") / (F.col("containers") * F.col("capacity"))
    return per.join(capacity, "container_kind").select("container_kind", "containers", "words", unused.alias("unused_share"), F.ceil(F.col("words") / F.col("capacity")).alias("least_containers"))


def split_items(packed: DataFrame) -> DataFrame:
    """Items that a kind of container had to split."""
    return packed.where("piece > 0").select("container_kind", "item_id").distinct()
