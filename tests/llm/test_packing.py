"""Packings are valid, split only what is too long, and stay close to the least number of containers."""

import random

import numpy as np
from pyspark.sql import functions as F

from tracewright.llm import packing as P

KINDS = [("small", 50), ("large", 400), (None, 10), ("none", 0)]


def check(items, packed, capacity):
    by_bin, by_item = {}, {}
    for r in packed:
        by_bin.setdefault(r.container_id, []).append(r)
        by_item.setdefault(r.item_id, []).append(r)
    for rs in by_bin.values():
        assert sum(r.words for r in rs) <= capacity
        assert sorted(r.position for r in rs) == list(range(1, len(rs) + 1))
    assert {i: sum(r.words for r in rs) for i, rs in by_item.items()} == items
    for i, rs in by_item.items():
        assert len(rs) == max(1, -(-items[i] // capacity)) and sorted(r.start_word for r in rs) == [k * capacity for k in range(len(rs))]


def test_packing(spark):
    rng = random.Random(6)
    items = {i: int(min(900, rng.lognormvariate(3, 0.8))) for i in range(5000)} | {9001: 0, 9002: 50, 9003: 400, 9004: 12345}
    df = spark.createDataFrame(list(items.items()), "item_id bigint, words int").withColumn("kind", F.lit("clash"))
    kinds = spark.createDataFrame(KINDS, "container_kind string, capacity_words int")
    packed = P.pack(df, kinds).cache()
    for kind, capacity in KINDS[:2]:
        check(items, packed.where(F.col("container_kind") == kind).collect(), capacity)
    assert {(r.container_kind, r.item_id) for r in P.split_items(packed).collect()} == {(k, i) for k, c in KINDS[:2] for i, w in items.items() if w > c}
    for r in P.usage(packed, kinds).collect():
        assert r.containers <= 1.06 * r.least_containers
    assert packed.select("container_kind").distinct().count() == 2


def test_the_search_gains_on_best_fit():
    rng = random.Random(8)
    sizes = [rng.randrange(40, 120) for _ in range(600)]
    greedy = len(P.build(sorted(range(600), key=lambda i: -sizes[i]), sizes, 192).bins)
    elite = P.evolve(sizes, 192, P.evolve(sizes, 192, [], 1), 2)
    best = P._packing(elite[0], sizes, 192)
    assert sorted(i for x in best.bins for i in x) == list(range(600)) and min(best.left) >= 0 and len(best.bins) < greedy


def test_repeated_and_empty(spark):
    kinds = spark.createDataFrame(KINDS[:1], "container_kind string, capacity_words int")
    df = spark.createDataFrame([(1, 30)] * 7 + [(2, None)], "item_id bigint, words int")
    packed = P.pack(df, kinds)
    assert packed.count() == 8 and packed.agg(F.sum("words")).first()[0] == 210
    assert P.pack(df.limit(0), kinds).count() == 0 and P.pack(df, kinds.limit(0)).count() == 0


def test_words(spark):
    df = spark.createDataFrame([(None, 0), ("", 0), (" a\tb\xa0c\n", 3), ("x", 1)], "t string, n int")
    assert df.where(P.word_count(F.col("t")) != F.col("n")).count() == 0


def test_found_equals_sql(spark, sf):
    from scripts.compare import compare

    assert ": same" in compare(spark, sf, "p5_found")


def test_even_packings_are_whole_and_close():
    rng = random.Random(4)
    for capacity in (1, 7, 192, 512, 20_000):
        sizes = [rng.randrange(0, min(capacity, 140) + 1) for _ in range(700)]
        packing = P.build_even(list(range(700)), sizes, capacity)
        assert sorted(i for x in packing.bins for i in x) == list(range(700))
        assert all(sum(sizes[i] for i in x) + r == capacity and r >= 0 for x, r in zip(packing.bins, packing.left))
    sizes = [int(rng.triangular(40, 136, 50)) for _ in range(2000)]
    assert len(P.build_even(sorted(range(2000), key=lambda i: -sizes[i]), sizes, 192).bins) <= 1.02 * sum(sizes) / 192
    assert P.build_even([], [], 10).bins == [] and P.build_even([0, 1], [0, 0], 10).bins == [[0, 1]]


def triangular(n, seed):
    rng = random.Random(seed)
    return sorted((int(rng.triangular(40, 136, 50)) for _ in range(n)), reverse=True)


def test_a_packing_one_over_the_least_is_bred_further(spark):
    for n, capacity, seed in ((300, 192, 7), (400, 512, 11)):
        sizes = triangular(n, seed)
        least = -(-sum(sizes) // capacity)
        assert len(P.build_even(list(range(n)), sizes, capacity).bins) == least + 1
        assert max(P.evolve(sizes, capacity, [], 1)[0]) + 1 == least
        kinds = spark.createDataFrame([("one", capacity)], "container_kind string, capacity_words int")
        packed = P.pack(spark.createDataFrame(list(enumerate(sizes)), "item_id bigint, words int"), kinds)
        assert [r.containers for r in P.usage(packed, kinds).collect()] == [least]


def test_an_island_keeps_its_packings_between_epochs():
    sizes = triangular(300, 4)  # one over the bound after an epoch
    people = P.evolve(sizes, 192, [], 1)
    assert len(people) == P.POPULATION and len({tuple(x) for x in people}) > 1
    counts = [max(x) + 1 for x in people]
    assert counts == sorted(counts) and max(P.evolve(sizes, 192, people, 2)[0]) + 1 <= counts[0]


def test_children_and_mutants_are_whole():
    rng = np.random.default_rng(5)
    for capacity in (192, 5000, 100_000):
        sizes = [int(x) for x in rng.integers(0, capacity // 2, 300)]
        a, b = P.build(list(range(300)), sizes, capacity), P.build(list(range(299, -1, -1)), sizes, capacity)
        before = [list(x) for x in a.bins]
        for p in (P.crossover(a, b, sizes, capacity, rng), P.mutate(a, sizes, capacity, rng)):
            assert sorted(i for x in p.bins for i in x) == list(range(300)) and a.bins == before
            assert all(sum(sizes[i] for i in x) + r == capacity and r >= 0 for x, r in zip(p.bins, p.left))


def test_loose_items_replace_items_of_a_container_they_fill_better():
    sizes = [40, 30, 20, 60, 35]
    for unit in (1, 1000):
        bins, left = [[0, 1, 2]], [10 * unit]
        loose = P.replace(bins, left, [3, 4], [s * unit for s in sizes])
        assert sorted(bins[0] + loose) == [0, 1, 2, 3, 4] and sum(sizes[i] for i in bins[0]) == 100 and left == [0]


def test_no_packing_has_fewer_than_the_least_containers():
    def fits(sizes, room):
        return not sizes or any(r >= sizes[0] and r not in room[:b] and fits(sizes[1:], [*room[:b], r - sizes[0], *room[b + 1 :]]) for b, r in enumerate(room))

    rng = random.Random(3)
    for _ in range(300):
        capacity = rng.randrange(1, 30)
        sizes = sorted((rng.randrange(0, capacity + 1) for _ in range(rng.randrange(1, 9))), reverse=True)
        best = next(k for k in range(1, 10) if fits(sizes, [capacity] * k))
        assert P.least_containers(sizes, capacity) <= best == max(P.evolve(sizes, capacity, [], 1)[0]) + 1
    assert P.least_containers([60] * 5, 100) == 5 and P.least_containers([0, 0], 9) == 1
