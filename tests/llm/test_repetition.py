"""Repetition against a brute-force count."""

import random

from tracewright.llm.repetition import cleaned, measure, repeated_mask, repetition
from tracewright.llm.words import words


def brute(tokens, run=4):
    covered = set()
    for j in range(len(tokens) - run + 1):
        if any(tokens[i : i + run] == tokens[j : j + run] for i in range(j)):
            covered.update(range(j, j + run))
    return [i in covered for i in range(len(tokens))]


def test_mask_is_brute_force():
    rng = random.Random(1)
    for n in [0, 1, 3, 4, 5, 8, 40, 200]:
        for _ in range(20):
            tokens = [rng.choice("abc") for _ in range(n)]
            assert list(repeated_mask(tokens)) == brute(tokens)


def test_long_text_takes_the_array_path():
    rng = random.Random(2)
    tokens = [str(rng.randrange(40)) for _ in range(6000)]
    seen, want = set(), [False] * len(tokens)
    for i in range(len(tokens) - 3):
        g = tuple(tokens[i : i + 4])
        if g in seen:
            want[i : i + 4] = [True] * 4
        seen.add(g)
    assert list(repeated_mask(tokens)) == want


def test_case_punctuation_and_list_numbers_do_not_count():
    text = "1. The pile has five parts.\n2) THE PILE, has five parts!\n- the pile has\nfive parts"
    n, repeated, share, *_ = measure(text)
    assert (n, repeated) == (15, 10) and abs(share - 2 / 3) < 1e-9
    assert len(words(cleaned(text))) <= 7


def test_line_rules():
    m = measure("Home | Next | Search\n----\nAll rights reserved by us\nA sentence of its own.")
    assert m[1] == 0 and m[5] == 4 and m[6:9] == (1, 1, 1) and m[3] == 8
    assert cleaned("Home | Next | Search\n----\nA sentence of its own.") == "A sentence of its own."


def test_odd_rows(spark):
    rows = [(1, None, "x"), (1, "", "x"), (2, "  \n ", "x"), (3, "a b c d " * 9000, "x"), (3, "one two three four five", None)]
    df = spark.createDataFrame(rows, "id int, t string, n_words string")
    got = sorted((r.id, r.n_words, round(r.repeated_share, 3), r.rejected) for r in repetition(df, "id", "t").collect())
    assert got == [(1, 0, 0.0, False), (1, 0, 0.0, False), (2, 0, 0.0, False), (3, 5, 0.0, False), (3, 36000, 1.0, True)]
    assert repetition(df.limit(0), "id", "t").count() == 0


def test_found_equals_sql(spark, sf):
    from scripts.compare import compare

    assert ": same" in compare(spark, sf, "p2_found")
