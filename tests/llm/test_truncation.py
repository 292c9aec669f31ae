"""Truncation on a small corpus whose cuts are known."""

import json
import random

from pyspark.sql import functions as F

from tracewright.llm import truncation as X

SENTENCES = ["The total of {} and {} is {}.", "We move {} boxes to the other room.", "Half of {} is about {}.", "Nobody noticed that {} coins were counted twice.", "Result = {}"]


def corpus(n=1500, seed=3):
    rng = random.Random(seed)
    rows, cut = [], set()
    for i in range(n):
        parts = [s.format(*(rng.randrange(10, 999) for _ in range(3))) for s in rng.sample(SENTENCES[:4], 3)]
        text = " ".join(parts)
        kind = rng.random()
        source = rng.choice("ab")
        if kind < 0.1:
            text += " " + SENTENCES[4].format(rng.randrange(99))
        elif kind < 0.2:
            text = text[:-1]
        elif kind < 0.3:
            last = parts[-1].split()
            text = " ".join(parts[:2] + last[: max(1, len(last) // 2)])[: -1 if last[len(last) // 2 - 1][-1].isalpha() else None]
            cut.add(i)
        elif kind < 0.35:
            text = " ".join(parts[:2]) + " " + parts[2][:9] + rng.choice(["…", "...", " [...]", "�"])
            cut.add(i)
        rows.append((i, source, "f", text))
    return rows, cut


def test_cuts_are_found(spark):
    rows, cut = corpus()
    odd = [(-1, "a", "f", None), (-2, "a", "f", ""), (-3, "a", "f", "N/A"), (-4, None, "f", "​ "), (-5, "a", "f", "..."), (-6, "b", "f", "word " * 20000 + "done.")]
    df = spark.createDataFrame(rows + odd, "id int, source string, field_name string, text string").withColumn("evidence", F.lit(1)).withColumn("limit", F.lit(1)).withColumn("encoding", F.lit("x"))
    got = {r.id for r in X.truncated(df).collect()}
    assert len(got - cut) <= 0.03 * len(cut) and len(cut - got) <= 0.03 * len(cut)
    assert not any(i < 0 for i in got)


def test_rates_and_repeats(spark):
    rows, cut = corpus(400)
    df = spark.createDataFrame(rows + rows, "id int, source string, field_name string, text string")
    found = X.truncated(df)
    rates = X.cut_rates(df, found).collect()
    assert sum(r.n_values for r in rates) == 800 and sum(r.n_cut for r in rates) == found.count() and found.count() % 2 == 0


def test_limits_by_encoding(spark):
    rng = random.Random(5)
    rows = []
    for i in range(600):
        text = "".join(rng.choice("abc déß ") for _ in range(rng.randrange(20, 90)))
        raw = text.encode()[:60].decode(errors="ignore")
        rows.append((i, "bytes", "f", raw if len(text.encode()) > 60 else text + "."))
        tagged = "".join(rng.choice("ab&\n ") for _ in range(rng.randrange(20, 90)))
        while len(tagged) + 4 * tagged.count("&") > 70:
            tagged = tagged[:-1]
            done = True
        rows.append((i, None, "f", "x" + tagged + "z"))
    df = spark.createDataFrame(rows, "id int, source string, field_name string, text string")
    found = {r.source: (r.encoding, r.limit) for r in X.hidden_limits(df).collect()}
    assert found["bytes"] == ("utf8_bytes", 60)


def test_every_limit_is_kept(spark):
    """Three limits in one source, one in a source of mostly complete values without full stop; one text told often is none."""
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdefgé&\n ") for _ in range(n - 2)).join("xz")
    sizes = [*[("a", 200)] * 90, *[("a", 140)] * 40, *[("a", 150)] * 30, *[(None, 300)] * 20, *[("b", 120)] * 15]
    sizes += [("a", rng.randrange(20, 100)) for _ in range(60)] + [(None, rng.randrange(20, 280)) for _ in range(600)]
    rows = [(i, s, "f", text(n)) for i, (s, n) in enumerate(sizes)] + [(-1, None, "f", "no answer was given here and none will be " * 8)] * 20
    df = spark.createDataFrame(rows, "id int, source string, field_name string, text string")
    got = sorted((r.source or "", r.encoding, r.limit, r.values_at_limit) for r in X.hidden_limits(df).collect())
    assert got == [("", "characters", 300, 20), ("a", "characters", 140, 40), ("a", "characters", 150, 30), ("a", "characters", 200, 90), ("b", "characters", 120, 15)]


def test_values_at_every_limit_are_cut(spark):
    rng = random.Random(2)
    rows = []
    for i, n in enumerate([70] * 60 + [46] * 30 + [None] * 300):
        text = "".join(f"Box {rng.randrange(10, 99)} holds the blue cards. " for _ in range(5))
        if n:  # the last words look complete: only the length tells
            text = (text[: n - len(end)] + end) if (end := " the blue cards") else text
        else:
            text = text.strip() if i % 3 else text.strip()[:-1] + "s" * rng.randrange(1, 40)
        rows.append((i, "s", "f", text))
    df = spark.createDataFrame(rows, "id int, source string, field_name string, text string")
    cut = {r.id: r.evidence for r in X.truncated(df).collect()}
    assert all(i in cut for i in range(90)) and {"limit"} <= {cut[i] for i in range(60)} & {cut[i] for i in range(60, 90)}


def test_lengths(spark):
    text = 'é"&\n😀'
    df = spark.createDataFrame([(text,)], "t string").select(*[c.alias(k) for k, c in X.lengths(F.col("t")).items()])
    want = {"characters": 5, "utf8_bytes": 9, "utf16_units": 6, "html_characters": 14, "html_bytes": 18, "json_characters": 7, "json_bytes": 11, "json_ascii": 17, "crlf_characters": 6, "crlf_bytes": 10}
    assert df.first().asDict() == want


def test_empty_tables(spark):
    df = spark.createDataFrame([], "id int, source string, field_name string, text string")
    assert X.truncated(df).count() == 0 and X.hidden_limits(df).count() == 0 and X.cut_rates(df, X.truncated(df)).count() == 0


def test_limits_in_every_encoding_decide(spark):
    """Values cut where a store counts bytes, HTML or JSON; their last words may look whole. The limit is named and is the evidence."""
    import html
    import random

    size = {
        "utf8_bytes": lambda t: len(t.encode()), "html_characters": lambda t: len(html.escape(t).replace("&#x27;", "&apos;").replace("&#39;", "&apos;")),
        "json_characters": lambda t: len(json.dumps(t, ensure_ascii=False)) - 2, "crlf_characters": lambda t: len(t) + t.count("\n"),
    }
    special = {"utf8_bytes": "é", "html_characters": "&", "json_characters": '"', "crlf_characters": "\n"}
    rng = random.Random(3)
    rows = []
    for name, count in size.items():
        for i in range(120):
            words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 8))) for _ in range(40)]
            quoted = lambda: '"' if name == "crlf_characters" and rng.random() < 0.2 else ""  # noqa: E731  (else JSON escapes count as line ends do)
            text = "".join(w + quoted() + (special[name] if rng.random() < 0.3 else "") + " " for w in words).strip()
            if i % 3 == 0:
                while count(text) > 90:
                    text = text[:-1]
                if count(text) < 90 or text != text.strip():  # an escape stands over the limit, or the cut is at a blank
                    continue
            else:
                text = text[: rng.randrange(40, 160)].strip() + "."
            rows.append((len(rows), name, "f", text))
    df = spark.createDataFrame(rows, "k int, source string, field_name string, text string")
    found = {(r.source, r.encoding, r.limit) for r in X.hidden_limits(df).collect()}
    assert found == {(name, name, 90) for name in size}
    cut = {r.k: r.evidence for r in X.truncated(df).collect()}
    at = {k for k, name, _, t in rows if t[-1] != "." and size[name](t) == 90}
    assert at and all(cut.get(k) == "limit" for k in at)


def test_ends_behind_long_blanks_and_brackets(spark):
    """What stands far from the last letter counts, too."""
    said = {1: "It goes on [" + " " * 60 + "truncated" + " " * 60 + "]", 2: "All is said." + '"' * 80, 3: "All is said here. " * 30 + "And then it goes [...]", 4: "#" * 200 + "n/a" + "#" * 200}
    df = spark.createDataFrame([(k, "s", "f", t) for k, t in said.items()], "k int, source string, field_name string, text string")
    assert {r.k: r.evidence for r in X.truncated(df).collect()} == {1: "mark", 3: "mark"}
    assert [r.k for r in df.where(X.is_empty(F.col("text"))).collect()] == [4]
