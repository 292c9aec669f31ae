"""Suffix-array search against brute force, and disguised passages."""

import random

import numpy as np
import pytest

from tracewright.llm import leakage as K


def test_suffix_array():
    rng = np.random.default_rng(3)
    for n in (1, 2, 17, 300):
        s = rng.integers(0, 3, n)
        assert list(K.suffix_array(s, n)) == sorted(range(n), key=lambda i: list(s[i:]))


def brute(string, items, least):
    out = set()
    for p in range(len(string)):
        for q in range(len(items)):
            if p and string[p - 1] and string[p - 1] == items[q - 1]:
                continue
            n = 0
            while p + n < len(string) and q + n < len(items) and string[p + n] == items[q + n] and string[p + n] > 0:
                n += 1
            if n >= least:
                out.add((p, q, n))
    return out


def test_matches_are_brute_force():
    rng = random.Random(5)
    for _ in range(10):
        items = K.Items([(i, " ".join(rng.choice("abc") for _ in range(12)), None) for i in range(3)])
        string = np.array([0, *(rng.randrange(0, 4) for _ in range(120)), 0], dtype=np.int32)
        got = set(zip(*(x.tolist() for x in K.matches(string, items))))
        assert got == brute(string.tolist(), items.string.tolist(), K.ANCHOR)


rng = random.Random(9)
WORDS = [f"w{i}" for i in range(400)]
ITEM = [rng.choice(WORDS) for _ in range(60)]
OTHER = [rng.choice(WORDS) for _ in range(60)]


def fill(n):
    return [rng.choice(WORDS) + "x" for _ in range(n)]


def changed(ws, every):
    out = []
    for i, w in enumerate(ws):
        if i % every == every - 1:
            out += rng.choice([["zz"], [], [w, "zz"], [w[:-1] + "q"]])
        else:
            out.append(w)
    return out


def found(text):
    items = K.Items([(1, " ".join(ITEM[:30]), " ".join(ITEM[30:])), (2, " ".join(OTHER), None)])
    return {r[1] for r in K.search([K.passage_words("unrelated words here"), K.passage_words(text)], items)}


def test_verbatim_length():
    assert found(" ".join(fill(20) + ITEM[24:36] + fill(20))) == {1}
    assert found(" ".join(fill(20) + ITEM[24:35] + fill(20))) == set()
    assert found(" ".join(ITEM[:12] + fill(5) + OTHER[-12:])) == {1, 2}


@pytest.mark.parametrize("every, want", [(5, {1}), (6, {1}), (9, {1}), (2, set())])
def test_changed_words(every, want):
    assert found(" ".join(fill(10) + changed(ITEM[:50], every) + fill(10))) == want


def fewest(passage, text):
    """Fewest changes that turn ``passage`` into some stretch of ``text``."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(passage, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def holds(item, text):
    whole = f" {' '.join(text)} "
    if any(f" {' '.join(item[i : i + K.VERBATIM])} " in whole for i in range(len(item) - K.VERBATIM + 1)):
        return True
    return any(5 * fewest(item[i : i + n], text) <= n for n in range(K.FUZZY, len(item) + 1) for i in range(len(item) - n + 1))


def test_changes_in_clusters():
    item = [f"v{i}" for i in range(30)]
    text, at = [], 0
    for run in (5, 3, 3, 3, 3, 2, 5):  # six words replaced, exactly one in five; only the outer runs are anchors
        text += [*item[at : at + run], "zz"]
        at += run + 1
    items = K.Items([(1, " ".join(item), None)])
    assert K.search([fill(20) + text[:-1] + fill(20)], items)
    begin = item[:4] + ["zz"] * 5 + item[4:25]  # all changes are words put in beside a short run at the item's begin
    assert K.search([fill(20) + begin + fill(20)], items)


def test_changes_against_brute_force():
    r = random.Random(21)
    for n in range(25, 61):
        for kind in ("replaced", "any", "one more"):
            item = [f"v{i}" for i in range(n)]
            k = n // 5 + (kind == "one more")
            heads = [r.randrange(n) for _ in range(r.randrange(1, 4))]
            places = r.sample(range(n), k) if r.random() < 0.5 else sorted(range(n), key=lambda i: min(abs(i - h) for h in heads) + 3 * r.random())[:k]
            text = []
            for i, w in enumerate(item):
                how = r.choice(["replaced", "dropped", "inserted"]) if kind == "any" and i in places else "replaced"
                text += [w] if i not in places else {"replaced": ["zz"], "dropped": [], "inserted": ["zz", w]}[how]
            items = K.Items([(1, " ".join(item), None)])
            assert bool(K.search([fill(12) + text + fill(12)], items)) == holds(item, text), (n, kind)


def test_disguise():
    ws = ITEM[5:25]
    text = "1. " + " ".join(ws[:4]).upper() + "&nbsp;" + f"<b>{ws[4]}</b>, " + "\n> ".join(ws[5:9]) + "\n2) " + "; ".join(ws[9:]).replace("w1", "w１")
    assert found(text) == {1}
    assert K.passage_words("ver-\nbindet Ｅmko ﬁnd­et\n- Straße") == ["verbindet", "emko", "findet", "strasse"]


def test_rows(spark):
    items = spark.createDataFrame([(1, " ".join(ITEM[:30]), " ".join(ITEM[30:])), (3, " ".join(ITEM[:30]), None), (4, None, None), (5, "", "short one")], "item_id long, question string, reference_solution string")
    leak = " ".join(fill(5) + ITEM[2:20])
    rows = [(1, None, 0), (2, "", 0), (3, leak, 0), (3, leak, 0), (4, " ".join(fill(30000)) + " " + leak, 0), (5, "short one", 0)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, item_id int")
    got = sorted((r.doc_id, r.item_id) for r in K.leaked(docs, items).collect())
    assert got == [(3, 1), (3, 1), (3, 3), (3, 3), (4, 1), (4, 3)]
    assert sorted(r.doc_id for r in K.without_leaks(docs, K.leaked(docs, items)).collect()) == [1, 2, 5]
    assert K.leaked(docs.limit(0), items).count() == 0 and K.leaked(docs, items.limit(0)).count() == 0


def test_blocks_change_nothing(spark, monkeypatch):
    items = spark.createDataFrame([(i, " ".join(ITEM[i : i + 14]), None) for i in range(10)], "item_id long, question string, reference_solution string")
    docs = spark.createDataFrame([(1, " ".join(ITEM[:20]))], "doc_id int, text string")
    whole = sorted(r.item_id for r in K.leaked(docs, items).collect())
    monkeypatch.setattr(K, "BLOCK_CHARACTERS", 120)
    assert sorted(r.item_id for r in K.leaked(docs, items).collect()) == whole and len(whole) == 9


def test_a_run_of_words_that_stands_everywhere(monkeypatch):
    """Portions of the places of a hot run change nothing."""
    hot = "what is the total number of"
    items = K.Items([(i, f"{hot} things {i} " + " ".join(f"w{i}x{k}" for k in range(30)), None) for i in range(40)])
    documents = [K.passage_words(f"note {d} {hot} cards. " * 5 + (" ".join(f"w{d}x{k}" for k in range(5, 20)) if d % 10 == 0 else "")) for d in range(60)]
    whole = sorted(K.search(documents, items))
    assert [(r[0], r[1]) for r in whole] == [(d, d) for d in range(0, 40, 10)]
    monkeypatch.setattr(K, "PAIRS", 50)
    assert sorted(K.search(documents, items)) == whole


def test_long_passages_are_followed_to_their_end():
    said = [f"w{i}" for i in range(400)]
    changed = [("x" if i % 8 == 3 else w) for i, w in enumerate(said)]
    [(_, _, verbatim, words, changes, *_)] = K.search([["a", *changed, "b"]], K.Items([(1, " ".join(said), None)]))
    assert verbatim == 7 and words >= 398 and changes == 50
