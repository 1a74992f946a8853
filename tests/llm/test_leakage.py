import random

import numpy as np
import pytest

from lexloom.llm.leakage import EDITS, Items, Leak, edited, leaks
from lexloom.llm.words import words
from lexloom.tables import Scratch


def brute(docs, items, w):
    grams = {}
    for i, t in items:
        ws = words(t)
        for k in range(len(ws) - w + 1):
            grams.setdefault(tuple(ws[k : k + w]), set()).add(i)
    return {(d, i) for d, t in docs for ws in [words(t)] for k in range(len(ws) - w + 1) for i in grams.get(tuple(ws[k : k + w]), ())}


def made(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(80)]
    items = [(f"q{i}", " ".join(rng.choice(vocab) for _ in range(rng.randrange(5, 60)))) for i in range(40)]
    docs = []
    for d in range(200):
        ws = [rng.choice(vocab + ["foreign"]) for _ in range(rng.randrange(0, 80))]
        if rng.random() < 0.5:
            p = words(rng.choice(items)[1])
            a = rng.randrange(len(p))
            part = p[a : a + rng.randrange(1, 40)]
            if part and rng.random() < 0.3:
                part[rng.randrange(len(part))] = "edited"
            k = rng.randrange(len(ws) + 1)
            ws = ws[:k] + part + ws[k:]
        docs.append((d, ", ".join(ws).upper() if d % 7 == 0 else " ".join(ws)))
    return docs, items


def run(spark, docs, items, cfg):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    q = spark.createDataFrame(items, "item_id string, text string")
    return {(r.doc_id, r.item_id): r.edits for r in leaks(d, q, Scratch(spark, "t"), cfg).collect()}


def test_exact_runs_are_all_found(spark):
    docs, items = made(1)
    got = run(spark, docs, items, Leak(window=16))
    want = brute(docs, items, 16)
    assert len(want) > 10
    assert {k for k, e in got.items() if e == 0} == want


def changed(ws, kind, rng):
    k = rng.randrange(len(ws))
    return ws[:k] + (["edited"] if kind != "delete" else []) + ws[k + (kind != "insert") :]


def nearest(ws, window):
    """Fewest edits between the window and any run of words, by the plain table."""
    above = [0] * (len(ws) + 1)
    for i, w in enumerate(window, 1):
        row = [i]
        for j, x in enumerate(ws, 1):
            row.append(min(above[j - 1] + (x != w), above[j] + 1, row[-1] + 1))
        above = row
    return min(above)


@pytest.mark.parametrize("kind", EDITS)
@pytest.mark.parametrize("edits", [1, 2])
def test_edited_windows_reach_the_recall(spark, kind, edits):
    rng = random.Random(2)
    items = [(f"q{i}", " ".join(f"{rng.random()}".replace(".", "x") for _ in range(rng.randrange(16, 24)))) for i in range(300)]
    docs = []
    for k, (_, t) in enumerate(items):
        ws = words(t)[:16]
        for _ in range(edits):
            ws = changed(ws, kind, rng)
        docs.append((k, " ".join(["before"] * rng.randrange(3) + ws + ["after"] * rng.randrange(3))))
    got = run(spark, docs, items, Leak(window=16, edits=edits, recall=0.9))
    assert sum((k, f"q{k}") in got for k in range(300)) >= 270
    for (d, q), e in got.items():
        ws, item = words(docs[d][1]), words(items[int(q[1:])][1])
        assert e == min(nearest(ws, item[k : k + 16]) for k in range(len(item) - 15))


def test_edits_in_dense_texts_are_exact(spark):
    """Every row found has its true number of edits, and few true rows are missed."""
    rng = random.Random(5)
    items = [(f"q{i}", " ".join(rng.choice("abcdefgh") for _ in range(20))) for i in range(12)]
    docs = []
    for d in range(60):
        ws = words(rng.choice(items)[1])
        docs.append((d, " ".join(changed(ws, rng.choice(EDITS), rng)[rng.randrange(3) :])))
    want = {}
    for d, t in docs:
        for q, i in items:
            e = min(nearest(words(t), words(i)[k : k + 16]) for k in range(5))
            if e <= 1:
                want[d, q] = e
    got = run(spark, docs, items, Leak(window=16, edits=1))
    assert set(got) <= set(want) and len(got) >= 0.9 * len(want) and all(got[k] >= want[k] for k in got)


def test_recall_that_no_table_gives_is_an_error():
    items = [("q", " ".join(f"w{i}" for i in range(30)))]
    assert Items(items, Leak(edits=4)).recall >= 0.9
    with pytest.raises(ValueError):
        Items(items, Leak(window=3, edits=2, recall=1.0))


def test_edited_copies():
    rows = np.arange(1, 13).reshape(2, 6)
    rng = np.random.default_rng(1)
    assert edited(rows, "insert", 2, rng).shape == (2, 8) and edited(rows, "delete", 1, rng).shape == (2, 5) and (edited(rows, "replace", 1, rng) == 0).sum() == 2
    assert [r[r > 0].tolist() for r in edited(rows, "insert", 2, rng)] == rows.tolist()


def test_blocks_nulls_and_repeats(spark):
    docs, items = made(3)
    items += [items[0], (None, "x " * 40), ("null", None), ("short", "a b c")]
    docs += [(1000, None), (1001, "")]
    want = brute([x for x in docs if x[1]], [x for x in items if x[0] and x[1]], 16)
    got = run(spark, docs, items, Leak(window=16, edits=0, block_words=200))
    assert set(got) == want
    assert run(spark, docs[:3], [], Leak()) == {} and run(spark, [], items, Leak()) == {}


def test_very_long_text():
    docs, items = made(4)
    longest = max((t for _, t in items), key=len)
    owner, edits = Items(items, Leak()).find("other " * 200_000 + longest)
    assert 0 in edits.tolist() and len(owner) >= 1
