import numpy as np
import pytest

from lexloom.llm.vectors import Similar, most_similar
from lexloom.tables import Scratch

ROW = "id string, space string, vec array<double>"


def clustered(n, dims=16, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 12 + 1, dims))
    x = centres[rng.integers(0, len(centres), n)] + 0.35 * rng.normal(size=(n, dims))
    return x * rng.uniform(0.2, 30, (n, 1))


def brute(ids, x, cfg):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 12)
    np.fill_diagonal(s, -2)
    out = {}
    for i, a in enumerate(ids):
        best = sorted(((-s[i, j], b) for j, b in enumerate(ids) if j != i and s[i, j] >= cfg.least))[: cfg.k]
        out[a] = [b for _, b in best]
    return out


def run(spark, rows, cfg):
    got = {}
    for r in most_similar(spark.createDataFrame(rows, ROW), Scratch(spark, "t"), cfg).orderBy("id", "place").collect():
        got.setdefault(r.id, []).append(r.other)
    return got


@pytest.mark.parametrize("least", [-1.0, 0.8])
def test_recall_against_brute_force(spark, least):
    cfg = Similar(k=5, least=least, dims=16, leaf_rows=40, branch=4, recall=0.98)
    x = clustered(900)
    ids = [f"v{i:04}" for i in range(len(x))]
    rows = [(i, "m", v.tolist()) for i, v in zip(ids, x)]
    got, want = run(spark, rows, cfg), brute(ids, x, cfg)
    hit = sum(len(set(got.get(i, ())) & set(w)) for i, w in want.items())
    assert hit >= 0.95 * sum(map(len, want.values()))


def test_spaces_unusable_rows_and_copies(spark):
    cfg = Similar(k=2, least=0.9, dims=2)
    nan, inf = float("nan"), float("inf")
    rows = [
        ("a", "m", [1.0, 0.0]), ("b", "m", [2.0, 0.0]), ("c", "m", [0.5, 0.0]), ("d", "m", [3.0, 0.0]), ("near", "m", [1.0, 0.1]), ("far", "m", [0.0, 1.0]), ("other", "n", [1.0, 0.0]), ("null space", None, [1.0, 0.0]),
        ("short", "m", [1.0]), ("null entry", "m", [1.0, None]), ("nan", "m", [nan, 1.0]), ("inf", "m", [inf, 1.0]), ("zero", "m", [0.0, 0.0]), ("none", "m", None), (None, "m", [1.0, 0.0]),
    ]
    assert run(spark, rows, cfg) == {"a": ["b", "c"], "b": ["a", "c"], "c": ["a", "b"], "d": ["a", "b"], "near": ["a", "b"]}
    assert run(spark, [], cfg) == {}


def test_one_direction_holds_most_rows(spark):
    cfg = Similar(k=3, least=0.5, dims=16, leaf_rows=40, block=100)
    x = clustered(300, seed=2)
    rows = [(f"v{i:03}", "m", v.tolist()) for i, v in enumerate(x)] + [(f"hot{i:04}", "m", (x[0] * (i + 1)).tolist()) for i in range(600)]
    got = run(spark, rows, cfg)
    assert got["hot0599"] == ["hot0000", "hot0001", "hot0002"] and got["hot0000"] == ["hot0001", "hot0002", "hot0003"] and got["v000"] == ["hot0000", "hot0001", "hot0002"]


@pytest.mark.parametrize("jitter", [1e-8, 1e-5])
def test_near_copies_closer_than_single_precision(spark, jitter):
    cfg = Similar(k=5, least=0.8, dims=16)
    rng = np.random.default_rng(3)
    x = rng.normal(size=16) + jitter * rng.normal(size=(300, 16))
    ids = [f"v{i:04}" for i in rng.permutation(300)]
    got, want = run(spark, [(i, "m", v.tolist()) for i, v in zip(ids, x)], cfg), brute(ids, x, cfg)
    assert sum(len(set(got[i]) & set(w)) for i, w in want.items()) >= 0.99 * sum(map(len, want.values()))


def test_walk_opens_only_near_branches():
    """Leaves come nearest first, far branches are never compared, and radii keep all within reach."""
    from lexloom.llm.vectors import Tree

    x = clustered(4000, seed=4)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree, cfg = Tree(x, 300, 4), Similar(dims=16, least=0.8)
    leaf, cos = tree.assign(x)
    every = np.unique(leaf)
    tree.fill(every, np.bincount(leaf)[every], np.stack([cos[leaf == i].min(0) for i in every]))
    q = x[:200]
    opened = []
    plain = tree.kids
    tree.kids = type("Counted", (list,), {"__getitem__": lambda self, i: opened.append(i) or list.__getitem__(self, i)})(plain)
    walked = tree.walk(q, 10, cfg)
    branches = sum(bool(k) for k in plain)
    assert len(set(opened)) <= branches and max(map(len, walked)) == 10
    found = tree.walk(q, tree.n_leaves, cfg)
    assert np.mean([len(f) for f in found]) < 0.7 * tree.n_leaves
    for i, f in enumerate(found):
        near = set(leaf[x @ q[i] >= 0.8].tolist())
        assert near <= set(f) and len(set(f)) == len(f)
    angles = np.arccos(np.clip((q[:, None, :] * tree.leaf_centre[[f[0] for f in walked]][:, None, :]).sum(2)[:, 0], -1, 1))
    best = np.arccos(np.clip((q @ tree.leaf_centre.T).max(1), -1, 1))
    assert np.mean(angles <= best + 0.2) > 0.9
    assert set(tree.cells(100)) <= set(range(len(plain))) and all(tree.rows[c] <= 100 or c in tree.leaf_node for c in tree.cells(100))


@pytest.mark.parametrize("least", [-1.0, 0.8])
def test_crowded_leaves_get_trees(spark, least):
    """Four leaves for 2,000 rows, so that nearly all is found in trees of the second level, some of
    whose leaves are split into blocks."""
    cfg = Similar(k=5, least=least, dims=16, leaf_rows=20, branch=4, recall=0.98, sample=400, most_leaves=4, block=60, leaf_sample=200, route_rows=150, cell_rows=50)
    x = clustered(2000, seed=9)
    x[1500:] = x[0] + 0.02 * np.random.default_rng(1).normal(size=(500, 16))
    ids = [f"v{i:04}" for i in range(len(x))]
    got, want = run(spark, [(i, "m", v.tolist()) for i, v in zip(ids, x)], cfg), brute(ids, x, cfg)
    hit = sum(len(set(got.get(i, ())) & set(w)) for i, w in want.items())
    assert hit >= 0.93 * sum(map(len, want.values()))
    exact = sum(got.get(i) == w for i, w in want.items())
    assert exact >= 0.8 * len(want)
