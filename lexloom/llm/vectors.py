"""Most similar vectors for every vector, by a hierarchical k-means tree.

A tree of k-means centres is grown on a bounded sample, its leaves are settled by a few rounds of
k-means over all of them, and every row is filed under the leaf of the nearest centre. Each query
walks the tree best bin first: a priority queue holds the branches seen so far by the angle to their
centre, less a share of how far their leaves spread, and only the branch at its head is opened.
Branches that hold no row within the asked similarity are never opened: every node knows the widest
angle between its centre and a row below it. How many leaves a query visits is calibrated: exact
neighbours of sampled queries are found by brute force over all rows, and the number of visits is
widened until the wanted share of them lies in visited leaves. A query travels once to each cell, a
branch of a few leaves, with the list of leaves it visits there.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.crowded import Crowded
from lexloom.llm.spread import spread
from lexloom.tables import Scratch


@dataclass(frozen=True)
class Similar:
    """``k`` most similar rows by cosine, of similarity at least ``least``."""

    k: int = 10
    least: float = -1.0
    dims: int = 64
    #: Share of the true neighbours of the calibration queries that must be in visited leaves.
    recall: float = 0.999
    branch: int = 16
    leaf_rows: int = 200
    #: Rows on which the tree is grown, of all spaces together, and the most leaves it may get.
    sample: int = 40_000
    most_leaves: int = 4096
    #: Queries of the calibration, of all spaces together.
    calibrate: int = 256
    #: Share of the spread of a branch's leaves by which it is taken to be nearer than its centre.
    boundary: float = 0.4
    #: Rows of a cell, the branch whose leaves are searched in one place (16 MB of 64 numbers). Its
    #: queries are spread over several tasks, each with a copy of the cell, where cells are few.
    cell_rows: int = 32_000
    #: Rows of a leaf that are searched as a whole; a leaf of more gets a tree of its own, grown on
    #: about this many of its rows, and copies of it for each ``route_rows`` of them.
    block: int = 4_000
    leaf_sample: int = 8_000
    route_rows: int = 100_000


class Tree:
    """K-means centres of one space (unit vectors); leaves are numbered from 0."""

    def __init__(self, sample: np.ndarray, leaves: int, branch: int, seed: int = 7):
        self.kids: list[list[int]] = []
        self.leaf: list[int] = []
        centre: list[np.ndarray] = []
        rng = np.random.default_rng(seed)

        def add(c: np.ndarray) -> int:
            centre.append(c)
            self.kids.append([])
            self.leaf.append(-1)
            return len(centre) - 1

        root = add(sample.mean(0) if len(sample) else np.zeros(1))
        heap, n_leaves = [(-len(sample), root, sample)], 1
        done: list[int] = []
        while heap:
            _, node, x = heapq.heappop(heap)
            k = min(branch, leaves - n_leaves + 1, len(x) // 4)
            parts = self._kmeans(x, k, rng) if k >= 2 else []
            if len(parts) < 2:
                done.append(node)
                continue
            n_leaves += len(parts) - 1
            for c, own in parts:
                kid = add(c)
                self.kids[node].append(kid)
                heapq.heappush(heap, (-len(own), kid, own))
        for i, node in enumerate(sorted(done)):
            self.leaf[node] = i
        self.n_leaves, self.leaf_node = len(done), np.array(sorted(done))
        self.leaf_centre = np.stack(centre)[self.leaf_node]
        for _ in range(2 if self.n_leaves > 1 else 0):
            own = (sample @ self.leaf_centre.T).argmax(1)
            c = np.zeros_like(self.leaf_centre)
            np.add.at(c, own, sample)
            size = np.linalg.norm(c, axis=1, keepdims=True)
            self.leaf_centre = np.where(size > 0, c / np.where(size > 0, size, 1), self.leaf_centre)
        self._settle(np.stack(centre))

    def _settle(self, centre: np.ndarray) -> None:
        """Centres of branches from those of their leaves, and how far these spread. Children of a
        node stand side by side, after their parent."""
        n, sums = len(centre), np.zeros_like(centre)
        self.parent, self.spread = np.full(n, -1), np.zeros(n)
        for node, kids in enumerate(self.kids):
            self.parent[kids] = node
        sums[self.leaf_node] = self.leaf_centre
        for node in range(n - 1, 0, -1):
            sums[self.parent[node]] += sums[node]
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        self.centre = np.where(size > 0, sums / np.where(size > 0, size, 1), centre)
        self.paths = []
        for leaf, node in enumerate(self.leaf_node):
            path = [node]
            while self.parent[path[-1]] >= 0:
                path.append(self.parent[path[-1]])
            self.paths.append(path[::-1])
            for up in path[1:]:
                cos = float(np.clip(self.centre[up] @ self.leaf_centre[leaf], -1, 1))
                self.spread[up] = max(self.spread[up], np.arccos(cos))
        self.depth = max(map(len, self.paths))

    @staticmethod
    def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> list[tuple[np.ndarray, np.ndarray]]:
        c = x[rng.choice(len(x), k, replace=False)]
        for _ in range(8):
            own = (x @ c.T).argmax(1)
            c = np.stack([x[own == j].sum(0) if (own == j).any() else c[j] for j in range(k)])
            n = np.linalg.norm(c, axis=1, keepdims=True)
            c = c / np.where(n > 0, n, 1)
        own = (x @ c.T).argmax(1)
        return [(c[j], x[own == j]) for j in range(k) if (own == j).any()]

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaf of each row, and its cosine with the centres from the root to the leaf (which fills
        the places below it)."""
        leaf, cos = np.zeros(len(x), np.int32), np.ones((len(x), self.depth))
        table = np.array([p + [p[-1]] * (self.depth - len(p)) for p in self.paths])
        for lo in range(0, len(x), 2000):
            part = x[lo : lo + 2000]
            leaf[lo : lo + 2000] = (part @ self.leaf_centre.T).argmax(1)
            for level in range(self.depth):
                cos[lo : lo + 2000, level] = np.einsum("ij,ij->i", part, self.centre[table[leaf[lo : lo + 2000], level]])
        return leaf, cos

    def fill(self, leaves: np.ndarray, n: np.ndarray, cos: np.ndarray) -> None:
        """Takes in, for each leaf with rows, their number and their least cosine by level."""
        self.rows, self.radius = np.zeros(len(self.kids), np.int64), np.zeros(len(self.kids))
        for leaf, k, least in zip(leaves, n, np.arccos(np.clip(cos, -1, 1))):
            for level, node in enumerate(self.paths[leaf]):
                self.rows[node] += k
                self.radius[node] = max(self.radius[node], least[level])

    def cells(self, most: int) -> np.ndarray:
        """For each leaf the highest branch above it of at most ``most`` rows, or the leaf itself."""
        return np.array([next((v for v in p if self.rows[v] <= most), p[-1]) for p in self.paths])

    def walk(self, x: np.ndarray, visits: int, cfg: Similar) -> list[list[int]]:
        """Leaves that each query (a row) visits, best bin first. Queries that open the same branch at
        the same time compare with its children together."""
        limit, serial = np.arccos(cfg.least) + 1e-4, 0
        heaps: list[list] = [[] for _ in range(len(x))]
        out: list[list[int]] = [[] for _ in range(len(x))]
        if self.leaf[0] >= 0:
            return [[0] if self.rows[0] else [] for _ in range(len(x))]
        todo = {0: list(range(len(x)))}
        while todo:
            then: dict[int, list[int]] = defaultdict(list)
            for node, who in todo.items():
                a, b = self.kids[node][0], self.kids[node][-1] + 1
                angle = np.arccos(np.clip(x[who] @ self.centre[a:b].T, -1, 1))
                key = np.where((angle - self.radius[a:b] > limit) | (self.rows[a:b] == 0), np.inf, angle - cfg.boundary * self.spread[a:b])
                order = np.argsort(key, axis=1, kind="stable")
                for q, keys, kids in zip(who, np.take_along_axis(key, order, 1).tolist(), (order + a).tolist()):
                    serial += 1
                    if keys[0] < np.inf:
                        heapq.heappush(heaps[q], (keys[0], serial, 0, keys, kids))
            for q in [q for who in todo.values() for q in who]:
                heap, mine = heaps[q], out[q]
                while heap and len(mine) < visits:
                    _, tie, at, keys, kids = heap[0]
                    if at + 1 < len(keys) and keys[at + 1] < np.inf:
                        heapq.heapreplace(heap, (keys[at + 1], tie, at + 1, keys, kids))
                    else:
                        heapq.heappop(heap)
                    leaf = self.leaf[kids[at]]
                    if leaf < 0:
                        then[kids[at]].append(q)
                        break
                    mine.append(leaf)
            todo = then
        return out


def _unit(b: pa.RecordBatch, col: int) -> np.ndarray:
    a = b.column(col)
    x = a.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _smallest(keyed: DataFrame, n: int) -> DataFrame:
    """The ``n`` smallest ids of each group, in two steps, so that no task holds a large group."""
    part = Window.partitionBy("space", "gid", "salt").orderBy("id")
    return (
        keyed.select("space", "gid", "id", F.expr("pmod(xxhash64(id), 64)").alias("salt"))
        .withColumn("r", F.row_number().over(part)).where(F.col("r") <= n)
        .groupBy("space", "gid").agg(F.slice(F.array_sort(F.collect_list("id")), 1, n).alias("ids"))
    )


def _best(met: DataFrame, n: int, tie: str = "other") -> DataFrame:
    w = Window.partitionBy("space", "gid").orderBy(F.col("s").desc(), tie)
    return met.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).drop("r")


def _first(r: np.ndarray, c: np.ndarray, v: np.ndarray, tie: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row ``r`` the ``keep`` entries of largest ``v``, equal ones by ``tie``."""
    order = np.lexsort((tie, -v, r))
    r, c, v = r[order], c[order], v[order]
    start = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else np.empty(0, np.int64)
    rank = np.arange(len(r)) - np.repeat(start, np.diff(np.r_[start, len(r)]))
    return r[rank < keep], c[rank < keep], v[rank < keep]


def _widened(place: np.ndarray, most: int, recall: float) -> int:
    """Visits that reach the wanted share of the places."""
    visits = 2
    while visits < most and len(place) and (place < visits).mean() < recall:
        visits += max(1, visits // 4)
    return int(min(visits, most)) if len(place) else most


def _calibrate(filed: DataFrame, trees: dict[str, Tree], cfg: Similar) -> tuple[dict[str, int], pd.DataFrame]:
    """Leaves to visit in each space: widened until the neighbours found by brute force for the
    sampled queries are in visited leaves to the wanted share. Also those neighbours."""
    spark = filed.sparkSession
    asked = filed.where(F.col("space").isin(list(trees))).orderBy(F.xxhash64("gid", F.lit(1)), "gid").limit(cfg.calibrate).select("space", "gid", "v").toPandas()
    queries = {s: (g["gid"].to_numpy(), np.stack(g["v"].to_numpy())) for s, g in asked.groupby("space")}
    shared = spark.sparkContext.broadcast(queries)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            spaces, gid, leaf = np.array(b.column(0).to_pylist(), dtype=object), b.column(1).to_numpy(), b.column(3).to_numpy()
            x = b.column(2).flatten().to_numpy().reshape(b.num_rows, -1)
            for s, (qid, q) in shared.value.items():
                at = np.flatnonzero(spaces == s)
                if not len(at):
                    continue
                sims = q @ x[at].T
                sims[qid[:, None] == gid[at][None, :]] = -2
                keep = min(cfg.k, len(at))
                top = np.argpartition(-sims, keep - 1, axis=1)[:, :keep]
                v = np.take_along_axis(sims, top, 1)
                r, c = np.nonzero((v >= cfg.least) & (v > -1.5))
                yield pa.RecordBatch.from_arrays([pa.array([s] * len(r), pa.string()), pa.array(qid[r]), pa.array(gid[at][top[r, c]]), pa.array(v[r, c].astype(np.float32)), pa.array(leaf[at][top[r, c]])], names=["space", "gid", "other", "s", "leaf"])

    true = _best(filed.mapInArrow(scan, "space string, gid bigint, other bigint, s float, leaf int"), cfg.k).toPandas()
    out = {}
    for s, tree in trees.items():
        out[s] = tree.n_leaves
        if s in queries:
            qid, q = queries[s]
            order = {g: {leaf: i for i, leaf in enumerate(o)} for g, o in zip(qid, tree.walk(q, tree.n_leaves, cfg))}
            mine = true[true["space"] == s]
            place = np.array([order[g].get(leaf, tree.n_leaves) for g, leaf in zip(mine["gid"], mine["leaf"])])
            out[s] = _widened(place, tree.n_leaves, cfg.recall)
    vectors = {(s, g): v for s, (qid, q) in queries.items() for g, v in zip(qid, q)}
    true["v"] = [vectors[k].tolist() for k in zip(true["space"], true["gid"])]
    return out, true


def _grow(base: DataFrame, cfg: Similar, total: int) -> dict[str, Tree]:
    """A tree for each space with rows in the sample; other spaces are one leaf."""
    sample = base.orderBy(F.xxhash64("gid"), "gid").limit(cfg.sample).select("space", "vec").toPandas()
    trees = {}
    for space, part in sample.groupby("space"):
        x = np.stack(part["vec"].to_numpy()).astype(np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        rows = total * len(x) / len(sample)
        trees[space] = Tree(x, int(min(cfg.most_leaves * len(x) / len(sample) + 1, rows // cfg.leaf_rows + 1)), cfg.branch)
    return trees


def most_similar(rows: DataFrame, scratch: Scratch, cfg: Similar = Similar()) -> DataFrame:
    """The ``k`` most similar rows of every row of ``rows (id string, space string, vec array<double>)``.

    Result ``(id, other, similarity, place)``. Rows are compared within one ``space`` only; a null
    space or id is left out. A row counts when its vector has exactly ``dims`` entries, none null
    or NaN or infinite, and a direction; equal similarity (to 12 digits) is ordered by the smaller
    id. Ids must be unique. An empty input gives an empty table.

    Rows of one direction form a group that is filed and searched once: of a group only the k + 1
    smallest ids can be among any row's first k. Groups meet in leaves. A leaf that outgrows
    ``block`` rows gets a tree of its own, so that leaves follow the rows (``crowded``); a crowded
    leaf of such a tree is searched in blocks, spread over tasks. Candidates are compared in double precision and ranked by
    similarity to 12 digits, then the smallest id of the group: the k first groups hold the k first
    rows.
    """
    spark = rows.sparkSession
    good = (F.size("vec") == cfg.dims) & F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vec", lambda v: v != 0)
    usable = rows.where("id is not null and space is not null").where(F.coalesce(good, F.lit(False))).select("id", "space", F.col("vec").cast("array<double>").alias("vec"))

    def group_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            if b.num_rows:
                key = [xxhash.xxh3_64_intdigest(v.tobytes()) for v in np.round(_unit(b, 2), 12) + 0.0]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(np.array(key, np.uint64).view(np.int64))], names=["id", "space", "vec", "gid"])

    keyed = scratch.save(usable.mapInArrow(group_ids, "id string, space string, vec array<double>, gid bigint"), "keyed")
    base = scratch.save(keyed.groupBy("space", "gid").agg(F.min_by("vec", "id").alias("vec"), F.min("id").alias("first"), F.count("*").alias("copies")), "base")
    few = scratch.save(_smallest(keyed, cfg.k + 1), "few")
    total = base.count()
    trees = _grow(base, cfg, total)
    shared = spark.sparkContext.broadcast(trees)

    deep = max([1, *(t.depth for t in trees.values())])

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, spaces = _unit(b, 2), np.array(b.column(0).to_pylist(), dtype=object)
            leaf, cos = np.zeros(len(x), np.int32), np.ones((len(x), deep))
            for s in set(spaces):
                if s in shared.value:
                    at = np.flatnonzero(spaces == s)
                    tree = shared.value[s]
                    leaf[at], cos[at, : tree.depth] = tree.assign(x[at])
            rows = np.arange(len(x) + 1, dtype=np.int32)
            v, c = pa.ListArray.from_arrays(pa.array(rows * cfg.dims), pa.array(x.ravel())), pa.ListArray.from_arrays(pa.array(rows * deep), pa.array(cos.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), v, pa.array(leaf), c, b.column(3)], names=["space", "gid", "v", "leaf", "cos", "first"])

    filed = scratch.save(spread(base.select("space", "gid", "vec", "first"), "gid").mapInArrow(file, "space string, gid bigint, v array<double>, leaf int, cos array<double>, first string"), "filed")
    sizes = filed.where(F.col("space").isin(list(trees))).groupBy("space", "leaf").agg(F.count("*").alias("n"), *(F.min(F.col("cos")[i]).alias(f"c{i}") for i in range(deep))).toPandas()
    for s, tree in trees.items():
        mine = sizes[sizes["space"] == s]
        tree.fill(mine["leaf"].to_numpy(), mine["n"].to_numpy(), mine[[f"c{i}" for i in range(deep)]].to_numpy())
    visits, true = _calibrate(filed, trees, cfg)
    crowds = {(s, leaf): int(n) for s, t in trees.items() for leaf, n in enumerate(t.rows[t.leaf_node]) if n > cfg.block}
    crowd, below = None, {}
    if crowds:
        crowd = Crowded(filed, crowds, lambda x, leaves: Tree(x, min(cfg.most_leaves, leaves), cfg.branch), scratch, cfg)
        found = true[[k in crowds for k in zip(true["space"], true["leaf"])]][["space", "leaf", "gid", "v", "other"]]
        placed = crowd.places(spark.createDataFrame(found, "space string, leaf int, gid bigint, v array<double>, other bigint"))
        for s in {k[0] for k in crowds}:
            mine = placed[placed["space"] == s]
            below[s] = _widened(mine["place"].to_numpy(), int(mine["leaves"].max()) if len(mine) else cfg.most_leaves, cfg.recall)

    # The cell in which each leaf is searched; 0 stands for the trees of crowded leaves.
    places, n_tasks = [], int(spark.conf.get("spark.sql.shuffle.partitions"))
    cell_rows = cfg.cell_rows
    for s, tree in trees.items():
        for leaf, cell in enumerate(tree.cells(cell_rows)):
            places.append((s, leaf, int(cell), (s, leaf) in crowds))
    plan = spark.sparkContext.broadcast((trees, visits, {(s, leaf): (cell, more) for s, leaf, cell, more in places}))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every query once for each cell that it visits, with its leaves there."""
        trees_, visits_, place = plan.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                b = whole.slice(lo, 1000)
                x, spaces = _unit(b, 2), np.array(b.column(0).to_pylist(), dtype=object)
                src, cell, block, leaves = [], [], [], []
                for s in set(spaces):
                    at = np.flatnonzero(spaces == s)
                    found = trees_[s].walk(x[at], visits_[s], cfg) if s in trees_ else [[0]] * len(at)
                    for i, visited in zip(at, found):
                        here: dict[tuple[int, int], list[int]] = defaultdict(list)
                        for leaf in visited:
                            c, more = place.get((s, leaf), (0, False))
                            here[c, leaf if more else -1].append(leaf)
                        for (c, j), one in here.items():
                            src.append(i), cell.append(c), block.append(j), leaves.append(one)
                take = b.take(pa.array(src, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [take.column(0), take.column(1), take.column(2), pa.array(cell, pa.int64()), pa.array(block, pa.int32()), pa.array(leaves, pa.list_(pa.int32()))],
                    names=["space", "gid", "v", "cell", "block", "leaves"],
                )

    form = "space string, gid bigint, v array<double>, cell bigint, block int, leaves array<int>"
    asked = filed.select("space", "gid", "v").mapInArrow(ask, form)
    where = F.broadcast(spark.createDataFrame(places, "bs string, bl int, cell bigint, more boolean"))
    stored = filed.join(where, (F.col("space") == F.col("bs")) & (F.col("leaf") == F.col("bl")), "left").where("not coalesce(more, false)").select(
        "space", "gid", "v", F.coalesce("cell", F.lit(0)).alias("cell"), F.lit(-1).alias("block"), F.array("leaf").alias("leaves"), "first"
    )
    if crowd is not None:
        # Queries that visit a crowded leaf go on to its tree.
        asked = scratch.save(asked, "asked")
        further = asked.where("block >= 0").select("space", F.col("block").alias("leaf"), "gid", "v")
        asked = asked.where("block < 0").unionByName(crowd.ask(further, below, cell_rows, form))
        stored = stored.unionByName(crowd.rows(cell_rows))
    copies = max(1, -(-n_tasks * cell_rows // max(cell_rows, total)))
    asked = asked.withColumn("block", F.expr(f"int(block * {copies} + pmod(xxhash64(gid, 5), {copies}))"))
    stored = stored.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).withColumn("block", F.expr(f"int(block * {copies} + copy)")).drop("copy").withColumn("query", F.lit(False))
    tasks = max(n_tasks, total * max([1, *visits.values()]) // 400_000)
    both = asked.withColumn("query", F.lit(True)).withColumn("first", F.lit(None).cast("string")).unionByName(stored.select("space", "gid", "v", "cell", "block", "leaves", "query", "first"))
    keep = cfg.k

    def best(sims: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each row the ``keep`` largest, equal ones (to 12 digits) by column."""
        r, c = np.nonzero(sims >= max(cfg.least - 1e-5, -1.5))
        if len(r) > 20 * keep * len(sims):
            least = np.partition(sims, -min(keep, sims.shape[1]), axis=1)[:, -min(keep, sims.shape[1]), None]
            r, c = np.nonzero((sims >= least - 2e-12) & (sims >= max(cfg.least - 1e-5, -1.5)))
        return _first(r, c, np.round(sims[r, c], 12), c, keep)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows arrive sorted by cell and block, stored rows first."""
        key, held, ready = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(2).flatten().to_numpy().reshape(b.num_rows, -1)
            gid, is_query = b.column(1).to_numpy(), b.column(6).to_numpy(zero_copy_only=False)
            leaves, firsts = b.column(5), b.column(7)
            keys = list(zip(b.column(0).to_pylist(), b.column(3).to_numpy().tolist(), b.column(4).to_numpy().tolist()))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for lo, hi in zip(cuts, cuts[1:]):
                if keys[lo] != key:
                    key, held, ready = keys[lo], [], None
                n = int((~is_query[lo:hi]).sum())
                if n:
                    held.append((gid[lo : lo + n], x[lo : lo + n], leaves.slice(lo, n).flatten().to_numpy(), np.array(firsts.slice(lo, n).to_pylist(), dtype=object)))
                    ready = None
                if lo + n == hi or not held:
                    continue
                if ready is None:
                    # By leaf and smallest id, so that of equal similarities the first are kept.
                    first, leaf = np.concatenate([h[3] for h in held]), np.concatenate([h[2] for h in held])
                    by_id = np.array(sorted(range(len(first)), key=first.__getitem__))
                    rank = np.empty(len(first), np.int64)
                    rank[by_id] = np.arange(len(first))
                    order = np.lexsort((rank, leaf))
                    of, begin = np.unique(leaf[order], return_index=True)
                    ready = np.concatenate([h[0] for h in held])[order], np.concatenate([h[1] for h in held])[order], of, np.r_[begin, len(order)], first[order], rank[order]
                ids, vecs, of, begin, first, rank = ready
                for at in range(lo + n, hi, 2048):
                    end = min(at + 2048, hi)
                    asked_ = leaves.slice(at, end - at)
                    flat = asked_.flatten().to_numpy()
                    who = np.repeat(np.arange(at, end), np.diff(asked_.offsets.to_numpy()))
                    slot = np.minimum(np.searchsorted(of, flat), len(of) - 1)
                    who, slot = who[of[slot] == flat], slot[of[slot] == flat]
                    turn = np.argsort(slot, kind="stable")
                    who, slot = who[turn], slot[turn]
                    rows_, cols, values = [], [], []
                    for a in np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]]) if len(slot) else ():
                        lo_, hi_ = begin[slot[a]], begin[slot[a] + 1]
                        z = np.searchsorted(slot, slot[a], "right")
                        for cut in range(a, z, 256):
                            q = who[cut : min(cut + 256, z)]
                            sims = x[q] @ vecs[lo_:hi_].T
                            sims[gid[q][:, None] == ids[lo_:hi_][None, :]] = -2.0
                            r, c, v = best(sims)
                            rows_.append(q[r]), cols.append(lo_ + c), values.append(v)
                    if not rows_:
                        continue
                    r, c, v = (np.concatenate(part) for part in (rows_, cols, values))
                    r, c, v = _first(r, c, v, rank[c], keep)
                    if len(r):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([key[0]] * len(r), pa.string()), pa.array(gid[r]), pa.array(ids[c]), pa.array(v), pa.array(first[c], pa.string())], names=["space", "gid", "other", "s", "first"],
                        )

    met = both.repartition(tasks, "space", "cell", "block").sortWithinPartitions("space", "cell", "block", "query").mapInArrow(compare, "space string, gid bigint, other bigint, s double, first string")
    near = _best(met, keep, "first").select("space", "gid", "other", F.col("s").alias("similarity"))
    groups = near.unionByName(base.where("copies > 1").select("space", "gid", F.col("gid").alias("other"), F.lit(1.0).alias("similarity"))).where(F.col("similarity") >= cfg.least)
    # Rows of a group share everything but their own id, so each group's list is made once.
    listed = groups.join(few.select(F.col("space").alias("fs"), F.col("gid").alias("fg"), F.explode("ids").alias("oid")), (F.col("space") == F.col("fs")) & (F.col("other") == F.col("fg")))
    lists = listed.groupBy("space", "gid").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("n"), F.col("oid").alias("oid")))), 1, cfg.k + 1).alias("l"))
    out = keyed.select("id", "space", "gid").join(lists, ["space", "gid"]).select("id", F.slice(F.filter("l", lambda e: e["oid"] != F.col("id")), 1, cfg.k).alias("l"))
    return out.select("id", F.posexplode("l").alias("p", "e")).select("id", F.col("e.oid").alias("other"), (-F.col("e.n")).alias("similarity"), (F.col("p") + 1).alias("place"))
