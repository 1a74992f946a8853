"""A second level of trees, for leaves that hold more rows than can be compared as a whole.

The tree of a space is known everywhere, so it has a bounded number of leaves. A leaf that grows
beyond a block gets a tree of its own, grown in a task on a bounded sample of its rows; these trees
are a table, as many as the rows ask for, and are never gathered in one place. Rows and queries of a
leaf travel to its tree: to one of several copies of it, so that a leaf may hold a third of all rows.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.tables import Scratch

if TYPE_CHECKING:
    from lexloom.llm.vectors import Similar, Tree

#: Levels of a tree whose radii are kept; deeper ones are never closed by radius.
DEEP = 16
_TREE = "space string, leaf int, tree binary"


def matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


class Crowded:
    """``sizes``: rows of each crowded leaf of ``filed (space, gid, v, leaf, first, ...)``."""

    def __init__(self, filed: DataFrame, sizes: dict[tuple[str, int], int], make: Callable[[np.ndarray, int], Tree], scratch: Scratch, cfg: Similar):
        self.scratch, self.cfg, self.spark = scratch, cfg, filed.sparkSession
        rows = [(s, leaf, n, -(-n // cfg.route_rows)) for (s, leaf), n in sizes.items()]
        self.marks = F.broadcast(self.spark.createDataFrame(rows, "ms string, ml int, mn bigint, copies int"))
        here = filed.select("space", "leaf", "gid", "v", "first", F.lit(None).cast("int").alias("sub"))
        few = self._marked(here).where("pmod(xxhash64(gid, 3), mn) < " + str(cfg.leaf_sample)).select("space", "leaf", "mn", "v")

        def grow(part: pd.DataFrame) -> pd.DataFrame:
            x = np.stack(part["v"].to_numpy())
            tree = make(x, int(part["mn"].iloc[0]) // cfg.leaf_rows + 1)
            return pd.DataFrame({"space": part["space"].iloc[:1], "leaf": part["leaf"].iloc[:1], "tree": [pickle.dumps(tree)]})

        grown = scratch.save(few.groupBy("space", "leaf").applyInPandas(grow, _TREE), "grown")

        def assign(tree: Tree, b: pa.RecordBatch) -> Iterator[list]:
            x = matrix(b["v"], b.num_rows)
            sub, cos = tree.assign(x)
            wide = np.full((len(x), DEEP), 1.0)
            wide[:, : min(DEEP, tree.depth)] = cos[:, :DEEP]
            if tree.depth > DEEP:
                wide[:, DEEP - 1] = -1.0
            yield [b["space"], b["leaf"], b["gid"], b["v"], b["first"], pa.array(sub.astype(np.int32)), lists(wide)]

        self.stored = scratch.save(self._route(here, grown, assign, "space string, leaf int, gid bigint, v array<double>, first string, sub int, cos array<double>"), "routed")
        held = self.stored.groupBy("space", "leaf", "sub").agg(F.count("*").alias("n"), F.array(*(F.min(F.col("cos")[i]) for i in range(DEEP))).alias("c"))
        held = held.groupBy(F.col("space").alias("hs"), F.col("leaf").alias("hl")).agg(F.collect_list(F.struct("sub", "n", "c")).alias("held"))

        def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                out = []
                for raw, rows_ in zip(b["tree"], b["held"]):
                    tree = pickle.loads(raw)
                    cos = np.array([r["c"] for r in rows_])
                    wide = np.concatenate([cos, np.repeat(cos[:, -1:], max(0, tree.depth - DEEP), axis=1)], axis=1)
                    tree.fill(np.array([r["sub"] for r in rows_]), np.array([r["n"] for r in rows_]), wide)
                    out.append(pickle.dumps(tree))
                yield pd.DataFrame({"space": b["space"], "leaf": b["leaf"], "tree": out})

        joined = grown.join(held, (F.col("space") == F.col("hs")) & (F.col("leaf") == F.col("hl"))).select("space", "leaf", "tree", "held")
        self.trees = scratch.save(joined.mapInPandas(fill, _TREE), "filled")

    def _marked(self, df: DataFrame) -> DataFrame:
        return df.join(self.marks, (F.col("space") == F.col("ms")) & (F.col("leaf") == F.col("ml")))

    def _route(self, rows: DataFrame, trees: DataFrame, each: Callable, schema: str) -> DataFrame:
        """``each (tree, batch of rows)`` for the rows of every leaf; it gives lists of columns."""
        none = lambda t: F.lit(None).cast(t)
        t = self._marked(trees).select("space", "leaf", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.lit(0).alias("rank"), "tree", none("bigint").alias("gid"), none("array<double>").alias("v"), none("string").alias("first"), none("int").alias("sub"))
        r = self._marked(rows).select("space", "leaf", F.expr("int(pmod(xxhash64(gid), copies))").alias("copy"), F.lit(1).alias("rank"), none("binary").alias("tree"), "gid", "v", "first", "sub")
        names = [c.split()[0] for c in schema.split(", ")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree = None
            for b in batches:
                starts = np.flatnonzero(b["rank"].to_numpy() == 0)
                cuts = [*([0] if not len(starts) or starts[0] else []), *starts.tolist(), b.num_rows]
                for lo, hi in zip(cuts, cuts[1:]):
                    if b["tree"][lo].is_valid:
                        tree, lo = pickle.loads(b["tree"][lo].as_py()), lo + 1
                    if lo < hi:
                        for columns in each(tree, b.slice(lo, hi - lo)):
                            yield pa.RecordBatch.from_arrays(columns, names=names)

        tasks = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), 1)
        return t.unionByName(r).repartition(tasks, "space", "leaf", "copy").sortWithinPartitions("space", "leaf", "copy", "rank").mapInArrow(run, schema)

    def places(self, found: DataFrame) -> pd.DataFrame:
        """Of ``found (space, leaf, gid, v, other)``, gid being a query: the place of the other row's leaf
        in the walk of the query through the tree of ``leaf``."""
        of = self.stored.select(F.col("space").alias("os"), F.col("gid").alias("og"), F.col("sub").alias("to"))
        asked = found.join(of, (F.col("space") == F.col("os")) & (F.col("other") == F.col("og"))).select("space", "leaf", "gid", "v", F.lit(None).cast("string").alias("first"), F.col("to").alias("sub"))

        cfg = self.cfg

        def place(tree: Tree, b: pa.RecordBatch) -> Iterator[list]:
            walks = tree.walk(matrix(b["v"], b.num_rows), tree.n_leaves, cfg)
            at = [w.index(s) if s in w else tree.n_leaves for w, s in zip(walks, b["sub"].to_pylist())]
            yield [b["space"], pa.array(np.array(at, np.int32)), pa.array(np.full(len(at), tree.n_leaves, np.int32))]

        return self._route(asked, self.trees, place, "space string, place int, leaves int").toPandas()

    def ask(self, asked: DataFrame, visits: dict[str, int], cell_rows: int, schema: str) -> DataFrame:
        """Queries ``(space, leaf, gid, v)`` as rows of ``schema``, one for each cell that they visit."""
        cfg = self.cfg

        def go(tree: Tree, b: pa.RecordBatch) -> Iterator[list]:
            cells = tree.cells(cell_rows)
            src, cell, block, leaves = [], [], [], []
            for i, (s, leaf, walk) in enumerate(zip(b["space"].to_pylist(), b["leaf"].to_pylist(), tree.walk(matrix(b["v"], b.num_rows), visits[b["space"][0].as_py()], cfg))):
                here: dict[tuple[int, int], list[int]] = defaultdict(list)
                for sub in walk:
                    for j in range(_blocks(tree, sub, cfg.block)):
                        here[int(cells[sub]), j].append(sub)
                for (c, j), one in here.items():
                    src.append(i), cell.append(_cell(leaf, c)), block.append(j), leaves.append(one)
            take = b.take(pa.array(src, pa.int32()))
            yield [take["space"], take["gid"], take["v"], pa.array(cell, pa.int64()), pa.array(block, pa.int32()), pa.array(leaves, pa.list_(pa.int32()))]

        rows = asked.select("space", "leaf", "gid", "v", F.lit(None).cast("string").alias("first"), F.lit(None).cast("int").alias("sub"))
        return self._route(rows, self.trees, go, schema)

    def rows(self, cell_rows: int) -> DataFrame:
        """Stored rows ``(space, gid, v, cell, block, leaves, first)``."""

        most = self.cfg.block

        def list_(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                out = []
                for s, leaf, raw in zip(b["space"], b["leaf"], b["tree"]):
                    tree = pickle.loads(raw)
                    out += [(s, leaf, sub, _cell(leaf, int(c)), _blocks(tree, sub, most)) for sub, c in enumerate(tree.cells(cell_rows))]
                yield pd.DataFrame(out, columns=["ps", "pl", "psub", "cell", "blocks"])

        where = self.trees.mapInPandas(list_, "ps string, pl int, psub int, cell bigint, blocks int")
        at = (F.col("space") == F.col("ps")) & (F.col("leaf") == F.col("pl")) & (F.col("sub") == F.col("psub"))
        return self.stored.join(where, at).select("space", "gid", "v", "cell", F.expr("int(pmod(xxhash64(gid), blocks))").alias("block"), F.array("sub").alias("leaves"), "first")


def _blocks(tree: Tree, leaf: int, most: int) -> int:
    return max(1, -(-int(tree.rows[tree.leaf_node[leaf]]) // most))


def _cell(leaf: int, c: int) -> int:
    """Cells below a crowded leaf have negative numbers, so that they differ from those above."""
    return -((leaf << 32) + c) - 1
