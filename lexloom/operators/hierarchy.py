"""Parent-child rows to full hierarchies with nested-set ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.tables import Scratch

#: Blocks into which the children of one node are spread for prefix sums.
SIBLING_BLOCKS = 256


class _Climb:
    """Rows that follow pointers upward, a doubled distance in each round. Rows whose pointer has run
    out are done: they leave the loop, stay in the tables they were written to, and are only looked
    up from then on. ``seen`` names the columns that a row takes over from the row it points at."""

    def __init__(self, rows: DataFrame, scratch: Scratch, name: str, seen: list[str]):
        self.scratch, self.name, self.seen, self.round = scratch, name, seen, 0
        self.parts = [scratch.save(rows, f"{name}0")]

    @property
    def open(self) -> DataFrame:
        return self.parts[-1].where("ptr is not null")

    @property
    def done(self) -> DataFrame:
        out = self.parts[0].where("ptr is null")
        for part in self.parts[1:]:
            out = out.unionByName(part.where("ptr is null"))
        return out

    def step(self, change: dict, extra: DataFrame | None = None) -> None:
        """Every open row takes ``change`` (columns by name) from the row it points at, whose columns
        have the prefix ``up_``; ``extra (xid, ...)`` is joined by id first."""
        columns = self.parts[0].columns
        up = self.open.select("id", *self.seen).unionByName(self.done.select("id", *self.seen))
        up = up.select(F.col("id").alias("up_id"), *(F.col(c).alias(f"up_{c}") for c in self.seen))
        moving = self.open if extra is None else self.open.join(extra, F.col("id") == F.col("xid"), "left")
        # Every pointer leads to a row, so the smaller side may be the one that is broadcast.
        moved = moving.join(up, F.col("ptr") == F.col("up_id")).select(*(change[c].alias(c) if c in change else F.col(c) for c in columns))
        self.round += 1
        # Where nothing was shuffled the rows left open lie in as many files as the rows looked up.
        self.parts.append(self.scratch.save(moved.hint("rebalance"), f"{self.name}{self.round}"))


def hierarchy(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """Place of every node of ``nodes (id, parent)`` in its tree.

    Result: ``id, state, root_id, depth, n_descendants, path, lft, rgt``. ``state`` is ``ok``,
    ``cycle`` (the node is its own ancestor) or ``below-cycle``; for the last two root and path are
    empty and the numbers -1. ``lft``/``rgt`` are nested-set bounds within the root's tree: node b
    is a proper descendant of a when both have one root and ``a.lft < b.lft <= a.rgt``. A null or
    unknown parent makes a root. ``id`` must be unique; rows with a null id are left out.

    Subtree sizes are summed upward, sibling ranges are laid out by prefix sums over those sizes,
    and ranges are summed downward. Every pass doubles the distance it covers in a round (a node
    holds a pointer 2^k steps up), so a tree of depth d takes log2(d) rounds, each written to
    shared storage. Nodes that no round can settle hang on a cycle. Siblings are summed in hashed
    blocks first, so one parent may hold a third of all rows.
    """
    known = nodes.where("id is not null").select("id", "parent")
    ids = known.select(F.col("id").alias("pid"))
    base = scratch.save(
        known.join(ids, known["parent"] == ids["pid"], "left").select("id", F.col("pid").alias("parent")), "base"
    )

    none_ = F.lit(None).cast("string")
    first = base.select("id", "parent", F.col("parent").alias("ptr"), F.expr("bigint(if(parent is null, 0, 1))").alias("depth"), F.when(F.col("parent").isNull(), F.col("id")).alias("root"), F.lit(1).cast("bigint").alias("size"), none_.alias("late_id"), F.lit(0).cast("bigint").alias("late"))
    up, open_ = _Climb(first, scratch, "up", ["ptr", "depth", "root"]), None
    while True:
        left = up.open.count()
        if left == 0 or left == open_:
            break
        open_ = left
        gained = up.open.groupBy(F.col("ptr").alias("xid")).agg(F.sum("size").alias("gain"))
        # What reaches a row that is done already is noted, and added at the end.
        up.step({
            "ptr": F.col("up_ptr"), "depth": F.col("depth") + F.col("up_depth"), "root": F.col("up_root"), "size": F.col("size") + F.coalesce("gain", F.lit(0)),
            "late_id": F.when(F.col("up_ptr").isNull(), F.col("ptr")), "late": F.col("size"),
        }, gained)

    stuck = None
    if left:
        # The nodes that are a far ancestor of some unsettled node shrink to those on cycles.
        rest = _Climb(up.open.select("id", "ptr"), scratch, "rest", ["ptr"])
        on = rest.open.select("ptr").distinct().count()
        while True:
            rest.step({"ptr": F.col("up_ptr")})
            now = rest.open.select("ptr").distinct().count()
            if now == on:
                break
            on = now
        ring = rest.open.select(F.col("ptr").alias("cid")).distinct()
        stuck = rest.open.join(ring, F.col("id") == F.col("cid"), "left").select("id", F.expr("if(cid is null, 'below-cycle', 'cycle')").alias("state"))

    more = up.parts[0]
    for part in up.parts[1:]:
        more = more.unionByName(part)
    more = more.where("late_id is not null").groupBy(F.col("late_id").alias("xid")).agg(F.sum("late").alias("gain"))
    settled = up.done.join(more, F.col("id") == F.col("xid"), "left").withColumn("size", F.col("size") + F.coalesce("gain", F.lit(0)))
    settled = scratch.save(settled.select("id", "parent", "depth", "root", "size"), "settled")
    for name in ["base", *(f"up{i}" for i in range(up.round + 1))]:
        scratch.drop(name)
    ok = settled.withColumn("block", F.expr(f"pmod(xxhash64(id), {SIBLING_BLOCKS})"))
    kids = ok.where("parent is not null")
    inside = F.coalesce(F.sum("size").over(Window.partitionBy("parent", "block").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = F.coalesce(F.sum("total").over(Window.partitionBy("bp").orderBy("bb").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = kids.groupBy(F.col("parent").alias("bp"), F.col("block").alias("bb")).agg(F.sum("size").alias("total")).withColumn("before", before).drop("total")
    placed = kids.withColumn("inside", inside).join(blocks, (F.col("parent") == F.col("bp")) & (F.col("block") == F.col("bb"))).select(
        "id", F.col("parent").alias("ptr"), "depth", "root", "size", (F.lit(1) + F.col("inside") + F.col("before")).alias("lft"), F.col("id").alias("path")
    )
    roots = ok.where("parent is null").select("id", F.col("parent").alias("ptr"), "depth", "root", "size", F.lit(0).cast("bigint").alias("lft"), F.col("id").alias("path"))
    down = _Climb(placed.unionByName(roots), scratch, "down", ["ptr", "lft", "path"])
    far = settled.agg(F.max("depth")).first()[0] or 0
    while (1 << down.round) <= far:
        down.step({"ptr": F.col("up_ptr"), "lft": F.col("lft") + F.coalesce("up_lft", F.lit(0)), "path": F.concat_ws(">", "up_path", "path")})
    out = down.done.select(
        "id", F.lit("ok").alias("state"), F.col("root").alias("root_id"), "depth", (F.col("size") - 1).alias("n_descendants"), "path", "lft", (F.col("lft") + F.col("size") - 1).alias("rgt")
    )
    if stuck is not None:
        none = F.lit(-1).cast("bigint")
        out = out.unionByName(
            stuck.select("id", "state", F.lit("").alias("root_id"), none.alias("depth"), none.alias("n_descendants"), F.lit("").alias("path"), none.alias("lft"), none.alias("rgt"))
        )
    return out


def descendants(places: DataFrame, tree: list[str]) -> DataFrame:
    """``(*tree, ancestor, descendant)`` of all nodes of ``places (*tree, id, lft, rgt)``, columns
    ``tree`` naming a node's tree; without the nodes themselves.

    A node's range is cut into intervals of 2^k numbers that start at multiples of 2^k, at most two
    of each k. Every number lies in one such interval of each size, so that ranges and numbers meet
    by equality, each pair exactly once: no task holds more than the rows it gives out, and a tree of
    any shape, also one with a third of all rows, is spread by interval.
    """
    wide = places.agg(F.max(F.col("rgt") - F.col("lft"))).first()[0] or 0
    levels = F.sequence(F.lit(0), F.lit(int(wide).bit_length()))
    lo, hi = F.col("lft") + 1, F.col("rgt") + 1

    def cut(k):
        size = F.call_function("shiftleft", F.lit(1).cast("bigint"), k)
        a, b = F.floor((lo + size - 1) / size), F.floor(hi / size)
        one = lambda use, at: F.when((a < b) & use, F.struct(k.alias("k"), at.alias("at")))
        return F.array(one(a % 2 == 1, a), one(b % 2 == 1, b - 1))

    ranges = places.where("rgt > lft").select(*tree, F.col("id").alias("ancestor"), F.explode(F.filter(F.flatten(F.transform(levels, cut)), lambda e: e.isNotNull())).alias("e"))
    points = places.select(*tree, F.col("id").alias("descendant"), "lft", F.explode(levels).alias("k"))
    points = points.select(*tree, "descendant", "k", F.expr("shiftright(lft, k)").alias("at"))
    return ranges.select(*tree, "ancestor", "e.k", "e.at").join(points, [*tree, "k", "at"]).select(*tree, "ancestor", "descendant")
