"""Evaluation passages inside a corpus, by CGK embedding and bit-sampling LSH.

Texts and passages are cut into windows of as many words as an item must share. The CGK walk reads
a window along random bits: at step j it emits the current word and moves on when a random function
of (j, word) says so, over three times the window's length. Windows at small edit distance keep
most positions of the emitted string, so edit distance turns into Hamming distance. Each LSH table
samples a few of those positions as its key; how many tables reach the asked recall is calibrated
on copies of the items' own windows with words replaced, inserted and deleted. Windows of a text are
read in every length that the edits allow, and where they meet an item's under a key their edit
distance is computed exactly. Windows with more words or runs of three words that no item has than
the edits could bring about are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.spread import spread
from lexloom.llm.words import U64, mix, words
from lexloom.tables import Scratch

RUN = 3
EDITS = ("replace", "insert", "delete")


@dataclass(frozen=True)
class Leak:
    """A document leaks an item when ``window`` consecutive words of the item stand in it with at
    most ``edits`` words replaced, inserted or deleted."""

    window: int = 16
    edits: int = 1
    #: Share of the windows with ``edits`` edits of one kind that must meet the original in some
    #: table, for each kind; equal windows always do.
    recall: float = 0.9
    #: Positions sampled for a key. Where ``tables`` tables do not reach the recall, keys of one
    #: position less are taken; with one position tables are added until they do.
    positions: int = 8
    tables: int = 32
    #: Tables that share a walk. An edit can throw a walk off for good, so there are several.
    of_a_walk: int = 1
    seed: int = 11
    #: Words of items held in one block; more items are searched block after block.
    block_words: int = 2_000_000


class Sketch:
    """The random functions: walks, and the sampled positions of the tables of each."""

    def __init__(self, cfg: Leak, n_words: int):
        self.cfg, self.steps = cfg, 3 * cfg.window
        # Word 0 stands for all words no item has, n_words + 1 for the end of the window.
        self.end = n_words + 1
        self.code = mix(np.arange(1, n_words + 3, dtype=U64) * U64(0x9E3779B97F4A7C15))
        self.rng = np.random.default_rng(cfg.seed)
        self.tables: list[np.ndarray] = []

    def widen(self, positions: int) -> None:
        # A step moves on half of the time: past twice the window's length most walks read its end.
        self.tables.append(np.sort(self.rng.choice(2 * self.cfg.window, positions, replace=False)))

    def keys(self, words_: np.ndarray, starts: np.ndarray, lengths: np.ndarray | int, first: int = 0) -> np.ndarray:
        """A row of keys, one for each table from ``first`` on, of the windows at ``starts``."""
        out = np.zeros((len(self.tables) - first, len(starts)), U64)
        stop = starts + lengths
        for walk in range(first // self.cfg.of_a_walk, -(-len(self.tables) // self.cfg.of_a_walk)):
            wanted: dict[int, list[int]] = {}
            for t in range(max(first, walk * self.cfg.of_a_walk), min(len(self.tables), (walk + 1) * self.cfg.of_a_walk)):
                for j in self.tables[t]:
                    wanted.setdefault(int(j), []).append(t - first)
            salt, pos = mix(np.arange(2 * self.steps, dtype=U64) + U64((self.cfg.seed << 32) + (walk << 16))) | U64(1), starts.copy()
            with np.errstate(over="ignore"):
                for j in range(max(wanted, default=-1) + 1):
                    code = self.code[np.where(pos < stop, words_[np.minimum(pos, len(words_) - 1)], self.end)]
                    if j in wanted:
                        add = code * salt[j]
                        for t in wanted[j]:
                            out[t] += add
                    pos += (code * salt[self.steps + j] >> U64(63)).astype(np.int64)
        return out


def edited(windows: np.ndarray, kind: str, edits: int, rng: np.random.Generator) -> np.ndarray:
    """Copies of the windows (rows) with ``edits`` edits of one kind, the new words being 0."""
    n, rows = len(windows), windows
    for _ in range(edits):
        w = rows.shape[1]
        at, col = rng.integers(0, w, n)[:, None], np.arange(w)
        if kind == "replace":
            rows = np.where(col == at, 0, rows)
        elif kind == "insert":
            wide = np.concatenate([rows, rows[:, -1:]], axis=1)
            shift = np.concatenate([rows[:, :1], rows], axis=1)
            col = np.arange(w + 1)
            rows = np.where(col < at, wide, np.where(col == at, 0, shift))
        else:
            rows = rows[np.broadcast_to(col != at, rows.shape)].reshape(n, w - 1)
    return rows


def distances(a: np.ndarray, x: np.ndarray, room: np.ndarray, b: np.ndarray, y: np.ndarray, window: int, edits: int) -> np.ndarray:
    """Fewest edits between the ``window`` words of ``b`` at ``y`` and any beginning of the words of
    ``a`` at ``x`` (of which there are ``room``); ``edits`` + 1 stands for more."""
    far = edits + 1
    shift = np.arange(-edits, edits + 1)
    # best[k]: edits between the first i words of b and the first i + shift[k] of a.
    best = np.where(shift >= 0, shift, far)[:, None] * np.ones(len(x), np.int64)
    for i in range(1, window + 1):
        mine, now = b[y + i - 1], np.full_like(best, far)
        for k, s in enumerate(shift):
            j = i + s
            if j < 0:
                continue
            inside = j <= room
            cost = np.full(len(x), far)
            if j >= 1:
                same = a[np.minimum(x + j - 1, len(a) - 1)] == mine
                cost = best[k] + ~same
            if k + 1 < len(shift):
                cost = np.minimum(cost, best[k + 1] + 1)
            if k:
                cost = np.minimum(cost, now[k - 1] + 1)
            now[k] = np.where(inside, np.minimum(cost, far), far)
        best = now
    return best.min(0)


def _once(x: np.ndarray) -> np.ndarray:
    """Distinct numbers, by sorting."""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


class Items:
    """The windows of a block of items, searchable by key."""

    def __init__(self, items: list[tuple[str, str]], cfg: Leak):
        self.cfg, self.ids = cfg, [i for i, _ in items]
        self.number: dict[str, int] = {}
        flat, starts, owner, base = [], [], [], 0
        for k, (_, text) in enumerate(items):
            ws = words(text)
            flat += [self.number.setdefault(w, len(self.number) + 1) for w in ws]
            starts += range(base, base + len(ws) - cfg.window + 1)
            owner += [k] * max(0, len(ws) - cfg.window + 1)
            base += len(ws)
        self.words = np.array(flat, np.int64)
        self.starts, self.owner = np.array(starts, np.int64), np.array(owner, np.int64)
        # Runs over the ends of items do no harm: the map only saves work.
        self.runs = np.zeros(1 << max(10, (16 * len(flat)).bit_length()), bool)
        if len(flat) >= RUN:
            self.runs[self._runs(self.words)] = True
        self.sketch, self.recall = Sketch(cfg, len(self.number)), 1.0
        self._calibrate()
        self.tables = []
        for keys in self.sketch.keys(self.words, self.starts, cfg.window) if len(self.starts) else []:
            order = np.argsort(keys, kind="stable")
            self.tables.append((keys[order], order))

    def _runs(self, ws: np.ndarray) -> np.ndarray:
        """Place of each run of neighbours in the map of runs that items have."""
        code, n = np.zeros(max(0, len(ws) - RUN + 1), U64), len(ws)
        with np.errstate(over="ignore"):
            for i in range(RUN):
                code = code * U64(0x9E3779B97F4A7C15) + ws[i : n - RUN + 1 + i].astype(U64)
        return (mix(code) & U64(len(self.runs) - 1)).astype(np.int64)

    def _calibrate(self) -> None:
        """Adds tables until edited copies of the windows meet their originals often enough, whether
        words are replaced, inserted or deleted."""
        s, cfg = self.sketch, self.cfg
        s.widen(cfg.positions)
        if cfg.edits == 0 or not len(self.starts):
            return
        rng, w = np.random.default_rng(cfg.seed + 1), cfg.window
        pick = self.starts[rng.integers(0, len(self.starts), 4000)]
        original = self.words[pick[:, None] + np.arange(w)]
        copies = [edited(original, kind, cfg.edits, rng) for kind in EDITS]
        at = np.arange(len(pick))

        def met(first: int) -> np.ndarray:
            mine = s.keys(original.ravel(), at * w, w, first)
            return np.stack([(mine == s.keys(c.ravel(), at * c.shape[1], c.shape[1], first)).any(0) for c in copies])

        for positions in range(cfg.positions, 0, -1):
            if positions < cfg.positions:
                s.tables = []
                s.widen(positions)
            found = met(0)
            while found.mean(1).min() < cfg.recall and (len(s.tables) < cfg.tables or positions == 1 and len(s.tables) < 10 * cfg.tables):
                s.widen(positions)
                found |= met(len(s.tables) - 1)
            self.recall = float(found.mean(1).min())
            if self.recall >= cfg.recall:
                return
        raise ValueError(f"windows of {w} words with {cfg.edits} edits are found with recall {self.recall:.3f} only, {cfg.recall} was asked")

    def find(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Items met by the text and the fewest edits of each."""
        return self.find_many([text])[1:]

    def _meet(self, ws: np.ndarray, starts: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of windows of ``length`` words, and numbers of items' windows with an equal key."""
        for lo in range(0, len(starts), 50_000):
            here = starts[lo : lo + 50_000]
            for (sorted_keys, order), keys in zip(self.tables, self.sketch.keys(ws, here, length)):
                left = np.searchsorted(sorted_keys, keys, "left")
                hit = np.flatnonzero(sorted_keys[np.minimum(left, len(sorted_keys) - 1)] == keys)
                if len(hit):
                    left = left[hit]
                    n = np.searchsorted(sorted_keys, keys[hit], "right") - left
                    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    yield here[np.repeat(hit, n)], order[np.repeat(left, n) + within]

    def find_many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of the text, item met by it, and the fewest edits."""
        w, e, none = self.cfg.window, self.cfg.edits, np.empty(0, np.int64)
        number = self.number
        parts = [np.array([number.get(x, 0) for x in words(t)], np.int64) for t in texts]
        ws = np.concatenate(parts) if parts else none
        if len(ws) < max(1, w - e) or not len(self.starts):
            return none, none, none
        sizes = np.array([len(p) for p in parts])
        ends, text_of = np.cumsum(sizes), np.repeat(np.arange(len(parts)), sizes)
        # A window with more foreign words or runs than the edits make is near no item's.
        foreign = np.concatenate([[0], np.cumsum(ws == 0)])
        apart = np.concatenate([[0], np.cumsum(~self.runs[self._runs(ws)])])
        met = []
        for length in range(max(1, w - e), w + e + 1):
            n = len(ws) - length + 1
            if n <= 0:
                continue
            near = (foreign[length:] - foreign[:n] <= e) & (text_of[:n] == text_of[length - 1 :])
            if length >= RUN:
                near &= apart[length - RUN + 1 :] - apart[:n] <= RUN * e
            for x, y in self._meet(ws, np.flatnonzero(near), length):
                met.append(_once(x * np.int64(len(self.starts)) + y))
        if not met:
            return none, none, none
        pairs, out = _once(np.concatenate(met)), []
        for cut in range(0, len(pairs), 200_000):
            x, y = np.divmod(pairs[cut : cut + 200_000], len(self.starts))
            d = distances(ws, x, ends[text_of[x]] - x, self.words, self.starts[y], w, e)
            ok = d <= e
            out.append((text_of[x[ok]], self.owner[y[ok]], d[ok]))
        t, owner, edit = (np.concatenate(c) for c in zip(*out))
        order = np.lexsort((edit, owner, t))
        t, owner, edit = t[order], owner[order], edit[order]
        first = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (owner[1:] != owner[:-1])]) if len(t) else none
        return t[first], owner[first], edit[first]


def _chunks(ids: list, texts: list[str], most: int = 400_000) -> Iterator[tuple[list, list[str]]]:
    """Texts of about ``most`` characters at a time; a longer one is a chunk of its own."""
    lo = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > most:
            yield ids[lo:i], texts[lo:i]
            lo, total = i, 0
        total += len(t)
    yield ids[lo:], texts[lo:]


def leaks(docs: DataFrame, items: DataFrame, scratch: Scratch, cfg: Leak = Leak()) -> DataFrame:
    """``(doc_id, item_id, edits)`` of every document of ``docs (doc_id, text, ...)`` and every item
    of ``items (item_id string, text)`` of which a window of words stands in the document, ``edits``
    being the fewest edits of any window.

    Null, empty and too short texts and items give nothing; repeated items count once; rows with a
    null id are left out. Whole texts are searched. Equal windows are always found; edited ones with
    the recall asked, and a ValueError says so where no number of tables gives it. The items are the
    stated query set: they are broadcast in blocks of at most ``block_words`` words (one longer item
    is a block), one after another: all documents are searched for a block, the result is written and
    the block released, so neither side is bounded.
    """
    spark = docs.sparkSession
    sized = items.where("item_id is not null and text is not null").select("item_id", "text").distinct()
    total = sized.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / 4 / cfg.block_words))
    source = spread(docs.where("doc_id is not null and text is not null").select("doc_id", "text"), "doc_id")
    out = None
    for k in range(blocks):
        held = [tuple(r) for r in sized.where(F.expr(f"pmod(xxhash64(item_id), {blocks}) = {k}")).orderBy("item_id", "text").toLocalIterator()]
        shared = spark.sparkContext.broadcast(Items(held, cfg))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = shared.value
            for b in batches:
                for ids, texts in _chunks(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    at, owner, edits = block.find_many(texts)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([ids[i] for i in at], pa.int64()), pa.array([block.ids[i] for i in owner], pa.string()), pa.array(edits.astype(np.int32))], names=["doc_id", "item_id", "edits"]
                    )

        found = source.mapInArrow(search, "doc_id bigint, item_id string, edits int").groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"))
        found = scratch.save(found, f"block{k}")
        shared.destroy()
        out = found if out is None else out.unionByName(found)
    return out.groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits")) if blocks > 1 else out
