"""Encoding of texts with a byte-level BPE vocabulary by dynamic programming over prefixes.

For every prefix of a byte string exactly one token can end its encoding. Among the vocabulary
tokens that are suffixes of the prefix (all found by one run of an automaton) it is the one that
forms a valid pair with the last token of the prefix before it: two tokens are a valid pair when
merging across their border never comes before the merges inside them. Following the stored last
tokens back from the end gives the ids, the same as merging step by step.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lexloom.llm.spread import spread

#: Fixed value: the published split pattern of this byte-level vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write each byte as one printable character: printable ones stand
    for themselves, the others are numbered upward from U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixEncoder:
    """``encode(text)`` gives ids without special tokens; their strings are ordinary text.

    ``spec``: the content of a ``tokenizer.json`` with a byte-level BPE model. Encoded pieces are
    remembered up to ``remember`` of them, which changes nothing but the speed.
    """

    def __init__(self, spec: bytes, remember: int = 200_000):
        model = json.loads(spec)["model"]
        letters = _byte_letters()
        special = {t["content"] for t in json.loads(spec).get("added_tokens", ())}
        vocab: dict[str, int] = model["vocab"]
        raw = {t: "".join(chr(letters[c]) for c in t) for t in vocab if t not in special}
        self.pieces = regex.compile(PATTERN)
        self.length = np.zeros(max(vocab.values()) + 1, np.int64)
        self.merged: dict[tuple[int, int], int] = {}
        self.order: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for k, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            pair, whole = (vocab[a], vocab[b]), vocab[a + b]
            self.merged[pair] = k
            if whole not in self.order:
                self.order[whole], self.parts[whole] = k, pair
        self.automaton = ahocorasick.Automaton()
        for t, s in raw.items():
            i = vocab[t]
            if len(s) == 1 or i in self.parts:
                self.automaton.add_word(s, (i, len(s)))
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.known: dict[str, list[int]] = {}
        self.remember = remember

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens can stand side by side. Their last merges are undone in turn,
        latest first, and no pair met across the border may merge before what was undone."""
        key = (left, right)
        if (said := self.pairs.get(key)) is None:
            said = self._compatible(left, right)
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            self.pairs[key] = said
        return said

    def _compatible(self, left: int, right: int) -> bool:
        order, parts, merged = self.order, self.parts, self.merged
        # A merge across the border must come at or after this rank to be no obstacle. Of equal
        # merges on both sides the left one happens first, so the right one is undone first.
        limit = len(merged)
        while True:
            r = merged.get((left, right))
            if r is not None and r < limit:
                return False
            a, b = order.get(left, -1), order.get(right, -1)
            if a < 0 and b < 0:
                return True
            if a > b:
                limit, left = a, parts[left][1]
            else:
                limit, right = b + 1, parts[right][0]

    def piece(self, s: str) -> list[int]:
        """Ids of one piece, given as its bytes in Latin-1."""
        n = len(s)
        last, step = [-1] * (n + 1), [0] * (n + 1)
        ok = self.compatible
        for end, (t, size) in self.automaton.iter(s):
            end += 1
            if last[end] >= 0:
                continue
            begin = end - size
            if begin == 0 or (last[begin] >= 0 and ok(last[begin], t)):
                last[end], step[end] = t, size
        ids = []
        while n:
            if last[n] < 0:
                raise ValueError("the vocabulary lacks single bytes")
            ids.append(last[n])
            n -= step[n]
        return ids[::-1]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        known = self.known
        for p in self.pieces.findall(text):
            ids = known.get(p)
            if ids is None:
                ids = self.piece(p.encode("utf-8").decode("latin-1"))
                if len(p) <= 64:
                    if len(known) >= self.remember:
                        known.clear()
                    known[p] = ids
            out += ids
        return out


_ENCODERS: dict[bytes, PrefixEncoder] = {}


def encode_table(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``(doc_id, ids)`` for every row of ``docs (doc_id, text, ...)``; null and empty texts give
    an empty list, blank ones their tokens. Other columns are ignored. ``vocabulary`` is the path
    of a ``tokenizer.json`` on the driver; its bytes, of fixed size, are broadcast."""
    spark = docs.sparkSession
    with open(vocabulary, "rb") as f:
        spec = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = spec.value
        enc = _ENCODERS.get(raw) or _ENCODERS.setdefault(raw, PrefixEncoder(raw))
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                flat: list[int] = []
                ends = [0]
                for t in part.column(1).to_pylist():
                    flat += enc.encode(t)
                    ends.append(len(flat))
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["doc_id", "ids"])

    return spread(docs.select("doc_id", "text"), "doc_id").mapInArrow(run, "doc_id bigint, ids array<int>")
