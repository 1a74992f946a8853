"""Repair of text from scanned pages: page furniture, broken words, misread words.

Two averaged perceptrons are trained here, on no labels but the collection itself. One tells page
furniture from text by a short line's shape, how often it occurs and its place on the page; its
examples are lines that cut a running sentence in two, and lines of shapes that never do. The other
is a character editor: for every character it predicts keep, replace, delete, replace-and-insert or,
at a line's end, join with or without the hyphen. Its examples are words of clean sections, broken
and misread on purpose with confusions that are learned from the scanned words themselves. Spellings
are the sequences of operations that it offers; the clean vocabulary then says which of them are words.
"""

from __future__ import annotations

import math
import random
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.perceptron import Perceptron
from lexloom.llm.spread import scattered, spread
from lexloom.tables import Scratch

#: Shapes that optical recognition commonly takes for each other, misread and right.
CONFUSIONS = (
    ("0", "o"), ("1", "l"), ("1", "i"), ("2", "z"), ("5", "s"), ("6", "b"), ("8", "b"), ("9", "g"), ("c", "e"), ("e", "c"), ("o", "a"),
    ("i", "l"), ("l", "i"), ("f", "t"), ("q", "g"), ("h", "b"), ("b", "h"), ("rn", "m"), ("m", "rn"), ("ri", "n"), ("ii", "u"),
    ("cl", "d"), ("d", "cl"), ("vv", "w"), ("li", "h"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl"),
)
HYPHENS = "-‐‑¬­"
#: Letters of the longest word.
LONGEST = 64
#: Examples that the editor sees of a confusion at least.
RARE = 3
#: Stands for a hyphen at a line's end in the words that the editor reads.
BREAK = "\n"

_TOKEN = re.compile(r"[^\W_]+(?:-[^\W_]+)*")
_WORD = re.compile(r"[^\W_]+")
_BROKEN = re.compile(rf"([^\W_]+(?:-[^\W_]+)*)[{HYPHENS}]\s*$")
_NEXT = re.compile(r"\s*([^\W_]+(?:-[^\W_]+)*)")
_END = re.compile(r"[.!?:;][\"'”’)\]]*\s*$")


@dataclass(frozen=True)
class Scan:
    #: Scanned sections, and words of the clean vocabulary, on which the perceptrons are trained.
    page_sample: int = 3_000
    word_sample: int = 3_000
    #: Words held out of the editor's training, and the share of their misread characters whose right
    #: operation the editor must still offer: this sets how far below "keep" an operation may score.
    held_out: int = 300
    offered: float = 1.0
    #: A word counts as right spelling from this many clean occurrences.
    least: int = 3
    #: Bits of the map of word beginnings in which the editor's operations are followed (2 MB). It
    #: only saves work: every spelling is looked up afterwards.
    beginnings: int = 1 << 24
    seed: int = 5


# --- page furniture ---------------------------------------------------------------------------


def _skeleton(w: str) -> str:
    """A word with shapes that are taken for each other brought to one of them."""
    w = unicodedata.normalize("NFKC", w)
    for a, b in (("rn", "m"), ("ri", "n"), ("ii", "u"), ("cl", "d"), ("vv", "w"), ("0", "o"), ("1", "l"), ("5", "s"), ("6", "b"), ("2", "z")):
        w = w.replace(a, b)
    return w


def _alike(a: str, b: str) -> bool:
    if a == b:
        return True
    if min(len(a), len(b)) <= 3 or a.isdigit() or b.isdigit():
        return False
    a, b = _skeleton(a), _skeleton(b)
    return len(a) == len(b) and sum(x != y for x, y in zip(a, b)) <= 1


def shape(line: str, owner: str, edition: str) -> str:
    """A line with digits as 9, the owner's name as T and the edition's name as E."""
    own = [w for w in re.split(r"[^\w]+", owner.lower()) if w]
    ed = [w for w in re.split(r"[^\w]+", edition.lower()) if w]
    out: list[str] = []
    parts = re.findall(r"[^\W_]+|[^\w\s]|_", line.lower())
    i = 0
    while i < len(parts):
        for name, sign, least in ((own, "T", len(own)), (ed, "E", max(2, len(ed) - 1))):
            j = k = 0
            while i + j < len(parts) and k < len(name):
                if _alike(parts[i + j], name[k]):
                    k += 1
                elif parts[i + j].isalnum():
                    break
                j += 1
            if name and k >= least and k:
                while i + j < len(parts) and parts[i + j] in "()":
                    j += 1
                out.append(sign)
                i += j
                break
        else:
            out.append(re.sub(r"\d+", "9", parts[i]))
            i += 1
    return " ".join(out)


def _facts(lines: list[str], owner: str, edition: str) -> list[dict]:
    """For each line: what it looks like and how it stands between its neighbours."""
    full = [i for i, x in enumerate(lines) if x.strip()]
    sizes = sorted(len(lines[i]) for i in full)
    width = sizes[int(len(sizes) * 0.6)] if sizes else 1
    size = [len(" ".join(x.split())) for x in lines]
    limit = max(24, 0.75 * width)
    brief = [0 < n <= max(64, limit) and not re.search(r"[a-z]{2}[.;:,]\s*$", x) for x, n in zip(lines, size)]
    shapes = [shape(x, owner, edition) if s else "" for x, s in zip(lines, brief)]
    others = [sum(t.isalpha() and t not in "TE" for t in y.split()) for y in shapes]
    named = [bool({"T", "E"} & set(y.split())) and k <= 2 for y, k in zip(shapes, others)]
    short = [
        s and (g or n <= limit and (_page_number(y) or k <= 4 and not x.strip()[0].islower()))
        for x, y, s, g, n, k in zip(lines, shapes, brief, named, size, others)
    ]
    shapes = [y if s else "" for y, s in zip(shapes, short)]
    out = []
    for i, x in enumerate(lines):
        up = next((lines[j] for j in range(i - 1, -1, -1) if lines[j].strip() and not short[j]), None)
        down = next((lines[j] for j in range(i + 1, len(lines)) if lines[j].strip() and not short[j]), None)
        cuts = bool(short[i] and up is not None and down is not None and not _END.search(up) and len(up.strip()) > 0.6 * width and down.lstrip()[0].islower())
        out.append({"short": short[i], "shape": shapes[i], "cuts": cuts, "near": [shapes[j] for j in (i - 1, i + 1) if 0 <= j < len(lines)], "edge": i == full[0] or i == full[-1] if full else True})
    return out


def _page_number(s: str) -> bool:
    return bool(re.fullmatch(r"(?:[\[\](){}\-–—|•*~. ]|p|pg|page|of|9)*9(?:[\[\](){}\-–—|•*~. ]|of|9)*", s)) and "( 9" not in s


def _bucket(n: float) -> int:
    return int(math.log2(n)) if n >= 1 else 0


def line_features(line: str, s: str, i: int, lines: list[str], near: list[str], width: float) -> list[str]:
    """What a line looks like and where on the page it stands. Whether it cuts a sentence is no
    feature: that is what the examples are told by."""
    tokens = s.split()
    letters = [t for t in tokens if t.isalpha() and t not in "TE"]
    upper = sum(c.isupper() for c in line) > 0.6 * max(1, sum(c.isalpha() for c in line))
    blank = lambda j: "end" if not 0 <= j < len(lines) else "blank" if not lines[j].strip() else "text"
    named = [n for n, t in (("T", "T" in tokens), ("E", "E" in tokens)) if t]
    out = [
        "bias", f"shape={s}", f"named={named}", f"words={min(len(letters), 3)}", f"number={_page_number(s)}", f"upper={upper and bool(letters or named)}",
        f"only={bool(named) and not letters}", f"above={blank(i - 1)}", f"below={blank(i + 1)}", f"deep={len(line) - len(line.lstrip()) > 0.2 * width}",
        f"feed={chr(12) in line}", f"wide={int(4 * len(line.strip()) / max(1, width))}",
        f"near={any(_page_number(t) or {'T', 'E'} & set(t.split()) for t in near if t)}", f"alone={not any(near)}",
    ]
    out += [f"first={tokens[0]}", f"last={tokens[-1]}", f"ends={tokens[0]}~{tokens[-1]}"] if tokens else ["first="]
    out += [f"by={t}" for t in near if t]
    # Parts of words still show a misread header for what it is.
    out += [f"part={w[k : k + 3]}" for w in map(_skeleton, letters) if len(w) > 4 for k in range(len(w) - 2)]
    return out + [f"signs={'.'.join(t for t in tokens if not t.isalnum())}", f"figures={sum(t[0] == '9' for t in tokens)}"]


def page_lines(body: str, owner: str, edition: str) -> list[tuple[int, str, bool, list[str]]]:
    """The short lines of a page: number (from 0), shape, whether it cuts a sentence, features."""
    lines = body.split("\n")
    sizes = sorted(len(x) for x in lines if x.strip())
    width = sizes[int(len(sizes) * 0.6)] if sizes else 1
    return [
        (i, f["shape"], f["cuts"], line_features(x, f["shape"], i, lines, f["near"], width))
        for i, (x, f) in enumerate(zip(lines, _facts(lines, owner, edition))) if f["short"]
    ]


def train_pages(examples: list[tuple[bool, bool, list[str]]], folds: int = 4) -> Perceptron:
    """From lines (cuts a sentence; its shape ever does; features). Lines that cut a sentence are
    furniture; lines of a shape that never does are taken for text, but for those that models trained
    on the other lines find to be like furniture; the rest, which one cannot tell, are no example."""
    mixed = [(f, "drop" if cut else "keep") for cut, ever, f in examples if cut or not ever]
    random.Random(3).shuffle(mixed)

    def fit(data: list[tuple[list[str], str]]) -> Perceptron:
        return Perceptron().train(data, 5, ["keep", "drop"])

    sure = []
    for k in range(folds):
        model = fit([one for j, one in enumerate(mixed) if j % folds != k])
        sure += [(f, label) for f, label in mixed[k::folds] if label == "drop" or not is_furniture(f, model)]
    random.Random(4).shuffle(sure)
    return fit(sure)


def is_furniture(features: list[str], model: Perceptron) -> bool:
    s = model.scores(features)
    return s.get("drop", 0.0) > s.get("keep", 0.0)


# --- running text -----------------------------------------------------------------------------


def running(lines: list[str], dropped: set[int]) -> tuple[set[str], list[tuple[int, int, str, str]]]:
    """Whole words of the kept lines, and the words broken over two of them: (line, next line,
    left part, right part)."""
    kept = [i for i, x in enumerate(lines) if i not in dropped and x.strip()]
    breaks, whole = [], set()
    start = {}
    for i, j in zip(kept, kept[1:]):
        a, b = _BROKEN.search(lines[i]), _NEXT.match(lines[j])
        if a and b and re.search(r"[^\W\d_]", a.group(1)) and re.search(r"[^\W\d_]", b.group(1)) and not b.group(1)[0].isupper() | a.group(1).isdigit():
            breaks.append((i, j, a.group(1).lower(), b.group(1).lower()))
            start[j] = b.end()
    ends = {i: _BROKEN.search(lines[i]).start(1) for i, *_ in breaks}
    for i in kept:
        whole.update(_WORD.findall(lines[i][start.get(i, 0) : ends.get(i, len(lines[i]))].lower()))
    return whole, breaks


# --- character editor -------------------------------------------------------------------------


def char_features(w: str, i: int) -> list[str]:
    p = f"^^{w}$$"
    a, b, c, d, e = p[i], p[i + 1], p[i + 2], p[i + 3], p[i + 4]
    return ["b", f"c={c}", f"bc={b}{c}", f"cd={c}{d}", f"abc={a}{b}{c}", f"bcd={b}{c}{d}", f"cde={c}{d}{e}", f"abcde={a}{b}{c}{d}{e}"]


def _ops(wrong: str, right: str) -> list[str]:
    """Edits of the characters of ``wrong`` that give ``right``."""
    out = [f"R:{b}" for _, b in zip(wrong, right)]
    out += ["D"] * (len(wrong) - len(right))
    if len(right) > len(wrong):
        out[-1] = f"R:{right[len(wrong) - 1 :]}"
    return out


class Runs:
    """Confusions by their run as read, or as it should be, so that their number costs no time."""

    def __init__(self, confusions: Iterable[tuple[str, str]], right: bool = False):
        self.at: dict[str, list[tuple[int, str, str]]] = {}
        for k, (a, b) in enumerate(confusions):
            self.at.setdefault(b if right else a, []).append((k, a, b))
        self.sizes = sorted({len(run) for run in self.at})

    def of(self, w: str) -> list[tuple[int, int, str, str]]:
        """Those that fit somewhere in a word: number, place, run as read, run as it should be."""
        return sorted((k, i, a, b) for i in range(len(w)) for n in self.sizes if i + n <= len(w) for k, a, b in self.at.get(w[i : i + n], ()))


def _misread(w: str, confusions: dict[tuple[str, str], float], runs: Runs, rng: random.Random, most: int) -> Iterator[tuple[str, int, list[str], tuple[str, str]]]:
    """Misread forms of a word, each with the place, the operations that set it right and the
    confusion; frequent ones come more often. ``runs`` has the confusions by the right reading."""
    fits = [(a, b, i) for _, i, a, b in runs.of(w)]
    fits.sort(key=lambda t: -(rng.random() ** (1 / confusions[t[:2]])))
    for a, b, i in fits[:most]:
        yield w[:i] + a + w[i + len(b) :], i, _ops(a, b), (a, b)


def _split(w: str, rng: random.Random) -> tuple[str, int, list[str]] | None:
    """A word broken over two lines: at its own hyphen (H), or inside a part (J)."""
    own = [i for i, c in enumerate(w) if c == "-"]
    if own and rng.random() < 0.5:
        return w, rng.choice(own), ["H"]
    at = [i for i in range(2, len(w) - 1) if "-" not in w[i - 1 : i + 1]]
    if not at:
        return None
    i = rng.choice(at)
    return f"{w[:i]}{BREAK}{w[i:]}", i, ["J"]


def train_editor(words: list[str], confusions: dict[tuple[str, str], float], seed: int, more: Iterable[str] = ()) -> Perceptron:
    """From words as they are, misread and broken. Frequent confusions come more often, but each comes
    ``RARE`` times, if need be in words of ``more``, or as often as it fits: an operation that is in no
    example would never be offered."""
    rng, data, runs, drawn = random.Random(seed), [], Runs(confusions, right=True), Counter()
    example = lambda x, i, ops: [(char_features(x, j), ops[j - i] if 0 <= j - i < len(ops) else "K") for j in range(len(x))]
    for w in words:
        data.append([(char_features(w, i), "K") for i in range(len(w))])
        for x, i, ops, pair in _misread(w, confusions, runs, rng, 5):
            data.append(example(x, i, ops))
            drawn[pair] += 1
        for _ in range(2):
            if broken := _split(w, rng):
                x, i, ops = broken
                x = x[:i] + BREAK + x[i + 1 :]
                data.append([(char_features(x, i), ops[0])])
    if any(drawn[pair] < RARE for pair in confusions):
        for w in [*words, *more]:
            for _, i, a, b in runs.of(w):
                if drawn[a, b] < RARE:
                    data.append(example(w[:i] + a + w[i + len(b) :], i, _ops(a, b)))
                    drawn[a, b] += 1
    rng.shuffle(data)
    flat = [one for word in data for one in word]
    return Perceptron().train(flat, 3, sorted({label for _, label in flat}))


def calibrate(words: list[str], model: Perceptron, confusions: dict[tuple[str, str], float], share: float, seed: int) -> float:
    """How far below "keep" an operation may score: held-out words are misread, and of the operations
    that set them right ``share`` must be offered."""
    rng, short, runs = random.Random(seed + 1), [], Runs(confusions, right=True)
    for w in words:
        for x, i, ops, _ in _misread(w, confusions, runs, rng, 5):
            for j, o in enumerate(ops):
                s = model.scores(char_features(x, i + j))
                short.append(s.get("K", 0.0) - s.get(o, 0.0))
    short.sort()
    return max(0.0, short[min(len(short) - 1, int(share * len(short)))]) if short else 0.0


class Beginnings:
    """A bit for every beginning of a known word, by CRC-32."""

    def __init__(self, pages: dict[int, bytes], bits: int):
        self.mask, self.bits = bits - 1, bytearray(bits // 8)
        for page, held in pages.items():
            self.bits[page * 4096 : page * 4096 + len(held)] = held

    def step(self, crc: int, out: str) -> int:
        """The state after ``out``, or -1 where no known word goes on so."""
        for c in out:
            crc = zlib.crc32(c.encode(), crc)
            at = crc & self.mask
            if not self.bits[at >> 3] >> (at & 7) & 1:
                return -1
        return crc


def beginnings(vocabulary: DataFrame, bits: int) -> Beginnings:
    prefix = F.explode(F.transform(F.sequence(F.lit(1), F.length("w")), lambda i: F.expr("w").substr(F.lit(1), i)))
    slot = vocabulary.select(prefix.alias("p")).select(F.crc32(F.col("p").cast("binary")).bitwiseAND(bits - 1).alias("s"))
    held = slot.groupBy(F.shiftright("s", 15).alias("page")).agg(F.bitmap_construct_agg(F.col("s").bitwiseAND(32767)).alias("b"))
    return Beginnings({r["page"]: bytes(r["b"]) for r in held.collect()}, bits)


def _offers(w: str, model: Perceptron, slack: float, confusions: Runs) -> list[list[tuple[int, str, int, float]]]:
    """For each place of a word what the editor offers there: characters read, text written, places
    changed, and the score above keeping them."""
    s = [model.scores(char_features(w, i)) for i in range(len(w))]
    out: list[list[tuple[int, str, int, float]]] = [[(1, c, 0, 0.0)] if c != BREAK else [] for c in w]
    for _, i, a, b in confusions.of(w):
        gains = [s[i + j].get(o, 0.0) - s[i + j].get("K", 0.0) if o in s[i + j] else -math.inf for j, o in enumerate(_ops(a, b))]
        if min(gains) >= -slack:
            out[i].append((len(a), b, 1, sum(gains)))
    for i, c in enumerate(w):
        best = max(s[i].get("J", 0.0), s[i].get("H", 0.0)) if c == BREAK else 0.0
        if c == BREAK and best > s[i].get("K", 0.0):
            out[i] = [(1, text, 0, s[i][o] - best) for o, text in (("J", ""), ("H", "-")) if o in s[i]]
    return out


def spellings(w: str, model: Perceptron, slack: float, known: Beginnings, confusions: Runs | Iterable[tuple[str, str]]) -> dict[str, tuple[int, float]]:
    """Spellings that the editor's operations give, each with the number of changed places and the
    score above keeping the word as it is: every sequence of operations it was trained on that score
    no more than ``slack`` below "keep" and go along beginnings of known words. At a break ``J`` and
    ``H`` are the operations, and the better of them is the measure; where neither exceeds "keep" the
    line end breaks no word."""
    offers, out = _offers(w, model, slack, confusions if isinstance(confusions, Runs) else Runs(confusions)), {}
    open_ = [(0, 0, "", 0, 0.0)]
    while open_:
        i, crc, done, n, score = open_.pop()
        if i == len(w):
            if done and (done not in out or out[done][1] < score):
                out[done] = (n, score)
            continue
        for read, text, k, gain in offers[i]:
            after = known.step(crc, text)
            if after >= 0:
                open_.append((i + read, after, done + text, n + k, score + gain))
    return out


def _wildcards(word: str) -> list[tuple[str, str]]:
    """A word with a run of one or two characters left out, and the run."""
    return [(f"{word[:i]}\x00{word[i + n :]}", word[i : i + n]) for n in (1, 2) for i in range(len(word) - n + 1)]


def _explode_wildcards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(k, run, w) for w in b["w"] if len(w) >= 4 and BREAK not in w for k, run in _wildcards(w)]
        yield pd.DataFrame(rows, columns=["k", "run", "w"])


def learn_confusions(unknown: DataFrame, vocabulary: DataFrame) -> tuple[dict[tuple[str, str], float], list[str]]:
    """Runs of one or two characters in which an unknown word differs from exactly one known one,
    each with its right reading and how often it was seen, and known words in which they were seen.
    All that were seen twice: their number is bounded by the characters in use, not by the rows.
    Swapped neighbours are slips of the pen, not of the eye."""
    wild = "k string, run string, w string"
    a = unknown.select("w").mapInPandas(_explode_wildcards, wild)
    b = vocabulary.select("w").mapInPandas(_explode_wildcards, wild).select("k", F.col("run").alias("right"), F.col("w").alias("v"))
    pairs = a.join(b, "k").where(
        "run != right and left(run, 1) != left(right, 1) and right(run, 1) != right(right, 1) and run != reverse(right) and length(w) >= 5 and (length(run) = 1 or length(right) = 1)"
    ).distinct()
    one = pairs.groupBy("w").agg(F.count_distinct("v").alias("n"), F.first(F.struct("run", "right")).alias("p"), F.min("v").alias("v")).where("n = 1")
    found = one.groupBy("p.run", "p.right").agg(F.count("*").alias("n"), F.min("v").alias("v")).where("n >= 2").orderBy(F.desc("n"), "run", "right").collect()
    out = {pair: 2.0 for pair in CONFUSIONS}
    return out | {(r[0], r[1]): out.get((r[0], r[1]), 0.0) + r[2] for r in found}, [r[3] for r in found]


# --- the operator -----------------------------------------------------------------------------


def _short_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for key, body, owner, edition in b[["id", "body", "owner", "edition"]].itertuples(index=False):
            rows += [(key, *line) for line in page_lines(body, owner, edition)]
        yield pd.DataFrame(rows, columns=["id", "line", "shape", "cuts", "features"])


def find_furniture(pages: DataFrame, scratch: Scratch, cfg: Scan) -> DataFrame:
    """``(id, line)``, line from 0, of the lines that are only running header, footer or page number.
    How often a line's shape occurs, and cuts sentences, is counted over all pages."""
    spark = pages.sparkSession
    lines = spread(pages, "id").mapInPandas(_short_lines, "id string, line int, shape string, cuts boolean, features array<string>")
    lines = scratch.save(lines, "lines")
    seen = lines.groupBy("shape").agg(F.count("*").alias("n"), F.max("cuts").alias("ever"))
    all_ = pages.count()
    often = F.concat(F.lit("often="), F.floor(F.log2(F.col("n") / F.lit(max(1, all_)))).cast("string"))
    lines = lines.join(seen, "shape").select("id", "line", "cuts", "ever", F.concat("features", F.array(often)).alias("features"))
    sample = pages.select("id").orderBy(F.xxhash64("id"), "id").limit(cfg.page_sample)
    asked = lines.join(sample, "id").orderBy("id", "line").select("cuts", "ever", "features").toPandas()
    model = spark.sparkContext.broadcast(train_pages([(bool(c), bool(e), list(f)) for c, e, f in asked.itertuples(index=False)]))

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[[is_furniture(f, model.value) for f in b["features"]]][["id", "line"]]

    return scratch.save(lines.select("id", "line", "features").mapInPandas(decide, "id string, line int"), "furniture")


def read_pages(pages: DataFrame, clean: DataFrame, scratch: Scratch, cfg: Scan = Scan()) -> tuple[DataFrame, DataFrame]:
    """What is to be repaired in ``pages (id, body, owner, edition)``, by the words of ``clean (body)``.

    Result: ``repairs (id, kind, item, line, wrong, right)`` with kind ``dropped`` (item: number of
    the line from 1), ``joined`` (item: the word; wrong: its parts with a line feed between; line:
    where it begins) and ``corrected`` (item: right spelling; wrong: as read), and ``pages`` as
    saved. One row per id; null bodies are empty and need no repair. Vocabulary and shape counts
    cover all rows; only the training sets are samples, of the sizes in ``cfg``. With no clean
    text, words read often enough in the pages themselves are the vocabulary. Words of more than
    ``LONGEST`` letters are debris: neither right spellings nor set right.

    What is dropped, joined and corrected is decided by the two models: without weights they drop,
    join and correct nothing.
    """
    spark = pages.sparkSession
    pages = scratch.save(pages.where("id is not null").select("id", *(F.coalesce(c, F.lit("")).alias(c) for c in ("body", "owner", "edition"))), "pages")
    source = clean if not clean.isEmpty() else pages
    least = cfg.least if source is clean else cfg.least * 2
    text = F.lower(F.coalesce("body", F.lit("")))
    token = r"[\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)*"
    both = F.concat(F.regexp_extract_all(text, F.lit(token), F.lit(0)), F.filter(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: F.length(w) > 0))
    words = source.select(F.explode(both).alias("w")).where(f"w rlike '[^0-9-]' and length(w) <= {LONGEST}").groupBy("w").agg(F.count("*").alias("n"))
    vocabulary = scratch.save(words.where(F.col("n") >= least) if source is pages else words, "vocabulary")
    good = vocabulary.where(F.col("n") >= least)

    out = find_furniture(pages, scratch, cfg).groupBy("id").agg(F.collect_list("line").alias("out"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [running(body.split("\n"), set(o) if o is not None else set()) for body, o in zip(b["body"], b["out"])]
            yield pd.DataFrame({
                "id": b["id"], "out": b["out"], "words": [sorted(w) for w, _ in found],
                "breaks": [[{"line": i + 1, "a": x, "b": y} for i, _, x, y in breaks] for _, breaks in found],
            })

    kept = "id string, out array<int>, words array<string>, breaks array<struct<line int, a string, b string>>"
    parts = scratch.save(pages.select("id", "body").join(out, "id", "left").mapInPandas(read, kept), "parts")
    plain = parts.select("id", F.explode("words").alias("w")).where(f"w rlike '[^0-9]' and length(w) between 2 and {LONGEST}")
    broken = parts.select("id", F.explode("breaks").alias("e")).select("id", "e.line", "e.a", "e.b", F.concat_ws(BREAK, "e.a", "e.b").alias("w")).where(f"length(w) <= {LONGEST}")
    unknown = scratch.save(plain.select("w").distinct().join(vocabulary, "w", "left_anti"), "unknown")
    confusions, seen_in = learn_confusions(unknown, good)
    known = good.where("length(w) > 2").orderBy(F.desc("n"), "w").limit(cfg.word_sample + cfg.held_out).collect()
    order = sorted((r[0] for r in known), key=lambda w: zlib.crc32(w.encode()))
    held = order[: min(cfg.held_out, len(order) // 4)]
    model = train_editor(order[len(held) :], confusions, cfg.seed, seen_in)
    editor = spark.sparkContext.broadcast((model, calibrate(held, model, confusions, cfg.offered, cfg.seed), beginnings(vocabulary, cfg.beginnings), Runs(confusions)))

    def edit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(w, v, n, score) for w in b["w"] for v, (n, score) in spellings(w, *editor.value).items()]
            yield pd.DataFrame(rows, columns=["w", "v", "places", "score"])

    asked = unknown.select("w").unionByName(broken.select("w").distinct())
    offered = scattered(asked, "w").mapInPandas(edit, "w string, v string, places int, score double")
    # A word read as it stands in any clean text is right; an edit needs a word of the good ones.
    fits = offered.join(vocabulary.select(F.col("w").alias("v"), "n"), "v").where((F.col("places") == 0) | (F.col("n") >= least))
    fixes = scratch.save(fits.groupBy("w").agg(F.max_by(F.struct("v", "places"), F.struct(F.col("score") + F.lit(0.5) * F.log("n"), "v")).alias("f")).select("w", "f.v", "f.places"), "fixes")

    def hyphen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The editor's operation at a break: no word, or none known, may tell it."""
        for b in batches:
            s = [editor.value[0].scores(char_features(x, x.index(BREAK))) for x in b["w"]]
            best = [max(("K", "J", "H"), key=lambda o: v.get(o, 0.0)) for v in s]
            yield b.assign(op=best)

    cut = broken.join(fixes, "w", "left").mapInPandas(hyphen, "w string, id string, line int, a string, b string, v string, places int, op string").where("op != 'K'")
    cut = cut.withColumn("plain", F.when(F.col("op") == "H", F.concat_ws("-", "a", "b")).otherwise(F.concat("a", "b"))).withColumn("item", F.coalesce("v", "plain"))
    none = F.lit(None).cast("string")
    dropped = parts.select("id", F.explode("out").alias("l")).select("id", F.lit("dropped").alias("kind"), (F.col("l") + 1).cast("string").alias("item"), (F.col("l") + 1).alias("line"), none.alias("wrong"), none.alias("right"))
    joined = cut.select("id", F.lit("joined").alias("kind"), "item", "line", F.col("w").alias("wrong"), F.col("item").alias("right"))
    misread = cut.where("places > 0").select("id", F.lit("corrected").alias("kind"), "item", "line", F.concat("a", "b").alias("wrong"), F.col("item").alias("right"))
    single = plain.join(fixes, "w").select("id", F.lit("corrected").alias("kind"), F.col("v").alias("item"), F.lit(0).alias("line"), F.col("w").alias("wrong"), F.col("v").alias("right"))
    return scratch.save(dropped.unionByName(joined).unionByName(misread).unionByName(single), "repairs"), pages


def repaired_text(pages: DataFrame, repairs: DataFrame) -> DataFrame:
    """``(id, text)``: paragraphs set apart by a blank line, each on one line of its own."""
    per_page = repairs.groupBy("id").agg(F.collect_list(F.struct("kind", "item", "line", "wrong", "right")).alias("r"))

    def cased(old: str, new: str) -> str:
        return new.upper() if old.isupper() and len(old) > 1 else new[:1].upper() + new[1:] if old[:1].isupper() else new

    def rebuild(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for body, rs in zip(b["body"], b["r"]):
                rs = rs if rs is not None else []
                drop = {r["line"] - 1 for r in rs if r["kind"] == "dropped"}
                fixed = {r["wrong"]: r["right"] for r in rs if r["kind"] == "corrected" and r["line"] == 0}
                joins = {(r["line"] - 1): r["right"] for r in rs if r["kind"] == "joined"}
                lines, text, gap, after_drop = body.split("\n"), "", False, False
                word = lambda m: cased(m.group(0), fixed.get(m.group(0).lower(), m.group(0).lower())) if m.group(0).lower() in fixed else m.group(0)  # noqa: B023, E731
                pending = None
                for i, raw in enumerate(lines):
                    if i in drop:
                        after_drop = True
                        continue
                    if not raw.strip():
                        gap = True
                        continue
                    line = raw.strip()
                    if pending is not None:
                        m = _NEXT.match(line)
                        line, glue = line[m.end() :] if m else line, pending
                        text, pending, gap, after_drop = text + glue, None, False, False
                    elif text:
                        runs_on = after_drop and not _END.search(text)
                        text += " " if (not gap or runs_on) else "\n\n"
                    gap = after_drop = False
                    tail = None
                    if i in joins and (m := _BROKEN.search(line)):
                        tail = cased(m.group(1), joins[i])
                        line = line[: m.start(1)]
                    text += _WORD.sub(word, line)
                    pending = tail
                out.append(text + (pending or ""))
            yield pd.DataFrame({"id": b["id"], "text": out})

    return pages.join(per_page, "id", "left").select("id", "body", "r").mapInPandas(rebuild, "id string, text string")
