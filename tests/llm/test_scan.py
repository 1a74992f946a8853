import random
import zlib

import pytest

from lexloom.llm import scan
from lexloom.llm.scan import BREAK, CONFUSIONS, Beginnings, _ops, calibrate, page_lines, read_pages, repaired_text, running, shape, spellings, train_editor, train_pages
from lexloom.llm.perceptron import Perceptron
from lexloom.tables import Scratch

WORDS = "the applicant shall file a permit with clerk no person may store material on lot without approval notice hearing officer building garage boundary fence drainage channel between section chapter original inspection amendment".split()
PAGE = "id string, body string, owner string, edition string"


def collection(seed=0, n=120):
    rng = random.Random(seed)
    sentence = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.randrange(8, 14))).capitalize() + "."
    clean = [" ".join(sentence() for _ in range(5)) for _ in range(n)]
    pages, truth = [], {}
    for i in range(n):
        ws = " ".join(sentence() for _ in range(6)).split()
        kinds = set()
        k = rng.randrange(5, len(ws) - 5)
        if len(ws[k]) > 4 and "." not in ws[k]:
            fits = [(a, b) for a, b in CONFUSIONS[:20] if b in ws[k].lower()[1:]]
            if fits:
                a, b = rng.choice(fits)
                right = ws[k].lower()
                wrong = right[0] + right[1:].replace(b, a, 1)
                if wrong not in WORDS:
                    ws[k] = wrong
                    kinds.add(("corrected", right))
        lines, line = [], ""
        for w in ws:
            if len(line) + len(w) > 46:
                lines.append(line)
                line = ""
            line = f"{line} {w}".strip()
        lines.append(line)
        at = next((j for j in range(1, len(lines) - 1) if lines[j].split()[-1].isalpha() and len(lines[j].split()[-1]) > 5 and lines[j].split()[-1] in WORDS), None)
        if at:
            w = lines[at].split()[-1]
            lines[at] = lines[at][: -len(w)] + w[:3] + "-"
            lines[at + 1] = w[3:] + " " + lines[at + 1]
            kinds.add(("joined", w))
        j = next((j for j in range(len(lines) - 2, 0, -1) if j != at and not lines[j - 1].endswith((".", "-")) and lines[j][0].islower()), None)
        if j:
            lines[j:j] = [f"- {i + 1} -", "RIVER TOWN CODE"]
            kinds |= {("dropped", str(j + 1)), ("dropped", str(j + 2))}
        pages.append((f"p{i}", "\n".join(lines), "river-town", "code-2020"))
        truth[f"p{i}"] = kinds
    return clean, pages, truth


def test_repairs(spark):
    clean, pages, truth = collection()
    repairs, saved = read_pages(spark.createDataFrame(pages + [("null", None, None, None)], PAGE), spark.createDataFrame([(c,) for c in clean], "body string"), Scratch(spark, "t"))
    got = {}
    for r in repairs.collect():
        got.setdefault(r.id, set()).add((r.kind, r.item))
    want = {(p, *x) for p, xs in truth.items() for x in xs}
    have = {(p, *x) for p, xs in got.items() for x in xs}
    for kind in ("dropped", "joined", "corrected"):
        w, h = ({x for x in s if x[1] == kind} for s in (want, have))
        assert len(w & h) >= 0.95 * len(w) and len(w & h) >= 0.95 * len(h), kind
    text = {r.id: r.text for r in repaired_text(saved, repairs).collect()}
    assert text["null"] == "" and not any("RIVER TOWN" in t or "\n" in t for t in text.values())


@pytest.mark.parametrize("model, kinds", [("train_editor", {"joined", "corrected"}), ("train_pages", {"dropped"})])
def test_rows_come_from_the_models(spark, monkeypatch, model, kinds):
    """Without the weights of a model none of its rows are left."""
    monkeypatch.setattr(scan, model, lambda *_: Perceptron())
    clean, pages, _ = collection()
    repairs, _ = read_pages(spark.createDataFrame(pages, PAGE), spark.createDataFrame([(c,) for c in clean], "body string"), Scratch(spark, "t"))
    found = {r.kind for r in repairs.select("kind").distinct().collect()}
    assert not found & kinds and found


def test_page_model_finds_more_than_its_examples(spark):
    """Examples are lines that cut a sentence; most headers between paragraphs are found, too."""
    rng, body, examples, between = random.Random(2), [], [], []
    for i in range(200):
        text = [" ".join(rng.choice(WORDS) for _ in range(8)) for _ in range(6)]
        if i % 2:
            text[2:3] = [text[2] + ".", f"- {i} -", "Next " + text[2] + "."]
        else:
            text[3:3] = [f"- {i} -"]
        body.append("\n".join(text))
    lines = [x for b in body for x in page_lines(b, "river-town", "code-2020")]
    cut = {s for _, s, c, _ in lines if c}
    examples = [(c, s in cut, f) for _, s, c, f in lines]
    model = train_pages(examples)
    between = [f for _, s, c, f in lines if s == "- 9 -" and not c]
    assert len(between) >= 90 and sum(scan.is_furniture(f, model) for f in between) >= 0.95 * len(between)


def test_nothing_to_read(spark):
    empty = spark.createDataFrame([], PAGE)
    repairs, _ = read_pages(empty, spark.createDataFrame([], "body string"), Scratch(spark, "t"))
    assert repairs.count() == 0


def test_pieces():
    assert shape("RIVER TOWN CODE", "river-town", "code-2020") == "T code" and shape("Chapter 3  Code 2020", "x", "code-2020") == "chapter 9 E"
    assert _ops("rn", "m") == ["R:m", "D"] and _ops("ﬁ", "fi") == ["R:fi"] and _ops("1", "l") == ["R:l"]
    whole, breaks = running(["A forty-", "eight foot ins-", "- 3 -", "pection.", "End 1-", "2"], {2})
    assert [(a, b) for _, _, a, b in breaks] == [("forty", "eight"), ("ins", "pection")] and whole == {"a", "foot", "end", "1", "2"}
    ops = {pair: 1.0 for pair in CONFUSIONS}
    model, known = train_editor(WORDS, ops, 1), beginnings_of(WORDS)
    slack = calibrate(WORDS, model, ops, 1.0, 1)
    assert "original" in spellings("0riginal", model, slack, known, ops)
    assert "boundary" in spellings("bouridory", model, slack, known, ops)
    assert spellings(f"bound{BREAK}ary", model, slack, known, ops) and not spellings(f"bound{BREAK}ary", Perceptron(), slack, known, ops)
    assert spellings("clerk", model, slack, known, ops)["clerk"][0] == 0 and not spellings("0riginal", Perceptron(), slack, known, ops)


def beginnings_of(words, bits=1 << 20):
    out = Beginnings({}, bits)
    for w in words:
        for i in range(1, len(w) + 1):
            at = zlib.crc32(w[:i].encode()) & (bits - 1)
            out.bits[at >> 3] |= 1 << (at & 7)
    return out


def test_beginnings_are_those_of_the_engine(spark):
    words = ["straße", "lot", "§x"]
    assert scan.beginnings(spark.createDataFrame([(w,) for w in words], "w string"), 1 << 20).bits == beginnings_of(words).bits


def test_very_long_words_and_pages(spark):
    body = "z" * 50_000 + "\n" + "l" * 30 + "-\n" + "i" * 60 + "\n" + "word " * 30_000
    repairs, saved = read_pages(spark.createDataFrame([("a", body, "o", "e")], PAGE), spark.createDataFrame([("word " * 9,)], "body string"), Scratch(spark, "t"))
    assert repairs.count() == 0 and len(repaired_text(saved, repairs).first().text) > 200_000


def test_all_learned_confusions_are_offered(spark):
    """Far more confusions than any sample: each is learned, trained and offered."""
    rng, abc = random.Random(9), "abcdefghijklmnopqrstuvwxyz"
    letters = lambda: "".join(rng.choice(abc) for _ in range(9))
    right, wrong = [], []
    for a in abc:
        for b in abc.replace(a, ""):
            for _ in range(2):
                x, y = letters(), letters()
                right.append(f"{x}{b}{y}")
                wrong.append(f"{x}{a}{y}")
    frame = lambda ws: spark.createDataFrame([(w,) for w in ws], "w string")
    learned, seen_in = scan.learn_confusions(frame(wrong), frame(right))
    assert {(a, b) for a in abc for b in abc if a != b} <= set(learned) and set(seen_in) <= set(right)


def test_rare_confusions_are_trained():
    """Frequent confusions take all places of the examples; a rare one is offered all the same."""
    often, rare = {pair: 1e9 for pair in CONFUSIONS}, {("w", "v"): 2.0}
    words = [w for w in WORDS if "v" not in w]
    model, known = train_editor(words, often | rare, 1, ["approval"]), beginnings_of([*words, "approval"])
    assert "approval" in spellings("approwal", model, 0.0, known, often | rare)
