import pytest

from lexloom.llm.quality import Quality, classify, describe, text_statistics

PROSE = "The applicant shall file a permit with the clerk. No person may store material on the lot without approval."
KNOWN = set(PROSE.lower().replace(".", "").split()) | {"zone", "front", "side", "lot", "area", "contents", "general", "uses", "fees", "shed", "wall", "garage", "pool", "ft"}
CASES = {
    "prose": [PROSE, PROSE + "\n\n" + PROSE, "(a) " + PROSE + "\n\n(b) " + PROSE, PROSE * 3 + "\n- shed\n- wall", "", " \n\t", None, PROSE.upper(), "\n".join(PROSE[i : i + 40] for i in range(0, 100, 40))],
    "list": ["CONTENTS\n" + "\n".join(f"General uses ......... {i}" for i in range(8)), "\n".join(f"• Shed wall" for _ in range(6)), "\n".join(f"{i}) Garage pool" for i in range(1, 9)), "\n".join(f"Sec. {i}-{i}. General uses" for i in range(1, 9)), "Shed, 1-2, 3-44\nWall, 9-1\nGarage, 2-2, 5-1, 6-6\nPool, 1-1", "Permitted uses:\n(a) shed;\n(b) wall;\n(c) garage;\n(d) pool;"],
    "table": ["| Zone | Lot | Front |\n| --- | --- | --- |\n| R-1 | 20 | 30% |\n| R-2 | 5 ft | - |", "Zone\tLot\tFront\nR-1\t1\t2\nR-2\t\t3", "Zone        Lot area    Front\nR-1         12          30 ft\nR-2                     40\nR-3         1           2", "Zone, Lot, Front\nR-1, 2, 3\nR-2, 4 ft, 5", "Zone;Lot;Front\nR-1;2;3\nR-2;4;5", PROSE + "\n" + "\n".join(f"{x}              $9.{i}0  each" for i, x in enumerate(["shed wall", "pool", "garage wall", "lot area", "side"]))],
    "junk": ["�" * 60 + " ■□■□", "zzq " * 30, "\n".join('<div class="c1"><a href="#n1"></a></div>' for _ in range(5)), "\n".join(f"var _{i}=function(){{return {i}^0x1f}};" for i in range(6)), "QkFzZTY0ZGF0YUxvbmdTdHJpbmdIZXJlV2l0aG91dFNwYWNlcw" * 3, "x1v |qz bcd fgh jklm npq rstv wxz |l bdf ghj klm npqr stv", "~:^*<#:#/@_||}<+/+ #+|^_|{+{/{]}~^+"],
}


@pytest.mark.parametrize("kind,text", [(k, t) for k, ts in CASES.items() for t in ts])
def test_kinds(kind, text):
    assert classify(describe(text, KNOWN, KNOWN), Quality()) == kind


def test_statistics(spark):
    df = spark.createDataFrame([(1, "One two. Three!\nfour"), (2, None), (3, ""), (4, "One two. Three!\nfour"), (5, "One two. Three!\nfour")], "doc_id long, text string").selectExpr("*", "1 as n_words")
    got = {r.doc_id: r for r in text_statistics(df).collect()}
    assert len(got) == 5
    r = got[1]
    assert (r.n_words, r.n_lines, r.line_end_ratio, r.distinct_ratio) == (4, 2, 0.5, 1.0)
    assert r.mean_word_length == pytest.approx(15 / 4) and r.symbol_ratio == pytest.approx(2 / 17) and r.common_ratio == 1.0
    assert got[2].n_words == 0 and got[2].kind == got[3].kind == "prose"
    assert text_statistics(df.limit(0)).count() == 0


NAMES = ["Shed", "Garage wall", "Front lot", "Pool", "Side area", "Zone uses", "Wall", "Lot contents"]
WRAPPED = [PROSE[i : i + 36] for i in range(0, 105, 36)] * 3
ONLY_LAYOUT = {
    "list": ["\n".join("    " + x for x in NAMES), "\n".join(f"{x}\n    near the clerk\n    no fees" for x in NAMES), "Permitted uses\n" + "\n".join(NAMES)],
    "table": ["\n".join(f"Zone{i} {i * 37 % 90 + 10} {i * 53 % 900 + 100} ft" for i in range(1, 9))],
    "prose": ["\n".join(WRAPPED), "\n".join("    " + x for x in WRAPPED), "No person\nmay store\nmaterial on\nthe lot without\napproval the\napplicant shall\nfile with\nthe clerk."],
}


@pytest.mark.parametrize("kind,text", [(k, t) for k, ts in ONLY_LAYOUT.items() for t in ts])
def test_kinds_that_only_repeating_layout_decides(kind, text):
    f = describe(text, KNOWN | {"permitted", "near", "the", "clerk", "no"}, KNOWN)
    assert max(f["row_ratio"], f["entry_ratio"]) <= Quality().most
    assert classify(f, Quality()) == kind


def test_readable_words_are_counted_over_distinct_texts(spark):
    debris = "uvo xaqe ziro kyle baqu ewo iqua oze vuxa aqyl"
    prose = [f"{PROSE} Permit {i}." for i in range(60)]
    rich = [" ".join("wo" + "".join("abcdefghij"[int(c)] for c in str(n)) for n in range(6000)) + f" {i}" for i in range(4)]
    minority = ["La piscina no podrá ser reparada cerca de la escuela " + x for x in ("norte", "sur", "este")]
    texts = prose + rich + minority + [debris] * 10
    got = {r.doc_id: r.kind for r in text_statistics(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == ["prose"] * 67 + ["junk"] * 10


def test_texts_too_few_to_tell_readable_words(spark):
    df = spark.createDataFrame([(1, PROSE), (2, "Another wall stands by the pool."), (3, "zzq " * 30)], "doc_id long, text string")
    assert {r.doc_id: r.kind for r in text_statistics(df).collect()} == {1: "prose", 2: "prose", 3: "junk"}


BY_INDENT = "\n".join(f"{x}\n    near the clerk {'of the general uses ' * (i % 3)}\n    no fees{' for the pool' * (i % 2)}" for i, x in enumerate(NAMES))
BY_LENGTH = "\n".join(f"{x}\nNear the clerk of the general" for x in ("Shed", "Wall", "Pool", "Zone", "Lots", "Uses", "Fees", "Side"))
ALIGNED = ONLY_LAYOUT["table"][0]


@pytest.mark.parametrize("signal,text", [("indent", BY_INDENT), ("length", BY_LENGTH), ("alignment", ALIGNED)])
def test_each_layout_signal_decides(signal, text, monkeypatch):
    """Without the one signal the text is no list or table any more."""
    from lexloom.llm import quality

    known = KNOWN | {"near", "the", "clerk", "no", "of", "for", "lots"}
    kind = classify(describe(text, known, known), Quality())
    assert kind == ("table" if signal == "alignment" else "list")
    plain = quality._periodic
    if signal == "indent":
        monkeypatch.setattr(quality, "_periodic", lambda lines, size, indent: plain(lines, size, indent * 0))
    elif signal == "length":
        monkeypatch.setattr(quality, "_autocorrelation", lambda x: 0.0)
    else:
        monkeypatch.setattr(quality, "_periodic", lambda lines, size, indent: plain([x.replace(" ", " " * (1 + i % 3), 1) for i, x in enumerate(lines)], size, indent))
    assert classify(describe(text, known, known), Quality()) != kind


def test_readable_words_of_a_language_stay_so_as_others_grow(spark):
    own = ["la piscina no podrá ser reparada cerca de la escuela " + x for x in ("norte", "sur", "este", "oeste", "vieja", "nueva")]
    docs = [(i, f"{PROSE} Permit {i}.", "en") for i in range(300)] + [(1000 + i, x, "ES") for i, x in enumerate(own)]
    docs += [(2000 + i, "uvo xaqe ziro kyle baqu ewo iqua oze vuxa aqyl" + " q" * i, None) for i in range(6)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    cfg = Quality(least_share=0.1)
    got = {r.doc_id: r.kind for r in text_statistics(df, cfg).collect()}
    assert all(got[1000 + i] == "prose" for i in range(6)) and all(got[2000 + i] == "junk" for i in range(6))
    assert {r.kind for r in text_statistics(df.drop("lang"), cfg).where("doc_id between 1000 and 1999").collect()} == {"junk"}
