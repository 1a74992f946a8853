import os
import random

import pytest

from lexloom.llm.tokenizer import PrefixEncoder, encode_table

SPEC = "/opt/tokenizers/byte_bpe_50k.json"
pytestmark = pytest.mark.skipif(not os.path.exists(SPEC), reason="no vocabulary file")


@pytest.fixture(scope="module")
def both():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(SPEC)
    t.encode_special_tokens = True
    with open(SPEC, "rb") as f:
        return PrefixEncoder(f.read()), lambda x: t.encode(x, add_special_tokens=False).ids


def test_same_ids_as_merging(both):
    mine, theirs = both
    rng = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyzABC éßñ日本語ع☃🙂‍ \t\n\r 0123456789.,;:'\"-—()<>|_=\x00"
    texts = ["", " ", "  x", "<|endoftext|> a", "it's we'll I'D", "a" * 3000, "ab" * 1500, "́combining", "x y"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(200))) for _ in range(400)]
    texts += ["".join(rng.choice("aeinorst") for _ in range(300)) for _ in range(200)]
    for t in texts:
        assert mine.encode(t) == theirs(t), repr(t[:60])


def test_round_trip_and_table(spark, both):
    mine, _ = both
    df = spark.createDataFrame([(1, "The zoning code.", "x"), (2, None, "x"), (3, "", "x"), (4, " ", "x")], "doc_id long, text string, ids string")
    got = {r.doc_id: r.ids for r in encode_table(df, SPEC).collect()}
    assert got == {1: mine.encode("The zoning code."), 2: [], 3: [], 4: [220]}
    assert encode_table(df.limit(0), SPEC).count() == 0
