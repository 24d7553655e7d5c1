import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from parcela.llm import bpe

REFERENCE = Tokenizer.from_file(bpe.default_path())
REFERENCE.encode_special_tokens = True


def same(texts):
    want = [e.ids for e in REFERENCE.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in bpe.vocabulary(bpe.default_path()).encode(texts)] == want


def test_notations():
    rnd = random.Random(0)
    same(["", " ", "Hola mundo", "don't I'll", "<|endoftext|> x", "a" * 1000, "aaaa bbbb" * 300, "ñ" * 500 + "á", "́" * 300, "🏡" * 200, "  \n\n x ", "https://" + "ab1_" * 200, "the" * 150])
    same(["".join(rnd.choice("etaoinshr") for _ in range(3000)), "".join(chr(rnd.choice([97, 0x4E00 + rnd.randrange(500), 0x1F600 + rnd.randrange(50), 32])) for _ in range(2000))])


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_any_texts(texts):
    same([t.encode("utf-8", "replace").decode() for t in texts])


def test_a_round_is_the_leftmost_least_pair():
    v = bpe.Vocabulary(bpe.default_path())
    ids = v.byte_ids[np.frombuffer(b"thethe", dtype=np.uint8)][None, :].copy()
    first = v._merge_leftmost(ids)[0]
    assert (first >= 0).sum() == 5 and first[-1] == -1
    assert v._encode_wide(b"thethe" * 40).tolist() == REFERENCE.encode("thethe" * 40).ids


def test_full_cache_still_gives_all(monkeypatch):
    v = bpe.Vocabulary(bpe.default_path())
    v.cache = {f"w{k}": np.empty(0, np.int32) for k in range(1 << 18)}
    assert v.encode(["hola que tal", "hola"])[1].tolist() == REFERENCE.encode("hola").ids


def test_table(spark):
    rows = spark.createDataFrame([(1, "Hola", [1]), (2, None, [1]), (3, "", [1]), (4, "Hola", [1]), (5, "x" * 200_000, [1])], "doc_id long, text string, ids array<int>")
    got = {r.doc_id: r.ids for r in bpe.encoded(rows, "doc_id", F.col("text")).collect()}
    assert got[1] == got[4] == REFERENCE.encode("Hola").ids and got[2] == got[3] == [] and got[5] == REFERENCE.encode("x" * 200_000).ids
    assert bpe.encoded(rows.limit(0), "doc_id", F.col("text")).count() == 0


def test_vocabularies_of_another_kind_are_refused():
    import pytest

    assert bpe.word_pattern({"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}, None) == bpe.PATTERN
    for other in ((None, None), ({"type": "Whitespace"}, None), ({"type": "ByteLevel", "add_prefix_space": True}, None), ({"type": "ByteLevel", "add_prefix_space": False}, {"type": "NFC"})):
        with pytest.raises(ValueError):
            bpe.word_pattern(*other)
