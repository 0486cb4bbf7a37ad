"""Piece encoding against the library."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor

import __spark_entry__ as entry
from matricula.llm.pieces import PieceModel, TwoGenerations, model_path, with_decoded, with_ids

SF_DIR = "/root/testdata/sf0.001"
MODEL, LIBRARY = PieceModel(model_path()), SentencePieceProcessor(model_file=model_path())


def check(text):
    ids = np.frombuffer(MODEL.encode(text), np.int32).tolist()
    assert ids == LIBRARY.encode(text)
    assert MODEL.decode(ids) == LIBRARY.decode(ids)


@settings(max_examples=1500, deadline=None)
@given(st.text())
def test_any_text(text):
    check(text)


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet=" ▁\nabtheinr=-./é漢\U0001F600", max_size=80))
def test_texts_that_merge(text):
    check(text)


def test_joined_pieces_and_runs():
    draw, pieces = random.Random(7), list(MODEL.id_of)
    for _ in range(4000):
        check("".join(draw.choice(pieces) for _ in range(draw.randint(1, 10))).replace("▁", draw.choice(" ▁")))
        check(" ".join(draw.choice(("==", "--", "..", "\\\\", "))", "##", "  ")) * draw.randint(1, 30) for _ in range(4)))


def test_backtracking_equals_merging():
    draw = random.Random(8)
    for _ in range(3000):
        text = "".join(draw.choice("theainoersdl▁") for _ in range(draw.randint(1, 40)))
        assert MODEL.backtracked(text) == MODEL.merged(text)


@pytest.mark.parametrize("text", ["", " ", "▁", "<s></s><unk><0x0A>", "\x00", "a\x00b", " " * 99 + "the" + " " * 33, "vocabulary " * 5000, "x" * 3000, "⁇ �"])
def test_cases(text):
    check(text)


def test_cache_is_bounded():
    made = []
    cache = TwoGenerations(lambda k: made.append(k) or k * 2, 4)
    for k in [0, 1, 2, 3, 0, 4, 0, 5, 6, 7, 8, 0]:
        assert cache[k] == 2 * k
        assert len(cache) <= 4 and len(cache.old) <= 4
    assert made.count(0) == 1  # in use, so it moved to the new generation


def test_frames(spark):
    texts = [None, "", "one two", "one two", "Ünï ▁ x", "\n"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "x", 1)], "doc_id long, text string, ids int")
    got = with_decoded(with_ids(docs, model_path()), model_path())
    assert sorted(got.columns) == ["decoded", "doc_id", "ids", "text"]
    for r in got.collect():
        ids = LIBRARY.encode(r.text or "")
        assert list(r.ids) == ids and r.decoded == LIBRARY.decode(ids)
    assert with_decoded(with_ids(docs.limit(0), model_path()), model_path()).count() == 0
    lists = spark.createDataFrame([(LIBRARY.encode("a b"),), (None,), ([],), (LIBRARY.encode("c"),)], "ids array<int>")
    assert [r.decoded for r in with_decoded(lists, model_path()).collect()] == ["a b", "", "", "c"]
    bad = spark.createDataFrame([(bytearray(b"a\xffb"),)], "text binary")
    assert with_ids(bad, model_path()).first().ids == LIBRARY.encode("a�b")


def test_query_on_whole_documents(spark):
    expected = {}
    for doc_id, text in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect():
        ids = LIBRARY.encode(text or "")
        expected[doc_id] = (len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), LIBRARY.decode(ids))))
    got = entry.queries()["op12_pieces"](spark, SF_DIR).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == expected and len(got) == len(expected)
