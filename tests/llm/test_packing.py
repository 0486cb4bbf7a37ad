import random
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from matricula.llm import packing, tokens
from matricula.llm.tokens import WordIds


def check(pieces, lengths, tokens, segments, loss):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
    assert set(by_doc) == set(lengths)
    for doc_id, own in by_doc.items():
        at = 0
        for p in sorted(own, key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == lengths[doc_id]
            at += p.length
        assert at == lengths[doc_id]
    for own in by_seq.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == tokens or at & (at - 1) == 0
        assert at <= tokens and len(own) <= segments and sum(p.loss_tokens for p in own) <= loss


@pytest.mark.parametrize("tokens,segments,loss", [(64, 4, 64), (64, 3, 10), (100, 50, 100), (8, 1, 8)])
def test_every_id_lies_in_one_piece_within_all_limits(spark, tokens, segments, loss):
    random.seed(tokens)
    texts = [" ".join(random.choices("the of loser, ßu éà don't 1234 ...".split(), k=random.choice([0, 1, 3, 30, 400]))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, i % 5 * 7) for i, t in enumerate([None, *texts])], "doc_id long, text string, offset long").coalesce(2)
    path = packing.tokenizer_path()
    plain = WordIds(path).tokenizer
    ids = {r.doc_id: [*plain.encode(r.text or "", add_special_tokens=False).ids, 1] for r in docs.collect()}
    got = packing.pack(docs, path, tokens, segments, loss, loss_from=docs["offset"]).collect()
    check(got, {k: len(v) for k, v in ids.items()}, tokens, segments, loss)
    for p in got:
        assert p.ids_crc32 == zlib.crc32(np.array(ids[p.doc_id][p.start:p.start + p.length], "<u4").tobytes())
    assert packing.pack(docs.limit(0), path).count() == 0


def test_words_give_the_tokenizers_ids():
    ids = WordIds(packing.tokenizer_path())
    texts = ["It's  the END. of, <|endoftext|> x<|endoftext|>y", "<|ENDOFTEXT|>", "É́ été ǅ ﬁ 漢字 ß. a., ... a.. é. İI 12.5,",
             "naïve\x1cword x", "😀 :) they'll 'tis o'clock's", "ẞß straße, Σίσυφος."]
    for text in texts:
        want = ids.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids(text.encode()), "<u4").tolist() == want, text


IDS = WordIds(packing.tokenizer_path())


@settings(max_examples=2000, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="aAzZéÉßÿŸİªµ.,'s1 \n\x1c\x85\u0301\u3000|<>", max_size=60)))
def test_any_text_gives_the_tokenizers_ids(text):
    assert np.frombuffer(IDS(text.encode()), "<u4").tolist() == IDS.tokenizer.encode(text, add_special_tokens=False).ids


def test_a_full_cache_changes_nothing():
    ids = WordIds(packing.tokenizer_path())
    ids.words.limit = 3
    text = "one two, three. four five six, one two, seven " * 3
    assert np.frombuffer(ids(text.encode()), "<u4").tolist() == ids.tokenizer.encode(text, add_special_tokens=False).ids


def test_waiting_pieces_keep_their_own_ids_only():
    def pieces():
        tracemalloc.start()
        for n in range(packing.POOL // 4):
            ids = bytes(4 * (2048 * 50 + 7))  # 400 KB, of which seven ids wait
            yield packing.Piece(n, ids, 0, 0, len(ids) // 4)
        kept.append(tracemalloc.get_traced_memory()[0])
        tracemalloc.stop()

    kept = []
    placed = sum(p.length for s in packing.packed(pieces(), (2048, 256, 2048)) for p in s)
    assert placed == packing.POOL // 4 * (2048 * 50 + 7)
    assert kept[0] < 8 << 20


def test_marks_after_letters_are_one_word_of_the_tokenizer():
    ids, whole = WordIds(packing.tokenizer_path()), []
    ids._ids = lambda word, made=ids._ids: whole.append(word) or made(word)
    for text in ["été.", "loser$$$", "straße,###", "a''", "été.%%%", "x.<|", "É!!"]:
        want = ids.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids(text.encode()), "<u4").tolist() == want, text
    assert not any(w.rstrip(tokens.MARKS) not in (w, b"") for w in whole)


def test_limits_must_be_positive(spark):
    with pytest.raises(ValueError):
        packing.pack(spark.range(1), "", tokens=0)
