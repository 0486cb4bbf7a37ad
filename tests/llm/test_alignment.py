"""Alignment against a plain walk over token occurrences."""

import hashlib
from collections import Counter

import pytest
from public_tokenizers import path
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

import __spark_entry__ as entry
from matricula.llm import alignment

A, B = path("byte_bpe_50k.json"), path("piece_bpe_32k.model")
SF_DIR = "/root/testdata/sf0.001"


def spans(raw):
    at = 0
    for i, x in raw:
        yield i, at, at + len(x)
        at += len(x)


def plain(docs):
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups of each (doc_id, text)."""
    a_model, b_model = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a_model.encode_special_tokens = True
    byte = alignment.byte_alphabet()
    out, counts = [], Counter()
    for doc_id, text in docs:
        row = {"id": doc_id, "a": [], "b": [], "links": [], "groups": []}
        out.append(row)
        if not text:
            continue
        a_ids = a_model.encode(" " + text, add_special_tokens=False).ids
        raw_a = [(i, bytes(byte[c] for c in a_model.id_to_token(i))) for i in a_ids]
        raw_b = [(i, bytes([int(b_model.id_to_piece(i)[3:5], 16)]) if b_model.is_byte(i) else b_model.id_to_piece(i).replace("▁", " ").encode())
                 for i in b_model.encode(text)]
        whole = (" " + text).encode()
        if b"".join(x for _, x in raw_a) != whole or b"".join(x for _, x in raw_b) != whole:
            continue
        row["a"], row["b"] = list(spans(raw_a)), list(spans(raw_b))
        cuts = sorted({e for *_, e in row["a"]} & {e for *_, e in row["b"]})
        first = 0
        for cut in cuts:
            left, right = ([i for i, s, e in row[x] if first <= s and e <= cut] for x in "ab")
            row["groups"].append(",".join(map(str, left)) + "|" + ",".join(map(str, right)))
            first = cut
        j = 0
        for x, s, e in row["a"]:
            while row["b"][j][2] <= s:
                j += 1
            k = j
            while k < len(row["b"]) and row["b"][k][1] < e:
                row["links"].append((x, row["b"][k][0]))
                k += 1
        counts.update(row["links"])
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return [(r["id"], len(r["a"]), len(r["b"]), len(r["groups"]), len(r["links"]), sum(counts[p] == most[p[1]] for p in r["links"]),
             sum(counts[p] for p in r["links"]), ";".join(r["groups"])) for r in out]


TEXTS = [
    (1, "The first words, and the second words."), (2, None), (3, ""), (4, " "), (5, "a▁b"), (6, "a▁"), (7, "  two  spaces \n\n and\tlines\n"),
    (8, "Über naïve café — 漢字かな交じり文 \U0001F600\U0001F600"), (9, "<|endoftext|> and <s> </s> <0x0A>"), (None, "The first words, and the second words."),
    (1, "The first words, and the second words."), (11, "x" * 5000), (12, "\x00\x01 　 x  y"), (13, "they're he'll it's 12345 $$$ === ==="),
    (14, "ﬁ ﷺ İstanbul"), (17, "a,b c., d.e... f;;g h!? é, ÿ. 1,2 x,\ny .z it's, don't. A.B.C."), (15, "a\n b\n\nc \n d"), (16, "==" * 40 + " " + "aa" * 33),
]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("stretches", [alignment.STRETCHES, 1])
def test_equals_a_plain_walk(spark, monkeypatch, stretches):
    monkeypatch.setattr(alignment, "STRETCHES", stretches)  # with 1 every batch is a block
    docs = spark.createDataFrame([(*d, "x", 7) for d in TEXTS], "doc_id long, text string, groups string, kind int").repartition(3)
    got = rows(alignment.align(docs, A, B))
    assert got == sorted(plain(TEXTS), key=str)


def test_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0


def test_no_text_has_tokens(spark):
    docs = spark.createDataFrame([(1, None), (2, "▁")], "doc_id long, text string")
    assert rows(alignment.align(docs, A, B)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_invalid_utf8_has_no_tokens(spark):
    docs = spark.createDataFrame([(1, bytearray(b"ab \xff cd"))], "doc_id long, text binary")
    assert rows(alignment.align(docs, A, B)) == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_query_on_whole_documents(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    expected = [(*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else "") for r in plain(docs)]
    assert rows(entry.queries()["op13_alignment"](spark, SF_DIR)) == sorted(expected, key=str)


def test_words_in_batches_have_the_ids_of_single_words(monkeypatch):
    """New words of letters go to the library together; what is not of letters, or already kept, does not."""
    monkeypatch.setattr(alignment, "ENCODED", 3)
    t = alignment.Tokenizers(A, B)
    stretches = [" the", " Straße", " 漢字かな", " x1", ",", "word", " ", "\n", " ﬁ", " zzzzqqqq" * 2, " İstanbul", " " + "ab" * 300, " ÿ", "  a"]
    for _ in range(2):
        assert t.all_b_ids(stretches) == [t.b_ids(s) for s in stretches]
