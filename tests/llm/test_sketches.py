import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from matricula.llm import sketches as S


def paragraphs(text):
    return set(re.findall(S.PARAGRAPH, text))


def near(a, b):
    a, b = paragraphs(a), paragraphs(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(rows):
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    out = []
    for n, (i, text) in enumerate(order):
        following = order[(n + 1) % len(order)][1]
        k = len(text) // 3
        edited = text[:len(text) - k] + following[:k]
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), near(text, edited), near(text, following)))
    return out


@pytest.mark.parametrize("block,group,load", [(3, 2, 30), (500, 4096, 30), (7, 2, 400)])
def test_matches_brute_force(spark, monkeypatch, block, group, load):
    monkeypatch.setattr(S, "BLOCK_DOCS", block)
    monkeypatch.setattr(S, "SUPER", group)
    monkeypatch.setattr(S, "LOAD", load)  # too many digests for a bucket: retries
    random.seed(block)
    words = "alpha béta gamma. delta! epsilon\n zeta? 😀".split(" ")
    rows = [(random.randrange(-500, 5000), " ".join(random.choices(words, k=random.choice([0, 1, 5, 50, 700])))) for _ in range(40)]
    rows += [(7000, rows[0][1]), (7001, rows[0][1]), (10 ** 9, None), (None, None), (None, "x. y"), (5, "same. id"), (5, "other id"), (6, "z" * 5000)]
    rows = [*rows, rows[0], (6000, " ".join(f"{i}." for i in range(3000)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("block", F.lit(1))
    got = S.fingerprints(docs).collect()
    assert len(got) == len(rows)
    plain = sorted(((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got), key=repr)
    assert plain == sorted(((*w[:3], round(w[3], 9), round(w[4], 9)) for w in brute(rows)), key=repr)
    of = {r.doc_id: r.fingerprint for r in got}
    assert of[7000] == of[7001] and len({r.fingerprint for r in got}) > 20


@pytest.mark.parametrize("ids", [(1, 5, 2 ** 62), (-2 ** 63, 5, 2 ** 63 - 1), (-2 ** 63, -2 ** 63 + 1, None), (2 ** 63 - 1, 2 ** 63 - 1, 0)])
def test_ids_far_apart(spark, ids):
    rows = [(i, f"one. two {n}. three.") for n, i in enumerate(ids)]
    got = S.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    key = lambda r: (repr(r[0]), r[2])
    plain = sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got), key=key)
    for a, b in zip(plain, sorted(brute(rows), key=key), strict=True):
        assert a[:3] == b[:3] and a[3:] == pytest.approx(b[3:])


def test_one_document_and_none(spark):
    docs = spark.createDataFrame([(4, "one. two.")], "doc_id long, text string")
    row = S.fingerprints(docs).first()  # its own head replaces its tail
    assert (row.near_next, row.edited_sha256) == (1.0, hashlib.sha256(b"one. tone").hexdigest())
    assert S.fingerprints(docs.limit(0)).count() == 0
