"""Periodic runs against a search of every period."""

import hashlib
import random
import zlib

import __spark_entry__ as entry
from matricula.llm import runs
from matricula.llm.runs import runs_of, with_runs

SF_DIR = "/root/testdata/sf0.001"
SPACE = b" \t\n\x0b\x0c\r"


def plain_runs(w):
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - start >= max(6, 4 * q):
                found.setdefault((start, i + q), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def plain_collapsed(w, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return [x for i, x in enumerate(w) if i not in gone]


def words_of(text):
    return text.encode().split() if text else []


def test_every_period_of_small_alphabets():
    draw = random.Random(5)
    for _ in range(1500):
        texts = []
        for _ in range(draw.randint(1, 5)):
            w = []
            while draw.random() < 0.85:
                if draw.random() < 0.5 or not w:
                    w += [draw.choice("abcde"[:draw.choice((2, 5))]) for _ in range(draw.randint(1, 12))]
                else:
                    p = draw.randint(1, min(len(w), draw.choice((3, 9, 40))))
                    for _ in range(draw.randint(1, 6 * p)):
                        w.append(w[-p])
            texts.append(" ".join(w).encode())
        words, first, found, dropped = runs_of(texts)
        expected = [(s + int(f), n, q) for w, f in zip(words, first) for s, n, q in plain_runs(w)]
        assert list(map(tuple, found.tolist())) == sorted(expected, key=lambda r: (r[0], r[2]))
        for w, f in zip(words, first):
            kept = [x for i, x in enumerate(w) if not dropped[f + i]]
            assert kept == plain_collapsed(w, plain_runs(w))


def test_long_periods_and_inner_runs():
    base = [f"w{i}".encode() for i in range(700)]
    inner = [b"a"] * 400 + [b"b"]  # a period that is itself nearly one run
    for w in (base * 4, base * 3, base * 5 + base[:11], inner * 4, [b"x"] + inner * 6, [b"a", b"b"] * 300 + [b"c"] + base * 4):
        assert list(map(tuple, runs_of([b" ".join(w)])[2].tolist())) == plain_runs(w)


def test_selected_positions_are_few_and_consistent():
    draw = random.Random(3)
    numbers = [draw.randrange(50) for _ in range(3000)]
    numbers[1000:1400] = numbers[200:600]
    x = runs.np.array(numbers)
    ids = runs._mixed(x.astype(runs.np.uint64))
    size = 1
    while size < 32:
        ids = runs._doubled(ids, size)
        size *= 2
    chosen = runs.selected(ids, runs.np.zeros(len(x), bool), 32)
    assert len(chosen) < 4 * len(x) / 32
    inside = {i for i in chosen.tolist() if 200 <= i < 600 - 64}
    assert {i + 800 for i in inside} == {i for i in chosen.tolist() if 1000 <= i < 1400 - 64}


def test_cases(spark):
    texts = [None, "", " \n\t", "a", "a a a a a", "a a a a a a", "x " + "a b\t" * 3 + "c", "x " + "a b\n" * 4 + "c", "É É É É É É é", "p q r " * 4 + "p s"]
    docs = spark.createDataFrame([(i, t, "kept", 1) for i, t in enumerate(texts)] + [(None, "a " * 9, "kept", 1)] * 2, "doc_id long, text string, other string, runs int")
    got = with_runs(docs)
    assert got.columns == ["doc_id", "text", "other", "n_words", "runs", "collapsed"]
    for r in got.collect():
        w = words_of(r.text)
        assert r.other == "kept" and r.n_words == len(w)
        assert [tuple(x) for x in r.runs] == plain_runs(w)
        assert r.collapsed.encode() == b" ".join(plain_collapsed(w, plain_runs(w)))
    assert with_runs(docs.limit(0)).count() == 0


def test_query_on_whole_documents(spark):
    expected = {}
    for doc_id, text in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect():
        w = words_of(text)
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and w:
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, len(w))]
        found = plain_runs(w)
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        expected[doc_id] = (len(found), *best, 1000 * best[1] // best[2] if found else None, hashlib.sha256(lines.encode()).hexdigest(),
                            hashlib.sha256(b" ".join(plain_collapsed(w, found))).hexdigest())
    got = entry.queries()["op11_runs"](spark, SF_DIR).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == expected and len(got) == len(expected)
    assert sum(r.n_runs > 0 for r in got) > 5


def test_planted_keeps_empty_and_null(spark):
    docs = spark.createDataFrame([(i, t) for i in range(300) for t in (None, "", "one")] + [(None, "x y")], "doc_id long, text string")
    got = {(r.doc_id, r.text) for r in runs.planted(docs).collect()}
    assert got == {(r.doc_id, r.text) for r in docs.collect()}
