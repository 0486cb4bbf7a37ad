import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from matricula.llm import mixing as M


def rows_of(n, hot=0.4):
    random.seed(n)
    sources = ["a", "é", "Z", None, "b"]
    rows = []
    for i in range(n):
        source = "hot" if random.random() < hot else random.choice(sources)
        rows.append((i, " ".join(["w"] * random.choice([0, 1, 7, 40])), source))
    return [*rows, rows[3], (None, "x y z", "a"), (None, None, None), (n, "word \t word\n", "single")]


def brute_targets(sizes, weights):
    total, capped = 1.5 * sum(sizes), set()
    while True:
        rest = total - sum(2 * sizes[i] for i in capped)
        weight = sum(w for i, w in enumerate(weights) if i not in capped)
        now = {i for i in range(len(sizes)) if i not in capped and 2 * sizes[i] < rest * weights[i] / weight}
        if not now:
            return [2.0 * s if i in capped else rest * weights[i] / weight for i, s in enumerate(sizes)]
        capped |= now


@pytest.mark.parametrize("broadcast,shard_words", [(0, 300), (10_000, 10 ** 9)])
def test_taken_words_meet_the_targets(spark, monkeypatch, broadcast, shard_words):
    monkeypatch.setattr(M, "BROADCAST_SOURCES", broadcast)
    monkeypatch.setattr(M, "DOCS_PER_BLOCK", 8)
    rows = rows_of(300)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"size": F.lit("x"), "shard": F.lit(9)})
    got = M.mix(docs, words_per_shard=shard_words).collect()
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += len(re.findall(M.WORD, t or ""))
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    want = dict(zip(order, brute_targets([size[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))])))
    taken, per_row, places = defaultdict(int), defaultdict(list), set()
    for r in got:
        taken[r.doc.source] += r.words
        per_row[r.row].append(r)
        assert abs(r.target - want[r.doc.source]) < 1e-9 and r.source_size == size[r.doc.source]
        if r.shard is not None:
            assert (r.shard, r.position) not in places
            places.add((r.shard, r.position))
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in order)
    assert len(per_row) == len(rows) and all(sum(r.words for r in own) <= 2 * own[0]["size"] for own in per_row.values())
    shards = {s for s, _ in places}
    assert (len(shards) > 4) == (shard_words == 300)
    again = M.mix(docs.repartition(7), words_per_shard=shard_words).collect()
    key = lambda r: (str(r.doc), str(r.row), r["pass"], r.words, str(r.shard))
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_tree_splits_exact_quotas(spark):
    quotas = spark.createDataFrame([(0, 100), (1, 3), (2, 41)], "sid long, blocks long")
    leaves = M.splitting_tree(quotas, 3, per_step=2).collect()
    by_source, by_shard = defaultdict(int), defaultdict(int)
    for r in leaves:
        by_source[r.sid] += r.blocks
        by_shard[r.shard] += r.blocks
    assert by_source == {0: 100, 1: 3, 2: 41} and set(by_shard) == set(range(8)) and max(by_shard.values()) - min(by_shard.values()) <= 1


def test_cut_to_words(spark):
    df = spark.createDataFrame([("  one\t two \n three ", n) for n in range(4)], "t string, n long")
    got = [r[0] for r in df.select(M.cut_to_words(F.col("t"), F.col("n"), F.lit(3))).collect()]
    assert got == ["", "  one", "  one\t two", "  one\t two \n three "]


def test_empty_and_wordless(spark):
    docs = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert M.mix(docs.limit(0)).count() == 0
    assert [(r.words, r.target, r.shard) for r in M.mix(docs).collect()] == [(0, 0.0, None)] * 2


def test_permutation_is_by_keyed_hash(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "a") for i in range(4)] + [(9, "w " * 1000, "b")], "doc_id long, text string, source string")
    got = {r.doc.doc_id: r.words for r in M.mix(docs, weights=(1, 1000), share=0.15).collect() if r.doc.source == "a"}
    order = sorted(range(4), key=lambda i: hashlib.md5(f"7:{i}".encode()).hexdigest())
    left = round(0.15 * 1040 / 1001)
    assert [got[i] for i in order] == [left, 0, 0, 0]
