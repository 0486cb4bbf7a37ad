import numpy as np

from matricula.llm import topk


def brute(rows, k):
    seen, out = {(i, tuple(v)) for i, v in rows}, []
    for q, qv in sorted(seen):
        if q % 50 == 0:
            scored = sorted((-int(np.dot(qv, v)), i) for i, v in seen if i != q and len(v) == len(qv))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 60)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 3)
    rng = np.random.default_rng(5)
    rows = [(i, rng.integers(-300, 300, 6).astype(float).tolist()) for i in range(0, 700, 2)]
    rows += [(i, rows[3][1]) for i in range(1001, 1100, 2)]  # ties
    rows += [(50, rows[25][1]), (8000, [0.0] * 6), (8001, [1.0, 2.0]), (8050, [3.0, 1.0]), (8100, []), (8101, [])]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>").distinct()
    for k in (1, 5):
        got = topk.top_k(df, df.filter("vec_id % 50 = 0"), k).collect()
        assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute(rows, k)
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_reading_stops_early_on_skewed_lists():
    rng = np.random.default_rng(1)
    rows = np.round(rng.exponential(1, (4096, 4)) ** 4 * 100)
    lists = topk.SortedLists(np.arange(4096), rows)
    query = np.array([3.0, 1.0, 0.0, 2.0])
    ids, scores, depth = lists.top(query, -1, 5)
    assert depth < 4096
    want = rows @ query
    assert scores.tolist() == sorted(want, reverse=True)[:5] and want[ids].tolist() == scores.tolist()


def test_left_out_vectors(spark):
    rows = [(1, [1.0, None]), (2, None), (None, [1.0]), (3, [float("nan")]), (4, [float("inf")]), (5, [0.999, -0.001]), (5, [0.999, -0.001]), (6, [])]
    got = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted((r.vec_id, r.v) for r in got) == [(5, [255.0, -1.0]), (6, [])]
