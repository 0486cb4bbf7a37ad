import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from matricula.llm import ngram_lm as L


def brute(train, texts):
    """Interpolated modified Kneser-Ney by dictionaries."""
    def tokens(t):
        return [*(t or "").encode().lower().split(), None]

    pairs = Counter(p for t in train for p in zip(["start", *tokens(t)], tokens(t)))
    words = Counter(w for t in train for w in tokens(t))
    n, v = sum(words.values()), len(words)
    following = Counter(w for _, w in pairs)

    def discount(counts):
        k = Counter(counts.values())
        y = k[1] / (k[1] + 2 * k[2]) if k[1] + 2 * k[2] else 0.5
        d = [i - (i + 1) * y * k[i + 1] / k[i] if k[i] else i / 2 for i in (1, 2, 3)]
        return [0] + [min(max(x, 0.1), i - 0.1) for x, i in zip(d, (1, 2, 3))]

    d2, d1 = discount(pairs), discount(following)
    after = defaultdict(list)
    for (c, _), k in pairs.items():
        after[c].append(k)

    def p1(w):
        if not pairs:
            return 1 / (v + 1)
        spared = sum(d1[min(k, 3)] for k in following.values())
        return (following[w] - d1[min(following[w], 3)] + spared / (v + 1)) / sum(following.values())

    def p2(c, w):
        if not after[c]:
            return p1(w)
        k, own = pairs[c, w], after[c]
        return (k - d2[min(k, 3)] + sum(d2[min(x, 3)] for x in own) * p1(w)) / sum(own)

    rows = []
    for t in texts:
        ts = tokens(t)
        rows.append((len(ts), sum(words[w] > 0 for w in ts), n, sum(math.log10((words[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ts),
                     sum(math.log10(p2(c, w)) for c, w in zip(["start", *ts], ts))))
    total = sum(p2("start", w) for w in [*words, "unknown"]) if words else 1
    return rows, total


@pytest.mark.parametrize("flush,split", [(50, 5), (1 << 22, 1 << 17)])
def test_scores_match_brute_force(spark, monkeypatch, flush, split):
    monkeypatch.setattr(L, "SHARD_BYTES", 300)
    monkeypatch.setattr(L, "FLUSH_TOKENS", flush)
    monkeypatch.setattr(L, "SPLIT_CONTEXT", split)
    random.seed(flush)
    vocabulary = [f"w{i}" for i in range(40)] + ["Été", "x\x1cy"]
    texts = [None, "", " \t"] + [" ".join(random.choices(vocabulary, [1 / (i + 1) for i in range(42)], k=random.randrange(40))) for _ in range(80)]
    texts += [texts[9]] * 5 + ["never seen w1 never", "w0 " * 500]
    rows = [(i, t, i % 7 == 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, s string, held_out boolean").withColumn("text", F.col("s").cast("binary"))
    model = L.train(docs.filter("not held_out").select("text"))
    want, total = brute([t for _, t, h in rows if not h], texts)
    assert abs(total - 1) < 1e-9
    got = {r.doc_id: tuple(r)[2:] for r in L.score(docs, model, docs["text"]).collect()}
    for i, w in enumerate(want):
        assert got[i][:3] == w[:3] and np.allclose(got[i][3:], w[3:]), i
    assert L.score(docs.limit(0), model, docs["text"]).count() == 0


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, bytearray(b"a b"), True)], "doc_id long, text binary, held_out boolean")
    row = L.score(docs, L.train(docs.limit(0).select("text")), docs["text"]).first()
    assert (row.n_tokens, row.n_known, row.train_tokens) == (3, 0, 0) and row.score == 0.0
