import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from matricula.llm import quality as Q


def corpus(n=400):
    random.seed(2)
    rows = []
    for i in range(n):
        words = random.choices("alpha beta gamma delta epsilon zeta eta theta".split(), k=random.choice([8, 60, 300]))
        bad = i % 4 == 0
        text = " ".join(w.upper() + "!!" for w in words) if bad else " ".join(words) + "."
        rows.append((i, text, f"s{i % 3}", ["en", None][i % 2], int(not bad)))
    return rows


def test_held_out_documents(spark):
    rows = corpus()
    docs = spark.createDataFrame([r[:4] for r in rows] + [(None, None, None, None), (900, "", "s0", "en")],
                                 "doc_id long, text string, source string, lang string").withColumn("score", F.lit("x"))
    labels = spark.createDataFrame([(r[0], r[4]) for r in rows] + [(None, 1), (5, None)], "doc_id long, quality int")
    kept = Q.keep_good(docs, labels)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    folds = {r.doc_id for r in docs.filter(Q.crc_fold(docs.doc_id, Q.FOLDS) == 0).collect()}
    assert np.mean([(r[0] in ids) == bool(r[4]) for r in rows if r[0] in folds]) > 0.97
    assert Q.keep_good(docs.limit(0), labels).count() == 0
    assert Q.keep_good(docs, labels.limit(0)).count() == docs.count()  # no labels: nothing tells them apart


@pytest.mark.parametrize("limit", [0, 1000])
def test_site_rates_match_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(Q, "BROADCAST_SITES", limit)  # both ways of joining
    random.seed(1)
    rows = [(i, random.choice(["a", "b", "c", None]), random.choice(["x", None]), random.gauss(1, 2)) for i in range(300)] + [(300, "rare", "y", -9.0)]
    df = spark.createDataFrame(rows, "id long, host string, path string, evidence double")
    sites, f = Q.site_rates(df)
    got = {r.id: (r.site, r.score) for r in Q.scored(df, sites, f).collect()}
    p = {r[0]: 1 / (1 + np.exp(-r[3])) for r in rows}
    rate = np.mean(list(p.values()))
    assert abs(f["rate"] - rate) < 1e-9
    for i, host, path, e in rows:
        of_host = [p[r[0]] for r in rows if r[1] == host and r[0] != i]
        of_path = [p[r[0]] for r in rows if r[1:3] == (host, path) and r[0] != i]
        h = (sum(of_host) + f["host_strength"] * rate) / (len(of_host) + f["host_strength"])
        site = (sum(of_path) + f["path_strength"] * h) / (len(of_path) + f["path_strength"])
        logit = e + np.log(site / (1 - site)) - np.log(rate / (1 - rate))
        assert np.allclose(got[i], (site, 1 / (1 + np.exp(-logit))), atol=1e-9)


def test_features_cover_the_whole_text():
    clean = b"plain words here " * 2000
    assert len(Q.features(None)) == len(Q.features(clean)) == len(Q.features(b"x"))
    assert not np.allclose(Q.features(clean), Q.features(clean + b"LOUD!! " * 64))
