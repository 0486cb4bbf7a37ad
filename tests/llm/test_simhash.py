import random

import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from matricula.llm import simhash
from matricula.llm.components import components


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(prints):
        for j in range(i):
            if bin(a ^ prints[j]).count("1") <= radius:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def test_fingerprints_match_the_definition(spark):
    random.seed(3)
    texts = ["", None, " \t\n", "One", "one two", "É  É\x0bÉ ß", "a b c", "A B\tC\n"]
    texts += [" ".join(random.choices("ab cd ef gh Ij Kl é".split(), k=random.randrange(1, 60))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.fingerprint % (1 << 64) for r in simhash.with_fingerprints(docs).collect()}
    assert got == {i: brute_fingerprint(t) for i, t in enumerate(texts)}
    assert simhash.simhash(("x y z " * 40000).encode()) == brute_fingerprint("x y z " * 40000)  # several chunks


@pytest.mark.parametrize("radius", [2, 4])
def test_components_match_brute_force(spark, radius):
    random.seed(radius)
    base = [random.getrandbits(64) for _ in range(12)] + [0, (1 << 64) - 1]
    prints = [p ^ sum(1 << b for b in random.sample(range(64), random.randrange(4))) for p in base for _ in range(6)]
    prints += prints[:20]
    rows = [(i if i % 7 else None, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)]
    df = spark.createDataFrame(rows, "doc_id long, fingerprint long")
    parts = brute_components(prints, radius)
    want = sorted((r[0] is None, r[0] or 0, r[1], min((rows[j][0] for j, q in enumerate(parts) if q == p and rows[j][0] is not None), default=None))
                  for r, p in zip(rows, parts))
    got = sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df, radius).collect())
    assert got == want


def test_long_chain_is_one_component(spark):
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.root for r in components(edges).collect()} == {0}
    assert components(edges.limit(0)).count() == 0


def test_keep_one_of_each_group(spark):
    docs = spark.createDataFrame(
        [(5, "a b c d e f", "x"), (3, "A b c d e f", "y"), (9, "q r s t", None), (3, "a b c d e f", "z"), (None, None, None), (None, "", "w")],
        "doc_id long, text string, row string")
    kept = simhash.keep_one(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == [(False, 3), (False, 9), (True, 0)]
    assert kept[0].asDict().keys() == {"doc_id", "text", "row"}
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_odd_radius_is_refused(spark):
    with pytest.raises(ValueError):
        simhash.links(spark.range(1).select(F.col("id").alias("fingerprint")), 3)
