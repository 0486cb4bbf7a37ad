"""The pipeline on a fixture: every stage against a plain version of its decision."""

import random
from collections import Counter, defaultdict

import pytest

import corpus_pipeline as P
from matricula.llm import mixing
from matricula.llm.tokens import WordIds
from matricula.llm.packing import tokenizer_path


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    random.seed(4)
    plain = [f"word{i}" for i in range(200)]
    docs, labels = [], []
    for i in range(400):
        words = random.choices(plain, k=random.choice([12, 60, 250]))
        bad, toxic = i % 5 == 0, i % 5 == 1
        if bad:
            words = [w.upper() + "!!" for w in words]
        if toxic:
            for _ in range(1 + len(words) // 20):
                words[random.randrange(len(words))] = random.choice(["vilething", "rotten", "nastyword"])
        text = " ".join(words)
        docs.append((i, text, "en", f"s{i % 3}" if i % 7 else None, len(text)))
        labels.append((i, int(not bad), int(toxic)))
    clean = next(d for d in docs if d[0] % 5 == 2)
    docs += [(1000 + i, clean[1], "en", "s1", len(clean[1])) for i in range(5)] + [docs[2], (2000, None, None, None, None)]
    for n, d in enumerate([d for d in docs[:400] if d[0] % 5 > 1 and d[4] > 1500][:12]):  # edited copies
        words = d[1].split()
        words[7] = f"word{n}"
        docs.append((3000 + n, " ".join(words), *d[2:4], len(" ".join(words))))
    folder = tmp_path_factory.mktemp("sf")
    clashing = "score string, toxicity int, fingerprint int, row int, shard int, words int, size int, doc string"
    docs = [(*d, "x", *range(6), "y") for d in docs]
    spark.createDataFrame(docs, f"doc_id long, text string, lang string, source string, n_chars long, {clashing}").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), docs, {i: (q, t) for i, q, t in labels}


def test_stages(spark, sf_dir):
    folder, rows, labels = sf_dir
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, found = docs.columns, []
    for name, stage in P.STAGES:
        docs = P.through_table(stage(spark, docs, folder), f"test-{name}")
        found.append([tuple(r) for r in docs.collect()])
        assert name == "packing" or docs.columns == columns
    good, clean, single, mixed, packed = found
    known = [r for r in rows if r[0] in labels]
    kept = {r[0] for r in good}
    assert Counter(good) <= Counter(rows)
    assert sum((r[0] in kept) == (labels[r[0]][0] == 1) for r in known) > 0.97 * len(known)
    kept = {r[0] for r in clean}
    assert Counter(clean) <= Counter(good)
    judged = [r for r in good if r[0] in labels]
    assert sum((r[0] in kept) == (labels[r[0]][1] == 0) for r in judged) > 0.95 * len(judged)

    def shingles(text):
        w = (text or "").lower().split()
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(r[1]) for r in clean]
    near = [[j for j, b in enumerate(sets) if 5 * len(a & b) >= 4 * len(a | b)] for a in sets]
    group = list(range(len(clean)))  # least index of each component, by plain spreading
    changed = True
    while changed:
        changed = False
        for i, others in enumerate(near):
            least = min(group[j] for j in others)
            if least < group[i]:
                group[i], changed = least, True
    assert len(set(group)) < len(clean) - 12
    least = {g: min((clean[i][0] for i in range(len(clean)) if group[i] == g), key=lambda d: (d is None, d)) for g in set(group)}
    assert sorted(map(str, (r[0] for r in single))) == sorted(map(str, least.values()))

    words = lambda t: len((t or "").encode().split())
    size, taken = defaultdict(int), defaultdict(int)
    for r in single:
        size[r[3]] += words(r[1])
    for r in mixed:
        taken[r[3]] += words(r[1])
        assert r[4] == (None if r[1] is None else len(r[1]))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    targets = mixing.water_fill([size[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))], 1.5, 2)
    assert all(abs(taken[s] - t) <= 0.5 for s, t in zip(order, targets))
    originals = {r[0]: r[1] for r in single}
    assert all((originals[r[0]] or "").startswith(r[1] or "") for r in mixed)

    ids = WordIds(tokenizer_path())
    tokens = Counter()
    for r in mixed:
        tokens[r[0]] += len(ids((r[1] or "").encode())) // 4 + 1
    lengths = Counter()
    for p in packed:
        lengths[p[0]] += p[2]
    assert lengths == tokens


def test_run_and_empty_tables(spark, sf_dir, tmp_path):
    folder, _, _ = sf_dir
    assert P.run(spark, folder).count() > 0
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
