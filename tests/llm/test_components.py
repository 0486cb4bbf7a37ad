import random

import pytest

from matricula.llm import components as C


@pytest.fixture
def written(monkeypatch):
    names = []

    def noted(df, name, put=C.through_table):
        names.append(name)
        return put(df, name)

    monkeypatch.setattr(C, "through_table", noted)
    return names


def test_stars_take_one_round(spark, written):
    edges = spark.createDataFrame([(0, n) for n in range(1, 40)] + [(50, 60), (60, 50), (70, 50)], "a long, b long")
    got = {r.node: r.root for r in C.components(edges).collect()}
    assert got == {n: 0 for n in range(40)} | {50: 50, 60: 50, 70: 50}
    assert written == ["stars"]


def test_rounds_end_in_stars(spark, written):
    draw = random.Random(3)
    pairs = {tuple(draw.sample(range(400), 2)) for _ in range(260)}
    root = list(range(400))
    for _ in range(400):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in C.components(spark.createDataFrame(sorted(pairs), "a long, b long")).collect()}
    assert got == {n: root[n] for pair in pairs for n in pair}
    assert len(written) > 1
