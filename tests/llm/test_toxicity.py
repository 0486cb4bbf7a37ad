import random

import numpy as np
import pytest

from matricula.llm import toxicity as T


def small_net():
    words = [b"ab", b"cd", b"efgh", b"x"]
    net = T.Network({w: i + 1 for i, w in enumerate(words)}, np.random.default_rng(0), 0.1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    return net


def test_gradients_match_differences():
    net = small_net()
    windows = [[b"ab", b"cd", b"zz"], [b"x"], [], [b"efgh"] * T.WINDOW]
    words, index, mask = T._indexed(windows)
    given = net.inputs(words)
    y = np.array([1.0, 0.0, 1.0, 0.0])

    def loss():
        z = net.logits(net.embed(*given), index, mask).astype(float)
        return np.mean(np.log1p(np.exp(z)) - y * z)

    g = net.gradients(*given, index, mask, y)
    rng = np.random.default_rng(1)
    for name, grad in g.items():
        if isinstance(grad, tuple):
            full = np.zeros_like(net.p[name])
            np.add.at(full, grad[0], grad[1])
            cells = [(int(r), int(rng.integers(full.shape[1]))) for r in np.unique(grad[0]) if r][:6]
        else:
            full, cells = grad, [tuple(int(rng.integers(n)) for n in grad.shape) for _ in range(6)]
        for cell in cells:
            kept, eps = net.p[name][cell], 1e-3
            net.p[name][cell] = kept + eps
            up = loss()
            net.p[name][cell] = kept - eps
            down = loss()
            net.p[name][cell] = kept
            assert abs((up - down) / (2 * eps) - full[cell]) < 2e-4, name


@pytest.mark.parametrize("n", [0, 1, 31, 32, 33, 56, 57, 100, 1000])
def test_windows_reach_every_word(n):
    starts = list(T.window_starts(n))
    assert {w for s in starts for w in range(s, min(n, s + T.WINDOW))} == set(range(n))
    assert all(s < max(1, n) for s in starts) and all(b - a < T.WINDOW for a, b in zip(starts, starts[1:]))


def corpus(n):
    random.seed(n)
    plain = ["w%d" % i for i in range(300)]
    docs = []
    for i in range(n):
        words = random.choices(plain, k=random.choice([5, 40, 200]))
        toxic = i % 3 == 0
        if toxic:
            for _ in range(1 + len(words) // 20):
                words[random.randrange(len(words))] = random.choice(["vilething", "Rotten,", "nastyword."])
        docs.append((i, " ".join(words), int(toxic)))
    return docs


def test_held_out_documents_are_told_apart(spark):
    rows = corpus(600)
    docs = spark.createDataFrame([(i, t, "s") for i, t, _ in rows] + [(None, None, "s"), (9000, "", "s"), (9001, "w1 " * 30000 + "nastyword", "s")],
                                 "doc_id long, text string, toxicity string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    net = T.train(docs, labels)
    got = {r.doc_id: r.score for r in T.with_toxicity(docs, net, name="score").collect()}
    folds = {r.doc_id for r in docs.filter(T.crc_fold(docs.doc_id, T.FOLDS) == 0).collect()}
    assert len(got) == 603
    right = [(got[i] >= 0.5) == bool(y) for i, _, y in rows if i in folds]
    assert np.mean(right) > 0.95
    assert got[9001] >= 0.5 and got[9000] < 0.5 and got[None] == got[9000]  # the last word of a long text counts
    kept = T.keep_clean(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, s in got.items() if s < 0.5}


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "")], "doc_id long, text string")
    net = T.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [round(r.score, 6) for r in T.with_toxicity(docs, net, name="score").collect()] == [0.5, 0.5]
    assert T.with_toxicity(docs.limit(0), net).count() == 0


@pytest.mark.parametrize("n", [1, 15, 16, 17, 28, 29, 40, 41, 1000])
def test_pieces_hold_every_trigram(n):
    word = bytes(random.Random(n).choices(b"abcdefghij", k=n))
    found = T.split_words(word)
    assert all(0 < len(p) <= T.CHARS for p in found) and (found == [word]) == (n <= T.CHARS)
    at = 0
    for p in found:
        assert word[at:at + T.CHARS] == p
        at += T.PIECE_STEP
    assert word.endswith(found[-1]) and len(found) == max(1, -(-(n - T.CHARS) // T.PIECE_STEP) + 1)
    assert T.split_words(b"(" + b"x" * 16 + b"),") == [b"(" + b"x" * 16 + b"),"]


def test_toxic_end_of_a_text_without_spaces(spark):
    random.seed(6)
    rows = []
    for i in range(600):
        text = "".join(chr(0x4E00 + random.randrange(300)) for _ in range(random.choice([30, 120, 400])))
        rows.append((i, text + ("惡毒罵人惡毒" if i % 3 == 0 else ""), int(i % 3 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    net = T.train(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    got = {r.doc_id: r.score for r in T.with_toxicity(docs.filter(T.crc_fold(docs.doc_id, T.FOLDS) == 0), net, name="score").collect()}
    assert np.mean([(got[i] >= 0.5) == bool(y) for i, _, y in rows if i in got]) > 0.9
    end = T.score_texts(net, [("_".join(["word"] * 500) + e).encode() for e in ("", "惡毒罵人惡毒")])
    assert end[1] > end[0]
