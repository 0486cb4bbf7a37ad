"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input is its own embedding (words of the training windows; others share one) beside the mean
embedding of its character trigrams; a word of over `CHARS` bytes, as in texts without spaces, is read as several
overlapping pieces, each a word of its own. The network reads windows of `WINDOW` words; attention over its
states gives one vector and a logit. All overlapping windows of a text are scored, to its very end, and
the largest logit is the text's. Documents are labelled, windows are not: after a first round in which all
windows of a document carry its label, only the likeliest windows of a toxic document do.

The model learns from at most `SAMPLE` labelled documents of each class (drawn by a hash of the id) and
`WINDOWS_PER_DOC` windows of each, never from those of fold 0; those of fold 1, with up to
`CALIBRATION_WINDOWS` windows, are kept from training and set where the score crosses 0.5. Nothing but the text enters a score.

Defined results: null and empty texts are scored as one window without words. Null labels and ids are
not learned from; repeated rows are scored row by row. Without labels of both classes every score is the
smoothed share of toxic labels.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh32_intdigest

from matricula.llm.base import bound_batches, crc_fold, give_back, register, table

SAMPLE, FOLDS, WINDOWS_PER_DOC = 5000, 5, 8
CALIBRATION_FOLD, CALIBRATION_WINDOWS = 1, 32  # documents of this fold are not trained on
WINDOW, STRIDE = 32, 24
HIDDEN, WORD_DIM, CHAR_DIM, TRIGRAMS, CHARS = 8, 8, 8, 1 << 13, 16
PIECE_STEP = 12  # whole characters of three or four bytes
MIN_COUNT, EPOCHS, BATCH, RATE, CHAR_PACE, SEED = 3, 5, 96, 0.005, 0.5, 11
CHUNK = 4096  # windows scored together
DECAY, MIN_STEPS = 0.05, 400
STRIPPED = b".,;:!?\"'()[]{}|*_-"


def pieces(word: bytes) -> list[bytes]:
    """A word, or its overlapping pieces of CHARS bytes: every byte and every trigram lies whole in one."""
    bare = word.strip(STRIPPED) or word
    if len(bare) <= CHARS:
        return [word]
    return [bare[at:at + CHARS] for at in range(0, len(bare) - CHARS + PIECE_STEP, PIECE_STEP)]


def split_words(text: bytes | None) -> list[bytes]:
    """The steps of the network: words, longer ones in pieces."""
    words = (text or b"").lower().split()
    if max(map(len, words), default=0) <= CHARS:
        return words
    return [p for w in words for p in (pieces(w) if len(w) > CHARS else (w,))]


def window_starts(n: int) -> range:
    """Starts of overlapping windows that cover words 0..n-1."""
    return range(0, max(1, n - WINDOW + STRIDE), STRIDE)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def trigram_codes(words: list[bytes]) -> np.ndarray:
    """(words, CHARS) trigram buckets of each word with its borders; 0 is no trigram."""
    out = np.zeros((len(words), CHARS), np.uint16)
    for at in range(0, len(words), CHUNK):
        part = [b"^" + w[:CHARS] + b"$" for w in words[at:at + CHUNK]]
        text = np.frombuffer(b"".join(w.ljust(CHARS + 2, b"\0") for w in part), np.uint8).reshape(-1, CHARS + 2).astype(np.int32)
        a, b, c = (text[:, i:i + CHARS] for i in range(3))
        out[at:at + CHUNK] = np.where(c > 0, 1 + (a * 8191 + b * 131 + c * 17) % (TRIGRAMS - 1), 0)
    return out


class Network:
    def __init__(self, vocabulary: dict[bytes, int], rng: np.random.Generator, bias: float = 0.0) -> None:
        self.vocabulary = vocabulary
        d, h = WORD_DIM + CHAR_DIM, HIDDEN

        def weights(*shape):
            return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        self.p = {
            "word": 0.1 * rng.standard_normal((len(vocabulary) + 1, WORD_DIM)).astype(np.float32),
            "char": 0.1 * rng.standard_normal((TRIGRAMS, CHAR_DIM)).astype(np.float32),
            "Wf": weights(d, 3 * h), "Uf": weights(h, 3 * h), "bf": np.zeros(3 * h, np.float32),
            "Wb": weights(d, 3 * h), "Ub": weights(h, 3 * h), "bb": np.zeros(3 * h, np.float32),
            "A": weights(2 * h, h), "a": np.zeros(h, np.float32), "v": weights(h, 1)[:, 0],
            "u": weights(2 * h, 1)[:, 0], "c": np.array([bias], np.float32),
        }
        self.slope, self.shift = 1.0, 0.0  # of a text's logit, see calibrate()
        self.p["word"][0] = 0
        self.p["char"][0] = 0

    def inputs(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word rows, trigram buckets, trigram counts) of distinct words."""
        bare = [w.strip(STRIPPED) or w for w in words]
        codes = trigram_codes(bare)
        rows = np.fromiter((self.vocabulary.get(w, 0) for w in bare), np.int64, len(bare))
        return rows, codes, np.maximum(1, (codes > 0).sum(1)).astype(np.float32)

    def embed(self, rows: np.ndarray, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        chars = np.zeros((len(rows), CHAR_DIM), np.float32)
        for i in range(CHARS):  # one column at a time keeps memory small
            chars += self.p["char"][codes[:, i]]
        return np.hstack([self.p["word"][rows], chars / counts[:, None]])

    def run(self, side: str, gates: np.ndarray, index: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States (steps, windows, hidden) of one direction; `gates` holds the input part of each distinct word."""
        u, h = self.p["U" + side], HIDDEN
        state = np.zeros((len(index), h), np.float32)
        out = np.zeros((WINDOW, len(index), h), np.float32)
        for t in range(WINDOW) if side == "f" else range(WINDOW - 1, -1, -1):
            x, y = gates[index[:, t]], state @ u
            zr = _sigmoid(x[:, :2 * h] + y[:, :2 * h])
            z, r = zr[:, :h], zr[:, h:]
            n = np.tanh(x[:, 2 * h:] + r * y[:, 2 * h:])
            m = mask[:, t:t + 1]
            new = state + m * (1 - z) * (n - state)
            if keep is not None:
                keep.append((t, state, z, r, n, y[:, 2 * h:], m))
            state = out[t] = new
        return out

    def pool(self, states: np.ndarray, mask: np.ndarray):
        """Attention over the steps; a window without words pools to zero."""
        tanh = np.tanh(states @ self.p["A"] + self.p["a"])
        raw = np.where(mask.T > 0, tanh @ self.p["v"], -1e9)
        weight = np.exp(raw - raw.max(0)) * mask.T
        weight /= np.maximum(weight.sum(0), 1e-9)
        pooled = (weight[:, :, None] * states).sum(0)
        return tanh, weight, pooled, pooled @ self.p["u"] + self.p["c"][0]

    def logits(self, embedded: np.ndarray, index: np.ndarray, mask: np.ndarray) -> np.ndarray:
        gates = {s: embedded @ self.p["W" + s] + self.p["b" + s] for s in "fb"}
        out = []
        for at in range(0, len(index), CHUNK):
            i, m = index[at:at + CHUNK], mask[at:at + CHUNK]
            states = np.concatenate([self.run(s, gates[s], i, m) for s in "fb"], axis=2)
            out.append(self.pool(states, m)[3])
        return np.concatenate(out) if out else np.zeros(0, np.float32)

    def gradients(self, rows, codes, counts, index, mask, target) -> dict:
        """Gradients of the mean cross-entropy; those of the two tables come as (rows, values)."""
        p, h = self.p, HIDDEN
        x = self.embed(rows, codes, counts)
        kept = {"f": [], "b": []}
        states = np.concatenate(
            [self.run(s, x @ p["W" + s] + p["b" + s], index, mask, kept[s]) for s in "fb"], axis=2)
        tanh, weight, pooled, logit = self.pool(states, mask)
        g = {}
        dlogit = (_sigmoid(logit) - target) / len(target)
        g["u"], g["c"] = pooled.T @ dlogit, np.array([dlogit.sum()], np.float32)
        dpooled = dlogit[:, None] * p["u"]
        dstates = weight[:, :, None] * dpooled
        dweight = (states * dpooled).sum(2)
        draw = weight * (dweight - (weight * dweight).sum(0))
        g["v"] = np.einsum("tbh,tb->h", tanh, draw)
        dtanh = draw[:, :, None] * p["v"] * (1 - tanh ** 2)
        g["A"] = np.einsum("tbi,tbj->ij", states, dtanh)
        g["a"] = dtanh.sum((0, 1))
        dstates = dstates + dtanh @ p["A"].T
        dx = np.zeros_like(x)
        for s, part in (("f", dstates[:, :, :h]), ("b", dstates[:, :, h:])):
            dgates = np.zeros((len(x), 3 * h), np.float32)
            du, dstate = np.zeros_like(p["U" + s]), np.zeros_like(part[0])
            for t, old, z, r, n, yn, m in reversed(kept[s]):
                d = dstate + part[t]
                dn = d * m * (1 - z) * (1 - n ** 2)
                dz = d * m * (old - n) * z * (1 - z)
                dr = dn * yn * r * (1 - r)
                dy = np.hstack([dz, dr, dn * r])
                du += old.T @ dy
                np.add.at(dgates, index[:, t], np.hstack([dz, dr, dn]))
                dstate = d * (1 - m * (1 - z)) + dy @ p["U" + s].T
            g["U" + s], g["b" + s], g["W" + s] = du, dgates.sum(0), x.T @ dgates
            dx += dgates @ p["W" + s].T
        g["word"] = rows, dx[:, :WORD_DIM]
        spread = np.repeat((dx[:, WORD_DIM:] / counts[:, None])[:, None], CHARS, axis=1)
        g["char"] = codes.ravel(), spread.reshape(-1, CHAR_DIM)
        return g

    def step(self, g: dict, moments: dict, rate: float) -> None:
        """Adam; of the two tables only the rows in use move, and row 0 never does."""
        moments["t"] = t = moments.get("t", 0) + 1
        norm = np.sqrt(sum(float((v[1] if isinstance(v, tuple) else v).ravel() @ (v[1] if isinstance(v, tuple) else v).ravel()) for v in g.values()))
        for name, grad in g.items():
            if name not in moments:
                moments[name] = np.zeros_like(self.p[name]), np.zeros_like(self.p[name])
            at = slice(None)
            if norm > 1:
                grad = (grad[0], grad[1] / norm) if isinstance(grad, tuple) else grad / norm
            if isinstance(grad, tuple):
                at, inverse = np.unique(grad[0], return_inverse=True)
                total = np.zeros((len(at), grad[1].shape[1]), np.float32)
                np.add.at(total, inverse, grad[1])
                at, grad = at[at > 0], total[at > 0]
            m, v = moments[name]
            m[at] = 0.9 * m[at] + 0.1 * grad
            v[at] = 0.999 * v[at] + 0.001 * grad ** 2
            pace = rate * CHAR_PACE if name == "char" else rate  # known words lead, their spelling follows
            self.p[name][at] *= 1 - DECAY * pace
            self.p[name][at] -= pace * (m[at] / (1 - 0.9 ** t)) / (np.sqrt(v[at] / (1 - 0.999 ** t)) + 1e-8)


    def calibrate(self, best: np.ndarray, y: np.ndarray) -> None:
        """A logistic fit of the labels on the largest logits, both classes weighing alike: it sets 0.5 amid the gap."""
        each = np.where(y == 1, (y == 0).sum() / max(1, y.sum()), 1.0)
        z, w = np.stack([best.astype(float), np.ones(len(best))], 1), np.array([1.0, 0.0])
        for _ in range(100):
            p = _sigmoid(z @ w)
            curve = z.T @ (z * (each * p * (1 - p) + 1e-9)[:, None]) + 0.1 * np.diag([1, 1e-3])
            step = np.linalg.solve(curve, z.T @ (each * (y - p)) - 0.1 * np.array([w[0], 0]))
            w = w + np.clip(step, -1, 1)
            if np.abs(step).max() < 1e-6:
                break
        self.slope, self.shift = max(float(w[0]), 1e-3), float(w[1])


def _indexed(windows: list[list[bytes]]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words, and for each window the places of its words and which steps it has."""
    place: dict[bytes, int] = {b"": 0}
    index, mask = np.zeros((len(windows), WINDOW), np.int32), np.zeros((len(windows), WINDOW), np.float32)
    for n, w in enumerate(windows):
        index[n, :len(w)] = [place.setdefault(x, len(place)) for x in w]
        mask[n, :len(w)] = 1
    return list(place), index, mask


def fit(windows: list[list[list[bytes]]], labels: list[int], held: list[bool], epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """windows: for each document some of its windows, each a list of words; `held` ones set the border only."""
    rng = np.random.default_rng(seed)
    counts = Counter(w.strip(STRIPPED) for doc in windows for win in doc for w in win)
    vocabulary = {w: n + 1 for n, w in enumerate(sorted(w for w, c in counts.items() if c >= MIN_COUNT and w))}
    y_all, held = np.array(labels, np.float32), np.array(held, bool)
    texts = [doc for doc, h in zip(windows, held) if h]
    windows = [doc for doc, h in zip(windows, held) if not h]
    y = y_all[~held]
    share = (y_all.sum() + 1) / (len(y_all) + 2)
    net = Network(vocabulary, rng, float(np.log(share / (1 - share))))
    if min(len(set(y.tolist())), len(set(y_all[held].tolist()))) < 2:
        net.p["u"][:] = 0  # nothing to tell apart
        return net
    flat = [w for doc in windows for w in doc]
    owner = np.repeat(np.arange(len(windows)), [len(d) for d in windows])
    words, index, mask = _indexed(flat)
    rows, codes, n_grams = net.inputs(words)
    moments: dict = {}
    for epoch in range(epochs):
        if epoch:
            logit = net.logits(net.embed(rows, codes, n_grams), index, mask)
            order = np.lexsort((-logit, owner))
            rank = np.empty(len(flat), np.int64)
            rank[order] = np.arange(len(flat)) - np.searchsorted(owner[order], owner[order])
            # the likeliest windows of a toxic document; of others the likeliest, all near the border and some at random
            chosen = np.where(y[owner] == 1, rank < 1 + 2 // epoch, (rank < 1) | (logit > -2) | (rng.random(len(flat)) < 0.1))
            picked = np.flatnonzero(chosen)
        else:
            picked = np.flatnonzero(rng.random(len(flat)) < 0.4)
        rounds = -(-MIN_STEPS * BATCH // (epochs * max(1, len(picked))))  # a small sample is gone over again
        picked = np.concatenate([rng.permutation(picked) for _ in range(rounds)])
        for at in range(0, len(picked), BATCH):
            batch = picked[at:at + BATCH]
            used, inverse = np.unique(index[batch], return_inverse=True)
            g = net.gradients(rows[used], codes[used], n_grams[used], inverse.reshape(len(batch), WINDOW),
                              mask[batch], y[owner[batch]])
            net.step(g, moments, RATE * (1 - epoch / epochs))
    words, index, mask = _indexed([w for doc in texts for w in doc])
    best = np.full(len(texts), -np.inf)
    np.maximum.at(best, np.repeat(np.arange(len(texts)), [len(d) for d in texts]), net.logits(net.embed(*net.inputs(words)), index, mask))
    net.calibrate(best, y_all[held])
    return net


def score_texts(net: Network, texts: list[bytes | None]) -> np.ndarray:
    """The largest logit over all windows of each text."""
    place: dict[bytes, int] = {b"": 0}
    starts, at, flat = [], [], []
    total = 0
    for n, text in enumerate(texts):
        words = split_words(text)
        flat.append(np.array([place.setdefault(w, len(place)) for w in words], np.int32))
        own = np.array(window_starts(len(words)))
        starts.append(np.stack([own + total, np.minimum(WINDOW, len(words) - own)]))
        at.append(np.full(len(own), n))
        total += len(words)
    tokens = np.concatenate([*flat, np.zeros(WINDOW, np.int32)])
    (begin, length), owner = np.concatenate(starts, axis=1), np.concatenate(at)
    steps = np.arange(WINDOW)
    embedded = net.embed(*net.inputs(list(place)))
    best = np.full(len(texts), -np.inf, np.float32)
    for i in range(0, len(begin), CHUNK):
        mask = (steps < length[i:i + CHUNK, None]).astype(np.float32)
        index = np.where(mask > 0, tokens[np.minimum(begin[i:i + CHUNK, None] + steps, len(tokens) - 1)], 0)
        np.maximum.at(best, owner[i:i + CHUNK], net.logits(embedded, index, mask))
    return best * net.slope + net.shift


def sampled_windows(text: bytes | None, most: int = WINDOWS_PER_DOC) -> list[bytes]:
    """At most `most` windows of a text, drawn by a hash of their place and words."""
    words = split_words(text)
    found = [b" ".join(words[s:s + WINDOW]) for s in window_starts(len(words))]
    return sorted(found, key=lambda w: xxh32_intdigest(w, SEED))[:most]


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network:
    """docs(doc_id, text), labels(doc_id, toxic)."""
    known = labels.filter(F.col("toxic").isin(0, 1) & (crc_fold(F.col("doc_id"), FOLDS) != 0)).select("doc_id", "toxic")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.filter("toxic = 1").orderBy(*order).limit(sample).union(known.filter("toxic = 0").orderBy(*order).limit(sample))

    @F.pandas_udf("array<binary>")
    def windows(texts: pd.Series, held: pd.Series) -> pd.Series:
        return pd.Series([sampled_windows(t, CALIBRATION_WINDOWS if h else WINDOWS_PER_DOC) for t, h in zip(texts, held)])

    bound_batches(docs.sparkSession, 2 << 20)
    rows = (
        docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most 2 * sample ids
        .withColumn("held", crc_fold(F.col("doc_id"), FOLDS) == CALIBRATION_FOLD)
        .select("toxic", "held", F.xxhash64("text").alias("h"), windows(F.col("text").cast("binary"), "held").alias("w"))
        .orderBy("h", "toxic").limit(4 * sample).toLocalIterator()
    )
    one: dict[bytes, bytes] = {}  # a word is kept once, however often it occurs
    docs_, labels_, held = [], [], []
    for r in rows:
        docs_.append([[one.setdefault(w, w) for w in bytes(window).split()] for window in r["w"]])
        labels_.append(int(r["toxic"]))
        held.append(r["held"])
    net = fit(docs_, labels_, held)
    del docs_, one
    give_back()
    return net


def with_toxicity(docs: DataFrame, net: Network, text: str = "text", name: str = "toxicity") -> DataFrame:
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(_sigmoid(score_texts(net, list(texts)).astype(float)) if len(texts) else [], dtype=float)
            del texts
            give_back()

    bound_batches(docs.sparkSession, 2 << 20)
    return docs.withColumn(name, score(F.col(text).cast("binary")))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    net = train(docs, labels)
    rows = docs.select(F.struct(*docs.columns).alias("doc"), "text")
    return with_toxicity(rows, net).filter(F.col("toxicity") < threshold).select("doc.*")


@register("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = train(docs, table(spark, sf_dir, "labels"))
    return with_toxicity(docs, net, name="score").select(
        "doc_id", (crc_fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))
