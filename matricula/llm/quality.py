"""Quality classifier: hierarchical empirical Bayes over document evidence, hosts and paths.

A logistic model on window statistics of the whole text gives a document's evidence. Its probabilities
are summed by host and by (host, path); each host's rate is shrunk toward the global rate, each path's
toward its host's, with strengths estimated from the spread between groups, so sparse sites fall back
to the priors. A document's score is its evidence moved by the log-odds of its site, without its own share.

The model learns from at most `SAMPLE` labelled documents (drawn by a hash of the id), never from
those of fold 0; everything else covers all rows. Site rows are joined by broadcast only up to
`BROADCAST_SITES`.

Defined results: null and empty texts have the features of no words. Null hosts and paths are groups of their
own. Null labels are left out; repeated rows and labels count as often as they occur. Without labels of
both classes the evidence is the smoothed share of good labels, for every document. Extra columns are ignored
by `scores` and kept by `keep_good`.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matricula.llm.base import bound_batches, crc_fold, give_back, register, table, through_table

SAMPLE, FOLDS, WINDOW = 20_000, 5, 64
BROADCAST_SITES = 100_000
THRESHOLD = 0.5
CLASSES = (bytes(range(65, 91)), b"0123456789", b"!?", b"|#$%&*@^~<>{}[]\\=+_/", b".,;:", b"\"'()-")


def features(text: bytes | None) -> np.ndarray:
    """Means and maxima over windows of words: character classes, repeats, distinct words, word length."""
    words = (text or b"").split()
    rows = []
    for at in range(0, max(1, len(words)), WINDOW):
        w = words[at:at + WINDOW] if len(words) >= at + WINDOW else words[-WINDOW:]
        joined = b"".join(w)
        size = max(1, len(joined))
        rows.append([
            *((len(joined) - len(joined.translate(None, c))) / size for c in CLASSES),
            sum(map(eq, w, w[1:])) / max(1, len(w)), sum(map(eq, w, w[2:])) / max(1, len(w)),
            len(set(w)) / max(1, len(w)), np.log1p(len(joined) / max(1, len(w))),
        ])
    stats = np.array(rows)
    return np.concatenate([stats.mean(0), stats.max(0), stats.min(0)[-2:], [np.log1p(len(words)), not words]])


class Model:
    """Logistic regression on standardised features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> None:
        n_features = x.shape[1] if x.ndim == 2 else len(features(b""))
        self.mean, self.scale = np.zeros(n_features), np.ones(n_features)
        self.weights = np.zeros(n_features + 1)
        self.weights[-1] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
        if len(set(y.tolist())) < 2:
            return
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        z = self._design(x)
        ridge = np.diag([penalty] * n_features + [1e-6])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ self.weights, -30, 30)))
            curve = z.T @ (z * (p * (1 - p) + 1e-9)[:, None]) + ridge
            step = np.linalg.solve(curve, z.T @ (y - p) - ridge @ self.weights)
            self.weights = self.weights + step
            if np.abs(step).max() < 1e-6:
                break

    def _design(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([np.clip((x - self.mean) / self.scale, -8, 8), np.ones((len(x), 1))])

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self._design(x) @ self.weights, -20, 20)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """docs(doc_id, text), labels(doc_id, quality): learn from at most `sample` labelled documents."""
    chosen = (
        labels.filter(F.col("quality").isNotNull() & (crc_fold(F.col("doc_id"), FOLDS) != 0))
        .select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    )

    @F.pandas_udf("array<double>")
    def measured(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t) for t in texts])

    bound_batches(docs.sparkSession, 2 << 20)
    # at most `sample` ids are broadcast, so the texts stay where they are
    rows = (
        docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
        .select(F.xxhash64("text").alias("h"), "quality", measured(F.col("text").cast("binary")).alias("x"))
        .orderBy("h", "quality").limit(2 * sample).toPandas()
    )
    x = np.array(rows["x"].tolist()) if len(rows) else np.zeros((0, len(features(b""))))
    return Model(x, rows["quality"].to_numpy(float))


def with_evidence(docs: DataFrame, model: Model, text: str = "text", name: str = "evidence") -> DataFrame:
    """Add the model's log-odds of good quality."""

    @F.pandas_udf("double")
    def evidence(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.logits(np.array([features(t) for t in texts])) if len(texts) else [], dtype=float)
            del texts
            give_back()

    bound_batches(docs.sparkSession, 2 << 20)
    return docs.withColumn(name, evidence(F.col(text).cast("binary")))


def _strength(groups: DataFrame, parent: Column) -> float:
    """Prior strength (pseudo-count) from the spread of group rates around the parent's rate."""
    r = groups.agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("groups"),
        F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - parent, F.lit(2))).alias("spread"),
        F.sum(F.col("n") * parent * (1 - parent)).alias("noise"),
    ).first()
    if not r["n"]:
        return 1.0
    noise = r["noise"] / r["n"]
    between = r["spread"] / r["n"] - noise * r["groups"] / r["n"]
    return float(np.clip(noise / max(between, 1e-9) - 1, 1.0, 1e6))


def site_rates(evidence: DataFrame) -> tuple[DataFrame, dict[str, float]]:
    """evidence(host, path, evidence) -> sites(host, path, host_n, host_good, n, good) and the global figures."""
    p = 1 / (1 + F.exp(-F.col("evidence")))
    paths = through_table(
        evidence.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum(p).alias("good")), "sites")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good"))
    total = paths.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    rate = float(np.clip(total["good"] / total["n"], 1e-6, 1 - 1e-6)) if total["n"] else 0.5
    figures = {"rate": rate, "host_strength": _strength(hosts.select(F.col("host_n").alias("n"), F.col("host_good").alias("good")), F.lit(rate))}
    sites = paths.join(hosts.withColumnRenamed("host", "_h"), F.col("host").eqNullSafe(F.col("_h"))).drop("_h")
    figures["path_strength"] = _strength(sites, _host_rate(figures, F.lit(0.0), F.lit(0.0)))
    return sites, figures


def _host_rate(f: dict[str, float], own: Column, one: Column) -> Column:
    k = f["host_strength"]
    return (F.col("host_good") - own + k * f["rate"]) / (F.col("host_n") - one + k)


def scored(rows: DataFrame, sites: DataFrame, f: dict[str, float]) -> DataFrame:
    """rows(..., host, path, evidence) with site (posterior rate of the site) and score added."""
    count = sites.count()
    sites = sites.select(F.col("host").alias("_host"), F.col("path").alias("_path"), "host_n", "host_good", "n", "good")
    joined = rows.join(
        F.broadcast(sites) if count <= BROADCAST_SITES else sites,
        F.col("host").eqNullSafe(F.col("_host")) & F.col("path").eqNullSafe(F.col("_path")))
    own, k = 1 / (1 + F.exp(-F.col("evidence"))), f["path_strength"]
    site = (F.col("good") - own + k * _host_rate(f, own, F.lit(1.0))) / (F.col("n") - 1 + k)
    site = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), site))
    moved = F.col("evidence") + F.log(site / (1 - site)) - float(np.log(f["rate"] / (1 - f["rate"])))
    return joined.select(*rows.columns, site.alias("site"), (1 / (1 + F.exp(-moved))).alias("score"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` whose score reaches the threshold. Texts are read three times and never shuffled."""
    model = train(docs, labels)
    rows = with_evidence(
        docs.select(F.struct(*docs.columns).alias("doc"), "text", F.col("source").alias("host"), F.col("lang").alias("path")), model)
    narrow = through_table(rows.select("host", "path", "evidence"), "evidence")
    return scored(rows.drop("text"), *site_rates(narrow)).filter(F.col("score") >= threshold).select("doc.*")


@register("op8_quality")
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host: the document's source; path: its language within the source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("host"), F.col("lang").alias("path"))
    model = train(docs, table(spark, sf_dir, "labels"))
    rows = through_table(with_evidence(docs, model).drop("text"), "evidence")
    return scored(rows, *site_rates(rows)).select(
        "doc_id", (crc_fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "host", "path", "evidence", "site", "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
