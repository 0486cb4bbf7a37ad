"""Periodic runs of words, found with string synchronising sets.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and a length of at
least `EXPONENT` * q and `LEAST` words, which no neighbouring word extends with that period.

Periods up to `DIRECT` are found by comparing the words with themselves, shifted. Longer ones are found at the
dyadic scale t with t <= period < 2t. A window of t words has an id, the hash of its words. A position is selected
if the least id of the t + 1 windows from there on is that of the first or of the last one, and so the choice
depends on the next 2t words only: equal contexts are selected alike. Windows with a period of up to t/4 have no id
(else every position inside would be selected); they lie in runs of small periods, which smaller scales have
found. In a run of period p some position of the first t is selected, the one p words on has the same context, and
no selected position between has it, so equal contexts of neighbouring selected positions propose every period of
the scale. A proposal is extended word by word to a whole run, so hashes only propose and never decide.

Texts of a batch are read together, parted by numbers that occur once; a task holds one batch, and a text is
never cut. Work is in proportion to the words, times the squared logarithm of the longest text.

Defined results: words are split at ASCII white space and compared byte by byte. Null and empty texts, and texts of
white space, have no words, no runs and an empty collapsed text. Repeated rows are read row by row, null ids are
kept, an empty table gives no rows. Other columns stay; those named n_words, runs or collapsed are replaced.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matricula.llm.base import bound_batches, register, table

EXPONENT, LEAST = 4, 6
DIRECT = 3  # periods found without selected positions
SPACES = r"[\x20\x09-\x0D]+"
SCHEMA = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0xA0761D6478BD642F)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(32))


def _ahead(x: np.ndarray, by: int, fill) -> np.ndarray:
    """x[i + by] at i."""
    out = np.full_like(x, fill)
    out[:max(0, len(x) - by)] = x[by:]
    return out


def _doubled(ids: np.ndarray, size: int) -> np.ndarray:
    """Ids of windows of twice the size."""
    return _mixed(ids * np.uint64(0x9E3779B97F4A7C15) + _mixed(_ahead(ids, size, 0)))


def _inside(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n positions lie in one of the half-open stretches."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, ends, -1)
    return np.cumsum(steps[:-1]) > 0


def _direct(x: np.ndarray, period: int) -> np.ndarray:
    """(start, end) of all stretches of a period that are at least `EXPONENT` periods long."""
    same = np.zeros(max(0, len(x) - period) + 2, np.int8)
    same[1:-1] = x[:-period] == x[period:] if len(x) > period else 0
    edge = np.flatnonzero(np.diff(same))
    found = np.stack([edge[::2], edge[1::2] + period], 1)
    return found[found[:, 1] - found[:, 0] >= EXPONENT * period]


def _equal_steps(x: np.ndarray, at: int, period: int, forward: bool) -> int:
    """How many words from `at` on (or before it) equal those a period later."""
    most = len(x) - period - at if forward else at
    done, size = 0, 64
    while done < most:
        size = min(2 * size, most - done)
        low = at + done if forward else at - done - size
        differ = np.flatnonzero(x[low:low + size] != x[low + period:low + period + size])
        if len(differ):
            return done + int(differ[0] if forward else size - 1 - differ[-1])
        done += size
    return done


def selected(ids: np.ndarray, free: np.ndarray, size: int) -> np.ndarray:
    """Positions of the synchronising set of a scale; `free` windows have no id."""
    none = np.uint64((1 << 64) - 1)
    ids = np.where(free, none, ids)
    least, covered = ids, 1
    while covered < size:
        least = np.minimum(least, _ahead(least, covered, none))
        covered *= 2
    last = _ahead(ids, size, none)
    least = np.minimum(least, last)
    return np.flatnonzero((least != none) & ((least == ids) | (least == last)))


def proposals(contexts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """contexts: ids of 2 * size words at selected positions -> (order, earlier, later) of neighbours that are equal."""
    order = np.argsort(contexts, kind="stable")
    sorted_ = contexts[order]
    at = np.flatnonzero(sorted_[1:] == sorted_[:-1])
    return order, at, at + 1


def find_runs(numbers: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """numbers: words of all texts as numbers, each text closed by a number of its own; sizes: for each place the
    words of its text. -> rows (start, length, period), by start and period."""
    found: dict[tuple[int, int], int] = {}
    for period in range(1, DIRECT + 1):
        for start, end in _direct(numbers, period).tolist():
            found.setdefault((start, end), period)  # a stretch of a smaller period has its multiples too
    x, place, ids = numbers, np.arange(len(numbers)), _mixed(numbers.astype(np.uint64) + np.uint64(1))
    size = 1
    while len(x):
        if size > DIRECT:
            _at_scale(x, place, ids, size, found)
        ids = _doubled(ids, size)
        size *= 2
        long = sizes >= EXPONENT * size
        if not long.all():  # texts too short for a run of this scale
            x, place, ids, sizes = x[long], place[long], ids[long], sizes[long]
    rows = [(s, e - s, p) for (s, e), p in found.items() if e - s >= max(LEAST, EXPONENT * p)]
    return np.array(sorted(rows, key=lambda r: (r[0], r[2])), np.int64).reshape(-1, 3)


def _at_scale(x: np.ndarray, place: np.ndarray, ids: np.ndarray, size: int, found: dict[tuple[int, int], int]) -> None:
    """Add the runs of periods size .. 2 * size - 1."""
    small = [(s, e) for (s, e), p in found.items() if EXPONENT * p <= size and e - s >= size]
    free = np.zeros(len(x), bool)
    if small:
        start, end = np.array(small).T
        kept = np.isin(start, place)
        start = np.searchsorted(place, start[kept])
        free = _inside(len(x), start, start + (end - np.array(small).T[0])[kept] - size + 1)
    chosen = selected(ids, free, size)
    order, earlier, later = proposals(_doubled(ids, size)[chosen], size)
    at = chosen[order]
    period = at[later] - at[earlier]
    fits = (period >= size) & (period < 2 * size)
    pairs = np.stack([period[fits], at[earlier][fits]], 1)
    last, start, end = 0, 0, 0
    for p, i in pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))].tolist():
        if p == last and start <= i and i + p < end:
            continue  # of the stretch just seen
        start, end = i - _equal_steps(x, i, p, False), i + p + _equal_steps(x, i, p, True)
        last = p
        if end - start >= EXPONENT * p:
            first = int(place[start])
            found.setdefault((first, first + end - start), p)


def runs_of(texts: list[bytes | None]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, first place of each text, runs by place, places dropped when runs are collapsed)."""
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    words = [(t or b"").split() for t in texts]
    size = np.array([len(w) for w in words], np.int64)
    first = np.concatenate([[0], np.cumsum(size + 1)])
    numbers = np.empty(int(first[-1]), np.int64)
    for at, own in zip(first.tolist(), words):
        numbers[at:at + len(own)] = np.fromiter(map(number.__getitem__, own), np.int64, len(own))
    numbers[first[1:] - 1] = len(number) + np.arange(len(words))
    runs = find_runs(numbers, np.repeat(size, size + 1))
    return words, first, runs, _inside(len(numbers), runs[:, 0] + runs[:, 2], runs[:, 0] + runs[:, 1])


def with_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, runs (by start and period) and collapsed: the words without those that a run repeats, joined by one space."""

    @F.arrow_udf(SCHEMA)
    def measured(texts: pa.Array) -> pa.Array:
        words, first, runs, dropped = runs_of(texts.to_pylist())
        own = np.searchsorted(first, runs[:, 0], "right") - 1
        starts = np.concatenate([[0], np.cumsum(np.bincount(own, minlength=len(words)))]).astype(np.int32)
        items = pa.StructArray.from_arrays(
            [pa.array(runs[:, 0] - first[own]), pa.array(runs[:, 1]), pa.array(runs[:, 2])], ["start", "length", "period"])
        touched, joined = set(own.tolist()), []
        for n, w in enumerate(words):
            if n in touched:
                out = dropped[first[n]:first[n] + len(w)].tolist()
                w = [x for x, gone in zip(w, out) if not gone]
            joined.append(b" ".join(w))
        return pa.StructArray.from_arrays(
            [pa.array([len(w) for w in words], pa.int64()), pa.ListArray.from_arrays(pa.array(starts), items),
             pa.array(joined, pa.binary()).cast(pa.string())], ["n_words", "runs", "collapsed"])

    bound_batches(docs.sparkSession, 8 << 20)
    names = ("n_words", "runs", "collapsed")
    out = docs.withColumn("_runs", measured(F.col(text).cast("binary")))
    kept = [c for c in docs.columns if c not in names]
    return out.select(*kept, *(F.col(f"_runs.{n}").alias(n) for n in names))


def longest(runs: Column) -> Column:
    """The run of the greatest length; ties: least start, then period."""
    key = F.transform(runs, lambda r: F.struct(-r["length"], r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")))
    return F.array_min(key)


def planted(docs: DataFrame) -> DataFrame:
    """In a tenth of the documents (by a hash of the id) the words from some place on repeat a stretch there."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", SPACES, -1), lambda w: w != "")
    rows = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("w")).withColumn("n", F.array_size("w").cast("long"))
    g = F.floor(F.col("h") / 10).cast("long")
    rows = rows.withColumn("a", F.when(F.col("n") > 0, g % F.when(F.col("n") > 0, F.col("n"))))
    p = 1 + F.floor((F.col("n") - F.col("a")) / (3 + g % 8)).cast("long")
    rows = rows.withColumn("p", p)
    repeated = F.transform(
        "w", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


@register("op11_runs")
def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_runs(planted(table(spark, sf_dir, "documents").select("doc_id", "text"))).withColumn("best", longest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n")))
    length, period = F.col("best.length"), F.col("best.period")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
