"""Interpolated modified Kneser-Ney bigram model, kept as sorted hash arrays that workers map into memory.

1. Words are counted by hash; each shard of the hash space is written as a sorted array of hashes with
   counts. A word's id is its place in the whole sorted sequence, so ids are exact and need no dictionary.
2. Bigrams are counted as pairs of ids, packed in one 64-bit key and written as sorted arrays with counts.
   A shard holds contexts by hash; a frequent context is split by its next word, so no shard grows with it.
   What each context and each next word needs (totals, counts of counts, continuations) leaves as partial sums.
3. The partial sums are added up into arrays beside the word hashes.

Scoring maps the files of the shared folder and looks up whole batches. Rows between stages are packed
blocks of arrays; the driver sees only sums. Counting combines in each task before anything is shuffled.
The number of shards follows the size of the corpus. Files in a store that is not mounted are fetched
into the worker's temporary folder for as long as the worker lives.

Defined results: a null text is empty, and an empty text is its end alone. A null id is never learned from.
Repeated rows are counted and scored row by row. Words not in the training text share one class beside
the V known ones, and a context not seen leaves the unigram distribution. Ids are 32-bit: at most 2 ** 32 - 2
distinct words. The model is of order 2; see the README for why.
"""

from __future__ import annotations

import struct
import tempfile
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from matricula.llm.base import (bound_batches, crc_fold, local_path, read_stream, register, shared_folder, table, through_table,
                                write_file)

FOLDS = 10
SHARD_BYTES = 16 << 20  # of training text for one shard
MAX_SHARDS = 1 << 14
FLUSH_TOKENS = 1 << 21  # combined in a task before its counts leave it
SCORED_BYTES = 3 << 20  # of text scored together: some twenty arrays of its tokens
SPLIT_CONTEXT = 1 << 17  # occurrences after which a context is dealt to one more shard
END = b" "  # not a word: words hold no space
WORDS, COUNTS = "<u8", "<u8"
BLOCK = "shard int, kind int, data binary"


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, in one compressed block."""
    head = struct.pack("<q", len(arrays[0]))
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def unpack(data: bytes, *types: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n, at, out = struct.unpack_from("<q", raw)[0], 8, []
    for t in types:
        out.append(np.frombuffer(raw, t, n, at))
        at += n * np.dtype(t).itemsize
    return out


def pack_keys(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted pair keys: contexts as differences, which compress well."""
    high = (keys >> np.uint64(32)).astype(np.int64)
    return pack(np.diff(high, prepend=0).astype("<u4"), (keys & np.uint64(0xFFFFFFFF)).astype("<u4"), counts.astype("<u4"))


def unpack_keys(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps, low, counts = unpack(data, "<u4", "<u4", "<u4")
    return np.cumsum(steps, dtype=np.uint64) << np.uint64(32) | low, counts


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, sorted, with their values added up."""
    if not len(keys):
        return keys, *values
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], *(np.add.reduceat(v[order].astype(np.int64), first) for v in values)


def runs(values: np.ndarray) -> Iterator[tuple[int, slice]]:
    """(value, slice) of the stretches of equal values in a sorted array."""
    if not len(values):
        return
    edges = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1], [True])))
    for a, b in zip(edges, edges[1:]):
        yield int(values[a]), slice(a, b)


class Tokens:
    """The words of some texts as numbers of distinct words, each text closed by its end."""

    def __init__(self) -> None:
        self.place: dict[bytes, int] = defaultdict(count().__next__)
        self.parts: list[np.ndarray] = []
        self.n = 0

    def add(self, text: bytes | None) -> int:
        words = (text or b"").lower().split()
        words.append(END)
        self.parts.append(np.fromiter(map(self.place.__getitem__, words), np.int64, len(words)))
        self.n += len(words)
        return len(words)

    def hashes(self) -> np.ndarray:
        return np.fromiter(map(xxh64_intdigest, self.place), np.uint64, len(self.place))

    def numbers(self) -> np.ndarray:
        return np.concatenate(self.parts) if self.parts else np.zeros(0, np.int64)


def _blocks(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary()))], names=["shard", "kind", "data"])


def _flushed(batches: Iterator[pa.RecordBatch], emit) -> Iterator[pa.RecordBatch]:
    """Gather texts and hand them to `emit` whenever enough have come."""
    tokens = Tokens()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            tokens.add(text)
            if tokens.n >= FLUSH_TOKENS:
                yield from emit(tokens)
                tokens = Tokens()
    if tokens.n:
        yield from emit(tokens)


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    """(shard, blocks) of a partition that is sorted by shard."""
    shard, held = None, []
    for batch in batches:
        for s, kind, data in zip(*(c.to_pylist() for c in batch.columns)):
            if s != shard and held:
                yield shard, held
                held = []
            shard = s
            held.append((kind, data))
    if held:
        yield shard, held


def _array(uri: str, dtype: str) -> np.ndarray:
    """A file of the shared folder, mapped into memory."""
    path = local_path(uri)
    if path is None:
        copy = tempfile.NamedTemporaryFile()  # lives as long as the array
        with read_stream(uri) as stream:
            while chunk := stream.read(1 << 22):
                copy.write(chunk)
        copy.flush()
        array = np.memmap(copy.name, dtype, "r") if copy.tell() else np.zeros(0, dtype)
        _COPIES.append(copy)
        return array
    with open(path, "rb") as f:
        empty = not f.read(1)
    return np.zeros(0, dtype) if empty else np.memmap(path, dtype, "r")


_COPIES: list = []
_MAPPED: dict[tuple[str, str], np.ndarray] = {}


class Store:
    """Look-ups in the files of one model. `sizes[s]` is the number of words of shard s."""

    def __init__(self, folder: str, bits: int, sizes: list[int]) -> None:
        self.folder, self.bits = folder, bits
        self.first = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        self.n_words, self.shards = int(self.first[-1]), len(sizes)

    def part(self, name: str, shard: int, dtype: str) -> np.ndarray:
        key = f"{self.folder}/{name}-{shard:05d}", dtype
        if key not in _MAPPED:
            _MAPPED[key] = _array(*key)
        return _MAPPED[key]

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of word hashes, -1 where unknown."""
        out = np.full(len(hashes), -1, np.int64)
        order = np.argsort(hashes)
        ordered = hashes[order]
        for s, span in runs(word_shard(ordered, self.bits)):
            known = self.part("words", s, WORDS)
            if len(known):
                at = np.minimum(np.searchsorted(known, ordered[span]), len(known) - 1)
                out[order[span]] = np.where(known[at] == ordered[span], at + self.first[s], -1)
        return out

    def values(self, name: str, ids: np.ndarray, dtype: str) -> np.ndarray:
        """Values beside the words; 0 for unknown ids. The text's start has the id n_words."""
        out = np.zeros(len(ids), np.int64)
        shard = self.shard_of(ids)
        order = np.argsort(shard, kind="stable")
        for s, span in runs(shard[order]):
            if s >= 0:
                rows = order[span]
                out[rows] = self.part(name, s, dtype)[ids[rows] - self.first[s]]
        return out

    def shard_of(self, ids: np.ndarray) -> np.ndarray:
        return np.where(ids < 0, -1, np.minimum(np.searchsorted(self.first, ids, "right") - 1, self.shards - 1))

    def pairs(self, context: np.ndarray, word: np.ndarray, frequency: np.ndarray) -> np.ndarray:
        """Counts of pairs of known ids."""
        out = np.zeros(len(word), np.int64)
        keys = pair_keys(context, word)
        shard = pair_shard(context, word, frequency, self.shards)
        order = np.argsort(shard, kind="stable")
        for s, span in runs(shard[order]):
            rows, known = order[span], self.part("pairs", s, WORDS)
            if len(known):
                at = np.minimum(np.searchsorted(known, keys[rows]), len(known) - 1)
                out[rows] = np.where(known[at] == keys[rows], self.part("pair_counts", s, "<u4")[at], 0)
        return out


def word_shard(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)


def pair_keys(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return context.astype(np.uint64) << np.uint64(32) | word.astype(np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(24)


def pair_shard(context: np.ndarray, word: np.ndarray, frequency: np.ndarray, shards: int) -> np.ndarray:
    """A context lies in one shard, or in one more for each SPLIT_CONTEXT of its occurrences."""
    split = _mixed(word) % (1 + frequency.astype(np.uint64) // np.uint64(SPLIT_CONTEXT))
    return (_mixed(context.astype(np.uint64) * np.uint64(1 << 20) + split) % np.uint64(shards)).astype(np.int64)


def contexts_of(numbers: np.ndarray, end: int, start: int) -> np.ndarray:
    """The id before each token; the start where the token before is an end."""
    before = np.concatenate(([end], numbers[:-1])) if len(numbers) else numbers
    return np.where(before == end, start, before)


def discounts(n: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts (0, D1, D2, D3+) from n[i], the number of entries counted i times (i = 1..4)."""
    y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else 0.5
    d = [i - (i + 1) * y * n[i + 1] / n[i] if n[i] else i / 2 for i in (1, 2, 3)]
    return np.array([0.0, *(min(max(x, 0.1), i - 0.1) for x, i in zip(d, (1, 2, 3)))])


def count_words(texts: DataFrame, folder: str, bits: int) -> tuple[list[int], int]:
    """Write the word arrays; return the words of each shard and the number of tokens."""

    def combine(batches):
        def emit(tokens: Tokens):
            hashes, totals = tokens.hashes(), np.bincount(tokens.numbers(), minlength=len(tokens.place))
            order = np.argsort(hashes)
            hashes, totals = hashes[order], totals[order]
            yield _blocks([(s, 0, pack(hashes[span], totals[span].astype(COUNTS))) for s, span in runs(word_shard(hashes, bits))])
        yield from _flushed(batches, emit)

    def write(batches):
        attempt = TaskContext.get().taskAttemptId()
        for s, blocks in _by_shard(batches):
            parts = [unpack(d, WORDS, COUNTS) for _, d in blocks]
            hashes, totals = summed(*(np.concatenate(c) for c in zip(*parts)))
            write_file(f"{folder}/words-{s:05d}", attempt, [hashes.tobytes()])
            write_file(f"{folder}/counts-{s:05d}", attempt, [totals.astype(COUNTS).tobytes()])
            yield pa.RecordBatch.from_pydict({"shard": pa.array([s], pa.int32()), "n": [len(hashes)], "tokens": [int(totals.sum())]})

    shards = 1 << bits
    blocks = texts.mapInArrow(combine, BLOCK)
    done = through_table(
        blocks.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(write, "shard int, n long, tokens long"), "words")
    sizes = [0] * shards
    tokens = 0
    for r in done.collect():  # one row a shard
        sizes[r["shard"]] = r["n"]
        tokens += r["tokens"]
    for s in range(shards):
        if not sizes[s]:
            for name in ("words", "counts"):
                write_file(f"{folder}/{name}-{s:05d}", 0, [])
    return sizes, tokens


PAIRS, CONTEXT, NEXT = 0, 1, 2


def count_pairs(texts: DataFrame, store: Store) -> tuple[np.ndarray, np.ndarray]:
    """Write the pair arrays and the arrays beside the words; return the counts of counts of pairs and of continuations."""
    folder, start = store.folder, store.n_words

    def combine(batches):
        def emit(tokens: Tokens):
            ids = store.ids(tokens.hashes())
            words = ids[tokens.numbers()]
            keys, totals = summed(pair_keys(contexts_of(words, int(ids[tokens.place[END]]), start), words), np.ones(len(words), np.int64))
            context, word = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
            shard = pair_shard(context, word, frequency(context), store.shards)
            order = np.argsort(shard, kind="stable")
            keys, totals = keys[order], totals[order]
            yield _blocks([(s, PAIRS, pack_keys(keys[span], totals[span])) for s, span in runs(shard[order])])
        yield from _flushed(batches, emit)

    frequency = store.frequency

    def write(batches):
        attempt = TaskContext.get().taskAttemptId()
        for s, blocks in _by_shard(batches):
            keys, totals = summed(*(np.concatenate(c) for c in zip(*(unpack_keys(d) for _, d in blocks))))
            write_file(f"{folder}/pairs-{s:05d}", attempt, [keys.tobytes()])
            write_file(f"{folder}/pair_counts-{s:05d}", attempt, [totals.astype("<u4").tobytes()])
            ones = [(totals == i).astype(np.int64) for i in (1, 2)]
            context = summed((keys >> np.uint64(32)).astype(np.int64), totals, *ones, (totals > 2).astype(np.int64))
            following = summed((keys & np.uint64(0xFFFFFFFF)).astype(np.int64), np.ones(len(keys), np.int64))
            rows = [(-1, PAIRS, pack(np.bincount(np.minimum(totals, 5), minlength=6).astype(COUNTS)))]
            for kind, (ids, *sums) in ((CONTEXT, context), (NEXT, following)):
                rows += [(t, kind, pack(*(a[span].astype(COUNTS) for a in (ids, *sums)))) for t, span in runs(store.shard_of(ids))]
            yield _blocks(rows)

    sums = through_table(
        texts.mapInArrow(combine, BLOCK).repartition(store.shards, "shard").sortWithinPartitions("shard").mapInArrow(write, BLOCK), "sums")

    def gather(batches):
        attempt = TaskContext.get().taskAttemptId()
        for s, blocks in _by_shard(batches):
            n = int(store.first[s + 1] - store.first[s]) + (s == store.shards - 1)  # the start comes after the last word
            arrays = {name: np.zeros(n, np.int64) for name in ("after", "once", "twice", "more", "before")}
            for kind, data in blocks:
                names = ("after", "once", "twice", "more") if kind == CONTEXT else ("before",)
                ids, *values = unpack(data, *[COUNTS] * (1 + len(names)))
                for name, v in zip(names, values):
                    np.add.at(arrays[name], ids.astype(np.int64) - store.first[s], v.astype(np.int64))
            for name, a in arrays.items():
                write_file(f"{folder}/{name}-{s:05d}", attempt, [a.astype(COUNTS).tobytes()])
            ahead = arrays["before"][arrays["before"] > 0]
            figures = np.append(np.bincount(np.minimum(ahead, 5), minlength=6), ahead.sum())
            yield _blocks([(s, NEXT, pack(figures.astype(COUNTS)))])

    done = through_table(
        sums.filter("shard >= 0").repartition(store.shards, "shard").sortWithinPartitions("shard").mapInArrow(gather, BLOCK), "gathered")
    of_pairs = sum((unpack(r["data"], COUNTS)[0].astype(np.int64) for r in sums.filter("shard < 0").collect()), np.zeros(6, np.int64))
    rows = done.collect()  # one row a shard
    of_next = sum((unpack(r["data"], COUNTS)[0].astype(np.int64) for r in rows), np.zeros(7, np.int64))
    seen = {r["shard"] for r in rows}
    for s in set(range(store.shards)) - seen:  # shards without a word
        n = int(store.first[s + 1] - store.first[s]) + (s == store.shards - 1)
        for name in ("after", "once", "twice", "more", "before"):
            write_file(f"{folder}/{name}-{s:05d}", 0, [np.zeros(n, COUNTS).tobytes()])
    return of_pairs, of_next


class Model(Store):
    """A trained model: figures on the driver, arrays in the shared folder."""

    tokens = 0
    texts = 0

    def frequency(self, context: np.ndarray) -> np.ndarray:
        """Occurrences of contexts, as far as the word counts tell; the start has as many as there are texts."""
        out = np.full(len(context), self.texts, np.int64)
        known = context < self.n_words
        out[known] = self.values("counts", context[known], COUNTS)
        return out

    def finish(self, of_pairs: np.ndarray, of_next: np.ndarray) -> None:
        self.pair_discount, self.next_discount = discounts(of_pairs), discounts(of_next)
        self.continuations = int(of_next[6])
        n = of_next[[1, 2, 3, 4, 5]]
        self.spared = float(np.dot(self.next_discount[1:], [n[0], n[1], n[2:].sum()]))

    def unigram(self, before: np.ndarray) -> np.ndarray:
        """Continuation probability, interpolated with one in V + 1."""
        if not self.continuations:
            return np.full(len(before), 1.0 / (self.n_words + 1))
        kept = before - self.next_discount[np.minimum(before, 3)]
        return (kept + self.spared / (self.n_words + 1)) / self.continuations

    def log10(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """log10 probability of each token, by ids (-1: unknown)."""
        low = self.unigram(self.values("before", word, COUNTS))
        total, once, twice, more = (self.values(n, context, COUNTS) for n in ("after", "once", "twice", "more"))
        pairs = np.zeros(len(word), np.int64)
        known = (word >= 0) & (total > 0)
        pairs[known] = self.pairs(context[known], word[known], self.frequency(context[known]))
        d = self.pair_discount
        high = (pairs - d[np.minimum(pairs, 3)] + (d[1] * once + d[2] * twice + d[3] * more) * low) / np.maximum(total, 1)
        return np.log10(np.where(total > 0, high, low))


def train(texts: DataFrame) -> Model:
    """texts(text): one binary column."""
    spark = texts.sparkSession
    bound_batches(spark)
    folder = shared_folder(spark, "bigrams")
    size = texts.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    bits = min(MAX_SHARDS, -(-(size["bytes"] or 1) // SHARD_BYTES)).bit_length()
    sizes, tokens = count_words(texts, folder, bits)
    model = Model(folder, bits, sizes)
    model.tokens, model.texts = tokens, size["n"]
    for s in range(model.shards):
        for name in ("pairs", "pair_counts"):
            write_file(f"{folder}/{name}-{s:05d}", 0, [])  # replaced where there are pairs
    model.finish(*count_pairs(texts, model))
    return model


def score(docs: DataFrame, model: Model, text: Column) -> DataFrame:
    """Add n_tokens, n_known, train_tokens, base_score and score to (doc_id, held_out) of `docs`."""

    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                            ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
        for batch in batches:
            tokens = Tokens()
            lengths = [tokens.add(t) for t in batch.column(2).to_pylist()]
            if not lengths:
                continue
            ids = model.ids(tokens.hashes())
            totals = model.values("counts", ids, COUNTS)
            base = np.log10((totals + 0.1) / (model.tokens + 0.1 * (model.n_words + 1)))
            numbers = tokens.numbers()
            doc = np.repeat(np.arange(len(lengths)), lengths)
            words = ids[numbers]
            before = contexts_of(numbers, tokens.place[END], -2)
            context = np.where(before == -2, model.n_words, ids[before])
            logs = model.log10(context, words)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(lengths, pa.int64()),
                pa.array(np.bincount(doc, totals[numbers] > 0, len(lengths)).astype("int64")),
                pa.array([model.tokens] * len(lengths), pa.int64()),
                pa.array(np.bincount(doc, base[numbers], len(lengths))), pa.array(np.bincount(doc, logs, len(lengths)))], schema=schema)

    bound_batches(docs.sparkSession, SCORED_BYTES)
    return docs.select(F.col("doc_id").cast("long"), "held_out", text.alias("text")).mapInArrow(
        run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


@register("op4_lm_scores")
def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.col("text").cast("binary").alias("text"), (crc_fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"))
    model = train(docs.filter(~F.col("held_out")).select("text"))
    return score(docs, model, F.col("text"))
