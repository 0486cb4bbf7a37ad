"""Alignment of two tokenizers over one text: which tokens of A and of B share bytes.

A reads a space and the text, B the text, before which it puts a space itself; so both cover the same bytes. Offsets
where tokens of both end cut them into groups; a link is a token of A and one of B that overlap. How often an A id
and a B id are linked is counted over all documents, and every document is scored by the counts of its links.

Identity map: for each A id the B id of the same bytes is computed before. A group of one A and one B token of that
kind is counted in a vector as long as A's vocabulary, which a task emits once. Only links of other groups become
pairs, and they are shuffled once for a block of documents, however often they occur in it. The counts come
back to the blocks by a join and to the documents of a block by a cogroup; the vector of the identity map, one row an id
of A at most, goes to all tasks.

Texts are cut before spaces and line feeds that follow a letter, digit or ASCII mark, and between a Latin letter and
a mark such as a comma: places that no token of either spans (where one could, texts are not cut). Each distinct stretch of a block is aligned once, all new ones
of a batch at a time: every interval between neighbouring token ends is one link. A block ends at `STRETCHES` distinct or
`WORDS` stretches in all, so a task holds a bounded part; a longer document is a block of its own.

Defined results: null and empty texts, and texts whose tokens do not give their bytes (such as with U+2581), have
no tokens: all numbers are zero and `groups` is empty. Repeated rows count as often as they occur, null ids are
kept, an empty table gives no rows, other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matricula.llm.base import bound_batches, register, table, through_table
from matricula.llm.pieces import CACHED, SPACE, PieceModel, TwoGenerations, model_path, piece_model

STRETCHES, WORDS = 1 << 17, 1 << 21
ENCODED, ALIGNED = 1 << 12, 1 << 15  # stretches that A reads at once, and that are aligned at once
BLOCKS_OF_A_TASK = 1 << 32
ROWS, BYTES = 4096, 8 << 20  # of a batch that leaves a task
B_IDS = 1 << 24  # more than any vocabulary has: an id pair is a * B_IDS + b
TOTALS = ("n_a", "n_b", "n_groups", "n_links")
DOCUMENT, BLOCK, PAIR, SAME = range(4)
SCHEMA = ("kind int, block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, "
          "body binary, a int, b int, n long")
_ARROW = pa.schema([(c.split()[0], {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[c.split()[1]])
                    for c in SCHEMA.split(", ")])
LETTERS, MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", ",.;:!?"
_LOADED: dict[tuple[str, str], Tokenizers] = {}


def byte_alphabet() -> dict[str, int]:
    """The byte each character of a byte-level vocabulary stands for: printable Latin-1 itself, others moved above 255."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """A (a byte-level file of `tokenizers`) and B (a piece model) with the bytes of their ids."""

    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b: PieceModel = piece_model(b_path)
        byte = byte_alphabet()
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        self.a_raw = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_raw[i] = bytes(byte[c] for c in token)
        self.a_size = np.array([len(x) for x in self.a_raw], np.int64)
        self.b_size = np.array([len(x) for x in self.b.raw], np.int64)
        b_of = {raw: i for i, raw in enumerate(self.b.raw) if raw}
        b_of |= {self.b.raw[i]: i for i in self.b.id_of.values()}  # whole pieces before single bytes
        self.same = np.array([b_of.get(raw, -1) for raw in self.a_raw], np.int64)
        with open(a_path, encoding="utf-8") as f:
            step = json.load(f)["pre_tokenizer"]
        cuts_words = step["type"] == "ByteLevel" and step["use_regex"] and not step["add_prefix_space"]
        self.cut = None
        if cuts_words and self.b.splits_words and not any(y == "\n" for _, y in self.b.together):
            inside = {y for x, y in self.b.together if re.match(f"[{LETTERS}]", x)}
            marks = "".join(m for m in MARKS if m not in inside)
            self.cut = re.compile(r"(?<=[!-~\w])(?=[ \n])" + (f"|(?<=[{LETTERS}])(?=[{marks}])" if marks else ""))
        self.a_ids = TwoGenerations(self._a_ids, CACHED // 2)
        self.b_words = TwoGenerations(self.b_ids, CACHED // 2)
        self.library = SentencePieceProcessor(model_file=b_path) if self.b.splits_words and self.b.bytes_at else None

    def _a_ids(self, stretch: str) -> bytes:
        return array("i", self.a.encode(stretch, add_special_tokens=False).ids).tobytes()

    @staticmethod
    def _in_batches(stretches: list[str], kept: TwoGenerations, new: list[str], encode: Callable) -> list[bytes]:
        made = {}
        for at in range(0, len(new), ENCODED):
            part = new[at:at + ENCODED]
            made.update(zip(part, (array("i", ids).tobytes() for ids in encode(part))))
        out = [made[s] if s in made else kept[s] for s in stretches]
        for s, ids in made.items():
            kept.keep(s, ids)
        return out

    def all_a_ids(self, stretches: list[str]) -> list[bytes]:
        """The ids of A; those not kept are made in batches."""
        kept, old = self.a_ids, self.a_ids.old
        new = [s for s in stretches if s not in kept and s not in old]
        return self._in_batches(stretches, kept, new, lambda part: [e.ids for e in self.a.encode_batch_fast(part, add_special_tokens=False)])

    def all_b_ids(self, stretches: list[str]) -> list[bytes]:
        """The ids of B; new words of letters after one space are what the library itself puts a space before."""
        kept, old = self.b_words, self.b_words.old
        new = [s for s in stretches if s[0] == " " and s not in kept and s not in old and s[1:].isalpha()] if self.library else []
        return self._in_batches(stretches, kept, new, lambda part: self.library.encode([s[1:] for s in part], num_threads=1))

    def b_ids(self, stretch: str) -> bytes:
        if stretch[0] == " " and stretch.count(" ") == 1 and len(stretch) > 1 and SPACE not in stretch:
            return self.b.words[stretch[1:]]
        return self.b.joined(stretch.replace(" ", SPACE))

    def stretches(self, text: bytes | None) -> list[str]:
        if not text:
            return []
        whole = " " + text.decode("utf-8", "surrogateescape")
        return self.cut.split(whole) if self.cut else [whole]


def tokenizers(a_path: str, b_path: str) -> Tokenizers:
    """One pair a worker."""
    if (a_path, b_path) not in _LOADED:
        _LOADED[a_path, b_path] = Tokenizers(a_path, b_path)
    return _LOADED[a_path, b_path]


def covers(raw_of: list[bytes], ids: bytes, raw: bytes) -> bool:
    """Whether the tokens' bytes are those of a stretch."""
    return b"".join(map(raw_of.__getitem__, np.frombuffer(ids, np.int32).tolist())) == raw


def _sums(size: np.ndarray, ids: list[bytes]) -> np.ndarray:
    """The bytes of each stretch's tokens."""
    upto = np.cumsum(np.concatenate([[0], size[np.frombuffer(b"".join(ids), np.int32)]]))
    return np.diff(upto[np.cumsum([0, *map(len, ids)]) // 4])


class Aligned:
    """Stretches aligned all at once: numbers of each, its groups as text, and its links one after another."""

    def __init__(self, t: Tokenizers, stretches: list[str]) -> None:
        raw = [s.encode("utf-8", "surrogateescape") for s in stretches]
        whole = [s if s.isascii() else r.decode("utf-8", "replace") for s, r in zip(stretches, raw)]
        a, b = t.all_a_ids(whole), t.all_b_ids(whole)
        size = np.array([len(r) for r in raw], np.int64)
        self.ok = np.array([covers(t.a_raw, x, r) and covers(t.b.raw, y, r) for x, y, r in zip(a, b, raw)], bool) if (
            not covers(t.a_raw, b"".join(a), b"".join(raw)) or not covers(t.b.raw, b"".join(b), b"".join(raw))
            or (_sums(t.a_size, a) != size).any() or (_sums(t.b_size, b) != size).any()) else np.ones(len(raw), bool)
        if not self.ok.all():
            a, b = ([x if ok else b"" for x, ok in zip(ids, self.ok)] for ids in (a, b))
        size = np.where(self.ok, size, 0)
        n_a, n_b = (np.array(list(map(len, ids)), np.int64) // 4 for ids in (a, b))
        a, b = (np.frombuffer(b"".join(ids), np.int32).astype(np.int64) for ids in (a, b))
        a_end, b_end = np.cumsum(t.a_size[a]), np.cumsum(t.b_size[b])
        ends = np.union1d(a_end, b_end)
        common = np.intersect1d(a_end, b_end, assume_unique=True)
        at_a, at_b = np.searchsorted(a_end, ends), np.searchsorted(b_end, ends)
        group = np.searchsorted(common, ends)
        a_last, b_last = np.searchsorted(a_end, common) + 1, np.searchsorted(b_end, common) + 1
        single = (np.diff(a_last, prepend=0) == 1) & (np.diff(b_last, prepend=0) == 1)
        self.a, self.b = a[at_a], b[at_b]
        self.regular = single[group] & (t.same[self.a] == self.b)
        last = np.cumsum(size)
        self.link_ends = np.searchsorted(ends, last, "right")
        group_ends = np.searchsorted(common, last, "right")
        self.totals = np.stack([n_a, n_b, np.diff(group_ends, prepend=0), np.diff(self.link_ends, prepend=0)], 1)
        shown_a, shown_b = list(map(str, a.tolist())), list(map(str, b.tolist()))
        cuts = zip([0, *a_last.tolist()], a_last.tolist(), [0, *b_last.tolist()], b_last.tolist())
        groups = [",".join(shown_a[i:j]) + "|" + ",".join(shown_b[k:m]) for i, j, k, m in cuts]
        self.groups = [";".join(groups[i:j]) for i, j in zip([0, *group_ends.tolist()], group_ends.tolist())]


class Block:
    """Documents as places of their stretches, and each distinct stretch's links."""

    def __init__(self, t: Tokenizers) -> None:
        self.t, self.place, self.docs, self.parts, self.words = t, {}, [], [], 0

    def add(self, ids: list, texts: list[bytes | None]) -> None:
        stretches = [self.t.stretches(text) for text in texts]
        new = [s for s in dict.fromkeys(s for own in stretches for s in own) if s not in self.place]
        for n, s in enumerate(new, len(self.place)):
            self.place[s] = n
        for at in range(0, len(new), ALIGNED):
            self.parts.append(Aligned(self.t, new[at:at + ALIGNED]))
        for doc_id, own in zip(ids, stretches):
            self.docs.append((doc_id, np.fromiter(map(self.place.__getitem__, own), np.int32, len(own))))
            self.words += len(own)

    def rows(self, block: int, same: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Rows of the documents, the block and its pairs; links of the identity map are added to `same`."""
        parts = self.parts
        ok = np.concatenate([np.ones(0, bool), *(p.ok for p in parts)])
        totals = np.concatenate([np.zeros((0, 4), np.int64), *(p.totals for p in parts)])
        groups = [g for p in parts for g in p.groups]
        a, b, regular = (np.concatenate([np.zeros(0, kind), *(getattr(p, name) for p in parts)])
                         for name, kind in (("a", np.int64), ("b", np.int64), ("regular", bool)))
        rows, size, times = [], 0, np.zeros(len(ok), np.int64)
        for doc_id, own in self.docs:
            if not ok[own].all():
                own = own[:0]
            np.add.at(times, own, 1)
            text = ";".join([groups[i] for i in own.tolist()])
            rows.append((doc_id, *totals[own].sum(0).tolist(), text, own.tobytes()))
            size += len(text) + own.nbytes
            if len(rows) == ROWS or size > BYTES:
                yield _batch(DOCUMENT, block, ("doc_id", *TOTALS, "groups", "body"), zip(*rows), len(rows))
                rows, size = [], 0
        if rows:
            yield _batch(DOCUMENT, block, ("doc_id", *TOTALS, "groups", "body"), zip(*rows), len(rows))
        links = np.cumsum(np.where(times > 0, totals[:, 3], 0))
        weight = np.repeat(times, totals[:, 3])
        used = weight > 0  # others are of documents without tokens only
        a, b, regular, weight = a[used], b[used], regular[used], weight[used]
        same += np.bincount(a[regular], weight[regular], len(same)).astype(np.int64)
        codes, at = np.unique(a[~regular] * B_IDS + b[~regular], return_inverse=True)
        n = np.bincount(at, weight[~regular], len(codes)).astype(np.int64)
        marks = np.empty(len(a), np.int32)  # an A id of the identity map below zero, else the place among the block's pairs
        marks[regular] = -1 - a[regular]
        marks[~regular] = at
        yield _batch(BLOCK, block, ("n", "body"), ([len(links)], [links.astype(np.int64).tobytes() + marks.tobytes()]), 1)
        for i in range(0, len(codes), 1 << 16):
            part = codes[i:i + (1 << 16)]
            yield _batch(PAIR, block, ("a", "b", "n"), (part // B_IDS, part % B_IDS, n[i:i + (1 << 16)]), len(part))


def _batch(kind: int, block: int | None, names: tuple[str, ...], columns, rows: int) -> pa.RecordBatch:
    given = dict(zip(names, columns)) | {"kind": np.full(rows, kind), "block": [block] * rows}
    return pa.RecordBatch.from_arrays(
        [pa.array(given[f.name], f.type) if f.name in given else pa.nulls(rows, f.type) for f in _ARROW], schema=_ARROW)


def aligned_blocks(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """docs(doc_id, text) -> rows of four kinds: documents, blocks, pairs of a block and the identity map's links of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizers(a_path, b_path)
        same, block = np.zeros(len(t.a_raw), np.int64), Block(t)
        number = TaskContext.get().partitionId() * BLOCKS_OF_A_TASK
        for batch in batches:
            block.add(*(c.to_pylist() for c in batch.columns))
            if len(block.place) >= STRETCHES or block.words >= WORDS:
                yield from block.rows(number, same)
                number, block = number + 1, Block(t)
        if block.docs:
            yield from block.rows(number, same)
        met = np.flatnonzero(same)
        if len(met):
            yield _batch(SAME, None, ("a", "b", "n"), (met, t.same[met], same[met]), len(met))

    bound_batches(docs.sparkSession, 4 << 20)
    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(run, SCHEMA)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """How often each A id and B id are linked: (a, b, n, best), best if no A id is linked more with that B id."""
    counts = blocks.filter(F.col("kind").isin(PAIR, SAME)).groupBy("a", "b").agg(F.sum("n").alias("n")).filter("n > 0")
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    return counts.join(F.broadcast(most), "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))  # a row a B id


def align(docs: DataFrame, a_path: str, b_path: str, keep: Column | None = None) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and `keep`, an expression of
    `groups` (the column itself if none is given)."""
    keep = F.col("groups") if keep is None else keep
    blocks = aligned_blocks(docs, a_path, b_path).withColumn("kept", F.when(F.col("kind") == DOCUMENT, keep)).drop("groups")
    blocks = through_table(blocks, "aligned")
    counts = through_table(pair_counts(blocks), "pair-counts")
    # a row an A id at most: bounded by the vocabulary
    same_rows = counts.join(
        blocks.filter(F.col("kind") == SAME).select("a", "b").distinct(), ["a", "b"]).select("a", "n", "best").toArrow()
    size = 1 + max(same_rows["a"].to_pylist(), default=0)
    same = np.zeros((size, 2), np.int64)
    same[same_rows["a"].to_numpy()] = np.stack([same_rows["n"].to_numpy(), same_rows["best"].to_numpy(zero_copy_only=False)], 1)
    values = blocks.filter(F.col("kind") == PAIR).select("block", "a", "b").join(counts, ["a", "b"]).select(F.col("block").alias("of_block"), "a", "b", "n", "best")
    kept = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in TOTALS), ("n_best", pa.int64()), ("count_sum", pa.int64()), ("kept", pa.string())])

    def scored(docs: pa.Table, values: pa.Table) -> pa.Table:
        order = np.lexsort((values["b"].to_numpy(), values["a"].to_numpy()))
        found = np.stack([values["n"].to_numpy(), values["best"].to_numpy(zero_copy_only=False)], 1).astype(np.int64)[order]
        kind = docs["kind"].to_numpy()
        head = docs.filter(pa.array(kind == BLOCK)).to_pylist()[0]
        ends = np.frombuffer(head["body"], np.int64, head["n"])
        marks = np.frombuffer(head["body"], np.int32, offset=8 * head["n"])
        each = np.zeros((len(marks) + 1, 2), np.int64)
        regular = marks < 0
        each[1:][regular] = same[-1 - marks[regular]]
        each[1:][~regular] = found[marks[~regular]]
        upto = np.cumsum(each, 0)[np.concatenate([[0], ends])]
        of_stretch = np.diff(upto, axis=0)
        rows = docs.filter(pa.array(kind == DOCUMENT))
        sums = np.array([of_stretch[np.frombuffer(x.as_buffer(), np.int32)].sum(0) for x in rows["body"]], np.int64).reshape(-1, 2)
        return pa.table([rows["doc_id"], *(rows[c] for c in TOTALS), pa.array(sums[:, 1]), pa.array(sums[:, 0]), rows["kept"]], schema=kept)

    whole = blocks.filter(F.col("kind").isin(DOCUMENT, BLOCK)).select("kind", "block", "doc_id", *TOTALS, "body", "n", F.col("kept").cast("string"))
    return whole.groupBy("block").cogroup(values.groupBy("of_block")).applyInArrow(
        scored, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, kept string")


def byte_level_path() -> str:
    from public_tokenizers import path

    return path("byte_bpe_50k.json")


@register("op13_alignment")
def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    return align(table(spark, sf_dir, "documents"), byte_level_path(), model_path(), digest).withColumnRenamed("kept", "groups_sha256")
