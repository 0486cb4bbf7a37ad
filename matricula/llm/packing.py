"""Packing examples into training sequences: vector bin packing by the dot-product heuristic.

A sequence has simultaneous limits on tokens, segments (pieces) and loss-bearing tokens. Every
partition packs its own rows: full pieces are cut from long documents, the rest wait in a bounded
pool, and the next piece of an open sequence is the waiting one whose demand vector has the largest
dot product with what is left of the limits. When none fits, the best one is cut to fit. A sequence
that ends early (segment or loss limit, or nothing left) is trimmed to the largest power of two, for
such lengths need no padding; what is trimmed waits again. So padding is never needed. No row is
shuffled; the pool holds at most `POOL` pieces, each with its own ids only.

Defined results: a null or empty text is its end token alone. Repeated rows and null ids are packed
row by row. An empty table gives no pieces. Loss-bearing tokens are all by default, or those from
position `loss_from` (a column) on; null means all.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matricula.llm.base import bound_batches, give_back, register, table
from matricula.llm.tokens import word_ids

TOKENS, SEGMENTS, LOSS, END_ID = 2048, 256, 2048, 1
POOL = 1024
SEQUENCES_OF_A_TASK = 1 << 38

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, loss_tokens long, "
          "sequence_id long, offset long")


class Piece:
    """A stretch of a document's ids; `ids` are its own only, as bytes or a view of them."""

    __slots__ = ("doc_id", "ids", "start", "length", "loss_from", "doc_tokens")

    def __init__(self, doc_id, ids: bytes | memoryview, start: int, loss_from: int, doc_tokens: int) -> None:
        self.doc_id, self.ids, self.start, self.length = doc_id, ids, start, len(ids) // 4
        self.loss_from, self.doc_tokens = loss_from, doc_tokens

    def loss(self, length: int | None = None) -> int:
        end = self.start + (self.length if length is None else length)
        return max(0, end - max(self.start, self.loss_from))

    def fitting(self, tokens: int, loss: int) -> int:
        """The longest head within both limits."""
        free = max(0, self.loss_from - self.start)  # tokens before the loss begins
        return min(self.length, tokens, free + loss)

    def cut(self, length: int) -> tuple[Piece, Piece]:
        ids = memoryview(self.ids)
        return (Piece(self.doc_id, ids[:4 * length], self.start, self.loss_from, self.doc_tokens),
                Piece(self.doc_id, ids[4 * length:], self.start + length, self.loss_from, self.doc_tokens))


class Pool:
    """Waiting pieces and their demand vectors."""

    def __init__(self, limits: tuple[int, int, int]) -> None:
        self.limits = np.array(limits, float)
        self.pieces: list[Piece] = []
        self.demand = np.zeros((2 * POOL, 3))

    def add(self, piece: Piece) -> None:
        piece.ids = bytes(piece.ids)  # a view would keep the whole document while the piece waits
        n = len(self.pieces)
        if n == len(self.demand):
            self.demand = np.vstack([self.demand, np.zeros_like(self.demand)])
        self.demand[n] = piece.length, 1, piece.loss()
        self.pieces.append(piece)

    def take(self, left: np.ndarray) -> Piece | None:
        """The fitting piece of the largest dot product, else the best one, for cutting."""
        n = len(self.pieces)
        if not n:
            return None
        demand = self.demand[:n]
        score = demand @ (left / self.limits ** 2)
        fits = (demand <= left).all(axis=1)
        best = int(np.where(fits, score, -1.0).argmax()) if fits.any() else int(score.argmax())
        piece, last = self.pieces[best], self.pieces.pop()
        if last is not piece:
            self.pieces[best] = last
            demand[best] = demand[n - 1]
        return piece


def packed(pieces: Iterator[Piece], limits: tuple[int, int, int]) -> Iterator[list[Piece]]:
    """Sequences, each a list of pieces whose total length is `limits[0]` or a power of two."""
    tokens, segments, loss = limits
    pool = Pool(limits)

    def close(bin_: list[Piece], length: int) -> list[Piece]:
        excess = 0 if length == tokens else length - (1 << (length.bit_length() - 1))
        while excess:
            last = bin_.pop()
            if last.length > excess:
                head, last = last.cut(last.length - excess)
                bin_.append(head)
            pool.add(last)
            excess -= last.length
        return bin_

    def fill() -> list[Piece]:
        bin_, left = [], np.array(limits, float)
        while left[0] and left[1]:
            piece = pool.take(left)
            if piece is None:
                break
            fit = piece.fitting(int(left[0]), int(left[2]))
            if fit < piece.length:
                if not fit:
                    pool.add(piece)
                    break
                piece, rest = piece.cut(fit)
                pool.add(rest)
            bin_.append(piece)
            left -= (piece.length, 1, piece.loss())
        return close(bin_, tokens - int(left[0]))

    for piece in pieces:
        while (whole := piece.fitting(tokens, loss)) == tokens and piece.length:
            head, piece = piece.cut(whole)
            yield [head]
        if piece.length:
            pool.add(piece)
        while len(pool.pieces) >= POOL:
            yield fill()
    while pool.pieces:
        yield fill()


def pack(docs: DataFrame, tokenizer: str, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int = LOSS,
         end_id: int = END_ID, loss_from: Column | None = None) -> DataFrame:
    """docs(doc_id, text) -> one row per piece; see SCHEMA. Needs at least one token in every limit."""
    if min(tokens, segments, loss) < 1:
        raise ValueError("every limit must be at least 1")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = word_ids(tokenizer)
        give_back()

        def pieces() -> Iterator[Piece]:
            for batch in batches:
                for doc_id, text, begin in zip(*(c.to_pylist() for c in batch.columns)):
                    ids = ids_of(text or b"") + end
                    yield Piece(doc_id, ids, 0, begin or 0, len(ids) // 4)

        first = TaskContext.get().partitionId() * SEQUENCES_OF_A_TASK
        schema = pa.schema([(c.split()[0], pa.int64()) for c in SCHEMA.split(", ")])
        rows: list[tuple] = []
        for n, sequence in enumerate(packed(pieces(), (tokens, segments, loss))):
            offset = 0
            for p in sequence:
                rows.append((p.doc_id, p.start, p.length, zlib.crc32(p.ids), p.doc_tokens, p.loss(), first + n, offset))
                offset += p.length
            if len(rows) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=schema)
        give_back()

    bound_batches(docs.sparkSession, 2 << 20)
    begin = F.lit(0) if loss_from is None else loss_from
    return docs.select("doc_id", F.col("text").cast("binary"), begin.cast("long")).mapInArrow(run, SCHEMA)


def tokenizer_path() -> str:
    from public_tokenizers import path

    return path("word_bpe_49k.json")


@register("op7_packing")
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())
