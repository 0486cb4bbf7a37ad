"""Exact top-k inner products by no-random-access aggregation over sorted lists.

Candidates are dealt into shards of bounded size, queries into blocks, and every block meets every
shard once (a stated query set against all rows, in blocks). In a shard each dimension is a list
sorted by value. For a query all lists are read from the end that contributes most, a stretch of all
lists at a time; every row has a lower bound (what was read, plus the least of the lists it was not
read in) and an upper bound (what was read, plus the value reached in those lists). Reading stops
when all rows outside a small set have upper bounds under the k-th lower bound: they cannot qualify.
The scores of that set are then resolved exactly. The k best of each shard are merged per query.

Every block first meets one shard alone: the k-th score found there is a floor that all shards may use,
for no row below it can be among the k best of all.

Defined results: vectors that are null, hold a null, NaN or infinite component, or have a null id take
no part. Repeated rows count once; a row is its id, so rows of a query's own id are not its candidates.
Vectors are compared with those of the same length only. Components and scores must stay under 2 ** 53,
within which double arithmetic on integers is exact. Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from matricula.llm.base import bound_batches, register, table, through_table

SHARD_ROWS, BLOCK_QUERIES = 2048, 256
DEPTHS = (1 / 4, 1 / 2, 5 / 8, 3 / 4, 1)  # of the lists read when the bounds are compared
K, EVERY, SCALE = 5, 50, 256


def integer_vectors(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """rows(vec_id, embedding) -> distinct (vec_id, v), v = floor(scale * component)."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return (
        rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(whole)
        .select("vec_id", F.transform(x, lambda c: F.floor(c * scale).cast("double")).alias("v")).distinct()
    )


def packed(vectors: DataFrame, parts: int, most: int) -> DataFrame:
    """(dim, part, ids, rows): rows of one part and dimension, at most `most` together, as arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, rows = None, [], []

        def flush() -> Iterator[pa.RecordBatch]:
            if ids:
                yield pa.RecordBatch.from_pylist(
                    [{"dim": key[0], "part": key[1], "ids": np.array(ids, "<i8").tobytes(), "rows": np.array(rows, "<f8").tobytes()}],
                    schema=pa.schema([("dim", pa.int32()), ("part", pa.int32()), ("ids", pa.binary()), ("rows", pa.binary())]))

        for batch in batches:
            for dim, part, vec_id, v in zip(*(c.to_pylist() for c in batch.columns)):
                if (dim, part) != key or len(ids) == most:
                    yield from flush()
                    key, ids, rows = (dim, part), [], []
                ids.append(vec_id)
                rows.append(v)
        yield from flush()

    dealt = vectors.select(F.size("v").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int").alias("part"), "vec_id", "v")
    return dealt.repartition(parts, "part").sortWithinPartitions("dim", "part", "vec_id").mapInArrow(
        run, "dim int, part int, ids binary, rows binary")


class SortedLists:
    """One sorted list per dimension over the rows of a shard."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray) -> None:
        self.ids, self.rows = ids, rows
        self.order = np.ascontiguousarray(np.argsort(rows, axis=0, kind="stable").T)  # by ascending value
        self.values = np.take_along_axis(rows.T, self.order, axis=1)

    def top(self, query: np.ndarray, own: int, k: int, floor: float = -np.inf) -> tuple[np.ndarray, np.ndarray, int]:
        """(ids, scores) of the k best rows that reach the floor, and the depth to which the lists were read."""
        n, lists = len(self.ids), np.flatnonzero(query)
        sides = [(lists[query[lists] > 0], True), (lists[query[lists] < 0], False)]  # read from the top, from the bottom
        weight = np.concatenate([query[j] for j, _ in sides])
        worst = np.concatenate([self.values[j, 0 if top else -1] for j, top in sides]) * weight if n else weight
        read, seen, at = np.zeros(n), np.zeros((len(lists), n)), 0
        others = self.ids != own
        alive = np.flatnonzero(others)
        for depth in DEPTHS if len(lists) else ():
            end = min(n, max(at + 1, int(np.ceil(depth * n))))
            spans = [slice(n - end, n - at) if top else slice(at, end) for _, top in sides]
            rows = np.concatenate([self.order[j, s] for (j, _), s in zip(sides, spans)])
            gain = np.concatenate([self.values[j, s] for (j, _), s in zip(sides, spans)]) * weight[:, None]
            read += np.bincount(rows.ravel(), gain.ravel(), n)
            at = end
            if at == n:  # every score is known
                alive = np.flatnonzero(others & (read >= floor))
                break
            seen[np.arange(len(lists))[:, None], rows] = 1
            ups = len(sides[0][0])
            frontier = np.concatenate([gain[:ups, 0], gain[ups:, -1]])
            lower = np.where(others, read + worst.sum() - worst @ seen, -np.inf)
            upper = read + frontier.sum() - frontier @ seen
            bar = max(floor, np.partition(lower, n - k)[n - k] if n > k else -np.inf)
            alive = np.flatnonzero(others & (upper >= bar))
            if len(alive) <= max(2 * k, n // 2):
                break
        scores = self.rows[alive] @ query
        best = np.lexsort((self.ids[alive], -scores))[:k]
        best = best[scores[best] >= floor]
        return self.ids[alive][best], scores[best], at


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, SortedLists | None, np.ndarray, np.ndarray]]:
    """(cell, lists of its shard, query ids, query vectors); the lists of a shard are sorted once for cells in a row."""
    held, lists = None, None
    for batch in batches:
        for cell in batch.to_pylist():
            if cell["ids"] is not None and (cell["ids"], cell["rows"]) != held:
                held, ids = (cell["ids"], cell["rows"]), np.frombuffer(cell["ids"], "<i8")
                lists = SortedLists(ids, np.frombuffer(cell["rows"], "<f8").reshape(len(ids), cell["dim"]))
            queries = np.frombuffer(cell["query_ids"], "<i8")
            vectors = np.frombuffer(cell["query_rows"], "<f8").reshape(len(queries), cell["dim"])
            yield cell, lists if cell["ids"] is not None else None, queries, vectors


def _floors(k: int):
    """Blocks with the k-th score of each query in the shard that the block meets first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, lists, queries, vectors in _cells(batches):
            tops = [lists.top(v, q, k)[1] if lists else [] for q, v in zip(queries, vectors)]
            floors = np.array([t[-1] if len(t) == k else -np.inf for t in tops], "<f8")
            yield pa.RecordBatch.from_pylist([{"dim": cell["dim"], "query_ids": cell["query_ids"], "query_rows": cell["query_rows"], "floors": floors.tobytes()}],
                                             schema=pa.schema([("dim", pa.int32()), ("query_ids", pa.binary()), ("query_rows", pa.binary()), ("floors", pa.binary())]))
    return run


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c, pa.int64()) for c in ("query_id", "query", "vec_id", "score")])
        for cell, lists, queries, vectors in _cells(batches):
            floors = np.frombuffer(cell["floors"], "<f8")
            found = [(q, xxh64_intdigest(v.tobytes()) >> 1, *lists.top(v, q, k, f)[:2]) for q, v, f in zip(queries, vectors, floors)]
            counts = [len(f[2]) for f in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat([f[0] for f in found], counts), pa.int64()),
                 pa.array(np.repeat(np.array([f[1] for f in found], np.int64), counts), pa.int64()),
                 pa.array(np.concatenate([f[2] for f in found]), pa.int64()),
                 pa.array(np.concatenate([f[3] for f in found]).astype("int64"), pa.int64())], schema=schema)
    return run


def top_k(candidates: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """candidates, queries (vec_id, v) -> query_id, rank, vec_id, score."""
    spark = candidates.sparkSession
    bound_batches(spark)
    shards = max(1, -(-candidates.count() // SHARD_ROWS))
    blocks = max(1, -(-queries.count() // BLOCK_QUERIES))
    stored = packed(candidates, shards, SHARD_ROWS)
    asked = packed(queries, blocks, BLOCK_QUERIES).select(
        "dim", (F.col("part") % shards).alias("part"), F.col("ids").alias("query_ids"), F.col("rows").alias("query_rows"))
    # numbered repartitions stay as they are: small in bytes, the cells are large in work
    first = asked.repartition(min(blocks, shards), "dim", "part").join(
        stored.dropDuplicates(["dim", "part"]).repartition(min(blocks, shards), "dim", "part"), ["dim", "part"], "left")
    asked = through_table(first.mapInArrow(_floors(k), "dim int, query_ids binary, query_rows binary, floors binary"), "floors")
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    cells = stored.repartition(shards, "dim", "part").join(asked.repartition(shards, "dim", "part"), ["dim", "part"])
    found = cells.mapInArrow(_search(k), "query_id long, query long, vec_id long, score long")
    best = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


ORACLE = f"""
with v as (
  select distinct vec_id, [floor({SCALE} * x::double) for x in embedding] as v
  from embeddings
  where vec_id is not null and embedding is not null
    and len([x for x in embedding if x is null or isnan(x) or isinf(x)]) = 0),
scored as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.v) = len(c.v)
  where q.vec_id % {EVERY} = 0)
select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score
from scored qualify rank <= {K}
"""


def _is_query(vec_id: Column) -> Column:
    return vec_id % EVERY == 0


@register("op2_topk", ORACLE)
def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = through_table(integer_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")), "vectors")
    return top_k(vectors, vectors.filter(_is_query(F.col("vec_id"))))
