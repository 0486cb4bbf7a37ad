"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Sources share `share` times all words by weight; no target exceeds `repeats` times its source, and
the excess is shared anew. A source's documents are permuted by a keyed hash and dealt into blocks;
full passes over the source come first, and the last pass takes blocks in permuted order until the
target is reached, the document at the boundary with its first words only. A tree then splits the
exact block quotas of all sources among the output shards: each node draws, by a multivariate
hypergeometric law, which half gets how many blocks of each source. A shard draws its quota from
the source's permuted blocks, disjoint from all other shards, and orders its documents by a hash.

Nothing depends on partitioning: reruns agree. Hot sources are spread over their blocks.

Defined results: a null text counts 0 words; a null source is a source of its own, last in order;
a null id is permuted as empty text. Repeated rows are mixed one by one. A source without words has
target 0, and its documents are not drawn. The documents' own columns travel as one struct, so their
names never clash. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matricula.llm.base import register, table, through_table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE, REPEATS, SEED = 1.5, 2, 7
DOCS_PER_BLOCK, MAX_BLOCKS = 128, 1 << 16  # blocks of one source: never more than MAX_BLOCKS
WORDS_PER_SHARD = 4_000_000
#: One row per source passes the driver and the root of the tree.
MAX_SOURCES = 1_000_000
#: Up to so many sources (under 1 MB) their rows are broadcast; beyond, Spark joins by shuffle.
BROADCAST_SOURCES = 10_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sizes: Sequence[int], weights: Sequence[int], share: float, repeats: int) -> list[float]:
    """Targets by weight, capped at `repeats` times the size, the excess reshared until none is above."""
    total, free = share * sum(sizes), set(range(len(sizes)))
    while free:
        rest = total - sum(repeats * sizes[i] for i in range(len(sizes)) if i not in free)
        weight = sum(weights[i] for i in free)
        above = {i for i in free if repeats * sizes[i] < rest * weights[i] / weight}
        if not above:
            break
        free -= above
    return [rest * w / weight if i in free else float(repeats * sizes[i]) for i, w in enumerate(weights)]


def _split(keys: np.ndarray, quota: np.ndarray, node: int, depth: int, seed: int) -> Iterator[tuple]:
    """(node, source, blocks) of the nodes `depth` levels below `node`."""
    if not depth:
        yield from ((node, int(k), int(q)) for k, q in zip(keys, quota) if q)
        return
    draw = np.random.default_rng([seed, node])
    left = draw.multivariate_hypergeometric(quota, int(quota.sum()) // 2, method="marginals")
    yield from _split(keys, left, 2 * node, depth - 1, seed)
    yield from _split(keys, quota - left, 2 * node + 1, depth - 1, seed)


def _splitter(step: int, seed: int):
    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sid")
        rows = _split(pdf["sid"].to_numpy(), pdf["blocks"].to_numpy(), int(pdf["node"].iloc[0]), step, seed)
        return pd.DataFrame(rows, columns=["node", "sid", "blocks"]).astype("int64")

    return split


def splitting_tree(quotas: DataFrame, levels: int, seed: int = SEED, per_step: int = 5) -> DataFrame:
    """quotas(sid, blocks) -> (shard, sid, blocks), 2 ** levels shards of equal block counts (+-1)."""
    nodes = quotas.select(F.lit(1).cast("long").alias("node"), "sid", F.col("blocks").cast("long"))
    done = 0
    while done < levels:
        step = min(per_step, levels - done)

        nodes = nodes.groupBy("node").applyInPandas(_splitter(step, seed), "node long, sid long, blocks long")
        done += step
    return nodes.select((F.col("node") - (1 << levels)).alias("shard"), "sid", "blocks")


def _by_source(rows: DataFrame, sources: DataFrame, n: int) -> DataFrame:
    return rows.join(F.broadcast(sources) if n <= BROADCAST_SOURCES else sources, "sid")


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS,
        seed: int = SEED, words_per_shard: int = WORDS_PER_SHARD, size: Column | None = None) -> DataFrame:
    """One row per drawn copy of a document, and one with no shard for a document that is not drawn.

    `size` is the column that holds a document's words; they are counted from `text` without it.
    Columns: doc (struct of the document's columns), row (identity of the input row), size,
    source_size, target, pass, words (that this copy brings), shard, position (in the shard).
    """
    spark = docs.sparkSession
    counted = n_words(F.col("text")) if size is None else size
    sized = docs.select(F.struct(*docs.columns).alias("doc"), counted.alias("size"))
    totals = (
        sized.groupBy(F.col("doc.source").alias("source"))
        .agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("docs"))
        .limit(MAX_SOURCES + 1).collect()
    )
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    totals.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    sizes = [r["size"] for r in totals]
    given = [weights[i % len(weights)] for i in range(len(totals))]
    rows = []
    for sid, (r, target) in enumerate(zip(totals, water_fill(sizes, given, share, repeats))):
        words = int(np.floor(target + 0.5))
        full = words // r["size"] if r["size"] else 0
        rows.append((sid, r["source"], r["size"], target, full, words - full * r["size"],
                     min(MAX_BLOCKS, -(-r["docs"] // DOCS_PER_BLOCK))))
    sources = spark.createDataFrame(
        rows, "sid long, source string, source_size long, target double, full long, part long, blocks long")
    n = len(rows)

    named = F.broadcast(sources) if n <= BROADCAST_SOURCES else sources
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc.doc_id").cast("string"), F.lit(""))))
    placed = (
        sized.join(named, F.col("doc.source").eqNullSafe(F.col("source")))
        .withColumn("key", key)
        .withColumn("block", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.col("blocks") / (1 << 32)))
    )
    in_block = Window.partitionBy("sid", "block").orderBy("key", "doc.doc_id", "size")
    placed = placed.withColumns({
        "nth": F.row_number().over(in_block),
        "inside": F.coalesce(F.sum("size").over(in_block.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    })
    # words before each block: at most MAX_BLOCKS rows of a source
    blocks = _by_source(
        sized.select("size", F.col("doc.source").alias("_s"), key.alias("key")).join(named, F.col("_s").eqNullSafe(F.col("source")))
        .groupBy("sid", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.col("blocks") / (1 << 32)).alias("block"))
        .agg(F.sum("size").alias("words")),
        sources.select("sid", "full", "part"), n,
    )
    before = Window.partitionBy("sid").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
    drawn = blocks.filter((F.col("words") > 0) & ((F.col("full") > 0) | (F.col("before") < F.col("part")))).select(
        "sid", "block", "before", F.explode(F.expr("sequence(0L, full - if(before < part, 0, 1))")).alias("pass"))
    levels = max(0, int(np.ceil(np.log2(max(1, share * sum(sizes) / words_per_shard)))))
    quotas = drawn.groupBy("sid").agg(F.count(F.lit(1)).alias("blocks"))
    leaves = splitting_tree(quotas, levels, seed)
    upto = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    turns = (
        leaves.withColumn("lo", F.coalesce(F.sum("blocks").over(upto), F.lit(0)))
        .select("sid", "shard", F.explode(F.expr("sequence(lo + 1, lo + blocks)")).alias("turn"))
    )
    permuted = Window.partitionBy("sid").orderBy(F.md5(F.concat_ws(":", F.lit(seed), "pass", "block")), "pass", "block")
    dealt = (
        drawn.withColumn("turn", F.row_number().over(permuted).cast("long"))
        .join(turns, ["sid", "turn"])
        .groupBy("sid", "block")
        .agg(F.first("before").alias("before"), F.collect_list(F.struct("pass", "shard")).alias("copies"))  # at most `repeats`
    )
    copies = placed.join(dealt, ["sid", "block"], "left").select(
        "doc", F.struct("sid", "block", "nth").alias("row"), "size", "source_size", "target", "full", "part", "key",
        (F.col("before") + F.col("inside")).alias("at"), F.explode_outer("copies").alias("c"),
    )
    words = F.when(F.col("c.pass") < F.col("full"), F.col("size")).otherwise(
        F.greatest(F.lit(0), F.least("size", F.col("part") - F.col("at"))))
    copies = copies.select(
        "doc", "row", "size", "source_size", "target", "key", F.coalesce("c.pass", F.lit(0)).alias("pass"),
        F.when(F.col("c").isNull(), F.lit(0)).otherwise(words).cast("long").alias("words"), F.col("c.shard").alias("shard"))
    local = Window.partitionBy("shard", F.when(F.col("shard").isNull(), F.col("key"))).orderBy(
        F.md5(F.concat_ws(":", F.lit(seed), "shard", "pass", "key")), "row.nth")
    return copies.select(
        "doc", "row", "size", "source_size", "target", "pass", "words", "shard",
        F.when(F.col("shard").isNotNull(), F.row_number().over(local)).alias("position"))


def cut_to_words(text: Column, words: Column, size: Column) -> Column:
    """The text up to the end of its first `words` words; the whole text where that is all."""
    pieces = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")  # each piece ends with a word
    return F.when(words >= size, text).otherwise(F.array_join(F.slice(pieces, F.lit(1), words.cast("int")), ""))


ORACLE = r"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents),
totals as (
  select source, sum(size)::bigint as source_size,
         [5, 2, 1][((row_number() over (order by source nulls last)) - 1) % 3 + 1] as w
  from sized group by source),
steps as (
  select *, sum(2 * source_size) over o - 2 * source_size as caps, sum(w) over () - (sum(w) over o - w) as ws,
         1.5::double * sum(source_size) over () as total
  from totals window o as (order by 2 * source_size / w::double, source nulls last rows unbounded preceding)),
marked as (select *, 2 * source_size < (total - caps) * w / ws as capped from steps),
rest as (
  select any_value(total) - coalesce(sum(2 * source_size) filter (capped), 0) as words,
         sum(w) filter (not capped) as ws from marked),
targets as (
  select m.source, source_size, case when capped then (2 * source_size)::double else r.words::double * w / r.ws::double end as target
  from marked m, rest r),
parts as (
  select *, case when source_size > 0 then floor(target + 0.5)::bigint // source_size else 0 end as passes,
         case when source_size > 0 then floor(target + 0.5)::bigint % source_size else 0 end as part
  from targets),
placed as (
  select doc_id, size, source_size, target, passes, part,
         sum(size) over (partition by p.source order by md5('7:' || coalesce(doc_id::varchar, '')), doc_id, size
                         rows unbounded preceding) - size as prior
  from sized s join parts p on s.source is not distinct from p.source)
select doc_id, size, source_size, target, (passes * size + greatest(0, least(size, part - prior)))::bigint as taken
from placed
"""


@register("op9_mixing", ORACLE)
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("n_words"))
    docs = through_table(docs, "mixing-sizes")  # texts are read once
    return (
        mix(docs, size=F.col("n_words")).groupBy("row")
        .agg(F.first("doc.doc_id").alias("doc_id"), F.first("size").alias("size"),
             F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.sum("words").alias("taken"))
        .drop("row")
    )
