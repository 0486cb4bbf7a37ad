"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints differ in at most `radius` bits exactly if some value lies within half the radius of
both. So every distinct fingerprint emits all values within half the radius (65 for radius 2), the
values are shuffled, and fingerprints that meet at a value are linked. All that meet are within the
radius of one another, so linking each to the least of them keeps every connection without emitting
all pairs; a value is met by at most as many distinct fingerprints as it has variants. Links are
deduplicated and verified bit by bit.

Documents of one fingerprint are folded first, so groups of copies of any size cost one fingerprint.

Defined results: null and empty texts, and texts of white space, have fingerprint 0 and are linked
like any other. Ids may repeat or be null; a component's id is its least id that is not null, else
null. Other columns are kept under their names, apart from `fingerprint` and `component_id`.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from matricula.llm.base import register, table, through_table
from matricula.llm.components import components

WORDS, RADIUS, HASH_SEED = 3, 2, 42
CHUNK = 1 << 15  # shingles whose bits are unpacked at once


def simhash(text: bytes | None, words: int = WORDS) -> int:
    """64-bit fingerprint of a text in UTF-8: a bit is set if it is set in over half the shingle hashes."""
    tokens = (text or b"").lower().split()  # bytes: only A-Z are lower-cased, only ASCII space splits
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    shingles = max(1, len(tokens) - words + 1)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:shingles].tolist()
    ends = ends[-shingles:].tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, shingles, CHUNK):
        spans = zip(starts[at:at + CHUNK], ends[at:at + CHUNK])
        hashes = np.array([xxh64_intdigest(joined[a:b], HASH_SEED) for a, b in spans], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > shingles, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, text: str = "text", words: int = WORDS) -> DataFrame:
    @F.pandas_udf("long")
    def fingerprint(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(t, words) for t in texts], dtype="uint64").astype("int64")

    return docs.withColumn("fingerprint", fingerprint(F.col(text).cast("binary")))


def variants(fingerprint: Column, half: int) -> Column:
    """All 64-bit values within `half` bits."""
    masks = [sum(1 << b for b in bits) for n in range(half + 1) for bits in combinations(range(64), n)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return F.transform(F.array(*map(F.lit, signed)), lambda m: m.bitwiseXOR(fingerprint))


def links(fingerprints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fingerprints(fingerprint), distinct -> edges (a, b) that connect all pairs within the radius."""
    if radius % 2:
        raise ValueError("the radius must be even: both sides emit half of it")
    emitted = fingerprints.select(
        "fingerprint", F.explode(variants(F.col("fingerprint"), radius // 2)).alias("variant"))
    # at a value meet at most as many fingerprints as it has variants
    met = Window.partitionBy("variant")
    edges = emitted.select(F.min("fingerprint").over(met).alias("a"), F.col("fingerprint").alias("b")).filter("a < b").distinct()
    return edges.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def with_components(prints: DataFrame, parts: DataFrame) -> DataFrame:
    """Add component_id to rows with doc_id and fingerprint; parts(node, root) are the linked fingerprints."""
    distinct = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least_id"))
    member = distinct.join(parts, F.col("fingerprint") == F.col("node"), "left").select(
        "fingerprint", "least_id", F.coalesce("root", "fingerprint").alias("root"))
    ids = member.groupBy("root").agg(F.min("least_id").alias("component_id"))
    member = member.join(ids, "root").select("fingerprint", "component_id")
    return prints.drop("component_id").join(member, "fingerprint").select(*prints.drop("component_id").columns, "component_id")


def near_duplicates(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Add component_id to rows with doc_id and fingerprint. `prints` is read several times: pass a table."""
    edges = through_table(links(prints.select("fingerprint").distinct(), radius), "edges")
    return with_components(prints, components(edges))


def first_of_each(judged: DataFrame) -> DataFrame:
    """judged(doc_id, fingerprint, row, component_id) -> the row with each component's id (of repeated ids, one)."""
    first = judged.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fingerprint"))).agg(
        F.min(F.struct(F.coalesce(F.col("doc_id") != F.col("component_id"), F.lit(False)), "row")).alias("first"))
    return first.select(F.col("first.row").alias("row"))


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of each component: that with the component's id (of repeated ids, one row)."""
    own = docs.columns
    rows = through_table(
        with_fingerprints(docs.select(F.struct(*own).alias("doc"), "doc_id", "text")).select(
            "doc", "doc_id", "fingerprint", F.monotonically_increasing_id().alias("row")), "fingerprints")
    judged = near_duplicates(rows.select("doc_id", "fingerprint", "row"), radius)
    return rows.join(first_of_each(judged), "row", "left_semi").select("doc.*")


@register("op1_simhash_dups")
def op1_simhash_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = through_table(
        with_fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "fingerprint"),
        "fingerprints")
    return near_duplicates(prints).select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
