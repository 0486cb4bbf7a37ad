"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

Only DataFrame functions. A text's paragraphs are its lines cut after sentence ends and after
`PIECE` characters; their distinct digests are the sketched set. A sketch has buckets of `CELLS`
cells in three tables; a digest falls into one bucket and there into one cell of each table, and a cell
holds a signed count, the xor of its digests and the xor of their check hashes. Sketches of two versions
subtract cell by cell, common paragraphs cancel, and peeling single-digest cells recovers the
digests in which the versions differ. What falls into buckets that cannot be peeled is tried again with other
hashes and then with four times the buckets, until none is left. Since buckets have a fixed size, the work
is linear in the text.

Likeness is shared paragraphs over all paragraphs, from the set sizes and the recovered digests.
A text's fingerprint is the SHA-256 of its sketch of one bucket.

Defined results: a null text is empty; two texts without paragraphs have likeness 1. Null ids come last.
Documents of one id follow one another by text. A single document is followed by itself. Repeated rows
are kept. Extra columns are ignored.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matricula.llm.base import register, table, through_table

PIECE = 96
PARAGRAPH = rf"[^.!?\n]{{1,{PIECE}}}[.!?\n]*|[.!?\n]+"
SIDE = 21  # cells of each of the three tables of a bucket
CELLS = 3 * SIDE
LOAD = 36  # digests of both sides for one bucket at the first attempt
ROUNDS = 24  # of peeling
BLOCK_DOCS, SUPER = 512, 4096


def paragraph_digests(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0)), lambda p: F.xxhash64(p)))


def _buckets(items: Column) -> Column:
    """A power of two that leaves about LOAD digests to a bucket."""
    return F.pow(2, F.greatest(F.lit(0), F.ceil(F.log2(items / F.lit(float(LOAD)))))).cast("int")


def bucket_of(digest: Column, seed: Column, buckets: Column) -> Column:
    return F.pmod(F.xxhash64(digest, seed, F.lit("bucket")), buckets).cast("int")


def sketch_cells(units: DataFrame, keys: list[str], seed: Column) -> DataFrame:
    """units(keys, buckets, d, sign) -> the cells in use: keys, bucket, cell, n, k (xor of digests), c (xor of checks)."""
    h = F.xxhash64("d", seed)
    cells = F.array(*(F.lit(SIDE * t) + F.pmod(F.shiftright(h, 20 * t).bitwiseAND((1 << 20) - 1), F.lit(SIDE)).cast("int") for t in range(3)))
    return (
        units.select(*keys, bucket_of(F.col("d"), seed, F.col("buckets")).alias("bucket"),
                     "d", "sign", F.explode(cells).alias("cell"))
        .groupBy(*keys, "bucket", "cell")
        .agg(F.sum("sign").cast("int").alias("n"), F.bit_xor("d").alias("k"), F.bit_xor(F.xxhash64("d", F.lit("check"))).alias("c"))
    )


def peeled(cells: Column, seed: str) -> Column:
    """Struct(cells, got): what peeling leaves of a bucket's cells, and the digests it recovers.

    `transform(array(x), y -> ...)[0]` binds y once; a plain reference would be evaluated for each cell."""
    place = " + ".join  # readable pieces of one expression
    spots = ", ".join(
        f"cast({place([str(SIDE * t), f'pmod(shiftright(xxhash64(x.k, {seed}), {20 * t}) & {(1 << 20) - 1}, {SIDE})'])} as int)" for t in range(3))
    pure = (
        "array_distinct(transform(filter(s.cells, x -> abs(x.n) = 1 and x.c = xxhash64(x.k, 'check')), "
        f"x -> struct(x.k as k, x.n as n, x.c as c, array({spots}) as at)))"
    )
    left = (
        "filter(transform(s.cells, x -> aggregate(p, x, (y, d) -> if(array_contains(d.at, x.cell), "
        "named_struct('cell', y.cell, 'n', y.n - d.n, 'k', y.k ^ d.k, 'c', y.c ^ d.c), y))), x -> x.n <> 0 or x.k <> 0 or x.c <> 0)"
    )
    step = (
        f"transform(array({pure}), p -> if(size(p) = 0, s, named_struct('cells', {left}, "
        "'got', concat(s.got, transform(p, d -> d.k)))))[0]"
    )
    start = "named_struct('cells', {c}, 'got', cast(array() as array<bigint>))"
    return F.expr(f"aggregate(sequence(1, {ROUNDS}), {start.format(c=cells)}, (s, i) -> {step})")


def compared(cells: DataFrame, keys: list[str], seed: str) -> DataFrame:
    """Cells of differences -> keys, whole (all buckets peeled), differ (recovered digests)."""
    buckets = (
        cells.filter("n <> 0 or k <> 0 or c <> 0").groupBy(*keys, "bucket")
        .agg(F.collect_list(F.struct("cell", "n", "k", "c")).alias("cells"))  # at most CELLS
        .withColumn("p", peeled("cells", seed))
    )
    return buckets.groupBy(*keys).agg(
        F.min(F.size("p.cells") == 0).alias("whole"), F.sum(F.size("p.got")).alias("differ"))


def likeness(a: Column, b: Column, differ: Column) -> Column:
    return F.when(a + b == 0, F.lit(1.0)).otherwise((a + b - differ) / (a + b + differ)).cast("double")


def retried(failed: DataFrame, keys: list[str]) -> DataFrame:
    """failed(keys, a, b, buckets): pairs of digest arrays -> keys, differ, with other hashes, then with ever larger sketches."""
    found, attempt = None, 1
    todo = through_table(failed, "sketch-retry")
    while not todo.isEmpty():
        seed = F.lit(attempt)
        more = F.col("buckets") * (1 if attempt == 1 else 4)
        spread = todo.repartition(*keys).select(*keys, more.alias("buckets"), F.explode(F.concat(
            F.transform("a", lambda d: F.struct(d.alias("d"), F.lit(1).alias("sign"))),
            F.transform("b", lambda d: F.struct(d.alias("d"), F.lit(-1).alias("sign"))))).alias("u"))
        done = compared(sketch_cells(spread.select(*keys, "buckets", "u.d", "u.sign"), keys, seed), keys, str(attempt))
        tried = through_table(todo.join(done, keys, "left").select(
            *keys, "a", "b", more.alias("buckets"), F.coalesce("whole", F.lit(True)).alias("whole"),
            F.coalesce("differ", F.lit(0)).alias("differ")), "sketch-tried")
        now = tried.filter("whole").select(*keys, "differ")
        found = now if found is None else found.unionByName(now)
        todo, attempt = tried.filter("not whole").drop("whole", "differ"), attempt + 1
    return todo.select(*keys, F.lit(0).cast("long").alias("differ")).limit(0) if found is None else found


def neighbours(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> block, nth, guest, doc_id, text, following: the next text by descending id, the first after the last.

    Ids are dealt into blocks of their range, about BLOCK_DOCS documents each; a block also gets the first
    document of the next block in use as a guest row, so that the row after (block, nth) is (block, nth + 1)."""
    span = docs.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("doc_id").alias("n")).first()
    lo = span["lo"] or 0
    width = max(1, -(-((span["hi"] or 0) - lo + 1) * BLOCK_DOCS // max(1, span["n"])))
    if max(width, (span["hi"] or 0) - lo) < 1 << 62:
        place = (F.col("doc_id") - lo) / width
    else:  # ids so far apart that differences do not fit a long
        place = (F.col("doc_id").cast("decimal(20,0)") - F.lit(Decimal(lo))) / F.lit(Decimal(width))
    block = F.coalesce(F.floor(place), F.lit(-1)).cast("long")
    rows = docs.select(block.alias("block"), "doc_id", "text")
    tops = through_table(rows.groupBy("block").agg(F.max("doc_id").alias("top")), "tops")
    # the next lower block in use: within a group of blocks, or the highest block of the next group
    group = F.floor(F.col("block") / SUPER).alias("group")
    groups = tops.groupBy(group).agg(F.max("block").alias("highest"))
    over = Window.orderBy(F.desc("group"))  # one row for SUPER * BLOCK_DOCS documents
    first = groups.agg(F.max("highest").alias("first"))
    groups = groups.withColumn("below", F.lead("highest").over(over)).join(F.broadcast(first)).select(
        "group", F.coalesce("below", "first").alias("below"))
    next_block = F.coalesce(F.lead("block").over(Window.partitionBy("group").orderBy(F.desc("block"))), F.col("below"))
    heads = through_table(
        tops.withColumn("group", group).join(groups, "group").select(F.col("block").alias("goes_to"), next_block.alias("block"))
        .join(tops, "block").select("block", "top", "goes_to"), "heads")
    guests = (
        rows.join(heads.withColumnRenamed("block", "_b"), (F.col("block") == F.col("_b")) & F.col("doc_id").eqNullSafe(F.col("top")))
        .groupBy(F.col("goes_to").alias("block"), "doc_id").agg(F.min("text").alias("text"))
    )
    both = rows.withColumn("guest", F.lit(False)).unionByName(guests.withColumn("guest", F.lit(True)))
    order = Window.partitionBy("block").orderBy("guest", F.desc_nulls_last("doc_id"), "text")
    return both.withColumns({"nth": F.row_number().over(order), "following": F.lead("text").over(order)})


def edited(text: Column, following: Column, n_chars: Column) -> Column:
    cut = F.floor(n_chars / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n_chars.cast("int") - cut), F.substring(following, F.lit(1), cut))


OWN, NEXT, FINGERPRINT, EDITED = range(4)  # what a sketch is of: two differences, two texts


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    near = neighbours(texts).withColumn("n_chars", F.length("text").cast("long"))
    near = near.withColumn("edited", edited(F.col("text"), F.col("following"), F.col("n_chars")))
    # the texts are shuffled once and end here; what follows moves digests only
    base = through_table(near.select(
        "block", "nth", "guest", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        paragraph_digests(F.col("text")).alias("a"), F.when(~F.col("guest"), paragraph_digests(F.col("edited"))).alias("e")), "paragraphs")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    follow = Window.partitionBy("block").orderBy("nth")
    sets = base.repartition(parts, "block").withColumn("f", F.lead("a").over(follow)).filter("not guest")

    def units(array: str, kind: int, sign: int) -> Column:
        return F.transform(array, lambda d: F.struct(F.lit(kind).alias("kind"), d.alias("d"), F.lit(sign).alias("sign")))

    keys = ["block", "nth", "kind"]
    spread = sets.select("block", "nth", _buckets(F.size("a") + F.size("e")).alias("b0"), _buckets(F.size("a") + F.size("f")).alias("b1"),
                         F.explode(F.concat(units("a", OWN, 1), units("e", OWN, -1), units("a", NEXT, 1), units("f", NEXT, -1),
                                            units("a", FINGERPRINT, 1), units("e", EDITED, 1))).alias("u"))
    spread = spread.select("block", "nth", "u.kind", "u.d", "u.sign",
                           F.when(F.col("u.kind") == OWN, F.col("b0")).when(F.col("u.kind") == NEXT, F.col("b1")).otherwise(1).alias("buckets"))
    cells = sketch_cells(spread, keys, F.lit(0))
    grouped = (
        cells.filter("n <> 0 or k <> 0 or c <> 0").groupBy(*keys, "bucket")
        .agg(F.collect_list(F.struct("cell", "n", "k", "c")).alias("cells"))
    )
    shown = F.sha2(F.array_join(F.transform(F.array_sort("cells"), lambda x: F.concat_ws(":", x["cell"], x["n"], x["k"], x["c"])), ","), 256)
    peel = F.when(F.col("kind") < FINGERPRINT, peeled("cells", "0"))
    per = (
        grouped.withColumn("p", peel).groupBy("block", "nth").agg(
            *(F.coalesce(F.sum(F.when((F.col("kind") == k) & (F.size("p.cells") == 0), F.size("p.got"))), F.lit(0)).alias(f"differ{k}") for k in (OWN, NEXT)),
            *(F.collect_list(F.when((F.col("kind") == k) & (F.size("p.cells") > 0), F.col("bucket"))).alias(f"stuck{k}") for k in (OWN, NEXT)),
            *(F.max(F.when(F.col("kind") == k, shown)).alias(f"shown{k}") for k in (FINGERPRINT, EDITED)))
    )
    empty = F.sha2(F.lit(""), 256)
    first = (
        base.filter("not guest").select("block", "nth", "doc_id", "n_chars", "edited_sha256", F.size("a").alias("na"), F.size("e").alias("ne"))
        .join(base.select("block", (F.col("nth") - 1).alias("nth"), F.size("a").alias("nf")), ["block", "nth"])
        .join(per, ["block", "nth"], "left").select(
            "block", "nth", "doc_id", "n_chars", "edited_sha256", "na", "ne", "nf",
            F.coalesce(f"shown{FINGERPRINT}", empty).alias("fingerprint"), F.coalesce(f"shown{EDITED}", empty).alias("edited_fingerprint"),
            *(F.coalesce(f"differ{k}", F.lit(0)).alias(f"differ{k}") for k in (OWN, NEXT)),
            *(f"stuck{k}" for k in (OWN, NEXT))))
    first = through_table(first, "sketches")
    failed = []
    for k, other in ((OWN, base.select("block", "nth", F.col("e").alias("b"))),
                     (NEXT, base.select("block", (F.col("nth") - 1).alias("nth"), F.col("a").alias("b")))):
        buckets = _buckets(F.col("na") + F.col("ne" if k == OWN else "nf"))
        at = first.filter(F.size(f"stuck{k}") > 0).select("block", "nth", F.lit(k).alias("kind"), F.col(f"stuck{k}").alias("stuck"), buckets.alias("buckets"))
        pairs = at.join(base.select("block", "nth", "a"), ["block", "nth"]).join(other, ["block", "nth"])
        left = [F.filter(side, lambda d: F.array_contains("stuck", bucket_of(d, F.lit(0), F.col("buckets")))).alias(side) for side in "ab"]
        left = pairs.select("block", "nth", "kind", *left)
        failed.append(left.withColumn("buckets", _buckets(F.size("a") + F.size("b"))))
    again = retried(failed[0].unionByName(failed[1]), keys).groupBy("block", "nth").agg(
        *(F.max(F.when(F.col("kind") == k, F.col("differ"))).alias(f"again{k}") for k in (OWN, NEXT)))
    differ = [F.col(f"differ{k}") + F.coalesce(f"again{k}", F.lit(0)) for k in (OWN, NEXT)]
    return first.join(again, ["block", "nth"], "left").select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("na"), F.col("ne"), differ[0]).alias("near_edited"),
        likeness(F.col("na"), F.col("nf"), differ[1]).alias("near_next"))


@register("op5_sketches")
def op5_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))
