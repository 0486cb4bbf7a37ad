"""Small relational idioms shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matricula.session import cut_lineage, through_table


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int | None, rank: str = "rank") -> DataFrame:
    """First n rows per key, or all rows with their rank without n. The rank filter is
    pushed below the shuffle (WindowGroupLimit), so a hot key ships at most n rows per task."""
    window = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(rank, F.row_number().over(window))
    return ranked if n is None else ranked.filter(F.col(rank) <= n)


def left_out(df: DataFrame, keys: Sequence[str], n: int | None, name: str = "left_out") -> DataFrame:
    """Rows per key that a cut to n leaves out; 0 without n."""
    total = F.count(F.lit(1))
    return df.groupBy(*keys).agg((F.lit(0).cast("long") if n is None else F.greatest(total - n, F.lit(0))).alias(name))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return top_n(df, keys, order, 1, "_first").drop("_first")


def spread(df: DataFrame, parts: int | None = None) -> DataFrame:
    """Deal the rows of a compute-heavy scan out to `parts` tasks, by default the session's setting
    `spark.matricula.spread`; without either the scan's splits stay as they are.

    For small tables that sit in fewer splits than there are cores; large ones have splits enough."""
    parts = parts or int(df.sparkSession.conf.get("spark.matricula.spread", "0"))
    return df.repartition(parts) if parts else df


def pending(items: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    """Items not recorded as done; failed ones stay pending."""
    done = ledger.filter(F.col("status") == "done").select(key)
    return items.join(done, key, "left_anti")


def status_counts(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def global_position(df: DataFrame, order: Sequence[Column], name: str = "position") -> DataFrame:
    """1-based position in a total order without a single-task window.

    A range-partitioned sort numbers rows inside each partition; adding the
    sizes of the earlier partitions gives the position. The sorted rows are
    checkpointed first, so both reads see the same partitioning.
    """
    index_bits = 33  # layout of monotonically_increasing_id: partition above, row index below
    placed = cut_lineage(df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id()))
    placed = placed.withColumn("_pid", F.shiftright("_mid", index_bits)).withColumn(
        "_in", F.col("_mid").bitwiseAND(F.lit((1 << index_bits) - 1))
    )
    sizes = placed.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = sizes.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (
        placed.join(offsets, "_pid")
        .withColumn(name, F.col("_before") + F.col("_in") + 1)
        .drop("_mid", "_pid", "_in", "_before")
    )


def breadth_first(
    roots: DataFrame,
    edges: DataFrame | Callable[[DataFrame], DataFrame],
    cap: int | None = None,
    admit: Callable[[DataFrame], DataFrame] = lambda reached: reached,
) -> DataFrame:
    """Queue-ordered walk from many roots at once, at most `cap` visits per school.

    roots(school_id, node, ord, counted); edges(src, pos, node, counted), or a function
    that gives the edges leaving the nodes of a frontier(src, ...). A node that does not count (it is not there to be visited) takes no share of the
    cap and leads nowhere. One round is one level of the walk: the nodes newly
    reached are ranked in queue order, cut to what is left of the cap, and joined
    to their edges; nodes already queued are dropped. A round writes its own level
    alone, so that joins know how small it is, and the levels are put together at the end. Without `cap` the
    walk ends where no new node is reached.

    Returns school_id, node, visit (null when not visited), remaining (still in
    the queue at the end).
    """
    key = ["school_id", "node"]

    def visited(reached: DataFrame, level: int, before: list[DataFrame]) -> DataFrame:
        """The level's nodes with their visit numbers, which follow those of the levels before."""
        turn = F.row_number().over(Window.partitionBy("school_id", "counted").orderBy("at", "node"))
        if before:
            used = reduce(DataFrame.unionByName, before).groupBy("school_id").agg(F.count("visit").alias("used"))
            reached = reached.join(used, "school_id", "left")
            turn = turn + F.coalesce("used", F.lit(0))
        fits = F.col("counted") if cap is None else F.col("counted") & (turn <= cap)
        return through_table(reached.select(
            *key, F.lit(level).alias("level"), "at", F.when(fits, turn.cast("bigint")).alias("visit")), "level")

    at = F.struct(F.lit(0).cast("bigint").alias("p"), F.col("ord").cast("int").alias("q"))
    start = roots.groupBy(*key).agg(F.min(at).alias("at"), F.bool_or("counted").alias("counted"))
    levels = [visited(start, 0, [])]
    while not (now := levels[-1].filter(F.col("visit").isNotNull())).isEmpty():
        front = now.select("school_id", F.col("node").alias("src"), F.col("visit").alias("turn"))
        reached = admit(front.join(edges(front) if callable(edges) else edges, "src"))
        fresh = (
            reached.groupBy(*key)
            .agg(F.min(F.struct(F.col("turn").alias("p"), F.col("pos").cast("int").alias("q"))).alias("at"),
                 F.bool_or("counted").alias("counted"))
            .join(reduce(DataFrame.unionByName, levels).select(*key), key, "left_anti")
        )
        levels.append(visited(fresh, len(levels), levels))
    state = reduce(DataFrame.unionByName, levels)
    place = F.struct("level", "at", "node")
    last = state.filter(F.col("visit").isNotNull()).groupBy("school_id").agg(F.max(place).alias("last"))
    return state.join(last, "school_id", "left").select(
        "school_id", "node", "visit",
        F.coalesce(F.col("visit").isNull() & (place > F.col("last")), F.lit(True)).alias("remaining"),
    )
