"""Folding researched sections, batch by batch, into the details table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matricula import fixed_values as V
from matricula.functions import nested, text


def clean_batches(batches: DataFrame) -> DataFrame:
    """One row per (batch, school) with usable sections and sources.

    Input: batch, school_id, faculty, research, src array<string>, retrieved, seq.
    A section that says nothing becomes null; `usable` needs a section and at
    least one http source. A school repeated inside a batch keeps its last row.
    """
    sections = {
        s: F.when(~text.is_empty_text(F.col(s)), F.col(s)) for s in V.MERGEABLE_SECTIONS
    }
    payload = F.struct(
        *[c.alias(s) for s, c in sections.items()],
        F.filter("src", lambda s: s.startswith("http")).alias("src"),
        F.col("retrieved"),
    )
    last = batches.groupBy("batch", "school_id").agg(F.max_by(payload, "seq").alias("p"))
    return last.select("batch", "school_id", "p.*").withColumn(
        "usable",
        F.coalesce(*V.MERGEABLE_SECTIONS).isNotNull() & (F.coalesce(F.size("src"), F.lit(0)) > 0),
    )


def clean_entries(batches: DataFrame) -> DataFrame:
    return clean_batches(batches).filter("usable").drop("usable")


def _winners(cleaned: DataFrame) -> DataFrame:
    """Per school, the first batch offering each section: at most two small structs."""
    offers = {
        s: F.min_by(
            F.struct("batch", F.col(s).alias("value"), "src", "retrieved"),
            F.when(F.col(s).isNotNull(), F.col("batch")),
        ).alias(f"w_{s}")
        for s in V.MERGEABLE_SECTIONS
    }
    return (
        cleaned.filter("usable")
        .groupBy("school_id")
        .agg(*offers.values(), F.min_by(F.struct("batch", "src", "retrieved"), "batch").alias("w_new"))
    )


def _folded(details: DataFrame, cleaned: DataFrame) -> DataFrame:
    """details full-outer winners, with the batch that filled each open section."""
    prior = details.select(
        "school_id",
        F.lit(True).alias("_known"),
        *[F.col(s).alias(f"old_{s}") for s in V.MERGEABLE_SECTIONS],
        F.col("src").alias("old_src"),
        F.col("retrieved").alias("old_retrieved"),
    )
    joined = prior.join(_winners(cleaned), "school_id", "full_outer")
    for s in V.MERGEABLE_SECTIONS:
        is_open = text.is_empty_text(F.col(f"old_{s}"))
        joined = joined.withColumn(f"fill_{s}", F.when(is_open, F.col(f"w_{s}")))
    return joined


def merge_details(details: DataFrame, batches: DataFrame) -> DataFrame:
    """Existing sections win; otherwise the earliest batch fills a section.

    Sources of the batches that filled something are appended in batch order.
    """
    folded = _folded(details, clean_batches(batches))
    fac, res = F.col("fill_faculty"), F.col("fill_research")
    fac_src, res_src = fac["src"], res["src"]
    faculty_first = fac["batch"] <= res["batch"]
    src = (
        F.when(F.coalesce(faculty_first, F.lit(True)), nested.ordered_union(fac_src, res_src))
        .otherwise(nested.ordered_union(res_src, fac_src))
    )
    return folded.select(
        "school_id",
        F.coalesce(fac["value"], F.col("old_faculty")).alias("faculty"),
        F.coalesce(res["value"], F.col("old_research")).alias("research"),
        nested.ordered_union(F.col("old_src"), src).alias("src"),
        F.coalesce("old_retrieved", F.when(F.col("_known").isNull(), F.col("w_new")["retrieved"])).alias(
            "retrieved"
        ),
    )


def merge_statistics(details: DataFrame, batches: DataFrame) -> DataFrame:
    """added / skipped_empty / skipped_existing / new_schools per batch, and the total (null batch)."""
    cleaned = clean_batches(batches)
    fills = _folded(details, cleaned).select(
        "school_id",
        F.col("_known").isNull().alias("_new"),
        F.col("fill_faculty")["batch"].alias("b_faculty"),
        F.col("fill_research")["batch"].alias("b_research"),
        F.col("w_new")["batch"].alias("b_new"),
    )
    flags = cleaned.join(fills, "school_id", "left")
    usable, batch = F.col("usable"), F.col("batch")
    wrote = F.lit(False)
    kept = F.lit(0)
    for s in V.MERGEABLE_SECTIONS:
        filled_here = F.coalesce(F.col(f"b_{s}") == batch, F.lit(False))
        wrote = wrote | filled_here
        kept = kept + F.when(F.col(s).isNotNull() & ~filled_here, 1).otherwise(0)
    flags = flags.select(
        "batch",
        F.when(usable & wrote, 1).otherwise(0).alias("added"),
        F.when(~usable, 1).otherwise(0).alias("skipped_empty"),
        F.when(usable, kept).otherwise(0).alias("skipped_existing"),
        F.when(usable & F.col("_new") & (F.col("b_new") == batch), 1).otherwise(0).alias("new_schools"),
    )
    names = ("added", "skipped_empty", "skipped_existing", "new_schools")
    return flags.rollup("batch").agg(*[F.sum(n).cast("bigint").alias(n) for n in names])


def section_coverage(details: DataFrame) -> DataFrame:
    return details.agg(
        F.count(F.lit(1)).alias("schools"),
        F.count_if(~text.is_empty_text(F.col("faculty"))).alias("with_faculty"),
        F.count_if(~text.is_empty_text(F.col("research"))).alias("with_research"),
    )
