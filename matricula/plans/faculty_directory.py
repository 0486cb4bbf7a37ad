"""From discovered directories and fetched pages to gated faculty rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matricula.functions import urls as U
from matricula.operators import directory as R
from matricula.operators import faculty as Y


def _walked(directories: DataFrame, pages: DataFrame) -> DataFrame:
    """school_id, url, ord from a walk; `ord` is the place where a URL was first seen."""
    found, _ = R.walk_directories(directories, pages)
    place = F.struct(
        F.col("at")["page_ord"].alias("a"), F.col("at")["pos"].cast("bigint").alias("b"), F.lit("").alias("c")
    )
    return found.select("school_id", F.col("norm").alias("url"), place.alias("ord"))


def enumerate_profiles(
    directories: DataFrame, pages: DataFrame, clusters: DataFrame, ledger: DataFrame,
    cap: int | None = None, rendered: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(profile URLs to fetch, counts). A sitemap cluster replaces the walk for its school.

    directories(school_id, url, ord); clusters(school_id, url): cluster members.
    `rendered`, a second page table, is walked for schools that came up empty or
    look cut off after one letter; its links are added behind the first set.
    """
    covered = clusters.select("school_id").distinct()
    zero = F.lit(0).cast("bigint")
    mapped = clusters.select(
        "school_id", U.normalize_url(F.col("url")).alias("url"),
        F.struct(zero.alias("a"), zero.alias("b"), F.col("url").alias("c")).alias("ord"),
    )
    listed = _walked(directories.join(covered, "school_id", "left_anti"), pages).unionByName(mapped)
    if rendered is not None:
        full = (
            Y.partial_schools(listed.select("school_id", F.col("url").alias("profile_url")))
            .filter(~F.col("partial"))
            .select("school_id")
        )
        again = _walked(directories.join(full, "school_id", "left_anti"), rendered)
    else:
        again = listed.limit(0)
    merged = R.merge_links(listed, again)
    urls = merged.select(
        "school_id", F.col("url").alias("profile_url"), F.struct("src", "ord").alias("ord")
    )
    return R.cap_new(urls, ledger, cap)


def faculty_tables(pages: DataFrame, schools: DataFrame, proposals: DataFrame | None = None) -> dict[str, DataFrame]:
    """rows (every outcome), kept rows, coverage and a stage summary for a table of fetched pages."""
    named = Y.with_school_names(pages, schools)
    rows = (
        Y.extract_deterministic(named)
        if proposals is None
        else Y.extract_with_proposals(named, proposals)
    )
    clean = rows.filter(F.col("outcome") == "extracted")
    raw = pages.select(
        "school_id", "profile_url", "http_status", F.col("fetched_at").alias("seq")
    )
    return {
        "rows": rows,
        "kept": Y.kept_rows(clean),
        "coverage": Y.coverage_report(clean, raw),
        "summary": Y.stage_summary(rows, "extract"),
    }
