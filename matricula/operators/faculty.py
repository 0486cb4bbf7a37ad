"""Faculty records: extraction outcome, quality gates, coverage report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matricula import fixed_values as V
from matricula.functions import html as H
from matricula.functions import numeric as N
from matricula.functions import text as T
from matricula.operators.common import spread, status_counts


# ------------------------------------------------------------ extraction ----
def with_school_names(raw: DataFrame, schools: DataFrame) -> DataFrame:
    """Attach the school name; an unknown school is named by its id."""
    return raw.join(
        schools.select("school_id", F.col("name").alias("_name")), "school_id", "left"
    ).withColumn("school_name", F.coalesce("_name", "school_id")).drop("_name")


def page_hints(pages: DataFrame) -> DataFrame:
    """Deterministic hints of each page. Only fetched (200) pages are read."""
    read = F.when(F.col("http_status") == 200, F.col("html"))
    staged = spread(pages).withColumns(
        {
            "text": H.visible_text(read),
            "links": H.anchors(read),
            "person": H.jsonld_person(read),
            "hint": H.parse_hint(read),
            "meta_author": H.meta_author(read),
            "meta_name": H.meta_name(read),
        }
    )
    return staged.withColumns(
        {
            "email_hint": F.coalesce(
                F.col("person")["email"], H.first_mailto(F.col("links")), H.email_in_text(F.col("text"))
            ),
            "phone_hint": F.coalesce(
                F.col("person")["phone"], H.first_tel(F.col("links")), H.phone_in_text(F.col("text"))
            ),
        }
    ).drop("links")


def deterministic_name(person_name: Column, author: Column, school_name: Column) -> Column:
    """JSON-LD name, else meta author. A page title is not a claim about a person."""
    return F.coalesce(
        T.strip_boilerplate(person_name, school_name), T.strip_boilerplate(author, school_name)
    )


def extract_deterministic(pages: DataFrame) -> DataFrame:
    """Rows from structured evidence alone, with an outcome for every page.

    pages(school_id, school_name, profile_url, directory_url, http_status, html).
    """
    hinted = page_hints(pages).withColumn("_unread", F.col("html").isNull())
    name = deterministic_name(
        F.col("person")["name"], F.col("meta_author"), F.col("school_name")
    )
    outcome = (
        F.when(F.col("http_status") != 200, "non_200")
        .when(F.col("_unread"), "failed")  # fetched, but its text is missing
        .when(F.col("professor_name").isNull(), "no_name")
        .otherwise("extracted")
    )
    keep = [c for c in pages.columns if c != "html"]
    return (
        hinted.withColumn("professor_name", name)
        .withColumn("outcome", outcome)
        .select(
            *keep, "outcome", "professor_name",
            F.lit(None).cast("string").alias("title"),
            F.lit(None).cast("boolean").alias("is_faculty"),
            F.col("person")["department"].alias("department"),
            F.col("email_hint").alias("email"),
            F.col("phone_hint").alias("phone"),
            F.lit(None).cast("string").alias("research_interests"),
            F.lit(V.NO_MODEL_CONFIDENCE).alias("extraction_confidence"),
        )
    )


PROPOSAL_KEYS = (
    "is_profile", "professor_name", "title", "department", "email", "phone",
    "research_interests", "confidence", "notes",
)


def proposal_problem(proposal: Column) -> Column:
    """First structural problem of a proposal (all-string map), null when usable."""
    missing = F.filter(
        F.array(*[F.lit(k) for k in PROPOSAL_KEYS]), lambda k: ~F.map_contains_key(proposal, k)
    )
    get = lambda k: F.try_element_at(proposal, F.lit(k))
    return (
        F.when(
            F.size(missing) > 0,
            F.concat(F.lit("missing required field(s): "), F.array_join(missing, ", ")),
        )
        .when(~F.coalesce(get("is_profile").isin("true", "false"), F.lit(False)), "'is_profile' must be a boolean")
        .when(get("confidence").try_cast("double").isNull(), "'confidence' must be a number")
        .when(
            (get("is_profile") == "true") & T.blank_to_null(get("professor_name")).isNull(),
            "'is_profile' is true but 'professor_name' is missing or empty",
        )
    )


def coerce_proposal(proposal: Column) -> Column:
    """Proposal map to a typed struct; not a profile, or no name, empties it."""
    get = lambda k: F.try_element_at(proposal, F.lit(k))
    name = T.blank_to_null(get("professor_name"))
    is_person = F.coalesce(get("is_profile") == "true", F.lit(False)) & name.isNotNull()
    text = lambda k: F.when(is_person, T.blank_to_null(get(k))).alias(k)
    return F.struct(
        is_person.alias("is_profile"),
        F.when(is_person, name).alias("professor_name"),
        text("title"),
        F.when(
            is_person,
            F.when(get("is_faculty") == "true", True).when(get("is_faculty") == "false", False),
        ).alias("is_faculty"),
        text("department"), text("email"), text("phone"), text("research_interests"),
        F.when(is_person, N.confidence_or_zero(get("confidence"))).otherwise(0.0).alias("confidence"),
    )


def faculty_judgment(title: Column, proposed: Column) -> Column:
    """The title decides where it is explicit, then the proposal, else unknown."""
    return F.coalesce(T.classify_role(title), proposed)


def extract_with_proposals(pages: DataFrame, proposals: DataFrame) -> DataFrame:
    """Rows from proposals(profile_url, proposal map), grounded against the page itself."""
    p = F.col("c")
    joined = page_hints(pages).join(proposals, "profile_url", "left")
    joined = joined.withColumn("problem", proposal_problem(F.col("proposal"))).withColumn(
        "c", coerce_proposal(F.col("proposal"))
    )
    outcome = (
        F.when(F.col("http_status") != 200, "non_200")
        .when(F.col("proposal").isNull() | F.col("problem").isNotNull(), "invalid")
        .when(~p["is_profile"], "not_a_profile")
        .otherwise("extracted")
    )
    keep = [c for c in pages.columns if c != "html"]
    return joined.withColumn("outcome", outcome).select(
        *keep, "outcome",
        F.coalesce(
            T.strip_boilerplate(p["professor_name"], F.col("school_name")), p["professor_name"]
        ).alias("professor_name"),
        p["title"].alias("title"),
        faculty_judgment(p["title"], p["is_faculty"]).alias("is_faculty"),
        p["department"].alias("department"),
        H.grounded_email(p["email"], F.col("text"), F.col("email_hint")).alias("email"),
        H.grounded_phone(p["phone"], F.col("text"), F.col("phone_hint")).alias("phone"),
        p["research_interests"].alias("research_interests"),
        p["confidence"].alias("extraction_confidence"),
    )


def stage_summary(outcomes: DataFrame, stage: str) -> DataFrame:
    """processed / skipped / failed of one run from its outcome column."""
    o = F.col("outcome")
    return outcomes.agg(
        F.count_if(o == "extracted").alias("processed"),
        F.count_if(~o.isin("extracted", "failed")).alias("skipped"),
        F.count_if(o == "failed").alias("failed"),
    ).withColumn("stage", F.lit(stage))


# ---------------------------------------------------------- quality gates ---
def resolved_role(is_faculty: Column, title: Column) -> Column:
    return F.coalesce(is_faculty, T.classify_role(title))


def judge(professors: DataFrame, min_confidence: float = V.MIN_CONFIDENCE) -> DataFrame:
    """Add `role` and `verdict`: kept, below_confidence or non_faculty.

    Only an explicit non-faculty role excludes; the confidence floor is inclusive.
    """
    role = resolved_role(F.col("is_faculty"), F.col("title"))
    return professors.withColumn("role", role).withColumn(
        "verdict",
        F.when(~F.coalesce("role", F.lit(True)), "non_faculty")
        .when(F.col("extraction_confidence") >= min_confidence, "kept")
        .otherwise("below_confidence"),
    )


def kept_rows(professors: DataFrame, min_confidence: float = V.MIN_CONFIDENCE) -> DataFrame:
    return judge(professors, min_confidence).filter(F.col("verdict") == "kept").drop("verdict")


# --------------------------------------------------------------- coverage ---
def source_counts(raw: DataFrame) -> DataFrame:
    """Distinct fetched URLs and dead ones per school; the last status of a URL wins.

    The first level groups by (school, url), so a school with very many pages is
    spread over all tasks before it is summed.
    """
    valid = raw.filter(F.col("school_id").isNotNull() & F.col("profile_url").isNotNull())
    last = valid.groupBy("school_id", "profile_url").agg(
        F.max_by("http_status", "seq").alias("status")
    )
    return last.groupBy("school_id").agg(
        F.count(F.lit(1)).alias("fetched"),
        F.count_if(F.col("status") != 200).alias("dead"),
    )


def stale_sources(raw: DataFrame, share: float = V.STALE_SHARE) -> DataFrame:
    return source_counts(raw).filter(F.col("dead") / F.col("fetched") >= share)


def partial_schools(
    urls: DataFrame,
    min_profiles: int = V.PARTIAL_MIN_PROFILES,
    concentration: float = V.PARTIAL_CONCENTRATION,
) -> DataFrame:
    """Schools whose captured profiles nearly all share one surname initial.

    `urls(school_id, profile_url)`. Slug tokens are read in both name orders.
    Letters are counted per (school, order, letter) with map-side partial sums.
    """
    slug = F.lower(
        F.regexp_extract(F.regexp_replace(F.regexp_extract("profile_url", r"^[^?#]*", 0), "/+$", ""), "([^/]*)$", 1)
    )
    tokens = F.filter(F.split(slug, "-"), lambda t: t.rlike(r"^\p{L}"))
    rows = urls.select("school_id", tokens.alias("t"))
    initials = lambda part: F.array_distinct(F.transform(part, lambda t: F.substring(t, 1, 1)))
    usable = rows.filter(F.size("t") >= 2)
    letters = usable.select(
        "school_id",
        F.explode(
            F.concat(
                F.transform(
                    initials(F.slice("t", F.lit(2), F.size("t") - 1)),
                    lambda c: F.struct(F.lit("first").alias("drop"), c.alias("letter")),
                ),
                F.transform(
                    initials(F.slice("t", F.lit(1), F.size("t") - 1)),
                    lambda c: F.struct(F.lit("last").alias("drop"), c.alias("letter")),
                ),
            )
        ).alias("l"),
    )
    top = (
        letters.groupBy("school_id", "l.drop", "l.letter")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("school_id")
        .agg(F.max("n").alias("top_n"))
    )
    sizes = rows.groupBy("school_id").agg(
        F.count(F.lit(1)).alias("profiles"), F.count_if(F.size("t") >= 2).alias("slugs")
    )
    flagged = (
        (F.col("profiles") >= min_profiles)
        & (F.col("slugs") >= min_profiles)
        & (F.col("top_n") / F.col("slugs") >= concentration)
    )
    return sizes.join(top, "school_id", "left").select(
        "school_id", "profiles", "slugs",
        F.coalesce(flagged, F.lit(False)).alias("partial"),
    )


def coverage_report(
    professors: DataFrame,
    raw: DataFrame | None,
    min_confidence: float = V.MIN_CONFIDENCE,
    max_profiles: int = V.MAX_PROFILES_PER_SCHOOL,
) -> DataFrame:
    """One row per school; evidence that is not there reads "unknown", never zero or false."""
    judged = judge(professors, min_confidence)
    verdict = F.col("verdict")
    counts = judged.groupBy("school_id").agg(
        F.min("school_name").alias("school_name"),
        F.count_if(verdict == "kept").alias("professors_in_csv"),
        F.count_if(verdict == "below_confidence").alias("professors_below_confidence"),
        F.count_if(verdict == "non_faculty").alias("professors_excluded_as_non_faculty"),
    )
    partial = partial_schools(judged.filter(verdict == "kept")).select("school_id", "partial")
    report = counts.join(partial, "school_id", "left").withColumn(
        "partial", F.coalesce("partial", F.lit(False))
    )
    if raw is None:
        unknown = F.lit("unknown")
        report = report.withColumns(
            {"fetched_cell": unknown, "dead_cell": unknown, "capped_cell": unknown, "capped": F.lit(False)}
        )
    else:
        capped = F.coalesce(F.col("fetched") >= max_profiles, F.lit(False))
        report = report.join(source_counts(raw), "school_id", "left").withColumns(
            {
                "fetched_cell": F.coalesce(F.col("fetched").cast("string"), F.lit("unknown")),
                "dead_cell": F.coalesce(F.col("dead").cast("string"), F.lit("unknown")),
                "capped": capped,
                "capped_cell": capped.cast("string"),
            }
        )
    return report.select(
        "school_id", "school_name", "professors_in_csv", "professors_below_confidence",
        "professors_excluded_as_non_faculty",
        F.col("fetched_cell").alias("source_urls_fetched"),
        F.col("dead_cell").alias("source_urls_dead"),
        F.col("partial").cast("string").alias("partial_coverage"),
        F.col("capped_cell").alias("capped_at_limit"),
        (F.col("partial") | F.col("capped")).cast("string").alias("incomplete"),
    )


def incomplete_headline(coverage: DataFrame) -> DataFrame:
    return coverage.agg(
        F.count(F.lit(1)).alias("schools"),
        F.count_if(F.col("incomplete") == "true").alias("incomplete"),
        F.count_if(F.col("partial_coverage") == "true").alias("partial"),
        F.count_if(F.col("capped_at_limit") == "true").alias("capped"),
    )


def pipeline_status(artifacts: dict[str, DataFrame], ledger: DataFrame, coverage: DataFrame) -> DataFrame:
    """Rows per artifact, ledger counts and incomplete schools as (section, item, n)."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("n")).select(
            F.lit("artifact").alias("section"), F.lit(name).alias("item"), "n"
        )
        for name, df in artifacts.items()
    ]
    parts.append(
        status_counts(ledger).select(
            F.lit("ledger").alias("section"), F.col("status").alias("item"), "n"
        )
    )
    parts.append(
        incomplete_headline(coverage).select(
            F.lit("coverage").alias("section"),
            F.lit("incomplete").alias("item"),
            F.col("incomplete").alias("n"),
        )
    )
    status = parts[0]
    for part in parts[1:]:
        status = status.unionByName(part)
    return status


# ------------------------------------------------------------------ export --
def output_slugs(school_ids: DataFrame) -> DataFrame:
    """Collision-safe file slug per school id; the first id in order keeps the bare slug."""
    from pyspark.sql import Window

    slug = F.coalesce(F.nullif(T.slugify_folded(F.col("school_id")), F.lit("")), F.col("school_id"))
    named = school_ids.select("school_id").distinct().withColumn("base", slug)
    nth = F.row_number().over(Window.partitionBy("base").orderBy("school_id"))
    return named.withColumn("_n", nth).select(
        "school_id",
        F.when(F.col("_n") == 1, F.col("base"))
        .otherwise(F.concat_ws("-", "base", "base", F.col("_n").cast("string")))
        .alias("slug"),
    )


def export_rows(professors: DataFrame, min_confidence: float = V.MIN_CONFIDENCE) -> DataFrame:
    """Kept rows as CSV cells in the fixed column order; null becomes an empty cell."""
    kept = kept_rows(professors, min_confidence)
    cells = {
        c: F.coalesce(F.col(c).cast("string"), F.lit(""))
        for c in V.PROFESSOR_COLUMNS
        if c in kept.columns
    }
    cells["is_faculty"] = T.bool_cell(F.col("role"))
    return kept.select(*[cells[c].alias(c) for c in V.PROFESSOR_COLUMNS if c in cells])
