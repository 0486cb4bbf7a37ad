"""Catalog analytics: search, facets, coverage, list balance, major finder, comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matricula import fixed_values as V
from matricula.functions import display, nested, numeric
from matricula.functions.text import word_mask
from matricula.operators.common import spread, top_n


# ------------------------------------------------------- search and facets --
def search(
    catalog: DataFrame, text: str, country: str | None = None, size: str | None = None
) -> DataFrame:
    """Substring match over name, place, country and majors; blank text keeps everything."""
    needle = text.strip().lower()
    found = catalog
    if country:
        found = found.filter(F.col("country") == country)
    if size:
        found = found.filter(F.col("size") == size)
    if not needle:
        return found
    hit = F.exists("majors", lambda m: F.lower(m).contains(needle))
    for name in ("name", "location", "country"):
        hit = hit | F.lower(F.col(name)).contains(needle)
    return found.filter(hit)


def facet_counts(catalog: DataFrame, column: str) -> DataFrame:
    """Facet values, most frequent first, then by value (binary order)."""
    return (
        catalog.groupBy(column)
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), F.asc(column))
    )


def offered_majors(catalog: DataFrame, min_schools: int = 3) -> DataFrame:
    return (
        catalog.select(F.explode(F.array_distinct("majors")).alias("major"))
        .groupBy("major")
        .agg(F.count(F.lit(1)).alias("schools"))
        .filter(F.col("schools") >= min_schools)
    )


# ------------------------------------------------------- degree families ----
def family_coverage(catalog: DataFrame, families: list[str] | None = None) -> DataFrame:
    """Per family: schools awarding it, measured without it, and never measured.

    Awards are counted from the exploded programs; the other two numbers follow
    from catalog totals, so schools are never paired with families.
    """
    awarding = (
        catalog.select(F.explode("programs.name").alias("family"))
        .groupBy("family")
        .agg(F.count(F.lit(1)).alias("awarding"))
    )
    wanted = F.array(*[F.lit(f) for f in (families or sorted(set(V.CIP_FAMILIES.values())))])
    totals = catalog.agg(
        F.count_if(F.col("programs").isNotNull()).alias("measured"),
        F.count_if(F.col("programs").isNull()).alias("unmeasured"),
    ).withColumn("family", F.explode(wanted))
    counted = F.coalesce("awarding", F.lit(0))
    return totals.join(awarding, "family", "left").select(
        "family",
        counted.alias("awarding"),
        (F.col("measured") - counted).alias("none"),
        "unmeasured",
    )


def awards_family(catalog: DataFrame, family: str | Column) -> DataFrame:
    family = F.lit(family) if isinstance(family, str) else family
    return catalog.withColumn("awards", nested.awards_degrees_in(F.col("programs"), family))


def family_of_major(major: Column) -> Column:
    """Federal family of a major finder entry; an unmapped major makes no claim."""
    pairs = [F.lit(x) for name, *_, family in V.MAJORS for x in (name, family)]
    return F.try_element_at(F.create_map(*pairs), major)


def also_awarding(catalog: DataFrame, shown: DataFrame, limit: int = 6) -> DataFrame:
    """Per family, schools awarding it that are not among `shown(family, id)`, by share."""
    rows = catalog.select("id", F.explode("programs").alias("p")).select(
        F.col("p")["name"].alias("family"), "id", F.col("p")["share"].alias("share")
    )
    rest = rows.join(shown.select("family", "id"), ["family", "id"], "left_anti")
    return top_n(rest, ["family"], [F.desc("share"), F.asc("id")], limit)


def researchers_by_family(people: DataFrame) -> DataFrame:
    """school_id, family, person rows: each researcher under every family of their fields."""
    families = F.array_distinct(F.flatten(F.transform("fields", nested.families_of)))
    return people.withColumn("family", F.explode(families))


# ------------------------------------------------------------- the list -----
def list_balance(entries: DataFrame, students: DataFrame | None = None) -> DataFrame:
    """Tier counts, safety share, suggested range and warning per student.

    Students without entries get zeros and no warning when `students` is given.
    """
    tier = F.col("tier")
    counts = entries.groupBy("student_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(tier == "reach").alias("reach"),
        F.count_if(tier == "target").alias("target"),
        F.count_if(tier == "safety").alias("safety"),
        F.count_if(tier == "extreme_reach").alias("extreme_reach"),
        F.count_if(tier.isNull()).alias("unknown"),
    )
    names = ("total", "reach", "target", "safety", "extreme_reach", "unknown")
    if students is not None:
        counts = students.select("student_id").join(counts, "student_id", "left").select(
            "student_id", *[F.coalesce(n, F.lit(0)).alias(n) for n in names]
        )
    empty = F.col("total") == 0
    share = F.when(empty, F.lit(0.0)).otherwise(
        F.col("safety") / F.greatest(F.col("total"), F.lit(1))
    )
    return counts.select(
        "student_id", *names,
        share.alias("safety_share"),
        numeric.js_round(F.col("total") * V.SAFETY_MIN).cast("bigint").alias("range_low"),
        numeric.js_round(F.col("total") * V.SAFETY_MAX).cast("bigint").alias("range_high"),
        (~empty & (share < V.SAFETY_MIN)).alias("needs_more_safeties"),
    )


def suggest_gaps(
    listed: DataFrame, matches: DataFrame, limit: int = V.MAX_SUGGESTIONS
) -> DataFrame:
    """Best unlisted safeties from a student's own matches, only where the list needs them."""
    short = list_balance(listed).filter("needs_more_safeties").select("student_id")
    open_matches = (
        matches.filter(F.col("tier") == "safety")
        .join(short, "student_id", "left_semi")
        .join(listed.select("student_id", "school_id"), ["student_id", "school_id"], "left_anti")
    )
    return top_n(open_matches, ["student_id"], [F.desc("fit"), F.asc("school_id")], limit)


def flag_delisted(entries: DataFrame, catalog: DataFrame | None) -> DataFrame:
    """True when a listed school left the catalog; null when no catalog is available."""
    if catalog is None:
        return entries.withColumn("delisted", F.lit(None).cast("boolean"))
    known = catalog.select(F.col("id").alias("school_id"), F.lit(True).alias("_known")).distinct()
    return entries.join(known, "school_id", "left").withColumn(
        "delisted", F.col("_known").isNull()
    ).drop("_known")


# --------------------------------------------------------- major finder -----
def fold_answers(answers: DataFrame) -> DataFrame:
    """Long answers(profile_id, question, answer) to the eight axes; unanswered is 0.5."""
    wide = answers.groupBy("profile_id").pivot("question", list(V.QUESTIONS)).agg(F.max("answer"))
    answered = sum((F.col(q).isNotNull().cast("int") for q in V.QUESTIONS), F.lit(0))
    return wide.select(
        "profile_id",
        *[F.coalesce(q, F.lit(0.5)).alias(q) for q in V.QUESTIONS],
        answered.alias("answered"),
    )


def rank_majors(students: DataFrame) -> DataFrame:
    """Every major per student with score, reasons and rank.

    students(profile_id, courses array<string>, activities, people, applied,
    creative). Patterns run once per student; the fixed list of majors is then
    unfolded from an array literal.
    """
    text = F.lower(F.trim(F.coalesce("activities", F.lit(""))))
    mask = word_mask(text, [pattern for _, _, _, pattern, _ in V.MAJORS])
    spec = F.array(
        *[
            F.struct(
                F.lit(name).alias("name"),
                F.lit(1 << i).cast("bigint").alias("bit"),
                F.array(*[F.lit(c) for c in courses]).alias("courses"),
                *[F.lit(a).alias(k) for k, a in zip(("people", "applied", "creative"), axes)],
            )
            for i, (name, courses, axes, _, _) in enumerate(V.MAJORS)
        ]
    )
    rows = spread(students).withColumn("_mask", mask).select(
        "profile_id", "courses", "people", "applied", "creative", "_mask",
        F.explode(spec).alias("m"),
    )
    m = F.col("m")
    overlap = F.filter(m["courses"], lambda c: F.array_contains(F.col("courses"), c))
    rows = rows.select(
        "profile_id",
        m["name"].alias("major"),
        overlap.alias("overlap"),
        (F.size(overlap) / F.size(m["courses"])).alias("course_share"),
        (F.col("_mask").bitwiseAND(m["bit"]) != 0).alias("hit"),
        numeric.axis_score(
            [F.col(k) for k in ("people", "applied", "creative")],
            [m[k] for k in ("people", "applied", "creative")],
        ).alias("axis_score"),
    )
    reasons = F.concat_ws(
        "; ",
        F.when(
            F.size("overlap") > 0,
            F.concat(F.lit("courses: "), F.array_join(F.slice("overlap", 1, 3), ", ")),
        ),
        F.when(F.col("hit"), "matches your activities"),
        F.when(F.col("axis_score") >= V.AXIS_REASON_MIN, "fits how you like to work"),
    )
    scored = rows.select(
        "profile_id", "major",
        numeric.major_score(F.col("course_share"), F.col("hit"), F.col("axis_score")).alias("score"),
        reasons.alias("reasons"),
    )
    return top_n(scored, ["profile_id"], [F.desc("score"), F.asc("major")], len(V.MAJORS))


def schools_for_major(catalog: DataFrame, limit: int = 6) -> DataFrame:
    """First schools, in catalog order, listing each major among their strengths."""
    majors = F.array(
        *[
            F.struct(F.lit(name).alias("major"), F.lit(name.split(" / ")[0].lower()).alias("needle"))
            for name, *_ in V.MAJORS
        ]
    )
    hit = F.filter(
        majors, lambda m: F.exists("_lower", lambda own: own.contains(m["needle"]))
    )
    rows = catalog.withColumn("_lower", F.transform("majors", F.lower)).select(
        "id", F.explode(hit).alias("m")
    )
    return top_n(rows.select(F.col("m")["major"].alias("major"), "id"), ["major"], [F.asc("id")], limit)


# ------------------------------------------------------------ comparison ----
def stat_rows(catalog: DataFrame) -> DataFrame:
    """One row per school and metric with its display text and qualifier."""
    cells = F.array(
        *[
            F.struct(
                F.lit(label).alias("metric"),
                display.stat_text(
                    F.col(key), F.try_element_at("provenance", F.lit(key)), kind
                ).alias("text"),
                display.stat_note(F.col(key), F.try_element_at("provenance", F.lit(key))).alias("note"),
            )
            for label, key, kind in V.COMPARE_ROWS
        ]
    )
    return catalog.select("id", F.inline(cells))


def comparison_table(catalog: DataFrame, ids: list[str]) -> DataFrame:
    """Metrics as rows, up to three chosen schools as columns."""
    if len(ids) > 3:
        raise ValueError("at most three schools are compared")
    chosen = stat_rows(catalog.filter(F.col("id").isin(*ids)))
    cell = F.concat_ws(" ", "text", "note")
    return chosen.groupBy("metric").pivot("id", ids).agg(F.first(cell))
