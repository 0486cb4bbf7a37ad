"""Profile x university ranking: six components, deterministic top-k per profile.

Execution plan. The catalog is folded into *packs* of at most about `PACK_ROWS`
universities, keyed by the two hard filters (country class, institution type)
and a pack number. A profile meets the packs its filters admit through an
equi-join. The catalog is counted first: up to `BROADCAST_ROWS` universities
(a few megabytes) the packs are broadcast, and profiles, hash-partitioned by
`profile_id` once, are scored and ranked in the same task; there are as many
tasks as keep the pairs that one of them sorts near `PAIRS_PER_TASK`, however
many profiles there are. A larger catalog is
shuffled on (filters, pack) instead, which by then are many keys; the partial
rank still reduces each task to k rows per profile before they move. Either
way no pair crosses the network, and the result is the same.

Everything that depends on one side only (regex masks, importances, weight
sums, lower-cased names) is computed before the sides meet. The pair arithmetic
is staged over several projections, so a value used twice is computed once and
each generated method stays small enough to be compiled by the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matricula import fixed_values as V
from matricula.functions import numeric as N
from matricula.functions import text as T
from matricula.operators.common import spread, top_n

PACK_ROWS = 256
BROADCAST_ROWS = 16384
PAIRS_PER_TASK = 1 << 19
UNIVERSITY_FIELDS = (
    "id", "avg_gpa", "avg_sat", "acceptance_rate", "net_price", "sticker_tuition",
    "tuition_in_state", "state", "region", "setting", "enrollment",
)


def activity_masks(activities: DataFrame) -> DataFrame:
    """activities(profile_id, text) -> one array of pattern masks per profile.

    Patterns run once per activity, before any pairing. Masks are counted first,
    so a profile with very many activities folds to its distinct masks.
    """
    counted = (
        spread(activities).select("profile_id", T.activity_mask(F.col("text")).alias("m"))
        .groupBy("profile_id", "m")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counted.groupBy("profile_id").agg(
        F.collect_list(F.struct("m", "n")).alias("activity_masks")
    )


def score_pairs(pairs: DataFrame) -> DataFrame:
    """profile_id, id, neg_score and the six components for every row.

    `pairs` holds the columns of `prepare_profiles`, a university struct `u` and
    the already computed `activities` component.
    """
    p, u = F.col, lambda name: F.col("u")[name]
    weights = [f"w_{c}" for c in V.COMPONENTS] + ["w_total"]
    premium = N.out_of_state_premium(
        p("home_state"), u("state"), u("sticker_tuition"), u("tuition_in_state")
    )
    staged = pairs.select(
        "profile_id",
        u("id").alias("id"),
        (p("gpa") - u("avg_gpa")).alias("gap_gpa"),
        (p("sat") - u("avg_sat")).cast("double").alias("gap_sat"),
        (u("net_price") + premium).alias("owed"),
        "max_tuition",
        N.fit(
            p("intended_lower"), u("majors_lower"), p("regions"), u("region"),
            p("settings"), u("setting"),
        ).alias("fit"),
        N.culture_fit(
            {a: p(f"pf_{a}") for a in V.CULTURE_AXES},
            {a: p(f"i_{a}") for a in V.CULTURE_AXES},
            p("i_culture"),
            {a: u(f"c_{a}") for a in V.CULTURE_AXES},
        ).alias("culture"),
        "activities",
        N.personality_fit(
            p("intensity"), p("scale"), p("i_intensity"), p("i_scale"),
            u("acceptance_rate"), u("enrollment"),
        ).alias("personality"),
        *weights,
    )
    staged = staged.withColumns(
        {
            "bell_gpa": N.bell(p("gap_gpa"), V.GPA_SIGMA),
            "bell_sat": N.bell(p("gap_sat"), V.SAT_SIGMA),
        }
    )
    staged = staged.select(
        "profile_id", "id", "fit", "culture", "activities", "personality", *weights,
        N.peaked(p("gap_gpa"), V.GPA_SIGMA, p("bell_gpa")).alias("on_gpa"),
        F.when(
            p("gap_sat").isNotNull(), N.peaked(p("gap_sat"), V.SAT_SIGMA, p("bell_sat"))
        ).alias("on_sat"),
        N.cost_fit(p("owed"), p("max_tuition")).alias("cost"),
    )
    staged = staged.withColumn("academic", N.academic_fit(p("on_gpa"), p("on_sat")))
    score = N.rubric(
        {c: p(f"w_{c}") for c in V.COMPONENTS}, p("w_total"), {c: p(c) for c in V.COMPONENTS}
    )
    return staged.select("profile_id", "id", (-score).alias("neg_score"), *V.COMPONENTS)


def prepare_profiles(profiles: DataFrame, feedback: DataFrame | None = None) -> DataFrame:
    """Fill optional inputs and resolve weights (default <- override x feedback).

    Optional columns: sat, max_tuition, home_state, scope, institution_type,
    regions, settings, pf_<axis>, intensity, scale, w_<component>,
    activity_masks. `feedback(profile_id, feedback map<string,double>)`.
    """
    have = set(profiles.columns)
    half = F.lit(0.5)

    def col(name: str, default: Column) -> Column:
        return F.coalesce(F.col(name), default) if name in have else default

    def optional(name: str, dtype: str) -> Column:
        return F.col(name) if name in have else F.lit(None).cast(dtype)

    base = profiles
    if feedback is not None:
        base = profiles.join(feedback.select("profile_id", "feedback"), "profile_id", "left")
    empty = F.array().cast("array<string>")
    masks = "array<struct<m:int,n:bigint>>"
    filled = base.select(
        "profile_id",
        "gpa",
        optional("sat", "int").alias("sat"),
        F.lower("intended_major").alias("intended_lower"),
        optional("max_tuition", "double").alias("max_tuition"),
        optional("home_state", "string").alias("home_state"),
        col("scope", F.lit("both")).alias("scope"),
        optional("institution_type", "string").alias("institution_type"),
        col("regions", empty).alias("regions"),
        col("settings", empty).alias("settings"),
        *[col(f"pf_{a}", half).alias(f"pf_{a}") for a in V.CULTURE_AXES],
        col("intensity", half).alias("intensity"),
        col("scale", half).alias("scale"),
        optional("activity_masks", masks).alias("activity_masks"),
        *[
            N.resolved_weight(
                c,
                F.col(f"w_{c}") if f"w_{c}" in have else None,
                F.try_element_at("feedback", F.lit(c)) if feedback is not None else None,
            ).alias(f"w_{c}")
            for c in V.COMPONENTS
        ],
    )
    return filled.withColumns(
        {
            **{f"i_{a}": N.axis_importance(F.col(f"pf_{a}")) for a in V.CULTURE_AXES},
            "i_culture": N.culture_weight({a: F.col(f"pf_{a}") for a in V.CULTURE_AXES}),
            "i_intensity": N.axis_importance(F.col("intensity")),
            "i_scale": N.axis_importance(F.col("scale")),
            "w_total": N.weight_total({c: F.col(f"w_{c}") for c in V.COMPONENTS}),
        }
    )


def prepare_catalog(catalog: DataFrame) -> DataFrame:
    majors = F.transform("majors", F.lower)
    return catalog.select(
        *UNIVERSITY_FIELDS,
        *[f"c_{a}" for a in V.CULTURE_AXES],
        majors.alias("majors_lower"),
        T.subject_mask(majors).alias("subject_mask"),
        (F.col("country") == "USA").alias("is_us"),
        "type",
    )


@dataclass(frozen=True)
class Packs:
    df: DataFrame
    per_filter: int
    rows: int


def pack_catalog(catalog: DataFrame, pack_rows: int = PACK_ROWS) -> Packs:
    """Packed catalog with its size. One count sizes the packs and decides on broadcasting.

    Inside a pack, schools with the same subject mask sit together: the activity
    component is the same for all of them and is computed once per group.
    """
    ready = prepare_catalog(catalog)
    rows = catalog.count()
    packs = max(1, -(-rows // pack_rows))
    entry = F.struct(*[c for c in ready.columns if c not in ("is_us", "type", "subject_mask")])
    packed = (
        ready.withColumn("pack", F.pmod(F.xxhash64("id"), F.lit(packs)).cast("int"))
        .groupBy("is_us", "type", "pack", "subject_mask")
        .agg(F.collect_list(entry).alias("entries"))
        .groupBy("is_us", "type", "pack")
        .agg(F.collect_list(F.struct("subject_mask", "entries")).alias("groups"))
    )
    return Packs(packed, packs, rows)


def admitted_filters(profiles: DataFrame, packs: int) -> DataFrame:
    """Explode each profile to the filter keys and packs its hard filters admit.

    An unknown scope admits every country; both filters apply before ranking.
    """
    scope = F.col("scope")
    classes = (
        F.when(scope == "usa", F.array(F.lit(True)))
        .when(scope == "international", F.array(F.lit(False)))
        .otherwise(F.array(F.lit(True), F.lit(False)))
    )
    types = F.when(
        F.col("institution_type").isNotNull(), F.array("institution_type")
    ).otherwise(F.array(*[F.lit(t) for t in V.INSTITUTION_TYPES]))
    numbers = F.sequence(F.lit(0), F.lit(packs - 1))
    return (
        profiles.withColumn("is_us", F.explode(classes))
        .withColumn("type", F.explode(types))
        .withColumn("pack", F.explode(numbers))
    )


def ranking_tasks(profiles: DataFrame, schools: int) -> int:
    """Tasks that rank at most about PAIRS_PER_TASK pairs each; no fewer than other shuffles have.

    Distinct ids are counted: unlike the rows, they do not depend on what was joined to the profiles.
    """
    pairs = profiles.select("profile_id").distinct().count() * schools
    return max(int(profiles.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pairs // PAIRS_PER_TASK))


def rank_top_k(
    profiles: DataFrame,
    catalog: DataFrame,
    k: int = 5,
    feedback: DataFrame | None = None,
    packed: Packs | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """profile_id, rank, id, score, components: score descending, id ascending."""
    packs = packed or pack_catalog(catalog)
    ready, entries = prepare_profiles(profiles, feedback), packs.df
    if packs.rows <= broadcast_rows:
        entries = F.broadcast(entries)
        # One hash partitioning by profile serves both the scoring and the final rank.
        ready = ready.repartition(ranking_tasks(profiles, packs.rows), "profile_id")
    seekers = admitted_filters(ready, packs.per_filter)
    pairs = (
        seekers.join(entries, ["is_us", "type", "pack"])
        .drop("is_us", "type", "pack", "scope", "institution_type")
        .withColumn("g", F.explode("groups"))
        .withColumn(
            "activities", N.activity_fit(F.col("activity_masks"), F.col("g")["subject_mask"])
        )
        .withColumn("u", F.explode(F.col("g")["entries"]))
        .drop("groups", "g", "activity_masks")
    )
    kept = score_pairs(pairs)
    return top_n(kept, ["profile_id"], [F.col("neg_score"), F.col("id")], k).select(
        "profile_id",
        F.col("rank").cast("int").alias("rank"),
        "id",
        (-F.col("neg_score")).alias("score"),
        *V.COMPONENTS,
    )


def with_universities(ranked: DataFrame, catalog: DataFrame, columns: list[str]) -> DataFrame:
    """Attach catalog attributes after the top-k, when few rows are left."""
    return ranked.join(catalog.select("id", *columns), "id")


def with_admit_tier(ranked: DataFrame, profiles: DataFrame, catalog: DataFrame) -> DataFrame:
    joined = with_universities(ranked, catalog, ["avg_gpa", "acceptance_rate"]).join(
        profiles.select("profile_id", "gpa"), "profile_id"
    )
    return joined.withColumn(
        "admit_tier",
        N.admit_tier(F.col("gpa"), F.col("avg_gpa"), F.col("acceptance_rate")),
    ).drop("avg_gpa", "acceptance_rate", "gpa")


def filter_tiers(results: DataFrame, tiers: list[str]) -> DataFrame:
    """Multi-select tier filter; an empty selection keeps everything."""
    return results.filter(F.col("admit_tier").isin(*tiers)) if tiers else results


def resort(results: DataFrame, by: str) -> DataFrame:
    """Position of each result under another order; ties keep the ranking order.

    An unknown price or rate sorts as 1e9 or 1.0, so it ties with a real 1.0.
    `results(profile_id, rank, score, net_price, acceptance_rate)`.
    """
    from pyspark.sql import Window

    keys = {
        "match": -F.col("score"),
        "price": F.coalesce("net_price", F.lit(1e9)),
        "selectivity": F.coalesce("acceptance_rate", F.lit(1.0)),
    }
    # A profile has at most top_k results, so this window is small by construction.
    window = Window.partitionBy("profile_id").orderBy(keys[by], F.col("rank"))
    return results.withColumn("position", F.row_number().over(window))


def page(results: DataFrame, number: int, size: int = 10, position: str = "position") -> DataFrame:
    at = F.col(position)
    return results.filter((at > (number - 1) * size) & (at <= number * size))
