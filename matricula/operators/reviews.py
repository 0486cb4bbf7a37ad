"""Untrusted reviews: sanitation, stop rules, result assembly and the feedback loop."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matricula import fixed_values as V
from matricula.functions import numeric as N
from matricula.operators import ranking
from matricula.session import cut_lineage

ReviewFn = Callable[[DataFrame, int], DataFrame]
REVIEW_SCHEMA = (
    "profile_id bigint, keep_ids array<string>, confidence string, "
    "weight_feedback map<string,string>, notes map<string,string>"
)


def top_lists(ranked: DataFrame, k: int) -> DataFrame:
    """profile_id -> ids and notes-ready structs of the k best, in rank order."""
    rows = ranked.filter(F.col("rank") <= k).groupBy("profile_id").agg(
        F.array_sort(
            F.collect_list(F.struct("rank", "id", "score", *V.COMPONENTS))
        ).alias("top")
    )
    return rows.withColumn("top_ids", F.transform("top", lambda r: r["id"]))


def default_review(ranked: DataFrame, iteration: int, k: int = 5) -> DataFrame:
    """Agrees with the current top-k and grows more confident each iteration."""
    best = F.array_sort

    def strongest(row):
        # Largest component; on a tie the earlier component wins.
        keyed = F.array(
            *[
                F.struct((-row[c]).alias("v"), F.lit(i).alias("o"), F.lit(c).alias("c"))
                for i, c in enumerate(V.COMPONENTS)
            ]
        )
        return best(keyed)[0]["c"]

    lists = top_lists(ranked, k)
    note = lambda r: F.format_string(
        # format_number rounds the exact binary value, as a reader of the score would expect
        "Strong on %s (score %s).", strongest(r), F.format_number(r["score"], 2)
    )
    return lists.select(
        "profile_id",
        F.col("top_ids").alias("keep_ids"),
        F.lit(str(min(1.0, 0.6 + 0.15 * iteration))).alias("confidence"),
        F.create_map().cast("map<string,string>").alias("weight_feedback"),
        F.map_from_arrays("top_ids", F.transform("top", note)).alias("notes"),
    )


def sanitize(reviews: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """Trust boundary: keep only candidate ids, first mention, k at most; clamp numbers.

    `candidates(profile_id, id)`. Feedback values that are not numbers are
    dropped, the rest are clamped; notes survive for candidate ids only.
    """
    # A review names few ids; candidates can be a whole catalog. Mentioned ids
    # are joined to the candidates, never the candidates gathered per profile.
    kept_pos = reviews.select("profile_id", F.posexplode("keep_ids").alias("pos", "id"))
    kept = (
        kept_pos.groupBy("profile_id", "id")
        .agg(F.min("pos").alias("pos"))
        .join(candidates.select("profile_id", "id"), ["profile_id", "id"], "left_semi")
    )
    keeps = kept.groupBy("profile_id").agg(
        F.slice(F.array_sort(F.collect_list(F.struct("pos", "id"))), 1, k).alias("_kept")
    )
    notes = (
        reviews.select("profile_id", F.explode("notes").alias("id", "note"))
        .join(candidates.select("profile_id", "id"), ["profile_id", "id"], "left_semi")
        .groupBy("profile_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("id", "note"))).alias("_notes"))
    )
    feedback = F.map_filter(
        F.transform_values(
            "weight_feedback",
            lambda _, v: N.clamp(v.try_cast("double"), V.FEEDBACK_MIN, V.FEEDBACK_MAX),
        ),
        lambda _, v: v.isNotNull(),
    )
    empty_map = F.create_map()
    return (
        reviews.select(
            "profile_id",
            N.confidence_or_zero(F.col("confidence")).alias("confidence"),
            F.coalesce(feedback, empty_map.cast("map<string,double>")).alias("feedback"),
        )
        .join(keeps, "profile_id", "left")
        .join(notes, "profile_id", "left")
        .select(
            "profile_id",
            F.coalesce(
                F.transform("_kept", lambda r: r["id"]), F.array().cast("array<string>")
            ).alias("keep_ids"),
            "confidence",
            "feedback",
            F.coalesce("_notes", empty_map.cast("map<string,string>")).alias("notes"),
        )
    )


def stop_reason(iteration, max_iterations, top_ids, prev_ids, kept_ids, confidence):
    """R1 > R2 > R3 > R4, first match wins; null means go on."""
    return (
        F.when((F.size(kept_ids) > 0) & (kept_ids == top_ids), "R1_converged")
        .when(confidence >= V.CONFIDENCE_STOP, "R2_confident")
        .when(prev_ids.isNotNull() & (top_ids == prev_ids), "R3_no_change")
        .when(iteration == max_iterations - 1, "R4_iteration_cap")
    )


def assemble(ranked: DataFrame, clean: DataFrame, catalog: DataFrame, profiles: DataFrame, k: int) -> DataFrame:
    """Chosen ids with score, rationale and tier; nothing kept falls back to the top-k.

    `ranked` must hold every candidate that a review may keep.
    """
    kept = clean.select("profile_id", F.posexplode("keep_ids").alias("pos", "id"), "notes")
    rows = ranked.join(kept, ["profile_id", "id"]).select(
        "profile_id", (F.col("pos") + 1).alias("position"), "id", "score", "notes"
    )
    none_kept = clean.filter(F.size("keep_ids") == 0).select("profile_id", "notes")
    rows = rows.unionByName(
        ranked.filter(F.col("rank") <= k)
        .join(none_kept, "profile_id")
        .select("profile_id", F.col("rank").alias("position"), "id", "score", "notes")
    )
    named = ranking.with_admit_tier(
        rows.select(
            "profile_id", "position", "id", "score",
            F.coalesce(
                F.try_element_at("notes", F.col("id")), F.lit(V.DEFAULT_RATIONALE)
            ).alias("rationale"),
        ),
        profiles,
        catalog,
    )
    return named.join(catalog.select("id", "name"), "id")


def feedback_loop(
    profiles: DataFrame,
    catalog: DataFrame,
    review: ReviewFn | None = None,
    max_iterations: int = 5,
    k: int = 5,
    depth: int | None = None,
    rank_fn: Callable[..., DataFrame] = ranking.rank_top_k,
) -> tuple[DataFrame, DataFrame]:
    """(trace, results) of rank -> review -> sanitise -> stop, for all profiles at once.

    Only profiles without a stop reason take part in the next iteration. Each
    iteration is checkpointed, so the plan stays short and survives executor
    loss. `depth` is how far down the ranking a review may reach (default k);
    a review of the whole catalog passes its size. Feedback replaces, it does
    not accumulate; an empty review keeps the feedback in force.
    """
    if not 1 <= max_iterations <= 20 or not 1 <= k <= 50:
        raise ValueError("max_iterations must be 1..20 and top_k 1..50")
    review = review or (lambda ranked, i: default_review(ranked, i, k))
    depth = max(depth or k, k)
    packed = ranking.pack_catalog(catalog)
    profiles = cut_lineage(profiles)  # what they derive from activities is computed once, not every round
    active = profiles.select(
        "profile_id",
        F.create_map().cast("map<string,double>").alias("feedback"),
        F.lit(None).cast("array<string>").alias("prev_ids"),
    )
    traces: list[DataFrame] = []
    finals: list[DataFrame] = []
    for i in range(max_iterations):
        now = profiles.join(active.select("profile_id"), "profile_id", "left_semi")
        ranked = cut_lineage(
            rank_fn(now, catalog, depth, feedback=active, packed=packed)
        )
        clean = sanitize(review(ranked, i), ranked, k)
        tops = top_lists(ranked, k).select("profile_id", "top_ids")
        no_ids, no_map = F.array().cast("array<string>"), F.create_map()
        step = (
            active.join(tops, "profile_id", "left")
            .join(clean.withColumnRenamed("feedback", "new_feedback"), "profile_id", "left")
            .select(
                "profile_id",
                F.lit(i).alias("iteration"),
                F.coalesce("top_ids", no_ids).alias("top_ids"),
                "prev_ids",
                F.coalesce("keep_ids", no_ids).alias("keep_ids"),
                # No candidate means no review row: the default policy's confidence stands.
                F.coalesce("confidence", F.lit(min(1.0, 0.6 + 0.15 * i))).alias("confidence"),
                F.coalesce("notes", no_map.cast("map<string,string>")).alias("notes"),
                F.when(F.size("new_feedback") > 0, F.col("new_feedback"))
                .otherwise(F.col("feedback"))
                .alias("feedback"),
            )
        )
        step = cut_lineage(
            step.withColumn(
                "stop_reason",
                stop_reason(
                    F.col("iteration"), max_iterations, F.col("top_ids"), F.col("prev_ids"),
                    F.col("keep_ids"), F.col("confidence"),
                ),
            )
        )
        traces.append(step.select("profile_id", "iteration", "top_ids", "confidence", "stop_reason"))
        stopped = step.filter(F.col("stop_reason").isNotNull())
        finals.append(
            assemble(
                ranked.join(stopped.select("profile_id"), "profile_id", "left_semi"),
                stopped, catalog, profiles, k,
            )
        )
        active = step.filter(F.col("stop_reason").isNull()).select(
            "profile_id", "feedback", F.col("top_ids").alias("prev_ids")
        )
        if active.isEmpty():
            break
    trace, results = traces[0], finals[0]
    for t in traces[1:]:
        trace = trace.unionByName(t)
    for r in finals[1:]:
        results = results.unionByName(r)
    return trace, results
