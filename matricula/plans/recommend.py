"""Recommendation requests: validate, rank, review, assemble."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matricula.operators import ranking, reviews, validation


def recommend(
    profiles: DataFrame,
    activities: DataFrame | None,
    catalog: DataFrame,
    review: reviews.ReviewFn | None = None,
    max_iterations: int = 5,
    k: int = 5,
) -> dict[str, DataFrame]:
    """results, trace, runs (one row per profile) and rejected profiles with their violations."""
    valid, rejected = validation.split_valid(profiles, validation.profile_rules())
    if activities is not None:
        valid = valid.join(ranking.activity_masks(activities), "profile_id", "left")
    trace, results = reviews.feedback_loop(valid, catalog, review, max_iterations, k)
    runs = trace.filter(F.col("stop_reason").isNotNull()).select(
        "profile_id", "iteration", "confidence", "stop_reason"
    )
    return {"results": results, "trace": trace, "runs": runs, "rejected": rejected}
