"""The whole catalog build as one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame

from matricula.operators import catalog as C


def build_catalog(
    tier1: DataFrame,
    scorecard: DataFrame,
    aliases: DataFrame | None = None,
    details: DataFrame | None = None,
    notable: DataFrame | None = None,
    active: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(catalog, unmatched US names). An absent tier reads as an empty one."""
    spark = tier1.sparkSession
    from matricula import schemas

    details = details if details is not None else spark.createDataFrame([], "id string, details map<string,string>")
    notable = notable if notable is not None else spark.createDataFrame(
        [], f"id string, notable_faculty array<{schemas.NOTABLE_PERSON}>"
    )
    active = active if active is not None else spark.createDataFrame(
        [], f"id string, active_faculty array<{schemas.ACTIVE_PERSON}>"
    )
    enriched = C.enrich(C.join_scorecard(tier1, scorecard, aliases))
    catalog = C.attach_active(C.attach_notable(C.attach_details(enriched, details), notable), active)
    return catalog, C.unmatched_us_names(tier1, scorecard, aliases)
