"""Row validation: one named rule per constraint, violations listed per row."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matricula import fixed_values as V


def _between(name: str, low: float, high: float | None = None) -> Column:
    value = F.col(name)
    bad = (value < low) if high is None else ((value < low) | (value > high))
    return ~F.coalesce(bad | F.isnan(value.cast("double")), F.lit(False))


def _required(name: str) -> Column:
    return F.col(name).isNotNull() & (F.length(F.col(name)) > 0)


def _one_of(name: str, values: tuple[str, ...]) -> Column:
    return F.coalesce(F.col(name).isin(*values), F.lit(False))


def university_rules() -> dict[str, Column]:
    return {
        "id": _required("id"),
        "name": _required("name"),
        "country": _required("country"),
        "state": F.coalesce(F.length("state") == 2, F.lit(True)),
        "region": _one_of("region", V.REGIONS),
        "setting": _one_of("setting", V.SETTINGS),
        "type": _one_of("type", V.INSTITUTION_TYPES),
        "avg_gpa": F.col("avg_gpa").isNotNull() & _between("avg_gpa", 0, 4),
        "avg_sat": _between("avg_sat", 400, 1600),
        "acceptance_rate": _between("acceptance_rate", 0, 1),
        "net_price": _between("net_price", 0),
        "sticker_tuition": _between("sticker_tuition", 0),
        "tuition_in_state": _between("tuition_in_state", 0),
        "enrollment": _between("enrollment", 0),
    }


def profile_rules() -> dict[str, Column]:
    rules = {
        "gpa": F.col("gpa").isNotNull() & _between("gpa", 0, 4),
        "sat": _between("sat", 400, 1600),
        "intended_major": _required("intended_major"),
        "max_tuition": _between("max_tuition", 0),
        "home_state": F.coalesce(F.length("home_state") == 2, F.lit(True)),
        "scope": _one_of("scope", V.SCOPES),
        "institution_type": F.col("institution_type").isNull()
        | F.col("institution_type").isin(*V.INSTITUTION_TYPES),
        "regions": F.coalesce(
            F.forall("regions", lambda r: r.isin(*V.REGIONS)), F.lit(True)
        ),
        "settings": F.coalesce(
            F.forall("settings", lambda s: s.isin(*V.SETTINGS)), F.lit(True)
        ),
    }
    for axis in (*[f"pf_{a}" for a in V.CULTURE_AXES], *V.PERSONALITY_AXES):
        rules[axis] = _between(axis, 0, 1)
    return rules


def feedback_rule(name: str = "feedback") -> Column:
    factors = F.map_values(F.col(name))
    return F.coalesce(
        F.forall(factors, lambda f: (f >= V.FEEDBACK_MIN) & (f <= V.FEEDBACK_MAX)), F.lit(True)
    )


def professor_rules() -> dict[str, Column]:
    return {
        "school_id": F.col("school_id").isNotNull(),
        "professor_name": F.col("professor_name").isNotNull(),
        "profile_url": F.col("profile_url").isNotNull(),
        "extraction_confidence": F.col("extraction_confidence").isNotNull()
        & _between("extraction_confidence", 0, 1),
    }


def with_violations(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    broken = F.array_compact(F.array(*[F.when(~rule, F.lit(n)) for n, rule in rules.items()]))
    return df.withColumn("violations", broken)


def split_valid(df: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with their violations)."""
    checked = with_violations(df, rules)
    return (
        checked.filter(F.size("violations") == 0).drop("violations"),
        checked.filter(F.size("violations") > 0),
    )


def violation_counts(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    return (
        with_violations(df, rules)
        .select(F.explode("violations").alias("rule"))
        .groupBy("rule")
        .agg(F.count(F.lit(1)).alias("n"))
    )
