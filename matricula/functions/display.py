"""Formatting of values that may legitimately be absent."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from matricula import fixed_values as V
from matricula.functions.numeric import js_round


def _whole(value: Column) -> Column:
    return js_round(value).cast("bigint")


def format_value(value: Column, kind: str) -> Column:
    if kind == "percent":
        return F.concat(_whole(value * 100).cast("string"), F.lit("%"))
    if kind == "money":
        return F.concat(F.lit("$"), F.format_number(_whole(value), 0))
    if kind == "decimal":
        return F.format_string("%.2f", value.cast("double"))
    if kind == "score":
        return _whole(value).cast("string")
    return F.format_number(_whole(value), 0)


def stat_text(value: Column, provenance: Column, kind: str) -> Column:
    """Missing reads `n/a` where it does not apply and an em dash where it is a gap."""
    return (
        F.when(value.isNotNull(), format_value(value, kind))
        .when(provenance == "not_applicable", "n/a")
        .otherwise("—")
    )


def stat_note(value: Column, provenance: Column) -> Column:
    return (
        F.when(
            value.isNull(),
            F.when(provenance == "not_applicable", "not used at this school"),
        )
        .when(provenance == "editorial", V.PROVENANCE_NOTES["editorial"])
        .when(provenance == "web_verified", V.PROVENANCE_NOTES["web_verified"])
    )


def tier_label(tier: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for pair in V.TIER_LABELS.items() for x in pair])
    return F.try_element_at(labels, tier)
