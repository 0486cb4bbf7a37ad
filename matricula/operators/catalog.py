"""Catalog build: tier merge with per-field provenance, dedupe and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matricula import fixed_values as V
from matricula.functions import nested, numeric, text
from matricula.operators.common import first_per_key, global_position


# ------------------------------------------------------------- tier 1 -------
def drop_excluded(records: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Leave out institutions that no longer stand on their own."""
    if excluded is None:
        return records.filter(F.col("name").isNull() | ~F.col("name").isin(*V.EXCLUDED_INSTITUTIONS))
    return records.join(excluded.select("name"), "name", "left_anti")


def dedupe_by_name(records: DataFrame, seq: str = "seq") -> DataFrame:
    """First entry per name keeps its scalars; majors are unioned in first-seen order.

    Majors are reduced to one row per (name, major) before they meet, so a name
    repeated any number of times never gathers its copies in one task.
    """
    scalars = [c for c in records.columns if c not in ("name", "majors")]
    firsts = records.groupBy("name").agg(
        F.min_by(F.struct(*scalars), F.col(seq)).alias("_first")
    )
    majors = (
        records.select("name", seq, F.posexplode("majors").alias("_pos", "_major"))
        .groupBy("name", "_major")
        .agg(F.min(F.struct(F.col(seq), F.col("_pos"))).alias("_at"))
        .groupBy("name")
        .agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct("_at", "_major"))), lambda m: m["_major"]
            ).alias("majors")
        )
    )
    return firsts.join(majors, "name", "left").select(
        "name",
        *[F.col("_first")[c].alias(c) for c in scalars],
        F.coalesce("majors", F.array().cast("array<string>")).alias("majors"),
    )


def dedupe_by_slug(records: DataFrame, slug: str = "slug", seq: str = "seq") -> DataFrame:
    return first_per_key(records, [slug], [F.col(seq)])


def duplicate_slugs(records: DataFrame, slug: str = "slug") -> DataFrame:
    """How many rows the slug dedupe collapses."""
    return records.agg(
        (F.count(slug) - F.count_distinct(slug)).cast("bigint").alias("duplicate_slugs")
    )


# ------------------------------------------------------- federal statistics --
def resolve_keys(tier1: DataFrame, aliases: DataFrame | None) -> DataFrame:
    """Add `_key`, the alias-resolved normalised name.

    Rows outside the USA never match; their key is unique instead of null so a
    large foreign share does not pile up in one shuffle partition.
    """
    named = tier1
    source: Column = F.col("name")
    if aliases is not None:
        named = tier1.join(aliases.select("name", "alias"), "name", "left")
        source = F.coalesce("alias", "name")
    keyed = named.withColumn(
        "_key",
        F.when(F.col("country") == "USA", text.normalize_name(source)).otherwise(
            F.concat(F.lit("~"), F.col("id"))
        ),
    )
    return keyed.drop("alias") if aliases is not None else keyed


def reduce_scorecard(scorecard: DataFrame, keyed_tier1: DataFrame) -> DataFrame:
    """Semi-join the federal file to the names the catalog asks for, used columns only."""
    used = [c for c in scorecard.columns if c in V.SCORECARD_COLUMNS or c == "seq"]
    wanted = keyed_tier1.filter(F.col("country") == "USA").select("_key").distinct()
    return (
        scorecard.select(*used)
        .withColumn("_key", text.normalize_name(F.col("INSTNM")))
        .join(wanted, "_key", "left_semi")
    )


def join_scorecard(
    tier1: DataFrame, scorecard: DataFrame, aliases: DataFrame | None = None
) -> DataFrame:
    """Left join on the resolved name, first federal row per name wins."""
    keyed = resolve_keys(tier1, aliases)
    right = first_per_key(reduce_scorecard(scorecard, keyed), ["_key"], [F.col("seq")])
    right = right.drop("seq").withColumn("_matched", F.lit(True))
    return keyed.join(right, "_key", "left").withColumn(
        "_matched", F.coalesce("_matched", F.lit(False))
    )


def unmatched_us_names(tier1: DataFrame, scorecard: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    keyed = resolve_keys(tier1, aliases).filter(F.col("country") == "USA")
    keys = scorecard.select(text.normalize_name(F.col("INSTNM")).alias("_key"))
    return keyed.join(keys, "_key", "left_anti").select("id", "name")


def _measured(value: Column, missing: str | Column) -> Column:
    return F.when(value.isNotNull(), F.lit("observed")).otherwise(missing)


def enrich(joined: DataFrame) -> DataFrame:
    """Observed federal values over editorial ones, with the origin of each field.

    `joined` is the output of `join_scorecard`: tier-1 columns, federal columns
    (all strings) and `_matched`.
    """
    absent_unless_us = F.when(F.col("country") == "USA", "absent").otherwise("not_applicable")
    out = joined.withColumns(
        {
            "_sat": numeric.parse_number(F.col("SAT_AVG")),
            "_enrolled": numeric.parse_number(F.col("UGDS")),
            "_observed_net": numeric.observed_net_price(F.col("NPT4_PUB"), F.col("NPT4_PRIV")),
            "acceptance_rate": numeric.parse_number(F.col("ADM_RATE")),
            "sticker_tuition": numeric.parse_number(F.col("TUITIONFEE_OUT")),
            "tuition_in_state": numeric.parse_number(F.col("TUITIONFEE_IN")),
            "state": numeric.text_or_null(F.col("STABBR")),
            "programs": F.when(F.col("_matched"), nested.programs_from_columns()),
            "outcomes": nested.optional_struct(V.OUTCOME_COLUMNS),
            "population": nested.optional_struct(V.POPULATION_COLUMNS),
        }
    )
    provenance = {
        "avg_gpa": F.lit("editorial"),
        "culture": F.lit("editorial"),
        "region": F.lit("editorial"),
        "setting": F.lit("editorial"),
        "type": F.lit("editorial"),
        "net_price": F.when(F.col("_observed_net").isNotNull(), "observed")
        .when(F.col("net_price").isNotNull(), "editorial")
        .otherwise("absent"),
        "avg_sat": _measured(F.col("_sat"), absent_unless_us),
        "acceptance_rate": _measured(F.col("acceptance_rate"), "absent"),
        "enrollment": _measured(F.col("_enrolled"), "absent"),
        "sticker_tuition": _measured(F.col("sticker_tuition"), "absent"),
        "tuition_in_state": _measured(F.col("tuition_in_state"), absent_unless_us),
        "state": _measured(F.col("state"), absent_unless_us),
        "programs": _measured(F.col("programs"), absent_unless_us),
        "outcomes": _measured(F.col("outcomes"), "absent"),
        "population": _measured(F.col("population"), absent_unless_us),
    }
    return out.select(
        "id",
        F.col("UNITID").alias("unitid"),
        "name", "country", "location", "state", "region", "setting", "type", "avg_gpa",
        F.col("_sat").cast("int").alias("avg_sat"),
        "acceptance_rate",
        F.coalesce("_observed_net", F.col("net_price").cast("double")).alias("net_price"),
        "sticker_tuition", "tuition_in_state", "programs",
        F.col("_enrolled").cast("int").alias("enrollment"),
        numeric.size_band(F.coalesce("_enrolled", "enrollment_editorial")).alias("size"),
        "majors", "culture", "outcomes", "population",
        numeric.text_or_null(F.col("INSTURL")).alias("url"),
        numeric.text_or_null(F.col("NPCURL")).alias("net_price_calculator_url"),
        F.map_from_arrays(
            F.array(*[F.lit(k) for k in provenance]), F.array(*provenance.values())
        ).alias("provenance"),
    )


# ------------------------------------------------------------ enrichment ----
def _with_provenance(field: str, value: Column) -> Column:
    return F.map_concat("provenance", F.create_map(F.lit(field), value))


def attach_details(catalog: DataFrame, details: DataFrame) -> DataFrame:
    """Left join `details(id, details map)`; an empty map counts as absent."""
    joined = catalog.join(
        details.select("id", F.col("details").alias("_details")), "id", "left"
    )
    present = F.coalesce(F.size("_details") > 0, F.lit(False))
    source = F.coalesce(F.try_element_at("_details", F.lit("_source")), F.lit("curated"))
    label = F.lit("editorial")
    for name, origin in V.DETAIL_PROVENANCE.items():
        label = F.when(source == name, origin).otherwise(label)
    return joined.withColumns(
        {
            "details": F.when(present, F.map_filter("_details", lambda k, _: k != "_source")),
            "provenance": _with_provenance(
                "details", F.when(present, label).otherwise("absent")
            ),
        }
    ).drop("_details")


def attach_people(
    catalog: DataFrame, tier: DataFrame, field: str, fields: tuple[str, ...], found: str
) -> DataFrame:
    """Attach a people list and keep three states apart.

    A list means searched and found, an empty list searched and found nobody,
    null never searched or outside the USA. `tier(id, <field> array<struct>)`.
    """
    right = tier.select(
        F.col("id").alias("_tid"),
        F.coalesce(
            nested.allow_fields(F.col(field), fields),
            F.expr("array()").cast(
                "array<struct<" + ",".join(_struct_fields(tier, field, fields)) + ">>"
            ),
        ).alias(field),
        F.lit(True).alias("_hit"),
    )
    joined = catalog.join(
        right, (F.col("id") == F.col("_tid")) & (F.col("country") == "USA"), "left"
    )
    state = (
        F.when(F.col("_hit"), found)
        .when(F.col("country") == "USA", "absent")
        .otherwise("not_applicable")
    )
    return joined.withColumn("provenance", _with_provenance(field, state)).drop("_tid", "_hit")


def _struct_fields(tier: DataFrame, field: str, fields: tuple[str, ...]) -> list[str]:
    element = tier.schema[field].dataType.elementType
    return [f"`{f}`:{element[f].dataType.simpleString()}" for f in fields]


def attach_notable(catalog: DataFrame, tier: DataFrame) -> DataFrame:
    return attach_people(catalog, tier, "notable_faculty", V.NOTABLE_FIELDS, "web_verified")


def attach_active(catalog: DataFrame, tier: DataFrame) -> DataFrame:
    return attach_people(catalog, tier, "active_faculty", V.ACTIVE_FIELDS, "observed")


def provenance_rows(catalog: DataFrame) -> DataFrame:
    return catalog.select("id", F.explode("provenance").alias("field", "origin"))


# ------------------------------------------------------------- statistics ---
def catalog_stats(catalog: DataFrame) -> DataFrame:
    return catalog.agg(
        F.count(F.lit(1)).alias("size"),
        F.count_if(F.col("setting") == "rural").alias("rural"),
        F.count_if(F.coalesce(F.size("details") > 0, F.lit(False))).alias("with_details"),
    )


# ---------------------------------------------------------------- loading ---
def stale_ids(existing: DataFrame, catalog: DataFrame, min_rows: int = V.MIN_SAFE_ROWS) -> DataFrame:
    """Ids to prune. A catalog too small to trust refuses instead of emptying the table."""
    size = catalog.limit(min_rows).count()
    if size < min_rows:
        raise ValueError(f"refusing to prune: catalog has only {size} rows, expected {min_rows}")
    return existing.select("id").join(catalog.select("id"), "id", "left_anti")


def upsert(existing: DataFrame, catalog: DataFrame, prune: bool = True) -> DataFrame:
    """Next snapshot: catalog rows win; rows absent from the catalog stay unless pruned."""
    if prune:
        stale_ids(existing, catalog)
        return catalog
    kept = existing.join(catalog.select("id"), "id", "left_anti")
    return catalog.unionByName(kept, allowMissingColumns=True)


# --------------------------------------------------------------- worklist ---
def worklist(catalog: DataFrame, details: DataFrame, batch_size: int) -> DataFrame:
    """Schools still lacking a faculty or research section, most selective first, in batches."""
    sections = details.select(
        "id",
        (~text.is_empty_text(F.col("faculty"))).alias("has_faculty"),
        (~text.is_empty_text(F.col("research"))).alias("has_research"),
    )
    todo = (
        catalog.select("id", "name", "location", "acceptance_rate")
        .join(sections, "id", "left")
        .withColumn("has_research", F.coalesce("has_research", F.lit(False)))
        .filter(~(F.coalesce("has_faculty", F.lit(False)) & F.col("has_research")))
        .drop("has_faculty")
    )
    placed = global_position(todo, [F.asc_nulls_last("acceptance_rate"), F.col("id")])
    return placed.withColumn(
        "batch", (F.floor((F.col("position") - 1) / batch_size) + 1).cast("int")
    )
