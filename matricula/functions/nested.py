"""Arrays, maps and structs: degree families, research records, entity claims."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from matricula import fixed_values as V
from matricula.functions.numeric import parse_number


def drop_nulls(values: Column) -> Column:
    return F.filter(values, lambda v: v.isNotNull())


def programs_from_columns(families: Mapping[str, str] = V.CIP_FAMILIES) -> Column:
    """Wide family columns to array<struct<name, share>>, largest share first.

    A zero or missing share is left out. Sorting by a (-share, name) key keeps
    the order inside compiled code instead of a comparator.
    """
    cells = F.array(
        *[
            F.struct(parse_number(F.col(c)).alias("raw"), F.lit(name).alias("name"))
            for c, name in families.items()
        ]
    )
    kept = F.filter(cells, lambda p: p["raw"].isNotNull() & (p["raw"] != 0))
    return order_programs(
        F.transform(
            kept, lambda p: F.struct(p["name"].alias("name"), F.round(p["raw"], 4).alias("share"))
        )
    )


def order_programs(programs: Column) -> Column:
    keyed = F.transform(programs, lambda p: F.struct((-p["share"]).alias("k"), p["name"].alias("n")))
    return F.transform(
        F.array_sort(keyed), lambda p: F.struct(p["n"].alias("name"), (-p["k"]).alias("share"))
    )


def optional_struct(columns: Mapping[str, str]) -> Column:
    """Struct of parsed cells, or null when every cell is missing."""
    values = {name: parse_number(F.col(c)) for name, c in columns.items()}
    return F.when(
        F.coalesce(*values.values()).isNotNull(),
        F.struct(*[v.alias(name) for name, v in values.items()]),
    )


def awards_degrees_in(programs: Column, family: Column) -> Column:
    """True / false when measured, null when programs were never measured."""
    return F.when(programs.isNotNull(), F.exists(programs, lambda p: p["name"] == family))


def family_map() -> Column:
    pairs: list[Column] = []
    for field, families in V.FIELD_TO_FAMILIES.items():
        pairs += [F.lit(field), F.array(*[F.lit(f) for f in families])]
    return F.create_map(*pairs)


def families_of(field: Column) -> Column:
    """Families a research field belongs to; an unknown field claims none."""
    return F.coalesce(F.try_element_at(family_map(), field), F.array().cast("array<string>"))


def researchers_in(people: Column, family: Column) -> Column:
    return F.filter(
        people,
        lambda p: F.exists(
            F.coalesce(p["fields"], F.array().cast("array<string>")),
            lambda f: F.array_contains(families_of(f), family),
        ),
    )


def research_families(people: Column, programs: Column) -> Column:
    """Awarded families with a researcher in them, program order kept; unmeasured is empty."""
    names = F.transform(programs, lambda p: p["name"])
    covered = F.flatten(
        F.transform(people, lambda p: F.flatten(F.transform(p["fields"], families_of)))
    )
    return F.coalesce(
        F.filter(names, lambda n: F.array_contains(covered, n)),
        F.array().cast("array<string>"),
    )


def affiliated_recently(affiliations: Column, institution: Column, since: Column) -> Column:
    """The author's own record names the institution in a recent year; no record keeps them."""
    none_known = affiliations.isNull() | (F.size(affiliations) == 0)
    return none_known | F.coalesce(
        F.exists(
            affiliations,
            lambda a: (F.substring_index(a["institution"]["id"], "/", -1) == institution)
            & F.coalesce(F.exists(a["years"], lambda y: y >= since), F.lit(False)),
        ),
        F.lit(False),
    )


def plausible_here(fields: Column, families: Column) -> Column:
    """Judged on the primary field; unknown families keep everyone, no field drops."""
    open_door = families.isNull() | (F.size(families) == 0)
    return open_door | (
        (F.size(fields) > 0) & F.arrays_overlap(families_of(F.get(fields, F.lit(0))), families)
    )


def research_fields(topics: Column) -> Column:
    names = F.transform(topics, lambda t: t["field"]["display_name"])
    return F.array_distinct(F.filter(names, lambda n: n.isNotNull() & (n != "")))


def research_topics(topics: Column, limit: int = 4) -> Column:
    names = F.transform(F.slice(topics, 1, limit), lambda t: t["display_name"])
    return F.filter(names, lambda n: n.isNotNull() & (n != ""))


def last_active_year(counts: Column) -> Column:
    return F.array_max(
        F.transform(F.filter(counts, lambda c: c["works_count"] > 0), lambda c: c["year"])
    )


def claim_ids(claims: Column, prop: str) -> Column:
    """Item ids asserted for a property; entries without a value are skipped."""
    listed = F.coalesce(
        F.try_element_at(claims, F.lit(prop)), F.array().cast("array<struct<id:string>>")
    )
    return F.transform(F.filter(listed, lambda c: c["id"].isNotNull()), lambda c: c["id"])


def is_human(claims: Column) -> Column:
    return F.array_contains(claim_ids(claims, "P31"), V.HUMAN_QID)


def life_status(claims: Column) -> Column:
    """A recorded death makes the person historical, with or without a known date."""
    deaths = F.coalesce(F.size(F.try_element_at(claims, F.lit("P570"))), F.lit(0))
    return F.when(deaths > 0, "historical").otherwise("current")


def sitelink_count(sitelinks: Column) -> Column:
    return F.coalesce(F.size(F.map_keys(sitelinks)), F.lit(0))


def occupation_labels(labels: Column, limit: int = 4) -> Column:
    kept = F.filter(labels, lambda v: ~F.lower(v).isin(*V.UNINFORMATIVE_OCCUPATIONS))
    return F.slice(kept, 1, limit)


def award_labels(labels: Column, limit: int = 6) -> Column:
    return F.slice(F.array_distinct(labels), 1, limit)


def ordered_union(first: Column, second: Column) -> Column:
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(first, empty), F.coalesce(second, empty)))


def allow_fields(people: Column, fields: Sequence[str]) -> Column:
    """Project array<struct> to an allowlist of fields; anything else cannot leak."""
    return F.transform(people, lambda p: F.struct(*[p[f].alias(f) for f in fields]))


def scalar_or_list(json_text: Column) -> Column:
    """JSON list or bare text to a list; any other JSON value is empty."""
    listed = F.from_json(json_text, "array<string>")
    return (
        F.when(json_text.startswith("["), listed)
        .when(json_text.rlike(r"^\s*(\{.*|null|true|false|-?\d.*)$"), F.array().cast("array<string>"))
        .when(json_text.startswith('"'), F.array(F.get_json_object(F.concat(F.lit('{"v":'), json_text, F.lit("}")), "$.v")))
        .when(json_text.isNotNull(), F.array(json_text))
        .otherwise(F.array().cast("array<string>"))
    )
