"""Name, slug and title normalisation."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matricula import fixed_values as V


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def fold_ascii(text: Column) -> Column:
    """NFKD fold to ASCII. Spark has no Unicode normalisation function.

    The helper is a local function, so it travels to the executors by value.
    """

    def fold(values: pd.Series) -> pd.Series:
        return values.map(
            lambda t: t
            if t is None or t.isascii()
            else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode("ascii")
        )

    return F.pandas_udf(fold, T.StringType())(text)


def normalize_name(name: Column) -> Column:
    """Key that folds the naming habits of the catalog and of the federal file."""
    folded = F.regexp_replace(F.trim(F.lower(name)), "[–—]", "-")
    folded = F.regexp_replace(folded, r",\s*", "-")
    folded = F.regexp_replace(folded, r"-main campus$", "")
    folded = F.regexp_replace(folded, r"(?U)\bthe\b|\bat\b", "")
    return F.regexp_replace(folded, r"[^a-z0-9]+", "")


def slugify(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def slugify_folded(text: Column) -> Column:
    return slugify(fold_ascii(text))


def match_name(name: Column) -> Column:
    """Person-name key: accents, parentheticals and punctuation set aside."""
    bare = F.regexp_replace(fold_ascii(name), r"\s*\(.*?\)", "")
    return collapse(F.lower(F.regexp_replace(bare, "[^A-Za-z ]", " ")))


def institution_key(name: Column) -> Column:
    """Institution-name key; equal keys mean the same name. Null for a blank name."""
    key = collapse(F.regexp_replace(F.lower(name), "[^a-z0-9 ]", " "))
    return F.when(name != "", key)


def city_state(location: Column) -> Column:
    """State code of `City, ST`, else null."""
    state = F.upper(F.regexp_extract(F.trim(location), V.CITY_STATE_PATTERN, 2))
    return F.nullif(state, F.lit(""))


def control_type(kind: Column) -> Column:
    return F.nullif(F.lower(F.trim(kind)), F.lit(""))


def classify_role(title: Column) -> Column:
    """True for an academic rank, False for a clear staff title, else null."""
    return (
        F.when(F.trim(title) == "", F.lit(None).cast("boolean"))
        .when(title.rlike("(?iU)" + V.ACADEMIC_TITLE), F.lit(True))
        .when(title.rlike("(?iU)" + V.ADMIN_TITLE), F.lit(False))
    )


def activity_text(name: Column, kind: Column | None = None, about: Column | None = None) -> Column:
    parts = [c for c in (name, kind, about) if c is not None]
    return F.lower(F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts]))


def matches_any(text: Column, pattern: str) -> Column:
    """`text rlike pattern` for an alternation of plain words and whole words.

    Words become substring tests; on long texts these measured faster than one
    alternation, flat or prefix-grouped, tried at every position.
    """
    hit = None
    for alternative in pattern.split("|"):
        word = alternative.replace(r"\b", "")
        test = text.contains(word)
        if word != alternative:  # whole word: the boundary check runs on containing texts only
            test = test & text.rlike("(?U)" + alternative)
        hit = test if hit is None else hit | test
    return hit


def word_mask(text: Column, patterns: Sequence[str]) -> Column:
    """Bit i set when pattern i occurs in the text."""
    mask = F.lit(0).cast("bigint")
    for i, pattern in enumerate(patterns):
        mask = mask + F.when(matches_any(text, pattern), F.lit(1 << i)).otherwise(F.lit(0))
    return mask


def has_bit(mask: Column, i: int) -> Column:
    return mask.bitwiseAND(F.lit(1 << i)) != 0


def activity_mask(text: Column) -> Column:
    """Bit i set when activity pattern i matches; computed once per text, before any join."""
    return word_mask(text, [pattern for pattern, _ in V.ACTIVITY_SUBJECTS]).cast("int")


def subject_mask(majors_lower: Column) -> Column:
    """Bit i set when the school lists a subject paired with activity pattern i."""
    mask = F.lit(0)
    for i, (_, subjects) in enumerate(V.ACTIVITY_SUBJECTS):
        wanted = F.array(*[F.lit(s.lower()) for s in subjects])
        mask = mask + F.when(F.arrays_overlap(majors_lower, wanted), 1 << i).otherwise(0)
    return mask.cast("int")


def subjects_of_mask(mask: Column) -> Column:
    """Subjects of the first matching activity pattern; empty array when none matches."""
    ladder = None
    for i, (_, subjects) in enumerate(V.ACTIVITY_SUBJECTS):
        hit, value = has_bit(mask, i), F.array(*[F.lit(s) for s in subjects])
        ladder = F.when(hit, value) if ladder is None else ladder.when(hit, value)
    return ladder.otherwise(F.array().cast("array<string>"))


def method_label(sitemap: Column, department: Column, heuristic: Column, search: Column) -> Column:
    parts = F.concat_ws(
        "+",
        F.when(sitemap, "sitemap"),
        F.when(department, "department"),
        F.when(heuristic, "heuristic"),
        F.when(search, "search"),
    )
    return F.coalesce(F.nullif(parts, F.lit("")), F.lit("none"))


def strip_boilerplate(name: Column, school_name: Column) -> Column:
    """Cut at a separator when the tail is the school's name, part of it, or contains it."""
    school = F.lower(F.trim(school_name))
    ladder = None
    for sep in V.BOILERPLATE_SEPARATORS:
        at = F.locate(sep, name)
        tail = F.lower(F.trim(F.substring(name, at + F.lit(len(sep)), F.length(name))))
        hit = (at > 0) & (tail != "") & (school.contains(tail) | tail.contains(school))
        head = blank_to_null(F.substring_index(name, sep, 1))
        ladder = F.when(hit, head) if ladder is None else ladder.when(hit, head)
    return ladder.otherwise(blank_to_null(name))


def bool_cell(flag: Column) -> Column:
    return F.coalesce(flag.cast("string"), F.lit(""))


def is_empty_text(value: Column) -> Column:
    """Null or one of the marker words that mean "nothing found"."""
    return value.isNull() | F.lower(F.trim(value)).isin(*V.EMPTY_MARKERS)


def is_empty_list(values: Column) -> Column:
    return values.isNull() | F.forall(values, is_empty_text)
