"""Numeric and scoring expressions. Every function maps Columns to a Column.

Because they take plain Columns, the same expressions run over joined rows and
over the fields of a struct inside a higher-order function (see
`operators.ranking`).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from matricula import fixed_values as V


def clamp(value: Column, low: float, high: float) -> Column:
    """Clamp that keeps null null (`least`/`greatest` alone would skip it)."""
    bounded = F.greatest(F.lit(low), F.least(F.lit(high), value))
    return F.when(value.isNotNull(), bounded)


def clamp01(value: Column) -> Column:
    return clamp(value, 0.0, 1.0)


def bounded01(value: Column) -> Column:
    """0..1 clamp for a value already known not to be null: one evaluation, no branch."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def round6(value: Column) -> Column:
    """Non-negative double to six decimals, half up, in primitive arithmetic.

    `round` on a double goes through BigDecimal; seven of those per scored pair
    cost more than the score itself. The two differ only on exact ties.
    """
    return F.floor(value * F.lit(1e6) + F.lit(0.5)).cast("double") / F.lit(1e6)


def confidence_or_zero(text: Column) -> Column:
    """Clamp an untrusted confidence to 0..1; anything that is not a number is 0."""
    return F.coalesce(clamp01(_try_double(text)), F.lit(0.0))


def _try_double(text: Column) -> Column:
    return text.try_cast("double")


def js_round(value: Column) -> Column:
    """Round half towards +infinity, as display code does."""
    return F.floor(value + F.lit(0.5))


# ----------------------------------------------------------- cleaning -------
def parse_number(text: Column) -> Column:
    """All-string cell to double; the missing markers and non-numbers are null.

    A trailing `d`/`f` suffix is legal for a Spark cast but is not a number in
    the source format, so it is rejected first.
    """
    cell = F.trim(text)
    usable = ~cell.isin(*V.MISSING_CELLS) & ~cell.rlike("[dDfF]$")
    return F.when(usable, _try_double(cell))


def text_or_null(text: Column) -> Column:
    cell = F.trim(text)
    return F.when(~cell.isin(*V.MISSING_CELLS), cell)


def net_price(public: Column, private: Column, editorial: Column | None = None) -> Column:
    """Public, else private figure when positive, else the editorial estimate."""
    observed = observed_net_price(public, private)
    return observed if editorial is None else F.coalesce(observed, editorial)


def observed_net_price(public: Column, private: Column) -> Column:
    pub, priv = parse_number(public), parse_number(private)
    return F.coalesce(F.when(pub > 0, pub), F.when(priv > 0, priv))


def size_band(enrollment: Column) -> Column:
    return (
        F.when(enrollment.isNull(), "medium")
        .when(enrollment < V.SMALL_MAX, "small")
        .when(enrollment < V.MEDIUM_MAX, "medium")
        .otherwise("large")
    )


# ------------------------------------------------------------ components ----
def bell(gap: Column, sigma: float) -> Column:
    return F.exp(-(gap * gap) / F.lit(2 * sigma * sigma))


def peaked(gap: Column, sigma: float, bell_value: Column | None = None) -> Column:
    """Gaussian around a zero gap with a small bounded bonus above it.

    Pass `bell_value` when the gaussian is already bound to a column.
    """
    base = bell(gap, sigma) if bell_value is None else bell_value
    bonus = F.lit(V.OVERMATCH_BONUS) * F.least(gap / F.lit(sigma), F.lit(V.OVERMATCH_BONUS_CAP))
    return bounded01(base + F.when(gap >= 0, bonus).otherwise(F.lit(0.0)))


def academic_fit(on_gpa: Column, on_sat: Column) -> Column:
    """Mean of the GPA and SAT terms; `on_sat` is null unless both sides have a SAT."""
    both = (on_gpa + on_sat) / F.lit(2.0)
    return round6(F.when(on_sat.isNotNull(), both).otherwise(on_gpa))


def out_of_state_premium(
    home_state: Column, state: Column, sticker: Column, in_state: Column
) -> Column:
    """Tuition gap an out-of-state student owes; 0 unless every input is known."""
    applies = (F.upper(home_state) != F.upper(state)) & sticker.isNotNull() & in_state.isNotNull()
    return F.when(applies, F.greatest(F.lit(0.0), sticker - in_state)).otherwise(F.lit(0.0))


def cost_fit(owed: Column, cap: Column) -> Column:
    """`owed` is net price plus residency premium; null (unknown price) is neutral."""
    over = (owed - cap) / F.greatest(cap, F.lit(1.0))
    share = F.when(cap.isNull(), owed / F.lit(V.REFERENCE_PRICE)).when(owed <= cap, 0.0).otherwise(over)
    return F.when(owed.isNull(), F.lit(0.5)).otherwise(round6(bounded01(F.lit(1.0) - share)))


def place_match(preferred: Column, actual: Column) -> Column:
    return (
        F.when(preferred.isNull() | (F.size(preferred) == 0), F.lit(1.0))
        .when(F.array_contains(preferred, actual), F.lit(1.0))
        .otherwise(F.lit(0.0))
    )


def fit(
    intended_lower: Column,
    majors_lower: Column,
    regions: Column,
    region: Column,
    settings: Column,
    setting: Column,
) -> Column:
    """`intended_lower` and `majors_lower` are lower-cased once, outside the pairing."""
    major = F.when(F.array_contains(majors_lower, intended_lower), F.lit(1.0)).otherwise(
        F.lit(V.MAJOR_MISS)
    )
    return round6(
        F.lit(0.5) * major
        + F.lit(0.25) * place_match(regions, region)
        + F.lit(0.25) * place_match(settings, setting)
    )


def _sum(parts: Sequence[Column]) -> Column:
    total = parts[0]
    for part in parts[1:]:
        total = total + part
    return total


def axis_importance(preference: Column) -> Column:
    """How far a preference was moved from centre, 0..1."""
    return F.abs(preference - F.lit(0.5)) * 2


def culture_weight(prefs: Mapping[str, Column]) -> Column:
    """Total importance over the culture axes; depends on the profile only."""
    return _sum([axis_importance(prefs[a]) for a in V.CULTURE_AXES])


def culture_fit(
    prefs: Mapping[str, Column],
    importance: Mapping[str, Column],
    weight: Column,
    culture: Mapping[str, Column],
) -> Column:
    """Agreement weighted by how far each axis was moved from centre; none moved is 0.5."""
    weighted = _sum(
        [
            importance[a] * (F.lit(1.0) - F.abs(prefs[a] - culture[a]))
            for a in V.CULTURE_AXES
        ]
    )
    return F.when(weight == 0, F.lit(0.5)).otherwise(round6(bounded01(weighted / weight)))


def personality_fit(
    intensity: Column,
    scale: Column,
    intensity_importance: Column,
    scale_importance: Column,
    acceptance_rate: Column,
    enrollment: Column,
) -> Column:
    """Axes without school data drop out; no usable axis is neutral."""
    w_int = F.when(acceptance_rate.isNotNull(), intensity_importance).otherwise(0.0)
    w_scale = F.when(enrollment.isNotNull(), scale_importance).otherwise(0.0)
    selectivity = F.lit(1.0) - acceptance_rate
    campus = bounded01(enrollment / F.lit(V.SCALE_TOP))
    p_int = F.coalesce(
        (F.lit(1.0) - F.abs(intensity - selectivity)) * intensity_importance, F.lit(0.0)
    )
    p_scale = F.when(
        enrollment.isNotNull(), (F.lit(1.0) - F.abs(scale - campus)) * scale_importance
    ).otherwise(F.lit(0.0))
    total = w_int + w_scale
    return F.when(total == 0, F.lit(0.5)).otherwise(round6(bounded01((p_int + p_scale) / total)))


def activity_fit(counted_masks: Column, subject_mask: Column) -> Column:
    """Share of activities whose matched patterns pair with a school subject.

    `counted_masks` is array<struct<m, n>>: bit i of `m` says pattern i matched
    the text of `n` activities; bit i of the subject mask says the school
    teaches a subject of pattern i. No activities is neutral.
    """

    def total(of: Column) -> Column:
        return F.aggregate(of, F.lit(0).cast("bigint"), lambda acc, x: acc + x["n"])

    hits = total(F.filter(counted_masks, lambda x: x["m"].bitwiseAND(subject_mask) != 0))
    share = hits / total(counted_masks).cast("double")
    return F.when(
        counted_masks.isNull() | (F.size(counted_masks) == 0), F.lit(0.5)
    ).otherwise(round6(bounded01(F.lit(0.5) + F.lit(0.5) * share)))


def resolved_weight(component: str, override: Column | None, feedback: Column | None) -> Column:
    """Default <- profile override, times clamped feedback for that component."""
    weight = F.lit(V.DEFAULT_WEIGHTS[component])
    if override is not None:
        weight = F.coalesce(override, weight)
    if feedback is not None:
        weight = weight * F.coalesce(feedback, F.lit(1.0))
    return weight


def weight_total(weights: Mapping[str, Column]) -> Column:
    """Sum of the component weights, 1 in place of 0; depends on the profile only."""
    total = _sum([weights[c] for c in V.COMPONENTS])
    return F.when(total == 0, F.lit(1.0)).otherwise(total)


def rubric(weights: Mapping[str, Column], total: Column, components: Mapping[str, Column]) -> Column:
    return round6(bounded01(_sum([weights[c] * components[c] for c in V.COMPONENTS]) / total))


def admit_tier(gpa: Column, avg_gpa: Column, acceptance_rate: Column) -> Column:
    delta = avg_gpa - gpa
    return (
        F.when(gpa.isNull(), F.lit(None).cast("string"))
        .when(acceptance_rate <= V.EXTREME_REACH_RATE, "extreme_reach")
        .when(delta >= V.ADMIT_TIER_DELTA, "reach")
        .when(delta <= -V.ADMIT_TIER_DELTA, "safety")
        .otherwise("target")
    )


# ------------------------------------------------------------ major finder --
def major_score(course_share: Column, activity_hit: Column, axis_score: Column) -> Column:
    return js_round(
        F.lit(100)
        * (
            course_share * F.lit(V.W_COURSES)
            + F.when(activity_hit, 1.0).otherwise(0.0) * F.lit(V.W_ACTIVITIES)
            + axis_score * F.lit(V.W_AXES)
        )
    ).cast("int")


def axis_score(axes: Sequence[Column], targets: Sequence[Column]) -> Column:
    distance = _sum([F.abs(a - t) for a, t in zip(axes, targets, strict=True)]) / 3
    return F.lit(1.0) - distance
