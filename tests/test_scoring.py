"""Rubric components on edge rows, bounds, and agreement with a plain-Python rubric."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from matricula import fixed_values as V
from matricula.functions import numeric as N
from matricula.functions import text as T
from matricula.operators import ranking, validation
from tests_support import (
    PROFILE_SCHEMA, UNI_SCHEMA, frame, make_profiles, make_universities, plain_rank,
)

L = F.lit


def num(x):
    return F.lit(x).cast("double")


def test_peaked_is_highest_near_the_match_and_decays_both_ways(one):
    at, above, far_above, below = one(
        *[N.peaked(num(g), V.GPA_SIGMA) for g in (0.0, 0.1, 1.0, -1.0)]
    )
    assert at == 1.0 and above <= 1.0
    assert far_above < above and below < far_above


def test_sat_counts_only_when_both_sides_have_one(one):
    both, gpa_only = one(N.academic_fit(num(1.0), num(0.5)), N.academic_fit(num(1.0), num(None)))
    assert (both, gpa_only) == (0.75, 1.0)


@pytest.mark.parametrize(
    "home,state,sticker,in_state,expected",
    [
        ("CA", "NY", 30000.0, 10000.0, 20000.0),
        ("ny", "NY", 30000.0, 10000.0, 0.0),
        (None, "NY", 30000.0, 10000.0, 0.0),
        ("CA", None, 30000.0, 10000.0, 0.0),
        ("CA", "NY", None, 10000.0, 0.0),
        ("CA", "NY", 30000.0, None, 0.0),
        ("CA", "NY", 9000.0, 10000.0, 0.0),
    ],
)
def test_out_of_state_premium(one, home, state, sticker, in_state, expected):
    (got,) = one(
        N.out_of_state_premium(
            L(home).cast("string"), L(state).cast("string"), num(sticker), num(in_state)
        )
    )
    assert got == expected


@pytest.mark.parametrize(
    "owed,cap,expected",
    [(None, 10.0, 0.5), (30000.0, None, 0.5), (90000.0, None, 0.0), (5.0, 10.0, 1.0),
     (15.0, 10.0, 0.5), (50.0, 10.0, 0.0), (3.0, 0.0, 0.0)],
)
def test_cost_fit(one, owed, cap, expected):
    assert one(N.cost_fit(num(owed), num(cap))) == (expected,)


def test_place_match_unstated_is_full(one):
    empty = F.array().cast("array<string>")
    assert one(
        N.place_match(empty, L("West")),
        N.place_match(L(None).cast("array<string>"), L("West")),
        N.place_match(F.array(L("West")), L("West")),
        N.place_match(F.array(L("South")), L("West")),
    ) == (1.0, 1.0, 1.0, 0.0)


def _culture(prefs, school):
    p = {a: num(prefs.get(a, 0.5)) for a in V.CULTURE_AXES}
    i = {a: N.axis_importance(p[a]) for a in V.CULTURE_AXES}
    return N.culture_fit(p, i, N.culture_weight(p), {a: num(school.get(a, 0.5)) for a in V.CULTURE_AXES})


def test_culture_is_closeness_not_dot_product(one):
    assert one(
        _culture({}, {"collab": 0.0}),
        _culture({"collab": 0.0}, {"collab": 0.0}),
        _culture({"collab": 1.0}, {"collab": 0.0}),
    ) == (0.5, 1.0, 0.0)


def test_personality_skips_axes_without_school_data(one):
    args = (num(1.0), num(0.0), N.axis_importance(num(1.0)), N.axis_importance(num(0.0)))
    assert one(
        N.personality_fit(*args, num(None), L(None).cast("int")),
        N.personality_fit(*args, num(0.0), L(None).cast("int")),
        N.personality_fit(*args, num(None), L(50000)),
    ) == (0.5, 1.0, 0.0)


@pytest.mark.parametrize(
    "gpa,avg,rate,expected",
    [(None, 3.0, 0.01, None), (4.0, 3.0, 0.15, "extreme_reach"), (3.0, 3.2, 0.5, "reach"),
     (3.5, 3.0, None, "safety"), (3.0, 3.05, None, "target")],
)
def test_admit_tier(one, gpa, avg, rate, expected):
    assert one(N.admit_tier(num(gpa), num(avg), num(rate))) == (expected,)


def test_zero_weights_do_not_divide_by_zero(one):
    w = {c: num(0.0) for c in V.COMPONENTS}
    assert one(N.rubric(w, N.weight_total(w), {c: num(1.0) for c in V.COMPONENTS})) == (0.0,)


def test_activity_rules(one):
    first, none, case = one(
        T.subjects_of_mask(T.activity_mask(L("robot research"))), T.subjects_of_mask(T.activity_mask(L("xyz"))),
        T.activity_text(L("Chess"), L(""), L(None).cast("string")),
    )
    assert first == list(V.ACTIVITY_SUBJECTS[0][1]) and none == [] and case == "chess"
    lab, label = one(T.activity_mask(L("my lab work")), T.activity_mask(L("élab label")))
    assert lab == 2 and label == 0


@settings(max_examples=40, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(parts=st.lists(st.sampled_from(
    [w[i:j] for p, _ in V.ACTIVITY_SUBJECTS for w in [a.replace(r"\b", "") for a in p.split("|")] for i, j in ((0, 99), (1, 99), (0, -1))] + [" ", "é", "x"]
), max_size=12))
def test_one_pass_mask_equals_separate_searches(one, parts):
    text = "".join(parts)
    want = sum(1 << i for i, (p, _) in enumerate(V.ACTIVITY_SUBJECTS) if re.search(p, text))
    assert one(T.activity_mask(L(text))) == (want,)


ACTS = {0: ["robot club", "band"], 1: ["band"], 2: ["nothing here"], 5: ["code", "code", "varsity swim"]}


@pytest.mark.parametrize(
    "rows,broadcast_rows,feedback",
    [(256, 1000, None), (7, 1000, {"cost": 1.5, "academic": 0.5}), (7, 0, None)],
)
def test_rank_equals_plain_python(spark, rows, broadcast_rows, feedback):
    """Same ranking for one pack or many, broadcast or shuffled, with and without feedback."""
    unis, profiles = make_universities(), make_profiles()
    catalog, people = frame(spark, unis, UNI_SCHEMA), frame(spark, profiles, PROFILE_SCHEMA)
    acts = spark.createDataFrame([(p, t) for p, ts in ACTS.items() for t in ts], "profile_id bigint, text string")
    people = people.join(ranking.activity_masks(acts), "profile_id", "left")
    fb = None
    if feedback:
        fb = people.select("profile_id", F.create_map(*[L(x) for kv in feedback.items() for x in kv]).alias("feedback"))
    got = ranking.rank_top_k(people, catalog, 6, fb, packed=ranking.pack_catalog(catalog, rows), broadcast_rows=broadcast_rows).collect()
    by_profile = {}
    for r in got:
        by_profile.setdefault(r["profile_id"], {})[r["rank"]] = (r["id"], r["score"])
    for p in profiles:
        want = plain_rank(p, unis, ACTS.get(p["profile_id"], []), feedback)[:6]
        have = [by_profile[p["profile_id"]][i + 1] for i in range(len(want))]
        assert [h[0] for h in have] == [w[0] for w in want]
        assert all(abs(h[1] - w[1]) <= 1e-6 for h, w in zip(have, want))


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    gpa=st.floats(0, 4), sat=st.one_of(st.none(), st.integers(400, 1600)),
    cap=st.one_of(st.none(), st.floats(0, 1e5)), x=st.floats(0, 1), y=st.floats(0, 1),
)
def test_scores_stay_in_bounds_and_sorted(spark, gpa, sat, cap, x, y):
    profile = dict(
        profile_id=1, gpa=gpa, sat=sat, intended_major="Law", max_tuition=cap, home_state="CA", scope="both",
        institution_type=None, intensity=x, scale=y, **{f"pf_{a}": y for a in V.CULTURE_AXES},
    )
    catalog = frame(spark, make_universities(20), UNI_SCHEMA)
    rows = ranking.rank_top_k(frame(spark, [profile], PROFILE_SCHEMA), catalog, 20).orderBy("rank").collect()
    assert len(rows) == 20
    assert [(-r["score"], r["id"]) for r in rows] == sorted((-r["score"], r["id"]) for r in rows)
    assert all(0 <= r[c] <= 1 for r in rows for c in (*V.COMPONENTS, "score"))


def test_validation_lists_every_broken_rule(spark):
    rows = make_universities(3)
    rows[0].update(avg_gpa=4.5, avg_sat=1700, type="Trade")
    df = frame(spark, rows, UNI_SCHEMA).withColumn("name", F.col("id"))
    good, bad = validation.split_valid(df, validation.university_rules())
    assert good.count() == 2
    assert set(bad.first()["violations"]) == {"avg_gpa", "avg_sat", "type"}
    inside, outside = spark.sql("select map('x', 1.0d) a, map('x', 1.6d) b").select(
        validation.feedback_rule("a"), validation.feedback_rule("b")
    ).first()
    assert inside is True and outside is False


def test_no_pairs_cross_a_shuffle(spark):
    """Profiles are partitioned once; scoring and ranking follow in the same stage."""
    catalog, people = frame(spark, make_universities(), UNI_SCHEMA), frame(spark, make_profiles(), PROFILE_SCHEMA)
    plan = ranking.rank_top_k(people, catalog, 5)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    top = plan.split("hashpartitioning(profile_id")
    assert len(top) == 2, "one shuffle on profile_id"
    assert "WindowGroupLimit" in top[0]


def test_pairs_of_a_task_are_bounded(spark, monkeypatch):
    """More profiles make more ranking tasks, not larger ones; the ranking stays the same."""
    catalog, people = frame(spark, make_universities(), UNI_SCHEMA), frame(spark, make_profiles(), PROFILE_SCHEMA)
    want = sorted(ranking.rank_top_k(people, catalog, 5).collect())
    n, pairs = people.select("profile_id").distinct().count(), 2 * catalog.count()
    monkeypatch.setattr(ranking, "PAIRS_PER_TASK", pairs)
    got = ranking.rank_top_k(people, catalog, 5)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // 2))
    assert "hashpartitioning(profile_id#" in (plan := got._jdf.queryExecution().executedPlan().toString())
    assert f", {tasks})" in plan.split("hashpartitioning(profile_id")[1].split("\n")[0]
    assert ranking.ranking_tasks(people, 1000 * pairs) == 1000 * n
    assert sorted(got.collect()) == want
