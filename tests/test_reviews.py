"""Trust boundary, stop rules and the feedback loop with scripted reviewers."""

import pytest
from pyspark.sql import functions as F

from matricula.operators import reviews
from matricula.plans.recommend import recommend
from workload import ranking as _  # noqa: F401
from workload.registry import REGISTRY as QUERIES
from workload.views import Tables
from tests_support import PROFILE_SCHEMA, UNI_SCHEMA, frame, make_profiles, make_universities, plain_rank


@pytest.fixture(scope="module")
def data(spark):
    unis, profiles = make_universities(40), make_profiles()
    catalog = frame(spark, unis, UNI_SCHEMA).withColumn("name", F.concat(F.lit("School "), "id"))
    return unis, profiles, catalog, frame(spark, profiles, PROFILE_SCHEMA)


def test_sanitize(spark):
    cands = spark.createDataFrame([(1, x) for x in "abcd"] + [(2, "a")], "profile_id bigint, id string")
    revs = spark.createDataFrame(
        [(1, ["d", "zz", "b", "d", "a", "c"], "1.5", {"cost": "9", "fit": "0", "academic": "0.7", "culture": "x"}, {"a": "n", "zz": "m"}),
         (2, [], "bad", None, None), (3, ["a"], None, {}, {})],
        reviews.REVIEW_SCHEMA,
    )
    got = {r["profile_id"]: r for r in reviews.sanitize(revs, cands, 3).collect()}
    assert got[1]["keep_ids"] == ["d", "b", "a"] and got[1]["confidence"] == 1.0
    assert got[1]["feedback"] == {"cost": 1.5, "fit": 0.5, "academic": 0.7} and got[1]["notes"] == {"a": "n"}
    assert got[2]["keep_ids"] == [] and got[2]["confidence"] == 0.0 and got[2]["feedback"] == {}
    assert got[3]["keep_ids"] == [] and got[3]["confidence"] == 0.0


def test_sanitized_reviews_rank_once(spark):
    plan = QUERIES["sanitized_reviews"].run(Tables(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    assert "customer.parquet" not in plan and "c_custkey" not in plan


@pytest.mark.parametrize(
    "i,top,prev,kept,conf,expected",
    [(0, ["a"], None, ["a"], 0.95, "R1_converged"), (0, ["a"], None, ["b"], 0.9, "R2_confident"),
     (1, ["a"], ["a"], ["b"], 0.1, "R3_no_change"), (4, ["a"], ["b"], ["b"], 0.1, "R4_iteration_cap"),
     (1, ["a", "b"], ["b", "a"], ["b", "a"], 0.1, None), (1, [], [], [], 0.6, "R3_no_change"), (0, [], None, [], 0.6, None)],
)
def test_stop_rules(spark, i, top, prev, kept, conf, expected):
    row = spark.createDataFrame([(i, top, prev, kept, conf)], "i int, t array<string>, p array<string>, k array<string>, c double")
    c = F.col
    assert row.select(reviews.stop_reason(c("i"), 5, c("t"), c("p"), c("k"), c("c"))).first()[0] == expected


def test_default_review_converges_at_once(data):
    unis, profiles, catalog, people = data
    trace, results = reviews.feedback_loop(people, catalog, k=4)
    steps = trace.collect()
    assert {(s["iteration"], s["stop_reason"], s["confidence"]) for s in steps} == {(0, "R1_converged", 0.6)}
    rows = results.collect()
    for p in profiles:
        got = sorted((r["position"], r["id"]) for r in rows if r["profile_id"] == p["profile_id"])
        assert [g[1] for g in got] == [w[0] for w in plain_rank(p, unis, [])[:4]]
    assert all(r["rationale"].startswith("Strong on ") for r in rows)


def test_scripted_feedback_replaces_weights(data):
    unis, profiles, catalog, people = data
    fb = {"cost": 1.5, "academic": 0.5}

    def review(ranked, i):
        base = reviews.default_review(ranked, i, 3)
        if i == 0:
            return base.select("profile_id", F.array(F.lit("nobody")).alias("keep_ids"), F.lit("0.2").alias("confidence"),
                               F.create_map(F.lit("cost"), F.lit("4"), F.lit("academic"), F.lit("0.1")).alias("weight_feedback"),
                               F.create_map().cast("map<string,string>").alias("notes"))
        if i == 1:
            return base.withColumn("keep_ids", F.array().cast("array<string>")).withColumn("confidence", F.lit("0.95"))
        raise AssertionError("every profile has stopped")

    trace, results = reviews.feedback_loop(people, catalog, review, k=3)
    by = {(t["profile_id"], t["iteration"]): t for t in trace.collect()}
    rows = results.collect()
    for p in profiles:
        pid = p["profile_id"]
        first = [w[0] for w in plain_rank(p, unis, [])[:3]]
        second = [w[0] for w in plain_rank(p, unis, [], fb)[:3]]
        assert by[pid, 0]["top_ids"] == first and by[pid, 0]["stop_reason"] is None
        assert by[pid, 1]["top_ids"] == second and by[pid, 1]["stop_reason"] == "R2_confident"
        # nothing kept: fall back to the ranking in force
        assert [r["id"] for r in sorted((r for r in rows if r["profile_id"] == pid), key=lambda r: r["position"])] == second


def test_iteration_cap_and_no_candidates(data, spark):
    _, profiles, catalog, people = data
    lost = people.withColumn("institution_type", F.lit("Trade"))
    trace, results = reviews.feedback_loop(lost, catalog, k=3)
    assert {(t["iteration"], t["stop_reason"]) for t in trace.collect()} == {(0, None), (1, "R3_no_change")}
    assert results.count() == 0
    trace, _ = reviews.feedback_loop(lost, catalog, k=3, max_iterations=1)
    assert {t["stop_reason"] for t in trace.collect()} == {"R4_iteration_cap"}
    with pytest.raises(ValueError):
        reviews.feedback_loop(people, catalog, max_iterations=0)


def test_plan_rejects_invalid_profiles(data, spark):
    _, _, catalog, people = data
    acts = spark.createDataFrame([(1, "robot club")], "profile_id bigint, text string")
    out = recommend(people.withColumn("regions", F.array(F.lit("West"))).withColumn("settings", F.array().cast("array<string>")), acts, catalog, k=2)
    assert {r["profile_id"] for r in out["rejected"].collect()} == {3, 7, 11}
    assert out["runs"].count() == 9 and out["results"].count() == 18
