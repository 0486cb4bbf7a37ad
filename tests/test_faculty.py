"""Quality gates, coverage cells, extraction outcomes, enrichment joins."""

import pytest
from pyspark.sql import functions as F

from matricula.operators import enrichment as E
from matricula.operators import faculty as Y
from matricula.plans.faculty_directory import enumerate_profiles, faculty_tables

PROF = (
    "school_id string, school_name string, professor_name string, title string, is_faculty boolean, "
    "profile_url string, extraction_confidence double"
)


def profs(spark, rows):
    return spark.createDataFrame(rows, PROF)


def test_gates_are_inclusive_and_only_false_excludes(spark):
    df = profs(spark, [
        ("s", "S", "a", "Provost", None, "u1", 0.9), ("s", "S", "b", "Provost", True, "u2", 0.5),
        ("s", "S", "c", None, None, "u3", 0.49), ("s", "S", "d", "Gardener", None, "u4", 0.5), ("s", "S", "e", "Professor", False, "u5", 1.0),
    ])
    assert {r["professor_name"]: r["verdict"] for r in Y.judge(df).collect()} == {
        "a": "non_faculty", "b": "kept", "c": "below_confidence", "d": "kept", "e": "non_faculty"}


A_NAMES = ["mia-abbot", "noor-al-amin", "jo-lund-avery", "max-archer", "kit-ames", "rui-alba", "una-ashby", "sol-arden"]
MIXED = ["ann-lee", "bob-cole", "cy-dean", "di-evans", "ed-fox", "flo-gray", "gus-hill", "hal-ivy", "ida-jones"]


@pytest.mark.parametrize(
    "slugs,expected",
    [(A_NAMES, True), (A_NAMES[:7], False), (MIXED, False), ([f"abbot-{n}" for n in "bcdefghij"], True), ([f"x{i}" for i in range(12)], False)],
)
def test_one_letter_directories_are_flagged(spark, slugs, expected):
    df = spark.createDataFrame([("s", f"https://x.edu/people/{x}/?q=1") for x in slugs], "school_id string, profile_url string")
    assert Y.partial_schools(df).first()["partial"] is expected


def test_last_status_wins_and_missing_log_is_unknown(spark):
    raw = spark.createDataFrame(
        [("s", "u1", 500, 1), ("s", "u1", 200, 2), ("s", "u2", 404, 1), ("s", None, 200, 3)],
        "school_id string, profile_url string, http_status int, seq int",
    )
    assert tuple(Y.source_counts(raw).first()) == ("s", 2, 1)
    df = profs(spark, [("s", "S", "a", None, None, "u1", 0.9), ("t", "T", "b", None, None, "u9", 0.9)])
    with_log = {r["school_id"]: r for r in Y.coverage_report(df, raw, max_profiles=2).collect()}
    assert (with_log["s"]["source_urls_fetched"], with_log["s"]["source_urls_dead"], with_log["s"]["capped_at_limit"], with_log["s"]["incomplete"]) == ("2", "1", "true", "true")
    assert (with_log["t"]["source_urls_fetched"], with_log["t"]["capped_at_limit"], with_log["t"]["incomplete"]) == ("unknown", "false", "false")
    without = Y.coverage_report(df, None).first()
    assert (without["source_urls_dead"], without["capped_at_limit"], without["incomplete"]) == ("unknown", "unknown", "false")


def test_slug_collisions_get_a_suffix(spark):
    ids = spark.createDataFrame([("A b",), ("a-b",), ("É",), ("--",)], "school_id string")
    got = {r["school_id"]: r["slug"] for r in Y.output_slugs(ids).collect()}
    assert got == {"A b": "a-b", "a-b": "a-b-a-b-2", "É": "e", "--": "--"}


PAGE = "school_id string, profile_url string, directory_url string, http_status int, fetched_at timestamp, html string"


def test_faculty_tables(spark):
    ld = '<html><script type="application/ld+json">{"@type":"Person","name":"Ann Lee | S College"}</script><body>ann@s.edu</body></html>'
    pages = spark.createDataFrame(
        [("s", "u1", "d", 200, None, ld), ("s", "u2", "d", 404, None, ld), ("x", "u3", "d", 200, None, "<html><h1>Directory</h1>"), ("s", "u4", "d", 200, None, None)], PAGE
    )
    schools = spark.createDataFrame([("s", "S College")], "school_id string, name string")
    out = faculty_tables(pages, schools)
    rows = {r["profile_url"]: r for r in out["rows"].collect()}
    assert {u: r["outcome"] for u, r in rows.items()} == {"u1": "extracted", "u2": "non_200", "u3": "no_name", "u4": "failed"}
    assert rows["u1"]["professor_name"] == "Ann Lee" and rows["u1"]["email"] == "ann@s.edu" and rows["u3"]["school_name"] == "x"
    assert tuple(out["summary"].select("processed", "skipped", "failed").first()) == (1, 2, 1)
    assert out["kept"].count() == 1 and out["coverage"].first()["professors_in_csv"] == 1


def test_proposals_are_checked(spark):
    good = {k: "" for k in Y.PROPOSAL_KEYS} | {"is_profile": "true", "professor_name": "Ann", "confidence": "0.8"}
    cases = [
        (good, None), ({k: v for k, v in good.items() if k not in ("notes", "email")}, "missing required field(s): email, notes"),
        (good | {"is_profile": "yes"}, "'is_profile' must be a boolean"), (good | {"confidence": "high"}, "'confidence' must be a number"),
        (good | {"professor_name": " "}, "'is_profile' is true but 'professor_name' is missing or empty"),
        (good | {"is_profile": "false", "professor_name": ""}, None),
    ]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, p map<string,string>")
    got = df.orderBy("i").select(Y.proposal_problem(F.col("p")), Y.coerce_proposal(F.col("p"))).collect()
    assert [g[0] for g in got] == [want for _, want in cases]
    assert got[0][1]["confidence"] == 0.8 and got[5][1]["professor_name"] is None and got[5][1]["confidence"] == 0.0


def test_cluster_replaces_the_walk(spark):
    pages = spark.createDataFrame(
        [("https://a.edu/faculty", 200, '<html><a href="/people/x">X Y</a>'), ("https://b.edu/faculty", 200, '<html><a href="/people/y">Y Z</a>')],
        "url string, status int, body string",
    )
    dirs = spark.createDataFrame([("a", "https://a.edu/faculty", 0), ("b", "https://b.edu/faculty", 0)], "school_id string, url string, ord int")
    clusters = spark.createDataFrame([("b", f"https://b.edu/people/{i}/") for i in range(5)], "school_id string, url string")
    ledger = spark.createDataFrame([("https://b.edu/people/0", "done")], "profile_url string, status string")
    chosen, counts = enumerate_profiles(dirs, pages, clusters, ledger, cap=3)
    got = {}
    for r in chosen.collect():
        got.setdefault(r["school_id"], set()).add(r["profile_url"])
    assert got == {"a": {"https://a.edu/people/x"}, "b": {f"https://b.edu/people/{i}" for i in (1, 2, 3)}}
    assert {r["school_id"]: r["cap_skipped"] for r in counts.collect()} == {"a": 0, "b": 1}


def test_rendered_pages_extend_a_cut_off_listing(spark):
    link = lambda names: "<html>" + "".join(f'<a href="/people/{n}">{n.replace("-", " ")}</a>' for n in names)
    base = [f"https://{h}.edu/faculty" for h in ("part", "full", "none")]
    static = spark.createDataFrame([(base[0], 200, link(A_NAMES)), (base[1], 200, link(MIXED)), (base[2], 200, "<html>")], "url string, status int, body string")
    rendered = spark.createDataFrame([(u, 200, link([*A_NAMES, "zed-zu"])) for u in base], "url string, status int, body string")
    dirs = spark.createDataFrame([(h, u, 0) for h, u in zip(("part", "full", "none"), base)], "school_id string, url string, ord int")
    no_cluster = spark.createDataFrame([], "school_id string, url string")
    ledger = spark.createDataFrame([], "profile_url string, status string")
    chosen, _ = enumerate_profiles(dirs, static, no_cluster, ledger, rendered=rendered)
    got = {}
    for r in chosen.collect():
        got.setdefault(r["school_id"], []).append((r["rank"], r["profile_url"].rsplit("/", 1)[1]))
    assert [n for _, n in sorted(got["part"])] == [*A_NAMES, "zed-zu"]
    assert [n for _, n in sorted(got["full"])] == MIXED and len(got["none"]) == 9


def test_institution_needs_an_agreeing_homepage(spark):
    schools = spark.createDataFrame(
        [("k", "Harbor College", "https://www.harbor.edu"), ("i", "Prairie University", "prairie.edu"), ("n", "No Home", None), ("z", "None", "z.edu")],
        "school_key string, name string, homepage string",
    )
    cands = spark.createDataFrame(
        [("k", 1, "g", "Harbor Freight", "https://freight.ca"), ("k", 2, "b", "Harbor", "http://online.harbor.edu/x"), ("i", 1, "iu", "PRAIRIE  University.", "pu.edu"),
         ("n", 1, "top", "Other", "o.org"), ("n", 2, "second", "No Home", "p.org"), ("z", 1, "bad", "Other", "o.org")],
        "school_key string, cand_rank int, institution_id string, display_name string, homepage_url string",
    )
    got = {r["school_key"]: (r["institution_id"], r["prio"]) for r in E.resolve_institutions(schools, cands).collect()}
    assert got == {"k": ("b", 1), "i": ("iu", 2), "n": ("top", 3)}


def test_later_duplicate_honour_wins_within_a_school(spark):
    person = "array<struct<name:string,awards:array<string>>>"
    tier = spark.createDataFrame([("s", [("José Li", ["old"]), ("Jose Li (poet)", ["new"]), ("Ann", [])]), ("t", None)], f"school_id string, notable_faculty {person}")
    assert [(r["match_name"], r["awards"]) for r in E.honours(tier).collect()] == [("jose li", ["new"])]


def test_tier_compaction_keeps_empties_and_the_last_record(spark):
    log = spark.createDataFrame([("s", ["a"], 1), ("s", [], 2), ("t", ["b"], 1)], "school_id string, people array<string>, seq int")
    assert {r["school_id"]: r["people"] for r in E.compact_tier(log).collect()} == {"s": [], "t": ["b"]}
