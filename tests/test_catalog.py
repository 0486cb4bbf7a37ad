"""Catalog build, merges and upserts, checked on edge rows and against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from matricula import fixed_values as V
from matricula import schemas
from matricula.operators import catalog as C
from matricula.operators import details as D
from matricula.plans.catalog_build import build_catalog

CULTURE = {a: 0.5 for a in V.CULTURE_AXES}


def tier1(spark, *rows):
    base = dict(location="X, GA", region="South", setting="rural", type="Private", avg_gpa=3.5, net_price=None,
                enrollment_editorial=None, majors=["Art"], culture=CULTURE)
    return spark.createDataFrame([{**base, **r} for r in rows], schemas.TIER1)


def scorecard(spark, *rows):
    cols = [*V.SCORECARD_COLUMNS, "seq"]
    schema = ", ".join(f"`{c}` string" for c in V.SCORECARD_COLUMNS) + ", seq bigint"
    return spark.createDataFrame([tuple({**r, "seq": i}.get(c) for c in cols) for i, r in enumerate(rows)], schema)


@pytest.fixture(scope="module")
def built(spark):
    t1 = tier1(
        spark,
        dict(id="a", name="Cedar Hill", country="USA", net_price=100.0),
        dict(id="b", name="Beta", country="USA", enrollment_editorial=20000.0),
        dict(id="c", name="Cedar Hill", country="Canada"),
        dict(id="d", name="Aliased", country="USA"),
    )
    sc = scorecard(
        spark,
        dict(INSTNM="Cedar Hill", UNITID="1", SAT_AVG="1200.9", ADM_RATE="0.5", UGDS="900", STABBR="GA", NPT4_PUB="NULL", NPT4_PRIV="-1",
             PCIP11="0.12345", PCIP14="0", PCIP52="0.9", UGDS_WOMEN="1.0"),
        dict(INSTNM="cedar hill", UNITID="2"),
        dict(INSTNM="Real Name", UNITID="3", NPT4_PRIV="7"),
    )
    aliases = spark.createDataFrame([("Aliased", "Real Name")], "name string, alias string")
    details = spark.createDataFrame(
        [("a", {"_source": "estimated", "x": "1"}), ("b", {})], "id string, details map<string,string>"
    )
    person = ("P", None, ["f"], "current", 3, [], "wikipedia", "u")
    notable = spark.createDataFrame(
        [("a", [person]), ("b", []), ("c", [person])], f"id string, notable_faculty array<{schemas.NOTABLE_PERSON}>"
    )
    catalog, unmatched = build_catalog(t1, sc, aliases, details, notable)
    return {r["id"]: r for r in catalog.collect()}, [r["name"] for r in unmatched.collect()]


def test_first_federal_row_wins_and_us_only(built):
    rows, unmatched = built
    assert rows["a"]["unitid"] == "1" and rows["c"]["unitid"] is None and rows["d"]["unitid"] == "3"
    assert unmatched == ["Beta"]


def test_observed_over_editorial(built):
    rows, _ = built
    a, d = rows["a"], rows["d"]
    assert a["avg_sat"] == 1200 and a["enrollment"] == 900 and a["size"] == "small"
    assert a["net_price"] == 100.0 and a["provenance"]["net_price"] == "editorial"
    assert d["net_price"] == 7.0 and d["provenance"]["net_price"] == "observed"
    assert rows["b"]["size"] == "large" and rows["b"]["provenance"]["net_price"] == "absent"


def test_absent_differs_from_not_applicable(built):
    rows, _ = built
    for field in ("avg_sat", "state", "programs", "population", "tuition_in_state", "notable_faculty", "active_faculty"):
        assert rows["c"]["provenance"][field] == "not_applicable", field
    assert rows["b"]["provenance"]["avg_sat"] == "absent"
    assert len(rows["a"]["provenance"]) == 18


def test_programs_tristate_and_order(built):
    rows, _ = built
    assert [(p["name"], p["share"]) for p in rows["a"]["programs"]] == [
        ("Business, Management & Marketing", 0.9), ("Computer & Information Sciences", 0.1235)]
    assert rows["d"]["programs"] == [] and rows["b"]["programs"] is None


def test_optional_structs(built):
    rows, _ = built
    assert rows["a"]["outcomes"] is None and rows["a"]["population"]["women_share"] == 1.0


def test_people_tristate(built):
    rows, _ = built
    assert len(rows["a"]["notable_faculty"]) == 1 and rows["b"]["notable_faculty"] == [] and rows["c"]["notable_faculty"] is None
    assert rows["a"]["provenance"]["notable_faculty"] == "web_verified"


def test_details_source(built):
    rows, _ = built
    assert rows["a"]["details"] == {"x": "1"} and rows["a"]["provenance"]["details"] == "editorial"
    assert rows["b"]["details"] is None and rows["b"]["provenance"]["details"] == "absent"


def test_dedupe_by_name_unions_majors_in_order(spark):
    df = spark.createDataFrame(
        [("N", 1, "first", ["a", "b"]), ("N", 2, "second", ["b", "c", "a", "d"]), ("M", 3, "m", [])],
        "name string, seq int, tag string, majors array<string>",
    )
    got = {r["name"]: (r["tag"], r["majors"]) for r in C.dedupe_by_name(df).collect()}
    assert got == {"N": ("first", ["a", "b", "c", "d"]), "M": ("m", [])}


def test_upsert_and_prune_guard(spark):
    old = spark.createDataFrame([(str(i), "old") for i in range(150)], "id string, v string")
    new = spark.createDataFrame([(str(i), "new") for i in range(100, 220)], "id string, v string")
    assert C.upsert(old, new).count() == 120
    kept = C.upsert(old, new, prune=False)
    assert kept.count() == 220 and kept.filter("v = 'old'").count() == 100
    assert C.stale_ids(old, new).count() == 100
    with pytest.raises(ValueError, match="refusing"):
        C.stale_ids(old, new.limit(5))


def plain_merge(details, batches):
    """Sequential merge, batch after batch."""
    empty = lambda v: v is None or v.strip().lower() in V.EMPTY_MARKERS
    details = {k: dict(v) for k, v in details.items()}
    stats = {}
    for name in sorted(batches):
        s = stats[name] = dict(added=0, skipped_empty=0, skipped_existing=0, new_schools=0)
        for school, e in batches[name].items():
            src = [x for x in e["src"] if x.startswith("http")]
            got = {k: e[k] for k in ("faculty", "research") if not empty(e[k])}
            if not got or not src:
                s["skipped_empty"] += 1
            elif school not in details:
                details[school] = {**got, "src": src}
                s["new_schools"] += 1
                s["added"] += 1
            else:
                wrote = False
                for k, v in got.items():
                    if not empty(details[school].get(k)):
                        s["skipped_existing"] += 1
                    else:
                        details[school][k] = v
                        wrote = True
                if wrote:
                    s["added"] += 1
                    details[school]["src"] = list(dict.fromkeys([*details[school].get("src", []), *src]))
    return details, stats


@pytest.mark.parametrize("seed", range(3))
def test_batch_merge_equals_sequential(spark, seed):
    rng = random.Random(seed)
    pick = lambda *xs: rng.choice(xs)
    details = {f"s{i}": {"faculty": pick("hand", "N/A", None), "research": pick("lab", "", None), "src": ["https://h"]} for i in range(8)}
    batches = {
        f"b{n}": {
            f"s{i}": {"faculty": pick(f"f{n}{i}", "none found", None), "research": pick(f"r{n}{i}", " TBD ", None),
                      "src": pick([f"https://{n}"], ["ftp://x"], [], ["https://h", f"http://{i}"])}
            for i in rng.sample(range(14), 9)
        }
        for n in range(4)
    }
    want, stats = plain_merge(details, batches)
    ddf = spark.createDataFrame(
        [(k, v["faculty"], v["research"], v["src"], None) for k, v in details.items()],
        "school_id string, faculty string, research string, src array<string>, retrieved string",
    )
    bdf = spark.createDataFrame(
        [(b, s, e["faculty"], e["research"], e["src"], None, i) for b, es in batches.items() for i, (s, e) in enumerate(es.items())],
        "batch string, school_id string, faculty string, research string, src array<string>, retrieved string, seq int",
    )
    got = {r["school_id"]: r for r in D.merge_details(ddf, bdf).collect()}
    assert set(got) == set(want)
    for k, w in want.items():
        assert got[k]["faculty"] == w.get("faculty") and got[k]["research"] == w.get("research") and got[k]["src"] == w["src"], k
    rows = {r["batch"]: r for r in D.merge_statistics(ddf, bdf).collect()}
    for b, s in stats.items():
        assert {k: rows[b][k] for k in s} == s, b
    assert rows[None]["added"] == sum(s["added"] for s in stats.values())


def test_worklist_positions_are_global(spark):
    n = 97
    catalog = spark.createDataFrame(
        [(f"i{i:03d}", "n", "l", None if i % 9 == 0 else (i * 37 % 50) / 50) for i in range(n)],
        "id string, name string, location string, acceptance_rate double",
    ).repartition(7)
    details = spark.createDataFrame([("i001", "x", "y"), ("i002", "x", "n/a")], "id string, faculty string, research string")
    rows = C.worklist(catalog, details, 10).collect()
    key = lambda r: (r["acceptance_rate"] is None, r["acceptance_rate"] or 0, r["id"])
    want = sorted(rows, key=key)
    assert len(rows) == n - 1 and [r["position"] for r in want] == list(range(1, n))
    assert all(r["batch"] == (r["position"] - 1) // 10 + 1 for r in rows)
