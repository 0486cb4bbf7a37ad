"""Readers, writers and streams over temporary folders."""

import json

import pytest
from pyspark.sql import functions as F

from matricula import schemas
from matricula.operators import faculty as Y
from matricula.operators import ranking, validation
from matricula.sources import readers as R
from matricula.sources import sinks as S
from matricula.streaming import incremental as I
from tests_support import PROFILE_SCHEMA, UNI_SCHEMA, frame, make_profiles, make_universities


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_scorecard_csv_is_text_and_pruned(spark, tmp_path):
    p = put(tmp_path / "sc.csv", 'UNITID,INSTNM,IGNORED,SAT_AVG\n007,"A, ""B"" College",x,NA\n8,Second,y,1200\n')
    df = R.read_scorecard(spark, p)
    rows = df.orderBy("seq").collect()
    assert rows[0]["UNITID"] == "007" and rows[0]["INSTNM"] == 'A, "B" College' and rows[0]["SAT_AVG"] == "NA" and rows[0]["ADM_RATE"] is None
    plan = df.select("UNITID")._jdf.queryExecution().executedPlan().toString()
    assert "IGNORED" not in plan and "INSTNM" not in plan


def test_json_array_root(spark, tmp_path):
    good = put(tmp_path / "a.json", '\n [{"id":"x","majors":["m"]},\n{"id":"y"}]')
    assert {r["id"] for r in R.read_json_array(spark, good, schemas.TIER1).collect()} == {"x", "y"}
    with pytest.raises(ValueError, match="array"):
        R.read_json_array(spark, put(tmp_path / "b.json", '{"id":"x"}'), schemas.TIER1)


def test_keyed_json_and_absent_file(spark, tmp_path):
    p = put(tmp_path / "n.json", json.dumps({"a": {"notable_faculty": []}, "b": {"notable_faculty": [{"name": "N", "extra": 1}]}}))
    rows = {r["id"]: r["value"]["notable_faculty"] for r in R.read_keyed_json(spark, p, schemas.NOTABLE_ENTRY).collect()}
    assert rows["a"] == [] and rows["b"][0]["name"] == "N"
    assert R.read_keyed_json(spark, str(tmp_path / "none.json"), schemas.NOTABLE_ENTRY).count() == 0
    al = put(tmp_path / "al.json", json.dumps({"_note": "x", "A": "B"}))
    assert [tuple(r) for r in R.read_aliases(spark, al).collect()] == [("A", "B")]


LINES = '{"school_id":"s","professor_name":"A","profile_url":"u","extraction_confidence":0.5}\n\nnot json\n{"school_id":"s","professor_name":"B","profile_url":"v","extraction_confidence":1.5}\n'


def test_json_lines(spark, tmp_path):
    p = put(tmp_path / "p.jsonl", LINES)
    good, bad = R.read_json_lines_tolerant(spark, p, schemas.PROFESSOR, validation.professor_rules())
    assert str(good._jdf.queryExecution().optimizedPlan()).count("Relation [") == 1
    assert [r["professor_name"] for r in good.collect()] == ["A"] and bad.get == {"good": 1, "malformed": 2}
    unruled, bad = R.read_json_lines_tolerant(spark, p, schemas.PROFESSOR)
    assert unruled.count() == 2 and bad.get == {"good": 2, "malformed": 1}
    with pytest.raises(Exception):
        R.read_json_lines(spark, p, schemas.PROFESSOR).collect()
    assert R.read_json_lines(spark, put(tmp_path / "q.jsonl", LINES.split("\n")[0] + "\n\n"), schemas.PROFESSOR).count() == 1


def test_editorial_js(spark, tmp_path):
    put(tmp_path / "data2.js", 'const b=[{n:"Beta",loc:"B, NY",size:900}];')
    put(tmp_path / "data.js", 'const a = [\n{n:"Alpha",loc:"A, GA",ctry:"USA",size:1200,net:-5,gpa:.9,strengths:["x","y z"],v:{collab:.7,quirky: 0.25}},];')
    rows = R.read_editorial_js(spark, str(tmp_path / "data*.js")).orderBy("seq").collect()
    a, b = rows
    assert (a["name"], a["enrollment_editorial"], a["net_price"], a["avg_gpa"], a["majors"]) == ("Alpha", 1200, -5, 0.9, ["x", "y z"])
    assert a["culture"]["collab"] == 0.7 and a["culture"]["research"] is None and b["country"] is None and b["majors"] == []


def test_long_editorial_record(spark, tmp_path):
    name, majors = "N" * 100_000, ",".join(f'"m{i}"' for i in range(30_000))
    put(tmp_path / "data.js", f'x=[{{n:"{name}",strengths:[{majors}],v:{{collab:.7}}}},{{n:"Next",gpa:3}}];')
    first, second = R.read_editorial_js(spark, str(tmp_path / "data.js")).orderBy("seq").collect()
    assert first["name"] == name and len(first["majors"]) == 30_000 and first["culture"]["collab"] == 0.7
    assert second["name"] == "Next" and second["avg_gpa"] == 3


def test_scorecard_order_follows_files_and_lines(spark, tmp_path):
    from matricula.operators.common import first_per_key

    head = "UNITID,INSTNM\n"
    put(tmp_path / "s" / "a.csv", head + "".join(f"a{i},Same\n" for i in range(5)))
    put(tmp_path / "s" / "b.csv", head + "".join(f"b{i},Same\n" for i in range(20_000)))  # larger, so Spark packs it first
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        rows = R.read_scorecard(spark, str(tmp_path / "s"))
        assert rows.rdd.getNumPartitions() > 2
        assert [r["UNITID"] for r in first_per_key(rows, ["INSTNM"], [rows["seq"]]).collect()] == ["a0"]
        assert [r["UNITID"] for r in rows.orderBy("seq").select("UNITID").collect()] == [f"a{i}" for i in range(5)] + [f"b{i}" for i in range(20_000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_research_batches(spark, tmp_path):
    put(tmp_path / "batch-02.json", json.dumps({"s": {"faculty": "F2", "src": "https://one"}}))
    put(tmp_path / "batch-01.json", json.dumps({"s": {"research": "R1", "src": ["https://a", "ftp://b"], "_retrieved": "2020"}}))
    rows = R.read_research_batches(spark, str(tmp_path / "batch-*.json")).orderBy("batch").collect()
    assert [(r["batch"], r["src"], r["retrieved"]) for r in rows] == [("batch-01.json", ["https://a", "ftp://b"], "2020"), ("batch-02.json", ["https://one"], None)]


def test_relational_catalog_columns(spark):
    df = spark.createDataFrame([("a", '["m"]', '{"avg_sat":"observed"}', None)], "id string, majors string, provenance string, programs string")
    row = R.parse_catalog_columns(df).first()
    assert row["majors"] == ["m"] and row["provenance"] == {"avg_sat": "observed"} and row["programs"] is None


def test_seed_serves_failed_and_empty_loads(spark):
    seed = spark.range(2)
    boom = lambda: spark.read.parquet("/nowhere/at/all")
    assert [R.catalog_or_seed(f, seed)[1] for f in (boom, lambda: spark.range(0), lambda: spark.range(1))] == [True, True, False]


def test_ordered_json_is_stable(spark, tmp_path):
    df = spark.createDataFrame([(f"{i:02d}", i) for i in range(20)], "id string, v int")
    texts = []
    for n, shuffled in enumerate((df, df.repartition(5))):
        out = tmp_path / f"o{n}"
        S.write_ordered_json(shuffled, str(out), "id", single_file=True)
        texts.append(next(out.glob("*.json")).read_text())
    assert texts[0] == texts[1] and texts[0].startswith('{"id":"00"')


def test_snapshots(spark, tmp_path):
    root = str(tmp_path / "snap")
    first = spark.createDataFrame([(str(i), "a") for i in range(120)], "id string, v string")
    assert S.read_snapshot(spark, root) is None and S.publish_snapshot(first, root) == 1
    with pytest.raises(ValueError):
        S.publish_snapshot(first.limit(3), root)
    assert S.read_snapshot(spark, root).count() == 120
    second = spark.createDataFrame([(str(i), "b") for i in range(100, 230)], "id string, v string")
    assert S.publish_snapshot(second, root, prune=False) == 2
    now = S.read_snapshot(spark, root)
    assert now.count() == 230 and now.filter("v = 'b'").count() == 130
    (tmp_path / "snap" / "data-unfinished").mkdir()
    assert S.read_snapshot(spark, root).count() == 230, "a folder that no manifest names is ignored"
    assert S.read_snapshot(spark, root, version=1).filter("v = 'a'").count() == 120


def test_two_publishers_lose_nothing(spark, tmp_path, monkeypatch):
    """The second commits between the first's read and its commit; the first merges again."""
    root = str(tmp_path / "snap")
    rows = lambda a, b, v: spark.createDataFrame([(str(i), v) for i in range(a, b)], "id string, v string")
    S.publish_snapshot(rows(0, 10, "base"), root)
    commit, raced = S._commit, []

    def late(*args):
        if not raced:
            raced.append(True)
            assert S.publish_snapshot(rows(10, 20, "second"), root, prune=False) == 2
        return commit(*args)

    monkeypatch.setattr(S, "_commit", late)
    assert S.publish_snapshot(rows(5, 15, "first"), root, prune=False) == 3
    count = lambda n: {r["v"]: r["count"] for r in S.read_snapshot(spark, root, n).groupBy("v").count().collect()}
    assert count(2) == {"base": 10, "second": 10} and count(3) == {"base": 5, "first": 10, "second": 5}
    assert len(list((tmp_path / "snap").glob("data-*"))) == 3 and not list((tmp_path / "snap" / "_manifests").glob(".data*"))


def test_only_one_commit_of_a_version_wins(spark, tmp_path):
    root = str(tmp_path / "snap")
    assert S._commit(spark, root, 1, "data-a") and not S._commit(spark, root, 1, "data-b")
    assert (tmp_path / "snap" / "_manifests" / "v00000001").read_text() == "data-a"


def test_recommendation_log(spark, tmp_path):
    results = spark.createDataFrame([(1, 2, "b", "B", 0.5, "r", None), (1, 1, "a", "A", 0.6, "r", "reach")],
                                    "profile_id bigint, position int, id string, name string, score double, rationale string, admit_tier string")
    runs = spark.createDataFrame([(1, 0.6, "R1"), (2, 0.6, "R3")], "profile_id bigint, confidence double, stop_reason string")
    out = str(tmp_path / "recs")
    S.append_recommendations(results, runs, out)
    S.append_recommendations(results, runs, out)
    rows = spark.read.parquet(out).collect()
    assert len(rows) == 4 and {(r["profile_id"], tuple(x["id"] for x in r["results"])) for r in rows} == {(1, ("a", "b")), (2, ())}


def test_faculty_csv(spark, tmp_path):
    rows = [("s 1", "S", f"P{i}", None if i else "Lecturer, \"x\"", None, None, None, None, None, f"u{i}", "d", 0.9, None) for i in (2, 0, 1)]
    rows.append(("t", "T", "Q", "Provost", None, None, None, None, None, "u9", "d", 0.9, None))
    out = tmp_path / "csv"
    S.write_faculty_csv(spark.createDataFrame(rows, schemas.PROFESSOR), str(out))
    master = "".join(p.read_text() for p in sorted((out / "master").glob("*.csv")))
    assert [line.split(",")[2] for line in master.splitlines() if not line.startswith("school_id")] == ["P0", "P1", "P2"]
    assert '"Lecturer, ""x""",true' in master and "null" not in master and '""",,' not in master
    assert [p.name for p in (out / "by_school").iterdir() if p.is_dir()] == ["slug=s-1"]
    S.write_coverage_csv(Y.coverage_report(spark.createDataFrame(rows, schemas.PROFESSOR), None), str(tmp_path / "cov"))
    assert len(next((tmp_path / "cov").glob("*.csv")).read_text().splitlines()) == 3


def page(i, html, status=200):
    return json.dumps({"school_id": "s", "school_name": "S", "profile_url": f"u{i}", "directory_url": "d", "http_status": status, "html": html})


def person(name):
    return f'<html><meta name="author" content="{name}"><body>x</body></html>'


def rows_and_ledger(spark, out):
    rows = {r["profile_url"]: r["professor_name"] for r in I.read_rows(spark, out).collect()}
    assert I.read_rows(spark, out).count() == len(rows)
    return rows, {r["profile_url"]: (r["status"], r["attempts"]) for r in I.read_ledger(spark, out).collect()}


def test_stream_equals_batch_and_retries(spark, tmp_path):
    src, out, ck = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    put(src / "x" / "a.json", "\n".join([page(1, person("Ann")), page(2, person("Bob"), 404), page(3, None), page(1, person("Ann"))]))
    put(src / "x" / "b.json", "\n".join([page(1, person("Ann again")), page(4, person("Cy"))]))
    for _ in range(2):  # a second run finds nothing new
        I.extract_stream(spark, f"{src}/*", out, ck, max_files=1).awaitTermination()
    put(src / "x" / "c.json", "\n".join([page(4, person("Cy again")), page(5, person("Di"))]))
    I.extract_stream(spark, f"{src}/*", out, ck).awaitTermination()
    rows, ledger = rows_and_ledger(spark, out)
    assert rows["u5"] == "Di" and set(rows) == {"u1", "u4", "u5"}
    assert ledger == {"u1": ("done", 1), "u2": ("done", 1), "u3": ("failed", 1), "u4": ("done", 1), "u5": ("done", 1)}
    put(tmp_path / "again.json", page(3, person("Eve")))
    fresh = spark.read.schema(schemas.RAW_PAGE).json(str(tmp_path / "again.json"))
    assert I.retry_failed(spark, fresh, str(src), out, ck, "1") and not I.retry_failed(spark, fresh, str(src), out, ck, "2")
    rows, ledger = rows_and_ledger(spark, out)
    assert set(rows) == {"u1", "u3", "u4", "u5"} and ledger["u3"] == ("done", 2)
    batch = Y.extract_deterministic(spark.read.schema(schemas.RAW_PAGE).json(f"{src}/x").dropDuplicates(["profile_url"]))
    assert {r["profile_url"] for r in batch.filter("outcome = 'extracted'").collect()} == {"u1", "u4", "u5"}


def test_stream_state_needs_no_older_ledger(spark, tmp_path):
    """Each batch's ledger is deleted before the next: what is settled, failed or given up is in the keyed state."""
    import shutil

    src, out, ck = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    seen = []
    for n, own in enumerate([
        [page(1, person("Ann")), page(2, None), page(3, None)],
        [page(1, person("Ann again")), page(2, None), page(3, person("Cy"))],
        [page(3, person("Cy again")), page(2, person("too late")), page(1, None), page(4, person("Di"))],
    ]):
        put(src / f"{n}.json", "\n".join(own))
        I.extract_stream(spark, str(src), out, ck, max_attempts=2).awaitTermination()
        seen.append(rows_and_ledger(spark, out))
        shutil.rmtree(out)
    assert seen[0] == ({"u1": "Ann"}, {"u1": ("done", 1), "u2": ("failed", 1), "u3": ("failed", 1)})
    assert seen[1] == ({"u3": "Cy"}, {"u2": ("given_up", 2), "u3": ("done", 2)})
    assert seen[2] == ({"u4": "Di"}, {"u4": ("done", 1)})


def test_replayed_batch_changes_nothing(spark, tmp_path):
    src, out, ck = tmp_path / "in", str(tmp_path / "out"), tmp_path / "ck"
    put(src / "a.json", "\n".join([page(1, person("Ann")), page(2, None)]))
    I.extract_stream(spark, str(src), out, str(ck)).awaitTermination()
    put(src / "b.json", "\n".join([page(2, person("Bob")), page(1, person("again"))]))
    I.extract_stream(spark, str(src), out, str(ck)).awaitTermination()
    before = rows_and_ledger(spark, out)
    for name in ("1", ".1.crc"):  # the last batch is not known to have ended
        (ck / "commits" / name).unlink(missing_ok=True)
    I.extract_stream(spark, str(src), out, str(ck)).awaitTermination()
    assert rows_and_ledger(spark, out) == before == ({"u1": "Ann", "u2": "Bob"}, {"u1": ("done", 1), "u2": ("done", 2)})


def test_streamed_ranking_equals_batch(spark, tmp_path):
    people, catalog = frame(spark, make_profiles(), PROFILE_SCHEMA), frame(spark, make_universities(), UNI_SCHEMA)
    src, out = str(tmp_path / "req"), str(tmp_path / "ranked")
    people.repartition(3).write.parquet(src)
    stream = spark.readStream.schema(people.schema).option("maxFilesPerTrigger", 1).parquet(src)
    I.rank_stream(stream, catalog, out, str(tmp_path / "ck"), k=3).awaitTermination()
    got = {tuple(r[c] for c in ("profile_id", "rank", "id", "score")) for r in spark.read.parquet(out).collect()}
    want = {tuple(r[c] for c in ("profile_id", "rank", "id", "score")) for r in ranking.rank_top_k(people, catalog, 3).collect()}
    assert got == want
