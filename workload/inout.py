"""Round trips: tables written by the sinks and read back, and streams over them."""

from __future__ import annotations

from pyspark.sql import functions as F

from matricula import schemas
from matricula.operators import validation
from matricula.session import scratch_path
from matricula.sources import readers, sinks
from matricula.streaming import incremental
from workload.faculty import _HINTS, _JUDGED, profile_pages
from workload.ranking import scored_ctes
from workload.registry import query


@query(
    "scorecard_csv",
    "S1",
    "select UNITID, INSTNM, SAT_AVG, coalesce(NPT4_PUB, '') npt4_pub, cast(null as string) pcip54 from {v_scorecard}",
)
def scorecard_csv(t):
    path = scratch_path(t.spark, "scorecard")
    t["v_scorecard"].drop("seq").withColumn("UNUSED", F.lit("x")).write.option("header", True).csv(path)
    rows = readers.read_scorecard(t.spark, path)
    return rows.select(
        "UNITID", "INSTNM", F.coalesce("SAT_AVG", F.lit("")).alias("SAT_AVG"),
        F.coalesce("NPT4_PUB", F.lit("")).alias("npt4_pub"), F.col("PCIP54").alias("pcip54"),
    )


@query(
    "json_lines_strict",
    "S5 S17",
    "select school_id, professor_name, title, is_faculty, extraction_confidence from {v_professors}",
)
def json_lines_strict(t):
    path = scratch_path(t.spark, "professors")
    sinks.write_ordered_json(t["v_professors"], path, "professor_name")
    rows = readers.read_json_lines(t.spark, path, schemas.PROFESSOR)
    return rows.select("school_id", "professor_name", "title", "is_faculty", "extraction_confidence")


@query(
    "json_lines_tolerant",
    "S6 V1",
    "select count(*) filter (title is not null and extraction_confidence <= 0.9e0) good, count(*) filter (title is null or extraction_confidence > 0.9e0) malformed from {v_professors}",
)
def json_lines_tolerant(t):
    """Rows without a title are cut off mid-line; very confident ones leave the allowed range."""
    path = scratch_path(t.spark, "lines")
    shifted = t["v_professors"].withColumn(
        "extraction_confidence",
        F.when(F.col("extraction_confidence") > 0.9, 1.5).otherwise(F.col("extraction_confidence")),
    )
    line = F.to_json(F.struct(*shifted.columns))
    cut = F.when(F.col("title").isNull(), F.substring_index(line, ",", 2)).otherwise(line)
    shifted.select(cut.alias("value")).write.text(path)
    good, seen = readers.read_json_lines_tolerant(
        t.spark, path, schemas.PROFESSOR, validation.professor_rules()
    )
    good.write.parquet(f"{path}-good")
    kept = t.spark.read.parquet(f"{path}-good")
    return kept.agg(F.count(F.lit(1)).alias("good")).withColumn("malformed", F.lit(seen.get["malformed"]))


def _documents(rows, root, text, each=1000):
    """One JSON document per file, about `each` rows in a file: `text` folds a file's rows to its document."""
    parts = 2 + rows.count() // each
    rows.groupBy(F.pmod(F.xxhash64(*rows.columns), F.lit(parts)).alias("file")).agg(text.alias("value")).write.partitionBy("file").text(root)


@query(
    "json_array",
    "S2",
    "select id, name, avg_gpa, array_to_string(majors, '|') majors from {v_universities}",
)
def json_array(t):
    path = scratch_path(t.spark, "arrays")
    rows = t["v_universities"].select("id", "name", "avg_gpa", "majors")
    _documents(rows, path, F.to_json(F.collect_list(F.struct(*rows.columns))))
    back = readers.read_json_array(t.spark, path, "id string, name string, avg_gpa double, majors array<string>")
    return back.select("id", "name", "avg_gpa", F.array_join("majors", "|").alias("majors"))


@query(
    "keyed_json",
    "S3",
    "select doc_id::varchar id, n_entries, source from {v_details} union all select 'absent', 0, null where not exists (select 1 from {v_details} where false)",
)
def keyed_json(t):
    """Keyed records and an absent file, which is an empty table."""
    path = scratch_path(t.spark, "keyed")
    rows = t["v_details"].select(F.col("doc_id").cast("string").alias("id"), F.struct("n_entries", "source").alias("r"))
    _documents(rows, path, F.to_json(F.map_from_entries(F.collect_list(F.struct("id", "r")))))
    record = "struct<n_entries:int,source:string>"
    back = readers.read_keyed_json(t.spark, path, record)
    none = readers.read_keyed_json(t.spark, f"{path}-absent", record).groupBy().agg(F.count(F.lit(1)).cast("int").alias("n_entries"))
    return back.select("id", "value.n_entries", "value.source").unionByName(
        none.select(F.lit("absent").alias("id"), "n_entries", F.lit(None).cast("string").alias("source")))


@query("alias_file", "S4", "select name, alias from {v_aliases} where not starts_with(name, '_')")
def alias_file(t):
    path = scratch_path(t.spark, "aliases")
    rows = t["v_aliases"].unionByName(t["nation"].select(F.concat(F.lit("_note "), "n_name").alias("name"), F.lit("comment").alias("alias")))
    _documents(rows, path, F.to_json(F.map_from_entries(F.collect_list(F.struct("name", "alias")))))
    return readers.read_aliases(t.spark, path)


@query(
    "editorial_js",
    "S7",
    "select p_name || ' ' || p_partkey \"name\", case when p_partkey % 3 = 0 then null else p_type end \"type\", p_size::int size, -1e0 * p_size gpa, p_brand || '|' || p_name majors, 0.5e0 research from {part}",
)
def editorial_js(t):
    path = scratch_path(t.spark, "editorial")
    p = t["part"]
    kind = F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.concat(F.lit(', type:"'), "p_type", F.lit('"')))
    p.select(F.concat(
        F.lit('X.push({n:"'), "p_name", F.lit(" "), F.col("p_partkey").cast("string"), F.lit('"'), kind, F.lit(", size:"), F.col("p_size").cast("string"),
        F.lit(", gpa: -"), F.col("p_size").cast("string"), F.lit(', v:{research:.5}, strengths:["'), "p_brand", F.lit('","'), "p_name", F.lit('"]});'),
    ).alias("value")).write.text(path)
    rows = readers.read_editorial_js(t.spark, path)
    return rows.select(
        "name", "type", F.col("enrollment_editorial").alias("size"), F.col("avg_gpa").alias("gpa"),
        F.array_join("majors", "|").alias("majors"), F.col("culture.research").alias("research"))


@query(
    "research_batch_files",
    "S8",
    "select school_id || '-' || seq school_id, faculty, research, case when seq % 3 = 0 then '' when seq % 3 = 1 then src[1] else array_to_string(src, ' ') end src from {v_batches}",
)
def research_batch_files(t):
    """Sources written as a list, as one text, and as something else, which is no source."""
    path = scratch_path(t.spark, "batches")
    seq = F.col("seq") % 3
    src = F.when(seq == 0, F.lit("{}")).when(seq == 1, F.to_json(F.array(F.col("src")[0]))).otherwise(F.to_json("src"))
    src = F.when(seq == 1, F.concat(F.lit('"'), F.col("src")[0], F.lit('"'))).otherwise(src)
    entry = F.concat(
        F.lit('"'), "school_id", F.lit("-"), F.col("seq").cast("string"), F.lit('":{"faculty":"'), "faculty", F.lit('","research":"'), "research",
        F.lit('","src":'), src, F.lit("}"))
    rows = t["v_batches"].select(entry.alias("e"))
    _documents(rows, path, F.concat(F.lit("{"), F.array_join(F.collect_list("e"), ","), F.lit("}")))
    back = readers.read_research_batches(t.spark, path)
    return back.select("school_id", "faculty", "research", F.array_join("src", " ").alias("src"))


@query(
    "ordered_catalog",
    "S11 S19",
    "select id, name, avg_gpa, net_price, array_to_string(majors, '|') majors from {v_universities}",
)
def ordered_catalog(t):
    path = scratch_path(t.spark, "catalog")
    sinks.write_ordered_json(t["v_universities"], path, "id")
    rows = t.spark.read.schema("id string, name string, avg_gpa double, net_price double, majors array<string>").json(path)
    return sinks.list_catalog(rows).withColumn("majors", F.array_join("majors", "|"))


@query(
    "catalog_snapshots",
    "S12 S10",
    "select id, case when setting = 'rural' then 'first' else 'second' end version from {v_universities}",
)
def catalog_snapshots(t):
    root = scratch_path(t.spark, "snapshots")
    unis = t["v_universities"]
    sinks.publish_snapshot(unis.select("id", F.lit("first").alias("version")), root)
    sinks.publish_snapshot(
        unis.filter("setting <> 'rural'").select("id", F.lit("second").alias("version")), root, prune=False
    )
    latest, _ = readers.catalog_or_seed(lambda: sinks.read_snapshot(t.spark, root), unis.select("id"))
    return latest


@query(
    "recommendation_log",
    "S13",
    "select student_id profile_id, 0.6e0 confidence, count(tier) n_results, max(case when tier is not null then fit end) best from {v_list} group by 1",
)
def recommendation_log(t):
    path = scratch_path(t.spark, "recommendations")
    listed = t["v_list"].filter(F.col("tier").isNotNull()).select(
        F.col("student_id").alias("profile_id"), F.col("school_id").alias("position"),
        F.col("school_id").cast("string").alias("id"), F.lit("x").alias("name"),
        F.col("fit").alias("score"), F.lit("r").alias("rationale"), F.col("tier").alias("admit_tier"),
    )
    runs = t["v_list"].select(F.col("student_id").alias("profile_id")).distinct().select(
        "profile_id", F.lit(0.6).alias("confidence"), F.lit("R1_converged").alias("stop_reason")
    )
    sinks.append_recommendations(listed, runs, path)
    rows = t.spark.read.parquet(path)
    return rows.select(
        "profile_id", "confidence", F.size("results").cast("bigint").alias("n_results"),
        F.array_max(F.transform("results", lambda r: r["score"])).alias("best"),
    )


@query(
    "faculty_csv",
    "S14 U1 T34",
    f"with {_JUDGED} select f file, school_id, professor_name, title, cast(\"role\" as string) is_faculty, profile_url from verdicts, (values ('by_school'), ('master')) v(f) where verdict = 'kept'",
)
def faculty_csv(t):
    path = scratch_path(t.spark, "faculty")
    none = F.lit(None).cast("string")
    full = t["v_professors"].withColumns(
        {"department": none, "email": none, "phone": none, "research_interests": none,
         "directory_url": F.lit("d"), "extracted_at": F.lit(None).cast("timestamp")}
    )
    sinks.write_faculty_csv(full, path)
    columns = ["school_id", "professor_name", "title", "is_faculty", "profile_url"]
    parts = [t.spark.read.option("header", True).csv(f"{path}/{f}").select(F.lit(f).alias("file"), *columns) for f in ("by_school", "master")]
    return parts[0].unionByName(parts[1])


def _raw_pages(t):
    return profile_pages(t).select(
        "school_id", "school_name", "profile_url", F.lit("d").alias("directory_url"), "http_status",
        F.lit(None).cast("timestamp").alias("fetched_at"), "html",
    )


@query(
    "incremental_extraction",
    "R1 R2 R3",
    f"""with h as ({_HINTS}) select 'https://x.edu/p/' || page_id profile_url, coalesce(ld_name, author) professor_name, email, phone
      from h where not dead and coalesce(ld_name, author) is not null""",
)
def incremental_extraction(t):
    """The same pages arrive twice in two folders; every profile comes out once."""
    base = scratch_path(t.spark, "stream")
    pages = _raw_pages(t)
    pages.write.json(f"{base}/in/a")
    pages.filter("http_status = 200").write.json(f"{base}/in/b")
    stream = incremental.extract_stream(t.spark, f"{base}/in/*", f"{base}/out", f"{base}/ck")
    stream.awaitTermination()
    rows = incremental.read_rows(t.spark, f"{base}/out")
    return rows.select("profile_url", "professor_name", "email", "phone")


@query(
    "retried_extraction",
    "R2",
    f"""with h as ({_HINTS}), e as (select page_id, dead, coalesce(ld_name, author) \"name\" from h)
      select 'https://x.edu/p/' || page_id profile_url, case when not dead and page_id % 3 = 0 and page_id % 2 = 1 then 'failed' else 'done' end status,
        case when not dead and page_id % 3 = 0 then 2 else 1 end attempts from e""",
)
def retried_extraction(t):
    """Pages without text are tried again from a fresh fetch, in which every second one has come back."""
    base = scratch_path(t.spark, "retried")
    pages = _raw_pages(t)
    number = F.regexp_extract("profile_url", "([0-9]+)$", 1).cast("long")
    pages.withColumn("html", F.when(number % 3 != 0, F.col("html"))).write.json(f"{base}/in/a")
    incremental.extract_stream(t.spark, f"{base}/in/*", f"{base}/out", f"{base}/ck").awaitTermination()
    fresh = pages.withColumn("html", F.when(number % 2 == 0, F.col("html")))
    incremental.retry_failed(t.spark, fresh, f"{base}/in", f"{base}/out", f"{base}/ck", "1")
    return incremental.read_ledger(t.spark, f"{base}/out")


@query(
    "streamed_ranking",
    "R4",
    "with " + scored_ctes() + " select profile_id, rank, id, score from ranked where rank <= 5",
)
def streamed_ranking(t):
    base = scratch_path(t.spark, "requests")
    profiles = t["v_profiles"]
    profiles.write.parquet(f"{base}/in")
    requests = t.spark.readStream.schema(profiles.schema).parquet(f"{base}/in")
    incremental.rank_stream(requests, t["v_catalog"], f"{base}/out", f"{base}/ck", activities=t["v_activities"]).awaitTermination()
    return t.spark.read.parquet(f"{base}/out").select("profile_id", "rank", "id", "score")
