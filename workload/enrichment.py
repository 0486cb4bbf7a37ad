"""Research and encyclopedia enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from matricula import fixed_values as V
from matricula.functions import nested
from matricula.operators import enrichment as E
from workload.registry import query


@query(
    "recent_author_counts",
    "A11",
    """with c as (select institution_id, author_id, count(distinct work_id) works from {v_works} where published_day >= 10 group by 1, 2)
      select institution_id, author_id, works, cast(rn as int) cand_rank, greatest(n - 3, 0) left_out from (select *, row_number() over (partition by institution_id order by works desc, author_id) rn, count(*) over (partition by institution_id) n from c) where rn <= 3""",
)
def recent_author_counts(t):
    works = t["v_works"].withColumnRenamed("published_day", "published")
    return E.recent_author_counts(works, F.lit(10), limit=3)


@query(
    "last_active_day",
    "A12 M17",
    "select user_id, max(case when event_type = 'purchase' then cast(extract(day from ts) as int) end) last_active from {events} group by 1",
)
def last_active_day(t):
    # one entry per (user, day): at most 31 per user here, one per year in an author record
    days = t["events"].groupBy("user_id", F.dayofmonth("ts").alias("year")).agg(
        F.count_if(F.col("event_type") == "purchase").alias("works_count")
    )
    records = days.groupBy("user_id").agg(F.collect_list(F.struct("year", "works_count")).alias("counts"))
    return records.select("user_id", nested.last_active_year(F.col("counts")).alias("last_active"))


def authors(t):
    """Author records; half of the affiliations name another institution."""
    inst = F.when(F.col("author_id") % 4 == 3, F.lit("elsewhere")).otherwise(F.col("institution"))
    affiliation = F.struct(
        F.struct(F.concat(F.lit("https://id.org/"), inst).alias("id")).alias("institution"),
        F.array((F.col("aff_year") - 3).cast("int"), F.col("aff_year").cast("int")).alias("years"),
    )
    topic = lambda n, f: F.struct(F.lit(n).alias("display_name"), F.struct(f.alias("display_name")).alias("field"))
    return t["v_authors"].select(
        "author_id", "display_name",
        F.array(topic("first", F.col("primary_field")), topic("second", F.lit("Chemistry"))).alias("topics"),
        F.when(F.col("no_affiliation"), F.array().cast("array<struct<institution:struct<id:string>,years:array<int>>>"))
        .otherwise(F.array(affiliation)).alias("affiliations"),
        F.array(F.struct(F.col("aff_year").alias("year"), F.lit(2).alias("works_count")), F.struct((F.col("aff_year") + 1).alias("year"), F.lit(0).alias("works_count"))).alias("counts_by_year"),
        F.col("h_index"),
    )


def _judged(t):
    counts = t["v_authors"].select(
        F.col("institution").alias("school_id"), F.col("institution").alias("institution_id"), "author_id",
        (F.col("author_id") % 9).alias("works"), F.col("author_id").alias("cand_rank"),
    )
    return E.judge_authors(counts, authors(t), t["v_school_families"].select("school_id", "families"), 2023)


_FIELD_ROWS = ", ".join(f"('{f}', '{fam}')" for f, fams in V.FIELD_TO_FAMILIES.items() for fam in fams)
_JUDGED = f"""m(field, family) as (values {_FIELD_ROWS}),
    j as (select a.*, case when not (no_affiliation or (author_id % 4 <> 3 and aff_year >= 2023)) then 'elsewhere'
        when families is not null and not exists (select 1 from m where field = primary_field and list_contains(families, family)) then 'field' end rejected
      from {{v_authors}} a join {{v_school_families}} s on s.school_id = a.institution)"""


@query("author_verdicts", "F16 F17 J9 U5", f"with {_JUDGED} select author_id, rejected from j")
def author_verdicts(t):
    return _judged(t).select("author_id", "rejected")


@query("rejection_counts", "A21", f"with {_JUDGED} select rejected, count(*) n from j where rejected is not null group by 1")
def rejection_counts(t):
    return E.rejection_counts(_judged(t))


def _notable_tier(t):
    person = F.struct(
        F.regexp_replace("display_name", "#", " #(x)").alias("name"),
        F.when(F.col("n_awards") == 1, F.array(F.lit("Medal"))).otherwise(F.array().cast("array<string>")).alias("awards"),
    )
    # one tier record per person keeps the fixture flat; schools repeat
    return t["v_authors"].select(F.col("institution").alias("school_id"), F.array(person).alias("notable_faculty"))


@query(
    "honours_by_name",
    "J10 T4",
    "select distinct institution school_id, 'customer' match_name, 1 n_awards from {v_authors} where n_awards = 1",
)
def honours_by_name(t):
    return E.honours(_notable_tier(t)).select("school_id", "match_name", F.size("awards").alias("n_awards"))


@query(
    "active_researchers",
    "W4 N3 M17 A12",
    f"""with {_JUDGED}, r as (select *, row_number() over (partition by institution order by coalesce(h_index, 0) desc, author_id % 9 desc, author_id) rank from j where rejected is null)
      select institution school_id, cast(rank as int) rank, display_name "name", 'first|second' research, case when primary_field = 'Chemistry' then 'Chemistry' else primary_field || '|Chemistry' end fields,
        author_id % 9 recent_works, aff_year last_active, h_index from r where rank <= 20""",
)
def active_researchers(t):
    top = E.active_researchers(_judged(t))
    return top.select(
        "school_id", "rank", "name", F.array_join("research", "|").alias("research"),
        F.array_join("fields", "|").alias("fields"), "recent_works", "last_active", "h_index",
    )


@query(
    "awarded_researchers",
    "W4 J10",
    f"""with {_JUDGED}, k as (select *, exists (select 1 from {{v_authors}} x where x.institution = j.institution and x.n_awards = 1) award from j where rejected is null),
      r as (select *, row_number() over (partition by institution order by award desc, coalesce(h_index, 0) desc, author_id % 9 desc, author_id) rank from k)
      select institution school_id, cast(rank as int) rank, display_name "name", case when award then 1 else 0 end n_awards from r where rank <= 20""",
)
def awarded_researchers(t):
    top = E.active_researchers(_judged(t), E.honours(_notable_tier(t)))
    return top.select("school_id", "rank", "name", F.size("awards").alias("n_awards"))


@query(
    "result_sizes",
    "A21",
    f"""with {_JUDGED}, n as (select institution, count(*) n from j where rejected is null group by 1)
      select case when n_nationkey = 3 then 'unresolved' when coalesce(n, 0) = 0 then 'empty' when n < 10 then 'thin' else 'full' end outcome, count(*) schools
      from {{nation}} left join n on institution = 'inst' || n_nationkey group by 1""",
)
def result_sizes(t):
    schools = t["nation"].select(
        F.concat(F.lit("inst"), F.col("n_nationkey").cast("string")).alias("school_id"),
        (F.col("n_nationkey") != 3).alias("resolved"),
    )
    return E.result_sizes(schools, _judged(t).filter(F.col("rejected").isNull()))


@query(
    "institution_resolution",
    "J12 T5 T7",
    """with s as (select n_nationkey school_key, 'INST  ' || n_nationkey as name, case when n_nationkey % 4 = 0 then null else 'http://inst' || n_nationkey || '.edu' end homepage from {nation}),
      c as (select *, row_number() over (partition by school_key order by cand_rank) pos from {v_institutions}),
      p as (select c.school_key, c.cand_rank, c.pos, case when homepage is not null and c.cand_rank % 3 = 0 then 1 when homepage is not null and c.cand_rank % 4 = 0 then 2 when pos = 1 and homepage is null then 3 end prio
        from c join s on s.school_key = c.school_key where pos <= 10),
      r as (select *, row_number() over (partition by school_key order by prio, pos) rn from p where prio is not null)
      select school_key, cand_rank institution_id, prio from r where rn = 1""",
)
def institution_resolution(t):
    k = F.col("n_nationkey").cast("string")
    schools = t["nation"].select(
        F.col("n_nationkey").alias("school_key"), F.concat(F.lit("INST  "), k).alias("name"),
        F.when(F.col("n_nationkey") % 4 != 0, F.concat(F.lit("http://inst"), k, F.lit(".edu"))).alias("homepage"),
    )
    candidates = t["v_institutions"].withColumn("institution_id", F.col("cand_rank"))
    return E.resolve_institutions(schools, candidates, pool=10).select("school_key", "institution_id", "prio")


# ------------------------------------------------------------ encyclopedia --
def _encyclopedia(t):
    k = F.col("c_custkey")
    qid = lambda n: F.concat(F.lit("Q"), n.cast("string"))
    ident = lambda c: F.struct(c.alias("id"))
    titles = t["customer"].select(
        F.col("c_nationkey").alias("school_id"),
        F.when(k % 10 == 0, F.concat(F.lit("List of "), "c_name")).otherwise(F.replace("c_name", F.lit("#"), F.lit(" "))).alias("title"),
    )
    qids = t["customer"].filter("c_acctbal > -500").select(F.replace("c_name", F.lit("#"), F.lit(" ")).alias("title"), qid(k).alias("qid"))
    claims = F.create_map(
        F.lit("P31"), F.array(ident(F.when(k % 7 == 0, "Q99").otherwise("Q5"))),
        F.lit("P106"), F.array(ident(F.lit("Q1")), ident(F.lit(None).cast("string")), ident(F.lit("Q2")), ident(qid(k % 5 + 3))),
        F.lit("P166"), F.array(ident(qid(k % 3 + 20)), ident(F.lit("Q20")), ident(F.lit("Q404"))),
        F.lit("P570"), F.when(k % 6 == 0, F.array(ident(F.lit(None).cast("string")))).otherwise(F.array().cast("array<struct<id:string>>")),
    )
    links = F.map_from_arrays(F.sequence(F.lit(1), (k % 23 + 1).cast("int")), F.sequence(F.lit(1), (k % 23 + 1).cast("int")))
    entities = t["customer"].select(
        qid(k).alias("qid"), claims.alias("claims"), F.col("c_mktsegment").alias("description"),
        F.when(k % 8 != 0, links).alias("sitelinks"),
    )
    labels = t["nation"].select(
        qid(F.col("n_nationkey")).alias("qid"),
        F.when(F.col("n_nationkey") == 1, "Academic").otherwise(F.concat(F.lit("label "), "n_name")).alias("label"),
    )
    return titles, qids, entities, labels


@query(
    "notable_people",
    "J17 F14 F15 W5 N4 N5 N6 N7",
    """with l as (select n_nationkey k, case when n_nationkey = 1 then 'Academic' else 'label ' || n_name end label from {nation}),
      p as (select c_nationkey school_id, replace(c_name, '#', ' ') title, c_custkey k, case when c_custkey % 8 <> 0 then cast(c_custkey % 23 + 1 as int) else 0 end prominence, c_mktsegment known_for
        from {customer} where c_custkey % 10 <> 0 and c_acctbal > -500 and c_custkey % 7 <> 0),
      r as (select *, row_number() over (partition by school_id order by prominence desc, title) rank from p)
      select school_id, cast(rank as int) rank, title "name", known_for, (select label from l where l.k = 2) || '|' || (select label from l where l.k = r.k % 5 + 3) fields,
        case when k % 6 = 0 then 'historical' else 'current' end status, prominence,
        case when k % 3 = 0 then (select label from l where l.k = 20) else (select label from l where l.k = r.k % 3 + 20) || '|' || (select label from l where l.k = 20) end awards
      from r where rank <= 20""",
)
def notable_people(t):
    titles, qids, entities, labels = _encyclopedia(t)
    people = E.notable_people(E.person_titles(titles), qids, entities, labels)
    return people.select(
        "school_id", "rank", "name", "known_for", F.array_join("fields", "|").alias("fields"), "status",
        "prominence", F.array_join("awards", "|").alias("awards"),
    )


@query(
    "category_cascade",
    "J18 F14 W15",
    """select s_suppkey school_id, 'Category:' || case when s_suppkey % 5 = 0 then s_name when s_suppkey % 5 = 1 then s_name || ' R' when s_suppkey % 5 = 2 then s_name || ' A' else s_name || ' (X)' end || ' faculty' category,
      cast(s_suppkey % 5 + 1 as int) step, 0 unread from {supplier} where s_suppkey % 5 < 4""",
)
def category_cascade(t):
    k, n = F.col("s_suppkey"), F.col("s_name")
    schools = t["supplier"].select(k.alias("school_id"), n.alias("name"))
    suffix = F.when(k % 5 == 0, "").when(k % 5 == 1, " R").when(k % 5 == 2, " A").when(k % 5 == 3, " (X)").otherwise(" none")
    people = t["supplier"].select(
        F.concat(F.lit("Category:"), n, suffix, F.lit(" faculty")).alias("category"),
        F.when(k % 5 == 4, "List of staff").otherwise("A Person").alias("title"), k.alias("ord"),
    )
    redirects = t["supplier"].select(n.alias("name"), F.concat(n, F.lit(" R")).alias("title"))
    hits = t["supplier"].select(n.alias("name"), F.concat(n, F.lit(" A")).alias("title"))
    category_hits = t["supplier"].select(n.alias("name"), F.concat(F.lit("Category:"), n, F.lit(" (X) faculty")).alias("category"))
    return E.resolve_category(schools, people, redirects, hits, category_hits, V.MAX_CATEGORY_MEMBERS)


@query(
    "compacted_tier",
    "S16",
    "select user_id % 50 school_id, arg_max(event_type, event_id) event_type, arg_max(value, event_id) \"value\" from {events} group by 1",
)
def compacted_tier(t):
    log = t["events"].select((F.col("user_id") % 50).alias("school_id"), "event_type", "value", F.col("event_id").alias("seq"))
    return E.compact_tier(log)
