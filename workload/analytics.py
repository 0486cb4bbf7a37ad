"""Search, facets, coverage, list balance, major finder, comparison, validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from matricula import fixed_values as V
from matricula.functions import nested, numeric
from matricula.operators import analytics as A
from matricula.operators import validation
from workload.ranking import re2
from workload.registry import query

_SIZE = "case when enrollment is null then 'medium' when enrollment < 5000 then 'small' when enrollment < 15000 then 'medium' else 'large' end"


@query(
    "catalog_search",
    "F4",
    f"""select id, name from {{v_universities}} where country = 'USA' and {_SIZE} = 'large' and
      (contains(lower(name), 'ring') or contains(lower(location), 'ring') or contains(lower(country), 'ring')
       or len(list_filter(majors, lambda m: contains(lower(m), 'ring'))) > 0)""",
)
def catalog_search(t):
    sized = t["v_universities"].withColumn("size", numeric.size_band(F.col("enrollment")))
    return A.search(sized, "  Ring ", country="USA", size="large").select("id", "name")


@query(
    "country_facets",
    "A3",
    "select country, region, count(*) n from {v_universities} group by 1, 2",
)
def country_facets(t):
    both = t["v_universities"].select(F.struct("country", "region").alias("facet"))
    return A.facet_counts(both, "facet").select("facet.country", "facet.region", "n")


@query(
    "majors_offered",
    "A18",
    "select major, count(*) schools from (select distinct id, unnest(majors) major from {v_universities}) group by 1 having count(*) >= 3",
)
def majors_offered(t):
    return A.offered_majors(t["v_universities"])


# ----------------------------------------------------------- programs -------
_SHARES = """shares as (select s_suppkey id, family, round(cast(amount as double) / cast(sum(amount) over (partition by s_suppkey) as double), 4) share
      from {v_program_rows} r join {supplier} s on r.school_key = s.s_suppkey)"""


def program_catalog(t):
    """Suppliers with their families as programs; suppliers in debt stay unmeasured."""
    rows = t["v_program_rows"]
    totals = rows.groupBy("school_key").agg(F.sum("amount").alias("total"))
    share = F.round(F.col("amount").cast("double") / F.col("total").cast("double"), 4)
    programs = (
        rows.join(totals, "school_key")
        .groupBy("school_key")
        .agg(F.collect_list(F.struct(F.col("family").alias("name"), share.alias("share"))).alias("p"))
        .select(F.col("school_key").alias("id"), nested.order_programs(F.col("p")).alias("programs"))
    )
    return t["supplier"].select(F.col("s_suppkey").alias("id"), "s_acctbal").join(programs, "id", "left")


@query(
    "program_order",
    "W9 N1",
    f"with {_SHARES} select id, cast(row_number() over (partition by id order by share desc, family) - 1 as int) pos, family, share from shares",
)
def program_order(t):
    rows = program_catalog(t).select("id", F.posexplode("programs").alias("pos", "p"))
    return rows.select("id", "pos", F.col("p")["name"].alias("family"), F.col("p")["share"].alias("share"))


_FAMILIES = ["AF", "AO", "NF", "NO", "RF", "RO", "XX"]


@query(
    "family_coverage",
    "A2",
    f"""with {_SHARES}, fams as (select unnest({_FAMILIES}) family)
      select f.family, (select count(*) from shares s where s.family = f.family) awarding,
        (select count(*) from {{supplier}} where s_acctbal >= 0 and s_suppkey in (select l_suppkey from {{lineitem}})) - (select count(*) from shares s where s.family = f.family) none,
        (select count(*) from {{supplier}}) - (select count(distinct id) from shares) unmeasured from fams f""",
)
def family_coverage(t):
    return A.family_coverage(program_catalog(t), _FAMILIES)


@query(
    "awards_degrees",
    "J21 J11",
    f"""with {_SHARES} select s_suppkey id, case when not exists (select 1 from shares x where x.id = s_suppkey) then null
        else exists (select 1 from shares x where x.id = s_suppkey and x.family = 'AF') end awards from {{supplier}}""",
)
def awards_degrees(t):
    return A.awards_family(program_catalog(t), "AF").select("id", "awards")


@query(
    "also_awarding",
    "J16",
    f"""with {_SHARES} select family, id, share, cast(rank as int) rank from (
        select *, row_number() over (partition by family order by share desc, id) rank from shares where share <= 0.4e0) where rank <= 6""",
)
def also_awarding(t):
    catalog = program_catalog(t)
    shown = catalog.select("id", F.explode("programs").alias("p")).filter("p.share > 0.4").select(
        F.col("p")["name"].alias("family"), "id"
    )
    return A.also_awarding(catalog, shown)


_FIELD_ROWS = ", ".join(
    f"('{f}', '{fam}')" for f, fams in V.FIELD_TO_FAMILIES.items() for fam in fams
)


def _staff(t):
    return t["v_authors"].select(
        F.col("institution").alias("school_id"), "author_id", F.array("primary_field").alias("fields")
    )


@query(
    "researchers_by_family",
    "J20 N8",
    f"with m(field, family) as (values {_FIELD_ROWS}) select institution school_id, author_id, family from {{v_authors}} join m on field = primary_field",
)
def researchers_by_family(t):
    return A.researchers_by_family(_staff(t)).select("school_id", "author_id", "family")


@query(
    "research_families",
    "A22 U5",
    f"""with m(field, family) as (values {_FIELD_ROWS}),
      have as (select distinct institution, family from {{v_authors}} join m on field = primary_field),
      fam as (select school_id, unnest(families) family, generate_subscripts(families, 1) pos from {{v_school_families}})
      select f.school_id, f.family, cast(row_number() over (partition by f.school_id order by f.pos) - 1 as int) pos
      from fam f join have h on h.institution = f.school_id and h.family = f.family""",
)
def research_families(t):
    # distinct fields per school: bounded by the field vocabulary
    people = (
        _staff(t).select("school_id", "fields").distinct().groupBy("school_id")
        .agg(F.collect_list(F.struct("fields")).alias("people"))
    )
    programs = t["v_school_families"].select(
        "school_id", F.transform("families", lambda f: F.struct(f.alias("name"))).alias("programs")
    )
    return programs.join(people, "school_id", "left").select(
        "school_id",
        F.posexplode(nested.research_families(F.col("people"), F.col("programs"))).alias("pos", "family"),
    )


# ------------------------------------------------------------- the list -----
_BALANCE = """balance as (select student_id, count(*) total, count(*) filter (tier = 'reach') reach, count(*) filter (tier = 'target') target,
        count(*) filter (tier = 'safety') safety, count(*) filter (tier = 'extreme_reach') extreme_reach, count(*) filter (tier is null) unknown
      from {v_list} where listed group by 1)"""


@query(
    "list_balance",
    "A4",
    f"""with {_BALANCE.replace("where listed ", "")}, b as (select c_custkey student_id, coalesce(total, 0) total, coalesce(reach, 0) reach, coalesce(target, 0) target, coalesce(safety, 0) safety,
        coalesce(extreme_reach, 0) extreme_reach, coalesce(unknown, 0) unknown from {{customer}} left join balance on c_custkey = student_id)
      select *, case when total = 0 then 0e0 else cast(safety as double) / total end safety_share,
        cast(floor(total * 0.15e0 + 0.5e0) as bigint) range_low, cast(floor(total * 0.2e0 + 0.5e0) as bigint) range_high,
        total > 0 and cast(safety as double) / greatest(total, 1) < 0.15e0 needs_more_safeties from b""",
)
def list_balance(t):
    students = t["customer"].select(F.col("c_custkey").alias("student_id"))
    return A.list_balance(t["v_list"], students)


@query(
    "gap_suggestions",
    "J15",
    f"""with {_BALANCE}, short as (select student_id from balance where cast(safety as double) / total < 0.15e0)
      select student_id, school_id, fit, cast(rank as int) rank from (
        select m.student_id, m.school_id, m.fit, row_number() over (partition by m.student_id order by m.fit desc, m.school_id) rank
        from {{v_list}} m join short using (student_id)
        where m.tier = 'safety' and not exists (select 1 from {{v_list}} l where l.listed and l.student_id = m.student_id and l.school_id = m.school_id))
      where rank <= 3""",
)
def gap_suggestions(t):
    listed = t["v_list"].filter("listed")
    return A.suggest_gaps(listed, t["v_list"]).select("student_id", "school_id", "fit", "rank")


@query(
    "delisted_schools",
    "F23",
    """select student_id, school_id, not exists (select 1 from {part} where p_partkey = school_id and p_type <> 'PROMO') delisted from {v_list}""",
)
def delisted_schools(t):
    catalog = t["part"].filter("p_type <> 'PROMO'").select(F.col("p_partkey").alias("id"))
    return A.flag_delisted(t["v_list"], catalog).select("student_id", "school_id", "delisted")


# --------------------------------------------------------- major finder -----
@query(
    "questionnaire_axes",
    "M16",
    "select profile_id, " + ", ".join(
        f"coalesce(max(case when question = {i} then answer end), 0.5e0) {q}" for i, q in enumerate(V.QUESTIONS)
    ) + ", cast(count(distinct question) as int) answered from {v_answers} group by 1",
)
def questionnaire_axes(t):
    names = F.array(*[F.lit(q) for q in V.QUESTIONS])
    answers = t["v_answers"].withColumn("question", F.get(names, F.col("question").cast("int")))
    return A.fold_answers(answers)


def _students(t):
    doc = F.col("doc_id")
    courses = F.when(doc % 3 == 0, F.array(F.lit("Math"), F.lit("Physics"), F.lit("Art"))).when(
        doc % 3 == 1, F.array(F.lit("Biology"), F.lit("Psychology"), F.lit("History"), F.lit("English / Literature"))
    ).otherwise(F.array().cast("array<string>"))
    return t["documents"].select(
        doc.alias("profile_id"), courses.alias("courses"), F.col("text").alias("activities"),
        ((doc % 11).cast("double") / 10).alias("people"),
        ((doc * 3 % 11).cast("double") / 10).alias("applied"),
        ((doc * 7 % 11).cast("double") / 10).alias("creative"),
    )


_MAJOR_ROWS = ", ".join(
    "('{}', [{}], {}e0, {}e0, {}e0, '{}')".format(
        name, ", ".join(f"'{c}'" for c in courses), *axes, re2(pattern)
    )
    for name, courses, axes, pattern, _ in V.MAJORS
)


@query(
    "major_ranking",
    "M15 W12",
    f"""with majors(major, mc, mp, ma, mr, act) as (values {_MAJOR_ROWS}),
      st as (select doc_id, lower(trim(text)) txt, cast(doc_id % 11 as double) / 10e0 p, cast(doc_id * 3 % 11 as double) / 10e0 a, cast(doc_id * 7 % 11 as double) / 10e0 r,
        case doc_id % 3 when 0 then ['Math', 'Physics', 'Art'] when 1 then ['Biology', 'Psychology', 'History', 'English / Literature'] else cast([] as varchar[]) end courses from {{documents}}),
      x as (select doc_id profile_id, major, list_filter(mc, lambda c: list_contains(courses, c)) ov, len(mc) n, regexp_matches(txt, act) and txt <> '' hit,
        1e0 - (abs(p - mp) + abs(a - ma) + abs(r - mr)) / 3 ax from st, majors),
      s as (select profile_id, major, cast(floor(100 * (cast(len(ov) as double) / n * 0.45e0 + case when hit then 1e0 else 0e0 end * 0.2e0 + ax * 0.35e0) + 0.5e0) as int) score,
        concat_ws('; ', case when len(ov) > 0 then 'courses: ' || array_to_string(ov[1:3], ', ') end, case when hit then 'matches your activities' end, case when ax >= 0.85e0 then 'fits how you like to work' end) reasons from x)
      select *, cast(row_number() over (partition by profile_id order by score desc, major) as int) rank from s""",
)
def major_ranking(t):
    return A.rank_majors(_students(t))


@query(
    "schools_for_major",
    "W13",
    "with needles(major, needle) as (values " + ", ".join(
        f"('{name}', '{name.split(' / ')[0].lower()}')" for name, *_ in V.MAJORS
    ) + """) select major, id, cast(rank as int) rank from (select major, id, row_number() over (partition by major order by id) rank
      from needles, {v_catalog} where len(list_filter(majors, lambda m: contains(lower(m), needle))) > 0) where rank <= 6""",
)
def schools_for_major(t):
    return A.schools_for_major(t["v_catalog"])


# ------------------------------------------------------------ comparison ----
def _with_provenance(t):
    pairs = []
    for key in ("avg_gpa", "avg_sat", "acceptance_rate", "net_price", "enrollment"):
        origin = (
            F.when(F.col(key).isNotNull(), "editorial" if key == "avg_gpa" else "observed")
            .when(F.col("country") == "USA", "absent")
            .otherwise("not_applicable")
        )
        pairs += [F.lit(key), origin]
    return t["v_universities"].withColumn("provenance", F.create_map(*pairs))


_NA = "case when country = 'USA' then '—' else 'n/a' end"
_NOTE = "case when country = 'USA' then null else 'not used at this school' end"
_STATS = f"""
      select id, 'Avg GPA' metric, printf('%.2f', avg_gpa) text, 'est.' note from {{v_universities}}
      union all select id, 'Avg SAT', coalesce(cast(avg_sat as string), {_NA}), case when avg_sat is null then {_NOTE} end from {{v_universities}}
      union all select id, 'Acceptance', coalesce(cast(cast(floor(acceptance_rate * 100 + 0.5e0) as bigint) as string) || '%', {_NA}), case when acceptance_rate is null then {_NOTE} end from {{v_universities}}
      union all select id, 'Net price', coalesce('$' || format('{{{{:,}}}}', cast(floor(net_price + 0.5e0) as bigint)), {_NA}), case when net_price is null then {_NOTE} end from {{v_universities}}
      union all select id, 'Undergrads', coalesce(format('{{{{:,}}}}', cast(enrollment as bigint)), {_NA}), case when enrollment is null then {_NOTE} end from {{v_universities}}""".replace("{{", "{").replace("}}", "}")


@query("display_stats", "M18", _STATS)
def display_stats(t):
    return A.stat_rows(_with_provenance(t))


_THREE = ["u000000000003", "u000000000005", "u000000000007"]


@query(
    "comparison_table",
    "A24",
    f"""with s as ({_STATS}) select metric, """ + ", ".join(
        f"max(case when id = '{i}' then concat_ws(' ', text, note) end) {i}" for i in _THREE
    ) + " from s group by metric",
)
def comparison_table(t):
    return A.comparison_table(_with_provenance(t), _THREE)


# ------------------------------------------------------------ validation ----
def _shaky(t):
    return t["v_universities"].withColumns(
        {
            "avg_gpa": F.col("avg_gpa") + 0.3,
            "avg_sat": F.col("avg_sat") + 100,
            "acceptance_rate": F.col("acceptance_rate") + 0.2,
            "net_price": F.col("net_price") - 9000,
            "state": F.when(F.col("state") == "TX", "Texas").otherwise(F.col("state")),
            "setting": F.when(F.col("setting") == "rural", "remote").otherwise(F.col("setting")),
        }
    )


@query(
    "validation_report",
    "V1",
    """select 'avg_gpa' rule, count(*) n from {v_universities} where avg_gpa + 0.3e0 > 4
      union all select 'avg_sat', count(*) from {v_universities} where avg_sat + 100 > 1600
      union all select 'acceptance_rate', count(*) from {v_universities} where acceptance_rate + 0.2e0 > 1
      union all select 'net_price', count(*) from {v_universities} where net_price - 9000 < 0
      union all select 'state', count(*) from {v_universities} where state = 'TX'
      union all select 'setting', count(*) from {v_universities} where setting = 'rural'""",
)
def validation_report(t):
    return validation.violation_counts(_shaky(t), validation.university_rules())


@query(
    "quarantined_profiles",
    "V1",
    "select profile_id, 'scope' violations from {v_profiles} where scope = 'anywhere'",
)
def quarantined_profiles(t):
    _, bad = validation.split_valid(t["v_profiles"], validation.profile_rules())
    return bad.select("profile_id", F.array_join("violations", ",").alias("violations"))
