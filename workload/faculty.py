"""Extraction, quality gates and coverage of faculty records."""

from __future__ import annotations

from pyspark.sql import functions as F

from matricula import fixed_values as V
from matricula.functions import html as H
from matricula.functions import text as T
from matricula.operators import common
from matricula.operators import faculty as Y
from workload.registry import query


def classify(c: str) -> str:
    academic, admin = V.ACADEMIC_TITLE, V.ADMIN_TITLE
    return f"(case when regexp_matches({c}, '(?i){academic}') then true when regexp_matches({c}, '(?i){admin}') then false end)"


_JUDGED = f"""judged as (select *, coalesce(is_faculty, {classify('title')}) as "role" from {{v_professors}}),
    verdicts as (select *, case when not coalesce("role", true) then 'non_faculty' when extraction_confidence >= 0.5e0 then 'kept' else 'below_confidence' end verdict from judged)"""


@query("title_roles", "T13 T14 F6", f"select doc_id, {classify('title')} from_title, coalesce(is_faculty, {classify('title')}) as \"role\" from {{v_professors}}")
def title_roles(t):
    return t["v_professors"].select(
        "doc_id",
        T.classify_role(F.col("title")).alias("from_title"),
        Y.resolved_role(F.col("is_faculty"), F.col("title")).alias("role"),
    )


@query("row_verdicts", "F5 F6", f"with {_JUDGED} select doc_id, verdict from verdicts")
def row_verdicts(t):
    return Y.judge(t["v_professors"]).select("doc_id", "verdict")


_SOURCES = """last_status as (select school_id, profile_url, arg_max(http_status, seq) status from {v_raw_profiles} group by 1, 2),
    counts as (select school_id, count(*) fetched, count(*) filter (status <> 200) dead from last_status group by 1)"""


@query("source_counts", "A6 A7", f"with {_SOURCES} select * from counts")
def source_counts(t):
    return Y.source_counts(t["v_raw_profiles"])


@query("stale_sources", "A7", f"with {_SOURCES} select * from counts where cast(dead as double) / fetched >= 0.15e0")
def stale_sources(t):
    return Y.stale_sources(t["v_raw_profiles"])


def partial_ctes(source: str, url: str = "profile_url") -> str:
    return f"""slugs as (select school_id, list_filter(string_split(lower(regexp_extract(regexp_replace({url}, '/+$', ''), '([^/]*)$', 1)), '-'), lambda x: regexp_matches(x, '^\\p{{L}}')) tk from {source}),
    letters as (select school_id, 'first' d, unnest(list_distinct(list_transform(tk[2:], lambda x: x[1:1]))) l from slugs where len(tk) >= 2
      union all select school_id, 'last', unnest(list_distinct(list_transform(tk[:-2], lambda x: x[1:1]))) from slugs where len(tk) >= 2),
    tops as (select school_id, max(n) top_n from (select school_id, d, l, count(*) n from letters group by 1, 2, 3) group by 1),
    sized as (select school_id, count(*) profiles, count(*) filter (len(tk) >= 2) slugs from slugs group by 1),
    partials as (select z.school_id, profiles, z.slugs, coalesce(profiles >= 8 and z.slugs >= 8 and cast(top_n as double) / z.slugs >= 0.9e0, false) "partial"
      from sized z left join tops using (school_id))"""


@query("alphabetical_partials", "A8", f"with {partial_ctes('{v_slugs}')} select * from partials")
def alphabetical_partials(t):
    return Y.partial_schools(t["v_slugs"])


def _report_raw(t):
    """Fetch log keyed by document source, so that it meets the professor rows."""
    return t["documents"].select(
        F.col("source").alias("school_id"),
        F.concat(F.lit("https://x.edu/"), (F.col("doc_id") % 300).cast("string")).alias("profile_url"),
        F.when(F.col("n_chars") % 7 == 0, 404).otherwise(200).alias("http_status"),
        F.col("doc_id").alias("seq"),
    )


_REPORT = f"""with {_JUDGED},
    raw as (select source school_id, concat('https://x.edu/', cast(doc_id % 300 as string)) profile_url, case when n_chars % 7 = 0 then 404 else 200 end http_status, doc_id seq from {{documents}}),
    last_status as (select school_id, profile_url, arg_max(http_status, seq) status from raw group by 1, 2),
    counts as (select school_id, count(*) fetched, count(*) filter (status <> 200) dead from last_status group by 1),
    keptrows as (select school_id, profile_url from verdicts where verdict = 'kept'),
    {partial_ctes('keptrows')},
    per as (select school_id, min(school_name) school_name, count(*) filter (verdict = 'kept') professors_in_csv, count(*) filter (verdict = 'below_confidence') professors_below_confidence,
      count(*) filter (verdict = 'non_faculty') professors_excluded_as_non_faculty from verdicts group by 1),
    report as (select p.school_id, school_name, professors_in_csv, professors_below_confidence, professors_excluded_as_non_faculty,
      coalesce(cast(fetched as string), 'unknown') source_urls_fetched, coalesce(cast(dead as string), 'unknown') source_urls_dead,
      cast(coalesce("partial", false) as string) partial_coverage, cast(coalesce(fetched >= 100, false) as string) capped_at_limit,
      cast(coalesce("partial", false) or coalesce(fetched >= 100, false) as string) incomplete
      from per p left join counts c on p.school_id = c.school_id left join partials q on q.school_id = p.school_id)"""


@query("coverage_report", "A5 U4 S15", _REPORT + " select * from report")
def coverage_report(t):
    return Y.coverage_report(t["v_professors"], _report_raw(t))


@query(
    "coverage_without_fetch_log",
    "A5",
    _REPORT + " select school_id, professors_in_csv, 'unknown' source_urls_fetched, 'unknown' capped_at_limit, partial_coverage incomplete from report",
)
def coverage_without_fetch_log(t):
    report = Y.coverage_report(t["v_professors"], None)
    return report.select("school_id", "professors_in_csv", "source_urls_fetched", "capped_at_limit", "incomplete")


@query(
    "incomplete_headline",
    "A20",
    _REPORT + " select count(*) schools, count(*) filter (incomplete = 'true') incomplete, count(*) filter (partial_coverage = 'true') as \"partial\", count(*) filter (capped_at_limit = 'true') capped from report",
)
def incomplete_headline(t):
    return Y.incomplete_headline(Y.coverage_report(t["v_professors"], _report_raw(t)))


@query("ledger_status", "A16", "select status, count(*) n from {v_ledger} group by 1")
def ledger_status(t):
    return common.status_counts(t["v_ledger"])


@query(
    "pipeline_report",
    "A25",
    _REPORT + """ select 'artifact' section, 'professors' item, count(*) n from {v_professors}
      union all select 'artifact', 'raw_profiles', count(*) from {v_raw_profiles}
      union all select 'ledger', status, count(*) from {v_ledger} group by status
      union all select 'coverage', 'incomplete', count(*) filter (incomplete = 'true') from report""",
)
def pipeline_report(t):
    coverage = Y.coverage_report(t["v_professors"], _report_raw(t))
    return Y.pipeline_status(
        {"professors": t["v_professors"], "raw_profiles": t["v_raw_profiles"]}, t["v_ledger"], coverage
    )


@query(
    "pending_profiles",
    "F22",
    "select seq, profile_url from {v_raw_profiles} r where not exists (select 1 from {v_ledger} l where l.profile_url = r.profile_url and status = 'done')",
)
def pending_profiles(t):
    return common.pending(t["v_raw_profiles"], t["v_ledger"], "profile_url").select("seq", "profile_url")


@query(
    "export_cells",
    "T34 U1 S14",
    f"""with {_JUDGED} select school_id, school_name, professor_name, coalesce(title, '') title, coalesce(cast("role" as string), '') is_faculty, profile_url from verdicts where verdict = 'kept'""",
)
def export_cells(t):
    return Y.export_rows(t["v_professors"]).drop("extraction_confidence")


@query(
    "output_slugs",
    "W6 T3",
    """with ids as (select distinct p_brand || case when p_size % 2 = 0 then ' A' else '_a' end school_id from {part}),
      b as (select school_id, trim(regexp_replace(lower(school_id), '[^a-z0-9]+', '-', 'g'), '-') base from ids),
      n as (select *, row_number() over (partition by base order by school_id) rn from b)
      select school_id, case when rn = 1 then base else base || '-' || base || '-' || rn end slug from n""",
)
def output_slugs(t):
    ids = t["part"].select(
        F.concat("p_brand", F.when(F.col("p_size") % 2 == 0, " A").otherwise("_a")).alias("school_id")
    )
    return Y.output_slugs(ids)


# ------------------------------------------------------------ extraction ----
def profile_pages(t):
    pages = t.dealt("v_profile_pages").select(
        "page_id", "school_id", "http_status", "html",
        F.concat(F.lit("https://x.edu/p/"), F.col("page_id").cast("string")).alias("profile_url"),
    )
    schools = t["v_school_families"].filter("families is not null").select(
        F.concat(F.lit("k"), F.col("k").cast("string")).alias("school_id"), F.lit("Acme College").alias("name")
    )
    return Y.with_school_names(pages, schools)


_OBFUSCATED = """case c_custkey % 4 when 3 then null else 'c' || c_custkey || '@acme.edu' end"""
_HINTS = f"""select c_custkey page_id, 'k' || c_nationkey school_id,
      case when c_nationkey % 5 <> 0 then 'Acme College' else 'k' || c_nationkey end school_name, c_custkey % 11 = 0 dead,
      case when c_custkey % 3 = 0 then c_name end ld_name, case when c_custkey % 3 = 0 then 'Dept ' || c_nationkey end ld_dept,
      case when c_custkey % 5 = 0 then c_name || case when c_nationkey % 5 <> 0 then '' else ' - Acme College' end end author,
      coalesce(case when c_custkey % 6 = 0 then 'm' || c_custkey || '@acme.edu' end, {_OBFUSCATED}) email,
      coalesce(case when c_custkey % 3 = 0 then '555-000-' || (1000 + c_custkey % 9000) end, '555-' || (100 + c_custkey % 900) || '-' || (1000 + c_custkey % 9000)) phone, c_name
    from {{customer}}"""


@query(
    "deterministic_extraction",
    "F12 J8 T20 T21 T22 T23 T24 T25 T26",
    f"""with h as ({_HINTS}) select page_id, school_name,
      case when dead then 'non_200' when coalesce(ld_name, author) is null then 'no_name' else 'extracted' end outcome,
      case when not dead then coalesce(ld_name, author) end professor_name, case when not dead then ld_dept end department,
      case when not dead then email end email, case when not dead then phone end phone from h""",
)
def deterministic_extraction(t):
    out = Y.extract_deterministic(profile_pages(t))
    return out.select("page_id", "school_name", "outcome", "professor_name", "department", "email", "phone")


@query(
    "nested_jsonld",
    "T23",
    """select c_custkey, case when c_custkey % 6 = 5 then null else c_name end "name", case when c_custkey % 6 < 4 then c_mktsegment end department,
      case when c_custkey % 6 = 3 then null when c_custkey % 6 < 5 then 'p' || c_custkey || '@x.edu' end email from {customer}""",
)
def nested_jsonld(t):
    """People inside lists and `@graph` lists of one another, behind broken JSON, after other objects, and none."""
    k = F.col("c_custkey")
    text = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    mail = F.when(k % 6 == 3, F.lit("17")).otherwise(F.concat(F.lit('"mailto:p'), k.cast("string"), F.lit('@x.edu"')))
    place = F.when(k % 6 < 4, F.concat(F.lit('{"name":'), text(F.col("c_mktsegment")), F.lit("}"))).otherwise("[]")
    person = F.concat(F.lit('{"@type":["Thing","Person"],"name":'), text(F.col("c_name")), F.lit(',"worksFor":'), place, F.lit(',"email":'), mail, F.lit("}"))
    body = (
        F.when(k % 6 == 0, person)
        .when(k % 6 == 1, F.concat(F.lit('[[{"@type":"Org"},['), person, F.lit("]]]")))
        .when(k % 6 == 2, F.concat(F.lit('{"@graph":[{"@graph":[[{"@graph":[{"@type":"WebPage"},'), person, F.lit("]}]]}]}")))
        .when(k % 6 == 3, F.concat(F.lit('{"@graph":[]}</script><script type="application/ld+json">{broken</script><script type="application/ld+json">['), person, F.lit("]")))
        .when(k % 6 == 4, F.concat(F.lit('{"@graph":{"@type":"Person"},"@type":"Org"}</script><script type="application/ld+json">'), person))
        .otherwise(F.concat(F.lit('{"mainEntity":'), person, F.lit("}")))
    )
    page = F.concat(F.lit('<html><head><script type="application/ld+json">'), body, F.lit("</script></head></html>"))
    found = t.dealt("customer").select(k, H.jsonld_person(page).alias("p"))
    return found.select("c_custkey", "p.name", "p.department", "p.email")


@query(
    "extraction_summary",
    "A17",
    f"""with h as ({_HINTS}) select 'extract' stage, count(*) filter (not dead and coalesce(ld_name, author) is not null) processed,
      count(*) filter (dead or coalesce(ld_name, author) is null) skipped, count(*) filter (false) failed from h""",
)
def extraction_summary(t):
    return Y.stage_summary(Y.extract_deterministic(profile_pages(t)), "extract")


@query(
    "page_parse_hints",
    "T28 T24",
    """select c_custkey page_id, c_name h_name, 'Staff' h_title,
      coalesce(case when c_custkey % 7 = 0 then c_mktsegment end, case when c_custkey % 5 = 0 then c_name || ' - Acme College' end) meta_name from {customer}""",
)
def page_parse_hints(t):
    hint = H.parse_hint(F.col("html"))
    return t.dealt("v_profile_pages").select(
        "page_id", hint["name"].alias("h_name"), hint["title"].alias("h_title"),
        H.meta_name(F.col("html")).alias("meta_name"),
    )


def _proposals(t):
    """Proposals of mixed quality: invented contacts, missing keys, wrong types, non-profiles."""
    k = F.col("c_custkey")
    s = lambda c: c.cast("string")
    full = F.map_from_arrays(
        F.array(*[F.lit(x) for x in (*Y.PROPOSAL_KEYS, "is_faculty")]),
        F.array(
            F.when(k % 7 == 0, "maybe").when(k % 7 == 1, "false").otherwise("true"),
            F.when(k % 13 == 0, " ").otherwise(F.concat("c_name", F.lit(" | Acme College"))),
            F.when(k % 4 == 0, "Professor of Physics").when(k % 4 == 1, "Provost").otherwise("Gardener"),
            F.lit(" "),
            F.when(k % 3 == 0, F.lit("made.up@acme.edu")).otherwise(F.concat(F.lit("C"), s(k), F.lit("@acme.edu"))),
            F.when(k % 2 == 0, F.concat(F.lit("(555) "), s(100 + k % 900), F.lit("."), s(1000 + k % 9000))).otherwise("12345"),
            F.lit("rivers; birds"),
            F.when(k % 17 == 0, "high").otherwise("1.4"),
            F.lit(""),
            F.when(k % 2 == 0, "false").otherwise("unsure"),
        ),
    )
    short = F.map_filter(full, lambda key, _: key != "notes")
    return t["customer"].select(
        F.concat(F.lit("https://x.edu/p/"), s(k)).alias("profile_url"),
        F.when(k % 19 == 0, short).otherwise(full).alias("proposal"),
    )


@query(
    "grounded_extraction",
    "T14 T26 T27 T36 E3",
    f"""with h as ({_HINTS}), p as (select *, page_id % 19 = 0 or page_id % 7 = 0 or page_id % 17 = 0 or (page_id % 7 > 1 and page_id % 13 = 0) bad from h),
      o as (select *, case when dead then 'non_200' when bad then 'invalid' when page_id % 7 = 1 then 'not_a_profile' else 'extracted' end outcome,
        page_id % 7 > 1 and page_id % 13 <> 0 person from p)
      select page_id, outcome, case when person then case when school_name = 'Acme College' then c_name else c_name || ' | Acme College' end end professor_name,
        case when person then case when page_id % 4 = 0 then true when page_id % 4 = 1 then false when page_id % 2 = 0 then false end end is_faculty,
        case when person and not dead and page_id % 3 <> 0 and page_id % 4 <> 3 and (page_id % 4 = 1 or lower(email) = 'c' || page_id || '@acme.edu') then 'C' || page_id || '@acme.edu' end email,
        case when person and not dead and page_id % 2 = 0 then '(555) ' || (100 + page_id % 900) || '.' || (1000 + page_id % 9000) end phone,
        case when person and page_id % 17 <> 0 then 1e0 else 0e0 end extraction_confidence from o""",
)
def grounded_extraction(t):
    out = Y.extract_with_proposals(profile_pages(t), _proposals(t))
    return out.select(
        "page_id", "outcome", "professor_name", "is_faculty", "email", "phone", "extraction_confidence"
    )


@query(
    "contacts_in_text",
    "T20 T21",
    r"""select doc_id, nullif(regexp_extract(regexp_replace(regexp_replace(text, '(?i)\s*[\[(]\s*at\s*[\])]\s*', '@', 'g'), '(?i)\s*[\[(]\s*dot\s*[\])]\s*', '.', 'g'), '[\p{L}\p{N}\p{M}_.+\-]+@[\p{L}\p{N}\p{M}_-]+(?:\.[\p{L}\p{N}\p{M}_-]+)+'), '') email,
      nullif(trim(regexp_extract(text, '(?i)(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]\d{3}[-.\s]\d{4}(?:\s*(?:x|ext\.?)\s*\d{1,6})?')), '') phone from {documents}""",
)
def contacts_in_text(t):
    return common.spread(t["documents"]).select(
        "doc_id",
        H.email_in_text(F.col("text")).alias("email"),
        H.phone_in_text(F.col("text")).alias("phone"),
    )
