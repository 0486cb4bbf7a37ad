"""Catalog build: cleaning, tier joins, tri-state enrichment, merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from matricula import fixed_values as V
from matricula.functions import nested, numeric, text
from matricula.operators import catalog as C
from matricula.operators import details as D
from matricula.operators.common import spread
from workload.registry import query

_MISSING = "('', 'NA', 'NULL', 'PrivacySuppressed')"


def num(c: str) -> str:
    return f"(case when trim({c}) in {_MISSING} then null else try_cast(trim({c}) as double) end)"


def norm_name(c: str) -> str:
    x = f"replace(replace(trim(lower({c})), '–', '-'), '—', '-')"
    x = f"regexp_replace({x}, ',\\s*', '-', 'g')"
    x = f"regexp_replace({x}, '-main campus$', '')"
    x = f"regexp_replace({x}, '\\bthe\\b|\\bat\\b', '', 'g')"
    return f"regexp_replace({x}, '[^a-z0-9]+', '', 'g')"


_NET = f"coalesce(case when {num('NPT4_PUB')} > 0 then {num('NPT4_PUB')} end, case when {num('NPT4_PRIV')} > 0 then {num('NPT4_PRIV')} end)"


def federal(t):
    """The federal fixture with every used column, missing ones as null cells."""
    df = t["v_scorecard"]
    have = {c.upper() for c in df.columns}
    return df.withColumns(
        {c: F.lit(None).cast("string") for c in V.SCORECARD_COLUMNS if c.upper() not in have}
    )


@query(
    "cleaned_cells",
    "F25 T12 M10 M11",
    f"""select seq, {num('SAT_AVG')} sat, {_NET} net_price,
      case when {num('UGDS')} is null then 'medium' when {num('UGDS')} < 5000 then 'small' when {num('UGDS')} < 15000 then 'medium' else 'large' end size,
      case when trim(STABBR) in {_MISSING} then null else trim(STABBR) end state from {{v_scorecard}}""",
)
def cleaned_cells(t):
    c = F.col
    return t["v_scorecard"].select(
        "seq",
        numeric.parse_number(c("SAT_AVG")).alias("sat"),
        numeric.net_price(c("NPT4_PUB"), c("NPT4_PRIV")).alias("net_price"),
        numeric.size_band(numeric.parse_number(c("UGDS"))).alias("size"),
        numeric.text_or_null(c("STABBR")).alias("state"),
    )


@query(
    "name_keys",
    "T1 T2 T5 T30",
    f"""select p_partkey, {norm_name("concat('The ', p_name, ', ', p_brand, ' at ', p_type, '-Main Campus')")} key,
      trim(regexp_replace(lower(concat(p_name, ' (', p_brand, ')')), '[^a-z0-9]+', '-', 'g'), '-') slug,
      trim(regexp_replace(regexp_replace(lower(concat(p_name, '. ', p_brand)), '[^a-z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g')) same_key,
      sha256(p_name) sha from {{part}}""",
)
def name_keys(t):
    n, b, k = F.col("p_name"), F.col("p_brand"), F.col("p_type")
    return t["part"].select(
        "p_partkey",
        text.normalize_name(F.concat(F.lit("The "), n, F.lit(", "), b, F.lit(" at "), k, F.lit("-Main Campus"))).alias("key"),
        text.slugify(F.concat(n, F.lit(" ("), b, F.lit(")"))).alias("slug"),
        text.institution_key(F.concat(n, F.lit(". "), b)).alias("same_key"),
        F.sha2(n, 256).alias("sha"),
    )


@query(
    "folded_slugs",
    "T3 T4",
    r"""select doc_id, trim(regexp_replace(lower(regexp_replace(strip_accents(text), '[^\x00-\x7F]', '', 'g')), '[^a-z0-9]+', '-', 'g'), '-') slug,
      trim(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(strip_accents(text), '[^\x00-\x7F]', '', 'g'), '\s*\(.*?\)', '', 'g'), '[^A-Za-z ]', ' ', 'g')), '\s+', ' ', 'g')) match_key
      from {documents}""",
)
def folded_slugs(t):
    return spread(t["documents"]).select(
        "doc_id",
        text.slugify_folded(F.col("text")).alias("slug"),
        text.match_name(F.col("text")).alias("match_key"),
    )


_KEYED = f"""
    keyed as (select t.*, case when country = 'USA' then {norm_name('coalesce(a.alias, t.name)')} end key
      from {{v_tier1}} t left join {{v_aliases}} a on a.name = t.name),
    federal as (select * from (select *, {norm_name('INSTNM')} fkey, row_number() over (partition by {norm_name('INSTNM')} order by seq) rn from {{v_scorecard}}) where rn = 1)"""


@query(
    "scorecard_join",
    "J1 S18 W3",
    f"with {_KEYED} select id, name, UNITID unitid, fkey is not null matched from keyed left join federal on key = fkey",
)
def scorecard_join(t):
    joined = C.join_scorecard(t["v_tier1"], t["v_scorecard"], t["v_aliases"])
    return joined.select("id", "name", F.col("UNITID").alias("unitid"), F.col("_matched").alias("matched"))


@query(
    "unmatched_us_schools",
    "J2",
    f"with {_KEYED} select id, name from keyed where country = 'USA' and key not in (select fkey from federal)",
)
def unmatched_us_schools(t):
    return C.unmatched_us_names(t["v_tier1"], t["v_scorecard"], t["v_aliases"])


def _enriched(t):
    return C.enrich(C.join_scorecard(t["v_tier1"], federal(t), t["v_aliases"]))


@query(
    "enriched_catalog",
    "M10 M11 N2 T12",
    f"""with {_KEYED} select id, UNITID unitid, case when trim(STABBR) in {_MISSING} then null else trim(STABBR) end state,
      cast(trunc({num('SAT_AVG')}) as int) avg_sat, {num('ADM_RATE')} acceptance_rate, coalesce({_NET}, k.net_price) net_price,
      {num('TUITIONFEE_OUT')} sticker_tuition, {num('TUITIONFEE_IN')} tuition_in_state, cast(trunc({num('UGDS')}) as int) enrollment,
      case when coalesce({num('UGDS')}, enrollment_editorial) is null then 'medium' when coalesce({num('UGDS')}, enrollment_editorial) < 5000 then 'small' when coalesce({num('UGDS')}, enrollment_editorial) < 15000 then 'medium' else 'large' end size,
      {num('C150_4')} graduation_rate, coalesce({num('C150_4')}, {num('MD_EARN_WNE_P10')}) is not null has_outcomes,
      {num('UGDS_NRA')} international_share, coalesce({num('UGDS_NRA')}, {num('UGDS_WOMEN')}) is not null has_population,
      case when trim(INSTURL) in {_MISSING} then null else trim(INSTURL) end url
      from keyed k left join federal on key = fkey""",
)
def enriched_catalog(t):
    return _enriched(t).select(
        "id", "unitid", "state", "avg_sat", "acceptance_rate", "net_price", "sticker_tuition",
        "tuition_in_state", "enrollment", "size",
        F.col("outcomes")["graduation_rate"].alias("graduation_rate"),
        F.col("outcomes").isNotNull().alias("has_outcomes"),
        F.col("population")["international_share"].alias("international_share"),
        F.col("population").isNotNull().alias("has_population"), "url",
    )


@query(
    "awarded_programs",
    "N1 W9",
    f"""with {_KEYED}, wide as (select id, fkey, unnest([{{{{'n': 'Computer & Information Sciences', 's': {num('PCIP11')}}}}},
        {{{{'n': 'Engineering', 's': {num('PCIP14')}}}}}, {{{{'n': 'Business, Management & Marketing', 's': {num('PCIP52')}}}}}]) p from keyed join federal on key = fkey)
      select id, cast(row_number() over (partition by id order by round(p.s, 4) desc, p.n) - 1 as int) pos, p.n family, round(p.s, 4) share
      from wide where p.s is not null and p.s <> 0""".replace("{{", "{").replace("}}", "}"),
)
def awarded_programs(t):
    rows = _enriched(t).select("id", F.posexplode("programs").alias("pos", "p"))
    return rows.select("id", "pos", F.col("p")["name"].alias("family"), F.col("p")["share"].alias("share"))


_ABSENT = "case when country = 'USA' then 'absent' else 'not_applicable' end"


@query(
    "field_provenance",
    "M19",
    f"""with {_KEYED}, j as (select k.*, f.* exclude (seq) from keyed k left join federal f on key = fkey)
      select id, x.f field, x.o origin from (select id, unnest([
        {{'f': 'avg_gpa', 'o': 'editorial'}}, {{'f': 'culture', 'o': 'editorial'}}, {{'f': 'region', 'o': 'editorial'}},
        {{'f': 'setting', 'o': 'editorial'}}, {{'f': 'type', 'o': 'editorial'}},
        {{'f': 'net_price', 'o': case when {_NET} is not null then 'observed' when net_price is not null then 'editorial' else 'absent' end}},
        {{'f': 'avg_sat', 'o': case when {num('SAT_AVG')} is not null then 'observed' else {_ABSENT} end}},
        {{'f': 'acceptance_rate', 'o': case when {num('ADM_RATE')} is not null then 'observed' else 'absent' end}},
        {{'f': 'enrollment', 'o': case when {num('UGDS')} is not null then 'observed' else 'absent' end}},
        {{'f': 'sticker_tuition', 'o': case when {num('TUITIONFEE_OUT')} is not null then 'observed' else 'absent' end}},
        {{'f': 'tuition_in_state', 'o': case when {num('TUITIONFEE_IN')} is not null then 'observed' else {_ABSENT} end}},
        {{'f': 'state', 'o': case when trim(STABBR) not in {_MISSING} then 'observed' else {_ABSENT} end}},
        {{'f': 'programs', 'o': case when fkey is not null then 'observed' else {_ABSENT} end}},
        {{'f': 'outcomes', 'o': case when coalesce({num('C150_4')}, {num('MD_EARN_WNE_P10')}) is not null then 'observed' else 'absent' end}},
        {{'f': 'population', 'o': case when coalesce({num('UGDS_NRA')}, {num('UGDS_WOMEN')}) is not null then 'observed' else {_ABSENT} end}}
      ]) x from j)""",
)
def field_provenance(t):
    return C.provenance_rows(_enriched(t))


# ------------------------------------------------------------- tri-state ----
def _doc_catalog(t):
    return t["documents"].select(
        F.col("doc_id").alias("id"),
        F.when(F.col("lang") == "en", "USA").otherwise("Canada").alias("country"),
        F.create_map().cast("map<string,string>").alias("provenance"),
    )


def _state(c):
    return F.when(c.isNull(), "null").when(F.size(c) == 0, "empty").otherwise("list")


@query(
    "details_state",
    "J3 N9",
    """select d.doc_id id, case when n_entries > 0 then n_entries end n,
      case when coalesce(n_entries, 0) = 0 then 'absent' when v.source = 'curated' then 'observed' when v.source = 'web_verified' then 'web_verified' else 'editorial' end origin
      from {documents} d left join {v_details} v on d.doc_id = v.doc_id""",
)
def details_state(t):
    n = F.col("n_entries")
    keys = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: i.cast("string"))
    record = F.map_concat(
        F.create_map(F.lit("_source"), F.col("source")), F.map_from_arrays(keys, keys)
    )
    empty = F.create_map().cast("map<string,string>")
    details = t["v_details"].select(
        F.col("doc_id").alias("id"), F.when(n == 0, empty).otherwise(record).alias("details")
    )
    out = C.attach_details(_doc_catalog(t), details)
    return out.select("id", F.size("details").alias("n"), F.col("provenance")["details"].alias("origin"))


def _people(t, field, fields):
    person = F.struct(*[F.lit(f).alias(f) for f in fields], F.lit("secret@x.edu").alias("email"))
    return t["v_details"].select(
        F.col("doc_id").alias("id"),
        F.when(F.col("n_entries") == 0, F.slice(F.array(person), 1, 0))
        .otherwise(F.array_repeat(person, F.col("n_entries")))
        .alias(field),
    )


_PEOPLE = """select d.doc_id id, case when lang <> 'en' or n_entries is null then 'null' when n_entries = 0 then 'empty' else 'list' end state,
      case when lang <> 'en' then 'not_applicable' when n_entries is null then 'absent' else '{found}' end origin, {n} n_fields
      from {{documents}} d left join {{v_details}} v on d.doc_id = v.doc_id"""


def _people_state(t, field, fields, attach):
    out = attach(_doc_catalog(t), _people(t, field, fields))
    n_fields = len(out.schema[field].dataType.elementType.fields)
    return out.select(
        "id", _state(F.col(field)).alias("state"), F.col("provenance")[field].alias("origin"),
        F.lit(n_fields).alias("n_fields"),
    )


@query("notable_state", "J4 F10 F11", _PEOPLE.format(found="web_verified", n=8))
def notable_state(t):
    return _people_state(t, "notable_faculty", V.NOTABLE_FIELDS, C.attach_notable)


@query("active_state", "J5 F10 F11", _PEOPLE.format(found="observed", n=9))
def active_state(t):
    return _people_state(t, "active_faculty", V.ACTIVE_FIELDS, C.attach_active)


# --------------------------------------------------------------- dedupe -----
@query(
    "merged_duplicates",
    "W2 S8",
    """with m as (select p_name, p_partkey, unnest([p_type, p_brand, p_type]) major, unnest([0, 1, 2]) pos from {part}),
      f as (select p_name, major, min(p_partkey * 10 + pos) at_ from m group by 1, 2)
      select f.p_name "name", (select min(p_partkey) from {part} q where q.p_name = f.p_name) first_id, f.major,
        cast(row_number() over (partition by f.p_name order by at_) - 1 as int) pos from f""",
)
def merged_duplicates(t):
    records = t["part"].select(
        F.col("p_name").alias("name"),
        F.col("p_partkey").alias("seq"),
        F.col("p_partkey").alias("first_id"),
        F.array("p_type", "p_brand", "p_type").alias("majors"),
    )
    merged = C.dedupe_by_name(records)
    return merged.select("name", "first_id", F.posexplode("majors").alias("pos", "major"))


_SLUGS = "with s as (select p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') slug from {part})"


def _slugged(t):
    return t["part"].select("p_partkey", text.slugify(F.col("p_name")).alias("slug"))


@query("slug_dedupe", "W3 T2", _SLUGS + " select slug, min(p_partkey) p_partkey from s group by slug")
def slug_dedupe(t):
    return C.dedupe_by_slug(_slugged(t), seq="p_partkey")


@query("duplicate_slugs", "W3", _SLUGS + " select count(*) - count(distinct slug) duplicate_slugs from s")
def duplicate_slugs(t):
    return C.duplicate_slugs(_slugged(t))


@query(
    "excluded_institutions",
    "F7",
    "select id, name from {v_universities} u where not exists (select 1 from {part} p where p_size = 50 and concat(p_name, ' ', p_brand) = u.name)",
)
def excluded_institutions(t):
    gone = t["part"].filter("p_size = 50").select(F.concat_ws(" ", "p_name", "p_brand").alias("name"))
    return C.drop_excluded(t["v_universities"].select("id", "name"), gone)


@query(
    "catalog_statistics",
    "A1",
    "select count(*) size, count(*) filter (setting = 'rural') rural, count(*) filter (net_price is not null) with_details from {v_universities}",
)
def catalog_statistics(t):
    priced = F.create_map(F.lit("net_price"), F.col("net_price"))
    empty = F.create_map().cast("map<string,double>")
    return C.catalog_stats(
        t["v_universities"].withColumn(
            "details", F.when(F.col("net_price").isNotNull(), priced).otherwise(empty)
        )
    )


@query(
    "stale_catalog_ids",
    "U2 S12",
    "select id from {v_universities} where setting = 'rural'",
)
def stale_catalog_ids(t):
    catalog = t["v_universities"].filter("setting <> 'rural'")
    return C.stale_ids(t["v_universities"], catalog)


@query(
    "catalog_upsert",
    "S12",
    "select id, case when setting = 'rural' then 'old' else 'new' end version from {v_universities}",
)
def catalog_upsert(t):
    new = t["v_universities"].filter("setting <> 'rural'").select("id", F.lit("new").alias("version"))
    old = t["v_universities"].select("id", F.lit("old").alias("version"))
    return C.upsert(old, new, prune=False)


# ---------------------------------------------------------- batch merging ---
def _batches(t):
    return t["v_batches"].withColumn("retrieved", F.lit(None).cast("string"))


def _prior(t):
    return t["v_prior_details"].withColumn("retrieved", F.lit(None).cast("string"))


_EMPTY = "('', 'n/a', 'na', 'none', 'none found', 'not found', 'unknown', 'tbd', 'null')"
_CLEAN = f"""
    last as (select * from (select *, row_number() over (partition by batch, school_id order by seq desc) rn from {{v_batches}}) where rn = 1),
    clean as (select batch, school_id,
        case when lower(trim(faculty)) not in {_EMPTY} then faculty end faculty,
        case when lower(trim(research)) not in {_EMPTY} then research end research,
        list_filter(src, lambda s: starts_with(s, 'http')) src from last),
    judged as (select *, coalesce(faculty, research) is not null and len(src) > 0 usable from clean),
    win as (select school_id, min(case when faculty is not null then batch end) bf, min(case when research is not null then batch end) br, min(batch) b0
      from judged where usable group by 1),
    prior as (select *, faculty is null or lower(trim(faculty)) in {_EMPTY} open_f, research is null or lower(trim(research)) in {_EMPTY} open_r from {{v_prior_details}}),
    fold as (select coalesce(p.school_id, w.school_id) school_id, p.school_id is null is_new, p.faculty pf, p.research pr, p.src psrc,
        case when coalesce(open_f, true) then bf end bf, case when coalesce(open_r, true) then br end br, b0
      from prior p full outer join win w on p.school_id = w.school_id)"""


@query(
    "merged_details",
    "J23 F8 F9 U3",
    f"""with {_CLEAN}, joined as (select f.*, a.faculty nf, a.src fsrc, b.research nr, b.src rsrc from fold f
        left join judged a on a.usable and a.school_id = f.school_id and a.batch = f.bf
        left join judged b on b.usable and b.school_id = f.school_id and b.batch = f.br),
      urls as (select school_id, u, min(o * 100 + p) at_ from (
          select school_id, unnest(psrc) u, 0 o, generate_subscripts(psrc, 1) p from joined
          union all select school_id, unnest(fsrc), case when bf <= br or br is null then 1 else 2 end, generate_subscripts(fsrc, 1) from joined
          union all select school_id, unnest(rsrc), case when bf <= br or br is null then 2 else 1 end, generate_subscripts(rsrc, 1) from joined) group by 1, 2)
      select j.school_id, coalesce(nf, pf) faculty, coalesce(nr, pr) research,
        (select string_agg(u, '|' order by at_) from urls x where x.school_id = j.school_id) src from joined j""",
)
def merged_details(t):
    merged = D.merge_details(_prior(t), _batches(t))
    return merged.select("school_id", "faculty", "research", F.array_join("src", "|").alias("src"))


@query(
    "merge_statistics",
    "A19 N10",
    f"""with {_CLEAN}, flags as (select j.batch, j.usable, f.is_new and f.b0 = j.batch is_new,
          coalesce(j.batch = f.bf, false) wf, coalesce(j.batch = f.br, false) wr, j.faculty, j.research
        from judged j left join fold f on f.school_id = j.school_id)
      select batch, cast(sum(case when usable and (wf or wr) then 1 else 0 end) as bigint) added,
        cast(sum(case when not usable then 1 else 0 end) as bigint) skipped_empty,
        cast(sum(case when usable then (case when faculty is not null and not wf then 1 else 0 end) + (case when research is not null and not wr then 1 else 0 end) else 0 end) as bigint) skipped_existing,
        cast(sum(case when usable and is_new then 1 else 0 end) as bigint) new_schools
      from flags group by rollup (batch)""",
)
def merge_statistics(t):
    return D.merge_statistics(_prior(t), _batches(t))


@query(
    "section_coverage",
    "A23",
    f"""with {_CLEAN} select count(*) schools,
        count(*) filter (bf is not null or coalesce(lower(trim(pf)) not in {_EMPTY}, false)) with_faculty,
        count(*) filter (br is not null or coalesce(lower(trim(pr)) not in {_EMPTY}, false)) with_research from fold""",
)
def section_coverage(t):
    return D.section_coverage(D.merge_details(_prior(t), _batches(t)))


@query(
    "research_worklist",
    "S20",
    """with done as (select id, setting = 'rural' r, setting <> 'urban' f from {v_universities}),
      todo as (select u.id, u.name, u.location, u.acceptance_rate, r has_research from {v_universities} u join done d on u.id = d.id where not (r and f))
      select *, row_number() over (order by acceptance_rate asc nulls last, id) "position",
        cast(floor((row_number() over (order by acceptance_rate asc nulls last, id) - 1) / 25) + 1 as int) batch from todo""",
)
def research_worklist(t):
    unis = t["v_universities"]
    details = unis.select(
        "id",
        F.when(F.col("setting") != "urban", "who").otherwise("n/a").alias("faculty"),
        F.when(F.col("setting") == "rural", "what").alias("research"),
    )
    return C.worklist(unis, details, 25)
