"""Domain-shaped views over the given tables.

Every view is one SQL text that both engines run, over whole tables. `{name}`
refers to a base table or to another view.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from matricula.operators.common import spread

_S, _L, _I, _D = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()
_TS = T.TimestampNTZType()
BASE_SCHEMAS = {
    name: T.StructType([T.StructField(c, t) for c, t in columns.items()])
    for name, columns in {
        "region": {"r_regionkey": _I, "r_name": _S},
        "nation": {"n_nationkey": _I, "n_name": _S, "n_regionkey": _I},
        "customer": {"c_custkey": _L, "c_name": _S, "c_nationkey": _I, "c_acctbal": _D,
                     "c_mktsegment": _S},
        "supplier": {"s_suppkey": _L, "s_name": _S, "s_nationkey": _I, "s_acctbal": _D},
        "part": {"p_partkey": _L, "p_name": _S, "p_brand": _S, "p_type": _S, "p_size": _I,
                 "p_retailprice": _D},
        "orders": {"o_orderkey": _L, "o_custkey": _L, "o_orderstatus": _S, "o_totalprice": _D,
                   "o_orderdate": _TS, "o_orderpriority": _S},
        "lineitem": {"l_orderkey": _L, "l_partkey": _L, "l_suppkey": _L, "l_linenumber": _I,
                     "l_quantity": _D, "l_extendedprice": _D, "l_discount": _D, "l_tax": _D,
                     "l_returnflag": _S, "l_linestatus": _S, "l_shipdate": _TS},
        "events": {"event_id": _L, "ts": _TS, "user_id": _L, "event_type": _S, "value": _D,
                   "props": _S},
        "documents": {"doc_id": _L, "text": _S, "lang": _S, "source": _S, "n_chars": _L},
        "labels": {"doc_id": _L, "quality": _I, "toxic": _I},
        "pages": {"page_id": _L, "url": _S, "html": _S},
        "conversations": {"conv_id": _L, "turn": _L, "role": _S, "text": _S},
    }.items()
}

VIEWS: dict[str, str] = {
    # one university per part: row-level catalog work grows with the table
    "v_universities": """
        select concat('u', lpad(cast(p_partkey as string), 12, '0')) as id,
          concat(p_name, ' ', p_brand) as name,
          case when p_partkey % 5 = 0 then 'Canada' else 'USA' end as country,
          concat(split_part(p_name, ' ', 1), ', ', case p_partkey % 4 when 0 then 'CA' when 1 then 'NY' when 2 then 'tx' else 'Illinois' end) as location,
          case when p_partkey % 5 = 0 then null when p_partkey % 4 = 0 then 'CA' when p_partkey % 4 = 1 then 'NY' when p_partkey % 4 = 2 then 'TX' else 'IL' end as state,
          case when p_partkey % 5 = 0 then 'International' when p_partkey % 4 = 0 then 'West' when p_partkey % 4 = 1 then 'Northeast' when p_partkey % 4 = 2 then 'South' else 'Midwest' end as region,
          case when p_type in ('PROMO', 'ECONOMY') then 'rural' when p_type in ('STANDARD', 'MEDIUM') then 'suburban' else 'urban' end as setting,
          case when p_partkey % 3 = 0 then 'Public' else 'Private' end as type,
          2.5e0 + cast(p_partkey % 16 as double) / 10e0 as avg_gpa,
          case when p_partkey % 5 = 0 or p_partkey % 7 = 0 then null else cast(900 + (p_partkey * 37 % 69) * 10 as int) end as avg_sat,
          case when p_partkey % 5 = 0 or p_partkey % 11 = 0 then null else cast(5 + p_partkey * 13 % 90 as double) / 100e0 end as acceptance_rate,
          case when p_size = 1 then null else 5000e0 + p_size * 900e0 end as net_price,
          12000e0 + p_size * 800e0 as sticker_tuition,
          case when p_partkey % 5 = 0 then null when p_partkey % 3 = 0 then 6000e0 + p_size * 200e0 else 12000e0 + p_size * 800e0 end as tuition_in_state,
          case when p_partkey % 13 = 0 then null else p_size * 700 end as enrollment,
          split(p_name, ' ') as majors
        from {part}""",
    # the ranked catalog: one school per (brand, type), attributes aggregated from all parts
    "v_catalog": """
        select id, concat('School ', id) as name,
          case when z % 5 = 0 then 'Canada' else 'USA' end as country,
          concat('Town ', cast(b as string), case when z % 5 = 0 then ', Ontario' else ', NY' end) as location,
          case when z % 5 = 0 then null when z % 4 = 0 then 'CA' when z % 4 = 1 then 'NY' when z % 4 = 2 then 'TX' else 'IL' end as state,
          case when z % 5 = 0 then 'International' when z % 4 = 0 then 'West' when z % 4 = 1 then 'Northeast' when z % 4 = 2 then 'South' else 'Midwest' end as region,
          case when t < 2 then 'rural' when t < 4 then 'suburban' else 'urban' end as setting,
          case when z % 3 = 0 then 'Public' else 'Private' end as type,
          2.5e0 + cast(z % 16 as double) / 10e0 as avg_gpa,
          case when z % 5 = 0 or z % 7 = 0 then null else cast(900 + (z * 37 % 69) * 10 as int) end as avg_sat,
          case when z % 5 = 0 or z % 11 = 0 then null else cast(5 + z * 13 % 90 as double) / 100e0 end as acceptance_rate,
          case when y % 17 = 0 then null else 5000e0 + cast(y % 50 as double) * 900e0 end as net_price,
          12000e0 + cast(y % 50 as double) * 800e0 as sticker_tuition,
          case when z % 5 = 0 then null when z % 3 = 0 then 6000e0 + cast(y % 50 as double) * 200e0 else 12000e0 + cast(y % 50 as double) * 800e0 end as tuition_in_state,
          case when y % 13 = 0 then null else cast((1 + y % 50) * 700 as int) end as enrollment,
          split(concat(case b % 5 when 0 then 'Computer Science,Engineering' when 1 then 'Biology,Chemistry' when 2 then 'Music,Studio Art' when 3 then 'History,English' else 'Nursing,Public Health' end,
            case t % 3 when 0 then ',Economics' when 1 then ',Kinesiology' else ',Law' end), ',') as majors,
          cast(z * 3 % 11 as double) / 10e0 as c_collab,
          cast(z * 5 % 11 as double) / 10e0 as c_quirky,
          cast(z * 7 % 11 as double) / 10e0 as c_idealist,
          cast(z * 2 % 11 as double) / 10e0 as c_research,
          cast(z * 9 % 11 as double) / 10e0 as c_spirit,
          cast(z * 4 % 11 as double) / 10e0 as c_seminar
        from (
          select concat('u', lpad(cast(b as string), 2, '0'), cast(t as string)) as id, b, t,
            cast(sum(p_size) as bigint) as y, cast(sum(p_partkey % 1000 + p_size) as bigint) as z
          from (
            select p_partkey, p_size, cast(replace(p_brand, 'Brand#', '') as int) as b,
              case p_type when 'PROMO' then 0 when 'ECONOMY' then 1 when 'STANDARD' then 2 when 'MEDIUM' then 3 when 'SMALL' then 4 else 5 end as t
            from {part}) p
          group by b, t) g""",
    "v_profiles": """
        select c_custkey as profile_id,
          2e0 + cast(c_custkey % 21 as double) / 10e0 as gpa,
          case when c_custkey % 3 = 0 then null else cast(800 + (c_custkey * 7 % 81) * 10 as int) end as sat,
          case c_mktsegment when 'MACHINERY' then 'Computer Science' when 'AUTOMOBILE' then 'biology' when 'FURNITURE' then 'Music' when 'BUILDING' then 'History' else 'nursing' end as intended_major,
          case when c_acctbal < 0 then null else 10000e0 + cast(floor(c_acctbal) as double) * 4e0 end as max_tuition,
          case c_nationkey % 5 when 0 then 'CA' when 1 then 'ny' when 2 then 'TX' when 3 then 'IL' else null end as home_state,
          case c_custkey % 4 when 0 then 'usa' when 1 then 'international' when 2 then 'both' else 'anywhere' end as scope,
          case when c_nationkey % 3 = 0 then 'Public' else null end as institution_type,
          case when c_custkey % 2 = 0 then split('West,South', ',') else null end as regions,
          case when c_nationkey % 2 = 0 then split('urban', ',') else null end as settings,
          0.5e0 + cast(c_custkey % 6 as double) / 10e0 as pf_collab,
          cast(c_custkey * 7 % 11 as double) / 10e0 as pf_quirky,
          cast(c_custkey % 11 as double) / 10e0 as pf_idealist,
          cast(c_nationkey % 11 as double) / 10e0 as pf_research,
          cast(c_nationkey * 3 % 11 as double) / 10e0 as pf_spirit,
          0.3e0 as pf_seminar,
          cast(c_custkey % 11 as double) / 10e0 as intensity,
          cast(c_custkey * 3 % 11 as double) / 10e0 as scale,
          case when c_custkey % 10 = 0 then 0.5e0 else null end as w_cost
        from {customer}""",
    # two activities per profile, whole texts
    "v_activities": """
        select doc_id as activity_id, cast(floor(doc_id / 2) as bigint) as profile_id,
          lower(text) as text
        from {documents}""",
    "v_raw_profiles": """
        select concat('s', cast(user_id % 20 as string)) as school_id,
          concat('https://s', cast(user_id % 20 as string), '.edu/people/', cast(event_id % 700 as string)) as profile_url,
          case when event_type = 'error' then 404 else 200 end as http_status,
          ts as fetched_at, event_id as seq
        from {events}""",
    "v_professors": """
        select d.source as school_id, concat('Name of ', d.source) as school_name, d.doc_id,
          concat('Person ', cast(d.doc_id as string)) as professor_name,
          case d.doc_id % 5 when 0 then 'Professor of Physics' when 1 then 'Provost' when 2 then 'Dean and Lecturer' when 3 then null else 'Gardener' end as title,
          case when l.quality is null then null when l.quality = 1 then true else false end as is_faculty,
          cast(d.doc_id * 17 % 101 as double) / 100e0 as extraction_confidence,
          concat('https://x.edu/people/', lower(d.lang), '-', cast(d.doc_id as string)) as profile_url
        from {documents} d left join {labels} l on d.doc_id = l.doc_id""",
    # degree families with amounts; suppliers in debt count as unmeasured
    "v_program_rows": """
        select s.s_suppkey as school_key, concat(l.l_returnflag, l.l_linestatus) as family,
          sum(cast(l.l_extendedprice as decimal(18, 2))) as amount
        from {lineitem} l join {supplier} s on l.l_suppkey = s.s_suppkey
        where s.s_acctbal >= 0
        group by s.s_suppkey, concat(l.l_returnflag, l.l_linestatus)""",
    "v_works": """
        select event_id as work_id, user_id as author_id, user_id % 20 as institution_id,
          cast(extract(day from ts) as int) as published_day, event_type as kind
        from {events}""",
    "v_scorecard": """
        select s_suppkey as seq, cast(1000 + s_suppkey as string) as UNITID,
          concat('University of  the ', n_name, ',', ' Campus ', cast(s_suppkey % 40 as string), '-Main Campus') as INSTNM,
          case when s_suppkey % 6 = 0 then ' ' else upper(substr(n_name, 1, 2)) end as STABBR,
          case s_suppkey % 7 when 0 then 'NA' when 1 then 'PrivacySuppressed' when 2 then '' else cast(900 + s_suppkey % 60 * 10 as string) end as SAT_AVG,
          case when s_suppkey % 4 = 0 then 'NULL' else concat('0.', cast(10 + s_suppkey % 80 as string)) end as ADM_RATE,
          case when s_suppkey % 2 = 0 then cast(cast(floor(s_acctbal) as int) as string) else 'NULL' end as NPT4_PUB,
          case when s_suppkey % 2 = 1 then cast(cast(floor(s_acctbal) as int) as string) else 'NULL' end as NPT4_PRIV,
          case when s_suppkey % 5 = 0 then 'NA' else cast(s_suppkey % 30 * 1000 as string) end as UGDS,
          cast(20000 + s_suppkey % 50 * 100 as string) as TUITIONFEE_OUT,
          case when s_suppkey % 8 = 0 then 'NA' else cast(9000 + s_suppkey % 50 * 100 as string) end as TUITIONFEE_IN,
          case when s_suppkey % 9 = 0 then 'NA' else '0.5' end as C150_4,
          case when s_suppkey % 9 = 0 then 'NA' else '51000' end as MD_EARN_WNE_P10,
          case when s_suppkey % 3 = 0 then 'NA' else '0.21' end as UGDS_NRA,
          case when s_suppkey % 3 = 0 then '' else '0.5' end as UGDS_WOMEN,
          case when s_suppkey % 10 = 0 then 'NA' else concat('https://', lower(replace(s_name, '#', '')), '.edu') end as INSTURL,
          case when s_suppkey % 4 = 0 then '0' else '0.25' end as PCIP11,
          case when s_suppkey % 6 = 0 then 'NA' else concat('0.', cast(10 + s_suppkey % 70 as string)) end as PCIP14,
          '0.12345' as PCIP52
        from {supplier} join {nation} on s_nationkey = n_nationkey""",
    "v_tier1": """
        select concat('t', cast(s_suppkey as string)) as id,
          concat('university of ', lower(n_name), '-campus ', cast(s_suppkey % 50 as string)) as name,
          case when s_suppkey % 6 = 0 then 'Canada' else 'USA' end as country,
          concat(n_name, ', NY') as location, 'West' as region, 'urban' as setting, 'Private' as type,
          3.1e0 as avg_gpa, case when s_suppkey % 3 = 0 then null else 15000e0 + s_nationkey end as net_price,
          case when s_suppkey % 4 = 0 then null else cast(s_suppkey % 40 * 700 as int) end as enrollment_editorial,
          split('Art,Music', ',') as majors, 'c' as culture
        from {supplier} join {nation} on s_nationkey = n_nationkey""",
    "v_aliases": """
        select concat('university of ', lower(n_name), '-campus 41') as name,
          concat('University of ', n_name, ', Campus 1') as alias
        from {nation}""",
    "v_details": """
        select doc_id, case when quality = 0 then 0 when toxic = 1 then 1 else 2 end as n_entries,
          case when toxic = 1 then 'web_verified' when quality = 1 then 'curated' else 'estimated' end as source
        from {labels}""",
    "v_list": """
        select o_custkey as student_id, o_orderkey as school_id,
          case o_orderpriority when '1-URGENT' then 'extreme_reach' when '2-HIGH' then 'reach' when '3-MEDIUM' then 'target' when '5-LOW' then 'safety' else null end as tier,
          o_totalprice as fit, o_orderstatus = 'F' as listed
        from {orders}""",
    "v_ledger": """
        select concat('https://s', cast(user_id % 20 as string), '.edu/people/', cast(event_id % 700 as string)) as profile_url,
          case when max(case when event_type = 'purchase' then 1 else 0 end) = 1 then 'done' else 'failed' end as status
        from {events} group by 1""",
    "v_slugs": """
        select p_brand as school_id, concat('https://x.edu/faculty/', replace(p_name, ' ', '-')) as profile_url
        from {part}""",
    "v_answers": """
        select conv_id as profile_id, turn % 8 as question,
          max(cast(length(text) % 11 as double)) / 10e0 as answer
        from {conversations} group by conv_id, turn % 8""",
    "v_authors": """
        select c_custkey as author_id, concat('inst', cast(c_nationkey as string)) as institution,
          2020 + c_custkey % 6 as aff_year, c_custkey % 9 = 0 as no_affiliation,
          case c_mktsegment when 'MACHINERY' then 'Engineering' when 'BUILDING' then 'Mathematics' when 'FURNITURE' then 'Arts and Humanities' when 'HOUSEHOLD' then 'Medicine' else 'Unmapped Field' end as primary_field,
          case when c_custkey % 4 = 0 then null else c_custkey % 60 end as h_index,
          case when c_custkey % 10 = 0 then 1 else 0 end as n_awards, c_name as display_name
        from {customer}""",
    "v_institutions": """
        select s_suppkey as cand_rank, s_nationkey as school_key,
          case when s_suppkey % 3 = 0 then concat('https://www', cast(s_suppkey % 2 as string), '.inst', cast(s_nationkey as string), '.edu/') else concat('https://other', cast(s_suppkey as string), '.ac.uk') end as homepage_url,
          case when s_suppkey % 4 = 0 then concat('Inst. ', cast(s_nationkey as string)) else s_name end as display_name
        from {supplier}""",
    "v_profile_pages": """
        select c_custkey as page_id,
          concat('<html><head><title>', c_name, ' | Acme College</title>',
            case when c_custkey % 3 = 0 then concat('<script type="application/ld+json">', case when c_custkey % 2 = 0 then '[' else '' end, '{"@type":"Person","name":"', c_name, '","telephone":"555-000-', cast(1000 + c_custkey % 9000 as string), '","worksFor":{"name":"Dept ', cast(c_nationkey as string), '"},"jobTitle":"',
              case c_custkey % 4 when 0 then 'Professor of Physics' when 1 then 'Provost' when 2 then 'Dean and Lecturer' else 'Gardener' end, '"}', case when c_custkey % 2 = 0 then ']' else '' end, '</script>') else '' end,
            case when c_custkey % 5 = 0 then concat('<meta name="author" content="', c_name, ' - Acme College">') else '' end,
            case when c_custkey % 7 = 0 then concat('<meta property="og:title" content="', c_mktsegment, '">') else '' end,
            '</head><body><nav>Menu</nav><h1>', c_name, ', Staff</h1><p>c', cast(c_custkey as string),
            case c_custkey % 4 when 0 then ' [at] acme (dot) edu' when 1 then '@acme.edu' when 2 then ' AT acme DOT edu' else '' end,
            '</p>', case when c_custkey % 6 = 0 then concat('<a href="mailto:m', cast(c_custkey as string), '%40acme.edu?x=1">m</a>') else '' end,
            '<p>Tel 555-', cast(100 + c_custkey % 900 as string), '-', cast(1000 + c_custkey % 9000 as string), '</p></body></html>') as html,
          case when c_custkey % 11 = 0 then 404 else 200 end as http_status, c_name as real_name,
          concat('k', cast(c_nationkey as string)) as school_id
        from {customer}""",
    "v_batches": """
        select 1 + s_suppkey % 3 as batch, concat('k', cast(s_suppkey % 60 as string)) as school_id,
          case s_suppkey % 5 when 0 then 'N/A' when 1 then 'none found' else concat('faculty ', s_name) end as faculty,
          case when s_suppkey % 2 = 0 then '' else concat('research ', s_name) end as research,
          split(case when s_suppkey % 4 = 0 then 'ftp://x' else concat('https://src/', cast(s_suppkey as string), ',https://hand') end, ',') as src,
          s_suppkey as seq
        from {supplier}""",
    "v_prior_details": """
        select concat('k', cast(n_nationkey as string)) as school_id,
          case when n_nationkey % 2 = 0 then concat('hand ', n_name) else 'n/a' end as faculty,
          case when n_nationkey % 3 = 0 then concat('lab ', n_name) else null end as research,
          split('https://hand', ',') as src
        from {nation}""",
    "v_filter_catalog": """
        select concat('sch-', cast(p_partkey % 1500 as string)) as id, p_name as name,
          case p_size % 4 when 0 then null when 1 then 'United States' when 2 then ' ' else 'Canada' end as country,
          concat(split_part(p_name, ' ', 1), ', ', case p_partkey % 4 when 0 then 'CA' when 1 then 'ny' when 2 then 'ZZ' else 'Illinois' end) as location,
          concat(' ', p_type, ' ') as type,
          case p_partkey % 5 when 0 then null when 1 then concat('www.x', cast(p_partkey as string), '.edu/home') when 2 then concat('https://y', cast(p_partkey as string), '.com/') when 3 then '  ' else concat('http://z', cast(p_partkey as string), '.edu') end as url,
          p_partkey as seq
        from {part}""",
    # listing pages of 25 schools: each shows one person and links a few later pages
    "v_listing_pages": """
        select concat('https://www.s', cast(c_nationkey as string), '.edu/faculty?page=', cast(c_custkey as string)) as url,
          case when c_custkey % 17 = 0 then 500 else 200 end as status,
          concat('<html><body><a href="/people/', lower(replace(c_name, '#', '-')), '">', c_name, '</a>',
            '<a href="?page=', cast(c_custkey + 5 as string), '">Next</a>',
            '<a href="?page=', cast(c_custkey + 11 as string), '" rel="next">more</a>',
            '<a href="https://elsewhere.org/people/x">partner</a>',
            '<a href="../people/./d', cast(c_nationkey as string), '/">dept</a>',
            '<a href="mailto:a@b.edu">mail</a><a href="/files/cv.pdf">cv</a></body></html>') as body,
          c_nationkey as school_key, c_custkey as ord
        from {customer}""",
    "v_sitemaps": """
        select concat('https://s', cast(s_nationkey as string), '.edu/map-', cast(s_suppkey as string), '.xml') as doc_url,
          case when s_suppkey % 13 = 0 then 404 else 200 end as status,
          case when s_suppkey % 11 = 0 then '<urlset><url><loc>broken'
            when s_suppkey % 3 = 0 then concat('<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><sitemap><loc>https://s', cast(s_nationkey as string), '.edu/map-', cast(s_suppkey + 25 as string), '.xml</loc></sitemap><sitemap><loc> https://s', cast(s_nationkey as string), '.edu/map-', cast(s_suppkey + 50 as string), '.xml </loc></sitemap></sitemapindex>')
            else concat('<urlset><url><loc>https://s', cast(s_nationkey as string), '.edu/people/a', cast(s_suppkey as string), '</loc></url><url><loc>https://s', cast(s_nationkey as string), '.edu/faculty/</loc></url><url><loc>  </loc></url></urlset>') end as body,
          s_nationkey as school_key, s_suppkey as ord
        from {supplier}""",
    "v_site_urls": """
        select concat('s', cast(c_nationkey as string)) as school_id,
          concat('https://s', cast(c_nationkey as string), '.edu/',
            case c_custkey % 4 when 0 then concat('people/', lower(c_mktsegment), '/p', cast(c_custkey as string), '.html')
              when 1 then concat('news/', cast(c_custkey as string))
              when 2 then concat('academics/faculty/', case when c_custkey % 5 = 0 then 'index.html' else concat('f', cast(c_custkey as string)) end)
              else case when c_custkey % 3 = 0 then 'staff/' else 'directory/people.php' end end) as url
        from {customer}""",
    "v_school_families": """
        select concat('inst', cast(n_nationkey as string)) as school_id, n_nationkey as k,
          case when n_nationkey % 5 = 0 then null else split(case n_nationkey % 4 when 0 then 'Engineering,Physical Sciences' when 1 then 'Mathematics & Statistics,Visual & Performing Arts' when 2 then 'Health Professions' else 'History,Engineering' end, ',') end as families
        from {nation}""",
}


class Tables:
    """Lazily loaded tables and views of one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir
        self._loaded: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._loaded:
            if name in VIEWS:
                text = VIEWS[name]
                used = {n: self[n] for n in references(text)}
                self._loaded[name] = self.spark.sql(_escape(text), **used)
            else:
                self._loaded[name] = self.spark.read.schema(BASE_SCHEMAS[name]).parquet(
                    f"{self.sf_dir}/{name}.parquet"
                )
        return self._loaded[name]

    def dealt(self, name: str) -> DataFrame:
        """A table, or a view over tables, whose rows are dealt out to all cores before anything is made of them.

        For pages made from narrow rows: making and reading one costs far more than moving its row, and a whole
        table may sit in one row group, which is one task."""
        if name in VIEWS:
            return self.spark.sql(_escape(VIEWS[name]), **{n: self.dealt(n) for n in references(VIEWS[name])})
        return spread(self[name], 3 * self.spark.sparkContext.defaultParallelism)


def _escape(text: str) -> str:
    """Double every brace that is not a table reference."""
    parts = re.split(r"(\{\w+\})", text)
    return "".join(
        p if i % 2 else p.replace("{", "{{").replace("}", "}}") for i, p in enumerate(parts)
    )


def references(text: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", text)) & (set(VIEWS) | set(BASE_SCHEMAS)))


def with_views(sql: str) -> str:
    """Oracle SQL with the views it uses inlined as CTEs, dependencies first."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in references(text):
            if name in VIEWS and name not in ordered:
                visit(VIEWS[name])
                ordered.append(name)

    def plain(text: str) -> str:
        return re.sub(r"\{(\w+)\}", lambda m: m.group(1) if m.group(1) in (set(VIEWS) | set(BASE_SCHEMAS)) else m.group(0), text)

    visit(sql)
    ctes = ",\n".join(f"{n} as ({plain(VIEWS[n])})" for n in ordered)
    body = plain(sql).strip()
    if not ctes:
        return body
    if body.lower().startswith("with "):
        return f"with {ctes},\n{body[5:]}"
    return f"with {ctes}\n{body}"
