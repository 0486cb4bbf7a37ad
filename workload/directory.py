"""Pages, links, sitemaps, candidate assembly and bounded walks."""

from __future__ import annotations

from pyspark.sql import functions as F

from matricula import fixed_values as V
from matricula.functions import html as H
from matricula.functions import text as T
from matricula.functions import urls as U
from matricula.operators import directory as R
from matricula.operators import domains as D
from matricula.operators.common import spread
from workload.registry import query


def _q(pattern: str) -> str:
    return pattern.replace("'", "''")


def unescape(x: str) -> str:
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"), ("&amp;", "&")):
        x = f"replace({x}, '{entity}', '{char}')"
    return x


def tags_to_text(x: str) -> str:
    stripped = f"regexp_replace({x}, '(?s)<[^>]*>', ' ', 'g')"
    return f"trim(regexp_replace({unescape(stripped)}, '\\s+', ' ', 'g'))"


def body_markup(x: str) -> str:
    x = f"regexp_replace({x}, '(?s)<!--.*?-->', ' ', 'g')"
    x = f"regexp_replace({x}, '(?is)<head\\b[^>]*>.*?</head\\s*>|<title\\b[^>]*>.*?</title\\s*>', ' ', 'g')"
    for tag in V.NOISE_TAGS:
        x = f"regexp_replace({x}, '(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>', ' ', 'g')"
    return x


@query("visible_text", "T15", f"select page_id, {tags_to_text(body_markup('html'))} as text from {{pages}}")
def visible_text(t):
    return spread(t["pages"]).select("page_id", H.visible_text(F.col("html")).alias("text"))


_REFERENCES = (  # written in the page, what a reader sees
    ("Jos&eacute;", "José"), ("x &#8211; y", "x – y"), ("a&#x2014;b", "a—b"), ("it&rsquo;s", "it’s"),
    ("&laquo;q&raquo;", "«q»"), ("&#150;&hellip;", "–…"), ("R&amp;D &amp;eacute;", "R&D &eacute;"),
)
_AT_SIGNS = ("&#64;", "&#x40;", "&commat;")


@query(
    "character_references",
    "T15 T17 T20",
    "select c_custkey, case c_custkey % 7 "
    + " ".join(f"when {i} then '{seen}'" for i, (_, seen) in enumerate(_REFERENCES))
    + """ end || ' ' || c_name || ' mail m' || c_custkey || '@s.edu cv' as text, 'm' || c_custkey || '@s.edu' as email,
      'https://s.edu/p?a=' || c_custkey || '&b=2' as href from {customer}""",
)
def character_references(t):
    """Named and numeric references in text, e-mails and links, beside nested and unclosed noise elements."""
    k = F.col("c_custkey")
    pick = lambda values: F.get(F.array(*map(F.lit, values)), (k % len(values)).cast("int"))
    body = F.concat(
        F.lit("<html><body><header>top<nav>menu<nav>sub</nav></nav>still</header><p>"), pick([w for w, _ in _REFERENCES]),
        F.lit(" "), F.col("c_name"), F.lit("</p><p>mail m"), k.cast("string"), pick(_AT_SIGNS), F.lit("s.edu</p><a href='/p?a="),
        k.cast("string"), F.lit("&amp;b=2'>cv</a><footer>end <b>never closed</b></body></html>"))
    page = t.dealt("customer").select("c_custkey", body.alias("html"))
    text = H.visible_text(F.col("html"))
    href = U.resolve(F.lit("https://s.edu/"), F.get(H.anchors(F.col("html")), F.lit(0))["href"])
    return page.select("c_custkey", text.alias("text"), H.email_in_text(text).alias("email"), href.alias("href"))


@query(
    "quoted_tags",
    "T15 T17 T24",
    """select c_custkey, 'before ' || c_name || ' after link' || c_custkey || ' open next' as text, 'https://s.edu/a?x=' || c_custkey || '>2' as first, 'https://s.edu/b' as second,
      'open' as "label", 'x > ' || c_mktsegment as author from {customer}""",
)
def quoted_tags(t):
    """A closing bracket inside quoted values, upper-case and unquoted attributes, and a link without an end tag."""
    k = F.col("c_custkey").cast("string")
    page = F.concat(
        F.lit("<HTML><head><META content='x > "), F.col("c_mktsegment"), F.lit("' NAME=author></head><body><p title=\"a > b\" class='c>d'>before "), F.col("c_name"),
        F.lit("</p><NAV data-x='</nav>'>menu > </NAV> after <A HREF='/a?x="), k, F.lit(">2' rel=nofollow>link"), k, F.lit("</A> <a class=x href=/b>open <a href=\"/c\">next</a></body></HTML>"))
    rows = t.dealt("customer").select("c_custkey", H.visible_text(page).alias("text"), H.anchors(page).alias("a"), H.meta_author(page).alias("author"))
    href = lambda i: U.resolve(F.lit("https://s.edu/"), F.get("a", F.lit(i))["href"])
    return rows.select("c_custkey", "text", href(0).alias("first"), href(1).alias("second"), F.get("a", F.lit(1))["text"].alias("label"), "author")


_EXCERPT = f"""with b as (select page_id, {body_markup('html')} m from {{pages}}),
    p as (select page_id,
      list_distinct_ordered(list_filter(list_transform(regexp_extract_all(m, '(?is)<h[1-6]\\b[^>]*>(.*?)</h[1-6]\\s*>', 1), lambda x: {tags_to_text('x')}), lambda x: x <> '')) hs,
      list_distinct_ordered(list_filter(list_transform(regexp_extract_all(m, '(?is)<a\\s([^>]*)>(.*?)</a\\s*>', 2), lambda x: {tags_to_text('x')}), lambda x: x <> '')) ls,
      {tags_to_text("regexp_replace(regexp_replace(m, '(?is)<h[1-6]{B}[^>]*>(.*?)</h[1-6]{S}*>', ' ', 'g'), '(?is)<a{S}([^>]*)>(.*?)</a{S}*>', ' ', 'g')").replace('{B}', chr(92) + 'b').replace('{S}', chr(92) + 's')} rest from b)
    select page_id, left(concat_ws(chr(10), case when len(hs) > 0 then 'Headings: ' || array_to_string(hs, ' | ') end,
      case when len(ls) > 0 then 'Links: ' || array_to_string(ls, ' | ') end, case when rest <> '' then 'Text: ' || rest end), 4000) excerpt from p"""


def _ordered_distinct(sql: str) -> str:
    """DuckDB's list_distinct does not keep order; spell out the first occurrence."""
    import re

    out, i = sql, 0
    while (at := out.find("list_distinct_ordered(")) >= 0:
        depth, j = 0, at + len("list_distinct_ordered")
        for j in range(at + len("list_distinct_ordered"), len(out)):
            depth += {"(": 1, ")": -1}.get(out[j], 0)
            if depth == 0:
                break
        inner = out[at + len("list_distinct_ordered(") : j]
        i += 1
        out = out[:at] + f"list_reduce(list_prepend(cast([] as varchar[]), list_transform({inner}, lambda y{i}: [y{i}])), lambda acc, y{i}: case when list_contains(acc, y{i}[1]) then acc else list_concat(acc, y{i}) end)" + out[j + 1 :]
    return re.sub(r"\s+\n", "\n", out)


@query("page_excerpts", "T16", _ordered_distinct(_EXCERPT))
def page_excerpts(t):
    return spread(t["pages"]).select("page_id", H.excerpt(F.col("html"), V.EXCERPT_MAX_CHARS).alias("excerpt"))


_ATTR = "regexp_extract(attrs, '(?is)(?:^|\\s){n}\\s*=\\s*(\"[^\"]*\"|''[^'']*''|[^\\s>]+)', 1)"


def attr(n: str) -> str:
    return unescape(f"regexp_replace(regexp_replace({_ATTR.replace('{n}', n)}, '^[\"'']', ''), '[\"'']$', '')")


_PATHQ = "'(?s)^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?(?://[^/?#]*)?([^?#]*)'"


def path(x: str) -> str:
    return f"regexp_extract({x}, {_PATHQ}, 1)"


def query_of(x: str) -> str:
    return f"regexp_extract({x}, '^[^?#]*\\?([^#]*)', 1)"


def netloc(x: str) -> str:
    return f"regexp_extract({x}, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1)"


def scheme(x: str) -> str:
    return f"lower(regexp_extract({x}, '^([A-Za-z][A-Za-z0-9+.\\-]*):', 1))"


def normalize_url(x: str) -> str:
    return f"""({scheme(x)} || '://' || lower({netloc(x)}) || case when {path(x)} in ('', '/') then '/' else rtrim({path(x)}, '/') end
      || case when {query_of(x)} <> '' then '?' || {query_of(x)} else '' end)"""


def domain(x: str) -> str:
    host = f"regexp_replace(regexp_replace({netloc(f'lower({x})')}, '^www\\.', ''), ':\\d+$', '')"
    two = f"regexp_extract({host}, '([^.]*\\.)?[^.]*$', 0)"
    three = f"regexp_extract({host}, '([^.]*\\.)?([^.]*\\.)?[^.]*$', 0)"
    return f"(case when {two} in {V.COMPOUND_SUFFIXES} then {three} else {two} end)"


# Anchors of the crawled pages; their links are absolute, rooted or plain relative names.
_LINKS = f"""stripped as (select page_id, url, regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'), '(?is)<script\\b[^>]*>.*?</script\\s*>', ' ', 'g'), '(?is)<style\\b[^>]*>.*?</style\\s*>', ' ', 'g') m from {{pages}}),
    raw as (select page_id, url, unnest(list_zip(regexp_extract_all(m, '(?is)<a\\s([^>]*)>(.*?)</a\\s*>', 1), regexp_extract_all(m, '(?is)<a\\s([^>]*)>(.*?)</a\\s*>', 2))) z from stripped),
    anchors as (select page_id, url page_url, z[1] attrs, {tags_to_text('z[2]')} as text from raw),
    hrefs as (select *, trim({attr('href')}) h, {attr('rel')} rel from anchors),
    links as (select page_id, page_url, text, rel, case when regexp_matches(h, '(?i)^[a-z][a-z0-9+.\\-]*:') then h when starts_with(h, '//') then {scheme('page_url')} || ':' || h
        when starts_with(h, '?') then {scheme('page_url')} || '://' || {netloc('page_url')} || {path('page_url')} || h
        when starts_with(h, '/') then {scheme('page_url')} || '://' || {netloc('page_url')} || h
        else {scheme('page_url')} || '://' || {netloc('page_url')} || regexp_replace({path('page_url')}, '[^/]*$', '') || h end href
      from hrefs where h <> '' and not starts_with(h, '#') and not regexp_matches(h, '(?i)^(javascript|mailto|tel):'))"""


def _pages(t):
    return t["pages"].select("page_id", "url", F.col("html").alias("body"))


@query(
    "page_anchors",
    "T17",
    f"with {_LINKS} select page_url, href, text, rel from links where regexp_matches(href, '(?i)^https?://')",
)
def page_anchors(t):
    return R.page_links(_pages(t)).drop("pos")


_ASSETS = "|".join(e.replace(".", "\\.") for e in V.ASSET_EXTENSIONS)
_KIND = f"""case when regexp_matches(lower(rel), 'next|prev') then 'pagination'
      when rtrim({path('href')}, '/') = rtrim({path('page_url')}, '/') and {query_of('href')} <> {query_of('page_url')} and regexp_matches({query_of('href')}, '(?i)(?:^|&)(?:{'|'.join(V.PAGINATION_QUERY_KEYS)})=[^&]') then 'pagination'
      when regexp_matches({path('href')}, '(?i)/page/\\d+/?$') then 'pagination'
      when regexp_matches(trim(text), '{V.PAGINATION_TEXT}') then 'pagination'
      when regexp_matches(lower({path('href')}), '(?:{_ASSETS})$|{'|'.join(V.ASSET_PATH_HINTS)}') then 'ignore'
      when {' or '.join(f"contains(lower(href), '{p}')" for p in V.PROFILE_PATTERNS)} then 'profile' else 'ignore' end"""


@query(
    "link_kinds",
    "T18 T9",
    f"with {_LINKS} select page_url, {normalize_url('href')} norm, {_KIND} kind from links where regexp_matches(href, '(?i)^https?://')",
)
def link_kinds(t):
    return R.classified_links(_pages(t)).select("page_url", "norm", "kind")


@query(
    "same_domain_links",
    "F19 T7 T8",
    f"with {_LINKS} select page_url, href from links where regexp_matches(href, '(?i)^https?://') and {domain('href')} = {domain('page_url')}",
)
def same_domain_links(t):
    return R.same_domain(R.page_links(_pages(t))).select("page_url", "href")


_HINT = ("in", "de", "et")


@query(
    "hinted_links",
    "F20",
    f"""with {_LINKS} select distinct page_url, regexp_replace(href, '#.*$', '') href from links where regexp_matches(href, '(?i)^https?://') and {domain('href')} = {domain('page_url')}
      and regexp_matches(lower({path('href')}) || ' ' || lower(text), '{'|'.join(_HINT)}') and rtrim(regexp_replace(href, '#.*$', ''), '/') <> rtrim(page_url, '/')""",
)
def hinted_links(t):
    return R.links_matching(R.page_links(_pages(t)), _HINT).select("page_url", "href")


@query(
    "url_forms",
    "T7 T8 T9 T6",
    f"""select page_id, {normalize_url('url')} norm, {domain('url')} "domain",
      regexp_replace({netloc('lower(url)')}, '^www\\.', '') || rtrim({path('lower(url)')}, '/') home_key from {{pages}}""",
)
def url_forms(t):
    return t["pages"].select(
        "page_id",
        U.normalize_url(F.col("url")).alias("norm"),
        U.registrable_domain(F.col("url")).alias("domain"),
        U.homepage_key(F.col("url")).alias("home_key"),
    )


@query(
    "institution_domains",
    "T7",
    f"select cand_rank, {domain('homepage_url')} \"domain\" from {{v_institutions}}",
)
def institution_domains(t):
    return t["v_institutions"].select("cand_rank", U.registrable_domain(F.col("homepage_url")).alias("domain"))


_SOFT = "|".join(_q(m) for m in V.SOFT_404_MARKERS)


@query(
    "page_gates",
    "F13",
    f"""select page_id, regexp_matches(lower(left(html, 2000)), '<html|<body|<!doctype html') is_html, regexp_matches(lower(html), '{_SOFT}') soft_404 from {{pages}}""",
)
def page_gates(t):
    body = F.col("html")
    return t["pages"].select(
        "page_id", H.looks_like_html(body).alias("is_html"), H.soft_404(body).alias("soft_404")
    )


@query(
    "us_schools",
    "F3 T6 T10 T11 J7",
    r"""with d as (select *, trim(coalesce(country, '')) ct, upper(regexp_extract(trim(location), '^(.*),\s*([A-Za-z]{2})\s*$', 2)) st,
        regexp_matches(split_part(regexp_replace(lower(trim(coalesce(url, ''))), '^https?://', ''), '/', 1), '(^|\.)edu$') edu, nullif(trim(url), '') u from {v_filter_catalog}),
      k as (select *, case when ct <> '' then upper(ct) in ('USA', 'US', 'UNITED STATES', 'UNITED STATES OF AMERICA') else st in ('CA', 'NY') or edu end is_us from d),
      f as (select *, row_number() over (partition by id order by seq) rn from k where is_us and u is not null)
      select id school_id, name, nullif(st, '') state, case when regexp_matches(u, '^https?://') then u else 'https://' || u end homepage, nullif(lower(trim(type)), '') control,
        case when ct = '' then 'low' else 'high' end confidence, case when id in (select id from {v_filter_catalog} where length(name) > 10) then 1 else 0 end n_details from f where rn = 1""",
)
def us_schools(t):
    details = (
        t["v_filter_catalog"].filter(F.length("name") > 10).select(F.col("id").alias("school_id"))
        .distinct().withColumn("details", F.create_map(F.lit("x"), F.lit("y")))
    )
    schools = R.load_schools(t["v_filter_catalog"], details)
    return schools.select(
        "school_id", "name", "state", "homepage", "control", "confidence",
        F.size("source_fields").alias("n_details"),
    )


# ----------------------------------------------------------------- sitemap --
_BASE = "regexp_extract(rtrim(lower(%s), '/'), '([^/]*)$', 1)" % path("url")
_IS_INDEX = f"""(regexp_matches(lower({path('url')}), '{'|'.join(V.DIRECTORY_HINTS)}') and ({_BASE} in {V.INDEX_BASENAMES} or regexp_replace({_BASE}, '\\.[^.]*$', '') in {V.DIRECTORY_HINTS}))"""
_CLUSTERS = f"""members as (select *, {scheme('url')} || '://' || {netloc('url')} || regexp_extract({path('url')}, '^(.*)/[^/]*$', 1) || '/' parent from {{v_site_urls}}
      where not {_IS_INDEX} and not ends_with({path('url')}, '/') and {path('url')} <> '' and regexp_matches(lower({path('url')}), '{'|'.join(V.DIRECTORY_HINTS)}')),
    clusters as (select school_id, parent, count(*) n from members group by 1, 2 having count(*) >= 5)"""


@query("directory_index_pages", "T19", f"select school_id, url from {{v_site_urls}} where {_IS_INDEX}")
def directory_index_pages(t):
    return R.directory_pages(t["v_site_urls"])


@query("profile_clusters", "A9", f"with {_CLUSTERS} select * from clusters")
def profile_clusters(t):
    return R.profile_clusters(t["v_site_urls"])


@query(
    "largest_cluster_members",
    "A10 U6",
    f"with {_CLUSTERS}, best as (select school_id, max({{'n': n, 'p': parent}}) b from clusters group by 1) select m.school_id, m.parent, m.url from members m join best on best.school_id = m.school_id and b.p = m.parent",
)
def largest_cluster_members(t):
    urls = t["v_site_urls"]
    return R.cluster_members(urls, R.largest_cluster(R.profile_clusters(urls))).select("school_id", "parent", "url")


@query(
    "sitemap_entries",
    "T29",
    """select doc_url, case when ends_with(body, 'broken') then 'urlset' when contains(body, '<sitemapindex') then 'sitemapindex' else 'urlset' end kind, trim(loc) loc
      from (select doc_url, body, unnest(case when ends_with(body, 'broken') then [''] else regexp_extract_all(body, '<loc>([^<]*)</loc>', 1) end) loc from {v_sitemaps}) where trim(loc) <> ''""",
)
def sitemap_entries(t):
    m = t["v_sitemaps"].select("doc_url", H.sitemap_entries(F.col("body")).alias("m"))
    return m.select("doc_url", "m.kind", F.explode("m.locs").alias("loc"))


def _levels(cap: int) -> str:
    """A queue-ordered walk in SQL, one pair of CTEs a level: the queued nodes and the visits among them.

    Expects CTEs roots(school_id, node, ord, counted) and edges(school_id, src, pos, node, counted); leaves
    queued(school_id, node, level, turn, counted) and visits(school_id, node, visit).
    """
    ctes = ["q0 as materialized (select school_id, node, 0 as level, {'p': 0::bigint, 'q': min(ord)::int} as turn, bool_or(counted) as counted from roots group by school_id, node)"]
    for n in range(cap):
        used = "0" if not n else "coalesce((select count(*) from (" + " union all ".join(
            f"select school_id from w{i}" for i in range(n)) + f") u where u.school_id = q{n}.school_id), 0)"
        ctes.append(
            f"w{n} as materialized (select * from (select school_id, node, {used} + row_number() over (partition by school_id order by turn, node) as visit"
            f" from q{n} where counted) where visit <= {cap})")
        seen = " union all ".join(f"select school_id, node from q{i}" for i in range(n + 1))
        ctes.append(
            f"q{n + 1} as materialized (select e.school_id, e.node, {n + 1} as level, min({{'p': visit, 'q': pos::int}}) as turn, bool_or(counted) as counted"
            f" from w{n} w join edges e on e.school_id = w.school_id and e.src = w.node"
            f" where not exists (select 1 from ({seen}) o where o.school_id = e.school_id and o.node = e.node) group by e.school_id, e.node)")
    ctes.append("queued as (" + " union all ".join(f"select * from q{n}" for n in range(cap + 1)) + ")")
    ctes.append("visits as (" + " union all ".join(f"select * from w{n}" for n in range(cap)) + ")")
    ctes.append(
        "last as (select school_id, max({'l': level, 'a': turn, 'n': node}) as place from queued join visits using (school_id, node) group by school_id)")
    ctes.append(
        "walked as (select q.school_id, count(v.visit) as n, bool_or(v.visit is null and (l.place is null or {'l': q.level, 'a': q.turn, 'n': q.node} > l.place)) as remaining"
        " from queued q left join visits v using (school_id, node) left join last l on l.school_id = q.school_id group by q.school_id)")
    return ",\n".join(ctes)


_SITEMAP_WALK = f"""
with docs as (select school_key as school_id, doc_url, status, body, ord from {{v_sitemaps}}),
roots as (select school_id, arg_min(doc_url, ord) as node, 0 as ord, true as counted from docs group by school_id),
locs as (
  select doc_url as src, contains(body, '<sitemapindex') as is_index, unnest(l) as loc, generate_subscripts(l, 1) - 1 as pos
  from (select doc_url, body, [trim(x) for x in regexp_extract_all(body, '<loc>([^<]*)</loc>', 1) if trim(x) <> ''] as l
        from docs where status = 200 and not ends_with(body, 'broken'))),
edges as (select r.school_id, src, pos, loc as node, true as counted from locs, (select distinct school_id from docs) r where is_index),
{_levels(V.MAX_SITEMAP_DOCUMENTS)},
found as (select v.school_id, l.loc as url, v.visit as doc_ord, l.pos from visits v join locs l on l.src = v.node where not is_index)
select w.school_id, w.n as documents_tried, (select count(*) from found f where f.school_id = w.school_id) as urls,
       w.remaining as truncated, f.url, f.doc_ord, f.pos::int as pos
from walked w left join found f on f.school_id = w.school_id
"""


@query("sitemap_walk", "I3 W15", _SITEMAP_WALK)
def sitemap_walk(t):
    """Each school's summary beside every URL found, in order."""
    docs = t["v_sitemaps"]
    seeds = docs.groupBy("school_key").agg(F.min(F.struct("ord", "doc_url")).alias("s")).select(
        F.col("school_key").alias("school_id"), F.col("s")["doc_url"].alias("doc_url"), F.lit(0).alias("ord")
    )
    urls, summary = R.read_sitemaps(seeds, docs, V.MAX_SITEMAP_DOCUMENTS, V.MAX_SITEMAP_URLS)
    return summary.join(urls, "school_id", "left")


@query(
    "truncated_listings",
    "W15",
    """select user_id, event_id, cast(rn as int) rn, total >= 60 truncated from (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) rn, count(*) over (partition by user_id) total from {events}) where rn <= 60""",
)
def truncated_listings(t):
    rows = t["events"].select("user_id", "event_id", "ts")
    return R.truncate(rows, "user_id", [F.col("ts"), F.col("event_id")], 60).drop("ts")


# -------------------------------------------------------------- candidates --
@query(
    "capped_fetch_list",
    "W8 F22",
    """with urls as (select school_id, profile_url, min(seq) ord from {v_raw_profiles} group by 1, 2),
      fresh as (select * from urls u where not exists (select 1 from {v_ledger} l where l.profile_url = u.profile_url and status = 'done')),
      t as (select school_id, count(*) listed from urls group by 1), n as (select school_id, count(*) as new from fresh group by 1)
      select t.school_id, listed - coalesce(new, 0) already_done, least(coalesce(new, 0), 20) attempted, greatest(coalesce(new, 0) - 20, 0) cap_skipped,
        (select cast(sum(ord) as bigint) from (select ord, row_number() over (partition by school_id order by ord, profile_url) rn from fresh f where f.school_id = t.school_id) where rn <= 20) checksum
      from t left join n on n.school_id = t.school_id""",
)
def capped_fetch_list(t):
    urls = t["v_raw_profiles"].groupBy("school_id", "profile_url").agg(F.min("seq").alias("ord"))
    chosen, counts = R.cap_new(urls, t["v_ledger"], 20)
    return counts.join(chosen.groupBy("school_id").agg(F.sum("ord").alias("checksum")), "school_id", "left")


@query(
    "merged_link_sets",
    "J22",
    """with b as (select user_id % 20 school_id, event_id % 900 url, 0 src, event_id ord from {events} where event_type = 'click'
        union all select user_id % 20, event_id % 900, 1, event_id from {events} where event_type <> 'click')
      select school_id, url, m.s src, m.o ord from (select school_id, url, min({'s': src, 'o': ord}) m from b group by 1, 2)""",
)
def merged_link_sets(t):
    e = t["events"].select(
        (F.col("user_id") % 20).alias("school_id"), (F.col("event_id") % 900).alias("url"),
        F.col("event_id").alias("ord"), "event_type",
    )
    first = e.filter("event_type = 'click'").drop("event_type")
    second = e.filter("event_type <> 'click'").drop("event_type")
    return R.merge_links(first, second)


_RULES = [("/people/1", False, 1), ("/people/12", True, 2), ("/people/", True, 3), ("/", False, 4)]


def _rules(t):
    hosts = t["v_raw_profiles"].select(F.lower(U.netloc(F.col("profile_url"))).alias("host")).distinct()
    table = F.array(
        *[
            F.struct(F.lit(p).alias("prefix"), F.lit(a).alias("allow"), F.lit(o).alias("ord"))
            for p, a, o in _RULES
        ]
    )
    return hosts.filter("host <> 's3.edu'").select("host", F.inline(table))


@query(
    "rule_admission",
    "F21",
    """with u as (select distinct school_id, profile_url url from {v_raw_profiles}),
      a as (select *, school_id = 's3' or not starts_with(regexp_extract(url, '/people/.*$'), '/people/1') admitted from u)
      select school_id, count(*) filter (admitted) allowed_urls, bool_and(admitted) all_admitted from a group by 1""",
)
def rule_admission(t):
    urls = t["v_raw_profiles"].select("school_id", F.col("profile_url").alias("url")).distinct()
    return R.rules_verdict(R.admit_by_rules(urls, _rules(t)))


def _candidate_inputs(t):
    """Homepages from suppliers; the pages that resolve are a subset of the generated URLs."""
    k = F.col("s_suppkey").cast("string")
    base = F.concat(F.lit("https://h"), k, F.lit(".edu"))
    schools = t["supplier"].select(k.alias("school_id"), F.concat(base, F.lit("/")).alias("homepage"), "s_suppkey", "s_nationkey")
    heuristic = R.heuristic_candidates(schools)
    one = lambda path, name: schools.select("school_id", F.regexp_replace("homepage", "/$", path).alias("url"), F.lit(0).alias("ord"))
    sitemap, search, department = one("/faculty", "m"), one("/find", "s"), one("/math/people", "d")
    s, n = F.col("s_suppkey"), F.col("s_nationkey")
    parts = [
        schools.select(F.regexp_replace("homepage", "/$", "/faculty").alias("url"), F.when(s % 4 == 0, 200).otherwise(404).alias("status"), F.lit("<html>ok").alias("body")),
        schools.select(F.regexp_replace("homepage", "/$", "/people").alias("url"), F.lit(200).alias("status"), F.when(n % 2 == 0, "<html>Page Not Found").otherwise("<BODY>x").alias("body")),
        schools.select(F.regexp_replace("homepage", "/$", "/find").alias("url"), F.lit(200).alias("status"), F.when(n % 5 == 0, "<html>").otherwise("plain").alias("body")),
        schools.select(F.regexp_replace("homepage", "/$", "/math/people").alias("url"), F.lit(200).alias("status"), F.lit("<!doctype html>").alias("body")),
    ]
    pages = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return schools, R.assemble_candidates(sitemap, heuristic, search, department, pages)


_CANDS = """cand as (
    select cast(s_suppkey as string) school_id, 'https://h' || s_suppkey || '.edu/faculty' url, 'sitemap' source from {supplier} where s_suppkey % 4 = 0
    union all select cast(s_suppkey as string), 'https://h' || s_suppkey || '.edu/people', 'heuristic' from {supplier} where s_nationkey % 2 = 1
    union all select cast(s_suppkey as string), 'https://h' || s_suppkey || '.edu/find', 'search' from {supplier} where s_nationkey % 5 = 0
    union all select cast(s_suppkey as string), 'https://h' || s_suppkey || '.edu/math/people', 'department' from {supplier} where s_suppkey % 4 <> 0 and s_nationkey % 2 = 0 and s_nationkey % 5 <> 0)"""


@query("directory_candidates", "J24 T33 F13", f"with {_CANDS} select * from cand")
def directory_candidates(t):
    return _candidate_inputs(t)[1].select("school_id", "url", "source")


@query(
    "directory_verdicts",
    "J25 F24 T32 M12 E4",
    f"""with {_CANDS}, u as (select school_id, bool_or(source = 'sitemap') a, bool_or(source = 'department') d, bool_or(source = 'heuristic') h, bool_or(source = 'search') s, count(*) n from cand group by 1)
      select cast(s_suppkey as string) school_id, case when n > 0 then coalesce((select count(*) from cand c where c.school_id = u.school_id and c.source in ('heuristic', 'search')), 0) else 0 end n_urls,
        case when n is null then 'none' else concat_ws('+', case when a then 'sitemap' end, case when d then 'department' end, case when h then 'heuristic' end, case when s then 'search' end) end discovery_method,
        case when h or s then case when s_suppkey % 3 = 0 then 1e0 when s_suppkey % 3 = 1 then 0.25e0 else 0e0 end else 0e0 end confidence
      from {{supplier}} left join u on u.school_id = cast(s_suppkey as string)""",
)
def directory_verdicts(t):
    schools, candidates = _candidate_inputs(t)
    s = F.col("s_suppkey")
    base = F.regexp_replace("homepage", "/$", "")
    proposals = schools.select(
        "school_id",
        F.array(
            F.concat(base, F.lit("/people")), F.lit("https://invented.org/x"), F.concat(base, F.lit("/find"))
        ).alias("directory_urls"),
        F.when(s % 3 == 0, "7").when(s % 3 == 1, "0.25").otherwise("sure").alias("confidence"),
        F.lit(" ").alias("notes"),
    )
    clusters = R.largest_cluster(R.profile_clusters(t["v_site_urls"]))
    rows = R.directory_rows(schools, candidates, clusters, R.trusted_proposals(proposals, candidates))
    return rows.select("school_id", F.size("directory_urls").cast("bigint").alias("n_urls"), "discovery_method", "confidence")


@query(
    "cluster_only_directories",
    "J25",
    f"with {_CLUSTERS}, best as (select school_id, max(n) n from clusters group by 1) select 's' || n_nationkey school_id, n n_profile_urls, case when n is null then 'none' else 'sitemap' end discovery_method, case when n is null then 0e0 else 0.9e0 end confidence from {{nation}} left join best on best.school_id = 's' || n_nationkey",
)
def cluster_only_directories(t):
    schools = t["nation"].select(F.concat(F.lit("s"), F.col("n_nationkey").cast("string")).alias("school_id"))
    none = t["v_site_urls"].filter("false").select("school_id", "url", F.lit("x").alias("source"))
    verdicts = R.trusted_proposals(
        none.select("school_id", F.array("url").alias("directory_urls"), F.lit("0").alias("confidence"), F.lit("").alias("notes")), none
    )
    clusters = R.largest_cluster(R.profile_clusters(t["v_site_urls"]))
    rows = R.directory_rows(schools, none, clusters, verdicts)
    return rows.drop("directory_urls", "rules_allowed", "notes")


# ------------------------------------------------------------------- walks --
def _entrypoints(t):
    pages = t["v_listing_pages"]
    return pages.groupBy("school_key").agg(F.min(F.struct("ord", "url")).alias("s")).select(
        F.concat(F.lit("s"), F.col("school_key").cast("string")).alias("school_id"),
        F.col("s")["url"].alias("url"), F.lit(0).alias("ord"),
    )


_DIRECTORY_WALK = f"""
with listing as (select 's' || school_key as school_id, ord as k, url as node, status from {{v_listing_pages}}),
roots as (select school_id, arg_min(node, k) as node, 0 as ord, true as counted from listing group by school_id),
edges as (
  select e.school_id, e.node as src, e.pos, e.target as node, l.node is not null as counted
  from (select school_id, node, pos, regexp_replace(node, '[0-9]+$', '') || (k + step) as target
        from listing, (values (1, 5), (2, 11)) s(pos, step) where status = 200) e
  left join listing l on l.node = e.target),
{_levels(V.MAX_DIRECTORY_PAGES)},
seen as (
  select v.school_id, l.node as page_url, v.visit,
         unnest(['https://www.' || v.school_id || '.edu/people/customer-' || lpad(l.k::varchar, 9, '0'), 'https://www.' || v.school_id || '.edu/people/d' || substr(v.school_id, 2)]) as norm
  from visits v join listing l on l.node = v.node and l.status = 200),
found as (select school_id, norm, arg_min(page_url, visit) as page_url from seen group by school_id, norm)
select w.school_id, w.n as pages_visited, (select count(*) from found f where f.school_id = w.school_id) as profiles,
       w.n >= {V.MAX_DIRECTORY_PAGES} and w.remaining as page_cap_hit, f.norm, f.page_url
from walked w left join found f on f.school_id = w.school_id
"""


@query("directory_walk", "I2 W14", _DIRECTORY_WALK)
def directory_walk(t):
    """Each school's summary beside every profile link found and the page that showed it first."""
    found, summary = R.walk_directories(_entrypoints(t), t["v_listing_pages"], V.MAX_DIRECTORY_PAGES)
    return summary.join(found.drop("at"), "school_id", "left")


@query(
    "first_seen_pages",
    "W14",
    """select school_id, norm, page_url from (select user_id % 7 school_id, event_id % 500 norm, ts page_url, row_number() over (partition by user_id % 7, event_id % 500 order by user_id, event_id) rn from {events}) where rn = 1""",
)
def first_seen_pages(t):
    found = t["events"].select(
        (F.col("user_id") % 7).alias("school_id"), (F.col("event_id") % 500).alias("norm"),
        F.col("ts").alias("page_url"), F.col("user_id").alias("page_ord"), F.col("event_id").alias("pos"),
    )
    return R.first_pages(found).drop("at")


_DEPARTMENT_WALK = """
with firsts as (
  select c_nationkey as k, min(c_custkey) as a, max(c_custkey) as b,
         list_position(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'], c_mktsegment) as place
  from {customer} group by c_nationkey, c_mktsegment),
best as (select k, arg_min(a, place) as a, arg_min(b, place) as b from firsts where place is not null group by k),
people as (select k, a as c, 1 as ord from best union all select k, b, 2 from best where a <> b)
select 's' || k as school_id, 'https://www.s' || k || '.edu/department/' || c || '/people' as url, ord, 0 as left_out from people
"""


@query("department_walk", "I4", _DEPARTMENT_WALK)
def department_walk(t):
    """Departments and people pages built from the listing hosts."""
    k = F.col("c_nationkey").cast("string")
    c = F.col("c_custkey").cast("string")
    base = F.concat(F.lit("https://www.s"), k, F.lit(".edu"))
    schools = t["nation"].select(
        F.concat(F.lit("s"), F.col("n_nationkey").cast("string")).alias("school_id"),
        F.concat(F.lit("https://www.s"), F.col("n_nationkey").cast("string"), F.lit(".edu/")).alias("homepage"),
    )
    departments = t.dealt("customer").select(
        F.concat(base, F.lit("/department/"), c).alias("url"),
        F.concat(F.lit('<html><a href="/department/'), c, F.lit('/people">People</a><a href="/about">About</a>')).alias("body"),
        "c_nationkey", "c_custkey",
    )
    # each index page lists the departments of one market segment
    index = t["customer"].groupBy("c_nationkey", "c_mktsegment").agg(
        F.min("c_custkey").alias("a"), F.max("c_custkey").alias("b")
    )
    paths = F.create_map(
        *[F.lit(x) for pair in zip(("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"), V.DEPARTMENT_INDEX_PATHS) for x in pair]
    )
    index_pages = index.select(
        F.concat(base, F.try_element_at(paths, F.col("c_mktsegment"))).alias("url"),
        F.concat(
            F.lit('<html><a href="/department/'), F.col("a").cast("string"), F.lit('">A</a><a href="/department/'),
            F.col("b").cast("string"), F.lit('">B</a>'),
        ).alias("body"),
    )
    pages = departments.select("url", "body").unionByName(index_pages).withColumn("status", F.lit(200))
    return R.department_people_pages(schools, pages, V.MAX_DEPARTMENTS_PER_SCHOOL)


_SUFFIXES = ", ".join(f"('{r.removeprefix('!').removeprefix('*.')}', {-1 if r[0] == '!' else int(r[0] == '*')})" for r in V.SUFFIX_RULES)
#: hosts(host) -> domains(host, suffix, domain), every host beside every rule
_DOMAINS = f"""rules(k, gain) as (values {_SUFFIXES}),
    parts as (select distinct host, string_split(host, '.') l, regexp_matches(host, '^[0-9.]+$') ip from hosts),
    met as (select host, max(case when gain < 0 then 1000 else 0 end + len(string_split(k, '.')) + gain) z from parts join rules
        on not ip and (host = k or ends_with(host, '.' || k)) and len(string_split(k, '.')) + gain <= len(l) group by host),
    sized as (select host, l, case when not ip then coalesce(z % 1000, 1) end z from parts left join met using (host)),
    domains as (select host, array_to_string(l[len(l) - z + 1:], '.') suffix, case when len(l) > z then array_to_string(l[len(l) - z:], '.') end \"domain\" from sized)"""
_MADE_URLS = """select c_custkey, case c_custkey % 9 when 0 then 'https://www.u' || c_custkey // 18 || '.edu.pl/people' when 1 then 'https://Math.u' || c_custkey // 18 || '.EDU.PL:8080/'
    when 2 then 'http://u' || c_custkey || '.edu.pl' when 3 then 'https://cs.dept' || c_custkey || '.town.ck/a?b=//c' when 4 then 'https://me@a' || c_custkey || '.www.ck/'
    when 5 then 'https://x.y' || c_custkey || '.port.kobe.jp' when 6 then 'https://x' || c_custkey || '.city.kobe.jp./' when 7 then 'https://edu.pl/' || c_custkey else 'http://10.0.0.' || c_custkey % 256 end url from {customer}"""


@query(
    "suffix_domains",
    "T8",
    f"""with made as ({_MADE_URLS}), hosts as (select c_custkey, rtrim(regexp_replace(regexp_extract(lower(url), '://([^/?#]*)', 1), '^.*@|:[0-9]+$', '', 'g'), '.') host from made), {_DOMAINS}
      select c_custkey, host, suffix, \"domain\" from hosts join domains using (host)""",
)
def suffix_domains(t):
    """Wildcard and exception rules, names under edu.pl, subdomains, bare suffixes and addresses."""
    rows = _made_urls(t).select("c_custkey", D.host(F.col("made")).alias("host"))
    return rows.join(D.registrable(rows, D.default_rules(t.spark)), "host").select("c_custkey", "host", "suffix", "domain")


def _made_urls(t):
    k = F.col("c_custkey")
    n, group = k.cast("string"), F.floor(k / 18).cast("string")
    made = (
        F.concat(F.lit("https://www.u"), group, F.lit(".edu.pl/people")), F.concat(F.lit("https://Math.u"), group, F.lit(".EDU.PL:8080/")),
        F.concat(F.lit("http://u"), n, F.lit(".edu.pl")), F.concat(F.lit("https://cs.dept"), n, F.lit(".town.ck/a?b=//c")),
        F.concat(F.lit("https://me@a"), n, F.lit(".www.ck/")), F.concat(F.lit("https://x.y"), n, F.lit(".port.kobe.jp")),
        F.concat(F.lit("https://x"), n, F.lit(".city.kobe.jp./")), F.concat(F.lit("https://edu.pl/"), n),
        F.concat(F.lit("http://10.0.0."), (k % 256).cast("string")),
    )
    return t["customer"].select(k, F.get(F.array(*made), (k % 9).cast("int")).alias("made"))


@query(
    "site_links",
    "F19 T8",
    f"""with made as ({_MADE_URLS}), linked as (select p.page_id, m.url page_url, o.url href from {{pages}} p join made m on m.c_custkey = 1 + p.page_id % (select count(*) from made)
        join made o on o.c_custkey = 1 + (p.page_id * 7 + 1) % (select count(*) from made)),
      links as (select page_id, m[1] page_url, m[2] href from (select page_id, unnest([[page_url, href], [url, 'https://lib.' || host || '/x'], [url, 'https://other' || page_id % 5 || '.example.org/']]) m from
        (select *, regexp_extract(lower(url), '://([^/?#]*)', 1) host from linked join {{pages}} using (page_id)) z)),
      two as (select *, rtrim(regexp_replace(regexp_extract(lower(page_url), '://([^/?#]*)', 1), '^.*@|:[0-9]+$', '', 'g'), '.') p, rtrim(regexp_replace(regexp_extract(lower(href), '://([^/?#]*)', 1), '^.*@|:[0-9]+$', '', 'g'), '.') q from links),
      hosts as (select p host from two union select q from two), {_DOMAINS}
      select page_id, page_url, href from two left join domains a on a.host = p left join domains b on b.host = q where p <> '' and (p = q or a.\"domain\" = b.\"domain\")""",
)
def site_links(t):
    """Links of every page to a host under its own, to a host elsewhere, and between made-up universities."""
    return D.same_site(_made_links(t), D.default_rules(t.spark))


def _made_links(t):
    made = _made_urls(t)
    n = made.count()
    pages = t["pages"].withColumns({"a": 1 + F.col("page_id") % n, "b": 1 + (F.col("page_id") * 7 + 1) % n})
    host = F.lower(U.netloc(F.col("url")))
    own = F.array(
        F.struct(F.col("ua").alias("page_url"), F.col("ub").alias("href")),
        F.struct(F.col("url").alias("page_url"), F.concat(F.lit("https://lib."), host, F.lit("/x")).alias("href")),
        F.struct(F.col("url").alias("page_url"), F.concat(F.lit("https://other"), (F.col("page_id") % 5).cast("string"), F.lit(".example.org/")).alias("href")),
    )
    joined = pages.join(made.select(F.col("c_custkey").alias("a"), F.col("made").alias("ua")), "a").join(
        made.select(F.col("c_custkey").alias("b"), F.col("made").alias("ub")), "b")
    return joined.select("page_id", F.explode(own).alias("l")).select("page_id", "l.page_url", "l.href")
