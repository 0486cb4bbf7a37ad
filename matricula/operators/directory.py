"""Directory discovery over tables of fetched pages, links and sitemap documents.

Nothing here fetches. A page table is `pages(url, status, body)`; walks are
bounded iterations of joins over it, one breadth-first level per round.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matricula import fixed_values as V
from matricula.functions import html as H
from matricula.functions import numeric as N
from matricula.functions import text as T
from matricula.functions import urls as U
from matricula.operators import domains as D
from matricula.operators.common import breadth_first, left_out, pending, spread, top_n
from matricula.session import cut_lineage, through_table


# ----------------------------------------------------------- school filter --
def detect_us(country: Column, location: Column, url: Column) -> Column:
    """struct<is_us, confidence>: explicit country, else `City, ST`, else an .edu host."""
    stated = F.trim(F.coalesce(country, F.lit("")))
    in_state = F.coalesce(T.city_state(location).isin(*V.US_STATES), F.lit(False))
    edu = F.coalesce(U.looks_edu(url), F.lit(False))
    return F.struct(
        F.when(stated != "", F.upper(stated).isin(*V.US_COUNTRY_VALUES))
        .otherwise(in_state | edu)
        .alias("is_us"),
        F.when((stated == "") & (in_state | edu), "low").otherwise("high").alias("confidence"),
    )


def load_schools(catalog: DataFrame, details: DataFrame | None = None) -> DataFrame:
    """US schools with a homepage, one per id (first row by `seq`), details passed through."""
    seen = catalog.filter(F.col("id").isNotNull() & (F.col("id") != "")).withColumn(
        "_us", detect_us(F.col("country"), F.col("location"), F.col("url"))
    )
    schools = seen.filter(F.col("_us")["is_us"]).select(
        F.col("id").alias("school_id"),
        F.coalesce(F.nullif("name", F.lit("")), F.col("id")).alias("name"),
        F.col("id").alias("slug"),
        F.lit("US").alias("country"),
        T.city_state(F.col("location")).alias("state"),
        U.homepage_url(F.col("url")).alias("homepage"),
        T.control_type(F.col("type")).alias("control"),
        F.col("_us")["confidence"].alias("confidence"),
        "seq",
    )
    schools = top_n(
        schools.filter(F.col("homepage").isNotNull()), ["slug"], [F.col("seq")], 1, "_rn"
    ).drop("_rn", "seq")
    if details is None:
        return schools.withColumn("source_fields", F.create_map().cast("map<string,string>"))
    empty = F.create_map().cast("map<string,string>")
    return schools.join(
        details.select("school_id", F.col("details").alias("source_fields")), "school_id", "left"
    ).withColumn("source_fields", F.coalesce("source_fields", empty))


# ------------------------------------------------------------------ links ---
def page_links(pages: DataFrame) -> DataFrame:
    """page_url, pos, href (absolute), text, rel for every usable anchor."""
    base = F.col("url")
    links = spread(pages).select(
        base.alias("page_url"), F.posexplode(H.anchors(F.col("body"))).alias("pos", "a")
    ).filter(H.usable_href(F.col("a")["href"]))
    return links.select(
        "page_url", "pos",
        U.resolve(F.col("page_url"), F.col("a")["href"]).alias("href"),
        F.col("a")["text"].alias("text"),
        F.col("a")["rel"].alias("rel"),
    ).filter(F.lower("href").rlike("^https?://"))


def same_domain(links: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Links inside one registrable domain: by public-suffix rules (see `domains`) if given, else by the fixed compound suffixes."""
    if rules is not None:
        return D.same_site(links, rules)
    return links.filter(
        U.registrable_domain(F.col("href")) == U.registrable_domain(F.col("page_url"))
    )


def classified_links(pages: DataFrame) -> DataFrame:
    links = page_links(pages)
    return links.withColumns(
        {
            "norm": U.normalize_url(F.col("href")),
            "kind": U.classify_link(
                F.col("href"), F.col("page_url"), F.col("text"), F.col("rel")
            ),
        }
    )


def links_matching(links: DataFrame, hints: tuple[str, ...], rules: DataFrame | None = None) -> DataFrame:
    """On-domain links whose path or text mentions a hint; self links and repeats dropped."""
    target = F.regexp_replace("href", "#.*$", "")
    strip = lambda c: F.regexp_replace(c, "/+$", "")
    hay = F.concat_ws(" ", F.lower(U.path(F.col("href"))), F.lower("text"))
    found = same_domain(links, rules).filter(hay.rlike("|".join(hints))).withColumn("href", target)
    return (
        found.filter(strip(F.col("href")) != strip(F.col("page_url")))
        .groupBy("page_url", "href")
        .agg(F.min("pos").alias("pos"))
    )


def first_pages(found: DataFrame) -> DataFrame:
    """Each URL once, with the page it was first seen on: (page_ord, pos) decides."""
    return found.groupBy("school_id", "norm").agg(
        F.min_by("page_url", F.struct("page_ord", "pos")).alias("page_url"),
        F.min(F.struct("page_ord", "pos")).alias("at"),
    )


def merge_links(first: DataFrame, second: DataFrame) -> DataFrame:
    """Union keeping the first set's order, then unseen rows of the second.

    Both sides: school_id, url, ord.
    """
    both = first.withColumn("src", F.lit(0)).unionByName(second.withColumn("src", F.lit(1)))
    return both.groupBy("school_id", "url").agg(F.min(F.struct("src", "ord")).alias("at")).select(
        "school_id", "url", F.col("at")["src"].alias("src"), F.col("at")["ord"].alias("ord")
    )


def cap_new(urls: DataFrame, ledger: DataFrame, cap: int | None) -> tuple[DataFrame, DataFrame]:
    """(urls to fetch, counts per school). Finished URLs do not use up the cap.

    `urls(school_id, profile_url, ord)`. The skipped count comes from totals, so
    ranking keeps only `cap` rows per school.
    """
    fresh = pending(urls, ledger, "profile_url")
    chosen = top_n(fresh, ["school_id"], [F.col("ord"), F.col("profile_url")], cap)
    totals = urls.groupBy("school_id").agg(F.count(F.lit(1)).alias("listed"))
    new = fresh.groupBy("school_id").agg(F.count(F.lit(1)).alias("new"))
    n = F.coalesce("new", F.lit(0))
    most = n if cap is None else F.least(n, F.lit(cap))
    counts = totals.join(new, "school_id", "left").select(
        "school_id",
        (F.col("listed") - n).alias("already_done"),
        most.alias("attempted"),
        (n - most).alias("cap_skipped"),
    )
    return chosen, counts


def truncate(rows: DataFrame, key: str, order: list[Column], cap: int | None) -> DataFrame:
    """First `cap` rows per key; `truncated` is set once the count reaches the cap."""
    kept = top_n(rows, [key], order, cap, "rn")
    full = F.lit(False) if cap is None else F.count(F.lit(1)) >= cap
    sizes = rows.groupBy(key).agg(full.alias("truncated"))
    return kept.join(sizes, key)


# -------------------------------------------------------- sitemap clusters --
def directory_pages(urls: DataFrame) -> DataFrame:
    return urls.filter(U.is_directory_index(F.col("url")))


def profile_clusters(urls: DataFrame, min_size: int = V.MIN_CLUSTER_SIZE) -> DataFrame:
    """school_id, parent, n for folders with enough sibling profile pages.

    Clusters are counted, not gathered; `cluster_members` joins the URLs back.
    """
    return (
        _cluster_urls(urls)
        .groupBy("school_id", "parent")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= min_size)
    )


def _cluster_urls(urls: DataFrame) -> DataFrame:
    parent = U.cluster_parent(F.col("url"))
    return (
        urls.filter(~U.is_directory_index(F.col("url")))
        .withColumn("parent", parent)
        .filter(F.col("parent").isNotNull())
    )


def largest_cluster(clusters: DataFrame) -> DataFrame:
    """Biggest cluster per school; a tie goes to the greater parent."""
    return clusters.groupBy("school_id").agg(F.max(F.struct("n", "parent")).alias("c")).select(
        "school_id", F.col("c")["parent"].alias("parent"), F.col("c")["n"].alias("n")
    )


def cluster_members(urls: DataFrame, clusters: DataFrame) -> DataFrame:
    return _cluster_urls(urls).join(
        clusters.select("school_id", "parent"), ["school_id", "parent"], "left_semi"
    )


# ------------------------------------------------------ candidate assembly --
def resolves(status: Column, body: Column) -> Column:
    """Fetched, HTML, and not a soft "not found" page."""
    return (status == 200) & H.looks_like_html(body) & ~H.soft_404(body)


def heuristic_candidates(schools: DataFrame) -> DataFrame:
    return schools.select(
        "school_id", F.posexplode(U.candidate_urls(F.col("homepage"))).alias("ord", "url")
    )


def assemble_candidates(
    sitemap: DataFrame,
    heuristic: DataFrame,
    search: DataFrame,
    department: DataFrame,
    pages: DataFrame,
) -> DataFrame:
    """school_id, url, source, ord: sources in order, the first one keeps a URL.

    Sources are `(school_id, url, ord)`. Department pages count only for schools
    where every earlier source came up empty.
    """
    live = pages.filter(resolves(F.col("status"), F.col("body"))).select("url")
    early = None
    for prio, (name, rows) in enumerate(
        (("sitemap", sitemap), ("heuristic", heuristic), ("search", search))
    ):
        part = rows.select(
            "school_id", "url", F.struct(F.lit(prio).alias("prio"), F.col("ord").cast("bigint").alias("ord")).alias("at"),
            F.lit(name).alias("source"),
        )
        early = part if early is None else early.unionByName(part)
    early = early.join(live, "url", "left_semi")
    late = (
        department.select(
            "school_id", "url",
            F.struct(F.lit(3).alias("prio"), F.col("ord").cast("bigint").alias("ord")).alias("at"),
            F.lit("department").alias("source"),
        )
        .join(live, "url", "left_semi")
        .join(early.select("school_id").distinct(), "school_id", "left_anti")
    )
    return early.unionByName(late).groupBy("school_id", "url").agg(
        F.min_by("source", "at").alias("source"), F.min("at").alias("at")
    )


def trusted_proposals(proposals: DataFrame, candidates: DataFrame) -> DataFrame:
    """Keep proposed URLs that are candidates, in order; count the others.

    proposals(school_id, directory_urls array, confidence string, notes).
    """
    flat = proposals.select("school_id", F.posexplode("directory_urls").alias("pos", "url"))
    known = candidates.select("school_id", "url", F.lit(True).alias("_ok")).distinct()
    judged = (
        flat.join(known, ["school_id", "url"], "left")
        .groupBy("school_id")
        .agg(
            F.array_sort(F.collect_list(F.when(F.col("_ok"), F.struct("pos", "url")))).alias("kept"),
            F.count_if(F.col("_ok").isNull()).alias("dropped"),
        )
    )
    joined = proposals.join(judged, "school_id", "left")
    urls = F.coalesce(F.transform("kept", lambda k: k["url"]), F.array().cast("array<string>"))
    return joined.select(
        "school_id",
        urls.alias("directory_urls"),
        F.coalesce("dropped", F.lit(0)).alias("dropped"),
        F.when(F.size(urls) > 0, N.confidence_or_zero(F.col("confidence")))
        .otherwise(0.0)
        .alias("confidence"),
        T.blank_to_null(F.col("notes")).alias("notes"),
    )


def admit_by_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Add `admitted`: the first matching (host, prefix) rule decides, no rule admits.

    rules(host, prefix, allow, ord). Rules meet URLs through an equi-join on the
    host; the decision is a map-side-combined minimum per URL.
    """
    at = urls.withColumns(
        {"host": F.lower(U.netloc(F.col("url"))), "_path": U.path(F.col("url"))}
    )
    hits = (
        at.select("url", "host", "_path").distinct()
        .join(rules, "host")
        .filter(F.col("_path").startswith(F.col("prefix")))
        .groupBy("url")
        .agg(F.min_by("allow", "ord").alias("_allow"))
    )
    return (
        at.join(hits, "url", "left")
        .withColumn("admitted", F.coalesce("_allow", F.lit(True)))
        .drop("_allow", "host", "_path")
    )


def rules_verdict(admitted: DataFrame) -> DataFrame:
    """Per school: URLs left and whether none was dropped."""
    return admitted.groupBy("school_id").agg(
        F.count_if("admitted").alias("allowed_urls"), F.bool_and("admitted").alias("all_admitted")
    )


def admitted_verdicts(verdicts: DataFrame, rules: DataFrame) -> DataFrame:
    """Verdicts after the rule table: refused URLs leave, none left means confidence 0.

    Adds `all_admitted`. Each verdict's own short URL list is unfolded and put
    back in its order.
    """
    flat = verdicts.select("school_id", F.posexplode("directory_urls").alias("pos", "url"))
    judged = (
        admit_by_rules(flat, rules)
        .groupBy("school_id")
        .agg(
            F.array_sort(F.collect_list(F.when(F.col("admitted"), F.struct("pos", "url")))).alias("left"),
            F.bool_and("admitted").alias("all_admitted"),
        )
    )
    urls = F.coalesce(F.transform("left", lambda k: k["url"]), F.array().cast("array<string>"))
    return verdicts.drop("directory_urls").join(judged, "school_id", "left").select(
        "school_id",
        urls.alias("directory_urls"),
        "dropped",
        F.when(F.size(urls) > 0, F.col("confidence")).otherwise(0.0).alias("confidence"),
        "notes",
        F.coalesce("all_admitted", F.lit(True)).alias("all_admitted"),
    )


def directory_rows(
    schools: DataFrame, candidates: DataFrame, clusters: DataFrame, verdicts: DataFrame
) -> DataFrame:
    """One directory row per school: verdict, else profile cluster, else nothing found.

    clusters: `largest_cluster` rows; verdicts: `trusted_proposals` rows, or
    those rows after `admitted_verdicts`.
    """
    if "all_admitted" not in verdicts.columns:
        verdicts = verdicts.withColumn("all_admitted", F.lit(True))
    src = F.col("source")
    used = candidates.groupBy("school_id").agg(
        *[F.bool_or(src == s).alias(f"u_{s}") for s in ("sitemap", "department", "heuristic", "search")],
        F.count(F.lit(1)).alias("n_candidates"),
    )
    has = F.coalesce(F.col("n_candidates") > 0, F.lit(False))
    cluster = F.col("n").isNotNull()
    false = F.lit(False)
    label = T.method_label(
        *[F.coalesce(f"u_{s}", false) for s in ("sitemap", "department", "heuristic", "search")]
    )
    return (
        schools.select("school_id")
        .join(used, "school_id", "left")
        .join(clusters.select("school_id", "n"), "school_id", "left")
        .join(verdicts, "school_id", "left")
        .select(
            "school_id",
            F.when(has, F.coalesce("directory_urls", F.array().cast("array<string>")))
            .otherwise(F.array().cast("array<string>"))
            .alias("directory_urls"),
            F.col("n").alias("n_profile_urls"),
            (~has | F.coalesce("all_admitted", F.lit(True))).alias("rules_allowed"),
            F.when(
                has,
                F.nullif(
                    F.concat_ws(
                        "; ",
                        "notes",
                        F.when(
                            F.col("dropped") > 0,
                            F.format_string(
                                "dropped %d proposed URL(s) not in the candidate set", F.col("dropped")
                            ),
                        ),
                        F.when(~F.col("all_admitted"), "one or more chosen URLs were dropped by rule"),
                    ),
                    F.lit(""),
                ),
            )
            .when(cluster, "profile URLs found in the sitemap; no directory page resolved")
            .otherwise("no candidate directory URL resolved")
            .alias("notes"),
            F.when(~has & cluster, "sitemap").otherwise(label).alias("discovery_method"),
            F.when(has, F.coalesce("confidence", F.lit(0.0)))
            .when(cluster, F.lit(V.CLUSTER_ONLY_CONFIDENCE))
            .otherwise(F.lit(0.0))
            .alias("confidence"),
        )
    )


# ------------------------------------------------------------------ walks ---
FEW_PAGES = 1 << 17  # a frontier up to this is sent to all tasks


def walk_directories(
    entrypoints: DataFrame, pages: DataFrame, max_pages: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(profile links, walk summary) from following pagination breadth-first.

    entrypoints(school_id, url, ord); pages(url, status, body). At most
    `max_pages` existing pages per school (no limit without it), shared by its
    entrypoints; `page_cap_hit` tells where the limit left pages in the queue. A round
    reads the links of the pages it visits; one that visits over `FEW_PAGES` has those of
    all pages read, once.
    """
    # One page per normalised URL, chosen without moving any page body.
    listed = through_table(
        pages.groupBy(U.normalize_url(F.col("url")).alias("norm")).agg(
            F.min("url").alias("page_url"), F.min_by("status", "url").alias("status")
        ), "listed")
    fetched = pages.filter(F.col("status") == 200).select("url", "body")
    read: list[DataFrame] = []
    whole: list[DataFrame] = []

    def links_of(some: DataFrame) -> DataFrame:
        return (
            classified_links(some)
            .filter(F.col("kind") != "ignore")
            .withColumn("src", U.normalize_url(F.col("page_url")))
            .filter(F.col("norm") != F.col("src"))
            .withColumn("domain", U.registrable_domain(F.col("href")))
            .select("src", "page_url", "pos", "norm", "kind", "domain")
        )

    def counted(nodes: DataFrame) -> DataFrame:
        """Whether there is a page at the column `norm`; the few nodes are sent to the many pages."""
        there = listed.join(nodes.select("norm").distinct(), "norm", "left_semi").select("norm", F.lit(True).alias("there"))
        return nodes.join(there, "norm", "left").withColumn("counted", F.coalesce("there", F.lit(False))).drop("there")

    def leaving(front: DataFrame) -> DataFrame:
        here = through_table(
            listed.filter(F.col("status") == 200)
            .join(front.select(F.col("src").alias("norm")).distinct(), "norm", "left_semi")
            .select(F.col("norm").alias("src"), "page_url"), "walk-pages")
        if not whole and here.count() > FEW_PAGES:
            whole.append(through_table(links_of(fetched), "all-links"))
        if whole:
            links = whole[0].join(here, ["src", "page_url"], "left_semi")
        else:
            links = links_of(fetched.join(F.broadcast(here.select(F.col("page_url").alias("url"))), "url", "left_semi"))
        read.append(through_table(links, "walk-links"))
        return counted(read[-1].filter(F.col("kind") == "pagination")).select(
            "src", "pos", F.col("norm").alias("node"), "domain", "counted")

    roots = entrypoints.withColumn("norm", U.normalize_url(F.col("url")))
    allowed = roots.select("school_id", U.registrable_domain(F.col("url")).alias("domain")).distinct()
    start = counted(roots).select("school_id", F.col("norm").alias("node"), "ord", "counted")
    inside = lambda reached: reached.join(allowed, ["school_id", "domain"], "left_semi")
    walk = breadth_first(start, leaving, max_pages, inside)
    links = reduce(DataFrame.unionByName, read) if read else links_of(fetched.filter("false"))
    visited = walk.filter(F.col("visit").isNotNull())
    profiles = (
        inside(
            visited.select("school_id", F.col("node").alias("src"), F.col("visit").alias("page_ord"))
            .join(links.filter(F.col("kind") == "profile"), "src")
        )
        .join(roots.select("school_id", "norm").distinct(), ["school_id", "norm"], "left_anti")
    )
    found = first_pages(profiles)
    summary = (
        walk.groupBy("school_id")
        .agg(F.count("visit").alias("pages_visited"), F.bool_or("remaining").alias("remaining"))
        .join(found.groupBy("school_id").agg(F.count(F.lit(1)).alias("profiles")), "school_id", "left")
        .select(
            "school_id", "pages_visited",
            F.coalesce("profiles", F.lit(0)).alias("profiles"),
            (F.lit(False) if max_pages is None else (F.col("pages_visited") >= max_pages) & F.col("remaining")).alias("page_cap_hit"),
        )
    )
    return found, summary


def read_sitemaps(
    seeds: DataFrame,
    documents: DataFrame,
    max_documents: int | None = None,
    max_urls: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(urls with their order, summary per school) from recursive sitemap indexes.

    seeds(school_id, doc_url, ord); documents(doc_url, status, body). Documents
    are tried breadth-first, at most `max_documents` per school whether or not they
    exist; at most `max_urls` are kept. No limit without them; `truncated` reports a cut.
    """
    parsed = cut_lineage(
        documents.filter(F.col("status") == 200)
        .select(F.col("doc_url").alias("src"), H.sitemap_entries(F.col("body")).alias("m"))
        .select("src", "m.kind", F.posexplode("m.locs").alias("pos", "loc"))
    )
    is_index = F.col("kind") == "sitemapindex"
    edges = parsed.filter(is_index).select(
        "src", "pos", F.col("loc").alias("node"), F.lit(True).alias("counted")
    )
    start = seeds.select("school_id", F.col("doc_url").alias("node"), "ord", F.lit(True).alias("counted"))
    walk = breadth_first(start, edges, max_documents)
    listed = (
        walk.filter(F.col("visit").isNotNull())
        .select("school_id", F.col("node").alias("src"), F.col("visit").alias("doc_ord"))
        .join(parsed.filter(~is_index), "src")
        .select("school_id", "doc_ord", "pos", F.col("loc").alias("url"))
    )
    urls = truncate(listed, "school_id", [F.col("doc_ord"), F.col("pos")], max_urls)
    summary = (
        walk.groupBy("school_id")
        .agg(F.count("visit").alias("documents_tried"), F.bool_or("remaining").alias("remaining"))
        .join(
            urls.groupBy("school_id").agg(
                F.count(F.lit(1)).alias("urls"), F.bool_or("truncated").alias("url_cap")
            ),
            "school_id", "left",
        )
        .select(
            "school_id", "documents_tried",
            F.coalesce("urls", F.lit(0)).alias("urls"),
            (F.col("remaining") | F.coalesce("url_cap", F.lit(False))).alias("truncated"),
        )
    )
    return urls.select("school_id", "url", "doc_ord", "pos"), summary


def department_people_pages(
    schools: DataFrame, pages: DataFrame, budget: int | None = None
) -> DataFrame:
    """school_id, url, ord: people listings reached through a school's departments.

    Two hops: the first department index (in path order) that yields department
    links, then the people links of at most `budget` departments, `budget` in all
    (no limit without it). With a budget, `left_out` counts a school's departments beyond it.
    """
    live = pages.filter(resolves(F.col("status"), F.col("body")))
    index = schools.select(
        "school_id",
        F.posexplode(U.candidate_urls(F.col("homepage"), V.DEPARTMENT_INDEX_PATHS)).alias("ord", "url"),
    )
    links = page_links(live.select("url", "body"))
    departments = index.join(
        links_matching(links, V.DEPARTMENT_LINK_HINTS).withColumnRenamed("page_url", "url"), "url"
    ).select("school_id", "ord", "href", "pos")
    best = departments.groupBy("school_id").agg(F.min("ord").alias("ord"))
    chosen = top_n(
        departments.join(best, ["school_id", "ord"], "left_semi"),
        ["school_id"], [F.col("pos"), F.col("href")], budget, "d",
    )
    people = chosen.select("school_id", "d", F.col("href").alias("url")).join(
        links_matching(links, V.PEOPLE_LINK_HINTS).withColumnRenamed("page_url", "url"), "url"
    )
    firsts = people.groupBy("school_id", F.col("href").alias("url")).agg(
        F.min(F.struct("d", "pos")).alias("at")
    )
    listed = top_n(firsts, ["school_id"], [F.col("at"), F.col("url")], budget, "ord").drop("at")
    if budget is None:
        return listed
    beyond = left_out(departments.join(best, ["school_id", "ord"], "left_semi"), ["school_id"], budget)
    return listed.join(beyond, "school_id")
