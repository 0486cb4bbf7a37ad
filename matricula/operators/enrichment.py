"""Research and encyclopedia enrichment of schools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matricula import fixed_values as V
from matricula.functions import nested
from matricula.functions import text as T
from matricula.functions import urls as U
from matricula.operators.common import first_per_key, left_out, top_n


def recent_author_counts(works: DataFrame, since: Column, limit: int | None = None) -> DataFrame:
    """institution_id, author_id, works, cand_rank: most published authors since a date.

    works(institution_id, author_id, work_id, published). Distinct works are
    counted in two partial steps, so a prolific institution is spread out. With
    `limit`, `left_out` is the number of an institution's authors beyond it.
    """
    counts = (
        works.filter(F.col("published") >= since)
        .select("institution_id", "author_id", "work_id")
        .distinct()
        .groupBy("institution_id", "author_id")
        .agg(F.count(F.lit(1)).alias("works"))
    )
    best = top_n(counts, ["institution_id"], [F.desc("works"), F.asc("author_id")], limit, "cand_rank")
    return best if limit is None else best.join(left_out(counts, ["institution_id"], limit), "institution_id")


def resolve_institutions(schools: DataFrame, candidates: DataFrame, pool: int | None = None) -> DataFrame:
    """Best candidate institution per school, or none.

    schools(school_key, name, homepage); candidates(school_key, cand_rank,
    institution_id, display_name, homepage_url) in search order. Same
    registrable domain first, then an exactly matching name, both among the
    first `pool` (all without it); the top candidate alone only when no homepage contradicts it.
    """
    ranked = top_n(candidates, ["school_key"], [F.col("cand_rank")], pool, "pos")
    both = ranked.join(schools.select("school_key", "name", "homepage"), "school_key")
    wanted = U.registrable_domain(F.col("homepage"))
    has_home = wanted.isNotNull()
    same_domain = F.coalesce(U.registrable_domain(F.col("homepage_url")) == wanted, F.lit(False))
    same_name = F.coalesce(
        T.institution_key(F.col("display_name")) == T.institution_key(F.col("name")), F.lit(False)
    )
    prio = (
        F.when(has_home & same_domain, 1)
        .when(has_home & same_name, 2)
        .when((F.col("pos") == 1) & ~has_home, 3)
    )
    scored = both.withColumn("prio", prio).filter(F.col("prio").isNotNull())
    return first_per_key(scored, ["school_key"], [F.col("prio"), F.col("pos")]).select(
        "school_key", "institution_id", "display_name", "prio"
    )


def judge_authors(
    counts: DataFrame, authors: DataFrame, families: DataFrame, since: Column | int
) -> DataFrame:
    """counts inner authors, with `rejected`: elsewhere, field, or null when kept.

    counts(school_id, institution_id, author_id, works, cand_rank);
    authors(author_id, display_name, topics, affiliations, counts_by_year,
    h_index); families(school_id, families array). Unknown authors drop out.
    """
    since = F.lit(since) if isinstance(since, int) else since
    joined = counts.join(authors, "author_id").join(families, "school_id", "left")
    fields = nested.research_fields(F.col("topics"))
    recent = nested.affiliated_recently(F.col("affiliations"), F.col("institution_id"), since)
    return joined.withColumn("fields", fields).withColumn(
        "rejected",
        F.when(~recent, "elsewhere").when(
            ~nested.plausible_here(F.col("fields"), F.col("families")), "field"
        ),
    )


def honours(notable: DataFrame) -> DataFrame:
    """school_id, match_name, awards from the notable tier; a later duplicate wins.

    notable(school_id, notable_faculty array<struct<name, awards>>).
    """
    people = notable.select(
        "school_id", F.posexplode("notable_faculty").alias("pos", "p")
    ).filter(F.coalesce(F.size(F.col("p")["awards"]) > 0, F.lit(False)))
    return people.groupBy(
        "school_id", T.match_name(F.col("p")["name"]).alias("match_name")
    ).agg(F.max_by(F.col("p")["awards"], F.col("pos")).alias("awards"))


def active_researchers(
    judged: DataFrame, awards: DataFrame | None = None, limit: int = V.TOP_PEOPLE
) -> DataFrame:
    """Top researchers per school: award, then h-index, then recent works, all descending."""
    kept = judged.filter(F.col("rejected").isNull())
    no_awards = F.array().cast("array<string>")
    if awards is not None:
        kept = kept.withColumn("match_name", T.match_name(F.col("display_name"))).join(
            awards, ["school_id", "match_name"], "left"
        )
        kept = kept.withColumn("awards", F.coalesce("awards", no_awards))
    else:
        kept = kept.withColumn("awards", no_awards)
    order = [
        F.desc(F.size("awards") > 0),
        F.desc(F.coalesce("h_index", F.lit(0))),
        F.desc(F.coalesce("works", F.lit(0))),
        F.asc("cand_rank"),
    ]
    return top_n(kept, ["school_id"], order, limit).select(
        "school_id", "rank", F.col("display_name").alias("name"),
        nested.research_topics(F.col("topics")).alias("research"),
        F.slice("fields", 1, 3).alias("fields"),
        F.col("works").alias("recent_works"),
        nested.last_active_year(F.col("counts_by_year")).alias("last_active"),
        "h_index", "awards",
        F.lit("openalex").alias("source"),
        F.col("author_id").alias("source_url"),
    )


def rejection_counts(judged: DataFrame) -> DataFrame:
    return (
        judged.filter(F.col("rejected").isNotNull())
        .groupBy("rejected")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def result_sizes(schools: DataFrame, people: DataFrame, thin_below: int = 10) -> DataFrame:
    """Schools by outcome: empty, thin (fewer than ten) or full; `unresolved` has no institution.

    schools(school_id, resolved boolean).
    """
    n = people.groupBy("school_id").agg(F.count(F.lit(1)).alias("n"))
    found = F.coalesce("n", F.lit(0))
    kind = (
        F.when(~F.col("resolved"), "unresolved")
        .when(found == 0, "empty")
        .when(found < thin_below, "thin")
        .otherwise("full")
    )
    return (
        schools.join(n, "school_id", "left")
        .groupBy(kind.alias("outcome"))
        .agg(F.count(F.lit(1)).alias("schools"))
    )


# ------------------------------------------------------------ encyclopedia --
def person_titles(members: DataFrame) -> DataFrame:
    pattern = "^(" + "|".join(V.NON_PERSON_PREFIXES) + ")"
    return members.filter(~F.col("title").rlike(pattern))


def resolve_category(
    schools: DataFrame,
    members: DataFrame,
    redirects: DataFrame,
    article_hits: DataFrame,
    category_hits: DataFrame,
    cap: int | None = None,
) -> DataFrame:
    """school_id, category, step: the first category that holds any person.

    Steps: the plain name, the redirect target, the article a search finds, the
    category a search finds. members(category, title, ord); redirects(name,
    title); article_hits(name, title); category_hits(name, category). With `cap`
    only the first members of a category are looked at, and `unread` tells how
    many of the chosen category's were not.
    """
    listed = top_n(members, ["category"], [F.col("ord"), F.col("title")], cap, "_rn")
    alive = person_titles(listed).select("category").distinct()
    of = lambda c: F.concat(F.lit("Category:"), c, F.lit(" faculty"))
    named = schools.select("school_id", "name")
    tries = named.select("school_id", of(F.col("name")).alias("category"), F.lit(1).alias("step"))
    for step, rows in ((2, redirects), (3, article_hits)):
        tries = tries.unionByName(
            named.join(rows, "name").select(
                "school_id", of(F.col("title")).alias("category"), F.lit(step).alias("step")
            )
        )
    tries = tries.unionByName(
        named.join(category_hits, "name").select("school_id", "category", F.lit(4).alias("step"))
    )
    found = tries.join(alive, "category", "left_semi").groupBy("school_id").agg(
        F.min_by("category", "step").alias("category"), F.min("step").alias("step")
    )
    return found if cap is None else found.join(left_out(members, ["category"], cap, "unread"), "category", "left").select(
        "school_id", "category", "step", F.coalesce("unread", F.lit(0)).alias("unread"))


def notable_people(
    titles: DataFrame, qids: DataFrame, entities: DataFrame, labels: DataFrame,
    limit: int = V.TOP_PEOPLE,
) -> DataFrame:
    """Humans among the titles, most widely known first, with labelled occupations and awards.

    titles(school_id, title); qids(title, qid); entities(qid, claims,
    description, sitelinks); labels(qid, label). Ids without a label drop out.
    Ranking comes before labelling, so only the people kept are looked up.
    """
    humans = (
        titles.join(qids, "title")
        .join(entities, "qid")
        .filter(nested.is_human(F.col("claims")))
        .withColumn("prominence", nested.sitelink_count(F.col("sitelinks")))
    )
    top = top_n(humans, ["school_id"], [F.desc("prominence"), F.asc("title")], limit)
    ids = top.select(
        "school_id", "title",
        F.explode(
            F.concat(
                F.transform(
                    nested.claim_ids(F.col("claims"), "P106"),
                    lambda q, i: F.struct(F.lit("o").alias("kind"), i.alias("pos"), q.alias("qid")),
                ),
                F.transform(
                    nested.claim_ids(F.col("claims"), "P166"),
                    lambda q, i: F.struct(F.lit("a").alias("kind"), i.alias("pos"), q.alias("qid")),
                ),
            )
        ).alias("x"),
    ).select("school_id", "title", "x.kind", "x.pos", F.col("x")["qid"].alias("lq"))
    named = (
        ids.join(labels.select(F.col("qid").alias("lq"), "label"), "lq")
        .groupBy("school_id", "title")
        .agg(
            *[
                F.transform(
                    F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("pos", "label")))),
                    lambda s: s["label"],
                ).alias(name)
                for k, name in (("o", "occupations"), ("a", "honours"))
            ]
        )
    )
    empty = F.array().cast("array<string>")
    return top.join(named, ["school_id", "title"], "left").select(
        "school_id", "rank",
        F.col("title").alias("name"),
        F.col("description").alias("known_for"),
        nested.occupation_labels(F.coalesce("occupations", empty)).alias("fields"),
        nested.life_status(F.col("claims")).alias("status"),
        "prominence",
        nested.award_labels(F.coalesce("honours", empty)).alias("awards"),
        F.lit("wikipedia").alias("source"),
        F.concat(F.lit("https://en.wikipedia.org/wiki/"), F.replace("title", F.lit(" "), F.lit("_"))).alias("source_url"),
    )


# --------------------------------------------------------------- tier file --
def compact_tier(log: DataFrame, key: str = "school_id", seq: str = "seq") -> DataFrame:
    """Append-only log to one record per key, last one wins, empties kept."""
    rest = [c for c in log.columns if c not in (key, seq)]
    return (
        log.groupBy(key)
        .agg(F.max_by(F.struct(*rest), F.col(seq)).alias("r"))
        .select(key, *[F.col("r")[c].alias(c) for c in rest])
    )
