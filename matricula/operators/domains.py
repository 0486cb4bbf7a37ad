"""Registrable domains by public-suffix rules.

Rules come as a table or as a file in the format of public suffix lists, at a path the caller names. A host is
unfolded into its suffixes, which meet the rules in one equi-join; an exception rule prevails, else the longest
suffix does, and a host that meets no rule has its last label as its suffix. Only distinct hosts are unfolded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matricula import fixed_values as V
from matricula.functions import urls as U


def suffix_rules(lines: DataFrame, line: str = "value") -> DataFrame:
    """rules(key, gain): the labels a rule names, and how many more (`*.key`) or fewer (`!key`) are the suffix.

    A line holds one rule up to its first white space; blank lines and those starting with `//` are comments."""
    rule = F.lower(F.regexp_extract(line, r"^\s*(\S*)", 1))
    key = F.regexp_replace(rule, r"^(?:!|\*\.|\.)", "")
    gain = F.when(rule.startswith("!"), -1).when(rule.startswith("*."), 1).otherwise(0)
    # a lone star is what holds for a host without a rule anyway
    return lines.filter((rule != "") & ~rule.startswith("//") & (rule != "*")).select(key.alias("key"), gain.alias("gain")).distinct()


def read_suffix_rules(spark: SparkSession, path: str) -> DataFrame:
    return suffix_rules(spark.read.text(path))


def default_rules(spark: SparkSession) -> DataFrame:
    """The suffixes that universities of some countries register under, for callers without a list of their own."""
    return suffix_rules(spark.createDataFrame([(r,) for r in V.SUFFIX_RULES], "value string"))


def host(url: Column) -> Column:
    """Lower-case host of a URL (or of a bare host), without user, port and closing dot; null when there is none."""
    whole = F.when(url.contains("//"), url).otherwise(F.concat(F.lit("//"), url))
    bare = F.regexp_replace(F.lower(U.netloc(F.trim(whole))), "^.*@", "")
    return F.nullif(F.regexp_replace(bare, r"\.?(?::\d*)?$", ""), F.lit(""))


def _last(labels: Column, n: Column) -> Column:
    return F.array_join(F.slice(labels, F.size(labels) - n + 1, n), ".")


def registrable(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """hosts(host) -> one row a host: host, suffix, domain (the suffix and one more label).

    An address in digits or brackets has neither; a host that is itself a suffix has no domain."""
    named = hosts.select("host").filter("host is not null").distinct()
    numeric = F.col("host").rlike(r"^(?:\d{1,3}(?:\.\d{1,3}){3}|\[.*\])$")
    labels = F.split("host", r"\.")
    places = F.when(numeric, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.size(labels)))
    unfolded = named.select("host", F.explode(places).alias("n")).withColumn("key", _last(labels, F.col("n")))
    size = F.col("n") + F.col("gain")
    met = (
        unfolded.join(rules, "key").filter(size <= F.size(labels))
        .groupBy("host").agg(F.max(F.struct((F.col("gain") < 0).alias("exception"), size.alias("n")))["n"].alias("n"))
    )
    size = F.when(~numeric, F.coalesce("n", F.lit(1)))
    return named.join(met, "host", "left").select(
        "host", _last(labels, size).alias("suffix"), F.when(F.size(labels) > size, _last(labels, size + 1)).alias("domain"))


def same_site(links: DataFrame, rules: DataFrame, page: str = "page_url", target: str = "href") -> DataFrame:
    """Links whose page and target have one registrable domain, or the same host.

    Links inside one host, most of a site's, are kept without a join, so a site with very many links is no hot key."""
    both = links.withColumns({"_p": host(F.col(page)), "_t": host(F.col(target))}).filter("_p is not null and _t is not null")
    inside = both.filter("_p = _t").drop("_p", "_t")
    across = both.filter("_p <> _t")
    hosts = across.select(F.explode(F.array("_p", "_t")).alias("host"))
    domains = registrable(hosts, rules).filter("domain is not null").select("host", "domain")
    for side in ("_p", "_t"):
        across = across.join(domains.select(F.col("host").alias(side), F.col("domain").alias(f"{side}d")), side)
    return inside.unionByName(across.filter("_pd = _td").select(*links.columns))
