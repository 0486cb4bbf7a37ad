"""URL filter: a blocked Bloom filter of the listed keys passes possible hits to an exact hash join.

Only DataFrame functions. A listed rule is (host, path, verdict); its key is host || path. A url
fits a rule when its host is the rule's host or a subdomain and its path starts with the rule's
path, so the keys to look up are the url's (host suffix, path prefix) pairs in the shapes (number
of labels, path length) that the list holds.

Defined results: a null url, or one without `://`, has empty host and path and fits no rule. Null
ids and repeated rows are kept as they are. Rules with a null or empty host or a null path are
ignored; of equal rules the larger verdict text counts. An empty list leaves every url to `default`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matricula.llm.base import ascii_lower, register, table

BITS_PER_KEY = 16
#: Largest filter: 32,768 blocks of 256 bits. It is broadcast, so its size has this bound whatever
#: the list holds; a longer list only makes more false positives, which the exact join removes.
MAX_BLOCKS = 1 << 15
SALTS = 32
WORDS = range(4)  # of 64 bits in a block; a key sets two bits in each


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; both empty without `://`."""
    at = F.instr(url, "://")
    tail = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise("")
    tail = F.coalesce(tail, F.lit(""))
    return (
        ascii_lower(F.regexp_extract(tail, r"^[^/?#]*", 0)),
        F.regexp_extract(tail, r"^[^/?#]*([^?#]*)", 1),
    )


def _block(blocks: int) -> Column:
    return F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int")


def _mask(word: int) -> Column:
    bit = "shiftleft(1L, cast(shiftrightunsigned(xxhash64(key, 'bits'), {}) & 63 as int))"
    return F.expr(f"{bit.format(12 * word)} | {bit.format(12 * word + 6)}")


def bloom_blocks(keys: DataFrame, blocks: int) -> DataFrame:
    """The filter as a table (block, b0..b3) of at most `blocks` rows."""
    return (
        keys.select(_block(blocks).alias("block"), *(_mask(w).alias(f"m{w}") for w in WORDS))
        .groupBy("block")
        .agg(*(F.bit_or(f"m{w}").alias(f"b{w}") for w in WORDS))
    )


def possible_hits(candidates: DataFrame, filter_blocks: DataFrame, blocks: int) -> DataFrame:
    """Candidates whose `key` may be listed."""
    probed = candidates.withColumn("block", _block(blocks)).join(F.broadcast(filter_blocks), "block")
    for w in WORDS:
        probed = probed.filter(_mask(w).bitwiseAND(F.col(f"b{w}")) == _mask(w))
    return probed.select(*candidates.columns)


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Add host, path, rule and verdict to every row of `pages` (replacing columns of those names)."""
    listed = (
        rules.filter(F.col("path").isNotNull() & (F.col("host") != ""))
        .groupBy(F.concat("host", "path").alias("key"))
        .agg(
            F.first(F.size(F.split("host", r"\."))).alias("labels"),
            F.first(F.length("path")).alias("chars"),
            F.max("verdict").alias("verdict"),
        )
    )
    size = listed.agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.struct("labels", "chars")).alias("shapes")).first()
    host, path = split_url(F.col(url))
    others = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    judged = pages.select(*others, host.alias("host"), path.alias("path"))
    if not size["n"]:
        return judged.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    blocks = max(1, min(MAX_BLOCKS, -(-size["n"] * BITS_PER_KEY // 256)))
    shapes = F.array(*(F.struct(F.lit(s["labels"]).alias("labels"), F.lit(s["chars"]).alias("chars"))
                       for s in sorted(size["shapes"])))
    # one row per distinct url before anything is unfolded, so repeated urls cost nothing
    urls = judged.select("host", "path").filter(F.col("host") != "").distinct()
    candidates = (
        urls.select("host", "path", F.explode(shapes).alias("s"))
        .filter((F.size(F.split("host", r"\.")) >= F.col("s.labels")) & (F.length("path") >= F.col("s.chars")))
        .select("host", "path", F.expr("substring_index(host, '.', -s.labels) || substring(path, 1, s.chars)").alias("key"))
    )
    hits = possible_hits(candidates, bloom_blocks(listed, blocks), blocks)
    # one short key may fit a third of all urls: the urls are salted and the list repeated for each salt
    salted = hits.withColumn("salt", F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).cast("int"))
    exact_keys = listed.select("key", "verdict", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    exact = salted.join(exact_keys.hint("shuffle_hash"), ["key", "salt"])
    # the longest key wins; of two keys of one length that without a path, else that of the shorter host
    rank = F.struct(F.length("key"), -F.instr("key", "/"), F.col("key"), F.col("verdict"))
    best = exact.groupBy("host", "path").agg(F.max(rank).alias("best")).select(
        "host", "path", F.col("best.key").alias("rule"), F.col("best.verdict").alias("verdict"))
    return (
        judged.join(best, ["host", "path"], "left")
        .select(*others, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
    )


#: Fixed values of the query.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)

ORACLE = """
with rules(host, path, verdict) as (values {rules}),
tails as (
  select row_number() over () as r, page_id,
         case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end as tail
  from pages),
parts as (
  select r, page_id,
         translate(regexp_extract(tail, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(tail, '^[^/?#]*([^?#]*)', 1) as path
  from tails),
fits as (
  select p.r, arg_max(u.host || u.path, length(u.host || u.path)) as rule,
         arg_max(u.verdict, length(u.host || u.path)) as verdict
  from parts p join rules u on (p.host = u.host or ends_with(p.host, '.' || u.host)) and starts_with(p.path, u.path)
  group by p.r)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict
from parts left join fits using (r)
""".format(rules=", ".join(str(r) for r in RULES))


@register("op3_url_filter", ORACLE)
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(RULES), "host string, path string, verdict string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")
