"""Readers for the source files. Single-file JSON inputs are landed once as
parquet by the caller when they are read more than once."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from matricula import fixed_values as V
from matricula import schemas
from matricula.operators.validation import with_violations


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(hadoop_path)
    return found is not None and len(found) > 0


def _require_root(spark: SparkSession, path: str, bracket: str, kind: str) -> None:
    head = spark.read.text(path).filter(F.trim("value") != "").first()
    if head is None or not head[0].lstrip("﻿ \t").startswith(bracket):
        raise ValueError(f"{path}: expected a JSON {kind}")


def read_scorecard(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Federal CSV, every cell text, used columns only (the scan prunes the rest).

    `seq` orders rows by file name, then place in the file, however Spark packs splits into tasks, so
    "first row wins" is defined.
    """
    raw = spark.read.option("header", True).option("multiLine", multiline).option("escape", '"').csv(path)
    have = set(raw.columns)
    cols = [F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in V.SCORECARD_COLUMNS]
    # inside one split (file and block) the row ids of its task ascend
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                     F.monotonically_increasing_id().alias("row"))
    return raw.select(*cols, place.alias("seq"))


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON array of records; any other root is an error."""
    _require_root(spark, path, "[", "array")
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_keyed_json(spark: SparkSession, path: str, value_type: str, key: str = "id") -> DataFrame:
    """`{id: record}` object(s) to rows (key, value); an absent file is an empty table."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], f"{key} string, value {value_type}")
    _require_root(spark, path, "{", "object keyed by id")
    texts = spark.read.option("wholetext", True).text(path)
    return texts.select(F.explode(F.from_json("value", f"map<string,{value_type}>")).alias(key, "value"))


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """name -> federal name; keys starting with an underscore are comments."""
    rows = read_keyed_json(spark, path, "string", key="name")
    return rows.filter(~F.col("name").startswith("_")).withColumnRenamed("value", "alias")


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Strict JSON lines: a malformed line fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_json_lines_tolerant(
    spark: SparkSession, path: str, schema: str, rules: Mapping[str, Column] | None = None
) -> tuple[DataFrame, Observation]:
    """(good rows, observation of `good` and `malformed`). Broken rules count as malformed.

    The counts come with the first action on the good rows, such as their write, and need no scan of their own."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = F.from_json(
        "value", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    )
    raw = lines.select(parsed.alias("r")).select("r.*")
    checked = with_violations(raw, rules) if rules else raw.withColumn("violations", F.array())
    ok = F.col("_corrupt").isNull() & (F.size("violations") == 0)
    seen = Observation()
    counted = checked.observe(seen, F.count_if(ok).alias("good"), F.count_if(~ok).alias("malformed"))
    return counted.filter(ok).drop("_corrupt", "violations"), seen


def read_editorial_js(spark: SparkSession, path: str) -> DataFrame:
    """Records `{n:"...", v:{...}}` out of JavaScript files, in file-name then text order."""
    record = r'\{n:"(?:[^{}]++|\{[^{}]*+\})*+\}'  # possessive: no frame a character, however long a record is
    files = spark.read.option("wholetext", True).text(path).select(
        "value", F.col("_metadata.file_name").alias("file")
    )
    rows = files.select(
        "file", F.posexplode(F.regexp_extract_all("value", F.lit(record), F.lit(0))).alias("pos", "r")
    )

    def text(key: str) -> Column:
        hit = F.regexp_extract("r", rf'\b{key}:"([^"]*)"', 1)
        return F.when(F.col("r").rlike(rf'\b{key}:"'), hit)

    def number(key: str, source: str = "r") -> Column:
        return F.nullif(F.regexp_extract(source, rf"\b{key}:\s*(-?\d*\.?\d+)", 1), F.lit("")).cast("double")

    body = F.regexp_extract("r", r"\bstrengths:\s*\[([^\]]*)\]", 1)
    return rows.withColumn("v", F.regexp_extract("r", r"\bv:\s*\{([^}]*)\}", 1)).select(
        F.struct("file", "pos").alias("seq"),
        text("n").alias("name"),
        text("loc").alias("location"),
        text("ctry").alias("country"),
        text("region").alias("region"),
        text("type").alias("type"),
        text("setting").alias("setting"),
        number("size").cast("int").alias("enrollment_editorial"),
        number("net").cast("int").alias("net_price"),
        number("gpa").alias("avg_gpa"),
        F.regexp_extract_all(body, F.lit('"([^"]*)"'), F.lit(1)).alias("majors"),
        F.struct(*[number(a, "v").alias(a) for a in V.CULTURE_AXES]).alias("culture"),
    )


def read_research_batches(spark: SparkSession, path: str) -> DataFrame:
    """batch, school_id, faculty, research, src, retrieved, seq from `batch-*.json`; name order is precedence.

    `src` may be a list or a single string; anything else is no source.
    """
    from matricula.functions.nested import scalar_or_list

    texts = spark.read.option("wholetext", True).text(path).select(
        "value", F.col("_metadata.file_name").alias("batch")
    )
    rows = texts.select(
        "batch",
        F.posexplode(F.from_json("value", f"map<string,{schemas.RESEARCH_ENTRY}>")).alias(
            "seq", "school_id", "e"
        ),
    )
    return rows.select(
        "batch", "school_id", F.col("e")["faculty"].alias("faculty"),
        F.col("e")["research"].alias("research"),
        scalar_or_list(F.col("e")["src"]).alias("src"),
        F.col("e")["_retrieved"].alias("retrieved"), "seq",
    )


def parse_catalog_columns(rows: DataFrame) -> DataFrame:
    """Relational catalog rows with JSON text columns to nested columns."""
    have = [c for c in schemas.CATALOG_COLUMNS if c in rows.columns]
    return rows.select(
        *[
            F.from_json(c, schemas.CATALOG_JSON_COLUMNS[c]).alias(c)
            if c in schemas.CATALOG_JSON_COLUMNS and dict(rows.dtypes)[c] == "string"
            else F.col(c)
            for c in have
        ]
    )


def read_catalog_table(spark: SparkSession, url: str, table: str = "universities", **options: str) -> DataFrame:
    """Catalog over JDBC with an explicit column list, so the projection is pushed to the source."""
    rows = spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
    return parse_catalog_columns(rows.select(*[c for c in schemas.CATALOG_COLUMNS if c in rows.columns]))


def catalog_or_seed(load: Callable[[], DataFrame], seed: DataFrame) -> tuple[DataFrame, bool]:
    """(catalog, from_seed). A failed or empty load falls back; the fallback is never cached."""
    try:
        catalog = load()
        if not catalog.isEmpty():
            return catalog, False
    except (PySparkException, Py4JError, OSError):  # the source is not there or cannot be read
        pass
    return seed, True
