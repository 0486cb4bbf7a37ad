"""Writers: catalog snapshots, recommendation log, faculty CSVs, tier files."""

from __future__ import annotations

import os
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matricula.operators import catalog as C
from matricula.operators import faculty as Y
from matricula.operators.enrichment import compact_tier


def write_ordered_json(df: DataFrame, path: str, key: str, single_file: bool = False) -> None:
    """JSON lines ordered by a key: same rows, same bytes.

    The sort is range-partitioned, so part files are in order too.
    `single_file` is for small published exports only.
    """
    # one file: rows move to one task that sorts and writes, and what they come from stays in many
    ordered = df.repartition(1).sortWithinPartitions(key) if single_file else df.orderBy(key)
    ordered.write.mode("overwrite").json(path)


def list_catalog(catalog: DataFrame) -> DataFrame:
    return catalog.orderBy("id")


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, root: str) -> list[int]:
    pattern, fs = _path(spark, f"{root}/_manifests/v*")
    return sorted(int(f.getPath().getName()[1:]) for f in fs.globStatus(pattern) or [])


def _commit(spark: SparkSession, root: str, version: int, folder: str) -> bool:
    """Create the manifest of a version, which names its folder; False if another publisher has."""
    target = f"{root}/_manifests/v{version:08d}"
    (made, fs), (final, _) = _path(spark, f"{root}/_manifests/.{folder}"), _path(spark, target)
    out = fs.create(made, True)
    out.write(folder.encode())
    out.close()
    local = urlparse(final.toUri().toString())
    if fs.getScheme() == "file":  # a rename would replace a file that is there; a link does not
        try:
            os.link(made.toUri().getPath(), unquote(local.path))
        except FileExistsError:
            return False
        finally:
            fs.delete(made, False)
        return True
    if fs.rename(made, final):
        return True
    fs.delete(made, False)
    return False


def read_snapshot(spark: SparkSession, root: str, version: int | None = None) -> DataFrame | None:
    """The latest committed snapshot, or that of a version. What no manifest names, such as a half-written folder, is ignored."""
    versions = _versions(spark, root)
    if not versions:
        return None
    at = versions[-1] if version is None else version
    folder = spark.read.text(f"{root}/_manifests/v{at:08d}").first()[0]
    return spark.read.parquet(f"{root}/{folder}")


def publish_snapshot(catalog: DataFrame, root: str, prune: bool = True, tries: int = 10) -> int:
    """Write the next snapshot: upsert by id, rows gone from the catalog pruned.

    Pruning refuses a catalog that looks too small to trust. A publisher writes a folder of its own and commits it as
    the version after the one it read, by a manifest that only one can create. Who comes second merges again with
    the version that came between, so no snapshot is lost or overwritten, and a failed write changes nothing.
    """
    spark = catalog.sparkSession
    for _ in range(tries):
        versions = _versions(spark, root)
        last = versions[-1] if versions else 0
        current = read_snapshot(spark, root, last) if last else None
        rows = catalog if current is None else C.upsert(current, catalog, prune)
        folder = f"data-{uuid.uuid4().hex}"
        rows.write.parquet(f"{root}/{folder}")
        if _commit(spark, root, last + 1, folder):
            return last + 1
        data, fs = _path(spark, f"{root}/{folder}")
        fs.delete(data, True)
    raise RuntimeError(f"{root}: another publisher came first {tries} times")


def append_recommendations(results: DataFrame, runs: DataFrame, path: str) -> None:
    """One row per profile with its results nested, appended by date.

    results(profile_id, position, id, name, score, rationale, admit_tier);
    runs(profile_id, confidence, stop_reason). A profile has at most top_k results.
    """
    nested = results.groupBy("profile_id").agg(
        F.array_sort(
            F.collect_list(F.struct("position", "id", "name", "score", "rationale", "admit_tier"))
        ).alias("results")
    )
    empty = F.array().cast(nested.schema["results"].dataType)
    now = F.current_timestamp()
    (
        runs.join(nested, "profile_id", "left")
        .withColumn("results", F.coalesce("results", empty))
        .withColumn("created_at", now)
        .withColumn("created_date", F.to_date(now))
        .write.mode("append")
        .partitionBy("created_date")
        .parquet(path)
    )


_CSV = {"header": "true", "nullValue": "", "emptyValue": "", "escape": '"'}


def write_faculty_csv(professors: DataFrame, out: str, **gates: float) -> None:
    """Per-school CSV folders and the master CSV, both from the same rows.

    Rows are range-partitioned by (slug, name), so a school with very many rows
    spans several part files instead of one task.
    """
    rows = Y.export_rows(professors, **gates)
    slugs = Y.output_slugs(rows.select("school_id"))
    by_school = rows.join(slugs, "school_id").select(*rows.columns, "slug")
    (
        by_school.repartitionByRange("slug", "professor_name")
        .sortWithinPartitions("slug", "professor_name")
        .write.mode("overwrite")
        .options(**_CSV)
        .partitionBy("slug")
        .csv(f"{out}/by_school")
    )
    rows.orderBy("school_id", "professor_name").write.mode("overwrite").options(**_CSV).csv(f"{out}/master")


def write_coverage_csv(coverage: DataFrame, out: str) -> None:
    """One row per school, one file."""
    coverage.repartition(1).sortWithinPartitions("school_id").write.mode("overwrite").options(**_CSV).csv(out)


def write_tier(log: DataFrame, path: str, key: str = "school_id", seq: str = "seq") -> None:
    """Fold an append-only log to one record per key and publish it in key order."""
    write_ordered_json(compact_tier(log, key, seq), path, key)
