"""Incremental, exactly-once stages over growing folders of records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from matricula import schemas
from matricula.operators import faculty as Y
from matricula.operators import ranking
from matricula.session import cut_lineage
from matricula.streaming.attempts import FAILED, admitted, rocksdb_state


def _write_batch(df: DataFrame, folder: str, batch: str) -> None:
    """One folder per batch: a replayed batch replaces itself, so output stays exactly-once."""
    df.write.mode("overwrite").parquet(f"{folder}/batch={batch}")


def _write_outcomes(rows: DataFrame, out: str, batch: str) -> None:
    rows = rows.persist()  # two writes from one evaluation of the batch
    try:
        _write_batch(rows.filter(F.col("outcome") == "extracted").drop("status", "attempt"), f"{out}/rows", batch)
        ledger = rows.select("profile_url", "status", "outcome", "attempt", F.current_timestamp().alias("updated_at"))
        _write_batch(ledger, f"{out}/ledger", batch)
    finally:
        rows.unpersist()


def extract_stream(
    spark: SparkSession, pages: str, out: str, checkpoint: str, max_files: int | None = None,
    max_attempts: int | None = None,
) -> StreamingQuery:
    """Append-only pages in, clean rows and a ledger out, each profile URL once.

    Runs over everything available and stops. Keyed state (see `attempts`) holds the status of every URL: a settled one
    is passed over, a failed one (fetched, but its text is missing) is worked on again when it comes again. No batch reads the
    ledger, which is a log for readers. A replayed batch replaces its own folders.
    """
    reader = spark.readStream.schema(schemas.RAW_PAGE)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    unread = (F.col("http_status") == 200) & F.col("html").isNull()
    stream = admitted(reader.json(pages), unread, "profile_url", max_attempts)

    def each(batch: DataFrame, batch_id: int) -> None:
        _write_outcomes(Y.extract_deterministic(batch), out, str(batch_id))

    with rocksdb_state(spark):
        return (
            stream.writeStream.foreachBatch(each)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )


def read_rows(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(f"{out}/rows").drop("batch")


def read_ledger(spark: SparkSession, out: str) -> DataFrame:
    """Latest status and number of attempts per URL."""
    log = spark.read.parquet(f"{out}/ledger")
    return log.groupBy("profile_url").agg(
        F.max_by("status", "attempt").alias("status"), F.max("attempt").cast("bigint").alias("attempts")
    )


def retry_failed(spark: SparkSession, fresh: DataFrame, pages: str, out: str, checkpoint: str, attempt: str, **settings) -> bool:
    """Put fresh fetches of failed URLs into the folder `pages` of the stream and run it; False when there are none.

    `settings` are those of the stream. The same attempt twice replaces its own input, which the stream reads once."""
    failed = read_ledger(spark, out).filter(F.col("status") == FAILED).select("profile_url")
    todo = fresh.join(failed, "profile_url", "left_semi").select(*(f.name for f in T.StructType.fromDDL(schemas.RAW_PAGE)))
    if todo.isEmpty():
        return False
    todo.write.mode("overwrite").json(f"{pages}/retry-{attempt}")
    extract_stream(spark, f"{pages}/*", out, checkpoint, **settings).awaitTermination()
    return True


def rank_stream(
    requests: DataFrame, catalog: DataFrame, out: str, checkpoint: str, k: int = 5, activities: DataFrame | None = None
) -> StreamingQuery:
    """Streamed profile requests against the static catalog, top-k per request appended.

    activities(profile_id, text) are matched with their patterns once, before the stream starts."""

    packed = ranking.pack_catalog(catalog)
    masks = None if activities is None else cut_lineage(ranking.activity_masks(activities))

    def each(batch: DataFrame, batch_id: int) -> None:
        if masks is not None:
            batch = batch.join(masks, "profile_id", "left")
        _write_batch(ranking.rank_top_k(batch, catalog, k, packed=packed), out, str(batch_id))

    return (
        requests.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


