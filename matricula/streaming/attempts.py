"""Keyed state of a stream of fetched pages: which URLs are settled, which have failed and how often.

The state of a URL is its status and its attempts. It lies in the state store of the stream's checkpoint, which is
partitioned by URL, so a batch touches the URLs it brings and reads nothing of earlier batches; a replayed batch
starts from the state before it and does the same again.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

DONE, FAILED, GIVEN_UP = "done", "failed", "given_up"
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


MARKS = ("tie__", "failed__")


def _earliest(row: Row) -> tuple:
    at = row["fetched_at"]
    return at is None, at, row["tie__"]


class Attempts(StatefulProcessor):
    """Passes the earliest row of a URL in a batch, unless the URL is settled, with its status and attempt."""

    def __init__(self, most: int | None) -> None:
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "status string, attempts int")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        status, attempts = self.seen.get() or (None, 0)
        if status in (DONE, GIVEN_UP):
            return
        first = min(rows, key=_earliest)
        attempts += 1
        failed = first["failed__"]
        status = (GIVEN_UP if self.most is not None and attempts >= self.most else FAILED) if failed else DONE
        self.seen.update((status, attempts))
        kept = {name: value for name, value in first.asDict().items() if name not in MARKS}
        yield Row(**kept, status=status, attempt=attempts)

    def close(self) -> None:
        pass


def admitted(pages: DataFrame, failed, key: str = "profile_url", most: int | None = None) -> DataFrame:
    """The rows of a stream that are to be worked on, with `status` and `attempt`.

    A URL is settled by its first row for which the Boolean column `failed` is not true; until then each batch that
    brings it counts as an attempt, at most `most` in all if given. No URL is ever forgotten: state that expires by
    the clock would keep a stream that runs over what is there from ending."""
    shape = T.StructType([*pages.schema.fields, T.StructField("status", T.StringType()), T.StructField("attempt", T.IntegerType())])
    marked = pages.withColumns({"tie__": F.xxhash64("html"), "failed__": F.coalesce(failed, F.lit(False))})
    return marked.groupBy(key).transformWithState(
        Attempts(most), outputStructType=shape, outputMode="Append", timeMode="None")


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Queries started inside keep their state in RocksDB; a query takes the setting over when it starts."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_STORE)
        else:
            spark.conf.set(_STORE, before)
