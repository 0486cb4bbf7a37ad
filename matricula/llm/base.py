"""What the operators share: their query registry, table reads, and files in the shared folder."""

from __future__ import annotations

import os
from collections.abc import Callable
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matricula.session import scratch_path, through_table  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def register(name: str, oracle: str | None = None):
    """Register `fn(spark, sf_dir)` as a query, with its DuckDB SQL where SQL can express it."""

    def keep(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, ASCII_UPPER, ASCII_UPPER.lower())


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; a null id is in fold 0 (never learned from)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder, as a URI, for files that tasks write and read themselves."""
    path = scratch_path(spark, name)
    if urlparse(path).scheme in ("", "file"):
        os.makedirs(local_path(path), exist_ok=True)
    return path


def local_path(uri: str) -> str | None:
    """The mounted path of a `file:` URI or plain path; None for a store that is not mounted."""
    parsed = urlparse(uri)
    if parsed.scheme == "":
        return uri
    return unquote(parsed.path) if parsed.scheme == "file" else None


def _store(uri: str):
    from pyarrow import fs

    path = local_path(uri)
    return (fs.LocalFileSystem(), path) if path is not None else fs.FileSystem.from_uri(uri)


def write_file(uri: str, attempt: int, chunks) -> None:
    """Write the chunks under a name of this attempt, then move them into place: a lost or
    repeated task leaves either nothing or the whole file."""
    store, path = _store(uri)
    part = f"{path}.{attempt}.tmp"
    with store.open_output_stream(part, compression=None) as out:
        for chunk in chunks:
            out.write(chunk)
    store.move(part, path)


def read_stream(uri: str):
    store, path = _store(uri)
    return store.open_input_stream(path, compression=None)


def read_random(uri: str):
    store, path = _store(uri)
    return store.open_input_file(path)


def bound_batches(spark: SparkSession, limit: int = 16 << 20) -> None:
    """Rows go to Python workers in batches of at most `limit` bytes, however long the texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(limit))


def give_back() -> None:
    """Hand freed memory of this Python worker back to the system, so that reused workers do not keep their highest use."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
