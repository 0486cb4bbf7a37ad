"""WARC archives: writing, normalising whole-file gzip streams, and reading through an offset index.

`write_archives` deduplicates payloads (a revisit record points at the response of the same payload)
and writes each partition as archives compressed as one whole-file gzip stream. `normalise` inflates
such a stream once, without holding it, rewrites every record as a gzip member of its own, and writes a
sidecar index (offset, length, type, record id) beside the archive. `read_archives` then reads any
record by its offset, in parallel within a file.

Files are written by tasks into the shared folder under the name of their attempt and moved into place,
so lost or repeated tasks leave whole files only. A record is held in memory, never a file.

Defined results: a null payload is empty, a null url is left out, a null page id is an empty field.
Of equal payloads of at least `min_bytes` bytes the row with the largest page id is the response; rows
that repeat it with the same id are responses too, and null ids count as smallest. An empty table writes no archive.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matricula.llm.base import (bound_batches, read_random, read_stream, register, shared_folder, table, through_table,
                                write_file)

MIN_BYTES = 1000
ARCHIVE_BYTES = 256 << 20  # payload bytes after which a task begins another archive
CHUNK = 1 << 20
SPLIT_BYTES = 32 << 20  # of an archive that one task reads
SALTS = 64
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def decide(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, payload, digest, bytes, refers_to (null for responses)."""
    payload = F.coalesce(F.col("html").cast("string").cast("binary"), F.lit(b""))
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumns(
        {"digest": F.sha1("payload"), "bytes": F.octet_length("payload").cast("long")})
    large = rows.filter(F.col("bytes") >= min_bytes)
    # only payloads that occur again matter; their rows are salted, for one may hold a third of all pages
    again = large.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("keeper")).filter("n > 1")
    again = again.select("digest", "keeper", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salt = F.when(F.col("bytes") >= min_bytes, F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    return (
        rows.withColumn("salt", salt).join(again, ["digest", "salt"], "left")
        .select("page_id", "url", "payload", "digest", "bytes",
                F.when(~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper")).alias("refers_to"))
    )


def record(page_id, url, payload: bytes, digest: str, size: int, refers_to) -> bytes:
    """One record, uncompressed. A revisit carries the headers of the exchange but no payload."""
    name = "" if page_id is None else str(page_id)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{name}>",
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {size}",
        f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}",
    ]
    if url is not None:
        head.insert(3, f"WARC-Target-URI: {quote(url, safe=URL_SAFE)}")
    if refers_to is not None:
        head[-1:-1] = [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


URL_SAFE = "".join(chr(c) for c in range(0x21, 0x7F))


def _gzip() -> zlib._Compress:
    return zlib.compressobj(6, zlib.DEFLATED, 31)


def _strings(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows],
                                      schema=pa.schema([(n, pa.string()) for n in names]))


def write_archives(decided: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write whole-file gzip archives; one row (archive) for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        ahead, n = next(rows, None), 0
        while ahead is not None:
            def archive() -> Iterator[bytes]:
                nonlocal ahead
                packer, size = _gzip(), 0
                while ahead is not None and size < archive_bytes:
                    size += len(ahead[2])
                    yield packer.compress(record(*ahead))
                    ahead = next(rows, None)
                yield packer.flush()

            uri = f"{folder}/{task.partitionId():06d}-{n:04d}.warc.gz"
            write_file(uri, task.taskAttemptId(), archive())
            n += 1
            yield _strings([(uri,)], ["archive"])

    bound_batches(decided.sparkSession)
    columns = ["page_id", "url", "payload", "digest", "bytes", "refers_to"]
    return decided.select(*columns).mapInArrow(run, "archive string")


def inflated(uri: str) -> Iterator[bytes]:
    """The bytes of a gzip file of one or many members."""
    with read_stream(uri) as stream:
        member, started = zlib.decompressobj(31), False
        while chunk := stream.read(CHUNK):
            while chunk:
                piece = member.decompress(chunk, CHUNK)
                started = True
                if piece:
                    yield piece
                if member.eof:
                    chunk, member, started = member.unused_data, zlib.decompressobj(31), False
                else:
                    chunk = member.unconsumed_tail
        if started:
            raise EOFError(f"{uri} ends inside a gzip member")


def fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:60]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


def records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, whole record with its closing lines) of an inflated archive."""
    held = bytearray()

    def more(size: int) -> bool:
        while len(held) < size:
            chunk = next(chunks, None)
            if chunk is None:
                return False
            held.extend(chunk)
        return True

    while more(1):
        looked = 0
        while (end := held.find(b"\r\n\r\n", looked)) < 0:
            looked = max(0, len(held) - 3)
            if not more(len(held) + 1):
                raise EOFError("an archive ends inside a record's head")
        head = fields(bytes(held[:end]))
        size = end + 4 + int(head["content-length"]) + 4
        if not more(size):
            raise EOFError("an archive ends inside a record")
        yield head, bytes(held[:size])
        del held[:size]


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite each archive with one gzip member a record and a sidecar `.idx`; one row (sidecar) for each.

    A sidecar line is: offset, length, record type, record id, separated by tabs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            for (source,) in zip(batch.column(0).to_pylist()):
                name = f"{folder}/{source.rsplit('/', 1)[1]}"
                index: list[str] = []

                def members() -> Iterator[bytes]:
                    offset = 0
                    for head, whole in records(inflated(source)):
                        packer = _gzip()
                        member = packer.compress(whole) + packer.flush()
                        index.append(f"{offset}\t{len(member)}\t{head['warc-type']}\t{head['warc-record-id']}\n")
                        offset += len(member)
                        yield member

                write_file(name, attempt, members())
                write_file(f"{name}.idx", attempt, (line.encode() for line in index))
                yield _strings([(f"{name}.idx",)], ["sidecar"])

    # a task an archive: with a number, adaptive execution leaves the small rows that name them apart
    return archives.select("archive").repartition(max(1, archives.count())).mapInArrow(run, "sidecar string")


def _page(name: str | None) -> int | None:
    found = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(found) if found else None


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Every record that the sidecars of `folder` list, read by its offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, file = None, None
        for batch in batches:
            rows = []
            for archive, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if archive != at:
                    if file is not None:
                        file.close()
                    at, file = archive, read_random(archive)
                file.seek(offset)
                head, whole = next(records(iter([zlib.decompress(file.read(length), 31)])))
                payload = whole.split(b"\r\n\r\n", 2)[2][:-4] if head["warc-type"] == "response" else None
                digest, size = head["warc-payload-digest"].removeprefix("sha1:"), int(head["x-payload-length"])
                if payload is not None and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                    raise ValueError(f"damaged record at {offset} of {archive}")
                rows.append((_page(head["warc-record-id"]), head.get("warc-target-uri"), size, digest,
                             head["warc-type"], _page(head.get("warc-refers-to")), payload))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                        ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
    bound_batches(spark)
    lines = (
        spark.read.schema("offset long, length long, type string, record string").option("sep", "\t").option("quote", "").csv(f"{folder}/*.idx")
        .select(F.regexp_replace("_metadata.file_path", r"\.idx$", "").alias("archive"), "offset", "length")
    )
    lines = lines.withColumn("split", F.floor(F.col("offset") / SPLIT_BYTES))
    splits = lines.groupBy("archive").agg(F.max("split").alias("last")).agg(F.sum(F.col("last") + 1)).first()[0] or 1
    return (
        lines.repartition(int(splits), "archive", "split").drop("split").sortWithinPartitions("archive", "offset")
        .mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")
    )


@register("op6_warc", """with p as (select page_id, encode(coalesce(html, '')) payload from pages),
    d as (select page_id, octet_length(payload)::bigint payload_bytes, sha1(payload) payload_digest from p),
    k as (select *, case when payload_bytes >= 1000 then max(page_id) over (partition by payload_digest) end keeper from d)
    select page_id, payload_bytes, payload_digest, case when keeper <> page_id then 'revisit' else 'response' end record_type,
      case when keeper <> page_id then keeper end refers_to from k""")
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    whole, single = shared_folder(spark, "warc-whole"), shared_folder(spark, "warc")
    archives = through_table(write_archives(decide(pages), whole), "archives")
    if through_table(normalise(archives, single), "sidecars").isEmpty():
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    return read_archives(spark, single).drop("payload", "url")
