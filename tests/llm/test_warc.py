import gzip
import hashlib
import os
import zlib

import pytest
from pyspark.sql import functions as F

from matricula.llm import warc
from matricula.llm.base import local_path, shared_folder

BIG = "x" * 1200


def pages(spark):
    rows = [(1, "http://a/ é\n", BIG), (7, "http://b", BIG), (7, None, BIG), (3, None, "short"), (4, "u", "short"),
            (5, "v", None), (6, "w", ""), (None, "n", BIG), (8, "y", "É" * 499), (9, "z", "É" * 499), (10, "z", "é" * 500), (11, "z", "é" * 500),
            (12, "r", "a\r\n\r\nb" * 90000), (None, "q", "WARC/1.1\r\n\r\n" * 100), (None, "q", "WARC/1.1\r\n\r\n" * 100)]
    return spark.createDataFrame(rows, "page_id long, url string, html string"), rows


def expected(rows):
    out = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == data and p is not None]
        keeper = max(same) if same and len(data) >= 1000 else page_id
        refers = keeper if keeper != page_id else None
        out.append((page_id, len(data), hashlib.sha1(data).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=repr)


@pytest.mark.parametrize("size", [500, 1 << 28])
def test_round_trip(spark, size):
    df, rows = pages(spark)
    whole, single = shared_folder(spark, "whole"), shared_folder(spark, "single")
    archives = warc.write_archives(warc.decide(df.withColumn("digest", F.lit(1))), whole, size)
    assert warc.normalise(archives, single).count() == len([f for f in os.listdir(local_path(single)) if f.endswith(".gz")])
    got = warc.read_archives(spark, single)
    keys = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted((tuple(r[k] for k in keys) for r in got.collect()), key=repr) == expected(rows)
    payloads = {r.page_id: r.payload for r in got.collect() if r.payload is not None and r.page_id}
    assert payloads[12].decode() == rows[12][2] and payloads[5] == b""
    for name in os.listdir(local_path(whole)):  # the same bytes before and after
        a = gzip.decompress(open(f"{local_path(whole)}/{name}", "rb").read())
        with open(f"{local_path(single)}/{name}", "rb") as f:
            data = f.read()
        assert gzip.decompress(data) == a
        lines = [line.split("\t") for line in open(f"{local_path(single)}/{name}.idx").read().splitlines()]
        members = [zlib.decompress(data[int(o):int(o) + int(n)], 31) for o, n, *_ in lines]
        assert b"".join(members) == a and all(m.startswith(b"WARC/1.1\r\n") for m in members)


def test_damage_is_noticed(tmp_path):
    data = gzip.compress(warc.record(1, "u", b"abc", "0", 3, None))
    (tmp_path / "cut.gz").write_bytes(data[:-12])
    with pytest.raises(EOFError):
        list(warc.records(warc.inflated(str(tmp_path / "cut.gz"))))
    (tmp_path / "many.gz").write_bytes(data * 3)
    assert len(list(warc.records(warc.inflated(str(tmp_path / "many.gz"))))) == 3


def test_empty_table(spark):
    df, _ = pages(spark)
    assert warc.write_archives(warc.decide(df.limit(0)), shared_folder(spark, "none")).count() == 0
