"""WARC archives with damage, and token files beyond one file a shard."""

import hashlib
import io
import random
import time

import numpy as np
import pyarrow.fs as pafs
from loomline.llm import queries as Q
from loomline.llm import token_records, warc


def _pages(spark, n=40):
    rows = [(k, f"http://h/{k}", ("p%d " % (k // 3)) * 200 if k % 5 else None) for k in range(n)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_damaged_archives_are_salvaged_and_gaps_logged(spark):
    """A flipped byte in every archive: all other records are read, and the log holds each gap."""
    manifest = warc.write_archives(warc.with_references(_pages(spark)), warc.new_path(spark, "t")).collect()
    lost = 0
    for row in manifest:
        files, name = pafs.FileSystem.from_uri(row["path"])
        with files.open_input_stream(name) as source:
            data = bytearray(source.read())
        data[len(data) // 2] ^= 0xFF
        with files.open_output_stream(name) as sink:
            sink.write(bytes(data))
        lost += 1
    read = warc.read_archives(spark, spark.createDataFrame(manifest))
    log = warc.gap_log(read).collect()
    assert sum(r["records"] for r in manifest) - lost == read.where("gap_end IS NULL").count()
    assert {r["path"] for r in log} == {r["path"] for r in manifest} and all(r["gap_end"] > r["offset"] and r["gap_reason"] for r in log)


def test_round_trip_never_loses_a_page_in_silence(spark, monkeypatch):
    """A record longer than the reader takes is a gap, and a gap fails the query."""
    page = "".join(hashlib.sha256(bytes([k % 256, k // 256])).hexdigest() for k in range(50_000))
    pages = spark.createDataFrame([(1, "u", "short"), (2, "u", page)], "page_id long, url string, html string")
    assert warc.round_trip(pages).count() == 2
    data = warc.member(warc.record("response", "urn:page:2", "u", page.encode(), "x"))
    assert [type(x).__name__ for x in warc.salvage(io.BytesIO(data))] == ["Record"]
    monkeypatch.setattr(warc, "MOST_RECORD_BYTES", 1 << 20)
    assert [type(x).__name__ for x in warc.salvage(io.BytesIO(data))] == ["Gap"]


def test_pages_over_many_blocks_and_clashing_columns(spark):
    pages = _pages(spark).selectExpr("*", "1 AS digest", "2 AS refers_to", "3 AS payload")
    got = {r["page_id"]: r for r in warc.round_trip(pages.repartition(5)).collect()}
    first = {}
    for r in _pages(spark).collect():
        data = (r["html"] or "").encode()
        first.setdefault(data, r["page_id"])
        want = ("response", None) if len(data) < 100 or first[data] == r["page_id"] else ("revisit", first[data])
        assert (got[r["page_id"]]["record_type"], got[r["page_id"]]["refers_to"]) == want
        assert got[r["page_id"]]["payload_digest"] == hashlib.sha256(data).hexdigest() and got[r["page_id"]]["payload_bytes"] == len(data)


def test_token_files_roll(spark, sf, monkeypatch):
    """Many shards of many small files give the rows of one file a shard, in order."""
    word = Q.tokenizer_file("word_bpe_49k.json")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    fields = ["doc_id", "n_tokens", "ids_crc32"]
    plain = token_records.token_records(docs, word).orderBy("start").collect()
    assert [r["start"] for r in plain] == np.cumsum([0, *[r["n_tokens"] for r in plain]])[:-1].tolist() and len(plain) == docs.count()
    monkeypatch.setattr(token_records, "SHARD_BYTES", 50_000)
    manifest = token_records.write_records(docs, token_records.new_path(spark, "t"), word, file_bytes=3000)
    assert manifest.select("shard").distinct().count() > 4 and manifest.where("part > 2").count()
    rolled = token_records.read_records(spark, manifest).orderBy("shard", "part", "seq").select(*fields).collect()
    assert [tuple(r) for r in rolled] == [tuple(r[k] for k in fields) for r in plain]


def test_sql_on_odd_pages(spark, equal):
    """Null and short payloads, ties of the smallest id, null ids, repeated rows and letters of several bytes."""
    import duckdb

    long, wide = "<p>" + "word " * 40, "é" * 50
    rows = [(1, None), (2, ""), (3, "x" * 99), (4, "x" * 99), (9, long), (5, long), (5, long), (None, long), (6, wide), (7, wide), (None, "y" * 100), (None, "y" * 100)]
    pages = spark.createDataFrame([(i, "http://a.com/", h) for i, h in rows], "page_id long, url string, html string")
    c = duckdb.connect()
    c.execute("CREATE TABLE pages (page_id BIGINT, html VARCHAR)")
    c.executemany("INSERT INTO pages VALUES (?, ?)", rows)
    equal(warc.round_trip(pages), c.sql(warc.ORACLE))


def test_time_of_long_records_is_in_proportion():
    """A record four times as long takes about four times as long to read, compressed or not; a copy of all that is held for every block would take sixteen times."""
    rng = random.Random(1)
    block = rng.randbytes(1 << 20)
    for wrap in (lambda x: x, lambda x: warc.member(x, 0)):
        took = []
        for mb in (32, 128):
            data = wrap(warc.record("response", "urn:page:1", "u", block * mb, "x"))
            began = time.perf_counter()
            (found,) = warc.salvage(io.BytesIO(data))
            took.append(time.perf_counter() - began)
            assert isinstance(found, warc.Record) and len(found.block) > mb << 20
        assert took[1] < 9 * took[0] + 0.2


def test_many_small_records_between_long_damage():
    """Small records in plain and packed form around megabytes of noise: all are found, and each stretch of noise is a gap."""
    rng = random.Random(2)
    for packed in (True, False):
        parts, ids = [], []
        for k in range(600):
            if k % 200 == 100:
                parts.append(b"\r\n\r\n".join(rng.randbytes(700_000).replace(b"\x1f\x8b", b"..") for _ in range(3)))
            data = warc.record("response", f"urn:page:{k}", "u" * (k % 40), b"WARC/1.0\r\n" * (k % 5) + rng.randbytes(k), "x")
            parts.append(warc.member(data) if packed else data)
            ids.append(k)
        found = list(warc.salvage(io.BytesIO(b"".join(parts))))
        assert [int(x.headers["warc-record-id"].split(":")[-1].strip(">")) for x in found if isinstance(x, warc.Record)] == ids
        assert sum(isinstance(x, warc.Gap) for x in found) == 3


def test_archives_roll(spark):
    pages = _pages(spark, 400)
    manifest = warc.write_archives(warc.with_references(pages), warc.new_path(spark, "roll"), archive_bytes=3000)
    rows = manifest.collect()
    assert len(rows) > 8 and sum(r["records"] for r in rows) == 400 and all(r["bytes"] < 3000 + 2000 for r in rows)
    assert warc.read_archives(spark, manifest).where("gap_end IS NULL").count() == 400
