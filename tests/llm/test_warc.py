import random

import duckdb
import pyarrow as pa
import pytest

from palaver.llm import warc as W


def pages(seed=1, n=150):
    rng = random.Random(seed)
    bodies = ["<p>é🙂\r\n\r\nWARC/1.1\n\nfiledesc://x " + "y" * 1100, "short", "", None, "<html>" + "z" * 994, "q" * 999]
    rows = [(i, f"http://h.example/{i} a", rng.choice([*bodies, f"own {i} " * 300])) for i in range(n)]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


@pytest.mark.parametrize("file_bytes, revisits", [(5_000, 10**6), (5_000, 0), (2**25, 10**6)])
def test_equals_sql(spark, file_bytes, revisits):
    rows = pages()
    got = W.through_archives(frame(spark, rows).repartition(3), file_bytes, revisits).drop("target_uri", "date")
    con = duckdb.connect()
    con.sql("create table pages (page_id bigint, url varchar, html varchar)")
    con.executemany("insert into pages values (?, ?, ?)", rows)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(con.sql(W.SQL).fetchall(), key=repr)
    assert {r.record_type for r in got.collect()} == {"response", "revisit"}


def test_nulls_repeats_and_empty(spark):
    long = "x" * 2000
    got = W.through_archives(frame(spark, [(None, None, long), (5, "", long), (5, "", long), (None, "u", None)]).selectExpr("*", "1 path", "'v' value")).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got), key=repr) == sorted([(None, 2000, "revisit", 5), (5, 2000, "revisit", 5), (5, 2000, "response", None), (None, 0, "response", None)], key=repr)
    assert W.through_archives(frame(spark, [])).count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_arc_of_either_version(version):
    docs = [b"HTTP/1.1 200 OK\r\nX-Page-Id: 3\r\n\r\na\n\nb", b""]
    data = W.arc_version_block(version, "n.arc") + b"\n" + W.arc_record(version, "n.arc", 7, "http://a/b c", b"one\n\ntwo") + b"\n" + W.arc_record(version, "n.arc", None, None, b"") + b"\n"
    (n0, f0, d0), (n1, f1, d1) = W.parse_arc(data)
    assert (n0, n1) == (0, 1) and f0["URL"] == "http://a/b%20c" and len(f0) == (5 if version == 1 else 10)
    assert W.http_parts(d0)[1] == b"one\n\ntwo" and W.page_of(W.http_parts(d0)[0]) == 7 and W.page_of(W.http_parts(d1)[0]) is None
    assert W.http_parts(docs[1]) == (b"", b"")
    # A url with spaces, as old writers left it, and a header that names no fields.
    raw = b"filedesc://x 0.0.0.0 20000101000000 text/plain 8\n1 0 org\n\nhttp://a/b c d 1.2.3.4 19990102030405 image/gif 3\n\xff\x00\n\n"
    [(_, f, d)] = W.parse_arc(raw)
    assert (f["URL"], f["Archive-date"], d) == ("http://a/b c d", "19990102030405", b"\xff\x00\n")
    [(g, block)] = W.parse_warc(W.warc_record(f, d, W.record_id(None, "x#0"), None) + b"\r\n\r\n")
    assert g["WARC-Date"] == "1999-01-02T03:04:05Z" and g["Content-Type"] == "image/gif" and block == d
    with pytest.raises(ValueError):
        list(W.parse_arc(raw[:-4]))


def test_pages_of_several_megabytes_leave_in_small_batches(spark, monkeypatch):
    monkeypatch.setattr(W, "HELD_BYTES", 2**20)
    rows = [(i, f"http://h/{i}", ("é%d " % (i % 3)) * 800_000) for i in range(9)] + [(9, "http://h/9", "x")]
    got = W.through_archives(frame(spark, rows).repartition(2), 2**22).collect()
    assert {r.page_id: r.payload_bytes for r in got} == {i: len((t or "").encode()) for i, _, t in rows}
    assert sorted(r.page_id for r in got if r.record_type == "response") == [6, 7, 8, 9]
    held = [b.num_rows for b in W._batched(((k, k, b"x" * 2**19) for k in range(9)), pa.schema([("a", pa.int64()), ("b", pa.int64()), ("c", pa.binary())]), lambda r: len(r[2]))]
    assert held == [2, 2, 2, 2, 1]
