import base64
import gzip
import hashlib

import pytest

from quirework.llm import warc as W
from quirework.llm.shared import new_folder


def brute(pages, least=0):
    first = {}
    for page, url, html in pages:
        key = (page is None, page or 0, url or "")
        data = (html or "").encode()
        if len(data) >= least and (data not in first or key < first[data]):
            first[data] = key
    out, taken = [], set()
    for page, url, html in pages:
        data = (html or "").encode()
        again = data in first and (first[data] != (page is None, page or 0, url or "") or data in taken)
        if data in first and not again:
            taken.add(data)
        ref = None if not again or first[data][0] else first[data][1]
        out.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", ref))
    return sorted(out, key=str)


PAGES = [(k, f"http://x/{k}\r\nX: 1", h) for k, h in enumerate(["<p>é</p>", "same", "", None, "same", "x" * 300_000, "\r\n\r\n", "same", "\0\x1f\x8b"])] + [(None, None, "same"), (3, "again", None), (8, None, "other"), (1, "http://x/1\r\nX: 1", "same")]


@pytest.mark.parametrize("least, broadcast, share", [(0, 100, 10_000), (5, 100, 10_000), (0, 0, 10_000), (0, 0, 3), (0, 0, 1)])
def test_round_trip(spark, monkeypatch, least, broadcast, share):
    monkeypatch.setattr(W, "LARGEST_BROADCAST", broadcast)
    monkeypatch.setattr(W, "MOST_SHARED", share)
    pages = spark.createDataFrame([(*p, 1) for p in PAGES], "page_id long, url string, html string, sha int").repartition(3)
    got = sorted((tuple(r) for r in W.round_trip(pages, least).collect()), key=str)
    assert got == brute(PAGES, least)
    assert W.round_trip(pages.limit(0)).count() == 0
    folder = new_folder(spark, "w")
    assert W.write(pages, folder, archive_bytes=1000) > 2
    rows = W.read(spark, folder, with_payload=True).collect()
    assert len(rows) == len(PAGES)
    assert sorted(bytes(r.payload) for r in rows if r.record_type == "response") == sorted({(h or "").encode() for _, _, h in PAGES})


def test_rows_are_those_of_the_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    mine = [p for p in PAGES if "\0" not in (p[2] or "")]
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", mine)
    got = W.round_trip(spark.createDataFrame(mine, "page_id long, url string, html string")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, con.execute(W.ORACLE).fetchall()))


def test_members_and_damage():
    one, two = (W.record(k, "u", b"p" * 200_000, W.base32_sha1(b"p" * 200_000)) for k in (1, 2))
    assert [f["x-page-id"] for f, _, _ in W.records(one + two)] == ["1", "2"]
    assert gzip.decompress(one).startswith(b"WARC/1.1\r\n")
    plain = gzip.decompress(one)
    for bad in (plain.replace(b"pppp", b"pppq", 1), plain[:-2], plain.replace(b"Content-Length: 2", b"Content-Length: 3"), b"HTTP" + plain):
        with pytest.raises(W.Broken):
            list(W.records(gzip.compress(bad)))
    with pytest.raises(W.Broken):
        list(W.records(one + two[:-20]))
