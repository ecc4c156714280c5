"""WARC archives: writing web pages with revisit records for equal payloads, and a sequential reader.

Each record is a gzip member of its own. The reader takes an archive's bytes in order: zlib decompresses one
member incrementally (in steps, so that a huge record needs no more than itself), the header is read up to the
empty line, Content-Length frames the block, and the record's block digest and payload digest are verified.

Of records with equal payloads of at least ``least_bytes`` bytes, the one with the smallest page_id is the
``response``; the others are ``revisit`` records, which name it and keep the HTTP header but no payload. Equal
payloads are found by SHA-1 and length; only digests that occur twice or more are joined to the pages. While these
are few (LARGEST_BROADCAST, counted before) they are broadcast, and pages stay where they were read. Beyond that,
only digests with at least a MOST_SHARED-th of all pages are (so at most that many), and the others, none of which
is hot, are joined by a shuffle in which pages of hot digests are dealt by their ids.

Defined cases: a null html is an empty payload; null page_ids come last and are named by an empty id; of rows with
equal page_id and payload, the one of the smallest url is the first; of rows that are equal in all three one is the
response (any, as they don't differ), the others revisit it; an empty table gives no archive; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .shared import new_folder, prepare_workers, write_file, written

ARCHIVE_BYTES = 32 << 20
#: Digests of repeated payloads that are broadcast at most; a digest with this share of all pages is hot.
LARGEST_BROADCAST, MOST_SHARED = 200_000, 10_000
STEP = 1 << 16
REVISIT = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


# --- records --------------------------------------------------------------------------------------


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id) -> str:
    h = hashlib.sha1(f"page {'' if page_id is None else page_id}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-5{h[13:16]}-8{h[17:20]}-{h[20:32]}>"


def clean(value: str | None) -> str:
    """A header value: line breaks and other controls would break the framing."""
    return "".join(c for c in value or "" if c >= " " and c != "\x7f")


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to=None, revisit: bool = False, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """One WARC record as a gzip member."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {clean(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if revisit:
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-ID: {'' if refers_to is None else refers_to}"]
    else:
        block += payload
    lines += [f"WARC-Block-Digest: sha1:{base32_sha1(block)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


class Broken(ValueError):
    """The archive's bytes aren't what its headers say."""


def members(content):
    """The decompressed bytes of each gzip member, one after the other."""
    view = memoryview(content)
    at, n = 0, len(view)
    while at < n:
        engine, parts, tail = zlib.decompressobj(31), [], b""
        while not engine.eof:
            if not tail:
                if at >= n:
                    raise Broken("the archive ends within a record")
                tail = view[at : at + STEP]
                at += len(tail)
            parts.append(engine.decompress(tail, STEP))
            tail = engine.unconsumed_tail
        at -= len(engine.unused_data)
        yield b"".join(parts)


def headers(block: bytes) -> tuple[str, dict[str, str], int]:
    """(first line, fields by lower-cased name, where the content starts)."""
    end = block.find(b"\r\n\r\n")
    if end < 0:
        raise Broken("a header has no end")
    first, *lines = block[:end].decode("utf-8").split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}, end + 4


def records(content):
    """(WARC fields, HTTP fields, payload) of each record, verified."""
    for data in members(content):
        version, fields, start = headers(data)
        if not version.startswith("WARC/"):
            raise Broken(f"not a WARC record: {version[:20]!r}")
        length = int(fields["content-length"])
        block = data[start : start + length]
        if len(block) != length or data[start + length :] != b"\r\n\r\n":
            raise Broken("a record's length differs from its Content-Length")
        if (want := fields.get("warc-block-digest")) and want != f"sha1:{base32_sha1(block)}":
            raise Broken("a block's digest differs")
        _, http, body = headers(block)
        payload = block[body:]
        if fields["warc-type"] == "response":
            if want := fields.get("warc-payload-digest"):
                if want != f"sha1:{base32_sha1(payload)}":
                    raise Broken("a payload's digest differs")
            if int(http.get("content-length", len(payload))) != len(payload):
                raise Broken("a payload's length differs from its HTTP Content-Length")
        yield fields, http, payload


# --- archives -------------------------------------------------------------------------------------


def write(pages: DataFrame, folder: str, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> int:
    """Writes pages as archives folder/part-NNNNN-NNNN.warc.gz; returns their number. An archive ends once it has ``archive_bytes``."""
    spark = pages.sparkSession
    prepare_workers(spark)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("size", F.octet_length("html").cast("long")).withColumn("sha", F.sha1(F.col("html").cast("binary")))
    # page ids in order, null last
    order = F.struct(F.col("page_id").isNull().alias("last"), F.col("page_id"), F.coalesce("url", F.lit("")).alias("url"))
    places = rows.where(F.col("size") >= least_bytes).groupBy("sha", "size", order.alias("place")).agg(F.count(F.lit(1)).alias("n"))
    first = places.groupBy("sha", "size").agg(F.min(F.struct("place", "n")).alias("f"), F.sum("n").alias("n")).where("n > 1")
    first = written(first.select("sha", "size", F.col("f.place").alias("first"), F.col("f.n").alias("ties"), "n"), "digests")
    known = first.agg(F.count(F.lit(1)).alias("digests"), F.max("ties").alias("ties"), F.sum("n").alias("n")).first()

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def archive():
            n = write_file(f"{folder}/part-{part:05d}-{number:04d}.warc.gz", held)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(held)], pa.int64()), pa.array([n], pa.int64())], ["part", "n", "bytes"])

        for batch in batches:
            for page_id, url, html, sha, refers_to, revisit in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(record(page_id, url, html.encode(), base64.b32encode(bytes.fromhex(sha)).decode(), refers_to, revisit))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield archive()
                    number, held, size = number + 1, [], 0
        if held:
            yield archive()

    if known.digests <= LARGEST_BROADCAST:
        joined = rows.join(F.broadcast(first.drop("n")), ["sha", "size"], "left")
    else:
        # each hot digest has a share of the pages, which bounds their number
        is_hot = F.col("n") * MOST_SHARED >= known.n
        hot = first.where(is_hot).select("sha", "size", F.col("first").alias("hot_first"), F.col("ties").alias("hot_ties"))
        dealt = rows.join(F.broadcast(hot), ["sha", "size"], "left")
        dealt = dealt.withColumn("key", F.when(F.col("hot_ties").isNull(), F.col("sha")).otherwise(F.hex(F.xxhash64("page_id", "url"))))
        cold = first.where(~is_hot).select(F.col("sha").alias("key"), "size", "first", "ties")
        joined = dealt.join(cold, ["key", "size"], "left").withColumn("first", F.coalesce("hot_first", "first")).withColumn("ties", F.coalesce("hot_ties", "ties"))
    revisit = F.coalesce(order != F.col("first"), F.lit(False))
    refers_to = F.when(F.col("revisit"), F.col("first.page_id")).alias("refers_to")
    if (known.ties or 1) > 1:
        # rows that are equal to the first one in all that is written: one of them is the response
        tied = (F.col("ties") > 1) & ~revisit
        again = F.row_number().over(Window.partitionBy("sha", "size").orderBy("page_id")) > 1
        joined = joined.where(~F.coalesce(tied, F.lit(False))).withColumn("revisit", revisit).unionByName(joined.where(tied).withColumn("revisit", again))
    else:
        joined = joined.withColumn("revisit", revisit)
    ready = joined.select("page_id", "url", "html", "sha", refers_to, "revisit")
    # the partitions that pages come in are the archives
    done = ready.mapInArrow(run, "part int, n long, bytes long")
    return len(done.collect())  # a row for each archive


def read(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to and, if asked for, payload of each record of the archives in a folder."""
    prepare_workers(spark)
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * with_payload

    def run(batches):
        import pyarrow as pa

        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * with_payload

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        number = lambda x: int(x) if x else None
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for fields, http, payload in records(content.as_buffer()):
                    digest = fields["warc-payload-digest"].removeprefix("sha1:")
                    row = (number(fields["x-page-id"]), fields["warc-target-uri"], int(http["content-length"]), digest, fields["warc-type"], number(fields.get("x-refers-to-page-id")))
                    rows.append(row + (payload,) * with_payload)
                    held += len(payload) * with_payload
                    if len(rows) >= 10_000 or held >= 1 << 25:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("content")
    return files.mapInArrow(run, schema)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each page, as read from archives that were written before."""
    spark = pages.sparkSession
    folder = new_folder(spark, "warc")
    if not write(pages, folder, least_bytes):
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    return read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, row_number() OVER w AS place, first_value(page_id) OVER w AS first FROM p WINDOW w AS (PARTITION BY h ORDER BY page_id NULLS LAST, coalesce(url, ''))),
bits AS (SELECT *, list_transform(range(0, 40), lambda i: strpos('0123456789abcdef', substr(h, i + 1, 1)) - 1) AS x FROM f)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((x[CAST(5 * i // 4 AS INT) + 1] * 16 + coalesce(x[CAST(5 * i // 4 AS INT) + 2], 0)) // CAST(pow(2, 3 - (5 * i) % 4) AS INT) AS INT) % 32, 1)), '') AS payload_digest,
  CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN place > 1 THEN first END AS refers_to
FROM bits
"""
