"""Requests against a server of this test."""

import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from quirework.plans import research
from quirework.plans.models import embedded
from quirework.sources import formats, http

SEEN: Counter = Counter()
TEI = '<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title>From the service</title></titleStmt></fileDesc></teiHeader></TEI>'


class Handler(BaseHTTPRequestHandler):
    def do_GET(self):
        SEEN[self.path] += 1
        n = int(self.path.rsplit("/", 1)[1])
        if n == 3 and SEEN[self.path] < 3:
            return self.say(503, "busy", {"Retry-After": "0.01"})
        self.say(404, "none") if n == 5 else self.say(200, f"page {n}")

    def do_POST(self):
        body = self.rfile.read(int(self.headers["Content-Length"]))
        SEEN[self.path, body] += 1
        if self.path.endswith("processFulltextDocument"):
            assert b'name="includeRawCitations"\r\n\r\n1\r\n' in body and body.endswith(b"--\r\n")
            return self.say(500, "broken") if b"%PDF bad" in body else self.say(200, TEI)
        asked = json.loads(body)
        if self.path.endswith("/chat/completions"):
            said = asked["messages"][-1]["content"]
            if said == "refuse" or self.headers.get("Authorization") != "Bearer key":
                return self.say(400, "no")
            if said == "slow start" and SEEN[self.path, body] == 1:
                return self.say(429, "wait", {"Retry-After": "0.01"})
            return self.say(200, json.dumps({"choices": [{"message": {"content": f"{said}? {SEEN[self.path, body]}"}}]}))
        if self.path.endswith("/embeddings"):
            return self.say(200, json.dumps({"data": [{"index": k, "embedding": [len(t), 1.0]} for k, t in reversed(list(enumerate(asked["input"])))]}))
        if self.path.endswith("/rerank"):
            if asked["query"] == "down":
                return self.say(500, "down")
            return self.say(200, json.dumps({"results": [{"index": k, "relevance_score": len(d) / 10} for k, d in enumerate(asked["documents"])]}))
        if asked["query"] == "down":
            return self.say(500, "down")
        self.say(200, json.dumps({"results": [{"title": "", "url": f"http://x/{k}", "content": "short", "raw_content": asked["query"] * k} for k in range(5)]}))

    def say(self, status, text, headers=None):
        data = text.encode()
        self.send_response(status)
        for k, v in {**(headers or {}), "Content-Length": str(len(data))}.items():
            self.send_header(k, v)
        self.end_headers()
        self.wfile.write(data)

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def url():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


LIMITS = http.Limits(tries=3, wait=0.01, per_second=500, secrets={"chat": {"Authorization": "Bearer key"}})


def test_each_request_is_sent_once_and_kept(spark, url, tmp_path):
    SEEN.clear()
    rows = spark.createDataFrame([(k, ["hello", "slow start", "refuse", "hello", "é"][k % 5]) for k in range(40)], "id long, said string").repartition(5)
    ask = lambda: http.chats(rows, F.array(F.struct(F.lit("user").alias("role"), F.col("said").alias("content"))), url, "m", LIMITS, f"file://{tmp_path}/kept")
    found = {r.id: r for r in ask().collect()}
    assert len(found) == 40 and found[0].reply == found[3].reply == "hello? 1" and found[1].reply == "slow start? 2" and found[4].reply == "é? 1"
    assert found[2].reply is None and found[2].error == "HTTP 400: no"
    sent = Counter({json.loads(k[1])["messages"][-1]["content"]: n for k, n in SEEN.items()})
    assert sent == {"hello": 1, "slow start": 2, "refuse": 1, "é": 1}
    again = {r.id: r.reply for r in ask().collect()}  # answers come from the folder; what failed is tried again
    assert again == {k: r.reply for k, r in found.items()}
    assert Counter({json.loads(k[1])["messages"][-1]["content"]: n for k, n in SEEN.items()}) == {"hello": 1, "slow start": 2, "refuse": 2, "é": 1}


def test_a_task_that_runs_again_sends_nothing_again(spark, url, tmp_path):
    SEEN.clear()
    rows = spark.range(100).select(F.lit(f"{url}/v1/embeddings").alias("url"), F.lit("application/json").alias("content_type"), F.lit("").alias("credentials"), F.to_json(F.struct(F.array(F.col("id").cast("string")).alias("input"))).cast("binary").alias("body"))
    folder = f"file://{tmp_path}/kept"
    first = http.answered(rows, LIMITS, folder).select("answer").collect()
    import shutil

    shutil.rmtree(tmp_path / "kept/answers")  # as if the job had failed before its answers were published
    assert sorted(map(str, http.answered(rows, LIMITS, folder).select("answer").collect())) == sorted(map(str, first))
    assert len(SEEN) == 100 and set(SEEN.values()) == {1}


def test_pages_as_a_data_source(spark, url):
    SEEN.clear()
    http.register(spark)
    rows = {r.n: r for r in spark.read.format("http_pages").option("url", f"{url}/p/{{n}}").option("first", 1).option("last", 7).option("per_task", 3).option("tries", 3).option("wait", 0.01).option("per_second", 500).load().collect()}
    assert sorted(rows) == list(range(1, 8)) and rows[3].body == "page 3" and SEEN["/p/3"] == 3
    assert rows[5].status == 404 and rows[5].body is None and rows[5].error == "HTTP 404: none"


def test_nobody_there(spark, tmp_path):
    rows = spark.createDataFrame([("http://127.0.0.1:9/x", "a/b", "", bytearray(b"1")), ("no address", "a/b", "", bytearray(b"1"))], http.REQUEST)
    found = {r.url: r for r in http.answered(rows, LIMITS, f"file://{tmp_path}/kept").collect()}
    assert "refused" in found["http://127.0.0.1:9/x"].error and found["no address"].error.startswith("ValueError")


def test_services(spark, url, tmp_path):
    limits, folder = LIMITS, f"file://{tmp_path}/kept"
    files = spark.createDataFrame([("/d/a.pdf", bytearray(b"%PDF good \xff")), ("/d/b.pdf", bytearray(b"%PDF bad"))], "path string, content binary")
    tei = {r.path: r for r in http.tei_documents(files, url, limits, folder).collect()}
    assert tei["/d/b.pdf"].tei is None and tei["/d/b.pdf"].error.startswith("HTTP 500")
    parsed = formats.tei(http.tei_documents(files, url, limits, folder).withColumnRenamed("path", "doc_id"))
    assert {r.doc_id: r.tei and r.tei.title for r in parsed.collect()} == {"/d/a.pdf": "From the service", "/d/b.pdf": None}
    make = lambda: http.HttpEmbedder(url, "m", limits, batch=2)
    texts = spark.createDataFrame([("a",), ("bbb",), ("cc",)], "t string").coalesce(1)
    assert [list(r.v) for r in texts.select(embedded(F.col("t"), make).alias("v")).collect()] == [[1, 1], [3, 1], [2, 1]]
    assert http.HttpChat(url, "m", limits).generate([{"role": "user", "content": "alone"}], json_mode=True) == "alone? 1"
    with pytest.raises(RuntimeError, match="HTTP 400"):
        http.HttpChat(url, "m", limits).generate([{"role": "user", "content": "refuse"}])
    hits = spark.createDataFrame([(1, "q", 0, "long text", 0.5), (1, "q", 1, "x", 0.4), (2, "down", 0, "t", 0.3)], "query_id long, question string, rank int, text string, score double")
    found = {(r.query_id, r.rank): r for r in http.reranked(hits, url, "m", limits, folder).collect()}
    assert found[1, 0].score == 0.9 and found[1, 0].original_score == 0.5 and found[1, 1].score == 0.1 and found[2, 0].score == 0.3 and found[2, 0].error.startswith("HTTP 500")
    rows = research.search_all(spark, ["ab", "down"], [http.HttpSearch("web", f"{url}/search", limits, folder)], 3).collect()
    assert {(r.url, r.title) for r in rows} == {("http://x/0", "Untitled"), ("http://x/1", "Untitled"), ("http://x/2", "Untitled"), ("", "unavailable")}
    assert {r.url: r.content for r in rows}["http://x/2"] == "abab" and {r.url: r.content for r in rows}["http://x/0"] == "short"
