"""Requests over HTTP as rows: each distinct request once, with retries, a rate, its error as data, and kept answers.

`answered` takes a table of requests. Equal ones (by a digest of address, type, credentials' name and body) are one;
those answered before, in the folder of kept answers, aren't sent again. The rest are dealt to tasks and sorted, and a
task sends blocks of BLOCK at once; a block's answers are kept under the digest of its requests as soon as they are
there, so that a task which runs again takes them from there. Requests that fail in the end are rows with an error;
only answers of success are kept for later calls.

Secrets aren't columns: a request names its credentials, and ``secrets`` gives the header for each name.
"""

from __future__ import annotations

import hashlib
import json
import random
import threading
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from urllib.error import HTTPError, URLError
from urllib.request import Request, urlopen

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .formats import prepare_workers

BLOCK = 64
REQUEST = "url string, content_type string, credentials string, body binary"
ANSWER = "digest string, status int, answer binary, error string"


@dataclass
class Limits:
    """Tries of a request, seconds before the second one (then doubled), requests a second and at once of a task, seconds for an answer."""

    tries: int = 4
    wait: float = 0.5
    per_second: float = 10.0
    at_once: int = 8
    timeout: float = 120.0
    secrets: dict[str, dict[str, str]] = field(default_factory=dict)


class Pace:
    """Lets ``per_second`` calls a second pass."""

    def __init__(self, per_second: float):
        self.gap, self.next, self.lock = 1 / per_second, 0.0, threading.Lock()

    def wait(self) -> None:
        with self.lock:
            at = max(self.next, time.monotonic())
            self.next = at + self.gap
        time.sleep(max(0.0, at - time.monotonic()))


def send(url: str, body: bytes | None, content_type: str, headers: dict[str, str], limits: Limits, pace: Pace) -> tuple[int | None, bytes | None, str | None]:
    """(status, answer, error): other tries follow where a server is busy, broken or not there, at its own Retry-After if it gives one."""
    status, error = None, "not sent"
    for n in range(limits.tries):
        pace.wait()
        rest = limits.wait * 2**n * (1 + random.random() / 4)
        try:
            with urlopen(Request(url, body, {"Content-Type": content_type, **headers}), timeout=limits.timeout) as answer:
                return answer.status, answer.read(), None
        except HTTPError as fault:
            status, error = fault.code, f"HTTP {fault.code}: {fault.read()[:500].decode(errors='replace')}"
            if status != 429 and status < 500:
                break
            after = fault.headers.get("Retry-After", "")
            rest = float(after) if after.replace(".", "", 1).isdigit() else rest
        except (URLError, OSError, ValueError) as fault:
            status, error = None, f"{type(fault).__name__}: {fault}"
            if isinstance(fault, ValueError):
                break
        if n + 1 < limits.tries:
            time.sleep(rest)
    return status, None, error


def with_digest(requests: DataFrame) -> DataFrame:
    parts = [F.coalesce(F.col(c), F.lit("")).cast("binary") for c in ("url", "content_type", "credentials")]
    lengths = F.concat_ws(",", *(F.octet_length(p).cast("string") for p in parts), F.lit("")).cast("binary")
    return requests.withColumn("digest", F.sha2(F.concat(lengths, *parts, F.coalesce("body", F.lit(b""))), 256))


def answered(requests: DataFrame, limits: Limits, folder: str, tasks: int = 4) -> DataFrame:
    """``requests`` (with the columns of REQUEST) with status, answer and error; ``folder`` keeps answers and is shared by driver and executors."""
    spark = requests.sparkSession
    prepare_workers(spark)
    rows = with_digest(requests)
    known = kept_answers(spark, folder)
    todo = rows.select("digest", "url", "content_type", "credentials", "body").dropDuplicates(["digest"]).join(known, "digest", "left_anti")

    call = uuid.uuid4().hex

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        pace = Pace(limits.per_second)

        def one(row: dict) -> dict:
            headers = limits.secrets.get(row["credentials"] or "", {})
            status, answer, error = send(row["url"], row["body"], row["content_type"] or "application/json", headers, limits, pace)
            return {"digest": row["digest"], "status": status, "answer": answer, "error": error}

        schema = pa.schema([("digest", pa.string()), ("status", pa.int32()), ("answer", pa.binary()), ("error", pa.string())])
        with ThreadPoolExecutor(limits.at_once) as pool:
            held: list[dict] = []

            def block():
                name = hashlib.sha256("".join(r["digest"] for r in held).encode()).hexdigest()
                # a block with an error is kept for this call's tasks only, so that a later call tries again
                whole, broken = f"{root}/blocks/{name}.arrow", f"{root}/rounds/{call}/{name}.arrow"
                for path in (whole, broken):
                    if system.get_file_info(path).type == fs.FileType.File:
                        with system.open_input_file(path) as file, pa.ipc.open_file(file) as reader:
                            yield from reader.read_all().to_batches()
                        return
                table = pa.Table.from_pylist(list(pool.map(one, held)), schema)
                path = broken if table["error"].null_count < len(table) else whole
                system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                own = f"{path}.{uuid.uuid4().hex}"  # whole under its name, or not there
                with system.open_output_stream(own) as file, pa.ipc.new_file(file, schema) as writer:
                    writer.write_table(table)
                system.move(own, path)
                yield from table.to_batches()

            for batch in batches:
                for row in batch.to_pylist():
                    held.append(row)
                    if len(held) == BLOCK:
                        yield from block()
                        held = []
            if held:
                yield from block()

    fresh = todo.repartition(tasks, "digest").sortWithinPartitions("digest").mapInArrow(run, ANSWER)
    stage = f"{folder}/rounds/{call}/answers"
    fresh.write.parquet(stage)
    fresh = spark.read.schema(ANSWER).parquet(stage)
    fresh.where("error is null").select("digest", "status", "answer").coalesce(1).write.mode("append").parquet(f"{folder}/answers")
    every = known.withColumn("error", F.lit(None).cast("string")).unionByName(fresh)
    return rows.join(every, "digest", "left").drop("digest")


def kept_answers(spark: SparkSession, folder: str) -> DataFrame:
    """digest, status, answer of what was answered before, as it stands now."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = hadoop.Path(f"{folder}/answers")
    schema = "digest string, status int, answer binary"
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{folder}/answers").dropDuplicates(["digest"])


def text_of(answer: Column) -> Column:
    return F.try_validate_utf8(answer.cast("string"))


# --- services -------------------------------------------------------------------------------------


def chats(rows: DataFrame, messages: Column, url: str, model: str, limits: Limits, folder: str, temperature: float = 0.0, max_tokens: int = 1024, json_mode: bool = False, credentials: str = "chat") -> DataFrame:
    """``rows`` with reply and error: messages (an array of role and content) answered by a service with the common interface for chats."""
    fields = [F.lit(model).alias("model"), messages.alias("messages"), F.lit(temperature).alias("temperature"), F.lit(max_tokens).alias("max_tokens")]
    fields += [F.struct(F.lit("json_object").alias("type")).alias("response_format")] * json_mode
    asked = rows.withColumns({"url": F.lit(f"{url.rstrip('/')}/chat/completions"), "content_type": F.lit("application/json"), "credentials": F.lit(credentials), "body": F.to_json(F.struct(*fields)).cast("binary")})
    reply = F.get_json_object(text_of(F.col("answer")), "$.choices[0].message.content")
    error = F.coalesce("error", F.when(reply.isNull(), F.lit("the answer has no content")))
    return answered(asked, limits, folder).select(*rows.columns, reply.alias("reply"), error.alias("error"))


def reranked(hits: DataFrame, url: str, model: str, limits: Limits, folder: str, credentials: str = "rerank") -> DataFrame:
    """Hits (query_id, question, rank, text, ...) with the service's score, the old one as original_score; one request for each query. A query that fails keeps its scores, and has error."""
    lists = hits.groupBy("query_id", "question").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("d"))
    body = F.to_json(F.struct(F.lit(model).alias("model"), F.col("question").alias("query"), F.transform("d", lambda d: d["text"]).alias("documents"), F.size("d").alias("top_n"), F.lit(False).alias("return_documents")))
    asked = lists.withColumns({"url": F.lit(f"{url.rstrip('/')}/rerank"), "content_type": F.lit("application/json"), "credentials": F.lit(credentials), "body": body.cast("binary")})
    told = answered(asked, limits, folder).withColumn("r", F.from_json(text_of(F.col("answer")), "results array<struct<index:int,relevance_score:double>>")["results"])
    scores = told.select("query_id", F.explode("r").alias("r"), "d").select("query_id", F.try_element_at("d", F.col("r.index") + 1)["rank"].alias("rank"), F.col("r.relevance_score").alias("new"))
    out = hits.join(scores, ["query_id", "rank"], "left").join(told.select("query_id", F.col("error")), "query_id", "left")
    failed = F.col("error").isNotNull()
    return out.where(failed | F.col("new").isNotNull()).withColumn("original_score", F.col("score")).withColumn("score", F.coalesce("new", "score")).drop("new")


def tei_documents(files: DataFrame, url: str, limits: Limits, folder: str, raw_citations: bool = True) -> DataFrame:
    """path, tei, error of PDF files (path, content), from a service that answers a file by the TEI of its text."""
    mark = F.concat(F.lit("part-"), F.substring(F.sha2("content", 256), 1, 24))
    line = lambda *parts: F.concat(*(p.cast("binary") if isinstance(p, Column) else F.lit(p.encode()) for p in parts))
    name = F.regexp_replace(F.substring_index("path", "/", -1), r'["\\\r\n]', "_")
    body = F.concat(
        line("--", mark, '\r\nContent-Disposition: form-data; name="includeRawCitations"\r\n\r\n', "1" if raw_citations else "0", "\r\n--"),
        line(mark, '\r\nContent-Disposition: form-data; name="input"; filename="', name, '"\r\nContent-Type: application/pdf\r\n\r\n'), F.col("content"), line("\r\n--", mark, "--\r\n"),
    )
    asked = files.select("path", F.lit(f"{url.rstrip('/')}/api/processFulltextDocument").alias("url"), F.concat(F.lit("multipart/form-data; boundary="), mark).alias("content_type"), F.lit("").alias("credentials"), body.alias("body"))
    return answered(asked, limits, folder).select("path", text_of(F.col("answer")).alias("tei"), "error")


class HttpEmbedder:
    """An embedder for `plans.models.embedded`: a batch of texts is one request."""

    def __init__(self, url: str, model: str, limits: Limits, credentials: str = "embedding", batch: int = 64):
        self.url, self.model, self.limits, self.credentials, self.batch = f"{url.rstrip('/')}/embeddings", model, limits, credentials, batch
        self.pace = Pace(limits.per_second)

    def embed(self, texts: list[str]) -> list[list[float]]:
        out: list[list[float]] = []
        for at in range(0, len(texts), self.batch):
            body = json.dumps({"model": self.model, "input": texts[at : at + self.batch]}).encode()
            _, answer, error = send(self.url, body, "application/json", self.limits.secrets.get(self.credentials, {}), self.limits, self.pace)
            if error:
                raise RuntimeError(error)
            out += [d["embedding"] for d in sorted(json.loads(answer)["data"], key=lambda d: d.get("index", 0))]
        return out


class HttpChat:
    """The chat protocol for one conversation at a time."""

    def __init__(self, url: str, model: str, limits: Limits, credentials: str = "chat"):
        self.url, self.model, self.limits, self.credentials, self.pace = f"{url.rstrip('/')}/chat/completions", model, limits, credentials, Pace(limits.per_second)

    def generate(self, messages: list[dict[str, str]], temperature: float = 0.0, max_tokens: int = 1024, json_mode: bool = False) -> str:
        request = {"model": self.model, "messages": messages, "temperature": temperature, "max_tokens": max_tokens} | ({"response_format": {"type": "json_object"}} if json_mode else {})
        _, answer, error = send(self.url, json.dumps(request).encode(), "application/json", self.limits.secrets.get(self.credentials, {}), self.limits, self.pace)
        if error:
            raise RuntimeError(error)
        return json.loads(answer)["choices"][0]["message"]["content"] or ""


class HttpSearch:
    """A source for research: each query is a request; one that fails is one result that says so."""

    def __init__(self, name: str, url: str, limits: Limits, folder: str, credentials: str = "search"):
        self.name, self.url, self.limits, self.folder, self.credentials = name, url, limits, folder, credentials

    def search(self, queries: DataFrame, most: int) -> DataFrame:
        body = F.to_json(F.struct("query", F.lit(most).alias("max_results"), F.lit(True).alias("include_raw_content"), F.lit("general").alias("topic")))
        asked = queries.select("query_no", "query", F.lit(self.url).alias("url"), F.lit("application/json").alias("content_type"), F.lit(self.credentials).alias("credentials"), body.cast("binary").alias("body"))
        told = answered(asked, self.limits, self.folder).withColumn("r", F.from_json(text_of(F.col("answer")), "results array<struct<title:string,url:string,content:string,raw_content:string>>")["results"])
        failed = F.coalesce("error", F.when(F.col("r").isNull(), F.lit("the answer has no results")))
        none = F.nullif(F.lit(""), F.lit(""))
        lost = F.array(F.struct(F.lit("unavailable").alias("title"), F.lit("").alias("url"), F.concat(F.col("query"), F.lit(": "), failed).alias("content"), none.alias("raw_content")))
        rows = told.select("query_no", F.posexplode(F.when(failed.isNotNull(), lost).otherwise(F.slice("r", 1, most))).alias("rank", "r"))
        content = F.coalesce(F.nullif("r.raw_content", F.lit("")), "r.content", F.lit(""))
        return rows.select(F.lit(self.name).alias("source"), F.col("query_no").cast("int").alias("query_no"), "rank", F.coalesce(F.nullif("r.title", F.lit("")), F.lit("Untitled")).alias("title"), F.coalesce("r.url", F.lit("")).alias("url"), F.substring(content, 1, 6000).alias("content"))


# --- pages of a service as a data source ----------------------------------------------------------


class Pages(DataSource):
    """``spark.read.format("http_pages")``: numbered pages of a service, a row for each, with its error.

    Options: url (with {n} for the number), first, last, per_task, and tries, wait, per_second, timeout as in Limits.
    """

    @classmethod
    def name(cls) -> str:
        return "http_pages"

    def schema(self) -> str:
        return "n int, url string, status int, body string, error string"

    def reader(self, schema) -> DataSourceReader:
        return PagesReader(dict(self.options))


class Range(InputPartition):
    def __init__(self, first: int, last: int):
        super().__init__((first, last))


class PagesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.url, self.first, self.last, self.per_task = options["url"], int(options.get("first", 1)), int(options["last"]), int(options.get("per_task", 100))
        given = {k: type(getattr(Limits, k))(options[low]) for k in ("tries", "wait", "per_second", "timeout") for low in (k, k.lower()) if low in options}
        self.limits = Limits(**given)

    def partitions(self) -> list[Range]:
        return [Range(at, min(at + self.per_task - 1, self.last)) for at in range(self.first, self.last + 1, self.per_task)]

    def read(self, partition: Range):
        pace = Pace(self.limits.per_second)
        for n in range(partition.value[0], partition.value[1] + 1):
            url = self.url.replace("{n}", str(n))
            status, answer, error = send(url, None, "application/json", {}, self.limits, pace)
            try:
                body = None if answer is None else answer.decode()
            except UnicodeDecodeError as fault:
                body, error = None, f"UnicodeDecodeError: {fault}"
            yield n, url, status, body, error


def register(spark: SparkSession) -> None:
    prepare_workers(spark)
    spark.dataSource.register(Pages)
