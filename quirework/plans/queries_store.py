"""Queries of store, discovery, set and memory operators, and of aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import blocks as B, quality as Q, sets as S
from ..sources import discovery, formats, pdf, store
from .catalog import query, table

H = "sha256(text)"


@query(f"WITH d AS (SELECT source || '/' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.md' WHEN 1 THEN '.TXT' WHEN 2 THEN '.png' ELSE '.pdf' END AS path, {H} AS h FROM documents), r AS (SELECT *, CASE WHEN path LIKE '%.png' THEN 'unsupported_extension' WHEN path NOT LIKE 'src%' THEN 'not_matched_by_include' WHEN path LIKE '%/%7.%' THEN 'matched_exclude_rule' END AS reason FROM d), f AS (SELECT h, min_by(path, lower(path)) AS first FROM r WHERE reason IS NULL GROUP BY h) SELECT path, CASE WHEN reason IS NOT NULL THEN 'excluded' WHEN first <> path THEN 'duplicate' ELSE 'pending' END AS status, CASE WHEN reason IS NOT NULL THEN reason WHEN first <> path THEN 'duplicate_content_hash' ELSE '' END AS reason, CASE WHEN reason IS NULL AND first <> path THEN first END AS duplicate_of, h AS content_hash FROM r LEFT JOIN f USING (h)")
def src_01_discovery(spark, sf):
    m = F.col("doc_id") % 4
    end = F.when(m == 0, ".md").when(m == 1, ".TXT").when(m == 2, ".png").otherwise(".pdf")
    found = table(spark, sf, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), end).alias("path"), X.content_hash("text").alias("content_hash"))
    return discovery.candidates(found, include=["src*"], exclude=["*7.*"])


@query("SELECT p_partkey, CASE WHEN p_size <= 5 THEN list_transform(range(0, p_size), lambda i: CAST(i AS INT)) ELSE list_sort(list_distinct(list_transform(range(0, 5), lambda i: CAST(round_even(i * (p_size - 1) / 4.0, 0) AS INT)))) END AS pages, p_size * 10 < 300 AS ocr FROM part")
def src_13_page_sample(spark, sf):
    return table(spark, sf, "part").select("p_partkey", discovery.sampled_pages(F.col("p_size"), 5).alias("pages"), discovery.ocr_decision("auto", F.col("p_size") * 10)["enabled"].alias("ocr"))


@query("SELECT conv_id AS doc_id, count(*) AS sampled_pages, sum(length(regexp_replace(text, '\\s+', '', 'g')))::BIGINT AS extracted_chars FROM conversations GROUP BY conv_id")
def src_12_text_layer(spark, sf):
    return discovery.text_layer(table(spark, sf, "conversations").withColumnRenamed("conv_id", "doc_id"))


@query("SELECT o_orderkey, coalesce(n.o_orderstatus, o.o_orderstatus) AS o_orderstatus, coalesce(o.o_orderdate, n.o_orderdate) AS o_orderdate FROM (SELECT * FROM orders WHERE o_orderkey % 3 <> 0) o FULL JOIN (SELECT o_orderkey, 'N' AS o_orderstatus, o_orderdate + INTERVAL 1 DAY AS o_orderdate FROM orders WHERE o_orderkey % 2 = 0) n USING (o_orderkey)")
def src_19_upsert(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    new = o.where("o_orderkey % 2 = 0").select("o_orderkey", F.lit("N").alias("o_orderstatus"), (F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")).alias("o_orderdate"))
    return store.upsert(o.where("o_orderkey % 3 <> 0"), new.unionByName(new), "o_orderkey", ("o_orderdate",))


@query("WITH w AS (SELECT l_orderkey AS o_orderkey, min(l_partkey) AS pos FROM lineitem WHERE l_quantity >= 45 GROUP BY l_orderkey) SELECT o_orderkey, o_totalprice, pos FROM orders JOIN w USING (o_orderkey)")
def src_21_in_list(spark, sf):
    wanted = table(spark, sf, "lineitem").where("l_quantity >= 45").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("pos"))
    return store.in_order(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", wanted, "pos")


@query("SELECT c_custkey, coalesce(keys, []) AS keys FROM customer LEFT JOIN (SELECT o_custkey, list(o_orderkey ORDER BY o_orderdate, o_orderkey) AS keys FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey")
def src_22_grouped_lookup(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderdate", "o_orderkey")
    out = store.grouped(rows, "c_custkey", table(spark, sf, "customer"), ("o_orderdate", "o_orderkey"), ())
    return out.select("c_custkey", F.transform("items", lambda x: x["o_orderkey"]).alias("keys"))


@query("SELECT 'documents' AS name, count(*) AS n FROM orders WHERE o_custkey % 10 <> 0 UNION ALL SELECT 'parent_chunks', count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey % 10 <> 0 UNION ALL SELECT 'assets', 0")
def src_24_cascade_and_counts(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_custkey")
    rows = {"documents": o, "parent_chunks": table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), "l_linenumber")}
    return store.counts({**store.without(rows, o.where("o_custkey % 10 = 0")), "assets": None})


@query("SELECT event_id, props IS NOT NULL AND json_valid(props) AS valid, json_extract_string(props, '$.k') AS k FROM events")
def src_25_json_codec(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "props", store.decoded(F.col("props")).alias("m"))
    return rows.select("event_id", (F.col("props").isNotNull() & F.get_json_object("props", "$").isNotNull()).alias("valid"), F.col("m")["k"].alias("k"))


@query("SELECT event_id, 2 AS n FROM events")
def src_27_flat_metadata(spark, sf):
    m = F.create_map(F.lit("a"), F.col("event_id").cast("string"), F.lit("b"), F.lit(None).cast("string"), F.lit("c"), F.col("event_type"))
    return table(spark, sf, "events").select("event_id", F.size(store.flat_metadata(m)).alias("n"))


@query("WITH r AS (SELECT 0 AS s, page_id % 5 AS q, page_id AS k, regexp_extract(url, '^https?://([^/]+)', 1) AS u FROM pages UNION ALL SELECT 1, 0, page_id, regexp_extract(url, '^https?://([^/]+)', 1) FROM pages) SELECT u AS url, arg_min(k, {'s': s, 'q': q, 'k': k}) AS rank FROM r GROUP BY u")
def set_01_sources(spark, sf):
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    a = table(spark, sf, "pages").select(F.lit("web").alias("source"), (F.col("page_id") % 5).alias("query_no"), F.col("page_id").alias("rank"), F.lit("t").alias("title"), host.alias("url"), F.substring("html", 1, 6000).alias("content"))
    return S.merged_sources(a, a.withColumn("query_no", F.lit(0).cast("long")).withColumn("source", F.lit("kb"))).select("url", "rank")


@query("SELECT o_orderkey AS id, o_orderstatus AS text FROM orders WHERE o_orderkey % 2 = 1 UNION ALL SELECT o_orderkey, 'new' FROM orders WHERE o_orderkey % 2 = 0")
def set_03_messages(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("text"))
    return S.merge_messages(o, o.where("id % 2 = 0").withColumn("text", F.lit("new")))


@query("SELECT o_orderkey AS result_id, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE 'new' END AS text FROM orders")
def set_04_results(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("result_id"), F.col("o_orderstatus").alias("text"))
    return S.merge_results(o.where("result_id % 2 = 0"), o.withColumn("text", F.lit("new")))


@query("SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 3")
def rnk_08_recent_messages(spark, sf):
    return S.recent(table(spark, sf, "conversations"), 3).select("conv_id", "turn")


@query("SELECT conv_id, turn FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM conversations) WHERE n > 4 AND pos >= 1 AND pos < n - 2")
def rnk_08_to_summarize(spark, sf):
    return S.to_summarize(table(spark, sf, "conversations"), threshold=4, keep=2, done=F.lit(1)).select("conv_id", "turn")


@query("SELECT event_type AS category, props AS content FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, props DESC) AS n FROM events WHERE NOT contains(props, '7')) WHERE n <= 8 ORDER BY event_type DESC, ts DESC, props DESC LIMIT 8")
def agg_11_memory(spark, sf):
    memory = table(spark, sf, "events").select(F.col("event_type").alias("category"), F.col("props").alias("content"), F.col("ts").alias("created_at"))
    return S.memory_summary(S.forgotten(memory, "7")).select("category", "content")


@query("WITH t AS (SELECT user_id AS conv_id, event_id AS turn, event_type, CASE WHEN event_id % 3 <> 0 THEN 'tool' ELSE 'x' END AS role FROM events), l AS (SELECT conv_id, coalesce(max(CASE WHEN role <> 'tool' THEN turn END), -1) AS last FROM t GROUP BY conv_id) SELECT t.conv_id, t.turn AS result_id FROM t JOIN l USING (conv_id) WHERE t.turn > last AND t.turn % 2 = 0")
def jon_07_new_results(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("conv_id"), F.col("event_id").alias("turn"), F.when(F.col("event_id") % 3 != 0, "tool").otherwise("x").alias("role"), F.col("event_id").alias("result_id"))
    return S.new_results(e, e.where("result_id % 2 = 1")).select("conv_id", "result_id")


@query("SELECT user_id, arg_max(event_type, {'a': ts, 'b': event_type}) AS event_type, max(ts) AS ts FROM events GROUP BY user_id")
def jon_08_job_state(spark, sf):
    return S.latest_state(table(spark, sf, "events"), "user_id", "event_type", "ts")


@query(f"WITH k AS (SELECT 'p' || doc_id AS path, {H} AS h FROM documents WHERE doc_id % 3 = 0), i AS (SELECT CASE WHEN doc_id % 5 = 0 THEN 'q' ELSE 'p' END || doc_id AS path, sha256(text || CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE '' END) AS h FROM documents) SELECT i.path, CASE WHEN k.h = i.h THEN 'unchanged' WHEN k.path IS NOT NULL THEN 'changed' WHEN i.h IN (SELECT h FROM k) THEN 'duplicate' ELSE 'new' END AS status FROM i LEFT JOIN k USING (path)")
def flw_14_ingest_status(spark, sf):
    d, i = table(spark, sf, "documents"), F.col("doc_id")
    known = d.where("doc_id % 3 = 0").select(F.concat(F.lit("p"), i.cast("string")).alias("path"), X.content_hash("text").alias("content_hash"))
    incoming = d.select(F.concat(F.when(i % 5 == 0, "q").otherwise("p"), i.cast("string")).alias("path"), X.content_hash(F.concat("text", F.when(i % 7 == 0, "x").otherwise(""))).alias("content_hash"))
    return discovery.ingest_status(incoming, known).select("path", "status")


@query("SELECT doc_id, pos AS block_ordinal, trim(p, ' ' || chr(10)) AS text FROM (SELECT doc_id, unnest(range(0, len(l))) AS pos, unnest(l) AS p FROM (SELECT doc_id, regexp_split_to_array(text, '\\n\\s*\\n') AS l FROM documents)) WHERE trim(p, ' ' || chr(10)) <> ''")
def flw_02_text_blocks(spark, sf):
    return B.text_blocks(table(spark, sf, "documents")).select("doc_id", F.col("block_ordinal").cast("long").alias("block_ordinal"), "text")


@query("WITH l AS (SELECT doc_id % 20 AS doc_id, doc_id % 3 AS page, trim(x, ' ') AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents)), n AS (SELECT doc_id, page, regexp_replace(line, '\\s+', ' ', 'g') AS line FROM l) SELECT doc_id, line FROM n WHERE line <> '' AND length(line) <= 180 AND len(string_split(line, ' ')) <= 18 GROUP BY doc_id, line HAVING count(DISTINCT page) >= 2")
def flw_04_repeated_lines(spark, sf):
    rows = table(spark, sf, "documents").select((F.col("doc_id") % 20).alias("doc_id"), (F.col("doc_id") % 3).alias("page_start"), "text")
    return B.repeated_lines(rows, 2)


@query("SELECT o_custkey AS doc_id, o_orderkey AS block_ordinal, sum(c) OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::BIGINT AS section_no FROM (SELECT *, CASE WHEN lag(o_orderstatus) OVER w IS DISTINCT FROM o_orderstatus THEN 1 ELSE 0 END AS c FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))")
def flw_07_sections_by_path(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("block_ordinal"), F.col("o_orderstatus").alias("section_path"), F.lit("body").alias("role"))
    return B.sections_by_path(rows).select("doc_id", "block_ordinal", "section_no")


@query("SELECT o_custkey AS doc_id, least(min(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey END), min(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey END)) AS page_start, greatest(max(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey END), max(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey END)) AS page_end FROM orders GROUP BY o_custkey")
def flw_12_page_range(spark, sf):
    k = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("doc_id"), F.when(k % 2 == 0, k).alias("page_start"), F.when(k % 3 == 0, k).alias("page_end"))
    return B.page_ranges(rows, "doc_id")


@query("SELECT source AS doc_id, count(*) AS child_chunks, count(*) FILTER (trim(text, ' ' || chr(10)) = '') AS empty_child_chunks, count(*) FILTER (len(regexp_extract_all(text, '[A-Za-z0-9]+(?:[-_''][A-Za-z0-9]+)*|\\d+(?:\\.\\d+)?|[^\\s]')) > 500) AS oversize_child_chunks, 0::BIGINT AS mojibake_warnings FROM documents GROUP BY source")
def agg_01_quality(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("source").alias("doc_id"), "text", F.lit("within_limit").alias("split_reason"))
    return Q.child_stats(rows, 500).select("doc_id", "child_chunks", "empty_child_chunks", "oversize_child_chunks", "mojibake_warnings")


@query("SELECT count(*) AS documents, sum(c)::BIGINT AS child_chunks FROM (SELECT source, count(*) AS c FROM documents GROUP BY source)")
def agg_02_merge(spark, sf):
    rows = table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("child_chunks")).withColumn("documents", F.lit(1))
    return Q.merged(rows, ("documents", "child_chunks"))


@query("SELECT o_custkey AS doc_id, o_orderstatus AS role, count(*) AS n FROM orders GROUP BY ALL")
def agg_03_roles(spark, sf):
    return Q.role_counts(table(spark, sf, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderstatus").alias("role")))


@query("SELECT c_custkey, coalesce(n, 0) AS n_assets FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey")
def agg_06_asset_counts(spark, sf):
    return Q.counts_of(table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "n_assets")


@query("SELECT o_custkey, list_sort(list(DISTINCT o_orderstatus)) AS kinds FROM orders GROUP BY o_custkey")
def agg_10_distinct_sets(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderstatus")).alias("kinds"))


_LOG = {"schemas": {"orders": "o_orderkey long, o_orderstatus string, o_totalprice double", "lines": "line string, doc_id long, l_quantity double"}, "keys": {"orders": "o_orderkey", "lines": "line"}, "kept": {"orders": ("o_totalprice",)}}


def _order_log(spark, sf):
    """All orders and lines; then finished orders again with another status, in two changes; then a compaction; then one customer segment's documents go."""
    log = store.Store(spark, store.working_folder(spark, "orders-log"), **_LOG)
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("double").alias("o_totalprice"), "o_custkey")
    lines = table(spark, sf, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("line"), F.col("l_orderkey").alias("doc_id"), F.col("l_quantity").cast("double").alias("l_quantity"))
    rows = o.drop("o_custkey")
    log.add({"orders": rows, "lines": lines})
    for status in ("F", "P"):
        log.add({"orders": rows.where(F.col("o_orderstatus") == status).withColumns({"o_orderstatus": F.lit(f"{status}2"), "o_totalprice": F.lit(0.0)})})
    log.compact(least=2)
    gone = o.join(table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'"), F.expr("o_custkey = c_custkey"), "left_semi").select(F.col("o_orderkey").alias("doc_id"))
    log.add({}, without=gone, drop={"orders": gone.withColumnRenamed("doc_id", "o_orderkey")})
    return log


@query("WITH o AS (SELECT * FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')) SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F', 'P') THEN o_orderstatus || '2' ELSE o_orderstatus END AS o_orderstatus, CAST(o_totalprice AS DOUBLE) AS o_totalprice, n_lines FROM o LEFT JOIN (SELECT l_orderkey, count(DISTINCT l_linenumber) AS n_lines FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def src_18_log(spark, sf):
    """What counts after upserts, a compaction and deletes, merged from segments."""
    log = _order_log(spark, sf)
    lines = log.table("lines").groupBy(F.col("doc_id").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n_lines"))
    return log.table("orders").join(lines, "o_orderkey", "left")


@query("SELECT 1 AS version, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL UNION ALL SELECT v, CASE WHEN o_orderstatus = 'F' OR v > 2 AND o_orderstatus = 'P' THEN o_orderstatus || '2' ELSE o_orderstatus END AS s, count(*) FROM orders, (SELECT unnest([2, 3, 4]) AS v) GROUP BY v, s UNION ALL SELECT 5, CASE WHEN o_orderstatus IN ('F', 'P') THEN o_orderstatus || '2' ELSE o_orderstatus END AS s, count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY s")
def src_18_log_versions(spark, sf):
    """Each version of the log as it was."""
    log, out = _order_log(spark, sf), None
    for version in sorted(log.versions()):
        part = log.table("orders", version).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")).select(F.lit(version).alias("version"), "o_orderstatus", "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("WITH p AS (SELECT page_id, html, regexp_extract(url, '^https?://([^/]+)', 1) AS host, page_id % 5 AS k FROM pages) SELECT host, CASE k WHEN 0 THEN 'docx' WHEN 1 THEN 'md' ELSE 'txt' END AS file_type, CASE WHEN k = 0 THEN 'bad_docx' WHEN k = 2 THEN 'not_utf8' ELSE 'read' END AS status, count(*) AS n, sum(CASE WHEN k IN (0, 2) THEN 0 ELSE length(html) END)::BIGINT AS chars FROM p GROUP BY ALL")
def flw_15_file_failures(spark, sf):
    """Pages as files, some no archives and some in UTF-16: what is read, and what fails for which reason, by host."""
    p, k = table(spark, sf, "pages"), F.col("page_id") % 5
    kind = F.when(k == 0, "docx").when(k == 1, "md").otherwise("txt")
    files = p.select(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("path"), kind.alias("file_type"), F.lit("").alias("content_hash"), F.when(k == 2, F.encode("html", "UTF-16")).otherwise(F.encode("html", "UTF-8")).alias("content"))
    rows = formats.read_texts(files)
    return rows.groupBy(F.col("path").alias("host"), "file_type", F.coalesce("error.reason", F.lit("read")).alias("status")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.length("raw"), F.lit(0)).cast("long")).alias("chars"))


@query("WITH p AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k, count(*) OVER (PARTITION BY conv_id) AS n, length(regexp_replace(text, '\\s+', '', 'g')) AS c FROM conversations), s AS (SELECT * FROM p WHERE n <= 3 OR k IN (0, CAST(round_even((n - 1) / 2.0, 0) AS BIGINT), n - 1)) SELECT conv_id, any_value(n)::INT AS n_pages, count(*) AS sampled_pages, sum(c)::BIGINT AS extracted_chars, CASE WHEN sum(c) < 300 THEN 'little_text' ELSE 'text_layer' END AS reason FROM s GROUP BY conv_id")
def src_12_pdf_probe(spark, sf):
    """Conversations as PDF files, a page for each turn, read again: their text layers, sampled."""
    turns = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    number = lambda k, more: (10 + 2 * k + more).cast("string")
    page = lambda t, k: F.concat(number(k, 0), F.lit(" 0 obj << /Type /Page /Parent 2 0 R /Contents "), number(k, 1), F.lit(" 0 R >> endobj\n"), number(k, 1), F.lit(" 0 obj << >> stream\nBT /F1 10 Tf <"), F.hex(F.encode(t["text"], "ISO-8859-1")), F.lit("> Tj ET\nendstream endobj\n"))
    kids = F.array_join(F.transform("t", lambda t, k: F.concat(number(k, 0), F.lit(" 0 R"))), " ")
    head = "%PDF-1.7\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n3 0 obj << /Type /Font /Subtype /Type1 /Encoding /WinAnsiEncoding >> endobj\n2 0 obj << /Type /Pages /Resources << /Font << /F1 3 0 R >> >> /Kids ["
    body = F.concat(F.lit(head), kids, F.lit("] >> endobj\n"), F.array_join(F.transform("t", page), ""), F.lit("trailer << /Root 1 0 R >>\n"))
    files = turns.select(F.col("conv_id").cast("string").alias("path"), F.encode(body, "ISO-8859-1").alias("content"))
    seen = pdf.probe(pdf.pages(files, 3))
    return seen.select(F.col("path").cast("long").alias("conv_id"), "n_pages", "sampled_pages", "extracted_chars", F.col("ocr.reason").alias("reason"))
