"""Queries of operators on text pieces, noise rules, blocks, sections and states, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import predicates as P, text as X, vocabulary as V
from ..operators import blocks as B, sets as S
from ..sources.store import point, search_documents
from ..streaming import conversations
from . import answer
from .catalog import query, quoted, table

MOST = 40
_token = quoted(V.TOKEN)
_trim = "' ' || chr(10)"
_line = "regexp_replace(trim(text, E' \\t\\n\\r'), '\\s+', ' ', 'g')"


def _joined(tokens: str) -> str:
    """SQL of tokens put together, for texts without CJK."""
    spaced = f"array_to_string({tokens}, ' ')"
    return f"trim(regexp_replace(regexp_replace({spaced}, ' ([，。！？；：、,.!?;:%)\\]}}])', '\\1', 'g'), '([(\\[{{/]) ', '\\1', 'g'))"


def _slices(text: str, most: int) -> str:
    found = f"regexp_extract_all({text}, {_token})"
    return f"list_transform(range(0, len({found}), {most}), lambda k: {_joined(f'{found}[k + 1:k + {most}]')})"


def _count(text: str) -> str:
    return f"len(regexp_extract_all({text}, {_token}))"


@query(
    f"""WITH p AS (SELECT doc_id, n AS p_no, trim(p, {_trim}) AS p FROM (SELECT doc_id, unnest(l) AS p, generate_subscripts(l, 1) AS n FROM (SELECT doc_id, regexp_split_to_array(text, '\\n\\s*\\n+') AS l FROM documents))),
s AS (SELECT doc_id, p_no, n AS s_no, trim(s, {_trim}) AS s FROM (SELECT doc_id, p_no, unnest(l) AS s, generate_subscripts(l, 1) AS n FROM (SELECT doc_id, p_no, regexp_extract_all(p, '[^。！？；.!?;\\n]*[。！？；.!?;\\n]|[^。！？；.!?;\\n]+$') AS l FROM p WHERE p <> '' AND {_count("p")} > {MOST})) WHERE trim(s, {_trim}) <> ''),
h AS (SELECT doc_id, unnest({_slices("s", MOST)}) AS text FROM s WHERE {_count("s")} > {MOST}),
u AS (SELECT doc_id, p AS text, 'paragraph_boundary' AS reason FROM p WHERE p <> '' AND {_count("p")} <= {MOST} UNION ALL SELECT doc_id, s, 'sentence_boundary' FROM s WHERE {_count("s")} <= {MOST} UNION ALL SELECT doc_id, text, 'hard_limit' FROM h)
SELECT doc_id, text, reason, count(*) AS n FROM u GROUP BY ALL"""
)
def txt_13_boundary_units(spark, sf):
    """The units that a document's pieces are packed from, with their reasons (texts without any word have one empty unit)."""
    rows = table(spark, sf, "documents").select("doc_id", F.explode(X.boundary_units("text", MOST)).alias("u")).where("u.text <> ''")
    return rows.groupBy("doc_id", "u.text", "u.reason").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT doc_id, {_slices('text', MOST)} AS pieces FROM documents")
def txt_14_split_long(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.split_long("text", MOST).alias("pieces"))


@query(f"SELECT conv_id, turn, {_joined(f'regexp_extract_all(text, {_token})')} AS joined FROM conversations")
def txt_15_join_tokens(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", X.join_tokens(X.tokens("text")).alias("joined"))


@query("SELECT p_partkey, p_size % 4 <> 3 AS header FROM part")
def prd_03_publication_header(spark, sf):
    size = F.col("p_size").cast("string")
    m = F.col("p_size") % 4
    text = F.when(m == 0, F.concat(F.lit("Vol. "), size, F.lit(", No. 3"))).when(m == 1, F.concat(F.lit("第 "), size, F.lit(" 卷 第 1 期"))).when(m == 2, F.concat("p_name", F.lit(" ISSN 1234"))).otherwise(F.col("p_name"))
    return table(spark, sf, "part").select("p_partkey", P.is_publication_header(text).alias("header"))


_cited = "text || CASE doc_id % 3 WHEN 0 THEN chr(10) || 'Smith et al. 2019, doi: 10.1, Vol. 3, No. 4' WHEN 1 THEN chr(10) || 'A et al. (2020)' ELSE '' END"


@query(
    f"""WITH d AS (SELECT doc_id, {_cited} AS text FROM documents), l AS (SELECT doc_id, {_line} AS line, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, E' \\t\\r')), lambda x: x <> '') AS lines FROM d)
SELECT doc_id, length(line) >= 80 AND (len(regexp_extract_all(line, '(?i)@marker@')) >= 4 OR (len(lines) >= 3 AND len(list_filter(lines, lambda x: regexp_matches(x, '(?i)@marker@'))) / len(lines) >= 0.6)) AS cited FROM l""",
    marker=V.BIBLIOGRAPHY_MARKER,
)
def prd_04_bibliography(spark, sf):
    m = F.col("doc_id") % 3
    more = F.when(m == 0, "\nSmith et al. 2019, doi: 10.1, Vol. 3, No. 4").when(m == 1, "\nA et al. (2020)").otherwise("")
    return table(spark, sf, "documents").select("doc_id", P.is_bibliography(F.concat("text", more)).alias("cited"))


@query("SELECT role, count(*) AS n FROM (SELECT CASE o_orderkey % 5 WHEN 0 THEN 'reference' WHEN 1 THEN 'furniture' WHEN 2 THEN 'noise' WHEN 3 THEN 'asset' END AS role FROM orders) WHERE coalesce(role, 'body') NOT IN ('reference', 'furniture', 'noise') GROUP BY role")
def prd_09_main_roles(spark, sf):
    m = F.col("o_orderkey") % 5
    rows = table(spark, sf, "orders").select(F.when(m == 0, "reference").when(m == 1, "furniture").when(m == 2, "noise").when(m == 3, "asset").alias("role"))
    return rows.where(P.is_main_role(F.col("role"))).groupBy("role").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, p_name <> '' AND p_size % 2 = 0 AS heading_only, p_size % 3 = 0 AS nested FROM part")
def prd_10_paths(spark, sf):
    n = F.col("p_size")
    text = F.concat(F.lit(" "), F.replace(F.col("p_name"), F.lit(" "), F.lit("  \n")), F.when(n % 2 == 0, "\n").otherwise(" more"))
    path = F.when(n % 3 == 0, F.concat("p_brand", F.lit(" > "), "p_name")).when(n % 3 == 1, F.col("p_brand")).otherwise(F.concat("p_brand", F.lit(">"), "p_name"))
    return table(spark, sf, "part").select("p_partkey", P.is_heading_only(text, F.col("p_name")).alias("heading_only"), P.is_nested_path(F.col("p_brand"), path).alias("nested"))


@query("SELECT l_orderkey, l_linenumber, l_linenumber % 3 = 0 OR l_quantity > 40 AS blocked FROM lineitem")
def prd_11_quality_gate(spark, sf):
    some = F.when(F.col("l_linenumber") % 3 == 0, F.col("l_linenumber")), F.when(F.col("l_quantity") > 40, 1).otherwise(0), F.lit(0)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", P.has_quality_blockers(*some).alias("blocked"))


@query("SELECT conv_id, turn, turn % 4 IN (0, 1, 2) OR contains(lower(text), 'provided context does not contain') AS falls_back FROM conversations")
def prd_14_chat_fallback(spark, sf):
    m = F.col("turn") % 4
    said = F.when(m == 2, F.concat("text", F.lit(" It Cannot be determined from the provided context."))).otherwise(F.col("text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", P.falls_back_to_chat(F.when(m == 0, "broken"), F.when(m != 1, 3), said).alias("falls_back"))


@query(
    f"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text || chr(10) || 'Page 3 of 9' || chr(10) || '  Running   Head ' || chr(10) || 'https://x.org/a' || chr(10) || 'last line', chr(10)), lambda x: trim(x, E' \\t\\r')), lambda x: x <> '') AS l FROM documents),
k AS (SELECT doc_id, l, list_filter(l, lambda x: regexp_replace(x, '\\s+', ' ', 'g') <> 'Running Head' AND NOT regexp_matches(regexp_replace(x, '\\s+', ' ', 'g'), '(?i)@noise@')) AS kept FROM l)
SELECT doc_id, trim(regexp_replace(array_to_string(kept, chr(10)), '[ \\t]+', ' ', 'g'), {_trim}) AS clean, CAST(len(l) - len(kept) AS INT) AS removed FROM k""",
    noise=V.NOISE_LINE,
)
def flw_05_cleaned_lines(spark, sf):
    text = F.concat("text", F.lit("\nPage 3 of 9\n  Running   Head \nhttps://x.org/a\nlast line"))
    rows = table(spark, sf, "documents").select("doc_id", B.cleaned_lines(text, F.array(F.lit("Running Head"))).alias("c"))
    return rows.select("doc_id", F.col("c.text").alias("clean"), F.col("c.removed").alias("removed"))


@query(
    """WITH b AS (SELECT o_custkey AS doc_id, o_orderkey AS k, o_orderpriority AS text, CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 END AS lvl FROM orders),
w AS (SELECT *, sum(CASE WHEN lvl IS NULL THEN 0 ELSE 1 END) OVER d AS no, last_value(lvl IGNORE NULLS) OVER d AS now, last_value(CASE WHEN lvl = 1 THEN text END IGNORE NULLS) OVER d AS t1, last_value(CASE WHEN lvl = 2 THEN text END IGNORE NULLS) OVER d AS t2 FROM b WINDOW d AS (PARTITION BY doc_id ORDER BY k))
SELECT doc_id, k AS block_ordinal, no::BIGINT AS section_no, CASE WHEN no = 0 THEN 'Untitled' WHEN now = 1 THEN t1 ELSE coalesce(t1 || ' > ', '') || t2 END AS path, coalesce(now, 1) AS section_level FROM w"""
)
def flw_06_sections(spark, sf):
    m = F.col("o_orderkey") % 4
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("block_ordinal"), F.col("o_orderpriority").alias("text"), F.when(m == 0, "title").when(m == 1, "section_header").otherwise("paragraph").alias("block_type"), F.lit(0).alias("level"))
    return B.sections(rows).select("doc_id", "block_ordinal", "section_no", "path", "section_level")


@query(
    """SELECT o_custkey AS doc_id, o_orderkey AS block_ordinal, last_value(CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_custkey % 2 = 0 THEN 'Paper > ' || o_orderpriority ELSE o_orderpriority END END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS section_path FROM orders"""
)
def flw_13_aligned(spark, sf):
    """Headings of blocks are matched with a second parser's in their normal form; the first of equal ones counts."""
    o = table(spark, sf, "orders")
    kind = F.when(F.col("o_orderkey") % 3 == 0, "section_header").otherwise("paragraph")
    rows = o.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("block_ordinal"), F.col("o_orderpriority").alias("text"), kind.alias("block_type"))
    heads = o.where("o_custkey % 2 = 0").select(F.col("o_custkey").alias("doc_id"), F.upper(F.replace("o_orderpriority", F.lit("-"), F.lit(": "))).alias("heading"), F.concat(F.lit("Paper > "), "o_orderpriority").alias("section_path"), F.lit(0).alias("ordinal")).distinct()
    later = heads.withColumns({"ordinal": F.lit(1), "section_path": F.lit("Later")})
    return B.aligned(rows, heads.unionByName(later)).select("doc_id", "block_ordinal", "section_path")


@query("SELECT source, count(*) AS n FROM (SELECT source FROM documents UNION ALL SELECT CAST(page_id % 3 AS VARCHAR) FROM pages UNION ALL SELECT source FROM documents) GROUP BY source")
def set_02_appended(spark, sf):
    d = table(spark, sf, "documents").select("source")
    return S.appended(d, table(spark, sf, "pages").select((F.col("page_id") % 3).cast("string").alias("source")), d).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_custkey, list(o_orderpriority ORDER BY k) AS kinds FROM (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS k FROM orders GROUP BY ALL) GROUP BY o_custkey")
def set_05_ordered_distinct(spark, sf):
    rows = table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))).alias("l"))
    return rows.select("o_custkey", S.in_first_order(F.transform("l", lambda x: x["o_orderpriority"])).alias("kinds"))


@query("SELECT event_type AS category, props AS content FROM events WHERE NOT contains(props, '3') UNION ALL SELECT 'preference', 'tea'")
def set_06_memory(spark, sf):
    memory = table(spark, sf, "events").select(F.col("event_type").alias("category"), F.col("props").alias("content"), F.col("ts").alias("created_at"))
    return S.remembered(S.forgotten(S.forgotten(memory, "3"), ""), F.lit("whim"), F.lit("tea"), F.current_timestamp()).select("category", "content")


@query(
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 45 THEN 'end' WHEN l_linenumber % 3 > 0 THEN 'generate' WHEN l_partkey % 4 >= 2 THEN 'end' ELSE 'transform_query' END AS after_documents,
CASE WHEN l_quantity > 45 THEN 'end' WHEN l_partkey % 3 > 0 AND l_suppkey % 2 = 0 THEN 'end' WHEN l_partkey % 3 = 0 THEN CASE WHEN l_linenumber < 2 THEN 'generate' ELSE 'end' END WHEN l_partkey % 4 < 2 THEN 'transform_query' ELSE 'end' END AS after_generation FROM lineitem"""
)
def agt_17_loop_edges(spark, sf):
    error, tries = F.when(F.col("l_quantity") > 45, "broken"), F.col("l_partkey") % 4
    after = answer.after_generation(error, F.when(F.col("l_partkey") % 3 > 0, True), F.col("l_suppkey") % 2 == 0, F.col("l_linenumber"), tries)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", answer.after_documents(error, F.col("l_linenumber") % 3, tries).alias("after_documents"), after.alias("after_generation"))


@query(
    f"""WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k, role, trim(text, {_trim}) AS text FROM conversations),
u AS (SELECT conv_id, 0 AS place, 'title' AS block_type, 'Conversation ' || conv_id AS text, 1 AS level FROM t WHERE k = 0
UNION ALL SELECT conv_id, 3 * k + 1, 'section_header', role || ' ' || k, 2 FROM t UNION ALL SELECT conv_id, 3 * k + 2, 'paragraph', text, 0 FROM t WHERE text <> '' UNION ALL SELECT conv_id, 3 * k + 3, 'code', '```' || chr(10) || role || chr(10) || '```', 0 FROM t)
SELECT conv_id AS doc_id, (row_number() OVER (PARTITION BY conv_id ORDER BY place) - 1)::INT AS block_ordinal, block_type, text, level FROM u"""
)
def flw_01_markdown_blocks(spark, sf):
    """Conversations as Markdown: a title, and for each turn a heading, its text and a fenced block."""
    turns = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    each = F.transform("t", lambda t, k: F.concat(F.lit("\n\n## "), t["role"], F.lit(" "), k.cast("string"), F.lit("\n"), t["text"], F.lit("\n\n```\n"), t["role"], F.lit("\n```")))
    docs = turns.select(F.col("conv_id").alias("doc_id"), F.concat(F.lit("# Conversation "), F.col("conv_id").cast("string"), F.array_join(each, "")).alias("text"))
    return B.markdown_blocks(docs).select("doc_id", "block_ordinal", "block_type", "text", "level")


_clean = f"trim(regexp_replace(regexp_replace(text, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), {_trim})"


@query(
    f"""WITH d AS (SELECT doc_id, {_clean} AS c FROM documents),
p AS (SELECT doc_id, n AS p_no, trim(p, {_trim}) AS p FROM (SELECT doc_id, unnest(l) AS p, generate_subscripts(l, 1) AS n FROM (SELECT doc_id, regexp_split_to_array(c, '\\n\\s*\\n+') AS l FROM d))),
s AS (SELECT doc_id, p_no, n AS s_no, trim(s, {_trim}) AS s FROM (SELECT doc_id, p_no, unnest(l) AS s, generate_subscripts(l, 1) AS n FROM (SELECT doc_id, p_no, regexp_extract_all(p, '[^。！？；.!?;\\n]*[。！？；.!?;\\n]|[^。！？；.!?;\\n]+$') AS l FROM p WHERE p <> '' AND {_count("p")} > {MOST})) WHERE trim(s, {_trim}) <> ''),
h AS (SELECT doc_id, p_no, s_no, unnest(l) AS text, generate_subscripts(l, 1) AS k FROM (SELECT doc_id, p_no, s_no, {_slices("s", MOST)} AS l FROM s WHERE {_count("s")} > {MOST})),
u AS (SELECT doc_id, p_no, 0 AS s_no, 0 AS k, {_count("p")} AS n FROM p WHERE p <> '' AND {_count("p")} <= {MOST} UNION ALL SELECT doc_id, p_no, s_no, 0, {_count("s")} FROM s WHERE {_count("s")} <= {MOST} UNION ALL SELECT doc_id, p_no, s_no, k, {_count("text")} FROM h),
g AS (SELECT doc_id, list([n] ORDER BY p_no, s_no, k) AS l FROM u GROUP BY doc_id)
SELECT doc_id, CASE WHEN c = '' THEN [] ELSE list_reduce(l, lambda a, x: CASE WHEN a[-1] + x[1] > {MOST} THEN list_concat(a, x) ELSE list_concat(a[:-2], [a[-1] + x[1]]) END) END AS sizes FROM d LEFT JOIN g USING (doc_id)"""
)
def txt_19_piece_sizes(spark, sf):
    """How many tokens each piece of a text has, packed greedily from its units."""
    pieces = X.split_text("text", MOST)
    return table(spark, sf, "documents").select("doc_id", F.transform(pieces, lambda p: X.estimated_tokens(p["text"]).cast("long")).alias("sizes"))


@query(
    f"""WITH s AS (SELECT conv_id, turn, list_reverse(list_filter(list_transform(regexp_extract_all(text, '[^。！？；.!?;\\n]*[。！？；.!?;\\n]|[^。！？；.!?;\\n]+$'), lambda x: trim(x, {_trim})), lambda x: x <> '')) AS l, text FROM conversations),
n AS (SELECT *, list_transform(l, lambda x: {_count('x')}) AS c FROM s),
k AS (SELECT *, len(list_filter(range(1, len(c) + 1), lambda i: list_sum(c[1:i]) <= {MOST})) AS whole FROM n)
SELECT conv_id, turn, CASE WHEN whole > 0 THEN list_reduce(list_reverse(l[1:whole]), lambda a, b: CASE WHEN contains('。！？；.!?;', right(a, 1)) OR contains('，。！？；：、,.!?;:%)]}}', left(b, 1)) THEN a || b ELSE a || ' ' || b END)
ELSE {_joined(f"regexp_extract_all(text, {_token})[-{MOST}:]")} END AS overlap FROM k"""
)
def txt_17_trailing_overlap(spark, sf):
    """The end of each turn that the next piece would begin with."""
    return table(spark, sf, "conversations").select("conv_id", "turn", X.trailing_overlap("text", MOST).alias("overlap"))


@query("SELECT conv_id || '-' || turn AS child_id, CAST(conv_id AS VARCHAR) AS parent_id, CAST(conv_id % 10 AS VARCHAR) AS doc_id, CASE WHEN conv_id % 7 > 0 THEN CAST(conv_id AS INT) END AS parent_index, CAST(turn AS INT) AS child_index, text AS embedding_text FROM conversations")
def src_23_search_documents(spark, sf):
    c = table(spark, sf, "conversations")
    conv = F.col("conv_id").cast("string")
    kids = c.select(F.concat_ws("-", "conv_id", "turn").alias("child_id"), conv.alias("parent_id"), (F.col("conv_id") % 10).cast("string").alias("doc_id"), F.col("turn").cast("int").alias("child_index"), F.col("text").alias("embedding_text"), F.lit(None).cast("map<string,string>").alias("metadata"))
    parents = c.where("conv_id % 7 > 0").select(conv.alias("parent_id"), F.col("conv_id").cast("int").alias("parent_index")).distinct()
    return search_documents(kids, parents).drop("metadata")


@query("SELECT c_custkey, c_name, o_orderkey FROM customer JOIN (SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey ORDER BY o_orderkey DESC LIMIT 1) ON c_custkey = o_custkey")
def src_20_point(spark, sf):
    """The one customer of the last order, looked up by key."""
    last = table(spark, sf, "orders").agg(F.max_by("o_custkey", "o_orderkey").alias("k"), F.max("o_orderkey").alias("o_orderkey")).first()
    return point(table(spark, sf, "customer"), "c_custkey", last.k).select("c_custkey", "c_name", F.lit(last.o_orderkey).alias("o_orderkey"))


def _turn_numbers(summary: str, messages: list) -> str:
    return ",".join(filter(None, [summary, *(f"{turn}:{len(text)}" for turn, _, text in messages)]))


@query("WITH t AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations), s AS (SELECT *, CASE WHEN n > 4 THEN n - 2 ELSE 0 END AS done FROM t) SELECT conv_id, any_value(n) AS messages, any_value(done) AS summary_message_count, coalesce(string_agg(turn || ':' || length(text), ',' ORDER BY pos) FILTER (pos < done), '') AS summary, coalesce(list(turn ORDER BY pos) FILTER (pos >= done), []) AS recent FROM s GROUP BY conv_id")
def agt_12_conversation_state(spark, sf):
    """Each conversation's summary and recent turns, message by message, as a stream of them keeps it."""
    rows = conversations.replayed(table(spark, sf, "conversations"), _turn_numbers, threshold=4, keep=2)
    return rows.withColumn("recent", F.transform("recent", lambda m: m["turn"]))
