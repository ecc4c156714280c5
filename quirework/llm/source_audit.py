"""Source divergence audit: how far the term probabilities of a source's texts lie from its language's, and from other sources'.

Terms are runs of letters A-Z, a-z and of non-ASCII characters; a language keeps those in at least LEAST_DOCS of its
documents. p of a term in a group (lang, source) and q in its language are exact integers,
1 + floor(SCALE * (count + 5) / (N + 5 * V)), by long division in base 1000.

Two readings of the texts: the first counts documents of each (lang, term), by a task first and then by a shuffle;
the second counts occurrences of kept terms in each group. Kept terms are sent to the tasks if there are at most
MOST_SENT of them, and else joined, with the same result.

`term`, by upper bounds: the terms of a group that occur in it fall into buckets of nearly equal counts; the largest
p and the smallest q of a bucket bound its differences p - q. Buckets are opened best bound first until they hold
``top`` terms, for all groups at once; the top-th difference found so far is the bar, and a second round opens the
buckets whose bound isn't strictly below it. What stays closed can't enter the list, ties included.

`pair`, by postings: f(s, t) = sum |p_s - p_t| over all kept terms is what it were if neither had any term, plus a
correction for each source's own terms against the other's p of an absent term (from the numbers of terms of each p,
as p follows from the count), plus, from each term's posting list, a correction for the terms that both have. The
last is summed in matrices of BLOCK by BLOCK sources in each task. No row is made for a pair and a term.

Defined cases: null text, lang and source are ''; a group without terms (all p as of count 0) and a language without
kept terms (pairs of value 0, no `term` rows) take part; a language's only source has no pair; repeated rows count
as documents of their own; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import prepare_workers, scratch, written

LEAST_DOCS, SCALE, TOP = 30, 10**9, 50
#: Kept terms, or groups, up to which a table of them is sent to all tasks; entries of a task's table of counts; sources in a block.
MOST_SENT, MOST_HELD, BLOCK = 500_000, 2_000_000, 256
#: Bytes of a text that are cut at once.
STEP = 1 << 20
#: ASCII letters, lower-cased, and bytes of other characters stay; all else is white space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes):
    """The terms of a text, in lists."""
    at = 0
    while at < len(text):
        stop = at + STEP
        if stop < len(text):
            part = text[at : stop + 1].translate(FOLD)
            if (cut := part.rfind(b" ")) <= 0:  # one term over the whole step
                while stop < len(text) and text[stop : stop + 1].translate(FOLD) != b" ":
                    stop += 1
            else:
                stop = at + cut
        yield text[at:stop].translate(FOLD).split()
        at = stop


def _groups(batch):
    """(lang, source, text) of rows, null as empty."""
    import pyarrow as pa

    columns = [batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.large_binary()).to_pylist()]
    return ((a or "", b or "", c or b"") for a, b, c in zip(*columns))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.col(c).cast("string").alias(c) for c in ("lang", "source", "text")))


def document_counts(docs: DataFrame) -> DataFrame:
    """lang, term and docs, the number of documents with it, of each part of the rows that a task holds at once."""

    def run(batches):
        import pyarrow as pa

        held: dict[str, Counter] = defaultdict(Counter)

        def found():
            for lang, counts in held.items():
                terms = pa.array(list(counts), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), terms, pa.array(list(counts.values()), pa.int64())], ["lang", "term", "docs"])
            held.clear()

        for batch in batches:
            for lang, _, text in _groups(batch):
                own: set[bytes] = set()
                for some in words(text):
                    own.update(some)
                held[lang].update(own)
            if sum(map(len, held.values())) > MOST_HELD:
                yield from found()
        yield from found()

    return _rows(docs).mapInArrow(run, "lang string, term string, docs long")


def occurrences(docs: DataFrame, known: dict[str, list[str]] | None) -> DataFrame:
    """lang, source, term, n of parts of the rows; for each group also a row without a term. known: kept terms; None: all terms."""
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        import pyarrow as pa

        at = {lang: {t.encode(): k for k, t in enumerate(terms)} for lang, terms in (sent.value or {}).items()}
        every: dict[tuple, Counter] = defaultdict(Counter)
        numbers: dict[tuple, list] = defaultdict(list)
        counts: dict[tuple, np.ndarray] = {}

        def count(group):
            part = np.bincount(np.array(numbers.pop(group), np.int32), minlength=len(at.get(group[0], ())) + 1)
            counts[group] = counts[group] + part if group in counts else part

        def found():
            for group in list(numbers):
                count(group)
            for (lang, source), made in [*every.items(), *counts.items()]:
                if isinstance(made, Counter):
                    terms, n = pa.array(list(made), pa.binary()).cast(pa.string()), list(made.values())
                else:
                    some = np.flatnonzero(made[:-1])
                    terms, n = pa.array([known_terms[lang][k] for k in some.tolist()], pa.string()), made[some]
                terms = pa.concat_arrays([pa.nulls(1, pa.string()), terms])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), terms, pa.array([0, *n], pa.int64())], ["lang", "source", "term", "n"])
            every.clear()
            counts.clear()

        known_terms = sent.value or {}
        for batch in batches:
            size = 0
            for lang, source, text in _groups(batch):
                if sent.value is None:
                    for some in words(text):
                        every[lang, source].update(some)
                    every[lang, source]  # the group is there even without a term
                    continue
                own, get = numbers[lang, source], at.get(lang, {}).get
                for some in words(text):
                    own.extend(k for k in map(get, some) if k is not None)
                    if len(own) > STEP:
                        count((lang, source))
                        own = numbers[lang, source]
            size = sum(map(len, every.values())) + sum(map(len, counts.values())) + sum(map(len, numbers.values()))
            if size > 4 * MOST_HELD:
                yield from found()
        yield from found()

    return _rows(docs).mapInArrow(run, "lang string, source string, term string, n long")


def counted(docs: DataFrame, least_docs: int, most_sent: int) -> tuple[DataFrame, DataFrame]:
    """(lang, source, term, n of kept terms, and a row of null term for each group; lang, term of kept terms)."""
    kept = written(document_counts(docs).groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).select("lang", "term"), "kept-terms")
    known = None
    if kept.count() <= most_sent:
        known = defaultdict(list)
        for r in kept.collect():  # at most most_sent terms
            known[r.lang].append(r.term)
    parts = occurrences(docs, known)
    if known is None:
        parts = parts.where("term IS NULL").unionByName(parts.where("term IS NOT NULL").join(kept, ["lang", "term"], "left_semi"))
    return written(parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n")), "term-counts"), kept


def scaled(n: Column, total: Column) -> Column:
    """1 + floor(SCALE * n / total) in whole numbers, three decimal digits at a time."""
    total = F.greatest(total, F.lit(1).cast("long"))
    div = lambda a, b: F.call_function("div", a, b)
    whole, rest = div(n, total), n % total
    for _ in range(3):
        whole, rest = whole * 1000 + div(rest * 1000, total), rest * 1000 % total
    return whole + 1


def small(table: DataFrame, most: int) -> DataFrame:
    """A written table, to be broadcast if it has at most ``most`` rows."""
    return F.broadcast(table) if table.count() <= most else table


def group_table(counts: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, k (number of the source in its language), total (N), lang_total, terms (V), absent (p of count 0; 0 if V is 0)."""
    groups = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    by_lang = groups.groupBy("lang").agg(F.sum("total").alias("lang_total")).join(kept.groupBy("lang").agg(F.count("*").alias("terms")), "lang", "left").fillna(0, ["terms"])
    number = (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("int")
    groups = groups.withColumn("k", number).join(by_lang, "lang")
    five = F.lit(5).cast("long")
    return groups.withColumn("absent", F.when(F.col("terms") > 0, scaled(five, F.col("total") + 5 * F.col("terms"))).otherwise(0))


def probabilities(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, term, k, n, p, q and absent of each kept term that occurs in the group."""
    total = F.sum("n").over(Window.partitionBy("lang", "term"))  # a term's rows are as many as its sources
    rows = counts.where("term IS NOT NULL").withColumn("lang_n", total).join(groups, ["lang", "source"])
    five_v = 5 * F.col("terms")
    return rows.select("lang", "source", "term", "k", "n", scaled(F.col("n") + 5, F.col("total") + five_v).alias("p"), scaled(F.col("lang_n") + 5, F.col("lang_total") + five_v).alias("q"), "absent")


# --- term -----------------------------------------------------------------------------------------


def leading_terms(entries: DataFrame, top: int, most_sent: int) -> DataFrame:
    """lang, source, item, value, rank of the ``top`` terms of largest p - q above 0 in each group."""
    group = ["lang", "source"]
    # counts below 64 one by one, beyond that eight buckets for each doubling
    entries = entries.withColumn("bucket", F.when(F.col("n") < 64, F.col("n")).otherwise(F.floor(F.log2(F.col("n").cast("double")) * 8) + 64).cast("int"))
    buckets = entries.groupBy(*group, "bucket").agg((F.max("p") - F.min("q")).alias("bound"), F.count("*").alias("terms")).where("bound > 0")
    buckets = written(buckets, "count-buckets")
    best_first = Window.partitionBy(*group).orderBy(F.desc("bound"), "bucket").rowsBetween(Window.unboundedPreceding, -1)
    opened = written(buckets.withColumn("before", F.coalesce(F.sum("terms").over(best_first), F.lit(0))).withColumn("first", F.col("before") < top), "opened")
    in_order = Window.partitionBy(*group).orderBy(F.desc("value"), "item")

    def evaluated(some: DataFrame) -> DataFrame:
        rows = entries.join(small(some.select(*group, "bucket"), most_sent), [*group, "bucket"], "left_semi").where("p > q")
        ranked = rows.select(*group, F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value")).withColumn("rank", F.row_number().over(in_order))
        return ranked.where(F.col("rank") <= top)

    first = written(evaluated(opened.where("first")), "first-terms")
    bar = first.where(F.col("rank") == top).select(*group, F.col("value").alias("bar"))
    more = opened.where("NOT first").join(bar, group, "left").where(F.col("bound") >= F.coalesce("bar", F.lit(1)))
    more = written(more.select(*group, "bucket"), "second-round")
    both = first.drop("rank").unionByName(evaluated(more).drop("rank"))
    return both.withColumn("rank", F.row_number().over(in_order)).where(F.col("rank") <= top)


# --- pair -----------------------------------------------------------------------------------------


def shared_terms(entries: DataFrame) -> DataFrame:
    """lang, i < j (numbers of sources) and the correction for terms that both have."""
    prepare_workers(entries.sparkSession)
    postings = entries.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("k", "p", "absent"))).alias("posts"))

    def run(batches):
        import pyarrow as pa

        sums: dict[tuple, np.ndarray] = {}

        def found():
            for (lang, a, b), block in sums.items():
                i, j = np.nonzero(block)
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(i)), pa.array((i + a * BLOCK).astype(np.int32)), pa.array((j + b * BLOCK).astype(np.int32)), pa.array(block[i, j])], ["lang", "i", "j", "more"])
            sums.clear()

        for batch in batches:
            lists = batch.column(1)
            stops, flat = lists.offsets.to_numpy(), lists.values
            k, p, absent = (flat.field(c).to_numpy(zero_copy_only=False) for c in range(3))
            for lang, start, stop in zip(batch.column(0).to_pylist(), stops[:-1].tolist(), stops[1:].tolist()):
                if stop - start < 2:
                    continue
                blocks = np.split(np.arange(start, stop), np.flatnonzero(np.diff(k[start:stop] // BLOCK)) + 1)
                for x, rows in enumerate(blocks):
                    for columns in blocks[x:]:
                        p1, p2, a1, a2 = p[rows, None], p[None, columns], absent[rows, None], absent[None, columns]
                        block = sums.setdefault((lang, int(k[rows[0]]) // BLOCK, int(k[columns[0]]) // BLOCK), np.zeros((BLOCK, BLOCK), np.int64))
                        more = abs(p1 - p2) - abs(p1 - a2) - abs(a1 - p2) + abs(a1 - a2)
                        block[(k[rows] % BLOCK)[:, None], k[columns] % BLOCK] += np.where(k[rows][:, None] < k[columns], more, 0)
                if len(sums) > 64:  # 32 MB
                    yield from found()
        yield from found()

    parts = postings.select("lang", "posts").mapInArrow(run, "lang string, i int, j int, more long")
    return parts.groupBy("lang", "i", "j").agg(F.sum("more").alias("more"))


def source_pairs(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value, rank: each other source of the language."""
    heights = entries.groupBy("lang", "source", "p").agg(F.count("*").alias("terms")).groupBy("lang", "source").agg(F.collect_list(F.struct("p", "terms")).alias("heights"))
    sides = groups.select("lang", "source", "k", "absent", F.col("terms").alias("v")).join(heights, ["lang", "source"], "left")
    sides = written(sides.withColumn("heights", F.coalesce("heights", F.array().cast(sides.schema["heights"].dataType))), "sides")
    # each pair once, in blocks of the second source
    last = F.max("k").over(Window.partitionBy("lang"))
    left = sides.withColumn("last", last).withColumn("block", F.explode(F.expr(f"sequence(k - k % {BLOCK}, last - last % {BLOCK}, {BLOCK})"))).drop("last")
    right = sides.select("lang", (F.col("k") - F.col("k") % BLOCK).alias("block"), *(F.col(c).alias(f"{c}_2") for c in ("source", "k", "absent", "heights")))
    pairs = left.join(right, (left.lang == right.lang) & (left.block == right.block) & (F.col("k") < F.col("k_2"))).drop(right.lang, right.block)
    none = F.abs(F.col("absent") - F.col("absent_2"))
    own = lambda heights, other: F.aggregate(heights, F.lit(0).cast("long"), lambda s, h: s + h["terms"] * (F.abs(h["p"] - F.col(other)) - none))
    pairs = pairs.select("lang", "source", "source_2", F.col("k").alias("i"), F.col("k_2").alias("j"), (F.col("v") * none + own("heights", "absent_2") + own("heights_2", "absent")).alias("apart"))
    pairs = pairs.join(shared_terms(entries), ["lang", "i", "j"], "left").withColumn("value", F.col("apart") + F.coalesce("more", F.lit(0)))
    ways = F.explode(F.array(F.struct("source", F.col("source_2").alias("item")), F.struct(F.col("source_2").alias("source"), F.col("source").alias("item"))))
    rows = pairs.select("lang", "value", ways.alias("way")).select("lang", "way.source", "way.item", "value")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, most_sent: int = MOST_SENT) -> DataFrame:
    """lang, source, part (`pair` or `term`), item, value, rank."""
    prepare_workers(docs.sparkSession)
    with scratch(docs.sparkSession) as keep:
        counts, kept = counted(docs, least_docs, most_sent)
        groups = written(group_table(counts, kept), "groups")
        entries = written(probabilities(counts, small(groups, most_sent)), "term-probabilities")
        terms = keep(written(leading_terms(entries, top, most_sent), "leading-terms"))
        pairs = keep(written(source_pairs(entries, groups), "source-pairs"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(columns).unionByName(terms.withColumn("part", F.lit("term")).select(columns))


ORACLE = r"""
WITH docs AS (
    SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), words AS (
    SELECT row_id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), kept AS (
    SELECT lang, term, count(*)::HUGEINT AS n FROM words GROUP BY ALL HAVING count(DISTINCT row_id) >= 30
), langs AS (
    SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang
), counts AS (
    SELECT lang, source, term, count(*)::HUGEINT AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL
), sources AS (
    SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS total
    FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN counts c USING (lang, source) GROUP BY ALL
), shares AS (
    SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n,
        1 + 1000000000 * (coalesce(c.n, 0) + 5) // (s.total + 5 * l.v) AS p, 1 + 1000000000 * (k.n + 5) // (l.total + 5 * l.v) AS q
    FROM sources s JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term
), pairs AS (
    SELECT a.lang, a.source, b.source AS item, coalesce((
        SELECT sum(abs(x.p - y.p)) FROM shares x JOIN shares y USING (lang, term) WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0)::BIGINT AS value
    FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source
), ranked AS (
    SELECT lang, source, 'pair' AS part, item, value FROM pairs
    UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM shares WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, rank::INT AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM ranked)
WHERE part = 'pair' OR rank <= 50
"""
