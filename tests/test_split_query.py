"""The query of split texts on null texts and long chains; whole texts that fit though their units seem not to; many pieces."""

import duckdb
from pyspark.sql import functions as F

from quirework.functions import text as X
from quirework.plans import queries_text
from quirework.plans.catalog import SQL


def test_odd_texts_keep_the_invariants(spark, tmp_path):
    # a chain of words is one token, however long
    texts = [None, "", " \n", "a-" * 50000, "a-b'c_" * 20000 + "d. " + "One two. " * 100, "- " * 500, "数据。" * 100, "x\x1c" * 300, "٣.٤ " * 90, "word " * 400 + "\n\n" + "(a) [b] {c} " * 90]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    found = sorted(tuple(r) for r in queries_text.txt_19_split_invariants(spark, str(tmp_path)).select("doc_id", "fits", "whole").collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM read_parquet('{next((tmp_path / 'documents.parquet').glob('*.parquet'))}')")
    assert found == sorted(con.execute(SQL["txt_19_split_invariants"]).fetchall())


def split(spark, text, most, overlap=0):
    return [tuple(p) for p in spark.createDataFrame([(text,)], "text string").select(X.split_text("text", most, overlap).alias("p")).first().p]


def test_a_text_that_fits_stays_whole(spark):
    # sentences cut the numbers, so that units have three times the tokens of the whole
    assert split(spark, "٣.٤ ٣.٤ ٣.٤ ٣.٤", 4) == [("٣.٤ ٣.٤ ٣.٤ ٣.٤", "within_limit")]
    assert split(spark, "a b\n\nc d", 4) == [("a b\n\nc d", "within_limit")]
    assert split(spark, "a b\n\nc d", 3) == [("a b", "paragraph_boundary"), ("c d", "paragraph_boundary")]


def test_pieces_of_many_units(spark):
    text = "".join(f"w{k} x{k}. " for k in range(3000))
    pieces = split(spark, text, 30)
    assert len(pieces) == 300 and {r for _, r in pieces} == {"sentence_boundary"}
    assert pieces[1][0] == "".join(f"w{k} x{k}." for k in range(10, 20))
    # each piece begins with the last sentence of the one before
    lapped = split(spark, text, 30, 3)
    assert all(b.startswith(a[a[:-1].rfind(".") + 1 :]) for (a, _), (b, _) in zip(lapped, lapped[1:]))


def test_joined_at_once_as_one_by_one(spark):
    parts = ["", "a", "b", "", "(c", "d)", ", e", "。", "数", "f", "《g", "数据", "h.", "i", "!", "j", ""]
    one_by_one = F.lit("")
    for part in parts:
        one_by_one = X.join_text(one_by_one, F.lit(part))
    got = spark.range(1).select(X.join_stripped(F.array(*map(F.lit, parts))).alias("at_once"), one_by_one.alias("one_by_one")).first()
    assert got.at_once == got.one_by_one == "a b (c d), e。数f 《g数据h.i!j"


def test_short_texts_are_stripped_as_others(spark):
    rows = spark.createDataFrame([(c, f"{c}{c}a{c}b{c}") for c in map(chr, range(0x10000)) if not 0xD800 <= ord(c) < 0xE000], "c string, text string")
    assert rows.where(X.strip("text") != X.strip_short(F.col("text"))).count() == 0
    assert rows.where(F.length(X.strip_short(F.col("text"))) == 3).count() == 29
