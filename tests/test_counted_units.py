"""Units of a text carry their counts."""

from pyspark.sql import functions as F

from quirework.functions import text as X


def test_units_and_their_counts(spark):
    text = "One two three.\n\nFour five six seven eight. Nine ten eleven twelve thirteen fourteen fifteen!\n\nEnd"
    rows = spark.createDataFrame([(1, text), (2, ""), (3, None)], "k long, text string")
    found = {r.k: [(u.text, u.reason, u.n) for u in r.u] for r in rows.select("k", X.counted_units("text", 6).alias("u")).collect()}
    assert found[1] == [("One two three.", "paragraph_boundary", 4), ("Four five six seven eight.", "sentence_boundary", 6), ("Nine ten eleven twelve thirteen fourteen", "hard_limit", 6), ("fifteen!", "hard_limit", 2), ("End", "paragraph_boundary", 1)]
    assert [t for t, _, _ in found[2]] == [t for t, _, _ in found[3]] == [""]
