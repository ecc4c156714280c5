"""Only texts that composition can change are sent to Python."""

from pyspark.sql import functions as F

from quirework.functions import text as X


def test_plain_texts_stay_in_the_jvm(spark):
    rows = spark.createDataFrame([(1, "plain"), (2, "ﬁne"), (3, None), (4, "")], "k long, text string").repartition(2)
    found = rows.select("k", X.nfkc("text").alias("t"))
    assert {(r.k, r.t) for r in found.collect()} == {(1, "plain"), (2, "fine"), (3, ""), (4, "")}
    # the argument is null for plain texts
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    call = plan[plan.index("compose(") :]
    assert "ArrowEvalPython" in plan and ("CASE WHEN" in call[:200] or "CASE WHEN" in plan.split("ArrowEvalPython")[1])
