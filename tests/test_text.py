import pytest
from pyspark.sql import functions as F

from quirework.functions import predicates as P, text as X
from quirework.operators import chunks
from quirework.plans import assistant, research


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "text,most,want",
    [
        ("a b. c d. e f.", 4, [("a b.", "sentence_boundary"), ("c d.", "sentence_boundary"), ("e f.", "sentence_boundary")]),
        ("a b. c d. e f.", 6, [("a b.c d.", "sentence_boundary"), ("e f.", "sentence_boundary")]),
        ("a b c", 3, [("a b c", "within_limit")]),
        ("", 3, []),
        ("one two three four five six", 4, [("one two three four", "hard_limit"), ("five six", "hard_limit")]),
        ("p one\n\np two\n\np three", 4, [("p one p two", "paragraph_boundary"), ("p three", "paragraph_boundary")]),
        ("光学相干。应变测量。结果很好。", 6, [("光学相干。", "sentence_boundary"), ("应变测量。", "sentence_boundary"), ("结果很好。", "sentence_boundary")]),
    ],
)
def test_split(spark, text, most, want):
    assert [tuple(p) for p in one(spark, X.split_text(F.lit(text), most))] == want


def test_split_with_overlap(spark):
    got = [tuple(p) for p in one(spark, X.split_text(F.lit("a b. c d. e f. g h."), 6, 3))]
    assert got == [("a b.c d.", "sentence_boundary"), ("c d.e f.", "sentence_boundary"), ("e f.g h.", "sentence_boundary")]
    for text, most, overlap in (("x " * 40, 7, 3), ("one two. " * 20, 9, 5), ("é" * 30, 5, 2)):
        pieces = one(spark, X.split_text(F.lit(text), most, overlap))
        assert all(one(spark, X.estimated_tokens(F.lit(p.text))) <= most for p in pieces)


@pytest.mark.parametrize("text,n", [("3.14", 3), ("étion", 2), ("don't stop", 2), ("光学 OCT-A", 3), ("", 0), ("a_b-c's", 1), ("...", 3)])
def test_tokens(spark, text, n):
    assert one(spark, X.estimated_tokens(F.lit(text))) == n


def test_search_tokens(spark):
    text = "PhS-OCE 应变测量 strain-estimation  应变"
    assert one(spark, X.search_tokens(F.lit(text), terms=["应变", "OCE"])) == ["phs-oce", "strain-estimation", "应变", "应变", "oce", *"应变测量应变", "应变", "变测", "测量", "应变"]
    assert one(spark, X.search_tokens(F.lit("Ab c"), tokenizer="other", bigrams=False)) == ["ab", "c", "ab", "c"]


def test_text_helpers(spark):
    join = lambda a, b: one(spark, X.join_text(F.lit(a), F.lit(b)))
    assert [join("a.", "b"), join("a", "b"), join("a", ", b"), join("数", "b"), join("", " b "), join("a ", "")] == ["a.b", "a b", "a, b", "数b", "b", "a"]
    assert one(spark, X.trailing_overlap(F.lit("One two. Three. Four five six."), 5)) == "Four five six."
    assert one(spark, X.trailing_overlap(F.lit("a b c d e f"), 2)) == "e f"
    assert one(spark, X.join_tokens(F.array(*map(F.lit, ["a", "(", "b", ")", ",", "数", "c"])))) == "a (b),数c"
    assert one(spark, X.normalize_scientific(F.lit("ﬁne inter-\nnal\t x"))) == "fine internal x"
    assert one(spark, X.list_items(F.lit("1. one\n- two\n以下 x\n3) three"), 2)) == ["one", "two"] == research.items("1. one\n- two\n以下 x\n3) three", 2)
    assert one(spark, X.list_items(F.lit("以下；a。b"), 5)) == research.items("以下；a。b", 5)
    front = one(spark, X.front_matter(F.lit('---\ntitle: "T: x"\na: 1\na: 2\n---\nbody')))
    assert front.body == "body" and front.metadata == {"title": "T: x", "a": "2"}
    assert one(spark, X.front_matter(F.lit("no fence"))).body == "no fence"
    assert one(spark, X.mojibake_score(F.lit("clean text"))) == 0 and one(spark, X.mojibake_score(F.lit("(cid:123)�\x02算"))) == 5
    assert one(spark, X.stable_id("p", F.lit("a"), F.lit(None), F.lit(3))) == "p_" + __import__("hashlib").sha256(b"a\nNone\n3").hexdigest()[:24]


@pytest.mark.parametrize("text,path,want", [("A plain text of a body.", "Body", None), ("x", "Paper > References", "reference_section"), ("  ", "", "empty"), ("January 2020", "", "front_matter_or_header"), ("Supplement DOI: 10.1/x, Creative Commons Attribution", "", "front_matter_or_header"), ("[1] A. B et al., doi: 1.\n[2] C. D et al., doi: 2.\n[3] E et al., x. And some more words here to be long.", "", "bibliography_like"), ("Supplement published results and methods of the experiment", "", None)])
def test_drop_reason(spark, text, path, want):
    assert one(spark, P.drop_reason(F.lit(text), F.lit(path))) == want


@pytest.mark.parametrize("text,files", [("介绍BNN的原理", False), ("计算 strain", False), ("strain", True), ("vector strain", False), ("最新 论文 综述", False), ("本地知识库 phase", True), ("run the cnn", False), ("fragment", False), ("hello", False), ("what is strain, compute it", False)])
def test_route_rules_agree(spark, text, files):
    assert one(spark, P.route(F.lit(text), F.lit(files))) == assistant.route_of(text, files)


def test_merge_plan():
    s = lambda n, path, tokens, assets=False, body=True, level=1: {"number": n, "path": path, "level": level, "tokens": tokens, "assets": assets, "body": body}
    plan = lambda *rows: [(r["path"], r["numbers"]) for r in chunks.merge_plan(list(rows), 300, 1800)]
    assert plan(s(1, "Methods", 50), s(2, "Methods > Setup", 60, level=2)) == [("Methods", [1, 2])]
    assert plan(s(1, "A", 50), s(2, "B", 60)) == [("A", [1]), ("B", [2])]
    assert plan(s(1, "Intro", 400), s(2, "Untitled", 20)) == [("Intro", [1, 2])]
    assert plan(s(1, "T", 5, body=False), s(2, "T > A", 50), s(3, "T > B", 50)) == [("T > A", [1, 2]), ("T > B", [3])]
    assert plan(s(1, "Untitled", 20), s(2, "F", 0, assets=True, body=False)) == [("Untitled", [1]), ("F", [2])]
    assert plan(s(1, "A", 200), s(2, "A > B", 1700)) == [("A", [1]), ("A > B", [2])]
