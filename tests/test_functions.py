"""Text and path functions: the rules' numbers and codes."""

import pytest
from pyspark.sql import functions as F

from siltstone.errors import EngineError
from siltstone.functions import paths as P
from siltstone.functions import text as X
from siltstone.operators import search as S


def column(spark, values, c):
    return [r.c for r in spark.createDataFrame([(v,) for v in values], "v string").select(c(F.col("v")).alias("c")).collect()]


@pytest.mark.parametrize("query,code", [("", "search_query_empty"), ("  \u3000 ", "search_query_empty"), ("ab", "search_query_too_short"), ("x" * 257, "search_query_too_long"), ("abc\x01d", "search_query_invalid")])
def test_query_codes(query, code):
    with pytest.raises(EngineError) as e:
        X.normalize_query(query)
    assert e.value.code == code and query not in repr(e.value) or query == ""


def test_query_is_collapsed():
    assert X.normalize_query("  本機 \u00a0\t檔案  搜尋 ") == "本機 檔案 搜尋"


@pytest.mark.parametrize(
    "fields,code",
    [
        ({"scope_id": 0}, "search_scope_invalid"), ({"folder_node_id": 3}, "search_folder_invalid"), ({"scope_id": 1, "folder_node_id": 0}, "search_folder_invalid"), ({"extension": "a b"}, "search_extension_invalid"),
        ({"modified_since_s": 5, "modified_before_s": 5}, "search_modified_range_invalid"), ({"modified_since_s": 2**62}, "search_modified_range_invalid"), ({"limit": 51}, "search_limit_out_of_range"), ({"limit": 0}, "search_limit_out_of_range"),
    ],
)
def test_request_codes(fields, code):
    with pytest.raises(EngineError) as e:
        S.check(S.Request("query", **fields))
    assert e.value.code == code


def test_request_defaults():
    c = S.check(S.Request("abc", extension=" .MD "))
    assert (c.limit, c.per_source, c.extension) == (20, 40, "md") and S.check(S.Request("abc", limit=50)).per_source == 100
    assert "secret" not in repr(S.Request("secret"))


def test_whitespace_and_trigrams(spark):
    assert column(spark, ["  a \u3000b\n c\u00a0"], X.collapse_whitespace) == ["a b c"]
    assert column(spark, ["aBcab", "日本語x", "ab", "", None], X.trigrams) == [["abc", "bca", "cab"], ["日本語", "本語x"], [], [], []]


def test_unicode_forms(spark):
    assert column(spark, ["e\u0301", None], X.nfc) == ["\u00e9", None]
    assert column(spark, ["E\u0301X"], X.version_component) == ["\u00e9x"]
    assert column(spark, [" e\u0301  x "], X.evaluation_text) == ["\u00e9 x"]
    assert column(spark, ["日本語", "abc"], lambda c: X.truncate_utf8(c, 7)) == ["日本", "abc"]


def test_snippet(spark):
    assert column(spark, ["0123456789 Needle after"], lambda c: X.snippet(c, "needle", before=4, after=3)) == ["789 [Needle] af"]


def test_token_edits(spark):
    df = spark.createDataFrame([("a b c", "a x c d"), ("", "a"), ("one", "one")], "e string, h string")
    assert [r.t for r in df.select(X.token_error_edits(F.col("e"), F.col("h")).alias("t")).collect()] == [2, 1, 0]
    cjk = spark.createDataFrame([("本機檔案", "本地檔")], "e string, h string")
    assert cjk.select(X.char_error_edits(F.col("e"), F.col("h")).alias("t")).head().t == 2


def test_containment_counts_segments(spark):
    df = spark.createDataFrame([("/a/b", "/a/b", True), ("/a/b/c", "/a/b", True), ("/a/bc", "/a/b", False), ("/a", "/", True), ("/a", "/a/b", False)], "c string, r string, want boolean")
    assert all(r.got == r.want for r in df.select(P.is_under(F.col("c"), F.col("r")).alias("got"), "want").collect())
    win = spark.createDataFrame([("C:\\a\\b", "C:\\a", True), ("C:\\ab", "C:\\a", False)], "c string, r string, want boolean")
    assert all(r.got == r.want for r in win.select(P.is_under(F.col("c"), F.col("r"), "\\").alias("got"), "want").collect())
    assert column(spark, ["a/b/c"], P.ancestors) == [["a", "a/b", "a/b/c"]]


def test_names(spark):
    assert column(spark, ["/x/y.md", "a\\b.txt", "n"], P.filename) == ["y.md", "b.txt", "n"]
    assert column(spark, ["x.PART", "x.crdownload", "x.download", "x.partial"], P.is_temporary_download) == [True, True, True, False]
    assert column(spark, ["a.MD", "a.rs", "a.pdf", "a.XLSX", "a.tif", "a.exe", "noext"], P.media_kind) == ["markdown", "source_code", "pdf", "office", "image", None, None]
    assert column(spark, ["Cargo.toml", "a.rs", "a.md", "a.csv", "a.png", "a.zzz"], P.category) == ["code", "code", "document", "data", "image", "other"]


def test_version_names(spark):
    got = column(spark, ["Plan-v2.MD", "plan_V10.md", "plan.v3.md", "plan v1", "plan.v2", "plan-v01.md", "plan-v1-v2.md", "a/plan-v1.md", "plan-final.md", "-v1.md", "plan-v1000000.md"], P.explicit_version)
    assert [tuple(x) if x else None for x in got] == [("plan", 2, "md"), ("plan", 10, "md"), ("plan", 3, "md"), ("plan", 1, ""), None, None, None, None, None, None, None]


def test_portable_names(spark):
    bad = ["", "a.", "a ", "a:b", "a/b", "NUL", "com1.txt", "x" * 256, "a\x07", ".."]
    assert column(spark, bad, P.portable_name) == [False] * len(bad)
    assert column(spark, ["a", "README.md", "com10.txt", "本機"], P.portable_name) == [True] * 4


def test_cell_references(spark):
    assert column(spark, ["A1", "XFD1048576", "XFE1", "A0", "A01", "a1", "AAAA1", "A1048577", "ZZ99"], P.cell_reference_valid) == [True, True, False, False, False, False, False, False, True]


def test_case_only(spark):
    df = spark.createDataFrame([("a", "A", True), ("a", "a", False), ("é", "É", False), ("a", "b", False)], "a string, b string, want boolean")
    assert all(r.g == r.want for r in df.select(P.case_only_rename(F.col("a"), F.col("b")).alias("g"), "want").collect())


def test_token_edits_of_very_many_tokens(spark):
    a, b = " ".join(f"a{i}" for i in range(9_000)), " ".join(f"a{i}" if i % 1_000 else "x" for i in range(9_000))
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(X.token_error_edits(F.col("a"), F.col("b")).alias("n")).head().n == 9
