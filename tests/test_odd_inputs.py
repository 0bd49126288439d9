"""Inputs on which queries once differed from their SQL."""

import duckdb
from pyspark.sql import functions as F

from skein.operators import stories
from skein.plans import registry

# Letters beyond ASCII border words of ASCII; the long s and the Kelvin sign are an s and a k in another case.
LINES = ["Inözust keit", "inözust", "In der", "ein", "xdeals", "dealſ", "ädeal", "deal_", "of theß", "of the", "the thé", "", "the\nIn"]


def _both(spark, tmp_path, name):
    spark.createDataFrame(list(enumerate(LINES)) + [(99, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = registry.queries()[name](spark, str(tmp_path)).collect()
    return sorted(tuple(r) for r in got), sorted(con.sql(registry.oracle_sql()[name]).fetchall())


def test_exclude_pattern_counts_with_letters_beyond_ascii(spark, tmp_path):
    got, want = _both(spark, tmp_path, "exclude_pattern_counts")
    assert got == want and dict(got)["^in\\b"] == 3


def test_exclude_patterns_with_letters_beyond_ascii(spark, tmp_path):
    got, want = _both(spark, tmp_path, "exclude_patterns")
    assert got == want and (0,) not in got and (5,) not in got and (99,) in got


# A dotless i and a dotted I are no i in another case.
TURKISH = ["\u0131n der", "\u0130n der", "In der", "\u0130N der", "iN", "x", None]


def test_exclude_patterns_with_dotless_and_dotted_i(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TURKISH)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("exclude_patterns", "exclude_pattern_counts"):
        got = registry.queries()[name](spark, str(tmp_path)).collect()
        assert sorted(map(tuple, got)) == sorted(con.sql(registry.oracle_sql()[name]).fetchall())


def test_classes_of_letters_match_as_in_re2(spark):
    rows = [("\u0131",), ("\u0130",), ("i",), ("I",), ("\u017f",), ("k",), ("\u212a",), ("\u00e4",), ("b",), ("_",)]
    df, con = spark.createDataFrame(rows, "t string"), duckdb.connect()
    for p in (r"^[a-z]$", r"^[^i]$", r"^[h-j]$", r"^i$", r"^[is]$", "^\u00c4$", r"^\b[ik]", r"(?:^i)|^k$"):
        got = [r[0] is not None for r in df.select(stories.first_pattern(F.col("t"), [p])).collect()]
        assert got == [con.execute("SELECT regexp_matches(?, ?)", [t, f"(?i){p}"]).fetchone()[0] for (t,) in rows], p
