"""Gates that settle each text in its row, against their forms over rows of many texts and against SQL."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from skein.operators import gates, site, texts
from skein.plans import evidence, registry

BENCH = "one two three four five six seven eight nine ten eleven twelve"
TEXTS = [
    BENCH + ". The sun rose. The sun rose. the sun set.",
    "x " + BENCH.upper() + " y\n" + "z " * 30,
    "The word the word. " * 12 + "\n\nThis other thing!\n\tThe end.",
    "A.\n\t\nThe b c.\n \tThe b d.\nThese ÉTÉ été. The été was",
    "```\nThe code. The code.\nfoo bar foo bar\n```\nThe code. ``` open\nThis fence",
    "A long first line that is by no means a heading as it has over sixty signs in all.\nAnd a second long line that is not a heading, as it has over sixty signs, too.\nshort\n" + "many words here. " * 20 + "\nshort\nshort\n",
    "  tion of the lines tion of the\nTion Of The x\n\n",
    "", " ", "\n", "ΟΔΟΣ. ΟΔΟΣ\nΣ. Σ", None, "Roe Der says so of it. Roe Der says so", "Nobody else says so of it. Nobody",
    "ſ KK İx éa _a_ 1,5. the éa", ("aa bb cc dd ee ff gg hh " * 6 + "\n") * 4,
]


def _tables(spark, where, rows):
    made = [(k, t, "en", f"src{i % 4}", len(t or "")) for i, (k, t) in enumerate(rows)]
    spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([("b1", BENCH), ("b2", None), ("b3", "few words")], "item_id string, text string").write.parquet(f"{where}/benchmark.parquet")


def _found(checks):
    return Counter((r[0], r["check"], r["failure"]) for c in checks for r in c.collect())


@pytest.mark.parametrize("ids", ["plain", "one null"])
def test_gates_by_row_are_those_over_rows(spark, tmp_path, monkeypatch, ids):
    _tables(spark, tmp_path, [(None if ids == "one null" and i == 2 else i, t) for i, t in enumerate(TEXTS)])
    by_row = _found(evidence._suite(spark, str(tmp_path))[1])
    monkeypatch.setattr(texts, "keys_repeat", lambda *_: True)
    over_rows = _found(evidence._suite(spark, str(tmp_path))[1])
    assert by_row == over_rows
    assert {c for _, c, _ in by_row} >= {"overlap", "repeated facts", "dangling", "openers", "thin sections", "sections", "opinion attribution", "near duplicates"}


@pytest.mark.parametrize("name", ["gate_suite", "gate_failures"])
def test_gates_give_the_rows_of_their_sql(spark, tmp_path, name):
    # Their SQL knows no group as a speaker ("Der says").
    _tables(spark, tmp_path, [(i, t) for i, t in enumerate(TEXTS) if t is None or t.isascii() and "`" not in t and "\t" not in t and "Der" not in t])
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = registry.queries()[name](spark, str(tmp_path))
    want = con.sql(registry.oracle_sql()[name])
    assert sorted(map(repr, got.select(*want.columns).toPandas().values.tolist())) == sorted(map(repr, want.df()[want.columns].values.tolist()))


def test_texts_of_one_id_still_count_as_one(spark, tmp_path):
    _tables(spark, tmp_path, [(7, "the word " * 11), (7, "the word " * 11), (8, "x")])
    found = _found(evidence._suite(spark, str(tmp_path))[1])
    assert found[7, "repeated facts", "word"] == 1 and found[7, "openers", "the word"] == 1


def test_gates_shuffle_no_text(spark, sf_dir):
    """Before, sentences, lines, words and all 8-grams of the documents were dealt out by id."""
    a, checks = evidence._suite(spark, sf_dir)
    plan = gates.verdict(a, "doc_id", *checks)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    for row in plan.split("\n"):
        if "Exchange hashpartitioning" in row:
            assert not any(c in row.split("hashpartitioning(")[1].split(")")[0] for c in ("token", "sentence", "lower", "text"))


def test_gate_failures_needs_no_sorted_sentences(spark, sf_dir):
    plan = registry.queries()["gate_failures"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "posexplode" not in plan


def test_grams_by_row_are_counted_as_over_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").unionByName(spark.read.parquet(f"{sf_dir}/benchmark.parquet").limit(30).select(
        (F.hash("item_id") - 10**10).alias("doc_id"), "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(0).cast("bigint").alias("n_chars")))
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    one = sorted(map(tuple, texts.gram_overlap(docs, "doc_id", "text", bench, "text", 4).collect()))
    two = sorted(map(tuple, texts.gram_overlap_by_row(docs, "doc_id", "text", bench, "text", 4).collect()))
    assert one == two and sum(r[2] > 0 for r in two) > 30


def test_keys_repeat(spark):
    df = lambda *k: spark.createDataFrame([(x,) for x in k], "k long")
    assert not texts.keys_repeat(df(1, 2, None), "k") and texts.keys_repeat(df(1, 2, 1), "k") and texts.keys_repeat(df(1, None, None), "k") and not texts.keys_repeat(df(), "k")


def test_duplicated_values(spark):
    df = spark.createDataFrame([(1, "A b"), (2, "a B"), (3, None), (4, None), (5, ""), (6, "c"), (7, "A B")], "k int, t string")
    assert sorted(map(tuple, site.duplicated(df, "k", F.col("t")).collect())) == [(1, 3), (2, 3), (3, 2), (4, 2), (7, 3)]
