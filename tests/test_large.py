"""Forms that queries need to get through large tables."""

from pyspark.sql import functions as F

from skein.functions import articles
from skein.operators import claims, joins, texts
from skein.plans import registry


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_near_duplicate_sentences_stay_where_their_text_is(spark, sf_dir):
    assert "Exchange" not in _plan(registry.queries()["near_duplicate_sentences"](spark, sf_dir))


def test_near_duplicate_sentences_of_one_text(spark):
    words = "one two three four five six seven eight nine ten".replace(" ", "x ") + "x"
    tens = [words, "Other words here now.", words.replace("onex", "elevenx"), words, "Other words here now.", words.replace("tenx onex", "q").replace("ninex tenx", "ninex twelvex thirteenx")]
    df = spark.createDataFrame([(1, "\n".join(tens)), (2, ""), (3, None), (None, "a same line here\na same line here")], "id int, text string")
    got = {(r["id"], r["pos"], r["first_pos"]) for r in texts.near_duplicate_sentences(df, "id", F.col("text"), []).collect()}
    assert got == {(1, 2, 0), (1, 3, 0), (1, 4, 1), (1, 5, 0)}


def test_versions_of_a_fact_need_no_group_in_python(spark):
    rows = [(1, "u", "3 units"), (2, "u2", "3 units"), (2, "u1", "about 3 units"), (3, "b", "4"), (3, "a", "5"), (4, "a", "1"), (4, "b", "2 and 3"), (4, "c", "2 and 3"), (5, None, None), (5, "x", "7"), (6, "a", "1"), (6, "b", "2"), (6, "c", "3")]
    df = claims.resolve_versions(spark.createDataFrame(rows, "f bigint, source_url string, value string"), "f")
    assert "FlatMapGroups" not in _plan(df)
    got = sorted((r["f"], r["source_url"] or "", r["part"]) for r in df.collect())
    assert got == [(1, "u", 0), (2, "u1", 0), (2, "u2", 0), (3, "a", 0), (3, "b", 1), (4, "b", 0), (4, "c", 0), (5, "", 0), (5, "x", 0), (6, "a", 0), (6, "b", 1), (6, "c", 2)]


def test_flagged_sentences_are_dropped_once_an_article(spark, sf_dir):
    assert _plan(registry.queries()["drop_flagged_sentences"](spark, sf_dir)).count("ArrowEvalPython") == 1


def test_flagged_sentences_in_other_letters():
    for s in ("Zoë’s café it’s", "ZOES' CAFE its", "zoë café's its", "«Zoë–cafe»: it's"):
        kept = articles.drop_flagged(f"One. {s}. Two. Three. Four.", ["Zoe café its"])
        assert kept == ("One. Two. Three. Four." if "zoe cafe its" in articles.matching_form(s) else f"One. {s}. Two. Three. Four.")


def test_related_articles_of_one_term_make_no_pairs(spark):
    rows = [(i, [f"e{i % 3}"] + ([f"m{j}" for j in range(8)] if i % 500 == 0 else []), ["k"], i % 2, float(i % 7)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id bigint, e array<string>, k array<string>, c int, t double").repartition(4).cache()
    got = joins.related(df, "id", "e", "k", "c", "t")
    found = {(r["article"], r["nth"]): (r["other"], r["score"]) for r in got.collect()}
    assert len(found) == 9000
    for a in (0, 1, 500, 777, 2999):
        score = lambda b, a=a: 2 * len(set(rows[a][1]) & set(rows[b][1])) + 1 + (rows[a][3] == rows[b][3])
        best = sorted((b for b in range(3000) if b != a), key=lambda b: (-score(b), -rows[b][4], b))[:3]
        assert [found[a, n] for n in (1, 2, 3)] == [(b, score(b)) for b in best]
    # Articles of few terms meet in lists of a subset's first ones.
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "bit_get" in plan
