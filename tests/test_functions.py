"""Rules of the Arrow functions, with made-up cases."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from skein.functions import dates, text, titles, udfs, urls


@pytest.fixture(scope="module")
def apply(spark):
    """f of one string, as Spark computes it."""
    return lambda f, given: spark.createDataFrame([(given,)], "t string").select(f(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    "given, want",
    [
        ("Crème Brûlée", "Creme Brulee"),
        ("Øresund Straße", "Oresund Strasse"),
        ("", ""),
    ],
)
def test_fold(apply, given, want):
    assert apply(titles.fold, given) == titles.folded(given) == want


def test_fold_follows_the_decomposition_of_letters(spark):
    letters = [chr(c) for c in range(0x80, 0x2500)]
    rows = spark.createDataFrame([(x, x + "e") for x in letters], "x string, t string").select("x", titles.fold(F.col("t")).alias("f")).collect()
    for r in rows:
        bases = [c for c in unicodedata.normalize("NFKD", titles.LETTERS.get(r["x"], r["x"])) if not unicodedata.combining(c)]
        if len(bases) < 2 or r["x"] in titles.LETTERS:
            assert r["f"] == "".join(bases) + "e"


@pytest.mark.parametrize(
    "given, want",
    [
        ("It costs $1,200 or 30m of them", ["1200", "30000000"]),
        ("4.5bn rows, two million lines", ["4500000000", "2000000"]),
        ("from 13th to 20th October", ["D:10-13", "D:10-20"]),
        ("due March 5, 2027 at 9:30 pm", ["D:2027-03-05", "9:30pm"]),
        ("on 2026-11-02 and 11/03/2026", ["D:2026-11-02", "D:2026-11-03"]),
        ("16 GB, 144Hz, 3840x2160, 4K", ["3840x2160", "4k", "16gb", "144hz"]),
        ("rose 12.50% in v1.2.3", ["12.5%", "1.2.3"]),
        ("RTX 4080 Ti needs 8 cores", ["rtx4080ti", "8core"]),
        ("see https://x.example/2024/05/", []),
    ],
)
def test_values(given, want):
    assert [v["token"] for v in udfs.values_of(given)] == want


def test_figures_scale(apply):
    assert apply(titles.figures, "4m") == apply(titles.figures, "4 million") == apply(titles.figures, "4,000,000") == ["4000000"]
    assert apply(titles.figures, "13th October") == ["13", "october"]
    assert apply(titles.figures, "2.50bn, 0.125k, 007, 1.0 and v1.2") == ["1", "125", "2500000000", "7"]


def test_sentences_keep_abbreviations():
    assert udfs.sentences_of("Dr. Roe left. She said no. 5 is fine.") == ["Dr. Roe left.", "She said no. 5 is fine."]


def test_page_text():
    page = "<p>One &amp; two</p><script>x()</script><div>three<br>four</div>"
    assert udfs.page_text(page) == "One & two\nthree\nfour"


def test_entities(apply):
    assert apply(titles.names, "New Harbor of Glass sold 3 million copies") == ["harbor of glass"]
    assert apply(titles.names, "Glass is out") == []
    assert apply(lambda t: titles.names(t, True), "Glass is out") == ["glass"]
    assert apply(titles.names, "see Crown 2 and the iPhone of 5 at Über Café and") == ["crown 2 and the iphone of 5", "über café"]


@pytest.mark.parametrize("given, want", [("Copies of a review sold", "sales"), ("Review: copies", "review"), ("It is delayed", "delay"), ("Worth $ 5", "sales"), ("Makes 4m", "sales"), ("", "announcement")])
def test_story_type(apply, given, want):
    assert apply(titles.story_type, given) == want


def same_story(spark, a, b, **rules):
    rows = titles.features(spark.createDataFrame([(a,)], "t string"), "t").select(*[F.col(c).alias(f"a_{c}") for c in titles.FEATURES])
    other = titles.features(spark.createDataFrame([(b,)], "t string"), "t").select(*[F.col(c).alias(f"b_{c}") for c in titles.FEATURES])
    return titles.same_story(rows.join(other), "a_", "b_", **rules).count() == 1


@pytest.mark.parametrize(
    "a, b, want",
    [
        ("Harbor of Glass sold 3 million copies", "Harbor of Glass sales pass 3 million", True),
        ("Harbor of Glass gets a sequel", "Winter Crown gets a sequel", False),
        ("Harbor of Glass review", "Harbor of Glass delayed to spring", False),
        ("same words", "Same Words!", True),
    ],
)
def test_same_story(spark, a, b, want):
    assert same_story(spark, a, b) is want


@pytest.mark.parametrize(
    "a, b, want",
    [
        ("Winter Crown review", "Winter Crown sold well by far in the north", False),  # types differ, texts do too
        ("Winter Crown sold", "Winter Crown sells well", True),  # a specific type and one leading name
        ("Why Winter Crown and Harbor of Glass matter so very much today", "Harbor of Glass joins Winter Crown", True),  # two names
        ("Xbox Game Pass grows in May", "Xbox Game Pass shrinks by far over there", False),  # a name of many stories
        ("Winter Crown opens doors slowly", "Winter Crown closes all of its old northern gates for good", False),  # one subject, two events
        ("Winter Crown opens doors slowly", "Winter Crown has many doors", True),  # one subject, one event
    ],
)
def test_same_story_by_the_decision_table(spark, a, b, want):
    assert same_story(spark, a, b) is want


def test_urls(spark):
    rows = spark.createDataFrame([("HTTPS://WWW.News.Example.co.uk:80/A/?q=1#x",), ("bare.example.com",), ("",)], "url string")
    got = rows.select(urls.normalize_url(F.col("url")), urls.registered_domain(F.col("url")), urls.claim_url_key(F.col("url"))).collect()
    assert got[0][0] == "https://news.example.co.uk:80/A/?q=1"
    assert got[0][1] == "example.co.uk"
    assert got[1][1] == "example.com"
    assert got[2][0] == "" and got[2][1] == ""


def test_url_date(spark):
    now = F.lit("2026-06-01").cast("timestamp")
    rows = spark.createDataFrame([("https://a.b/2026/05/04/x",), ("https://a.b/2027/01/01/x",), ("https://a.b/2026/13/01/x",)], "url string")
    got = [r[0] for r in rows.select(urls.url_date(F.col("url"), now)).collect()]
    assert str(got[0]) == "2026-05-04" and got[1] is None and got[2] is None


def test_durations(spark):
    rows = spark.createDataFrame([("2 days",), ("48",), ("0 hours",), ("soon",), (None,)], "t string")
    assert [r[0] for r in rows.select(dates.duration_hours(F.col("t"))).collect()] == [48.0, 48.0, None, None, None]


def test_ngrams_and_jaccard(spark):
    row = spark.createDataFrame([(["a", "b", "a", "b"], ["a"])], "x array<string>, y array<string>")
    got = row.select(text.ngrams(F.col("x"), 2), text.ngrams(F.col("y"), 2), text.jaccard(F.col("x"), F.col("y"))).first()
    assert got[0] == ["a b", "b a"] and got[1] == [] and got[2] == 0.5


@pytest.mark.parametrize(
    "given, want",
    [
        ("New Call of Glass: Modern Crown 4 is out", ["Call of Glass: Modern Crown 4"]),
        ("at Acme CEO Roe Hart joins Bolt and Nut Works", ["Acme", "Roe Hart", "Bolt", "Nut Works"]),
        ("see Crown 6 PC, a port", ["Crown 6", "PC"]),
        ("Hundreds wait. They leave for Acme's Crown", ["Acme Crown"]),
        ("DMZ opens", ["DMZ"]),
        ("They and They", ["They"]),
    ],
)
def test_story_phrases(apply, given, want):
    assert apply(lambda t: titles.story_phrases(t, ["pc", "ai"]), given) == want


def test_sub_and_lead_entities(apply):
    assert apply(titles.sub_entities, "Call of Glass: Modern Crown 4") == ["call of glass: modern crown 4", "call of glass", "modern crown 4"]
    assert apply(lambda t: titles.sub_entities(t, ["nut works"]), "Great Nut Works") == ["great nut works", "nut works"]
    assert apply(lambda t: titles.sub_entities(t, ["salt and sand"]), "Salt and Sand") == ["salt and sand"]
    found = lambda t: titles.primary_entities(t, ["pc"])
    assert apply(found, "see Xbox, Winter Crown: Ice PC") == ["xbox", "winter crown: ice", "winter crown", "ice"]
    assert apply(lambda t: titles.lead_entity(found(t)), "see Xbox, Winter Crown: Ice PC") == "winter crown: ice"
    assert apply(lambda t: titles.lead_entity(found(t)), "on Xbox") == "xbox" and apply(lambda t: titles.lead_entity(found(t)), "nothing") == ""
