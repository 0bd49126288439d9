from pyspark.sql import functions as F

from skein.operators import claims, editorial, joins, media


def test_subsequence(spark):
    rows = spark.createDataFrame([(["a", "c"], ["a", "b", "c"]), (["c", "a"], ["a", "b", "c"]), ([], ["a"])], "n array<string>, h array<string>")
    assert [r[0] for r in rows.select(editorial.subsequence(F.col("n"), F.col("h"))).collect()] == [True, False, True]


def test_title_coverage(spark):
    rows = spark.createDataFrame([(1, "New Harbor of Glass meets Winter Crown", ["Harbor of Glass"])], "id int, title string, entities array<string>")
    assert [r["phrase"] for r in editorial.title_coverage(rows, "id", "title", "entities").collect()] == ["winter crown"]


def test_entity_mentions(spark):
    rows = spark.createDataFrame([(1, "The Harbor of Glass opens.", ["Harbor of Glass", "Winter Crown"])], "id int, text string, entities array<string>")
    assert [r["entity"] for r in editorial.entity_mentions(rows, "id", "text", "entities").collect()] == ["Winter Crown"]


def test_currency_names(spark):
    rows = spark.createDataFrame([("Costs 500 Gold Coins or 20 Gems today",)], "t string")
    assert rows.select(editorial.currency_names(F.col("t"))).first()[0] == ["Gems", "Gold Coins"]


def test_model_calls_fall_back_and_skip_a_family(spark):
    def broken(_):
        raise RuntimeError("down")

    clients = {"a-1": broken, "b-1": lambda t: "{}", "a-2": lambda t: '{"x": 1}', "c-1": lambda t: '{"x": 2}'}
    rows = spark.createDataFrame([(1, "p")], "id int, prompt string")
    got = editorial.model_calls(rows, "id", "prompt", clients, ["x"]).first()
    assert got["provider"] == "a-2" and got["error"] == "a-1: down; b-1: no x"
    assert editorial.model_calls(rows, "id", "prompt", clients, ["x"], banned="a").first()["provider"] == "c-1"


def test_first_success_keeps_the_budget():
    assert editorial.first_success([1, 2, 3], lambda c: c * 10 if c == 3 else None, 3) == (3, 30)
    assert editorial.first_success([1, 2, 3], lambda c: c * 10 if c == 3 else None, 2) == (None, None)


def test_member_support(spark):
    rows = [("s", 1, "u1", "Harbor opens early winter", "x", None), ("s", 2, "u2", "doors opens early winter", "y", None), ("s", 3, "u3", "else", "z", "Harbor news"), ("s", 4, "u4", "else", "z", None)]
    df = spark.createDataFrame(rows, "story string, seq int, source_url string, claim string, value string, source_title string")
    e = spark.createDataFrame([("s", "Harbor")], "story string, entity string")
    got = {r["seq"]: r["support"] for r in claims.member_support(df, "story", e, 3).collect()}
    assert got == {1: "direct", 2: "peer", 3: "title", 4: "none"}


def test_robots(spark):
    rules = spark.createDataFrame([("a.com", "/", False), ("a.com", "/ok", True)], "host string, path string, allow boolean")
    pages = spark.createDataFrame([("http://a.com",), ("http://a.com/ok/1",), ("http://www.a.com/no",), ("http://b.com/no",)], "url string")
    assert sorted(r["url"] for r in joins.robots_allowed(pages, "url", rules).collect()) == ["http://a.com/ok/1", "http://b.com/no"]


def test_near_duplicate_articles(spark):
    rows = [(1, "Glass harbor opens doors", "2026-01-01"), (2, "Glass Harbor opens its doors", "2026-01-06"), (3, "Glass harbor opens doors!", "2026-03-01"), (4, "Other", "2026-01-02"), (5, "Glass harbor opens all doors", "2026-02-20")]
    df = spark.createDataFrame(rows, "id int, title string, day string")
    got = {(r["id"], r["earlier"], r["why"]) for r in joins.near_duplicate_articles(df, "id", "title", "day").collect()}
    assert got == {(2, 1, "similar"), (3, 1, "title")}


def test_near_duplicate_articles_of_any_number_of_titles(spark, monkeypatch):
    """Both ways of titles, of many articles a title and of one, against all pairs; titles are compared once each."""
    import datetime as dt
    import random

    rng = random.Random(3)
    day = lambda n: dt.date(2026, 1, 1) + dt.timedelta(n)
    rows = [(i, " ".join(rng.sample("abcdef", 4)), day(rng.randrange(60))) for i in range(150)] + [(200 + i, f"x{i // 2} y{i // 3} z", day(rng.randrange(60))) for i in range(60)]
    words = {i: set(t.split()) for i, t, _ in rows}
    want = []
    for i, t, d in rows:
        near = [j for j, o, e in rows if o != t and 0 <= (d - e).days <= 7 and (e < d or j < i) and len(words[i] & words[j]) / len(words[i] | words[j]) >= 0.5]
        want += [(i, min(near))] if near else []
    df = spark.createDataFrame(rows, "id int, title string, day date")
    for few in (joins.FEW_TITLES, 0):
        monkeypatch.setattr(joins, "FEW_TITLES", few)
        got = joins.near_duplicate_articles(df, "id", "title", "day").where("why = 'similar'").collect()
        assert sorted((r["id"], r["earlier"]) for r in got) == sorted(want)


def test_near_duplicate_articles_make_no_row_for_a_pair_and_a_day(spark, monkeypatch):
    """600 titles that are all alike: 359,400 pairs, which no join multiplies by days; keys that are texts go by joins."""
    import datetime as dt

    day = lambda n: dt.date(2026, 1, 1) + dt.timedelta(n)
    # Titles i on days 3 i and 3 i + 1; on day 5000 two alike with keys in disorder; rows without a day or a key.
    rows = [(2 * i + j, f"order {i} 4 not specified c{i}", day(3 * i + j)) for i in range(600) for j in range(2)]
    rows += [(9002, "order 1 4 not specified c1", day(5000)), (9001, "order 2 4 not specified c2", day(5000)), (9003, "order 1 4 not specified c1", day(5000))]
    rows += [(9004, "order 3 4 not specified c3", None), (None, "order 4 4 not specified c4", day(5006)), (9005, "order 5 4 not specified c5", day(5007))]
    want = [(k, min(o for o in range(max(0, 2 * (i - 3)), 2 * i) if (d - rows[o][2]).days <= 7)) for k, t, d in rows[:1200] for i in [k // 2] if i]
    want += [(9002, 9001), (9003, 9001), (None, 9001), (9005, 9001)]
    made = []
    by_title = joins._earlier_by_title
    monkeypatch.setattr(joins, "_earlier_by_title", lambda *a: made.append(a) or by_title(*a))
    df = spark.createDataFrame(rows, "id int, title string, day date")
    got = joins.near_duplicate_articles(df, "id", "title", "day")
    assert got.schema["earlier"].dataType == df.schema["id"].dataType and not made
    order = lambda x: (x[0] is None, x)
    assert sorted(((r["id"], r["earlier"]) for r in got.where("why = 'similar'").collect()), key=order) == sorted(want, key=order)
    few = df.where("id > 9000").withColumn("id", F.col("id").cast("string"))
    assert {(r["id"], r["earlier"]) for r in joins.near_duplicate_articles(few, "id", "title", "day").where("why = 'similar'").collect()} == {("9002", "9001"), ("9003", "9001"), ("9005", "9001")}
    assert made


def test_near_titles_do_not_grow_with_their_days(spark):
    days = spark.range(3000).selectExpr("concat('a b c ', id % 3) AS t", "id DIV 3 AS b")
    assert joins._near_titles(days, 0.5).count() == 6


def test_game_and_photo(spark):
    games = spark.createDataFrame([("Alan Wake",), ("Control",)], "game string")
    titles = spark.createDataFrame([(1, "New Alan Wake 3 announced"), (2, "Why Alan Wake sells"), (3, "New Control patch"), (4, "Gamers control it")], "id int, title string")
    got = {r["id"]: r["game"] for r in media.match_game(titles, "id", "title", games).collect()}
    assert got == {2: "Alan Wake", 3: "Control"}
    photo = spark.createDataFrame(
        [("image/jpeg", 2000, 1000, "CC BY 4.0", "A", "Deck and Asus on a table", "", "Deck"), ("image/jpeg", 2000, 1000, "CC0", "", "Deck Pro", "", "Deck"), ("image/jpeg", 2000, 1000, "CC0", "", "Deck", "photo", "Deck")],
        "mime string, width int, height int, license string, artist string, title string, description string, phrase string",
    )
    why = media.unusable_reason(1200, 1.1, 2.8, ["CC BY 4.0", "CC0"], ["asus"])
    assert [r[0] for r in photo.select(why).collect()] == ["names another product", "names a different model", None]
