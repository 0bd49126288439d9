"""Small fixtures for operators that need state, files or order."""

import datetime as dt

from pyspark.sql import functions as F

from skein.operators import claims, clusters, gates, joins, site, stories
from skein.sources import tables
from skein.streaming import state

NOW = dt.datetime(2026, 1, 10)


def test_pick_counts_only_stories_over_their_threshold(spark):
    rows = [(1, "a", 90.0), (2, "a", 80.0), (3, "a", 70.0), (4, "b", 40.0), (5, None, 60.0), (6, None, 59.0)]
    df = spark.createDataFrame(rows, "id int, lead string, score double")
    got = stories.pick(df, "lead", [F.desc("score"), F.col("id")], F.lit(50.0), 2, 4)
    assert [r["id"] for r in got.collect()] == [1, 2, 5, 6]


def test_latest_keeps_the_first_of_ties(spark):
    df = spark.createDataFrame([("x", NOW, 2), ("x", NOW, 1), ("x", None, 0), ("y", None, 5)], "k string, t timestamp, seq int")
    got = {r["k"]: r["seq"] for r in stories.latest(df, ["k"], "t", "seq").collect()}
    assert got == {"x": 1, "y": 5}


def test_greedy_stories_join_seeds_not_members(spark):
    titles = ["Harbor of Glass sold 3 million copies", "Harbor of Glass sales pass 3 million", "Winter Crown delayed", "Winter Crown delayed again", "Other thing"]
    df = spark.createDataFrame([(i, t, NOW - dt.timedelta(hours=i)) for i, t in enumerate(titles)], "id bigint, title string, published timestamp")
    got = {r["key"]: r["seed"] for r in clusters.greedy_stories(df, "id", "title", "published").collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4}


def test_greedy_stories_by_walking(spark):
    import random

    from skein.functions import titles as H

    dice = random.Random(4)
    first, second = ["Harbor of Glass", "Winter Crown", "Harbor", "Crown of Ice"], ["sold 3 million copies", "review", "delayed to May", "opens in May", "sales pass 3 million"]
    titles = [f"{dice.choice(['New', 'The'])} {dice.choice(first)} {dice.choice(second)}" for _ in range(60)]
    rows = [(i, t, NOW - dt.timedelta(hours=dice.randrange(20))) for i, t in enumerate(titles)]
    texts = sorted(set(titles))
    known = H.features(spark.createDataFrame([(t,) for t in texts], "t string"), "t").cache()
    a, b = (known.select(*[F.col(c).alias(f"{p}{c}") for c in ["t", *H.FEATURES]]) for p in ("a_", "b_"))
    same = {(r["a_t"], r["b_t"]) for r in H.same_story(a.join(b), "a_", "b_").select("a_t", "b_t").collect()}
    same_story = lambda x, y: (x, y) in same
    seeds, want = [], {}
    for i, t, _ in sorted(rows, key=lambda r: (-r[2].timestamp(), r[0])):
        want[i] = next((s for s, u in seeds if same_story(t, u)), i)
        if want[i] == i:
            seeds.append((i, t))
    df = spark.createDataFrame(rows, "id bigint, title string, published timestamp")
    assert {r["key"]: r["seed"] for r in clusters.greedy_stories(df, "id", "title", "published").collect()} == want


def test_greedy_claims_never_merge_one_source(spark):
    rows = [
        ("s", 1, "u1", "copies sold", "4 million copies"), ("s", 2, "u2", "copies sold", "4m copies"),
        ("s", 3, "u2", "copies sold", "4m copies"), ("s", 4, "u3", "copies sold", "9 million copies"),
    ]
    df = spark.createDataFrame(rows, "story_id string, seq bigint, source_url string, claim string, value string")
    got = {r["seq"]: r["fact"] for r in clusters.greedy_claims(df).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_resolve_versions_drops_the_outlier(spark):
    rows = [(1, "a", "from Nov 4 to Jan 28"), (1, "b", "from Nov 4 to Jan 28"), (1, "c", "from Nov 4 to Jan 29"), (2, "a", "5 of 6"), (2, "b", "5 of 7")]
    df = spark.createDataFrame(rows, "fact bigint, source_url string, value string")
    got = {(r["fact"], r["source_url"]): r["part"] for r in claims.resolve_versions(df, "fact").collect()}
    assert got == {(1, "a"): 0, (1, "b"): 0, (2, "a"): 0, (2, "b"): 1}


def test_resolve_origins(spark):
    rows = [(1, "According to Acme Corp, it ships. Bolt was there.", "Daily", "Acme Corp; Bolt; an unnamed source; Daily; Nobody")]
    df = spark.createDataFrame(rows, "id int, text string, outlet string, origin string")
    got = claims.resolve_origins(df, "id", "text", [], []).first()
    assert got["origin"] == "Acme Corp"
    assert got["dropped"] == "Bolt: not attributed; Daily: not named; Nobody: not named; an unnamed source: anonymous"


def test_restore_rumors(spark):
    rows = [("s", 1, "rumor", "sequel planned winter", "x"), ("s", 2, "confirmed", "winter sequel", "y"), ("t", 3, "rumor", "sequel winter", "z")]
    df = spark.createDataFrame(rows, "story_id string, seq int, kind string, claim string, value string")
    assert {r["seq"]: r["kind"] for r in claims.restore_rumors(df, "story_id").collect()} == {1: "reported", 2: "confirmed", 3: "rumor"}


def test_verdict(spark):
    docs = spark.createDataFrame([(1, "fine words here"), (2, "see F12 now")], "id int, body string")
    got = {r["id"]: (r["passed"], r["failed_checks"]) for r in gates.verdict(docs, "id", gates.leak_gate(docs, "id", "body"), gates.words_gate(docs, "id", "body", 3)).collect()}
    assert got == {1: (True, ""), 2: (False, "leak")}


def test_unique_slugs(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id int, slug string")
    assert {r["id"]: r["slug"] for r in site.unique_slugs(df, "id", "slug").collect()} == {1: "a", 2: "a-2", 3: "b"}


def test_article_round_trip(spark, tmp_path):
    row = spark.createDataFrame([('A "fine" title', "Short", "news", ["x", "y"], "Body.\nMore.")], "t string, d string, c string, g array<string>, b string")
    made = row.select(tables.render_article(F.col("t"), F.col("d"), F.col("c"), F.col("g"), F.col("b")).alias("m")).first()["m"]
    (tmp_path / "a.md").write_text(made)
    got = tables.read_articles(spark, str(tmp_path)).select("body", tables.front_value(F.col("front"), "title").alias("t")).first()
    assert got["body"] == "Body.\nMore." and got["t"] == "A  fine  title"


def test_feeds(spark, tmp_path):
    (tmp_path / "f.xml").write_text(
        "<rss><channel><item><title>One</title><link>https://a.example/1</link><pubDate>Tue, 03 Feb 2026 10:00:00 GMT</pubDate></item>"
        "<item><title>Two</title><link>https://a.example/2</link><pubDate>2026-02-03T11:00:00Z</pubDate></item></channel></rss>"
    )
    got = {r["title"]: str(r["published"]) for r in tables.read_feeds(spark, str(tmp_path)).collect()}
    assert got == {"One": "2026-02-03 10:00:00", "Two": "2026-02-03 11:00:00"}


def test_state_round_trip(spark, tmp_path):
    path = str(tmp_path / "state")
    assert tables.read_state(spark, path, "k string, n int").count() == 0
    tables.write_state(spark.createDataFrame([("a", 1)], "k string, n int"), path)
    assert tables.read_state(spark, path, "k string, n int").first()["n"] == 1


def test_classify_response(spark):
    rows = [(403, "", "x", 1), (304, "", "", None), (500, "", "x", 1), (200, "text/html", "x", 1), (200, "xml", "", 0), (200, "xml", "<r/>", None), (200, "xml", "<r/>", 0), (200, "xml", "<r/>", 2)]
    df = spark.createDataFrame(rows, "s int, c string, b string, n int")
    got = [r[0] for r in df.select(tables.classify_response(F.col("s"), F.col("c"), F.col("b"), F.col("n"))).collect()]
    assert got == ["blocked", "not-modified", "http-error", "blocked", "empty", "invalid-xml", "empty", "ok"]


def test_fold_pool_stream(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    df = spark.createDataFrame([("a", NOW, 1), ("a", NOW + dt.timedelta(hours=1), 2)], "k string, t timestamp, seq int")
    df.limit(1).write.mode("append").parquet(src)
    for _ in range(2):
        stream = spark.readStream.schema(df.schema).parquet(src)
        state.fold_pool(stream, out, str(tmp_path / "cp"), ["k"], "t", "seq").awaitTermination()
        df.where("seq = 2").write.mode("append").parquet(src)
    assert [r["seq"] for r in spark.read.parquet(out + "/v=1").collect()] == [2]


def test_breaker_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [("a", 1, 1, True), ("a", 2, 2, True), ("b", 1, 3, True), ("b", 2, 4, False)]
    df = spark.createDataFrame(rows, "key string, ts bigint, seq bigint, failed boolean")
    df.write.parquet(src)
    got = state.run_available(state.breaker_stream(spark.readStream.schema(df.schema).parquet(src), 2), str(tmp_path / "cp"), "update")
    assert {r["key"]: (r["consecutive_failures"], r["open"]) for r in got.collect()} == {"a": (2, True), "b": (0, False)}


def test_failed_matches_name_each_pair_once(spark):
    """Pairs that match in several ways, by several URLs, or by rows that share an id."""
    form = "{} int, key string, urls array<string>, entities array<string>, story_type string"
    left = [(1, "k", ["u", "v", None], ["a", "b", "c"], "t"), (2, "x", ["v", "u"], ["c", "b", "a", "a"], "t"), (3, None, None, ["a", "b", "c"], "t"), (4, "k", ["w"], None, None)]
    right = [(7, "k", ["u", "v"], ["a", "c", "b"], "t"), (8, None, ["w", None], ["a", "b", "d"], "t"), (9, "z", [], ["b", "a", "c"], "t")]
    want = [(1, 7), (1, 9), (2, 7), (2, 9), (3, 7), (3, 9), (4, 7), (4, 8)]
    df = lambda rows, key: spark.createDataFrame(rows, form.format(key))
    found = joins.failed_matches(df(left, "id"), df(right, "failed_id"))
    assert sorted(map(tuple, found.collect())) == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not plan.startswith("Aggregate")  # pairs are not shuffled
    again = joins.failed_matches(df([*left, (1, "z", ["u"], None, None)], "id"), df([*right, right[0]], "failed_id"))
    assert sorted(map(tuple, again.collect())) == want
