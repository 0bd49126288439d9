"""Story queries over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import text as X
from skein.functions import urls as U
from skein.functions.dates import age_hours, duration_hours
from skein.operators import joins as J
from skein.operators import stories as S
from skein.sources.tables import table

NOW = "2024-01-31 00:00:00"
TITLE_PATTERNS = [r"\bdeals?\b", r"\bthe the\b", r"^in\b", r"\bof the\b"]

# Shared SQL: registrable domain and normalised form of pages.url.
_HOST = r"regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(regexp_replace(trim(url), '^([A-Za-z][A-Za-z0-9+.-]*:)?//', ''), '^([^/?#]*)', 1)), '^.*@', ''), ':.*$', ''), '^www\.', '')"
_DOMAIN = f"array_to_string(list_slice(string_split({_HOST}, '.'), -2, -1), '.')"
_REST = r"regexp_replace(regexp_replace(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', '', 's')"
_NORM = rf"""lower(regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.-]*://)', 1)) || regexp_replace(lower(regexp_extract({_REST}, '^([^/?]*)', 1)), '^www\.', '')
  || CASE WHEN starts_with(regexp_replace({_REST}, '^[^/?]*', ''), '/') THEN '' ELSE '/' END || regexp_replace({_REST}, '^[^/?]*', '')"""


def _at(time: str):
    return F.lit(time).cast("timestamp_ntz")


def url_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", U.normalize_url(F.col("url")).alias("norm"))


def url_registered_domain(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.registered_domain(F.col("url")).alias("domain"))


def url_keys(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select(
        "page_id", U.claim_url_key(u).alias("claim_key"), U.gate_url_key(u).alias("gate_key"), U.verifier_url_key(u).alias("verifier_key"),
        U.allowed_url(u, ["m.therwh.example.net", "tionsh.example.net"]).alias("allowed"),
    )


def reattribute_left_default(spark, sf):
    pages = table(spark, sf, "pages")
    sources = spark.createDataFrame(
        [("example.com", "Com Daily", 1, "com group", 1), ("example.com", "Late", 2, "late", 2), ("example.org", "Org Post", 2, "org group", 3)],
        "domain string, name string, tier int, owner string, seq int",
    )
    return S.reattribute(pages.select("page_id", "url"), sources, "url").select("page_id", "link_domain", "source_name", "tier", "owner")


def freshness_per_tier(spark, sf):
    events = table(spark, sf, "events").select("event_id", F.col("ts").alias("published"), (F.col("user_id") % 3 + 1).cast("int").alias("tier"))
    windows = spark.createDataFrame([(1, 168.0), (2, 48.0), (3, 24.0)], "tier int, hours double")
    kept = S.fresh(events, windows, _at(NOW))
    return kept.select("event_id", "tier", F.round(age_hours(F.col("published"), _at(NOW)), 4).alias("age_hours"))


def stale_keep_null_age(spark, sf):
    events = table(spark, sf, "events").withColumn("at", F.when(F.col("event_id") % 7 != 0, F.col("ts")))
    age = age_hours(F.col("at"), _at(NOW))
    return S.not_stale(events, 48.0, age).select("event_id", F.round(age, 4).alias("age_hours"))


def keep_latest_per_key(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type", "ts", "value")
    return S.latest(events, ["user_id", "event_type"], "ts", "event_id")


def pool_merge(spark, sf):
    e = table(spark, sf, "events").select(
        F.col("event_id").alias("seq"), F.concat(F.lit("HTTPS://WWW.Ex.com/u/"), "user_id").alias("link"), F.col("ts").alias("published")
    )
    got = S.merge_pool(e.where("seq % 2 = 0"), e.where("seq % 2 = 1"), _at(NOW), 24.0 * 20)
    return got.select("link", "seq", "published")


def exclude_patterns(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.split("text", "\n")[0].alias("title"))
    return docs.where(S.first_pattern(F.col("title"), TITLE_PATTERNS).isNull()).select("doc_id")


def exclude_pattern_counts(spark, sf):
    docs = table(spark, sf, "documents").select(S.first_pattern(F.split("text", "\n")[0], TITLE_PATTERNS).alias("pattern"))
    return docs.where("pattern IS NOT NULL").groupBy("pattern").agg(F.count("*").alias("n"))


TOPICS = [("money", r"licensed|price", False), ("junk", r"!!", True), ("tables", r"\|", True)]


def blocked_topic_first_match(spark, sf):
    """The first topic group that a text matches; groups marked so are lifted for the English scene."""
    docs = table(spark, sf, "documents")
    hit = F.coalesce(
        *[
            F.when(F.lower("text").rlike(p) & (F.lit(not lift) | (F.col("lang") != "en")), F.lit(name))
            for name, p, lift in TOPICS
        ]
    )
    return docs.select("doc_id", hit.alias("topic")).where("topic IS NOT NULL")


CATEGORIES = [("metal", "brass|steel|tin|copper|nickel"), ("shade", "dark|light|pale|dim"), ("colour", "red|green|blue|white|black")]


def category_first_match(spark, sf):
    part = table(spark, sf, "part")
    return part.select(
        "p_partkey",
        X.ordered_case(F.col("p_name"), CATEGORIES, "other").alias("category"),
        X.ordered_case(F.col("p_type"), CATEGORIES, "other", whole=False).alias("guess"),
    )


def keyword_gates(spark, sf):
    """Whole-word keywords; an empty list passes the relevance gate but not the scene gate."""
    docs = table(spark, sf, "documents")
    some = X.any_word(F.col("text"), ["The", "und"])
    return docs.select(
        "doc_id", some.alias("keyword"), ((F.col("source") == "src0") | some).alias("relevant"), X.any_word(F.col("text"), []).alias("scene_without_keywords")
    )


def _story_items(spark, sf):
    """Line items as story items: an order is a story, a supplier an owner."""
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("story"),
        F.concat(F.lit("https://s"), F.col("l_suppkey"), F.lit(".example/"), F.col("l_linenumber")).alias("link"),
        F.concat(F.lit("o"), F.col("l_suppkey") % 40).alias("owner"),
        (F.col("l_linenumber") % 3 + 1).cast("int").alias("tier"),
        F.col("l_shipdate").alias("published"),
        age_hours(F.col("l_shipdate"), _at("1998-12-31 00:00:00")).alias("age_hours"),
        F.when(F.col("l_returnflag") == "R", False).when(F.col("l_returnflag") == "A", True).alias("fetchable"),
    )


_ITEMS = """items AS (SELECT l_orderkey AS story, 'https://s' || l_suppkey || '.example/' || l_linenumber AS link, 'o' || (l_suppkey % 40) AS owner,
  CAST(l_linenumber % 3 + 1 AS INTEGER) AS tier, l_shipdate AS published, epoch_us(TIMESTAMP '1998-12-31 00:00:00') / 3.6e9 - epoch_us(l_shipdate) / 3.6e9 AS age_hours,
  CASE WHEN l_returnflag = 'R' THEN false WHEN l_returnflag = 'A' THEN true END AS fetchable FROM lineitem)"""
_GROUPS = """g AS (SELECT story, min(age_hours) AS age_hours, max(published) AS newest, list_sort(list(DISTINCT tier)) AS tiers,
  list_sort(list(DISTINCT owner)) AS owners, count(*) AS n_items, substr(sha1(array_to_string(list_sort(list(DISTINCT link)), chr(10))), 1, 12) AS cluster_id FROM items GROUP BY story)"""
_CONFIRM = "(list_contains(tiers, 1) OR len(owners) >= 2)"
_SCORE = f"""(CASE WHEN list_contains(tiers, 1) THEN 40.0 WHEN list_contains(tiers, 2) THEN 15.0 ELSE 0.0 END + least(len(owners), 4) * 10.0
  + CASE WHEN {_CONFIRM} THEN 10.0 ELSE 0.0 END + CASE WHEN age_hours <= 3500 THEN 0.0 ELSE 0.0 END
  + CASE WHEN age_hours <= 6 THEN 30.0 WHEN age_hours <= 24 THEN 20.0 WHEN age_hours <= 48 THEN 10.0 ELSE 0.0 END)::DOUBLE"""


def cluster_aggregate(spark, sf):
    g = S.story_groups(_story_items(spark, sf), "story")
    return g.select(
        "story", F.round("age_hours", 3).alias("age_hours"), "newest", F.array_join("tiers", ",").alias("tiers"), F.array_join("owners", ",").alias("owners"), "n_items", "cluster_id"
    )


def cluster_digest(spark, sf):
    pages = table(spark, sf, "pages")
    g = pages.groupBy(U.registered_domain(F.col("url")).alias("domain")).agg(F.collect_set(U.normalize_url(F.col("url"))).alias("urls"))
    return g.select("domain", F.size("urls").alias("n"), X.cluster_digest(F.col("urls")).alias("cluster_id"))


def distinct_owner_counts(spark, sf):
    items = _story_items(spark, sf)
    ok = S.countable(F.col("tier"), F.col("fetchable"))
    return items.groupBy("story").agg(
        S.distinct_owners(F.col("owner"), F.col("tier"), F.col("fetchable")).alias("n_owners"),
        F.count_distinct(F.when(ok, U.normalize_url(F.col("link")))).alias("n_sources"),
    )


def _scored(spark, sf):
    g = S.story_groups(_story_items(spark, sf), "story")
    return g.withColumn("score", S.story_score(F.col("tiers"), F.col("owners"), F.col("age_hours")))


def score_weighted(spark, sf):
    return _scored(spark, sf).select("story", "score")


def _threshold():
    return F.when(F.size("owners") >= 2, 55.0).otherwise(65.0)


def rank_threshold_topk(spark, sf):
    """The 20 best stories over their threshold, ties by tier, age and number."""
    ranked = _scored(spark, sf).where(F.col("score") >= _threshold())
    order = [F.desc("score"), F.col("tiers")[0], F.col("age_hours"), F.col("story")]
    return ranked.orderBy(*order).limit(20).select("story", "score")


def story_ranking(spark, sf):
    """Items to stories to a pick of 25, at most two of an owner."""
    stories = _scored(spark, sf).withColumn("lead", F.col("owners")[0])
    order = [F.desc("score"), F.col("tiers")[0], F.col("age_hours"), F.col("story")]
    return S.pick(stories, "lead", order, _threshold(), 2, 25).select("story", "lead", "score", "cluster_id")


def topk_entity_cap(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_brand") != "Brand#11", F.col("p_brand")).alias("brand"), F.col("p_retailprice").alias("score"))
    return S.pick(parts, "brand", [F.desc("score"), F.col("p_partkey")], F.lit(900.0), 2, 30)


def one_per_owner_then_fill(spark, sf):
    s = table(spark, sf, "supplier").withColumn("owner", F.col("s_suppkey") % 3)
    return S.one_per_owner_then_fill(s, "s_nationkey", "owner", [F.desc("s_acctbal"), F.col("s_suppkey")], 4).select("s_nationkey", "s_suppkey", "owner", "pick")


def confirmable_eligibility_reason(spark, sf):
    items = _story_items(spark, sf)
    ok = S.countable(F.col("tier"), F.col("fetchable"))
    g = items.groupBy("story").agg(
        F.collect_set("tier").alias("tiers"), F.collect_set("owner").alias("owners"), F.count_distinct(F.when(ok, F.col("link"))).alias("n_sources"),
        S.distinct_owners(F.col("owner"), F.col("tier"), F.col("fetchable")).alias("n_owners"),
    )
    excluded = F.when(F.col("story") % 11 == 0, F.lit("eleven"))
    return g.select(
        "story", S.ineligible_reason(S.confirmable(F.col("tiers"), F.col("owners")), F.col("n_sources"), F.col("n_owners"), excluded, F.col("story") % 5 != 0).alias("reason")
    )


def countable_sources(spark, sf):
    items = _story_items(spark, sf)
    return items.where(S.countable(F.col("tier"), F.col("fetchable"))).groupBy("tier").agg(F.count("*").alias("n"))


def covered_anti_join(spark, sf):
    seen = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("url"))
    return J.not_covered_by_url(table(spark, sf, "customer").withColumn("urls", F.array("c_custkey")), "c_custkey", "urls", seen).select("c_custkey", "c_name")


def cooldown_anti_join(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.array_sort(F.array(F.col("user_id").cast("string"), F.lit("x"))).alias("entities"), F.col("event_type").alias("story_type"), "ts")
    seen = e.where("event_id % 10 = 0").groupBy("entities", "story_type").agg(F.max("ts").alias("last_seen"))
    return J.not_in_cooldown(e.where("event_id % 10 != 0"), seen, _at(NOW), 168.0).select("event_id")


def failed_or_theta_match(spark, sf):
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("key"), F.array(F.col("o_orderdate").cast("date").cast("string")).alias("urls"),
        F.array(F.lit("a"), F.lit("b"), (F.col("o_custkey") % 50).cast("string"), (F.col("o_orderkey") % 40).cast("string")).alias("entities"),
        F.col("o_orderpriority").alias("story_type"),
    )
    failed = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("failed_id"), F.col("c_custkey").cast("string").alias("key"), F.array(F.date_add(F.lit("1995-01-01").cast("date"), F.pmod("c_custkey", F.lit(900)).cast("int")).cast("string")).alias("urls"),
        F.array(F.lit("a"), F.lit("b"), (F.col("c_custkey") % 50).cast("string"), (F.col("c_custkey") % 40).cast("string")).alias("entities"),
        F.lit("1-URGENT").alias("story_type"),
    )
    return J.failed_matches(orders, failed)


def alias_join(spark, sf):
    aliases = [("germany", "DE"), ("france", "FR"), ("united states", "US"), ("united kingdom", "UK")]
    names = table(spark, sf, "nation").select("n_nationkey", "n_name")
    return J.canonicalize(names, "n_name", spark.createDataFrame(aliases, "alias string, canonical string")).select("n_nationkey", "canonical")


def entity_dictionary_merge(spark, sf):
    base = table(spark, sf, "nation").where("n_nationkey < 15").select(F.lower("n_name").alias("canonical"), F.array(F.lower("n_name")).alias("aliases"))
    more = table(spark, sf, "nation").where("n_nationkey >= 10").select(F.lower("n_name").alias("canonical"), F.array(F.lower("n_name"), F.lit("x")).alias("aliases"))
    return J.merge_dictionaries(base, more).select("canonical", F.size("aliases").alias("n"))


def label_boost_join(spark, sf):
    docs, labels = table(spark, sf, "documents").select("doc_id", "source"), table(spark, sf, "labels")
    boost = docs.join(labels, "doc_id").groupBy("source").agg((F.sum("quality") - F.lit(5)).alias("boost"))
    return docs.join(boost, "source", "left").select(
        "doc_id", F.coalesce(F.greatest(F.lit(0.0), F.least(F.col("boost").cast("double"), F.lit(20.0))), F.lit(0.0)).alias("boost")
    )


def duration_parse(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.concat("p_size", F.element_at(F.array(*map(F.lit, ["", " days", " hours", " week", " minutes", " moons"])), (F.col("p_partkey") % 6 + 1).cast("int"))).alias("text"))
    return p.select("p_partkey", F.round(duration_hours(F.col("text")), 4).alias("hours"))


QUERIES = {
    f.__name__: f
    for f in (
        url_normalize, url_registered_domain, url_keys, reattribute_left_default, freshness_per_tier, stale_keep_null_age, keep_latest_per_key,
        pool_merge, exclude_patterns, exclude_pattern_counts, blocked_topic_first_match, category_first_match, keyword_gates, cluster_aggregate,
        cluster_digest, distinct_owner_counts, score_weighted, rank_threshold_topk, story_ranking, topk_entity_cap, one_per_owner_then_fill,
        confirmable_eligibility_reason, countable_sources, covered_anti_join, cooldown_anti_join, failed_or_theta_match, alias_join,
        entity_dictionary_merge, label_boost_join, duration_parse,
    )
}

_ORDER = "score DESC, tiers[1], age_hours, story"
_AGE = "epoch_us(TIMESTAMP '2024-01-31 00:00:00') / 3.6e9 - epoch_us({}) / 3.6e9"
_FIRST_LINE = "split_part(text, chr(10), 1)"
_PATTERN = f"CASE WHEN regexp_matches({_FIRST_LINE}, '(?i)\\bdeals?\\b') THEN '\\bdeals?\\b' WHEN regexp_matches({_FIRST_LINE}, '(?i)\\bthe the\\b') THEN '\\bthe the\\b' WHEN regexp_matches({_FIRST_LINE}, '(?i)^in\\b') THEN '^in\\b' WHEN regexp_matches({_FIRST_LINE}, '(?i)\\bof the\\b') THEN '\\bof the\\b' END"
SQL = {
    "url_normalize": f"SELECT page_id, {_NORM} AS norm FROM pages",
    "url_registered_domain": f"SELECT page_id, {_DOMAIN} AS domain FROM pages",
    "url_keys": rf"""SELECT page_id, regexp_replace({_NORM}, '/+$', '') AS claim_key, lower(regexp_replace(trim(url), '/+$', '')) AS gate_key,
        regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^[a-z][a-z0-9+.-]*://', ''), '^www\.', ''), '#.*$', ''), '/+$', '') AS verifier_key,
        starts_with(lower(url), 'https://') AND regexp_extract(url, '://([^/?#]*)', 1) IN ('m.therwh.example.net', 'tionsh.example.net') AS allowed FROM pages""",
    "reattribute_left_default": f"""WITH p AS (SELECT page_id, {_DOMAIN} AS d FROM pages), s(domain, name, tier, owner) AS (VALUES ('example.com', 'Com Daily', 1, 'com group'), ('example.org', 'Org Post', 2, 'org group'))
        SELECT page_id, d AS link_domain, coalesce(name, d) AS source_name, coalesce(tier, 3) AS tier, coalesce(owner, d) AS owner FROM p LEFT JOIN s ON d = domain""",
    "freshness_per_tier": f"""WITH e AS (SELECT event_id, CAST(user_id % 3 + 1 AS INTEGER) AS tier, {_AGE.format('ts')} AS a FROM events)
        SELECT event_id, tier, round(a, 4) AS age_hours FROM e WHERE a <= CASE tier WHEN 1 THEN 168 WHEN 2 THEN 48 ELSE 24 END""",
    "stale_keep_null_age": f"""WITH e AS (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN {_AGE.format('ts')} END AS a FROM events)
        SELECT event_id, round(a, 4) AS age_hours FROM e WHERE a IS NULL OR a <= 48""",
    "keep_latest_per_key": "SELECT event_id, user_id, event_type, ts, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id) = 1",
    "pool_merge": f"""SELECT 'https://ex.com/u/' || user_id AS link, event_id AS seq, ts AS published FROM events WHERE {_AGE.format('ts')} <= 480
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) = 1""",
    "exclude_patterns": f"SELECT doc_id FROM documents WHERE {_PATTERN} IS NULL",
    "exclude_pattern_counts": f"SELECT {_PATTERN} AS pattern, count(*) AS n FROM documents WHERE {_PATTERN} IS NOT NULL GROUP BY 1",
    "blocked_topic_first_match": r"""WITH t AS (SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'licensed|price') THEN 'money' WHEN contains(text, '!!') AND lang <> 'en' THEN 'junk'
        WHEN contains(text, '|') AND lang <> 'en' THEN 'tables' END AS topic FROM documents) SELECT * FROM t WHERE topic IS NOT NULL""",
    "category_first_match": r"""SELECT p_partkey, CASE WHEN regexp_matches(lower(p_name), '\b(?:brass|steel|tin|copper|nickel)\b') THEN 'metal' WHEN regexp_matches(lower(p_name), '\b(?:dark|light|pale|dim)\b') THEN 'shade'
        WHEN regexp_matches(lower(p_name), '\b(?:red|green|blue|white|black)\b') THEN 'colour' ELSE 'other' END AS category,
        CASE WHEN regexp_matches(lower(p_type), 'brass|steel|tin|copper|nickel') THEN 'metal' WHEN regexp_matches(lower(p_type), 'dark|light|pale|dim') THEN 'shade'
        WHEN regexp_matches(lower(p_type), 'red|green|blue|white|black') THEN 'colour' ELSE 'other' END AS guess FROM part""",
    "keyword_gates": r"""WITH k AS (SELECT doc_id, source, regexp_matches(lower(text), '(?:^|[^\p{L}\p{N}_])(?:the|und)(?:$|[^\p{L}\p{N}_])') AS k FROM documents)
        SELECT doc_id, k AS keyword, source = 'src0' OR k AS relevant, false AS scene_without_keywords FROM k""",
    "cluster_aggregate": f"WITH {_ITEMS}, {_GROUPS} SELECT story, round(age_hours, 3) AS age_hours, newest, array_to_string(tiers, ',') AS tiers, array_to_string(owners, ',') AS owners, n_items, cluster_id FROM g",
    "cluster_digest": f"""WITH p AS (SELECT DISTINCT {_DOMAIN} AS domain, {_NORM} AS u FROM pages)
        SELECT domain, CAST(count(*) AS INTEGER) AS n, substr(sha1(string_agg(u, chr(10) ORDER BY u)), 1, 12) AS cluster_id FROM p GROUP BY domain""",
    "distinct_owner_counts": f"""WITH {_ITEMS} SELECT story, count(DISTINCT owner) FILTER (tier <> 3 AND fetchable IS DISTINCT FROM false) AS n_owners,
        count(DISTINCT link) FILTER (tier <> 3 AND fetchable IS DISTINCT FROM false) AS n_sources FROM items GROUP BY story""",
    "score_weighted": f"WITH {_ITEMS}, {_GROUPS} SELECT story, {_SCORE} AS score FROM g",
    "rank_threshold_topk": f"""WITH {_ITEMS}, {_GROUPS}, s AS (SELECT *, {_SCORE} AS score FROM g) SELECT story, score FROM s WHERE score >= CASE WHEN len(owners) >= 2 THEN 55 ELSE 65 END ORDER BY {_ORDER} LIMIT 20""",
    "story_ranking": f"""WITH {_ITEMS}, {_GROUPS}, s AS (SELECT *, {_SCORE} AS score, owners[1] AS lead FROM g), t AS (SELECT * FROM s WHERE score >= CASE WHEN len(owners) >= 2 THEN 55 ELSE 65 END),
        c AS (SELECT *, row_number() OVER (PARTITION BY lead ORDER BY {_ORDER}) AS k FROM t) SELECT story, lead, score, cluster_id FROM c WHERE k <= 2 OR lead IS NULL ORDER BY {_ORDER} LIMIT 25""",
    "topk_entity_cap": """WITH p AS (SELECT p_partkey, CASE WHEN p_brand <> 'Brand#11' THEN p_brand END AS brand, p_retailprice AS score FROM part WHERE p_retailprice >= 900),
        c AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY score DESC, p_partkey) AS k FROM p) SELECT p_partkey, brand, score FROM c WHERE brand IS NULL OR k <= 2 ORDER BY score DESC, p_partkey LIMIT 30""",
    "one_per_owner_then_fill": """WITH o AS (SELECT *, s_suppkey % 3 AS owner, row_number() OVER (PARTITION BY s_nationkey, s_suppkey % 3 ORDER BY s_acctbal DESC, s_suppkey) AS k FROM supplier),
        f AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY k > 1, s_acctbal DESC, s_suppkey) AS pick FROM o) SELECT s_nationkey, s_suppkey, owner, CAST(pick AS INTEGER) AS pick FROM f WHERE pick <= 4""",
    "confirmable_eligibility_reason": f"""WITH {_ITEMS}, g AS (SELECT story, list(DISTINCT tier) AS tiers, list(DISTINCT owner) AS owners, count(DISTINCT link) FILTER (tier <> 3 AND fetchable IS DISTINCT FROM false) AS ns,
        count(DISTINCT owner) FILTER (tier <> 3 AND fetchable IS DISTINCT FROM false) AS n_o FROM items GROUP BY story)
        SELECT story, CASE WHEN NOT {_CONFIRM} THEN 'not confirmable' WHEN ns < 2 THEN 'too few sources' WHEN n_o < 2 THEN 'too few independent owners' WHEN story % 11 = 0 THEN 'excluded pattern: ''eleven''' WHEN story % 5 = 0 THEN 'off-topic' END AS reason FROM g""",
    "countable_sources": f"WITH {_ITEMS} SELECT tier, count(*) AS n FROM items WHERE tier <> 3 AND fetchable IS DISTINCT FROM false GROUP BY tier",
    "covered_anti_join": "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')",
    "cooldown_anti_join": """WITH s AS (SELECT user_id, event_type, max(ts) AS last_seen FROM events WHERE event_id % 10 = 0 GROUP BY ALL)
        SELECT event_id FROM events e WHERE event_id % 10 <> 0 AND NOT EXISTS (SELECT 1 FROM s WHERE s.user_id = e.user_id AND s.event_type = e.event_type AND TIMESTAMP '2024-01-31 00:00:00' - s.last_seen < INTERVAL 168 HOUR)""",
    "failed_or_theta_match": """WITH o AS (SELECT o_orderkey AS id, o_custkey AS k, CAST(o_orderdate AS DATE) AS u, o_orderpriority AS t, list_distinct(['a', 'b', CAST(o_custkey % 50 AS VARCHAR), CAST(o_orderkey % 40 AS VARCHAR)]) AS e FROM orders),
        f AS (SELECT c_custkey AS fid, DATE '1995-01-01' + CAST(c_custkey % 900 AS INTEGER) AS u, list_distinct(['a', 'b', CAST(c_custkey % 50 AS VARCHAR), CAST(c_custkey % 40 AS VARCHAR)]) AS e FROM customer)
        SELECT o.id, f.fid AS failed_id FROM o JOIN f ON o.k = f.fid UNION SELECT o.id, f.fid FROM o JOIN f ON o.u = f.u
        UNION SELECT o.id, f.fid FROM o JOIN f ON o.t = '1-URGENT' AND len(list_intersect(o.e, f.e)) >= 3 AND len(list_intersect(o.e, f.e)) / len(list_distinct(list_concat(o.e, f.e))) >= 0.8""",
    "alias_join": """SELECT n_nationkey, CASE lower(n_name) WHEN 'germany' THEN 'DE' WHEN 'france' THEN 'FR' WHEN 'united states' THEN 'US' WHEN 'united kingdom' THEN 'UK' ELSE n_name END AS canonical FROM nation""",
    "entity_dictionary_merge": "SELECT lower(n_name) AS canonical, CAST(CASE WHEN n_nationkey < 15 THEN 1 ELSE 2 END AS INTEGER) AS n FROM nation",
    "label_boost_join": """WITH b AS (SELECT source, sum(quality) - 5 AS b FROM documents JOIN labels USING (doc_id) GROUP BY source)
        SELECT doc_id, CAST(coalesce(greatest(0, least(b, 20)), 0) AS DOUBLE) AS boost FROM documents LEFT JOIN b USING (source)""",
    "duration_parse": """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_size::DOUBLE WHEN 1 THEN p_size * 24.0::DOUBLE WHEN 2 THEN p_size::DOUBLE WHEN 3 THEN p_size * 168.0::DOUBLE WHEN 4 THEN round(p_size / 60.0::DOUBLE, 4) END AS hours FROM part""",
}
