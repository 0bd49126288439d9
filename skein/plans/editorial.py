"""Article, media and feed queries over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import articles as A
from skein.functions import dates as D
from skein.functions import text as X
from skein.functions import udfs
from skein.functions import urls as U
from skein.operators import claims as C
from skein.operators import joins as J
from skein.operators import editorial as E
from skein.operators import media as M
from skein.plans.facts import _claims
from skein.sources import tables as S
from skein.sources.tables import table


def near_duplicate_articles(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("order "), F.col("o_custkey") % 40, F.lit(" "), F.col("o_orderpriority"), F.lit(" c"), F.col("o_custkey") % 300).alias("title"), "o_orderdate")
    return J.near_duplicate_articles(o, "o_orderkey", "title", "o_orderdate")


def robots_filter(spark, sf):
    rules = spark.createDataFrame([("tionsh.example.net", "/", False), ("tionsh.example.net", "/en/", True), ("m.therwh.example.net", "/de/", False), ("m.therwh.example.net", "/de/", True)], "host string, path string, allow boolean")
    return J.robots_allowed(table(spark, sf, "pages").select("page_id", "url"), "url", rules).select("page_id")


def budget_trim(spark, sf):
    c = _claims(spark, sf).withColumn("central", F.col("seq") == 1)
    return C.trim_to_budget(c, "story_id", 16.0, ["price 1"]).select("story_id", "seq", F.round("tokens", 4).alias("tokens"))


def member_support(spark, sf):
    c = _claims(spark, sf).withColumn("source_title", F.when(F.col("seq") == 2, F.concat(F.lit("On price "), F.col("story_id") % 50)))
    e = c.select("story_id").distinct().withColumn("entity", F.concat(F.lit("price "), F.col("story_id") % 50))
    return C.member_support(c, "story_id", e, 1).groupBy("support").agg(F.count("*").alias("n"))


def game_match(spark, sf):
    games = spark.createDataFrame([("Red",), ("Steel Rod",), ("Blue Steel",), ("Green Brass Widget",)], "game string")
    part = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("New "), F.initcap("p_name"), F.when(F.col("p_size") % 5 == 0, " 2").otherwise("")).alias("title"))
    return M.match_game(part, "p_partkey", "title", games)


def photo_rules(spark, sf):
    p = table(spark, sf, "part").select(
        "p_partkey", F.when(F.col("p_size") % 7 == 0, "image/gif").otherwise("image/jpeg").alias("mime"), (F.col("p_size") * 60).alias("width"), F.lit(1000).alias("height"),
        F.element_at(F.array(*map(F.lit, ["CC BY 4.0", "cc0", "All rights reserved", "CC BY-SA 4.0"])), (F.col("p_partkey") % 4 + 1).cast("int")).alias("license"),
        F.when(F.col("p_partkey") % 3 == 0, "").otherwise("Someone").alias("artist"), F.col("p_name").alias("title"), F.col("p_type").alias("description"), F.substring_index("p_name", " ", 1).alias("phrase"),
    )
    return p.groupBy(M.unusable_reason(1000, 1.1, 2.8, ["CC BY 4.0", "CC0"], ["asus", "xbox"]).alias("reason")).agg(F.count("*").alias("n"))


def photo_rank(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", (F.col("p_size") * 60).alias("width"), F.lit(1000).alias("height"), F.concat("p_name", F.lit(" "), "p_partkey").alias("title"), F.lit("red").alias("phrase"))
    return p.orderBy(*M.photo_order()).limit(15).select("p_partkey", "width")


def search_term_choice(spark, sf):
    part = table(spark, sf, "part")
    return part.select("p_partkey", F.array_join(M.search_terms(F.concat(F.split("p_type", " "), F.split("p_name", " ")), 3), ",").alias("terms"))


def url_dates(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.concat(F.lit("https://a.example/n"), F.date_format("ts", "/yyyy/MM/dd/"), F.lit("x")).alias("url"), F.to_date("ts").alias("d"))
    e = e.withColumn("u", U.url_date(F.col("url"), F.lit("2024-01-20").cast("timestamp"))).withColumn("feed", F.date_add("d", F.pmod("event_id", F.lit(4)).cast("int")))
    got = e.select("event_id", D.publication_anchor(F.col("u"), F.col("feed")).alias("a"))
    return got.select("event_id", F.col("a.anchor").cast("string").alias("anchor"), "a.ambiguous")


def gather_status(spark, sf):
    """Page text where there is enough, else the feed's, else the headline."""
    docs = table(spark, sf, "documents").select("doc_id", "text", F.split("text", "\n")[0].alias("head"))
    page, feed = F.when(F.col("doc_id") % 3 == 0, F.col("text")), F.when(F.col("doc_id") % 2 == 0, F.substring("text", 1, 500))
    pick = F.when(F.length(page) >= 400, "page").when(F.length(feed) >= 400, "feed").otherwise("headline")
    return docs.groupBy(pick.alias("status")).agg(F.count("*").alias("n"))


def replay_newest(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("entry"))


def stage_fingerprints(spark, sf):
    """Stories whose inputs' digest is not stored yet."""
    o = table(spark, sf, "orders").select("o_orderkey", S.fingerprint(F.col("o_custkey"), F.col("o_orderstatus")).alias("digest"))
    stored = o.where("o_orderkey % 2 = 0").select("digest").distinct()
    return o.join(stored, "digest", "left_anti").select("o_orderkey")


def number_whitelist(spark, sf):
    """Number tokens without those that a rule (pattern, context) allows."""
    docs = table(spark, sf, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b\d+\b"), 0))).alias("token"), "text")
    allowed = F.col("token").rlike(r"^\d$") | (F.col("token").rlike(r"^\d{2}$") & F.contains("text", F.lit("@")))
    return docs.where(~allowed).select("doc_id", "token")


def writer_view(spark, sf):
    """Claims as a writer sees them: numbered, clipped, without outlets as origins."""
    c = _claims(spark, sf).where("tier < 3")
    c = C.numbered(c, "story_id", "seq", "source_url", "claim", "value")
    return c.select("story_id", "id", F.substring("claim", 1, 300).alias("claim"), F.when(~F.contains("origin", F.lit("labs")), F.col("origin")).alias("origin"), F.col("source_url").alias("url"))


def article_projection(spark, sf):
    docs = table(spark, sf, "documents")
    md = docs.select("doc_id", S.render_article(F.substring("text", 1, 30), F.col("lang"), F.col("source"), F.array("lang", "source"), F.col("text")).alias("m"))
    head, body = X.front_matter(F.col("m"))
    return md.select("doc_id", S.front_value(head, "category").alias("category"), F.sha2(body, 256).alias("digest"))


def rss_items(spark, sf):
    pages = table(spark, sf, "pages")
    safe = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "&", "&amp;"), "<", "&lt;"), ">", "&gt;")
    return pages.select("page_id", F.concat(F.lit("<item><title>"), "page_id", F.lit("</title><link>"), safe(F.col("url")), F.lit("</link></item>")).alias("xml"))


def json_ld(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", F.to_json(F.struct(F.lit("NewsArticle").alias("type"), F.col("o_orderkey").alias("id"), F.struct(F.col("o_orderpriority").alias("name")).alias("author"))).alias("doc"))


def command_parse(spark, sf):
    c = table(spark, sf, "events").select("event_id", F.concat(F.lit("/blog "), "event_type", F.lit(" | idea "), "user_id", F.lit(" | https://a.example/"), "event_id", F.lit(" https://b.example")).alias("t"))
    part = F.transform(F.split(F.regexp_replace("t", r"^/blog\s+", ""), r"\|"), lambda x: F.trim(x))
    return c.select("event_id", part[0].alias("topic"), F.substring(part[1], 1, 200).alias("idea"), F.size(F.regexp_extract_all("t", F.lit(r"https?://\S+"), 0)).alias("n_urls"))


def capital_counts(spark, sf):
    words = F.regexp_extract_all(F.split("text", "\n")[0], F.lit(r"[\p{L}\p{N}]+"), 0)
    docs = table(spark, sf, "documents").select(F.explode(F.filter(words, lambda w: w.rlike("^[A-Z][a-z]+$"))).alias("w"))
    return docs.groupBy(F.lower("w").alias("word")).agg(F.count("*").alias("n")).where("n > 3")


def json_schema_violations(spark, sf):
    schema = '{"type":"object","required":["k","z"],"additionalProperties":false,"properties":{"k":{"type":"integer","minimum":10,"maximum":90},"z":{"type":"string"}}}'
    e = table(spark, sf, "events").select(F.explode(udfs.each("array<string>", A.schema_problems, F.col("props"), F.lit(schema))).alias("problem"))
    return e.groupBy("problem").agg(F.count("*").alias("n"))


def relative_dates(spark, sf):
    from datetime import date

    words = F.element_at(F.array(*map(F.lit, ["begins today", "came yesterday", "is out now", "is now open", "sold by now", "calm"])), (F.col("event_id") % 6 + 1).cast("int"))

    def rewrite(text: str, day) -> str:
        return A.absolute_time(text, date.fromisoformat(day)) or "dropped"

    e = table(spark, sf, "events").select("event_id", udfs.each("string", rewrite, words, F.date_format("ts", "yyyy-MM-dd")).alias("t"))
    return e.groupBy("t").agg(F.count("*").alias("n"))


def cue_sources(spark, sf):
    text = F.concat(F.lit("According to the firm Acme Corp, "), "event_type", F.lit(" rose. Roe Hart, the chief, has said so."))
    names = udfs.each("array<string>", lambda t: [c["kind"] + ":" + c["origin"] for c in A.cue_sources(t)], text)
    return table(spark, sf, "events").select(F.explode(names).alias("cue")).groupBy("cue").agg(F.count("*").alias("n"))


def link_articles(spark, sf):
    terms = [{"term": "with", "url": "/news/with"}, {"term": "that", "url": "/news/that"}]
    docs = table(spark, sf, "documents").select("doc_id", "text", udfs.each("string", lambda t: A.link_terms(t, terms), F.col("text")).alias("linked"))
    return docs.select("doc_id", (F.length("linked") - F.length("text")).alias("added"))


def fold_sections(spark, sf):
    body = F.concat(F.lit("## One\nshort\n\n## Two\n"), "text")
    docs = table(spark, sf, "documents").select("doc_id", udfs.each("string", A.fold_thin, body).alias("b"))
    return docs.select("doc_id", F.size(F.regexp_extract_all("b", F.lit(r"(?m)^## "), 0)).alias("n_sections"))


def drop_flagged_sentences(spark, sf):
    def drop(t: str) -> str:
        s = A.plain_sentences(t)
        return A.drop_flagged(t, s[2:3])

    # Through explode(), else the filter is pushed down and every article rewritten twice.
    docs = table(spark, sf, "documents").select("doc_id", F.length("text").alias("before"), F.explode(F.array(udfs.each("string", drop, F.col("text")))).alias("cut"))
    return docs.select("doc_id", "before", F.length("cut").alias("after")).where("after < before")


QUERIES = {
    f.__name__: f
    for f in (
        near_duplicate_articles, robots_filter, budget_trim, member_support, game_match, photo_rules, photo_rank, search_term_choice, url_dates,
        gather_status, replay_newest, stage_fingerprints, number_whitelist, writer_view, article_projection, rss_items, json_ld, command_parse,
        capital_counts, json_schema_violations, relative_dates, cue_sources, link_articles, fold_sections, drop_flagged_sentences,
    )
}

_CLAIMS = """c AS (SELECT l_orderkey AS story_id, CAST(l_linenumber AS BIGINT) AS seq, 'https://s' || l_suppkey AS source_url, CAST(l_suppkey % 3 + 1 AS INTEGER) AS tier, CAST(l_quantity AS INTEGER) % 5 AS strength,
  CASE WHEN l_suppkey % 4 = 0 THEN 'unstated' ELSE 'org ' || (l_suppkey % 5) || CASE WHEN l_suppkey % 2 = 0 THEN ' labs' ELSE '' END END AS origin,
  'price ' || l_partkey AS claim, CASE WHEN l_tax > 0.05 THEN 'about ' ELSE '' END || CAST(l_quantity AS INTEGER) || ' units' AS value FROM lineitem)"""
_PHOTO = """p AS (SELECT *, p_size * 60 AS width, ['CC BY 4.0','cc0','All rights reserved','CC BY-SA 4.0'][p_partkey % 4 + 1] AS license, string_split(p_name, ' ')[1] AS phrase FROM part)"""
SQL = {
    "near_duplicate_articles": """WITH r AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d, trim(regexp_replace(regexp_replace(lower('order ' || (o_custkey % 40) || ' ' || o_orderpriority || ' c' || (o_custkey % 300)), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS t FROM orders),
        f AS (SELECT t, min((d, k)) AS f FROM r GROUP BY t), s AS (SELECT r.k AS o_orderkey, f.f[2] AS earlier, 'title' AS why FROM r JOIN f USING (t) WHERE r.k <> f.f[2]),
        g AS (SELECT t, d, min(k) AS k, list_distinct(string_split(t, ' ')) AS w FROM r GROUP BY t, d),
        p AS (SELECT x.t, x.d, y.d AS yd, y.k AS yk FROM g x JOIN g y ON y.d BETWEEN x.d - 7 AND x.d AND x.t <> y.t AND len(list_intersect(x.w, y.w)) / (len(x.w) + len(y.w) - len(list_intersect(x.w, y.w))) >= 0.5),
        n AS (SELECT r.k AS o_orderkey, min(p.yk) AS earlier FROM r JOIN p ON r.t = p.t AND r.d = p.d AND (p.yd < r.d OR p.yk < r.k) GROUP BY r.k)
        SELECT * FROM s UNION ALL SELECT o_orderkey, earlier, 'similar' FROM n""",
    "robots_filter": "SELECT page_id FROM pages WHERE NOT (regexp_matches(url, '://tionsh\\.example\\.net(/|$)') AND NOT regexp_matches(url, '://tionsh\\.example\\.net/en/'))",
    "budget_trim": f"""WITH {_CLAIMS}, s AS (SELECT *, seq = 1 AS central, strength + CASE WHEN seq = 1 THEN 10 ELSE 0 END + CASE WHEN contains(claim || ' ' || value, 'price 1') THEN 2 ELSE 0 END AS score FROM c),
        u AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY story_id, value ORDER BY score DESC, seq, source_url, claim) = 1),
        r AS (SELECT *, sum(length(claim || ' ' || value) / 3.5) OVER (PARTITION BY story_id ORDER BY central DESC, score DESC, seq, source_url, claim, value ROWS UNBOUNDED PRECEDING) AS tokens FROM u) SELECT story_id, seq, round(tokens, 4) AS tokens FROM r WHERE central OR tokens <= 16""",
    "game_match": """WITH t AS (SELECT p_partkey, ' new ' || lower(p_name) || CASE WHEN p_size % 5 = 0 THEN ' 2' ELSE '' END || ' ' AS t FROM part), g(game, n) AS (VALUES ('Red', 1), ('Steel Rod', 2), ('Blue Steel', 2), ('Green Brass Widget', 3))
        SELECT p_partkey, game FROM t JOIN g ON contains(t, ' ' || lower(game) || ' ') AND NOT contains(t, ' ' || lower(game) || ' 2 ') QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY n DESC, game) = 1""",
    "photo_rules": f"""WITH {_PHOTO} SELECT CASE WHEN p_size % 7 = 0 THEN 'not a photo format' WHEN width < 1000 THEN 'too narrow' WHEN width / 1000 < 1.1 THEN 'too tall' WHEN width / 1000 > 2.8 THEN 'too panoramic'
        WHEN license NOT IN ('CC BY 4.0', 'cc0') THEN 'license not allowed' WHEN license = 'CC BY 4.0' AND p_partkey % 3 = 0 THEN 'no author to credit' END AS reason, count(*) AS n FROM p GROUP BY 1""",
    "photo_rank": """WITH p AS (SELECT p_partkey, p_size * 60 AS width, p_name || ' ' || p_partkey AS title, p_name AS n FROM part)
        SELECT p_partkey, width FROM p ORDER BY NOT contains(' ' || title || ' ', ' red '), NOT starts_with(title, 'red'), NOT (width / 1000 BETWEEN 1.3 AND 2.4), width DESC, title LIMIT 15""",
    "search_term_choice": """WITH t AS (SELECT p_partkey, unnest(list_distinct(list_concat(string_split(p_type, ' '), string_split(p_name, ' ')))) AS w FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY length(w) DESC, w) AS k FROM t)
        SELECT p_partkey, string_agg(w, ',' ORDER BY k) AS terms FROM r WHERE k <= 3 GROUP BY p_partkey""",
    "url_dates": """WITH e AS (SELECT event_id, CAST(ts AS DATE) AS d, event_id % 4 AS g FROM events), f AS (SELECT *, CASE WHEN d <= DATE '2024-01-20' THEN d END AS u FROM e)
        SELECT event_id, CASE WHEN u IS NOT NULL AND g > 1 THEN NULL ELSE strftime(coalesce(u, CAST(d + CAST(g AS INTEGER) AS DATE)), '%Y-%m-%d') END AS anchor, u IS NOT NULL AND g > 1 AS ambiguous FROM f""",
    "gather_status": "SELECT CASE WHEN doc_id % 3 = 0 AND length(text) >= 400 THEN 'page' WHEN doc_id % 2 = 0 AND length(text) >= 400 THEN 'feed' ELSE 'headline' END AS status, count(*) AS n FROM documents GROUP BY 1",
    "replay_newest": "SELECT user_id, arg_max(event_id, (ts, event_id)) AS entry FROM events GROUP BY user_id",
    "stage_fingerprints": "SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM orders x WHERE x.o_orderkey % 2 = 0 AND x.o_custkey = o.o_custkey AND x.o_orderstatus = o.o_orderstatus)",
    "number_whitelist": r"""WITH t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '\b\d+\b')) AS token, contains(text, '@') AS c FROM documents) SELECT doc_id, token FROM t WHERE NOT (length(token) = 1 OR (length(token) = 2 AND c))""",
    "writer_view": f"""WITH {_CLAIMS} SELECT story_id, 'F' || row_number() OVER (PARTITION BY story_id ORDER BY seq, source_url, claim, value) AS id, claim, CASE WHEN NOT contains(origin, 'labs') THEN origin END AS origin, source_url AS url FROM c WHERE tier < 3""",
    "article_projection": "SELECT doc_id, source AS category, sha256(text) AS digest FROM documents",
    "rss_items": "SELECT page_id, '<item><title>' || page_id || '</title><link>' || replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</link></item>' AS xml FROM pages",
    "json_ld": """SELECT o_orderkey, '{"type":"NewsArticle","id":' || o_orderkey || ',"author":{"name":"' || o_orderpriority || '"}}' AS doc FROM orders""",
    "command_parse": "SELECT event_id, event_type AS topic, 'idea ' || user_id AS idea, 2 AS n_urls FROM events",
    "capital_counts": r"""WITH w AS (SELECT unnest(regexp_extract_all(split_part(text, chr(10), 1), '[\p{L}\p{N}]+')) AS w FROM documents) SELECT lower(w) AS word, count(*) AS n FROM w WHERE regexp_full_match(w, '[A-Z][a-z]+') GROUP BY 1 HAVING count(*) > 3""",
    "json_schema_violations": """WITH e AS (SELECT CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events) SELECT '$.z: missing' AS problem, count(*) AS n FROM e
        UNION ALL SELECT '$.k: under 10', count(*) FROM e WHERE k < 10 HAVING count(*) > 0 UNION ALL SELECT '$.k: over 90', count(*) FROM e WHERE k > 90 HAVING count(*) > 0""",
    "cue_sources": "SELECT unnest(['lead:Acme Corp', 'subject:Roe Hart']) AS cue, count(*) AS n FROM events GROUP BY 1",
}


# ---- drafts -----------------------------------------------------------------


def _drafts(spark, sf):
    docs = table(spark, sf, "documents")
    first = F.split("text", "\n")[0]
    return docs.select("doc_id", F.substring(first, 1, 90).alias("title"), F.substring("text", 1, 150).alias("description"), X.slugify(F.substring(first, 1, 40)).alias("slug"), F.array("source", "lang").alias("tags"), "text", "source")


def seo_validation(spark, sf):
    return E.seo_errors(_drafts(spark, sf), "doc_id")


def title_entity_coverage(spark, sf):
    d = _drafts(spark, sf).withColumn("entities", F.array(F.substring_index("title", " ", 2), F.lit("the")))
    return E.title_coverage(d, "doc_id", "title", "entities")


def entity_mentions(spark, sf):
    d = _drafts(spark, sf).withColumn("entities", F.array(F.lit("of the"), F.lit("licensed under"), F.substring_index("title", " ", 1)))
    return E.entity_mentions(d, "doc_id", "text", "entities").groupBy("entity").agg(F.count("*").alias("n")).where("n > 3")


def outlet_names(spark, sf):
    d = _drafts(spark, sf)
    outlets = d.select("doc_id", F.explode(F.array(F.lit("The"), F.lit("the"), F.lit("Of"))).alias("outlet"))
    return E.outlets_named(d, "doc_id", "text", outlets).groupBy("outlet").agg(F.count("*").alias("n"))


def offers_and_completeness(spark, sf):
    d = _drafts(spark, sf).withColumn("facts", F.when(F.col("doc_id") % 2 == 0, "until 2024-05-01, all of it").otherwise("soon"))
    return E.offer_gate(d, "doc_id", "text", "facts", ["tion of", "and the"]).unionByName(E.completeness_gate(d, "doc_id", "text", "facts", ["all", "the"]))


def performance_claims(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("runs "), F.when(F.col("p_size") % 2 == 0, F.concat("p_size", F.lit(" percent far "))).otherwise("much much much much more or less "), F.lit("faster than a, b, c, d and 9")).alias("t"))
    return p.groupBy(E.numeric_claims(F.col("t"), ["faster", "slower"], 3).alias("numeric")).agg(F.count("*").alias("n"))


def statement_attribution(spark, sf):
    c = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("story"), F.col("o_orderkey").alias("clause_id"), (F.col("o_orderkey") % 2).alias("fact_id"),
        F.when(F.col("o_orderkey") % 3 == 0, "Hart says yes").otherwise("so it goes").alias("clause"), F.when(F.col("o_orderkey") % 5 == 0, "Roe Hart").otherwise("they").alias("sentence"),
    )
    f = table(spark, sf, "customer").select(F.col("c_custkey").alias("story"), F.explode(F.array(F.lit(0).cast("bigint"), F.lit(1).cast("bigint"))).alias("fact_id")).withColumn("kind", F.when(F.col("fact_id") == 0, "statement").otherwise("confirmed")).withColumn("speakers", F.array(F.lit("Roe Hart")))
    return E.statement_attribution(c, f, "story").select("clause_id")


def _short(text: str) -> str:
    if len(text) > 100:
        raise ValueError("too long")
    return '{"n": %d}' % len(text)


def _any(text: str) -> str:
    return '{"n": %d, "cut": true}' % min(len(text), 100)


def model_call_chain(spark, sf):
    """A chain of two deterministic stand-ins: the second takes what the first cannot."""
    c = table(spark, sf, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("key"), "text")
    got = E.model_calls(c, "key", "text", {"small": _short, "large": _any}, ["n"])
    return got.groupBy("provider").agg(F.count("*").alias("n"), F.count("error").alias("errors"))


def stage_timing(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("stage"), F.floor("value").alias("seconds"))
    return E.stage_seconds(e)


for _f in (
    seo_validation, title_entity_coverage, entity_mentions, outlet_names, offers_and_completeness, performance_claims, statement_attribution,
    model_call_chain, stage_timing,
):
    QUERIES[_f.__name__] = _f

_DRAFT = r"""a AS (SELECT doc_id, text, substr(split_part(text, chr(10), 1), 1, 90) AS title, substr(text, 1, 150) AS d, lower(regexp_replace(regexp_replace(substr(split_part(text, chr(10), 1), 1, 40), '[^A-Za-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS slug FROM documents)"""
_FORM = r"trim(regexp_replace(regexp_replace(lower({}), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"
SQL |= {
    "seo_validation": rf"""WITH {_DRAFT} SELECT doc_id, 'seo' AS "check", unnest(list_filter([CASE WHEN length(title) < 15 OR length(title) > 65 THEN 'title length' END, CASE WHEN regexp_matches(title, '[!?]{{2,}}|\.\.\.$') THEN 'title punctuation' END,
        CASE WHEN upper(title) = title THEN 'title in capitals' END, CASE WHEN length(d) < 70 OR length(d) > 160 THEN 'description length' END, CASE WHEN {_FORM.format('title')} = {_FORM.format('d')} THEN 'description repeats title' END,
        CASE WHEN NOT regexp_matches(slug, '^[a-z0-9]+(?:-[a-z0-9]+)*$') THEN 'slug form' END], lambda x: x IS NOT NULL)) AS failure FROM a""",
    "performance_claims": "SELECT p_size % 2 = 0 AS numeric, count(*) AS n FROM part GROUP BY 1",
    "statement_attribution": "SELECT o_orderkey AS clause_id FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 AND o_custkey IN (SELECT c_custkey FROM customer)",
    "model_call_chain": "SELECT CASE WHEN length(text) > 100 THEN 'large' ELSE 'small' END AS provider, count(*) AS n, count(*) FILTER (length(text) > 100) AS errors FROM conversations GROUP BY 1",
    "stage_timing": "SELECT event_type AS stage, CAST(sum(floor(value)) AS BIGINT) AS seconds, count(*) AS runs FROM events GROUP BY 1",
    "offers_and_completeness": r"""WITH a AS (SELECT doc_id, lower(text) AS t, doc_id % 2 = 0 AS e FROM documents)
        SELECT doc_id, 'offers' AS "check", 'tion of without a date' AS failure FROM a WHERE contains(t, 'tion of') AND NOT e UNION ALL SELECT doc_id, 'offers', 'and the without a date' FROM a WHERE contains(t, 'and the') AND NOT e
        UNION ALL SELECT doc_id, 'completeness', 'all' FROM a WHERE regexp_matches(t, '(^|[^\p{L}\p{N}\p{M}_])all($|[^\p{L}\p{N}\p{M}_])') AND NOT e UNION ALL SELECT doc_id, 'completeness', 'the' FROM a WHERE regexp_matches(t, '(^|[^\p{L}\p{N}\p{M}_])the($|[^\p{L}\p{N}\p{M}_])')""",
    "outlet_names": r"""WITH a AS (SELECT text AS p FROM documents) SELECT o AS outlet, count(*) AS n FROM a, (VALUES ('The'), ('Of')) v(o) WHERE regexp_matches(p, '(^|[^\p{L}\p{N}\p{M}_])' || o || '($|[^\p{L}\p{N}\p{M}_])') GROUP BY o""",
}


def html_to_text_native(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", X.plain_html(F.col("html")).alias("t"))
    return pages.select("page_id", F.length("t").alias("n_chars"), F.sha2("t", 256).alias("digest"))


QUERIES["html_to_text_native"] = html_to_text_native
_DAY = "strftime(CAST(ts AS DATE) + INTERVAL ({}) DAY, '%B %-d, %Y')"
_FOLDED = "strip_accents(replace(split_part(text, chr(10), 1), 'ß', 'ss'))"
SQL |= {
    "html_to_text_native": r"""WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<(script|style)\b[^>]*>.*?</(?:script|style)\s*>|<!--.*?-->', '', 'g') AS t FROM pages),
        b AS (SELECT page_id, regexp_replace(regexp_replace(t, '(?i)</?(?:p|br|div|li|ul|ol|h[1-6]|tr|table|section|article|blockquote|pre|hr)\b[^>]*>', chr(10), 'g'), '(?s)<[^>]*>', '', 'g') AS t FROM a),
        c AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&') AS t FROM b),
        d AS (SELECT page_id, array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS t FROM c)
        SELECT page_id, CAST(length(t) AS INTEGER) AS n_chars, sha256(t) AS digest FROM d""",
    "relative_dates": f"""WITH e AS (SELECT CASE event_id % 6 WHEN 0 THEN 'begins on ' || {_DAY.format(0)} WHEN 1 THEN 'came on ' || {_DAY.format(-1)} WHEN 2 THEN 'is available as of ' || {_DAY.format(0)}
        WHEN 3 THEN 'is open' WHEN 4 THEN 'dropped' ELSE 'calm' END AS t FROM events) SELECT t, count(*) AS n FROM e GROUP BY t""",
    "accent_folding": rf"""SELECT doc_id, lower(regexp_replace(regexp_replace(regexp_replace({_FOLDED}, '[^\x00-\x7F]', '', 'g'), '[^A-Za-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS slug,
        trim(regexp_replace(lower({_FOLDED}), '[^a-z0-9]+', ' ', 'g')) AS form FROM documents""",
    "entity_mentions": rf"""WITH {_DRAFT}, e AS (SELECT doc_id, text, unnest(['of the', 'licensed under', string_split(title, ' ')[1]]) AS entity FROM a),
        m AS (SELECT entity FROM e WHERE NOT ({_FORM.format('entity')} <> '' AND contains(' ' || {_FORM.format('text')} || ' ', ' ' || {_FORM.format('entity')} || ' '))) SELECT entity, count(*) AS n FROM m GROUP BY entity HAVING count(*) > 3""",
}
