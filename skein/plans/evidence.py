"""Queries on evidence, gates and small state over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skein.functions import dates as D
from skein.functions import text as X
from skein.operators import claims as C
from skein.operators import editorial as E
from skein.operators import gates as G
from skein.operators import joins as J
from skein.operators import site as P
from skein.operators import stories as S
from skein.operators import texts as T
from skein.plans import texts as plain
from skein.plans.facts import _CL, _claims
from skein.plans.stories import _HOST
from skein.sources.tables import table
from skein.streaming import state as Z

NOW = "2024-01-31 00:00:00"


def claims_validation(spark, sf):
    """Answers of orders, some without a kind or with another address; refused ones count by problem."""
    i = F.col("l_linenumber")
    claim = F.struct(
        F.concat(F.lit("price "), "l_partkey").alias("claim"), F.when(i % 7 != 0, F.concat(F.lit(" "), "l_quantity", F.lit(" units "))).alias("value"),
        F.when(F.col("l_suppkey") % 10 != 0, F.concat(F.lit("https://s"), "l_suppkey")).otherwise("ftp://s").alias("source_url"),
        F.when(F.col("l_suppkey") % 3 == 0, " ").otherwise(F.concat(F.lit(" Org "), F.col("l_suppkey") % 5)).alias("origin"), F.when(i % 2 == 0, "confirmed").otherwise("reported").alias("kind"),
    )
    answers = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", claim.alias("c")))).alias("l"))
    answers = answers.select("l_orderkey", F.when(F.col("l_orderkey") % 11 == 0, "no answer").otherwise(F.to_json(F.struct(F.col("l.c").alias("claims")))).alias("answer"))
    kept, refused = C.validated(answers, "l_orderkey", "answer")
    good = kept.groupBy("origin", "kind").agg(F.count("*").alias("n")).withColumn("what", F.concat_ws(" ", "origin", "kind"))
    return good.select("what", "n").unionByName(refused.groupBy(F.col("problem").alias("what")).agg(F.count("*").alias("n")))


def numbered_claims(spark, sf):
    c = C.numbered(_claims(spark, sf), "story_id", "seq", "source_url", "claim", "value")
    return c.select("story_id", "id", "seq")


def origin_resolution(spark, sf):
    """Which origins of claims hold in the text they come from, and why the others do not."""
    c = _claims(spark, sf).withColumn("id", F.concat_ws("-", "story_id", "seq"))
    said = F.when(F.col("seq") % 3 == 0, F.concat(F.lit("According to "), "origin", F.lit(", it is so."))).when(F.col("seq") % 3 == 1, F.concat(F.lit("It was at "), "origin", F.lit("."))).otherwise("Nobody was asked.")
    c = c.withColumn("text", said).withColumn("outlet", F.lit("org 3")).withColumn("origin", F.when(F.col("tier") == 1, F.concat("origin", F.lit("; an unnamed source"))).otherwise(F.col("origin")))
    return C.resolve_origins(c, "id", "text", [], ["org 4"])


def preceding_names(spark, sf):
    t = table(spark, sf, "conversations")
    return t.select("conv_id", "turn", C.preceding_name(F.lower("text"), " that ", ["the", "with", "de la", "de"]).alias("name")).where("name IS NOT NULL")


def claim_sources(spark, sf):
    """Claims with the names of their sources; a fifth of the suppliers have moved to another address."""
    sources = table(spark, sf, "supplier").select(F.concat(F.lit("HTTPS://www.S"), "s_suppkey", F.when(F.col("s_suppkey") % 5 == 0, ".moved").otherwise(""), F.lit(".example/#top")).alias("link"), "s_name")
    c = _claims(spark, sf).withColumn("source_url", F.concat("source_url", F.lit(".example/")))
    return J.claims_with_sources(c, sources).groupBy("s_name").agg(F.count("*").alias("n"))


def contributing_sources(spark, sf):
    sources = table(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit("https://s"), "s_suppkey").alias("link"))
    return J.contributing(sources, _claims(spark, sf).where("kind = 'confirmed' AND first_party")).select("s_suppkey")


def restored_rumors(spark, sf):
    # Line numbers repeat within an order, so its claims are numbered anew.
    place = F.row_number().over(Window.partitionBy("story_id").orderBy("seq", "source_url", "claim", "value"))
    c = _claims(spark, sf).withColumn("seq", place).withColumn("value", F.concat(F.lit("sold "), F.col("fact"), F.lit(" again")))
    return C.restore_rumors(c, "story_id", 3).groupBy("kind").agg(F.count("*").alias("n"))


def coherent_claims(spark, sf):
    c = _claims(spark, sf).withColumn("title", F.concat(F.lit("On Org "), F.col("fact"), F.lit(" today")))
    kept = C.coherent(c, ["price 17", "org 4"], F.concat_ws(" ", "claim", "value"), F.col("title"))
    return kept.select("story_id", "seq")


def sentence_ids(spark, sf):
    e = table(spark, sf, "events")
    ids = F.array(F.col("event_id") % 5 - 1, F.col("event_id") % 3, F.col("event_id") % 5 - 1, F.col("user_id") % 7, F.lit(4))
    return e.select("event_id", F.array_join(C.clean_ids(ids), ",").alias("ids"))


def story_keys(spark, sf):
    o = table(spark, sf, "orders")
    names = F.array("o_orderpriority", "o_orderstatus", F.lit(""), "o_orderstatus", F.lit(None).cast("string"))
    return o.select("o_orderkey", X.story_key(names, F.when(F.col("o_custkey") % 3 != 0, "sales")).alias("key"))


def set_relations(spark, sf):
    a, b = F.split(F.lower("p_name"), " "), F.split(F.lower("p_type"), " ")
    out = lambda c: F.array_join(X.sorted_set(c), ",")
    only = F.concat(F.array_except(a, b), F.array_except(b, a))
    return table(spark, sf, "part").select("p_partkey", out(F.array_intersect(a, b)).alias("shared"), out(F.array_except(a, b)).alias("left"), out(only).alias("different"), X.is_subset(b, a).alias("inside"))


def headline_restated(spark, sf):
    units, words = F.array_distinct(F.split(F.lower("p_name"), " ")), F.split(F.lower(F.concat_ws(" ", "p_type", "p_brand")), " ")
    return table(spark, sf, "part").select("p_partkey", F.round(C.restated(units, words), 6).alias("share"))


def currencies(spark, sf):
    text = F.concat(F.lit("Costs "), "p_size", F.lit(" Gold Coins, 1,200 "), F.initcap("p_name"), F.lit(" or 3 gems"))
    return table(spark, sf, "part").select("p_partkey", F.array_join(E.currency_names(text), ",").alias("names"))


def sentence_dates(spark, sf):
    e = table(spark, sf, "events").withColumn("d", F.to_date("ts"))
    said = F.when(F.col("event_id") % 3 == 0, F.date_format("d", "'out on 'yyyy-MM-dd")).when(F.col("event_id") % 3 == 1, F.date_format("d", "'it came 'MMMM d', then'")).otherwise(F.date_format("d", "'since 'yyyy' or so'"))
    return e.select("event_id", D.first_date(said).alias("found"), D.iso_midnight(F.col("d")).alias("midnight"))


def numbered_sentences(spark, sf):
    return T.sentences(table(spark, sf, "documents"), "doc_id", F.col("text")).select("doc_id", "pos", F.sha2("sentence", 256).alias("digest"))


def unseen_stories(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.array(F.concat(F.lit("u"), F.col("event_id") % 400)).alias("urls"), F.array(F.col("user_id").cast("string")).alias("entities"), F.col("event_type").alias("story_type"), "ts")
    urls = e.where("story_type = 'error'").select(F.explode("urls").alias("url"))
    types = e.where("story_type != 'click'").groupBy("entities", "story_type").agg(F.min("ts").alias("last_seen"))
    return J.unseen(e, "event_id", urls, types, F.lit(NOW).cast("timestamp_ntz"), 700.0).select("event_id")


def link_candidates(spark, sf):
    e = table(spark, sf, "events")
    return P.link_targets(e, "event_id", "ts", F.col("user_id"), F.lit("2024-01-20 12:00:00").cast("timestamp_ntz")).groupBy("event_type").agg(F.count("*").alias("n"))


def message_lines(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.message(F.col("html"), 120).alias("line"))


def feed(spark, sf):
    o = table(spark, sf, "orders")
    return P.rss(o, "o_orderkey", F.concat("o_orderpriority", F.lit(" & <more>")), F.concat(F.lit("https://a.example/?a=1&b="), "o_orderkey"), "o_orderdate", "Site", 20)


BANNED, OPENER = ["licensed under", "!!"], r"(?i)^((?:the|of|in|to)\s+[a-z]+)\b"


def _suite(spark, sf):
    """Failure rows of all gates over the documents as articles.

    Checks of one text stay in its row, unless several rows share an id.
    """
    a = plain._articles(spark, sf)
    by_row = not T.keys_repeat(a, "doc_id")
    sents = plain._sents(spark, sf)
    rows = T.lines(a, "doc_id", F.col("body"))
    reviews = a.select("doc_id", (F.col("doc_id") % 13 != 0).alias("passed"), F.concat(F.lit("Alpha-"), F.col("doc_id") % 3).alias("writer"), F.when(F.col("doc_id") % 17 == 0, "alpha 2").otherwise("beta 1").alias("verifier"))
    opinions = sents.where("pos = 0").select("doc_id", F.lit("first").alias("clause"), F.slice(plain._words("sentence"), 1, 6).alias("words"), F.array(F.lit("the"), F.lit("Roe Der")).alias("names"))
    spoken = a.withColumn("facts", F.when(F.col("doc_id") % 2 == 0, "unlike the others").otherwise("")).withColumn("speakers", F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("Hart"))).otherwise(F.array().cast("array<string>")))
    if by_row:
        own = [G.row_gates(a, "doc_id", "body", "first", ["the", "Roe Der"], ["this", "these", "the"], OPENER, lambda line: F.length(line) < 60, ["tion of the"], plain.STOP)]
    else:
        own = [
            G.opinion_gate(opinions, sents.select("doc_id", "pos", "sentence", plain._words("sentence").alias("words")), "doc_id"),
            G.found_gate(T.repeated_tokens(a, "doc_id", plain._words("body"), 20), "doc_id", "repeated facts", F.col("token")),
            G.found_gate(T.dangling(sents, "doc_id", ["this", "these", "the"]), "doc_id", "dangling", F.col("pos")),
            G.found_gate(T.opener_counts(sents, "doc_id", OPENER, 1), "doc_id", "openers", F.col("opener")),
            G.sections_gate(rows, "doc_id", F.length("line") < 60, ["tion of the"]),
            G.found_gate(T.near_duplicate_sentences(a, "doc_id", F.col("body"), plain.STOP), "doc_id", "near duplicates", F.concat_ws("-", "first_pos", "pos")),
        ]
    return a, own + [
        G.schema_gate(a, "doc_id", ["en", "fr", "de"]),
        G.structure_gate(a.withColumn("body", F.concat(F.when(F.col("doc_id") % 5 == 0, "# A\n\n# B\n\n#### Sources\n\n").when(F.col("doc_id") % 5 == 1, "# A\n\n## B\n\n").otherwise(""), "body")), "doc_id", "body", 60),
        G.leak_gate(a.withColumn("body", F.concat("body", F.when(F.col("doc_id") % 19 == 0, " as F12 says").otherwise(""))), "doc_id", "body"),
        G.overlap_gate(a, "doc_id", "body", table(spark, sf, "benchmark"), "text", by_row=by_row),
        G.phrase_gate(a, "doc_id", "body", "banned", BANNED),
        G.relative_time_gate(a, "doc_id", ["title", "body"], ["is", "von"]),
        G.attribution_gate(spoken, "doc_id", "body", "facts", "speakers", ["the of", "unlike the"], ["the", "der"]),
        E.offer_gate(a.withColumn("facts", F.lit("soon")), "doc_id", "body", "facts", ["tion of"]),
        E.completeness_gate(a.withColumn("facts", F.lit("all")), "doc_id", "body", "facts", ["all", "every", "the"]),
        G.found_gate(P.duplicated(a, "doc_id", F.col("title")), "doc_id", "duplicates", F.col("n")),
        G.review_gate(reviews, "doc_id"),
    ]


def gate_suite(spark, sf):
    """The verdict of all gates that need no other site: one row an article."""
    a, checks = _suite(spark, sf)
    return G.verdict(a, "doc_id", *checks)


def gate_failures(spark, sf):
    """How many failures each gate finds."""
    from functools import reduce

    _, checks = _suite(spark, sf)
    return reduce(lambda x, y: x.unionByName(y), checks).groupBy("check").agg(F.count("*").alias("n"))


def gate_repairs(spark, sf):
    """Sentences that must change because they hold a banned phrase."""
    found = G.phrase_gate(plain._articles(spark, sf), "doc_id", "body", "banned", BANNED)
    return G.repairs(found, plain._sents(spark, sf), "doc_id", ["banned"])


def headline_claims(spark, sf):
    s = table(spark, sf, "supplier").withColumn("owner", F.when(F.col("s_suppkey") % 4 != 0, F.concat(F.lit("Org "), F.col("s_nationkey"))))
    verb = F.element_at(F.array(*map(F.lit, ["announces a line", "and others today launched it", "was seen in town", "has at last revealed it"])), (F.col("s_nationkey") % 4 + 1).cast("int"))
    s = s.withColumn("title", F.concat(F.lit(" Org "), F.when(F.col("s_suppkey") % 3 == 0, F.col("s_nationkey") + 1).otherwise(F.col("s_nationkey")), F.lit(" "), verb)).withColumn("link", F.lit("https://a.example"))
    return C.headline_claims(s, "title", "owner", "s_name", "link").select("s_suppkey", "claim", "origin", "kind")


def manual_items(spark, sf):
    pages = table(spark, sf, "pages").withColumn("topic", F.concat(F.lit("Page "), "page_id"))
    items = S.url_items(pages, "url", "topic", F.lit(NOW).cast("timestamp_ntz"))
    return items.select("title", "source_name", "tier")


def article_topics(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", P.topic_links(F.array("p_name", F.lit("??"), "p_type")).alias("l"))
    return part.select("p_partkey", F.array_join(F.transform("l", lambda x: x["slug"]), ",").alias("slugs"))


def fetch_headers(spark, sf):
    e = table(spark, sf, "events")
    log = e.select("user_id", F.when(F.col("event_type") == "error", 304).otherwise(200).alias("status"), F.concat(F.lit("e"), "event_id").alias("etag"), F.date_format("ts", "yyyy-MM-dd").alias("last_modified"), F.struct("ts", "event_id").alias("fetched"))
    feeds = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    return Z.conditional_headers(feeds, log, "user_id").select("user_id", "etag", "last_modified")


def run_ledgers(spark, sf):
    e = table(spark, sf, "events").select(
        "user_id", F.col("event_id").alias("seq"), F.when(F.col("event_id") % 3 == 0, "verifier").otherwise("writer").alias("role"), F.col("event_type").alias("family"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("call "), "event_id")).alias("error"),
    )
    got = Z.run_ledger(e, "user_id")
    return got.select("user_id", "calls", F.array_join("writer_families", ",").alias("writers"), "verifier_family", F.array_join("fallbacks", ",").alias("fallbacks"))


def retry_delays(spark, sf):
    e = table(spark, sf, "events")
    delay = F.when(F.col("event_id") % 2 == 0, 10.0).otherwise(30.0)
    return e.select("event_id", Z.jitter(delay, 0.25, (F.col("user_id") % 8) / 8).alias("delay"))


QUERIES = {
    f.__name__: f
    for f in (
        headline_claims, manual_items, article_topics, fetch_headers, run_ledgers, retry_delays,
        claims_validation, numbered_claims, origin_resolution, preceding_names, claim_sources, contributing_sources, restored_rumors, coherent_claims,
        sentence_ids, story_keys, set_relations, headline_restated, currencies, sentence_dates, numbered_sentences, unseen_stories, link_candidates,
        message_lines, feed, gate_suite, gate_failures, gate_repairs,
    )
}

_ESC = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_DROP = "SELECT doc_id, '{}' AS \"check\" FROM ({})"
_W = plain._W
_WB = r"(^|[^\p{{L}}\p{{N}}\p{{M}}_]){}($|[^\p{{L}}\p{{N}}\p{{M}}_])"
_SUITE = rf"""{plain._A.format(n=200)}, {plain._SENT},
  st AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'A B Sources ' WHEN 1 THEN 'A B ' ELSE '' END AS h, CASE WHEN {plain._MD} = '' THEN 0 ELSE len(string_split({plain._MD}, ' ')) END AS n FROM documents),
  sw AS (SELECT doc_id, pos, sentence, {_W.format('sentence')} AS w FROM s), op AS (SELECT doc_id, list_slice(w, 1, 6) AS ow FROM sw WHERE pos = 0 AND len(list_slice(w, 1, 6)) >= 4),
  ob AS (SELECT sw.doc_id, sw.sentence FROM sw JOIN op ON sw.doc_id = op.doc_id WHERE len(list_intersect(w, ow)) / len(list_distinct(ow)) >= 0.6
    QUALIFY row_number() OVER (PARTITION BY sw.doc_id ORDER BY len(list_intersect(w, ow)) / len(list_distinct(ow)) DESC, pos) = 1),
  q AS (SELECT doc_id, regexp_replace(lower(text), '"[^"]*"|“[^”]*”', ' ', 'g') AS b, regexp_replace(lower(title), '"[^"]*"|“[^”]*”', ' ', 'g') AS t FROM a),
  ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
  fail AS (
    SELECT doc_id, "check" FROM ({plain._SCHEMA})
    UNION ALL SELECT doc_id, 'structure' FROM st WHERE n + len(string_split(h, ' ')) - 1 < 60
    UNION ALL SELECT doc_id, 'structure' FROM st, (VALUES (1), (2), (3)) WHERE doc_id % 5 = 0
    UNION ALL SELECT doc_id, 'leak' FROM a WHERE doc_id % 19 = 0
    UNION ALL SELECT doc_id, 'overlap' FROM ({plain.SQL['ngram_overlap_ratio']}) WHERE n_shared / nullif(n_grams, 0) > 0.2
    UNION ALL SELECT doc_id, 'banned' FROM a WHERE contains(lower(text), 'licensed under') UNION ALL SELECT doc_id, 'banned' FROM a WHERE contains(text, '!!')
    UNION ALL SELECT doc_id, 'relative time' FROM q, (VALUES ('is'), ('von')) v(w) WHERE regexp_matches(b, '{_WB.format("' || w || '").replace('{{', '{').replace('}}', '}')}')
    UNION ALL SELECT doc_id, 'relative time' FROM q, (VALUES ('is'), ('von')) v(w) WHERE regexp_matches(t, '{_WB.format("' || w || '").replace('{{', '{').replace('}}', '}')}')
    UNION ALL SELECT doc_id, 'attribution' FROM a WHERE contains(lower(text), 'the of') UNION ALL SELECT doc_id, 'attribution' FROM a WHERE contains(lower(text), 'unlike the') AND doc_id % 2 <> 0
    UNION ALL SELECT doc_id, 'opinion attribution' FROM ob WHERE NOT regexp_matches(' ' || {plain._NT.replace(plain._T, 'sentence')} || ' ', ' (the|roe der|der) ')
    UNION ALL SELECT doc_id, 'offers' FROM a WHERE contains(lower(text), 'tion of')
    UNION ALL SELECT doc_id, 'completeness' FROM a, (VALUES ('every'), ('the')) v(w) WHERE regexp_matches(lower(text), '{_WB.format("' || w || '").replace('{{', '{').replace('}}', '}')}')
    UNION ALL {_DROP.format('repeated facts', plain.SQL['repeated_tokens'])} UNION ALL {_DROP.format('near duplicates', plain.SQL['near_duplicate_sentences'])}
    UNION ALL {_DROP.format('dangling', plain.SQL['dangling_lag'])} UNION ALL {_DROP.format('openers', plain.SQL['opener_counts'])}
    UNION ALL {_DROP.format('thin sections', plain.SQL['section_groups'])} UNION ALL SELECT doc_id, 'sections' FROM ({plain.SQL['section_groups']}) WHERE n_words = 0
    UNION ALL SELECT doc_id, 'sections' FROM ln WHERE contains(lower(line), 'tion of the')
    UNION ALL SELECT doc_id, 'duplicates' FROM (SELECT doc_id, count(*) OVER (PARTITION BY lower(title)) AS n FROM a) WHERE n > 1
    UNION ALL SELECT doc_id, 'verify report' FROM a WHERE doc_id % 13 = 0 UNION ALL SELECT doc_id, 'model families' FROM a WHERE doc_id % 17 = 0)"""

SQL = {
    "claims_validation": """WITH l AS (SELECT *, l_linenumber % 7 = 0 AS lacks, l_suppkey % 10 = 0 AS off FROM lineitem),
        o AS (SELECT l_orderkey, CASE WHEN l_orderkey % 11 = 0 THEN 'no claims' WHEN bool_or(lacks) THEN 'field missing' WHEN bool_or(off) THEN 'no web address' END AS problem FROM l GROUP BY l_orderkey),
        k AS (SELECT CASE WHEN l_suppkey % 3 = 0 THEN 'unstated' ELSE 'org ' || (l_suppkey % 5) END AS origin, CASE WHEN l_linenumber % 2 = 0 AND l_suppkey % 3 <> 0 THEN 'confirmed' ELSE 'reported' END AS kind FROM l JOIN o USING (l_orderkey) WHERE problem IS NULL)
        SELECT origin || ' ' || kind AS what, count(*) AS n FROM k GROUP BY 1 UNION ALL SELECT problem, count(*) FROM o WHERE problem IS NOT NULL GROUP BY 1""",
    "numbered_claims": f"WITH {_CL} SELECT story_id, 'F' || row_number() OVER (PARTITION BY story_id ORDER BY seq, source_url, claim, value) AS id, seq FROM c",
    "origin_resolution": f"""WITH {_CL}, p AS (SELECT story_id || '-' || seq AS id, seq % 3 AS z, origin, unnest(CASE WHEN tier = 1 THEN [origin, 'an unnamed source'] ELSE [origin] END) AS part FROM c),
        m AS (SELECT id, part, CASE WHEN part = 'an unnamed source' THEN 'anonymous' WHEN part = 'org 4' THEN 'product' WHEN z = 2 THEN 'not named' WHEN part = 'org 3' THEN 'self' WHEN z = 1 THEN 'not attributed' END AS why FROM p WHERE part <> 'unstated'),
        g AS (SELECT id, string_agg(DISTINCT part, '; ' ORDER BY part) FILTER (why IS NULL) AS origin, string_agg(DISTINCT part || ': ' || why, '; ' ORDER BY part || ': ' || why) FILTER (why IS NOT NULL) AS dropped FROM m GROUP BY id)
        SELECT d.id, coalesce(origin, 'unstated') AS origin, coalesce(dropped, '') AS dropped FROM (SELECT story_id || '-' || seq AS id FROM c) d LEFT JOIN g USING (id)""",
    "claim_sources": "SELECT s_name, count(*) AS n FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey AND s_suppkey % 5 <> 0 GROUP BY s_name",
    "contributing_sources": f"WITH {_CL} SELECT s_suppkey FROM supplier WHERE 'https://s' || s_suppkey IN (SELECT source_url FROM c WHERE kind = 'confirmed' AND first_party)",
    "restored_rumors": f"""WITH {_CL}, w AS (SELECT *, list_filter(list_distinct(regexp_extract_all(claim || ' sold ' || fact || ' again', '[\\p{{L}}\\p{{N}}_]+')), lambda x: length(x) >= 4) AS w FROM c)
        SELECT CASE WHEN kind = 'rumor' AND EXISTS (SELECT 1 FROM w b WHERE b.story_id = a.story_id AND b.kind IN ('confirmed', 'statement') AND len(list_intersect(a.w, b.w)) >= 3) THEN 'reported' ELSE kind END AS kind, count(*) AS n FROM w a GROUP BY 1""",
    "coherent_claims": f"WITH {_CL} SELECT story_id, seq FROM c WHERE claim = 'price 17' OR fact = 4",
    "sentence_ids": """WITH x AS (SELECT event_id, [event_id % 5 - 1, event_id % 3, event_id % 5 - 1, user_id % 7, 4] AS x FROM events), y AS (SELECT event_id, list_filter(x, lambda v: v >= 0) AS x FROM x)
        SELECT event_id, array_to_string(list_slice(list_filter(x, lambda v, i: list_position(x, v) = i), 1, 3), ',') AS ids FROM y""",
    "story_keys": "SELECT o_orderkey, array_to_string(list_sort(list_distinct([o_orderpriority, o_orderstatus])), ',') || '|' || CASE WHEN o_custkey % 3 <> 0 THEN 'sales' ELSE '' END AS key FROM orders",
    "set_relations": """WITH x AS (SELECT p_partkey, list_distinct(string_split(lower(p_name), ' ')) AS a, list_distinct(string_split(lower(p_type), ' ')) AS b FROM part),
        y AS (SELECT *, list_filter(a, lambda v: NOT list_contains(b, v)) AS ab, list_filter(b, lambda v: NOT list_contains(a, v)) AS ba FROM x)
        SELECT p_partkey, array_to_string(list_sort(list_intersect(a, b)), ',') AS shared, array_to_string(list_sort(ab), ',') AS "left", array_to_string(list_sort(list_concat(ab, ba)), ',') AS different, len(ba) = 0 AS inside FROM y""",
    "headline_restated": """WITH x AS (SELECT p_partkey, list_distinct(string_split(lower(p_name), ' ')) AS a, string_split(lower(p_type || ' ' || p_brand), ' ') AS b FROM part) SELECT p_partkey, round(len(list_intersect(a, b)) / len(a), 6) AS share FROM x""",
    "currencies": r"""WITH n AS (SELECT p_partkey, p_size, list_transform(string_split(lower(p_name), ' '), lambda w: upper(w[1]) || w[2:]) AS w FROM part)
        SELECT p_partkey, array_to_string(list_sort(list_distinct(regexp_extract_all('Costs ' || p_size || ' Gold Coins, 1,200 ' || array_to_string(w, ' ') || ' or 3 gems', '\b\d[\d,]*\s+([A-Z][\w-]+(?:\s[A-Z][\w-]+)?)', 1))), ',') AS names FROM n""",
    "sentence_dates": "SELECT event_id, CASE event_id % 3 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN strftime(ts, '%B %-d') ELSE strftime(ts, '%Y') END AS found, strftime(ts, '%Y-%m-%dT00:00:00Z') AS midnight FROM events",
    "numbered_sentences": f"WITH {plain._SENT} SELECT doc_id, CAST(pos AS INTEGER) AS pos, sha256(sentence) AS digest FROM s",
    "unseen_stories": """WITH t AS (SELECT user_id, event_type, min(ts) AS at FROM events WHERE event_type <> 'click' GROUP BY ALL)
        SELECT event_id FROM events e WHERE event_id % 400 NOT IN (SELECT event_id % 400 FROM events WHERE event_type = 'error')
        AND NOT EXISTS (SELECT 1 FROM t WHERE t.user_id = e.user_id AND t.event_type = e.event_type AND epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(t.at) < 700 * 3600000000)""",
    "link_candidates": "SELECT event_type, count(*) AS n FROM events WHERE event_id <> user_id AND ts <= TIMESTAMP '2024-01-19 12:00:00' GROUP BY event_type",
    "message_lines": rf"""WITH l AS (SELECT page_id, trim(regexp_replace(html, '\s+', ' ', 'g')) AS t FROM pages) SELECT page_id, {_ESC.format("CASE WHEN length(t) > 120 THEN substr(t, 1, 119) || '…' ELSE t END")} AS line FROM l""",
    "feed": f"""WITH t AS (SELECT *, CAST(row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS INTEGER) AS place FROM orders QUALIFY place <= 20),
        i AS (SELECT place, '<item><title>' || {_ESC.format("o_orderpriority || ' & <more>'")} || '</title><link>' || {_ESC.format("'https://a.example/?a=1&b=' || o_orderkey")} || '</link><pubDate>' || strftime(o_orderdate, '%a, %d %b %Y %H:%M:%S GMT') || '</pubDate></item>' AS xml FROM t)
        SELECT place, xml FROM i UNION ALL SELECT 0, '<rss version="2.0"><channel><title>Site</title>' || string_agg(xml, '' ORDER BY place) || '</channel></rss>' FROM i""",
    "headline_claims": """WITH s AS (SELECT s_suppkey, 'Org ' || CASE WHEN s_suppkey % 3 = 0 THEN s_nationkey + 1 ELSE s_nationkey END AS org, CASE WHEN s_suppkey % 4 <> 0 THEN 'Org ' || s_nationkey ELSE s_name END AS who,
          CASE s_nationkey % 4 WHEN 0 THEN 'announces a line' WHEN 1 THEN 'and others today launched it' WHEN 2 THEN 'was seen in town' ELSE 'has at last revealed it' END AS verb FROM supplier)
        SELECT s_suppkey, org || ' ' || verb AS claim, lower(who) AS origin, CASE WHEN org = who AND verb = 'announces a line' THEN 'confirmed' ELSE 'reported' END AS kind FROM s""",
    "manual_items": f"""SELECT 'Page ' || page_id AS title, {_HOST} AS source_name, 3 AS tier FROM pages""",
    "article_topics": """SELECT p_partkey, replace(lower(p_name), ' ', '-') || ',' || replace(lower(p_type), ' ', '-') AS slugs FROM part""",
    "fetch_headers": """WITH l AS (SELECT user_id, arg_max(event_id, (ts, event_id)) AS id, max(ts) AS ts FROM events WHERE event_type <> 'error' GROUP BY user_id)
        SELECT c_custkey AS user_id, 'e' || id AS etag, strftime(ts, '%Y-%m-%d') AS last_modified FROM customer LEFT JOIN l ON user_id = c_custkey""",
    "run_ledgers": """SELECT user_id, count(*) FILTER (event_type <> 'error') AS calls, coalesce(string_agg(event_type, ',' ORDER BY event_id) FILTER (event_type <> 'error' AND event_id % 3 <> 0), '') AS writers,
        arg_max(event_type, event_id) FILTER (event_type <> 'error' AND event_id % 3 = 0) AS verifier_family, coalesce(string_agg('call ' || event_id, ',' ORDER BY event_id) FILTER (event_type = 'error'), '') AS fallbacks FROM events GROUP BY user_id""",
    "retry_delays": "SELECT event_id, round(CASE WHEN event_id % 2 = 0 THEN 10.0::DOUBLE ELSE 30.0::DOUBLE END * (1 + 0.25::DOUBLE * (2 * ((user_id % 8) / 8.0::DOUBLE) - 1)), 3) AS delay FROM events",
    "gate_suite": f"""WITH {_SUITE} SELECT doc_id, count("check") = 0 AS passed, count("check") AS n_failures, coalesce(string_agg(DISTINCT "check", ',' ORDER BY "check"), '') AS failed_checks FROM documents LEFT JOIN fail USING (doc_id) GROUP BY doc_id""",
    "gate_failures": f"""WITH {_SUITE} SELECT "check", count(*) AS n FROM fail GROUP BY 1""",
    "gate_repairs": f"""WITH {plain._SENT}, f AS (SELECT doc_id, unnest(list_filter(['licensed under', '!!'], lambda p: contains(lower(text), p))) AS failure FROM documents)
        SELECT f.doc_id, 'banned' AS "check", failure, CAST(pos AS INTEGER) AS pos FROM f LEFT JOIN s ON f.doc_id = s.doc_id AND contains(lower(sentence), failure)""",
}
