"""Text, gate and site queries over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import text as X
from skein.operators import gates as G
from skein.operators import joins as J
from skein.operators import site as W
from skein.operators import texts as T
from skein.sources.tables import table

STOP = ["the", "and", "der", "die", "und", "les", "des", "que", "los", "las"]

# Shared SQL.
_W = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}\p{{M}}_]+')"
_DW = _W.format("text")
_SENT = r"""s AS (SELECT doc_id, CAST(unnest(range(len(l))) AS INTEGER) AS pos, unnest(l) AS sentence FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(regexp_replace(
  regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+', chr(10), 'g'), '\n'), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents))"""


def _sents(spark, sf):
    return T.sentences(table(spark, sf, "documents"), "doc_id", F.col("text"))


def _words(c: str):
    return X.words(F.col(c))


def word_count(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", F.size(_words("text")).cast("bigint").alias("n_words"), X.markdown_words(F.col("text")).cast("bigint").alias("n_markdown"))


def content_words(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", F.array_join(F.array_sort(T.content_words(F.col("text"), STOP)), " ").alias("content"))


def title_normalize(spark, sf):
    docs = table(spark, sf, "documents")
    title = F.split("text", "\n")[0]
    return docs.select(
        "doc_id", X.normalize_title(title).alias("norm"), F.array_join(F.array_sort(X.title_tokens(title)), " ").alias("tokens"),
        X.slugify(title).alias("slug"), X.fit_words(title, 40).alias("fit"), F.round(X.token_estimate(F.col("text")), 4).alias("n_tokens"),
    )


def prose_measure_simple(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", X.prose_measure(X.simple_sentences(F.col("text"))).alias("m"))
    return docs.select("doc_id", "m.prose_chars", "m.prose_sentences", "m.ok")


def strip_boilerplate(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", F.sha2(X.strip_boilerplate(F.col("text"), ["licensed under", "!!"]), 256).alias("digest"))


def leak_detector(spark, sf):
    docs = table(spark, sf, "events").select("event_id", F.array_join(X.leaks(F.col("props")), ",").alias("leaks"))
    return docs.where("leaks != ''")


def ngram_overlap_ratio(spark, sf):
    docs, bench = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    got = T.gram_overlap(docs, "doc_id", "text", bench, "text", 8)
    return got.select("doc_id", "n_grams", "n_shared", F.round("ratio", 6).alias("ratio"))


def most_copied_sentences(spark, sf):
    grams = T.gram_rows(table(spark, sf, "benchmark"), [], "text", 4)
    return T.most_copied(_sents(spark, sf), "doc_id", grams, 4, 0.05)


def near_duplicate_sentences(spark, sf):
    return T.near_duplicate_sentences(table(spark, sf, "documents"), "doc_id", F.col("text"), STOP)


def repeated_tokens(spark, sf):
    return T.repeated_tokens(table(spark, sf, "documents"), "doc_id", _words("text"), 20)


def over_limit_sentences(spark, sf):
    return T.over_limit(_sents(spark, sf), "doc_id", _words("sentence"), 40)


def opener_counts(spark, sf):
    return T.opener_counts(_sents(spark, sf), "doc_id", r"(?i)^((?:the|of|in|to)\s+[a-z]+)\b", 1)


def dangling_lag(spark, sf):
    return T.dangling(_sents(spark, sf), "doc_id", ["this", "these", "the"])


def section_groups(spark, sf):
    rows = T.lines(table(spark, sf, "documents"), "doc_id", F.col("text"))
    return T.thin_sections(rows, "doc_id", F.length("line") < 60)


def dependent_sentences(spark, sf):
    s = _sents(spark, sf).withColumn("flagged", F.contains("sentence", F.lit("the")))
    return T.dependents(s, "doc_id", r"^(?:It|That|This|They)\b")


def best_sentence_match(spark, sf):
    s = _sents(spark, sf).select("doc_id", "pos", _words("sentence").alias("words"))
    clauses = s.where("pos = 0").select("doc_id", F.lit("head").alias("clause"), F.slice("words", 1, 6).alias("words")).where(F.size("words") > 0)
    return T.best_sentence(clauses, s.where("pos > 0"), "doc_id", 0.5).select("doc_id", "pos", F.round("share", 4).alias("share"))


def value_anti_join(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b\d+(?:\.\d+)?\b"), 0))).alias("token"))
    known = table(spark, sf, "part").select(F.col("p_size").cast("string").alias("token"))
    return T.missing_values(docs, "doc_id", known)


def date_value_anti_join(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.concat(F.lit("D:"), F.date_format("ts", "yyyy-MM-dd")).alias("token"))
    known = table(spark, sf, "events").where("event_id % 500 = 0").select(F.concat(F.lit("D:"), F.when(F.col("event_id") % 1000 == 0, F.date_format("ts", "MM-dd")).otherwise(F.date_format("ts", "yyyy-MM-dd"))).alias("token"))
    return T.missing_values(e, "event_id", known)


def _articles(spark, sf):
    docs = table(spark, sf, "documents")
    first = F.split("text", "\n")[0]
    return docs.select(
        "doc_id", "lang", "source", first.alias("title"), F.substring("text", 1, F.lit(200)).alias("description"), F.col("text").alias("body"),
        F.when(F.col("doc_id") % 9 != 0, F.col("lang")).alias("category"), F.filter(F.array("source"), lambda t: t != "src3").alias("tags"),
    )


def schema_gate(spark, sf):
    return G.schema_gate(_articles(spark, sf).withColumn("description", F.substring("body", 1, 120)), "doc_id", ["en", "fr", "de"])


def gate_verdict(spark, sf):
    a = _articles(spark, sf)
    checks = (
        G.schema_gate(a, "doc_id", ["en", "fr", "de"]), G.words_gate(a, "doc_id", "body", 60), G.phrase_gate(a, "doc_id", "body", "banned", ["licensed under", "!!"]),
        G.phrase_gate(a, "doc_id", "body", "relative", ["today", "tion of"], quoted=False),
    )
    return G.verdict(a, "doc_id", *checks)


def sources_gate(spark, sf):
    pages = table(spark, sf, "pages")
    docs = pages.select("page_id", F.array(F.col("url"), F.upper("url"), F.lit("ftp://x/"), F.concat(F.lit("http://a/"), F.col("page_id") % 7)).alias("sources"))
    docs = docs.withColumn("sources", F.when(F.col("page_id") % 3 == 0, F.slice("sources", 1, 1)).otherwise(F.col("sources")))
    sheet = pages.select("page_id", "url").unionByName(pages.select("page_id", F.lit("http://a/3").alias("url")))
    return G.sources_gate(docs, "page_id", "sources", sheet)


def internal_links(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("see [a](/news/s"), F.col("doc_id") % 30, F.lit(") and [b](/news/s"), F.col("doc_id") % 7, F.lit("/#x)")).alias("body"))
    slugs = spark.range(0, 20).select(F.concat(F.lit("s"), "id").alias("slug"))
    return G.link_gate(docs, "doc_id", "body", slugs)


def html_page_checks(spark, sf):
    return G.page_checks(table(spark, sf, "pages"), "page_id", "html")


def heading_steps(spark, sf):
    """Events of a user as the headings of an article, their value as the level."""
    rows = table(spark, sf, "events").select("user_id", F.col("event_id").alias("pos"), (F.floor("value").cast("int") % 4 + 1).alias("level"))
    return T.heading_steps(rows, "user_id")


def latest_listing(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return W.newest(orders, "o_orderdate", "o_orderkey")


def topic_counts_top12(spark, sf):
    return W.top_topics(table(spark, sf, "documents").select(F.array("source", "lang", "lang").alias("entities")), "entities")


def topic_hub(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.upper("source").alias("source"), F.lower("source").alias("slug"), "n_chars")
    got = W.topic_hubs(docs, "doc_id", "source", "slug", "n_chars", 5)
    return got.select("slug", "name", "n", F.array_join(F.transform("newest", lambda x: x.cast("string")), ",").alias("newest"))


def category_pages(spark, sf):
    names = spark.createDataFrame([(x,) for x in ("en", "fr", "de", "es", "it", "pl")], "name string")
    return W.category_pages(table(spark, sf, "documents"), "lang", names)


def search_postings_bm25(spark, sf):
    index = W.search_index(table(spark, sf, "documents"), "doc_id", _words("text"))
    return W.search(index, "doc_id", ["thing", "with", "mente"]).select("doc_id", F.round("score", 4).alias("score"))


def search_two_pass(spark, sf):
    docs = table(spark, sf, "documents")
    index = W.search_index(docs, "doc_id", _words("text"))
    return W.search_two_pass(index, docs, "doc_id", F.col("lang") == "fr", ["und", "with"], 10).select("doc_id", F.round("score", 4).alias("score"), "pass")


def unique_slug(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", X.slugify(F.col("p_name")).alias("slug"))
    taken = part.where("p_partkey < 5").select("slug").distinct().withColumn("n", F.lit(1))
    return W.unique_slugs(part, "p_partkey", "slug", taken)


def duplicate_titles(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.split("text", "\n")[0].alias("title"))
    return W.duplicated(docs, "doc_id", F.col("title"))


def tag_normalize(spark, sf):
    part = table(spark, sf, "part")
    return part.select("p_partkey", F.array_join(W.tags(F.split("p_type", " "), F.split("p_name", " "), 4), ",").alias("tags"))


def shared_terms_related_top3(spark, sf):
    part = table(spark, sf, "part").select(
        "p_partkey", F.split("p_name", " ").alias("entities"), F.array("p_brand").alias("keywords"), F.col("p_size").alias("category"), F.col("p_retailprice").alias("t")
    )
    return J.related(part, "p_partkey", "entities", "keywords", "category", "t").select("article", "other", "score", "nth")


def topic_phrase_match(spark, sf):
    phrases = spark.createDataFrame([("a", "with the"), ("b", "licensed under"), ("c", "est pour")], "topic string, phrase string")
    titles = table(spark, sf, "documents").select("doc_id", F.split("text", "\n")[0].alias("title"))
    return J.phrase_matches(titles, "title", phrases).select("doc_id", "topic")


QUERIES = {
    f.__name__: f
    for f in (
        word_count, content_words, title_normalize, prose_measure_simple, strip_boilerplate, leak_detector, ngram_overlap_ratio, most_copied_sentences,
        near_duplicate_sentences, repeated_tokens, over_limit_sentences, opener_counts, dangling_lag, section_groups, dependent_sentences,
        best_sentence_match, value_anti_join, date_value_anti_join, schema_gate, gate_verdict, sources_gate, internal_links, html_page_checks,
        heading_steps, latest_listing, topic_counts_top12, topic_hub, category_pages, search_postings_bm25, search_two_pass, unique_slug,
        duplicate_titles, tag_normalize, shared_terms_related_top3, topic_phrase_match,
    )
}

_MD = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '```.*?```', ' ', 'gs'), '!\[[^\]]*\]\([^)]*\)', ' ', 'g'), '\[([^\]]*)\]\([^)]*\)', '\1', 'g'),
  '(?m)^\s{0,3}(?:#{1,6}\s+|>\s?|[-*+]\s+|\d+\.\s+)', '', 'g'), '[*_`~]+', '', 'g'), '\s+', ' ', 'g'))"""
_CW = r"list_distinct(list_filter({}, lambda x: length(x) > 2 AND x NOT IN ('the', 'and', 'der', 'die', 'und', 'les', 'des', 'que', 'los', 'las')))"
_T = "split_part(text, chr(10), 1)"
_NT = rf"trim(regexp_replace(regexp_replace(lower({_T}), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"
_GRAMS = "list_transform(range(1, len({w}) - {n} + 2), lambda i: array_to_string(list_slice({w}, i, i + {n} - 1), ' '))"
_BM = f"""w AS (SELECT doc_id, unnest({_DW}) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY ALL), sz AS (SELECT doc_id, sum(tf) AS len FROM tf GROUP BY doc_id),
  tot AS (SELECT count(*) AS docs, avg(len) AS mean FROM sz), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
  ix AS (SELECT doc_id, term, ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean)) AS weight FROM tf JOIN sz USING (doc_id) JOIN df USING (term), tot)"""
_SCHEMA = """SELECT doc_id, 'schema' AS "check", unnest(list_filter([CASE WHEN length(title) > 65 THEN 'title too long' END, CASE WHEN length(d) < 70 OR length(d) > 160 THEN 'description length' END,
  CASE WHEN category IS NULL OR category NOT IN ('en', 'fr', 'de') THEN 'unknown category' END, CASE WHEN source = 'src3' THEN 'no tags' END], lambda x: x IS NOT NULL)) AS failure FROM a"""
_A = f"a AS (SELECT doc_id, source, text, {_T} AS title, substr(text, 1, {{n}}) AS d, CASE WHEN doc_id % 9 <> 0 THEN lang END AS category FROM documents)"

SQL = {
    "word_count": f"SELECT doc_id, len({_DW}) AS n_words, CASE WHEN {_MD} = '' THEN 0 ELSE len(string_split({_MD}, ' ')) END AS n_markdown FROM documents",
    "content_words": f"SELECT doc_id, array_to_string(list_sort({_CW.format(_DW)}), ' ') AS content FROM documents",
    "title_normalize": rf"""WITH t AS (SELECT doc_id, text, {_T} AS title, {_NT} AS norm FROM documents),
        f AS (SELECT doc_id, string_split_regex(trim(title), '\s+') AS w FROM t),
        g AS (SELECT doc_id, w, (SELECT coalesce(max(k), 0) FROM (SELECT unnest(range(1, len(w) + 1)) AS k) WHERE length(array_to_string(list_slice(w, 1, k), ' ')) <= 40) AS k FROM f)
        SELECT t.doc_id, norm, array_to_string(list_sort(list_filter(list_distinct(string_split(norm, ' ')), lambda x: length(x) >= 3 AND x NOT IN ('the','a','an','new','first','why','how','what','when','who','this','that','these','those','is','are','and','but','for'))), ' ') AS tokens,
        lower(regexp_replace(regexp_replace(title, '[^A-Za-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS slug, array_to_string(list_slice(g.w, 1, g.k), ' ') AS fit, round(length(text) / 3.5, 4) AS n_tokens FROM t JOIN g USING (doc_id)""",
    "prose_measure_simple": rf"""WITH {_SENT}, p AS (SELECT doc_id, sum(length(sentence)) AS c, count(*) AS n FROM s WHERE len(string_split_regex(trim(sentence), '\s+')) >= 5 AND regexp_matches(sentence, '[.!?]$') GROUP BY doc_id)
        SELECT doc_id, CAST(coalesce(c, 0) AS INTEGER) AS prose_chars, CAST(coalesce(n, 0) AS INTEGER) AS prose_sentences, coalesce(c >= 400 AND n >= 3, false) AS ok FROM documents LEFT JOIN p USING (doc_id)""",
    "strip_boilerplate": r"""SELECT doc_id, sha256(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(lower(x), 'licensed under|!!')
        AND (regexp_matches(x, '^\s*#{1,6}\s') OR len(string_split_regex(trim(x), '\s+')) >= 4)), chr(10))) AS digest FROM documents""",
    "leak_detector": r"""SELECT event_id, 'raw json' AS leaks FROM events WHERE regexp_matches(props, '[\[{]\s*"[^"]+"\s*:')""",
    "ngram_overlap_ratio": f"""WITH d AS (SELECT doc_id, {_DW} AS w FROM documents), b AS (SELECT {_DW} AS w FROM benchmark),
        dg AS (SELECT DISTINCT doc_id, unnest({_GRAMS.format(w='w', n=8)}) AS g FROM d), bg AS (SELECT DISTINCT unnest({_GRAMS.format(w='w', n=8)}) AS g FROM b),
        c AS (SELECT doc_id, count(*) AS n, count(bg.g) AS s FROM dg LEFT JOIN bg ON dg.g = bg.g GROUP BY doc_id)
        SELECT doc_id, coalesce(n, 0) AS n_grams, coalesce(s, 0) AS n_shared, round(coalesce(s / n, 0), 6) AS ratio FROM documents LEFT JOIN c USING (doc_id)""",
    "most_copied_sentences": f"""WITH {_SENT}, sw AS (SELECT doc_id, pos, {_W.format('sentence')} AS w FROM s), b AS (SELECT {_DW} AS w FROM benchmark),
        sg AS (SELECT DISTINCT doc_id, pos, unnest({_GRAMS.format(w='w', n=4)}) AS g FROM sw), bg AS (SELECT DISTINCT unnest({_GRAMS.format(w='w', n=4)}) AS g FROM b),
        c AS (SELECT doc_id, pos, count(*) AS total, count(bg.g) AS shared FROM sg LEFT JOIN bg ON sg.g = bg.g GROUP BY ALL),
        r AS (SELECT *, sum(shared) OVER (PARTITION BY doc_id) - coalesce(sum(shared) OVER (PARTITION BY doc_id ORDER BY shared DESC, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ls,
          sum(total) OVER (PARTITION BY doc_id) - coalesce(sum(total) OVER (PARTITION BY doc_id ORDER BY shared DESC, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lt FROM c)
        SELECT doc_id, pos, shared FROM r WHERE shared > 0 AND ls / lt > 0.05""",
    "near_duplicate_sentences": f"""WITH {_SENT}, x AS (SELECT doc_id, pos, {_CW.format(_W.format('sentence'))} AS w FROM s), y AS (SELECT * FROM x WHERE len(w) >= 3)
        SELECT b.doc_id, b.pos, min(a.pos) AS first_pos FROM y a JOIN y b ON a.doc_id = b.doc_id AND a.pos < b.pos WHERE len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) >= 0.7 GROUP BY ALL""",
    "repeated_tokens": f"SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest({_DW}) AS token FROM documents) GROUP BY ALL HAVING count(*) > 20",
    "over_limit_sentences": f"""WITH {_SENT}, t AS (SELECT doc_id, pos, unnest(range(len(w))) AS i, unnest(w) AS token FROM (SELECT doc_id, pos, {_W.format('sentence')} AS w FROM s)),
        r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, token ORDER BY pos, i) AS k FROM t) SELECT DISTINCT doc_id, pos FROM r WHERE k > 40""",
    "opener_counts": rf"""WITH {_SENT}, o AS (SELECT doc_id, lower(regexp_extract(sentence, '(?i)^((?:the|of|in|to)\s+[a-z]+)(?:$|[^\p{{L}}\p{{N}}\p{{M}}_])', 1)) AS opener FROM s)
        SELECT doc_id, opener, count(*) AS n FROM o WHERE opener <> '' GROUP BY ALL HAVING count(*) > 1""",
    "dangling_lag": rf"""WITH {_SENT}, o AS (SELECT doc_id, pos, lower(regexp_extract(sentence, '(?i)^(?:this|these|the)\s+([\p{{L}}\p{{N}}\p{{M}}_]+)', 1)) AS noun, lag(sentence) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM s)
        SELECT doc_id, pos FROM o WHERE noun <> '' AND NOT list_contains({_W.format("coalesce(b, '')")}, noun)""",
    "section_groups": rf"""WITH l AS (SELECT doc_id, unnest(range(len(x))) AS pos, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
        z AS (SELECT *, last_value(CASE WHEN length(line) < 60 THEN pos END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM l),
        c AS (SELECT doc_id, section, CASE WHEN pos <> section THEN line ELSE '' END AS t FROM z WHERE section IS NOT NULL),
        k AS (SELECT doc_id, section, len({_W.format('t')}) AS nw, len(list_filter(list_transform(string_split_regex(regexp_replace(t, '([.!?])\s+', '\1' || chr(10), 'g'), '\n'), lambda x: trim(x)), lambda x: x <> '')) AS ns FROM c)
        SELECT doc_id, CAST(section AS INTEGER) AS section, CAST(sum(nw) AS BIGINT) AS n_words, CAST(sum(ns) AS BIGINT) AS n_sentences FROM k GROUP BY ALL HAVING sum(nw) < 40 OR sum(ns) < 2""",
    "dependent_sentences": rf"""WITH {_SENT}, o AS (SELECT *, lag(contains(sentence, 'the')) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM s) SELECT doc_id, pos FROM o WHERE b AND regexp_matches(sentence, '^(?:It|That|This|They)\b')""",
    "best_sentence_match": f"""WITH {_SENT}, x AS (SELECT doc_id, pos, {_W.format('sentence')} AS w FROM s), c AS (SELECT doc_id, list_distinct(list_slice(w, 1, 6)) AS cw FROM x WHERE pos = 0 AND len(w) > 0),
        m AS (SELECT x.doc_id, x.pos, len(list_intersect(cw, w)) / len(cw) AS share FROM x JOIN c ON x.doc_id = c.doc_id AND x.pos > 0)
        SELECT doc_id, pos, round(share, 4) AS share FROM m QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY m.share DESC, pos) = 1 AND m.share >= 0.5""",
    "value_anti_join": r"""WITH t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '\b\d+(?:\.\d+)?\b')) AS token FROM documents) SELECT doc_id, token FROM t WHERE token NOT IN (SELECT CAST(p_size AS VARCHAR) FROM part)""",
    "date_value_anti_join": """WITH k AS (SELECT strftime(ts, '%m-%d') AS d, CASE WHEN event_id % 1000 <> 0 THEN strftime(ts, '%Y') END AS y FROM events WHERE event_id % 500 = 0)
        SELECT event_id, 'D:' || strftime(ts, '%Y-%m-%d') AS token FROM events e WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.d = strftime(e.ts, '%m-%d') AND (k.y IS NULL OR k.y = strftime(e.ts, '%Y')))""",
    "schema_gate": f"WITH {_A.format(n=120)} {_SCHEMA}",
    "gate_verdict": f"""WITH {_A.format(n=200)}, f AS ({_SCHEMA} UNION ALL SELECT doc_id, 'structure', 'few' FROM a WHERE CASE WHEN {_MD} = '' THEN 0 ELSE len(string_split({_MD}, ' ')) END < 60
        UNION ALL SELECT doc_id, 'banned', 'l' FROM a WHERE contains(lower(text), 'licensed under') UNION ALL SELECT doc_id, 'banned', '!' FROM a WHERE contains(text, '!!')
        UNION ALL SELECT doc_id, 'relative', 't' FROM a WHERE contains(regexp_replace(lower(text), '"[^"]*"|“[^”]*”', ' ', 'g'), 'today') UNION ALL SELECT doc_id, 'relative', 'o' FROM a WHERE contains(regexp_replace(lower(text), '"[^"]*"|“[^”]*”', ' ', 'g'), 'tion of'))
        SELECT doc_id, count("check") = 0 AS passed, count("check") AS n_failures, coalesce(string_agg(DISTINCT "check", ',' ORDER BY "check"), '') AS failed_checks FROM documents LEFT JOIN f USING (doc_id) GROUP BY doc_id""",
    "sources_gate": """WITH d AS (SELECT page_id, url, page_id % 3 = 0 AS one, lower(rtrim(trim(url), '/')) AS k FROM pages)
        SELECT page_id, 'sources' AS "check", 'fewer than two sources' AS failure FROM d WHERE one
        UNION ALL SELECT page_id, 'sources', 'not a web address' FROM d WHERE NOT one UNION ALL SELECT page_id, 'sources', 'repeated source' FROM d WHERE NOT one
        UNION ALL SELECT page_id, 'sources', 'not in sheet: ftp://x' FROM d WHERE NOT one UNION ALL SELECT page_id, 'sources', 'not in sheet: http://a/' || (page_id % 7) FROM d WHERE NOT one AND page_id % 7 <> 3""",
    "internal_links": """SELECT doc_id, 'links' AS "check", 'no such page: s' || (doc_id % 30) AS failure FROM documents WHERE doc_id % 30 >= 20""",
    "html_page_checks": r"""SELECT page_id, CAST(len(regexp_extract_all(lower(html), '<h1[\s>]')) AS INTEGER) AS n_h1, CAST(len(regexp_extract_all(lower(html), '<link[^>]+rel=["'']?canonical')) AS INTEGER) AS n_canonical,
        len(list_filter(regexp_extract_all(html, '(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>', 1), lambda x: NOT json_valid(x))) > 0 AS bad_json_ld FROM pages""",
    "heading_steps": """WITH h AS (SELECT user_id, event_id AS pos, CAST(floor(value) AS INTEGER) % 4 + 1 AS level FROM events),
        l AS (SELECT *, lag(level, 1, 1) OVER (PARTITION BY user_id ORDER BY pos) AS b FROM h) SELECT user_id, min(pos) AS pos FROM l WHERE level > b + 1 GROUP BY user_id""",
    "latest_listing": "SELECT o_orderkey, o_orderdate, CAST(row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS INTEGER) AS place FROM orders QUALIFY place <= 13",
    "topic_counts_top12": "WITH t AS (SELECT source AS topic FROM documents UNION ALL SELECT lang FROM documents) SELECT topic, count(*) AS n FROM t GROUP BY topic ORDER BY n DESC, topic LIMIT 12",
    "topic_hub": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id DESC) AS k FROM documents)
        SELECT source AS slug, upper(source) AS name, count(*) AS n, string_agg(doc_id::VARCHAR, ',' ORDER BY k) FILTER (k <= 5) AS newest FROM r GROUP BY source""",
    "category_pages": "SELECT name, count(d.doc_id) AS n FROM (VALUES ('en'), ('fr'), ('de'), ('es'), ('it'), ('pl')) v(name) LEFT JOIN documents d ON d.lang = name GROUP BY name",
    "search_postings_bm25": f"WITH {_BM}, h AS (SELECT doc_id, sum(weight) AS score FROM ix WHERE term IN ('thing', 'with', 'mente') GROUP BY doc_id) SELECT doc_id, round(score, 4) AS score FROM h ORDER BY round(h.score, 9) DESC, doc_id LIMIT 20",
    "search_two_pass": f"""WITH {_BM}, h AS (SELECT doc_id, lang, sum(weight) AS score FROM ix JOIN documents USING (doc_id) WHERE term IN ('und', 'with') GROUP BY ALL),
        p1 AS (SELECT doc_id, score, 1 AS pass FROM h WHERE lang = 'fr' ORDER BY round(score, 9) DESC, doc_id LIMIT 10), p2 AS (SELECT doc_id, score, 2 AS pass FROM h ORDER BY round(score, 9) DESC, doc_id LIMIT 10)
        SELECT doc_id, round(score, 4) AS score, pass FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2 WHERE (SELECT count(*) FROM p1) = 0)""",
    "unique_slug": r"""WITH s AS (SELECT p_partkey, lower(regexp_replace(regexp_replace(p_name, '[^A-Za-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS slug FROM part),
        r AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY p_partkey) + CASE WHEN slug IN (SELECT slug FROM s WHERE p_partkey < 5) THEN 1 ELSE 0 END AS k FROM s)
        SELECT p_partkey, CASE WHEN k = 1 THEN slug ELSE slug || '-' || k END AS slug FROM r""",
    "duplicate_titles": f"WITH t AS (SELECT doc_id, count(*) OVER (PARTITION BY lower({_T})) AS n FROM documents) SELECT doc_id, n FROM t WHERE n > 1",
    "tag_normalize": """WITH t AS (SELECT p_partkey, list_concat(list_transform(string_split(p_type, ' '), lambda x: lower(trim(x))), string_split(p_name, ' ')) AS l FROM part),
        u AS (SELECT p_partkey, list_filter(l, lambda x, i: list_position(l, x) = i) AS l FROM t) SELECT p_partkey, array_to_string(list_slice(l, 1, 4), ',') AS tags FROM u""",
    "shared_terms_related_top3": """WITH t AS (SELECT DISTINCT p_partkey AS a, unnest(string_split(p_name, ' ')) AS term, 2 AS w FROM part UNION ALL SELECT p_partkey, p_brand, 1 FROM part),
        s AS (SELECT x.a AS article, y.a AS other, sum(x.w) AS shared FROM t x JOIN t y ON x.term = y.term AND x.w = y.w AND x.a <> y.a GROUP BY ALL),
        c AS (SELECT article, other, shared + CASE WHEN p.p_size = q.p_size THEN 1 ELSE 0 END AS score, q.p_retailprice AS t FROM s JOIN part p ON p.p_partkey = article JOIN part q ON q.p_partkey = other),
        r AS (SELECT *, row_number() OVER (PARTITION BY article ORDER BY score DESC, t DESC, other) AS nth FROM c) SELECT article, other, CAST(score AS BIGINT) AS score, CAST(nth AS INTEGER) AS nth FROM r WHERE nth <= 3""",
    "topic_phrase_match": f"""WITH t AS (SELECT doc_id, string_split({_NT}, ' ') AS w FROM documents), p(topic, a, b) AS (VALUES ('a', 'with', 'the'), ('b', 'licensed', 'under'), ('c', 'est', 'pour'))
        SELECT doc_id, topic FROM t, p WHERE list_contains(w, a) AND list_contains(w, b)""",
}
