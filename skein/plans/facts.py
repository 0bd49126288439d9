"""Claim and state queries over the driver's tables, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from skein.functions import text as X
from skein.functions import titles as H
from skein.functions import udfs
from skein.operators import claims as C
from skein.operators import clusters as K
from skein.sources.tables import table
from skein.streaming import state as Z


def _claims(spark, sf):
    """Line items as claims: an order is a story, a part of ten a fact."""
    kinds = F.array(*[F.lit(k) for k in C.KINDS])
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("story_id"), F.col("l_linenumber").cast("bigint").alias("seq"), (F.col("l_partkey") % 10).alias("fact"),
        F.concat(F.lit("https://s"), F.col("l_suppkey")).alias("source_url"), F.concat(F.lit("o"), F.col("l_suppkey") % 7).alias("owner"),
        (F.col("l_suppkey") % 3 + 1).cast("int").alias("tier"), F.get(kinds, (F.col("l_quantity") % 5).cast("int")).alias("kind"),
        F.when(F.col("l_suppkey") % 4 == 0, "unstated").otherwise(F.concat(F.lit("org "), F.col("l_suppkey") % 5, F.when(F.col("l_suppkey") % 2 == 0, " labs").otherwise(""))).alias("origin"),
        (F.col("l_returnflag") == "N").alias("first_party"), F.round(F.col("l_discount") * 10, 2).alias("confidence"),
        F.concat(F.lit("price "), F.col("l_partkey")).alias("claim"),
        F.concat(F.when(F.col("l_tax") > 0.05, "about ").otherwise(""), F.col("l_quantity").cast("int"), F.lit(" units")).alias("value"),
    )


_CL = """c AS (SELECT l_orderkey AS story_id, CAST(l_linenumber AS BIGINT) AS seq, l_partkey % 10 AS fact, 'https://s' || l_suppkey AS source_url, 'o' || (l_suppkey % 7) AS owner, CAST(l_suppkey % 3 + 1 AS INTEGER) AS tier,
  ['rumor','opinion','reported','statement','confirmed'][CAST(l_quantity AS INTEGER) % 5 + 1] AS kind, CAST(l_quantity AS INTEGER) % 5 AS strength,
  CASE WHEN l_suppkey % 4 = 0 THEN 'unstated' ELSE 'org ' || (l_suppkey % 5) || CASE WHEN l_suppkey % 2 = 0 THEN ' labs' ELSE '' END END AS origin, l_returnflag = 'N' AS first_party, round(l_discount * 10, 2) AS confidence,
  'price ' || l_partkey AS claim, CASE WHEN l_tax > 0.05 THEN 'about ' ELSE '' END || CAST(l_quantity AS INTEGER) || ' units' AS value, l_tax > 0.05 AS hedged FROM lineitem)"""


def fact_merge_group(spark, sf):
    c = _claims(spark, sf).withColumn("key", F.concat_ws("-", "story_id", "fact"))
    m = C.merge_facts(c, "key")
    return m.select("key", "confidence", "kind", "origin", "value", "claim", "n_claims", F.array_join("source_urls", ",").alias("urls"))


def claim_demotion(spark, sf):
    c = _claims(spark, sf)
    return c.groupBy(C.apply_hedge(F.col("kind"), F.col("value")).alias("kind")).agg(F.count("*").alias("n"))


def confirmed_origin_names(spark, sf):
    return C.confirmed_origins(_claims(spark, sf), "story_id").select("story_id", F.array_join("origins", ",").alias("origins"))


def confirmed_origins_rule(spark, sf):
    return C.confirmation(_claims(spark, sf), "story_id")


def evidence_tally(spark, sf):
    return C.evidence_tally(_claims(spark, sf), "source_url")


def readiness(spark, sf):
    return C.ready(_claims(spark, sf), "story_id")


def drop_share_per_source(spark, sf):
    return C.drop_share(_claims(spark, sf), "source_url", F.col("kind").isin("rumor", "opinion"), 0.42).select("source_url", F.round("share", 6).alias("share"), "n")


def central_claims(spark, sf):
    c = _claims(spark, sf).withColumn("overlap", (F.length("claim") + F.col("seq") % 3).cast("double"))
    return C.central_claim(c, "story_id", "overlap").select("story_id", "seq", "overlap")


def group_guards(spark, sf):
    c = _claims(spark, sf).withColumn("claim_id", F.col("seq"))
    groups = c.groupBy("story_id").agg(F.array_sort(F.collect_list("seq")).alias("all"))
    groups = groups.select("story_id", F.explode(F.array(F.struct(F.lit(1).alias("group"), F.slice("all", 1, 2).alias("ids")), F.struct(F.lit(2).alias("group"), F.slice("all", 2, 3).alias("ids")))).alias("g")).select("story_id", "g.*")
    return C.group_guards(groups, c, "story_id")


def restatements(spark, sf):
    c = _claims(spark, sf).withColumn("verified", F.col("seq") % 2 == 0)
    owners = c.where("seq = 1").select("story_id", "owner").distinct()
    return C.restatement_candidates(c, "story_id", owners, 2).select("story_id", "seq", "nth")


def display_entity(spark, sf):
    part = table(spark, sf, "part").select(F.lower("p_type").alias("key"), F.when(F.col("p_size") % 3 == 0, F.initcap("p_type")).when(F.col("p_size") % 3 == 1, F.upper("p_type")).otherwise(F.lower("p_type")).alias("spelling"))
    return C.display_entities(part, "key", "spelling")


def _turns(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("pos"), "role", "text")


def max_by_corroboration(spark, sf):
    """For each conversation and role the turn that agrees most with the first turn."""
    t = _turns(spark, sf).withColumn("w", F.array_distinct(X.words(F.col("text"))))
    first = t.where("pos = 0").select("conv_id", F.col("w").alias("w0"))
    s = t.where("pos > 0").join(first, "conv_id")
    s = s.withColumn("score", C.corroboration_score(F.col("w"), F.col("w0"), F.slice("w", 1, 4), F.slice("w0", 1, 4), 0.05))
    return C.best_per_source(s, "conv_id", "role", "score", "pos").select("conv_id", "role", "pos", F.round("score", 6).alias("score"))


def lag_attribution_window(spark, sf):
    t = _turns(spark, sf)
    return C.attribution_window(t, "conv_id", F.length("text") % 7 == 0, 1).select("conv_id", "pos")


def nearest_cue(spark, sf):
    t = _turns(spark, sf)
    cue = F.when(F.contains("text", F.lit("the")), F.lit("the")).when(F.contains("text", F.lit("que")), F.lit("que"))
    return C.nearest_cue(t, "conv_id", F.length("text") % 3 == 0, cue)


def absence_claims(spark, sf):
    rows = table(spark, sf, "orders").select(
        "o_orderkey", F.concat(F.lit("The studio "), F.element_at(F.array(*map(F.lit, ["has not yet publicly disclosed", "revealed", "declined to comment on", "never said it would ever in any way at all reveal"])), (F.col("o_orderkey") % 4 + 1).cast("int")), F.lit(" the date")).alias("claim")
    )
    return rows.where(C.is_absence(F.col("claim"))).groupBy("claim").agg(F.count("*").alias("n"))


def claim_grounding(spark, sf):
    docs = table(spark, sf, "documents")
    value = F.concat(F.substring_index("text", " ", 5), F.when(F.col("doc_id") % 4 == 0, " all 77777").when(F.col("doc_id") % 4 == 1, " Zzqx").otherwise(""))
    return docs.groupBy(C.grounding_failure(value, F.col("text")).alias("reason")).agg(F.count("*").alias("n"))


def json_props_parse(spark, sf):
    e = table(spark, sf, "events").withColumn("p", F.from_json("props", "k int", {"mode": "PERMISSIVE"}))
    return e.groupBy("event_type").agg(F.sum("p.k").alias("k"), F.count_if(F.col("p.k").isNull()).alias("bad"))


def health_counters(spark, sf):
    return Z.health_counters(table(spark, sf, "events"), "user_id", F.col("event_type") != "error", "ts")


def health_merge(spark, sf):
    e = table(spark, sf, "events")
    ok = F.col("event_type") != "error"
    return Z.merge_health(Z.health_counters(e.where("event_id % 2 = 0"), "user_id", ok, "ts"), Z.health_counters(e.where("event_id % 2 = 1"), "user_id", ok, "ts"), "user_id")


def streak_breaker(spark, sf):
    return Z.breaker(table(spark, sf, "events"), "user_id", "ts", "event_id", F.col("event_type").isin("error", "view"), 2)


def longest_streaks(spark, sf):
    return Z.longest_streaks(table(spark, sf, "events"), "user_id", "ts", "event_id", F.col("event_type").isin("error", "view"))


def seen_upsert(spark, sf):
    e = table(spark, sf, "events")
    old = e.where("event_id < 5000").groupBy("user_id").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    return Z.mark_seen(old, e.where("event_id >= 5000"), "user_id", "ts")


def failed_attempts(spark, sf):
    e = table(spark, sf, "events").select("user_id", (F.col("event_type") == "purchase").alias("ok"), "ts")
    empty = spark.createDataFrame([], "user_id bigint, attempt_count bigint, last_attempt timestamp_ntz")
    return Z.record_attempts(empty, e, "user_id")


def attempts_on_cooldown(spark, sf):
    return Z.on_cooldown(failed_attempts(spark, sf), "user_id", F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"), 36.0, 2)


def daily_count(spark, sf):
    e = table(spark, sf, "events")
    return e.where(F.to_date("ts") == F.lit("2024-01-15").cast("date")).agg(F.count("*").alias("n"))


def stream_counts_watermark(spark, sf):
    """Daily counts of event types by a stream over the events file; equal to the batch answer."""
    schema = table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    counts = Z.windowed_counts(stream, "ts", "event_type", "30 days")
    got = Z.run_available(counts, f"{K.shared_folder(spark)}/stream-{uuid.uuid4().hex}", "complete")
    return got.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def html_to_text(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", udfs.html_to_text(F.col("html")).alias("t"))
    return pages.select("page_id", F.length("t").alias("n_chars"), F.size(F.split("t", "\n")).alias("n_lines"), F.sha2("t", 256).alias("digest"))


def sentence_split(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", udfs.split_sentences(F.col("text")).alias("s"))
    return docs.select("doc_id", F.size("s").alias("n"), X.prose_measure(F.col("s"))["ok"].alias("ok"))


def tokens_values_extract(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.explode(udfs.extract_values(F.col("text"))).alias("v"))
    return docs.select("doc_id", "v.token", "v.raw", "v.line")


def figure_tokens(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.explode(H.figures(F.col("text"))).alias("token"))
    return docs.groupBy("token").agg(F.count("*").alias("n"))


def entity_scanner(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.split("text", "\n")[0].alias("title"))
    return docs.select("doc_id", F.explode(H.names(F.col("title"))).alias("entity"))


def story_types(spark, sf):
    ends = ["opens soon", "review: copies", "sold well", "is delayed, units wait", "makes $ 5", "reaches 4M", "hands-on"]
    title = F.concat(F.initcap("p_name"), F.lit(" "), F.element_at(F.array(*map(F.lit, ends)), (F.col("p_size") % 7 + 1).cast("int")))
    part = table(spark, sf, "part").select(H.story_type(title).alias("type"))
    return part.groupBy("type").agg(F.count("*").alias("n"))


def sequence_similarity(spark, sf):
    t = _turns(spark, sf)
    a, b = t.where("pos = 0").select("conv_id", F.col("text").alias("a")), t.where("pos = 2").select("conv_id", F.col("text").alias("b"))
    return a.join(b, "conv_id").select("conv_id", F.round(H.similarity(F.col("a"), F.col("b")), 6).alias("ratio"))


def accent_folding(spark, sf):
    docs = table(spark, sf, "documents")
    title = F.split("text", "\n")[0]
    return docs.select("doc_id", X.slugify(title, H.fold).alias("slug"), X.match_normalize(title, H.fold).alias("form"))


def greedy_leader_cluster(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", F.concat(F.initcap("p_name"), F.lit(" "), F.initcap("p_type")).alias("title"), F.timestamp_seconds(F.col("p_partkey")).alias("published"))
    return K.greedy_stories(part, "p_partkey", "title", "published")


def greedy_claim_groups(spark, sf):
    c = _claims(spark, sf).select(F.col("story_id").cast("string").alias("story_id"), "seq", "source_url", F.lit("price of stock").alias("claim"), "value")
    return K.greedy_claims(c)


def version_conflicts(spark, sf):
    c = _claims(spark, sf).select((F.col("story_id") * 10 + F.col("fact")).alias("fact"), "source_url", "value")
    return C.resolve_versions(c, "fact")


QUERIES = {
    f.__name__: f
    for f in (
        fact_merge_group, claim_demotion, confirmed_origin_names, confirmed_origins_rule, evidence_tally, readiness, drop_share_per_source, central_claims,
        group_guards, restatements, display_entity, max_by_corroboration, lag_attribution_window, nearest_cue, absence_claims, claim_grounding,
        json_props_parse, health_counters, health_merge, streak_breaker, longest_streaks, seen_upsert, failed_attempts, attempts_on_cooldown, daily_count,
        stream_counts_watermark, html_to_text, sentence_split, tokens_values_extract, figure_tokens, entity_scanner, story_types, sequence_similarity,
        accent_folding, greedy_leader_cluster, greedy_claim_groups, version_conflicts,
    )
}

_HEALTH = """SELECT user_id, count(*) FILTER (event_type <> 'error') AS successes, count(*) FILTER (event_type = 'error') AS failures, max(ts) FILTER (event_type <> 'error') AS last_success, max(ts) FILTER (event_type = 'error') AS last_failure FROM events GROUP BY user_id"""
_TW = r"list_distinct(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}\p{{M}}_]+'))"
_FAILED = """WITH e AS (SELECT user_id, event_type = 'purchase' AS ok, ts FROM events), k AS (SELECT user_id, max(ts) AS ok_at FROM e WHERE ok GROUP BY user_id),
  f AS (SELECT e.user_id, count(*) AS attempt_count, max(ts) AS last_attempt FROM e LEFT JOIN k USING (user_id) WHERE NOT ok AND (ok_at IS NULL OR ts > ok_at) GROUP BY e.user_id)"""
SQL = {
    "story_types": "SELECT CASE p_size % 7 WHEN 0 THEN 'announcement' WHEN 1 THEN 'review' WHEN 3 THEN 'delay' WHEN 6 THEN 'review' ELSE 'sales' END AS type, count(*) AS n FROM part GROUP BY 1",
    "fact_merge_group": f"""WITH {_CL} SELECT story_id || '-' || fact AS key, min(confidence) AS confidence, arg_min(kind, strength) AS kind,
        coalesce(string_agg(DISTINCT CASE WHEN origin <> 'unstated' THEN origin END, '; ' ORDER BY CASE WHEN origin <> 'unstated' THEN origin END), 'unstated') AS origin,
        arg_min(value, (CASE WHEN hedged THEN -1 ELSE 0 END, strength, -length(value), seq, source_url, claim, value)) AS value, arg_min(claim, (CASE WHEN hedged THEN -1 ELSE 0 END, strength, -length(value), seq, source_url, claim, value)) AS claim,
        count(*) AS n_claims, string_agg(DISTINCT source_url, ',' ORDER BY source_url) AS urls FROM c GROUP BY story_id, fact""",
    "claim_demotion": f"WITH {_CL} SELECT CASE WHEN kind IN ('confirmed', 'reported') AND hedged THEN 'rumor' ELSE kind END AS kind, count(*) AS n FROM c GROUP BY 1",
    "confirmed_origin_names": f"""WITH {_CL}, o AS (SELECT story_id, source_url, arg_max(origin, (length(origin), origin)) AS name FROM c WHERE kind IN ('confirmed', 'reported') AND tier <> 3 AND origin <> 'unstated' GROUP BY ALL),
        d AS (SELECT DISTINCT story_id, name FROM o) SELECT story_id, string_agg(name, ',' ORDER BY name) AS origins FROM d a WHERE NOT EXISTS (SELECT 1 FROM d b WHERE a.story_id = b.story_id AND a.name <> b.name AND contains(' ' || a.name || ' ', ' ' || b.name || ' ')) GROUP BY story_id""",
    "confirmed_origins_rule": f"""WITH {_CL}, k AS (SELECT * FROM c WHERE kind IN ('confirmed', 'reported') AND tier <> 3), b AS (SELECT story_id, max(CAST(tier = 1 AS INTEGER)) AS t1, count(DISTINCT owner) AS owners FROM k GROUP BY story_id),
        p AS (SELECT story_id, max(n) AS pn FROM (SELECT story_id, origin, count(DISTINCT owner) AS n FROM k WHERE first_party GROUP BY ALL) GROUP BY story_id),
        s AS (SELECT story_id, count(*) AS origins, max(n) AS top, count(*) FILTER (n = m) AS tops FROM (SELECT story_id, n, max(n) OVER (PARTITION BY story_id) AS m FROM (SELECT story_id, origin, count(DISTINCT owner) AS n FROM k WHERE origin <> 'unstated' GROUP BY ALL)) GROUP BY story_id)
        SELECT d.story_id, CASE WHEN t1 = 1 THEN 'tier-1' WHEN pn >= 2 THEN 'first-party' WHEN origins >= 2 AND owners >= 2 THEN 'two origins' WHEN top >= 2 AND tops = 1 THEN 'single origin' ELSE 'none' END AS rule
        FROM (SELECT DISTINCT story_id FROM c) d LEFT JOIN b USING (story_id) LEFT JOIN p USING (story_id) LEFT JOIN s USING (story_id)""",
    "evidence_tally": f"WITH {_CL} SELECT source_url, count(*) AS claims, count(*) FILTER (kind IN ('confirmed', 'reported')) AS confirming, count(*) FILTER (origin <> 'unstated') AS named, count(*) FILTER (first_party) AS first_party FROM c GROUP BY source_url",
    "readiness": f"""WITH {_CL}, g AS (SELECT story_id, count(DISTINCT source_url) AS s, count(DISTINCT owner) AS o, count(*) FILTER (kind IN ('confirmed', 'reported', 'statement')) AS u FROM c GROUP BY story_id)
        SELECT story_id, CASE WHEN s < 2 THEN 'sources' WHEN o < 2 THEN 'owners' WHEN u < 2 THEN 'claims' ELSE 'ready' END AS state FROM g""",
    "drop_share_per_source": f"WITH {_CL}, g AS (SELECT source_url, avg(CASE WHEN kind IN ('rumor', 'opinion') THEN 1.0 ELSE 0.0 END) AS s, count(*) AS n FROM c GROUP BY source_url) SELECT source_url, round(s, 6) AS share, n FROM g WHERE s > 0.42",
    "central_claims": f"""WITH {_CL}, o AS (SELECT *, (length(claim) + seq % 3)::DOUBLE AS overlap FROM c), m AS (SELECT *, max(overlap) OVER (PARTITION BY story_id) AS best FROM o)
        SELECT story_id, seq, overlap FROM m WHERE overlap >= best * 0.8 QUALIFY row_number() OVER (PARTITION BY story_id ORDER BY (kind = 'confirmed' AND origin <> 'unstated') DESC, overlap DESC, length(claim) DESC, seq) = 1""",
    "group_guards": f"""WITH {_CL}, a AS (SELECT story_id, list_sort(list(seq)) AS l FROM c GROUP BY story_id), g AS (SELECT story_id, 1 AS "group", list_slice(l, 1, 2) AS ids FROM a UNION ALL SELECT story_id, 2, list_slice(l, 2, 4) FROM a),
        e AS (SELECT story_id, "group", unnest(ids) AS seq FROM g), u AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY story_id, seq ORDER BY "group") = 1),
        r AS (SELECT u.story_id, u."group", count(*) AS n, count(DISTINCT source_url) AS s, bool_or(kind = 'rumor') AS rumor FROM u JOIN c ON u.story_id = c.story_id AND u.seq = c.seq GROUP BY ALL)
        SELECT g.story_id, g."group", CASE WHEN n IS NULL OR n < 2 THEN 'fewer than two claims' WHEN s < 2 THEN 'one source' WHEN rumor THEN 'rumor' ELSE 'accepted' END AS verdict FROM g LEFT JOIN r ON g.story_id = r.story_id AND g."group" = r."group" """,
    "restatements": f"""WITH {_CL}, f AS (SELECT * FROM c WHERE seq % 2 = 0 AND kind IN ('confirmed', 'statement', 'reported') AND NOT EXISTS (SELECT 1 FROM c d WHERE d.story_id = c.story_id AND d.seq = 1 AND d.owner = c.owner))
        SELECT story_id, seq, CAST(row_number() OVER (PARTITION BY story_id ORDER BY CASE kind WHEN 'confirmed' THEN 1 WHEN 'statement' THEN 2 ELSE 3 END, seq) AS INTEGER) AS nth FROM f QUALIFY nth <= 2""",
    "display_entity": """WITH v AS (SELECT lower(p_type) AS key, p_size % 3 AS z, array_to_string(list_transform(string_split(lower(p_type), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS t FROM part),
        g AS (SELECT key, CASE z WHEN 0 THEN t WHEN 1 THEN upper(key) ELSE key END AS spelling, t, count(*) AS n FROM v GROUP BY ALL) SELECT key, arg_max(spelling, (spelling = t, n, length(spelling), spelling)) AS spelling FROM g GROUP BY key""",
    "max_by_corroboration": f"""WITH t AS (SELECT conv_id, turn AS pos, role, {_TW.format('text')} AS w FROM conversations), w AS (SELECT conv_id, turn AS pos, list_filter(x, lambda v, i: list_position(x, v) = i) AS w FROM (SELECT conv_id, turn, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}\\p{{M}}_]+') AS x FROM conversations)),
        j AS (SELECT a.conv_id, t.role, a.pos, a.w AS w, b.w AS v FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.pos = 0 AND a.pos > 0 JOIN t ON t.conv_id = a.conv_id AND t.pos = a.pos),
        k AS (SELECT *, len(list_intersect(w, v)) AS s, len(w) + len(v) - len(list_intersect(w, v)) AS u, list_slice(w, 1, 4) AS x, list_slice(v, 1, 4) AS y FROM j),
        m AS (SELECT *, CASE WHEN u > 0 THEN s / u ELSE 0 END AS o, least(len(w), len(v)) AS sm FROM k),
        z AS (SELECT *, CASE WHEN o >= 0.05 THEN o WHEN sm >= 3 AND s = sm THEN 1.0 ELSE 0.0 END AS score FROM m)
        SELECT conv_id, role, pos, round(score, 6) AS score FROM z WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY z.score DESC, pos) = 1""",
    "lag_attribution_window": """WITH h AS (SELECT conv_id, turn AS pos, CAST(length(text) % 7 = 0 AS INTEGER) AS h FROM conversations), n AS (SELECT *, max(h) OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near, max(h) OVER (PARTITION BY conv_id) AS a FROM h)
        SELECT conv_id, pos FROM n WHERE near = 1 OR a = 0""",
    "nearest_cue": """WITH r AS (SELECT conv_id, turn AS pos, length(text) % 3 = 0 AS h, CASE WHEN contains(text, 'the') THEN 'the' WHEN contains(text, 'que') THEN 'que' END AS cue FROM conversations),
        j AS (SELECT c.conv_id, c.pos, c.cue, h.pos AS a FROM r c JOIN r h ON c.conv_id = h.conv_id AND c.cue IS NOT NULL AND h.h)
        SELECT conv_id, pos, cue FROM j QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY a - pos < 0, abs(a - pos), pos, a) = 1""",
    "absence_claims": """SELECT 'The studio ' || CASE o_orderkey % 4 WHEN 0 THEN 'has not yet publicly disclosed' ELSE 'declined to comment on' END || ' the date' AS claim, count(*) AS n FROM orders WHERE o_orderkey % 4 IN (0, 2) GROUP BY 1""",
    "json_props_parse": "SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS INTEGER)) AS BIGINT) AS k, count(*) FILTER (json_extract(props, '$.k') IS NULL) AS bad FROM events GROUP BY event_type",
    "health_counters": _HEALTH,
    "health_merge": _HEALTH,
    "streak_breaker": """WITH o AS (SELECT user_id, max((ts, event_id)) AS ok FROM events WHERE event_type NOT IN ('error', 'view') GROUP BY user_id),
        a AS (SELECT e.user_id, event_id, ts, row_number() OVER (PARTITION BY e.user_id ORDER BY ts DESC, event_id DESC) AS k FROM events e LEFT JOIN o USING (user_id) WHERE event_type IN ('error', 'view') AND (ok IS NULL OR (ts, event_id) > ok)),
        g AS (SELECT user_id, count(*) AS n, string_agg(event_id::VARCHAR, ',' ORDER BY ts, event_id) FILTER (k <= 3) AS r FROM a GROUP BY user_id)
        SELECT u.user_id, coalesce(n, 0) AS consecutive_failures, coalesce(n, 0) >= 2 AS open, coalesce(r, '') AS recent FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN g USING (user_id)""",
    "longest_streaks": """WITH i AS (SELECT user_id, event_type IN ('error', 'view') AS f, sum(CASE WHEN event_type IN ('error', 'view') THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM events),
        n AS (SELECT user_id, g, count(*) AS n FROM i WHERE f GROUP BY ALL) SELECT user_id, max(n) AS longest FROM n GROUP BY user_id""",
    "seen_upsert": "SELECT user_id, min(ts) AS first_seen, max(ts) AS last_seen FROM events GROUP BY user_id",
    "failed_attempts": f"{_FAILED} SELECT user_id, attempt_count, last_attempt FROM f",
    "attempts_on_cooldown": f"{_FAILED} SELECT user_id FROM f WHERE attempt_count >= 2 AND TIMESTAMP '2024-01-31 00:00:00' - last_attempt < INTERVAL 36 HOUR",
    "daily_count": "SELECT count(*) AS n FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-15'",
    "stream_counts_watermark": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
}
