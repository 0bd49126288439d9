"""Claims: grounding, merging into facts, origins, confirmation, corroboration."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import text as X
from skein.functions import titles as H

# Kinds, the weakest first.
KINDS = ["rumor", "opinion", "reported", "statement", "confirmed"]
CONFIRMING = ["confirmed", "reported"]
HEDGES = ["about", "around", "estimated", "nearly", "roughly", "may", "might", "could", "reportedly", "allegedly", "up to", "at least"]
ABSENCE = r"(?U)\b(?:not|never|yet to|no|declined to)\b(?:\W+\w+){0,4}?\W+(?:disclos|reveal|announc|confirm|shar|detail|comment)\w*"


def strength(kind: Column) -> Column:
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(k) for k in KINDS]), kind), F.lit(0)), F.lit(1)) - 1


def hedge_count(value: Column) -> Column:
    return F.regexp_count(F.lower(value), F.lit(r"\b(?:" + "|".join(HEDGES) + r")\b"))


def apply_hedge(kind: Column, value: Column) -> Column:
    """A hedged confirmed or reported claim is a rumor."""
    return F.when(kind.isin(CONFIRMING) & (hedge_count(value) > 0), "rumor").otherwise(kind)


def is_absence(claim: Column) -> Column:
    """Claims that something was not disclosed."""
    return F.coalesce(F.lower(claim).rlike(ABSENCE), F.lit(False))


def clean_ids(ids: Column) -> Column:
    """At most three distinct non-negative sentence numbers, in order."""
    return F.slice(F.array_distinct(F.filter(ids, lambda x: x >= 0)), 1, 3)


def grounding_failure(value: Column, source: Column, title: Column | None = None) -> Column:
    """Why a value is not in its source: numbers first, then names, then absolutes; null if it is.

    Word numbers of both are compared as written, without separators.
    """
    text = source if title is None else F.concat_ws(" ", title, source)
    numbers = lambda c: F.regexp_extract_all(F.regexp_replace(c, r"(?<=\d),(?=\d)", ""), F.lit(r"\d+(?:\.\d+)?"), 0)
    names = F.regexp_extract_all(value, F.lit(r"(?U)(?<=\s)\p{Lu}\w+"), 0)
    low = F.lower(text)
    missing = F.filter(names, lambda n: ~F.contains(low, F.lower(n)))
    stands = lambda c, w: F.regexp_like(c, F.concat(F.lit(r"\b"), w, F.lit(r"\b")))
    absolute = F.filter(F.array(*map(F.lit, ["all", "every", "full", "only", "never", "always"])), lambda w: stands(F.lower(value), w) & ~stands(low, w))
    return (
        F.when(F.size(F.array_except(numbers(value), numbers(text))) > 0, "number not in source")
        .when(F.size(missing) > 0, "name not in source")
        .when(F.size(absolute) > 0, "qualifier not in source")
    )


def coherent(claims: DataFrame, entities: list[str], text: Column, title: Column) -> DataFrame:
    """Claims that name an entity themselves or in their source's title; without entities all."""
    if not entities:
        return claims
    form = lambda c: X.normalize_title(c)
    names = [F.lit(" ".join(e.lower().split())) for e in entities]
    named = lambda c: F.greatest(*[X.contains_phrase(form(c), n) for n in names], F.lit(False))
    return claims.where(named(text) | named(title))


def drop_share(rows: DataFrame, source: str, dropped: Column, limit: float = 0.5) -> DataFrame:
    """Sources more than `limit` of whose claims were dropped."""
    share = F.avg(F.when(dropped, 1.0).otherwise(0.0))
    return rows.groupBy(source).agg(share.alias("share"), F.count("*").alias("n")).where(F.col("share") > limit)


def merge_facts(claims: DataFrame, fact: str, prefer: Column | None = None) -> DataFrame:
    """One row a fact: least confidence, weakest kind, sources, origins, and the safest wording.

    The value kept is the most hedged, then of the weakest kind, then the
    longest; claims that `prefer` marks come first.
    """
    rank = F.struct(
        (~F.coalesce(prefer, F.lit(False))).cast("int").alias("p") if prefer is not None else F.lit(0).alias("p"),
        (-hedge_count(F.col("value"))).alias("h"),
        strength(F.col("kind")).alias("s"),
        (-F.length("value")).alias("l"),
        F.col("seq"),
        F.col("source_url"),
        F.col("claim"),
        F.col("value"),
    )
    named = F.collect_set(F.when(F.col("origin") != "unstated", F.col("origin")))
    return claims.groupBy(fact).agg(
        F.min("confidence").alias("confidence"),
        F.min_by("kind", strength(F.col("kind"))).alias("kind"),
        F.array_sort(F.collect_set("source_url")).alias("source_urls"),
        F.when(F.size(named) > 0, F.array_join(F.array_sort(named), "; ")).otherwise("unstated").alias("origin"),
        F.min_by("value", rank).alias("value"),
        F.min_by("claim", rank).alias("claim"),
        F.count("*").alias("n_claims"),
    )


def confirmed_origins(claims: DataFrame, story: str) -> DataFrame:
    """(story, origins): names that back a story, one a source, contained names collapsed.

    claims: (story, source_url, tier, kind, origin).  A source counts once, by
    its longest name; a name within another's words is the same origin.
    """
    ok = claims.where(F.col("kind").isin(CONFIRMING) & ~F.col("tier").eqNullSafe(3) & (F.col("origin") != "unstated"))
    name = F.lower(F.trim("origin"))
    one = ok.groupBy(story, "source_url").agg(F.max_by(name, F.struct(F.length(name), name)).alias("name"))
    sets = one.groupBy(story).agg(F.array_sort(F.collect_set("name")).alias("names"))
    # A name stays unless another name of the story stands within it.
    alone = F.filter("names", lambda x: ~F.exists("names", lambda y: (x != y) & F.contains(F.concat(F.lit(" "), x, F.lit(" ")), F.concat(F.lit(" "), y, F.lit(" ")))))
    return sets.select(story, alone.alias("origins"))


def confirmation(claims: DataFrame, story: str, min_owners: int = 2) -> DataFrame:
    """(story, rule): tier-1, first-party, two origins, single origin, or none.

    claims: (story, source_url, owner, tier, kind, origin, first_party).
    First-party needs enough owners behind one organisation; two origins need
    two owners; a single origin must have the most owners alone.
    """
    ok = claims.where(F.col("kind").isin(CONFIRMING) & ~F.col("tier").eqNullSafe(3))
    base = ok.groupBy(story).agg(
        F.max((F.col("tier") == 1).cast("int")).alias("tier1"),
        F.count_distinct("owner").alias("owners"),
    )
    party = ok.where("first_party").groupBy(story, "origin").agg(F.count_distinct("owner").alias("n"))
    party = party.groupBy(story).agg(F.max("n").alias("party_owners"))
    by_origin = ok.where("origin != 'unstated'").groupBy(story, "origin").agg(F.count_distinct("owner").alias("n"))
    top = F.max("n")
    single = by_origin.groupBy(story).agg(top.alias("top"), F.count("*").alias("origins"), F.sort_array(F.collect_list("n"), False).alias("all"))
    rows = claims.select(story).distinct().join(base, story, "left").join(party, story, "left").join(single, story, "left")
    alone = (F.col("top") >= min_owners) & ((F.size("all") < 2) | (F.col("all")[0] > F.get("all", F.lit(1))))
    rule = (
        F.when(F.col("tier1") == 1, "tier-1")
        .when(F.col("party_owners") >= min_owners, "first-party")
        .when((F.col("origins") >= 2) & (F.col("owners") >= 2), "two origins")
        .when(alone, "single origin")
        .otherwise("none")
    )
    return rows.select(story, rule.alias("rule"))


def corroboration_score(words: Column, other: Column, value: Column, other_value: Column, least: float = 0.5) -> Column:
    """Jaccard of words, else containment, else agreeing values; 0 under least.

    Arrays of content words of two claims and of their values.
    """
    overlap = X.jaccard(words, other)
    contained = X.containment(words, other)
    shared = F.array_intersect(value, other_value)
    agree = (X.jaccard(value, other_value) >= 0.8) & (F.size(F.filter(shared, lambda w: ~w.rlike(r"^\d+$"))) >= 2)
    agree = agree & (overlap >= 0.2) & (F.size(F.array_intersect(words, other)) >= 2)
    return F.when(overlap >= least, overlap).when(contained >= least, contained).when(agree, F.lit(least)).otherwise(F.lit(0.0))


def best_per_source(scored: DataFrame, story: str, source: str, score: str, seq: str) -> DataFrame:
    """The best row of each source of a story; the earliest of equal ones; scores over 0 only."""
    order = Window.partitionBy(story, source).orderBy(F.desc(score), seq)
    return scored.where(F.col(score) > 0).withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def central_claim(claims: DataFrame, story: str, overlap: str, share: float = 0.8) -> DataFrame:
    """A story's central claim: of those near the best overlap, the best by origin, overlap, length."""
    best = F.max(overlap).over(Window.partitionBy(story))
    near = claims.withColumn("__best", best).where((F.col(overlap) >= F.col("__best") * share) & (F.col(overlap) > 0))
    named = ((F.col("kind") == "confirmed") & (F.col("origin") != "unstated")).cast("int")
    order = Window.partitionBy(story).orderBy(F.desc(named), F.desc(overlap), F.desc(F.length("claim")), "seq")
    return near.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n", "__best")


def restore_rumors(claims: DataFrame, story: str, least: int = 2) -> DataFrame:
    """Rumors become reported where a confirmed claim or statement of the story shares enough words."""
    words = F.filter(F.array_distinct(X.words(F.concat_ws(" ", "claim", "value"))), lambda w: F.length(w) >= 4)
    tagged = claims.select(story, "seq", "kind", F.explode(words).alias("w"))
    rumor = tagged.where("kind = 'rumor'").select(story, "seq", "w")
    firm = tagged.where(F.col("kind").isin("confirmed", "statement")).select(story, F.col("seq").alias("other"), "w")
    hit = rumor.join(firm, [story, "w"]).groupBy(story, "seq", "other").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    back = hit.select(story, "seq").distinct().withColumn("__back", F.lit(True))
    return claims.join(back, [story, "seq"], "left").withColumn("kind", F.when(F.col("__back") & (F.col("kind") == "rumor"), "reported").otherwise(F.col("kind"))).drop("__back")


def resolve_origins(claims: DataFrame, key: str, text: str, publications: list[str], products: list[str]) -> DataFrame:
    """(key, origin, dropped): origins that hold, and why each other one went.

    Parts of origin between semicolons are checked in order: anonymous,
    product, named in the text, attributed there, and not the outlet itself.
    """
    part = F.explode(F.transform(F.split("origin", ";"), lambda x: F.trim(x))).alias("part")
    each = claims.select(key, text, "outlet", part).where("part != '' AND part != 'unstated'")
    low, name = F.lower(text), F.lower("part")
    anonymous = name.rlike(r"^(?:(?:an?|the|unnamed|anonymous|several|multiple|people|person|sources?|insiders?|familiar|with|matter)\s*)+$")
    cue = F.concat(F.lit(r"(?:according to|said by|told|citing|from)\s+(?:the\s+)?\Q"), name, F.lit(r"\E|\Q"), name, F.lit(r"\E\s+(?:has\s+|have\s+)?(?:said|says|told|wrote|announced|confirmed|revealed|reported)"))
    reason = (
        F.when(anonymous, "anonymous")
        .when(name.isin([p.lower() for p in products]), "product")
        .when(~F.contains(low, name), "not named")
        .when(name == F.lower("outlet"), "self")
        .when(name.isin([p.lower() for p in publications]) | F.regexp_like(low, cue), None)
        .otherwise("not attributed")
    )
    marked = each.withColumn("reason", reason)
    agg = marked.groupBy(key).agg(
        F.array_sort(F.collect_set(F.when(F.col("reason").isNull(), F.col("part")))).alias("kept"),
        F.array_sort(F.collect_set(F.when(F.col("reason").isNotNull(), F.concat("part", F.lit(": "), "reason")))).alias("dropped"),
    )
    return claims.select(key).join(agg, key, "left").select(
        key,
        F.when(F.size("kept") > 0, F.array_join("kept", "; ")).otherwise("unstated").alias("origin"),
        F.coalesce(F.array_join("dropped", "; "), F.lit("")).alias("dropped"),
    )


def attribution_window(sents: DataFrame, key: str, hit: Column, reach: int = 3) -> DataFrame:
    """Sentences within `reach` of one that hits; a text without a hit stays whole."""
    near = Window.partitionBy(key).orderBy("pos").rowsBetween(-reach, reach)
    whole = Window.partitionBy(key)
    flagged = sents.withColumn("__hit", F.coalesce(hit, F.lit(False)).cast("int"))
    tagged = flagged.withColumn("__near", F.max("__hit").over(near)).withColumn("__any", F.max("__hit").over(whole))
    return tagged.where("__near = 1 OR __any = 0").drop("__hit", "__near", "__any")


def nearest_cue(sents: DataFrame, key: str, hit: Column, cue: Column) -> DataFrame:
    """(key, pos, cue): the cue nearest to a hit: own or former sentences first, then later ones.

    A cue's best hit is the next one at or after it, or else the last one before
    it, so both are found by running along the text.
    """
    rows = sents.select(key, "pos", cue.alias("cue"), F.when(F.coalesce(hit, F.lit(False)), F.col("pos")).alias("__at"))
    along = Window.partitionBy(key).orderBy("pos")
    after = F.min("__at").over(along.rangeBetween(0, Window.unboundedFollowing))
    before = F.max("__at").over(along.rangeBetween(Window.unboundedPreceding, 0))
    near = rows.withColumn("__after", after).withColumn("__before", before).where("cue IS NOT NULL AND coalesce(__after, __before) IS NOT NULL")
    gap = F.coalesce(F.col("__after") - F.col("pos"), F.col("pos") - F.col("__before"))
    best = F.min_by(F.struct("pos", "cue"), F.struct(F.col("__after").isNull().alias("later"), gap.alias("gap"), F.col("pos")))
    return near.groupBy(key).agg(best.alias("__b")).select(key, "__b.pos", "__b.cue")


def group_guards(groups: DataFrame, claims: DataFrame, story: str) -> DataFrame:
    """(story, group, verdict): proposed groups of claim ids that hold, else why not.

    An id counts in the first group that names it.  A group needs two claims of
    two sources, all ids known, and no rumor among them.
    """
    each = groups.select(story, "group", F.posexplode("ids").alias("i", "claim_id"))
    first = Window.partitionBy(story, "claim_id").orderBy("group", "i")
    used = each.withColumn("n", F.row_number().over(first)).where("n = 1")
    facts = claims.select(story, F.col("claim_id"), "source_url", "kind", F.lit(True).alias("known"))
    agg = used.join(facts, [story, "claim_id"], "left").groupBy(story, "group").agg(
        F.count("*").alias("n"), F.count_distinct("source_url").alias("sources"), F.bool_and(F.coalesce("known", F.lit(False))).alias("known"),
        F.bool_or(F.coalesce(F.col("kind") == "rumor", F.lit(False))).alias("rumor"),
    )
    verdict = (
        F.when(~F.col("known"), "unknown claim").when(F.col("n") < 2, "fewer than two claims").when(F.col("sources") < 2, "one source").when(F.col("rumor"), "rumor").otherwise("accepted")
    )
    return groups.select(story, "group").join(agg, [story, "group"], "left").select(story, "group", F.coalesce(F.when(F.col("n").isNull(), "fewer than two claims"), verdict).alias("verdict"))


def restated(title_units: Column, claim_words: Column) -> Column:
    """Share of a headline's units (names, months, numbers) that a claim has."""
    n = F.size(title_units)
    return F.when(n > 0, F.size(F.array_intersect(title_units, claim_words)) / n).otherwise(F.lit(0.0))


def restatement_candidates(claims: DataFrame, story: str, owners: DataFrame, k: int = 12) -> DataFrame:
    """Verified first-party claims of owners that are not yet behind the central fact; k a story."""
    free = claims.where("verified AND kind IN ('confirmed', 'statement', 'reported')").join(owners, [story, "owner"], "left_anti")
    order = Window.partitionBy(story).orderBy(F.array_position(F.array(*map(F.lit, ["confirmed", "statement", "reported"])), F.col("kind")), "seq")
    return free.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k)


def resolve_versions(facts: DataFrame, fact: str) -> DataFrame:
    """(fact, source_url, value, part): versions of a fact whose figures agree.

    The version that most others contradict goes, until none do; where that is
    a tie every version becomes a part of its own.  Two versions contradict
    when each has a figure that the other lacks.
    """

    form = "array<struct<source_url:string,value:string,part:bigint>>"

    @F.arrow_udf(form)
    def settle(groups: pa.Array) -> pa.Array:
        out = []
        for rows in groups.to_pylist():
            figures = [set(r.pop("figures")) for r in rows]
            alive, part = list(range(len(rows))), [0] * len(rows)
            while len(alive) > 1:
                against = {i: sum(bool(figures[i] - figures[j]) and bool(figures[j] - figures[i]) for j in alive) for i in alive}
                worst = max(against.values())
                top = [i for i in alive if against[i] == worst]
                if not worst:
                    break
                if len(top) > 1:
                    part = list(range(len(rows)))
                    break
                alive.remove(top[0])
            out.append([{**rows[i], "part": part[i]} for i in alive])
        return pa.array(out, pa.list_(pa.struct([("source_url", pa.string()), ("value", pa.string()), ("part", pa.int64())])))

    # Most facts have one version, which needs no list, or two, which need no walk: two that contradict are a tie.
    counted = facts.select(fact, "source_url", "value").withColumn("n", F.count("*").over(Window.partitionBy(fact)))
    alone = counted.where("n = 1").select(fact, "source_url", "value", F.lit(0).cast("bigint").alias("part"))
    order = F.struct(F.coalesce("source_url", F.lit("")).alias("u"), F.coalesce("value", F.lit("")).alias("v"), "source_url", "value")
    groups = counted.where("n > 1").groupBy(fact).agg(F.sort_array(F.collect_list(order)).alias("g"))
    figures = F.transform("g", lambda r: F.filter(H.figures(r["v"]), lambda w: ~w.isin(H.MONTH_WORDS)))
    groups = groups.withColumn("figures", figures)
    a, b = F.get("figures", F.lit(0)), F.get("figures", F.lit(1))
    two = groups.where(F.size("g") == 2).withColumn("torn", (F.size(F.array_except(a, b)) > 0) & (F.size(F.array_except(b, a)) > 0))
    two = two.select(fact, F.posexplode("g").alias("i", "r"), "torn").select(fact, "r.source_url", "r.value", F.when(F.col("torn"), F.col("i")).otherwise(0).cast("bigint").alias("part"))
    told = F.zip_with("g", "figures", lambda r, f: F.struct(r["source_url"].alias("source_url"), r["value"].alias("value"), f.alias("figures")))
    more = groups.where(F.size("g") > 2).select(fact, F.inline(settle(told)))
    return alone.unionByName(two).unionByName(more)


def display_entities(variants: DataFrame, key: str, spelling: str) -> DataFrame:
    """(key, spelling): the best spelling of a folded name: accents, title case, frequency, length."""
    accents = F.length(spelling) - F.length(F.regexp_replace(spelling, r"[^\x00-\x7F]", ""))
    titled = (F.initcap(spelling) == F.col(spelling)).cast("int")
    counted = variants.groupBy(key, spelling).agg(F.count("*").alias("n"))
    rank = F.struct(accents.alias("a"), titled.alias("t"), F.col("n"), F.length(spelling).alias("l"), F.col(spelling).alias("s"))
    return counted.groupBy(key).agg(F.max_by(spelling, rank).alias(spelling))


def trim_to_budget(claims: DataFrame, story: str, budget: float, entities: list[str]) -> DataFrame:
    """Claims of a story whose prompts fit a token budget: distinct values, the most useful first.

    Central claims always stay and count first; the order of others is kind,
    named entities, then position.
    """
    named = F.exists(F.array(*[F.lit(e.lower()) for e in entities]), lambda e: F.contains(F.lower(F.concat_ws(" ", "claim", "value")), e)) if entities else F.lit(False)
    score = strength(F.col("kind")) + F.when(F.col("central"), 10).otherwise(0) + F.when(named, 2).otherwise(0)
    once = Window.partitionBy(story, F.lower(F.trim("value"))).orderBy(F.desc("score"), "seq", "source_url", "claim")
    ranked = claims.withColumn("score", score).withColumn("n", F.row_number().over(once)).where("n = 1").drop("n")
    cost = X.token_estimate(F.concat_ws(" ", "claim", "value"))
    run = Window.partitionBy(story).orderBy(F.desc("central"), F.desc("score"), "seq", "source_url", "claim", "value").rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("tokens", F.sum(cost).over(run)).where(F.col("central") | (F.col("tokens") <= budget))


def member_support(members: DataFrame, story: str, entities: DataFrame, least: int = 3) -> DataFrame:
    """(story, seq, support): how each member of a fact names a story's entities.

    direct: its own words; title: its source's headline; peer: a member of
    another source that is named directly shares enough words; none.
    entities: (story, entity).
    """
    text = X.normalize_title(F.concat_ws(" ", "claim", "value"))
    rows = members.withColumn("__t", text).withColumn("__h", X.normalize_title(F.coalesce("source_title", F.lit(""))))
    named = rows.join(entities.select(story, X.normalize_title(F.col("entity")).alias("__e")), story).groupBy(story, "seq").agg(
        F.bool_or(X.contains_phrase(F.col("__t"), F.col("__e"))).alias("direct"), F.bool_or(X.contains_phrase(F.col("__h"), F.col("__e"))).alias("headed")
    )
    rows = rows.join(named, [story, "seq"], "left")
    words = rows.select(story, "seq", "source_url", "direct", F.explode(F.filter(F.array_distinct(F.split("__t", " ")), lambda w: F.length(w) >= 4)).alias("w"))
    firm = words.where("direct").select(story, F.col("seq").alias("o"), F.col("source_url").alias("ou"), "w")
    peers = words.join(firm, [story, "w"]).where("source_url != ou").groupBy(story, "seq", "o").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    peers = peers.select(story, "seq", F.lit(True).alias("peer")).distinct()
    support = F.when(F.col("direct"), "direct").when(F.col("headed"), "title").when(F.col("peer"), "peer").otherwise("none")
    return rows.join(peers, [story, "seq"], "left").select(story, "seq", support.alias("support"))


# Kinds and speakers that an answer may give.
ANSWER_KINDS = ["confirmed", "reported", "statement", "opinion", "rumor", "estimate"]
SPEAKER_TYPES = ["person", "organization", "publication", "none"]
_ANSWER = "claims array<struct<claim:string,value:string,source_url:string,origin:string,affiliation:string,kind:string,speaker:string,speaker_type:string,quote_ids:array<int>,attribution_ids:array<int>>>"


def validated(answers: DataFrame, key: str, answer: str, url: str | None = None, most: int = 300) -> tuple[DataFrame, DataFrame]:
    """Claims of model answers, and (key, problem) of answers that are refused as a whole.

    An answer is JSON with claims, each of which has a claim, a value and a
    known kind.  url, the address that was asked about, replaces the address an
    answer gives, which must otherwise be one of the web.  Texts are cut to
    `most` characters; an unstated origin allows no more than "reported".
    """
    asked = F.trim(url) if url else F.lit(None).cast("string")
    read = answers.select(key, asked.alias("__url"), F.from_json(answer, _ANSWER, {"mode": "PERMISSIVE"}).alias("__a"))
    lacks = lambda c: c["claim"].isNull() | c["value"].isNull() | ~F.coalesce(c["kind"].isin(ANSWER_KINDS), F.lit(False))
    web = lambda c: F.coalesce(F.coalesce(F.col("__url"), c["source_url"]).rlike("^https?://"), F.lit(False))
    problem = (
        F.when(F.col("__a.claims").isNull(), "no claims")
        .when(F.exists("__a.claims", lacks), "field missing")
        .when(F.exists("__a.claims", lambda c: ~web(c)), "no web address")
    )
    read = read.withColumn("problem", problem)
    each = read.where("problem IS NULL").select(key, "__url", F.posexplode("__a.claims").alias("seq", "c")).select(key, "__url", "seq", "c.*")
    plain = lambda name: F.lower(F.trim(F.coalesce(name, F.lit(""))))
    origin = F.when(plain("origin") == "", "unstated").otherwise(plain("origin"))
    kind = F.when((origin == "unstated") & F.col("kind").isin("confirmed", "estimate"), "reported").otherwise(F.col("kind"))
    kept = each.select(
        key, "seq", F.substring(F.trim("claim"), 1, most).alias("claim"), F.substring(F.trim("value"), 1, most).alias("value"), F.coalesce("__url", "source_url").alias("source_url"),
        origin.alias("origin"), plain("affiliation").alias("affiliation"), kind.alias("kind"), F.trim(F.coalesce("speaker", F.lit(""))).alias("speaker"),
        F.when(F.col("speaker_type").isin(SPEAKER_TYPES), F.col("speaker_type")).otherwise("none").alias("speaker_type"),
        clean_ids(F.coalesce("quote_ids", F.array().cast("array<int>"))).alias("quote_ids"), clean_ids(F.coalesce("attribution_ids", F.array().cast("array<int>"))).alias("attribution_ids"),
    )
    return kept, read.where("problem IS NOT NULL").select(key, "problem")


def numbered(claims: DataFrame, story: str, *order: str) -> DataFrame:
    """claims with id: F1, F2 ... by story, in that order."""
    return claims.withColumn("id", F.concat(F.lit("F"), F.row_number().over(Window.partitionBy(story).orderBy(*order))))


def evidence_tally(claims: DataFrame, source: str) -> DataFrame:
    """Per source: claims, those that confirm, those with a named origin, first-party ones."""
    return claims.groupBy(source).agg(
        F.count("*").alias("claims"), F.count_if(F.col("kind").isin(CONFIRMING)).alias("confirming"), F.count_if(F.col("origin") != "unstated").alias("named"), F.count_if("first_party").alias("first_party")
    )


def ready(claims: DataFrame, story: str, sources: int = 2, owners: int = 2, usable: int = 2) -> DataFrame:
    """(story, state): ready, or the first thing a story lacks: sources, owners, usable claims."""
    g = claims.groupBy(story).agg(
        F.count_distinct("source_url").alias("s"), F.count_distinct("owner").alias("o"), F.count_if(F.col("kind").isin("confirmed", "reported", "statement")).alias("u")
    )
    return g.select(story, F.when(F.col("s") < sources, "sources").when(F.col("o") < owners, "owners").when(F.col("u") < usable, "claims").otherwise("ready").alias("state"))


def preceding_name(text: Column, before: str, names: list[str]) -> Column:
    """The last of some names that stands, as whole words, before a phrase; null if none does.

    Longer names win over their own parts.
    """
    forms = "|".join(r"\Q" + n + r"\E" for n in sorted(names, key=lambda n: (-len(n), n)))
    head = F.when(F.contains(text, F.lit(before)), F.substring_index(text, before, 1))
    return F.try_element_at(F.regexp_extract_all(head, F.lit(rf"(?U)(?<![\w-])(?:{forms})(?![\w-])"), 0), F.lit(-1))


# Verbs by which a headline lets its own organisation announce.
ANNOUNCING = ["announces", "announced", "reveals", "revealed", "confirms", "confirmed", "launches", "launched", "unveils", "unveiled"]


def headline_claims(sources: DataFrame, title: str, owner: str, name: str, link: str) -> DataFrame:
    """The one claim that a source without prose states in its title; all columns of sources stay.

    It is confirmed if the title lets the source's own organisation announce, at
    most two words apart, else reported; origin and speaker are the owner.
    """
    who = F.coalesce(F.nullif(F.trim(owner), F.lit("")), F.trim(name), F.lit(""))
    said = F.concat(F.lit(r"(?:^|\s)\Q"), X.normalize_title(who), F.lit(r"\E(?:\s\w+){0,2}\s(?:" + "|".join(ANNOUNCING) + r")\b"))
    announces = (who != "") & F.regexp_like(X.normalize_title(F.col(title)), said)
    return sources.withColumns(
        {
            "claim": F.trim(title),
            "value": F.trim(title),
            "source_url": F.col(link),
            "confidence": F.lit(0.5),
            "origin": F.lower(who),
            "kind": F.when(announces, "confirmed").otherwise("reported"),
            "speaker": who,
            "reason": F.when(~announces, "headline-only source: no body text to verify"),
        }
    )
