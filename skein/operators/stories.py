"""From items to ranked stories: attribution, filters, pool, scoring, picking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import text as X
from skein.functions.dates import age_hours
from skein.functions.urls import normalize_url, registered_domain

# Fixed values of the score.
WEIGHTS = {
    "tier1": 40.0, "tier2": 15.0, "owner": 10.0, "max_owners": 4, "corroboration": 10.0,
    "fresh_hours": 6.0, "fresh_bonus": 30.0, "day_hours": 24.0, "day_bonus": 20.0,
    "two_day_hours": 48.0, "two_day_bonus": 10.0, "most_boost": 20.0,
}


def reattribute(items: DataFrame, sources: DataFrame, link_col: str = "link") -> DataFrame:
    """Credit an item to the source that owns its link's domain.

    sources: (domain, name, tier, owner), the first by seq of a domain wins.
    Without an owner the domain itself is a tier 3 source.
    """
    first = Window.partitionBy("domain").orderBy("seq")
    known = (
        sources.withColumn("nth", F.row_number().over(first))
        .where("nth = 1")
        .select(F.col("domain").alias("s_domain"), F.col("name").alias("s_name"), F.col("tier").alias("s_tier"), F.col("owner").alias("s_owner"))
    )
    tagged = items.withColumn("link_domain", registered_domain(F.col(link_col)))
    return (
        tagged.join(known, tagged["link_domain"] == known["s_domain"], "left")
        .withColumn("source_name", F.coalesce("s_name", "link_domain"))
        .withColumn("tier", F.coalesce("s_tier", F.lit(3)))
        .withColumn("owner", F.coalesce("s_owner", "link_domain"))
        .drop("s_domain", "s_name", "s_tier", "s_owner")
    )


def fresh(items: DataFrame, windows: DataFrame, now: Column, time_col: str = "published") -> DataFrame:
    """Items inside the window of their tier; windows: (tier, hours).  Null times go."""
    limit = windows.select(F.col("tier").alias("w_tier"), F.col("hours").alias("w_hours"))
    return (
        items.join(limit, items["tier"] == limit["w_tier"])
        .where(age_hours(F.col(time_col), now) <= F.col("w_hours"))
        .drop("w_tier", "w_hours")
    )


def not_stale(items: DataFrame, hours: float, age: Column) -> DataFrame:
    """Items up to an age; an unknown age stays."""
    return items.where(age.isNull() | (age <= hours))


def first_pattern(text: Column, patterns: list[str]) -> Column:
    """The first pattern that a text matches, whatever the case; else null.

    Borders of words and letters of another case are those of RE2.
    """
    return F.coalesce(*[F.when(text.rlike(f"(?iu){X.as_re2(p)}"), F.lit(p)) for p in patterns], F.lit(None).cast("string"))


def latest(rows: DataFrame, key: list[str], time: str, seq: str) -> DataFrame:
    """Of each key the row with the latest time; of equal ones the first by seq."""
    order = Window.partitionBy(*key).orderBy(F.desc_nulls_last(time), F.asc(seq))
    return rows.withColumn("__nth", F.row_number().over(order)).where("__nth = 1").drop("__nth")


def merge_pool(pool: DataFrame, items: DataFrame, now: Column, hours: float, link: str = "link") -> DataFrame:
    """Pool and new items, one by normalised link, the latest, none too old."""
    both = pool.unionByName(items).withColumn(link, normalize_url(F.col(link))).where(F.col(link) != "")
    both = not_stale(both, hours, age_hours(F.col("published"), now))
    return latest(both, [link], "published", "seq")


def distinct_owners(owner: Column, tier: Column, fetchable: Column) -> Column:
    """Number of owners, blanks and case aside, of rows that count."""
    counts = countable(tier, fetchable)
    return F.count_distinct(F.when(counts & (F.trim(owner) != ""), F.lower(F.trim(owner))))


def countable(tier: Column, fetchable: Column) -> Column:
    """Rows that may support a story: not of tier 3, not marked unfetchable; nulls count."""
    return ~tier.eqNullSafe(3) & ~fetchable.eqNullSafe(False)


def confirmable(tiers: Column, owners: Column) -> Column:
    return F.array_contains(tiers, 1) | (F.size(F.array_distinct(owners)) >= 2)


def story_groups(items: DataFrame, key: str) -> DataFrame:
    """Aggregates of each story's items: tiers, owners, newest, age, urls, id."""
    from skein.functions.text import cluster_digest

    return items.groupBy(key).agg(
        F.min("age_hours").alias("age_hours"),
        F.max("published").alias("newest"),
        F.array_sort(F.collect_set("tier")).alias("tiers"),
        F.array_sort(F.collect_set("owner")).alias("owners"),
        F.count("*").alias("n_items"),
        cluster_digest(F.collect_set("link")).alias("cluster_id"),
    )


def story_score(tiers: Column, owners: Column, age: Column, boost: Column | None = None, news: Column | None = None, bonus: float = 0.0) -> Column:
    """Additive score of a story; see WEIGHTS."""
    w = WEIGHTS
    score = F.when(F.array_contains(tiers, 1), w["tier1"]).when(F.array_contains(tiers, 2), w["tier2"]).otherwise(0.0)
    score += F.least(F.size(owners), F.lit(w["max_owners"])) * w["owner"]
    score += F.when(confirmable(tiers, owners), w["corroboration"]).otherwise(0.0)
    score += (
        F.when(age <= w["fresh_hours"], w["fresh_bonus"])
        .when(age <= w["day_hours"], w["day_bonus"])
        .when(age <= w["two_day_hours"], w["two_day_bonus"])
        .otherwise(0.0)
    )
    if boost is not None:
        score += F.coalesce(F.greatest(F.lit(0.0), F.least(boost.cast("double"), F.lit(w["most_boost"]))), F.lit(0.0))
    if news is not None:
        score += F.when(news, bonus).otherwise(0.0)
    return score


def ineligible_reason(confirmed: Column, n_sources: Column, n_owners: Column, excluded: Column, relevant: Column, min_sources: int = 2, min_owners: int = 2) -> Column:
    """The first rule that a story fails, as text; null if it fails none."""
    return (
        F.when(~confirmed, "not confirmable")
        .when(n_sources < min_sources, "too few sources")
        .when(n_owners < min_owners, "too few independent owners")
        .when(excluded.isNotNull(), F.concat(F.lit("excluded pattern: '"), excluded, F.lit("'")))
        .when(~relevant, "off-topic")
    )


def pick(stories: DataFrame, entity: str, order: list[Column], threshold: Column, per_entity: int, most: int) -> DataFrame:
    """At most `most` stories over their threshold, at most per_entity of an entity.

    Stories under the threshold take no slot; a null entity is not capped.
    order must start with the score, and end with something unique.  Only
    stories of the best ranks of their entity reach the final top-k.
    """
    over = stories.where(F.col("score") >= threshold)
    rank = F.row_number().over(Window.partitionBy(entity).orderBy(*order))
    named = over.where(F.col(entity).isNotNull()).withColumn("__nth", rank).where(F.col("__nth") <= per_entity).drop("__nth")
    unnamed = over.where(F.col(entity).isNull()).orderBy(*order).limit(most)
    return named.unionByName(unnamed).orderBy(*order).limit(most)


def one_per_owner_then_fill(rows: DataFrame, group: str, owner: str, order: list[Column], k: int) -> DataFrame:
    """k rows a group: the best of each owner first, then the best of the others."""
    own = Window.partitionBy(group, owner).orderBy(*order)
    ranked = rows.withColumn("__own", F.row_number().over(own))
    fill = Window.partitionBy(group).orderBy((F.col("__own") > 1).cast("int"), *order)
    return ranked.withColumn("pick", F.row_number().over(fill)).where(F.col("pick") <= k).drop("__own")


def url_items(urls: DataFrame, url: str, topic: str, now: Column) -> DataFrame:
    """Pool items of addresses that someone gave by hand: the topic is the title, the host the source."""
    from skein.functions.urls import host_of

    host = host_of(F.col(url))
    return urls.select(
        F.col(topic).alias("title"), F.col(url).alias("link"), F.lit("").alias("content"), now.alias("published"), F.lit(0.0).alias("age_hours"), host.alias("source_name"),
        F.lit(3).alias("tier"), host.alias("owner"), F.lit(None).cast("string").alias("region"), F.lit(True).alias("fetchable"),
    )
