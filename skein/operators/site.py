"""Listings and search over published articles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def newest(articles: DataFrame, time: str, key: str, n: int = 13) -> DataFrame:
    """The newest n with their place; the first is the lead."""
    top = articles.orderBy(F.desc(time), key).limit(n)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc(time), key)))


def top_topics(articles: DataFrame, entities: str, n: int = 12) -> DataFrame:
    counts = articles.select(F.explode(F.array_distinct(entities)).alias("topic")).groupBy("topic").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "topic").limit(n)


def topic_hubs(articles: DataFrame, key: str, entity: str, slug: str, time: str, keep: int = 20) -> DataFrame:
    """(slug, name, n, newest): the first spelling of a topic, its size and its newest articles."""
    first = F.min_by(entity, F.struct(time, key))
    order = Window.partitionBy(slug).orderBy(F.desc(time), F.desc(key))
    ranked = articles.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= keep)
    heads = articles.groupBy(slug).agg(first.alias("name"), F.count("*").alias("n"))
    lists = ranked.groupBy(slug).agg(F.array_sort(F.collect_list(F.struct("nth", key))).alias("l"))
    return heads.join(lists, slug).select(slug, "name", "n", F.transform("l", lambda x: x[key]).alias("newest"))


def category_pages(articles: DataFrame, category: str, names: DataFrame) -> DataFrame:
    """(name, n) of all categories, empty ones too; names: (name)."""
    n = articles.groupBy(category).agg(F.count("*").alias("n"))
    return names.join(n, names["name"] == n[category], "left").select("name", F.coalesce("n", F.lit(0)).alias("n"))


def search_index(docs: DataFrame, key: str, tokens, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(term, key, weight): BM25 weights of every posting."""
    each = docs.select(key, F.explode(tokens).alias("term"))
    tf = each.groupBy(key, "term").agg(F.count("*").alias("tf"))
    size = tf.groupBy(key).agg(F.sum("tf").alias("len"))
    total = size.agg(F.count("*").alias("docs"), F.avg("len").alias("mean"))  # one row
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    scored = tf.join(size, key).join(df, "term").join(F.broadcast(total))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    return scored.select("term", key, weight.alias("weight"))


def search(index: DataFrame, key: str, terms: list[str], n: int = 20) -> DataFrame:
    """The n best documents for some terms."""
    hits = index.where(F.col("term").isin(terms)).groupBy(key).agg(F.sum("weight").alias("score"))
    return hits.orderBy(F.desc(F.round("score", 9)), key).limit(n)


def search_two_pass(index: DataFrame, docs: DataFrame, key: str, kind, terms: list[str], n: int = 20) -> DataFrame:
    """The best documents of a kind; where none has a hit, of any kind."""
    wanted = index.join(docs.where(kind).select(key), key, "left_semi")
    first = search(wanted, key, terms, n).withColumn("pass", F.lit(1))
    found = F.broadcast(first.agg(F.count("*").alias("found")))  # one row
    rest = search(index, key, terms, n).withColumn("pass", F.lit(2)).join(found).where("found = 0").drop("found")
    return first.unionByName(rest)


def unique_slugs(articles: DataFrame, key: str, slug: str, taken: DataFrame | None = None) -> DataFrame:
    """Slugs with -2, -3 ... for later articles of the same base; taken: (slug, n) counts."""
    nth = F.row_number().over(Window.partitionBy(slug).orderBy(key))
    rows = articles.withColumn("nth", nth)
    if taken is not None:
        t = taken.select(F.col("slug").alias("t_slug"), F.col("n").alias("t_n"))
        rows = rows.join(t, rows[slug] == t["t_slug"], "left").withColumn("nth", F.col("nth") + F.coalesce("t_n", F.lit(0)))
    return rows.select(key, F.when(F.col("nth") == 1, F.col(slug)).otherwise(F.concat(F.col(slug), F.lit("-"), "nth")).alias("slug"))


def duplicated(articles: DataFrame, key: str, value) -> DataFrame:
    """Every article whose value (slug or title, case aside) another has too."""
    # Values meet as digests, as a title can be a whole text; counts first, so that a common one needs no task of its own.
    rows = articles.select(key, F.coalesce(F.sha2(F.lower(value), 256), F.lit("")).alias("__d"))
    many = rows.groupBy("__d").agg(F.count("*").alias("n")).where("n > 1")
    return rows.join(many, "__d").select(key, "n")


def tags(own, extra, limit: int):
    """Distinct tags, filled up from extra, limit at most."""
    return F.slice(F.array_distinct(F.concat(F.transform(own, lambda t: F.lower(F.trim(t))), extra)), 1, limit)


def link_targets(articles: DataFrame, key: str, time: str, own, now, hours: float = 24.0) -> DataFrame:
    """Articles that another may link to: not itself, and published long enough ago."""
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col(time).cast("timestamp"))) / 3.6e9
    return articles.where((F.col(key) != own) & (age >= hours))


def rss(articles: DataFrame, key: str, title, link, time: str, site: str, n: int = 50) -> DataFrame:
    """(place, xml): the newest n items of a feed, then the feed itself at place 0."""
    from skein.functions.text import message

    item = F.concat(F.lit("<item><title>"), message(title), F.lit("</title><link>"), message(link, 2000), F.lit("</link><pubDate>"), F.date_format(time, "EEE, dd MMM yyyy HH:mm:ss 'GMT'"), F.lit("</pubDate></item>"))
    items = newest(articles.withColumn("xml", item), time, key, n).select("place", "xml")
    # At most n items make the channel.
    every = items.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "xml"))), lambda x: x["xml"]), "").alias("all"))
    channel = every.select(F.lit(0).alias("place"), F.concat(F.lit(f'<rss version="2.0"><channel><title>{site}</title>'), "all", F.lit("</channel></rss>")).alias("xml"))
    return items.unionByName(channel)


def topic_links(entities):
    """struct(name, slug) of an article's entities that have a slug, in order."""
    from skein.functions.text import slugify

    return F.filter(F.transform(entities, lambda e: F.struct(e.alias("name"), slugify(e).alias("slug"))), lambda x: x["slug"] != "")
