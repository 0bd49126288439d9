"""Semi, anti, alias and similarity joins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.functions import text as X


def not_covered_by_url(stories: DataFrame, key: str, urls: str, seen: DataFrame) -> DataFrame:
    """Stories none of whose URLs is in seen (url)."""
    hit = stories.select(F.col(key).alias("__key"), F.explode(urls).alias("__url")).join(seen, F.col("__url") == seen["url"], "left_semi")
    return stories.join(hit.select("__key").distinct(), stories[key] == F.col("__key"), "left_anti")


def not_in_cooldown(stories: DataFrame, seen: DataFrame, now: Column, hours: float) -> DataFrame:
    """Stories without a seen row of the same entity set and type younger than `hours`."""
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last_seen").cast("timestamp"))) / 3.6e9
    recent = seen.where(age < hours).select(F.array_join("entities", "\x1f").alias("__entities"), F.col("story_type").alias("__type"))
    same = (F.array_join("entities", "\x1f") == F.col("__entities")) & (F.col("story_type") == F.col("__type"))
    return stories.join(recent, same, "left_anti")


def unseen(stories: DataFrame, key: str, seen_urls: DataFrame, seen_types: DataFrame, now: Column, hours: float = 168.0) -> DataFrame:
    """Stories not told yet: no URL of theirs was ever seen, nor their entities with that type of late.

    seen_urls: (url), which never expires; seen_types: (entities, story_type, last_seen).
    """
    return not_in_cooldown(not_covered_by_url(stories, key, "urls", seen_urls), seen_types, now, hours)


def failed_matches(stories: DataFrame, failed: DataFrame, least: int = 3, share: float = 0.8) -> DataFrame:
    """(id, failed_id) by equal key, a shared URL, or like entity sets of one type.

    An OR join as a union of equi-joins, each of which leaves out the pairs of
    those before it.  So each pair of rows comes once, and where no id has two
    rows, which is looked up first, pairs are neither shuffled nor compared.
    """
    pair = ["id", "failed_id"]

    def side(df: DataFrame, key: str) -> DataFrame:
        urls = F.array_except("urls", F.array(F.lit(None).cast("string")))
        return df.select(key, "key", urls.alias("urls"), F.coalesce(F.size(urls) <= 1, F.lit(True)).alias("one"), F.get(urls, F.lit(0)).alias("only"), "story_type", F.sort_array(F.array_distinct("entities")).alias("set"))

    a = side(stories, "id")
    b = side(failed, "failed_id").select("failed_id", *[F.col(c).alias(f"f_{c}") for c in ("key", "urls", "one", "only", "story_type", "set")])
    other = ~F.coalesce(F.col("key") == F.col("f_key"), F.lit(False))
    by_key = a.select("id", "key").join(b.select("failed_id", "f_key"), F.col("key") == F.col("f_key")).select(*pair)
    # Under several shared URLs a pair stands under the first.
    first = F.col("one") | F.col("f_one") | (F.array_intersect("urls", "f_urls")[0] == F.col("url"))
    by_url = a.select("id", "key", "urls", "one", F.explode("urls").alias("url")).join(b.select("failed_id", "f_key", "f_urls", "f_one", F.explode("f_urls").alias("url")), "url")
    # Most have one URL, which is compared at a fraction of what arrays take.
    shared = F.when(F.col("one") & F.col("f_one"), F.col("only") == F.col("f_only")).otherwise(F.arrays_overlap("urls", "f_urls"))
    strange = other & ~F.coalesce(shared, F.lit(False))
    found = by_key.unionByName(by_url.where(other & first).select(*pair)).unionByName(_like_rows(a, b, least, share).where(strange).select(*pair))
    again = lambda df, key: df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
    return found if again(stories, "id").isEmpty() and again(failed, "failed_id").isEmpty() else found.distinct()


def like_sets(stories: DataFrame, failed: DataFrame, least: int, share: float) -> DataFrame:
    """Pairs of one type whose entity sets share `least` and `share` of their union."""
    a = stories.select("id", "story_type", F.sort_array(F.array_distinct("entities")).alias("set"))
    b = failed.select("failed_id", F.col("story_type").alias("f_story_type"), F.sort_array(F.array_distinct("entities")).alias("f_set"))
    return _like_rows(a, b, least, share).select("id", "failed_id").distinct()


def _like_rows(a: DataFrame, b: DataFrame, least: int, share: float) -> DataFrame:
    """Rows of a and b joined where their sets are alike; a has (story_type, set), b (f_story_type, f_set); sets are sorted.

    Rows of one type and set are alike to the same others, so sets are compared
    once each.  Sets that share enough of their union must share an element
    among each set's first ones by rarity, so only these are exploded (prefix
    filter); the exact test follows.
    """
    kinds_a = a.select("story_type", "set").distinct()
    kinds_b = b.select(F.col("f_story_type").alias("story_type"), F.col("f_set").alias("set")).distinct()
    each = lambda df: df.select("story_type", "set", F.explode("set").alias("entity"))
    counts = each(kinds_a).groupBy("entity").agg(F.count("*").alias("n"))

    def prefix(df: DataFrame, name: str) -> DataFrame:
        order = Window.partitionBy("story_type", "set").orderBy(F.coalesce("n", F.lit(0)), "entity")
        ranked = each(df).join(counts, "entity", "left").withColumn("nth", F.row_number().over(order))
        return ranked.where(F.col("nth") <= F.size("set") - F.ceil(F.size("set") * share) + 1).select("story_type", "entity", F.col("set").alias(name))

    both = F.size(F.array_intersect("sa", "sb"))
    pairs = prefix(kinds_a, "sa").join(prefix(kinds_b, "sb"), ["story_type", "entity"])
    pairs = pairs.where((both >= least) & (both / F.size(F.array_union("sa", "sb")) >= share)).select(F.col("story_type").alias("__type"), "sa", "sb").distinct()
    near = a.join(pairs, (a["story_type"] == F.col("__type")) & (F.col("set") == F.col("sa")))
    return near.join(b, (F.col("__type") == F.col("f_story_type")) & (F.col("sb") == F.col("f_set")))


def canonicalize(rows: DataFrame, name: str, aliases: DataFrame) -> DataFrame:
    """rows with canonical: the canonical form of a name, or the name itself."""
    known = aliases.groupBy(F.lower(F.trim("alias")).alias("__alias")).agg(F.min("canonical").alias("__canonical"))
    joined = rows.join(known, F.lower(F.trim(rows[name])) == known["__alias"], "left")
    return joined.withColumn("canonical", F.coalesce("__canonical", name)).drop("__alias", "__canonical")


def merge_dictionaries(base: DataFrame, state: DataFrame) -> DataFrame:
    """base and those rows of state whose canonical no base alias names."""
    taken = base.select(F.explode(F.array_union("aliases", F.array("canonical"))).alias("a")).select(F.lower("a").alias("a")).distinct()
    return base.unionByName(state.join(taken, F.lower(state["canonical"]) == taken["a"], "left_anti"))


def claims_with_sources(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """Claims with their sources' columns, by normalised URL; sources have one row a key."""
    from skein.functions.urls import claim_url_key

    keyed = sources.withColumn("__key", claim_url_key(F.col("link")))
    first = keyed.withColumn("__n", F.row_number().over(Window.partitionBy("__key").orderBy("link"))).where("__n = 1").drop("__n")
    return claims.withColumn("__ckey", claim_url_key(F.col("source_url"))).join(first, F.col("__ckey") == F.col("__key"), "left").drop("__key", "__ckey")


def contributing(sources: DataFrame, claims: DataFrame) -> DataFrame:
    """Sources that some claim names."""
    from skein.functions.urls import claim_url_key

    used = claims.select(claim_url_key(F.col("source_url")).alias("__used")).distinct()
    return sources.join(used, claim_url_key(sources["link"]) == used["__used"], "left_semi")


def postings(articles: DataFrame, key: str, terms: str) -> DataFrame:
    """Inverted index: (term, article)."""
    return articles.select(F.explode(F.array_distinct(terms)).alias("term"), F.col(key).alias("article"))


#: Articles of at most so many terms are related by subsets of them.
FEW_TERMS = 6


def related(articles: DataFrame, key: str, entities: str, keywords: str, category: str, newest: str, k: int = 3, max_docs: int | None = None) -> DataFrame:
    """(article, other, score): the k others that share most terms.

    A shared entity counts 2, a shared keyword 1, the same category 1 where
    anything is shared; newer articles win ties.  max_docs leaves out terms
    that more articles have.

    Articles of few terms meet by subsets of their terms.  Whoever belongs to
    the k best others of an article is among the first k + 1 of those that
    have all that both share, for who stands before it there shares as much at
    least and is newer.  So each subset needs its first k + 1 only, and
    articles of the same terms are one; no pair of articles is made that is
    not a candidate.  Pairs with an article of many terms are joined on terms.
    """
    terms = postings(articles, key, entities).withColumn("w", F.lit(2)).unionByName(postings(articles, key, keywords).withColumn("w", F.lit(1))).where("term IS NOT NULL AND article IS NOT NULL")
    if max_docs:
        rare = terms.groupBy("term", "w").agg(F.count("*").alias("df")).where(F.col("df") <= max_docs).select("term", "w")
        terms = terms.join(rare, ["term", "w"])
    held = terms.groupBy("article").agg(F.sort_array(F.collect_list(F.struct("w", F.col("term").cast("string").alias("term")))).alias("set"))
    facts = articles.select(F.col(key).alias("article"), F.col(category).cast("string").alias("c"), F.col(newest).alias("t"))
    rows = held.join(facts, "article")
    few, many = rows.where(F.size("set") <= FEW_TERMS), rows.where(F.size("set") > FEW_TERMS)

    def first(df: DataFrame, by: list[str], n: int, *best) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(*best, F.desc_nulls_last("t"), "other")
        return df.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= n).drop("nth")

    def subsets(df: DataFrame) -> DataFrame:
        each = df.withColumn("bits", F.expr("explode(sequence(1, shiftleft(1, size(set)) - 1))")).withColumn("sub", F.expr("filter(set, (x, i) -> bit_get(bits, i) = 1)"))
        # With the category and without it.
        each = each.withColumn("own", F.explode(F.when(F.col("c").isNull(), F.array(F.lit(None).cast("string"))).otherwise(F.array(F.lit(None).cast("string"), F.col("c")))))
        weight = F.aggregate("sub", F.lit(0), lambda n, x: n + x["w"]) + F.when(F.col("own").isNull(), 0).otherwise(1)
        return each.withColumn("id", F.struct("sub", F.col("own").isNotNull().alias("has"), F.coalesce("own", F.lit("")).alias("own"))).withColumn("score", weight)

    kinds = few.select("set", "c").distinct()
    members = first(few.withColumnRenamed("article", "other"), ["set", "c"], k + 1)
    lists = first(subsets(members).select("id", "other", "t"), ["id"], k + 1).groupBy("id").agg(F.collect_list(F.struct("other", "t")).alias("l"))
    found = subsets(kinds).select("id", "set", "c", "score").join(lists, "id").select("set", "c", "score", F.inline("l"))
    found = found.groupBy("set", "c", "other", "t").agg(F.max("score").alias("score"))
    best = first(found, ["set", "c"], k + 1, F.desc("score")).groupBy("set", "c").agg(F.collect_list(F.struct("other", "score", "t")).alias("l"))
    near = few.select("article", "set", "c").join(best, (few["set"] == best["set"]) & few["c"].eqNullSafe(best["c"])).select("article", F.inline("l"))

    # An article of many terms against all, both ways.
    each = lambda df: df.select("article", "c", "t", F.inline("set"))
    a, b = each(many), each(rows).select(F.col("article").alias("other"), F.col("c").alias("c2"), F.col("t").alias("t2"), "term", "w")
    pairs = a.join(b, ["term", "w"]).where("article != other").groupBy("article", "c", "t", "other", "c2", "t2").agg(F.sum("w").alias("shared"))
    pairs = pairs.withColumn("score", F.col("shared") + F.when(F.col("c") == F.col("c2"), 1).otherwise(0))
    back = pairs.join(few.select(F.col("article").alias("other")), "other", "left_semi")
    far = pairs.select("article", "other", "score", F.col("t2").alias("t")).unionByName(back.select(F.col("other").alias("article"), F.col("article").alias("other"), "score", "t"))
    scored = near.where("article != other").unionByName(far)
    place = Window.partitionBy("article").orderBy(F.desc("score"), F.desc_nulls_last("t"), "other")
    return scored.withColumn("nth", F.row_number().over(place)).where(F.col("nth") <= k).select("article", "other", F.col("score").cast("bigint").alias("score"), "nth")


def phrase_matches(titles: DataFrame, text: str, phrases: DataFrame) -> DataFrame:
    """Titles that hold all words of some phrase; phrases: (topic, phrase).  Joined on the phrase's longest word."""
    words = F.array_distinct(F.split(X.normalize_title(F.col("phrase")), " "))
    longest = F.array_sort(words, lambda a, b: F.length(b) - F.length(a))[0]
    wanted = phrases.select("topic", words.alias("__need"), longest.alias("__word"))
    have = titles.withColumn("__words", F.split(X.normalize_title(F.col(text)), " "))
    each = have.withColumn("__word", F.explode(F.array_distinct("__words")))
    hits = each.join(wanted, "__word").where(F.size(F.array_except("__need", "__words")) == 0)
    return hits.drop("__word", "__words", "__need").distinct()


#: Up to so many pairs of near titles go to every task, as numbers: 4 bytes a pair.
FEW_TITLES = 1 << 20


def near_duplicate_articles(articles: DataFrame, key: str, title: str, day: str, days: int = 7, share: float = 0.5) -> DataFrame:
    """(key, earlier, why): articles with an earlier near copy.

    The same normalised title at any time, or within `days` before, or on that
    day with a smaller key, a title whose words are alike; earlier is the least
    key of all such.  Titles are compared once each, whatever the number of
    their articles, and meet on their rarest words; under words of titles that
    seldom come again, only those of neighbouring buckets of `days` do.
    """
    raw = articles.select(F.col(key).alias("k"), F.to_date(day).alias("d"), F.col(title).alias("raw"))
    # Titles are normalised once each: what is asked of a maximum is not asked of all rows before it.
    names = raw.groupBy("raw").agg(F.max("raw").alias("t")).select("raw", X.normalize_title(F.col("t")).alias("t")).where("t != ''")
    rows = raw.join(names, "raw").select("k", "d", "t")
    first = rows.groupBy("t").agg(F.min(F.struct("d", "k")).alias("f"))
    same = rows.join(first, "t").where("k != f.k").select(F.col("k").alias(key), F.col("f.k").alias("earlier"), F.lit("title").alias("why"))
    # Articles of one title and day have the same near titles; the least key stands for them.
    bucket = lambda d: F.floor(F.datediff(d, F.lit("1970-01-01").cast("date")) / days)
    dated = raw.where("d IS NOT NULL")
    heads = dated.groupBy("raw", "d").agg(F.min("k").alias("k")).join(names, "raw").groupBy("t", "d").agg(F.min("k").alias("k"))
    titles = dated.select("raw", bucket("d").alias("b")).distinct().join(names, "raw").select("t", "b").distinct()
    pairs = _near_titles(titles, share).persist(StorageLevel.DISK_ONLY)  # read again
    whole = isinstance(articles.schema[key].dataType, T.IntegralType)
    few = whole and pairs.limit(FEW_TITLES + 1).count() <= FEW_TITLES
    near = (_earlier_by_number if few else _earlier_by_title)(heads, pairs, days)
    # Any article of a former day is earlier; of the same day those with a smaller key are.
    found = rows.join(near, (rows["t"] == near["ta"]) & (rows["d"] == near["da"]))
    earlier = F.least("former", F.when(F.col("same") < F.col("k"), F.col("same"))).cast(articles.schema[key].dataType)
    alike = found.select(F.col("k").alias(key), earlier.alias("earlier"), F.lit("similar").alias("why")).where("earlier IS NOT NULL")
    return same.unionByName(alike)


def _earlier_by_title(heads: DataFrame, pairs: DataFrame, days: int) -> DataFrame:
    """(ta, da, former, same): least keys of titles near ta, of the `days` before da and of da; heads: (t, d, k)."""
    bucket = lambda d: F.floor(F.datediff(d, F.lit("1970-01-01").cast("date")) / days)
    # Each head is seen on its day and the days after it, all of its bucket or the next.
    seen = heads.withColumn("b", F.explode(F.array(*[bucket("d") + i for i in range(2)])))
    seen = seen.withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(days)))).withColumn("da", F.date_add("d", F.col("lag"))).where(bucket("da") == F.col("b"))
    seen = seen.groupBy("b", F.col("t").alias("tb"), "da").agg(F.min(F.when(F.col("lag") > 0, F.col("k"))).alias("former"), F.min(F.when(F.col("lag") == 0, F.col("k"))).alias("same"))
    near = seen.join(pairs, "tb").groupBy("b", "ta", "da").agg(F.min("former").alias("former"), F.min("same").alias("same"))
    return near.select("ta", "da", "former", "same")


def _earlier_by_number(heads: DataFrame, pairs: DataFrame, days: int) -> DataFrame:
    """_earlier_by_title() where pairs are few and keys are whole numbers.

    Titles are numbered, so a task holds all pairs and the days of a bucket and
    the one before; no row is made for a pair and a day.
    """
    # Bounded by the number of pairs, so one task can number them.
    names = pairs.select(F.explode(F.array("ta", "tb")).alias("t")).distinct()
    names = names.select("t", (F.row_number().over(Window.orderBy("t")) - 1).alias("at")).persist(StorageLevel.DISK_ONLY)
    number = lambda end: names.select(F.col("t").alias(f"t{end}"), F.col("at").alias(end))
    got = pairs.join(number("a"), "ta").join(number("b"), "tb").select("a", "b").toArrow()
    a, b = (np.asarray(got.column(i).combine_chunks()).astype(np.int32) for i in range(2))
    order = np.argsort(a, kind="stable")
    ends = np.cumsum(np.bincount(a, minlength=max(a.max(initial=-1), b.max(initial=-1)) + 1))
    held = heads.sparkSession.sparkContext.broadcast((b[order], ends))
    none = np.iinfo(np.int64).max

    def least_of_near(values: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The least of the values of the titles near each of at."""
        near, ends = held.value
        n = ends[at] - np.where(at > 0, ends[at - 1], 0)
        out = np.full(len(at), none)
        some = np.flatnonzero(n)
        if len(some):
            until = np.cumsum(n[some])
            places = np.arange(until[-1]) + np.repeat(ends[at[some]] - until, n[some])
            out[some] = np.minimum.reduceat(values[near[places]], until - n[some])
        return out

    def settle(group: tuple, rows: pa.Table) -> pa.Table:
        at, day, k = (np.asarray(rows.column(c).combine_chunks()) for c in ("at", "day", "k"))
        order = np.argsort(day, kind="stable")
        at, day, k = at[order], day[order], k[order]
        values = np.full(len(held.value[1]), none)
        out = []
        first = group[0].as_py() * days
        for d in np.unique(day[day >= first]).tolist():
            begin, now, end = np.searchsorted(day, [d - days, d, d + 1]).tolist()
            least = []
            for part in (slice(begin, now), slice(now, end)):
                np.minimum.at(values, at[part], k[part])
                least.append(least_of_near(values, at[now:end]))
                values[at[part]] = none
            some = np.minimum(*least) < none
            out.append((at[now:end][some], np.full(some.sum(), d), *(x[some] for x in least)))
        cols = [np.concatenate(c) if out else np.zeros(0, np.int64) for c in (zip(*out, strict=True) if out else range(4))]
        return pa.table([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64(), mask=c == none) for c in cols[2:])], ["at", "day", "former", "same"])

    numbered = heads.join(names, "t").select("at", F.unix_date("d").alias("day"), F.coalesce(F.col("k").cast("bigint"), F.lit(none)).alias("k"))
    dealt = numbered.withColumn("b", F.floor(F.col("day") / days)).withColumn("b", F.explode(F.array("b", F.col("b") + 1)))
    near = dealt.groupBy("b").applyInArrow(settle, "at int, day int, former bigint, same bigint")
    return near.join(names, "at").select(F.col("t").alias("ta"), F.date_from_unix_date("day").alias("da"), "former", "same")


def _near_titles(titles: DataFrame, share: float) -> DataFrame:
    """(ta, tb) of different titles whose words are alike; titles: (t, b), the buckets of each title.

    Prefix filter on the rarest words.  A pair whose ta is not in a bucket of
    tb or the next may be left out.  Each word takes the way that makes fewer
    pairs: all its titles, or those of a bucket and the one before.
    """
    sets = titles.select("t").distinct().withColumn("set", F.array_distinct(F.split("t", " ")))
    each = sets.select("t", "set", F.explode("set").alias("w"))
    place = Window.partitionBy("t").orderBy("n", "w")
    prefix = each.join(each.groupBy("w").agg(F.count("*").alias("n")), "w").withColumn("nth", F.row_number().over(place))
    prefix = prefix.where(F.col("nth") <= F.size("set") - F.ceil(F.size("set") * share) + 1).select("w", "t", "set")
    dated = prefix.select("w", "t").join(titles, "t").groupBy("w", "b").agg(F.count("*").alias("c"))
    cost = dated.groupBy("w").agg((2 * F.sum(F.col("c") * F.col("c"))).alias("by_bucket"))
    ways = prefix.groupBy("w").agg((F.count("*") * F.count("*")).alias("in_all")).join(cost, "w").select("w", (F.col("in_all") <= F.col("by_bucket")).alias("whole"))
    marked = prefix.join(ways, "w")
    whole, parted = marked.where("whole").drop("whole"), marked.where("NOT whole").drop("whole").join(titles, "t")
    side = lambda df, s, *by: df.select("w", *by, F.col("t").alias(f"t{s}"), F.col("set").alias(f"s{s}"))
    alike = (F.col("ta") != F.col("tb")) & (X.jaccard(F.col("sa"), F.col("sb")) >= share)
    met = side(whole, "a").join(side(whole, "b"), "w").where(alike).select("ta", "tb")
    later = parted.withColumn("b", F.explode(F.array(F.col("b"), F.col("b") - 1)))
    met = met.unionByName(side(later, "a", "b").join(side(parted, "b", "b"), ["w", "b"]).where(alike).select("ta", "tb"))
    return met.distinct()


def robots_allowed(pages: DataFrame, url: str, rules: DataFrame) -> DataFrame:
    """Pages that the longest rule of their host allows; rules: (host, path, allow).  No rule allows."""
    from skein.functions.urls import host_of

    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)
    tagged = pages.withColumn("__host", host_of(F.col(url))).withColumn("__path", F.when(path == "", "/").otherwise(path))
    r = rules.select(F.lower("host").alias("__rhost"), F.col("path").alias("__rpath"), "allow")
    fits = tagged.join(r, (F.col("__host") == F.col("__rhost")) & F.startswith("__path", F.col("__rpath")))
    # Longest rule first; of equal ones the one that allows.
    denied = fits.groupBy("__host", "__path").agg(F.max(F.struct(F.length("__rpath").alias("n"), F.col("allow"))).alias("best")).where("NOT best.allow")
    return tagged.join(denied, ["__host", "__path"], "left_anti").drop("__host", "__path")
