"""Which game or photo a headline means, and which photo may be used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import text as X

# Words that make a name another model's.
MODEL_WORDS = ["pro", "slim", "oled", "lite", "mini", "max", "ultra", "plus", "super", "xl", "digital", "edition", "ti", "xt", "s", "x"]
NUMERALS = ["ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x"]


def tokens(value: Column) -> Column:
    return F.filter(F.split(X.normalize_title(value), " "), lambda w: w != "")


def continues(title: Column, name: Column, words: list[str]) -> Column:
    """Whether a name (both normalised) stands right before a number or a model word."""
    tail = "|".join(words)
    return F.regexp_like(F.concat(F.lit(" "), title, F.lit(" ")), F.concat(F.lit(r"\s\Q"), name, F.lit(rf"\E (?:\d+|{tail})\s")))


def match_game(titles: DataFrame, key: str, title: str, games: DataFrame) -> DataFrame:
    """(key, game): the longest game name that stands in a title as words.

    games: (game).  Joined on the name's first word.  A name that goes on as
    another model's is not meant; a one-word name must be capitalised.
    """
    form = X.normalize_title(F.col(title))
    have = titles.select(key, F.col(title).alias("__title"), form.alias("__form"), F.explode(F.array_distinct(tokens(F.col(title)))).alias("__w"))
    want = games.select("game", X.normalize_title(F.col("game")).alias("__name")).withColumn("__w", F.split("__name", " ")[0])
    hit = have.join(want.where("__name != ''"), "__w").where(X.contains_phrase(F.col("__form"), F.col("__name")))
    single = ~F.contains("__name", F.lit(" "))
    proper = F.regexp_like("__title", F.concat(F.lit(r"(?<!^)\b"), F.initcap("__name"), F.lit(r"\b")))
    ok = ~continues(F.col("__form"), F.col("__name"), NUMERALS) & (~single | proper)
    order = Window.partitionBy(key).orderBy(F.desc(F.size(F.split("__name", " "))), "game")
    return hit.where(ok).withColumn("n", F.row_number().over(order)).where("n = 1").select(key, "game")


def search_terms(phrases: Column, n: int) -> Column:
    """Distinct phrases, the longest first, n at most."""
    longest = lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0)
    return F.slice(F.array_sort(F.array_distinct(phrases), longest), 1, n)


def license_label(name: Column, allowed: list[str]) -> Column:
    """The plain label of a free licence on the list; else null."""
    n = F.trim(F.regexp_replace(name, r"\s+", " "))
    cc = F.when(n.rlike(r"(?i)^CC BY(-SA)? \d\.\d$"), F.upper(n))
    label = F.when(F.lower(n).isin("cc0", "cc0 1.0", "cc0 1.0 universal"), "CC0").when(F.lower(n).isin("public domain", "pd"), "Public domain").otherwise(cc)
    return F.when(F.lower(label).isin([a.lower() for a in allowed]), label)


def names_product(title: Column, description: Column, phrase: Column) -> Column:
    """Whether title and description together hold every word of the product."""
    return (F.size(tokens(phrase)) > 0) & X.is_subset(tokens(phrase), F.concat(tokens(title), tokens(F.coalesce(description, F.lit("")))))


def unusable_reason(min_width: int, low: float, high: float, allowed: list[str], others: list[str]) -> Column:
    """Why a photo (mime, width, height, license, artist, title, description, phrase) is not used; null if it may be."""
    ratio = F.col("width") / F.col("height")
    label = license_label(F.col("license"), allowed)
    form, phrase = X.normalize_title(F.col("title")), X.normalize_title(F.col("phrase"))
    joined = rf"(?:\b(?:and|with|vs|versus|beside|next to)\s+(?:an?\s+|the\s+)*(?:{'|'.join(others)})\b|\b(?:{'|'.join(others)})\s+(?:and|with|vs)\b)"
    return (
        F.when(~F.coalesce(F.col("mime").isin("image/jpeg", "image/png", "image/webp"), F.lit(False)), "not a photo format")
        .when(F.coalesce("width", F.lit(0)) < min_width, "too narrow")
        .when(F.coalesce(ratio < low, F.lit(True)), "too tall")
        .when(ratio > high, "too panoramic")
        .when(label.isNull(), "license not allowed")
        .when(label.startswith("CC BY") & (F.coalesce(F.trim("artist"), F.lit("")) == ""), "no author to credit")
        .when(form.rlike(r"\b(?:logo|screenshot|render|diagram|teardown)\b"), "not a plain product photo")
        .when(~names_product(F.col("title"), F.col("description"), F.col("phrase")), "does not name the product")
        .when(form.rlike(joined), "names another product")
        .when(continues(F.concat_ws(" ", form, X.normalize_title(F.coalesce("description", F.lit("")))), phrase, MODEL_WORDS), "names a different model")
    )


def photo_order() -> list[Column]:
    """Best first: product in the title, title that starts with it, landscape, wide."""
    form, phrase = X.normalize_title(F.col("title")), X.normalize_title(F.col("phrase"))
    ratio = F.col("width") / F.col("height")
    return [
        (~X.is_subset(tokens(F.col("phrase")), tokens(F.col("title")))).cast("int"),
        (~form.startswith(phrase)).cast("int"),
        (~ratio.between(1.3, 2.4)).cast("int"),
        F.desc("width"),
        F.col("title"),
    ]
