"""Durations, ages and dates.  `now` is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNIT_HOURS = {"week": 168.0, "day": 24.0, "hour": 1.0, "minute": 1 / 60, "second": 1 / 3600}


def duration_hours(value: Column) -> Column:
    """Hours of texts such as "2 days" or "48"; null unless positive."""
    v = F.lower(F.trim(value.cast("string")))
    amount = F.regexp_extract(v, r"^(\d+(?:\.\d+)?)", 1).try_cast("double")
    unit = F.regexp_extract(v, r"^\d+(?:\.\d+)?\s*(week|day|hour|minute|second)s?$", 1)
    scale = F.when(v.rlike(r"^\d+(?:\.\d+)?$"), 1.0)
    for name, hours in _UNIT_HOURS.items():
        scale = scale.when(unit == name, hours)
    hours = amount * scale
    return F.when(hours > 0, hours)


def age_hours(published: Column, now: Column, stored: Column | None = None) -> Column:
    """Hours from published to now; a stored age, where given, wins."""
    seconds = F.unix_micros(now.cast("timestamp")) - F.unix_micros(published.cast("timestamp"))
    age = seconds / F.lit(3.6e9)
    return age if stored is None else F.coalesce(stored, age)


def parse_time(value: Column) -> Column:
    """ISO times with or without zone (none: UTC); null for anything else."""
    return F.try_to_timestamp(F.regexp_replace(F.trim(value), "Z$", "+00:00"))


def publication_anchor(url_day: Column, feed_day: Column) -> Column:
    """struct(anchor, ambiguous): the URL's date, else the feed's; a gap over a day is ambiguous."""
    apart = F.abs(F.datediff(url_day, feed_day)) > 1
    unsure = F.coalesce(apart, F.lit(False))
    return F.struct(F.when(~unsure, F.coalesce(url_day, feed_day)).alias("anchor"), unsure.alias("ambiguous"))


def iso_midnight(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd'T'00:00:00'Z'")


# Month names in order.
MONTHS = [
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
]


def first_date(sentence: Column) -> Column:
    """The first ISO date, month name with a day, or year of a sentence, as written."""
    month = "|".join(MONTHS)
    forms = [r"\b\d{4}-\d{2}-\d{2}\b", rf"(?i)\b(?:{month})\s+\d{{1,2}}\b|\b\d{{1,2}}\s+(?:{month})\b", r"\b(?:19|20)\d{2}\b"]
    got = [F.nullif(F.regexp_extract(sentence, f, 0), F.lit("")) for f in forms]
    return F.coalesce(*got)


def dates_match(a: Column, b: Column) -> Column:
    """Whether two struct(year, month, day) agree, a missing year agreeing with any."""
    year = a["year"].isNull() | b["year"].isNull() | (a["year"] == b["year"])
    return (a["month"] == b["month"]) & (a["day"] == b["day"]) & year
