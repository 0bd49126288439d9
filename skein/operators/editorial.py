"""Checks of drafts against their facts, and the calls that make drafts."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import text as X
from skein.functions import titles as H
from skein.operators.gates import failures


def subsequence(needle: Column, hay: Column) -> Column:
    """Whether an array's elements stand in another in order, gaps allowed."""
    step = lambda i, w: F.when((i < F.size(needle)) & (F.get(needle, i) == w), i + 1).otherwise(i)
    return F.aggregate(hay, F.lit(0), step) == F.size(needle)


def title_coverage(articles: DataFrame, key: str, title: str, entities: str) -> DataFrame:
    """(key, phrase): names in a title that no listed entity covers.

    A name is covered by an entity of which it is an ordered part, or which is
    an ordered part of it.
    """
    names = articles.select(key, entities, F.explode(H.names(F.col(title))).alias("phrase"))
    words = lambda c: F.split(X.normalize_title(c), " ")
    own = words(F.col("phrase"))
    covered = F.exists(entities, lambda e: subsequence(own, words(e)) | subsequence(words(e), own))
    return names.where(~covered).select(key, "phrase")


def entity_mentions(articles: DataFrame, key: str, text: str, entities: str) -> DataFrame:
    """(key, entity): listed entities that the text never names as a run of words."""
    form = X.normalize_title(F.col(text))
    each = articles.select(key, form.alias("__t"), F.explode(entities).alias("entity"))
    return each.where(~X.contains_phrase(F.col("__t"), X.normalize_title(F.col("entity")))).select(key, "entity")


def outlets_named(articles: DataFrame, key: str, body: str, outlets: DataFrame) -> DataFrame:
    """(key, outlet): outlets of an article's sources that its prose names.

    outlets: (key, outlet).  Headings, list lines with links and lower-case
    matches do not count.
    """
    prose = F.regexp_replace(F.regexp_replace(F.col(body), r"(?m)^#{1,6}\s.*$", " "), r"(?m)^\s*[-*]\s+\[.*$", " ")
    rows = articles.select(F.col(key).alias("__k"), prose.alias("__p"))
    form = F.concat(F.lit(r"(?U)\b\Q"), F.col("outlet"), F.lit(r"\E\b"))
    joined = rows.join(outlets, rows["__k"] == outlets[key])
    return joined.where((F.lower("outlet") != F.col("outlet")) & F.regexp_like("__p", form)).select(key, "outlet").distinct()


def offer_gate(articles: DataFrame, key: str, body: str, facts: str, phrases: list[str]) -> DataFrame:
    """Offers that end need a date in the facts."""
    low = F.lower(body)
    dated = F.col(facts).rlike(r"\b\d{4}-\d{2}-\d{2}\b|(?i)\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+\d{1,2}\b")
    return failures(articles, key, "offers", *[(F.contains(low, F.lit(p)) & ~F.coalesce(dated, F.lit(False)), f"{p} without a date") for p in phrases])


def completeness_gate(articles: DataFrame, key: str, body: str, facts: str, words: list[str]) -> DataFrame:
    """Words such as "all" only where a fact says so."""
    return failures(articles, key, "completeness", *[(X.any_word(F.col(body), [w]) & ~X.any_word(F.col(facts), [w]), w) for w in words])


def numeric_claims(text: Column, terms: list[str], reach: int = 3) -> Column:
    """Whether a number stands within `reach` words of a term of comparison."""
    w = F.split(F.lower(text), r"[^\p{L}\p{N}.,%]+")
    marks = F.transform(w, lambda x: F.when(x.rlike(r"^\d"), 1).when(x.isin(terms), 2).otherwise(0))
    near = lambda m, i: (m == 1) & F.array_contains(
        F.slice(marks, F.greatest(i + 1 - reach, F.lit(1)), F.least(i, F.lit(reach)) + reach + 1), 2
    )
    return F.size(F.filter(marks, near)) > 0


def currency_names(text: Column) -> Column:
    """Capitalised words right after an amount: the money of a game."""
    found = F.regexp_extract_all(text, F.lit(r"\b\d[\d,]*\s+([A-Z][\w-]+(?:\s[A-Z][\w-]+)?)"), 1)
    return F.array_sort(F.array_distinct(found))


def seo_errors(articles: DataFrame, key: str) -> DataFrame:
    """Rules on title, description, slug and tags; one row for each that fails."""
    t, d, s = F.col("title"), F.col("description"), F.col("slug")
    return failures(
        articles,
        key,
        "seo",
        ((F.length(t) < 15) | (F.length(t) > 65), "title length"),
        (t.rlike(r"[!?]{2,}|\.\.\.$"), "title punctuation"),
        (F.upper(t) == t, "title in capitals"),
        ((F.length(d) < 70) | (F.length(d) > 160), "description length"),
        (X.normalize_title(t) == X.normalize_title(d), "description repeats title"),
        (~s.rlike(r"^[a-z0-9]+(?:-[a-z0-9]+)*$"), "slug form"),
        (F.length(s) > 80, "slug length"),
        ((F.size("tags") < 2) | (F.size("tags") > 8), "number of tags"),
        (F.size(F.array_distinct(F.transform("tags", lambda x: F.lower(x)))) < F.size("tags"), "repeated tag"),
    )


def statement_attribution(clauses: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """(key, clause_id): clauses from statements that name no speaker of the fact, nor does their sentence.

    clauses: (key, clause_id, fact_id, clause, sentence); facts: (key, fact_id,
    kind, speakers array).
    """
    joined = clauses.join(facts.where(F.col("kind").isin("statement", "opinion")), [key, "fact_id"])
    form = X.normalize_title(F.concat_ws(" ", "clause", "sentence"))
    named = F.exists("speakers", lambda s: X.contains_phrase(form, X.normalize_title(s)) | X.contains_phrase(form, F.element_at(F.split(X.normalize_title(s), " "), -1)))
    return joined.where(~named).select(key, "clause_id").distinct()


# ---- calls ------------------------------------------------------------------

Client = Callable[[str], str]


def model_calls(prompts: DataFrame, key: str, prompt: str, clients: dict[str, Client], required: list[str], banned: str | None = None) -> DataFrame:
    """(key, provider, answer, error): the first client of the chain whose JSON answer has the required fields.

    clients are tried in order, those of the banned family are left out.  They
    are plain functions, sent to the executors; a client that raises or gives
    something else counts as failed.
    """
    chain = [(n, f) for n, f in clients.items() if not banned or not n.startswith(banned)]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for k, text in zip(part["k"], part["p"], strict=True):
                errors, done = [], (None, None)
                for name, call in chain:
                    try:
                        answer = call(text)
                        lost = [f for f in required if f not in json.loads(answer)]
                        if lost:
                            raise ValueError(f"no {', '.join(lost)}")
                        done = (name, answer)
                        break
                    except Exception as e:  # noqa: BLE001  any failure moves on to the next client
                        errors.append(f"{name}: {e}")
                out.append((k, *done, "; ".join(errors) or None))
            yield pd.DataFrame(out, columns=["k", "provider", "answer", "error"])

    rows = prompts.select(F.col(key).cast("string").alias("k"), F.col(prompt).alias("p"))
    return rows.mapInPandas(run, "k string, provider string, answer string, error string").withColumnRenamed("k", key)


def first_success(candidates: list, attempt: Callable[[object], object | None], most_calls: int, cost: Callable[[object], int] = lambda _: 1):
    """(candidate, result) of the first of a few candidates that works, within a budget of calls.

    A driver-side loop over a picked list, which is short by its cap.
    """
    spent = 0
    for c in candidates:
        if spent + cost(c) > most_calls:
            break
        spent += cost(c)
        if (result := attempt(c)) is not None:
            return c, result
    return None, None


def stage_seconds(timings: DataFrame) -> DataFrame:
    """Seconds by stage of runs; timings: (stage, seconds)."""
    return timings.groupBy("stage").agg(F.sum("seconds").alias("seconds"), F.count("*").alias("runs"))
