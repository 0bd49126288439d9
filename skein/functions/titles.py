"""Headlines: folded letters, names, story types and the story match, on built-in expressions."""

from __future__ import annotations

import re
import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import text as X
from skein.functions import udfs

# Letters that have no decomposition.
LETTERS = {
    "ø": "o", "Ø": "O", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ß": "ss", "đ": "d", "Đ": "D",
    "ð": "d", "Ð": "D", "þ": "th", "Þ": "TH", "ł": "l", "Ł": "L", "ı": "i", "İ": "I",
}

# Capitalised in headlines, yet naming nothing.
GENERIC = [
    "sold", "sell", "sells", "selling", "sales", "sale", "copies", "copy", "units", "unit", "million", "billion", "thousand",
    "new", "update", "updates", "review", "reviews", "reviewed", "announce", "announced", "announces", "announcement",
    "launch", "launched", "launches", "release", "released", "releases", "delay", "delayed", "delays", "postpone", "postponed",
    "postpones", "reveal", "revealed", "reveals", "confirm", "confirmed", "confirms", "report", "reports", "reported",
    "reportedly", "details", "detail", "date", "dates", "price", "prices", "trailer", "trailers", "gameplay", "demo", "beta",
    "patch", "patches", "players", "player", "revenue", "generated", "generates", "coming", "gets", "got", "make", "makes",
    "made", "tops", "top", "faster", "than", "any", "more", "most", "best", "first", "series", "entry", "previous", "days",
    "day", "month", "months", "week", "weeks", "hour", "hours", "one", "two", "three", "the", "a", "an", "of", "and", "or",
    "but", "for", "to", "on", "in", "at", "is", "are", "was", "were", "has", "have", "had", "this", "that", "with", "as",
    "its", "it", "from", "after", "before",
]
CONNECTORS = ["of", "the", "and", "a", "an", "vs", "for", "de"]
# Markers of story types.
TYPE_MARKERS = {
    "sales": ["sold", "sell", "sells", "selling", "sales", "sale", "copies", "copy", "units", "revenue", "grossed", "tops", "million", "billion", "bestseller"],
    "review": ["review", "reviews", "reviewed", "verdict", "hands-on", "hands", "preview"],
    "delay": ["delay", "delayed", "delays", "postpone", "postponed", "postpones"],
}
# Names that many stories share.
INCIDENTAL = [
    "xbox game pass", "game pass", "playstation plus", "ps plus", "nintendo switch online", "playstation blog", "xbox wire",
    "nintendo", "xbox", "playstation", "steam", "geforce now", "playstation store", "xbox store", "nintendo eshop", "nvidia",
    "amd", "intel", "playstation network", "xbox live", "pc", "switch", "steam deck", "epic games store",
]

#: Letters of ASCII fold to themselves.
_BEYOND_ASCII = re.compile(r"[^\x00-\x7F]+")
#: Letters up to this code point are folded by rule.
_FOLDED_TO = 0x2500


@cache
def _fold_rule() -> tuple[str, str, str]:
    """Letters that decompose into one base letter, these bases, and a pattern of combining marks."""
    letters = {chr(c): [x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x)] for c in range(0x80, _FOLDED_TO)}
    pairs = {a: b[0] for a, b in letters.items() if len(b) == 1 and b[0] != a} | {a: b for a, b in LETTERS.items() if len(b) == 1}
    marks = "".join(a for a, b in letters.items() if not b)
    return "".join(pairs), "".join(pairs.values()), "[" + marks + "]"


@cache
def _fold_table() -> dict[int, str | None]:
    given, bases, marks = _fold_rule()
    return {**dict.fromkeys(map(ord, marks[1:-1])), **dict(zip(map(ord, given), bases, strict=True)), **{ord(k): v for k, v in LETTERS.items()}}


def folded(text: str) -> str:
    """fold() of a plain string, for functions that walk texts."""
    return _BEYOND_ASCII.sub(lambda m: m[0].translate(_fold_table()), text)


def fold(text: Column) -> Column:
    """Letters without accents, special letters as their closest ASCII."""
    given, bases, marks = _fold_rule()
    out = text
    for letter, plain in LETTERS.items():
        if len(plain) > 1:
            out = F.replace(out, F.lit(letter), F.lit(plain))
    out = F.regexp_replace(F.translate(out, given, bases), marks, "")
    return F.when(F.octet_length(text) == F.char_length(text), text).otherwise(out)


def similarity(a: Column, b: Column) -> Column:
    """Matching-block ratio of two texts in matching form; depends on their order."""
    return udfs.ratio(X.match_normalize(a, fold), X.match_normalize(F.coalesce(b, F.lit("")), fold))


# Patterns of a word, of sums of money, of a figure.
_WORD = r"[\p{L}\p{N}]+(?:['’-][\p{L}\p{N}]+)*"
_MONEY = r"\$\s?\d|(?i)\b\d[\d,]*(?:\.\d+)?\s*[mbk]\b"
_FIGURE = r"(?U)(?<![\w.])(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?(?:(?:st|nd|rd|th)\b|(?:k|m|mn|bn)\b|\s?(?:thousand|million|billion)\b)?"

# Words of a headline are marked N (may name), D (digits), C (connects) or G (generic
# or plain).  A name is a run of N and D that N opens, connectors within.
_NAME = r"N:\S+(?:(?: C:\S+)* [ND]:\S+)*"


def _marked(title: Column) -> Column:
    def mark(word: Column) -> Column:
        low = F.lower(fold(word))
        kind = (
            F.when(low.isin(CONNECTORS), F.concat(F.lit("C:"), low))
            .when(low.isin(GENERIC), F.concat(F.lit("G:"), low))
            .when(word.rlike(r"^\p{Nd}+$"), F.concat(F.lit("D:"), word))
            .when(word.rlike(r"\p{Lu}"), F.concat(F.lit("N:"), F.lower(word)))
        )
        return F.coalesce(kind, F.lit("G:"))

    return F.array_join(F.transform(F.regexp_extract_all(title, F.lit(_WORD), 0), mark), " ")


def names(title: Column, leading: bool = False) -> Column:
    """Names in a headline, in order; a single word that opens it is left out unless `leading`."""
    runs = F.transform(F.regexp_extract_all(_marked(title), F.lit(_NAME), 0), lambda r: F.regexp_replace(r, r"\b[NDC]:", ""))
    found = F.array_distinct(F.filter(runs, lambda r: r.rlike(r"\p{L}")))
    if leading:
        return found
    opener = F.lower(fold(F.regexp_extract(title, _WORD, 0)))
    return F.filter(found, lambda n: F.contains(n, F.lit(" ")) | (n != opener))


def form(title: Column) -> Column:
    """Folded, lower case, single spaces."""
    return X.normalize_title(title, fold)


def story_type(title: Column) -> Column:
    """sales, review or delay by the first marker; sums of money mean sales; else announcement."""

    def kind(word: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, markers in TYPE_MARKERS.items():
            out = F.when(word.isin(markers), F.lit(name)).otherwise(out)
        return out

    marks = F.array_compact(F.transform(F.split(form(title), " "), kind))
    return F.when(title.rlike(_MONEY), "sales").otherwise(F.coalesce(F.get(marks, F.lit(0)), F.lit("announcement")))


def event_words(title: Column) -> Column:
    """What happened: words that are neither generic nor part of a name, single letters aside."""
    named = F.flatten(F.transform(names(title, True), lambda n: F.split(form(n), " ")))
    rest = F.filter(F.split(form(title), " "), lambda w: ~w.isin(GENERIC) & ~w.rlike("^[a-z]?$"))
    return F.array_except(rest, named)


# ---- the story match --------------------------------------------------------


def _padded(name: Column) -> Column:
    return F.concat(F.lit(" "), X.match_normalize(name, fold), F.lit(" "))


def features(rows: DataFrame, title: str) -> DataFrame:
    """rows with what the story match looks at, computed once a headline."""
    t = F.col(title)
    got = rows.withColumn("names", names(t)).withColumn("first", F.get(names(t, True), F.lit(0)))
    return got.withColumns(
        {
            "form": form(t),
            "plain": X.match_normalize(t, fold),
            "names": F.transform("names", lambda n: F.struct(n.alias("name"), _padded(n).alias("form"))),
            "first": F.coalesce(_padded(F.col("first")), F.lit("")),
            "type": story_type(t),
            "events": event_words(t),
        }
    )


FEATURES = ["form", "plain", "names", "first", "type", "events"]


def shared_names(a: Column, b: Column) -> Column:
    """Names (name, form) in common; where one holds the other, the shorter."""
    within = lambda x, y: (x["form"] != "  ") & F.contains(y["form"], x["form"])
    meet = lambda x, y: F.when((x["name"] == y["name"]) | within(x, y), x).when(within(y, x), y)
    return F.array_distinct(F.array_compact(F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: meet(x, y))))))


def same_story(pairs: DataFrame, a: str, b: str, threshold: float = 0.6, floor: float = 0.3, rewrite: float = 0.85, words: int = 1) -> DataFrame:
    """Pairs whose headlines tell one story; a and b: prefixes of their features.

    Equal headlines do.  Others must share a name and, unless they are nearly
    one text, their type; and be like texts, or share two names and be somewhat
    like, or both open with a shared name of several words and tell of one event.
    The texts are compared only where their lengths allow a decision by that.
    """
    of = lambda side, name: F.col(f"{side}{name}")
    common = shared_names(of(a, "names"), of(b, "names"))
    opens = lambda e: (
        F.contains(e["name"], F.lit(" ")) & ~e["name"].isin(INCIDENTAL) & (e["form"] != "  ") & F.contains(of(a, "first"), e["form"]) & F.contains(of(b, "first"), e["form"])
    )
    one_event = ((of(a, "type") == of(b, "type")) & of(a, "type").isin(list(TYPE_MARKERS))) | (F.size(F.array_intersect(of(a, "events"), of(b, "events"))) >= words)
    equal = (of(a, "form") != "") & (of(a, "form") == of(b, "form"))

    def told(score: Column) -> Column:
        like = (score >= threshold) | ((F.col("__shared") >= 2) & (score >= floor)) | F.col("__subject")
        return F.col("__equal") | ((F.col("__shared") > 0) & ((of(a, "type") == of(b, "type")) | (score >= rewrite)) & like)

    n, m = F.length(of(a, "plain")), F.length(of(b, "plain"))
    most = F.when((n > 0) & (m > 0), 2 * F.least(n, m) / (n + m)).otherwise(0.0)
    marked = pairs.withColumn("__equal", equal).withColumn("__common", common)
    marked = marked.withColumn("__shared", F.size("__common")).withColumn("__subject", F.exists("__common", opens) & one_event)
    able = marked.where(told(most)).withColumn("__score", udfs.ratio(of(a, "plain"), of(b, "plain")))
    return able.where(told(F.col("__score"))).drop("__equal", "__common", "__shared", "__subject", "__score")


# ---- figures ----------------------------------------------------------------

# How many zeros a word or letter after a figure stands for.
SCALES = {"k": 3, "thousand": 3, "m": 6, "mn": 6, "million": 6, "bn": 9, "billion": 9}
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
MONTH_WORDS = sorted({m[:3] for m in MONTHS} | {"sept"} | set(MONTHS))


def figure(written: Column) -> Column:
    """A written figure as plain digits: "4m", "4 million" and "4,000,000" are one."""
    number, unit = F.regexp_extract(written, r"^[\d,]+(?:\.\d+)?", 0), F.regexp_extract(written, "(?:" + "|".join(SCALES) + ")$", 0)
    zeros = F.lit(0)
    for name, n in SCALES.items():
        zeros = F.when(unit == name, F.lit(n)).otherwise(zeros)
    whole = F.replace(F.substring_index(number, ".", 1), F.lit(","), F.lit(""))
    part = F.regexp_extract(number, r"\.(\d+)$", 1)
    whole = F.concat(whole, F.rpad(F.substring(part, F.lit(1), zeros), zeros, F.lit("0")))
    part = F.regexp_replace(F.substring(part, zeros + 1, F.length(part)), "0+$", "")
    whole = F.regexp_replace(whole, r"^0+(?=\d)", "")
    return F.when(part == "", whole).otherwise(F.concat(whole, F.lit("."), part))


def figures(text: Column) -> Column:
    """Distinct figures with their scale, and month names, sorted."""
    low = F.lower(text)
    written = F.transform(F.regexp_extract_all(low, F.lit(_FIGURE), 0), figure)
    return F.array_sort(F.array_distinct(F.concat(written, F.filter(F.regexp_extract_all(low, F.lit("[a-z]+"), 0), lambda w: w.isin(MONTH_WORDS)))))


# ---- phrases of a story -----------------------------------------------------

# Words within a phrase, words between phrases, and names of roles, which end one.
GLUE = ["of", "the", "a", "an", "vs", "de"]
BREAKS = ["for", "in", "on", "with", "and"]
ROLES = [
    "ceo", "cto", "coo", "cfo", "cio", "cro", "president", "founder", "co-founder", "cofounder", "director", "producer", "executive",
    "editor", "chairman", "chairwoman", "chair", "chief", "head", "boss", "lead", "manager", "spokesperson", "spokesman", "spokeswoman",
    "representative", "analyst", "reporter", "journalist", "author", "writer", "general", "owner", "creator", "designer", "developer",
    "vp", "svp", "evp",
]
UMBRELLA = ["xbox", "playstation", "nintendo", "pc", "nvidia", "amd", "intel", "microsoft", "sony", "steam", "google"]
_PHRASE = r"N:\S+(?:(?: [LI]:\S+)* [ND]:\S+)*"


def _low(word: Column) -> Column:
    return F.lower(fold(word))


def story_phrases(title: Column, generic: list[str], known: list[str] = (), stop: list[str] = (), verbs: list[str] = ()) -> Column:
    """Full names in a headline, in order and as written.

    Glue words and an inner colon stay within a name; commas, dashes, breaking
    words, roles and `verbs` end it.  Generic words at its end become names of
    their own.  A lone word that opens a sentence is no name unless it is known,
    an acronym, or capitalised twice.
    """

    def mark(token: Column) -> Column:
        low = _low(token)
        bare = F.regexp_replace(token, "['’][sS]$", "")
        return F.coalesce(
            F.when(token == ":", "I::")
            .when(token.isin(",", "-", "–", "—") | low.isin(BREAKS), "B:")
            .when(low.isin(GLUE), F.concat(F.lit("L:"), low))
            .when(low.isin([*GENERIC, *ROLES, *verbs]), "B:")
            .when(token.rlike(r"^\p{Nd}+$"), F.concat(F.lit("D:"), token))
            .when(token.rlike(r"\p{Lu}"), F.concat(F.lit("N:"), bare)),
            F.lit("B:"),
        )

    tokens = F.regexp_extract_all(title, F.lit(_WORD + "|[:,–—-]"), 0)
    runs = F.regexp_extract_all(F.array_join(F.transform(tokens, mark), " "), F.lit(_PHRASE), 0)
    runs = F.transform(runs, lambda r: F.regexp_replace(F.regexp_replace(r, " I::", ":"), r"\b[NDL]:", ""))
    ends = lambda w: _low(w).isin([*generic, *stop])

    def peeled(run: Column) -> Column:
        words = F.split(run, " ")
        kept = F.coalesce(F.array_max(F.transform(words, lambda w, i: F.when(~ends(w), i + 1))), F.lit(0))
        head = F.when(kept > 0, F.array(F.array_join(F.slice(words, 1, kept), " "))).otherwise(F.array().cast("array<string>"))
        return F.concat(head, F.slice(words, kept + 1, F.size(words)))

    openers = F.transform(F.split(title, r"[.!?]+|[\"“”]"), lambda s: _low(F.regexp_extract(s, _WORD, 0)))
    capital = F.transform(F.filter(F.regexp_extract_all(title, F.lit(_WORD), 0), lambda w: w.rlike(r"^\p{Lu}")), _low)

    def names_it(phrase: Column) -> Column:
        low = _low(phrase)
        alone = ~F.contains(phrase, F.lit(" ")) & F.array_contains(openers, low)
        saved = low.isin(list(known)) | phrase.rlike(r"^[^\p{Ll}]*\p{Lu}[^\p{Ll}]*\p{Lu}[^\p{Ll}]*$") | (F.size(F.filter(capital, lambda w: w == low)) > 1)
        return phrase.rlike(r"\p{L}") & ~low.isin(list(stop)) & (~alone | saved)

    return F.array_distinct(F.filter(F.flatten(F.transform(runs, peeled)), names_it))


def sub_entities(name: Column, known: list[str] = ()) -> Column:
    """A name in lower case, its parts between breaks, and known names within; known names stay whole."""
    display = F.lower(F.trim(F.regexp_replace(name, r"\s+", " ")))
    base = form(name)
    parts = F.split(F.regexp_replace(name, rf"(?i)[:,–—]|(?<=\s)-(?=\s)|\b(?:{'|'.join(BREAKS)})\b", "\n"), "\n")
    parts = F.filter(F.transform(parts, lambda p: F.trim(F.regexp_replace(F.lower(fold(p)), r"[^a-z0-9]+", " "))), lambda p: (p != base) & p.rlike("[a-z]"))
    within = F.filter(F.array(*[F.lit(n) for n in sorted(known, key=lambda n: (-len(n), n))]).cast("array<string>"), lambda n: X.contains_phrase(base, n))
    return F.when(base.isin(list(known)), F.array(display)).otherwise(F.array_distinct(F.concat(F.array(display), parts, within)))


def primary_entities(title: Column, generic: list[str], known: list[str] = (), **lists) -> Column:
    """What a story is about: all names and their parts but generic ones."""
    found = F.flatten(F.transform(story_phrases(title, generic, known, **lists), lambda p: sub_entities(p, known)))
    return F.filter(F.array_distinct(found), lambda e: ~e.isin(list(generic)))


def lead_entity(entities: Column, umbrella: list[str] = UMBRELLA) -> Column:
    """The first entity that is no umbrella name, else the first; empty without any."""
    own = F.filter(entities, lambda e: ~e.isin(umbrella))
    return F.coalesce(F.get(own, F.lit(0)), F.get(entities, F.lit(0)), F.lit(""))
