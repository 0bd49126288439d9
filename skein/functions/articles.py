"""Row functions over whole articles: rewriting, linking, folding, repairing.

Each takes and gives plain values; udfs.each() or a grouped operator runs them
over Arrow batches.  They walk an article in order, so they stay imperative.
"""

from __future__ import annotations

import datetime as dt
import json
import re

from skein.functions.titles import MONTHS, folded

_FENCE = re.compile(r"^\s*```")
_HEAD = re.compile(r"^\s{0,3}(#{1,6})\s+(.+?)\s*$")
_SPLIT = re.compile(r"(?<=[.!?])\s+|\n+")
_APOSTROPHE = re.compile(r"'s\b|s'(?![a-z0-9])|'")
_APOSTROPHES = re.compile("['’ʼ‘]")
_PLAIN = re.compile(r"[a-z0-9]+")
_QUOTES = str.maketrans("’ʼ‘", "'''")


def matching_form(text: str) -> str:
    """Folded, lower case, no possessives or apostrophes, words apart by one space: text.match_normalize() of a string."""
    bare = folded(text).lower()
    if not bare.isascii():
        bare = bare.translate(_QUOTES)
    if "'" in bare:
        bare = _APOSTROPHE.sub("", bare)
    return " ".join(_PLAIN.findall(bare))


def contains_name(text: str, name: str) -> bool:
    held, wanted = (f" {matching_form(x)} " for x in (text, name))
    return bool(wanted.strip()) and wanted in held


def plain_sentences(text: str) -> list[str]:
    return [s for s in (x.strip() for x in _SPLIT.split(re.sub(r"(?s)```.*?```", "", text))) if s]


def count_words(text: str) -> int:
    return len(re.sub(r"(?m)[*_`~#>]+|^\s*[-+]\s+", " ", text).split())


# ---- sections ---------------------------------------------------------------


def cut_sections(body: str) -> tuple[list[str], list[tuple[str, list[str]]]]:
    """Lines before the first ## heading, then (heading line, lines) of each section."""
    preface: list[str] = []
    parts: list[tuple[str, list[str]]] = []
    fenced = False
    for line in body.splitlines():
        fenced ^= bool(_FENCE.match(line))
        m = None if fenced else _HEAD.match(line)
        if m and len(m[1]) == 2:
            parts.append((line, []))
        else:
            (parts[-1][1] if parts else preface).append(line)
    return preface, parts


def fold_thin(body: str, min_sentences: int = 2, min_words: int = 40) -> str:
    """Thin ## sections merged into a neighbour until none is thin.

    Two thin ones in a row become one under the first heading; another joins
    the section before it; a first one becomes introduction.
    """
    preface, parts = cut_sections(body)
    thin = lambda lines: len(plain_sentences("\n".join(lines))) < min_sentences or count_words("\n".join(lines)) < min_words
    trim = lambda lines: "\n".join(lines).strip("\n").split("\n") if any(x.strip() for x in lines) else []

    def joined(a: list[str], b: list[str]) -> list[str]:
        a, b = trim(a), trim(b)
        return a + [""] * bool(a and b) + b

    changed = False
    while (at := next((i for i, (_, lines) in enumerate(parts) if thin(lines)), None)) is not None:
        changed = True
        head, lines = parts[at]
        if at + 1 < len(parts) and thin(parts[at + 1][1]):
            parts[at : at + 2] = [(head, joined(lines, parts[at + 1][1]))]
        elif at:
            parts[at - 1 : at + 1] = [(parts[at - 1][0], joined(parts[at - 1][1], lines))]
        else:
            preface, parts = joined(preface, lines), parts[1:]
    if not changed:
        return body
    blocks = ["\n".join(trim(preface))] + ["\n".join([head, "", *trim(lines)]) for head, lines in parts]
    return "\n\n".join(b for b in blocks if b) + "\n"


# ---- links ------------------------------------------------------------------


def link_terms(body: str, targets: list[dict], most: int = 5) -> str:
    """Link first mentions of terms, the longest terms first, `most` in all.

    targets: {term, url}.  A term and a url are used once; headings, fences,
    existing links and the sources section stay as they are.
    """
    todo = sorted(targets, key=lambda t: -len(t["term"]))
    used: set[str] = set()
    out, fenced, sources, n = [], False, False, 0
    for line in body.split("\n"):
        if _FENCE.match(line):
            fenced = not fenced
        head = _HEAD.match(line)
        if head and not fenced:
            sources = head[2].strip().lower() == "sources"
        if not (fenced or head or sources or _FENCE.match(line)):
            for t in todo:
                if n >= most:
                    break
                if t["term"].lower() in used or t["url"] in used:
                    continue
                taken = [m.span() for m in re.finditer(r"\[[^\]]*\]\([^)]*\)|https?://\S+", line)]
                form = rf"(?i)(?<![\w-]){re.escape(t['term'])}(?![\w-])"
                hit = next((m for m in re.finditer(form, line) if not any(a < m.end() and m.start() < b for a, b in taken)), None)
                if hit:
                    line = f"{line[: hit.start()]}[{hit[0]}]({t['url']}){line[hit.end() :]}"
                    used |= {t["term"].lower(), t["url"]}
                    n += 1
        out.append(line)
    return "\n".join(out)


def canonical_text(text: str, aliases: dict[str, str]) -> str:
    """Aliases as their canonical names, in one pass, the longest first.

    Canonical names match themselves, so an alias within one stays.
    """
    table = {a.lower(): c for a, c in aliases.items()} | {c.lower(): c for c in aliases.values()}
    forms = sorted(table, key=len, reverse=True)
    if not forms:
        return text
    return re.sub(rf"(?i)\b(?:{'|'.join(map(re.escape, forms))})\b", lambda m: table[m[0].lower()], text)


def mask_names(text: str, names: list[str], sign: str = " ") -> str:
    """A text without product names, whose numbers are no figures."""
    forms = sorted((n for n in names if n), key=len, reverse=True)
    return re.sub(rf"(?i)\b(?:{'|'.join(map(re.escape, forms))})\b", sign, text) if forms else text


# ---- attribution ------------------------------------------------------------

# Cues of attribution.
LEADS = ["according to", "data from", "citing", "per", "via"]
SPEECH = ["said", "says", "told", "wrote", "writes", "stated", "explained", "added", "noted", "denied"]
ANNOUNCE = ["announced", "announces", "revealed", "reveals", "confirmed", "confirms", "unveiled", "reported", "reports"]


def circular(body: str) -> list[str]:
    """Sentences in which a name says something of itself: "Roe said that Roe ..."."""
    out = []
    for s in plain_sentences(body):
        for m in re.finditer(rf"((?:\b[A-ZÀ-Þ][\w'’.-]*\s+)+)(?:{'|'.join(SPEECH + ANNOUNCE)})\s+that\s+", s):
            name = [matching_form(w) for w in m[1].split()]
            if [matching_form(w) for w in s[m.end() :].split()[: len(name)]] == name:
                out.append(s)
                break
    return out


def attribution_span(sentence: str, names: list[str], gap: int = 12) -> str:
    """The shortest stretch with a name and the nearest cue, the longest name first.

    Words in parentheses and between commas do not count for the gap; a cue
    after the name wins a tie.
    """
    words = list(re.finditer(r"[\w']+", sentence))
    low = [folded(w[0]).lower() for w in words]
    asides = [m.span() for m in re.finditer(r"\([^()]*\)", sentence)]
    commas = [m.start() for m in re.finditer(",", sentence)]
    asides += list(zip(commas, commas[1:], strict=False))
    counted = [not any(a < w.start() and w.end() <= b for a, b in asides) for w in words]

    def places(phrase: str) -> list[tuple[int, int]]:
        parts = phrase.split()
        return [(i, i + len(parts)) for i in range(len(low) - len(parts) + 1) if parts and low[i : i + len(parts)] == parts]

    cues = [p for c in LEADS + SPEECH + ANNOUNCE for p in places(c)]
    for name in sorted(names, key=len, reverse=True):
        found = []
        for a, b in places(folded(name).lower()):
            for c, d in cues:
                between = range(b, c) if c >= b else range(d, a)
                found.append((sum(counted[i] for i in between), c < b, min(a, c), max(b, d)))
        near = min((f for f in found if f[0] <= gap), default=None)
        if near:
            return sentence[words[near[2]].start() : words[near[3] - 1].end()].rstrip(" .,;:!?")
    return ""


def cue_sources(text: str) -> list[dict]:
    """Names that the text credits: {origin, kind, pos}, in order.

    lead: a cue before the name; subject: a name before a verb; inverted: a
    verb before a capitalised name.
    """
    name = r"((?:[A-ZÀ-Þ][\w'’&.-]*)(?:\s+[A-ZÀ-Þ][\w'’&.-]*){0,3})"
    verbs = "|".join(SPEECH + ANNOUNCE)
    forms = [
        ("lead", rf"\b(?:{'|'.join(LEADS)})\s+(?:[a-z]+\s+){{0,4}}{name}"),
        ("lead", rf"\b(?:{'|'.join(x.capitalize() for x in LEADS)})\s+(?:[a-z]+\s+){{0,4}}{name}"),
        ("subject", rf"{name}(?:,[^,.]{{1,60}},)?\s+(?:has\s+|have\s+|had\s+|also\s+)?(?:{verbs})\b"),
        ("inverted", rf"\b(?:{verbs})\s+{name}"),
    ]
    out = {}
    for kind, form in forms:
        for m in re.finditer(form, text):
            out.setdefault(m.start(1), {"origin": re.sub(r"['’]s$", "", m[1].rstrip(".,")), "kind": kind, "pos": m.start(1)})
    return [out[p] for p in sorted(out)]


def evidence_reason(quote: str, attribution: str, speakers: list[str], source: str, outlet: str = "", title: str = "") -> str | None:
    """Why a claim's evidence fails, by the first rule that it breaks; null if it holds."""
    body = matching_form(source)
    cue = [c for c in LEADS + SPEECH + ANNOUNCE if contains_name(attribution, c)]
    named = [s for s in speakers if contains_name(attribution, s)]
    anonymous = all(re.fullmatch(r"(?i)(?:(?:an?|the|unnamed|anonymous|several|sources?|insiders?|people|familiar|with|matter)\s*)+", s) for s in speakers)
    rules = [
        ("quote missing", not quote.strip()),
        ("quote not found", matching_form(quote) not in body),
        ("anonymous", bool(speakers) and anonymous),
        ("cites itself", bool(outlet) and any(matching_form(s) == matching_form(outlet) for s in speakers)),
        ("no named speaker", not speakers or not named),
        ("no cue", not cue),
        ("attribution not found", matching_form(attribution) not in body),
        ("speaker not grounded", not any(contains_name(source, s) or contains_name(title, s) for s in speakers)),
    ]
    return next((why for why, bad in rules if bad), None)


def spoken_clause(value: str, speakers: list[str]) -> str:
    """Of two halves around "but", the one that a speaker is credited with, if only one is."""
    halves = re.split(r",?\s+but\s+", value)
    if len(halves) != 2:
        return value
    said = [any(contains_name(h, s) for s in speakers) for h in halves]
    cued = [any(contains_name(h, c) for c in LEADS + SPEECH + ANNOUNCE) for h in halves]
    for i in (0, 1):
        if said[i] and cued[i] and not said[1 - i]:
            return halves[i].strip()
    return value


# ---- repair -----------------------------------------------------------------


def drop_flagged(body: str, flagged: list[str], share: float = 1 / 3) -> str:
    """A body without flagged sentences and those that lean on them.

    The first sentence stays, and nothing goes if more than `share` would.
    """
    marks = [matching_form(f) for f in flagged if matching_form(f)]
    longest = [max(m.split(" "), key=len) for m in marks]

    def hit(s: str) -> bool:
        low = folded(s).lower()  # without apostrophes, words stand here as in the matching form
        if not _APOSTROPHES.search(low) and not any(w in low for w in longest):
            return False
        return any(m in matching_form(s) for m in marks)

    total = gone = 0
    lines = []
    for line in body.split("\n"):
        if _HEAD.match(line) or not line.strip():
            lines.append(line)
            continue
        kept, dropped = [], False
        for s in re.split(r"(?<=[.!?])\s+", line):
            dropped = total > 0 and (hit(s) or (dropped and bool(re.match(r"(?:It|That|This|They|These|He|She)\b", s))))
            total += 1
            gone += dropped
            if not dropped:
                kept.append(s)
        if kept:
            lines.append(" ".join(kept))
    if total and gone > total * share:
        return body
    out: list[str] = []
    for line in lines:  # a heading without text goes, too
        if _HEAD.match(line):
            while out and (not out[-1].strip() or (_HEAD.match(out[-1]) and len(_HEAD.match(out[-1])[1]) >= len(_HEAD.match(line)[1]))):
                out.pop()
            if out:
                out.append("")
        out.append(line)
    while out and (not out[-1].strip() or _HEAD.match(out[-1])):
        out.pop()
    return "\n".join(out)


def repair_problem(before: str, after: str, flagged: list[str], growth: int = 40) -> str | None:
    """Why a repair is no repair: an unflagged sentence changed or moved, or too much was added."""
    marks = [matching_form(f) for f in flagged if matching_form(f)]
    keep = [matching_form(s) for s in plain_sentences(before) if not any(m in matching_form(s) for m in marks)]
    rest = iter(matching_form(s) for s in plain_sentences(after))
    if not all(any(k == r for r in rest) for k in keep):
        return "an unflagged sentence changed"
    if count_words(after) - count_words(before) > growth:
        return "too much added"
    return None


# ---- time -------------------------------------------------------------------


def absolute_time(value: str, published: dt.date | None, kind: str | None = None) -> str | None:
    """today, yesterday, tomorrow, now, currently and "out now" as dates.

    Null where there is no date to count from, or where "by now" and the like
    leave it open.  After a form of "to be", and in statements, present words
    go; a date after a preposition gets no second one.
    """
    if re.search(r"(?i)\b(?:by|until|till|up to)\s+now\b", value):
        return None
    text = re.sub(r"(?i)\bnow and then\b", "at times", value)
    text = re.sub(r"(?i)\s*\b(?:for now|from now on|right now)\b", "", text)
    form = re.compile(r"(?i)(?<!\w)(?:out now|yesterday|today|tomorrow|now|currently)(?!\w)")
    if not form.search(text):
        return text
    if published is None:
        return None
    say = lambda d: f"{MONTHS[d.month - 1].capitalize()} {d.day}, {d.year}"
    tail = ""

    def put(m: re.Match) -> str:
        nonlocal tail
        word, before = m[0].lower(), text[: m.start()].rstrip().lower()
        if word == "out now":
            tail = f" as of {say(published)}"
            return "available"
        if word in ("today", "now", "currently") and (kind == "statement" or re.search(r"\b(?:is|are|was|were|be|been|being)$", before)):
            return ""
        if word in ("now", "currently"):
            return f"as of {say(published)}"
        day = published + dt.timedelta(days={"yesterday": -1, "tomorrow": 1}.get(word, 0))
        return say(day) if re.search(r"\b(?:on|from|since|until|by|before|after|of)$", before) else f"on {say(day)}"

    out = re.sub(r"\s+([,.;:!?])", r"\1", re.sub(r"\s+", " ", form.sub(put, text)).strip())
    return out + tail if not out.endswith(".") or not tail else out[:-1] + tail + "."


def dates_of(text: str) -> list[dict]:
    """{year, month, day} of ISO dates and of month names with a day; the year may be missing."""
    month = "|".join(MONTHS)
    forms = rf"(?i)\b(?P<y>\d{{4}})-(?P<m>\d{{2}})-(?P<d>\d{{2}})\b|\b(?P<mn>{month})\s+(?P<md>\d{{1,2}})(?:st|nd|rd|th)?\b(?:,?\s+(?P<my>\d{{4}}))?|\b(?P<dd>\d{{1,2}})(?:st|nd|rd|th)?\s+(?P<dn>{month})\b(?:,?\s+(?P<dy>\d{{4}}))?"
    out = []
    for m in re.finditer(forms, text):
        g = m.groupdict()
        name = g["mn"] or g["dn"]
        number = MONTHS.index(name.lower()) + 1 if name else int(g["m"])
        year = g["y"] or g["my"] or g["dy"]
        out.append({"year": int(year) if year else None, "month": number, "day": int(g["d"] or g["md"] or g["dd"])})
    return out


# ---- JSON -------------------------------------------------------------------


def bare_json(text: str) -> str:
    """JSON without the code fence that it came in."""
    return re.sub(r"(?s)^\s*```(?:json)?\s*(.*?)\s*```\s*$", r"\1", text).strip()


def schema_problems(text: str, schema: str) -> list[str]:
    """All violations of a JSON schema: types, required, closed objects, items, enums, bounds."""
    kinds = {"object": dict, "array": list, "string": str, "boolean": bool, "number": (int, float), "integer": int, "null": type(None)}

    def look(value, rule: dict, path: str):
        names = rule.get("type")
        names = [names] if isinstance(names, str) else names
        if names and not any(isinstance(value, kinds[n]) and not (n in ("number", "integer") and isinstance(value, bool)) for n in names):
            yield f"{path}: not {' or '.join(names)}"
            return
        if "enum" in rule and value not in rule["enum"]:
            yield f"{path}: not one of {rule['enum']}"
        if isinstance(value, (int, float)) and not isinstance(value, bool):
            if value < rule.get("minimum", value):
                yield f"{path}: under {rule['minimum']}"
            if value > rule.get("maximum", value):
                yield f"{path}: over {rule['maximum']}"
        if isinstance(value, dict):
            own = rule.get("properties", {})
            yield from (f"{path}.{k}: missing" for k in rule.get("required", []) if k not in value)
            for k, v in value.items():
                if k in own:
                    yield from look(v, own[k], f"{path}.{k}")
                elif rule.get("additionalProperties") is False:
                    yield f"{path}.{k}: unknown"
        if isinstance(value, list) and "items" in rule:
            for i, v in enumerate(value):
                yield from look(v, rule["items"], f"{path}[{i}]")

    try:
        value = json.loads(bare_json(text))
    except ValueError:
        return ["$: not JSON"]
    return list(look(value, json.loads(schema), "$"))
