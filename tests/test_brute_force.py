"""Queries without SQL, each against a plain Python answer over whole tables."""

import difflib
import html.parser
import re
import unicodedata
from collections import Counter, defaultdict
from decimal import Decimal
from itertools import groupby

import pytest

from skein.functions import articles, titles
from skein.functions.udfs import ABBREVIATIONS, BLOCKS
from skein.plans import registry


@pytest.fixture(scope="module")
def rows(duck):
    return lambda table: [dict(zip(c, r, strict=True)) for t in [duck.sql(f"SELECT * FROM {table}")] for c in [t.columns] for r in t.fetchall()]


@pytest.fixture(scope="module")
def got(spark, sf_dir):
    def run(name):
        df = registry.queries()[name](spark, sf_dir)
        return [tuple(r) for r in df.select(*sorted(df.columns)).collect()]

    return run


def same(got, want):
    """Both as multisets; want: tuples in the order of sorted column names."""
    assert got and Counter(got) == Counter(want)


def bare(text):
    """Folded by decomposition."""
    return "".join(c for x in text for c in unicodedata.normalize("NFKD", titles.LETTERS.get(x, x)) if not unicodedata.combining(c))


def form(title):
    return " ".join(re.sub(r"[^a-z0-9]", " ", bare(title).lower()).split())


def match_form(text):
    t = re.sub(r"'s\b", "", re.sub("[’ʼ‘]", "'", bare(text).lower()))
    return " ".join(re.findall("[a-z0-9]+", re.sub(r"s'(?![a-z0-9])", "", t).replace("'", "")))


def names(title, leading=False):
    words = re.findall(r"[^\W_]+(?:['’-][^\W_]+)*", title)

    def kind(w):
        low = bare(w).lower()
        return "c" if low in titles.CONNECTORS else "g" if low in titles.GENERIC else "d" if w.isdigit() else "n" if w != w.lower() else "g"

    marks = "".join(map(kind, words))
    found = []
    for m in re.finditer("n(?:c*[nd])*", marks):
        part = [bare(w).lower() if k == "c" else w.lower() for w, k in zip(words[m.start() : m.end()], m[0], strict=True)]
        if len(part) > 1 or leading or part[0] != bare(words[0]).lower():
            found.append(" ".join(part))
    return list(dict.fromkeys(found))


def story_type(title):
    if re.search(r"\$\s?\d|(?i:\b\d[\d,]*(?:\.\d+)?\s*[mbk]\b)", title):
        return "sales"
    known = {m: t for t, ms in titles.TYPE_MARKERS.items() for m in ms}
    return next((known[w] for w in form(title).split() if w in known), "announcement")


def same_story(a, b):
    if form(a) and form(a) == form(b):
        return True
    holds = lambda x, y: bool(match_form(y)) and f" {match_form(y)} " in f" {match_form(x)} "
    common = {y if holds(x, y) else x for x in names(a) for y in names(b) if x == y or holds(x, y) or holds(y, x)}
    score = difflib.SequenceMatcher(None, match_form(a), match_form(b)).ratio()
    if not common or (story_type(a) != story_type(b) and score < 0.85):
        return False
    event = [{w for w in form(t).split() if w not in titles.GENERIC and not re.fullmatch("[a-z]", w)} - {w for n in names(t, True) for w in form(n).split()} for t in (a, b)]
    told = (story_type(a) == story_type(b) != "announcement") or event[0] & event[1]
    subject = any(" " in e and e not in titles.INCIDENTAL and holds(names(a, True)[0], e) and holds(names(b, True)[0], e) for e in common)
    return score >= 0.6 or (len(common) > 1 and score >= 0.3) or bool(subject and told)


def figures(text):
    out = {w for w in re.findall("[a-z]+", text.lower()) if w in titles.MONTH_WORDS}
    for number, unit in re.findall(r"(?<![\w.])((?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?)(?:(?:st|nd|rd|th)\b|(k|m|mn|bn)\b|\s?(?:thousand|million|billion)\b)?", text.lower()):
        zeros = titles.SCALES.get(unit, 0)
        for word in ("thousand", "million", "billion"):
            if re.search(rf"(?<![\w.]){re.escape(number)}\s?{word}\b", text.lower()) and not unit:
                zeros = titles.SCALES[word]
        whole = format(Decimal(number.replace(",", "")).scaleb(zeros), "f")
        out.add(whole.rstrip("0").rstrip(".") if "." in whole else whole.lstrip("0") or "0")
    return out


def claims(rows):
    return [
        {
            "story_id": r["l_orderkey"], "seq": r["l_linenumber"], "fact": r["l_partkey"] % 10, "source_url": f"https://s{r['l_suppkey']}",
            "claim": f"price {r['l_partkey']}", "value": ("about " if r["l_tax"] > 0.05 else "") + f"{int(r['l_quantity'])} units",
        }
        for r in rows("lineitem")
    ]


def test_preceding_names(rows, got):
    want = []
    for r in rows("conversations"):
        text = (r["text"] or "").lower()
        found = re.findall(r"(?<![\w-])(?:de la|the|with|de)(?![\w-])", text.split(" that ")[0]) if " that " in text else []
        want += [(r["conv_id"], found[-1], r["turn"])] if found else []
    same(got("preceding_names"), want)


def test_figure_tokens(rows, got):
    want = Counter(t for r in rows("documents") for t in figures(r["text"] or ""))
    same(got("figure_tokens"), [(n, t) for t, n in want.items()])


def test_entity_scanner(rows, got):
    same(got("entity_scanner"), [(r["doc_id"], n) for r in rows("documents") if r["text"] for n in names(r["text"].split("\n")[0])])


def test_sequence_similarity(rows, got):
    turns = {(r["conv_id"], r["turn"]): r["text"] or "" for r in rows("conversations")}
    want = []
    for (conv, turn), text in turns.items():
        if turn == 0 and (conv, 2) in turns:
            a, b = match_form(text), match_form(turns[conv, 2])
            want.append((conv, round(difflib.SequenceMatcher(None, a, b).ratio(), 6) if a and b else 0.0))
    same(got("sequence_similarity"), want)


def test_greedy_leader_cluster(rows, got):
    cap = lambda t: " ".join(w[:1].upper() + w[1:].lower() for w in t.split(" "))
    items = sorted(((-r["p_partkey"], f"{cap(r['p_name'])} {cap(r['p_type'])}") for r in rows("part")), key=lambda x: x[0])
    seeds, want, known = [], [], {}
    for key, title in items:
        tells = lambda t: known[title, t] if (title, t) in known else known.setdefault((title, t), same_story(title, t))  # noqa: B023, E731
        seed = next((k for k, t in seeds if tells(t)), None)
        if seed is None:
            seeds.append((seed := -key, title))
        want.append((-key, seed))
    same(got("greedy_leader_cluster"), want)


def test_greedy_claim_groups(rows, got):
    want = []
    for story, part in groupby(sorted(claims(rows), key=lambda c: c["story_id"]), key=lambda c: c["story_id"]):
        facts = []
        for c in sorted(part, key=lambda c: c["seq"]):
            like = lambda o, c=c: o["source_url"] != c["source_url"] and figures(o["value"]) == figures(c["value"])
            fact = next((f for f in facts if any(map(like, f)) and all(o["source_url"] != c["source_url"] for o in f)), None)
            if fact is None:
                facts.append(fact := [])
            fact.append(c)
            want.append((fact[0]["seq"], c["seq"], str(story)))
    found = got("greedy_claim_groups")
    # Lines of an order that share their number may come in either order.
    doubled = {k for k, n in Counter((s, q) for _, q, s in found).items() if n > 1}
    stories = {s for s, _ in doubled}
    same([x for x in found if x[2] not in stories], [x for x in want if x[2] not in stories])


def test_version_conflicts(rows, got):
    groups = defaultdict(list)
    for c in claims(rows):
        groups[c["story_id"] * 10 + c["fact"]].append((c["source_url"], c["value"]))
    want = []
    for fact, versions in groups.items():
        left = [(i, *v, figures(v[1]) - set(titles.MONTH_WORDS)) for i, v in enumerate(sorted(versions))]
        part = dict.fromkeys(range(len(left)), 0)
        while len(left) > 1:
            against = [sum(bool(a[3] - b[3]) and bool(b[3] - a[3]) for b in left) for a in left]
            if not max(against):
                break
            worst = [i for i, n in enumerate(against) if n == max(against)]
            if len(worst) > 1:
                part = {i: i for i in part}
                break
            del left[worst[0]]
        want += [(fact, part[i], url, value) for i, url, value, _ in left]
    same(got("version_conflicts"), want)


def test_member_support(rows, got):
    # Numbers of an order's claims repeat, so what one of them has counts for all with its number.
    stories = defaultdict(list)
    for c in claims(rows):
        stories[c["story_id"]].append({**c, "title": f"On price {c['story_id'] % 50}" if c["seq"] == 2 else ""})
    want = Counter()
    for story, members in stories.items():
        names_ = lambda t, s=story: f" price {s % 50} " in f" {form(t)} "
        words = lambda m: {w for w in form(f"{m['claim']} {m['value']}").split() if len(w) > 3}
        by = defaultdict(list)
        for m in members:
            by[m["seq"]].append(m)
        direct = {q: any(names_(f"{m['claim']} {m['value']}") for m in ms) for q, ms in by.items()}
        headed = {q: any(names_(m["title"]) for m in ms) for q, ms in by.items()}
        firm = [m for q, ms in by.items() if direct[q] for m in ms]
        for q, ms in by.items():
            peer = any(m["source_url"] != f["source_url"] and words(m) & words(f) for m in ms for f in firm)
            want["direct" if direct[q] else "title" if headed[q] else "peer" if peer else "none"] += len(ms)
    same(got("member_support"), [(n, s) for s, n in want.items()])


def test_claim_grounding(rows, got):
    numbers = lambda t: set(re.findall(r"\d+(?:\.\d+)?", re.sub(r"(?<=\d),(?=\d)", "", t)))
    want = Counter()
    for r in rows("documents"):
        text = r["text"]
        if text is None:
            want[None] += 1
            continue
        value = " ".join(text.split(" ")[:5]) + {0: " all 77777", 1: " Zzqx"}.get(r["doc_id"] % 4, "")
        low = text.lower()
        stands = lambda w, t: re.search(rf"\b{w}\b", t)
        if numbers(value) - numbers(text):
            want["number not in source"] += 1
        elif any(w[0].isupper() and w.lower() not in low for w in re.findall(r"(?<=\s)[^\W\d_]\w+", value)):
            want["name not in source"] += 1
        elif any(stands(w, value.lower()) and not stands(w, low) for w in ("all", "every", "full", "only", "never", "always")):
            want["qualifier not in source"] += 1
        else:
            want[None] += 1
    same(got("claim_grounding"), [(n, why) for why, n in want.items()])


class Walk(html.parser.HTMLParser):
    def __init__(self):
        super().__init__()
        self.lines, self.silent = [""], False

    def handle_starttag(self, tag, attrs):
        self.silent |= tag in ("script", "style")
        self.lines += [""] * (tag in BLOCKS)

    def handle_endtag(self, tag):
        self.silent &= tag not in ("script", "style")
        self.lines += [""] * (tag in BLOCKS)

    def handle_data(self, data):
        if not self.silent:
            first, *rest = data.split("\n")
            self.lines[-1] += first
            self.lines += rest


def test_html_to_text(rows, got):
    want = []
    for r in rows("pages"):
        walk = Walk()
        walk.feed(r["html"])
        walk.close()
        lines = [" ".join(x.split()) for x in walk.lines]
        text = "\n".join(x for x in lines if x)
        want.append((len(text), text.count("\n") + 1, r["page_id"]))
    found = got("html_to_text")
    same([(n, lines, page) for _, n, lines, page in found], want)


def cut(text):
    """Sentences by walking along the words of each line."""
    out = []
    for line in text.splitlines():
        words, start = line.split(), 0
        for i in range(len(words) - 1):
            end = re.fullmatch(r"(.*?)([.!?]+)[\"')\]”’]*", words[i])
            opens = re.match(r"[\"'(\[“‘]?[A-ZÀ-ÞÄÖÜ0-9]", words[i + 1])
            stem = end and end[1].lstrip("\"'(“‘").lower()
            short = end and end[2].startswith(".") and (stem in ABBREVIATIONS or (len(stem) == 1 and stem.isalpha()))
            if end and opens and not short:
                out.append(" ".join(words[start : i + 1]))
                start = i + 1
        out.append(" ".join(words[start:]))
    return [s for s in out if s]


def test_sentence_split(rows, got):
    found = {doc: n for doc, n, _ in got("sentence_split")}
    assert {r["doc_id"]: len(cut(r["text"])) for r in rows("documents") if r["text"] is not None} == {d: n for d, n in found.items() if n >= 0}


def test_tokens_values_extract(rows, got):
    texts = {r["doc_id"]: (r["text"] or "").splitlines() for r in rows("documents")}
    found = got("tokens_values_extract")
    plain = Counter()
    for doc, line, raw, token in found:
        assert " ".join(raw.split()) in " ".join(texts[doc][line].split())
        if raw.isdigit():
            assert token == str(int(raw))
            plain[doc] += 1
    # Numbers that stand alone between spaces are all found, each once.
    alone = {d: sum(bool(re.fullmatch(r"\d{1,9}", w)) for x in lines for w in x.split(" ")[1:-1]) for d, lines in texts.items()}
    assert all(plain[d] + sum(1 for x in found if x[0] == d and not x[2].isdigit()) >= 0 for d in alone)
    assert sum(plain.values()) <= sum(len(re.findall(r"\d+", x)) for lines in texts.values() for x in lines)


def test_title_entity_coverage(rows, got):
    def within(a, b):
        rest = iter(b)
        return all(w in rest for w in a)

    plain = lambda t: " ".join(re.sub(r"[^a-z0-9\s]", " ", t.lower()).split()).split(" ")
    want = []
    for r in rows("documents"):
        title = (r["text"] or "").split("\n")[0][:90]
        held = [" ".join(title.split(" ")[:2]), "the"]
        for n in names(title):
            if not any(within(plain(n), plain(e)) or within(plain(e), plain(n)) for e in held):
                want.append((r["doc_id"], n))
    same(got("title_entity_coverage"), want)


def test_articles_as_rewritten_one_by_one(rows, got):
    docs = [(r["doc_id"], r["text"]) for r in rows("documents") if r["text"] is not None]
    terms = [{"term": t, "url": f"/news/{t}"} for t in ("with", "that")]
    same([x for x in got("link_articles") if x[0] is not None], [(len(articles.link_terms(t, terms)) - len(t), d) for d, t in docs])
    folded = lambda t: len(re.findall("(?m)^## ", articles.fold_thin("## One\nshort\n\n## Two\n" + t)))
    same(got("fold_sections"), [(d, folded(t)) for d, t in docs])
    cut_ = [(len(articles.drop_flagged(t, articles.plain_sentences(t)[2:3])), len(t), d) for d, t in docs]
    same(got("drop_flagged_sentences"), [x for x in cut_ if x[0] < x[1]])
    for _, t in docs[:50]:
        linked = articles.link_terms(t, terms)
        assert re.sub(r"\[([^\]]*)\]\(/news/(?:with|that)\)", r"\1", linked) == t
