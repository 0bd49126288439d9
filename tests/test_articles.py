"""Row functions over articles, with made-up cases."""

import datetime as dt

import pytest

from skein.functions import articles as A

DAY = dt.date(2026, 10, 7)


@pytest.mark.parametrize(
    "value, kind, want",
    [
        ("begins today", None, "begins on October 7, 2026"),
        ("starts from tomorrow", None, "starts from October 8, 2026"),
        ("is out now on all stores", None, "is available on all stores as of October 7, 2026"),
        ("is now open", None, "is open"),
        ("they now sell it", None, "they as of October 7, 2026 sell it"),
        ("they now sell it", "statement", "they sell it"),
        ("should be done by now", None, None),
        ("no such word", None, "no such word"),
    ],
)
def test_absolute_time(value, kind, want):
    assert A.absolute_time(value, DAY, kind) == want


def test_absolute_time_needs_a_date():
    assert A.absolute_time("begins today", None) is None


def test_fold_thin():
    long = "One two three four five. " * 10
    body = f"Intro.\n\n## A\nshort\n\n## B\nalso short\n\n## C\n{long}\n\n## D\nend"
    got = A.fold_thin(body)
    assert [x for x in got.split("\n") if x.startswith("## ")] == ["## C"]
    assert "short" in got.split("## C")[0] and "end" in got.split("## C")[1]
    assert A.fold_thin(f"## C\n{long}") == f"## C\n{long}"


def test_link_terms():
    body = "# Glass Harbor\nGlass Harbor and [Glass Harbor](/x) by Glass.\n```\nGlass Harbor\n```\n## Sources\nGlass"
    got = A.link_terms(body, [{"term": "glass", "url": "/g"}, {"term": "glass harbor", "url": "/h"}])
    assert got.split("\n")[1] == "[Glass Harbor](/h) and [Glass Harbor](/x) by [Glass](/g)."
    assert got.split("\n")[0] == "# Glass Harbor" and got.endswith("Glass")
    assert A.link_terms(body, [{"term": "glass", "url": "/g"}], 0) == body


def test_canonical_text():
    assert A.canonical_text("the box 2 and Big Box 2", {"box 2": "Big Box 2"}) == "the Big Box 2 and Big Box 2"


def test_mask_names():
    assert A.mask_names("Card 5090 sold 40", ["Card 5090"]).split() == ["sold", "40"]


def test_circular():
    assert A.circular("Ann Roe said that Ann Roe left. Ann Roe said that Bo left.") == ["Ann Roe said that Ann Roe left."]


@pytest.mark.parametrize(
    "sentence, want",
    [
        ("On Monday Acme announced a plan.", "Acme announced"),
        ("According to Acme, it ships.", "According to Acme"),
        ("Acme, the large maker of many and more small things of all kinds and of every other sort, has said so.", "Acme, the large maker of many and more small things of all kinds and of every other sort, has said"),
        ("Acme shipped it.", ""),
    ],
)
def test_attribution_span(sentence, want):
    assert A.attribution_span(sentence, ["acme"]) == want


def test_cue_sources():
    got = A.cue_sources("Citing the paper Daily Post, Roe Hart has said that it ends. Confirmed Acme Corp.")
    assert [(c["kind"], c["origin"]) for c in got] == [("lead", "Daily Post"), ("subject", "Roe Hart")]


@pytest.mark.parametrize(
    "args, want",
    [
        (("It ships in May", "Acme said", ["Acme"], "Acme said: it ships in May."), None),
        (("", "Acme said", ["Acme"], "x"), "quote missing"),
        (("It ships in June", "Acme said", ["Acme"], "Acme said: it ships in May."), "quote not found"),
        (("It ships", "a source said", ["a source"], "a source said it ships"), "anonymous"),
        (("It ships", "Acme said", ["Acme"], "Acme said it ships", "ACME"), "cites itself"),
        (("It ships", "Bolt said", ["Acme"], "Bolt said it ships"), "no named speaker"),
        (("It ships", "Acme", ["Acme"], "Acme: it ships"), "no cue"),
        (("It ships", "Acme said", ["Acme"], "It ships."), "attribution not found"),
    ],
)
def test_evidence(args, want):
    assert A.evidence_reason(*args) == want


def test_spoken_clause():
    assert A.spoken_clause("Acme said it ships, but fans doubt it", ["Acme"]) == "Acme said it ships"
    assert A.spoken_clause("it ships but late", ["Acme"]) == "it ships but late"


def test_drop_flagged():
    body = "First one stays. Bad claim here. It leans on that. Fine end. More. Even more.\n\n## Only\nBad claim here."
    got = A.drop_flagged(body, ["bad claim"], share=0.5)
    assert got == "First one stays. Fine end. More. Even more."
    assert A.drop_flagged(body, ["bad claim"], share=0.1) == body


def test_repair_problem():
    before = "One stays. Two is bad. Three stays."
    assert A.repair_problem(before, "One stays. Two is good. Three stays.", ["two is bad"]) is None
    assert A.repair_problem(before, "Three stays. One stays.", ["two is bad"]) == "an unflagged sentence changed"
    assert A.repair_problem(before, before + " word" * 50, []) == "too much added"


def test_dates():
    assert A.dates_of("2026-11-02, November 2nd 2026 and 3 May") == [
        {"year": 2026, "month": 11, "day": 2}, {"year": 2026, "month": 11, "day": 2}, {"year": None, "month": 5, "day": 3},
    ]


def test_schema_problems():
    schema = '{"type":"object","required":["a"],"additionalProperties":false,"properties":{"a":{"type":"array","items":{"type":"integer","minimum":1}},"b":{"enum":["x"]}}}'
    assert A.schema_problems('```json\n{"a": [1, 2], "b": "x"}\n```', schema) == []
    assert A.schema_problems('{"a": [0, "q"], "b": "y", "c": 1}', schema) == ["$.a[0]: under 1", "$.a[1]: not integer", "$.b: not one of ['x']", "$.c: unknown"]
    assert A.schema_problems("{", schema) == ["$: not JSON"]
