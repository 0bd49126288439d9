"""Nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import hashlib
import io

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skein.llm import decontaminate, exact_dedup, line_dedup, mixing, quality_crf, recurrent_lm, simhash, toxicity, url_filter, warc
from skein.llm.components import components

LONG = " ".join(f"word{i % 977}" for i in range(60_000))
DOC = "doc_id bigint, text string, lang string, source string, digest string, fp string, key string, pos string, score string, hash string"


def docs(spark, rows):
    """Documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", "src1", *["x"] * 6) for i, t in rows], DOC)


EDGES = [(1, None), (2, ""), (3, "  \n\t"), (4, LONG), (4, LONG), (5, "a b c"), (6, "a b c"), (None, "a b c"), (7, "a b c\n"), (8, "Ünï çode ß"), (None, None)]


def test_exact_dedup_edges(spark):
    df = docs(spark, EDGES)
    rows = exact_dedup.exact_dedup(df).collect()
    assert len(rows) == len(EDGES)
    by = {}
    for r in rows:
        by.setdefault(bytes(r["digest"]), []).append(r)
    for group in by.values():
        assert sum(r["kept"] for r in group) == 1 and {r["group_size"] for r in group} == {len(group)}
        ids = [r["doc_id"] for r in group if r["doc_id"] is not None]
        assert {r["keep_id"] for r in group} == {max(ids, default=None)}
    kept = exact_dedup.drop_exact_copies(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [2, 3, 4, 6, 7, 8]
    assert exact_dedup.exact_dedup(df.limit(0)).count() == 0
    assert exact_dedup.drop_exact_copies(df.limit(0)).count() == 0


def test_exact_dedup_heavy_groups_agree_with_plain_ones(spark):
    df = docs(spark, [(i, "same" if i % 3 == 0 else f"t{i % 50}") for i in range(600)])
    heavy = exact_dedup.exact_dedup(df, share=0.1)
    plain = exact_dedup.exact_dedup(df, share=2.0)
    assert sorted(map(tuple, heavy.collect())) == sorted(map(tuple, plain.collect()))


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=300), st.integers(1, 8))
def test_misra_gries_never_misses(items, counters):
    held = {}
    for x in items:
        held = exact_dedup.merge_counters(held, [(x, 1)], counters)
    for x in set(items):
        n = items.count(x)
        assert held.get(x, 0) <= n and n - held.get(x, 0) <= len(items) / (counters + 1)


def test_line_dedup_edges(spark):
    rows = [
        (3, "A common line here\nown three\nA common line here"), (1, "  a COMMON line here\t\nshort"), (2, "x\na common line here\nshort"),
        (2, "x\na common line here\nshort"), (None, "a common line here"), (5, None), (6, ""), (7, "\n\n"),
    ]
    got = line_dedup.dedup_lines(docs(spark, rows)).collect()
    kept = sorted(((r["doc_id"], r["kept_text"], r["n_lines"], r["n_dropped"]) for r in got), key=str)
    want = [
        (3, "own three", 3, 2), (1, "  a COMMON line here\t\nshort", 2, 0), (2, "x\nshort", 3, 1), (2, "x\nshort", 3, 1),
        (None, "a common line here", 1, 0), (5, "", 1, 0), (6, "", 1, 0), (7, "\n\n", 3, 0),
    ]
    assert kept == sorted(want, key=str)
    assert line_dedup.dedup_lines(docs(spark, rows).limit(0)).count() == 0


def test_line_dedup_bitmaps_of_long_texts(spark):
    many = [f"line number {i:05d}" for i in range(1000)]
    rows = [(1, "\n".join(many[::3])), (2, "\n".join(many))]
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs(spark, rows), share=2.0).collect()}
    assert got[2]["kept_text"].split("\n") == [x for i, x in enumerate(many) if i % 3]
    assert got[1]["n_dropped"] == 0
    hot = {r["doc_id"]: r["kept_text"] for r in line_dedup.dedup_lines(docs(spark, rows), share=0.0).collect()}
    assert hot == {k: r["kept_text"] for k, r in got.items()}


def test_url_edges(spark):
    rules = spark.createDataFrame([("", "/x", "block"), ("b.com", "/", "allow"), ("b.com", "/p", "block"), ("b.com", "/p", "allow")], "host string, path string, verdict string")
    urls = ["http://A.B.com/page", "b.com/p", None, "http://b.com", "z://q.org/xyz?u=://b.com/p", "http://b.com/p", "http://notb.com/", "http://b.com/p"]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id bigint, url string, digest string, short string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages, rules).collect()}
    assert got == {
        0: ("a.b.com", "/page", "b.com/p", "block"), 1: ("", "", None, "allow"), 2: ("", "", None, "allow"), 3: ("b.com", "", None, "allow"),
        4: ("q.org", "/xyz", "/x", "block"), 5: ("b.com", "/p", "b.com/p", "block"), 6: ("notb.com", "/", None, "allow"), 7: ("b.com", "/p", "b.com/p", "block"),
    }
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in url_filter.judge_urls(pages, rules.limit(0)).collect()} == {"allow"}


def test_simhash_edges(spark):
    rows = simhash.near_components(docs(spark, EDGES)).collect()
    assert len(rows) == len(EDGES)
    part = {(r["doc_id"], r["fp"]): r["component_id"] for r in rows}
    assert {part[i, 0] for i in (1, 2, 3, None)} == {1}
    assert {v for (i, f), v in part.items() if i in (5, 6, 7) or (i is None and f)} == {5}
    assert {v for (i, _), v in part.items() if i in (4, 8)} == {4, 8}
    assert simhash.near_components(docs(spark, EDGES).limit(0)).count() == 0
    kept = simhash.drop_near_copies(docs(spark, EDGES), word_bits=simhash.WORD_BITS)
    assert kept.columns == docs(spark, EDGES).columns
    assert {r["doc_id"] for r in kept.collect()} == {1, 4, 5, 8, None}


def test_simhash_repeated_id_joins_components(spark):
    a, b = "one two three four five six", "alpha beta gamma delta epsilon"
    got = simhash.near_components(docs(spark, [(1, a), (2, a), (2, b), (3, b)])).collect()
    assert {r["component_id"] for r in got} == {1}


@pytest.mark.parametrize("bucket, check", [(1 << 16, 64), (20, 64), (20, 30)])
def test_fingerprint_links_by_brute_force(spark, bucket, check):
    dice = np.random.default_rng(5)
    base = dice.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = {int(b) for b in base}
    for b in base.tolist():
        for _ in range(12):
            x = b
            for bit in dice.choice(64, dice.integers(1, 7), replace=False).tolist():
                x ^= 1 << bit
            fps.add(x)
    fps = np.array(sorted(fps), np.uint64)
    chk = dice.integers(0, 1 << 63, len(fps), dtype=np.uint64)
    rows = [(int(np.int64(f)), i, int(np.int64(c))) for i, (f, c) in enumerate(zip(fps.view(np.int64), chk.view(np.int64), strict=True))]
    reps = spark.createDataFrame(rows, "fp bigint, rep bigint, chk bigint")
    got = simhash.fingerprint_links(reps, 4, check, bucket)
    parts = {r["node"]: r["component"] for r in components(got).collect()}
    label = list(range(len(fps)))
    near = [(i, j) for i in range(len(fps)) for j in range(i) if int(fps[i] ^ fps[j]).bit_count() <= 4 and int(chk[i] ^ chk[j]).bit_count() <= check]
    for _ in range(len(fps)):
        before = list(label)
        for i, j in near:
            label[i] = label[j] = min(label[i], label[j])
        if label == before:
            break
    assert [parts.get(i, i) for i in range(len(fps))] == label


def test_near_copies_with_changed_words_are_found(spark):
    dice = np.random.default_rng(1)
    words = [f"w{x}" for x in dice.integers(0, 5000, 400)]
    rows = [(0, " ".join(words))]
    for i in range(1, 40):
        new = list(words)
        for at in dice.choice(400, 5, replace=False).tolist():
            new[at] = f"v{i}_{at}"
        rows.append((i, " ".join(new)))
    rows.append((100, " ".join(reversed(words))))
    kept = [r["doc_id"] for r in simhash.drop_near_copies(docs(spark, rows), word_bits=simhash.WORD_BITS).collect()]
    assert 0 in kept and 100 in kept and len(kept) <= 4


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 15), st.integers(0, 15)), max_size=25))
def test_components_by_brute_force(spark, pairs):
    label = {x: x for p in pairs for x in p}
    for _ in label:
        for u, v in pairs:
            label[u] = label[v] = min(label[u], label[v])
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "u bigint, v bigint")).collect()}
    assert {x: got.get(x, x) for x in label} == label


WORDS = st.lists(st.sampled_from(["a", "b", "c", "d1", "é"]), max_size=40)


@settings(max_examples=150, deadline=None)
@given(WORDS, st.lists(WORDS, max_size=4))
def test_winnowing_by_brute_force(doc, items):
    spans = decontaminate.Spans()
    held = {}
    for i, item in enumerate(items):
        words = decontaminate.words_of(pa.array([" ".join(item)]))[0]
        if len(words):
            _, *found = spans.of(words, m := min(10, len(words)))
            for key in zip(*(x.view(np.int64).tolist() for x in found), strict=True):
                held.setdefault((m, *key), set()).add(str(i))
    prints = np.array([k[1] for k in held], np.int64).view(np.uint64)
    got = decontaminate.candidates(spans, lambda h: np.isin(h, prints), sorted({k[0] for k in held}), decontaminate.words_of(pa.array(["; ".join(doc)]))[0])
    got = [(held.get((x["m"], x["h"], x["s1"], x["s2"]), set()), x["m"], x["at"]) for x in got]
    hit = {p + j for found, m, at in got if found for p in at for j in range(m)}
    want, named = set(), set()
    for i, item in enumerate(items):
        m = min(10, len(item))
        for q in range(len(item) - m + 1 if m else 0):
            for p in range(len(doc) - m + 1):
                if doc[p : p + m] == item[q : q + m]:
                    want |= set(range(p, p + m))
                    named.add(str(i))
    assert hit == want
    assert set().union(*(found for found, _, _ in got)) == named


def test_decontamination_edges_and_small_filters(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven"), (2, None), (3, ""), (4, "Tiny item"), (None, "odd one out")], "item_id bigint, text string")
    text = "x one two three four five six seven eight nine ten y tiny ITEM z"
    df = docs(spark, [(1, text), (2, None), (3, ""), (4, LONG), (5, "odd one out")])
    for size in (1 << 20, 1):
        got = {r["doc_id"]: r["leak"] for r in decontaminate.contamination(df, bench, filter_bytes=size).collect()}
        assert (got[1]["n_words"], got[1]["n_hit"], got[1]["items"]) == (15, 12, ["1", "4"])
        assert [(h["start"], h["end"]) for h in got[1]["hits"]] == [(1, 11), (12, 14)]
        assert got[2]["n_words"] == got[3]["n_words"] == got[4]["n_hit"] == 0
        assert got[5]["n_hit"] == 3 and got[5]["items"] == []
        kept = decontaminate.drop_contaminated(df, bench, filter_bytes=size)
        assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {2, 3, 4}
    assert decontaminate.contamination(df, bench.limit(0)).where("leak.n_hit > 0").count() == 0
    assert decontaminate.contamination(df.limit(0), bench).count() == 0


def test_decontamination_of_repeated_rows_and_clashing_columns(spark):
    words = [f"w{i}" for i in range(30)]
    bench = spark.createDataFrame([(1, " ".join(words[:12])), (1, " ".join(words[15:27])), (1, " ".join(words[:12])), (2, " ".join(words[2:14]))], "item_id bigint, text string")
    df = docs(spark, [(1, " ".join(words)), (1, " ".join(words)), (2, " ".join(words[:5])), (None, " ".join(words[3:14]))])
    df = df.withColumn("leak", F.lit("old")).withColumn("t1", F.lit(1)).withColumn("h", F.lit(2)).withColumn("__n", F.lit(3))
    got = decontaminate.contamination(df, bench)
    assert sorted(got.columns) == sorted(df.columns)
    rows = got.collect()
    assert len(rows) == 4 and {(r["t1"], r["h"], r["__n"]) for r in rows} == {(1, 2, 3)}
    both = [r["leak"] for r in rows if r["doc_id"] == 1]
    assert both[0] == both[1] and both[0]["items"] == ["1", "2"] and both[0]["n_hit"] == 26
    assert [tuple(x) for x in both[0]["hits"]] == [(0, 14), (15, 27)]
    last = next(r["leak"] for r in rows if r["doc_id"] is None)
    assert last["items"] == ["2"] and last["n_words"] == last["n_hit"] == 11
    kept = decontaminate.drop_contaminated(df, bench)
    assert kept.columns == df.columns and [r["doc_id"] for r in kept.collect()] == [2]


def test_decontamination_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_KEYS", -1)
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", -1)
    bench = spark.createDataFrame([(7, "a b c")], "item_id bigint, text string")
    df = docs(spark, [(i, "x a b c y" if i % 3 == 0 else f"b c {i}") for i in range(30)])
    got = decontaminate.contamination(df, bench).collect()
    assert {r["doc_id"] for r in got if r["leak"]["n_hit"] == 3} == set(range(0, 30, 3))
    assert decontaminate.drop_contaminated(df, bench).count() == 20


def test_archive_round_trip():
    records = [warc.warc_record(i, "http://x/\r\n", bytes([i % 7]) * (i * 37), "2024-01-01T00:00:00Z", 3, i % 4 == 0) for i in range(50)]
    for sample in (1 << 20, 1000, 1):
        sink = io.BytesIO()
        n, size = warc.write_archive(sink, records, sample_bytes=sample)
        data = sink.getvalue()
        assert n == 50 and size == len(data) and int.from_bytes(data[:4], "little") == warc.DICTIONARY_MAGIC
        assert list(warc.read_archive(io.BytesIO(data))) == records
    sink = io.BytesIO()
    assert warc.write_archive(sink, [])[0] == 0
    assert list(warc.read_archive(io.BytesIO(sink.getvalue()))) == []


def test_warc_edges(spark):
    rows = [(2, "u2", "same"), (1, "u1", "same"), (3, None, None), (4, "u4", ""), (None, "u", "same"), (5, "u5", LONG), (5, "u5", LONG)]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id bigint, url string, html string, digest string, order string")
    archives = warc.write_warc(pages, warc.archive_folder(spark))
    got = warc.read_warc(archives).collect()
    assert len(got) == len(rows)
    key = lambda r: (r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"])
    want = [(2, "revisit", 1, 4), (1, "response", None, 4), (3, "response", None, 0), (4, "revisit", 3, 0), (None, "response", None, 4), (5, "response", None, len(LONG)), (5, "response", None, len(LONG))]
    assert sorted(map(key, got), key=str) == sorted(want, key=str)
    for r in got:
        if r["payload"] is not None:
            assert warc.payload_digest(bytes(r["payload"])) == r["payload_digest"]
    few = warc.read_warc(warc.write_warc(pages, warc.archive_folder(spark), min_bytes=5), payloads=False).collect()
    assert {r["record_type"] for r in few} == {"response"}
    assert warc.read_warc(warc.write_warc(pages.limit(0), warc.archive_folder(spark))).count() == 0


def test_forward_backward_by_enumeration():
    dice = np.random.default_rng(3)
    n = np.array([3, 1, 4])
    unary, trans = dice.normal(size=(8, 2)), dice.normal(size=(2, 2))
    marginal, pairs, z = quality_crf.forward_backward(unary, trans, quality_crf.Chains(n))
    at, all_pairs = 0, np.zeros((2, 2))
    for doc, k in enumerate(n.tolist()):
        total, mass, joint = 0.0, np.zeros((k, 2)), np.zeros((2, 2))
        for code in range(2**k):
            y = [code >> i & 1 for i in range(k)]
            p = np.exp(sum(unary[at + i, y[i]] for i in range(k)) + sum(trans[y[i - 1], y[i]] for i in range(1, k)))
            total += p
            for i in range(k):
                mass[i, y[i]] += p
            for i in range(1, k):
                joint[y[i - 1], y[i]] += p
        assert z[doc] == pytest.approx(np.log(total))
        assert marginal[at : at + k] == pytest.approx(mass / total)
        all_pairs += joint / total
        at += k
    assert pairs == pytest.approx(all_pairs)


def test_quality_edges(spark):
    df = docs(spark, EDGES)
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 1), (6, 0, 1), (8, 1, 0), (99, 1, 0), (None, 1, 1), (7, None, None)], "doc_id bigint, quality int, toxic int")
    field = quality_crf.fit_quality(df, labels)
    got = df.select("doc_id", quality_crf.quality_score(spark, field, F.col("text")).alias("s")).collect()
    assert len(got) == len(EDGES) and all(0 <= r["s"] <= 1 for r in got)
    none = quality_crf.fit_quality(df, labels.limit(0))
    assert {r["s"] for r in df.select(quality_crf.quality_score(spark, none, F.col("text")).alias("s")).collect()} == {0.5}


def test_toxicity_edges(spark):
    df = docs(spark, EDGES)
    labels = spark.createDataFrame([(4, 0), (5, 1), (6, 1), (8, 0), (99, 1), (None, 1), (7, None)], "doc_id bigint, toxic int")
    model = toxicity.fit_toxicity(df, labels)
    got = df.select("doc_id", toxicity.toxicity_score(spark, model, F.col("text")).alias("s")).collect()
    assert len(got) == len(EDGES) and all(0 <= r["s"] <= 1 for r in got)
    none = toxicity.fit_toxicity(df, labels.limit(0))
    assert {r["s"] for r in df.select(toxicity.toxicity_score(spark, none, F.col("text")).alias("s")).collect()} == {0.5}
    kept = toxicity.drop_toxic(df, none, threshold=0.6)
    assert kept.columns == df.columns and kept.count() == len(EDGES)


def kneser_ney(words, counts, order, alphabet):
    """P(letter | history, class) by the textbook: word counts a class, shared continuation counts below."""
    grams = {}
    for w, pair in zip(words, counts, strict=True):
        s = "^" + w + "$"
        for i in range(1, len(s)):
            for n in range(1, min(order, i + 1) + 1):
                grams.setdefault(s[i - n + 1 : i + 1], np.zeros(2))[:] += pair

    def shared(g):
        if len(g) == order or g.startswith("^"):
            return grams[g].sum()
        return sum(1 for x in grams if x[1:] == g)

    def p(history, letter, c):
        q = own = 1 / (alphabet + 1)
        for n in range(1, order + 1):
            h = ("^" + history)[len(history) + 2 - n :] if n > 1 else ""
            if n > len(history) + 2 or (h not in grams and h not in ("", "^")):
                break
            follow = {g: shared(g) for g in grams if len(g) == n and g[:-1] == h}
            if not follow:
                own = q
                continue
            total, d = sum(follow.values()), toxicity.DISCOUNT
            q = max(follow.get(h + letter, 0) - d, 0) / total + d * len(follow) / total * q
            mine = {g: grams[g][c] for g in follow}
            d, total = toxicity.CLASS_DISCOUNT, sum(mine.values())
            own = (max(mine.get(h + letter, 0) - d, 0) + sum(min(x, d) for x in mine.values()) * q) / total if total else q
        return own

    return p


KN_WORDS, KN_COUNTS = ["ab", "abc", "b", "ca", "caab", "abca"], np.array([(3, 0), (1, 2), (0, 4), (2, 2), (0, 1), (5, 1)])


def test_kneser_ney_by_brute_force():
    p = kneser_ney(KN_WORDS, KN_COUNTS, 3, 4)
    model = toxicity.LetterModel(KN_WORDS, KN_COUNTS, order=3)
    for w in ["ab", "b", "caab", "bbb", "zab", "abz", "", "cabab"]:
        got = model.log_probs([w, "ab"])[0]
        want = [sum(np.log(p(w[:i], (w + "$")[i], c)) for i in range(len(w) + 1)) for c in (0, 1)]
        assert got == pytest.approx(want, rel=1e-4)


@pytest.mark.parametrize("order", [2, 4, 6])
def test_kneser_ney_probabilities_sum_to_one(order):
    model = toxicity.LetterModel(KN_WORDS, KN_COUNTS, order=order)
    for w in ["", "a", "ca", "abc", "bb", "?a", "abca"]:
        total = np.zeros(2)
        for x in ["", "a", "b", "c", "?"]:  # the end, each letter, and any other sign
            _, logs = model.letter_log_probs([w + x])
            total += np.exp(logs[len(w)])
        assert total == pytest.approx(np.ones(2), abs=1e-4)


def test_toxic_stems_generalise():
    rows = []
    dice = np.random.default_rng(0)
    plain = ["house", "water", "green", "stone", "light", "paper", "river", "cloud"]
    for i in range(400):
        ws = [plain[j] + "aeiou"[k] for j, k in zip(dice.integers(0, 8, 30), dice.integers(0, 5, 30), strict=True)]
        if i % 4 == 0:
            ws[3] = "grumf" + "xyzqw"[i % 5] + plain[i % 8][:3]
        rows.append((" ".join(ws), int(i % 4 == 0)))
    score = toxicity.train(rows).scorer()
    assert score(["house water grumfnew stone", "grumfold"]).min() > 0.5
    assert score(["house water green stone", ""]).max() < 0.3


def test_lm_gradients():
    lex = recurrent_lm.Lexicon(
        np.arange(8), np.array([9, 7, 5, 4, 3, 2, 1, 1]), np.zeros(8, np.int64), 32, 8, np.r_[32, np.zeros(recurrent_lm.SHAPES - 1)], np.r_[8, np.zeros(recurrent_lm.SHAPES - 1)], 6, 2
    )
    model = recurrent_lm.first_model(lex, 3)
    model = recurrent_lm.Gru(model.words, model.starts, model.classes, 3, model.flat)
    ids = np.array([0, 3, 1, 6, 2, 4, 5, 0, 1, 2, 6, 3])

    def loss(flat):
        m = model.like(flat)
        t = recurrent_lm.Trainer(m, lex, 0.0, lanes=2, window=6)
        return t.run(ids) * len(ids)

    seen = {}
    trainer = recurrent_lm.Trainer(model.like(model.flat), lex, 0.0, lanes=2, window=6)
    trainer._adam = lambda g: seen.setdefault("g", g * 12)
    trainer.run(ids)
    dice = np.random.default_rng(0)
    for i in dice.choice(len(model.flat), 60, replace=False).tolist():
        up, down = model.flat.copy(), model.flat.copy()
        up[i] += 1e-2
        down[i] -= 1e-2
        assert -(loss(up) - loss(down)) / 2e-2 == pytest.approx(seen["g"][i], abs=2e-2)


def test_lm_carries_state_across_windows():
    lex = recurrent_lm.Lexicon(
        np.arange(8), np.array([9, 7, 5, 4, 3, 2, 1, 1]), np.zeros(8, np.int64), 32, 8, np.r_[32, np.zeros(recurrent_lm.SHAPES - 1)], np.r_[8, np.zeros(recurrent_lm.SHAPES - 1)], 6, 2
    )
    model = recurrent_lm.first_model(lex, 4)
    n = np.array([5, 17, 1])
    ids = np.random.default_rng(2).integers(0, 7, n.sum())
    small = recurrent_lm.document_log_probs(model, lex, ids, n, window=3)
    large = recurrent_lm.document_log_probs(model, lex, ids, n, window=100)
    assert small == pytest.approx(large, abs=1e-4)
    alone = recurrent_lm.document_log_probs(model, lex, ids[5:22], np.array([17]), window=4)
    assert alone[0] == pytest.approx(small[1], abs=1e-4)


def test_lm_edges(spark):
    df = docs(spark, EDGES)
    got = recurrent_lm.score_texts(df, F.coalesce(F.col("doc_id") % 2 == 1, F.lit(False))).collect()
    assert len(got) == len(EDGES)
    assert all(r["score"] < 0 and r["base_score"] < 0 and r["n_tokens"] >= 1 for r in got)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (1, 2, 3)} == {1}
    unseen = recurrent_lm.score_texts(df, F.lit(True)).collect()
    assert {r["n_known"] for r in unseen} == {0} and {r["train_tokens"] for r in unseen} == {0}
    assert recurrent_lm.score_texts(df.limit(0), F.lit(False)).count() == 0


def test_mixing_edges(spark):
    rows = [(1, "a b", "en", "src1"), (1, "a b", "en", "src1"), (2, None, "en", "src1"), (3, "a", None, None), (None, LONG, "de", "odd"), (4, "", "fr", "src2")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id bigint, text string, lang string, source string, bin int, rest int")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows) and all(0 <= r["copies"] <= mixing.MAX_EPOCHS for r in got)
    assert mixing.mix(df.limit(0)).count() == 0
    assert sum(r["n_tokens"] * r["copies"] for r in mixing.mix(df, budget=0).collect()) == 0
    full = mixing.mix(df, budget=10**9).collect()
    assert {r["copies"] for r in full if r["n_tokens"]} == {mixing.MAX_EPOCHS}


@settings(max_examples=100, deadline=None)
@given(st.floats(0, 1000), st.lists(st.tuples(st.floats(0, 5), st.floats(0, 300)), max_size=6))
def test_share_out(budget, children):
    parts = mixing.share_out(budget, children)
    usable = sum(c for w, c in children if w > 0)
    assert all(0 <= p <= c + 1e-6 for p, (_, c) in zip(parts, children, strict=True))
    assert sum(parts) == pytest.approx(min(budget, usable), abs=1e-6)


def test_shortages_go_to_siblings_first():
    leaves = {("d1", "en", "a"): 10, ("d1", "en", "b"): 100, ("d1", "fr", "c"): 100, ("d2", "en", "e"): 500}
    got = mixing.leaf_budgets(leaves, 200, {"domain": {}, "lang": {}, "source": {}}, 1)
    assert got == {("d1", "en", "a"): 10, ("d1", "en", "b"): 40, ("d1", "fr", "c"): 50, ("d2", "en", "e"): 100}


def test_digest_is_that_of_the_text(spark):
    row = exact_dedup.exact_dedup(docs(spark, [(1, "Ünï")])).first()
    assert bytes(row["digest"]) == hashlib.sha256("Ünï".encode()).digest()
