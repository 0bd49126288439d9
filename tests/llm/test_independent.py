"""Operators against answers that share no code with them."""

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from skein.llm import mixing, quality_crf, recurrent_lm, registry

QUERIES = registry.queries()
TABLE = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(TABLE))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_op1_fingerprints_and_components(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = {r["doc_id"]: simhash(r["text"]) for r in docs}
    rows = QUERIES["op1_simhash_near_dedup"](spark, sf_dir).collect()
    assert {r["doc_id"]: int(r["fingerprint"], 16) for r in rows} == want and all(len(r["fingerprint"]) == 16 for r in rows)
    label = {d: d for d in want}
    while True:
        before = dict(label)
        for a, x in want.items():
            for b, y in want.items():
                if (x ^ y).bit_count() <= 4:
                    label[a] = label[b] = min(label[a], label[b])
        if before == label:
            break
    assert {r["doc_id"]: r["component_id"] for r in rows} == label


def test_op3_document_score_by_enumeration():
    dice = np.random.default_rng(5)
    texts = ["One good line.\n\n!!! ### 12 12 12\nAnother line, with words.", "x", "", None, "a a a a\nb"]
    field = quality_crf.LineCRF(dice.normal(size=quality_crf.FEATURES + 1), dice.normal(size=(2, 2)), np.ones(quality_crf.FEATURES), np.array([0.7, -0.2]))
    x, _, n = quality_crf.line_features(texts)
    at, want = 0, []
    for text, k in zip(texts, n.tolist(), strict=True):
        lines = (text or "").encode().split(b"\n")
        assert len(lines) == k
        good = [float(x[at + i] @ field.weights[:-1] + field.weights[-1]) for i in range(k)]
        mass, total = np.zeros(k), 0.0
        for code in range(2**k):
            y = [code >> i & 1 for i in range(k)]
            p = np.exp(sum(g for g, z in zip(good, y, strict=True) if z) + sum(field.trans[a, b] for a, b in zip(y, y[1:], strict=False)))
            total += p
            mass += p * np.array(y)
        size = np.array([len(b) + 1 for b in lines])
        mean = float((size * mass / total).sum() / size.sum())
        want.append(1 / (1 + np.exp(-(0.7 * np.log(mean / (1 - mean)) - 0.2))))
        at += k
    assert field.score(texts) == pytest.approx(want, rel=1e-6)


def shared_by_water(budget, children):
    """What (weight, capacity) children get if a level rises until the budget is used."""
    usable = sum(c for w, c in children if w > 0)
    low, high = 0.0, 1e12
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(c, w * mid) for w, c in children) < min(budget, usable) else (low, mid)
    return [min(c, w * high) for w, c in children]


def test_op6_budgets_by_rising_water(spark, sf_dir):
    rows = QUERIES["op6_mixing"](spark, sf_dir).collect()
    leaves = {}
    for r in rows:
        key = (r["domain"], r["lang"], r["source"])
        leaves[key] = leaves.get(key, 0) + r["n_tokens"]

    def walk(prefix, budget):
        if len(prefix) == 3:
            return {prefix: budget}
        level = mixing.LEVELS[len(prefix)]
        names = sorted({k[len(prefix)] for k in leaves if k[: len(prefix)] == prefix}, key=str)
        caps = [mixing.MAX_EPOCHS * sum(n for k, n in leaves.items() if k[: len(prefix) + 1] == (*prefix, x)) for x in names]
        parts = shared_by_water(budget, [(mixing.WEIGHTS[level].get(x, 1.0), c) for x, c in zip(names, caps, strict=True)])
        return {k: v for x, p in zip(names, parts, strict=True) for k, v in walk((*prefix, x), p).items()}

    want = walk((), float(sum(leaves.values())))
    taken = {k: sum(r["n_tokens"] * r["copies"] for r in rows if (r["domain"], r["lang"], r["source"]) == k) for k in leaves}
    longest = {k: max(r["n_tokens"] for r in rows if (r["domain"], r["lang"], r["source"]) == k) for k in leaves}
    for k, n in taken.items():
        assert want[k] - longest[k] - 1 <= n <= want[k] + 1


def test_op9_scores_by_a_plain_forward_pass():
    dice = np.random.default_rng(8)
    shapes = recurrent_lm.SHAPES
    counts = np.array([40, 30, 20, 12, 9, 7, 5, 3, 2, 1])
    kinds = np.array([0, 0, 1, 1, 2, 2, 0, 1, 2, 0])
    lex = recurrent_lm.Lexicon(np.arange(10), counts, kinds, counts.sum(), 10, np.bincount(kinds, counts, shapes), np.bincount(kinds, minlength=shapes), 6, 2)
    model = recurrent_lm.first_model(lex, 5)
    model = model.like(model.flat + dice.normal(0, 0.3, len(model.flat)).astype(np.float32))
    n = np.array([70, 1, 33])
    ids = dice.integers(0, 9, n.sum())
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    softmax = lambda x: np.exp(x) / np.exp(x).sum()
    w = {k: getattr(model, k).astype(np.float64) for k in model.shapes}
    want, at = [], 0
    for k in n.tolist():
        h, before, total = np.zeros(5), lex.end, 0.0
        for t in ids[at : at + k].tolist():
            add = w["x"][before] + w["b"]
            z, r = sigmoid(add[:5] + h @ w["u"][:, :5]), sigmoid(add[5:10] + h @ w["u"][:, 5:])
            new = np.tanh(add[10:] + (r * h) @ w["v"])
            h = new + z * (h - new)
            kind = int(lex.class_of(np.array([t]))[0])
            total += np.log(softmax(h @ w["cw"] + w["cb"])[kind])
            if t < lex.words:
                a, b = lex.starts[kind], lex.starts[kind + 1]
                total += np.log(softmax(h @ w["ww"][:, a:b] + w["wb"][a:b])[t - a]) if b - a > 1 else 0
            before = t
        want.append(total)
        at += k
    got = recurrent_lm.document_log_probs(model, lex, ids, n, window=8)
    assert got == pytest.approx(want, rel=1e-4)


def test_op9_tokens_by_plain_python():
    import pyarrow as pa

    texts = ["Hello wOrld, foo.", "", None, "  a\tb\x0bc ", "x", "Ünï ÇODE!! ...", "a.b c;d e!", " ", "zz" * 200_000 + " end"]
    words = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(TABLE)) for t in texts]
    tokens = recurrent_lm.Tokens(pa.array(["cut off", *texts]).slice(1))
    flat = [w.encode() for ws in words for w in ws]
    assert tokens.n.tolist() == [len(ws) for ws in words]
    assert [bytes(tokens.data[a:b]) for a, b in zip(tokens.starts, tokens.ends, strict=True)] == flat
    assert tokens.hashes().tolist() == [recurrent_lm.word_hash(w) for w in flat]
    assert recurrent_lm.shapes(tokens, np.arange(len(flat))).tolist() == [recurrent_lm.shape(w) for w in flat]
    assert len(set(tokens.hashes().tolist())) == len(set(flat))


def test_copies_are_averaged_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(recurrent_lm, "MOST_COPIES", 3)
    dice = np.random.default_rng(2)
    values, tokens = dice.normal(size=(11, 2, 4)).astype(np.float32), dice.integers(1, 9, 11).astype(float)
    rows = [(b, c, float(tokens[c]), values[c, b].tobytes()) for c in range(11) for b in range(2)]
    got = dict(recurrent_lm.average(spark.createDataFrame(rows, recurrent_lm._BLOCKS), 11))
    for b in range(2):
        assert np.frombuffer(got[b], np.float32) == pytest.approx((values[:, b] * tokens[:, None]).sum(axis=0) / tokens.sum(), abs=1e-5)


EDGES = {
    "empty": [],
    "null texts": [(i, None, "en", "src1", 0) for i in range(5)],
    "repeats and nulls": [(1, "a b c d e f", "en", "src1", 1), (1, "a b c d e f", "en", "src1", 1), (1, "other words here", None, None, None), (None, "a b c d e f", "de", "src2", 2), (2, "", "fr", None, 0), (3, "word " * 40_000, "en", "src1", 3), (None, None, None, None, None)],
}


@pytest.mark.parametrize("case", sorted(EDGES))
def test_pipeline_stages_on_edges(spark, tmp_path, case):
    columns = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    docs = spark.createDataFrame(EDGES[case], columns)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, 0), (2, 1, 1), (99, 1, 1)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(7, "never seen words of a benchmark item that is long enough")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns
        kept = got.count()
        assert kept <= len(EDGES[case])
        if name == "exact_dedup":
            assert kept == len({(r[1] or "") for r in EDGES[case]})
        if name == "decontamination":
            assert kept == len(EDGES[case])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() <= len(EDGES[case])
    clash = docs.withColumn("t1", F.lit(1)).withColumn("key", F.lit("k")).withColumn("rep", F.lit(0)).withColumn("spans", F.lit("s"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, clash, str(tmp_path)).columns == clash.columns
