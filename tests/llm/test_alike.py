import numpy as np
import pytest

import corpus_pipeline
from skein.llm import alike, simhash
from skein.llm.components import components


def shingles(text):
    words = text.lower().split()
    k = min(5, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def texts_with_block_edits():
    dice = np.random.default_rng(3)
    new = lambda n: [f"w{x}" for x in dice.integers(0, 5000, n)]
    out, line = [], new(12)
    for i in range(30):
        words = new(int(dice.integers(40, 400)))
        cut = int(len(words) * 0.18)
        out += [words, words[:-cut], words[cut:], words + new(cut), new(cut) + words, line + words]
        if i == 0:  # a chain of copies, most of which are alike in steps only
            out += [words[j:] + new(j) for j in range(0, 60, 2)]
    return [(i, " ".join(w)) for i, w in enumerate(out)] + [(9000, ""), (9001, None), (9002, "two words"), (9003, "Two  words")]


@pytest.mark.parametrize("most", [24, 2])
def test_links_connect_what_all_pairs_connect(spark, most):
    rows = texts_with_block_edits()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    label = {i: i for i, t in rows if t}
    sets = {i: shingles(t) for i, t in rows if t}
    near = [(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    while True:
        before = dict(label)
        for i, j in near:
            label[i] = label[j] = min(label[i], label[j])
        if before == label:
            break
    links = alike.alike_links(docs, "doc_id", "text", 0.8, most)
    assert {(r["u"], r["v"]) for r in links.collect()} <= set(near)
    got = {r["node"]: r["component"] for r in components(links).collect()}
    assert {i: got.get(i, i) for i in label} == label


def test_near_dedup_finds_appended_and_cut_blocks(spark):
    rows = [(i, t) for i, t in texts_with_block_edits() if i < 6 or 36 <= i < 210]
    at = dict(rows)
    heads = [i for i in at if i >= 36 and i % 6 == 0]
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), "").collect()}
    for h in heads:
        for i in range(h + 1, h + 6):
            if i in at and jaccard(at[h], at[i]) >= 0.8:
                assert i not in kept


def test_near_dedup_keeps_texts_of_like_words_below_the_threshold(spark):
    dice = np.random.default_rng(2)
    words = [f"w{x}" for x in dice.integers(0, 5000, 400)]
    rows = [(0, " ".join(words))]
    for i in range(1, 30):
        new = list(words)
        for at in range(i % 20, 400, 30):  # 13 or 14 single words: about 65 of 396 shingles
            new[at] = f"v{i}_{at}"
        rows.append((i, " ".join(new)))
    assert all(jaccard(a, b) < 0.8 for i, a in rows for j, b in rows if i < j)
    fps = [simhash.fingerprint(t) for _, t in rows]
    alone = {i for i, f in enumerate(fps) if all(i == j or (f ^ g).bit_count() > 4 for j, g in enumerate(fps))}
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert alone and alone <= {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}


def test_texts_below_the_threshold_are_not_compared_in_pairs(spark, monkeypatch):
    """Copies of one text, each changed in its own places: all share keys, few are alike."""
    dice = np.random.default_rng(5)
    words = [f"w{x}" for x in range(150)]
    rows = []
    for i in range(150):
        new = list(words)
        for at in dice.choice(150, 2 if i % 10 == 0 else 3, replace=False):
            new[at] = f"v{i}_{at}"
        rows.append((i, " ".join(new)))
    near = {(i, j) for i, a in rows for j, b in rows if i < j and jaccard(a, b) >= 0.8}
    compared = []
    among = alike.alike_among

    def counted(rows, pairs, share):
        compared.append(pairs.count())
        return among(rows, pairs, share)

    monkeypatch.setattr(alike, "alike_among", counted)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    links = alike.alike_links(docs, "doc_id", "text", 0.8)
    assert {(r["u"], r["v"]) for r in links.collect()} <= near
    groups = lambda pairs: {r["node"]: r["component"] for r in components(pairs).collect()}
    assert groups(links) == groups(spark.createDataFrame(sorted(near), "u bigint, v bigint"))
    assert sum(compared) < 2500, compared  # there are 11,175 pairs


def test_bitmaps_differ_in_no_more_than_their_sets():
    dice = np.random.default_rng(8)
    for n in (1, 30, 70, 300, 1500, 9000):
        a = np.unique(dice.integers(0, 1 << 62, n).astype(np.uint64))
        b = np.unique(np.r_[a[n // 9 :], dice.integers(0, 1 << 62, n // 3).astype(np.uint64)])
        maps = alike.parities([a, b])
        w = min(map(len, maps))
        x, y = alike._folded(maps, w)
        assert all((alike._folded(alike.parities([s]), w)[0] == m).all() for s, m in ((a, x), (b, y)))
        assert int(np.bitwise_count(x ^ y).sum()) <= len(np.setxor1d(a, b))
