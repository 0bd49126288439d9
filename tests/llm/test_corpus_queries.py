"""The registered queries: SQL where there is some, brute force or held-out accuracy elsewhere."""

import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skein.llm import registry
from skein.llm.common import settle

SQL = registry.oracle_sql()
QUERIES = registry.queries()


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(name, spark, sf_dir, same_rows):
    same_rows(QUERIES[name](spark, sf_dir), SQL[name])


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


def held_out(doc_id, parts, fold):
    return zlib.crc32(str(doc_id).encode()) % parts == fold


def test_op1_components_by_brute_force(spark, sf_dir):
    rows = QUERIES["op1_simhash_near_dedup"](spark, sf_dir).collect()
    ids = np.array([r["doc_id"] for r in rows])
    fps = np.array([int(r["fingerprint"], 16) for r in rows], np.uint64)
    label = dict(zip(ids.tolist(), ids.tolist(), strict=True))
    moved = True
    while moved:
        moved = False
        for i in range(len(ids)):
            near = ids[np.bitwise_count(fps ^ fps[i]) <= 4].tolist()
            least = min(label[x] for x in near)
            for x in near:
                if label[x] > least:
                    label[x], moved = least, True
    assert {r["doc_id"]: r["component_id"] for r in rows} == label


def test_op3_held_out_accuracy(spark, sf_dir):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = QUERIES["op3_quality"](spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(r["held_out"] == held_out(r["doc_id"], 3, 1) and 0 <= r["score"] <= 1 for r in rows)
    test = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in test]) > 0.9


def test_op10_scores(spark, sf_dir):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = QUERIES["op10_toxicity"](spark, sf_dir).collect()
    assert all(r["held_out"] == held_out(r["doc_id"], 4, 2) and 0 <= r["score"] <= 1 for r in rows)
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in rows)
    train = [r for r in rows if not r["held_out"] and r["doc_id"] in labels]
    toxic = np.mean([r["score"] for r in train if labels[r["doc_id"]]])
    assert toxic > 2 * np.mean([r["score"] for r in train if not labels[r["doc_id"]]])


def test_op10_held_out_recall(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op10_toxicity"](spark, sf).collect() if r["held_out"] and r["doc_id"] in labels]
    caught = np.mean([r["predicted"] for r in rows if labels[r["doc_id"]]])
    assert caught >= 0.9 and np.mean([r["predicted"] for r in rows if not labels[r["doc_id"]]]) < 0.03


def test_op9_base_by_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    table = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    tokens = {r["doc_id"]: [*(r["text"] or "").encode().translate(table).split(), None] for r in docs}
    counts = Counter(w for d, ws in tokens.items() if not held_out(d, 5, 1) for w in ws)
    n, v = sum(counts.values()), len(counts)
    rows = QUERIES["op9_lm_scoring"](spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ws = tokens[r["doc_id"]]
        assert (r["n_tokens"], r["train_tokens"], r["held_out"]) == (len(ws), n, held_out(r["doc_id"], 5, 1))
        assert r["n_known"] == sum(counts[w] > 0 for w in ws)
        assert r["base_score"] == pytest.approx(sum(log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws))
    test = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in test) > sum(r["base_score"] for r in test)


def test_op6_budgets_by_brute_force(spark, sf_dir):
    from skein.llm.mixing import MAX_EPOCHS, WEIGHTS, leaf_budgets

    rows = QUERIES["op6_mixing"](spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    leaves = {}
    for r in rows:
        leaves.setdefault((r["domain"], r["lang"], r["source"]), []).append(r)
    given = leaf_budgets({k: sum(r["n_tokens"] for r in v) for k, v in leaves.items()}, sum(r["n_tokens"] for r in rows), WEIGHTS, MAX_EPOCHS)
    assert sum(given.values()) == pytest.approx(sum(r["n_tokens"] for r in rows))
    for leaf, docs in leaves.items():
        epochs, rest = divmod(given[leaf], sum(r["n_tokens"] for r in docs))
        ids = spark.createDataFrame([(int(r["doc_id"]), r["n_tokens"]) for r in docs], "doc_id bigint, n bigint")
        key = F.xxhash64(F.lit(17), F.lit(int(epochs)).cast("bigint"), "doc_id")
        place = F.shiftrightunsigned(key, 48)  # bins are cut from the top bits, unsigned
        run, want = 0, {}
        for r in ids.withColumn("p", place).withColumn("k", key).orderBy("p", "k", "doc_id").collect():
            run += r["n"]
            want[r["doc_id"]] = int(epochs) + (run <= int(rest))
        assert {r["doc_id"]: r["copies"] for r in docs} == want


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = settle(stage(spark, docs, sf_dir), name)
        assert 0 < docs.count() <= before.count()
        assert docs.select("doc_id").exceptAll(before.select("doc_id")).isEmpty()
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "mixing"]
    whole = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, docs.collect()))
