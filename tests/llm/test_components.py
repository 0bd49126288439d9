"""Linking dense groups, and components with hubs."""

import numpy as np
import pytest

from skein.llm import components as C
from skein.llm import simhash
from skein.llm.components import components


def near(base, n, dice):
    """n fingerprints, each at most two bits from base."""
    out = set()
    while len(out) < n:
        f = base
        for b in dice.integers(0, 64, 2).tolist():
            f ^= 1 << b
        out.add(f - (1 << 64) if f >> 63 else f)
    return sorted(out)


@pytest.mark.parametrize("n", [6, 50, 800])
def test_links_of_a_dense_group_grow_with_its_size(spark, n):
    dice = np.random.default_rng(n)
    fps = near(0x123456789ABCDEF0, n, dice)
    reps = spark.createDataFrame([(f, i, 0) for i, f in enumerate(dice.permutation(fps).tolist())], "fp bigint, rep bigint, chk bigint")
    links = {(min(r), max(r)) for r in simhash.fingerprint_links(reps).select("u", "v").collect()}
    assert n - 1 <= len(links) <= 6 * n
    parts = components(spark.createDataFrame(sorted(links), "u bigint, v bigint")).collect()
    assert {r["component"] for r in parts} == {0} and len(parts) == n - 1


def test_hubs_and_chains_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(C, "EDGES_A_TASK", 50)
    monkeypatch.setattr(C, "HEAVY_EDGES", 20)
    monkeypatch.setattr(C, "HEAVY_SHARE", 0)
    dice = np.random.default_rng(1)
    pairs = [(5000, i) for i in range(300)]  # a hub with the largest number
    pairs += [(1000, i) for i in range(1001, 1200)]  # and one with the least
    pairs += [(i, i + 1) for i in range(2000, 2100)]  # a chain
    pairs += [(3000 + i, 3000 + i // 2) for i in range(1, 120)] + [(7, 7)]
    pairs = dice.permutation(pairs).tolist()
    label = {x: x for p in pairs for x in p}
    for _ in label:
        before = dict(label)
        for u, v in pairs:
            label[u] = label[v] = min(label[u], label[v])
        if before == label:
            break
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "u bigint, v bigint")).collect()}
    assert {x: got.get(x, x) for x in label} == label
