"""Quality by a linear-chain conditional random field over lines.

Every line is good or bad.  Its score looks at the line and at its neighbours;
a transition score ties neighbours together.  Forward-backward gives each line
its marginal, and marginals weighted by line length give the document's
quality.
"""

from __future__ import annotations

import operator
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, fold, small_batches, worker_cache
from .numeric import fit_logistic, logistic

#: Bounds of the labelled sample, for each label: documents, bytes of text.
SAMPLE_DOCS = 2000
SAMPLE_BYTES = 16 << 20
THRESHOLD = 0.5

# Classes of bytes, by which lines are measured.
_KINDS = np.zeros(256, np.uint8)
for _kind, _bytes in enumerate(
    [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\r\x0b\x0c", b".,;:?'\"-()", b"!", b"|"],
    start=1,
):
    _KINDS[list(_bytes)] = _kind
_KINDS[128:] = 2  # parts of letters beyond ASCII, mostly
_NKINDS = 8  # 0: other signs

#: A line's own features; its neighbours' follow, and two marks of the borders.
OWN = 13
FEATURES = 3 * OWN + 2


def line_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines of texts, the lines' lengths, and each text's number of lines."""
    docs = [(t or "").encode("utf-8", "surrogatepass").split(b"\n") for t in texts]
    lines = [x for d in docs for x in d]
    n = np.fromiter(map(len, docs), np.int64, len(docs))
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    data = _KINDS[np.frombuffer(b"".join(lines), np.uint8)]
    starts = np.cumsum(size) - size
    out = np.zeros((len(lines), OWN), np.float32)
    full = np.flatnonzero(size)
    for kind in range(_NKINDS):
        if len(full):
            sums = np.add.reduceat((data == kind).astype(np.int32), starts[full])
            out[full, kind] = sums / size[full]
    words = np.zeros((len(lines), 3), np.float32)
    for i in full.tolist():
        w = lines[i].split()
        if w:
            same = sum(map(operator.eq, w, w[1:]))
            words[i] = len(w), len(set(w)) / len(w), same / len(w)
    out[:, 8] = np.log1p(size) / 5
    out[:, 9] = words[:, 1]
    out[:, 10] = words[:, 2]
    out[:, 11] = np.minimum(size / np.maximum(words[:, 0], 1), 40) / 10
    out[:, 12] = size == 0
    first = np.zeros(len(lines), bool)
    last = np.zeros(len(lines), bool)
    first[np.cumsum(n) - n] = True
    last[np.cumsum(n) - 1] = True
    before = np.where(first[:, None], 0, np.roll(out, 1, axis=0))
    after = np.where(last[:, None], 0, np.roll(out, -1, axis=0))
    return np.c_[out, before, after, first, last].astype(np.float64), size, n


class Chains:
    """Documents of different numbers of lines, walked line by line together."""

    def __init__(self, n: np.ndarray):
        self.n, self.start = n, np.cumsum(n) - n
        self.order = np.argsort(-n, kind="stable")
        lengths = n[self.order]
        #: At step t, the documents that still have a line: the first self.alive[t].
        self.alive = np.searchsorted(-lengths, -np.arange(1, (lengths[0] if len(n) else 0) + 1), side="right")

    def at(self, t: int) -> np.ndarray:
        """Line numbers of step t, in self.order."""
        return self.start[self.order[: self.alive[t]]] + t


def _pair(a: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """log sum over the former label of exp(a + trans), for each next label."""
    return np.logaddexp(a[:, :1] + trans[0], a[:, 1:] + trans[1])


def forward_backward(unary: np.ndarray, trans: np.ndarray, chains: Chains):
    """Marginals (lines, 2), expected transitions (2, 2) and log Z of each chain."""
    alpha, beta = np.array(unary), np.zeros_like(unary)
    steps = len(chains.alive)
    for t in range(1, steps):
        now = chains.at(t)
        alpha[now] += _pair(alpha[now - 1], trans)
    for t in range(steps - 1, 0, -1):
        now = chains.at(t)
        beta[now - 1] = _pair(unary[now] + beta[now], trans.T)
    ends = chains.start + chains.n - 1
    z = np.logaddexp(alpha[ends, 0], alpha[ends, 1])
    per_line = np.repeat(z, chains.n)
    marginal = np.exp(alpha + beta - per_line[:, None])
    later = np.ones(len(unary), bool)
    later[chains.start] = False
    i = np.flatnonzero(later)
    joint = alpha[i - 1][:, :, None] + trans + (unary[i] + beta[i])[:, None, :] - per_line[i][:, None, None]
    return marginal, np.exp(joint).sum(axis=0), z


class LineCRF:
    """weights of a line being good, and transition scores [former, next]."""

    def __init__(self, weights, trans, scale, calibration):
        self.weights, self.trans, self.scale, self.calibration = weights, trans, scale, calibration

    def _unary(self, x):
        good = (x / self.scale) @ self.weights[:-1] + self.weights[-1]
        return np.c_[np.zeros(len(x)), good]

    def document_margins(self, texts: list[str | None]) -> np.ndarray:
        """Log-odds of the length-weighted mean marginal of each text's lines."""
        if not texts:
            return np.zeros((0, 1))
        x, size, n = line_features(texts)
        chains = Chains(n)
        marginal, _, _ = forward_backward(self._unary(x), self.trans, chains)
        weight = size + 1.0
        doc = np.repeat(np.arange(len(n)), n)
        mean = np.bincount(doc, weight * marginal[:, 1], len(n)) / np.bincount(doc, weight, len(n))
        mean = np.clip(mean, 1e-4, 1 - 1e-4)
        return np.log(mean / (1 - mean))[:, None]

    def score(self, texts: list[str | None]) -> np.ndarray:
        return logistic(self.document_margins(texts), self.calibration)


def train(rows: list[tuple[str, int]], rounds: int = 150, rate: float = 0.1, ridge: float = 1e-3) -> LineCRF:
    """Fit on (text, label): every line starts with its document's label.

    Half-way, lines of bad documents that the field itself finds good are
    relabelled, as such documents hold ordinary lines too.  Adam steps; the
    mean margin of a document is calibrated at the end.
    """
    texts, labels = [t for t, _ in rows], np.array([label for _, label in rows], int)
    if not texts:
        return LineCRF(np.zeros(FEATURES + 1), np.zeros((2, 2)), np.ones(FEATURES), np.zeros(2))
    x, size, n = line_features(texts)
    scale = np.maximum(np.sqrt((x**2).mean(axis=0)), 1e-3)
    xs = np.c_[x / scale, np.ones(len(x))]
    chains = Chains(n)
    # Both labels weigh alike, and a document as much as another.
    share = np.bincount(labels, minlength=2)
    cost = np.repeat(1 / np.maximum(share[labels], 1) / np.sqrt(n), n)
    cost /= cost.sum()
    y = np.repeat(labels, n)
    later = np.ones(len(x), bool)
    later[chains.start] = False
    i = np.flatnonzero(later)
    w, trans = np.zeros(FEATURES + 1), np.zeros((2, 2))
    m, v = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    for step in range(1, rounds + 1):
        unary = np.c_[np.zeros(len(x)), xs @ w]
        marginal, pairs, _ = forward_backward(unary, trans, chains)
        if step == rounds // 2:
            y = np.where((np.repeat(labels, n) == 0) & (marginal[:, 1] > 0.5), 1, np.repeat(labels, n))
        slope = xs.T @ (cost * (marginal[:, 1] - y)) + ridge * np.r_[w[:-1], 0]
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[i - 1], y[i]), 1)
        slope_trans = (pairs - seen) / max(1, len(i)) + ridge * trans
        g = np.r_[slope, slope_trans.ravel()]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w -= move[: len(w)]
        trans -= move[len(w) :].reshape(2, 2)
    field = LineCRF(w, trans, scale, np.zeros(2))
    field.calibration = fit_logistic(field.document_margins(texts), labels.astype(float))
    return field


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample_docs: int = SAMPLE_DOCS,
    sample_bytes: int = SAMPLE_BYTES,
) -> LineCRF:
    """Fit on at most sample_docs documents of each label, at most sample_bytes of text each.

    Documents are taken in the order of a hash of their ids.  Labels but 0 and
    1, null ids and labels of absent documents are left out; a document with
    both labels is bad.  Without any label, or any document, every score is 0.5.
    Ids are bigint; other columns are not looked at.  A text is scored whole, in
    memory in proportion to its lines.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("label"))
    rows = []
    for label in (0, 1):
        few = bounded_sample(known.where(F.col("label") == label).select("id"), docs, id_col, text_col, sample_docs, sample_bytes)
        rows += [(text, label) for _, text in few]
    return train(rows)


_fields = worker_cache()


def quality_score(spark, field: LineCRF, text: Column) -> Column:
    """A column of scores, 1 for good; null and empty texts are one empty line."""
    small_batches(spark)
    held, token = spark.sparkContext.broadcast(field), uuid.uuid4().hex

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        if token not in _fields:
            _fields.clear()
            _fields[token] = held.value
        return pa.array(_fields[token].score(texts.to_pylist()), pa.float64())

    return score(text)


def op3_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold(F.col("doc_id"), 3) != 1)
    field = fit_quality(docs, labels)
    scored = docs.select(
        "doc_id",
        (fold(F.col("doc_id"), 3) == 1).alias("held_out"),
        quality_score(spark, field, F.col("text")).alias("score"),
    )
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
