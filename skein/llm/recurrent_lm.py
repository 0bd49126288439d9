"""Scoring texts with a gated recurrent language model.

Words are counted over all training documents.  The most frequent ones are the
model's vocabulary, in classes; all others share a class with words of their
form, within which their smoothed count decides.  So every text, rare and
unseen words included, has a probability.

The model is a gated recurrent unit in numpy.  Its softmax is factored: first
the class, then the word within it.  Tasks train copies by truncated
backpropagation on their documents, and the copies are averaged.  Scoring
carries the state from window to window, from a document's first token to its
end.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, hold, small_batches
from .tokens import Tokens, hash_words, types_of, word_hash

END = b"\n"  # no word holds white space
SEED = 42
#: Words of the model's own vocabulary, and classes of them.
VOCABULARY = 2048
WORD_CLASSES = 32
#: Words whose counts go to every task; the rest meet their counts in a join.
CARRIED = 1 << 19
HIDDEN = 16
LANES, WINDOW = 256, 32
#: Windows of a stream at least: a short one is cut into fewer lanes, for as many steps.
LEAST_WINDOWS = 16
#: Each training document is in one of so many rounds, and passed over once there.
ROUNDS = 2
#: About so many tokens make a copy in a round, at every size of the corpus.
COPY_TOKENS = 1_000_000
#: Copies that are averaged in one group at most; more are averaged in a tree.
MOST_COPIES = 64
RATE = 0.008
#: Tokens that are scored, or trained on, at once.
BUFFER = 1 << 20
_BLOCK = 2048
#: States whose softmax is taken at once, so that it stays in a core's cache.
_ROWS = 1 << 11
SHAPES = 32
_LETTERS = re.compile(rb"[a-z\x80-\xff]+")


#: Of a byte: 0 a-z, 1 beyond ASCII, 3 an outer sign, 2 any other.
_KIND = np.array([1 if c >= 128 else 0 if 97 <= c <= 122 else 3 if c in b".,;:!?" else 2 for c in range(256)], np.uint8)


def shapes(tokens: Tokens, at: np.ndarray) -> np.ndarray:
    """shape() of the words with these numbers."""
    size = tokens.ends[at] - tokens.starts[at]
    edge = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(edge, size)
    kind = _KIND[tokens.data[np.repeat(tokens.starts[at], size) + place]]
    if not len(at):
        return np.zeros(0, np.int32)
    body = np.maximum.reduceat(np.where(kind == 3, 0, place + 1), edge)
    strange = np.add.reduceat((kind >= 2) & (place < np.repeat(body, size)), edge, dtype=np.int64)
    beyond = np.maximum.reduceat(kind == 1, edge)
    length = np.searchsorted([4, 7, 11], body, side="left")
    return (length + 4 * beyond + 8 * (body < size) + 16 * ((strange > 0) | (body == 0))).astype(np.int32)


def shape(word: bytes) -> int:
    """The form class of a word: script, length, outer and inner signs."""
    body = word.rstrip(b".,;:!?")
    n = len(body)
    size = 0 if n <= 4 else 1 if n <= 7 else 2 if n <= 11 else 3
    return size + 4 * (not word.isascii()) + 8 * (len(body) < len(word)) + 16 * (not _LETTERS.fullmatch(body))


# ---- counts -----------------------------------------------------------------


def _count(batches):
    """Partial counts (hash, shape, n) of tokens."""
    for table in _buffers(batches):
        texts = table.column(0).combine_chunks()
        tokens = Tokens(texts)
        local, types, first = types_of(tokens.hashes())
        columns = np.r_[types, word_hash(END)], np.r_[shapes(tokens, first), shape(END)], np.r_[np.bincount(local, minlength=len(types)), len(texts)]
        yield pa.record_batch([pa.array(c.astype(k)) for c, k in zip(columns, (np.int64, np.int32, np.int64), strict=True)], ["hash", "shape", "n"])


def token_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(hash, shape, n) of each distinct token of docs, the end included."""
    small_batches(docs.sparkSession)
    parts = docs.select(text_col).mapInArrow(_count, "hash bigint, shape int, n bigint")
    return parts.groupBy("hash").agg(F.min("shape").alias("shape"), F.sum("n").alias("n"))


class Lexicon:
    """Counts and classes of the carried words, totals of all others."""

    def __init__(self, hashes, counts, shapes, total, types, shape_total, shape_types, vocabulary, word_classes):
        order = np.argsort(hashes)
        self.hashes, self.counts, shapes = hashes[order], counts[order], shapes[order]
        if len(counts) and counts.max() < 1 << 31:
            self.counts = self.counts.astype(np.int32)  # half the size of what goes to every task
        self.total, self.types = int(total), int(types)
        # The vocabulary: the most frequent words, ties by hash.
        top = np.lexsort((self.hashes, -self.counts))[:vocabulary]
        mass = np.cumsum(np.sqrt(self.counts[top].astype(float))) if len(top) else np.zeros(0)
        group = np.minimum((mass / max(mass[-1] if len(top) else 1, 1) * word_classes).astype(int), word_classes - 1)
        self.starts = np.searchsorted(group, np.arange(word_classes + 1))  # words of a class are neighbours
        self.word_class = group
        self.words = len(top)
        self.classes = word_classes + SHAPES
        # number[i]: of the i-th carried word: its vocabulary number, or vocabulary + shape.
        self.number = (self.words + shapes).astype(np.int32)
        self.number[top] = np.arange(self.words)
        self.top_counts = self.counts[top]
        left = np.array(shape_total, float)
        kinds = np.array(shape_types, float)
        np.subtract.at(left, shapes[top], self.counts[top])
        np.subtract.at(kinds, shapes[top], 1)
        self.shape_total, self.shape_types = left, kinds
        self.base_scale = math.log10(self.total + 0.5 * (self.types + 1))
        self.shape_scale = np.log10(left + 0.5 * (kinds + 1))
        number = word_hash(END)
        at = np.searchsorted(self.hashes, number)
        found = at < len(self.hashes) and self.hashes[at] == number
        self.end = int(self.number[at]) if found else self.words + shape(END)
        self.end_count = int(self.counts[at]) if found else -1

    def class_of(self, ids: np.ndarray) -> np.ndarray:
        """Classes of token numbers; those of forms follow those of words."""
        words = self.words
        known = np.minimum(ids, max(words - 1, 0))
        own = self.word_class[known] if words else np.zeros(len(ids), np.int64)
        return np.where(ids < words, own, ids - words + self.classes - SHAPES)


def fit_lexicon(counts: DataFrame, vocabulary: int, word_classes: int, carried: int) -> Lexicon:
    """counts must be held.  At most `carried` words come to the driver."""
    forms = counts.groupBy("shape").agg(F.sum("n"), F.count("*")).collect()
    shape_total, shape_types = np.zeros(SHAPES), np.zeros(SHAPES)
    for s, n, k in forms:
        shape_total[s], shape_types[s] = n, k
    # Counts by eighths of powers of two: a small histogram at any size.
    step = F.floor(F.log2("n") * 8).cast("int")
    sizes = sorted(counts.groupBy(step.alias("step")).count().collect(), reverse=True)
    least, taken = None, 0
    for s, k in sizes:
        if taken + k > carried:
            break
        least, taken = s, taken + k
    few = counts.where(step >= (least if least is not None else 1 << 20)).toArrow()
    return Lexicon(
        few.column("hash").to_numpy(),
        few.column("n").to_numpy(),
        few.column("shape").to_numpy(),
        shape_total.sum(),
        shape_types.sum(),
        shape_total,
        shape_types,
        vocabulary,
        word_classes,
    )


class Reading:
    """Texts as token numbers: each token's type, and of the types what the lexicon knows."""

    def __init__(self, lexicon: Lexicon, texts: pa.Array):
        tokens = Tokens(texts)
        words, types, first = types_of(tokens.hashes())
        at = np.searchsorted(lexicon.hashes, types)
        at[at == len(lexicon.hashes)] = 0
        has = lexicon.hashes[at] == types if len(lexicon.hashes) else np.zeros(len(types), bool)
        ids, counts = np.empty(len(types), np.int32), np.full(len(types), -1, np.int64)  # -1: not carried
        ids[has], counts[has] = lexicon.number[at[has]], lexicon.counts[at[has]]
        ids[~has] = lexicon.words + shapes(tokens, first[~has])
        #: Numbers, counts and hashes of types; the last type is the end.
        self.types_ids, self.types_counts = np.r_[ids, lexicon.end].astype(np.int32), np.r_[counts, lexicon.end_count]
        self.hashes = np.r_[types, word_hash(END)]
        #: Tokens of each text, the end included; the type of each token; its number.
        self.n = tokens.n + 1
        self.local = np.full(int(self.n.sum()), len(types), np.int64)
        inner = np.ones(len(self.local), bool)
        inner[np.cumsum(self.n) - 1] = False
        self.local[inner] = words
        self.ids = self.types_ids[self.local]


# ---- the model --------------------------------------------------------------


def _sigmoid(x):
    """In place; float32 exponents stay in range."""
    np.negative(np.clip(x, -30, 30, out=x), out=x)
    np.exp(x, out=x)
    x += 1
    np.reciprocal(x, out=x)


class Gru:
    """Weights as one flat float32 array, seen as matrices by name."""

    def __init__(self, words: int, starts: np.ndarray, classes: int, hidden: int, flat: np.ndarray | None = None):
        self.words, self.starts, self.classes, self.hidden = words, starts, classes, hidden
        h = hidden
        self.shapes = {
            "x": (words + SHAPES, 3 * h),  # what a token adds to the update, reset and new gates
            "u": (h, 2 * h),
            "v": (h, h),
            "b": (3 * h,),
            "cw": (h, classes),
            "cb": (classes,),
            "ww": (h, max(words, 1)),
            "wb": (max(words, 1),),
        }
        size = sum(int(np.prod(s)) for s in self.shapes.values())
        self.flat = np.zeros(size, np.float32) if flat is None else np.array(flat, np.float32)
        at = 0
        for name, s in self.shapes.items():
            n = int(np.prod(s))
            setattr(self, name, self.flat[at : at + n].reshape(s))
            at += n

    def like(self, flat: np.ndarray) -> Gru:
        return Gru(self.words, self.starts, self.classes, self.hidden, flat)

    def step(self, add: np.ndarray, h: np.ndarray):
        """The next state, and what backpropagation needs of this step."""
        k = self.hidden
        zr = h @ self.u
        zr += add[:, : 2 * k]
        _sigmoid(zr)
        z, r = zr[:, :k], zr[:, k:]
        rh = r * h
        new = rh @ self.v
        new += add[:, 2 * k :]
        np.tanh(new, out=new)
        out = h - new
        out *= z
        out += new
        return out, (z, r, rh, new, h)

    @staticmethod
    def _softmax(w, bias, states, targets, grad=None):
        """Log-probabilities of the targets; with grad, (d w, d bias, d states) of minus their sum.

        states: (targets, hidden), each entry in [-1, 1].  Logits are shifted by
        a bound of theirs, so exponents need no search for the largest.
        """
        rows = np.arange(len(targets))
        shifted = bias - (bias + np.abs(w).sum(axis=0)).max()
        p = np.concatenate([w, shifted[None, :]]).T @ np.concatenate([states.T, np.ones((1, len(rows)), np.float32)])
        logs = p[targets, rows]
        np.exp(p, out=p)
        z = np.maximum(p.sum(axis=0), 1e-37)
        logs -= np.log(z)
        if grad is None:
            return logs, None
        p[targets, rows] -= z
        share = 1 / z
        return logs, ((states * share[:, None]).T @ p.T, p @ share, (p.T @ w.T) * share[:, None])

    def log_probs(self, states: np.ndarray, classes: np.ndarray, ids: np.ndarray, grad: Gru | None = None):
        """Natural log-probabilities of targets; with grad, also d(-sum)/d(states), adding to grad."""
        out = np.empty(len(ids), np.float32)
        back = None if grad is None else np.empty_like(states)
        for i in range(0, len(ids), _ROWS):
            at = slice(i, i + _ROWS)
            out[at], got = self._softmax(self.cw, self.cb, states[at], classes[at], grad)
            if grad is not None:
                grad.cw += got[0]
                grad.cb += got[1]
                back[at] = got[2]
        known = np.flatnonzero(ids < self.words)
        known = known[np.argsort(classes[known], kind="stable")]
        edges = np.searchsorted(classes[known], np.arange(len(self.starts)))
        sorted_states, sorted_ids = states[known], ids[known]
        for c in range(len(self.starts) - 1):
            i, j = edges[c], edges[c + 1]
            a, b = self.starts[c], self.starts[c + 1]
            if i == j or b - a < 2:
                continue
            logs, got = self._softmax(self.ww[:, a:b], self.wb[a:b], sorted_states[i:j], sorted_ids[i:j] - a, grad)
            out[known[i:j]] += logs
            if grad is not None:
                grad.ww[:, a:b] += got[0]
                grad.wb[a:b] += got[1]
                back[known[i:j]] += got[2]
        return out, back


def first_model(lexicon: Lexicon, hidden: int = HIDDEN) -> Gru:
    """Random small weights; biases give every word its share in the corpus."""
    model = Gru(lexicon.words, lexicon.starts, lexicon.classes, hidden)
    dice = np.random.default_rng(SEED)
    for name in ("x", "u", "v", "cw", "ww"):
        m = getattr(model, name)
        m[...] = dice.normal(0, 0.1 if name != "x" else 0.3, m.shape)
    if lexicon.words:
        model.wb[...] = np.log(lexicon.top_counts)
    mass = np.zeros(lexicon.classes)
    np.add.at(mass, lexicon.word_class, lexicon.top_counts)
    mass[-SHAPES:] = np.maximum(lexicon.shape_total, 0)
    model.cb[...] = np.log(mass + 0.5) - np.log((mass + 0.5).sum())
    return model


class Trainer:
    """Truncated backpropagation over parallel lanes, with Adam steps."""

    def __init__(self, model: Gru, lexicon: Lexicon, rate: float = RATE, lanes: int = LANES, window: int = WINDOW, windows: int = 1):
        self.model, self.lexicon, self.rate, self.lanes, self.window, self.windows = model, lexicon, rate, lanes, window, windows
        self.m, self.v = np.zeros_like(model.flat), np.zeros_like(model.flat)
        self.grad = model.like(self.m)
        self.steps = 0

    def run(self, ids: np.ndarray) -> float:
        """One pass over a stream of token numbers; gives the mean log-probability.

        The stream is cut into lanes.  A lane's state goes on from window to
        window, and starts anew after an end.
        """
        lanes = max(1, min(self.lanes, len(ids) // (self.window * self.windows)))
        n = len(ids) // lanes
        stream = ids[: lanes * n].reshape(lanes, n)
        before = np.c_[np.full((lanes, 1), self.lexicon.end), stream[:, :-1]]
        h = np.zeros((lanes, self.model.hidden), np.float32)
        total = 0.0
        for at in range(0, n, self.window):
            got, h = self._window(before[:, at : at + self.window], stream[:, at : at + self.window], h)
            total += got
        return total / max(1, lanes * n)

    def _window(self, inputs: np.ndarray, targets: np.ndarray, h: np.ndarray):
        model, k = self.model, self.model.hidden
        lanes, steps = inputs.shape
        grad = self.grad
        grad.flat[grad.x.size :] = 0
        tokens = inputs.T
        fresh = (tokens == self.lexicon.end)[:, :, None]
        states, kept = np.empty((steps, lanes, k), np.float32), []
        for t in range(steps):
            h, cache = model.step(model.x[tokens[t]] + model.b, h * ~fresh[t])
            states[t] = h
            kept.append(cache)
        flat = targets.T.ravel()
        logs, back = model.log_probs(states.reshape(-1, k), self.lexicon.class_of(flat), flat, grad)
        back = back.reshape(steps, lanes, k)
        d_add = np.empty((steps, lanes, 3 * k), np.float32)
        dh = np.zeros((lanes, k), np.float32)
        for t in range(steps - 1, -1, -1):
            z, r, rh, new, old = kept[t]
            dh += back[t]
            keep = dh * z
            d_new, d_zr = d_add[t, :, 2 * k :], d_add[t, :, : 2 * k]
            np.multiply(dh - keep, 1 - new * new, out=d_new)
            d_rh = d_new @ model.v.T
            np.multiply((keep - keep * z), old - new, out=d_zr[:, :k])
            np.multiply(d_rh * rh, 1 - r, out=d_zr[:, k:])
            dh = (keep + d_rh * r + d_zr @ model.u.T) * ~fresh[t]
        every = d_add.reshape(-1, 3 * k)
        grad.u += np.concatenate([x[4] for x in kept]).T @ every[:, : 2 * k]
        grad.v += np.concatenate([x[2] for x in kept]).T @ every[:, 2 * k :]
        grad.b += every.sum(axis=0)
        where = tokens.ravel()
        order = np.argsort(where, kind="stable")
        edge = np.flatnonzero(np.r_[True, np.diff(where[order]) > 0])
        self.seen = where[order[edge]]
        grad.x[self.seen] = np.add.reduceat(every[order], edge, axis=0) / flat.size
        grad.flat[grad.x.size :] /= flat.size
        self._adam(grad.flat)
        grad.x[self.seen] = 0
        return float(logs.sum()), h

    def _adam(self, g: np.ndarray):
        """A step along the gradient g; of the input weights, only those of tokens seen have one and move."""
        x, seen = self.model.x.size, self.seen
        of = lambda whole: whole[:x].reshape(self.model.x.shape)
        rows, rest = of(g)[seen], g[x:]
        size = float(np.sqrt((rows * rows).sum() + rest @ rest))
        self.steps += 1
        scale = self.rate * math.sqrt(1 - 0.99**self.steps) / (1 - 0.9**self.steps)
        m, v = of(self.m)[seen], of(self.v)[seen]
        self.model.x[seen] -= self._moved(rows, m, v, size, scale)
        of(self.m)[seen], of(self.v)[seen] = m, v
        self.model.flat[x:] -= self._moved(rest, self.m[x:], self.v[x:], size, scale)

    @staticmethod
    def _moved(g, m, v, size: float, scale: float):
        """How far weights go; g is used up, m and v move on."""
        if size > 1:
            g /= size
        m *= 0.9
        m += 0.1 * g
        g *= g
        g *= 0.01
        v *= 0.99
        v += g
        np.sqrt(v, out=g)
        g += 1e-6
        np.divide(m, g, out=g)
        g *= scale
        return g


def document_log_probs(model: Gru, lexicon: Lexicon, ids: np.ndarray, n: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Natural log-probability of each document's tokens, forms standing for rare words.

    Documents run side by side, the longest first; each carries its state
    through all its windows.
    """
    start = np.cumsum(n) - n
    order = np.argsort(-n, kind="stable")
    lengths, start = n[order], start[order]
    out = np.zeros(len(n))
    h = np.zeros((len(n), model.hidden), np.float32)
    longest = int(lengths[0]) if len(n) else 0
    gates = model.x + model.b
    for at in range(0, longest, window):
        live = int(np.searchsorted(-lengths, -at, side="left"))
        h = h[:live]
        steps = min(window, longest - at)
        states, rows = [], []
        for t in range(at, at + steps):
            now = int(np.searchsorted(-lengths, -t, side="left"))
            if not now:
                break
            before = ids[start[:now] + t - 1] if t else np.full(now, lexicon.end)
            nxt, _ = model.step(gates[before], h[:now])
            h = np.concatenate([nxt, h[now:]]) if now < len(h) else nxt
            states.append(nxt)
            rows.append(np.arange(now))
        rows = np.concatenate(rows)
        step = np.repeat(np.arange(at, at + len(states)), [len(s) for s in states])
        target = ids[start[rows] + step]
        states = np.concatenate(states)
        logs, _ = model.log_probs(states, lexicon.class_of(target), target)
        out[order[:live]] += np.bincount(rows, logs, live)
    return out


# ---- on a cluster -----------------------------------------------------------


def _buffers(batches):
    """Batches joined until their texts, the first column, hold about BUFFER tokens."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.column(0).nbytes // 6
        if size >= BUFFER:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _copies(book, weights, rate: float):
    def run(batches):
        lexicon, (hidden, flat) = book.value, weights.value
        model = Gru(lexicon.words, lexicon.starts, lexicon.classes, hidden, flat)
        trainer, tokens = Trainer(model, lexicon, rate, windows=LEAST_WINDOWS), 0
        for table in _buffers(batches):
            ids = Reading(lexicon, table.column(0).combine_chunks()).ids
            trainer.run(ids)
            tokens += len(ids)
        if tokens:
            cuts = [model.flat[i : i + _BLOCK] for i in range(0, len(model.flat), _BLOCK)]
            yield pa.record_batch(
                [
                    pa.array(range(len(cuts)), pa.int32()),
                    pa.array([TaskContext.get().partitionId()] * len(cuts), pa.int32()),
                    pa.array([float(tokens)] * len(cuts), pa.float64()),
                    pa.array([c.tobytes() for c in cuts], pa.binary()),
                ],
                _BLOCK_NAMES,
            )

    return run


_BLOCKS = "block int, copy int, tokens double, weights binary"
_BLOCK_NAMES = [x.split()[0] for x in _BLOCKS.split(", ")]


def _mean_block(table: pa.Table) -> pa.Table:
    """The mean of one block of a group of copies, by their tokens; there are MOST_COPIES at most."""
    weight = np.array(table.column("tokens").to_pylist())
    values = np.stack([np.frombuffer(x, np.float32) for x in table.column("weights").to_pylist()])
    mean = (values * (weight / weight.sum())[:, None]).sum(axis=0).astype(np.float32)
    at = [table.column("block")[:1], table.column("copy")[:1], pa.array([weight.sum()]), pa.array([mean.tobytes()], pa.binary())]
    return pa.table(at, names=_BLOCK_NAMES)


def average(trained: DataFrame, copies: int) -> list[tuple[int, bytes]]:
    """(block, weights) of the mean of all copies; groups of MOST_COPIES are averaged first, then their means."""
    while True:
        group = F.expr(f"copy div {MOST_COPIES}").cast("int")
        trained = trained.withColumn("copy", group).groupBy("block", "copy").applyInArrow(_mean_block, _BLOCKS)
        copies = -(-copies // MOST_COPIES)
        if copies == 1:
            return [(r["block"], r["weights"]) for r in trained.collect()]


def train_model(
    docs: DataFrame, lexicon: Lexicon, book, id_col: str = "doc_id", text_col: str = "text", hidden: int = HIDDEN
) -> Gru:
    """Train on all documents, dealt to rounds by a hash of their ids, in averaged copies.

    Every document is in one round, at every size of docs; larger inputs have
    more copies, in proportion.  book is a broadcast of the lexicon.
    """
    model = first_model(lexicon, hidden)
    turn = F.coalesce(F.pmod(F.xxhash64(F.lit("train"), id_col), F.lit(ROUNDS)), F.lit(0))
    for i in range(ROUNDS):
        part = docs.where(turn == i).select(text_col)
        copies = int(max(1, lexicon.total / ROUNDS // COPY_TOKENS))
        held = docs.sparkSession.sparkContext.broadcast((hidden, model.flat))
        # Dealt in turn, not by a key: every copy costs its weights once more.
        trained = part.repartition(copies).mapInArrow(_copies(book, held, RATE / (1 + i)), _BLOCKS)
        means = average(trained, copies)
        if means:
            flat = np.concatenate([np.frombuffer(w, np.float32) for _, w in sorted(means)])
            model = model.like(flat)
        held.unpersist()
    return model


def _score(book, weights):
    """Per document its sums over carried words, and a row for each of its other words."""

    def run(batches):
        lexicon, (hidden, flat) = book.value, weights.value
        model = Gru(lexicon.words, lexicon.starts, lexicon.classes, hidden, flat)
        key = TaskContext.get().partitionId() << 40
        for table in _buffers(batches):
            read = Reading(lexicon, table.column(0).combine_chunks())
            local, n, ids, counts = read.local, read.n, read.ids, read.types_counts[read.local]
            logs = document_log_probs(model, lexicon, ids, n) / math.log(10)
            doc = np.repeat(np.arange(len(n)), n)
            keys = key + np.arange(len(n))
            key += len(n)
            carried = counts >= 0
            own = np.where(carried, np.log10(np.maximum(counts, 0) + 0.5), 0)
            base = np.where(carried, own - lexicon.base_scale, 0)
            form = ids - lexicon.words
            rare = carried & (form >= 0)
            own = np.where(rare, own - lexicon.shape_scale[np.maximum(form, 0)], 0)
            k = len(n)
            yield pa.record_batch(
                [
                    pa.array(keys),
                    table.column(1).combine_chunks(),
                    table.column(2).combine_chunks(),
                    pa.array(n),
                    pa.array(np.bincount(doc, carried, k).astype(np.int64)),
                    pa.array(np.bincount(doc, base, k)),
                    pa.array(logs + np.bincount(doc, own, k)),
                    pa.nulls(k, pa.int64()),
                    pa.nulls(k, pa.int32()),
                ],
                _PART_NAMES,
            )
            # Other words: a row for each distinct one of a document.
            at = np.flatnonzero(~carried)
            if len(at):
                pairs, times = np.unique(doc[at] * len(read.hashes) + local[at], return_counts=True)
                which, kind = np.divmod(pairs, len(read.hashes))
                m = len(pairs)
                yield pa.record_batch(
                    [
                        pa.array(keys[which]),
                        pa.nulls(m, pa.int64()),
                        pa.nulls(m, pa.bool_()),
                        pa.array(times.astype(np.int64)),
                        pa.nulls(m, pa.int64()),
                        pa.nulls(m, pa.float64()),
                        pa.nulls(m, pa.float64()),
                        pa.array(read.hashes[kind]),
                        pa.array((read.types_ids[kind] - lexicon.words).astype(np.int32)),
                    ],
                    _PART_NAMES,
                )

    return run


_PARTS = (
    "key bigint, doc_id bigint, held_out boolean, n bigint, n_known bigint, "
    "base double, score double, hash bigint, shape int"
)
_PART_NAMES = [x.split()[0] for x in _PARTS.split(", ")]


def score_texts(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row.

    held_out: a boolean column; the model and all counts learn from the other
    rows.  Null texts are empty: the end is their one token.  Rows that repeat
    an id are scored each; rows with null ids are trained on like others.  Ids
    are bigint.  Without any training row every word is unseen; no rows give no
    rows; other columns are not looked at.  A long text is one document, however
    long, and takes memory in proportion.  Scores are log10 of probabilities.
    Words are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(
        F.col(text_col).alias("text"), F.col(id_col).cast("bigint").alias("doc_id"), held_out.alias("held_out")
    )
    train = rows.where(~F.col("held_out"))
    counts = hold(token_counts(train))
    lexicon = fit_lexicon(counts, VOCABULARY, WORD_CLASSES, CARRIED)
    book = spark.sparkContext.broadcast(lexicon)
    model = train_model(train, lexicon, book)
    weights = spark.sparkContext.broadcast((model.hidden, model.flat))
    parts = hold(rows.mapInArrow(_score(book, weights), _PARTS))
    # Filled before two branches read it, which would wait for each other's tasks.
    parts.count()
    whole = parts.where("hash IS NULL").drop("hash", "shape")
    scales = F.array(*[F.lit(float(x)) for x in lexicon.shape_scale])
    others = (
        parts.where("hash IS NOT NULL")
        .select("key", "n", "hash", "shape")
        .join(counts.select("hash", F.col("n").alias("c")), "hash", "left")
        .select("key", "n", F.coalesce("c", F.lit(0)).alias("c"), F.log10(F.coalesce("c", F.lit(0)) + 0.5).alias("own"), "shape")
        .select(
            "key",
            F.lit(None).cast("bigint").alias("doc_id"),
            F.lit(None).cast("boolean").alias("held_out"),
            F.lit(None).cast("bigint").alias("n"),
            F.when(F.col("c") > 0, F.col("n")).otherwise(F.lit(0)).alias("n_known"),
            (F.col("n") * (F.col("own") - F.lit(lexicon.base_scale))).alias("base"),
            (F.col("n") * (F.col("own") - F.get(scales, F.col("shape")))).alias("score"),
        )
    )
    return (
        whole.unionByName(others)
        .groupBy("key")
        .agg(
            F.max("doc_id").alias("doc_id"),
            F.max("held_out").alias("held_out"),
            F.max("n").alias("n_tokens"),
            F.sum("n_known").alias("n_known"),
            F.lit(lexicon.total).cast("bigint").alias("train_tokens"),
            F.sum("base").alias("base_score"),
            F.sum("score").alias("score"),
        )
        .drop("key")
    )


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score_texts(docs, fold(F.col("doc_id"), 5) == 1)
