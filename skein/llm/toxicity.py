"""Toxicity by class-conditional Kneser-Ney models.

Two models spell the words of a text, one as toxic documents do, one as ordinary
documents do.  Their letters' chain is one Kneser-Ney model of both classes
together; each class has its own counts only on top of it, less a large
discount.  So an expression that is rare in either class backs off to the same
estimate in both and tells nothing.

The two log-likelihoods are compared per word.  Toxic documents hold one to
three toxic words in a hundred, and their language and style move the mean over
all words more than those do.  So the comparison is made over a document's most
telling words, a fixed share of its length.
"""

from __future__ import annotations

import itertools
import pickle
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fit_in_a_task, fold, sampled, small_batches, worker_cache
from .numeric import fit_logistic, logistic

#: Letters of a gram at most, the predicted one included.
ORDER = 7
#: What shared counts lose, and what counts of one class lose.
DISCOUNT, CLASS_DISCOUNT = 0.75, 2.0
#: From this order on a gram that occurs once is only backed off to.
PRUNED = 4
#: The share of a document's words that are its most telling ones.
TAIL = 0.015
#: Bounds of the labelled sample, for each label: documents, bytes of text.
SAMPLE_DOCS = 800
SAMPLE_BYTES = 2 << 20
THRESHOLD = 0.3
FOLDS = 4
#: Distinct words that a worker keeps scores of.
CACHE = 1 << 17

_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Words that are spelled at once.
_SPELLED = 20_000


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, each between a start 2 and an end 3; and their word numbers."""
    text = "".join(["\x02" + w + "\x03" for w in words])
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return codes, np.repeat(np.arange(len(words), dtype=np.int32), [len(w) + 2 for w in words])


def _places(word: np.ndarray) -> np.ndarray:
    """How far each code is from its word's start."""
    edge = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else np.zeros(0, np.int64)
    return np.arange(len(word), dtype=np.int32) - np.repeat(edge.astype(np.int32), np.diff(np.r_[edge, len(word)]))


def _grams(codes: np.ndarray, word: np.ndarray, order: int):
    """For each order: hashes of the n-grams that end at each code, and which are whole.

    A gram never leaves its word, and never ends at the start sign.
    """
    place = _places(word)
    mixed = (codes + np.uint64(1)) * _MIX
    mixed ^= mixed >> np.uint64(31)
    h = np.zeros(len(codes), np.uint64)
    for n in range(1, order + 1):
        back = np.zeros(len(codes), np.uint64)
        if n <= len(codes):
            back[n - 1 :] = mixed[: len(codes) - n + 1]
        h = (h * np.uint64(0x100000001B3)) ^ (back + np.uint64(n))
        yield n, h.copy(), (place >= n - 1) & (place >= 1)


class LetterModel:
    """P(word | class) letter by letter, for classes 0 and 1."""

    def __init__(self, words: list[str], counts: np.ndarray, order: int = ORDER, discount: float = CLASS_DISCOUNT):
        """counts: (len(words), 2), in how many documents of each class each word is."""
        self.order = order
        codes, word = _codes(words)
        counts = counts.astype(np.float32)
        place = _places(word)
        self.letters = len(np.unique(codes[place >= 1])) + 1  # and one for all others
        #: For each order: gram keys, what their shared counts and those of each class give;
        #: and by gram of the order before: what shared counts and each class leave to shorter ones.
        self.tables = []
        self.lookups = None  # made where words are spelled, and not sent
        slot, held = np.zeros(len(codes), np.int64), 1
        grams = _grams(codes, word, order + 1)
        now, after = next(grams), next(grams, None)
        for n in range(1, order + 1):
            _, h, ok = now
            i = np.flatnonzero(ok)
            if n > 1:
                i = i[slot[i - 1] >= 0]
            context = slot[i - 1] if n > 1 else np.zeros(len(i), np.int64)
            keys, at = np.unique(h[i], return_inverse=True)
            of = np.zeros(len(keys), np.int64)
            of[at] = context
            raw = np.stack([np.bincount(at, counts[word[i], c], len(keys)) for c in (0, 1)], axis=1)
            both = raw.sum(axis=1)
            if n < order:
                # Continuation counts, but at the start of a word, where nothing can precede.
                _, longer, whole = after
                wide = whole[i]
                _, one = np.unique(longer[i[wide]], return_index=True)
                left = np.bincount(at[wide][one], minlength=len(keys)).astype(float)
                starts = np.zeros(len(keys), bool)
                starts[at[place[i] == n - 1]] = True
                shared = np.where(starts, both, left)
            else:
                shared = both
            known = (both > 1) | (n < PRUNED)
            cut = np.where(known, np.minimum(shared, DISCOUNT), shared)
            share = lambda x: np.bincount(of, x, held)  # noqa: B023, E731
            total, own = share(shared), np.stack([share(raw[:, c]) for c in (0, 1)], axis=1)
            rest = np.where(total > 0, share(cut) / np.maximum(total, 1e-9), 1)
            low = np.minimum(raw, discount)
            left = np.stack([share(low[:, c]) for c in (0, 1)], axis=1)
            left = np.where(own > 0, left / np.maximum(own, 1e-9), 1)
            kept = (shared - cut) / np.maximum(total[of], 1e-9)
            mine = (raw - low) / np.maximum(own[of], 1e-9)
            new = np.cumsum(known) - 1
            slot = np.full(len(codes), -1, np.int64)
            slot[i] = np.where(known[at], new[at], -1)
            keys, kept, mine = keys[known], kept[known], mine[known]
            if n == 1:
                # The start sign is a context, and never predicted.
                sign = h[place == 0][:1]
                at = int(np.searchsorted(keys, sign[0])) if len(sign) else 0
                keys, kept = np.insert(keys, at, sign) if len(sign) else keys, np.insert(kept, at, [0.0] * len(sign))
                mine = np.insert(mine, at, np.zeros((len(sign), 2)), axis=0)
                slot[slot >= at] += len(sign)
                slot[place == 0] = at
            self.tables.append(tuple(x if x.dtype == np.uint64 else x.astype(np.float32) for x in (keys, kept, mine, rest, left)))
            held = len(keys)
            now, after = after, next(grams, None)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"lookups": None}

    def log_probs(self, words: list[str]) -> np.ndarray:
        """(len(words), 2): log P of each word, its end included."""
        word, logs = self.letter_log_probs(words)
        return np.stack([np.bincount(word, logs[:, c], len(words)) for c in (0, 1)], axis=1)

    def letter_log_probs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each letter and end of words: the word's number, and log P of the letter after those before it."""
        codes, word = _codes(words)
        place = _places(word)
        p = np.full(len(codes), 1 / self.letters)
        own = np.stack([p, p], axis=1)
        slot = np.zeros(len(codes), np.int64)
        if self.lookups is None:
            self.lookups = [Lookup(keys) for keys, *_ in self.tables]
        for (n, h, ok), (keys, kept, mine, rest, left), find in zip(_grams(codes, word, self.order), self.tables, self.lookups, strict=True):
            i = np.flatnonzero(ok)
            if n > 1:
                i = i[slot[i - 1] >= 0]
            context = slot[i - 1] if n > 1 else np.zeros(len(i), np.int64)
            at, found = find(h[i])
            q = p[i] * rest[context]
            if len(keys):
                q += np.where(found, kept[at], 0)
            p[i] = q
            slot = np.full(len(codes), -1, np.int64)
            slot[i] = np.where(found, at, -1)
            if n == 1 and len(keys):
                signs = np.flatnonzero(place == 0)
                sign, known = find(h[signs])
                slot[signs] = np.where(known, sign, -1)
            # A class speaks where the longest known context ends.
            last = np.flatnonzero((place[i] < n) | (slot[i - 1] < 0)) if n < self.order else np.arange(len(i))
            own[i[last]] = left[context[last]] * q[last][:, None]
            if len(keys):
                own[i[last]] += np.where(found[last, None], mine[at[last]], 0)
        use = place >= 1
        return word[use], np.log(own[use])


class Lookup:
    """Places of keys, by open addressing."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, (2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.at = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        left, step = np.arange(len(keys)), 0
        while len(left):
            slot = self._slot(keys[left], step)
            free = np.flatnonzero(self.at[slot] < 0)
            _, one = np.unique(slot[free], return_index=True)
            put = free[one]
            self.keys[slot[put]], self.at[slot[put]] = keys[left[put]], left[put]
            left, step = np.delete(left, put), step + 1

    def _slot(self, keys: np.ndarray, step: int) -> np.ndarray:
        return ((keys * _MIX) >> self.shift).astype(np.int64) + step & self.mask

    def __call__(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each wanted key is, and whether it is there."""
        out, left, step = np.full(len(wanted), -1, np.int64), np.arange(len(wanted)), 0
        while len(left):
            slot = self._slot(wanted[left], step)
            at, same = self.at[slot], self.keys[slot] == wanted[left]
            hit = same & (at >= 0)
            out[left[hit]] = at[hit]
            left, step = left[~same & (at >= 0)], step + 1
        return np.maximum(out, 0), out >= 0


def tokens(text: str | None) -> list[str]:
    return (text or "").lower().split()


class Margins:
    """Margins of words and texts; a word is spelled once as long as it stays in the cache."""

    def __init__(self, letters: LetterModel):
        self.letters, self.number, self.margins = letters, {}, np.zeros(0)

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """log P(word | toxic) - log P(word | ordinary) of all words, and each text's number of words."""
        if len(self.number) > CACHE:
            self.number, self.margins = {}, np.zeros(0)
        number, old = self.number, len(self.number)
        docs = [[number.setdefault(w, len(number)) for w in tokens(t)] for t in texts]
        new = list(itertools.islice(reversed(number), len(number) - old))[::-1]
        for i in range(0, len(new), _SPELLED):
            logs = self.letters.log_probs(new[i : i + _SPELLED])
            self.margins = np.concatenate([self.margins, logs[:, 1] - logs[:, 0]])
        n = np.fromiter(map(len, docs), np.int64, len(docs))
        return self.margins[np.fromiter(itertools.chain.from_iterable(docs), np.int64, int(n.sum()))], n

    def features(self, texts: list[str | None]) -> np.ndarray:
        """For each text: the mean margin of its most telling words; 0 without words."""
        margin, n = self(texts)
        out, ends = np.zeros((len(texts), 1)), np.cumsum(n)
        for i in np.flatnonzero(n).tolist():
            v, top = margin[ends[i] - n[i] : ends[i]], int(np.ceil(TAIL * n[i]))
            out[i] = np.partition(v, len(v) - top)[-top:].mean()
        return out


class ToxicityModel:
    """The letter models of both classes and the weights that make a score of a document's margin."""

    def __init__(self, letters: LetterModel, weights: np.ndarray):
        self.letters, self.weights = letters, weights

    def scorer(self):
        margins = Margins(self.letters)
        return lambda texts: logistic(margins.features(texts), self.weights)


def train(rows: list[tuple[str, int]]) -> ToxicityModel:
    """Fit on (text, label).

    Weights come from documents whose words the models have not seen: each of
    FOLDS parts is scored by models of the others.
    """

    def letters(part):
        words = [Counter(), Counter()]
        for text, label in part:
            words[label].update(set(tokens(text)))
        names = list({**words[0], **words[1]})
        return LetterModel(names, np.stack([np.fromiter((words[c].get(w, 0) for w in names), np.float32, len(names)) for c in (0, 1)], axis=1))

    rows = sorted(rows, key=lambda r: r[1])  # so that each part has its share of both labels
    x, y = [np.zeros((0, 1))], [np.zeros(0)]
    for i in range(FOLDS):
        margins, part = Margins(letters([r for j, r in enumerate(rows) if j % FOLDS != i])), rows[i::FOLDS]
        for at in range(0, len(part), 200):
            x.append(margins.features([t for t, _ in part[at : at + 200]]))
            y.append(np.array([label for _, label in part[at : at + 200]], float))
        del margins
    return ToxicityModel(letters(rows), fit_logistic(np.concatenate(x), np.concatenate(y)))


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    sample_docs: int = SAMPLE_DOCS,
    sample_bytes: int = SAMPLE_BYTES,
) -> bytes:
    """A pickled ToxicityModel, fitted in one task.

    It is fitted on at most sample_docs documents of each label, at most sample_bytes of text each.

    Documents are taken in the order of a hash of their ids.  Labels but 0 and
    1, null ids and labels of absent documents are left out; a document with
    both labels is toxic.  Without any label, or any document, every score is 0.5.
    Ids are bigint; other columns are not looked at.  A text is scored whole, in
    memory in proportion to its words.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("label"))
    few = [
        sampled(known.where(F.col("label") == y).select("id"), docs, id_col, text_col, sample_docs, sample_bytes).withColumn("label", F.lit(y))
        for y in (0, 1)
    ]

    def fit(rows: list[tuple]) -> ToxicityModel:
        rows = sorted(rows, key=lambda r: (r[0] * 2654435761 % 4294967296, r[0]))
        return train([(text, label) for _, text, label in rows])

    return fit_in_a_task(few[0].unionByName(few[1]), fit)


def toxicity_score(spark, model: bytes, text: Column) -> Column:
    """A column of scores; null texts are empty."""
    small_batches(spark)
    held, token = spark.sparkContext.broadcast(model), uuid.uuid4().hex

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(_scorer(token, held)(texts.to_pylist()), pa.float64())

    return score(text)


_scorers = worker_cache()


def _scorer(token: str, held):
    """One scorer a worker process, with its cache of words, for the model used last."""
    if token not in _scorers:
        _scorers.clear()
        _scorers[token] = pickle.loads(held.value).scorer()
    return _scorers[token]


def drop_toxic(docs: DataFrame, model: bytes, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score under threshold, all columns."""
    scored = docs.withColumn("__toxicity", toxicity_score(docs.sparkSession, model, F.col(text_col)))
    return scored.where(F.col("__toxicity") < threshold).drop("__toxicity")


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold(F.col("doc_id"), 4) != 2)
    model = fit_toxicity(docs, labels)
    scored = docs.select(
        "doc_id",
        (fold(F.col("doc_id"), 4) == 2).alias("held_out"),
        toxicity_score(spark, model, F.col("text")).alias("score"),
    )
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
