"""Toxicity: a factorization machine over hashed terms of whole texts.

Terms are a text's distinct words and word beginnings.  Beside a weight, each
hashed term has a short factor vector; the products of factors score pairs of
terms that only together mark a text.  Weights are fitted first, then factors
and weights together; a fold of the training rows says when to stop.
"""

from __future__ import annotations

import copy
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.arrow import fold, frugal
from plumbline.storage import materialise, scope

BITS = 18
FACTORS = 4
#: Labelled training rows that the model is fitted on: the smallest by a hash of their id.
TRAINING_ROWS = 12_000
HELD_OUT = (5, 0)
#: Training rows in which a term must occur to be learned.
LEAST_ROWS = 4
BEGINNINGS = (4, 5)
#: Most epochs of the weights alone, and of weights and factors; each ends when the inner fold's loss hasn't fallen for PATIENCE epochs.
EPOCHS = (60, 100)
PATIENCE = (15, 40)
#: Training rows with this remainder of crc32 div 5 are the inner fold.
INNER = (5, 0)
_STRIP = ".,;:!?\"'()[]{}<>|*#$%&-_=+/\\«»¿¡…“”‘’`~@^"
_CACHE = 1 << 19


class Terms:
    """Hashed terms of texts, with a bounded memory of words."""

    def __init__(self, bits: int = BITS):
        self.mask, self.known = (1 << bits) - 1, {}

    def _word(self, raw: str) -> tuple[int, ...]:
        word = raw.strip(_STRIP)
        if not word:
            return ()
        names = ["w " + word, *(f"b {word[:k]}" for k in BEGINNINGS if len(word) >= k)]
        return tuple(zlib.crc32(n.encode("utf-8", "replace")) & self.mask for n in names)

    def __call__(self, text: str) -> np.ndarray:
        """Sorted distinct term numbers of a whole text."""
        if len(self.known) > _CACHE:
            self.known.clear()
        found: set[int] = set()
        for raw in set(text.lower().split()):
            terms = self.known.get(raw)
            if terms is None:
                terms = self._word(raw)
                if len(raw) <= 64:
                    self.known[raw] = terms
            found.update(terms)
        return np.array(sorted(found), np.int32)


@dataclass
class Machine:
    """``bias + sum w_i + sum_{i<j} <v_i, v_j> / sqrt(n)`` over a text's n learned terms, as a probability."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        out = np.empty(len(rows))
        known = self.weights != 0
        for i, x in enumerate(rows):
            x = x[known[x]]
            v = self.factors[x]
            s = v.sum(axis=0)
            out[i] = self.bias + self.weights[x].sum() + 0.5 * float((s * s).sum() - (v * v).sum()) / max(1, len(x)) ** 0.5
        return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


class Layout:
    """Rows of learned terms as flat arrays, for sums over rows and over terms."""

    def __init__(self, rows: list[np.ndarray], labels: np.ndarray, terms: np.ndarray, size: int, rare: float):
        number = np.full(size, -1, np.int64)
        number[terms] = np.arange(len(terms))
        rows = [number[x] for x in rows]
        rows = [x[x >= 0] for x in rows]
        length = np.array([len(x) for x in rows], np.int64)
        self.labels, self.n, self.scale = labels, len(rows), 1 / np.sqrt(np.maximum(length, 1))
        self.local = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        self.some = np.flatnonzero(length)
        self.at_doc = (np.cumsum(length) - length)[self.some]
        by_term = np.argsort(self.local, kind="stable")
        self.doc_by_term = np.repeat(np.arange(self.n), length)[by_term]
        counts = np.bincount(self.local, minlength=len(terms))
        self.used = np.flatnonzero(counts)
        self.at_term, self.terms = (np.cumsum(counts) - counts)[self.used], len(terms)
        cost = np.where(labels > 0, rare, 1.0)
        self.cost = cost / max(cost.sum(), 1e-12)

    def per_doc(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n, *values.shape[1:]))
        if len(self.some):
            out[self.some] = np.add.reduceat(values, self.at_doc, axis=0)
        return out

    def per_term(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros((self.terms, *values.shape[1:]))
        if len(self.used):
            out[self.used] = np.add.reduceat(values[self.doc_by_term], self.at_term, axis=0)
        return out

    def loss(self, b: float, w: np.ndarray, v: np.ndarray | None) -> tuple[float, np.ndarray, np.ndarray | None]:
        """Weighted log loss, its gradient by each row's score, and the rows' sums of factors."""
        z, s = b + self.per_doc(w[self.local]), None
        if v is not None:
            s = np.empty((self.n, v.shape[1]))
            for f in range(v.shape[1]):
                own = v[:, f][self.local]
                s[:, f] = self.per_doc(own)
                z = z + 0.5 * self.scale * (s[:, f] ** 2 - self.per_doc(own * own))
        z = np.clip(z, -40, 40)
        p = 1 / (1 + np.exp(-z))
        return float((self.cost * (np.logaddexp(0, z) - self.labels * z)).sum()), (p - self.labels) * self.cost, s

    def gradients(self, b: float, w: np.ndarray, v: np.ndarray | None) -> tuple[float, np.ndarray, np.ndarray | None]:
        """Gradients of the loss by bias, weights and factors."""
        _, g, s = self.loss(b, w, v)
        if v is None:
            return float(g.sum()), self.per_term(g), None
        pair = g * self.scale
        crossed = np.column_stack([self.per_term(pair * s[:, f]) for f in range(v.shape[1])])
        return float(g.sum()), self.per_term(g), crossed - self.per_term(pair)[:, None] * v


class _Descent:
    """Adam with an L1 pull on weights.  A factor's step is divided by ten times the root mean square of all factors' gradients at least, so factors without a signal stay small."""

    def __init__(self, bias: float, terms: int, factors: int, rate: float, l1: float, factor_rate: float, l2: float):
        self.b, self.w, self.v = bias, np.zeros(terms), np.random.default_rng(7).normal(0, 0.01, (terms, factors))
        self.rate, self.l1, self.factor_rate, self.l2 = rate, l1, factor_rate, l2
        self.w1, self.w2, self.v1, self.v2, self.steps, self.pair_steps = np.zeros(terms), np.zeros(terms), np.zeros_like(self.v), np.zeros_like(self.v), 0, 0

    def step(self, data: Layout, pairs: bool) -> None:
        gb, gw, gv = data.gradients(self.b, self.w, self.v if pairs else None)
        self.steps += 1
        gw += self.l1 * np.sign(self.w)
        self.w1 += 0.1 * (gw - self.w1)
        self.w2 += 0.01 * (gw * gw - self.w2)
        self.w -= self.rate * (self.w1 / (1 - 0.9**self.steps)) / (np.sqrt(self.w2 / (1 - 0.99**self.steps)) + 1e-7)
        if pairs:
            self.pair_steps += 1
            self.v1 += 0.1 * (gv - self.v1)
            self.v2 += 0.01 * (gv * gv - self.v2)
            size = np.sqrt(np.maximum(self.v2, 100 * self.v2.mean()) / (1 - 0.99**self.pair_steps))
            self.v -= self.factor_rate * (self.v1 / (1 - 0.9**self.pair_steps) / (size + 1e-12) + self.l2 * self.v)
        self.b -= 0.5 * gb


def _best_epochs(fit: _Descent, data: Layout, inner: Layout, epochs: tuple[int, int]) -> tuple[int, int]:
    """Epochs of the weights alone, and then with factors, after which the inner fold's loss is least."""
    best = []
    for pairs, most in enumerate(epochs):
        least, at, kept = inner.loss(fit.b, fit.w, fit.v if pairs and best[0] < 0 else None)[0], 0, copy.deepcopy(fit)
        for epoch in range(1, most + 1):
            fit.step(data, bool(pairs))
            now = inner.loss(fit.b, fit.w, fit.v if pairs else None)[0]
            if now < least:
                least, at, kept = now, epoch, copy.deepcopy(fit)
            elif epoch - at >= PATIENCE[pairs]:
                break
        fit = kept
        best.append(at)
    return best[0], best[1]


def train(
    rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS, factors: int = FACTORS, epochs: tuple[int, int] = EPOCHS, inner: np.ndarray | None = None,
    rate: float = 0.05, l1: float = 1e-3, factor_rate: float = 0.02, l2: float = 1e-3, rare: float = 4.0,
) -> Machine:
    """Full-batch descent on log loss; the same rows give the same machine.

    With a mask ``inner`` that holds rows of both kinds (and leaves some of
    both), the numbers of epochs are those at which a machine of the other
    rows does best on it; then all rows are fitted for as long.  Else
    ``epochs`` are run.  ``rare``: weight of a toxic row's loss, as such rows
    are few.
    """
    size = 1 << bits
    weights, vectors = np.zeros(size), np.zeros((size, factors))
    share = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3)) if len(labels) else 0.5
    bias = float(np.log(share / (1 - share)))
    if not len(labels) or labels.min() == labels.max():
        return Machine(bias, weights, vectors)
    terms = np.flatnonzero(np.bincount(np.concatenate(rows), minlength=size) >= LEAST_ROWS)
    if not len(terms):
        return Machine(bias, weights, vectors)
    lay = lambda mask: Layout([x for x, m in zip(rows, mask) if m], labels[mask], terms, size, rare)
    start = lambda: _Descent(bias, len(terms), factors, rate, l1, factor_rate, l2)
    if inner is not None and all(len(set(labels[m])) == 2 for m in (inner, ~inner)):
        epochs = _best_epochs(start(), lay(~inner), lay(inner), epochs)
    fit, data = start(), lay(np.ones(len(rows), bool))
    for pairs, n in enumerate(epochs):
        for _ in range(n):
            fit.step(data, bool(pairs))
    weights[terms] = np.where(fit.w == 0, 1e-12, fit.w)
    if epochs[1]:
        vectors[terms] = fit.v
    return Machine(fit.b, weights, vectors)


def training_rows(docs: DataFrame, labels: DataFrame, most: int = TRAINING_ROWS) -> DataFrame:
    """``(doc_id, toxic)`` of the bounded training sample: labelled, not held out, one row an id (the higher label), smallest hashes first."""
    usable = labels.where("doc_id is not null and toxic is not null").where(fold("doc_id", HELD_OUT[0]) != HELD_OUT[1])
    one = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAINING_ROWS, bits: int = BITS) -> Machine:
    """Learn from the bounded sample: of an id's documents one is used, however often the id is there.

    At most ``most`` rows of terms meet in one task, without the terms that
    fewer than LEAST_ROWS of them have (Spark counts those first; the list of
    the others is bounded by the hash), and what comes back has the fixed size
    of a machine.
    """
    with scope(docs.sparkSession):
        return _fit(docs, labels, most, bits)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a list column without nulls, and the n+1 places where its lists end."""
    return column.flatten().to_numpy(), np.r_[0, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))].astype(np.int64)


def _fit(docs: DataFrame, labels: DataFrame, most: int, bits: int) -> Machine:
    sample = F.broadcast(training_rows(docs, labels, most))
    chosen = docs.select("doc_id", "text").join(sample, "doc_id")

    def hashed(batches):
        terms = Terms(bits)
        for batch in batches:
            found = [terms(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "toxic", "terms"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = chosen.select("doc_id", "text", "toxic").mapInArrow(frugal(hashed), f"doc_id {kind}, toxic int, terms array<int>")
    rows = materialise(rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("terms").alias("terms")), "training-terms")
    common = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_ROWS)
    marks = np.zeros(1 << bits, bool)
    marks[common.select("term").toArrow().column(0).to_numpy()] = True
    shared = docs.sparkSession.sparkContext.broadcast(marks)

    def prune(batches):
        for batch in batches:
            flat, ends = _lists(batch.column(2))
            keep = shared.value[flat]
            kept = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(keep)][ends].astype(np.int32)), pa.array(flat[keep]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), kept], ["doc_id", "toxic", "terms"])

    rows = rows.mapInArrow(frugal(prune), f"doc_id {kind}, toxic int, terms array<int>").repartition(1)

    def learn(batches):
        seen = [b for b in batches if b.num_rows]
        table = pa.Table.from_batches(seen).sort_by([("doc_id", "ascending")]) if seen else None
        flat, ends = _lists(table.column("terms").combine_chunks()) if table else (None, [0])
        terms = [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]
        labels = np.array(table.column("toxic").to_pylist(), float) if table else np.zeros(0)
        inner = np.array([zlib.crc32(str(i).encode()) // HELD_OUT[0] % INNER[0] == INNER[1] for i in table.column("doc_id").to_pylist()]) if table else None
        made = train(terms, labels, bits, inner=inner)
        used = np.flatnonzero(made.weights)
        blobs = [np.array([made.bias]).tobytes(), used.astype("<i4").tobytes(), made.weights[used].astype("<f4").tobytes(), made.factors[used].astype("<f4").tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.binary()), pa.array(range(4), pa.int32())], ["blob", "part"])

    blobs = {r.part: bytes(r.blob) for r in rows.mapInArrow(frugal(learn), "blob binary, part int").collect()}
    weights, factors = np.zeros(1 << bits, np.float32), np.zeros((1 << bits, FACTORS), np.float32)
    used = np.frombuffer(blobs[1], "<i4")
    weights[used] = np.frombuffer(blobs[2], "<f4")
    factors[used] = np.frombuffer(blobs[3], "<f4").reshape(-1, FACTORS)
    return Machine(float(np.frombuffer(blobs[0])[0]), weights, factors)


def score_toxicity(docs: DataFrame, labels: DataFrame, most: int = TRAINING_ROWS) -> DataFrame:
    """Return doc_id, held_out, score (0 to 1) and predicted (score of 0.5 or more) for every row of ``docs``.

    The machine learns ``labels.toxic`` from rows whose crc32(doc_id as text)
    mod 5 is not 0, of which at most ``most`` are taken.  A null or empty text
    has no terms and gets the bias alone; without labels of both kinds every
    score is the (clipped) share of toxic rows.  A null id is never held out
    and never trains; repeated rows stay; an empty table gives an empty
    result; other columns are not read.
    """
    machine = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, most))

    def run(batches):
        terms = Terms()
        for batch in batches:
            scores = machine.value.scores([terms(t or "") for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    held = fold("doc_id", HELD_OUT[0]) == HELD_OUT[1]
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
