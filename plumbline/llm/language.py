"""Language ID: interpolated Kneser-Ney character models per language, with calibrated rejection.

Texts are read as lower-case letters with every other character as a space
(runs of spaces count once).  Spark counts the 4-grams of all training rows
exactly, and from them discounts and continuation counts of single characters.
Models are sorted hash arrays in shards of bounded size, made by tasks and kept
in the shared folder: a language with more
types than a shard is cut by the character before the last, which all grams of
one back-off chain share, so each part works out its probabilities alone.
"""

from __future__ import annotations

import pickle
import uuid
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.arrow import fold, frugal, parts
from plumbline.storage import arrow_files, fresh_path, materialise, scope

ORDER = 4
#: 4-gram types of a shard (or of one unit, a language's grams of one bucket, if that has more): what a task makes or holds at once.
SHARD = 1 << 21
#: Buckets of the character before the last, by which large languages are cut.
BUCKETS = 64
#: Bytes of text that a task gathers before it goes through several shards.
GATHER = 1 << 25
HELD_OUT = (3, 1)
#: Training rows with this remainder of crc32 div 3 calibrate the rejection: they are scored by models of the other training rows.
CALIBRATION = (10, 0)
#: Rows that a language's limit needs; a language with fewer rejects nothing for its distance.
LEAST_ROWS = 3
#: Rows for which the variance of all languages counts beside a language's own.
POOLED_ROWS = 10
#: Standard deviations above its language's mean cross-entropy from which a text is rejected.
REJECT_Z = 10.0
_SLICE = 1 << 18
_SPACE = 32
_BITS = 21
_CODE = (1 << _BITS) - 1
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point to lower-case letter, or to space for what isn't a letter."""
    table = np.full(0x110000, _SPACE, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Mapped characters of the texts, each after ORDER - 1 spaces, and each text's first position."""
    lead = " " * (ORDER - 1)
    joined = lead + lead.join(texts)
    raw = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    size = np.array([len(t) + ORDER - 1 for t in texts], np.int64)
    return _letters()[raw], np.cumsum(size) - size


def _grams(codes: np.ndarray, context: int = ORDER - 1):
    """Positions that count (no space after a space) and the 4-gram that ends at each, as two packed halves."""
    c = codes.astype(np.int64)
    at = np.flatnonzero((c[context:] != _SPACE) | (c[context - 1 : -1] != _SPACE)) + context
    return at, c[at - 3] << _BITS | c[at - 2], c[at - 1] << _BITS | c[at]


def _slices(texts: list[str]):
    """``(row, text slice, context)``: long texts in slices that overlap by the context, so no gram is lost or doubled."""
    for i, t in enumerate(texts):
        yield i, t[:_SLICE], ""
        for a in range(_SLICE, len(t), _SLICE):
            yield i, t[a : a + _SLICE], t[a - ORDER + 1 : a]


def _own_grams(texts: list[str], skip: list[int]):
    """Mapped characters, and the counted grams of the texts: not in the lead, nor in the first ``skip`` characters, which are context; with each gram's text."""
    codes, first = _codes(texts)
    at, high, low = _grams(codes)
    piece = np.repeat(np.arange(len(texts)), np.diff(np.r_[first, len(codes)]))[at]
    keep = at >= (first + np.array(skip) + ORDER - 1)[piece]
    return codes, at[keep], high[keep], low[keep], piece[keep]


def _mix(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """64-bit hash of a gram's halves."""
    with np.errstate(over="ignore"):
        h = high.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h ^= (h >> np.uint64(29)) ^ low.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        h *= np.uint64(0xFF51AFD7ED558CCD)
        return h ^ h >> np.uint64(32)


def count_grams(docs: DataFrame) -> DataFrame:
    """``(lang, high, low, n)``: exact 4-gram counts over the whole texts of ``docs`` (columns text, lang)."""

    def run(batches):
        for batch in batches:
            langs = batch.column(1).dictionary_encode()
            codes_of, names = langs.indices.to_numpy(), langs.dictionary.to_pylist()
            texts = batch.column(0).to_pylist()
            for k, name in enumerate(names):
                own = [texts[i] or "" for i in np.flatnonzero(codes_of == k)]
                cut = [c + t if c else t for _, t, c in _slices(own)]
                skip = [len(c) for _, _, c in _slices(own)]
                for a, b in parts(map(len, cut), _SLICE):
                    _, at, high, low, _ = _own_grams(cut[a:b], skip[a:b])
                    order = np.lexsort((low, high)) if len(at) else np.zeros(0, int)
                    high, low = high[order], low[order]
                    new = np.r_[True, (high[1:] != high[:-1]) | (low[1:] != low[:-1])] if len(at) else np.zeros(0, bool)
                    starts = np.flatnonzero(new)
                    n = np.diff(np.r_[starts, len(high)])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(n), pa.string()), pa.array(high[starts]), pa.array(low[starts]), pa.array(n.astype(np.int64))], ["lang", "high", "low", "n"]
                    )

    partial = docs.select("text", "lang").mapInArrow(frugal(run), "lang string, high long, low long, n long")
    return partial.groupBy("lang", "high", "low").agg(F.sum("n").alias("n"))


@dataclass
class Totals:
    """What a language's parts have in common: discounts by order, and its characters with their continuation counts."""

    discounts: dict[int, float]
    characters: np.ndarray
    counts: np.ndarray


def _discount(ones: int, twos: int) -> float:
    return min(max(ones / (ones + 2 * twos) if ones else 0.5, 0.1), 0.9)


def totals(counts: DataFrame) -> dict[str, Totals]:
    """``Totals`` of each language from exact 4-gram counts (lang, high, low, n): two numbers an order, and one row a character that the language has."""
    one = F.lit(_CODE)
    three = counts.groupBy("lang", F.col("high").bitwiseAND(one).alias("high"), "low").agg(F.count(F.lit(1)).alias("n"))
    two = three.groupBy("lang", "low").agg(F.count(F.lit(1)).alias("n"))
    rare = lambda df, order: df.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("ones"), F.count_if(F.col("n") == 2).alias("twos")).withColumn("order", F.lit(order))
    found: dict[str, dict[int, float]] = {}
    for r in reduce(DataFrame.unionByName, [rare(counts, 4), rare(three, 3), rare(two, 2)]).collect():
        found.setdefault(r.lang, {})[r.order] = _discount(r.ones, r.twos)
    single = two.groupBy("lang", F.col("low").bitwiseAND(one).alias("code")).agg(F.count(F.lit(1)).alias("n")).toArrow()
    out = {}
    for lang, discounts in found.items():
        own = single.filter(pc.equal(single.column("lang"), lang))
        n = own.column("n").to_numpy()
        discounts[1] = _discount(int((n == 1).sum()), int((n == 2).sum()))
        out[lang] = Totals(discounts, own.column("code").to_numpy(), n)
    return out


def _bucket(low):
    """Bucket of the character before the last, from low halves: a column or an array."""
    if isinstance(low, Column):
        return F.pmod(F.shiftright(low, _BITS), F.lit(BUCKETS))
    return (low >> _BITS) % BUCKETS


@dataclass
class Model:
    """One language (number ``place``): for each order, sorted gram hashes with log2 probabilities, and sorted context hashes with back-off weights.

    ``own`` names the buckets that are here if the language is cut.
    """

    place: int
    own: np.ndarray | None
    grams: list[np.ndarray]
    logp: list[np.ndarray]
    contexts: list[np.ndarray]
    backoff: list[np.ndarray]
    floor: float


def _suffix(high: np.ndarray, low: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The last ``order`` characters of 4-grams, as halves."""
    if order == 4:
        return high, low
    if order == 3:
        return high & _CODE, low
    return np.zeros_like(high), low if order == 2 else low & _CODE


def _context(high: np.ndarray, low: np.ndarray, order: int) -> np.ndarray:
    """Hash of all but the last character of ``order``-grams."""
    return _mix(high + (order << 50), low >> _BITS)


def _types(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs and how often each occurs."""
    order = np.lexsort((low, high))
    high, low = high[order], low[order]
    starts = np.flatnonzero(np.r_[True, (high[1:] != high[:-1]) | (low[1:] != low[:-1])])
    return high[starts], low[starts], np.diff(np.r_[starts, len(high)])


def kneser_ney(high: np.ndarray, low: np.ndarray, n: np.ndarray, whole: Totals, place: int = 0, own: np.ndarray | None = None) -> Model:
    """Interpolated Kneser-Ney from a language's (or a part's) 4-gram types and counts: raw counts on top, continuation counts below.

    A part has all grams with its characters before the last, hence all their
    contexts and continuations but for single characters, which ``whole`` has.
    """
    levels = {ORDER: (high, low, n), 1: (np.zeros(len(whole.characters), np.int64), whole.characters, whole.counts)}
    for order in range(ORDER - 1, 1, -1):
        levels[order] = _types(*_suffix(*levels[order + 1][:2], order))
    grams, logp, contexts, backoff = [], [], [], []
    vocabulary = len(whole.characters) + 1
    keys_below = p_below = None
    for order in range(1, ORDER + 1):
        hi, lo, c = levels[order]
        discount = whole.discounts[order]
        keys, inverse = np.unique(_context(hi, lo, order), return_inverse=True)
        total = np.bincount(inverse, weights=c)
        weight = discount * np.bincount(inverse) / total
        below = np.full(len(c), 1.0 / vocabulary)
        if order > 1:
            s_high, s_low = _suffix(hi, lo, order - 1)
            below = p_below[np.searchsorted(keys_below, _mix(s_high + (order - 1 << 50), s_low))]
        p = (c - discount) / total[inverse] + weight[inverse] * below
        key = _mix(hi + (order << 50), lo)
        by = np.argsort(key)
        keys_below, p_below = key[by], p[by]
        grams.append(keys_below)
        logp.append(np.log2(p_below))
        contexts.append(keys)
        backoff.append(np.log2(weight))
    return Model(place, own, grams, logp, contexts, backoff, float(backoff[0][0]) - float(np.log2(vocabulary)))


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)


def log_probabilities(model: Model, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """log2 p(last character | three before) for distinct 4-grams, backing off order by order."""
    out = np.full(len(high), np.nan)
    carried = np.zeros(len(high))
    todo = np.arange(len(high))
    for order in range(ORDER, 0, -1):
        hi, lo = _suffix(high[todo], low[todo], order)
        at, hit = _find(model.grams[order - 1], _mix(hi + (order << 50), lo))
        out[todo[hit]] = carried[todo[hit]] + model.logp[order - 1][at[hit]]
        todo, hi, lo = todo[~hit], hi[~hit], lo[~hit]
        if order > 1:
            at, hit = _find(model.contexts[order - 1], _context(hi, lo, order))
            carried[todo[hit]] += model.backoff[order - 1][at[hit]]
    out[todo] = carried[todo] + model.floor
    return out


def entropies(models: list[Model], texts: list[str], width: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bits by each of ``width`` languages (texts x languages; a cut language's own part of them), counted characters, and whether a text has a letter."""
    bits, n = np.zeros((len(texts), width)), np.zeros(len(texts))
    letters = np.zeros(len(texts))
    pieces = list(_slices(texts))
    cut = [c + t if c else t for _, t, c in pieces]
    for a, b in parts(map(len, cut), _SLICE):
        codes, at, high, low, piece = _own_grams(cut[a:b], [len(c) for _, _, c in pieces[a:b]])
        row = np.array([i for i, _, _ in pieces[a:b]])[piece]
        _, index, inverse = np.unique(_mix(high, low), return_index=True, return_inverse=True)
        high, low = high[index], low[index]
        n += np.bincount(row, minlength=len(texts))
        letters += np.bincount(row, weights=codes[at] != _SPACE, minlength=len(texts))
        for model in models:
            if model.own is None:
                lp = log_probabilities(model, high, low)
            else:
                lp, here = np.zeros(len(high)), model.own[_bucket(low)]
                lp[here] = log_probabilities(model, high[here], low[here])
            bits[:, model.place] -= np.bincount(row, weights=lp[inverse], minlength=len(texts))
    return bits, n, letters > 0


class Stored:
    """A shard of models: a file in the shared folder, read by a task when it needs it."""

    def __init__(self, uri: str):
        self.uri = uri

    @property
    def value(self) -> list[Model]:
        if "_value" not in vars(self):
            files, path = arrow_files(self.uri)
            with files.open_input_stream(path) as source:
                self._value = pickle.loads(source.read())
        return self._value

    def __getstate__(self):
        return {"uri": self.uri}


def fit(docs: DataFrame) -> tuple[list[str], list[Stored]]:
    """Languages in ``docs`` (text, lang) by name, and their models from all its rows."""
    with scope(docs.sparkSession):
        return models_of(materialise(count_grams(docs.where("lang is not null")), "char-grams"))


def models_of(counts: DataFrame) -> tuple[list[str], list[Stored]]:
    """Languages by name and their models from exact 4-gram counts (lang, high, low, n), in shards in the shared folder.

    The driver plans by the sizes of units (BUCKETS a language) and gives what
    the parts of a language share; the shards are made and written by tasks.  A
    task that runs again writes a file of another name, and only the names that
    come back are read.  The files belong to the scope around the caller's.
    """
    spark = counts.sparkSession
    sizes = counts.groupBy("lang", _bucket(F.col("low")).alias("bucket")).agg(F.count(F.lit(1)).alias("types")).collect()
    units = sorted((r.lang, r.bucket, r.types) for r in sizes)
    langs = sorted({u[0] for u in units})
    if not langs:
        return [], []
    place = {lang: k for k, lang in enumerate(langs)}
    every: dict[str, list[int]] = {}
    for lang, bucket, _ in units:
        every.setdefault(lang, []).append(bucket)
    cuts = list(parts([u[2] for u in units], SHARD))
    plan = spark.createDataFrame([(lang, bucket, k) for k, (a, b) in enumerate(cuts) for lang, bucket, _ in units[a:b]], "lang string, bucket long, shard int")
    shared, folder = spark.sparkContext.broadcast(totals(counts)), fresh_path(spark, "language-models", hand_on=True)

    def make(table: pa.Table) -> pa.Table:
        made = []
        for lang in sorted(pc.unique(table.column("lang")).to_pylist()):
            own = table.filter(pc.equal(table.column("lang"), lang))
            here = sorted(pc.unique(own.column("bucket")).to_pylist())
            # What the language's own texts don't have falls to its first part.
            marks = None if here == every[lang] else np.isin(np.arange(BUCKETS), here) | (here[0] == every[lang][0]) & ~np.isin(np.arange(BUCKETS), every[lang])
            made.append(kneser_ney(*(own.column(c).to_numpy() for c in ("high", "low", "n")), shared.value[lang], place[lang], marks))
        files, root = arrow_files(folder)
        files.create_dir(root, recursive=True)
        name = f"{table.column('shard')[0].as_py():06d}-{uuid.uuid4().hex}"
        with files.open_output_stream(f"{root}/{name}") as out:
            out.write(pickle.dumps(made, protocol=5))
        return pa.table({"name": [name]})

    rows = counts.withColumn("bucket", _bucket(F.col("low")).cast("long")).join(F.broadcast(plan), ["lang", "bucket"])
    names = sorted(r.name for r in rows.groupBy("shard").applyInArrow(make, "name string").collect())
    return langs, [Stored(f"{folder}/{name}") for name in names]


def _entropies(shards: list[Stored], texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cross-entropy in bits a character by the models of all shards, with the other results of ``entropies``; of several shards one is in memory at a time."""
    bits, n, letters = entropies(shards[0].value if shards else [], texts, width)
    for before, shard in zip(shards, shards[1:]):
        _forget(before)
        bits += entropies(shard.value, texts, width)[0]
    if len(shards) > 1:
        _forget(shards[-1])
    return bits / np.maximum(n, 1)[:, None], n, letters


def _forget(*shards: Stored) -> None:
    """Let a worker drop what it read of shards; it reads them again when it needs them."""
    for shard in shards:
        vars(shard).pop("_value", None)


def _gathered(batches, shards: list[Stored], text_at: int):
    """The batches as they come for one shard; for several, joined up to GATHER bytes, so that shards are loaded seldom.  At the end the models are dropped: workers live on for other stages."""
    held, size = [], 0
    for batch in batches:
        if len(shards) < 2:
            yield batch
            continue
        held.append(batch)
        size += batch.column(text_at).nbytes
        if size >= GATHER:
            yield _joined(held)
            held, size = [], 0
    if held:
        yield _joined(held)
    _forget(*shards)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(batches).combine_chunks()
    return pa.RecordBatch.from_arrays([c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in table.columns], schema=table.schema)


def _scored(docs: DataFrame, langs: list[str], shards: list[Stored], extra: list[str]) -> DataFrame:
    names = np.array([*langs, UNKNOWN], dtype=object)

    def run(batches):
        for batch in _gathered(batches, shards, 0):
            h, n, letters = _entropies(shards, [t or "" for t in batch.column(0).to_pylist()], len(langs))
            best = h.argmin(axis=1) if len(langs) else np.zeros(len(n), int)
            best[~letters] = len(langs)
            low = h.min(axis=1) if len(langs) else np.zeros(len(n))
            gap = np.exp2(-np.minimum(n, 64)[:, None] * (h - low[:, None]) / 4)
            score = np.where(letters, 1 / np.maximum(gap.sum(axis=1), 1), 0.0) if len(langs) else np.zeros(len(n))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(names[best].tolist(), pa.string()), pa.array(score), pa.array(low), pa.array(n.astype(np.int64)), pa.array(letters)],
                [*extra, "lang_pred", "score", "entropy", "n_scored", "has_letter"],
            )

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in extra)
    return docs.select("text", *extra).mapInArrow(frugal(run), f"{kinds}, lang_pred string, score double, entropy double, n_scored long, has_letter boolean")


def _training(docs: DataFrame) -> DataFrame:
    return docs.where("lang is not null").where(fold("doc_id", HELD_OUT[0]) != HELD_OUT[1])


def _calibrates() -> Column:
    return F.floor(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) / HELD_OUT[0]) % CALIBRATION[0] == CALIBRATION[1]


def calibrate(scored: DataFrame) -> dict[str, tuple[float, float, float]]:
    """Per language: mean cross-entropy and its variance as a + b / length, from rows that were predicted as labelled.

    Five sums a language come to the driver.  A language's variance is drawn
    towards that of all languages together, as POOLED_ROWS rows would, so that
    few rows that happen to be alike set no narrow limit.  Languages with fewer
    than LEAST_ROWS such rows have no limit.
    """
    right = scored.where((F.col("lang") == F.col("lang_pred")) & (F.col("n_scored") > 0))
    means = right.groupBy("lang").agg((F.sum(F.col("entropy") * F.col("n_scored")) / F.sum("n_scored")).alias("mean"))
    square, inverse = (F.col("entropy") - F.col("mean")) ** 2, 1 / F.col("n_scored")
    rows = right.join(means, "lang").groupBy("lang").agg(
        F.first("mean").alias("mean"), F.count(F.lit(1)).alias("k"), F.sum(square).alias("y"), F.sum(inverse).alias("x"), F.sum(inverse * inverse).alias("xx"), F.sum(inverse * square).alias("xy")
    ).collect()

    def line(k, y, x, xx, xy):
        """Variance as a + b / length by least squares, neither below zero."""
        spread = k * xx - x * x
        b = max((k * xy - x * y) / spread, 0.0) if spread > 1e-15 else 0.0
        return max((y - b * x) / k, 0.0), b

    if not rows:
        return {}
    pooled = line(*(sum(r[c] for r in rows) for c in ("k", "y", "x", "xx", "xy")))
    out = {}
    for r in rows:
        a, b = ((r.k * own + POOLED_ROWS * every) / (r.k + POOLED_ROWS) for own, every in zip(line(r.k, r.y, r.x, r.xx, r.xy), pooled))
        if r.k >= LEAST_ROWS:
            out[r.lang] = (float(r["mean"]), max(float(a), 1e-4), float(b))
    return out


def _learned(docs: DataFrame):
    """Languages, shards of models and rejection limits from the training rows of ``docs``.

    The models count all training rows.  For the limits, the calibrating tenth
    is scored by models of the other rows alone.
    """
    own = _training(docs).where("doc_id is not null").select("doc_id", "text", "lang")
    with scope(docs.sparkSession):
        with scope(docs.sparkSession):
            most, tenth = (materialise(count_grams(own.where(c)), "char-grams", hand_on=True) for c in (~_calibrates(), _calibrates()))
            whole = materialise(most.unionByName(tenth).groupBy("lang", "high", "low").agg(F.sum("n").alias("n")), "all-char-grams", hand_on=True)
            fitted = models_of(most)
            if not fitted[0]:
                limits = {}
            else:
                limits = calibrate(materialise(_scored(own.where(_calibrates()), *fitted, ["lang"]), "calibration"))
        return *models_of(whole), limits


def identify(docs: DataFrame, training: DataFrame | None = None, z: float = REJECT_Z) -> DataFrame:
    """Return doc_id, held_out, lang_pred, score, entropy, rejected for every row of ``docs``.

    Models learn from text and lang of ``training`` (default ``docs``): rows
    with a language whose crc32(doc_id as text) mod 3 is not 1.  All of them are
    counted, so a language with a single training row is learned; a tenth of
    them also calibrates the rejection.  ``lang_pred`` is the language with the
    lowest cross-entropy a character (ties: the first by name), ``und`` for a
    null text, one without a letter, or when nothing can be learned; ``score``
    falls as other languages come near.  ``rejected`` holds for a text without
    a letter and for a cross-entropy far above what the language's own texts of
    that length have; a language with fewer than LEAST_ROWS calibrating rows
    rejects nothing for that, nor does anything where nothing can be learned.  Rows with a null id are not held out and never train; repeated rows
    stay; an empty table gives an empty result; other columns are not read.
    """
    langs, shards, limits = _learned(training if training is not None else docs)
    rows = docs.select("text", "doc_id", (fold("doc_id", HELD_OUT[0]) == HELD_OUT[1]).alias("held_out"))
    scored = _scored(rows, langs, shards, ["doc_id", "held_out"])
    far = F.lit(False)
    if limits:
        mean, a, b = (F.create_map(*[x for lang, v in sorted(limits.items()) for x in (F.lit(lang), F.lit(v[k]))])[F.col("lang_pred")] for k in range(3))
        far = F.coalesce(F.col("entropy") > mean + z * F.sqrt(a + b / F.greatest(F.col("n_scored"), F.lit(1))), F.lit(False))
    return scored.select("doc_id", "held_out", "lang_pred", "score", "entropy", (~F.col("has_letter") | far).alias("rejected"))


def keep_identified(docs: DataFrame, training: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` that language ID doesn't reject, with all columns, in one pass without a join.

    Null and empty texts and others without a letter go, as do those far from
    every language.  Languages that tie don't matter here; rows with null or
    repeated ids are each judged by their text; where no row has a language
    nothing can be learned, and all rows with a letter stay; an empty table
    gives an empty result; columns of any name pass through as they are.
    """
    langs, shards, limits = _learned(training if training is not None else docs)
    shared = docs.sparkSession.sparkContext.broadcast(np.array([limits.get(lang, (np.inf, 1.0, 0.0)) for lang in langs]).reshape(-1, 3).T)
    text_at = docs.columns.index("text")

    def run(batches):
        for batch in _gathered(batches, shards, text_at):
            mean, a, b = shared.value
            h, n, keep = _entropies(shards, [t or "" for t in batch.column(text_at).to_pylist()], len(mean))
            if len(mean):
                best, low = h.argmin(axis=1), h.min(axis=1)
                keep &= low <= mean[best] + REJECT_Z * np.sqrt(a[best] + b[best] / np.maximum(n, 1))
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(frugal(run), docs.schema)
