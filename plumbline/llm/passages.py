"""Suffix-array dedup: bytes covered by a 200-byte string that starts anywhere else too.

Every window of 200 bytes has an anchor: the least hash of its 64-byte strings.
Equal windows have equal anchors, so texts are cut into pieces of consecutive
windows with one anchor (each window in exactly one piece, whose bytes overlap
the next), and only pieces whose anchor occurs again are looked at.  Pieces are
gathered by anchor as distinct contents with a count.  The suffix array of a
group of contents then says which windows start twice in it: they are
neighbours there.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.arrow import frugal, parts, utf8
from plumbline.llm.suffix import suffix_arrays
from plumbline.storage import materialise, scope

LENGTH = 200
ANCHOR = 64
#: Contents of one anchor that go into one suffix array; the windows of a larger group are first dealt out by their hash.
GROUP = 16
#: Bytes whose suffix arrays are made side by side.
BATCH = 1 << 22
_SLICE = 1 << 18
_SPAN = LENGTH - ANCHOR + 1
_PLACE = np.uint64((1 << 20) - 1)
_KEYS = ["c1", "c2"]


def _anchor_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hashes of all strings of ANCHOR (a power of two) bytes."""
    with np.errstate(over="ignore"):
        h, size, factor = data.astype(np.uint64) + np.uint64(1), 1, np.uint64(0x100000001B3)
        while size < ANCHOR:
            h, size, factor = h[:-size] * factor + h[size:], 2 * size, factor * factor
        h = h * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xFF51AFD7ED558CCD)
        return h ^ h >> np.uint64(33)


def pieces(data: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cut the texts ``data[ends[i] : ends[i + 1]]``, which lie one after the other, into pieces.

    ``(first, last, anchor, places)``: a piece has the windows that start at
    ``first`` up to ``last``; its anchor occurs at ``places`` positions at
    least.  Pieces never cross texts.  Whether equal windows share an anchor
    doesn't depend on where slices begin.
    """
    out = []
    for at in range(int(ends[0]), int(ends[-1]) - length + 1, _SLICE):
        part = data[at : min(at + _SLICE + length - 1, int(ends[-1]))]
        h = _anchor_hashes(part)
        # Least hash, then first place, in one number; both come out of one sliding minimum.
        least, size, span = h & ~_PLACE | np.arange(len(h), dtype=np.uint64), 1, length - ANCHOR + 1
        while 2 * size <= span:
            least, size = np.minimum(least[:-size], least[size:]), 2 * size
        if size < span:
            least = np.minimum(least[: size - span], least[span - size :])
        value = least >> np.uint64(20)
        cut = np.r_[True, value[1:] != value[:-1]]
        borders = ends[np.searchsorted(ends, at) : np.searchsorted(ends, at + len(part), "right")] - at
        for border in (borders, borders - length + 1):
            cut[border[(border >= 0) & (border < len(cut))]] = True
        first = np.flatnonzero(cut)
        last = np.r_[first[1:], len(cut)] - 1
        # Long runs (text that repeats itself) are cut to the size of others.
        n = (last - first) // span + 1
        run, many = np.repeat(np.arange(len(first)), n), np.cumsum(n) - n
        begin = first[run] + (np.arange(len(run)) - many[run]) * span
        finish = np.minimum(begin + span - 1, last[run])
        moved = np.r_[0, np.cumsum(least[1:] != least[:-1])]
        text = np.searchsorted(ends, begin + at, "right")
        inside = begin + at + length <= ends[np.minimum(text, len(ends) - 1)]
        begin, finish = begin[inside], finish[inside]
        place = least[begin] & _PLACE
        out.append((begin + at, finish + at, h[place.astype(np.int64)].view(np.int64), 1 + moved[finish] - moved[begin]))
    if not out:
        return (np.zeros(0, np.int64),) * 4
    return tuple(np.concatenate(x) for x in zip(*out))


def _slabs(column: pa.Array):
    """``(first row, end row, bytes, offsets)`` of some rows of a text column at a time."""
    data, offsets = utf8(column)
    for a, b in parts(np.diff(offsets).tolist(), _SLICE):
        yield a, b, data, offsets[a : b + 1]


def anchors(texts: DataFrame) -> DataFrame:
    """``(anchor, h1, h2, places)`` for each piece of ``texts`` (h1, h2, text)."""

    def run(batches):
        for batch in batches:
            h1, h2 = (batch.column(k).to_numpy() for k in (0, 1))
            for a, b, data, offsets in _slabs(batch.column(2)):
                first, _, anchor, places = pieces(data, offsets)
                row = np.searchsorted(offsets, first, "right") - 1 + a
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(h1[row]), pa.array(h2[row]), pa.array(places.astype(np.int32))], ["anchor", "h1", "h2", "places"])

    return texts.select("h1", "h2", "text").mapInArrow(frugal(run), "anchor long, h1 long, h2 long, places int")


def _content_hashes(bodies: list[bytes]) -> list[pa.Array]:
    digests = np.array([xxhash.xxh3_128_digest(b) for b in bodies], dtype="S16") if bodies else np.zeros(0, "S16")
    halves = np.frombuffer(digests.tobytes(), dtype="<i8").reshape(-1, 2)
    return [pa.array(halves[:, k].copy()) for k in (0, 1)]


def candidate_pieces(texts: DataFrame) -> DataFrame:
    """``(h1, h2, begin, anchor, c1, c2, n, body)``: the pieces of ``texts`` (h1, h2, n, text, wanted) whose anchor is in the text's list."""
    names = ["h1", "h2", "begin", "anchor", "c1", "c2", "n", "body"]

    def run(batches):
        for batch in batches:
            h1, h2, n = (batch.column(k).to_numpy() for k in range(3))
            wanted = batch.column(4)
            for a, b, data, offsets in _slabs(batch.column(3)):
                first, last, anchor, _ = pieces(data, offsets)
                row = np.searchsorted(offsets, first, "right") - 1
                sought = wanted.slice(a, b - a)
                pairs = np.unique(np.rec.fromarrays([np.repeat(np.arange(b - a), sought.value_lengths().to_numpy(zero_copy_only=False)), sought.flatten().to_numpy()]))
                at = np.isin(np.rec.fromarrays([row, anchor], dtype=pairs.dtype), pairs)
                first, last, anchor, row = first[at], last[at], anchor[at], row[at]
                bodies = [data[x : y + LENGTH].tobytes() for x, y in zip(first.tolist(), last.tolist())]
                row += a
                columns = [pa.array(h1[row]), pa.array(h2[row]), pa.array(first - offsets[row - a]), pa.array(anchor), *_content_hashes(bodies), pa.array(n[row]), pa.array(bodies, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names)

    return texts.select("h1", "h2", "n", "text", "wanted").mapInArrow(frugal(run), "h1 long, h2 long, begin long, anchor long, c1 long, c2 long, n long, body binary")


def repeated_starts(groups: list[list[tuple[bytes, int]]], length: int = LENGTH) -> list[np.ndarray]:
    """For each content (bytes, count) of each group, which of its windows start anywhere else in the group; a content that occurs twice repeats all of its windows.

    A group is one string: contents with a separator below all bytes between
    them and a lower end.  Windows that begin alike are neighbours in its
    suffix array.
    """
    bodies, kept = [b for g in groups for b, _ in g], [n for g in groups for _, n in g]
    sizes = np.array([len(b) for b in bodies], np.int64)
    begin = np.cumsum(sizes + 1) - sizes - 1
    data = np.frombuffer(b"\0".join(bodies) + bytes(9), np.uint8)
    total = int(sizes.sum()) + len(bodies)
    symbols = data[:total].astype(np.int32) + 2
    symbols[begin + sizes] = 1
    final = np.cumsum([len(g) for g in groups]) - 1
    symbols[(begin + sizes)[final]] = 0
    base = np.r_[0, (begin + sizes + 1)[final][:-1]]
    order = suffix_arrays(symbols, base, np.diff(np.r_[base, total]))
    found, starts = np.zeros(total + 1, np.int8), np.zeros(total + 1, np.int8)
    many = np.array(kept) > 1
    np.add.at(starts, begin, 1)
    np.add.at(starts, np.maximum(begin, begin + sizes - length + 1), -1)
    valid = np.cumsum(starts)[:total] > 0
    x, y = order[:-1].astype(np.int64), order[1:].astype(np.int64)
    same = np.ones(len(x), bool)
    same[base[1:] - 1] = False
    same &= valid[x] & valid[y]
    x, y = x[same], y[same]
    words = np.ndarray((total,), "<u8", data.tobytes(), strides=(1,))
    for k in [*range(0, length - 7, 8), length - 8]:
        alike = words[x + k] == words[y + k]
        x, y = x[alike], y[alike]
    found[x] = found[y] = 1
    return [np.ones(max(0, s - length + 1), bool) if m else found[b : b + max(0, s - length + 1)] > 0 for b, s, m in zip(begin.tolist(), sizes.tolist(), many.tolist())]


def _runs(flags: np.ndarray) -> tuple[list[int], list[int]]:
    """First and last position of each run of set flags."""
    edge = np.diff(np.r_[0, flags.astype(np.int8), 0])
    return np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist()


_RUNS = "c1 long, c2 long, low int, high int"


def _solved(contents: DataFrame) -> DataFrame:
    """``(c1, c2, low, high)``: runs of repeated windows of contents (anchor, c1, c2, n, body), by suffix arrays of whole anchors."""

    def solve(held):
        """The runs of the rows (anchor, c1, c2, n, body), which are sorted by anchor."""
        groups, before = [], None
        for anchor, _, _, n, body in held:
            if anchor != before:
                groups.append([])
            groups[-1].append((body, n))
            before = anchor
        out = ([], [], [], [])
        for (_, c1, c2, _, _), flags in zip(held, repeated_starts(groups)):
            low, high = _runs(flags)
            for column, values in zip(out, ([c1] * len(low), [c2] * len(low), low, high)):
                column.extend(values)
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["c1", "c2", "low", "high"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if size > BATCH and row[0] != held[-1][0]:
                    yield solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield solve(held)

    return contents.select("anchor", "c1", "c2", "n", "body").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(frugal(run), _RUNS)


def _dealt(contents: DataFrame) -> DataFrame:
    """The same for anchors with many contents: their windows are counted by 128-bit hash, so no task holds an anchor."""

    def windows(batches):
        for batch in batches:
            for body, c1, c2, n in zip(*(batch.column(k).to_pylist() for k in (3, 0, 1, 2))):
                m = len(body) - LENGTH + 1
                hashes = _content_hashes([body[k : k + LENGTH] for k in range(m)])
                yield pa.RecordBatch.from_arrays([*hashes, pa.array([c1] * m), pa.array([c2] * m), pa.array(range(m), pa.int32()), pa.array([n] * m)], ["w1", "w2", "c1", "c2", "at", "n"])

    rows = materialise(contents.select("c1", "c2", "n", "body").mapInArrow(frugal(windows), "w1 long, w2 long, c1 long, c2 long, at int, n long"), "anchor-windows")
    twice = rows.groupBy("w1", "w2").agg(F.sum("n").alias("n")).where("n > 1").select("w1", "w2")
    return rows.join(twice, ["w1", "w2"], "left_semi").select("c1", "c2", F.col("at").alias("low"), F.col("at").alias("high"))


def _text_keys() -> list[Column]:
    text = F.coalesce("text", F.lit(""))
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("b"), text).alias("h2")]


def candidates(docs: DataFrame) -> DataFrame:
    """``(h1, h2, n, text, wanted)``: distinct texts by 128-bit hash that have an anchor which occurs again, how often each occurs, and those anchors.

    Anchors are counted with partial aggregation, and copies of a text become
    one row with a count before they move.
    """
    long = docs.where(F.octet_length("text") >= LENGTH).select(*_text_keys(), "text")
    every = materialise(anchors(long), "anchors", hand_on=True)
    again = every.groupBy("anchor").agg(F.sum("places").alias("places")).where("places > 1").select("anchor")
    wanted = every.join(again, "anchor", "left_semi").groupBy("h1", "h2").agg(F.collect_set("anchor").alias("wanted"))
    return long.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.first("text").alias("text")).join(wanted, ["h1", "h2"])


def removed_spans(texts: DataFrame) -> DataFrame:
    """``(h1, h2, spans)``: for each of ``texts`` (as of ``candidates``) that has any, the runs (low, high) of its windows that start anywhere else too.

    No step gathers the rows of an anchor: equal pieces become one row with a
    count before they move.
    """
    with scope(texts.sparkSession):
        found = materialise(candidate_pieces(texts), "pieces")
        contents = materialise(found.groupBy("anchor", *_KEYS).agg(F.sum("n").alias("n"), F.first("body").alias("body")), "contents")
        large = materialise(contents.groupBy("anchor").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > GROUP).select("anchor"), "large-anchors")
        solved = _solved(contents.join(large, "anchor", "left_anti")).unionByName(_dealt(contents.join(large, "anchor", "left_semi")))
        runs = solved.groupBy(*_KEYS).agg(F.collect_list(F.struct("low", "high")).alias("runs"))
        each = found.select("h1", "h2", "begin", *_KEYS).join(runs, _KEYS).select("h1", "h2", "begin", F.explode("runs").alias("r"))
        span = F.struct((F.col("begin") + F.col("r.low")).alias("low"), (F.col("begin") + F.col("r.high")).alias("high"))
        return materialise(each.groupBy("h1", "h2").agg(F.collect_list(span).alias("spans")), "spans", hand_on=True)


def without_spans(data: np.ndarray, offsets: np.ndarray, row: np.ndarray, low: np.ndarray, high: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts ``data[offsets[i] : offsets[i + 1]]`` without the windows that start at ``low`` up to ``high`` of text ``row``.

    ``(bytes that stay, their offsets by text, maximal runs that went by text)``.
    """
    begin, end = int(offsets[0]), int(offsets[-1])
    at = offsets[row] - begin
    edge = np.bincount(at + low, minlength=end - begin + 1) - np.bincount(at + high + length, minlength=end - begin + 1)
    gone = np.cumsum(edge[: end - begin]) > 0
    first = gone & ~np.r_[False, gone[:-1]]
    heads = offsets[:-1][np.diff(offsets) > 0] - begin
    first[heads] = gone[heads]
    by_text = lambda flags: np.diff(np.r_[0, np.cumsum(flags)][offsets - begin])
    return data[begin:end][~gone], np.r_[0, np.cumsum(by_text(~gone))], by_text(first)


def repeated_passages(docs: DataFrame) -> DataFrame:
    """Return doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of ``docs``.

    A byte goes if it is covered by a string of 200 bytes that also starts at
    any other place of the table, the same text included (starts may overlap);
    all is judged on the texts as they are.  A null text is empty; texts under
    200 bytes lose nothing but are kept whole; equal texts (rows that repeat
    included) are copies of each other and go whole; a null or repeated doc_id
    changes nothing; an empty table gives an empty result; other columns are
    not read.
    """
    names = ["h1", "h2", "n_removed", "n_spans", "cut_sha256"]

    def cut(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            spans = batch.column(3)
            row = np.repeat(np.arange(len(spans)), spans.value_lengths().to_numpy(zero_copy_only=False))
            low, high = (spans.flatten().field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            kept, at, runs = without_spans(data, offsets, row, low, high)
            digests = [hashlib.sha256(kept[x:y]).hexdigest() for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(offsets) - np.diff(at)), pa.array(runs), pa.array(digests, pa.string())], names)

    with scope(docs.sparkSession):
        with scope(docs.sparkSession):
            texts = materialise(candidates(docs), "candidate-texts", hand_on=True)
        spans = removed_spans(texts)
        touched = texts.select("h1", "h2", "text").join(spans, ["h1", "h2"])
        done = materialise(touched.mapInArrow(frugal(cut), "h1 long, h2 long, n_removed long, n_spans long, cut_sha256 string"), "cut-texts", hand_on=True)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), *_text_keys(), F.sha2(text, 256).alias("sha")).join(done, ["h1", "h2"], "left")
    zero = F.lit(0).cast("long")
    return rows.select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("cut_sha256", "sha").alias("kept_sha256"))
