"""SimHash near-dedup: pigeonhole blocks over 64-bit fingerprints, then a Hamming check.

Two fingerprints that differ in at most three bits agree on at least three of
six blocks, whichever bits differ.  Each of the 20 choices of three blocks is
one table whose key (31 to 33 bits) all close pairs share in some table.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.arrow import frugal
from plumbline.llm.exact_dedup import keep_decided, raw_hashes
from plumbline.operators.graph import connected_components
from plumbline.storage import materialise, scope

SHINGLE = 3
MAX_BITS = 3
SEED = 42
#: Fingerprints compared with each other at once; larger buckets are split by further blocks.
BUCKET = 2048
_CHUNK = 1 << 15
_M64 = (1 << 64) - 1


def _blocks(bits: list[int], parts: int) -> list[list[int]]:
    cut = [len(bits) * i // parts for i in range(parts + 1)]
    return [bits[cut[i] : cut[i + 1]] for i in range(parts)]


def _mask(bits) -> int:
    return sum(1 << b for b in bits)


def tables(free: list[int]) -> list[int]:
    """Masks to key by, so that values which differ in at most three of the ``free`` bits share a key in one of them."""
    blocks = _blocks(free, 6)
    return [_mask(b for i in kept for b in blocks[i]) for kept in combinations(range(6), 3)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprint_of(text: str | bytes, shingle: int = SHINGLE) -> int:
    """SimHash of one whole text (UTF-8 or str): see ``fingerprints``."""
    words = (text.encode() if isinstance(text, str) else text).lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    ones, m = np.zeros(64, np.int64), len(words) - shingle + 1
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[:m].tolist()
    ends = ends[shingle - 1 :].tolist()
    for at in range(0, m, _CHUNK):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + _CHUNK], ends[at : at + _CHUNK])], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > m, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, raw_1, raw_2, fp)`` per row: words of the ASCII-lower-cased text, hashed in runs of ``shingle`` words, with the hashes of the text as it is.

    A bit is one if it is set in over half the XXH64 values.  Fewer words than
    ``shingle`` are hashed as one run; no words (or a null text) give zero.
    """

    def run(batches):
        for batch in batches:
            fps = [_signed(fingerprint_of(t or "", shingle)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(fps, pa.int64())], ["doc_id", "raw_1", "raw_2", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", *raw_hashes()).mapInArrow(frugal(run), f"doc_id {kind}, raw_1 long, raw_2 long, fp long")


def _keyed(rows: DataFrame, masks: Column) -> DataFrame:
    """One row for each fingerprint and mask: fp, free bits that are left, and the hash of the whole path of keys."""
    each = rows.withColumn("mask", F.explode(masks))
    key = F.xxhash64("path", "mask", F.col("fp").bitwiseAND(F.col("mask")))
    return each.select("fp", F.col("free").bitwiseAND(F.bitwise_not("mask")).alias("free"), key.alias("path"))


def _star(fps: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that span the components, within ``most`` bits, of a few distinct fingerprints."""
    n, left = len(fps), np.arange(len(fps))
    a, b = [], []
    while len(left) > 1:
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            near = np.bitwise_count(fps[left][:, None] ^ fps[front][None, :]) <= most if len(front) * len(left) <= 1 << 22 else None
            if near is None:
                front, rest = front[: max(1, (1 << 22) // len(left))], front[max(1, (1 << 22) // len(left)) :]
                near = np.bitwise_count(fps[left][:, None] ^ fps[front][None, :]) <= most
            else:
                rest = front[:0]
            hit = near.any(axis=1)
            a.append(left[hit])
            b.append(front[near[hit].argmax(axis=1)])
            front, left = np.concatenate([rest, left[hit]]), left[~hit]
    return (np.concatenate(a), np.concatenate(b)) if n > 1 and a else (np.zeros(0, int), np.zeros(0, int))


def _edges(keyed: DataFrame, most: int) -> DataFrame:
    """Verified edges that span the links inside each bucket; buckets have at most BUCKET fingerprints."""

    def run(batches):
        tail_path, tail_fp = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def solve(paths, fps):
            starts = np.flatnonzero(np.r_[True, paths[1:] != paths[:-1]])
            sizes = np.diff(np.r_[starts, len(paths)])
            out_a, out_b = [], []
            two = starts[sizes == 2]
            close = np.bitwise_count((fps[two] ^ fps[two + 1]).view(np.uint64)) <= most
            out_a.append(fps[two][close])
            out_b.append(fps[two + 1][close])
            for s, n in zip(starts[sizes > 2], sizes[sizes > 2]):
                group = np.unique(fps[s : s + n])
                i, j = _star(group.view(np.uint64), most)
                out_a.append(group[i])
                out_b.append(group[j])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], ["a", "b"])

        for batch in batches:
            paths = np.concatenate([tail_path, batch.column(0).to_numpy()])
            fps = np.concatenate([tail_fp, batch.column(1).to_numpy()])
            if not len(paths):
                continue
            cut = int(np.searchsorted(paths, paths[-1]))
            tail_path, tail_fp = paths[cut:], fps[cut:]
            if cut:
                yield solve(paths[:cut], fps[:cut])
        if len(tail_path):
            yield solve(tail_path, tail_fp)

    return keyed.select("path", "fp").repartition("path").sortWithinPartitions("path").mapInArrow(frugal(run), "a long, b long")


def close_pairs(fps: DataFrame, most: int = MAX_BITS) -> DataFrame:
    """Edges ``(a, b)`` between distinct fingerprints (column ``fp``) whose components are those of all links.

    Buckets of up to BUCKET fingerprints are solved inside a task and give a
    spanning forest of their links, never all pairs.  The bucket sizes are
    counted first; a larger bucket is split again by blocks of the bits its
    key leaves free (20 sub-keys, still without losing a link) before any of
    its rows move.  After two splits at most 8 bits are free, so a bucket then
    holds at most 256 fingerprints.
    """
    level0 = tables(list(range(64)))
    rows = fps.select("fp", F.lit(-1).cast("long").alias("free"), F.lit(0).cast("long").alias("path"))
    keyed = _keyed(rows, F.array(*[F.lit(_signed(m)).cast("long") for m in level0]))
    found = None
    subdivide = {_signed(_M64 & ~m): tables([b for b in range(64) if not m >> b & 1]) for m in level0}
    for level in range(3):
        sizes = keyed.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
        large = materialise(sizes.where(F.col("n") > BUCKET).select("path"), "large-buckets") if level < 2 else None
        if large is None or large.isEmpty():
            edges = _edges(keyed, most)
            found = edges if found is None else found.unionByName(edges)
            break
        edges = _edges(keyed.join(large, "path", "left_anti"), most)
        found = edges if found is None else found.unionByName(edges)
        masks = F.lit(None).cast("array<bigint>")
        for free, subs in subdivide.items():
            masks = F.when(F.col("free") == free, F.array(*[F.lit(_signed(m)).cast("long") for m in subs])).otherwise(masks)
        keyed = _keyed(keyed.join(large, "path", "left_semi"), masks)
        subdivide = {
            _signed(f & ~m & _M64): tables([b for b in range(64) if (f & ~m) >> b & 1])
            for f0, subs in subdivide.items()
            for f in [f0 & _M64]
            for m in subs
        }
    return found


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, most: int = MAX_BITS) -> DataFrame:
    """Return doc_id, fingerprint (16 hex digits) and component_id for every row of ``docs``.

    Rows are linked when their fingerprints differ in at most ``most`` (up to
    three) bits; component_id is the smallest doc_id that can be reached,
    itself included (null only if no member has an id).  Null and empty texts
    have fingerprint zero and are linked like any other; repeated rows stay
    repeated; an empty table gives an empty result; other columns are not read.

    Exact copies are one fingerprint, so only distinct fingerprints are keyed,
    joined and linked.  The last join has unique fingerprints on one side, and
    AQE may split the other where a group of copies is hot.
    """
    with scope(docs.sparkSession):
        marked, named = _named(docs, shingle, most)
        found = marked.join(named, "fp")
        return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


def _named(docs: DataFrame, shingle: int, most: int) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, raw_1, raw_2, fp)`` for every row, and for every fingerprint the first row of its component; both are handed on from the caller's scope.

    The first row has the smallest id (a null id comes last), then the smallest hashes of its text.
    """
    if not 0 <= most <= MAX_BITS:
        raise ValueError("blocks are laid out for up to three differing bits")
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "raw_1", "raw_2")
    marked = materialise(fingerprints(docs, shingle), "fingerprints", hand_on=True)
    distinct = materialise(marked.groupBy("fp").agg(F.min(row).alias("first")), "distinct-fingerprints")
    found = connected_components(close_pairs(distinct.select("fp"), most))
    linked = distinct.join(found, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    linked = materialise(linked, "linked-fingerprints")
    firsts = linked.groupBy("component").agg(F.min("first").alias("first"))
    return marked, materialise(linked.select("fp", "component").join(firsts, "component").select("fp", "first"), "components", hand_on=True)


def deduplicate(docs: DataFrame, shingle: int = SHINGLE, most: int = MAX_BITS) -> DataFrame:
    """One row of each component of near-duplicates: that with the smallest doc_id; all columns of ``docs``.

    A null id comes last; of rows with the smallest id and other texts one
    stays.  Rows go one by one: a text without a partner stays, whatever rows
    share its id (or have none).  Null and empty texts are near copies of each
    other; an empty table gives an empty result; extra columns of any name are
    kept.
    """
    spark = docs.sparkSession
    with scope(spark):
        with scope(spark):
            marked, named = _named(docs, shingle, most)
        own = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("raw_1") == F.col("first.raw_1")) & (F.col("raw_2") == F.col("first.raw_2"))
        decided = materialise(marked.join(named, "fp").select("doc_id", "raw_1", "raw_2", own.alias("kept")), "near-decisions")
        return keep_decided(docs, decided)
