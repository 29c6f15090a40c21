"""Conversation prefix trie: Patricia construction over sorted conversations.

Every distinct rebuilt conversation is one row: its turns as 16-byte digests in
one binary key, so that rows sort as the trie does.  In sorted order a row
brings the nodes below the length it shares with the row before it: its
*chain*.  A chain hangs on the last earlier chain that reaches above that
depth, which a stack over the sorted rows finds.  Only three kinds of points
are made on chains: ends (the bottom, where conversations end), branches (where
other chains hang), and leaves (ends without chains below).  Sums over subtrees
are worked out on that compressed tree; the unary nodes of an edge come last,
from suffix sums of the edge's bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.arrow import frugal
from plumbline.storage import materialise, scope

GROUP = 5
HEADS = 9
DIGEST = 16
#: Ids joined in one row before they are hashed: what a group with very many members sends on.
CHUNK = 4096
_BUCKET_BITS = 33
NO_ENDS = hashlib.sha256(b"").hexdigest()


def rebuilt(turns: DataFrame) -> DataFrame:
    """``(conv, key, sizes)``: each conversation's rebuilt turns, as digests of (role, text) in one binary, and their text bytes.

    The first h turns are those of conversation c - c % 5, h = crc32(c) % 9;
    what follows are c's own turns after its first h.  A turn travels as 30
    bytes or so, never with its text.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * DIGEST)
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), F.struct("turn", digest.alias("digest"), F.octet_length(text).alias("size")).alias("t"))
    own = rows.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("path"))
    heads = own.where(F.col("conv") % GROUP == 0).select(F.col("conv").alias("base"), F.slice("path", 1, HEADS - 1).alias("head"))
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % HEADS).cast("int")
    joined = own.withColumn("base", F.col("conv") - F.col("conv") % GROUP).join(heads, "base", "left")
    nothing = F.slice("path", 1, F.lit(0))
    path = F.concat(F.slice(F.coalesce("head", nothing), F.lit(1), h), F.slice("path", h + 1, F.size("path")))
    made = joined.select("conv", path.alias("path"))
    key = F.unhex(F.array_join(F.transform("path", lambda t: t["digest"]), ""))
    return made.select("conv", key.alias("key"), F.transform("path", lambda t: t["size"]).alias("sizes"))


def ends(members: DataFrame) -> DataFrame:
    """``(seq, ends_sha256)``: SHA-256 of each group's ids, ascending and comma-joined; ``members`` has seq and conv.

    Ids are joined in ranges of (seq, conv), so a group with a third of all
    rows is joined by many tasks; one task then hashes its few long rows as a
    stream.
    """

    def join(batches):
        seq, held = None, []

        def out():
            return pa.RecordBatch.from_arrays([pa.array([seq], pa.binary()), pa.array([held[0]], pa.int64()), pa.array([",".join(map(str, held))])], ["seq", "least", "ids"])

        for batch in batches:
            for s, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held and (s != seq or len(held) == CHUNK):
                    yield out()
                    held = []
                seq = s
                held.append(c)
        if held:
            yield out()

    def digest(batches):
        seq, state, done = None, None, ([], [])
        for batch in batches:
            for s, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                if s == seq:
                    state.update(b",")
                else:
                    if state is not None:
                        done[0].append(seq)
                        done[1].append(state.hexdigest())
                    seq, state = s, hashlib.sha256()
                state.update(ids.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array(done[0], pa.binary()), pa.array(done[1], pa.string())], ["seq", "ends_sha256"])
            done = ([], [])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([seq], pa.binary()), pa.array([state.hexdigest()])], ["seq", "ends_sha256"])

    chunks = members.select("seq", "conv").repartitionByRange("seq", "conv").sortWithinPartitions("seq", "conv").mapInArrow(frugal(join), "seq binary, least long, ids string")
    return chunks.repartition("seq").sortWithinPartitions("seq", "least").select("seq", "ids").mapInArrow(frugal(digest), "seq binary, ends_sha256 string")


def shared_turns(a: bytes, b: bytes) -> int:
    """How many leading turns two keys share."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // DIGEST
    low, high = 0, n // DIGEST
    while high - low > 1:
        middle = (low + high) // 2
        if a[: middle * DIGEST] == b[: middle * DIGEST]:
            low = middle
        else:
            high = middle
    return low


def _hang(stack: list[tuple[int, int]], depth: int) -> int | None:
    """The chain that a row with this shared depth hangs on, after those at or below the depth have left the stack."""
    while stack and stack[-1][0] >= depth:
        stack.pop()
    return stack[-1][1] if stack else None


def _scan(batches):
    """Chains of one range of sorted rows, then what later ranges need: the range's first and last key and its open chains."""
    bucket = TaskContext.get().partitionId()
    names = ["kind", "id", "shared", "up", "key", "sizes", "n_end", "first", "seq"]
    types = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.binary()]
    stack, last, at = [], None, bucket << _BUCKET_BITS

    def extra(kind, number, shared=None, key=None):
        values = dict.fromkeys(names) | {"kind": kind, "id": number, "shared": shared, "key": key}
        return pa.RecordBatch.from_arrays([pa.array([values[n]], t) for n, t in zip(names, types)], names)

    for batch in batches:
        shared, up, kept = [], [], at
        for key in batch.column("key").to_pylist():
            if last is None:
                yield extra("first", at, key=key)
                shared.append(None)
                up.append(None)
            else:
                depth = shared_turns(last, key)
                shared.append(depth)
                up.append(_hang(stack, depth))
                stack.append((depth, at))
            last, at = key, at + 1
        n = len(shared)
        yield pa.RecordBatch.from_arrays(
            [pa.array(["chain"] * n), pa.array(range(kept, at), pa.int64()), pa.array(shared, pa.int32()), pa.array(up, pa.int64()), pa.nulls(n, pa.binary()), *(batch.column(c).cast(t) for c, t in zip(names[5:], types[5:]))], names
        )
    if last is not None:
        yield extra("last", bucket << _BUCKET_BITS, key=last)
        for depth, number in stack:
            yield extra("open", number, depth)


def chains(sequences: DataFrame) -> DataFrame:
    """``(id, shared, up, sizes, n_end, first, seq)`` for each distinct sequence (key, sizes, n_end, first, seq), numbered in sorted order.

    ``shared`` is the depth that the chain hangs at (-1 for the first chain,
    which has the root), ``up`` the chain it hangs on.  Ranges are scanned
    alone; from each the driver takes two keys and the chains that are open at
    its end (at most one a turn of the last key), and what it gives back is as
    small.
    """
    spark = sequences.sparkSession
    kind = "kind string, id long, shared int, up long, key binary, sizes array<int>, n_end long, first long, seq binary"
    scanned = materialise(sequences.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(frugal(_scan), kind), "chains", hand_on=True)
    marks: dict[int, dict] = {}
    for r in sorted(scanned.where("kind != 'chain'").select("kind", "id", "shared", "key").collect(), key=lambda r: (r.id, r.shared or 0)):
        own = marks.setdefault(r.id >> _BUCKET_BITS, {"open": []})
        if r.kind == "open":
            own["open"].append((r.shared, r.id))
        else:
            own[r.kind] = bytes(r.key)
    stack, before, known = [], None, []
    for bucket in sorted(marks):
        depth = -1 if before is None else shared_turns(before, marks[bucket]["first"])
        up = _hang(stack, depth)
        stack.append((depth, bucket << _BUCKET_BITS))
        known.append((bucket, depth, up, [s for s, _ in stack], [i for _, i in stack]))
        if marks[bucket]["open"]:
            _hang(stack, marks[bucket]["open"][0][0])
        stack += marks[bucket]["open"]
        before = marks[bucket]["last"]
    ranges = spark.createDataFrame(known, "bucket long, in_depth int, in_up long, depths array<int>, owners array<long>")
    rows = scanned.where("kind = 'chain'").withColumn("bucket", F.shiftright("id", _BUCKET_BITS))
    rows = rows.join(F.broadcast(ranges), "bucket")
    opening = F.col("shared").isNull()
    reach = F.size(F.filter("depths", lambda d: d < F.col("shared")))
    up = F.when(opening, F.col("in_up")).otherwise(F.coalesce("up", F.element_at("owners", F.greatest(reach, F.lit(1)))))
    return rows.select("id", F.coalesce("shared", "in_depth").alias("shared"), up.alias("up"), "sizes", "n_end", "first", "seq")


def subtree_totals(nodes: DataFrame, sums: list[str], least: list[str] = ()) -> DataFrame:
    """``nodes`` (id, up, columns) with every column summed, or its least value taken, over the node and all below it.

    Pointers double: after k rounds a node has what lies less than 2^k above
    each node below it, so a tree of depth d takes log2(d) + 1 rounds.  A node
    with very many children gets one pre-aggregated row a task.
    """
    columns = [*sums, *least]
    total = nodes.select("id", "up", *columns)
    root = [r.id for r in total.where("up is null").select("id").take(1)]
    while root:
        lifted = total.where("up is not null")
        if lifted.isEmpty():
            break
        gained = lifted.groupBy(F.col("up").alias("id")).agg(*[F.sum(c).alias(f"{c}_below") for c in sums], *[F.min(c).alias(f"{c}_below") for c in least])
        added = [(F.col(c) + F.coalesce(f"{c}_below", F.lit(0))).alias(c) for c in sums] + [F.least(c, f"{c}_below").alias(c) for c in least]
        further = lifted.where(F.col("up") != root[0]).select(F.col("id"), F.col("up").alias("via"))
        jumps = further.join(lifted.select(F.col("id").alias("via"), F.col("up").alias("next_up")), "via").select("id", "next_up")
        total = materialise(total.join(gained, "id", "left").join(jumps, "id", "left").select("id", F.col("next_up").alias("up"), *added), "trie-totals", hand_on=True)
    return total.drop("up")


def _flat(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """How many values each list has (null: none), and all values."""
    return column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), column.flatten()


def _from_below(values: np.ndarray, counts: np.ndarray, op=np.add) -> np.ndarray:
    """Running ``op`` over each chain's points from its bottom up; points lie by chain, then depth."""
    out, starts = values.copy(), np.cumsum(counts) - counts
    by_count = np.argsort(-counts, kind="stable")
    starts, counts = starts[by_count], counts[by_count]
    for k in range(int(counts.max(initial=1)) - 2, -1, -1):
        at = starts[: np.searchsorted(-counts, -(k + 1))] + k
        out[at] = op(out[at], out[at + 1])
    return out


class _Points:
    """Points of a batch of chains (shared, sizes, n_end, first, hung), deepest last: the depths where chains hang, and the bottoms."""

    def __init__(self, batch: pa.RecordBatch):
        get = lambda name: batch.column(name).to_numpy(zero_copy_only=False)
        self.top, self.n_end, self.first = get("shared").astype(np.int64), get("n_end"), get("first")
        self.length, sizes = _flat(batch.column("sizes"))
        self.base = np.cumsum(self.length) - self.length
        self.bytes = np.r_[0, np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))]
        hung, each = _flat(batch.column("hung"))
        n = len(self.top)
        field = lambda name: each.field(name).to_numpy(zero_copy_only=False) if name in names else np.zeros(len(each), np.int64)
        names = [f.name for f in each.type]
        chain, depth = np.repeat(np.arange(n), hung), field("depth").astype(np.int64)
        ending = depth == self.length[chain]
        # A bottom where nothing hangs is a leaf and gets a point of its own.
        leaf = np.ones(n, bool)
        leaf[chain[ending]] = False
        lone = np.flatnonzero(leaf)
        chain = np.r_[chain, lone]
        order = np.lexsort((np.r_[depth, self.length[lone]], chain))
        add = lambda values, end: np.r_[values.astype(np.int64), np.broadcast_to(end, len(lone)).astype(np.int64)][order]
        self.chain, self.depth = chain[order], add(depth, self.length[lone])
        self.counts = np.bincount(self.chain, minlength=n)
        self.bottom = self.depth == self.length[self.chain]
        below = lambda values, op=np.add: _from_below(values, self.counts, op)
        self.convs = below(add(field("convs"), 0) + np.where(self.bottom, self.n_end[self.chain], 0))
        self.least = below(np.minimum(add(field("least"), np.iinfo(np.int64).max), np.where(self.bottom, self.first[self.chain], np.iinfo(np.int64).max)), np.minimum)
        self.leaves = below(add(field("leaves"), 1))
        self.children = add(field("children"), 0) + ~self.bottom
        start = np.r_[True, self.chain[1:] != self.chain[:-1]] if len(self.chain) else np.zeros(0, bool)
        self.above = np.where(start, self.top[self.chain], np.r_[0, self.depth[:-1]]) if len(start) else self.depth
        self.start = start
        at = self.base[self.chain]
        edge = self.bytes[at + self.depth] - self.bytes[at + np.maximum(self.above, 0)]
        self.weight = (self.convs - 1) * edge
        self.saved = below(add(field("saved"), 0) + self.weight)


def _batches(make):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield make(_Points(batch), batch)

    return frugal(run)


def _weights(points: _Points, batch: pa.RecordBatch) -> pa.RecordBatch:
    """A chain's own saved bytes, and the least conversation at each of its points."""
    own = np.zeros(len(points.top), np.int64)
    np.add.at(own, points.chain, points.weight)
    seen = np.r_[0, np.cumsum(points.counts)].astype(np.int32)
    places = pa.StructArray.from_arrays([pa.array(points.depth.astype(np.int32)), pa.array(points.least)], ["depth", "least"])
    return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(own), pa.ListArray.from_arrays(pa.array(seen), places)], ["id", "saved", "places"])


def _nodes(points: _Points, batch: pa.RecordBatch) -> pa.RecordBatch:
    """All nodes: each point, and the unary nodes of the edge above it from suffix sums of the edge's bytes."""
    n = points.depth - points.above
    point = np.repeat(np.arange(len(n)), n)
    up = np.arange(len(point)) - np.repeat(np.cumsum(n) - n, n)
    depth = points.above[point] + 1 + up
    chain = points.chain[point]
    itself = depth == points.depth[point]
    base = points.base[chain]
    # What the edge's nodes below this one save is counted with its own; the point's sum has the whole edge.
    before = points.bytes[base + np.maximum(depth - 1, 0)] - points.bytes[base + np.maximum(points.above[point], 0)]
    saved = points.saved[point] - (points.convs[point] - 1) * before
    no_parent = batch.column("parent_conv").is_null().to_numpy(zero_copy_only=False)
    outside = batch.column("parent_conv").fill_null(0).to_numpy(zero_copy_only=False)
    above_least = np.r_[points.least[:1], points.least[:-1]]
    parent = np.where(up > 0, points.least[point], np.where(points.start[point], outside[chain], above_least[point]))
    no_parent = no_parent[chain] & points.start[point] & (up == 0)
    digests = np.array(batch.column("ends_sha256").to_pylist(), dtype=object)
    ended = np.where(itself & points.bottom[point], digests[chain], NO_ENDS)
    columns = {
        "conv_id": points.least[point], "depth": depth, "n_convs": points.convs[point], "n_children": np.where(itself, points.children[point], 1),
        "n_leaves": points.leaves[point], "saved_tokens": saved,
    }
    arrays = [pa.array(v.astype(np.int64)) for v in columns.values()]
    return pa.RecordBatch.from_arrays([*arrays, pa.array(parent, mask=no_parent), pa.array(ended.tolist(), pa.string())], [*columns, "parent_conv_id", "ends_sha256"])


def _hung(chain: DataFrame, totals: DataFrame, columns: list[str], sums: list[str]) -> DataFrame:
    """``(id, hung)``: what hangs on each chain by depth, pre-aggregated where very many chains hang on one point."""
    rows = chain.where("up is not null").select("id", F.col("up"), F.col("shared").alias("depth")).join(totals, "id")
    points = rows.groupBy("up", "depth").agg(F.count(F.lit(1)).alias("children"), *[(F.sum if c in sums else F.min)(c).alias(c) for c in columns])
    return points.groupBy(F.col("up").alias("id")).agg(F.collect_list(F.struct("depth", "children", *columns)).alias("hung"))


def prefix_trie(turns: DataFrame) -> DataFrame:
    """One row for each distinct prefix of the rebuilt conversations, root included.

    Columns: conv_id (smallest member), depth, n_convs (members), n_children,
    n_leaves and saved_tokens (summed over the subtree), parent_conv_id,
    ends_sha256 (ids of the members that end there).

    ``turns`` has conv_id, turn, role, text.  Turns go by ``turn``, null first;
    of equal turns by their digests, and repeated rows are turns of their own.
    Null role or text is empty; rows without a conv_id belong to no
    conversation and are left out; an empty table gives an empty result; other
    columns are not read.

    Equal conversations become one row before they are sorted, so a
    conversation with a third of all copies is one row; a first turn that a
    third share is a prefix of many sorted rows, which range partitions split
    anywhere.  A conversation itself is one row, of some 30 bytes a turn.
    """
    spark = turns.sparkSession
    with scope(spark):
        members = materialise(rebuilt(turns).withColumn("seq", F.unhex(F.sha2("key", 256))), "conversations")
        digests = materialise(ends(members), "trie-ends", hand_on=True)
        sequences = members.groupBy("key").agg(F.first("sizes").alias("sizes"), F.count(F.lit(1)).alias("n_end"), F.min("conv").alias("first"), F.first("seq").alias("seq"))
        chain = materialise(chains(sequences), "trie-chains", hand_on=True)
        if chain.isEmpty():
            return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
        taken = chain.where("up is not null").groupBy(F.col("up").alias("id")).agg(F.max("shared").alias("deepest"))
        bare = F.when(F.col("deepest").eqNullSafe(F.size("sizes")), 0).otherwise(1)
        begun = chain.join(taken, "id", "left").select("id", "up", F.col("n_end").alias("convs"), bare.cast("long").alias("leaves"), F.col("first").alias("least"))
        totals = subtree_totals(begun, ["convs", "leaves"], ["least"])
        hung = _hung(chain, totals, ["convs", "leaves", "least"], ["convs", "leaves"])
        rows = chain.join(hung, "id", "left").select("id", "shared", "sizes", "n_end", "first", "hung")
        weights = materialise(rows.mapInArrow(_batches(_weights), "id long, saved long, places array<struct<depth:int,least:long>>"), "trie-weights")
        saved = subtree_totals(chain.select("id", "up").join(weights.select("id", "saved"), "id"), ["saved"])
        totals = materialise(totals.join(saved, "id"), "trie-subtrees")
        hung = materialise(_hung(chain, totals, ["convs", "leaves", "least", "saved"], ["convs", "leaves", "saved"]), "trie-hung", hand_on=True)
        places = weights.select(F.col("id").alias("up"), F.explode("places").alias("p")).select("up", F.col("p.depth").alias("shared"), F.col("p.least").alias("parent_conv"))
        parents = materialise(chain.select("id", "up", "shared").join(places, ["up", "shared"]).select("id", "parent_conv"), "trie-parents", hand_on=True)
    whole = chain.join(hung, "id", "left").join(parents, "id", "left").join(digests, "seq", "left")
    kinds = "conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long, parent_conv_id long, ends_sha256 string"
    nodes = whole.select("id", "shared", "sizes", "n_end", "first", "hung", "parent_conv", "ends_sha256").mapInArrow(_batches(_nodes), kinds)
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
