"""Token counts under edits: a segment tree over each document's pre-tokens.

A byte-pair vocabulary encodes pre-tokens one by one, so a document's count is
the sum of its pre-tokens' counts.  An edit re-splits the text only from the
first pre-token whose match could have looked at the edited place up to where
old and new borders meet again; only the new pre-tokens are encoded, and the
sums on their path to the root are updated.  A token that the vocabulary adds
(such as an end-of-text mark) parts the text and is a pre-token of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.tokens import added_pattern, added_tokens, count_pretoken, vocabulary_paths

#: Pre-tokens in a leaf block when a tree is built; a block that grows past GROWN times that is spread over its neighbours.
BLOCK = 64
GROWN = 8
#: Characters after a pre-token's end that the pattern may have looked at.
LOOKAHEAD = 2
_CACHE = 1 << 19
_LONG = 64


@lru_cache(maxsize=1)
def _pattern():
    import public_tokenizers

    return regex.compile(public_tokenizers.PATTERN)


class Counter(dict):
    """Token counts of pre-tokens, remembered for short ones."""

    def __init__(self, paths: tuple[str, str]):
        super().__init__()
        self.paths, self.added = paths, added_pattern(paths[0])
        #: Characters before an edit from which pre-tokens can change: an added token may become whole or broken, and the one before it looks ahead.
        self.back = LOOKAHEAD + max(map(len, added_tokens(paths[0])), default=0)

    def pretokens(self, text: str, start: int = 0) -> Iterator[str]:
        """Pre-tokens of ``text`` from ``start``, where one begins."""
        for m in self.added.finditer(text, start) if self.added else ():
            yield from (t[0] for t in _pattern().finditer(text, start, m.start()))
            yield m[0]
            start = m.end()
        yield from (t[0] for t in _pattern().finditer(text, start))

    def __missing__(self, token: str) -> int:
        n = count_pretoken(token, self.paths)
        if len(token) <= _LONG:
            if len(self) > _CACHE:
                self.clear()
            self[token] = n
        return n


class TokenTree:
    """Segment tree of one document: leaves are blocks of pre-tokens with their text, nodes hold sums of characters and of tokens.

    The text lies in the blocks alone, so an edit touches those around it and
    the sums above them, however long the document is.  A block that has grown
    too large is spread over the smallest subtree with room.
    """

    def __init__(self, text: str, counter: Counter, leaves: tuple[list[int], list[int]] | None = None):
        self.counter = counter
        if leaves is None:
            tokens = list(counter.pretokens(text))
            leaves = ([len(t) for t in tokens], [counter[t] for t in tokens])
        self.encoded = 0
        self._build(text, *leaves)

    def _build(self, text: str, chars: list[int], counts: list[int], width: int = 1) -> None:
        while width * BLOCK < len(chars):
            width *= 2
        self.width = width
        self.sums = [[0] * (2 * width) for _ in range(2)]
        self.blocks: list[tuple[list[int], list[int], str]] = [([], [], "")] * width
        self._fill(0, width, text, chars, counts)

    def _fill(self, first: int, width: int, text: str, chars: list[int], counts: list[int]) -> None:
        """Spread pre-tokens evenly over the blocks of a subtree (a block at least BLOCK, as far as they go), and sum up."""
        each, at = max(BLOCK, -(-len(chars) // width)), 0
        for k in range(width):
            own = chars[k * each : (k + 1) * each]
            size = sum(own)
            self.blocks[first + k] = (own, counts[k * each : (k + 1) * each], text[at : at + size])
            at += size
            for s, values in zip(self.sums, self.blocks[first + k]):
                s[self.width + first + k] = sum(values)
        low, high = self.width + first, self.width + first + width - 1
        while low > 1:
            low, high = low // 2, high // 2
            for s in self.sums:
                for node in range(low, high + 1):
                    s[node] = s[2 * node] + s[2 * node + 1]

    @property
    def tokens(self) -> int:
        return self.sums[1][1]

    @property
    def text(self) -> str:
        return "".join(b[2] for b in self.blocks)

    def leaves(self) -> tuple[list[int], list[int]]:
        """Characters and tokens of all pre-tokens in order: the state to store."""
        return [n for b in self.blocks for n in b[0]], [n for b in self.blocks for n in b[1]]

    def _find(self, place: int) -> tuple[int, int, int]:
        """Block, index in it, and start of the pre-token that holds the character at ``place`` (or the last one)."""
        node, start, chars = 1, 0, self.sums[0]
        while node < self.width:
            node *= 2
            if place >= start + chars[node] and chars[node + 1]:
                start += chars[node]
                node += 1
        block = node - self.width
        for i, n in enumerate(self.blocks[block][0]):
            if place < start + n:
                return block, i, start
            start += n
        last = len(self.blocks[block][0])
        return block, last, start

    def edit(self, position: int, delete: int, insert: str) -> None:
        """Replace ``delete`` characters at ``position`` by ``insert``; both are cut to what the text has.

        Pre-tokens are found in a window of the text that begins at the first
        one which may change; it grows while they could have looked beyond it.
        """
        total = self.sums[0][1]
        position = min(max(position, 0), total)
        delete = min(max(delete, 0), total - position)
        if not delete and not insert:
            return
        shift, back = len(insert) - delete, self.counter.back
        block, index, start = self._find(max(0, position - back))
        window, after, stop = self.blocks[block][2][sum(self.blocks[block][0][:index]) :], block + 1, 0
        stop, parts = start + len(window), [window]
        while stop < position + delete:
            parts.append(self.blocks[after][2])
            stop += len(parts[-1])
            after += 1
        window = "".join(parts)
        window = window[: position - start] + insert + window[position - start + delete :]
        old, b, i, more = start, block, index, 1
        new_chars, new_counts, met, end = [], [], False, 0
        while not met:
            whole = stop >= total
            for token in self.counter.pretokens(window, end):
                if not whole and end + len(token) > len(window) - back:
                    break
                end += len(token)
                new_chars.append(len(token))
                new_counts.append(self.counter[token])
                if start + end < position + len(insert):
                    continue
                while old < start + end - shift and b < self.width:
                    chars = self.blocks[b][0]
                    if i < len(chars):
                        old += chars[i]
                        i += 1
                    else:
                        b, i = b + 1, 0
                if old == start + end - shift:
                    met = True
                    break
            if met or whole:
                break
            parts = [window]
            for _ in range(more):
                if after < self.width:
                    parts.append(self.blocks[after][2])
                    stop += len(parts[-1])
                    after += 1
            window, more = "".join(parts), 2 * more
        if not met:
            b, i = self.width - 1, len(self.blocks[-1][0])
        elif b == self.width:
            b, i = self.width - 1, len(self.blocks[-1][0])
        self.encoded += len(new_chars)
        self._replace(block, index, b, i, window[:end], new_chars, new_counts)

    def _replace(self, block: int, index: int, to_block: int, to_index: int, text: str, chars: list[int], counts: list[int]) -> None:
        """Put new pre-tokens in place of those from ``(block, index)`` up to ``(to_block, to_index)``."""
        first, last = self.blocks[block], self.blocks[to_block]
        kept, rest = sum(first[0][:index]), sum(last[0][:to_index])
        for b in range(block + 1, to_block + 1):
            self.blocks[b] = ([], [], "")
        self.blocks[block] = (first[0][:index] + chars + last[0][to_index:], first[1][:index] + counts + last[1][to_index:], first[2][:kept] + text + last[2][rest:])
        if len(self.blocks[block][0]) > GROWN * BLOCK:
            for b in range(block + 1, to_block + 1):
                self._sum_up(b)
            self._spread(block)
            return
        for b in range(block, to_block + 1):
            node = self.width + b
            for s, values in zip(self.sums, self.blocks[b]):
                s[node] = sum(values)
        changed = set(range((self.width + block) // 2, (self.width + to_block) // 2 + 1))
        while changed and changed != {0}:
            for node in changed:
                for s in self.sums:
                    s[node] = s[2 * node] + s[2 * node + 1]
            changed = {n // 2 for n in changed} - {0}

    def _sum_up(self, block: int) -> None:
        node = self.width + block
        for s, values in zip(self.sums, self.blocks[block]):
            s[node] = sum(values)
        while node > 1:
            node //= 2
            for s in self.sums:
                s[node] = s[2 * node] + s[2 * node + 1]

    def _spread(self, block: int) -> None:
        """Spread a block over the smallest subtree around it that then has GROWN / 4 times BLOCK a block at most; if none has, over a tree of twice the width."""
        size = 1
        while size < self.width:
            size *= 2
            first = block // size * size
            part = self.blocks[first : first + size]
            if sum(len(p[0]) for p in part) <= size * max(1, GROWN // 4) * BLOCK:
                self._fill(first, size, "".join(p[2] for p in part), [n for p in part for n in p[0]], [n for p in part for n in p[1]])
                return
        self._build(self.text, *self.leaves(), 2 * self.width)


EDITS = "array<struct<position:int,remove:int,insert:string>>"
_STATE = "array<int>"


def sample_edits(text: Column) -> Column:
    """Three edits that follow from a text's length: insert words at a quarter, remove five characters in the middle, replace three at three quarters."""
    n = F.length(F.coalesce(text, F.lit("")))
    edit = lambda at, remove, insert: F.struct(at.cast("int").alias("position"), F.lit(remove).alias("remove"), F.lit(insert).alias("insert"))
    return F.array(edit(F.floor(n / 4), 0, " we've edited"), edit(F.floor(n / 2), 5, ""), edit(F.floor(n * 3 / 4), 3, "'ll  2024 "))


def count_tokens(rows: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """Count tokens before and after each row's ``edits``, and return the tree's leaves for the next round.

    ``rows`` has doc_id, text and edits (an array of position, remove, insert;
    applied in order, each to the text the one before left), and optionally
    ``leaf_chars`` and ``leaf_tokens`` from an earlier round, which spare the
    first encoding.  Positions and lengths are cut to the text; null edits,
    and null fields of an edit, count as none, zero and empty; a null text is
    empty; null and repeated ids stay; an empty table gives an empty result.

    Returns doc_id, text (edited), n_tokens, n_tokens_edited, n_pretokens,
    n_reencoded, leaf_chars, leaf_tokens.
    """
    paths = paths or vocabulary_paths()
    kind = rows.schema["doc_id"].dataType.simpleString()
    stored = {"leaf_chars", "leaf_tokens"} <= set(rows.columns)

    def run(batches):
        counter = Counter(paths)
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            columns = [c.to_pylist() for c in batch.columns]
            for i in range(batch.num_rows):
                leaves = (list(columns[3][i]), list(columns[4][i])) if stored and columns[3][i] is not None else None
                tree = TokenTree(columns[1][i] or "", counter, leaves)
                before = tree.tokens
                for e in columns[2][i] or []:
                    if e is not None:
                        tree.edit(e["position"] or 0, e["remove"] or 0, e["insert"] or "")
                chars, tokens = tree.leaves()
                for c, v in zip(out, (tree.text, before, tree.tokens, len(chars), tree.encoded, np.array(chars, np.int32), np.array(tokens, np.int32))):
                    c.append(v)
            kinds = [pa.string(), *[pa.int64()] * 4, pa.list_(pa.int32()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(out, kinds)]], _NAMES)

    rows = rows.select("doc_id", "text", "edits", *(["leaf_chars", "leaf_tokens"] if stored else []))
    return rows.mapInArrow(run, f"doc_id {kind}, text string, n_tokens long, n_tokens_edited long, n_pretokens long, n_reencoded long, leaf_chars {_STATE}, leaf_tokens {_STATE}")


_NAMES = ["doc_id", "text", "n_tokens", "n_tokens_edited", "n_pretokens", "n_reencoded", "leaf_chars", "leaf_tokens"]


def apply_edits(docs: DataFrame, edits: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """``count_tokens`` for an edit log: ``edits`` has doc_id, seq, position, remove, insert.

    Documents and edits are sorted by id and order within hash partitions and
    streamed: a task holds one document's tree and one batch, however many
    edits a document has (they depend on each other, so they are applied one
    after another).  Edits with a null id or of unknown documents are ignored;
    ties in seq go by position, remove and insert; a repeated doc_id gets the
    edits once, after its last row.

    Returns doc_id, text, n_tokens, n_tokens_edited, n_edits, n_reencoded.
    """
    paths = paths or vocabulary_paths()
    kind = docs.schema["doc_id"].dataType.simpleString()
    nothing = [F.lit(None).cast("int").alias("position"), F.lit(None).cast("int").alias("remove"), F.lit(None).cast("string").alias("insert")]
    both = docs.select("doc_id", F.lit(0).alias("is_edit"), F.lit(None).cast("long").alias("seq"), F.coalesce("text", F.lit("")).alias("text"), *nothing).unionByName(
        edits.where("doc_id is not null").select("doc_id", F.lit(1).alias("is_edit"), F.col("seq").cast("long"), F.lit(None).cast("string").alias("text"), F.col("position").cast("int"), F.col("remove").cast("int"), "insert")
    )
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64("text"))
    ordered = both.repartition("doc_id", spread).sortWithinPartitions("doc_id", "is_edit", "seq", "position", "remove", "insert")

    def run(batches):
        counter = Counter(paths)
        tree, doc_id, before, n_edits = None, None, 0, 0
        done: list[tuple] = []

        def flush():
            nonlocal done
            columns = list(zip(*done)) if done else [[]] * 6
            kinds = [id_type, pa.string(), *[pa.int64()] * 4]
            done = []
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["doc_id", "text", "n_tokens", "n_tokens_edited", "n_edits", "n_reencoded"])

        id_type = pa.int64()
        for batch in batches:
            id_type = batch.schema.field(0).type
            ids, is_edit, texts, at, remove, insert = (batch.column(k).to_pylist() for k in (0, 1, 3, 4, 5, 6))
            for k in range(batch.num_rows):
                if not is_edit[k]:
                    if tree is not None:
                        done.append((doc_id, tree.text, before, tree.tokens, n_edits, tree.encoded))
                    tree, doc_id, n_edits = TokenTree(texts[k], counter), ids[k], 0
                    before = tree.tokens
                elif tree is not None and doc_id == ids[k]:
                    tree.edit(at[k] or 0, remove[k] or 0, insert[k] or "")
                    n_edits += 1
            yield flush()
        if tree is not None:
            done.append((doc_id, tree.text, before, tree.tokens, n_edits, tree.encoded))
        yield flush()

    columns = ["doc_id", "is_edit", "seq", "text", "position", "remove", "insert"]
    return ordered.select(*columns).mapInArrow(run, f"doc_id {kind}, text string, n_tokens long, n_tokens_edited long, n_edits long, n_reencoded long")
