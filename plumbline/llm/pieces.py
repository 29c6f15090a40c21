"""SentencePiece encoding and decoding: batched numpy Viterbi over distinct words of equal length.

Words of one length advance together.  Substring hashes probe the sorted
piece keys, and vectorised maxima fill the back-pointers.  ``viterbi`` gives
the best-scoring segmentation (what the library does for unigram models).
A very long word is cut into blocks of equal length that advance together.
The public model is a byte-pair model, whose library ids come from ranked
merges instead; ``merges`` gives those by the same batching: in each round
every word of a length joins its best adjacent pair.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections import ChainMap
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plumbline.llm.arrow import crc

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Characters up to which words advance together; longer ones are cut into blocks of as many, which advance together.
LONG = 128
#: Blocks that advance together.
_BLOCKS = 1 << 10
_UNITS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_CACHE = 1 << 18
_LANES = 1 << 14
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)
_NONE = -1


def model_path(name: str = MODEL) -> str:
    """Path of a public model file."""
    import public_tokenizers

    return public_tokenizers.path(name)


class SortedKeys:
    """Sorted (mixed) hash keys; a table over their leading bits says where a probe starts."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        keys = self._mixed(keys)
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self.shift = np.uint64(64 - max(4, (8 * len(keys)).bit_length()))
        lead = (self.keys >> self.shift).astype(np.int64)
        self.first = np.searchsorted(lead, np.arange(1 << (64 - int(self.shift)))).astype(np.int32)
        self.depth = int(np.bincount(lead).max()) if len(lead) else 0

    @staticmethod
    def _mixed(hashes: np.ndarray) -> np.ndarray:
        """The hashes of short texts are small numbers; a one-to-one mix spreads them."""
        with np.errstate(over="ignore"):
            h = (hashes ^ hashes >> np.uint64(32)) * _MIX
        return h ^ h >> np.uint64(29)

    def probe(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each hash is a key, and its value (-1 if not)."""
        hashes = self._mixed(hashes)
        at = self.first[hashes >> self.shift]
        found, value = np.zeros(len(hashes), bool), np.full(len(hashes), _NONE)
        for d in range(self.depth):
            here = np.minimum(at + d, len(self.keys) - 1)
            hit = self.keys[here] == hashes
            found |= hit
            value = np.where(hit, self.values[here], value)
        return found, value


class Pieces:
    """The pieces of a model as sorted hash keys with their ids and scores."""

    def __init__(self, model_file: str | None = None, model_proto: bytes | None = None):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=model_file, model_proto=model_proto)
        size = lib.vocab_size()
        names = [lib.id_to_piece(i) for i in range(size)]
        special = [lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i) for i in range(size)]
        is_byte = [lib.is_byte(i) for i in range(size)]
        self.lib, self.size, self.unknown = lib, size, lib.unk_id()
        self.normal = [i for i in range(size) if not special[i] and not is_byte[i]]
        if any(SPACE in names[i].lstrip(SPACE) for i in self.normal):
            raise ValueError("a piece joins words; words can't be encoded apart")
        self.ids = {names[i]: i for i in self.normal}
        self.score = np.array([lib.get_score(i) for i in range(size)])
        self.longest = max(map(len, self.ids), default=0)
        self.byte_id = {names[i]: i for i in range(size) if is_byte[i]}
        self.of_byte = [self.byte_id.get(f"<0x{b:02X}>", self.unknown) for b in range(256)]
        self.unk_score = min((self.score[i] for i in self.normal), default=0.0) - 10.0
        keys = np.array([_text_hash(names[i]) for i in self.normal], np.uint64)
        if len(np.unique(keys)) != len(keys):
            raise ValueError("piece hashes collide")
        self.whole = SortedKeys(keys, np.array(self.normal, np.int64))
        self.length = np.zeros(size + 1, np.int64)
        for i in self.normal:
            self.length[i] = len(names[i])
        starts = {names[i][:k] for i in self.normal for k in range(1, len(names[i]) + 1)}
        starts = [(_text_hash(s), self.ids.get(s, _NONE)) for s in starts]
        self.starts = SortedKeys(np.array([h for h, _ in starts], np.uint64), np.array([i for _, i in starts], np.int64))
        surface = [bytes([int(n[3:5], 16)]) if b else b"" if s and i != self.unknown else (" ⁇ " if i == self.unknown else n.replace(SPACE, " ")).encode() for i, (n, s, b) in enumerate(zip(names, special, is_byte))]
        self.surface_size = np.array([len(x) for x in surface], np.int64)
        self.surface_at = np.cumsum(self.surface_size) - self.surface_size
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.names = names

    def probe(self, hashes: np.ndarray) -> np.ndarray:
        """Piece ids of substring hashes, or -1."""
        return self.whole.probe(hashes)[1]

    def fallback(self, ch: str) -> list[int]:
        """Ids of a character that no piece covers: its bytes, or the unknown id."""
        return [self.of_byte[b] for b in ch.encode("utf-8", "replace")] if self.byte_id else [self.unknown]


@lru_cache(maxsize=2)
def _pieces(path: str) -> Pieces:
    return Pieces(path)


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, _BASE, np.uint64))])


def _prefix(codes: np.ndarray) -> np.ndarray:
    """Hashes of all beginnings of the rows of ``codes`` (words x length)."""
    out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(codes.shape[1]):
            out[:, i + 1] = out[:, i] * _BASE + codes[:, i] + np.uint64(1)
    return out


def _between(prefix: np.ndarray, a: np.ndarray, b: np.ndarray, power: np.ndarray) -> np.ndarray:
    """Hashes of the substrings ``[a, b)`` of each row."""
    row = np.arange(len(prefix))
    with np.errstate(over="ignore"):
        return prefix[row, b] - prefix[row, a] * power[b - a]


def _text_hash(text: str) -> int:
    h = 0
    for ch in text:
        h = (h * int(_BASE) + ord(ch) + 1) & ((1 << 64) - 1)
    return h


def _codes(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), -1).astype(np.uint64)


def _named(p: Pieces, word: str, cuts: list[int]) -> list[int] | None:
    """Ids of the parts of ``word`` between ``cuts``; the text of each is looked up, so a hash collision can't pass."""
    out: list[int] = []
    for a, b in zip(cuts, cuts[1:]):
        i = p.ids.get(word[a:b])
        if i is not None:
            out.append(i)
        elif b - a == 1:
            out += p.fallback(word[a])
        else:
            return None
    return out


def _packed(p: Pieces, words: list[str], prefix: np.ndarray, power: np.ndarray, mark: np.ndarray, alone) -> list[bytes]:
    """Ids of each word's parts between the marked cuts, as little-endian 32-bit numbers.

    The pieces' texts, joined, are compared with the words, so a hash
    collision can't pass; if they differ, and for words with characters
    outside the vocabulary, parts are named one at a time (or the word is
    solved ``alone``).
    """
    row, at = np.nonzero(mark)
    inner = np.flatnonzero(row[1:] == row[:-1])
    row, a, b = row[inner], at[inner], at[inner + 1]
    with np.errstate(over="ignore"):
        ids = p.probe(prefix[row, b] - prefix[row, a] * power[b - a])
    first = np.searchsorted(row, np.arange(len(words) + 1))
    odd = set(row[p.length[ids] != b - a].tolist())
    plain = ids if not odd else ids[~np.isin(row, list(odd))]
    if "".join(map(p.names.__getitem__, plain.tolist())) != "".join(w for r, w in enumerate(words) if r not in odd):
        odd = set(range(len(words)))
    blob, first = ids.astype("<u4").tobytes(), (first * 4).tolist()
    out = [blob[x:y] for x, y in zip(first, first[1:])]
    for r in odd:
        named = _named(p, words[r], np.flatnonzero(mark[r]).tolist())
        out[r] = array("I", alone(p, words[r]) if named is None else named).tobytes()
    return out


def viterbi_batch(p: Pieces, words: list[str]) -> list[bytes]:
    """Best-scoring segmentations of words of one length; ties go to the longest piece at the end."""
    n = len(words[0])
    prefix, power = _prefix(_codes(words)), _powers(n)
    w = len(words)
    best = np.full((w, n + 1), -np.inf)
    back = np.zeros((w, n + 1), np.int64)
    best[:, 0] = 0
    for i in range(n):
        row, here = np.arange(w), best[:, i]
        for k in range(1, min(p.longest, n - i) + 1):
            with np.errstate(over="ignore"):
                hashes = prefix[row, i + k] - prefix[row, i] * power[k]
            begins, ids = p.starts.probe(hashes)
            cand = here[row] + np.where(ids >= 0, p.score[ids], p.unk_score if k == 1 else -np.inf)
            better = cand > best[row, i + k]
            best[row[better], i + k] = cand[better]
            back[row[better], i + k] = i
            row = row[begins]
            if not len(row):
                break
    mark = np.zeros((w, n + 1), bool)
    row, at = np.arange(w), np.full(w, n)
    while len(row):
        mark[row, at] = True
        row, at = row[at > 0], back[row, at][at > 0]
    return _packed(p, words, prefix, power, mark, viterbi_plain)


def _block_scores(p: Pieces, codes: np.ndarray, power: np.ndarray, span: int, left: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(i, k, rows, scores)`` of the pieces of ``k`` characters that begin at place ``i < span`` of each block (row of ``codes``); ``left``: characters of the word from the block's start on."""
    prefix = _prefix(codes)
    for i in range(span):
        row = np.flatnonzero(left > i)
        for k in range(1, p.longest + 1):
            row = row[left[row] >= i + k]
            if not len(row):
                break
            with np.errstate(over="ignore"):
                begins, ids = p.starts.probe(prefix[row, i + k] - prefix[row, i] * power[k])
            yield i, k, row, np.where(ids >= 0, p.score[ids], p.unk_score if k == 1 else -np.inf)
            row = row[begins]


def viterbi_long(p: Pieces, words: list[str]) -> list[list[int]]:
    """The same for long words of any lengths, in blocks that advance together.

    Any path stops at one of the first places of each block, as many as the
    longest piece has characters.  First every block is run from each of those
    places at once, which gives the best scores from place to place; these are
    chained block by block.  Then the blocks are run again from the true
    scores for the back-pointers.
    """
    if not words:
        return []
    entries, span = max(1, p.longest), max(LONG, 2 * p.longest)
    width, power = span + entries, _powers(entries)
    counts = [-(-len(w) // span) for w in words]
    first = np.cumsum(counts) - counts
    codes = np.zeros((sum(counts), width), np.uint64)
    left = np.zeros(sum(counts), np.int64)
    for w, n, b in zip(words, counts, first.tolist()):
        flat = np.zeros((n + 1) * span + entries, np.uint64)
        flat[: len(w)] = np.frombuffer(w.encode("utf-32-le", "surrogatepass"), np.uint32)
        codes[b : b + n] = np.lib.stride_tricks.sliding_window_view(flat, width)[: n * span : span]
        left[b : b + n] = len(w) - np.arange(n) * span
    begins = np.zeros(len(codes), bool)
    begins[first] = True
    groups = [slice(a, min(len(codes), a + _BLOCKS)) for a in range(0, len(codes), _BLOCKS)]
    start = np.full((len(codes) + 1, entries), -np.inf)
    for part in groups:
        best = np.full((part.stop - part.start, entries, width + 1), -np.inf)
        best[:, np.arange(entries), np.arange(entries)] = 0
        for i, k, row, score in _block_scores(p, codes[part], power, span, left[part]):
            best[row, :, i + k] = np.maximum(best[row, :, i + k], best[row, :, i] + score[:, None])
        for b in range(part.start, part.stop):
            if begins[b]:
                start[b], start[b, 0] = -np.inf, 0
            start[b + 1] = (start[b][:, None] + best[b - part.start, :, span : span + entries]).max(axis=0)
    back = np.full((len(codes), width + 1), _NONE, np.int32)
    for part in groups:
        best, own = np.full((part.stop - part.start, width + 1), -np.inf), back[part]
        best[:, :entries] = start[part]
        for i, k, row, score in _block_scores(p, codes[part], power, span, left[part]):
            cand, at = best[row, i] + score, i + k
            better = cand > best[row, at]
            best[row[better], at] = cand[better]
            own[row[better], at] = i
    out = []
    for w, b in zip(words, first.tolist()):
        at, path = len(w), [len(w)]
        while at:
            # A path's first stop in a block was reached from the block before.
            block = at // span
            if b + block == len(back) or at < block * span + 1 or block * span >= len(w) or back[b + block, at - block * span] < 0:
                block -= 1
            at = block * span + int(back[b + block, at - block * span])
            path.append(at)
        named = _named(p, w, path[::-1])
        out.append(viterbi_plain(p, w) if named is None else named)
    return out


def viterbi_plain(p: Pieces, word: str) -> list[int]:
    """The same for one word, position by position and by the pieces' texts: where hashes of pieces collide."""
    n = len(word)
    best, back = [-np.inf] * (n + 1), [0] * (n + 1)
    best[0] = 0.0
    ids, score = p.ids, p.score.tolist()
    for i in range(n):
        here = best[i]
        for k in range(1, min(p.longest, n - i) + 1):
            found = ids.get(word[i : i + k])
            cand = here + (score[found] if found is not None else p.unk_score if k == 1 else -np.inf)
            if cand > best[i + k]:
                best[i + k], back[i + k] = cand, i
    cuts, at = [n], n
    while at:
        at = back[at]
        cuts.append(at)
    return _named(p, word, cuts[::-1])


def merges_batch(p: Pieces, words: list[str]) -> list[bytes]:
    """Ranked merges of words of one length: each round joins every word's best pair, the leftmost on ties."""
    n = len(words[0])
    prefix, power = _prefix(_codes(words)), _powers(n)
    live = np.arange(len(words))
    cuts = np.tile(np.arange(n + 1), (len(words), 1))
    mark = np.zeros((len(words), n + 1), bool)

    def pair(rows, a, b):
        size = b - a
        ids = p.probe(_between(prefix[rows], a, b, power))
        return np.where((ids >= 0) & (size <= p.longest), p.score[ids], -np.inf)

    scores = np.column_stack([pair(live, cuts[:, i], cuts[:, i + 2]) for i in range(n - 1)]) if n > 1 else np.zeros((len(words), 0))
    while len(live):
        if scores.shape[1] == 0:
            mark[live[:, None], cuts] = True
            break
        at = scores.argmax(axis=1)
        row = np.arange(len(live))
        more = scores[row, at] > -np.inf
        mark[live[~more][:, None], cuts[~more]] = True
        live, cuts, scores, at = live[more], cuts[more], scores[more], at[more]
        if not len(live):
            break
        row, m = np.arange(len(live)), cuts.shape[1] - 1
        keep = np.ones(cuts.shape, bool)
        keep[row, at + 1] = False
        cuts = cuts[keep].reshape(len(live), m)
        keep = np.ones(scores.shape, bool)
        keep[row, at] = False
        scores = scores[keep].reshape(len(live), -1)
        if scores.shape[1]:
            left = at > 0
            if left.any():
                r, a = row[left], at[left] - 1
                scores[r, a] = pair(live[r], cuts[r, a], cuts[r, a + 2])
            right = at + 2 < m
            if right.any():
                r, a = row[right], at[right]
                scores[r, a] = pair(live[r], cuts[r, a], cuts[r, a + 2])
    return _packed(p, words, prefix, power, mark, _merged)


def merges_long(p: Pieces, words: list[str]) -> list[list[int]]:
    """The same for long words, each with a heap of pairs."""
    return [_merged(p, w) for w in words]


def _merged(p: Pieces, word: str) -> list[int]:
    n = len(word)
    end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    dead, heap, score = [False] * n, [], p.score

    def push(a: int) -> None:
        b = after[a]
        if b < n and (found := p.ids.get(word[a : end[b]]) if end[b] - a <= p.longest else None) is not None:
            heapq.heappush(heap, (-score[found], a, end[a], end[b]))

    for a in range(n - 1):
        push(a)
    while heap:
        _, a, mid, stop = heapq.heappop(heap)
        if dead[a] or end[a] != mid or after[a] >= n or end[after[a]] != stop:
            continue
        b = after[a]
        dead[b], end[a], after[a] = True, stop, after[b]
        if after[b] < n:
            before[after[b]] = a
        if before[a] >= 0:
            push(before[a])
        push(a)
    cuts, at = [0], 0
    while at < n:
        cuts.append(end[at])
        at = after[at]
    return _named(p, word, cuts)


_METHODS = {"viterbi": (viterbi_batch, viterbi_long), "merges": (merges_batch, merges_long)}


class Encoder:
    """Encodes texts word by word, by one or more methods, with a bounded memory of words."""

    def __init__(self, p: Pieces, *methods: str):
        self.p, self.methods = p, [_METHODS[m] for m in methods]
        self.known: dict[str, tuple[bytes, ...]] = {}

    def _learn(self, units: set[str]) -> None:
        if len(self.known) > _CACHE:
            self.known.clear()
        by_size: dict[int, list[str]] = {}
        for u in units.difference(self.known):
            if len(u) <= LONG:
                by_size.setdefault(len(u), []).append(u)
        for size, words in by_size.items():
            lanes = max(64, _LANES * 8 // size)
            for at in range(0, len(words), lanes):
                part = words[at : at + lanes]
                self.known.update(zip(part, zip(*[batch(self.p, part) for batch, _ in self.methods])))

    def encode(self, texts: list[str]) -> list[list[np.ndarray]]:
        """For each method the ids of whole texts, for a model without normalisation."""
        split = [_UNITS.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        units: set[str] = set()
        units.update(*split)
        self._learn(units)
        long_units = [u for u in units if len(u) > LONG]
        longer = dict(zip(long_units, zip(*[[array("I", ids).tobytes() for ids in long(self.p, long_units)] for _, long in self.methods])))
        get = ChainMap(longer, self.known).__getitem__ if longer else self.known.__getitem__
        out: list[list[np.ndarray]] = [[] for _ in self.methods]
        for row in split:
            found = list(map(get, row))
            for k, ids in enumerate(out):
                ids.append(np.frombuffer(b"".join([f[k] for f in found]), np.uint32))
        return out


def decode(p: Pieces, ids: np.ndarray) -> str:
    """Text of ids: piece bytes gathered in one step, without the leading space that encoding adds."""
    ids = ids.astype(np.int64)
    size = p.surface_size[ids]
    total = int(size.sum())
    place = np.arange(total) - np.repeat(np.cumsum(size) - size, size) + np.repeat(p.surface_at[ids], size)
    text = p.surface[place].tobytes().decode("utf-8", "replace")
    return text[1:] if text[:1] == " " else text


def encode_texts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Return doc_id, ids (the library's, by ranked merges) and best_ids (by Viterbi) for every row of ``docs``.

    A null or empty text has no ids; null and repeated doc_ids stay; an empty
    table gives an empty result; other columns are not read.
    """
    path = path or model_path()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        p = _pieces(path)
        encoder = Encoder(p, "merges", "viterbi")
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            arrays = [[x.astype(np.int32) for x in rows] for rows in encoder.encode(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(a, pa.list_(pa.int32())) for a in arrays]], ["doc_id", "ids", "best_ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>, best_ids array<int>")


def decode_ids(rows: DataFrame, column: str = "ids", path: str | None = None) -> DataFrame:
    """Return doc_id and the text that ``column`` decodes to; null ids decode to an empty text."""
    path = path or model_path()
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        p = _pieces(path)
        for batch in batches:
            texts = [decode(p, np.array(x or [], np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", column).mapInArrow(run, f"doc_id {kind}, text string")


def coded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Digest of encoding and decoding for every row of ``docs`` in one pass.

    doc_id, n_pieces and ids_crc32 of the Viterbi ids, library_pieces and
    library_crc32 of the library's ids (by ranked merges), and round_trip: both decode to the text
    (with U+2581 read as a space, as the model reads it).  Rows are as in
    ``encode_texts``.
    """
    path = path or model_path()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        p = _pieces(path)
        encoder = Encoder(p, "viterbi", "merges")
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            first, second = encoder.encode(texts)
            same = [t.replace(SPACE, " ") == decode(p, a) == decode(p, b) for t, a, b in zip(texts, first, second)]
            columns = [batch.column(0)]
            for ids in (first, second):
                columns += [pa.array([len(x) for x in ids], pa.int64()), pa.array([crc(x) for x in ids], pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(same)], ["doc_id", "n_pieces", "ids_crc32", "library_pieces", "library_crc32", "round_trip"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_pieces long, ids_crc32 long, library_pieces long, library_crc32 long, round_trip boolean")
