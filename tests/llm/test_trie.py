from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from plumbline.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, id int, key string"


def brute(rows):
    """Every prefix of every rebuilt conversation in one dictionary; sums by walking down."""
    order = lambda r: (r[1] is not None, r[1] or 0, hashlib.sha256(f"{len(r[2] or '')}:{r[2] or ''}{r[3] or ''}".encode()).hexdigest()[:32])
    own = {}
    for r in sorted((r for r in rows if r[0] is not None), key=order):
        own.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    members, ended = {}, {}
    for c, path in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        # Spark's remainder has the sign of the dividend.
        whole = own.get(c - (c % 5 if c >= 0 else -(-c % 5)), [])[:h] + path[h:]
        for d in range(len(whole) + 1):
            members.setdefault(tuple(whole[:d]), []).append(c)
        ended.setdefault(tuple(whole), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    out, saved, leaves = [], {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, [])
        leaves[node] = sum(leaves[b] for b in below) or 1
        saved[node] = (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0) + sum(saved[b] for b in below)
        ids = ",".join(map(str, sorted(ended.get(node, []))))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(members[node]), len(node), parent, len(members[node]), len(below), leaves[node], saved[node], hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(out)


def found(spark, rows):
    out = trie.prefix_trie(spark.createDataFrame([(*r, 1, "clash") for r in rows], SCHEMA))
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(r) for r in out.collect())


def made(rng, convs, turns, texts, ids=None):
    rows = [(c, t, rng.choice(["user", "assistant"]) if texts > 3 else "user", f"{'é' * rng.randrange(2)}t{rng.randrange(texts)}") for c in ids or range(convs) for t in range(rng.randrange(1, turns))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, convs, turns, texts", [(1, 60, 14, 2), (2, 200, 6, 3), (3, 150, 20, 1), (4, 80, 10, 40)])
def test_equals_all_prefixes(spark, seed, convs, turns, texts):
    rows = made(random.Random(seed), convs, turns, texts)
    assert found(spark, rows) == brute(rows)


def test_nulls_ties_repeats_and_gaps(spark):
    rng = random.Random(5)
    rows = made(rng, 0, 12, 2, ids=[-11, -10, -7, -5, -1, 0, 3, 7, 10, 11, 12, 10**15, 10**15 + 1])
    rows += [(3, None, None, None), (3, None, "user", None), (3, 1, "user", "t1"), (3, 1, "user", "t1"), (None, 0, "user", "t0"), (None, None, None, None)]
    rows += [(10, None, None, ""), (4, 0, "", None), (4, 0, None, ""), (21, 9, "user", "x" * 300_000), (22, 9, "user", "x" * 300_000)]
    assert found(spark, rows) == brute(rows)


def test_empty_and_single(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, 1, "a", "b")]) == []
    one = [(5, 0, "user", "hello")]
    assert found(spark, one) == brute(one) and len(brute(one)) == 2


def test_turnless_conversations(spark):
    """Own turns all replaced by a base that isn't there: the root alone, with its ends."""
    ids = [c for c in range(1, 40) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 2]
    rows = [(c, t, "user", "t") for c in ids for t in range(2)]
    want = brute(rows)
    assert len(want) == 1 and found(spark, rows) == want


def test_hot_conversation_and_long_one(spark):
    """Thousands of equal conversations, a first turn of all, and one conversation of 3,000 turns that another follows halfway."""
    rows = [(c, t, "user", f"same {t}") for c in range(0, 20_000, 5) for t in range(2)]
    rows += [(c, t, "user", f"same {t}" if t < 1500 or c == 100_000 else "other") for c in (100_000, 100_005) for t in range(3000)]
    rows += [(c, 0, "user", "same 0") for c in range(1, 200, 5)] + [(c, 1, "user", f"own {c}") for c in range(1, 200, 5)]
    assert found(spark, rows) == brute(rows)


def test_many_ranges_equal_few(spark):
    """Subtrees and chains that cross the borders of ranges: 61 ranges for some 300 sequences."""
    rows = made(random.Random(8), 300, 12, 2)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "61")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        assert found(spark, rows) == brute(rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_ends_of_one_group_in_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 3)
    rows = [(b"s", c) for c in range(-20, 200)] + [(b"t", 7), (b"u", 9), (b"u", 10)]
    out = {bytes(r.seq): r.ends_sha256 for r in trie.ends(spark.createDataFrame(rows, "seq binary, conv long")).collect()}
    assert out == {s: hashlib.sha256(",".join(str(c) for t, c in rows if t == s).encode()).hexdigest() for s in (b"s", b"t", b"u")}


def test_shared_turns_counts_whole_turns():
    a, b = bytes(range(48)), bytes(range(32)) + b"\xff" * 16
    assert [trie.shared_turns(a, b), trie.shared_turns(a, a[:16]), trie.shared_turns(a, a), trie.shared_turns(b"", a), trie.shared_turns(a, b"\xff" * 48)] == [2, 1, 3, 0, 0]
