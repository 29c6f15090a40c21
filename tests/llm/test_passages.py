from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import passages
from plumbline.llm.suffix import suffix_arrays

SCHEMA = "doc_id long, text string, h1 string, n int, anchor string"


def brute(rows):
    """Every window of every text counted in one dictionary."""
    bodies = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k : k + 200] for _, b in bodies for k in range(len(b) - 199))
    out = []
    for i, b in bodies:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k : k + 200] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def found(spark, rows):
    docs = spark.createDataFrame([(i, t, "clash", 1, "clash") for i, t in rows], SCHEMA)
    return sorted((tuple(r) for r in passages.repeated_passages(docs).collect()), key=repr)


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdeé", k=rng.randrange(1, 9))) for _ in range(n))


def mixed(seed):
    rng = random.Random(seed)
    shared = [prose(rng, k) for k in (30, 60, 120, 300)]
    rows = []
    for k in range(60):
        text = prose(rng, rng.randrange(5, 200))
        for _ in range(rng.randrange(4)):
            text += rng.choice(["", " "]) + rng.choice(shared)[rng.randrange(40) :] + prose(rng, rng.randrange(3))
        rows.append((k, text))
    whole = rows[7][1]
    return rows + [(100, whole), (101, whole), (102, whole[:350] + "#" + whole[351:]), (103, whole + "!"), (104, whole[1:])]


@pytest.mark.parametrize("seed, group", [(1, 8), (2, 2), (3, 0)])
def test_equals_a_dictionary_of_all_windows(spark, monkeypatch, seed, group):
    """With all groups in suffix arrays, some windows dealt out by hash, and all of them."""
    monkeypatch.setattr(passages, "GROUP", group)
    rows = mixed(seed)
    want = brute(rows)
    assert found(spark, rows) == want
    assert 10 < sum(r[2] > 0 for r in want) and any(r[3] > 1 for r in want)


def test_texts_that_repeat_themselves(spark):
    rows = [(1, "a" * 250), (2, "ab" * 500), (3, "x" * 200), (4, "y" * 199), (5, "y" * 199), (6, "z" * 5000), (7, "q" * 199 + "z" * 260), (8, "abcdefghij" * 19 + "abcdefghi"), (9, "abcdefghij" * 21), (10, "a b" * 60 + "#" + "a b" * 60)]
    assert found(spark, rows) == brute(rows)


def test_nulls_repeats_empties_and_other_letters(spark):
    long = prose(random.Random(3), 50)
    rows = [(1, None), (2, ""), (2, ""), (None, long), (None, "é" + long[:100]), (3, long), (3, long), (4, "é" * 150), (5, "é" * 100 + "e"), (6, "\x00\x01" * 150), (7, "\U0001f600" * 60), (8, long[:199] + "\U0001f600"), (9, "x" + long[:199] + "\U0001f601")]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []


def test_many_documents_share_a_passage(spark):
    rng = random.Random(9)
    passage = prose(rng, 60)
    rows = [(k, prose(rng, rng.randrange(60)) + passage + prose(rng, rng.randrange(60))) for k in range(400)]
    assert found(spark, rows) == brute(rows)


def test_long_text_over_slices(spark, monkeypatch):
    monkeypatch.setattr(passages, "_SLICE", 1000)
    rng = random.Random(5)
    part = prose(rng, 900)
    rows = [(1, prose(rng, 700) + part), (2, part[17:] + prose(rng, 400) + part[:301]), (3, prose(rng, 30)), (4, "k" * 3500), (5, part[990:1230])]
    assert found(spark, rows) == brute(rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=40), max_size=8), st.integers(1, 3))
def test_suffix_arrays_of_many_strings(strings, times):
    strings = [[x + 1 for x in s] * times + [0] for s in strings]
    size = np.array([len(s) for s in strings], np.int64)
    base = np.cumsum(size) - size
    got = suffix_arrays(np.array([x for s in strings for x in s], np.int32), base, size)
    assert got.tolist() == [b + k for s, b in zip(strings, base.tolist()) for k in sorted(range(len(s)), key=lambda k: s[k:])]


def test_each_window_lies_in_one_piece():
    rng = random.Random(2)
    texts = [prose(rng, k).encode() for k in (0, 3, 60, 200, 40, 0, 90)] + [b"w" * 900]
    ends = np.cumsum([0, *map(len, texts)])
    first, last, anchor, places = passages.pieces(np.frombuffer(b"".join(texts), np.uint8), ends)
    starts = [k for a, b in zip(first, last) for k in range(a, b + 1)]
    assert sorted(starts) == [e + k for e, t in zip(ends, texts) for k in range(len(t) - 199)]
    assert (last - first < 137).all() and (places[-3:] > 1).all()
