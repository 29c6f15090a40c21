from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from plumbline.llm import edit_counts
from plumbline.llm.tokens import encode, vocabulary_paths

PATHS = vocabulary_paths()
ALPHABET = "abc 's'll've  \n\t12,.é☃'re "


def edited(text, edits):
    for position, remove, insert in edits:
        position = min(max(position or 0, 0), len(text))
        text = text[:position] + (insert or "") + text[position + max(remove or 0, 0) :]
    return text


@pytest.mark.parametrize("block", [2, 64])
def test_trees_equal_full_counts_after_every_edit(monkeypatch, block):
    monkeypatch.setattr(edit_counts, "BLOCK", block)
    rnd, counter = random.Random(1), edit_counts.Counter(PATHS)
    for _ in range(300):
        text = "".join(rnd.choices(ALPHABET, k=rnd.randint(0, 80)))
        tree = edit_counts.TokenTree(text, counter)
        for _ in range(8):
            e = (rnd.randint(-2, len(text) + 2), rnd.choice((0, 0, 1, 3, 20)), "".join(rnd.choices(ALPHABET, k=rnd.choice((0, 1, 2, 30)))))
            text = edited(text, [e])
            tree.edit(*e)
            tokens = edit_counts._pattern().findall(text)
            assert (tree.text, tree.leaves()[0], tree.tokens) == (text, [len(t) for t in tokens], len(encode(text, PATHS)))
            assert all(s[i] == s[2 * i] + s[2 * i + 1] for s in tree.sums for i in range(1, tree.width))


def test_only_the_touched_region_is_encoded_again():
    tree = edit_counts.TokenTree("word " * 20_000, edit_counts.Counter(PATHS))
    tree.edit(50_000, 2, "xy")
    assert 0 < tree.encoded < 10


@pytest.mark.parametrize("block", [1, 3])
def test_windows_and_blocks_grow(monkeypatch, block):
    """Long pre-tokens, many insertions in one place, and deletions over many blocks, in tiny blocks."""
    monkeypatch.setattr(edit_counts, "BLOCK", block)
    rnd, counter = random.Random(2), edit_counts.Counter(PATHS)
    text = "x" * 500 + " " * 300 + "word 's " * 40
    tree = edit_counts.TokenTree(text, counter)
    for k in range(150):
        at = rnd.choice([250, 650, len(text) // 2, rnd.randrange(len(text) + 1)])
        e = (at, rnd.choice((0, 0, 1, 2, 90 if k % 9 == 0 else 0)), rnd.choice(("a b c ", " ", "", "'ll", "zz", "<|endoftext|>", "<|end", "oftext|>")))
        text = edited(text, [e])
        tree.edit(*e)
        assert tree.text == text and tree.tokens == len(encode(text, PATHS))
        assert tree.leaves()[0] == [len(t) for t in counter.pretokens(text)]
        assert all(s[i] == s[2 * i] + s[2 * i + 1] for s in tree.sums for i in range(1, tree.width))
        assert all(len(b[2]) == sum(b[0]) for b in tree.blocks)


def test_time_of_an_edit_does_not_follow_the_text():
    """A thousand edits in texts of 0.1 and 4 million characters; twice the time allows for deeper trees and colder memory."""
    import time

    counter, took = edit_counts.Counter(PATHS), {}
    for n in (100_000, 4_000_000):
        tree, rnd = edit_counts.TokenTree("some words, and more. " * (n // 22), counter), random.Random(3)
        places = [rnd.randrange(n - 100) for _ in range(1000)]
        began = time.process_time()
        for place in places:
            tree.edit(place, 3, " new text")
        took[n] = time.process_time() - began
    assert took[4_000_000] < 2 * took[100_000] + 0.05


EDITS = "doc_id long, seq int, position int, remove int, insert string, text string"


def log(n, seed=5):
    rnd = random.Random(seed)
    return [(rnd.randint(0, 9), s, rnd.randint(0, 60), rnd.randint(0, 8), "".join(rnd.choices(ALPHABET, k=4)), "clash") for s in range(n)]


def test_edit_log_is_applied_in_order(spark):
    docs = [(i, "some words and 's more " * i, 0) for i in range(10)] + [(50, None, 0), (None, "no id", 0)]
    edits = [*log(120), (77, 1, 0, 0, "unknown document", ""), (None, 1, 0, 0, "no id", ""), (50, 1, None, None, None, "")]
    out = edit_counts.apply_edits(spark.createDataFrame(docs, "doc_id long, text string, seq int"), spark.createDataFrame(edits, EDITS)).collect()
    assert len(out) == len(docs)
    for r in out:
        start = next(t for i, t, _ in docs if i == r.doc_id) or ""
        own = sorted(e[1:5] for e in edits if e[0] == r.doc_id and r.doc_id is not None)
        text = edited(start, [e[1:] for e in own])
        assert (r.text, r.n_tokens, r.n_tokens_edited, r.n_edits) == (text, len(encode(start, PATHS)), len(encode(text, PATHS)), len(own))


def test_rounds_continue_from_stored_leaves(spark):
    docs = spark.createDataFrame([(1, "first text's words " * 30, "x"), (2, None, "x"), (3, "", "x"), (3, "", "x")], "doc_id long, text string, n_tokens string")
    rows = docs.withColumn("edits", edit_counts.sample_edits(F.col("text")))
    first = edit_counts.count_tokens(rows)
    again = first.select("doc_id", "text", "leaf_chars", "leaf_tokens", edit_counts.sample_edits(F.col("text")).alias("edits"))
    a, b = first.collect(), edit_counts.count_tokens(again).collect()
    assert len(a) == len(b) == 4
    for r in [*a, *b]:
        assert r.n_tokens_edited == len(encode(r.text, PATHS)) == sum(r.leaf_tokens)
    assert sorted(r.n_tokens for r in b) == sorted(r.n_tokens_edited for r in a)


def test_null_edits_and_empty_table(spark):
    schema = f"doc_id long, text string, edits {edit_counts.EDITS}"
    rows = [(1, "a b", None), (2, "a b", [None, (None, None, None)]), (3, "a b", [(99, 99, "c")])]
    out = {r.doc_id: r for r in edit_counts.count_tokens(spark.createDataFrame(rows, schema)).collect()}
    assert out[1].text == out[2].text == "a b" and out[3].text == "a bc"
    assert edit_counts.count_tokens(spark.createDataFrame([], schema)).count() == 0
