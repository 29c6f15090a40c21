from __future__ import annotations

import random

import pytest
from tokenizers import Tokenizer

from plumbline.llm import edit_counts
from plumbline.llm.tokens import LONG_BLANK, encode, vocabulary_paths

PATHS = vocabulary_paths()
MARK = "<|endoftext|>"


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATHS[0])
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize(
    "text",
    ["a" + " " * 2_000_000 + "b c", "\n" * 2_000_000, "x" + " \n\t" * 400_000 + "yy's", "  " * 5000 + MARK + "\t" * 9000, "　" * 9000 + " z", "\x1c" * 9000 + "a", " " * (LONG_BLANK - 1) + "b" + "\n" * LONG_BLANK + "7"],
    ids=["spaces", "newlines", "mixed", "mark", "wide", "separators", "edge"],
)
def test_long_blank_runs_and_trees_equal_the_library(library, text):
    want = library(text)
    assert encode(text, PATHS).tolist() == want
    assert edit_counts.TokenTree(text, edit_counts.Counter(PATHS)).tokens == len(want)


def test_added_tokens_part_texts(library):
    rnd = random.Random(3)
    for _ in range(400):
        text = "".join(rnd.choices(["a", " ", "  ", MARK, "<|", "endoftext", "|>", "'s", "12"], k=rnd.randint(0, 12)))
        assert encode(text, PATHS).tolist() == library(text)


def test_trees_follow_added_tokens_through_edits(library):
    rnd, counter = random.Random(4), edit_counts.Counter(PATHS)
    parts = ["a", " ", "   ", MARK, "<|", "endoftext", "|>", ">", "'s", "12", "\n"]
    for _ in range(200):
        text = "".join(rnd.choices(parts, k=rnd.randint(0, 30)))
        tree = edit_counts.TokenTree(text, counter)
        for _ in range(6):
            at, cut, new = rnd.randint(0, len(text)), rnd.choice((0, 1, 4, 20)), "".join(rnd.choices(parts, k=rnd.randint(0, 3)))
            text = text[:at] + new + text[at + cut :]
            tree.edit(at, cut, new)
            assert (tree.text, tree.tokens, sum(tree.leaves()[0])) == (text, len(library(text)), len(text))
