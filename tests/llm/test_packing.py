from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pytest

from plumbline.llm import packing
from plumbline.llm.tokens import encode, vocabulary_paths

SCHEMA = "doc_id long, text string, start string, left binary"
TEXTS = ["", None, "hello world", "<|endoftext|> x", "word " * 3000, "é☃\U0001f600 \n\n  tabs\t", "a" * 9000, "b"]


def reference_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_paths()[0]).encode(text or "", add_special_tokens=False).ids


def test_fast_ids_equal_the_tokenizer_file():
    for text in TEXTS:
        assert encode(text or "", vocabulary_paths()).tolist() == reference_ids(text)


def check(pieces, texts, capacity):
    ids = {k: np.array(reference_ids(t) + [0], "<u4") for k, t in texts.items()}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
        assert p.doc_tokens == len(ids[p.doc_id])
        assert p.ids_crc32 == zlib.crc32(ids[p.doc_id][p.start : p.start + p.length].tobytes())
    assert set(by_doc) == set(texts)
    for k, own in by_doc.items():
        at = 0
        for p in sorted(own, key=lambda p: p.start):
            assert p.start == at and p.length > 0
            at += p.length
        assert at == len(ids[k])
    fill = []
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity
        fill.append(at)
    return fill


@pytest.mark.parametrize("partitions", [1, 5])
def test_every_id_in_one_piece_and_little_padding(spark, partitions):
    rows = [(i, t, "x", b"y") for i, t in enumerate(TEXTS)] + [(100 + i, "some words here " * (i % 50), "x", b"y") for i in range(300)]
    pieces = packing.pack(spark.createDataFrame(rows, SCHEMA).repartition(partitions)).collect()
    fill = check(pieces, {r[0]: r[1] for r in rows}, 1024)
    assert sum(n < 1024 for n in fill) == 1


def test_null_and_repeated_ids_and_empty_table(spark):
    rows = [(None, "a b", "x", b"y"), (None, "c d", "x", b"y"), (4, "same", "x", b"y"), (4, "same", "x", b"y")]
    pieces = packing.pack(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sum(p.length for p in pieces) == sum(len(reference_ids(r[1])) + 1 for r in rows)
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0


def test_windows_stay_bounded_and_full_ones_leave_at_once():
    out = []
    packer = packing.Packer(lambda w, pieces, closed: out.append((w, sum(len(p[2]) for p in pieces), closed)), 0, capacity=16, windows=3)
    for n in (9, 10, 11, 5, 6, 12, 40, 1, 15):
        packer.add("d", 0, np.arange(n, dtype=np.uint32), n)
        assert len(packer.open) <= 3
    packer.close()
    assert all(n == 16 for _, n, closed in out if closed) and sum(n for _, n, _ in out) == 109
    assert sum(not closed for _, _, closed in out) <= 1
