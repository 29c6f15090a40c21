from __future__ import annotations

import random
import warnings

import numpy as np
import pytest

from plumbline.llm import pieces
from plumbline.llm.arrow import crc

SCHEMA = "doc_id long, text string, ids string, best_ids int"
ALPHABET = "etaoin shrdlu  ▁éßñ☃\n\tABC123.,;'\"\U0001f600\x00中文字"


def texts():
    rnd = random.Random(6)
    out = ["".join(rnd.choices(ALPHABET, k=rnd.randint(0, 60))) for _ in range(600)]
    return [*out, "", "  ", " ", "a" * 500, "the " * 50 + "x" * 300 + " y", "▁▁", "é" * 200, "abc" * 100]


def unigram_model():
    """The public model's pieces as a unigram model; the blank runs get a plain score."""
    warnings.filterwarnings("ignore")
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(pieces.model_path(), "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    for p in proto.pieces:
        p.score = max(p.score, -40000.0)
    return proto.SerializeToString()


def test_viterbi_equals_the_library_on_a_unigram_model():
    p = pieces.Pieces(model_proto=unigram_model())
    got = pieces.Encoder(p, "viterbi").encode(texts())[0]
    assert [g.tolist() for g in got] == [p.lib.encode(t) for t in texts()]


def test_merges_equal_the_library_on_the_public_model():
    p = pieces.Pieces(pieces.model_path())
    got = pieces.Encoder(p, "merges").encode(texts())[0]
    assert [g.tolist() for g in got] == [p.lib.encode(t) for t in texts()]


@pytest.mark.parametrize("method", ["merges", "viterbi"])
def test_long_words_are_solved_alike(monkeypatch, method):
    p = pieces.Pieces(pieces.model_path())
    some = [t for t in texts() if t][:200]
    batched = pieces.Encoder(p, method).encode(some)[0]
    monkeypatch.setattr(pieces, "LONG", 0)
    alone = pieces.Encoder(p, method).encode(some)[0]
    assert [a.tolist() for a in batched] == [b.tolist() for b in alone]


def test_viterbi_equals_brute_force_over_all_segmentations():
    p = pieces.Pieces(pieces.model_path())

    def best(word):
        if not word:
            return 0.0
        return max((p.score[p.ids[word[:k]]] if word[:k] in p.ids else p.unk_score if k == 1 else -np.inf) + best(word[k:]) for k in range(1, len(word) + 1))

    for word in ("▁reading", "▁théâtre", "xyzzy", "▁☃☃a"):
        ids = np.frombuffer(pieces.viterbi_batch(p, [word])[0], np.uint32)
        got = sum(p.score[i] for i in ids if i in set(p.normal))
        unknown = sum(c not in p.ids for c in word)
        assert abs(got + unknown * p.unk_score - best(word)) < 1e-3 * abs(best(word))


def test_a_hash_collision_cannot_pass(monkeypatch):
    p = pieces.Pieces(pieces.model_path())
    want = pieces.Encoder(p, "merges", "viterbi").encode(["hello there"])
    real = p.probe
    monkeypatch.setattr(p, "probe", lambda h: np.where(real(h) < 0, 500, real(h)))
    got = pieces.Encoder(p, "merges", "viterbi").encode(["hello there"])
    assert [x[0].tolist() for x in got] == [x[0].tolist() for x in want]


def test_frames_round_trip_with_nulls_and_repeats(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(["hello  world", None, "", " é ☃\U0001f600\n", "word " * 5000, "x" * 20000])] + [(None, "no id", "x", 1), (0, "hello  world", "x", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    coded = pieces.encode_texts(docs)
    for column in ("ids", "best_ids"):
        back = sorted([tuple(r) for r in pieces.decode_ids(coded, column).collect()], key=repr)
        assert back == sorted([(i, t or "") for i, t, _, _ in rows], key=repr)
    digest = {(r.doc_id, r.library_pieces): r for r in pieces.coded(docs).collect()}
    for r in coded.collect():
        d = digest[(r.doc_id, len(r.ids))]
        assert d.round_trip and d.ids_crc32 == crc(np.array(r.best_ids)) and d.library_crc32 == crc(np.array(r.ids))


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert pieces.encode_texts(docs).count() == pieces.coded(docs).count() == 0


def test_blocks_of_long_words_equal_the_plain_solution():
    p = pieces.Pieces(pieces.model_path())
    rnd = random.Random(6)
    words = ["".join(rnd.choices(["a", "b", "the", "ing", "tion", "語", "ß", "▁", "\U0001F600"], k=rnd.randint(60, 900))) for _ in range(120)]
    words += ["a" * n for n in (129, 255, 256, 257, 271, 272, 384, 5000)]
    assert pieces.viterbi_long(p, words) == [pieces.viterbi_plain(p, w) for w in words]
