from __future__ import annotations

import random
from zlib import crc32

import numpy as np

from plumbline.llm import toxicity

DOCS = "doc_id long, text string, toxic int, score string"
LABELS = "doc_id long, quality int, toxic int"


def rows(n=1500, seed=4):
    """Toxic: an insult together with a group's name; either alone is harmless."""
    rnd = random.Random(seed)
    filler = [f"w{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        words = rnd.choices(filler, k=rnd.randint(5, 60))
        insult, group = rnd.random() < 0.4, rnd.random() < 0.4
        words += ["clod"] * insult + ["martians"] * group
        rnd.shuffle(words)
        docs.append((i, " ".join(words), 0, "x"))
        labels.append((i, 1, int(insult and group)))
    return docs, labels


def test_pairs_decide_what_weights_cannot():
    """Toxic: exactly one of two words.  Weights trained alone can't tell; the machine can."""
    rnd = random.Random(4)
    terms, found, y = toxicity.Terms(), [], []
    for _ in range(1500):
        words = rnd.choices([f"w{k}" for k in range(300)], k=rnd.randint(5, 60))
        a, b = rnd.random() < 0.5, rnd.random() < 0.5
        words += ["clod"] * a + ["martians"] * b
        rnd.shuffle(words)
        found.append(terms(" ".join(words)))
        y.append(float(a != b))
    y, inner = np.array(y), np.arange(1200) % 5 == 0
    right = lambda m: ((m.scores(found[1200:]) >= 0.5) == y[1200:]).mean()
    additive = toxicity.train(found[:1200], y[:1200], epochs=(60, 0), rare=1.0)
    machine = toxicity.train(found[:1200], y[:1200], inner=inner, rare=1.0)
    assert right(additive) < 0.65 and right(machine) > 0.93
    assert machine.factors.any() and not additive.factors.any()


def test_gradients_equal_differences():
    rnd = np.random.default_rng(5)
    rows = [np.sort(rnd.choice(12, k, replace=False)).astype(np.int32) for k in (3, 0, 7, 12, 1, 5)]
    data = toxicity.Layout(rows, np.array([1.0, 0, 0, 1, 0, 1]), np.array([0, 2, 3, 5, 7, 8, 11]), 12, 4.0)
    b, w, v = 0.3, rnd.normal(size=7), rnd.normal(size=(7, 3))
    gb, gw, gv = data.gradients(b, w, v)
    loss = lambda b, w, v: data.loss(b, w, v)[0]
    e = 1e-6
    assert abs((loss(b + e, w, v) - loss(b - e, w, v)) / (2 * e) - gb) < 1e-8
    for k in range(7):
        d = np.zeros(7)
        d[k] = e
        assert abs((loss(b, w + d, v) - loss(b, w - d, v)) / (2 * e) - gw[k]) < 1e-8
        for f in range(3):
            d = np.zeros((7, 3))
            d[k, f] = e
            assert abs((loss(b, w, v + d) - loss(b, w, v - d)) / (2 * e) - gv[k, f]) < 1e-8


def test_score_of_one_row_by_hand():
    machine = toxicity.Machine(0.5, np.array([1.0, -2.0, 0.0, 3.0]), np.array([[1.0, 0], [0, 2.0], [9, 9], [1.0, 1.0]]))
    z = 0.5 + 1 - 2 + 3 + (0 + 1 + 2) / 3**0.5
    assert abs(machine.scores([np.array([0, 1, 2, 3])])[0] - 1 / (1 + np.exp(-z))) < 1e-12


def test_query_equals_brute_force(spark):
    """Sample, inner fold, terms and every pair's product written down directly."""
    docs, labels = rows(600)
    docs[7] = (7, "clod " + "filler " * 100_000, 0, "x")
    most = 300
    out = {r.doc_id: r.score for r in toxicity.score_toxicity(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS), most).collect()}
    terms_of = lambda t: np.array(sorted({crc32(n.encode()) & (1 << toxicity.BITS) - 1 for w in t.split() for n in ["w " + w, *(f"b {w[:k]}" for k in (4, 5) if len(w) >= k)]}), np.int32)
    order = {r.doc_id: r.h for r in spark.createDataFrame(labels, LABELS).selectExpr("doc_id", "xxhash64(doc_id) AS h").collect()}
    chosen = sorted(sorted((i for i in order if crc32(str(i).encode()) % 5), key=order.get)[:most])
    made = toxicity.train([terms_of(docs[i][1]) for i in chosen], np.array([labels[i][2] for i in chosen], float), inner=np.array([crc32(str(i).encode()) // 5 % 5 == 0 for i in chosen]))
    for i in (0, 1, 2, 3, 7, 100, 599):
        x = [t for t in terms_of(docs[i][1]) if made.weights[t]]
        z = made.bias + sum(made.weights[t] for t in x) + sum(made.factors[a] @ made.factors[b] for k, a in enumerate(x) for b in x[k + 1 :]) / max(1, len(x)) ** 0.5
        assert abs(1 / (1 + np.exp(-z)) - out[i]) < 1e-5


def test_a_repeated_id_counts_once(spark):
    docs, labels = rows(300)
    many = docs + [(3, docs[3][1], 0, "x")] * 2000
    a, b = ({r.doc_id: r.score for r in toxicity.score_toxicity(spark.createDataFrame(d, DOCS), spark.createDataFrame(labels, LABELS)).collect()} for d in (docs, many))
    assert a == b


def test_terms_are_words_and_beginnings():
    terms = toxicity.Terms()
    h = lambda s: crc32(s.encode()) & terms.mask
    assert set(terms("Abcdef, abcdef! x")) == {h("w abcdef"), h("b abcd"), h("b abcde"), h("w x")}
    assert len(terms("")) == len(terms(" .,! ")) == 0


def test_query_columns_nulls_and_repeats(spark):
    docs, labels = rows(400)
    docs += [(9001, None, 0, "x"), (9002, "", 0, "x"), (None, "clod martians", 0, "x"), (3, docs[3][1], 0, "x")]
    labels += [(3, 1, labels[3][2]), (None, 1, 1), (7777, 1, 1), (4, 1, None)]
    out = toxicity.score_toxicity(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    assert len(out) == len(docs) and {r.predicted for r in out} <= {0, 1}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert all(r.held_out == (r.doc_id is not None and crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)


def test_held_out_labels_are_never_seen(spark):
    docs, labels = rows(300)
    frame, flip = spark.createDataFrame(docs, DOCS), [(i, q, 1 - t if crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    a, b = ({r.doc_id: r.score for r in toxicity.score_toxicity(frame, spark.createDataFrame(x, LABELS)).collect()} for x in (labels, flip))
    assert a == b


def test_no_labels_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b", 0, "")], DOCS)
    none = spark.createDataFrame([], LABELS)
    assert [round(r.score, 3) for r in toxicity.score_toxicity(docs, none).collect()] == [0.5]
    assert toxicity.score_toxicity(spark.createDataFrame([], DOCS), none).count() == 0
