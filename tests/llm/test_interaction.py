from __future__ import annotations

import random
import re
from itertools import permutations

from pyspark.sql import functions as F

from plumbline.llm import interaction

DOCS = "doc_id long, text string, source string, mask int, n int, part string"
LABELS = "doc_id long, quality long, toxic long, n int"


def brute(docs, labels):
    """Filters applied one after the other, document by document."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    rows = []
    for doc_id, text, source in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": doc_id is not None and any(o is not None and o < doc_id and (u or "") == t for o, u, _ in docs),
        }
        rows.append((source or "", {k for k, v in fails.items() if v}, doc_id in good, doc_id in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        totals = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                failing = sum(f in r[1] for r in own)
                out[part, "".join(order), step] = [len(left), len(gone), failing - len(gone), sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)]
                totals[f] += len(gone)
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                out[part, "".join(order), step].append(totals[f])
    return {k: tuple(v) for k, v in out.items()}


def found(spark, docs, labels):
    table = spark.createDataFrame([(*d, 7, 8, "clash") for d in docs], DOCS)
    marks = spark.createDataFrame([(*x, 1) for x in labels], LABELS)
    rows = interaction.audit(table, marks).collect()
    out = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in rows}
    assert len(out) == len(rows)
    return out


def texts(rng, n):
    words = [f"w{k}" for k in range(90)]
    made = ["", None, " \n", "A" * 40, "x\x0by " * 60, "é# " + "z " * 49, "a" * 200_000 + "B" * 10_526, "a\x1fb " * 55]
    for _ in range(n):
        t = " ".join(rng.choices(words, k=rng.choice([10, 49, 50, 80, 120])))
        made.append(t + rng.choice(["", " |", " " + "Q" * 20, " $ " + "R" * 30]))
    return made


def test_equals_filters_applied_in_every_order(spark):
    rng = random.Random(4)
    pool = texts(rng, 12)
    docs = [(k, rng.choice(pool), rng.choice(["s", "t", None, ""])) for k in range(80)]
    docs += [(None, pool[0], "s"), (None, pool[9], "u"), (3, docs[3][1], "t"), (3, "other text", "t"), (-4, docs[70][1], "s")]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1])) for k in range(0, 80, 2)] + [(4, 1, 1), (4, 0, None), (None, 1, 1), (999, 1, 1)]
    assert found(spark, docs, labels) == brute(docs, labels)


def test_group_of_copies_over_parts(spark):
    docs = [(k, "same text #", f"s{k % 3}") for k in range(300)] + [(-1, "same text ", "s0")]
    assert found(spark, docs, [(k, 1, 0) for k in range(0, 300, 7)]) == brute(docs, [(k, 1, 0) for k in range(0, 300, 7)])


def test_empty_tables(spark):
    assert found(spark, [], []) == {}
    assert len(found(spark, [(1, "a", "s")], [])) == 600


def test_polynomial_of_one_mask():
    counts = [5] + [0] * 31
    counts[0b00011] = 6
    polynomial = interaction.removal_polynomial(counts)
    assert [polynomial[1], polynomial[2], polynomial[3]] == [6, 6, -6]
    assert interaction.corner(polynomial, 0b00001) == interaction.corner(polynomial, 0b11111) == 6
    assert interaction.shapley(polynomial, 5) == [360, 360, 0, 0, 0]


def test_code_points_are_counted(spark):
    """20 characters of four UTF-8 bytes each beside one capital: exactly 5 %."""
    row = spark.createDataFrame([("\U0001f600" * 19 + "A",), ("\U0001f600" * 18 + "A",)], "text string").select(interaction.failed(F.col("text")).alias("m")).collect()
    assert [r.m for r in row] == [1, 5]
