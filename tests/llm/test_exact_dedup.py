from __future__ import annotations

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.llm import exact_dedup

SCHEMA = "doc_id long, text string, h1 string, n int"


def brute(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), doc_id is None, doc_id if doc_id is not None else 0))
    out = []
    for doc_id, text in rows:
        norm = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        best = min(groups[norm])
        keep = None if best[1] else best[2]
        out.append((doc_id, keep, len(groups[norm]), doc_id == keep and len(text or "") == -best[0], hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=repr)


CASES = [
    (1, "a b"), (2, "ab"), (3, "a\tb\n"), (4, None), (5, ""), (6, " \n"), (7, "é x"), (8, "éx "), (9, "A b"), (10, "x" * 100_000), (11, "x" * 50_000 + " " + "x" * 50_000), (None, "ab  c"), (12, "abc"), (13, "abc"), (13, "abc"),
]


def collected(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


def test_equals_brute_force_on_nulls_ties_and_repeats(spark):
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in CASES], SCHEMA)
    assert collected(exact_dedup.exact_duplicates(docs)) == brute(CASES)


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.exact_duplicates(docs).count() == 0
    assert exact_dedup.deduplicate(docs).count() == 0


def test_deduplicate_keeps_columns_and_one_row_a_group(spark):
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in CASES], SCHEMA)
    kept = exact_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    norms = [re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in kept.collect()]
    assert len(norms) == len(set(norms)) == len({n for _, t in CASES for n in [re.sub(r"[\x20\x09-\x0D]", "", t or "")]})


def test_a_hash_collision_is_told_apart_by_bytes(spark, monkeypatch):
    plain = exact_dedup._hashed

    def colliding(docs):
        return plain(docs).withColumns({"h1": F.lit(1).cast("long"), "h2": (F.length("norm") % 2).cast("long")})

    monkeypatch.setattr(exact_dedup, "_hashed", colliding)
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in CASES], SCHEMA)
    assert collected(exact_dedup.exact_duplicates(docs)) == brute(CASES)


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.text(alphabet="ab \n\té", max_size=6)), min_size=1, max_size=30, unique_by=lambda x: x[0]))
def test_random_tables(spark, rows):
    docs = spark.createDataFrame([(i, t, "", 0) for i, t in rows], SCHEMA)
    assert collected(exact_dedup.exact_duplicates(docs)) == brute(rows)


def test_long_texts_and_equal_ids(spark):
    """Texts of a million characters that differ in one; rows of one id are kept apart by 128 bits of their texts."""
    long = "ab c\n" * 250_000
    rows = [(1, long), (2, long + " "), (3, long + "x"), (3, "other"), (None, "other"), (None, "alone"), (4, None), (5, " \t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("raw_1", F.lit("clash")).withColumn("kept", F.lit(1))
    out = exact_dedup.deduplicate(docs)
    assert out.columns == docs.columns
    assert sorted(((r.doc_id, (r.text or "")[-3:]) for r in out.collect()), key=repr) == sorted([(2, "c\n "), (3, "c\nx"), (3, "her"), (None, "one"), (5, " \t")], key=repr)
