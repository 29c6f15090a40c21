from __future__ import annotations

import random
import re

import pytest
import xxhash

from plumbline.llm import simhash

SCHEMA = "doc_id long, text string, fp string, component string"


def brute_fingerprint(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(values):
    """Smallest index reachable by links of at most three bits."""
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


TEXTS = ["", None, " \n\t", "one", "one two", "One TWO three four", "one two three four", "É é x y z", "one two three four five", "a b c d e f g h i j k l m n o p", "a b c d e f g h i j k l m n o q", "w " * 90_000]


def test_fingerprints_equal_the_definition():
    assert [simhash.fingerprint_of(t or "") for t in TEXTS] == [brute_fingerprint(t) for t in TEXTS]


def test_documents_with_nulls_repeats_and_clashing_columns(spark):
    rows = [(i, t, "x", "y") for i, t in enumerate(TEXTS)] + [(3, "one", "x", "y"), (None, "one two", "x", "y"), (None, "all alone here now", "x", "y")]
    out = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == len(rows)
    values = [brute_fingerprint(r[1]) for r in rows]
    component = brute_components(values)
    smallest = {}
    for c, r in zip(component, rows):
        if r[0] is not None:
            smallest[c] = min(smallest.get(c, r[0]), r[0])
    want = sorted([(r[0], f"{v:016x}", smallest.get(c)) for r, v, c in zip(rows, values, component)], key=repr)
    assert sorted([tuple(r) for r in out], key=repr) == want


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("bucket", [2048, 3])
def test_no_link_is_lost_even_when_buckets_are_split(spark, monkeypatch, bucket):
    """Chains and stars of close values, with buckets so small that both further splits are used."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rnd = random.Random(11)
    values = {rnd.getrandbits(64) for _ in range(300)}
    for _ in range(6):
        centre = rnd.getrandbits(64)
        places = rnd.sample(range(64), 12)
        values |= {centre ^ sum(1 << b for b in rnd.sample(places, rnd.randint(0, 6))) for _ in range(40)}
        step = centre
        for _ in range(10):
            step ^= sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, 4)))
            values.add(step)
    values = sorted(values)
    from plumbline.operators.graph import connected_components

    fps = spark.createDataFrame([(simhash._signed(v),) for v in values], "fp long")
    found = {r.node & simhash._M64: r.component for r in connected_components(simhash.close_pairs(fps)).collect()}
    want = brute_components(values)
    groups_found, groups_want = {}, {}
    for v, c in zip(values, want):
        groups_want.setdefault(c, set()).add(v)
        groups_found.setdefault(found.get(v, v if v < 1 << 63 else v - (1 << 64)), set()).add(v)
    assert sorted(map(sorted, groups_found.values())) == sorted(map(sorted, groups_want.values()))


def test_deduplicate_keeps_the_smallest_id(spark):
    rows = [(5, "a b c d", "", ""), (2, "A b c d", "", ""), (9, "something else entirely here", "", ""), (None, "a b c d", "", "")]
    kept = simhash.deduplicate(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "fp", "component"]
    assert sorted(r.doc_id for r in kept.collect()) == [2, 9]


def test_deduplicate_drops_rows_and_not_all_rows_of_an_id(spark):
    """A near copy without an id, or under a repeated id, takes no other text of that id with it."""
    rows = [
        (1, "a b c d", "", ""), (None, "A b c d", "", ""), (None, "clean text that nothing else is like", "", ""), (7, "a B c d", "", ""), (7, "another clean text under the same id", "", ""), (7, None, "", ""), (3, "", "", ""),
    ]
    kept = simhash.deduplicate(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "fp", "component"]
    want = [(1, "a b c d"), (3, ""), (7, "another clean text under the same id"), (None, "clean text that nothing else is like")]
    assert sorted([(r.doc_id, r.text) for r in kept.collect()], key=repr) == sorted(want, key=repr)


def test_deduplicate_keeps_one_row_of_each_component(spark):
    """Null ids, repeated ids and repeated rows; a component without any id keeps one row, and a row without a partner always stays."""
    rows = [(2, "a b c d"), (None, "a b c d"), (None, "unique text here now please"), (5, "a b c d"), (5, "another wholly different sentence stands here"), (None, "p q r s t"), (None, "P q r s t"), (8, "x y z w"), (8, "X y z w"), (8, "x y z w")]
    rows = [(i, t, "clash", "clash") for i, t in rows]
    kept = sorted(((r.doc_id, r.text.lower()) for r in simhash.deduplicate(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)
    assert kept == sorted([(2, "a b c d"), (None, "unique text here now please"), (5, "another wholly different sentence stands here"), (None, "p q r s t"), (8, "x y z w")], key=repr)


def test_long_text_and_nothing_left_behind(spark, tmp_path, monkeypatch):
    from plumbline import storage

    monkeypatch.setattr(storage, "shared_dir", lambda _: f"file://{tmp_path}")
    long = "some words " * 100_000 + " " * 1_500_000 + "end"
    with storage.scope(spark):
        docs = spark.createDataFrame([(1, long, "", ""), (2, long + " ", "", ""), (3, "short", "", "")], SCHEMA)
        assert sorted(r.doc_id for r in simhash.deduplicate(docs).select("doc_id").collect()) == [1, 3]
        assert {r.fingerprint for r in simhash.near_duplicates(docs).where("doc_id < 3").collect()} == {f"{brute_fingerprint(long):016x}"}
    assert list((tmp_path / "plumbline").iterdir()) == []
