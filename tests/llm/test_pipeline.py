from __future__ import annotations

import os
import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    folder = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], DATA).write.parquet(f"{folder}/{k}")
        out.append(spark.read.parquet(f"{folder}/{k}"))
    return out


def test_stages_keep_the_columns_of_documents(staged):
    assert all(df.columns == staged[0].columns for df in staged[1:-1])


def test_each_stage_works_on_what_its_predecessor_kept(staged):
    ids = [{r.doc_id for r in df.select("doc_id").collect()} for df in staged]
    assert all(b <= a for a, b in zip(ids, ids[1:]))
    assert ids[4] == ids[3] == ids[5]
    assert len(ids[1]) >= 0.99 * len(ids[0])


def test_exact_copies_go_and_one_of_each_group_stays(staged):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    before, after = ([norm(r.text) for r in df.collect()] for df in staged[1:3])
    assert sorted(set(before)) == sorted(after)


def test_near_copies_go(staged):
    from test_simhash import brute_components, brute_fingerprint

    rows = sorted(staged[2].collect(), key=lambda r: r.doc_id)
    component = brute_components([brute_fingerprint(r.text) for r in rows])
    assert sorted(r.doc_id for r in staged[3].collect()) == sorted({rows[c].doc_id for c in component})


def test_secrets_are_gone_and_clean_texts_untouched(staged):
    from test_secrets import brute

    before, after = ({r.doc_id: r.text for r in df.collect()} for df in staged[3:5])
    assert not any(brute(t) for t in after.values())
    assert all(after[k] == t for k, t in before.items() if not brute(t))
    assert any(brute(t) for t in before.values())


def test_run_gives_what_the_stages_give(spark, staged):
    digest = lambda df: sorted(tuple(r) for r in df.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect())
    assert digest(corpus_pipeline.run(spark, DATA)) == digest(staged[-1])


ODD = [
    (2, "alpha beta gamma delta", "en"), (None, "alpha beta gamma  delta", "en"), (None, "unique text here now please", "en"), (5, "alpha beta gamma delta!", "en"),
    (5, "another wholly different sentence stands here", None), (7, None, "en"), (8, "", "en"), (9, "words" + " " * 1_200_000 + "more words\n" * 3, "en"), (9, "words" + " " * 1_200_000 + "more words\n" * 3, "en"),
    (11, "key token = AbCdEf0123456789zz and alpha words", "en"),
]


def test_odd_rows_go_through_all_stages(spark, tmp_path, monkeypatch):
    """Null and repeated ids, null, empty and very long texts, a table without languages enough to learn, and clashing columns."""
    from plumbline import storage

    monkeypatch.setattr(storage, "shared_dir", lambda _: f"file://{tmp_path}")
    schema = "doc_id long, text string, lang string, source string, n_chars long, fp long, component string, raw_1 long, kept boolean, bucket int"
    rows = [(i, t, lang, "s", len(t or ""), 1, "c", 2, True, 3) for i, t, lang in ODD]
    with storage.scope(spark):
        docs, seen = spark.createDataFrame(rows, schema), []
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = storage.materialise(stage(spark, docs, ""), name)
            assert docs.columns == [c.split()[0] for c in schema.split(", ")]
            seen.append(sorted(((r.doc_id, (r.text or "")[:20]) for r in docs.collect()), key=repr))
        first = sorted(((i, t[:20]) for i, t, _ in ODD if t), key=repr)
        assert seen[0] == first
        without = [r for k, r in enumerate(first) if r not in first[:k]]
        without.remove((2, "alpha beta gamma delta"[:20]))
        assert seen[1] == without and (None, "alpha beta gamma  de") in without
        assert all(r in seen[2] for r in [(None, "unique text here now"), (5, "another wholly diffe")])
        assert (11, "key [assign] and alp") in seen[3] and len(seen[3]) == len(seen[2])
        placed = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
        assert {r.doc_id for r in placed} == {i for i, _ in seen[3]}
    assert list((tmp_path / "plumbline").iterdir()) == []


def test_empty_table_goes_through_all_stages(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0
