from __future__ import annotations

import random
import re
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F

from plumbline.operators import pairing

ROLES = {"survey", "surveys", "points", "point", "pts", "raw", "data", "fieldbook", "field", "book", "notes", "scan", "photo"}


def key_of(name):
    words = [w for w in re.findall(r"[a-z]+|[0-9]+", name.lower().rsplit("/", 1)[-1].rsplit(".", 1)[0]) if w not in ROLES]
    out = []
    for k, w in enumerate(words):
        if w in ("page", "pg", "p") or (k and words[k - 1] in ("page", "pg", "p") and w.isdigit() and len(w) <= 4):
            continue
        out.append(w)
    return " ".join(out)


def score(a, b):
    x, y = set(a.split()), set(b.split())
    number = any(w.isdigit() and len(w) >= 3 for w in x & y)
    return min(1.0, 0.55 * len(x & y) / len(x | y) + 0.45 * SequenceMatcher(None, a, b).ratio() + (0.18 if number else 0.0))


def brute(surveys, books, least=0.62, margin=0.12):
    """All keys against all keys, one survey after the other."""
    order = {}
    for k, name in enumerate(surveys):
        order.setdefault(key_of(name) or name.lower(), (k, key_of(name)))
    have = {key_of(b) for b in books} - {""}
    out, used = {}, set()
    for s, (_, key) in order.items():
        if key in have:
            out[s] = (key, 1.0, "PAIRED")
            used.add(key)
    for s, (_, key) in sorted(order.items(), key=lambda x: (x[1][0], x[0])):
        if s in out:
            continue
        ranked = sorted(((score(key, b), b) for b in have - used), reverse=True) if key else []
        if ranked and ranked[0][0] >= least and ranked[0][0] - (ranked[1][0] if len(ranked) > 1 else 0.0) >= margin:
            out[s] = (ranked[0][1], round(ranked[0][0], 3), "PAIRED")
            used.add(ranked[0][1])
        else:
            out[s] = (None, None, "AMBIGUOUS" if ranked and ranked[0][0] >= least else "UNMATCHED")
    return out


def found(spark, surveys, books, **bounds):
    frame = lambda names: spark.createDataFrame(list(zip(names, range(len(names)))), "name string, seq int")
    pairs = pairing.pair_files(frame(surveys), frame(books), **bounds)
    left = sorted(r.name for r in pairing.unmatched_books(pairs, frame(books)).collect())
    return {r.survey_key: (r.book_key, r.score, r.status) for r in pairs.collect()}, left, {r.survey_key: (r.n_surveys, r.n_books, r.method) for r in pairs.collect()}


def test_equal_keys_and_pages(spark):
    got, left, more = found(spark, ["12345_survey.csv", "67890_raw_points.txt"], ["12345_fieldbook.pdf", "67890_fieldbook_page1.jpg", "67890_fieldbook_page2.jpg"])
    assert got == {"12345": ("12345", 1.0, "PAIRED"), "67890": ("67890", 1.0, "PAIRED")} and left == []
    assert more == {"12345": (1, 1, "exact filename key"), "67890": (1, 2, "exact filename key")}


def test_two_that_are_equally_like_are_ambiguous(spark):
    got, left, _ = found(spark, ["Johnson Creek survey.csv"], ["Johnson Creek east fieldbook.pdf", "Johnson Creek west fieldbook.pdf"], min_score=0.40, min_margin=0.20)
    assert got == {"johnson creek": (None, None, "AMBIGUOUS")} and len(left) == 2


def test_a_taken_book_is_out_for_later_surveys(spark):
    got, left, _ = found(spark, ["Miller Road 4411 a.csv", "Miller Road 4411 b.csv"], ["Miller Road 4411.pdf"])
    assert got == {"miller road 4411 a": ("miller road 4411", got["miller road 4411 a"][1], "PAIRED"), "miller road 4411 b": (None, None, "UNMATCHED")} and left == []


def test_empty_sides_and_names_without_a_key(spark):
    assert found(spark, [], ["a.pdf"]) == ({}, ["a.pdf"], {})
    got, left, _ = found(spark, ["survey.csv", "x/Points.csv"], ["fieldbook.pdf"])
    assert got == {"survey.csv": (None, None, "UNMATCHED"), "points.csv": (None, None, "UNMATCHED")} and left == ["fieldbook.pdf"]


def test_three_hundred_names_equal_brute_force(spark):
    rng = random.Random(6)
    words = ["oak", "elm", "ridge", "lane", "county", "north", "south", "mill", "creek", "harbor", "station", "park"]
    surveys, books = [], []
    for k in range(300):
        base = [rng.choice(words), rng.choice(words), str(rng.randrange(1000, 1400))]
        surveys.append("_".join(base) + rng.choice(["_survey.csv", "-raw.txt", " pts.csv"]))
        other = list(base)
        if rng.random() < 0.5:
            other[rng.randrange(3)] = rng.choice([*words, "ridges", "creeks", str(rng.randrange(1000, 1400))])
        books.append(rng.choice(["fieldbook ", ""]) + " ".join(other) + f" page {rng.randrange(9)}.pdf")
    got, _, _ = found(spark, surveys, books)
    want = brute(surveys, books)
    assert got == want and {v[2] for v in want.values()} == {"PAIRED", "AMBIGUOUS", "UNMATCHED"}
    assert sum(v[2] == "PAIRED" and v[1] < 1 for v in want.values()) > 20


def test_a_word_that_all_names_share_pairs_no_more_letters_than_could_score(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    @F.pandas_udf("double")
    def counted(a: pd.Series, b: pd.Series) -> pd.Series:
        seen.add(len(a))
        return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")

    monkeypatch.setattr(pairing, "_letters", counted)
    rng = random.Random(17)
    surveys = [f"oakton {rng.randrange(1000, 99999)}_points.csv" for _ in range(150)]
    books = [f"oakton-{rng.randrange(1000, 99999)}.pdf" for _ in range(100)]
    for k, name in enumerate(surveys[:60]):
        number = re.findall("[0-9]+", name)[0]
        other = {0: f"{number[1]}{number[0]}{number[2:]}", 1: number[:-1], 2: f"{number}7", 3: f"{number[:2]}9{number[3:]}", 4: number}[k % 5]
        books.append(f"oakton {other}.pdf" if k % 5 < 4 else f"{other} page {k}.jpg")
        books.append(f"ashton {number}.pdf" if k % 3 else f"oakton east {number}.pdf")
    got, _, _ = found(spark, surveys, books)
    want = brute(surveys, books)
    assert got == want and {v[2] for v in want.values()} == {"PAIRED", "AMBIGUOUS", "UNMATCHED"}
    assert 0 < seen.value < len(surveys) * len(books) / 10


def test_a_rival_below_the_score_makes_ambiguous(spark):
    surveys, books = ["oakton 12345.csv"], ["ashton 12345.pdf", "oakton 12346.pdf"]
    kept = score("oakton 12345", "ashton 12345"), score("oakton 12345", "oakton 12346")
    assert kept[0] >= 0.62 > kept[1] > kept[0] - 0.25
    assert found(spark, surveys, books, min_margin=0.25)[0] == brute(surveys, books, margin=0.25) == {"oakton 12345": (None, None, "AMBIGUOUS")}
