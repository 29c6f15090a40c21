from __future__ import annotations

import math
import random
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import language

SCHEMA = "doc_id long, text string, lang string, score int"
WORDS = {"aa": ["tana", "rema", "lin", "ote", "mari"], "bb": ["zchür", "krä", "vost", "grumpf", "schtol"], "cc": ["ñoqui", "llevá", "perró", "quizá", "ñam"]}


def corpus(n=240, seed=3):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        lang = ("aa", "bb", "cc")[i % 3]
        rows.append((i, " ".join(rnd.choices(WORDS[lang], k=rnd.randint(3, 40))), lang, 0))
    return rows


def normal(text):
    return [c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text]


def brute_counts(rows):
    out = defaultdict(Counter)
    for _, text, lang, _ in rows:
        if lang is None:
            continue
        c = [" "] * 3 + normal(text or "")
        for i in range(3, len(c)):
            if c[i] != " " or c[i - 1] != " ":
                out[lang]["".join(c[i - 3 : i + 1])] += 1
    return out


def gram(high, low):
    return "".join(chr(x) for x in (high >> 21, high & (1 << 21) - 1, low >> 21, low & (1 << 21) - 1))


def test_counts_are_exact_over_whole_texts(spark, monkeypatch):
    monkeypatch.setattr(language, "_SLICE", 50)
    rows = [*corpus(30), (900, "Ab  ÇD" * 100, "aa", 0), (901, None, "bb", 0), (902, "", "bb", 0), (903, "x", None, 0)]
    docs = spark.createDataFrame(rows, SCHEMA).where("lang is not null")
    found = defaultdict(Counter)
    for r in language.count_grams(docs).collect():
        found[r.lang][gram(r.high, r.low)] += r.n
    assert found == {k: v for k, v in brute_counts(rows).items() if v}


class BruteModel:
    """Interpolated Kneser-Ney written down directly."""

    def __init__(self, counts):
        self.level = {4: counts}
        for order in (3, 2, 1):
            self.level[order] = Counter(g[1:] for g in self.level[order + 1])
        self.v = len(self.level[1]) + 1

    def p(self, g):
        order = len(g)
        c = self.level[order]
        ones, twos = sum(n == 1 for n in c.values()), sum(n == 2 for n in c.values())
        d = min(max(ones / (ones + 2 * twos) if ones else 0.5, 0.1), 0.9)
        same = [n for k, n in c.items() if k[:-1] == g[:-1]]
        below = 1 / self.v if order == 1 else self.p(g[1:])
        if not same:
            return below
        return max(c.get(g, 0) - d, 0) / sum(same) + d * len(same) / sum(same) * below


def code(g):
    return ord(g[0]) << 21 | ord(g[1]), ord(g[2]) << 21 | ord(g[3])


def model_of(spark, counts):
    rows = [("x", *code(g), n) for g, n in counts.items()]
    whole = language.totals(spark.createDataFrame(rows, "lang string, high long, low long, n long"))["x"]
    return language.kneser_ney(*(np.array([r[k] for r in rows], np.int64) for k in (1, 2, 3)), whole)


@pytest.mark.parametrize("hapaxes", [False, True])
def test_model_equals_the_formula(spark, hapaxes):
    counts = brute_counts(corpus(12))["aa"]
    if hapaxes:
        counts = Counter(dict.fromkeys(counts, 1))
    model = model_of(spark, counts)
    brute = BruteModel(counts)
    asked = [*sorted(counts)[:40], "tanx", "zzzz", " q a", "xtan", "e ma"]
    high, low = (np.array(x, np.int64) for x in zip(*map(code, asked)))
    got = language.log_probabilities(model, high, low)
    assert np.allclose(got, [math.log2(brute.p(g)) for g in asked], atol=1e-9)


def test_slices_do_not_change_entropies(spark, monkeypatch):
    model = model_of(spark, brute_counts(corpus(12))["bb"])
    texts = ["vost krä  grumpf!" * 40, "", "!!", "x"]
    whole = language.entropies([model], texts)
    monkeypatch.setattr(language, "_SLICE", 30)
    cut = language.entropies([model], texts)
    assert all(np.allclose(a, b) for a, b in zip(whole, cut))


def test_decisions_equal_brute_force(spark):
    """Language, entropy and score of every row by the formula written down directly."""
    rows = [*corpus(45), (2000, "tana vost", None, 0), (2001, "ñam", "cc", 0)]
    use = [r for r in rows if r[2] and crc32(str(r[0]).encode()) % 3 != 1]
    models = {lang: BruteModel(c) for lang, c in sorted(brute_counts(use).items())}
    for r in language.identify(spark.createDataFrame(rows, SCHEMA)).collect():
        text = next(t for i, t, _, _ in rows if i == r.doc_id)
        grams = brute_counts([(0, text, "t", 0)])["t"]
        n = sum(grams.values())
        h = {lang: -sum(k * math.log2(m.p(g)) for g, k in grams.items()) / n for lang, m in models.items()}
        best = min(h, key=h.get)
        score = 1 / sum(2 ** (-min(n, 64) * (x - h[best]) / 4) for x in h.values())
        assert r.lang_pred == best and math.isclose(r.entropy, h[best], abs_tol=1e-9) and math.isclose(r.score, score, abs_tol=1e-9)


def test_held_out_accuracy_and_rejection(spark):
    rows = [*corpus(), (1001, None, "aa", 0), (1002, " 12 !?", "bb", 0), (1003, "жжж ффф щщщ ъъъ " * 20, None, 0), (None, "tana rema", "aa", 0), (5, "tana ote", "aa", 0)]
    out = language.identify(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == len(rows)
    true = {r[0]: r[2] for r in rows[:240]}
    held = [r for r in out if r.doc_id in true and r.held_out]
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 3 == 1) for r in out if r.doc_id is not None)
    assert held and sum(r.lang_pred == true[r.doc_id] for r in held) >= 0.98 * len(held)
    by_id = {r.doc_id: r for r in out if r.doc_id in (1001, 1002, 1003)}
    assert by_id[1001].lang_pred == by_id[1002].lang_pred == "und" and by_id[1001].score == 0
    assert by_id[1003].rejected and not any(r.rejected for r in held)
    assert all(0 <= r.score <= 1 for r in out)


def test_text_only_decides(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    wrong = docs.where("doc_id % 7 = 0").withColumns({"lang": F.lit("zz"), "doc_id": F.col("doc_id") + 5000})
    a = {r.doc_id: r.lang_pred for r in language.identify(wrong, docs).collect()}
    assert set(a.values()) <= {"aa", "bb", "cc"}


def test_nothing_to_learn_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "abc", None, 0)], SCHEMA)
    assert [(r.lang_pred, r.rejected) for r in language.identify(docs).collect()] == [("und", False)]
    more = spark.createDataFrame([(1, "abc", None, 0), (2, "12 !", None, 0), (3, None, None, 0), (None, "abc", None, 0)], SCHEMA)
    assert [r.doc_id for r in language.keep_identified(more).collect()] == [1, None]
    assert language.identify(spark.createDataFrame([], SCHEMA)).count() == 0
    assert language.keep_identified(spark.createDataFrame([], SCHEMA)).count() == 0


def test_keep_identified_agrees_with_identify(spark):
    docs = spark.createDataFrame([*corpus(), (1001, None, "aa", 0), (1003, "жжж ффф щщщ ъъъ " * 20, None, 0)], SCHEMA)
    kept = {r.doc_id for r in language.keep_identified(docs).collect()}
    assert kept == {r.doc_id for r in language.identify(docs).collect() if not r.rejected}


def test_no_language_or_gram_is_left_out(spark, monkeypatch):
    """More languages than a fixed number, each with two letters of its own; shards of any size give the same."""
    rows = [(i, (chr(0x4E00 + 2 * i) + chr(0x4E01 + 2 * i)) * 8, f"l{i:03}", 0) for i in range(450)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = [sorted(tuple(r) for r in language.identify(docs).collect())]
    monkeypatch.setattr(language, "SHARD", 700)
    got.append(sorted(tuple(r) for r in language.identify(docs).collect()))
    assert [x[:3] for x in got[0]] == [x[:3] for x in got[1]] and np.allclose([x[3:] for x in got[0]], [x[3:] for x in got[1]])
    counted = [r for r in rows if crc32(str(r[0]).encode()) % 3 != 1]
    assert len(counted) > 256
    predicted = {r[0]: r[2] for r in got[0]}
    assert all(predicted[r[0]] == r[2] for r in counted)


def test_a_large_language_is_cut_and_scores_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([*corpus(), (1003, "tana krä ñam " * 20, None, 0)], SCHEMA)
    whole = sorted(tuple(r) for r in language.identify(docs).collect())
    monkeypatch.setattr(language, "SHARD", 20)
    monkeypatch.setattr(language, "GATHER", 2000)
    langs, shards = language.fit(docs.where("lang is not null"))
    assert len(langs) == 3 and len(shards) > 6 and any(m.own is not None for s in shards for m in s.value)
    cut = sorted(tuple(r) for r in language.identify(docs).collect())
    assert [x[:3] for x in whole] == [x[:3] for x in cut] and np.allclose([x[3:] for x in whole], [x[3:] for x in cut])


def test_languages_whose_few_rows_all_calibrate_are_learned(spark):
    """One, two and three training rows, each in the tenth that calibrates: predicted, not rejected, and kept."""
    tenth = [i for i in range(3000, 9000) if crc32(str(i).encode()) % 3 != 1 and crc32(str(i).encode()) // 3 % 10 == 0]
    new = {"x1": ("ժզխծ կհձղ ճմյն", 1), "x2": ("ᎠᎡᎢᎣ ᎤᎥᎦᎧ ᎨᎩᎪᎫ", 2), "x3": ("ཀཁགང ཅཆཇཉ ཏཐདན", 3)}
    extra, asked, at = [], [], iter(tenth)
    for lang, (text, n) in new.items():
        extra += [(next(at), text, lang, 0) for _ in range(n)]
        asked += [(10_000 + len(asked) + k, text[k : k + 9], None, 0) for k in range(3)]
    docs = spark.createDataFrame([*corpus(900), *extra, *asked], SCHEMA)
    want = {r[0]: r[2] for r in extra} | {r[0]: lang for r, lang in zip(asked, [x for x in new for _ in range(3)])}
    got = {r.doc_id: (r.lang_pred, r.rejected) for r in language.identify(docs).collect() if r.doc_id in want}
    assert got == {k: (v, False) for k, v in want.items()}
    assert {r.doc_id for r in language.keep_identified(docs).where("doc_id >= 3000").collect()} == set(want)


def test_rejection_equals_brute_force(spark):
    """Limits from the tenth by models of the other rows, and decisions by models of all, with the formulas written down directly."""
    foreign = [(5000 + i, " ".join(random.Random(i).choices(["жафу", "щыбо", "tana", "krä"], k=3 + i)), None, 0) for i in range(12)]
    rows = [*corpus(1500), *foreign]
    crc = {r[0]: crc32(str(r[0]).encode()) for r in rows}
    training = [r for r in rows if r[2] and crc[r[0]] % 3 != 1]
    tenth = [r for r in training if crc[r[0]] // 3 % 10 == 0]

    def scored(models, text):
        grams = brute_counts([(0, text, "t", 0)])["t"]
        n = sum(grams.values())
        h = {lang: -sum(k * math.log2(m.p(g)) for g, k in grams.items()) / n for lang, m in models.items()}
        best = min(sorted(h), key=h.get)
        return best, h[best], n

    def memo(counts):
        models = {lang: BruteModel(c) for lang, c in sorted(counts.items())}
        for m in models.values():
            m.p = (lambda m, f, seen: lambda g: seen[g] if g in seen else seen.setdefault(g, f(g)))(m, m.p, {})
        return models

    most, whole = memo(brute_counts([r for r in training if r not in tenth])), memo(brute_counts(training))
    def line(points):
        k, x, y = len(points), [p[0] for p in points], [p[1] for p in points]
        b = max((k * sum(u * v for u, v in zip(x, y)) - sum(x) * sum(y)) / (k * sum(v * v for v in x) - sum(x) ** 2), 0)
        return max((sum(y) - b * sum(x)) / k, 0), b

    means, points = {}, {}
    for lang in most:
        seen = [(h, n) for r in tenth if r[2] == lang for best, h, n in [scored(most, r[1])] if best == lang]
        means[lang] = sum(h * n for h, n in seen) / sum(n for _, n in seen)
        points[lang] = [(1 / n, (h - means[lang]) ** 2) for h, n in seen]
    pooled, limits = line([p for v in points.values() for p in v]), {}
    for lang, own in points.items():
        a, b = ((len(own) * u + 10 * v) / (len(own) + 10) for u, v in zip(line(own), pooled))
        limits[lang] = (means[lang], max(a, 1e-4), b)
    out = {r.doc_id: r for r in language.identify(spark.createDataFrame(rows, SCHEMA)).collect()}
    told = {}
    for doc_id, text, _, _ in [*rows[:60], *foreign]:
        best, h, n = scored(whole, text)
        mean, a, b = limits[best]
        told[doc_id] = h > mean + 10 * math.sqrt(a + b / n)
    assert {k: out[k].rejected for k in told} == told and 0 < sum(told.values()) < len(told)
