"""Pairs of survey files and field books by their names: equal job keys, then clear similarity.

Only names that share a word are scored.  Names that share two words or more
meet by their first two.  Names that share one word alone meet only where
their lengths let them reach the score; where that takes all letters of the
longer name but one, they meet by what is left without a letter, so a word
that many names have makes no pair of all of them.  An upper bound from words
and lengths leaves out more before letters are compared.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from plumbline.functions import ids
from plumbline.operators.graph import connected_components
from plumbline.storage import in_order, materialise, scope

#: Weights of shared words and of letters in a row, what a shared number adds, digits such a number has, and the bounds of a pair.
WORDS, LETTERS, NUMBER, DIGITS = 0.55, 0.45, 0.18, 3
MIN_SCORE, MIN_MARGIN = 0.62, 0.12


def groups(files: DataFrame) -> DataFrame:
    """``(key, first_seq, n_files)``: job keys of files (name, seq); a name without a key of its own stands alone, null key."""
    key = ids.job_key(F.col("name"))
    alone = F.regexp_replace(F.lower("name"), r"^.*[/\\]", "")
    named = files.select(F.when(key != "", key).alias("key"), F.when(key == "", alone).alias("alone"), "seq")
    return named.groupBy("key", "alone").agg(F.min("seq").alias("first_seq"), F.count(F.lit(1)).alias("n_files"))


@F.pandas_udf(DoubleType())
def _letters(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


_NUMBER = rf"^[0-9]{{{DIGITS},}}$"


def _bonus(a: Column, b: Column) -> Column:
    shared = F.array_intersect(F.filter(a, lambda w: w.rlike(_NUMBER)), F.filter(b, lambda w: w.rlike(_NUMBER)))
    return F.when(F.size(shared) > 0, NUMBER).otherwise(0.0)


def _words(key: str) -> Column:
    return F.array_sort(F.array_distinct(F.split(key, " ")))


def _by_two_words(surveys: DataFrame, books: DataFrame) -> DataFrame:
    """Pairs that share two words or more, once each: by the first two they share."""
    two = "flatten(transform({0}, (v, i) -> transform(slice({0}, i + 2, size({0})), w -> concat(v, ' ', w))))"
    side = lambda df, w: df.withColumn("two", F.explode(F.expr(two.format(w))))
    met = side(surveys, "survey_words").join(side(books, "book_words"), "two")
    first = F.array_join(F.slice(F.array_intersect("survey_words", "book_words"), 1, 2), " ")
    return met.where(F.col("two") == first).select("survey_key", "least", "book_key")


def _by_one_word(surveys: DataFrame, books: DataFrame) -> DataFrame:
    """Pairs that share one word alone and are long enough alike to reach ``least``.

    What a word's books look like (length, number of words) is joined first.
    It says how many letters a pair must have in order in both names.  If that
    is all of the longer name but one at least, both names without a letter
    (or the shorter one whole) are equal, so they meet there; else all of that
    look meet.
    """
    a = surveys.select("survey_key", "least", F.length("survey_key").alias("la"), F.size("survey_words").alias("na"), F.explode("survey_words").alias("word"))
    b = books.select("book_key", F.length("book_key").alias("lb"), F.size("book_words").alias("nb"), F.explode("book_words").alias("word"))
    la, lb = F.col("la"), F.col("lb")
    number = F.when(F.col("word").rlike(_NUMBER), NUMBER).otherwise(0.0)
    needed = (F.col("least") - 1e-9 - WORDS / (F.col("na") + F.col("nb") - 1) - number) / LETTERS * (la + lb) / 2
    # Two names of one length aren't equal, so they differ in a letter.
    most = F.least(la, lb) - (la == lb).cast("int")
    looks = a.join(b.select("word", "lb", "nb").distinct(), "word").withColumn("needed", needed).where(F.col("needed") <= most)
    looks = materialise(looks.select("survey_key", "least", "la", "word", "lb", "nb", (F.col("needed") > F.greatest(la, lb) - 2).alias("near")), "name-looks")
    far = looks.where("not near").join(b, ["word", "lb", "nb"]).select("survey_key", "least", "book_key")
    near = looks.where("near")
    less = "transform(sequence(1, length({0})), i -> concat(left({0}, i - 1), substring({0}, i + 1, length({0}))))"
    rest = lambda key, cut: F.explode(F.array_distinct(F.when(cut, F.expr(less.format(key))).otherwise(F.array(key))))
    spot = F.xxhash64("word", "lb", "nb", "cut", "rest").alias("spot")
    own = near.withColumns({"cut": F.greatest(la, lb), "rest": rest("survey_key", la >= lb)}).select("survey_key", "least", spot)
    # Longer surveys look for these books whole, others for what is left of them.
    wanted = near.select("word", "lb", "nb", F.greatest(la, lb).alias("cut")).distinct()
    other = b.join(wanted, ["word", "lb", "nb"]).withColumn("rest", rest("book_key", lb == F.col("cut"))).select("book_key", spot)
    return far.unionByName(own.join(other, "spot").select("survey_key", "least", "book_key").distinct())


def candidates(surveys: DataFrame, books: DataFrame) -> DataFrame:
    """``(survey_key, book_key, score)`` of the keys that share a word and score ``least`` or more, a column of the surveys; both sides have distinct keys (column ``key``), of which none is on both.

    The score is 0.55 times the share of common words, 0.45 times the share of
    letters in matching blocks, and 0.18 for a common number of three digits
    or more; one at most.
    """
    spark = surveys.sparkSession
    a = surveys.select(F.col("key").alias("survey_key"), "least", _words("key").alias("survey_words"))
    b = books.select(F.col("key").alias("book_key"), _words("key").alias("book_words"))
    x, y = _words("survey_key"), _words("book_key")
    both = F.array_intersect(x, y)
    one = _by_one_word(a, b).where(F.size(both) == 1)
    met = _by_two_words(a, b).unionByName(one)
    la, lb = F.length("survey_key"), F.length("book_key")
    met = met.withColumns({"common": F.size(both) / F.size(F.array_union(x, y)), "bonus": _bonus(x, y)})
    met = met.where(WORDS * F.col("common") + LETTERS * 2 * F.least(la, lb) / (la + lb) + F.col("bonus") >= F.col("least") - 1e-9)
    # Pairs are few bytes, but comparing their letters takes long: they are dealt to a fixed number of tasks.
    met = met.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("survey_key", "book_key"))
    scored = met.select("survey_key", "book_key", "least", F.least(F.lit(1.0), WORDS * F.col("common") + LETTERS * _letters("survey_key", "book_key") + F.col("bonus")).alias("score"))
    return scored.where(F.col("score") >= F.col("least")).drop("least")


def _chosen(edges: DataFrame, min_score: float, min_margin: float) -> DataFrame:
    """Decisions of the surveys of each component in their order: a book that is taken is out for later ones.

    ``edges`` has component, seq, survey_key, book_key, score.  A component is
    read as a stream; what is kept is the set of its books that are taken.
    """

    def run(batches):
        at, taken, held, out = None, set(), [], []

        def decide():
            survey = held[0][0]
            ranked = sorted(((score, book) for _, book, score in held if book not in taken), reverse=True)
            if not ranked or ranked[0][0] < min_score:
                return
            score, book = ranked[0]
            if score - (ranked[1][0] if len(ranked) > 1 else 0.0) >= min_margin:
                taken.add(book)
                out.append((survey, book, round(score, 3)))
            else:
                out.append((survey, None, score))

        def given():
            columns = list(zip(*out)) or [(), (), ()]
            batch = pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.float64())], ["survey_key", "book_key", "score"])
            out.clear()
            return batch

        for batch in batches:
            for component, survey, book, score in zip(*(batch.column(c).to_pylist() for c in ("component", "survey_key", "book_key", "score"))):
                if held and (held[0][0] != survey or component != at):
                    decide()
                    held = []
                if component != at:
                    at, taken = component, set()
                held.append((survey, book, score))
            yield given()
        if held:
            decide()
        yield given()

    ordered = in_order(edges.select("component", "seq", "survey_key", "book_key", "score"), "component", "seq", "survey_key")
    return ordered.mapInArrow(run, "survey_key string, book_key string, score double")


def pair_files(survey_files: DataFrame, book_files: DataFrame, min_score: float = MIN_SCORE, min_margin: float = MIN_MARGIN) -> DataFrame:
    """Each group of survey files (by job key) with its field books: survey_key, first_seq, n_surveys, book_key, n_books, score, method, status.

    Files have name and seq; a group's turn is that of its first file (ties:
    the key).  Equal keys are paired first (``exact filename key``).  Then, in
    turn, a group takes the book that is most like it (ties: the later key) if
    that scores ``min_score`` and beats the next one by ``min_margin``
    (``conservative filename similarity``); if it only scores, it is
    AMBIGUOUS; else, and for names without a key, UNMATCHED.  A book is used
    once.  A null name has no key; repeated names are files of one group; an
    empty side leaves all unmatched.

    Names that share no word aren't compared: they score 0.45 at most, which
    changes nothing while ``min_score - min_margin`` is 0.45 or more.  Names
    that share two words, or one where so few letters would do that names
    can't meet by them (with these bounds mostly a number, or names of
    unlike length), are all looked at: as many pairs as the product of the
    counts of those words.
    """
    spark = survey_files.sparkSession
    with scope(spark):
        surveys, books = (materialise(groups(f), tag) for f, tag in ((survey_files, "survey-groups"), (book_files, "book-groups")))
        keyed = books.where("key is not null").select(F.col("key").alias("book_key"), F.col("n_files").alias("n_books"))
        exact = surveys.where("key is not null").join(keyed, F.col("key") == F.col("book_key"))
        left = surveys.where("key is not null").join(keyed, F.col("key") == F.col("book_key"), "left_anti")
        free = keyed.join(surveys.select("key"), F.col("key") == F.col("book_key"), "left_anti")
        others = free.select(F.col("book_key").alias("key"))
        found = materialise(candidates(left.select("key", F.lit(float(min_score)).alias("least")), others), "name-pairs")
        # Only what comes within the margin of a book that could be taken makes a survey ambiguous, so lower scores are looked for no farther than that.
        bars = found.groupBy(F.col("survey_key").alias("key")).agg((F.min("score") - min_margin - 1e-9).alias("least")).where(F.col("least") < min_score)
        rivals = candidates(materialise(bars, "name-bars"), others).where(F.col("score") < min_score)
        edges = found.unionByName(rivals).join(left.select(F.col("key").alias("survey_key"), F.col("first_seq").alias("seq")), "survey_key")
        edges = materialise(edges, "name-edges")
        linked = connected_components(edges.select(F.concat(F.lit("s "), "survey_key").alias("a"), F.concat(F.lit("b "), "book_key").alias("b")))
        linked = linked.select(F.expr("substring(node, 3)").alias("survey_key"), "component").where("node like 's %'")
        chosen = materialise(_chosen(edges.join(linked, "survey_key"), min_score, min_margin), "name-choices", hand_on=True)
        whole = materialise(surveys, "survey-groups", hand_on=True)
        counts = materialise(keyed, "book-counts", hand_on=True)
        same = materialise(exact.select("key", "book_key"), "equal-keys", hand_on=True)
    decided = same.select("key", "book_key", F.lit(1.0).alias("score"), F.lit("exact filename key").alias("method"))
    decided = decided.unionByName(chosen.select(F.col("survey_key").alias("key"), "book_key", "score", F.when(F.col("book_key").isNotNull(), "conservative filename similarity").alias("method")))
    rows = whole.join(decided, "key", "left").join(counts, "book_key", "left")
    status = F.when(F.col("book_key").isNotNull(), "PAIRED").when(F.col("score").isNotNull(), "AMBIGUOUS").otherwise("UNMATCHED")
    return rows.select(F.coalesce("key", "alone").alias("survey_key"), "first_seq", F.col("n_files").alias("n_surveys"), "book_key", "n_books", F.when(F.col("book_key").isNotNull(), F.col("score")).alias("score"), "method", status.alias("status"))


def unmatched_books(pairs: DataFrame, book_files: DataFrame) -> DataFrame:
    """Files (name, seq) of books that ``pair_files`` gave to nobody."""
    keyed = book_files.withColumn("key", ids.job_key(F.col("name")))
    used = pairs.where("book_key is not null").select(F.col("book_key").alias("key")).distinct()
    return keyed.join(used, "key", "left_anti").select("name", "seq")
