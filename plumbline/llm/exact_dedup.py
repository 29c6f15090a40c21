"""Exact dedup: 128-bit content hash, then a byte comparison inside each hash group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.storage import materialise, scope

#: Characters that equality ignores: space and U+0009 to U+000D.
BLANKS = (" ", "\n", "\t", "\r", "\x0b", "\x0c")
BROADCAST_BYTES = 32 << 20
_RAW = ("__plumbline_raw_1", "__plumbline_raw_2")


def raw_hashes() -> list[Column]:
    """128 bits of the text as it is (null: empty), as ``raw_1`` and ``raw_2``."""
    text = F.coalesce("text", F.lit(""))
    return [F.xxhash64(text).alias("raw_1"), F.xxhash64(F.lit("b"), text).alias("raw_2")]


def normalised(text: Column) -> Column:
    """The text without blanks; null counts as empty."""
    return reduce(lambda c, ch: F.replace(c, F.lit(ch), F.lit("")), BLANKS, F.coalesce(text, F.lit("")))


def _hashed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.length(text).cast("long").alias("n"), *raw_hashes(), normalised(F.col("text")).alias("norm"))
    return rows.select("doc_id", "n", "raw_1", "raw_2", "norm", F.xxhash64("norm").alias("h1"), F.xxhash64(F.lit("b"), "norm").alias("h2"))


def _keeper() -> Column:
    """Most code points, then the smallest id; a null id comes last."""
    return F.min(F.struct((-F.col("n")).alias("minus_n"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"))).alias("best")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """Return one row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Rows are equal when their texts are identical without blanks.  The group
    keeps the row with the most code points in its original text, then the
    smallest doc_id.  Null texts count as empty; a null doc_id is kept only
    where its group has no other row as long, and its ``keep_id`` is then
    null.  Rows that repeat a doc_id all count; of rows that are the same in
    id and length, all carry the same decision except ``kept``, which holds
    for each copy of the keeper's id and length.  An empty table gives an
    empty result; other columns are not read.

    One narrow table (ids, lengths, two 64-bit hashes, SHA-256) is written to
    the shared folder.  Texts move only for rows whose 128-bit hash occurs
    more than once: they are grouped by hash *and* text, with partial
    aggregation, so a group with a third of all rows sends one row per task.
    A hash with two texts is a collision, and its rows are then told apart by
    text.  No group is collected.
    """
    with scope(docs.sparkSession):
        return _decided(docs).drop("raw_1", "raw_2")


def _decided(docs: DataFrame) -> DataFrame:
    """Decisions with the raw hashes, inside the caller's scope; they read two tables that are handed on to the block around it."""
    digests = materialise(
        _hashed(docs).select("doc_id", "n", "raw_1", "raw_2", "h1", "h2", F.unhex(F.sha2("norm", 256)).alias("sha")), "digests", hand_on=True
    )
    groups = materialise(digests.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("group_size"), _keeper()), "hash-groups", hand_on=True)
    repeated = materialise(groups.where("group_size > 1").select("h1", "h2"), "repeated-hashes")
    narrow = repeated.count() * 16 <= BROADCAST_BYTES
    texts = _hashed(docs).join(F.broadcast(repeated) if narrow else repeated, ["h1", "h2"], "left_semi")
    by_text = texts.groupBy("h1", "h2", "norm").agg(F.count(F.lit(1)).alias("group_size"), _keeper())
    by_text = materialise(
        by_text.select("h1", "h2", F.unhex(F.sha2("norm", 256)).alias("sha"), F.md5("norm").alias("md5"), "group_size", "best"), "text-groups"
    )
    collided = materialise(by_text.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1"), "collided-hashes", hand_on=True)
    if collided.isEmpty():
        found = digests.join(groups, ["h1", "h2"])
    else:
        found = _with_collisions(docs, digests, groups, collided)
    best = F.col("best")
    return found.select(
        "doc_id",
        best["doc_id"].alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("doc_id").eqNullSafe(best["doc_id"]) & (F.col("n") == -best["minus_n"])).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "raw_1",
        "raw_2",
    )


def _with_collisions(docs: DataFrame, digests: DataFrame, groups: DataFrame, collided: DataFrame) -> DataFrame:
    """Rows with their groups, where rows of a collided hash are grouped and joined by the text itself."""
    keys = collided.select("h1", "h2")
    plain = digests.join(groups.join(keys, ["h1", "h2"], "left_anti"), ["h1", "h2"])
    rows = _hashed(docs).join(keys, ["h1", "h2"], "left_semi")
    exact = rows.groupBy("h1", "h2", "norm").agg(F.count(F.lit(1)).alias("group_size"), _keeper())
    told = rows.join(exact, ["h1", "h2", "norm"])
    told = told.withColumn("sha", F.unhex(F.sha2("norm", 256)))
    return plain.unionByName(told.select(*plain.columns))


def keep_decided(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``decided`` keeps, with all their columns; rows alike in id and text come out once.

    ``decided`` has a row for each row of ``docs``: doc_id, raw_1, raw_2,
    kept.  Only the narrow keys of dropped rows are joined back, and they are
    broadcast while they are few.  Null ids are equal to each other here, and
    columns of ``docs`` may have any names.  What the result reads is handed on
    from the caller's scope.
    """
    keys = ["doc_id", "raw_1", "raw_2"]
    dropped = materialise(decided.where("not kept").select(*keys).distinct(), "dropped-rows", hand_on=True)
    again = materialise(decided.where("kept").groupBy(*keys).count().where("count > 1").select(*keys), "repeated-rows", hand_on=True)
    small = dropped.count() * 24 <= BROADCAST_BYTES
    keyed = docs.withColumns(dict(zip(_RAW, raw_hashes())))
    same = lambda other: keyed["doc_id"].eqNullSafe(other["doc_id"]) & (keyed[_RAW[0]] == other["raw_1"]) & (keyed[_RAW[1]] == other["raw_2"])
    kept = keyed.join(F.broadcast(dropped) if small else dropped, same(dropped), "left_anti")
    if again.isEmpty():
        return kept.drop(*_RAW)
    once = kept.join(again, same(again), "left_semi").dropDuplicates(["doc_id", *_RAW])
    return kept.join(again, same(again), "left_anti").unionByName(once).drop(*_RAW)


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that exact dedup keeps, with all their columns; one row of each group.

    Decisions are those of ``exact_duplicates``, row by row: another text
    under the id (or the null id) of a dropped row stays.  Rows that repeat an
    id and a text come out once; an empty table gives an empty result; extra
    columns of any name are kept.
    """
    with scope(docs.sparkSession):
        with scope(docs.sparkSession):
            decided = materialise(_decided(docs), "dedup-decisions", hand_on=True)
        return keep_decided(docs, decided)
