"""Redaction of JSON texts of any depth by their keys, with variant functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.storage import materialise, scope

#: Parts of a key whose value is hidden, and what is written instead.
HIDDEN = ("key", "token", "secret", "password")
MASK = "<redacted>"
#: Levels of nesting that are redacted within a row, and a sign, which JSON never has, that something lies deeper.
WITHIN, DEEPER = 6, "\0"


def _quoted(text: Column) -> Column:
    """A string as JSON has it."""
    one = F.to_json(F.array(text))
    return F.substring(one, F.lit(2), F.length(one) - 2)


def _secret(key: Column, hidden: tuple[str, ...]) -> Column:
    return F.coalesce(F.lower(key).rlike("|".join(hidden)), F.lit(False))


def _within(v: Column, hidden: tuple[str, ...], levels: int = WITHIN) -> Column:
    """Redacted text of a variant; DEEPER stands for what lies below ``levels``."""
    leaf = F.coalesce(F.to_json(v), F.lit("null"))
    if levels == 0:
        return F.when(leaf.substr(1, 1).isin("{", "[") & (F.length(leaf) > 2), F.lit(DEEPER)).otherwise(leaf)
    items = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.struct(F.lit(None).cast("string").alias("key"), x.alias("value")))
    members = F.coalesce(F.map_entries(F.try_variant_get(v, "$", "map<string, variant>")), items)

    def text(m: Column) -> Column:
        value = F.when(_secret(m["key"], hidden), _quoted(F.lit(MASK))).otherwise(_within(m["value"], hidden, levels - 1))
        return F.concat(F.when(m["key"].isNull(), "").otherwise(F.concat(_quoted(m["key"]), F.lit(":"))), value)

    def joined(found: Column) -> Column:
        inside, listed = F.array_join(F.transform(found, text), ","), F.get(found, F.lit(0))["key"].isNull()
        return F.when(F.coalesce(F.size(found), F.lit(0)) < 1, leaf).otherwise(F.concat(F.when(listed, "[").otherwise("{"), inside, F.when(listed, "]").otherwise("}")))

    # The one-row array gives the members a name, so that they are found once.
    return F.get(F.transform(F.array(members), joined), F.lit(0))


def _nodes(rows: DataFrame, hidden: tuple[str, ...]) -> DataFrame:
    """Kind and, for what isn't entered, text of nodes (id, path, up, pos, key, v)."""
    secret = _secret(F.col("key"), hidden)
    kind = F.when(secret, "LEAF").otherwise(F.regexp_extract(F.schema_of_variant("v"), "^(OBJECT|ARRAY)", 1))
    kind = F.when(kind == "", "LEAF").otherwise(kind)
    text = F.when(secret, _quoted(F.lit(MASK))).otherwise(F.coalesce(F.to_json("v"), F.lit("null")))
    return rows.withColumn("kind", kind).withColumn("text", F.when(F.col("kind") == "LEAF", text))


def redact(rows: DataFrame, key: str, column: str, hidden: tuple[str, ...] = HIDDEN) -> DataFrame:
    """``(key, column)`` with every value under a key that contains one of ``hidden`` (in any case) replaced, however deep it lies.

    The whole value goes, objects and arrays too, and is not entered.  ``key``
    is unique.  Null and texts that aren't JSON stay as they are, and so do
    JSON texts of a single value; keys of an object come out in their own
    order.  Six levels of nesting are redacted within the row.  Only rows that
    go deeper are taken apart: each level is one pass over the values of that
    level, written to the shared folder, and one grouping on the way back.
    """
    if not all(h and h == h.lower() and h.isalnum() for h in hidden):
        raise ValueError("hidden parts are words in lower case")
    spark = rows.sparkSession
    with scope(spark):
        read = rows.select(F.col(key).alias("id"), F.col(column).alias("source")).withColumn("v", F.try_parse_json("source"))
        read = read.withColumn("text", F.when(F.col("v").isNotNull(), _within(F.col("v"), hidden)))
        deep = F.contains("text", F.lit(DEEPER))
        read = read.select("id", F.when(F.col("text").isNull() | deep, F.col("source")).alias("source"), F.when(~deep, F.col("text")).alias("text"), F.coalesce(deep, F.lit(False)).alias("deep"))
        whole = materialise(read, "json-texts", hand_on=True)
        rest = whole.where("deep")
        if rest.isEmpty():
            return whole.select(F.col("id").alias(key), F.coalesce("text", "source").alias(column))
        level = rest.select("id", F.lit("").alias("path"), F.lit(None).cast("string").alias("up"), F.lit(0).alias("pos"), F.lit(None).cast("string").alias("key"), F.try_parse_json("source").alias("v")).where("v is not null")
        levels = []
        while True:
            found = materialise(_nodes(level, hidden), "json-level")
            levels.append(found.drop("v"))
            inner = found.where("kind != 'LEAF'")
            if inner.isEmpty():
                break
            level = spark.sql("SELECT id, concat(path, '/', e.pos) AS path, path AS up, e.pos AS pos, e.key AS key, e.value AS v FROM {inner}, LATERAL variant_explode(v) AS e", inner=inner)
        below = None
        for found in reversed(levels):
            leaves = found.where("kind = 'LEAF'").select("id", "path", "up", "pos", "key", "text")
            entered = found.where("kind != 'LEAF'")
            if below is None:
                below = leaves
                continue
            member = F.when(F.col("key").isNull(), F.col("text")).otherwise(F.concat(_quoted(F.col("key")), F.lit(":"), F.col("text")))
            joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", member.alias("m")))), lambda x: x["m"]), ",")
            content = below.groupBy("id", F.col("up").alias("path")).agg(joined.alias("inside"))
            inside = F.coalesce("inside", F.lit(""))
            text = F.when(F.col("kind") == "OBJECT", F.concat(F.lit("{"), inside, F.lit("}"))).otherwise(F.concat(F.lit("["), inside, F.lit("]")))
            below = leaves.unionByName(entered.join(content, ["id", "path"], "left").select("id", "path", "up", "pos", "key", text.alias("text")))
        done = materialise(below.select("id", F.col("text").alias("deep_text")), "json-redacted", hand_on=True)
    shallow = whole.where("not deep").select(F.col("id").alias(key), F.coalesce("text", "source").alias(column))
    return shallow.unionByName(rest.join(done, "id", "left").select(F.col("id").alias(key), F.coalesce("deep_text", "source").alias(column)))
