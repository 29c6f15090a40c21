from __future__ import annotations

import random

from pyspark.sql import functions as F

from plumbline.operators import audit, records

SCHEMA = "chain_id string, place long, event_id string, ts_utc string, actor string, module string, action string, object_type string, object_id string, revision int, details_json string, extra int"


def events(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def row(chain, place, action="EDIT", **more):
    base = {"event_id": f"e{place}", "ts_utc": "t", "actor": "a", "module": "m", "action": action, "object_type": None, "object_id": None, "revision": None, "details_json": None} | more
    return (chain, place, *base.values(), 1)


def none(spark):
    return spark.createDataFrame([], "chain_id string, seq long, event_hash string")


#: Hashes of payloads that were written out by hand.
LITERAL = [
    (("p1", 1, "e1", "2024-05-01T10:00:00+00:00", "ana", "ControlSync", "IMPORT", None, "", None, '{"rows":3}', 1), "19f217c769b476dca7eaeac9a901f7724f5d24c4e3c1dc91cdc7dc9b38dd2cfb"),
    (("p1", 2, "e2", "2024-05-01T10:00:01+00:00", "bo", "Topo", 'ÉDIT\x1f"x"', "point", "7", 2, None, 1), "0c70723d5ccfec0a19daea506e0675611f37a21eee148dee600c39f7fb148d53"),
]


def test_literal_payloads_and_genesis(spark):
    got = {r.seq: r for r in audit.append(none(spark), events(spark, [r for r, _ in LITERAL])).collect()}
    assert [got[k].event_hash for k in (1, 2)] == [h for _, h in LITERAL]
    assert got[1].prev_hash == "0" * 64 and got[2].prev_hash == got[1].event_hash


def test_parts_continue_a_chain(spark):
    rng = random.Random(4)
    rows = [row(f"c{rng.randrange(4)}", k, action=f"A{k % 3}") for k in range(80)] + [row(None, 500), row(None, 501)]
    whole = audit.append(none(spark), events(spark, rows))
    first = audit.append(none(spark), events(spark, rows[:30]))
    second = audit.append(audit.tails(first), events(spark, rows[30:80]))
    key = lambda df: sorted((r.chain_id, r.seq, r.event_hash) for r in df.where("chain_id is not null").collect())
    assert key(first.unionByName(second)) == key(whole)
    told = {r.chain_id: (r.n_events, r.broken_at) for r in audit.verify(whole).collect()}
    assert all(b is None for _, b in told.values()) and sum(n for n, _ in told.values()) == 82


def test_chains_stay_whole_behind_a_join_on_the_chain(spark):
    wide = spark.range(0, 4000, 1, 8).selectExpr("id % 50 AS chain_id", "id AS place", "id AS event_id", "'t' AS ts_utc", "'a' AS actor", "'m' AS module", "'EDIT' AS action", "'point' AS object_type", "id AS object_id", "1L AS revision", "'{}' AS details_json")
    rows = spark.range(0, 4000, 1, 8).selectExpr("id % 50 AS chain", "id AS place", "'x' AS action")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        first = audit.append(none(spark), wide.where("place < 900"))
        second = audit.append(audit.tails(first), wide.where("place >= 900"))
        assert {(r.n_events, r.broken_at) for r in audit.verify(first.unionByName(second)).collect()} == {(80, None)}
        tails = rows.where("place < 50").selectExpr("chain", "1L AS seq", "'h' AS event_hash").groupBy("chain").agg(F.max("seq").alias("seq"), F.max("event_hash").alias("event_hash"))
        more = records.append_events(tails, rows.where("place >= 50"), "chain", "place", "action")
        # A join's parts may be split or read where they lie, so a chain's rows are dealt once more.
        assert all(df._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_COL") == n for df, n in ((second, 2), (more, 1)))
        assert {(r.n, r.low, r.high) for r in more.groupBy("chain").agg(F.countDistinct("seq").alias("n"), F.min("seq").alias("low"), F.max("seq").alias("high")).collect()} == {(79, 2, 80)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_changes_gaps_and_foreign_rows_break_a_chain(spark):
    chain = audit.append(none(spark), events(spark, [row("c", k) for k in range(6)]))
    broken = lambda df: audit.verify(df).first().broken_at
    assert broken(chain) is None and audit.verify(chain.limit(0)).count() == 0
    assert broken(chain.withColumn("actor", F.when(F.col("seq") == 3, "x").otherwise(F.col("actor")))) == 3
    assert broken(chain.where("seq != 2")) == 3 and broken(chain.where("seq != 1")) == 2
    assert broken(chain.unionByName(chain.where("seq = 4"))) == 4
    assert broken(chain.withColumn("seq", F.when(F.col("seq") == 5, None).otherwise(F.col("seq")))) == 0
    other = audit.append(none(spark), events(spark, [row("c", k, action="OTHER") for k in range(6)]))
    assert broken(chain.where("seq < 4").unionByName(other.where("seq >= 4"))) == 4
