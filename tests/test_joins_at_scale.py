"""What one task of a join takes in stays the same for larger tables."""

from pyspark.sql import functions as F

from tallyloom import session


def test_larger_side_is_dealt_by_rows(spark, monkeypatch):
    monkeypatch.setattr(session, "JOINED_ROWS", 1000)
    orders, lines = spark.range(20_000), spark.range(60_000).select((F.col("id") / 4).cast("long").alias("k"))
    dealt = session.dealt_to_join(lines, "k")
    found = orders.join(dealt.hint("merge"), F.col("id") == F.col("k"), "left_semi")
    assert found.count() == 15_000
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == plan.count(", 60)") == 2  # the other side follows, nothing is shuffled twice
    assert session.dealt_to_join(lines.limit(2000), "k").rdd.getNumPartitions() <= 8


def test_inferred_records_are_read_by_several_tasks(spark):
    from tallyloom.plans import payloads
    from tallyloom.plans.base import Tables

    t = Tables(spark, "/root/testdata/sf0.01")
    assert t.events.rdd.getNumPartitions() == 1
    assert payloads.c1_odd_records(t).rdd.getNumPartitions() > 1
