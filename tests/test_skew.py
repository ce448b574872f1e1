"""A key holding a third of all rows is split, not sent to one task."""

import contextlib
import io

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pitchframe.operators.quantile import exact_median
from pitchframe.operators.relational import flag_in
from pitchframe.operators.sequence import GUEST, RANGE, log_ranges, next_event


def _hot_log(spark, n=30000):
    # match 0 holds a third of the events, the rest spread over 500 matches
    return (spark.range(n)
            .select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 500 + 1).alias("MATCH_WYID"),
                    F.col("id").alias("EVENT_WYID"), (F.col("id") % 2).alias("TEAM_WYID"),
                    F.when(F.col("id") % 5 == 0, "shot").otherwise("pass").alias("PRIMARYTYPE")))


def test_hot_match_is_split_across_ranges(spark):
    ranges = log_ranges(_hot_log(spark), ["MATCH_WYID", "EVENT_WYID"], ["TEAM_WYID"], 12)
    sizes = [r["count"] for r in ranges.filter(~F.col(GUEST)).groupBy(RANGE).count().collect()]
    assert len(sizes) == 12 and max(sizes) < 2.5 * (sum(sizes) / len(sizes))  # no range near a third of the rows


def test_repeated_identical_event(spark):
    hot = F.col("MATCH_WYID") == 0
    log = (_hot_log(spark, 3000)  # a third of the rows become one identical event
           .withColumn("EVENT_WYID", F.when(hot, F.lit(0)).otherwise(F.col("EVENT_WYID")))
           .withColumn("TEAM_WYID", F.when(hot, F.lit(0)).otherwise(F.col("TEAM_WYID")))
           .withColumn("PRIMARYTYPE", F.when(hot, F.lit("pass")).otherwise(F.col("PRIMARYTYPE"))))
    nx = next_event(log, ["MATCH_WYID", "EVENT_WYID"], ["TEAM_WYID", "PRIMARYTYPE"], num_partitions=12)
    follow = nx.filter(hot).groupBy("next_TEAM_WYID", "next_PRIMARYTYPE").count().collect()
    assert nx.count() == 3000 and max(r["count"] for r in follow) >= 999


@pytest.mark.parametrize("reuse", ["true", "false"])
def test_lead_and_median_of_a_wide_large_log(spark, reuse):
    spark.conf.set("spark.sql.exchange.reuse", reuse)
    try:
        log = _hot_log(spark, 400_000).withColumn("extra", F.col("EVENT_WYID") * 3).withColumn("more", F.lit("x"))
        nx = next_event(log, ["MATCH_WYID", "EVENT_WYID"], ["TEAM_WYID", "PRIMARYTYPE"], num_partitions=16)
        w = Window.orderBy("MATCH_WYID", "EVENT_WYID")
        ref = log.select("EVENT_WYID", F.lead("PRIMARYTYPE").over(w).alias("np"), F.lead("TEAM_WYID").over(w).alias("nt"))
        bad = nx.join(ref, "EVENT_WYID").filter(~(F.col("next_PRIMARYTYPE").eqNullSafe(F.col("np"))
                                                  & F.col("next_TEAM_WYID").eqNullSafe(F.col("nt"))))
        assert nx.columns == [*log.columns, "next_TEAM_WYID", "next_PRIMARYTYPE"]
        assert bad.count() == 0 and nx.count() == 400_000
        values = log.select((F.col("MATCH_WYID") == 0).alias("g"), (F.col("extra") % 99_991).cast("double").alias("x"), "more")
        got = {r.g: r.m for r in exact_median(values, ["g"], "x", "m").collect()}
        assert got == {r.g: r.m for r in values.groupBy("g").agg(F.median("x").alias("m")).collect()}
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")


def test_hot_match_lead_is_still_exact(spark):
    log = _hot_log(spark, 6000)
    nx = next_event(log, ["MATCH_WYID", "EVENT_WYID"], ["TEAM_WYID", "PRIMARYTYPE"], num_partitions=12)
    from pyspark.sql import Window
    w = Window.orderBy("MATCH_WYID", "EVENT_WYID")
    ref = log.select("EVENT_WYID", F.lead("PRIMARYTYPE").over(w).alias("np"))
    bad = nx.join(ref, "EVENT_WYID").filter(~F.col("next_PRIMARYTYPE").eqNullSafe(F.col("np"))).count()
    assert bad == 0


def test_hot_key_membership_join_is_split_by_aqe(spark):
    conf = {"spark.sql.adaptive.enabled": "true",
            "spark.sql.adaptive.skewJoin.enabled": "true",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
            "spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(60000).select(
            F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("k"), "id")
        keys = spark.range(0, 60000, 7).select(F.col("id").alias("k"))
        out = flag_in(rows, keys, ["k"], "hit")
        got = out.collect()  # run it, so that the adaptive plan is final
        assert sum(r.hit for r in got) == rows.join(keys.distinct(), "k", "left_semi").count()
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            out.explain()
        plan = buf.getvalue()
        assert "isFinalPlan=true" in plan
        assert "SortMergeJoin(skew=true)" in plan
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_lead_exact_without_exchange_reuse(spark):
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        log = _hot_log(spark, 3000)
        nx = next_event(log, ["MATCH_WYID", "EVENT_WYID"], ["TEAM_WYID", "PRIMARYTYPE"], num_partitions=7)
        from pyspark.sql import Window
        ref = log.select("EVENT_WYID", F.lead("PRIMARYTYPE").over(Window.orderBy("MATCH_WYID", "EVENT_WYID")).alias("np"))
        assert nx.join(ref, "EVENT_WYID").filter(~F.col("next_PRIMARYTYPE").eqNullSafe(F.col("np"))).count() == 0
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")


def test_median_exact_without_exchange_reuse(spark):
    from pitchframe.operators.quantile import exact_median

    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        df = spark.range(5000).select((F.col("id") % 3 == 0).alias("g"), ((F.col("id") * 7919) % 1013).cast("double").alias("x"))
        got = {r.g: r.m for r in exact_median(df, ["g"], "x", "m").collect()}
        want = {r.g: r.m for r in df.groupBy("g").agg(F.median("x").alias("m")).collect()}
        assert got == want
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
