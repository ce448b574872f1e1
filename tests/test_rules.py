"""One tiny frame per null / tie / bin rule (FIXTURES.md section 3)."""

import math

from pyspark.sql import functions as F

from pitchframe.functions import binning, geometry
from pitchframe.functions import semantics as S
from pitchframe.operators.relational import first_by_key, flag_in, split_typed, top_k


def test_n1_not_in_keeps_null(spark):
    df = spark.createDataFrame([("corn",), (None,), ("open",)], "t string")
    kept = [r.t for r in df.filter(S.not_in_set("t", ["corn"])).collect()]
    assert sorted(kept, key=str) == sorted([None, "open"], key=str)


def test_n2_if_else_keeps_null(spark):
    df = spark.createDataFrame([(1,), (0,), (None,)], "g int")
    out = df.groupBy(S.if_else(F.col("g") == 1, "goal", "no").alias("o")).count().collect()
    assert {r.o for r in out} == {"goal", "no", None}


def test_n4_strict_sum_and_n5_lenient_sum(spark):
    df = spark.createDataFrame([(1, 1), (1, None), (2, None)], "k int, g int")
    got = {r.k: (r.s, r.l) for r in df.groupBy("k").agg(S.strict_sum("g").alias("s"),
                                                          S.lenient_sum("g").alias("l")).collect()}
    assert got[1] == (None, 1)
    assert got[2] == (None, 0)


def test_n6_distinct_count_counts_null(spark):
    df = spark.createDataFrame([(1,), (1,), (None,)], "m int")
    assert df.agg(S.n_distinct("m").alias("n")).first().n == 2


def test_n7_null_safe_membership(spark):
    left = spark.createDataFrame([(None,), (1,), (2,)], "k int")
    right = spark.createDataFrame([(None,), (1,)], "k int")
    safe = {r.k: r.f for r in flag_in(left, right, ["k"], "f", null_safe=True).collect()}
    plain = {r.k: r.f for r in flag_in(left, right, ["k"], "f").collect()}
    assert safe == {None: True, 1: True, 2: False}
    assert plain == {None: False, 1: True, 2: False}


def test_n8_nulls_last_both_directions(spark):
    df = spark.createDataFrame([(2,), (None,), (1,)], "x int")
    assert [r.x for r in df.orderBy(S.asc_last("x")).collect()] == [1, 2, None]
    assert [r.x for r in df.orderBy(S.desc_last("x")).collect()] == [2, 1, None]


def test_n9_ties_fall_back_to_key(spark):
    df = spark.createDataFrame([(3, 50.0), (1, 50.0), (2, 50.0)], "team int, rate double")
    assert [r.team for r in top_k(df, 2, [S.desc_last("rate")], ["team"]).collect()] == [1, 2]


def test_n10_zone_rounds_half_to_even(spark):
    df = spark.createDataFrame([(5.0,), (15.0,), (25.0,), (35.0,)], "x double")
    assert [r.z for r in df.select(binning.zone("x").alias("z")).collect()] == [0, 20, 20, 40]


def test_n11_paste0_writes_na(spark):
    df = spark.createDataFrame([(None, 189918)], "label string, season long")
    got = df.select(S.paste0(F.col("label"), " (", F.col("season"), ")").alias("t")).first().t
    assert got == "NA (189918)"


def test_n13_zero_denominator_is_null(spark):
    df = spark.createDataFrame([(0, 0)], "a long, b long")
    assert df.select(S.pct(F.col("a"), F.col("b")).alias("p")).first().p is None


def test_n14_first_row_per_key_follows_declared_order(spark):
    df = spark.createDataFrame([(7, "b", 2), (7, "a", 9), (8, None, 1), (8, "z", 5)], "e int, t string, v int")
    got = {r.e: (r.t, r.v) for r in first_by_key(df, ["e"]).collect()}
    assert got == {7: ("a", 9), 8: ("z", 5)}  # nulls sort last


def test_n15_right_closed_bins(spark):
    df = spark.createDataFrame([(0.0,), (5.0,), (5.01,), (60.0,), (60.01,), (None,)], "d double")
    idx, lab = binning.cut("d", binning.seq_breaks(0.0, 60.0, 5.0))
    got = [(r.i, r.l) for r in df.select(idx.alias("i"), lab.alias("l")).collect()]
    assert got == [(1, "[0,5]"), (1, "[0,5]"), (2, "(5,10]"), (12, "(55,60]"), (None, None), (None, None)]


def test_bin_breaks_and_labels():
    b = binning.seq_breaks(0.0, 1.0, 0.05)
    assert len(b) == 21 and b[3] == 3 * 0.05
    labels = binning.interval_labels(b)
    assert labels[0] == "[0,0.05]" and labels[2] == "(0.1,0.15]" and labels[-1] == "(0.95,1]"
    assert binning.interval_labels((0.0, 15.0, 30.0, 45.0, 60.0, 75.0, 90.0, 120.0))[-1] == "(90,120]"


def test_angle_bins_upper_bound_chain(spark):
    df = spark.createDataFrame([(0.0,), (20.0,), (20.5,), (120.0,), (150.0,)], "a double")
    idx, lab = binning.upper_bound_bins("a", (0.0, 20.0, 40.0, 60.0, 80.0, 100.0, 120.0, 180.0))
    got = [r.l for r in df.select(lab.alias("l")).collect()]
    assert got == ["[0,20]", "[0,20]", "(20,40]", "(100,120]", "(120,180]"]


def test_split_typed_missing_and_extra_pieces(spark):
    df = spark.createDataFrame([("3-1",), ("2",), ("x-1",), ("1-2-3",)], "s string")
    got = [(r.a, r.b) for r in df.select(*split_typed("s", "-", ["a", "b"])).collect()]
    assert got == [(3, 1), (2, None), (None, 1), (1, 2)]


def test_b6_angle_geometry(spark):
    rows = [(100.0, 50.0), (50.0, 40.0), (50.0, 60.0)]  # goal line centre; mirrored pair
    df = spark.createDataFrame(rows, "x double, y double")
    x_m, y_m = geometry.x_metres("x"), geometry.y_metres("y")
    got = [r.a for r in df.select(geometry.goal_angle_deg(x_m, y_m).alias("a")).collect()]
    assert math.isclose(got[0], 180.0)
    assert math.isclose(got[1], got[2])
    d = df.select(geometry.distance_to_goal(x_m, y_m).alias("d")).first().d
    assert math.isclose(d, 0.0, abs_tol=1e-9)


def test_is_finite(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (None,)], "v double")
    assert [r.f for r in df.select(geometry.is_finite(F.col("v")).alias("f")).collect()] == [True, False, False, False]
