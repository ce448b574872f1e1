"""Order-independent sums, radix medians, ranged leads, packed first rows and bitmap sets against brute force."""

import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchframe.functions.semantics import n_distinct
from pitchframe.operators.bitmaps import distinct_ids, flag_in_bitmap
from pitchframe.operators.exact import exact_mean, exact_sum
from pitchframe.operators.quantile import exact_median, median_of_counts, order_key, value_counts
from pitchframe.operators.relational import first_by_key, flag_in
from pitchframe.operators.sequence import GUEST, RANGE, log_ranges, next_event, successors


def jobs(spark, build):
    """Jobs started by ``build``, and what it returns."""
    sc, group = spark.sparkContext, f"build-{random.random()}"
    sc.setJobGroup(group, "building a plan")
    try:
        return build(), len(sc.statusTracker().getJobIdsForGroup(group))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


# -- sums and means ------------------------------------------------------------------------------

def test_sums_do_not_depend_on_the_partitioning(spark):
    rng = random.Random(1)
    values = [rng.uniform(-1, 1) * 10 ** rng.randint(-6, 9) for _ in range(20_000)] + [None] * 50
    df = spark.createDataFrame([(i % 3, v) for i, v in enumerate(values)], "g int, x double")
    got = set()
    for n in (1, 4, 64):
        out = df.repartition(n).groupBy("g").agg(exact_sum("x").alias("s"), exact_mean("x").alias("m"))
        got.add(tuple(sorted((r.g, struct.pack("<d", r.s), struct.pack("<d", r.m)) for r in out.collect())))
    assert len(got) == 1
    for g, s, m in got.pop():
        own = [v for i, v in enumerate(values) if i % 3 == g and v is not None]
        assert math.isclose(struct.unpack("<d", s)[0], math.fsum(own), rel_tol=1e-14)
        assert math.isclose(struct.unpack("<d", m)[0], math.fsum(own) / len(own), rel_tol=1e-14)


def test_sums_cancel_exactly(spark):
    values = [1e15, 1.5, -1e15, 2.0 ** -20, -1.5, 0.1, -0.1, 3.0, -0.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert df.agg(exact_sum("x")).first()[0] == 3.0 + 2.0 ** -20


def test_sums_of_odd_groups(spark):
    inf, nan = math.inf, math.nan
    rows = [(0, None), (1, None), (1, 0.5), (2, nan), (2, 1.0), (3, inf), (3, 1.0), (4, inf), (4, -inf), (5, 1e300), (5, 1e300)]
    got = {r.g: (r.s, r.m) for r in spark.createDataFrame(rows, "g int, x double").groupBy("g")
           .agg(exact_sum("x").alias("s"), exact_mean("x").alias("m")).collect()}
    assert got[0] == (None, None) and got[1] == (0.5, 0.5) and got[3] == (inf, inf) and got[5] == (2e300, 1e300)
    assert all(math.isnan(v) for g in (2, 4) for v in got[g])


def test_weighted_sums_equal_repeated_rows(spark):
    rows = [(i % 7 / 7, 1 + i % 4) for i in range(200)]
    weighted = spark.createDataFrame(rows + [(None, 9)], "x double, c long")
    plain = spark.createDataFrame([(x,) for x, c in rows for _ in range(c)], "x double")
    assert weighted.agg(exact_sum("x", times="c"), exact_mean("x", times="c")).first() == \
        plain.agg(exact_sum("x"), exact_mean("x")).first()


# -- medians ---------------------------------------------------------------------------------------

def test_order_key_orders_like_the_value(spark):
    rng = np.random.default_rng(3)
    bits = rng.integers(0, 0x7FF0_0000_0000_0000, 3000, dtype=np.uint64)
    values = np.concatenate([bits.view(np.float64), -bits.view(np.float64), 2.0 ** np.arange(-1074, 1024),
                             np.nextafter(2.0 ** np.arange(-1000, 1024.0), 0), [0.0, math.inf, -math.inf, 1.7976931348623157e308, 5e-324]])
    got = spark.createDataFrame([(float(v),) for v in values], "x double").select("x", order_key("x").alias("k")).collect()
    for r in got:
        want = struct.unpack("<q", struct.pack("<d", abs(r.x)))[0]
        assert r.k == (-want if r.x < 0 else want), r


@pytest.mark.parametrize("seed", range(3))
def test_median_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([None, "a", "b"]), rng.choice([None, math.nan, 0.0, -0.0, 1.0, rng.gauss(0, 100), rng.gauss(0, 1e-5)]))
            for _ in range(700)]
    rows += [("const", 4.25)] * 31 + [("none", None)] * 3 + [("one", -7.5)] + [("two", 1.0), ("two", 2.0)]
    rows += [("hot", rng.uniform(0, 50)) for _ in range(4000)] + [("inf", math.inf), ("inf", 1.0), ("inf", -math.inf)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(7)
    (out, n) = jobs(spark, lambda: exact_median(df, ["g"], "x", "m"))
    assert n == 0
    want = {}
    for g in {g for g, _ in rows}:
        own = sorted(x for k, x in rows if k == g and x is not None and not math.isnan(x))
        if own:
            want[g] = (own[(len(own) - 1) // 2] + own[len(own) // 2]) / 2
    assert {r.g: r.m for r in out.collect()} == want


def test_median_plan_samples_nothing(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("g"), F.col("id").cast("double").alias("x"))
    plan = exact_median(df, ["g"], "x", "m")._jdf.queryExecution().toString()
    assert "rand(" not in plan and "TakeOrdered" not in plan and "Sample" not in plan
    assert exact_median(df.limit(0), ["g"], "x", "m").count() == 0


def test_value_counts_keep_each_value(spark):
    rows = [(i % 3, [None, math.nan, -0.0, 0.0, 2.5][i % 5]) for i in range(300)]
    df = spark.createDataFrame(rows, "g int not null, x double").repartition(5)
    counts = value_counts(df, ["g"], "x")
    assert sorted(map(repr, counts.collect())) == sorted(
        f"Row(g={g}, _v={v}, _c={n})" for g in range(3) for v, n in ((None, 20), (math.nan, 20), (0.0, 40), (2.5, 20)))
    out = counts.groupBy("g").agg(F.sum("_c").alias("n")).join(median_of_counts(counts, ["g"], "m"), "g")
    assert {tuple(r) for r in out.collect()} == {(g, 100, 0.0) for g in range(3)}


# -- leads -------------------------------------------------------------------------------------------

def log_rows(rng, n):
    rows = [(rng.choice([None, 0, 0, 0, rng.randint(1, 40)]), rng.choice([None, rng.randint(0, 200)]),
             rng.choice([None, 1, 2]), rng.choice(["pass", "shot", None])) for _ in range(n)]
    return rows + rows[: n // 10]


def brute_lead(rows):
    key = lambda r: tuple((v is None, v if v is not None else 0) for v in r)
    rows = sorted(rows, key=key)
    return [(*r, *(rows[i + 1][2:] if i + 1 < len(rows) else (None, None))) for i, r in enumerate(rows)]


@pytest.mark.parametrize("n, ranges", [(600, 8), (600, 200), (900, 2000), (300, 20_000), (1, 50), (0, 8), (2, 200)])
def test_lead_at_any_number_of_ranges(spark, n, ranges):
    rows = log_rows(random.Random(n), n)
    log = spark.createDataFrame(rows, "MATCH_WYID int, EVENT_WYID int, TEAM_WYID int, PRIMARYTYPE string").repartition(5)
    out, started = jobs(spark, lambda: next_event(log, ["MATCH_WYID", "EVENT_WYID"], ["TEAM_WYID", "PRIMARYTYPE"], num_partitions=ranges))
    assert started == 0 and out.columns == [*log.columns, "next_TEAM_WYID", "next_PRIMARYTYPE"]
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, brute_lead(rows)))


def test_lead_inside_a_match_only(spark):
    rows = log_rows(random.Random(9), 500)
    log = spark.createDataFrame(rows, "MATCH_WYID int, EVENT_WYID int, TEAM_WYID int, PRIMARYTYPE string")
    out = next_event(log, ["MATCH_WYID", "EVENT_WYID"], ["TEAM_WYID", "PRIMARYTYPE"], scope="match", num_partitions=40)
    want = brute_lead(rows)
    for i, r in enumerate(want):
        if i + 1 == len(want) or want[i + 1][0] != r[0]:
            want[i] = (*r[:4], None, None)
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, want))
    with pytest.raises(ValueError):
        successors(log, [], [], scope="season")


def test_stored_ranges_serve_many_readers(spark, tmp_path):
    rows = log_rows(random.Random(4), 800)
    log = spark.createDataFrame(rows, "MATCH_WYID int, EVENT_WYID int, TEAM_WYID int, PRIMARYTYPE string")
    order, carry = ["MATCH_WYID", "EVENT_WYID"], ["TEAM_WYID", "PRIMARYTYPE"]
    log_ranges(log, order, carry, 30).write.parquet(str(tmp_path / "ranges"))
    stored = spark.read.parquet(str(tmp_path / "ranges"))
    sizes = {r[RANGE]: r["count"] for r in stored.filter(~F.col(GUEST)).groupBy(RANGE).count().collect()}
    assert sorted(sizes) == list(range(len(sizes))) and len(sizes) > 20  # no empty range between others
    got = successors(stored, order, carry)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, brute_lead(rows)))


# -- first rows ----------------------------------------------------------------------------------

def test_first_rows_without_a_window(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, 1, 2, 3]), rng.choice([None, 1, 2]), rng.choice([None, "a", "B", ""]),
             rng.choice([None, math.nan, -0.0, 1.5]), rng.choice([None, True])) for _ in range(400)]
    df = spark.createDataFrame(rows, "k int, i int, s string, x double, b boolean").repartition(6)
    got = first_by_key(df, ["k"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and got.schema == df.schema
    key = lambda r: tuple((v is None, (math.inf if isinstance(v, float) and math.isnan(v) else v) if v is not None else 0) for v in r[1:])
    want = {k: min((r for r in rows if r[0] == k), key=key) for k in (None, 1, 2, 3)}
    assert {r.k: repr(tuple(r)) for r in got.collect()} == {k: repr(tuple(v)) for k, v in want.items()}
    assert first_by_key(df.select("k"), ["k"]).count() == 4  # keys alone: the distinct keys


# -- bitmap sets -----------------------------------------------------------------------------------

@pytest.mark.parametrize("seed", range(3))
def test_bitmap_sets_equal_joins_and_counts(spark, seed):
    rng = random.Random(seed)
    ids = [None, 0, 1, -1, -40_000, 32_767, 32_768, 32_769, 10 ** 12, 10 ** 12 + 7, *range(50, 90)]
    left = [(rng.choice(ids), rng.choice(["a", "b", None])) for _ in range(300)]
    right = [(rng.choice(ids),) for _ in range(25)] + ([(None,)] if seed else [])
    a, b = spark.createDataFrame(left, "id long, g string"), spark.createDataFrame(right, "y long")
    for null_safe in (False, True):
        got = flag_in_bitmap(a, b, ("id", "y"), "f", null_safe=null_safe)
        want = flag_in(a, b, [("id", "y")], "f", null_safe=null_safe)
        assert got.columns == want.columns == ["id", "g", "f"]
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    got, want = distinct_ids(a, ["g"], "id", "n"), a.groupBy("g").agg(n_distinct("id").alias("n"))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_unread_bitmap_flag_is_left_out(spark):
    a = spark.createDataFrame([(1, "a"), (None, "b"), (2, "c")], "id long, g string")
    b = spark.createDataFrame([(1,), (1,), (None,)], "id long")
    out = flag_in_bitmap(a, b, "id", "f", null_safe=True)
    assert {tuple(r) for r in out.collect()} == {(1, "a", True), (None, "b", True), (2, "c", False)}
    assert "Join" not in out.select("g")._jdf.queryExecution().optimizedPlan().toString()


def test_bitmaps_merge_before_the_shuffle(spark):
    a = spark.range(100_000).select((F.col("id") % 40_000).alias("id"), (F.col("id") % 2).alias("g")).repartition(8)
    out = distinct_ids(a, ["g"], "id", "n")
    assert {r.g: r.n for r in out.collect()} == {0: 20_000, 1: 20_000}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "partial_bitmap_construct_agg" in plan
