"""Domain edge cases on hand-made tables: teammate rule, score parsing, sequence scope,
and the global lead operator against a single-window lead."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pitchframe.operators.sequence import next_event
from pitchframe.plans import passes, standings
from pitchframe.plans.params import Params
from pitchframe.sources.tables import EventData

P = Params(club=1, seasons=(2,), competitions=(9,), date_from="2000-01-01", as_of="2000-12-31",
           shot_seasons=(2,))


def _data(spark, **tables):
    frames = {k: spark.createDataFrame(rows, schema) for k, (rows, schema) in tables.items()}
    return EventData(builders={k: (lambda v=v: v) for k, v in frames.items()})


MATCHES = ([(1, 2, 9, "2000-05-01", "A-B"), (2, 2, 9, "2000-06-01", "B-A")],
           "MATCH_WYID long, SEASON_WYID long, COMPETITION_WYID long, DATE string, MATCHLABEL string")


def test_q03_teammate_rule(spark):
    # player 11 passes for team 1 only; player 12 passes only for team 2
    d = _data(
        spark,
        matches=MATCHES,
        passes=([(1, 10, 11, 12, 5.0, 1.0, 1.0, 1), (1, 20, 12, 11, 5.0, 1.0, 1.0, 1),
                 (1, 30, 13, 11, 5.0, 1.0, 1.0, 1)],
                "MATCH_WYID long, EVENT_WYID long, PLAYER_WYID long, RECIPIENT_WYID long, LENGTH double, "
                "ENDLOCATIONX double, ENDLOCATIONY double, ACCURATE int"),
        common=([(10, 1, 2, 1, "pass", 50.0, 50.0, 3), (20, 1, 2, 2, "pass", 50.0, 50.0, 4),
                 (30, 1, 2, 1, "pass", 50.0, 50.0, 5)],
                "EVENT_WYID long, MATCH_WYID long, SEASON_WYID long, TEAM_WYID long, PRIMARYTYPE string, "
                "LOCATIONX double, LOCATIONY double, MINUTE int"),
    )
    got = {r.EVENT_WYID: r.success for r in passes.scoped_passes(d, P).collect()}
    # event 10: recipient 12 never passed for team 1 -> not successful
    # event 20: recipient 11 never passed for team 2 -> not successful
    # event 30: recipient 11 passed for team 1 -> successful
    assert got == {10: False, 20: False, 30: True}


def test_q29_scores(spark):
    d = _data(
        spark,
        matches=([(1, 2, 9, "2000-05-01", "A"), (2, 2, 9, "2000-05-02", "B"), (3, 2, 9, "2000-05-03", "C"),
                  (4, 2, 9, "2000-05-04", "D")],
                 "MATCH_WYID long, SEASON_WYID long, COMPETITION_WYID long, DATE string, MATCHLABEL string"),
        match_teams=([(1, 100, "3-1"), (1, 200, "1-3"), (2, 100, ""), (2, 200, "0-0"),
                      (3, 100, None), (3, 200, "1-0"), (4, 100, "2"), (4, 200, "1-2")],
                     "MATCH_WYID long, TEAM_WYID long, SCORE string"),
    )
    got = {(r.MATCH_WYID, r.TEAM_WYID): (r.goals_for, r.goals_against)
           for r in standings.match_goals(d, P).collect()}
    # empty and null scores drop their row, so those matches keep no pair at all
    assert got == {(1, 100): (3, 1), (1, 200): (1, 3), (4, 100): (2, 1), (4, 200): (1, 2)}
    pts = {(r.MATCH_WYID, r.TEAM_WYID): r.points for r in standings.match_points(d, P).collect()}
    assert pts == {(1, 100): 3, (1, 200): 0, (4, 100): 3, (4, 200): 0}


def test_w1_boundary_global_vs_match_scope(spark):
    log = spark.createDataFrame(
        [(1, 1, 7, "shot"), (1, 2, 7, "pass"), (2, 3, 7, "shot"), (2, 4, 8, "pass")],
        "MATCH_WYID long, EVENT_WYID long, TEAM_WYID long, PRIMARYTYPE string")

    def pairs(scope):
        nx = next_event(log, ["MATCH_WYID", "EVENT_WYID"], ["TEAM_WYID", "PRIMARYTYPE"], scope=scope,
                        num_partitions=3)
        return nx.filter((F.col("PRIMARYTYPE") == "pass") & (F.col("next_PRIMARYTYPE") == "shot")
                         & (F.col("TEAM_WYID") == F.col("next_TEAM_WYID"))).count()

    assert pairs("global") == 1
    assert pairs("match") == 0


@pytest.mark.parametrize("n_parts,seed", [(1, 1), (3, 2), (8, 3), (17, 4)])
def test_next_event_equals_global_window(spark, n_parts, seed):
    rnd = random.Random(seed)
    rows = []
    for _ in range(400):
        m = rnd.choice([None] + list(range(6)) * 5)
        rows.append((m, rnd.randrange(60), rnd.choice([None, 1, 2]), rnd.choice(["pass", "shot", None])))
    log = spark.createDataFrame(rows, "MATCH_WYID long, EVENT_WYID long, TEAM_WYID long, PRIMARYTYPE string")
    order = ["MATCH_WYID", "EVENT_WYID", "TEAM_WYID", "PRIMARYTYPE"]
    w = Window.orderBy(*[F.col(c).asc_nulls_last() for c in order])
    expected = sorted(
        log.select(*order, F.lead("TEAM_WYID").over(w).alias("nt"), F.lead("PRIMARYTYPE").over(w).alias("np"))
        .collect(), key=str)
    got = next_event(log, ["MATCH_WYID", "EVENT_WYID"], ["TEAM_WYID", "PRIMARYTYPE"], num_partitions=n_parts)
    got = sorted(got.select(*order, F.col("next_TEAM_WYID").alias("nt"), F.col("next_PRIMARYTYPE").alias("np"))
                 .collect(), key=str)
    assert got == expected


@pytest.mark.parametrize("n_parts,seed", [(1, 5), (4, 6), (13, 7)])
def test_exact_median_matches_builtin(spark, n_parts, seed):
    from pitchframe.operators.quantile import exact_median

    rnd = random.Random(seed)
    rows = []
    for _ in range(700):
        grp = rnd.choice([None, "a", "b", "b", "b", "c"])  # "b" is the hot group
        rows.append((grp, rnd.choice([None, float(rnd.randrange(40)), rnd.random() * 10])))
    rows.append(("only_null", None))
    rows.append(("one", 3.5))
    df = spark.createDataFrame(rows, "g string, x double").repartition(n_parts)
    got = {r.g: r.m for r in exact_median(df, ["g"], "x", "m").collect()}
    want = {r.g: r.m for r in df.groupBy("g").agg(F.median("x").alias("m")).collect() if r.m is not None}
    assert set(got) == set(want)
    for k in want:
        assert abs(got[k] - want[k]) < 1e-9, k


def test_event_data_from_parquet(spark, tmp_path):
    from pitchframe.plans.catalog import TEST_PARAMS, event_data

    src = event_data(spark, "/root/testdata/sf0.001")
    for t in ("matches", "teams"):
        getattr(src, t).write.parquet(str(tmp_path / f"{t}.parquet"))
    d = EventData.from_parquet(spark, str(tmp_path))
    assert d.matches.count() == src.matches.count()
    assert passes.match_scope(d, TEST_PARAMS).count() == passes.match_scope(src, TEST_PARAMS).count()
