"""The scope switches of Params change results in the expected direction."""

import dataclasses
import os

from pyspark.sql import functions as F

from pitchframe.plans import assists, match_views, passes, standings
from pitchframe.plans.catalog import TEST_PARAMS, event_data, prepare, release

SF = "/root/testdata/sf0.01"


def _by(df, key, val):
    return {getattr(r, key): getattr(r, val) for r in df.collect()}


def test_club_set_without_type_filter_is_larger(spark):
    d = event_data(spark, SF)
    untyped = _by(passes.pass_outcome_share(d, TEST_PARAMS).filter("outcome = 'successful'"), "scope", "total")
    typed = _by(passes.pass_outcome_share(d, dataclasses.replace(TEST_PARAMS, club_pass_types=("pass",)))
                .filter("outcome = 'successful'"), "scope", "total")
    assert untyped["league"] == typed["league"]
    assert untyped["club"] > typed["club"]


def test_minutes_without_dedup_multiply_duplicated_events(spark):
    d = event_data(spark, SF)
    every = sum(_by(standings.late_game_passes(d, TEST_PARAMS), "period", "total_passes").values())
    one = sum(_by(standings.late_game_passes(d, dataclasses.replace(TEST_PARAMS, dedup_minutes=True)),
                  "period", "total_passes").values())
    assert every > one


def test_teamless_passes_are_kept(spark):
    d = event_data(spark, SF)
    total = passes.valid_passes(d, TEST_PARAMS).count()
    shares = passes.pass_outcome_share(d, TEST_PARAMS).filter("scope = 'league'").collect()
    assert {r.total for r in shares} == {total}
    teams = passes.team_pass_success(d, TEST_PARAMS).collect()
    assert sum(r.total for r in teams) == total and [r for r in teams if r.TEAM_WYID is None][0].success == 0


def test_rows_multiply_as_in_the_original_join(spark):
    d = event_data(spark, SF)
    once = dataclasses.replace(TEST_PARAMS, dedup_assists=True, dedup_scores=True)
    assert assists.shot_assists(d, TEST_PARAMS).count() > assists.shot_assists(d, once).count()
    assert standings.match_goals(d, TEST_PARAMS).count() > standings.match_goals(d, once).count()


def test_sequence_scope_match_drops_cross_match_pairs(spark):
    d = event_data(spark, SF)
    glob = _by(passes.passes_leading_to_shot(d, TEST_PARAMS), "scope", "passes_to_shots")
    match = _by(passes.passes_leading_to_shot(d, dataclasses.replace(TEST_PARAMS, sequence_scope="match")),
                "scope", "passes_to_shots")
    assert match["league"] <= glob["league"] and match["club"] <= glob["club"]


def test_match_filter(spark):
    d = event_data(spark, SF)
    some = match_views.match_shots(d, TEST_PARAMS).select("MATCH_WYID").first().MATCH_WYID
    one = match_views.match_shots(d, dataclasses.replace(TEST_PARAMS, match_id=some))
    assert one.count() > 0 and one.filter(F.col("MATCH_WYID") != some).count() == 0


def test_stored_tables_serve_every_club_and_are_deleted(spark):
    d = prepare(spark, SF)
    assert event_data(spark, SF) is d
    before, paths = len(d._derived), [p.removeprefix("file:") for p in d._paths]
    assert before == len(paths) > 0 and all(os.path.isdir(p) for p in paths)
    other = dataclasses.replace(TEST_PARAMS, club=2)
    a = _by(passes.pass_outcome_share(d, TEST_PARAMS).filter("outcome = 'successful'"), "scope", "total")
    b = _by(passes.pass_outcome_share(d, other).filter("outcome = 'successful'"), "scope", "total")
    assert len(d._derived) == before  # nothing rebuilt for another club
    assert a["league"] == b["league"] and a["club"] != b["club"]
    release(spark, SF)
    assert not any(os.path.exists(p) for p in paths) and event_data(spark, SF) is not d
