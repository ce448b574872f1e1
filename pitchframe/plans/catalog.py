"""Registry of the named analytics and how they run on the generated test tables."""

from __future__ import annotations

import dataclasses
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .. import constants as K
from ..sources import sql_functions, testdata
from ..sources.tables import EventData
from . import assists, match_views, passes, shots, standings
from .params import Params

# Parameters that fit the test tables: team ids there are small integers and match
# dates fall in 1995-2001, so the club, the date window and "today" are fixed here.
TEST_PARAMS = Params(club=1, seasons=(191611, 189918), competitions=(335, 328),
                     date_from="1996-07-19", as_of="2001-12-31", shot_competition=335,
                     shot_seasons=(189918, 191611), top_n=10)

#: Matches of the test tables, at every scale factor: one with located shots, one of the club with passes.
SHOT_MATCH, CLUB_MATCH = 10, 373


def _with(analytic: Callable[[EventData, Params], DataFrame], **changes) -> Callable[[EventData, Params], DataFrame]:
    """``analytic`` with some parameters fixed."""
    return lambda d, p: analytic(d, dataclasses.replace(p, **changes))


def _by_sql(name: str, *arguments: str) -> Callable[[EventData, Params], DataFrame]:
    """The table function ``name`` called from SQL text with these parameters bound."""
    def analytic(d: EventData, p: Params) -> DataFrame:
        spark = d.matches.sparkSession
        sql_functions.register(spark, d)
        return sql_functions.call(spark, sql_functions.PREFIX + name, **{a: getattr(p, a) for a in arguments})
    return analytic


ANALYTICS: dict[str, Callable[[EventData, Params], DataFrame]] = {
    "match_scope": passes.match_scope,
    "pass_enrichment": passes.pass_enrichment,
    "successful_passes": passes.successful_passes,
    "valid_passes": passes.valid_passes,
    "valid_passes_club": passes.valid_passes_club,
    "pass_outcome_share": passes.pass_outcome_share,
    "pass_length_by_scope": passes.pass_length_by_scope,
    "pass_zone_frequency": passes.pass_zone_frequency,
    "top_pass_zones": passes.top_pass_zones,
    "passes_leading_to_shot": passes.passes_leading_to_shot,
    "team_pass_success": passes.team_pass_success,
    "bottom3_pass_success": passes.bottom3_pass_success,
    "top3_pass_success": passes.top3_pass_success,
    "last_third_summary": passes.last_third_summary,
    "last_third_by_team": passes.last_third_by_team,
    "last_third_all_teams": passes.last_third_all_teams,
    "accuracy_flag_success": passes.accuracy_flag_success,
    "shots_by_season": shots.shots_by_season,
    "shot_exclusion_audit": shots.shot_exclusion_audit,
    "goal_flag": shots.goal_flag,
    "goal_share": shots.goal_share,
    "shot_coordinates": shots.shot_coordinates,
    "shot_distance_mean": shots.shot_distance_mean,
    "shot_angle_mean": shots.shot_angle_mean,
    "xg_on_target": shots.xg_on_target,
    "conversion_by_distance": shots.conversion_by_distance,
    "conversion_by_angle": shots.conversion_by_angle,
    "conversion_by_xg": shots.conversion_by_xg,
    "conversion_by_minute": shots.conversion_by_minute,
    "shot_precision": shots.shot_precision,
    "match_overview": standings.match_overview,
    "match_goals": standings.match_goals,
    "match_points": standings.match_points,
    "standings": standings.standings,
    "top_bottom_groups": standings.top_bottom_groups,
    "passes_top_vs_bottom": standings.passes_top_vs_bottom,
    "late_game_passes": standings.late_game_passes,
    "late_game_share": standings.late_game_share,
    "late_game_success_share": standings.late_game_success_share,
    "shot_assists": assists.shot_assists,
    "assist_length_by_team": assists.assist_length_by_team,
    "assist_length_top3": assists.assist_length_top3,
    "assist_length_bottom3": assists.assist_length_bottom3,
    "assist_length_overall": assists.assist_length_overall,
    "assist_vs_other_length": assists.assist_vs_other_length,
    "assist_vs_other_length_club": assists.assist_vs_other_length_club,
    "assist_length_gap": assists.assist_length_gap,
    "player_line": assists.player_line,
    "assist_rate_by_line": assists.assist_rate_by_line,
    "assist_distribution": assists.assist_distribution,
    "top_assist_players": assists.top_assist_players,
    "assist_totals": assists.assist_totals,
    "top_scorers_xg": match_views.top_scorers_xg,
    "all_scorers_xg": match_views.all_scorers_xg,
    "club_matches": match_views.club_matches,
    "match_pass_outcomes": match_views.match_pass_outcomes,
    "match_list_with_goals": match_views.match_list_with_goals,
    "match_shots": match_views.match_shots,
    # the cleaned forms of rules that the original does not have
    "pass_outcome_share_typed_club": _with(passes.pass_outcome_share, club_pass_types=(K.PASS_TYPE,)),
    "late_game_passes_one_minute": _with(standings.late_game_passes, dedup_minutes=True),
    "shot_assists_once": _with(assists.shot_assists, dedup_assists=True),
    "match_goals_one_row": _with(standings.match_goals, dedup_scores=True),
    "player_line_one_row": _with(assists.player_line, dedup_players=True),
    "assist_rate_by_line_one_row": _with(assists.assist_rate_by_line, dedup_players=True),
    # one match, as the dashboards ask for it
    "match_shots_of_one": _with(match_views.match_shots, match_id=SHOT_MATCH),
    # analytics called as table functions of SQL text
    "sql_match_goals": _by_sql("match_goals", "competitions", "seasons"),
    "sql_standings": _by_sql("standings", "competitions", "seasons"),
    "sql_club_matches": _by_sql("club_matches", "club", "competitions", "seasons"),
    "match_pass_outcomes_of_one": _with(match_views.match_pass_outcomes, match_id=CLUB_MATCH),
}


#: Results of library functions (arc tangent) whose last bit differs between engines. Every other
#: double is exact or takes the same IEEE steps anywhere.
LIBRARY_COLUMNS = ("mean_angle_m",)


def round_doubles(df: DataFrame, columns: tuple[str, ...] = LIBRARY_COLUMNS, scale: int = 6) -> DataFrame:
    """Round the double columns named in ``columns``.

    Computed as ``round(x * 10^scale) / 10^scale`` (half away from zero on the scaled
    double), the same steps DuckDB's ``round(x, scale)`` takes, so equal inputs round
    equally even when the exact value sits on a rounding boundary."""
    m = float(10 ** scale)
    return df.select(*[(F.round(F.col(f.name) * F.lit(m), 0) / F.lit(m)).alias(f.name)
                       if f.name in columns and isinstance(f.dataType, DoubleType) else F.col(f.name)
                       for f in df.schema.fields])


_PREPARED: dict[tuple, EventData] = {}


def event_data(spark: SparkSession, root: str) -> EventData:
    """The test tables of ``root`` as domain tables: those of ``prepare`` while it holds, else read anew."""
    return _PREPARED.get((spark.sparkContext.applicationId, root)) or testdata.load(spark, root)


def run(name: str, spark: SparkSession, root: str, params: Params = TEST_PARAMS) -> DataFrame:
    """Analytic ``name`` over the test tables in ``root``; building it starts no job of its own."""
    return round_doubles(ANALYTICS[name](event_data(spark, root), params))


def prepare(spark: SparkSession, root: str, params: Params = TEST_PARAMS) -> EventData:
    """Store the tables that many analytics share (enriched, flagged and assist-marked passes, the ranged log, shots
    with geometry, match results) in the shared folder; ``release`` on the returned tables deletes them again."""
    d = testdata.load(spark, root)
    with d.storing():
        passes.pass_enrichment(d, params)
        passes.scoped_passes(d, params)
        passes.passes_leading_to_shot(d, params)
        assists.marked_passes(d, params)
        shots.shots_geo(d, params)
        standings.match_goals(d, params)
    _PREPARED[(spark.sparkContext.applicationId, root)] = d
    return d


def release(spark: SparkSession, root: str) -> None:
    """Delete what ``prepare`` stored; later runs read the tables anew."""
    d = _PREPARED.pop((spark.sparkContext.applicationId, root), None)
    if d is not None:
        d.release()


def runner(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, root: run(name, spark, root)
