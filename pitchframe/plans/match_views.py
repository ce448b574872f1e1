"""Per-player and per-match views behind the dashboards: top scorers vs xG, club
matches, pass outcomes per match and team, match list with goals, shots of a match.

The dashboards evaluate one match at a time; here every match is computed in one job
and ``Params.match_id`` narrows the result when set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.semantics import asc_last, desc_last, if_else, lenient_sum, paste0
from ..operators.exact import exact_sum
from ..operators.relational import first_by_key, in_rank_order, semi_join, share_of_group, top_k
from ..sources.tables import EventData
from .params import Params
from .passes import league_passes
from .shots import goal_flag, shots_geo
from .standings import match_goals


def _one_match(df: DataFrame, p: Params) -> DataFrame:
    return df if p.match_id is None else df.filter(F.col("MATCH_WYID") == p.match_id)


def _player_totals(d: EventData, p: Params) -> DataFrame:
    return goal_flag(d, p).groupBy("PLAYER_WYID").agg(lenient_sum("total_goal").alias("goals"),
                                                       F.coalesce(exact_sum("SHOTXG"), F.lit(0.0)).alias("xg"))


def _with_player_names(totals: DataFrame, players: DataFrame) -> DataFrame:
    names = first_by_key(players, ["PLAYER_WYID"]).select("PLAYER_WYID", F.col("SHORTNAME").alias("player_name"))
    return totals.join(names, "PLAYER_WYID", "left").select("PLAYER_WYID", "player_name", "goals", "xg")


def all_scorers_xg(d: EventData, p: Params) -> DataFrame:
    """Q43: goals and summed xG of every player over open-play shots, most goals first."""
    return _with_player_names(_player_totals(d, p), d.players).orderBy(desc_last("goals"), asc_last("PLAYER_WYID"))


def top_scorers_xg(d: EventData, p: Params) -> DataFrame:
    """Q43: the ``top_n`` players by goals; names are looked up, and made unique, for those only."""
    best = top_k(_player_totals(d, p), p.top_n, [desc_last("goals")], ["PLAYER_WYID"])
    return in_rank_order(_with_player_names(best, semi_join(d.players, best, ["PLAYER_WYID"])),
                         [desc_last("goals")], ["PLAYER_WYID"])


def _club_match_ids(d: EventData, p: Params) -> DataFrame:
    return match_goals(d, p).filter(F.col("TEAM_WYID") == p.club).select("MATCH_WYID", "SEASON_WYID").distinct()


def club_matches(d: EventData, p: Params) -> DataFrame:
    """Q44: matches the club played (from the results table), with their labels, by label."""
    return semi_join(d.matches, _club_match_ids(d, p), ["MATCH_WYID"]) \
        .select("MATCH_WYID", "MATCHLABEL").distinct().orderBy(asc_last("MATCHLABEL"), asc_last("MATCH_WYID"))


def match_pass_outcomes(d: EventData, p: Params) -> DataFrame:
    """Q45: hit / miss pass counts per club match and team, percent within the team,
    and whether the team is the club."""
    m = league_passes(d, p).withColumn(
        "outcome", if_else(F.col("success"), K.PASS_HIT_LABEL, K.PASS_MISS_LABEL))
    m = _one_match(semi_join(m, _club_match_ids(d, p), ["MATCH_WYID"]), p)
    counts = (m.groupBy("MATCH_WYID", "TEAM_WYID", "outcome").agg(F.count(F.lit(1)).alias("n"))
              .join(first_by_key(d.teams, ["TEAM_WYID"]), "TEAM_WYID", "left"))
    return (counts.withColumn("pct", share_of_group("n", ["MATCH_WYID", "TEAMNAME"]))
            .withColumn("is_fcn", if_else(F.col("TEAM_WYID") == p.club, K.CLUB_SIDE_LABEL, K.OPPONENT_SIDE_LABEL))
            .select("MATCH_WYID", "TEAM_WYID", "TEAMNAME", "outcome", "n", "pct", "is_fcn"))


def shots_plotdata(d: EventData, p: Params) -> DataFrame:
    """Located open-play shots with team name and goal label (the shot-map input)."""
    s = shots_geo(d, p).join(first_by_key(d.teams, ["TEAM_WYID"]), "TEAM_WYID", "left")
    return s.select("MATCH_WYID", "EVENT_WYID", "TEAM_WYID", "TEAMNAME",
                    F.col("LOCATIONX").alias("x"), F.col("LOCATIONY").alias("y"),
                    if_else(F.col("total_goal") == 1, K.GOAL_LABEL, K.NO_GOAL_LABEL).alias("is_goal"))


def match_list_with_goals(d: EventData, p: Params) -> DataFrame:
    """Q46: matches of the chosen seasons with goals counted from the shot map (0 if
    none) and a "label (season)" text, by that text."""
    goals = shots_geo(d, p).filter(F.col("total_goal") == 1) \
        .groupBy("MATCH_WYID").agg(F.count(F.lit(1)).alias("_goals"))
    m = d.matches.filter(F.col("SEASON_WYID").isin(*p.seasons)).join(goals, "MATCH_WYID", "left")
    return (m.withColumn("goals_in_shots", F.coalesce(F.col("_goals"), F.lit(0).cast("bigint")))
            .withColumn("label_with_season", paste0(F.col("MATCHLABEL"), " (", F.col("SEASON_WYID"), ")"))
            .drop("_goals").orderBy("label_with_season", asc_last("MATCH_WYID")))


def match_shots(d: EventData, p: Params) -> DataFrame:
    """Q47: located shots of a match (every match when ``match_id`` is not set)."""
    return _one_match(shots_plotdata(d, p), p)
