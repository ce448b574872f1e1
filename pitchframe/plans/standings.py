"""Match results and standings; passing of top vs bottom teams; late-game passing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.semantics import (asc_last, desc_last, if_else, lenient_sum, mean_flag, n_distinct, pct,
                                   ratio, strict_sum)
from ..operators.exact import exact_mean
from ..operators.relational import first_by_key, share_of_group, split_typed
from ..sources.tables import EventData
from .params import Params
from .passes import _pass_facts, league_passes


def match_overview(d: EventData, p: Params) -> DataFrame:
    """Q28: every match row."""
    return d.matches


def match_goals(d: EventData, p: Params) -> DataFrame:
    """Q29: goals for and against per (match, team) in scope.

    The score text is "for-against"; goals against are taken from the other teams' rows of
    the same match (the original's self-join, every row of the result table; ``dedup_scores``
    keeps the first row per match and team). Rows with a null or empty score are dropped;
    pieces that are missing or not numbers are null. The scope is applied first, so only
    rows of matches in scope are shuffled."""
    return d.derived(("match_goals", p.competitions, p.seasons, p.dedup_scores), lambda: _match_goals(d, p))


def _match_goals(d: EventData, p: Params) -> DataFrame:
    m = d.matches.filter(F.col("COMPETITION_WYID").isin(*p.competitions) & F.col("SEASON_WYID").isin(*p.seasons)) \
        .select("MATCH_WYID", "SEASON_WYID")
    side = (d.match_teams.filter(F.col("SCORE").isNotNull() & (F.col("SCORE") != "")).join(m, "MATCH_WYID")
            .select("MATCH_WYID", "TEAM_WYID", split_typed("SCORE", "-", ["goals_for", "goals_against"])[0],
                    "SEASON_WYID"))
    if p.dedup_scores:
        side = first_by_key(side, ["MATCH_WYID", "TEAM_WYID"])
    opp = side.select("MATCH_WYID", F.col("TEAM_WYID").alias("_opp"), F.col("goals_for").alias("goals_against"))
    return (side.join(opp, "MATCH_WYID")
            .filter(F.col("TEAM_WYID") != F.col("_opp"))
            .select("MATCH_WYID", "TEAM_WYID", "goals_for", "goals_against", "SEASON_WYID"))


def match_points(d: EventData, p: Params) -> DataFrame:
    """Q30: 3 for a win, 1 for a draw, otherwise (including unknown) 0."""
    gf, ga = F.col("goals_for"), F.col("goals_against")
    return match_goals(d, p).withColumn(
        "points", F.when(gf > ga, 3).when(gf == ga, 1).otherwise(0))


def standings(d: EventData, p: Params) -> DataFrame:
    """Q31: per season and team: points, goals, difference, rank (row number), in table order."""
    return _ranked(d, p).orderBy(asc_last("SEASON_WYID"), "rank")


def _ranked(d: EventData, p: Params) -> DataFrame:
    t = (match_points(d, p).groupBy("SEASON_WYID", "TEAM_WYID")
         .agg(strict_sum("points").alias("points"), strict_sum("goals_for").alias("goals_for"),
              strict_sum("goals_against").alias("goals_against"))
         .withColumn("goal_diff", F.col("goals_for") - F.col("goals_against")))
    w = Window.partitionBy("SEASON_WYID").orderBy(desc_last("points"), desc_last("goal_diff"),
                                                  desc_last("goals_for"), asc_last("TEAM_WYID"))
    return t.withColumn("rank", F.row_number().over(w))


def top_bottom_groups(d: EventData, p: Params) -> DataFrame:
    """Q32: rank <= 5 is the top group, every other team is the bottom group."""
    return _ranked(d, p).withColumn(
        "group_label", if_else(F.col("rank") <= K.TOP_GROUP_RANK, K.TOP_GROUP_LABEL, K.BOTTOM_GROUP_LABEL))


def passes_top_vs_bottom(d: EventData, p: Params) -> DataFrame:
    """Q33: passes, passes per match, mean length and success rate by season and group."""
    tb = top_bottom_groups(d, p).select("TEAM_WYID", "SEASON_WYID", "group_label")
    j = league_passes(d, p).join(tb, ["TEAM_WYID", "SEASON_WYID"], "left")
    return (j.groupBy("SEASON_WYID", "group_label")
            .agg(F.count(F.lit(1)).alias("total_passes"), n_distinct("MATCH_WYID").alias("_matches"),
                 exact_mean("LENGTH").alias("avg_length"), (mean_flag(F.col("success")) * 100).alias("success_rate"))
            .withColumn("avg_passes_per_match", ratio(F.col("total_passes"), F.col("_matches")))
            .select("SEASON_WYID", "group_label", "total_passes", "avg_passes_per_match", "avg_length",
                    "success_rate"))


def late_game_passes(d: EventData, p: Params) -> DataFrame:
    """Q34: passes and successful passes by season and period (minute >= 80 is late).

    The original joins every common row of the event, so a pass counts once per row with a minute;
    these rows were counted per event when the first one was taken, so nothing is joined here.
    ``dedup_minutes`` counts the first row's minute alone."""
    s = _pass_facts(d, p).filter("in_league")
    if p.dedup_minutes:
        late = F.col("MINUTE") >= K.LATE_MINUTE
        early, late = [F.coalesce(c, F.lit(False)).cast("bigint") for c in (~late, late)]
    else:
        early, late = F.col("_early"), F.col("_late")
    rows = F.array(*[F.struct(F.lit(label).alias("period"), n.alias("n"))
                     for label, n in ((K.EARLY_PERIOD_LABEL, early), (K.LATE_PERIOD_LABEL, late))])
    s = s.select("SEASON_WYID", "success", F.inline(rows)).filter(F.col("n") > 0)
    return (s.groupBy("SEASON_WYID", "period")
            .agg(F.sum("n").alias("total_passes"),
                 lenient_sum(F.when(F.col("success"), F.col("n"))).alias("success_passes"))
            .withColumn("success_rate", pct(F.col("success_passes"), F.col("total_passes"))))


def late_game_share(d: EventData, p: Params) -> DataFrame:
    """Q35: each period's share of the season's passes."""
    return late_game_passes(d, p).select("SEASON_WYID", "period", "total_passes") \
        .withColumn("share_pct", share_of_group("total_passes", ["SEASON_WYID"]))


def late_game_success_share(d: EventData, p: Params) -> DataFrame:
    """Q35: each period's share of the season's successful passes."""
    return late_game_passes(d, p).select("SEASON_WYID", "period", "success_passes") \
        .withColumn("success_pct", share_of_group("success_passes", ["SEASON_WYID"]))
