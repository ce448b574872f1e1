"""Shot-assist passes: length by team, assist vs other passes, lines, top assisters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.semantics import asc_last, count_true, desc_last, lenient_sum, ratio
from ..operators.bitmaps import flag_in_bitmap
from ..operators.exact import exact_mean
from ..operators.quantile import median_of_counts, value_counts
from ..operators.relational import (any_column_matches, first_by_key, semi_join,
                                    fraction_of_total, in_rank_order, stack_rows, top_k)
from ..sources.tables import EventData
from .params import Params
from .passes import _pass_facts, club_condition, league_passes, match_scope, pass_facts_key

PASS_COLUMNS = ["EVENT_WYID", "MATCH_WYID", "SEASON_WYID", "TEAM_WYID", "PLAYER_WYID",
                "RECIPIENT_WYID", "LENGTH"]


def assist_tags(d: EventData, p: Params) -> DataFrame:
    """Event ids (one per tag row) of in-scope passes tagged as shot assists (any SECONDARYTYPE
    column matches "shot_assist", case-insensitive) whose first tag is "assist"."""
    sec = d.secondary.join(match_scope(d, p), "MATCH_WYID", "left")
    tagged = (F.col("PRIMARYTYPE") == K.PASS_TYPE) \
        & any_column_matches(sec, r"^SECONDARYTYPE", "(?i)" + K.SHOT_ASSIST_PATTERN) \
        & F.col("SEASON_WYID").isin(*p.seasons)
    return sec.filter(tagged & (F.lower(F.col("SECONDARYTYPE1")) == K.ASSIST_TAG)).select("EVENT_WYID")


def assist_events(d: EventData, p: Params) -> DataFrame:
    """The distinct event ids of ``assist_tags``."""
    return assist_tags(d, p).distinct()


def marked_passes(d: EventData, p: Params) -> DataFrame:
    """League passes with ``is_assist`` (event id among the shot-assist events); ``prepare`` can store them
    (the club flag is added on read)."""
    def build() -> DataFrame:
        passes = _pass_facts(d, p).filter("in_league").drop("_early", "_late")
        return flag_in_bitmap(passes, assist_tags(d, p), "EVENT_WYID", "is_assist")

    return d.derived(("marked_passes", pass_facts_key(p)), build).withColumn("in_club", club_condition(p))


def shot_assists(d: EventData, p: Params) -> DataFrame:
    """Q36: league passes joined to their shot-assist tags: a row per pass and tag row
    (``dedup_assists`` gives each pass one row)."""
    if p.dedup_assists:
        return semi_join(league_passes(d, p), assist_events(d, p), ["EVENT_WYID"]).select(*PASS_COLUMNS)
    return league_passes(d, p).join(assist_tags(d, p), "EVENT_WYID").select(*PASS_COLUMNS)


def assist_length_by_team(d: EventData, p: Params) -> DataFrame:
    """Q37: mean assist length and number of assists per team, named, shortest first."""
    stats = shot_assists(d, p).groupBy("TEAM_WYID").agg(exact_mean("LENGTH").alias("mean_length"),
                                                         F.count(F.lit(1)).alias("n"))
    return stats.join(first_by_key(d.teams, ["TEAM_WYID"]), "TEAM_WYID", "left") \
        .select("TEAM_WYID", "TEAMNAME", "mean_length", "n") \
        .orderBy(asc_last("mean_length"), asc_last("TEAM_WYID"))


def assist_length_top3(d: EventData, p: Params, k: int = 3) -> DataFrame:
    """Q37: the k teams with the longest assists."""
    return top_k(assist_length_by_team(d, p), k, [desc_last("mean_length")], ["TEAM_WYID"])


def assist_length_bottom3(d: EventData, p: Params, k: int = 3) -> DataFrame:
    """Q37: the k teams with the shortest assists."""
    return top_k(assist_length_by_team(d, p), k, [asc_last("mean_length")], ["TEAM_WYID"])


def assist_length_overall(d: EventData, p: Params) -> DataFrame:
    """Q37: mean assist length over the league and over the club."""
    a = shot_assists(d, p)
    club = F.col("TEAM_WYID") == p.club
    agg = a.agg(exact_mean("LENGTH").alias("la"), F.count(F.lit(1)).alias("ln"),
                exact_mean("LENGTH", f"TEAM_WYID = {p.club}").alias("ca"), count_true(club).alias("cn"))
    return stack_rows(agg, [(F.lit("club"), F.col("ca"), F.col("cn")), (F.lit("league"), F.col("la"), F.col("ln"))],
                      ["scope", "mean_length", "n"])


def assist_vs_other_length(d: EventData, p: Params) -> DataFrame:
    """Q38: mean, exact median and count of pass length, assists vs other passes."""
    counts = value_counts(marked_passes(d, p), ["is_assist"], "LENGTH")  # all three come from these
    stats = counts.groupBy("is_assist").agg(exact_mean("_v", times="_c").alias("mean_length"), F.sum("_c").alias("n"))
    med = median_of_counts(counts, ["is_assist"], "median_length")
    return stats.join(med, "is_assist", "left").select("is_assist", "mean_length", "median_length", "n")


def assist_vs_other_length_club(d: EventData, p: Params) -> DataFrame:
    """Q38 (club): mean pass length, assists vs other passes, club passes only."""
    return marked_passes(d, p).filter(F.col("TEAM_WYID") == p.club) \
        .groupBy("is_assist").agg(exact_mean("LENGTH").alias("mean_length"))


def assist_length_gap(d: EventData, p: Params) -> DataFrame:
    """Q38: mean assist length minus mean length of other passes; league and club."""
    m = marked_passes(d, p)
    agg = m.agg(*[(exact_mean("LENGTH", f"is_assist AND {scope}") - exact_mean("LENGTH", f"NOT is_assist AND {scope}"))
                  .alias(name) for scope, name in (("true", "league"), (f"TEAM_WYID = {p.club}", "club"))])
    return stack_rows(agg, [(F.lit("club"), F.col("club")), (F.lit("league"), F.col("league"))],
                      ["scope", "difference"])


def player_line(d: EventData, p: Params) -> DataFrame:
    """Q39: role text -> line (defence / midfield / attack), unknown otherwise; a row per row of
    the player table, as in the original (``dedup_players`` takes each player's first row)."""
    pl = first_by_key(d.players, ["PLAYER_WYID"]) if p.dedup_players else d.players
    role = F.col("ROLENAME")
    line = None
    for pattern, label in K.LINE_RULES:
        cond = role.rlike("(?i)" + pattern)
        line = F.when(cond, label) if line is None else line.when(cond, label)
    return pl.select(F.col("PLAYER_WYID").alias("player_id"), role.alias("role"),
                     F.col("SHORTNAME").alias("shortname"), line.otherwise(K.UNKNOWN_LINE).alias("line"))


def _passes_with_line(d: EventData, p: Params) -> DataFrame:
    """Passes with the passer's line; a player standing in the table n times gives a pass n rows."""
    pl = player_line(d, p).select("player_id", "line")
    j = marked_passes(d, p).join(pl, F.col("PLAYER_WYID") == F.col("player_id"), "left")
    return j.filter(F.col("line").isNotNull() & (F.col("line") != K.UNKNOWN_LINE))


def assist_rate_by_line(d: EventData, p: Params) -> DataFrame:
    """Q40: passes, assists and assist rate per line; league and club."""
    j = _passes_with_line(d, p)
    scope = F.explode(F.array_compact(F.array(F.lit("league"),
                                              F.when(F.col("TEAM_WYID") == p.club, F.lit("club")))))
    return (j.select(scope.alias("scope"), "line", "is_assist")
            .groupBy("scope", "line")
            .agg(F.count(F.lit(1)).alias("total_passes"), count_true(F.col("is_assist")).alias("total_assist"))
            .withColumn("assist_rate", ratio(F.col("total_assist"), F.col("total_passes"))))


def assist_distribution(d: EventData, p: Params) -> DataFrame:
    """Q41: each line's share of all assists (a fraction, not a percentage)."""
    a = _passes_with_line(d, p).filter("is_assist").groupBy("line").agg(F.count(F.lit(1)).alias("assists"))
    return a.withColumn("share", fraction_of_total("assists"))


def _assist_totals(d: EventData, p: Params) -> DataFrame:
    in_scope = league_passes(d, p).select("MATCH_WYID").distinct()
    return (semi_join(d.player_stats, in_scope, ["MATCH_WYID"])
            .groupBy("PLAYER_WYID", "TEAM_WYID").agg(lenient_sum("PLAYERASSISTS").alias("assists")))


def _named(totals: DataFrame, players: DataFrame, teams: DataFrame) -> DataFrame:
    players = first_by_key(players, ["PLAYER_WYID"]).select("PLAYER_WYID", "SHORTNAME")
    teams = first_by_key(teams, ["TEAM_WYID"]).select("TEAM_WYID", F.col("TEAMNAME").alias("team"))
    return (totals.join(players, "PLAYER_WYID", "left").join(teams, "TEAM_WYID", "left")
            .select("PLAYER_WYID", "TEAM_WYID", "SHORTNAME", "team", "assists"))


def assist_totals(d: EventData, p: Params) -> DataFrame:
    """Q42: total assists of every (player, team) in the matches of the league pass set, named."""
    return _named(_assist_totals(d, p), d.players, d.teams)


def top_assist_players(d: EventData, p: Params, k: int = 10) -> DataFrame:
    """Q42: the k (player, team) pairs with the most assists, named; names are looked up, and made
    unique, for those rows only."""
    best = top_k(_assist_totals(d, p), k, [desc_last("assists")], ["PLAYER_WYID", "TEAM_WYID"])
    named = _named(best, semi_join(d.players, best, ["PLAYER_WYID"]), semi_join(d.teams, best, ["TEAM_WYID"]))
    return in_rank_order(named, [desc_last("assists")], ["PLAYER_WYID", "TEAM_WYID"])
