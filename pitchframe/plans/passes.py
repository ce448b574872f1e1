"""Pass analytics: scope, success, length, zones, sequences, team rankings, last third."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.binning import zone
from ..functions.semantics import asc_last, count_true, desc_last, in_set, paste0, pct
from ..operators.bitmaps import flag_in_bitmap
from ..operators.exact import exact_mean
from ..operators.relational import (first_by_key, first_row, flag_in, share_of_group, stack_rows, top_k,
                                    top_k_per_group)
from ..operators.sequence import log_ranges, successors
from ..sources.tables import EventData, in_list_params, sql_query
from .params import Params

EVENT_COLUMNS = ["EVENT_WYID", "TEAM_WYID", "PRIMARYTYPE", "LOCATIONX", "LOCATIONY", "MINUTE"]


def match_scope(d: EventData, p: Params) -> DataFrame:
    """Q01: matches of the chosen competitions played between ``date_from`` and ``as_of``
    (today when not given). Written as parameterised SQL text, as the original sends it."""
    comps, args = in_list_params("comp", list(p.competitions))
    args["date_from"] = p.date_from
    upper = "CURRENT_DATE()" if p.as_of is None else "CAST(:as_of AS DATE)"
    if p.as_of is not None:
        args["as_of"] = p.as_of
    return sql_query(d.matches.sparkSession, f"""
        SELECT MATCH_WYID, SEASON_WYID
        FROM {{matches}}
        WHERE COMPETITION_WYID IN {comps}
          AND CAST(`DATE` AS DATE) BETWEEN CAST(:date_from AS DATE) AND {upper}""",
                     {"matches": d.matches}, args)


def first_event_rows(d: EventData) -> DataFrame:
    """One common-table row per event: the first in (every other column ascending, nulls last),
    over the whole table, whatever match a row names. The same aggregate counts the event's rows
    with a minute before (``_early``) and from ``LATE_MINUTE`` on (``_late``)."""
    rest = [c for c in d.common.columns if c != "EVENT_WYID"]
    late = F.col("MINUTE") >= K.LATE_MINUTE
    rows = d.common.groupBy("EVENT_WYID").agg(first_row(d.common, rest).alias("_first"),
                                              count_true(~late).alias("_early"), count_true(late).alias("_late"))
    return rows.select("EVENT_WYID", *[F.col("_first")[c].alias(c) for c in EVENT_COLUMNS[1:]], "_early", "_late")


def _enriched(d: EventData, p: Params) -> DataFrame:
    """``pass_enrichment`` with the minute counts of each event: every table is read once.
    Most analytics start from it, so ``prepare`` can store it; bucketed tables hold the event join."""
    def build() -> DataFrame:
        if d.with_passes is not None:
            return d.with_passes(match_scope(d, p))
        return match_scope(d, p).join(d.passes, "MATCH_WYID", "left").join(first_event_rows(d), "EVENT_WYID", "left")

    return d.derived(("enriched", _scope_key(p)), build).select(
        "EVENT_WYID", "MATCH_WYID", "SEASON_WYID", *[c for c in d.passes.columns if c not in ("EVENT_WYID", "MATCH_WYID")],
        *EVENT_COLUMNS[1:], "_early", "_late")


def pass_enrichment(d: EventData, p: Params) -> DataFrame:
    """Q02: in-scope matches, their passes, and the first common row of each pass event.

    Both joins are left joins, as in the original."""
    return _enriched(d, p).drop("_early", "_late")


def _passers(pe: DataFrame) -> DataFrame:
    """Distinct (team, player) pairs: who passed for which team anywhere in scope."""
    return (pe.filter(F.col("TEAM_WYID").isNotNull())
            .select(F.col("TEAM_WYID").alias("_team"), F.col("PLAYER_WYID").alias("_passer")).distinct())


def _valid(p: Params) -> Column:
    """A row filter, so plain predicates that reach the scan (a null drops the row)."""
    return (F.col("SEASON_WYID").isin(*p.seasons) & (F.col("PLAYER_WYID") != 0) & (F.col("RECIPIENT_WYID") != 0))


def _pass_rows() -> Column:
    """The pass type as a row filter."""
    return F.col("PRIMARYTYPE") == K.PASS_TYPE


def _is_pass() -> Column:
    """The pass type as a flag (never null)."""
    return F.coalesce(F.col("PRIMARYTYPE") == K.PASS_TYPE, F.lit(False))


def club_condition(p: Params) -> Column:
    c = F.coalesce(F.col("TEAM_WYID") == F.lit(p.club), F.lit(False))
    if p.club_pass_types is not None:
        c = c & in_set("PRIMARYTYPE", p.club_pass_types)
    return c


def successful_passes(d: EventData, p: Params) -> DataFrame:
    """Q03: valid passes whose recipient passed for the same team somewhere in scope."""
    pe = pass_enrichment(d, p)
    ok = pe.join(_passers(pe), (F.col("TEAM_WYID") == F.col("_team"))
                 & (F.col("RECIPIENT_WYID") == F.col("_passer")), "left_semi")
    return ok.filter(_valid(p) & _pass_rows())


def _scope_key(p: Params) -> tuple:
    """The parameters that decide which matches are in scope."""
    return (p.competitions, p.date_from, p.as_of)


def pass_facts_key(p: Params) -> tuple:
    """The parameters the flagged pass facts depend on (not the club)."""
    return (*_scope_key(p), p.seasons)


def _pass_facts(d: EventData, p: Params) -> DataFrame:
    """Flagged pass rows without the club flag (rows without a team are kept: they are passes
    of an unknown team and never successful)."""
    def build() -> DataFrame:
        pe = _enriched(d, p)
        rows = pe.filter(_valid(p))
        rows = flag_in(rows, _passers(pe), [("TEAM_WYID", "_team"), ("RECIPIENT_WYID", "_passer")], "_hit")
        rows = rows.withColumn("success_row", F.col("_hit") & _is_pass()).drop("_hit")
        rows = flag_in_bitmap(rows, rows.filter("success_row"), "EVENT_WYID", "success")
        return rows.withColumn("in_league", _is_pass())

    return d.derived(("pass_facts", pass_facts_key(p)), build)


def scoped_passes(d: EventData, p: Params) -> DataFrame:
    """Every in-season pass-event row with a known passer and recipient, flagged:

    in_league    the league pass set (type is pass)
    in_club      the club pass set (team is the club; type filter per ``club_pass_types``)
    success_row  this row is a successful pass (recipient passed for the same team)
    success      the row's event id is among the successful passes' event ids

    The success flags need two passes over the enriched passes (the passer set, then the
    rows). Most analytics share the result, so ``prepare`` can store it; the club flag is a
    column added on read, so another club reuses the same table.
    """
    return _pass_facts(d, p).drop("_early", "_late").withColumn("in_club", club_condition(p))


def league_passes(d: EventData, p: Params) -> DataFrame:
    return scoped_passes(d, p).filter("in_league")


def valid_passes(d: EventData, p: Params) -> DataFrame:
    """Q04: the league pass set (season, pass type, known passer and recipient)."""
    return pass_enrichment(d, p).filter(_valid(p) & _pass_rows())


def valid_passes_club(d: EventData, p: Params) -> DataFrame:
    """Q04: the club pass set (season, team, known passer and recipient; no type filter)."""
    rows = pass_enrichment(d, p).filter(_valid(p) & (F.col("TEAM_WYID") == p.club))
    return rows if p.club_pass_types is None else rows.filter(F.col("PRIMARYTYPE").isin(*p.club_pass_types))


def _scope_label() -> Column:
    """'league' and/or 'club' for a row (a club row outside the league set is club only)."""
    return F.explode(F.array_compact(F.array(F.when(F.col("in_league"), F.lit("league")),
                                             F.when(F.col("in_club"), F.lit("club")))))


def pass_outcome_share(d: EventData, p: Params) -> DataFrame:
    """Q05: successful / unsuccessful counts and percentages, club and league."""
    s = scoped_passes(d, p)
    club_success = F.col("success_row") & (F.col("TEAM_WYID") == p.club)
    agg = s.agg(count_true(F.col("in_league")).alias("lt"), count_true(F.col("success_row")).alias("ls"),
                count_true(F.col("in_club")).alias("ct"), count_true(club_success).alias("cs"))
    rows = []
    for scope, tot, suc in (("club", "ct", "cs"), ("league", "lt", "ls")):
        t, s_ = F.col(tot), F.col(suc)
        rows.append((F.lit(scope), F.lit("successful"), s_, pct(s_, t), t))
        rows.append((F.lit(scope), F.lit("unsuccessful"), t - s_, pct(t - s_, t), t))
    return stack_rows(agg, rows, ["scope", "outcome", "n", "pct", "total"])


def pass_length_by_scope(d: EventData, p: Params) -> DataFrame:
    """Q06: mean pass length for league / club x all / successful passes."""
    s = scoped_passes(d, p)
    club_success = F.col("success_row") & (F.col("TEAM_WYID") == p.club)
    s = s.withColumn("club_success", club_success)
    agg = s.agg(*[exact_mean("LENGTH", where).alias(name) for where, name in
                  (("in_league", "la"), ("success_row", "ls"), ("in_club", "ca"), ("club_success", "cs"))])
    rows = [(F.lit("league"), F.lit("all"), F.col("la")), (F.lit("league"), F.lit("successful"), F.col("ls")),
            (F.lit("club"), F.lit("all"), F.col("ca")), (F.lit("club"), F.lit("successful"), F.col("cs"))]
    return stack_rows(agg, rows, ["scope", "pass_set", "avg_length"])


def _zones(s: DataFrame) -> DataFrame:
    return s.select(_scope_label().alias("scope"),
                    zone("ENDLOCATIONX", K.ZONE_STEP).alias("zone_x"),
                    zone("ENDLOCATIONY", K.ZONE_STEP).alias("zone_y"))


def pass_zone_frequency(d: EventData, p: Params) -> DataFrame:
    """Q07: end-zone text "x-y" and its pass count (most frequent first), league and club."""
    z = _zones(scoped_passes(d, p)).select("scope", paste0(F.col("zone_x"), "-", F.col("zone_y")).alias("zone"))
    return z.groupBy("scope", "zone").agg(F.count(F.lit(1)).alias("n")).orderBy("scope", desc_last("n"), "zone")


def top_pass_zones(d: EventData, p: Params, k: int = 3) -> DataFrame:
    """Q08: the k busiest end zones per scope with their share of all the scope's passes."""
    counts = _zones(scoped_passes(d, p)).groupBy("scope", "zone_x", "zone_y").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("pct", share_of_group("n", ["scope"]))
    return top_k_per_group(counts, ["scope"], k, [desc_last("n")], ["zone_x", "zone_y"])


LOG_ORDER, LOG_CARRY = ["MATCH_WYID", "EVENT_WYID"], ["TEAM_WYID", "PRIMARYTYPE"]


def _log_ranges(d: EventData, p: Params) -> DataFrame:
    """The ordered log of the chosen seasons in ranges (``prepare`` can store them)."""
    log = d.event_log.filter(F.col("SEASON_WYID").isin(*p.seasons)).select(*LOG_ORDER, *LOG_CARRY)
    return d.derived(("log_ranges", p.seasons), lambda: log_ranges(log, LOG_ORDER, LOG_CARRY))


def passes_leading_to_shot(d: EventData, p: Params) -> DataFrame:
    """Q09: passes whose next event in the log is a shot by the same team, against the
    number of passes in the club and league pass sets."""
    nx = successors(_log_ranges(d, p), LOG_ORDER, LOG_CARRY, scope=p.sequence_scope)
    pairs = nx.filter((F.col("PRIMARYTYPE") == K.PASS_TYPE) & (F.col("next_PRIMARYTYPE") == K.SHOT_TYPE)
                      & (F.col("TEAM_WYID") == F.col("next_TEAM_WYID")))
    hits = pairs.agg(F.count(F.lit(1)).alias("league"), count_true(F.col("TEAM_WYID") == p.club).alias("club"))
    hits = stack_rows(hits, [(F.lit("club"), F.col("club")), (F.lit("league"), F.col("league"))],
                      ["scope", "passes_to_shots"])
    s = scoped_passes(d, p)
    totals = s.agg(count_true(F.col("in_club")).alias("club"), count_true(F.col("in_league")).alias("league"))
    totals = stack_rows(totals, [(F.lit("club"), F.col("club")), (F.lit("league"), F.col("league"))],
                        ["scope", "total_passes"])
    return (hits.join(totals, "scope")
            .withColumn("pct", pct(F.col("passes_to_shots"), F.col("total_passes"))))


def _with_team_names(df: DataFrame, d: EventData) -> DataFrame:
    return df.join(first_by_key(d.teams, ["TEAM_WYID"]), "TEAM_WYID", "left")


def _team_rates(rows: DataFrame, success: Column) -> DataFrame:
    return (rows.groupBy("TEAM_WYID")
            .agg(F.count(F.lit(1)).alias("total"), count_true(success).alias("success"))
            .withColumn("success_rate", pct(F.col("success"), F.col("total"))))


def team_pass_success(d: EventData, p: Params) -> DataFrame:
    """Q10: per team passes, successful passes (by event id) and rate, named, worst first
    (passes without a team are a group of their own)."""
    stats = _team_rates(league_passes(d, p), F.col("success"))
    return _with_team_names(stats, d).select("TEAM_WYID", "TEAMNAME", "total", "success", "success_rate") \
        .orderBy(asc_last("success_rate"), asc_last("TEAM_WYID"))


def bottom3_pass_success(d: EventData, p: Params, k: int = 3) -> DataFrame:
    """Q11: the k teams with the lowest success rate."""
    return top_k(team_pass_success(d, p), k, [asc_last("success_rate")], ["TEAM_WYID"])


def top3_pass_success(d: EventData, p: Params, k: int = 3) -> DataFrame:
    """Q11: the k teams with the highest success rate."""
    return top_k(team_pass_success(d, p), k, [desc_last("success_rate")], ["TEAM_WYID"])


def _last_third() -> Column:
    """A row filter (an unknown place is not in the last third)."""
    return F.col("LOCATIONX") > F.lit(K.LAST_THIRD_X)


def last_third_summary(d: EventData, p: Params) -> DataFrame:
    """Q12: passes starting in the last third: total, successful, rate; club and league."""
    s = scoped_passes(d, p).filter(_last_third())
    club_success = F.col("success_row") & (F.col("TEAM_WYID") == p.club)
    agg = s.agg(count_true(F.col("in_club")).alias("ct"), count_true(club_success).alias("cs"),
                count_true(F.col("in_league")).alias("lt"), count_true(F.col("success_row")).alias("ls"))
    rows = [(F.lit("club"), F.col("ct"), F.col("cs")), (F.lit("league"), F.col("lt"), F.col("ls"))]
    return stack_rows(agg, rows, ["scope", "total", "success"]) \
        .withColumn("success_rate", pct(F.col("success"), F.col("total")))


def _last_third_rates(d: EventData, p: Params) -> DataFrame:
    stats = _team_rates(league_passes(d, p).filter(_last_third()), F.col("success"))
    return _with_team_names(stats, d).select("TEAM_WYID", "TEAMNAME", "total", "success", "success_rate")


def last_third_all_teams(d: EventData, p: Params) -> DataFrame:
    """Q13: last-third success rate of every team, named, best first."""
    return _last_third_rates(d, p).orderBy(desc_last("success_rate"), asc_last("TEAM_WYID"))


def last_third_by_team(d: EventData, p: Params, k: int = 3) -> DataFrame:
    """Q13: the k teams with the best last-third success rate."""
    return top_k(_last_third_rates(d, p), k, [desc_last("success_rate")], ["TEAM_WYID"])


def accuracy_flag_success(d: EventData, p: Params) -> DataFrame:
    """Q14: per team success rate from the ACCURATE flag."""
    return _team_rates(league_passes(d, p), F.col("ACCURATE") == 1)
