"""Deterministic mapping from the generated benchmark tables to the domain tables.

The benchmark tables (orders, lineitem, events, part, supplier) carry no football
data, so each domain table is derived from one of them by fixed arithmetic. The same
expressions are written in DuckDB SQL in ``oracle/sql.py``; both must stay in step.
Nulls, duplicate keys and unknown ids are injected on purpose so that every null,
tie and first-row rule is exercised.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import EventData, read_parquet

# Mapping parameters of the test data (not football facts).
SEASON_NEW, SEASON_OLD = 191611, 189918
SEASON_SWITCH = "1998-04-01"
TEAMS_IN_PASSES = 20
TEAMS_IN_SCORES = 12
PLAYERS = 50
RECIPIENTS = 60


def _c(name: str) -> Column:
    return F.col(name)


def _season(ts: str) -> Column:
    return F.when(_c(ts) >= F.lit(SEASON_SWITCH).cast("timestamp_ntz"), F.lit(SEASON_NEW)) \
        .otherwise(F.lit(SEASON_OLD)).cast("bigint")


def _event_id() -> Column:
    return (_c("l_orderkey") * 10 + _c("l_linenumber")).alias("EVENT_WYID")


def _line_type() -> Column:
    return F.when(_c("l_returnflag") == "N", "pass").when(_c("l_returnflag") == "A", "shot") \
        .otherwise("duel").alias("PRIMARYTYPE")


def matches(orders: DataFrame) -> DataFrame:
    return orders.select(
        _c("o_orderkey").alias("MATCH_WYID"),
        F.when(_c("o_orderkey") % 59 != 0, _season("o_orderdate")).alias("SEASON_WYID"),
        F.when(_c("o_orderstatus") == "F", 335).when(_c("o_orderstatus") == "O", 328)
        .otherwise(999).cast("bigint").alias("COMPETITION_WYID"),
        _c("o_orderdate").alias("DATE"),
        F.when(_c("o_orderkey") % 53 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("M"), _c("o_orderkey").cast("string"))).alias("MATCHLABEL"),
    )


def passes(lineitem: DataFrame) -> DataFrame:
    return lineitem.select(
        _c("l_orderkey").alias("MATCH_WYID"),
        _event_id(),
        (_c("l_partkey") % PLAYERS).alias("PLAYER_WYID"),
        F.when(_c("l_partkey") % 41 != 7, (_c("l_partkey") * 7 + _c("l_linenumber")) % RECIPIENTS).alias("RECIPIENT_WYID"),
        (_c("l_extendedprice") / 1000).alias("LENGTH"),
        (_c("l_discount") * 1000).alias("ENDLOCATIONX"),
        (_c("l_tax") * 1250).alias("ENDLOCATIONY"),
        F.when(_c("l_linestatus") == "O", 1).otherwise(0).cast("int").alias("ACCURATE"),
    )


def common(lineitem: DataFrame) -> DataFrame:
    return lineitem.select(
        _event_id(),
        _c("l_orderkey").alias("MATCH_WYID"),
        _season("l_shipdate").alias("SEASON_WYID"),
        F.when(_c("l_suppkey") % 23 != 5, _c("l_suppkey") % TEAMS_IN_PASSES).alias("TEAM_WYID"),
        _line_type(),
        (_c("l_quantity") * 2).alias("LOCATIONX"),
        ((_c("l_suppkey") * 7 + _c("l_linenumber")) % 101).cast("double").alias("LOCATIONY"),
        (_c("l_partkey") % 96).cast("int").alias("MINUTE"),
    )


def secondary(lineitem: DataFrame) -> DataFrame:
    pk = _c("l_partkey")
    return lineitem.select(
        _event_id(),
        _c("l_orderkey").alias("MATCH_WYID"),
        _line_type(),
        F.when(pk % 9 == 0, "assist").when(pk % 5 == 0, "Assist").otherwise("pass").alias("SECONDARYTYPE1"),
        F.when(pk % 2 == 0, "Shot_Assist").alias("SECONDARYTYPE2"),
        F.when(pk % 7 == 0, "shot_assist").alias("SECONDARYTYPE3"),
    )


def player_stats(lineitem: DataFrame) -> DataFrame:
    return lineitem.select(
        _c("l_orderkey").alias("MATCH_WYID"),
        (_c("l_partkey") % PLAYERS).alias("PLAYER_WYID"),
        (_c("l_suppkey") % TEAMS_IN_PASSES).alias("TEAM_WYID"),
        F.when(_c("l_partkey") % 10 == 0, F.lit(None).cast("int"))
        .otherwise((_c("l_linenumber") % 3).cast("int")).alias("PLAYERASSISTS"),
    )


def event_log(events: DataFrame) -> DataFrame:
    et = _c("event_type")
    return events.select(
        _c("event_id").alias("EVENT_WYID"),
        _c("user_id").alias("MATCH_WYID"),
        F.when(_c("event_id") % 3 == 0, SEASON_NEW).otherwise(SEASON_OLD).cast("bigint").alias("SEASON_WYID"),
        (_c("event_id") % 2).alias("TEAM_WYID"),
        F.when(et == "view", "pass").when(et == "purchase", "shot").otherwise(et).alias("PRIMARYTYPE"),
    )


def shots(events: DataFrame) -> DataFrame:
    e = _c("event_id")
    return events.select(
        e.alias("EVENT_WYID"),
        _c("user_id").alias("MATCH_WYID"),
        (_c("user_id") % PLAYERS).alias("PLAYER_WYID"),
        (e % TEAMS_IN_PASSES).alias("TEAM_WYID"),
        F.when(e % 11 == 0, F.lit(None)).when(e % 8 == 0, 1).otherwise(0).cast("int").alias("SHOTISGOAL"),
        F.when(e % 17 == 0, F.lit(None)).when(e % 13 == 0, "Goal_left").otherwise("right_foot")
        .cast("string").alias("SHOTBODYPART"),
        F.when(e % 7 == 0, F.lit(None)).otherwise(e % 2).cast("int").alias("SHOTONTARGET"),
        F.when(e % 19 == 0, F.lit(None)).otherwise((e * 31 % 1001).cast("double") / 1000)
        .cast("double").alias("SHOTXG"),
    )


def shot_types(events: DataFrame) -> DataFrame:
    et = _c("event_type")
    kind = (F.when(et == "click", "corn").when(et == "view", "free").when(et == "error", F.lit(None))
            .otherwise("shot").cast("string"))
    base = events.select(_c("event_id").alias("EVENT_WYID"), _c("user_id").alias("MATCH_WYID"),
                         kind.alias("PRIMARYTYPE"))
    # every event has a second tag row: a copy, or a penalty tag for some events, so that
    # first-row-per-event sees both identical and conflicting duplicates
    second = events.select(_c("event_id").alias("EVENT_WYID"), _c("user_id").alias("MATCH_WYID"),
                           F.when(_c("event_id") % 29 == 0, F.lit("pena")).otherwise(kind).alias("PRIMARYTYPE"))
    return base.unionByName(second)


def shot_common(events: DataFrame) -> DataFrame:
    e = _c("event_id")
    return events.select(
        e.alias("EVENT_WYID"),
        _c("user_id").alias("MATCH_WYID"),
        F.when(e % 3 == 0, SEASON_NEW).otherwise(SEASON_OLD).cast("bigint").alias("SEASON_WYID"),
        (e % TEAMS_IN_PASSES).alias("TEAM_WYID"),
        F.when(_c("event_type") == "error", "duel").otherwise("shot").alias("PRIMARYTYPE"),
        F.when(e % 23 == 0, F.lit(None)).otherwise((50 + e * 13 % 51).cast("double"))
        .cast("double").alias("LOCATIONX"),
        (e * 37 % 101).cast("double").alias("LOCATIONY"),
        (e % 125).cast("int").alias("MINUTE"),
    )


def match_teams(orders: DataFrame) -> DataFrame:
    """Two team rows per order, the first repeated for some orders (one scan: exploded from one row)."""
    k = _c("o_orderkey")

    def side(team: Column) -> Column:
        goals = (k * (team + 3) % 4).cast("string")
        score = (F.when(k % 50 == 0, F.lit(None).cast("string"))
                 .when(k % 50 == 1, F.lit(""))
                 .when(k % 50 == 2, goals)
                 .otherwise(F.concat(goals, F.lit("-0"))))
        return F.struct(team.alias("TEAM_WYID"), score.alias("SCORE"))

    a, b = side(k % TEAMS_IN_SCORES), side((k + 1 + _c("o_custkey") % 11) % TEAMS_IN_SCORES)
    sides = F.when(k % 71 == 0, F.array(a, b, a)).otherwise(F.array(a, b))
    return orders.select(k.alias("MATCH_WYID"), F.explode(sides).alias("_s")) \
        .select("MATCH_WYID", "_s.TEAM_WYID", "_s.SCORE")


def players(part: DataFrame) -> DataFrame:
    """A player per part; every 13th stands twice, the second time as a midfielder."""
    t = _c("p_type")
    role = (F.when(t == "ECONOMY", "Defender").when(t == "STANDARD", "Midfielder")
            .when(t == "PROMO", "Wing Forward").when(t == "MEDIUM", F.lit(None))
            .otherwise("Goalkeeper").cast("string"))
    roles = F.when(_c("p_partkey") % 13 == 0, F.array(role, F.lit("Midfielder"))).otherwise(F.array(role))
    return part.select(_c("p_partkey").alias("PLAYER_WYID"), F.explode(roles).alias("ROLENAME"),
                       _c("p_name").alias("SHORTNAME"))


def teams(supplier: DataFrame) -> DataFrame:
    return supplier.select(_c("s_suppkey").alias("TEAM_WYID"), _c("s_name").alias("TEAMNAME"))


def load(spark: SparkSession, root: str) -> EventData:
    """All domain tables over the benchmark tables in ``root`` (lazy)."""
    def rd(name):
        return lambda: read_parquet(spark, root, name)

    src = {n: rd(n) for n in ("orders", "lineitem", "events", "part", "supplier")}
    return EventData(builders={
        "matches": lambda: matches(src["orders"]()),
        "passes": lambda: passes(src["lineitem"]()),
        "common": lambda: common(src["lineitem"]()),
        "secondary": lambda: secondary(src["lineitem"]()),
        "player_stats": lambda: player_stats(src["lineitem"]()),
        "event_log": lambda: event_log(src["events"]()),
        "shots": lambda: shots(src["events"]()),
        "shot_types": lambda: shot_types(src["events"]()),
        "shot_common": lambda: shot_common(src["events"]()),
        "match_teams": lambda: match_teams(src["orders"]()),
        "players": lambda: players(src["part"]()),
        "teams": lambda: teams(src["supplier"]()),
    })
