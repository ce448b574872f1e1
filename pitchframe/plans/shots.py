"""Shot analytics: season extracts, exclusion audit, goal flag, distance, angle, xG,
binned conversion and precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.binning import cut, seq_breaks, upper_bound_bins
from ..functions.geometry import distance_to_goal, goal_angle_deg, is_finite, x_metres, y_metres
from ..functions.semantics import count_true, if_else, in_set, lenient_sum, not_in_set, pct
from ..operators.exact import exact_mean
from ..operators.relational import first_by_key, share_of_total
from ..sources.tables import EventData, in_list_params, sql_query
from .params import Params


def shots_by_season(d: EventData, p: Params) -> DataFrame:
    """Q15: shots of the chosen competition, one extract per season (first row per event),
    stacked; only the last season's extract carries PRIMARYTYPE from the secondary types."""
    m = (d.matches.filter((F.col("COMPETITION_WYID") == p.shot_competition)
                          & F.col("SEASON_WYID").isin(*p.shot_seasons))
         .select("MATCH_WYID", "SEASON_WYID", "COMPETITION_WYID"))
    def build() -> DataFrame:
        s = d.shots.join(m, "MATCH_WYID")
        types = d.shot_types.select(F.col("EVENT_WYID").alias("_ev"), "PRIMARYTYPE")
        typed = s.join(types, (F.col("EVENT_WYID") == F.col("_ev"))
                       & (F.col("SEASON_WYID") == F.lit(p.shot_seasons[-1])), "left").drop("_ev")
        return first_by_key(typed, ["SEASON_WYID", "EVENT_WYID"])

    return d.derived(("shots_by_season", p.shot_competition, p.shot_seasons), build)


def shot_exclusion_audit(d: EventData, p: Params) -> DataFrame:
    """Q16: rows before, after and removed by the set-piece exclusion (null type is kept)."""
    s = shots_by_season(d, p)
    excluded = in_set("PRIMARYTYPE", K.SET_PIECE_TYPES)
    return s.agg(F.count(F.lit(1)).alias("n_before"), F.count_if(~excluded).alias("n_after"),
                 F.count_if(excluded).alias("removed"))


def goal_flag(d: EventData, p: Params) -> DataFrame:
    """Q17: open-play shots with total_goal = SHOTISGOAL is 1 or body part mentions "goal"
    (three-valued: unknown stays null unless the other source says goal)."""
    s = shots_by_season(d, p).filter(not_in_set("PRIMARYTYPE", K.SET_PIECE_TYPES))
    g1 = (F.col("SHOTISGOAL") == 1).cast("int")
    g2 = F.lower(F.col("SHOTBODYPART").cast("string")).contains("goal").cast("int")
    return (s.withColumn("goal_from_shotisgoal", g1)
            .withColumn("goal_from_bodypart", g2)
            .withColumn("total_goal", ((F.col("goal_from_shotisgoal") == 1)
                                       | (F.col("goal_from_bodypart") == 1)).cast("int")))


def _outcome() -> Column:
    return if_else(F.col("total_goal") == 1, K.GOAL_LABEL, K.NO_GOAL_LABEL)


def goal_share(d: EventData, p: Params) -> DataFrame:
    """Q18: goals vs non-goals (and unknown) with percentages."""
    g = goal_flag(d, p).groupBy(_outcome().alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("pct", share_of_total("n"))


def shot_coordinates(d: EventData, p: Params) -> DataFrame:
    """Q19: located shot events in the chosen seasons, first row per event. The season
    list is bound as parameters of the SQL text."""
    seasons, args = in_list_params("season", list(p.seasons))
    args["shot_type"] = K.SHOT_TYPE
    c = sql_query(d.shot_common.sparkSession, f"""
        SELECT EVENT_WYID, LOCATIONX, LOCATIONY
        FROM {{common}}
        WHERE SEASON_WYID IN {seasons} AND PRIMARYTYPE = :shot_type
          AND LOCATIONX IS NOT NULL AND LOCATIONY IS NOT NULL""", {"common": d.shot_common}, args)
    return first_by_key(c, ["EVENT_WYID"])


def shot_minutes(d: EventData, p: Params) -> DataFrame:
    c = (d.shot_common.filter(F.col("SEASON_WYID").isin(*p.seasons) & (F.col("PRIMARYTYPE") == K.SHOT_TYPE))
         .select("EVENT_WYID", "MINUTE"))
    return first_by_key(c, ["EVENT_WYID"])


def shots_geo(d: EventData, p: Params) -> DataFrame:
    """Open-play shots with coordinates in metres, distance and angle to goal (shared
    by the distance, angle and shot-map analytics; ``prepare`` can store it)."""
    def build() -> DataFrame:
        s = goal_flag(d, p).join(shot_coordinates(d, p), "EVENT_WYID", "left") \
            .filter(F.col("LOCATIONX").isNotNull() & F.col("LOCATIONY").isNotNull())
        s = s.withColumn("x_m", x_metres("LOCATIONX")).withColumn("y_m", y_metres("LOCATIONY"))
        return (s.withColumn("distance_m", distance_to_goal(F.col("x_m"), F.col("y_m")))
                .withColumn("angle_deg_m", goal_angle_deg(F.col("x_m"), F.col("y_m"))))

    return d.derived(("shots_geo", p.shot_competition, p.shot_seasons, p.seasons), build)


def _in_angle_range() -> Column:
    a = F.col("angle_deg_m")
    return is_finite(a) & (a >= 0) & (a <= 180)


def shot_distance_mean(d: EventData, p: Params) -> DataFrame:
    """Q20: mean distance to goal (metres) by outcome."""
    return shots_geo(d, p).groupBy(_outcome().alias("outcome")) \
        .agg(exact_mean("distance_m").alias("mean_distance_m"))


def shot_angle_mean(d: EventData, p: Params) -> DataFrame:
    """Q21: mean goal-mouth opening angle (degrees) by outcome."""
    return shots_geo(d, p).filter(_in_angle_range()).groupBy(_outcome().alias("outcome")) \
        .agg(exact_mean("angle_deg_m").alias("mean_angle_m"))


def xg_on_target(d: EventData, p: Params) -> DataFrame:
    """Q22: mean xG and count by outcome for shots on target."""
    s = goal_flag(d, p).filter((F.col("SHOTONTARGET") == 1) & F.col("SHOTXG").isNotNull())
    return s.groupBy(_outcome().alias("outcome")).agg(exact_mean("SHOTXG").alias("mean_xg"),
                                                       F.count(F.lit(1)).alias("n"))


def _conversion(df: DataFrame, idx: Column, label: Column, name: str, extra=()) -> DataFrame:
    return (df.groupBy(idx.alias("bin_idx"), label.alias(name))
            .agg(F.count(F.lit(1)).alias("shots"), lenient_sum("total_goal").alias("goals"), *extra)
            .withColumn("goal_pct", pct(F.col("goals"), F.col("shots"))))


def conversion_by_distance(d: EventData, p: Params) -> DataFrame:
    """Q23: shots, goals and conversion per 5 m distance bin (0-60 m; beyond is the NA bin)."""
    idx, label = cut("distance_m", seq_breaks(0.0, K.DISTANCE_BIN_MAX, K.DISTANCE_BIN_STEP))
    return _conversion(shots_geo(d, p), idx, label, "distance_bin")


def conversion_by_angle(d: EventData, p: Params) -> DataFrame:
    """Q24: shots, goals and conversion per 20 degree bin, 120-180 merged, in bin order."""
    idx, label = upper_bound_bins("angle_deg_m", K.ANGLE_BREAKS)
    return _conversion(shots_geo(d, p).filter(_in_angle_range()), idx, label, "angle_bin") \
        .orderBy(F.col("bin_idx").asc_nulls_last())


def conversion_by_xg(d: EventData, p: Params) -> DataFrame:
    """Q25: shots, goals, conversion and mean xG per 0.05 xG bin, bins with >= min shots."""
    s = goal_flag(d, p).filter(F.col("SHOTXG").isNotNull()).withColumn("xg", F.col("SHOTXG").cast("double"))
    idx, label = cut("xg", seq_breaks(0.0, K.XG_BIN_MAX, K.XG_BIN_STEP))
    out = _conversion(s, idx, label, "xg_bin", extra=[exact_mean("xg").alias("mean_xg")])
    return out.filter(F.col("shots") >= p.min_bin_shots)


def conversion_by_minute(d: EventData, p: Params) -> DataFrame:
    """Q26: shots, goals and conversion per quarter hour (0-120; later minutes are NA)."""
    s = goal_flag(d, p).join(shot_minutes(d, p), "EVENT_WYID", "left").filter(F.col("MINUTE").isNotNull())
    idx, label = cut(F.col("MINUTE").cast("double"), K.MINUTE_BREAKS)
    return _conversion(s, idx, label, "time_bin")


def shot_precision(d: EventData, p: Params) -> DataFrame:
    """Q27: shots on / off target as counts and share of the two (long form)."""
    agg = goal_flag(d, p).agg(F.count(F.lit(1)).alias("total_shots"),
                              count_true(F.col("SHOTONTARGET") == 1).alias(K.ON_TARGET_LABEL),
                              count_true(F.col("SHOTONTARGET") == 0).alias(K.OFF_TARGET_LABEL))
    long = agg.unpivot(["total_shots"], [K.ON_TARGET_LABEL, K.OFF_TARGET_LABEL], "outcome", "count")
    return long.withColumn("pct", share_of_total("count"))
