"""Analytics as table functions of SQL text.

``register`` makes the domain tables temporary views and defines table functions over them; a caller
then writes ``SELECT * FROM pf_standings(array(335), array(191611))`` in any query, or binds values with
``call``. Catalyst inlines a function into the query around it, so filters and column pruning reach the
scans as in the DataFrame form. Functions and views are temporary: they belong to the session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from .tables import EventData

PREFIX = "pf_"

_GOALS = """
  SELECT MATCH_WYID, TEAM_WYID, SEASON_WYID,
         try_cast(nullif(try_element_at(split(SCORE, '-'), 1), '') AS INT) AS goals_for
  FROM {p}match_teams JOIN (
    SELECT MATCH_WYID, SEASON_WYID FROM {p}matches
    WHERE array_contains(competitions, COMPETITION_WYID) AND array_contains(seasons, SEASON_WYID)) USING (MATCH_WYID)
  WHERE SCORE <> ''"""

_PAIRED = """
  SELECT a.MATCH_WYID, a.TEAM_WYID, a.goals_for, b.goals_for AS goals_against, a.SEASON_WYID
  FROM ({goals}) a JOIN ({goals}) b ON a.MATCH_WYID = b.MATCH_WYID AND a.TEAM_WYID <> b.TEAM_WYID"""

_TABLE = """
  SELECT SEASON_WYID, TEAM_WYID,
         sum(CASE WHEN goals_for > goals_against THEN 3 WHEN goals_for = goals_against THEN 1 ELSE 0 END) AS points,
         CASE WHEN count(goals_for) = count(*) THEN sum(goals_for) END AS goals_for,
         CASE WHEN count(goals_against) = count(*) THEN sum(goals_against) END AS goals_against
  FROM ({paired}) GROUP BY SEASON_WYID, TEAM_WYID"""


def _functions(prefix: str) -> dict[str, tuple[str, str, str]]:
    """Function name: parameters, columns, body."""
    goals = _GOALS.format(p=prefix)
    paired = _PAIRED.format(goals=goals)
    scope = "competitions ARRAY<BIGINT>, seasons ARRAY<BIGINT>"
    return {
        "match_scope": (
            "competitions ARRAY<BIGINT>, date_from DATE, as_of DATE", "MATCH_WYID BIGINT, SEASON_WYID BIGINT",
            f"""SELECT MATCH_WYID, SEASON_WYID FROM {prefix}matches
                WHERE array_contains(competitions, COMPETITION_WYID)
                  AND CAST(`DATE` AS DATE) BETWEEN date_from AND coalesce(as_of, current_date())"""),
        "match_goals": (
            scope, "MATCH_WYID BIGINT, TEAM_WYID BIGINT, goals_for INT, goals_against INT, SEASON_WYID BIGINT", paired),
        "standings": (
            scope, "SEASON_WYID BIGINT, TEAM_WYID BIGINT, points BIGINT, goals_for BIGINT, goals_against BIGINT, "
                   "goal_diff BIGINT, `rank` INT",
            f"""SELECT *, row_number() OVER (PARTITION BY SEASON_WYID ORDER BY points DESC NULLS LAST, goal_diff DESC NULLS LAST,
                       goals_for DESC NULLS LAST, TEAM_WYID ASC NULLS LAST) AS `rank`
                FROM (SELECT *, goals_for - goals_against AS goal_diff FROM ({_TABLE.format(paired=paired)}))"""),
        "club_matches": (
            f"club BIGINT, {scope}", "MATCH_WYID BIGINT, MATCHLABEL STRING",
            f"""SELECT DISTINCT m.MATCH_WYID, m.MATCHLABEL
                FROM {prefix}matches m JOIN ({paired}) g ON g.MATCH_WYID = m.MATCH_WYID WHERE g.TEAM_WYID = club"""),
        "shots_of_match": (
            "match_id BIGINT, seasons ARRAY<BIGINT>", "EVENT_WYID BIGINT, LOCATIONX DOUBLE, LOCATIONY DOUBLE, TEAM_WYID BIGINT",
            f"""SELECT EVENT_WYID, LOCATIONX, LOCATIONY, TEAM_WYID FROM {prefix}shot_common
                WHERE MATCH_WYID = match_id AND PRIMARYTYPE = '{K.SHOT_TYPE}' AND array_contains(seasons, SEASON_WYID)
                  AND LOCATIONX IS NOT NULL AND LOCATIONY IS NOT NULL"""),
    }


def register(spark: SparkSession, d: EventData, prefix: str = PREFIX) -> list[str]:
    """Define the views and functions in the session; the names of the functions."""
    for table in d.TABLES:
        getattr(d, table).createOrReplaceTempView(prefix + table)
    names = []
    for name, (parameters, columns, body) in _functions(prefix).items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) RETURNS TABLE ({columns}) RETURN {body}")
        names.append(prefix + name)
    return names


def call(spark: SparkSession, name: str, **arguments) -> DataFrame:
    """A registered function with bound arguments (Python values; lists become arrays), by name."""
    bound = {k: F.lit(v) if v is None else F.array(*[F.lit(x) for x in v]) if isinstance(v, (list, tuple)) else v
             for k, v in arguments.items()}
    text = ", ".join(f"{k} => :{k}" for k in arguments)
    return spark.sql(f"SELECT * FROM {name}({text})", args=bound)
