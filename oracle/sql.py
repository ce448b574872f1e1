"""DuckDB SQL for every registered analytic, written independently of the Spark code.

The views ``orders lineitem events part supplier`` are provided by the checker. The
domain tables are rebuilt here as CTEs with the same arithmetic as
``pitchframe/sources/testdata.py``; every analytic is then plain SQL over them. Means and
sums of doubles are exact here too (whole numbers of 2**-72 in 128-bit integers), so they are
compared bit for bit; only the mean angle, whose arc tangents come from each engine's own
library, is rounded to 6 places on both sides.
"""

from __future__ import annotations

from types import SimpleNamespace

# Fixed values of the original analysis: labels, pitch sizes in metres, thresholds, bin edges.
K = SimpleNamespace(
    ANGLE_BREAKS=(0.0, 20.0, 40.0, 60.0, 80.0, 100.0, 120.0, 180.0),
    BOTTOM_GROUP_LABEL="Bund 5", TOP_GROUP_LABEL="Top 5", TOP_GROUP_RANK=5,
    CLUB_SIDE_LABEL="FCN", OPPONENT_SIDE_LABEL="Modstander",
    DISTANCE_BIN_MAX=60.0, DISTANCE_BIN_STEP=5.0, XG_BIN_MAX=1.0, XG_BIN_STEP=0.05,
    EARLY_PERIOD_LABEL="0-79", LATE_PERIOD_LABEL="80+", LATE_MINUTE=80,
    GOAL_LABEL="Mål", NO_GOAL_LABEL="Ikke mål", PASS_HIT_LABEL="Ramte", PASS_MISS_LABEL="Fejl",
    ON_TARGET_LABEL="Rammer målet", OFF_TARGET_LABEL="Rammer ikke målet",
    GOAL_WIDTH_M=7.32, PITCH_WIDTH_M=68.0, LAST_THIRD_X=66.7,
    MINUTE_BREAKS=(0.0, 15.0, 30.0, 45.0, 60.0, 75.0, 90.0, 120.0),
    SET_PIECE_TYPES=("corn", "free", "pena"), UNKNOWN_LINE="Ukendt")
# The parameters the registry runs with on the generated tables.
P = SimpleNamespace(
    club=1, seasons=(191611, 189918), competitions=(335, 328), date_from="1996-07-19", as_of="2001-12-31",
    shot_competition=335, shot_seasons=(189918, 191611), min_bin_shots=1, top_n=10)
SHOT_MATCH, CLUB_MATCH = 10, 373


def seq_breaks(start: float, stop: float, step: float) -> list[float]:
    return [start + i * step for i in range(round((stop - start) / step) + 1)]


def interval_labels(breaks, include_lowest: bool = True) -> list[str]:
    """"[a,b]" for a closed lowest bin, "(a,b]" for the others, edges in three digits."""
    edge = [f"{b:.3g}" for b in breaks]
    return [("[" if i == 0 and include_lowest else "(") + f"{edge[i]},{edge[i + 1]}]" for i in range(len(edge) - 1)]


def _lst(values) -> str:
    return ", ".join(str(v) for v in values)


def _sum(x: str) -> str:
    """The exact sum of doubles: whole numbers of 2**-72, added as integers, turned into a double once
    (whole part and fraction)."""
    total = f"sum(CAST(trunc(CAST({x} AS DOUBLE) * {2 ** 72}.0) AS HUGEINT))"
    size = f"abs({total})"
    whole = f"CAST({size} // {2 ** 96} AS DOUBLE) * {2 ** 24}.0 + CAST({size} // {2 ** 72} % {2 ** 24} AS DOUBLE)"
    fraction = (f"CAST({size} % {2 ** 72} // {2 ** 24} AS DOUBLE) / {2 ** 48}.0 "
                f"+ CAST({size} % {2 ** 24} AS DOUBLE) / {2 ** 72}.0")
    return f"(sign({total}) * (({whole}) + ({fraction})))"


def _mean(x: str) -> str:
    return f"({_sum(x)} / nullif(count({x}), 0))"


def _dbl(x: float) -> str:
    return f"CAST('{x!r}' AS DOUBLE)"


SEASONS = _lst(P.seasons)
COMPS = _lst(P.competitions)
CLUB = P.club
SETP = ", ".join(f"'{t}'" for t in K.SET_PIECE_TYPES)
GOAL, NOGOAL = K.GOAL_LABEL, K.NO_GOAL_LABEL


def _score(team: str) -> str:
    g = f"CAST(o_orderkey * ({team} + 3) % 4 AS VARCHAR)"
    return (f"CASE WHEN o_orderkey % 50 = 0 THEN NULL WHEN o_orderkey % 50 = 1 THEN '' "
            f"WHEN o_orderkey % 50 = 2 THEN {g} ELSE {g} || '-0' END")


BASE = f"""
d_matches AS (
  SELECT o_orderkey AS MATCH_WYID,
         CASE WHEN o_orderkey % 59 <> 0 THEN
           CAST(CASE WHEN o_orderdate >= TIMESTAMP '1998-04-01' THEN 191611 ELSE 189918 END AS BIGINT) END AS SEASON_WYID,
         CAST(CASE o_orderstatus WHEN 'F' THEN 335 WHEN 'O' THEN 328 ELSE 999 END AS BIGINT) AS COMPETITION_WYID,
         o_orderdate AS "DATE",
         CASE WHEN o_orderkey % 53 = 0 THEN NULL ELSE 'M' || CAST(o_orderkey AS VARCHAR) END AS MATCHLABEL
  FROM orders),
d_passes AS (
  SELECT l_orderkey AS MATCH_WYID, l_orderkey * 10 + l_linenumber AS EVENT_WYID,
         l_partkey % 50 AS PLAYER_WYID, CASE WHEN l_partkey % 41 <> 7 THEN (l_partkey * 7 + l_linenumber) % 60 END AS RECIPIENT_WYID,
         l_extendedprice / 1000 AS LENGTH, l_discount * 1000 AS ENDLOCATIONX, l_tax * 1250 AS ENDLOCATIONY,
         CAST(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS INTEGER) AS ACCURATE
  FROM lineitem),
d_common AS (
  SELECT l_orderkey * 10 + l_linenumber AS EVENT_WYID, l_orderkey AS MATCH_WYID,
         CAST(CASE WHEN l_shipdate >= TIMESTAMP '1998-04-01' THEN 191611 ELSE 189918 END AS BIGINT) AS SEASON_WYID,
         CASE WHEN l_suppkey % 23 <> 5 THEN l_suppkey % 20 END AS TEAM_WYID,
         CASE l_returnflag WHEN 'N' THEN 'pass' WHEN 'A' THEN 'shot' ELSE 'duel' END AS PRIMARYTYPE,
         l_quantity * 2 AS LOCATIONX,
         CAST((l_suppkey * 7 + l_linenumber) % 101 AS DOUBLE) AS LOCATIONY,
         CAST(l_partkey % 96 AS INTEGER) AS MINUTE
  FROM lineitem),
d_secondary AS (
  SELECT l_orderkey * 10 + l_linenumber AS EVENT_WYID, l_orderkey AS MATCH_WYID,
         CASE l_returnflag WHEN 'N' THEN 'pass' WHEN 'A' THEN 'shot' ELSE 'duel' END AS PRIMARYTYPE,
         CASE WHEN l_partkey % 9 = 0 THEN 'assist' WHEN l_partkey % 5 = 0 THEN 'Assist' ELSE 'pass' END AS SECONDARYTYPE1,
         CASE WHEN l_partkey % 2 = 0 THEN 'Shot_Assist' END AS SECONDARYTYPE2,
         CASE WHEN l_partkey % 7 = 0 THEN 'shot_assist' END AS SECONDARYTYPE3
  FROM lineitem),
d_player_stats AS (
  SELECT l_orderkey AS MATCH_WYID, l_partkey % 50 AS PLAYER_WYID, l_suppkey % 20 AS TEAM_WYID,
         CASE WHEN l_partkey % 10 = 0 THEN NULL ELSE CAST(l_linenumber % 3 AS INTEGER) END AS PLAYERASSISTS
  FROM lineitem),
d_event_log AS (
  SELECT event_id AS EVENT_WYID, user_id AS MATCH_WYID,
         CAST(CASE WHEN event_id % 3 = 0 THEN 191611 ELSE 189918 END AS BIGINT) AS SEASON_WYID,
         event_id % 2 AS TEAM_WYID,
         CASE event_type WHEN 'view' THEN 'pass' WHEN 'purchase' THEN 'shot' ELSE event_type END AS PRIMARYTYPE
  FROM events),
d_shots AS (
  SELECT event_id AS EVENT_WYID, user_id AS MATCH_WYID, user_id % 50 AS PLAYER_WYID, event_id % 20 AS TEAM_WYID,
         CAST(CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 8 = 0 THEN 1 ELSE 0 END AS INTEGER) AS SHOTISGOAL,
         CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 13 = 0 THEN 'Goal_left' ELSE 'right_foot' END AS SHOTBODYPART,
         CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(event_id % 2 AS INTEGER) END AS SHOTONTARGET,
         CASE WHEN event_id % 19 = 0 THEN NULL ELSE CAST(event_id * 31 % 1001 AS DOUBLE) / 1000 END AS SHOTXG
  FROM events),
d_shot_types AS (
  SELECT event_id AS EVENT_WYID, user_id AS MATCH_WYID,
         CASE event_type WHEN 'click' THEN 'corn' WHEN 'view' THEN 'free' WHEN 'error' THEN NULL ELSE 'shot' END AS PRIMARYTYPE
  FROM events
  UNION ALL
  SELECT event_id, user_id,
         CASE WHEN event_id % 29 = 0 THEN 'pena'
              ELSE CASE event_type WHEN 'click' THEN 'corn' WHEN 'view' THEN 'free' WHEN 'error' THEN NULL ELSE 'shot' END
         END
  FROM events),
d_shot_common AS (
  SELECT event_id AS EVENT_WYID, user_id AS MATCH_WYID,
         CAST(CASE WHEN event_id % 3 = 0 THEN 191611 ELSE 189918 END AS BIGINT) AS SEASON_WYID,
         event_id % 20 AS TEAM_WYID,
         CASE WHEN event_type = 'error' THEN 'duel' ELSE 'shot' END AS PRIMARYTYPE,
         CASE WHEN event_id % 23 = 0 THEN NULL ELSE CAST(50 + event_id * 13 % 51 AS DOUBLE) END AS LOCATIONX,
         CAST(event_id * 37 % 101 AS DOUBLE) AS LOCATIONY,
         CAST(event_id % 125 AS INTEGER) AS MINUTE
  FROM events),
d_match_teams AS (
  SELECT o_orderkey AS MATCH_WYID, o_orderkey % 12 AS TEAM_WYID, {_score('o_orderkey % 12')} AS SCORE FROM orders
  UNION ALL
  SELECT o_orderkey, (o_orderkey + 1 + o_custkey % 11) % 12,
         {_score('((o_orderkey + 1 + o_custkey % 11) % 12)')} FROM orders
  UNION ALL
  SELECT o_orderkey, o_orderkey % 12, {_score('o_orderkey % 12')} FROM orders WHERE o_orderkey % 71 = 0),
d_players AS (
  SELECT p_partkey AS PLAYER_WYID,
         CASE p_type WHEN 'ECONOMY' THEN 'Defender' WHEN 'STANDARD' THEN 'Midfielder'
                     WHEN 'PROMO' THEN 'Wing Forward' WHEN 'MEDIUM' THEN NULL ELSE 'Goalkeeper' END AS ROLENAME,
         p_name AS SHORTNAME
  FROM part
  UNION ALL
  SELECT p_partkey, 'Midfielder', p_name FROM part WHERE p_partkey % 13 = 0),
d_teams AS (SELECT s_suppkey AS TEAM_WYID, s_name AS TEAMNAME FROM supplier)"""

DERIVED = f"""
teams1 AS (
  SELECT TEAM_WYID, TEAMNAME FROM (
    SELECT *, row_number() OVER (PARTITION BY TEAM_WYID ORDER BY TEAMNAME NULLS LAST) AS rn FROM d_teams) WHERE rn = 1),
players1 AS (
  SELECT PLAYER_WYID, ROLENAME, SHORTNAME FROM (
    SELECT *, row_number() OVER (PARTITION BY PLAYER_WYID ORDER BY ROLENAME NULLS LAST, SHORTNAME NULLS LAST) AS rn
    FROM d_players) WHERE rn = 1),
scoped AS (
  SELECT MATCH_WYID, SEASON_WYID FROM d_matches
  WHERE COMPETITION_WYID IN ({COMPS})
    AND CAST("DATE" AS DATE) BETWEEN DATE '{P.date_from}' AND DATE '{P.as_of}'),
ev_first AS (
  SELECT EVENT_WYID, TEAM_WYID, PRIMARYTYPE, LOCATIONX, LOCATIONY, MINUTE FROM (
    SELECT *, row_number() OVER (PARTITION BY EVENT_WYID ORDER BY MATCH_WYID NULLS LAST, SEASON_WYID NULLS LAST,
             TEAM_WYID NULLS LAST, PRIMARYTYPE NULLS LAST, LOCATIONX NULLS LAST, LOCATIONY NULLS LAST,
             MINUTE NULLS LAST) AS rn
    FROM d_common) WHERE rn = 1),
pe AS (
  SELECT s.MATCH_WYID, s.SEASON_WYID, p.EVENT_WYID, p.PLAYER_WYID, p.RECIPIENT_WYID, p.LENGTH,
         p.ENDLOCATIONX, p.ENDLOCATIONY, p.ACCURATE, e.TEAM_WYID, e.PRIMARYTYPE, e.LOCATIONX, e.LOCATIONY, e.MINUTE
  FROM scoped s LEFT JOIN d_passes p ON p.MATCH_WYID = s.MATCH_WYID
  LEFT JOIN ev_first e ON e.EVENT_WYID = p.EVENT_WYID),
passers AS (SELECT DISTINCT TEAM_WYID AS team, PLAYER_WYID AS passer FROM pe WHERE TEAM_WYID IS NOT NULL),
sp0 AS (
  SELECT pe.*,
         coalesce(EXISTS (SELECT 1 FROM passers q WHERE q.team = pe.TEAM_WYID AND q.passer = pe.RECIPIENT_WYID), false)
           AND coalesce(pe.PRIMARYTYPE = 'pass', false) AS success_row
  FROM pe
  WHERE SEASON_WYID IN ({SEASONS}) AND PLAYER_WYID <> 0 AND RECIPIENT_WYID <> 0),
success_ids AS (SELECT DISTINCT EVENT_WYID FROM sp0 WHERE success_row),
sp AS (
  SELECT sp0.*,
         coalesce(sp0.EVENT_WYID IN (SELECT EVENT_WYID FROM success_ids), false) AS success,
         coalesce(PRIMARYTYPE = 'pass', false) AS in_league,
         coalesce(TEAM_WYID = {CLUB}, false) AS in_club
  FROM sp0),
lp AS (SELECT * FROM sp WHERE in_league),
shot_m AS (
  SELECT MATCH_WYID, SEASON_WYID, COMPETITION_WYID FROM d_matches
  WHERE COMPETITION_WYID = {P.shot_competition} AND SEASON_WYID IN ({_lst(P.shot_seasons)})),
shot_j AS (
  SELECT s.MATCH_WYID, s.EVENT_WYID, s.PLAYER_WYID, s.TEAM_WYID, s.SHOTISGOAL, s.SHOTBODYPART, s.SHOTONTARGET,
         s.SHOTXG, m.SEASON_WYID, m.COMPETITION_WYID, st.PRIMARYTYPE
  FROM d_shots s JOIN shot_m m ON m.MATCH_WYID = s.MATCH_WYID
  LEFT JOIN d_shot_types st ON st.EVENT_WYID = s.EVENT_WYID AND m.SEASON_WYID = {P.shot_seasons[-1]}),
shots15 AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY SEASON_WYID, EVENT_WYID ORDER BY MATCH_WYID NULLS LAST,
             PLAYER_WYID NULLS LAST, TEAM_WYID NULLS LAST, SHOTISGOAL NULLS LAST, SHOTBODYPART NULLS LAST,
             SHOTONTARGET NULLS LAST, SHOTXG NULLS LAST, COMPETITION_WYID NULLS LAST, PRIMARYTYPE NULLS LAST) AS rn
    FROM shot_j) WHERE rn = 1),
shots_cpf AS (
  SELECT *, CAST(SHOTISGOAL = 1 AS INTEGER) AS goal_from_shotisgoal,
         CAST(contains(lower(SHOTBODYPART), 'goal') AS INTEGER) AS goal_from_bodypart,
         CAST((SHOTISGOAL = 1) OR contains(lower(SHOTBODYPART), 'goal') AS INTEGER) AS total_goal,
         CASE WHEN (SHOTISGOAL = 1) OR contains(lower(SHOTBODYPART), 'goal') THEN '{GOAL}'
              WHEN NOT ((SHOTISGOAL = 1) OR contains(lower(SHOTBODYPART), 'goal')) THEN '{NOGOAL}' END AS outcome
  FROM shots15 WHERE NOT coalesce(PRIMARYTYPE IN ({SETP}), false)),
coords AS (
  SELECT EVENT_WYID, LOCATIONX, LOCATIONY FROM (
    SELECT EVENT_WYID, LOCATIONX, LOCATIONY,
           row_number() OVER (PARTITION BY EVENT_WYID ORDER BY LOCATIONX NULLS LAST, LOCATIONY NULLS LAST) AS rn
    FROM d_shot_common
    WHERE SEASON_WYID IN ({SEASONS}) AND PRIMARYTYPE = 'shot' AND LOCATIONX IS NOT NULL AND LOCATIONY IS NOT NULL)
  WHERE rn = 1),
shot_min AS (
  SELECT EVENT_WYID, MINUTE FROM (
    SELECT EVENT_WYID, MINUTE, row_number() OVER (PARTITION BY EVENT_WYID ORDER BY MINUTE NULLS LAST) AS rn
    FROM d_shot_common WHERE SEASON_WYID IN ({SEASONS}) AND PRIMARYTYPE = 'shot') WHERE rn = 1),
geo0 AS (
  SELECT s.*, k.LOCATIONX, k.LOCATIONY, k.LOCATIONX / 100 * 105 AS x_m, k.LOCATIONY / 100 * 68 AS y_m
  FROM shots_cpf s LEFT JOIN coords k ON k.EVENT_WYID = s.EVENT_WYID
  WHERE k.LOCATIONX IS NOT NULL AND k.LOCATIONY IS NOT NULL),
geo1 AS (
  SELECT *, sqrt((105 - x_m) * (105 - x_m) + (34 - y_m) * (34 - y_m)) AS distance_m,
         abs(atan2({_dbl(K.PITCH_WIDTH_M / 2 + K.GOAL_WIDTH_M / 2)} - y_m, 105 - x_m)
             - atan2({_dbl(K.PITCH_WIDTH_M / 2 - K.GOAL_WIDTH_M / 2)} - y_m, 105 - x_m)) AS ang0
  FROM geo0),
geo AS (
  SELECT *, CASE WHEN ang0 > pi() THEN 2 * pi() - ang0 ELSE ang0 END * 180 / pi() AS angle_deg_m FROM geo1),
md AS (
  SELECT mt.MATCH_WYID, mt.TEAM_WYID, mt.SCORE, m.SEASON_WYID, m.COMPETITION_WYID
  FROM d_match_teams mt LEFT JOIN d_matches m ON m.MATCH_WYID = mt.MATCH_WYID
  WHERE m.COMPETITION_WYID IN ({COMPS}) AND m.SEASON_WYID IN ({SEASONS})),
clean AS (
  SELECT MATCH_WYID, TEAM_WYID, SEASON_WYID,
         TRY_CAST(nullif(split_part(SCORE, '-', 1), '') AS INTEGER) AS goals_for
  FROM md WHERE SCORE IS NOT NULL AND SCORE <> ''),
side AS (
  SELECT MATCH_WYID, TEAM_WYID, goals_for, SEASON_WYID FROM (
    SELECT *, row_number() OVER (PARTITION BY MATCH_WYID, TEAM_WYID
                                 ORDER BY goals_for NULLS LAST, SEASON_WYID NULLS LAST) AS rn FROM clean)
  WHERE rn = 1),
goals29 AS (
  SELECT a.MATCH_WYID, a.TEAM_WYID, a.goals_for, b.goals_for AS goals_against, a.SEASON_WYID
  FROM clean a LEFT JOIN clean b ON a.MATCH_WYID = b.MATCH_WYID WHERE a.TEAM_WYID <> b.TEAM_WYID),
points30 AS (
  SELECT *, CASE WHEN goals_for > goals_against THEN 3 WHEN goals_for = goals_against THEN 1 ELSE 0 END AS points
  FROM goals29),
stand0 AS (
  SELECT SEASON_WYID, TEAM_WYID,
         CAST(CASE WHEN count(points) = count(*) THEN sum(points) END AS BIGINT) AS points,
         CAST(CASE WHEN count(goals_for) = count(*) THEN sum(goals_for) END AS BIGINT) AS goals_for,
         CAST(CASE WHEN count(goals_against) = count(*) THEN sum(goals_against) END AS BIGINT) AS goals_against
  FROM points30 GROUP BY SEASON_WYID, TEAM_WYID),
stand31 AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY SEASON_WYID ORDER BY points DESC NULLS LAST,
           goal_diff DESC NULLS LAST, goals_for DESC NULLS LAST, TEAM_WYID ASC NULLS LAST) AS INTEGER) AS rank
  FROM (SELECT *, goals_for - goals_against AS goal_diff FROM stand0)),
tb32 AS (
  SELECT *, CASE WHEN rank <= {K.TOP_GROUP_RANK} THEN '{K.TOP_GROUP_LABEL}'
                 WHEN NOT (rank <= {K.TOP_GROUP_RANK}) THEN '{K.BOTTOM_GROUP_LABEL}' END AS group_label
  FROM stand31),
assist_tags AS (
  SELECT s.EVENT_WYID FROM d_secondary s LEFT JOIN scoped m ON m.MATCH_WYID = s.MATCH_WYID
  WHERE s.PRIMARYTYPE = 'pass'
    AND (regexp_matches(SECONDARYTYPE1, 'shot_assist', 'i') OR regexp_matches(SECONDARYTYPE2, 'shot_assist', 'i')
         OR regexp_matches(SECONDARYTYPE3, 'shot_assist', 'i'))
    AND m.SEASON_WYID IN ({SEASONS}) AND lower(SECONDARYTYPE1) = 'assist'),
assist_ev AS (SELECT DISTINCT EVENT_WYID FROM assist_tags),
assists36 AS (SELECT lp.* FROM lp JOIN assist_tags USING (EVENT_WYID)),
minutes34 AS (
  SELECT lp.* REPLACE (c.MINUTE AS MINUTE) FROM lp LEFT JOIN d_common c ON c.EVENT_WYID = lp.EVENT_WYID
  WHERE c.MINUTE IS NOT NULL),
marked AS (
  SELECT lp.*, coalesce(lp.EVENT_WYID IN (SELECT EVENT_WYID FROM assist_ev), false) AS is_assist FROM lp),
pline AS (
  SELECT PLAYER_WYID AS player_id, ROLENAME AS role, SHORTNAME AS shortname,
         CASE WHEN regexp_matches(ROLENAME, 'Defend', 'i') THEN 'Forsvar'
              WHEN regexp_matches(ROLENAME, 'Midfield', 'i') THEN 'Midtbane'
              WHEN regexp_matches(ROLENAME, 'Forward|Striker|Wing', 'i') THEN 'Angreb'
              ELSE '{K.UNKNOWN_LINE}' END AS line
  FROM d_players),
pline_once AS (
  SELECT * FROM pline
  QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY role NULLS LAST, shortname NULLS LAST) = 1),
with_line AS (
  SELECT m.*, l.line FROM marked m LEFT JOIN pline l ON m.PLAYER_WYID = l.player_id
  WHERE l.line IS NOT NULL AND l.line <> '{K.UNKNOWN_LINE}'),
with_line_once AS (
  SELECT m.*, l.line FROM marked m JOIN pline_once l ON m.PLAYER_WYID = l.player_id WHERE l.line <> '{K.UNKNOWN_LINE}'),
club_m AS (SELECT DISTINCT MATCH_WYID, SEASON_WYID FROM goals29 WHERE TEAM_WYID = {CLUB}),
plotdata AS (
  SELECT s.MATCH_WYID, s.EVENT_WYID, s.TEAM_WYID, t.TEAMNAME, k.LOCATIONX AS x, k.LOCATIONY AS y, s.outcome AS is_goal
  FROM shots_cpf s JOIN coords k ON k.EVENT_WYID = s.EVENT_WYID LEFT JOIN teams1 t ON t.TEAM_WYID = s.TEAM_WYID)"""


def _bins_case(x: str, breaks, include_lowest: bool = True) -> tuple[str, str]:
    labels = interval_labels(breaks, include_lowest)
    idx, lab = [], []
    for i in range(1, len(breaks)):
        lo, hi = breaks[i - 1], breaks[i]
        lower = f"{x} >= {_dbl(lo)}" if (i == 1 and include_lowest) else f"{x} > {_dbl(lo)}"
        cond = f"{lower} AND {x} <= {_dbl(hi)}"
        idx.append(f"WHEN {cond} THEN {i}")
        lab.append(f"WHEN {cond} THEN '{labels[i - 1]}'")
    return "CASE " + " ".join(idx) + " END", "CASE " + " ".join(lab) + " END"


def _angle_case(x: str) -> tuple[str, str]:
    b = K.ANGLE_BREAKS
    labels = interval_labels(b)
    idx, lab = [], []
    for i in range(1, len(b)):
        cond = f"{x} > {_dbl(b[i - 1])}" if i == len(b) - 1 else f"{x} <= {_dbl(b[i])}"
        idx.append(f"WHEN {cond} THEN {i}")
        lab.append(f"WHEN {cond} THEN '{labels[i - 1]}'")
    return "CASE " + " ".join(idx) + " END", "CASE " + " ".join(lab) + " END"


def _zone(x: str) -> str:
    return f"CAST(round_even({x} / 10, 0) * 10 AS BIGINT)"


def _pct(n: str, d: str) -> str:
    return f"{n} / nullif({d}, 0) * 100"


def _conv(src: str, idx: str, lab: str, name: str, extra_agg: str = "", extra_out: str = "",
          having: str = "") -> str:
    return (f"SELECT bin_idx, {name}, shots, goals, {_pct('goals', 'shots')} AS goal_pct{extra_out} "
            f"FROM (SELECT {idx} AS bin_idx, {lab} AS {name}, count(*) AS shots, "
            f"CAST(coalesce(sum(total_goal), 0) AS BIGINT) AS goals{extra_agg} "
            f"FROM {src} GROUP BY 1, 2 {having})")


_D_IDX, _D_LAB = _bins_case("distance_m", seq_breaks(0.0, K.DISTANCE_BIN_MAX, K.DISTANCE_BIN_STEP))
_X_IDX, _X_LAB = _bins_case("SHOTXG", seq_breaks(0.0, K.XG_BIN_MAX, K.XG_BIN_STEP))
_M_IDX, _M_LAB = _bins_case("CAST(MINUTE AS DOUBLE)", K.MINUTE_BREAKS)
_A_IDX, _A_LAB = _angle_case("angle_deg_m")
_ANGLE_OK = "isfinite(angle_deg_m) AND angle_deg_m >= 0 AND angle_deg_m <= 180"
_LT = f"coalesce(LOCATIONX > {_dbl(K.LAST_THIRD_X)}, false)"

def _team_rates(src: str, succ: str) -> str:
    return (f"SELECT TEAM_WYID, total, success, {_pct('success', 'total')} AS success_rate FROM "
            f"(SELECT TEAM_WYID, count(*) AS total, count_if({succ}) AS success FROM {src} GROUP BY TEAM_WYID)")


_Q10 = (f"SELECT r.TEAM_WYID, t.TEAMNAME, r.total, r.success, r.success_rate FROM ({_team_rates('lp', 'success')}) r "
        f"LEFT JOIN teams1 t ON t.TEAM_WYID = r.TEAM_WYID")
_Q13_ALL = (f"SELECT r.TEAM_WYID, t.TEAMNAME, r.total, r.success, r.success_rate FROM "
            f"({_team_rates('(SELECT * FROM lp WHERE ' + _LT + ')', 'success')}) r "
            f"LEFT JOIN teams1 t ON t.TEAM_WYID = r.TEAM_WYID "
            f"ORDER BY r.success_rate DESC NULLS LAST, r.TEAM_WYID ASC NULLS LAST")
_Q13 = _Q13_ALL + " LIMIT 3"
_Q34 = (f"SELECT SEASON_WYID, period, total_passes, success_passes, {_pct('success_passes', 'total_passes')} AS success_rate "
        f"FROM (SELECT SEASON_WYID, CASE WHEN MINUTE >= {K.LATE_MINUTE} THEN '{K.LATE_PERIOD_LABEL}' "
        f"WHEN NOT (MINUTE >= {K.LATE_MINUTE}) THEN '{K.EARLY_PERIOD_LABEL}' END AS period, "
        f"count(*) AS total_passes, count_if(success) AS success_passes FROM minutes34 GROUP BY 1, 2)")
_Q34_ONE = _Q34.replace("FROM minutes34", "FROM lp WHERE MINUTE IS NOT NULL")
_Q37 = ("SELECT a.TEAM_WYID, t.TEAMNAME, a.mean_length, a.n FROM (SELECT TEAM_WYID, avg(LENGTH) AS mean_length, "
        "count(*) AS n FROM assists36 GROUP BY TEAM_WYID) a LEFT JOIN teams1 t ON t.TEAM_WYID = a.TEAM_WYID")

_LINES = (f"SELECT scope, line, total_passes, total_assist, total_assist / nullif(total_passes, 0) AS assist_rate FROM ("
          f"SELECT scope, line, count(*) AS total_passes, count_if(is_assist) AS total_assist FROM ("
          f"SELECT 'league' AS scope, * FROM with_line UNION ALL "
          f"SELECT 'club' AS scope, * FROM with_line WHERE TEAM_WYID = {CLUB}) GROUP BY 1, 2)")

_Q45 = (
    f"SELECT c.MATCH_WYID, c.TEAM_WYID, t.TEAMNAME, c.outcome, c.n, "
    f"c.n / sum(c.n) OVER (PARTITION BY c.MATCH_WYID, t.TEAMNAME) * 100 AS pct, "
    f"CASE WHEN c.TEAM_WYID = {CLUB} THEN '{K.CLUB_SIDE_LABEL}' WHEN NOT (c.TEAM_WYID = {CLUB}) "
    f"THEN '{K.OPPONENT_SIDE_LABEL}' END AS is_fcn "
    f"FROM (SELECT MATCH_WYID, TEAM_WYID, CASE WHEN success THEN '{K.PASS_HIT_LABEL}' WHEN NOT success "
    f"THEN '{K.PASS_MISS_LABEL}' END AS outcome, count(*) AS n FROM lp "
    f"WHERE MATCH_WYID IN (SELECT MATCH_WYID FROM club_m) GROUP BY 1, 2, 3) c "
    f"LEFT JOIN teams1 t ON t.TEAM_WYID = c.TEAM_WYID")

# query name -> (final SELECT, its double columns)
QUERIES: dict[str, tuple[str, tuple[str, ...]]] = {
    "match_scope": ("SELECT * FROM scoped", ()),
    "pass_enrichment": ("SELECT * FROM pe", ("LENGTH", "ENDLOCATIONX", "ENDLOCATIONY", "LOCATIONX", "LOCATIONY")),
    "successful_passes": (
        f"SELECT * FROM pe WHERE SEASON_WYID IN ({SEASONS}) AND PLAYER_WYID <> 0 AND RECIPIENT_WYID <> 0 "
        f"AND coalesce(PRIMARYTYPE = 'pass', false) "
        f"AND EXISTS (SELECT 1 FROM passers q WHERE q.team = pe.TEAM_WYID AND q.passer = pe.RECIPIENT_WYID)",
        ("LENGTH", "ENDLOCATIONX", "ENDLOCATIONY", "LOCATIONX", "LOCATIONY")),
    "valid_passes": (
        f"SELECT * FROM pe WHERE SEASON_WYID IN ({SEASONS}) AND PLAYER_WYID <> 0 AND RECIPIENT_WYID <> 0 "
        f"AND coalesce(PRIMARYTYPE = 'pass', false)",
        ("LENGTH", "ENDLOCATIONX", "ENDLOCATIONY", "LOCATIONX", "LOCATIONY")),
    "pass_outcome_share": (
        f"WITH a AS (SELECT count_if(in_league) AS lt, count_if(success_row) AS ls, count_if(in_club) AS ct, "
        f"count_if(success_row AND TEAM_WYID = {CLUB}) AS cs FROM sp) "
        f"SELECT 'club' AS scope, 'successful' AS outcome, cs AS n, {_pct('cs', 'ct')} AS pct, ct AS total FROM a "
        f"UNION ALL SELECT 'club', 'unsuccessful', ct - cs, {_pct('(ct - cs)', 'ct')}, ct FROM a "
        f"UNION ALL SELECT 'league', 'successful', ls, {_pct('ls', 'lt')}, lt FROM a "
        f"UNION ALL SELECT 'league', 'unsuccessful', lt - ls, {_pct('(lt - ls)', 'lt')}, lt FROM a",
        ("pct",)),
    "pass_length_by_scope": (
        f"WITH a AS (SELECT avg(CASE WHEN in_league THEN LENGTH END) AS la, avg(CASE WHEN success_row THEN LENGTH END) AS ls, "
        f"avg(CASE WHEN in_club THEN LENGTH END) AS ca, "
        f"avg(CASE WHEN success_row AND TEAM_WYID = {CLUB} THEN LENGTH END) AS cs FROM sp) "
        f"SELECT 'league' AS scope, 'all' AS pass_set, la AS avg_length FROM a "
        f"UNION ALL SELECT 'league', 'successful', ls FROM a UNION ALL SELECT 'club', 'all', ca FROM a "
        f"UNION ALL SELECT 'club', 'successful', cs FROM a",
        ("avg_length",)),
    "pass_zone_frequency": (
        f"SELECT scope, zone, count(*) AS n FROM ("
        f"SELECT scope, coalesce(CAST({_zone('ENDLOCATIONX')} AS VARCHAR), 'NA') || '-' || "
        f"coalesce(CAST({_zone('ENDLOCATIONY')} AS VARCHAR), 'NA') AS zone FROM ("
        f"SELECT 'league' AS scope, * FROM sp WHERE in_league UNION ALL SELECT 'club' AS scope, * FROM sp WHERE in_club)) "
        f"GROUP BY scope, zone",
        ()),
    "top_pass_zones": (
        f"SELECT scope, zone_x, zone_y, n, pct, rank FROM ("
        f"SELECT *, n / sum(n) OVER (PARTITION BY scope) * 100 AS pct, CAST(row_number() OVER (PARTITION BY scope "
        f"ORDER BY n DESC NULLS LAST, zone_x ASC NULLS LAST, zone_y ASC NULLS LAST) AS INTEGER) AS rank FROM ("
        f"SELECT scope, {_zone('ENDLOCATIONX')} AS zone_x, {_zone('ENDLOCATIONY')} AS zone_y, count(*) AS n FROM ("
        f"SELECT 'league' AS scope, * FROM sp WHERE in_league UNION ALL SELECT 'club' AS scope, * FROM sp WHERE in_club) "
        f"GROUP BY 1, 2, 3)) WHERE rank <= 3",
        ("pct",)),
    "passes_leading_to_shot": (
        f"WITH lg AS (SELECT MATCH_WYID, EVENT_WYID, TEAM_WYID, PRIMARYTYPE FROM d_event_log WHERE SEASON_WYID IN ({SEASONS})), "
        f"nx AS (SELECT *, lead(TEAM_WYID) OVER w AS next_team, lead(PRIMARYTYPE) OVER w AS next_type FROM lg "
        f"WINDOW w AS (ORDER BY MATCH_WYID ASC NULLS LAST, EVENT_WYID ASC NULLS LAST, TEAM_WYID ASC NULLS LAST, "
        f"PRIMARYTYPE ASC NULLS LAST)), "
        f"pairs AS (SELECT * FROM nx WHERE PRIMARYTYPE = 'pass' AND next_type = 'shot' AND TEAM_WYID = next_team), "
        f"h AS (SELECT 'club' AS scope, count_if(TEAM_WYID = {CLUB}) AS n FROM pairs UNION ALL "
        f"SELECT 'league', count(*) FROM pairs), "
        f"t AS (SELECT 'club' AS scope, count_if(in_club) AS n FROM sp UNION ALL SELECT 'league', count_if(in_league) FROM sp) "
        f"SELECT h.scope, h.n AS passes_to_shots, t.n AS total_passes, {_pct('h.n', 't.n')} AS pct "
        f"FROM h JOIN t ON h.scope = t.scope",
        ("pct",)),
    "team_pass_success": (
        f"SELECT * FROM ({_Q10}) ORDER BY success_rate ASC NULLS LAST, TEAM_WYID ASC NULLS LAST", ("success_rate",)),
    "bottom3_pass_success": (
        f"SELECT * FROM ({_Q10}) ORDER BY success_rate ASC NULLS LAST, TEAM_WYID ASC NULLS LAST LIMIT 3",
        ("success_rate",)),
    "top3_pass_success": (
        f"SELECT * FROM ({_Q10}) ORDER BY success_rate DESC NULLS LAST, TEAM_WYID ASC NULLS LAST LIMIT 3",
        ("success_rate",)),
    "last_third_summary": (
        f"WITH a AS (SELECT count_if(in_club) AS ct, count_if(success_row AND TEAM_WYID = {CLUB}) AS cs, "
        f"count_if(in_league) AS lt, count_if(success_row) AS ls FROM sp WHERE {_LT}) "
        f"SELECT 'club' AS scope, ct AS total, cs AS success, {_pct('cs', 'ct')} AS success_rate FROM a "
        f"UNION ALL SELECT 'league', lt, ls, {_pct('ls', 'lt')} FROM a",
        ("success_rate",)),
    "last_third_by_team": (_Q13, ("success_rate",)),
    "accuracy_flag_success": (_team_rates("lp", "ACCURATE = 1"), ("success_rate",)),
    "shots_by_season": ("SELECT * FROM shots15", ("SHOTXG",)),
    "shot_exclusion_audit": (
        f"SELECT count(*) AS n_before, count_if(NOT coalesce(PRIMARYTYPE IN ({SETP}), false)) AS n_after, "
        f"count_if(coalesce(PRIMARYTYPE IN ({SETP}), false)) AS removed FROM shots15",
        ()),
    "goal_flag": ("SELECT * EXCLUDE (outcome) FROM shots_cpf", ("SHOTXG",)),
    "goal_share": (
        "SELECT outcome, n, n / sum(n) OVER () * 100 AS pct FROM (SELECT outcome, count(*) AS n FROM shots_cpf GROUP BY 1)",
        ("pct",)),
    "shot_coordinates": ("SELECT * FROM coords", ("LOCATIONX", "LOCATIONY")),
    "shot_distance_mean": ("SELECT outcome, avg(distance_m) AS mean_distance_m FROM geo GROUP BY 1", ("mean_distance_m",)),
    "shot_angle_mean": (
        f"SELECT outcome, avg(angle_deg_m) AS mean_angle_m FROM geo WHERE {_ANGLE_OK} GROUP BY 1", ("mean_angle_m",)),
    "xg_on_target": (
        "SELECT outcome, avg(SHOTXG) AS mean_xg, count(*) AS n FROM shots_cpf "
        "WHERE SHOTONTARGET = 1 AND SHOTXG IS NOT NULL GROUP BY 1",
        ("mean_xg",)),
    "conversion_by_distance": (_conv("geo", _D_IDX, _D_LAB, "distance_bin"), ("goal_pct",)),
    "conversion_by_angle": (_conv(f"(SELECT * FROM geo WHERE {_ANGLE_OK})", _A_IDX, _A_LAB, "angle_bin"), ("goal_pct",)),
    "conversion_by_xg": (
        _conv("(SELECT * FROM shots_cpf WHERE SHOTXG IS NOT NULL)", _X_IDX, _X_LAB, "xg_bin",
              extra_agg=", avg(SHOTXG) AS mean_xg", extra_out=", mean_xg", having=f"HAVING count(*) >= {P.min_bin_shots}"),
        ("goal_pct", "mean_xg")),
    "conversion_by_minute": (
        _conv("(SELECT s.*, m.MINUTE FROM shots_cpf s LEFT JOIN shot_min m ON m.EVENT_WYID = s.EVENT_WYID "
              "WHERE m.MINUTE IS NOT NULL)", _M_IDX, _M_LAB, "time_bin"),
        ("goal_pct",)),
    "shot_precision": (
        f"WITH a AS (SELECT count(*) AS total_shots, count_if(SHOTONTARGET = 1) AS on_target, "
        f"count_if(SHOTONTARGET = 0) AS off_target FROM shots_cpf), "
        f"l AS (SELECT total_shots, '{K.ON_TARGET_LABEL}' AS outcome, on_target AS count FROM a "
        f"UNION ALL SELECT total_shots, '{K.OFF_TARGET_LABEL}', off_target FROM a) "
        f"SELECT *, count / sum(count) OVER () * 100 AS pct FROM l",
        ("pct",)),
    "match_overview": ("SELECT * FROM d_matches", ()),
    "match_goals": ("SELECT * FROM goals29", ()),
    "match_points": ("SELECT * FROM points30", ()),
    "standings": ("SELECT * FROM stand31", ()),
    "top_bottom_groups": ("SELECT * FROM tb32", ()),
    "passes_top_vs_bottom": (
        "SELECT SEASON_WYID, group_label, total_passes, total_passes / nullif(matches, 0) AS avg_passes_per_match, "
        "avg_length, success_rate FROM (SELECT l.SEASON_WYID, t.group_label, count(*) AS total_passes, "
        "count(DISTINCT l.MATCH_WYID) + max(CASE WHEN l.MATCH_WYID IS NULL THEN 1 ELSE 0 END) AS matches, "
        "avg(l.LENGTH) AS avg_length, avg(CAST(l.success AS DOUBLE)) * 100 AS success_rate "
        "FROM lp l LEFT JOIN tb32 t ON t.TEAM_WYID = l.TEAM_WYID AND t.SEASON_WYID = l.SEASON_WYID GROUP BY 1, 2)",
        ("avg_passes_per_match", "avg_length", "success_rate")),
    "late_game_passes": (_Q34, ("success_rate",)),
    "late_game_share": (
        f"SELECT SEASON_WYID, period, total_passes, total_passes / sum(total_passes) OVER (PARTITION BY SEASON_WYID) * 100 "
        f"AS share_pct FROM ({_Q34})",
        ("share_pct",)),
    "late_game_success_share": (
        f"SELECT SEASON_WYID, period, success_passes, success_passes / sum(success_passes) OVER (PARTITION BY SEASON_WYID) "
        f"* 100 AS success_pct FROM ({_Q34})",
        ("success_pct",)),
    "shot_assists": (
        "SELECT EVENT_WYID, MATCH_WYID, SEASON_WYID, TEAM_WYID, PLAYER_WYID, RECIPIENT_WYID, LENGTH FROM assists36",
        ("LENGTH",)),
    "shot_assists_once": (
        "SELECT EVENT_WYID, MATCH_WYID, SEASON_WYID, TEAM_WYID, PLAYER_WYID, RECIPIENT_WYID, LENGTH FROM marked "
        "WHERE is_assist",
        ("LENGTH",)),
    "late_game_passes_one_minute": (_Q34_ONE, ("success_rate",)),
    "match_goals_one_row": (
        "SELECT a.MATCH_WYID, a.TEAM_WYID, a.goals_for, b.goals_for AS goals_against, a.SEASON_WYID "
        "FROM side a JOIN side b ON a.MATCH_WYID = b.MATCH_WYID AND a.TEAM_WYID <> b.TEAM_WYID", ()),
    "valid_passes_club": (
        f"SELECT * FROM pe WHERE SEASON_WYID IN ({SEASONS}) AND PLAYER_WYID <> 0 AND RECIPIENT_WYID <> 0 "
        f"AND TEAM_WYID = {CLUB}",
        ("LENGTH", "ENDLOCATIONX", "ENDLOCATIONY", "LOCATIONX", "LOCATIONY")),
    "last_third_all_teams": (_Q13_ALL, ("success_rate",)),
    "assist_totals": (
        "SELECT b.PLAYER_WYID, b.TEAM_WYID, p.SHORTNAME, t.TEAMNAME AS team, b.assists FROM ("
        "SELECT PLAYER_WYID, TEAM_WYID, CAST(coalesce(sum(PLAYERASSISTS), 0) AS BIGINT) AS assists "
        "FROM d_player_stats WHERE MATCH_WYID IN (SELECT DISTINCT MATCH_WYID FROM lp) GROUP BY 1, 2) b "
        "LEFT JOIN players1 p ON p.PLAYER_WYID = b.PLAYER_WYID LEFT JOIN teams1 t ON t.TEAM_WYID = b.TEAM_WYID", ()),
    "all_scorers_xg": (
        "SELECT b.PLAYER_WYID, p.SHORTNAME AS player_name, b.goals, b.xg FROM ("
        "SELECT PLAYER_WYID, CAST(coalesce(sum(total_goal), 0) AS BIGINT) AS goals, "
        f"coalesce({_sum('SHOTXG')}, 0) AS xg FROM shots_cpf GROUP BY 1) b "
        "LEFT JOIN players1 p ON p.PLAYER_WYID = b.PLAYER_WYID ORDER BY b.goals DESC NULLS LAST, b.PLAYER_WYID NULLS LAST",
        ("xg",)),
    "match_shots_of_one": (f"SELECT * FROM plotdata WHERE MATCH_WYID = {SHOT_MATCH}", ("x", "y")),
    "pass_outcome_share_typed_club": (
        f"WITH a AS (SELECT count_if(in_league) AS lt, count_if(success_row) AS ls, count_if(in_club AND in_league) AS ct, "
        f"count_if(success_row AND TEAM_WYID = {CLUB}) AS cs FROM sp) "
        f"SELECT 'club' AS scope, 'successful' AS outcome, cs AS n, {_pct('cs', 'ct')} AS pct, ct AS total FROM a "
        f"UNION ALL SELECT 'club', 'unsuccessful', ct - cs, {_pct('(ct - cs)', 'ct')}, ct FROM a "
        f"UNION ALL SELECT 'league', 'successful', ls, {_pct('ls', 'lt')}, lt FROM a "
        f"UNION ALL SELECT 'league', 'unsuccessful', lt - ls, {_pct('(lt - ls)', 'lt')}, lt FROM a",
        ("pct",)),
    "assist_length_by_team": (_Q37, ("mean_length",)),
    "assist_length_top3": (
        f"SELECT * FROM ({_Q37}) ORDER BY mean_length DESC NULLS LAST, TEAM_WYID ASC NULLS LAST LIMIT 3", ("mean_length",)),
    "assist_length_bottom3": (
        f"SELECT * FROM ({_Q37}) ORDER BY mean_length ASC NULLS LAST, TEAM_WYID ASC NULLS LAST LIMIT 3", ("mean_length",)),
    "assist_length_overall": (
        f"WITH a AS (SELECT avg(LENGTH) AS la, count(*) AS ln, avg(CASE WHEN TEAM_WYID = {CLUB} THEN LENGTH END) AS ca, "
        f"count_if(TEAM_WYID = {CLUB}) AS cn FROM assists36) "
        f"SELECT 'club' AS scope, ca AS mean_length, cn AS n FROM a UNION ALL SELECT 'league', la, ln FROM a",
        ("mean_length",)),
    "assist_vs_other_length": (
        "SELECT is_assist, avg(LENGTH) AS mean_length, median(LENGTH) AS median_length, count(*) AS n "
        "FROM marked GROUP BY 1",
        ("mean_length", "median_length")),
    "assist_vs_other_length_club": (
        f"SELECT is_assist, avg(LENGTH) AS mean_length FROM marked WHERE TEAM_WYID = {CLUB} GROUP BY 1",
        ("mean_length",)),
    "assist_length_gap": (
        f"WITH a AS (SELECT avg(CASE WHEN is_assist THEN LENGTH END) - avg(CASE WHEN NOT is_assist THEN LENGTH END) AS lg, "
        f"avg(CASE WHEN is_assist AND TEAM_WYID = {CLUB} THEN LENGTH END) "
        f"- avg(CASE WHEN NOT is_assist AND TEAM_WYID = {CLUB} THEN LENGTH END) AS cl FROM marked) "
        f"SELECT 'club' AS scope, cl AS difference FROM a UNION ALL SELECT 'league', lg FROM a",
        ("difference",)),
    "player_line": ("SELECT * FROM pline", ()),
    "player_line_one_row": ("SELECT * FROM pline_once", ()),
    "assist_rate_by_line_one_row": (_LINES.replace("with_line", "with_line_once"), ("assist_rate",)),
    "assist_rate_by_line": (_LINES, ("assist_rate",)),
    "assist_distribution": (
        "SELECT line, assists, assists / sum(assists) OVER () AS share FROM ("
        "SELECT line, count(*) AS assists FROM with_line WHERE is_assist GROUP BY 1)",
        ("share",)),
    "top_assist_players": (
        f"WITH tot AS (SELECT PLAYER_WYID, TEAM_WYID, CAST(coalesce(sum(PLAYERASSISTS), 0) AS BIGINT) AS assists "
        f"FROM d_player_stats WHERE MATCH_WYID IN (SELECT DISTINCT MATCH_WYID FROM lp) GROUP BY 1, 2), "
        f"best AS (SELECT * FROM tot ORDER BY assists DESC NULLS LAST, PLAYER_WYID ASC NULLS LAST, "
        f"TEAM_WYID ASC NULLS LAST LIMIT 10) "
        f"SELECT b.PLAYER_WYID, b.TEAM_WYID, p.SHORTNAME, t.TEAMNAME AS team, b.assists FROM best b "
        f"LEFT JOIN players1 p ON p.PLAYER_WYID = b.PLAYER_WYID LEFT JOIN teams1 t ON t.TEAM_WYID = b.TEAM_WYID",
        ()),
    "top_scorers_xg": (
        f"WITH tot AS (SELECT PLAYER_WYID, CAST(coalesce(sum(total_goal), 0) AS BIGINT) AS goals, "
        f"coalesce({_sum('SHOTXG')}, 0) AS xg FROM shots_cpf GROUP BY 1), "
        f"best AS (SELECT * FROM tot ORDER BY goals DESC NULLS LAST, PLAYER_WYID ASC NULLS LAST LIMIT {P.top_n}) "
        f"SELECT b.PLAYER_WYID, p.SHORTNAME AS player_name, b.goals, b.xg FROM best b "
        f"LEFT JOIN players1 p ON p.PLAYER_WYID = b.PLAYER_WYID",
        ("xg",)),
    "club_matches": (
        "SELECT DISTINCT MATCH_WYID, MATCHLABEL FROM d_matches WHERE MATCH_WYID IN (SELECT MATCH_WYID FROM club_m)", ()),
    "match_pass_outcomes_of_one": (f"SELECT * FROM ({_Q45}) WHERE MATCH_WYID = {CLUB_MATCH}", ("pct",)),
    "match_pass_outcomes": (_Q45, ("pct",)),
    "match_list_with_goals": (
        f"SELECT m.*, CAST(coalesce(g.goals, 0) AS BIGINT) AS goals_in_shots, "
        f"coalesce(m.MATCHLABEL, 'NA') || ' (' || coalesce(CAST(m.SEASON_WYID AS VARCHAR), 'NA') || ')' AS label_with_season "
        f"FROM d_matches m LEFT JOIN (SELECT MATCH_WYID, count(*) AS goals FROM plotdata WHERE is_goal = '{GOAL}' "
        f"GROUP BY 1) g ON g.MATCH_WYID = m.MATCH_WYID WHERE m.SEASON_WYID IN ({SEASONS})",
        ()),
    "match_shots": ("SELECT * FROM plotdata", ("x", "y")),
}
QUERIES |= {f"sql_{name}": QUERIES[name] for name in ("match_goals", "standings", "club_matches")}


def _calls(sql: str, forms: dict) -> str:
    """Write every call ``name(x)`` as ``forms[name](x)``: counts as BIGINT (DuckDB's count_if gives
    HUGEINT), means exactly."""
    for name, form in forms.items():
        out, i, token = [], 0, f"{name}("
        while (j := sql.find(token, i)) >= 0:
            depth, k = 1, j + len(token)
            while depth:
                depth += {"(": 1, ")": -1}.get(sql[k], 0)
                k += 1
            out.append(sql[i:j] + form(sql[j + len(token):k - 1]))
            i = k
        sql = "".join([*out, sql[i:]])
    return sql


def _wrap(select: str, rounded: tuple[str, ...]) -> str:
    if not rounded:
        head = select.lstrip()
        return f"WITH {BASE},{DERIVED},\n{head[5:]}" if head.upper().startswith("WITH ") \
            else f"WITH {BASE},{DERIVED}\n{select}"
    rep = ", ".join(f"round({c}, 6) AS {c}" for c in rounded)
    return f"WITH {BASE},{DERIVED}\nSELECT * REPLACE ({rep}) FROM (\n{select}\n) AS q"


def oracle_sql() -> dict[str, str]:
    return {name: _calls(_wrap(sel, ("mean_angle_m",) if "mean_angle_m" in dbl else ()), {
        "count_if": lambda x: f"CAST(count_if({x}) AS BIGINT)", "avg": _mean}) for name, (sel, dbl) in QUERIES.items()}
