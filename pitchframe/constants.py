"""Fixed values and parameter defaults.

Everything in the "Fixed values" block must equal what the original analysis uses,
otherwise labels, bins or geometry change. Everything below it is only a default and
is passed as a parameter by every public function.
"""

# ---------------------------------------------------------------------------
# Fixed values (must match the original analysis exactly)
# ---------------------------------------------------------------------------

# Pitch size in metres; event coordinates are percentages of it.
PITCH_LENGTH_M = 105.0
PITCH_WIDTH_M = 68.0
# Goal mouth width in metres (posts at PITCH_WIDTH_M / 2 +- GOAL_WIDTH_M / 2).
GOAL_WIDTH_M = 7.32

# Shot types dropped before any shot analytic (corner, free kick, penalty).
SET_PIECE_TYPES = ("corn", "free", "pena")

# Outcome labels.
GOAL_LABEL = "Mål"
NO_GOAL_LABEL = "Ikke mål"
ON_TARGET_LABEL = "Rammer målet"
OFF_TARGET_LABEL = "Rammer ikke målet"
PASS_HIT_LABEL = "Ramte"
PASS_MISS_LABEL = "Fejl"
CLUB_SIDE_LABEL = "FCN"
OPPONENT_SIDE_LABEL = "Modstander"
TOP_GROUP_LABEL = "Top 5"
BOTTOM_GROUP_LABEL = "Bund 5"
LATE_PERIOD_LABEL = "80+"
EARLY_PERIOD_LABEL = "0-79"

# Player role -> line of the team; patterns are case-insensitive and tried in order.
LINE_RULES = (
    ("Defend", "Forsvar"),
    ("Midfield", "Midtbane"),
    ("Forward|Striker|Wing", "Angreb"),
)
UNKNOWN_LINE = "Ukendt"

# Pass/shot type tags.
PASS_TYPE = "pass"
SHOT_TYPE = "shot"
SHOT_ASSIST_PATTERN = "shot_assist"
ASSIST_TAG = "assist"

# Bin edges.
DISTANCE_BIN_STEP = 5.0          # 0..60 m
DISTANCE_BIN_MAX = 60.0
XG_BIN_STEP = 0.05               # 0..1
XG_BIN_MAX = 1.0
MINUTE_BREAKS = (0.0, 15.0, 30.0, 45.0, 60.0, 75.0, 90.0, 120.0)
ANGLE_BREAKS = (0.0, 20.0, 40.0, 60.0, 80.0, 100.0, 120.0, 180.0)

# Thresholds.
LAST_THIRD_X = 66.7              # pass start x (percent of pitch length)
LATE_MINUTE = 80                 # minute >= 80 is late game
TOP_GROUP_RANK = 5               # rank <= 5 is the top group
ZONE_STEP = 10.0                 # pitch zone grid (percent)

# ---------------------------------------------------------------------------
# Defaults (real-data identifiers; always overridable)
# ---------------------------------------------------------------------------

DEFAULT_CLUB = 7458
DEFAULT_SEASONS = (191611, 189918)
DEFAULT_COMPETITIONS = (335, 328)
DEFAULT_SHOT_COMPETITION = 335
DEFAULT_DATE_FROM = "2024-07-19"
