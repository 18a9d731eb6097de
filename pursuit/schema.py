"""Table schemas and the fixed values shared by every operator."""

from pyspark.sql import types as T

PLAY = ["game_id", "play_id"]
KEY = PLAY + ["nfl_id"]
FRAME = KEY + ["frame_id"]

# The 23 tracking input columns, with their types.
INPUT_SCHEMA = T.StructType([
    T.StructField("game_id", T.LongType()),
    T.StructField("play_id", T.LongType()),
    T.StructField("player_to_predict", T.BooleanType()),
    T.StructField("nfl_id", T.LongType()),
    T.StructField("frame_id", T.LongType()),
    T.StructField("play_direction", T.StringType()),
    T.StructField("absolute_yardline_number", T.LongType()),
    T.StructField("player_name", T.StringType()),
    T.StructField("player_height", T.StringType()),
    T.StructField("player_weight", T.LongType()),
    T.StructField("player_birth_date", T.StringType()),
    T.StructField("player_position", T.StringType()),
    T.StructField("player_side", T.StringType()),
    T.StructField("player_role", T.StringType()),
    T.StructField("x", T.DoubleType()),
    T.StructField("y", T.DoubleType()),
    T.StructField("s", T.DoubleType()),
    T.StructField("a", T.DoubleType()),
    T.StructField("dir", T.DoubleType()),
    T.StructField("o", T.DoubleType()),
    T.StructField("num_frames_output", T.LongType()),
    T.StructField("ball_land_x", T.DoubleType()),
    T.StructField("ball_land_y", T.DoubleType()),
])
OUTPUT_SCHEMA = T.StructType([
    T.StructField("game_id", T.LongType()),
    T.StructField("play_id", T.LongType()),
    T.StructField("nfl_id", T.LongType()),
    T.StructField("frame_id", T.LongType()),
    T.StructField("x", T.DoubleType()),
    T.StructField("y", T.DoubleType()),
])
PREDICTION_SCHEMA = T.StructType([
    T.StructField("game_id", T.LongType()),
    T.StructField("play_id", T.LongType()),
    T.StructField("nfl_id", T.LongType()),
    T.StructField("frame_id", T.LongType()),
    T.StructField("x_pred", T.DoubleType()),
    T.StructField("y_pred", T.DoubleType()),
    T.StructField("sd_x", T.DoubleType()),
    T.StructField("sd_y", T.DoubleType()),
    T.StructField("fold", T.LongType()),
])

# Raw context column -> (short name, type).
CONTEXT_COLUMNS = {
    "game_id": ("game_id", "long"),
    "play_id": ("play_id", "long"),
    "week": ("week", "long"),
    "home_team_abbr": ("home", "string"),
    "visitor_team_abbr": ("away", "string"),
    "possession_team": ("off", "string"),
    "defensive_team": ("team", "string"),
    "play_description": ("desc", "string"),
    "quarter": ("q", "long"),
    "game_clock": ("clock", "string"),
    "down": ("down", "long"),
    "yards_to_go": ("dist", "long"),
    "pass_result": ("result", "string"),
    "route_of_targeted_receiver": ("route", "string"),
    "team_coverage_man_zone": ("mz", "string"),
    "team_coverage_type": ("cov", "string"),
    "expected_points_added": ("epa", "double"),
}

# Field, clock and role vocabulary.
FIELD_X, FIELD_Y = 120.0, 53.3
SECONDS_PER_FRAME = 0.1
RECEIVER, DEFENDER, PASSER, RUNNER = "Targeted Receiver", "Defensive Coverage", "Passer", "Other Route Runner"
ROLES = [PASSER, RECEIVER, DEFENDER, RUNNER]
DIRECTIONS = ["left", "right"]

# Position -> rating group; every other position rates with the linebackers.
RATING_GROUPS = {"CB": ["CB", "DB"], "S": ["FS", "SS", "S"]}
OTHER_GROUP = "LB"
# Position -> feature class; every other position is class 6.
FEATURE_CLASSES = {
    0: ["QB"],
    1: ["RB", "FB"],
    2: ["WR"],
    3: ["TE"],
    4: ["CB", "FS", "SS", "S", "DB"],
    5: ["ILB", "MLB", "OLB", "LB"],
}
OTHER_CLASS = 6

# Model window, folds and rating rules.
HISTORY, HORIZON = 20, 40
N_FOLDS = 5
MIN_PLAYS = 30
TEAM_PLAYS = 10
CENTERING = [["air", "role", "grp"], ["route"]]
GATED = ["cov", "mz", "start", "route", "air", "role", "grp"]
REPORTED = ["result", "team"]
RULES = {
    "cell_rows": 100, "cell_share": 0.25, "half_plays": 15, "half_players": 30,
    "reliability": 0.4, "league_mean": 0.02, "excluded_share": 0.15,
}
HIGHLIGHT_AIR = 15
MAX_ROWS, MAX_PLAYERS, MAX_FRAMES = 4000, 30, 100

# Play table column -> published short name, in published order.
PUBLISHED = {
    "game_id": "game", "play_id": "play", "week": "week", "nfl_id": "id", "name": "name", "pos": "pos",
    "grp": "grp", "team": "team", "cov": "cov", "mz": "mz", "route": "route", "result": "result", "epa": "epa",
    "frames": "air", "role": "role", "d0": "d0", "dexp": "dexp", "dact": "dact", "yards": "yards", "z": "z",
    "zc": "zc", "ex": "ex",
}
