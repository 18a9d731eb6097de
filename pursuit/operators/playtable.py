"""The play table: one row per flagged defender and play, with geometry, situation, context and exclusion."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pursuit.functions.geometry import distance
from pursuit.operators.expect import rating_group
from pursuit.operators.paths import arrivals
from pursuit.schema import DEFENDER, FIELD_X, FIELD_Y, HORIZON, KEY, PLAY, RECEIVER
from pursuit.staging import staged

# Expectations nearer to the ball than this use the line from the throw position.
NEAR_BALL = 1.0
TINY = 1e-9
CATCHABLE = 4.0

PLAY_TABLE = [
    *KEY, "week", "name", "pos", "grp", "team", "cov", "mz", "route", "result", "epa", "frames", "air", "role", "start",
    "d0", "dexp", "dact", "yards", "sdu", "z", "ex", "fold",
]


def geometry(rows: DataFrame) -> DataFrame:
    """Adds d0, dexp, dact, yards, sdu and z.

    Yards closer to the ball than expected, measured along the line from the expected position to the landing spot, and
    the expected spread along the same line. Needs x0, y0, x_pred, y_pred, sd_x, sd_y, x, y and the landing spot."""
    x, y, xp, yp, x0, y0, lx, ly = (F.col(c) for c in (
        "x", "y", "x_pred", "y_pred", "x0", "y0", "ball_land_x", "ball_land_y"))
    rows = rows.withColumns({
        "d0": distance(lx, ly, x0, y0), "dexp": distance(lx, ly, xp, yp), "dact": distance(x, y, lx, ly),
    })
    near = F.col("dexp") < NEAR_BALL
    rows = rows.withColumns({
        "_ux": F.when(near, (lx - x0) / (F.col("d0") + TINY)).otherwise((lx - xp) / (F.col("dexp") + TINY)),
        "_uy": F.when(near, (ly - y0) / (F.col("d0") + TINY)).otherwise((ly - yp) / (F.col("dexp") + TINY)),
    })
    along_x, along_y = F.col("sd_x") * F.col("_ux"), F.col("sd_y") * F.col("_uy")
    rows = rows.withColumns({
        "yards": (x - xp) * F.col("_ux") + (y - yp) * F.col("_uy"),
        "sdu": F.sqrt(along_x * along_x + along_y * along_y),
    })
    # a spread of zero gives an infinite score and no error; the finite-values check refuses it before publishing
    z = F.when(F.col("sdu") == 0, F.col("yards") * F.lit(float("inf"))).otherwise(
        F.try_divide(F.col("yards"), F.col("sdu")))
    return rows.withColumn("z", z).drop("_ux", "_uy")


def exclusion():
    """Why a play does not count, first reason first, or null; needs ``recv_dist``. Field limits are inside."""
    inside = F.col("ball_land_x").between(0, FIELD_X) & F.col("ball_land_y").between(0, FIELD_Y)
    return (
        F.when(F.col("num_frames_output") > HORIZON, f"over {HORIZON} frames")
        .when(~inside, "out of bounds")
        .when(F.col("recv_dist") > CATCHABLE, "not catchable")
    )


def air_bucket(frames):
    return F.when(frames <= 8, "5-8").when(frames <= 12, "9-12").when(frames <= 16, "13-16").otherwise("17-40")


def start_bucket(yards):
    return F.when(yards < 5, "0-5").when(yards < 10, "5-10").when(yards < 20, "10-20").otherwise("20+")


def play_table_of(arrived: DataFrame, context: DataFrame) -> DataFrame:
    """The play table from the arrival rows of all predicted players.

    The receiver's miss and the closest expectation come from one aggregate per play joined back on the play, so a play
    of any size combines before the shuffle and an oversized one is split by the adaptive skew join. Ties for the
    closest expectation are all primary, and plays are ranked before exclusions."""
    rows = geometry(arrived)
    defender = F.col("player_role") == DEFENDER
    per_play = rows.groupBy(*PLAY).agg(
        F.max(F.when(F.col("player_role") == RECEIVER, F.col("dact"))).alias("recv_dist"),
        F.min(F.when(defender, F.col("dexp"))).alias("_closest"),
    ).where("recv_dist IS NOT NULL")
    situation = context.select(*PLAY, "week", "team", "cov", "mz", "route", "result", "epa")
    table = rows.where(defender).join(per_play, PLAY).join(situation, PLAY, "left")
    return table.withColumns({
        "ex": exclusion(),
        "role": F.when(F.col("dexp") == F.col("_closest"), "primary").otherwise("help"),
        "air": air_bucket(F.col("num_frames_output")),
        "start": start_bucket(F.col("d0")),
        "grp": rating_group(F.col("player_position")),
    }).withColumnsRenamed({
        "player_name": "name", "player_position": "pos", "num_frames_output": "frames",
    }).select(*PLAY_TABLE)


def play_table(inp: DataFrame, out: DataFrame, pred: DataFrame, context: DataFrame) -> DataFrame:
    """Without checks; ``pursuit.plans.rate`` puts them between the steps. The arrival rows are staged, being read twice."""
    return play_table_of(staged(arrivals(inp, out, pred), "arrivals"), context)


def rated(table: DataFrame) -> DataFrame:
    return table.where(F.col("ex").isNull())


def exclusion_counts(table: DataFrame) -> DataFrame:
    return table.groupBy("ex").agg(F.count("*").alias("n"))
