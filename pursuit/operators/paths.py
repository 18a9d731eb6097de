"""Per-player frame sequences: the last input frame, the next frame, future frames and the arrival row."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pursuit.schema import FRAME, KEY

# A player's frames are walked in runs of this many, so one endless track is many groups and not one.
RUN = 4096

# What a player has in every frame of a play alike, and what changes from frame to frame.
CONSTANT = [
    "play_direction", "ball_land_x", "ball_land_y", "num_frames_output", "player_role", "player_position", "player_name",
]
MOVING = ["x", "y", "s", "dir"]


def per_player(rows: DataFrame, constant, moving=(), ends: str = "last") -> DataFrame:
    """One row per player: ``constant`` columns, and ``moving`` ones at the last or first frame, with that frame's id
    and the number of frames ``n``.

    Combines before the shuffle, so a player's frames never travel, and needs no sort: the constant columns are grouping
    keys and the moving ones numbers, which keeps the pass over the frames in hash maps. A second aggregate over what is
    left, one row per player, settles columns that were not constant after all."""
    at = F.col("frame_id")
    pick, edge = (F.max_by, F.max) if ends == "last" else (F.min_by, F.min)
    runs = rows.groupBy(*KEY, *constant).agg(
        *[pick(c, at).alias(c) for c in moving], edge(at).alias("frame_id"), F.count("*").alias("n"))
    one = runs.groupBy(*KEY).agg(
        pick(F.struct(*constant, *moving), at).alias("_row"), edge(at).alias("frame_id"), F.sum("n").alias("n"))
    return one.select(*KEY, "frame_id", "n", "_row.*")


def last_frame(inp: DataFrame, constant=CONSTANT, moving=MOVING) -> DataFrame:
    """One row per predicted player: the columns of the last input frame."""
    return per_player(inp.where("player_to_predict"), constant, moving).drop("n")


def with_next(frames: DataFrame, columns, by=KEY, order: str = "frame_id") -> DataFrame:
    """Adds ``next_<column>``, the value one frame later in the same ``by`` group, null at the end.

    Frames must be contiguous. The window runs over stretches of ``RUN`` frames; the first row of a stretch also
    closes the stretch before it, so no value is lost at the seam and no group is longer than ``RUN`` + 1 rows."""
    seam = (F.col(order) % RUN == 0) & (F.col(order) > 0)
    stretch = F.floor(F.col(order) / RUN)
    # the row itself is repeated at a seam: a union would make all frames twice
    runs = F.when(seam, F.array(stretch, stretch - 1)).otherwise(F.array(stretch))
    rows = frames.withColumn("_run", F.explode(runs))
    window = Window.partitionBy(*by, "_run").orderBy(order)
    ahead = rows.withColumns({f"next_{c}": F.lead(c).over(window) for c in columns})
    return ahead.where(F.col("_run") == stretch).drop("_run")


def future_frames(last: DataFrame) -> DataFrame:
    """One row per predicted player and air frame 1..num_frames_output; none where there is no air time."""
    one = F.lit(1).cast("long")
    k = F.sequence(one, F.greatest("num_frames_output", one))
    return last.drop("frame_id").where("num_frames_output >= 1").withColumn("frame_id", F.explode(k))


def arrivals(inp: DataFrame, out: DataFrame, pred: DataFrame) -> DataFrame:
    """Every predicted player at the throw, with the actual and the expected row of the arrival frame.

    The arrival frame is part of the join key, so both joins use one exchange of the small player side and no
    single player can make a task large."""
    constant = ["player_role", "player_position", "player_name", "num_frames_output", "ball_land_x", "ball_land_y"]
    last = last_frame(inp, constant, ["x", "y"]).drop("frame_id").withColumnsRenamed({"x": "x0", "y": "y0"})
    at = [*KEY, "num_frames_output"]
    actual = out.select(*KEY, F.col("frame_id").alias("num_frames_output"), "x", "y")
    expected = pred.select(
        *KEY, F.col("frame_id").alias("num_frames_output"), "x_pred", "y_pred", "sd_x", "sd_y", "fold"
    )
    return last.join(actual, at, "left").join(expected, at, "left")


def last_rows(frames: DataFrame, n: int) -> DataFrame:
    """The last ``n`` frames of every player; Spark drops the rest before the shuffle."""
    newest = Window.partitionBy(*KEY).orderBy(F.col("frame_id").desc())
    return frames.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= n).drop("_rn")


def first_rows(frames: DataFrame, n: int) -> DataFrame:
    oldest = Window.partitionBy(*KEY).orderBy("frame_id")
    return frames.withColumn("_rn", F.row_number().over(oldest)).where(F.col("_rn") <= n).drop("_rn")


def duplicates(rows: DataFrame, keys=FRAME) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
