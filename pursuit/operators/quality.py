"""Checks as DataFrames: each returns its violations, so a caller can count, store or refuse them."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pursuit.operators.paths import duplicates, with_next
from pursuit.schema import DIRECTIONS, FRAME, INPUT_SCHEMA, KEY, OUTPUT_SCHEMA, PLAY, RECEIVER, SECONDS_PER_FRAME


class ValidationError(ValueError):
    """The first check that failed, with the number of violations and one example."""


def raise_first(checks) -> None:
    """Refuse the data at the first ``(message, violations)`` pair that is not empty; one aggregate row per check."""
    for message, violations in checks:
        row = violations.agg(F.count("*").alias("n"), F.first(F.struct("*")).alias("example")).first()
        if row.n:
            raise ValidationError(f"{row.n} {message}, first {tuple(row.example)}")


def require_columns(inp: DataFrame, out: DataFrame) -> None:
    for name, df, schema in (("input", inp, INPUT_SCHEMA), ("output", out, OUTPUT_SCHEMA)):
        missing = sorted(set(schema.names) - set(df.columns))
        if missing:
            raise ValidationError(f"{name} is missing columns {missing}")


def domain_violations(inp: DataFrame) -> DataFrame:
    """Rows whose direction is neither left nor right; a null direction passes."""
    return inp.where(~F.col("play_direction").isin(DIRECTIONS))


def player_profile(inp: DataFrame) -> DataFrame:
    """One row per player and play with all the input checks need: frame range, row count, bad directions, air time.

    Numbers only, so it aggregates in hash maps before the shuffle; stage it and the checks read it, not the frames."""
    predicted = F.col("player_to_predict")
    return inp.groupBy(*KEY).agg(
        F.min("frame_id").alias("lo"), F.max("frame_id").alias("hi"), F.count("*").alias("n"),
        F.count_if(~F.col("play_direction").isin(DIRECTIONS)).alias("bad_direction"),
        F.count_if(predicted).alias("predicted"),
        F.min_by(F.when(predicted, F.col("num_frames_output")),
                 F.when(predicted, F.col("frame_id"))).alias("num_frames_output"),
    )


def contiguity_violations(profile: DataFrame) -> DataFrame:
    """Players whose frames are not 1..n."""
    return profile.where("lo <> 1 OR hi <> n").select(*KEY, "lo", "hi", "n")


def count_violations(profile: DataFrame, out: DataFrame) -> DataFrame:
    """Predicted players whose output rows do not match the announced air time, or are on one side only."""
    announced = profile.where("predicted > 0").select(*KEY, "num_frames_output")
    counts = out.groupBy(*KEY).agg(F.count("*").alias("n"))
    both = announced.join(counts, KEY, "full")
    return both.where("n IS NULL OR num_frames_output IS NULL OR n <> num_frames_output")


def angle_errors(inp: DataFrame) -> DataFrame:
    """Yards per frame between the real step and the step each of two angle conventions expects: a, b, ok for every
    season and week in the table, each judged by itself; one row for a table that says neither.

    a takes x with the sine, b swaps sine and cosine; a has to win five to one. Rows slower than 1 yd/s and last frames
    do not count; with no row left both are 0 and the check fails."""
    by = [c for c in ("season", "week") if c in inp.columns]
    steps = with_next(inp.select(*by, *FRAME, "x", "y", "s", "dir"), ["x", "y"], [*by, *KEY])
    counts = F.col("next_x").isNotNull() & (F.col("s") > 1)
    reach, rad = SECONDS_PER_FRAME * F.col("s"), F.radians("dir")
    dx, dy = F.col("next_x") - F.col("x"), F.col("next_y") - F.col("y")

    def error(ux, uy):
        ex, ey = dx - reach * ux, dy - reach * uy
        return F.coalesce(F.sqrt(F.avg(F.when(counts, ex * ex + ey * ey))), F.lit(0.0))

    errors = steps.groupBy(*by).agg(error(F.sin(rad), F.cos(rad)).alias("a"), error(F.cos(rad), F.sin(rad)).alias("b"))
    return errors.withColumn("ok", F.col("a") < F.col("b") / 5)


def angle_violations(inp: DataFrame) -> DataFrame:
    return angle_errors(inp).where(~F.col("ok")).drop("ok")


def duplicate_plays(context: DataFrame) -> DataFrame:
    return duplicates(context, PLAY)


def arrival_violations(arrived: DataFrame) -> DataFrame:
    """Predicted players without an actual or an expected row at the arrival frame."""
    return arrived.where("x IS NULL OR x_pred IS NULL").select(*KEY)


def receiver_violations(arrived: DataFrame) -> DataFrame:
    """Plays that do not have exactly one targeted receiver among the predicted players."""
    counts = arrived.groupBy(*PLAY).agg(F.count_if(F.col("player_role") == RECEIVER).alias("receivers"))
    return counts.where("receivers <> 1")


def context_violations(plays: DataFrame) -> DataFrame:
    """Defender plays that found no context row; ``plays`` is a play table."""
    return plays.where("team IS NULL").select(*PLAY)


def plays_without_context(rows: DataFrame, context: DataFrame) -> DataFrame:
    return rows.select(*PLAY).distinct().join(context, PLAY, "left_anti")


def uncovered_targets(out: DataFrame, pred: DataFrame) -> DataFrame:
    return out.select(*FRAME).join(pred.select(*FRAME), FRAME, "left_anti")


def repeated_predictions(out: DataFrame, pred: DataFrame) -> DataFrame:
    """Targets that would meet more than one prediction."""
    return duplicates(pred.select(*FRAME)).join(out.select(*FRAME), FRAME, "left_semi")


def prediction_gap(one: DataFrame, two: DataFrame, limit: float = 1e-3) -> DataFrame:
    """Two producers' predictions of the same frames: rows on each side, matched rows, largest gap, and agreement."""
    def side(df, tag):
        return df.select(*FRAME, F.lit(1).alias(f"in_{tag}"), F.col("x_pred").alias(f"x_{tag}"),
                         F.col("y_pred").alias(f"y_{tag}"))

    both = side(one, "a").join(side(two, "b"), FRAME, "full")
    gap = F.greatest(F.abs(F.col("x_a") - F.col("x_b")), F.abs(F.col("y_a") - F.col("y_b")))
    sums = both.agg(
        F.count("in_a").alias("rows_a"), F.count("in_b").alias("rows_b"),
        F.count(F.col("in_a") + F.col("in_b")).alias("matched"), F.max(gap).alias("gap"),
    )
    same = (F.col("rows_a") == F.col("matched")) & (F.col("rows_b") == F.col("matched"))
    return sums.withColumn("ok", same & F.coalesce(F.col("gap") <= limit, F.lit(False)))


def _doubles(schema, at=""):
    """The double fields of a flat row."""
    return [f"{at}{f.name}" for f in schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]


def non_finite_values(df: DataFrame) -> DataFrame:
    """One row per double column that holds a NaN or an infinity, with the number of such values."""
    names = _doubles(df.schema)
    if not names:
        return df.sparkSession.createDataFrame([], "name string, n long")
    def bad(c):
        return F.isnan(c) | (F.abs(c) == float("inf"))

    counts = df.agg(*[F.count_if(bad(F.col(c))).alias(c) for c in names])
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(c).alias("n")) for c in names
    ]))).where("n > 0")


def require_rows(df: DataFrame, message: str) -> None:
    """Refuse an empty result: no rated rows, no play scored, no report."""
    if df.isEmpty():
        raise ValidationError(message)
