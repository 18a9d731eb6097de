"""Prediction error on overlapping cuts, fold summaries and comparison tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pursuit.operators.quality import ValidationError
from pursuit.schema import FRAME, HORIZON, KEY
from pursuit.staging import staged

# Single air frames that get a cut of their own.
MARKED_FRAMES = [5, 10, 20, 30]
ONE_MODEL = {"model": ("x_pred", "y_pred")}


def cut_cells(scored: DataFrame, models=ONE_MODEL, by=()) -> DataFrame:
    """Squared errors per role, marked frame and horizon flag: a handful of groups that combine before the shuffle.

    ``scored`` has x, y, player_role, frame_id, num_frames_output and one pair of columns per model; rows without a
    prediction of the first model are counted as uncovered."""
    mark = F.when(F.col("frame_id").isin(MARKED_FRAMES), F.col("frame_id"))
    within = F.coalesce(F.col("num_frames_output") <= HORIZON, F.lit(False))
    first = next(iter(models.values()))[0]
    sums = [F.count("*").alias("n"), F.count_if(F.col(first).isNull()).alias("uncovered")]
    for i, (px, py) in enumerate(models.values()):
        for axis, p in (("x", px), ("y", py)):
            gap = F.col(axis) - F.col(p)
            sums.append(F.sum(gap * gap).alias(f"s{axis}{i}"))
    return scored.groupBy(*by, "player_role", within.alias("within"), mark.alias("mark")).agg(*sums)


def report_of(cells: DataFrame, models=ONE_MODEL, by=()) -> DataFrame:
    """RMSE per model and cut from those sums: all, air time up to the horizon, each role, and the marked frames.

    Only the few sums are spread over the overlapping cuts, never the rows."""
    cuts = F.array_compact(F.array(
        F.lit("all"), F.when(F.col("within"), F.lit(f"le{HORIZON}")),
        F.concat(F.lit("role_"), F.replace(F.col("player_role"), F.lit(" "), F.lit("_"))),
        F.concat(F.lit("frame_"), F.col("mark").cast("string")),
    ))
    per_model = F.array(*[
        F.struct(F.lit(name).alias("model"), F.col(f"sx{i}").alias("sx"), F.col(f"sy{i}").alias("sy"))
        for i, name in enumerate(models)
    ])
    spread = cells.select(*by, "n", F.explode(cuts).alias("cut"), per_model.alias("per_model"))
    spread = spread.select(*by, "cut", "n", F.inline("per_model"))
    totals = spread.groupBy(*by, "model", "cut").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy")])
    rmse = F.sqrt(F.lit(0.5) * (F.col("sx") / F.col("n") + F.col("sy") / F.col("n")))
    return totals.select(*by, "model", "cut", "n", rmse.alias("rmse"))


def report(scored: DataFrame, models=ONE_MODEL, by=()) -> DataFrame:
    return report_of(cut_cells(scored, models, by), models, by)


def scored_targets(pred: DataFrame, inp: DataFrame, out: DataFrame, how: str = "inner") -> DataFrame:
    """Target rows with their prediction, the player's role and the air time."""
    # frames combine in hash maps, role and air time being the same in all of them; then one row per player is made sure of
    meta = inp.select(*KEY, "player_role", "num_frames_output").distinct().dropDuplicates(KEY)
    targets = out.join(meta, KEY, "left")
    keep = [c for c in ("x_pred", "y_pred", "sd_x", "sd_y", "fold") if c in pred.columns]
    return targets.join(pred.select(*FRAME, *keep), FRAME, how)


def evaluate_predictions(pred: DataFrame, inp: DataFrame, out: DataFrame, by=()) -> DataFrame:
    """The report of predictions made anywhere; refuses targets without a prediction and repeated predictions.

    One join serves the report and both checks: what is not covered shows as null, what is repeated as more rows than
    there are targets. ``quality.uncovered_targets`` and ``quality.repeated_predictions`` name the rows.

    Stages its steps when called."""
    cells = staged(cut_cells(scored_targets(pred, inp, out, "left"), by=by), "cut-cells")
    seen = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("uncovered"), F.lit(0)).alias("u")).first()
    if seen.u:
        raise ValidationError(f"{seen.u} target rows have no predictions")
    targets = out.count()
    if seen.n != targets:
        raise ValidationError(f"predictions cover {seen.n} rows for {targets} target rows")
    return report_of(cells, by=by)


def gaussian_nll(scored: DataFrame, by=()) -> DataFrame:
    """Negative log likelihood of the targets under the predicted mean and spread, over frames inside the horizon."""
    def axis(name):
        logvar = 2.0 * F.log(f"sd_{name}")
        gap = F.col(name) - F.col(f"{name}_pred")
        return logvar + gap * gap * F.exp(-logvar)

    rows = scored.where(F.col("frame_id") <= HORIZON)
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(0.5 * (axis("x") + axis("y"))).alias("nll"))


def fold_summary(reports: DataFrame) -> DataFrame:
    """Mean, min and max of every cut over the folds that reported it; ``reports`` has fold, cut and rmse."""
    return reports.groupBy("cut").agg(
        F.avg("rmse").alias("mean"), F.min("rmse").alias("min"), F.max("rmse").alias("max"),
        F.count("rmse").alias("folds"),
    )


def comparison(reports: DataFrame, models) -> DataFrame:
    """One row per cut and one column per named model, to three decimals as text; a missing cut stays null."""
    text = F.format_string("%.3f", F.first("rmse"))
    return reports.groupBy("cut").pivot("model", list(models)).agg(
        F.when(F.first("rmse").isNotNull(), text)
    )
