"""Cross-fitted predictions for every predicted player, with the report of every fold."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pursuit.operators import expect, metric, quality
from pursuit.staging import staged


@dataclass
class Scored:
    state: DataFrame
    model: DataFrame
    pred: DataFrame
    reports: DataFrame


def score(inp: DataFrame, out: DataFrame) -> Scored:
    """The throw state and the fitted model (both staged), the lazy predictions of all plays, each by the model that
    never saw its fold, and the lazy report per fold and cut. The input frames are read once."""
    state = staged(expect.throw_state(inp), "throw-state")
    model = expect.fit_crossfit(state, out)
    reports = metric.report(expect.crossfit_targets(state, out, model), by=["fold"]).drop("model")
    return Scored(state, model, expect.predict_crossfit(state, model), reports)


def publish_summary(reports: DataFrame, path: str) -> DataFrame:
    """Mean, min and max per cut over the folds, written as JSON and returned."""
    quality.require_rows(reports, "no report to summarize")
    summary = metric.fold_summary(reports.select("fold", "cut", "rmse"))
    summary.orderBy("cut").coalesce(1).write.mode("overwrite").json(path)
    return reports.sparkSession.read.schema(summary.schema).json(path)


def row_counts(pred: DataFrame) -> DataFrame:
    """Scored rows and plays per fold."""
    plays = pred.groupBy("fold", "game_id", "play_id").agg(F.count("*").alias("rows"))
    return plays.groupBy("fold").agg(F.sum("rows").alias("rows"), F.count("*").alias("plays"))
