"""Stages for spark-submit: ``python -m pursuit.jobs <stage> --root <folder>``.

Folders under the root: raw (weekly CSV and supplementary_data.csv), processed, predictions, reports, ratings, site."""

import argparse

from pursuit.operators import quality
from pursuit.plans import prepare, rate, score
from pursuit.session import build_session
from pursuit.sources.tracking import load_weeks, parse_weeks, read_context_csv, read_predictions, write_predictions
from pursuit.staging import clear


def run_prepare(spark, root, args):
    prepare.prepare_weeks(spark, f"{root}/raw", f"{root}/processed", parse_weeks(args.weeks), args.season)


def run_score(spark, root, args):
    inp, out = load_weeks(spark, f"{root}/processed", parse_weeks(args.weeks), season=args.season)
    scored = score.score(inp.drop("season", "week"), out.drop("season", "week"))
    quality.require_rows(scored.state, "no play matched any fold")
    scored.model.write.mode("overwrite").parquet(f"{root}/models/{args.run}")
    write_predictions(scored.pred, f"{root}/predictions/{args.run}")
    scored.reports.write.mode("overwrite").parquet(f"{root}/reports/{args.run}")


def run_publish(spark, root, args):
    score.publish_summary(spark.read.parquet(f"{root}/reports/{args.run}"), f"{root}/summary/{args.run}")


def run_rate(spark, root, args):
    inp, out = (df.drop("season", "week") for df in load_weeks(
        spark, f"{root}/processed", parse_weeks(args.weeks), season=args.season))
    pred = read_predictions(spark, f"{root}/predictions/{args.run}")
    context = read_context_csv(spark, f"{root}/raw/supplementary_data.csv")
    result = rate.compute(inp, out, pred, context)
    summary = None
    if prepare._exists(spark, f"{root}/summary/{args.run}"):
        summary = spark.read.schema("cut string, mean double, min double, max double, folds long").json(
            f"{root}/summary/{args.run}")
    rate.release(result, inp, out, pred, context, f"{root}/ratings/{args.run}", f"{root}/site", args.run, summary)


STAGES = {"prepare": run_prepare, "score": run_score, "publish": run_publish, "rate": run_rate}


def main(argv=None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("stage", choices=list(STAGES))
    parser.add_argument("--root", required=True)
    parser.add_argument("--weeks", default="1-18")
    parser.add_argument("--run", default="local")
    parser.add_argument("--season", type=int, default=2023)
    parser.add_argument("--master")
    args = parser.parse_args(argv)
    spark = build_session("pursuit-" + args.stage, args.master)
    try:
        STAGES[args.stage](spark, args.root.rstrip("/"), args)
    finally:
        clear(spark)


if __name__ == "__main__":
    main()
