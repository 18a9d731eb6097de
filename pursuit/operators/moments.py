"""Ratings from sums that grow by week.

What centering, shrinkage and ratings need of the rated plays are counts, sums and sums of squares per player, team, half and
situation. These moments are stored by season and week; a new or corrected week writes its own folder and nothing else, and
the ratings follow from the stored moments without reading a play again. Subtracting a cell's mean from every value changes a
sum by ``n * mean`` and a sum of squares by ``n * mean ** 2 - 2 * mean * sum``, so the moments of the centered values are exact.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pursuit.operators import ratings
from pursuit.operators.playtable import rated
from pursuit.staging import staged

KEYS = [*ratings.cell_columns(), "fold", "nfl_id", "team", "half"]
SUMS = ["n", "z", "zz", "yards", "yds", "done", "known", "epa", "epas"]


def moments(plays: DataFrame, by=("season", "week")) -> DataFrame:
    """The moments of the rated rows of a play table, per ``KEYS`` and ``by``; rows combine before the shuffle."""
    complete, order = F.col("result") == "C", F.struct("game_id", "play_id")
    rows = rated(plays).withColumn("half", F.pmod("game_id", F.lit(2)))
    return rows.groupBy(*by, *KEYS).agg(
        F.count("*").alias("n"), F.sum("z").alias("z"), F.sum(F.col("z") * F.col("z")).alias("zz"), F.sum("yards").alias("yards"),
        F.count("yards").alias("yds"), F.sum(complete.cast("long")).alias("done"), F.count(complete).alias("known"),
        F.sum("epa").alias("epa"), F.count("epa").alias("epas"), F.max_by(F.struct("name", "pos"), order).alias("who"), F.max(order).alias("at"))


def write_moments(plays: DataFrame, path: str, season: int = 2023) -> None:
    """Store the moments of the weeks in ``plays``, in place of what was stored of them; other weeks stay."""
    state = moments(plays.withColumn("season", F.lit(season)) if "season" not in plays.columns else plays)
    state.repartition("season", "week").write.partitionBy("season", "week").mode("overwrite") \
        .option("partitionOverwriteMode", "dynamic").parquet(path)


def read_moments(spark: SparkSession, path: str) -> DataFrame:
    """The stored moments, weeks added up."""
    return merged(spark.read.parquet(path))


def merged(state: DataFrame) -> DataFrame:
    return state.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS], F.max_by("who", "at").alias("who"), F.max("at").alias("at"))


def centered(state: DataFrame) -> DataFrame:
    """Merged moments with ``zc`` and ``sq``: sum and sum of squares of the centered values. Stages its steps when called."""
    sums = staged(state.groupBy(*ratings.cell_columns(), "fold").agg(F.sum("z").alias("s"), F.sum("n").alias("n")), "cells")
    shift, n = F.col("_shift"), F.col("n")
    return ratings.with_shift(state, sums).withColumn("zc", F.col("z") - n * shift).withColumn(
        "sq", F.col("zz") - 2 * shift * F.col("z") + n * shift * shift).drop("_shift")


def shrinkage(state: DataFrame) -> DataFrame:
    """``ratings.shrinkage`` from centered moments."""
    per_player = state.groupBy("grp", "nfl_id").agg(F.sum("n").alias("n"), F.sum("zc").alias("zc"), F.sum("sq").alias("sq"))
    mean = F.col("zc") / F.col("n")
    return ratings.group_shrinkage(per_player.select("grp", "nfl_id", "n", mean.alias("mean"), F.greatest(
        F.col("sq") / F.col("n") - mean * mean, F.lit(0.0)).alias("v")))


def players(state: DataFrame, shrink: DataFrame) -> DataFrame:
    """``ratings.players`` from centered moments."""
    per_team = state.groupBy("nfl_id", "team").agg(
        *[F.sum(c).alias(c) for c in SUMS if c not in ("z", "zz")], F.sum("zc").alias("zc"), F.sum("n").alias("zcs"),
        F.max_by(F.struct("who.name", "who.pos", "grp"), "at").alias("who"), F.max("at").alias("at"))
    return ratings.rated_players(ratings.means_of_teams(per_team.withColumn("latest", F.col("at"))), shrink)


def teams(state: DataFrame, min_plays: int = 1) -> DataFrame:
    """``ratings.teams`` from centered moments."""
    n, total, squares = F.sum("n"), F.sum("zc"), F.sum("sq")
    within = state.select(F.coalesce(F.try_divide(squares - F.try_divide(total * total, n), n - 1), F.lit(0.0))).scalar()
    t = state.groupBy("team").agg(F.sum("n").alias("n"), (total / n).alias("mean")).where(F.col("n") >= min_plays)
    return t.withColumn("se", F.sqrt(within / F.col("n")))


def split_half(state: DataFrame) -> DataFrame:
    """``ratings.split_half`` from centered moments."""
    def half(number, column):
        return F.sum(F.when(F.col("half") == number, F.col(column)))

    halves = state.groupBy("nfl_id").agg(
        F.try_divide(half(0, "zc"), half(0, "n")).alias("even"), F.coalesce(half(0, "n"), F.lit(0)).alias("n_even"),
        F.try_divide(half(1, "zc"), half(1, "n")).alias("odd"), F.coalesce(half(1, "n"), F.lit(0)).alias("n_odd"))
    return ratings.correlated(ratings.long_halves(halves))
