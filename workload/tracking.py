"""Tracking-shaped tables derived from ``lineitem``, so every query grows with the given data.

An order becomes a play, a supplier on it a player, and arithmetic on the two keys fills the other columns. The formulas
are the ones in FIXTURES.md; ``workload.oracle_view`` writes the same tables in SQL."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pursuit import schema as S
from pursuit.operators.expect import fold_of
from pursuit.session import tune
from pursuit.staging import clustered

# Labels the key arithmetic picks from; workload.oracle_view uses the same lists.
FIRST_NAMES = ["Ana", "José", "Kei'To", "Lou-Ann", "Max", "Zoë", "Rémi"]
LAST_NAMES = ["Stone", "Ramos", "van Dyke", "St. Clair", "Ortiz II", "Weber, Jr.", "Núñez", "de la Cruz", "Young"]
COVERAGES = ["COVER_1_MAN", "COVER_2_ZONE", "COVER_3_ZONE", "COVER_4_ZONE", "unknown"]
ROUTES = ["GO", "OUT", "HITCH", "CROSS", "POST", "SLANT", "unknown"]
MAN_ZONE = ["man", "zone", "unknown"]
DEFENSE = ["FS", "ILB", "SS", "OLB", "CB"]

# Fixed value: rows of a bucket, some sixteen times as many input frames and as many output frames.
TASK_ENTRIES = 16_000

_rosters: dict[tuple, tuple[DataFrame, int]] = {}


def source_state(spark: SparkSession, sf_dir: str) -> tuple:
    """Tells the given table of one application apart from what it is after a change: its files with size and time."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/lineitem.parquet")
    system = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = system.listStatus(hadoop)
    return (spark.sparkContext.applicationId, sf_dir, *sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files))


@dataclass
class Tracking:
    inp: DataFrame
    out: DataFrame
    pred: DataFrame
    context: DataFrame
    roster: DataFrame
    buckets: int


def _pick(values, index):
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def _entries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """One row per order and supplier with the player's rank in the play; written once per application and state of the table,
    in buckets of plays, so that the frames made of it need no exchange to meet by play or player. And the number of buckets."""
    at = source_state(spark, sf_dir)
    if at not in _rosters:
        tune(spark)
        order = Window.partitionBy("o").orderBy((F.col("sk") * 7919 + F.col("o") * 104729) % 1009, "sk")
        lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
        buckets = max(tasks, lines.count() // TASK_ENTRIES)
        # one exchange, by order: rows of an order and supplier, the players of a play and its bucket all meet in it
        entries = (
            lines.select(F.col("l_orderkey").alias("o"), F.col("l_suppkey").alias("sk"), "l_quantity", "l_extendedprice")
            .repartition(buckets, "o")
            .groupBy("o", "sk").agg(F.min("l_quantity").alias("q"), F.min("l_extendedprice").alias("ep"))
            .withColumn("rn", F.row_number().over(order))
        )
        _rosters[at] = clustered(entries, "entries", ["o"], buckets, placed=True), buckets
    return _rosters[at]


def roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per player and play with everything that does not change from frame to frame."""
    o, sk, rn, q = (F.col(c) for c in ("o", "sk", "rn", "q"))
    role = F.when(rn == 1, S.RECEIVER).when(rn == 2, S.PASSER).when(rn % 5 == 0, S.RUNNER).otherwise(S.DEFENDER)
    position = (
        F.when(rn == 1, "WR").when(rn == 2, "QB").when(rn % 5 == 0, "TE").otherwise(_pick(DEFENSE, sk % 5))
    )
    df = _entries(spark, sf_dir)[0].select(
        "o", "sk", "rn", "q",
        (F.lit(2023090700) + o % 272).cast("long").alias("game_id"), o.alias("play_id"), sk.alias("nfl_id"),
        role.alias("player_role"), position.alias("player_position"),
        F.when(role == S.DEFENDER, "Defense").otherwise("Offense").alias("player_side"),
        ((rn == 1) | ((rn > 2) & (rn % 5 != 0))).alias("player_to_predict"),
        F.when(o % 2 == 0, "left").otherwise("right").alias("play_direction"),
        (F.lit(20) + o % 80).cast("long").alias("absolute_yardline_number"),
        F.concat_ws(" ", _pick(FIRST_NAMES, sk % 7), _pick(LAST_NAMES, sk % 9)).alias("player_name"),
        F.concat((F.lit(5) + sk % 2).cast("string"), F.lit("-"), (sk % 12).cast("string")).alias("player_height"),
        (F.lit(180) + sk % 120).cast("long").alias("player_weight"),
        F.concat(F.lit("199"), (sk % 10).cast("string"), F.lit("-01-15")).alias("player_birth_date"),
        (F.lit(5) + (o * 7) % 37).cast("long").alias("num_frames_output"),
        (F.lit(8) + o % 17).cast("long").alias("n_in"),
        (F.lit(4) + (o * 13) % 120).cast("double").alias("ball_land_x"),
        (F.lit(1) + (o * 11) % 54).cast("double").alias("ball_land_y"),
        (F.lit(1.0) + q / F.lit(10.0)).alias("s"),
        (q / F.lit(20.0)).alias("a"),
        (F.floor("ep") % 360).cast("double").alias("dir"),
    )
    spread = ((sk * 17 + o * 3) % 41 - 20).cast("double")
    effect = ((sk * 37) % 21 - 10).cast("double") / 20.0
    noise = ((sk * 31 + o * 17) % 201 - 100).cast("double") / 100.0
    rad = F.radians("dir")
    return df.withColumns({
        "o_deg": F.pmod(F.col("dir") + 37.0, F.lit(360.0)),
        "x0": F.col("ball_land_x") + (q - 25.0) * 0.9,
        "y0": F.col("ball_land_y") + spread * 0.5 + 0.13,
        "vx": F.col("s") * F.sin(rad), "vy": F.col("s") * F.cos(rad),
        "gain": effect + noise, "noise": noise,
    })


def _input_frames(players: DataFrame) -> DataFrame:
    back = F.lit(0.1) * (F.col("frame_id") - F.col("n_in")).cast("double")
    frames = players.withColumn("frame_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_in"))))
    return frames.withColumns({"x": F.col("x0") + back * F.col("vx"), "y": F.col("y0") + back * F.col("vy")}).select(
        *[F.col("o_deg").alias("o") if c == "o" else F.col(c) for c in S.INPUT_SCHEMA.names]
    )


def _air_frames(players: DataFrame) -> DataFrame:
    """Predicted players only, one row per air frame, with the expected position of the view's own rule."""
    frames = players.where("player_to_predict").withColumn(
        "frame_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("num_frames_output")))
    )
    k = F.col("frame_id").cast("double")
    return frames.withColumns({
        "k": k, "x_pred": F.col("x0") + 0.045 * k * F.col("vx"), "y_pred": F.col("y0") + 0.045 * k * F.col("vy"),
    })


def _output_frames(players: DataFrame) -> DataFrame:
    lx, ly, x0, y0 = (F.col(c) for c in ("ball_land_x", "ball_land_y", "x0", "y0"))
    t = F.col("k") / F.col("num_frames_output")
    d0 = F.sqrt((lx - x0) * (lx - x0) + (ly - y0) * (ly - y0))
    receiver = F.col("rn") == 1
    x = F.when(receiver, x0 + (lx + F.col("noise") * 4.15 - x0) * t).otherwise(
        F.col("x_pred") + F.col("gain") * t * (lx - x0) / d0)
    y = F.when(receiver, y0 + (ly - y0) * t).otherwise(F.col("y_pred") + F.col("gain") * t * (ly - y0) / d0)
    return _air_frames(players).select(*S.FRAME, x.alias("x"), y.alias("y"))


def _predictions(players: DataFrame) -> DataFrame:
    return _air_frames(players).select(
        *S.FRAME, "x_pred", "y_pred",
        (F.lit(0.5) + 0.02 * F.col("k")).alias("sd_x"), (F.lit(0.4) + 0.02 * F.col("k")).alias("sd_y"),
        fold_of("game_id").alias("fold"),
    )


def _context(players: DataFrame) -> DataFrame:
    """One row per play; every play has exactly one player of rank 1."""
    o = F.col("o")
    defense = F.concat(F.lit("T"), ((o * 5) % 32).cast("string"))
    offense = F.concat(F.lit("T"), ((o * 5 + 1) % 32).cast("string"))
    return players.where("rn = 1").select(
        "game_id", "play_id",
        (F.lit(1) + o % 18).cast("long").alias("week"),
        F.when(o % 2 == 0, defense).otherwise(offense).alias("home"),
        F.when(o % 2 == 0, offense).otherwise(defense).alias("away"),
        offense.alias("off"), defense.alias("team"),
        F.concat(F.lit("pass "), o.cast("string")).alias("desc"),
        (F.lit(1) + o % 4).cast("long").alias("q"),
        F.concat(F.lit("10:"), F.lpad((o % 60).cast("string"), 2, "0")).alias("clock"),
        (F.lit(1) + o % 4).cast("long").alias("down"), (F.lit(1) + o % 15).cast("long").alias("dist"),
        _pick(["C", "I", "IN"], o % 4).alias("result"),
        _pick(ROUTES, (o * 3) % 7).alias("route"), _pick(MAN_ZONE, o % 3).alias("mz"),
        _pick(COVERAGES, o % 5).alias("cov"),
        F.when(o % 11 != 0, ((o * 13) % 201 - 100).cast("double") / 50.0).alias("epa"),
    )


def tracking(spark: SparkSession, sf_dir: str) -> Tracking:
    players = roster(spark, sf_dir)
    return Tracking(
        _input_frames(players), _output_frames(players), _predictions(players), _context(players), players, _entries(spark, sf_dir)[1]
    )
