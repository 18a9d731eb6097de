"""Published rows and the documents of plays and games.

A document is one row, so nothing unbounded may go into it: the row is a run of frames of one player on one play, with
all that the play and the player have once. A game is a folder of such rows and a header row."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pursuit.functions.geometry import hundredths
from pursuit.operators.paths import per_player
from pursuit.schema import KEY, PLAY, PUBLISHED
from pursuit.staging import lookup

# Player columns of a document and the order of the values in a frame.
PLAYER_FIELDS = {
    "player_name": "name", "player_position": "pos", "player_side": "side", "player_role": "role",
    "player_height": "h", "player_weight": "w", "player_birth_date": "b", "player_to_predict": "p",
}
PLAY_FIELDS = [
    "play_direction", "absolute_yardline_number", "num_frames_output", "ball_land_x", "ball_land_y",
]
FRAME_VALUES = ["x", "y", "s", "a", "dir", "o"]
OUT_VALUES = ["x", "y"]
PRED_VALUES = ["x_pred", "y_pred", "sd_x", "sd_y"]
RATING_FIELDS = ["id", "role", "d0", "dexp", "dact", "yards", "z", "zc", "ex"]
# Fixed value: frames of a track in one document row; a longer track is several rows, told apart by ``run``.
TRACK_RUN = 256


def published(table: DataFrame) -> DataFrame:
    """The 22 published columns; numbers to two decimals, zc to six so that tiers come out the same from it."""
    def value(name):
        column = F.col(name)
        if table.schema[name].dataType.typeName() == "double":
            column = F.round(column, 6 if name == "zc" else 2)
        return column.alias(PUBLISHED[name])

    return table.select(*[value(c) for c in PUBLISHED])


def _values(names):
    return F.array(*[hundredths(F.col(c)) for c in names])


def _tracks(inp: DataFrame, out: DataFrame, pred: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Input, actual and expected frames in order, one row per player and run of frames; and the runs a player has.

    The three tables meet in one exchange and one aggregate of numbers only; ``out`` and ``pred`` are null for other
    players."""
    none = F.lit(None).cast("array<double>")

    def side(df, **value):
        return df.select(*KEY, "frame_id", *[value.get(k, none).alias(k) for k in ("i", "o", "e")])

    rows = side(inp, i=_values(FRAME_VALUES)).unionByName(side(out, o=_values(OUT_VALUES))).unionByName(
        side(pred, e=_values(PRED_VALUES)))

    def track(name):
        return F.collect_list(F.when(F.col(name).isNotNull(), F.struct("frame_id", F.col(name).alias("v")))).alias(name)

    def ordered(name):
        return F.transform(F.sort_array(name), lambda e: e["v"])

    run = F.floor((F.col("frame_id") - 1) / TRACK_RUN)
    tracks = rows.groupBy(*KEY, run.alias("run")).agg(track("i"), track("o"), track("e")).select(
        *KEY, "run", ordered("i").alias("in"), F.when(F.size("o") > 0, ordered("o")).alias("out"),
        F.when(F.size("e") > 0, ordered("e")).alias("pred"))
    runs = rows.groupBy(*KEY).agg(F.max(run).alias("last")).select(
        *KEY, F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("run"))
    return tracks, runs


def play_documents(inp: DataFrame, out: DataFrame, pred: DataFrame, table: DataFrame, context: DataFrame) -> DataFrame:
    """One document row per play, player and run of frames: the play's context, the player's frames and paths, and the
    player's rating row or null. The shape is the same at every size, and nothing is gathered per play or game.

    What a play or a player has once is put together on one row per player and run, so the frames are exchanged once.
    Frame values are rounded half away from zero in plain arithmetic, rating values by their decimal text."""
    tracks, runs = _tracks(inp, out, pred)
    people = per_player(inp, [*PLAYER_FIELDS, *PLAY_FIELDS], ends="first").drop("frame_id", "n")
    rows = published(table).select(
        F.col("game").alias("game_id"), F.col("play").alias("play_id"), F.col("id").alias("nfl_id"),
        F.struct(*RATING_FIELDS).alias("rating"))
    people = people.join(rows, KEY, "left").join(runs, KEY).join(context, PLAY, "left")
    player = F.struct(
        F.col("nfl_id").alias("id"), *[F.col(c).alias(n) for c, n in PLAYER_FIELDS.items()], F.col("in"), F.col("out"), F.col("pred"))
    return tracks.join(people, [*KEY, "run"]).select(
        *KEY, "run", "week", "home", "away", "desc", F.col("q"), "clock", "down", "dist", "off", F.col("team").alias("def"),
        "result", "cov", "mz", "route", F.col("play_direction").alias("dir"), F.col("absolute_yardline_number").alias("yl"),
        F.col("num_frames_output").alias("nfo"),
        F.array(hundredths(F.col("ball_land_x")), hundredths(F.col("ball_land_y"))).alias("land"),
        player.alias("player"), "rating")


def game_headers(plays: DataFrame) -> DataFrame:
    """One row per game: week and teams of its first play, and the number of plays. ``plays`` are play documents."""
    each = plays.groupBy(*PLAY).agg(F.min(F.struct("week", "home", "away")).alias("h"))
    return each.groupBy(F.col("game_id").alias("game")).agg(
        F.min_by("h", "play_id").alias("h"), F.count("*").alias("plays")).select("game", "h.week", "h.home", "h.away", "plays")


def input_rows(plays: DataFrame, land: tuple[float, float] | None = None, frames: int | None = None) -> DataFrame:
    """The 23 input columns rebuilt from play documents, one row per player and frame.

    The landing spot and the air time can be replaced for a what-if."""
    rows = plays.select("*", F.posexplode("player.in").alias("at", "f"))
    values = {name: F.get("f", F.lit(i)) for i, name in enumerate(FRAME_VALUES)}
    statics = {column: F.col(f"player.{short}") for column, short in PLAYER_FIELDS.items()}
    columns = {
        "game_id": F.col("game_id"), "play_id": F.col("play_id"), "nfl_id": F.col("player.id"),
        "frame_id": (F.col("run") * TRACK_RUN + F.col("at") + 1).cast("long"), "play_direction": F.col("dir"),
        "absolute_yardline_number": F.col("yl"), **statics, **values,
        "num_frames_output": F.lit(frames).cast("long") if frames is not None else F.col("nfo"),
        "ball_land_x": F.lit(float(land[0])) if land else F.get("land", F.lit(0)),
        "ball_land_y": F.lit(float(land[1])) if land else F.get("land", F.lit(1)),
    }
    return rows.select(*[c.alias(n) for n, c in columns.items()])


def highlights(picks: DataFrame, plays: DataFrame) -> DataFrame:
    """The reel: each pick with the document rows of its play, input frames cut down to x and y. ``picks`` has a
    handful of rows."""
    short = F.col("player").withField("in", F.transform("player.in", lambda f: F.slice(f, 1, 2)))
    scene = plays.select(
        F.col("game_id").alias("game"), F.col("play_id").alias("play"), "week", "home", "away",
        F.struct("run", *[c for c in plays.columns if c not in (*KEY, "run", "week", "home", "away", "player")], short.alias("player")).alias("scene"))
    return lookup(picks, "picks").join(scene.drop("week") if "week" in picks.columns else scene, ["game", "play"])


def meta_row(
    table: DataFrame, gate: DataFrame, shrink: DataFrame, run: str, generated: str, summary: DataFrame | None = None,
    min_plays: int = 30,
) -> DataFrame:
    """One row about the run: names, counts, the gate, the shrinkage table and the fold summary.

    Counts come from distinct plays, then games, so no task holds a set of all plays."""
    plays = table.select(*PLAY).distinct().groupBy("game_id").agg(F.count("*").alias("n"))
    counts = plays.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("plays"), F.count("*").alias("games"))

    def entries(df, key, fields):
        return df.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, F.struct(*fields)))))).scalar()

    summaries = (
        entries(summary, "cut", ["mean", "min", "max", "folds"]) if summary is not None else F.lit(None).cast("string"))
    return counts.select(
        F.lit(run).alias("run"), F.lit(generated).alias("generated"), summaries.alias("summary"),
        gate.select(F.struct("*")).scalar().alias("gate"),
        entries(shrink, "grp", ["within", "between", "k"]).alias("shrink"), F.lit(min_plays).alias("min_plays"),
        F.struct("plays", "games").alias("counts"),
    )
