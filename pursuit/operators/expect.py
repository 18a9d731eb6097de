"""Expected paths: straight-line baselines, the cross-fitted expectation and what-if scenarios."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pursuit.functions.geometry import clamp_spot, velocity
from pursuit.operators.paths import future_frames, last_frame
from pursuit.schema import (
    FIELD_X, FIELD_Y, FRAME, HORIZON, KEY, N_FOLDS, OTHER_GROUP, PLAY, RATING_GROUPS, RECEIVER, SECONDS_PER_FRAME,
)
from pursuit.staging import lookup, staged

BUCKET = 5  # air frames that share one set of weights
# The spread is held to a log variance between -6 and 6.
LOG_SD_LIMIT = 3.0
DEGENERATE = 1e-9


def fold_of(game="game_id"):
    """The fold of a game: stable, shared by all its plays, and not in calendar order."""
    text = F.col(game) if isinstance(game, str) else game
    return F.pmod(F.crc32(text.cast("string").cast("binary")), F.lit(N_FOLDS)).cast("long")


def held_out(rows: DataFrame, fold: int) -> DataFrame:
    return rows.where(fold_of("game_id") == fold)


def first_play(rows: DataFrame, fold: int) -> DataFrame:
    """The first play of the first game of a fold, as one row."""
    return held_out(rows, fold).agg(F.min(F.struct(*PLAY)).alias("p")).select("p.*")


def rating_group(position):
    """Position -> rating group, for any column expression."""
    group = F
    for name, positions in RATING_GROUPS.items():
        group = group.when(position.isin(positions), name)
    return group.otherwise(OTHER_GROUP)


def throw_state(inp: DataFrame) -> DataFrame:
    """Predicted players at the throw with their velocity; positions are x0, y0."""
    vx, vy = velocity()
    return last_frame(inp).withColumns({"vx": vx, "vy": vy}).withColumnsRenamed({"x": "x0", "y": "y0"})


# Each baseline maps a frame row that carries the throw state to its expected x and y.

def hold():
    return F.col("x0"), F.col("y0")


def constant_velocity():
    seconds = SECONDS_PER_FRAME * F.col("frame_id")
    return F.col("x0") + seconds * F.col("vx"), F.col("y0") + seconds * F.col("vy")


def hybrid():
    """The targeted receiver runs straight to the landing spot; everybody else keeps the velocity."""
    share = F.col("frame_id") / F.col("num_frames_output")
    receiver = F.col("player_role") == RECEIVER
    cx, cy = constant_velocity()
    return (
        F.when(receiver, F.col("x0") + (F.col("ball_land_x") - F.col("x0")) * share).otherwise(cx),
        F.when(receiver, F.col("y0") + (F.col("ball_land_y") - F.col("y0")) * share).otherwise(cy),
    )


BASELINES = {"hold": hold, "constant_velocity": constant_velocity, "hybrid": hybrid}


def baseline_predictions(inp: DataFrame, name: str) -> DataFrame:
    """One baseline's expected path for every predicted player, in field coordinates."""
    x, y = BASELINES[name]()
    return future_frames(throw_state(inp)).withColumns({"x_pred": x, "y_pred": y})


def targets_at_throw(state: DataFrame, out: DataFrame) -> DataFrame:
    """Target frames with their player's throw state. The targets meet one row per player and no path is expanded."""
    return out.join(state.drop("frame_id"), KEY)


def baseline_targets(inp: DataFrame, out: DataFrame) -> DataFrame:
    """Target frames with the position of every baseline next to them, after a single join.

    Half a turn of the field moves targets and expectations alike and leaves every error as it is."""
    rows = targets_at_throw(throw_state(inp), out)
    for name, rule in BASELINES.items():
        x, y = rule()
        rows = rows.withColumns({f"x_{name}": x, f"y_{name}": y})
    return rows


def baseline_columns() -> dict[str, tuple[str, str]]:
    return {name: (f"x_{name}", f"y_{name}") for name in BASELINES}


def _kind():
    return F.when(F.col("player_role") == RECEIVER, "receiver").otherwise(rating_group(F.col("player_position")))


def _bucket(frame):
    return F.floor((F.least(frame, F.lit(HORIZON)) - 1) / BUCKET)


def _regressors(frame):
    """Per axis: the displacement at constant velocity and the displacement straight to the landing spot."""
    seconds = SECONDS_PER_FRAME * frame
    share = frame / F.col("num_frames_output")
    return {
        "x": (seconds * F.col("vx"), (F.col("ball_land_x") - F.col("x0")) * share),
        "y": (seconds * F.col("vy"), (F.col("ball_land_y") - F.col("y0")) * share),
    }


def _moments():
    out = [F.count("*").alias("n")]
    for axis, (one, two) in _regressors(F.col("frame_id")).items():
        moved = F.col(axis) - F.col(f"{axis}0")
        pairs = {"11": one * one, "12": one * two, "22": two * two, "1d": one * moved, "2d": two * moved,
                 "dd": moved * moved}
        out += [F.sum(v).alias(f"{axis}{k}") for k, v in pairs.items()]
    return out


def _weights(axis: str):
    """Least squares without intercept from the moments; a degenerate cell keeps constant velocity's direction."""
    m = {k: F.col(f"{axis}{k}") for k in ("11", "12", "22", "1d", "2d", "dd")}
    det = m["11"] * m["22"] - m["12"] * m["12"]
    sound = det > DEGENERATE * m["11"] * m["22"]
    one = F.when(sound, F.try_divide(m["1d"] * m["22"] - m["2d"] * m["12"], det)).otherwise(
        F.coalesce(F.try_divide(m["1d"], m["11"]), F.lit(0.0)))
    two = F.when(sound, F.try_divide(m["2d"] * m["11"] - m["1d"] * m["12"], det)).otherwise(F.lit(0.0))
    return one, two


def _spread(axis: str):
    m = {k: F.col(f"{axis}{k}") for k in ("11", "12", "22", "1d", "2d", "dd")}
    b1, b2 = F.col(f"{axis}_velocity"), F.col(f"{axis}_ball")
    rest = (m["dd"] - 2.0 * (b1 * m["1d"] + b2 * m["2d"]) + b1 * b1 * m["11"] + 2.0 * b1 * b2 * m["12"]
            + b2 * b2 * m["22"])
    sd = F.sqrt(F.greatest(rest, F.lit(0.0)) / F.col("n"))
    return F.greatest(F.least(sd, F.exp(F.lit(LOG_SD_LIMIT))), F.exp(F.lit(-LOG_SD_LIMIT)))


def fit_crossfit(state: DataFrame, out: DataFrame) -> DataFrame:
    """The cross-fitted expectation: weights and spread per player kind, air-frame bucket and held-out fold.

    One pass over the targets sums second moments per (kind, bucket, fold); what a fold may not see is the total minus
    its own sums. A kind seen in one fold only is fitted on that fold. Half a turn flips the sign of both regressors
    and of the displacement, so the fit is the same in field coordinates. The result has at most four kinds x eight
    buckets x five folds rows and is a lookup for ``predict_crossfit``.

    Stages its steps when called."""
    rows = targets_at_throw(state, out.where(F.col("frame_id") <= HORIZON))
    by_fold = staged(
        rows.groupBy(_kind().alias("kind"), _bucket(F.col("frame_id")).alias("bucket"), fold_of().alias("fold"))
        .agg(*_moments()), "moments")
    sums = [c for c in by_fold.columns if c not in ("kind", "bucket", "fold")]
    total = by_fold.groupBy("kind", "bucket").agg(*[F.sum(c).alias(c) for c in sums])
    folds = total.withColumn("fold", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(N_FOLDS - 1).cast("long"))))
    own = by_fold.withColumnsRenamed({c: f"own_{c}" for c in sums})
    cells = folds.join(own, ["kind", "bucket", "fold"], "left")
    others = F.col("n") > F.coalesce(F.col("own_n"), F.lit(0))
    cells = cells.withColumns({
        c: F.when(others, F.col(c) - F.coalesce(F.col(f"own_{c}"), F.lit(0))).otherwise(F.col(c)) for c in sums
    })
    for axis in ("x", "y"):
        one, two = _weights(axis)
        cells = cells.withColumns({f"{axis}_velocity": one, f"{axis}_ball": two})
    cells = cells.withColumns({f"sd_{axis}": _spread(axis) for axis in ("x", "y")})
    model = cells.select(
        "kind", "bucket", "fold", "n", "x_velocity", "x_ball", "sd_x", "y_velocity", "y_ball", "sd_y"
    )
    return lookup(model, "crossfit")


def predict_crossfit(state: DataFrame, model: DataFrame) -> DataFrame:
    """Expected paths from the throw state; frames past the horizon hold its last value. Keeps role and air time."""
    rows = _with_expectation(future_frames(state), model)
    extra = [c for c in ("scenario",) if c in state.columns]
    return rows.select(
        *extra, *FRAME, "x_pred", "y_pred", "sd_x", "sd_y", "fold", "player_role", "num_frames_output")


def _with_expectation(rows: DataFrame, model: DataFrame) -> DataFrame:
    rows = rows.withColumns({
        "kind": _kind(), "bucket": _bucket(F.col("frame_id")), "fold": fold_of(),
        "_k": F.least(F.col("frame_id"), F.lit(HORIZON)),
    }).join(model.drop("n"), ["kind", "bucket", "fold"], "left")
    moved = _regressors(F.col("_k"))
    return rows.withColumns({
        f"{a}_pred": F.col(f"{a}0") + F.col(f"{a}_velocity") * moved[a][0] + F.col(f"{a}_ball") * moved[a][1]
        for a in ("x", "y")
    })


def crossfit_targets(state: DataFrame, out: DataFrame, model: DataFrame) -> DataFrame:
    """Target frames with the cross-fitted expectation, computed where they meet the throw state."""
    return _with_expectation(targets_at_throw(state, out), model)


def scenarios(state: DataFrame, moves: list[dict]) -> DataFrame:
    """The throw state once per what-if: another landing spot, a moved one, another air time, or any mix.

    ``moves`` entries have ``name`` and any of ``land_x``, ``land_y``, ``shift_x``, ``shift_y``, ``frames``. The short
    list is part of the expression, so every row is repeated where it lies and nothing is joined."""
    def number(move, key, kind):
        return F.lit(move.get(key)).cast(kind).alias(key)

    options = F.array(*[
        F.struct(
            F.lit(m["name"]).alias("scenario"), number(m, "land_x", "double"), number(m, "land_y", "double"),
            number(m, "shift_x", "double"), number(m, "shift_y", "double"), number(m, "frames", "long"),
        ) for m in moves
    ])
    rows = state.select("*", F.inline(options))
    return rows.withColumns({
        "ball_land_x": clamp_spot(
            F.coalesce("land_x", F.col("ball_land_x") + F.coalesce("shift_x", F.lit(0.0))), FIELD_X),
        "ball_land_y": clamp_spot(
            F.coalesce("land_y", F.col("ball_land_y") + F.coalesce("shift_y", F.lit(0.0))), FIELD_Y),
        "num_frames_output": F.coalesce("frames", "num_frames_output"),
    }).drop("land_x", "land_y", "shift_x", "shift_y", "frames")


def external_predictions(frames: DataFrame, model_fn, schema) -> DataFrame:
    """Predictions of a caller's own model: ``model_fn`` gets Arrow-backed pandas batches of the caller's rows."""
    return frames.mapInPandas(model_fn, schema)


def fit_linear_models(state: DataFrame, out: DataFrame):
    """The same expectation with ``pyspark.ml``: one least-squares fit per held-out fold and axis.

    The weights of a (kind, bucket) cell are the coefficients of that cell's two interaction terms, so one fit per
    fold covers every cell. Returns the long weight table, comparable with ``fit_crossfit``.

    Stages its steps when called."""
    from pyspark.ml.feature import Interaction, OneHotEncoder, VectorAssembler
    from pyspark.ml.regression import LinearRegression

    kinds = ["receiver", *RATING_GROUPS, OTHER_GROUP]
    buckets = -(-HORIZON // BUCKET)
    spark = out.sparkSession
    rows = targets_at_throw(state, out.where(F.col("frame_id") <= HORIZON))
    index = F.array_position(F.array(*[F.lit(k) for k in kinds]), _kind()) - 1
    cell = (index * buckets + _bucket(F.col("frame_id"))).cast("double")
    columns = [cell.alias("cell"), fold_of().alias("fold")]
    for axis, (one, two) in _regressors(F.col("frame_id")).items():
        columns += [_known(one).alias(f"{axis}1"), _known(two).alias(f"{axis}2"),
                    _known(F.col(axis) - F.col(f"{axis}0")).alias(f"{axis}d")]
    rows = _same_fit(rows.select(*columns))
    # every cell number is known, so the encoder is fitted on the numbers and not on the data
    numbers = spark.range(len(kinds) * buckets).select(F.col("id").cast("double").alias("cell"))
    rows = OneHotEncoder(inputCols=["cell"], outputCols=["onehot"], dropLast=False).fit(numbers).transform(rows)
    for axis in ("x", "y"):
        pair = VectorAssembler(inputCols=[f"{axis}1", f"{axis}2"], outputCol=f"{axis}pair")
        rows = Interaction(inputCols=["onehot", f"{axis}pair"], outputCol=f"{axis}features").transform(
            pair.transform(rows))
    rows = rows.select("fold", "xfeatures", "xd", "yfeatures", "yd")
    found = []
    for fold in range(N_FOLDS):
        part = rows.where(F.col("fold") != fold)
        fits = {}
        for axis in ("x", "y"):
            fit = LinearRegression(
                featuresCol=f"{axis}features", labelCol=f"{axis}d", fitIntercept=False, solver="normal",
                standardization=False,
            ).fit(part)
            fits[axis] = fit.coefficients.toArray()
        for i in range(len(kinds) * buckets):
            found.append((
                kinds[i // buckets], i % buckets, fold, *(float(fits[a][2 * i + j]) for a in "xy" for j in (0, 1))
            ))
    return spark.createDataFrame(
        found, "kind string, bucket long, fold long, x_velocity double, x_ball double, y_velocity double, y_ball double")


def _known(value):
    """``value``; a row without a number is refused, as the library does."""
    return F.when(value.isNull() | F.isnan(value), F.raise_error(F.lit("null or NaN in a row to be fitted"))).otherwise(value)


def _same_fit(rows: DataFrame) -> DataFrame:
    """Three rows per cell and fold with the same least-squares problem as all its rows.

    They are the triangle R of the rows' QR decomposition, from their second moments: a fit without intercept sees rows only
    through those, and R has the same. So the frames are read once, and what the fits read does not grow with them.

    Stages its steps when called."""
    columns = []
    for axis in ("x", "y"):
        one, two, moved = (F.col(f"{axis}{k}") for k in "12d")
        pairs = {"11": one * one, "12": one * two, "22": two * two, "1d": one * moved, "2d": two * moved, "dd": moved * moved}
        columns += [F.sum(v).alias(f"{axis}{k}") for k, v in pairs.items()]
    moments = staged(rows.groupBy("cell", "fold").agg(*columns), "linear-moments")

    def root(v):
        return F.sqrt(F.greatest(v, F.lit(0.0)))

    def over(v, by):
        return F.when(by > 0, v / by).otherwise(0.0)

    for axis in ("x", "y"):
        m = {k: F.col(f"{axis}{k}") for k in ("11", "12", "22", "1d", "2d", "dd")}
        moments = moments.withColumn(f"{axis}r11", root(m["11"]))
        r11 = F.col(f"{axis}r11")
        moments = moments.withColumns({f"{axis}r12": over(m["12"], r11), f"{axis}r1d": over(m["1d"], r11)})
        r12, r1d = F.col(f"{axis}r12"), F.col(f"{axis}r1d")
        moments = moments.withColumn(f"{axis}r22", root(m["22"] - r12 * r12))
        r22 = F.col(f"{axis}r22")
        moments = moments.withColumn(f"{axis}r2d", over(m["2d"] - r12 * r1d, r22))
        moments = moments.withColumn(f"{axis}rdd", root(m["dd"] - r1d * r1d - F.col(f"{axis}r2d") * F.col(f"{axis}r2d")))
    none = F.lit(0.0)
    triangle = [("r11", "r12", "r1d"), (None, "r22", "r2d"), (None, None, "rdd")]
    three = F.array(*[F.struct(*[
        (F.col(f"{axis}{c}") if c else none).alias(f"{axis}{k}") for axis in ("x", "y") for k, c in zip("12d", line)
    ]) for line in triangle])
    return moments.select("cell", "fold", F.inline(three))
