"""Field, feature, baseline and expectation queries."""

from pyspark.sql import functions as F

from pursuit.operators import expect, features, field, metric, paths, scene
from pursuit.operators.metric import scored_targets
from pursuit.plans import score as score_plan
from pursuit.schema import KEY
from pursuit.staging import clustered
from workload.oracle_view import VIEW
from workload.registry import AT, game_rows, hash_sum, per_game, query, r, row_hash, row_hash_sql, rounded
from workload.tracking import tracking

LAST = """
lastf AS MATERIALIZED (
  SELECT game_id, play_id, nfl_id, max(frame_id) AS frame_id, arg_max(player_role, frame_id) AS player_role,
    arg_max(player_position, frame_id) AS player_position, arg_max(player_name, frame_id) AS player_name,
    arg_max(num_frames_output, frame_id) AS num_frames_output, arg_max(ball_land_x, frame_id) AS ball_land_x,
    arg_max(ball_land_y, frame_id) AS ball_land_y, arg_max(play_direction, frame_id) AS play_direction,
    arg_max(absolute_yardline_number, frame_id) AS yl,
    arg_max(x, frame_id) AS x0, arg_max(y, frame_id) AS y0, arg_max(s, frame_id) AS s, arg_max(dir, frame_id) AS dir,
    arg_max(s * sin(radians(dir)), frame_id) AS vx, arg_max(s * cos(radians(dir)), frame_id) AS vy
  FROM inp WHERE player_to_predict GROUP BY 1, 2, 3)"""
NORMAL = """
normal AS (
  SELECT * EXCLUDE (x, y, ball_land_x, ball_land_y, dir, o),
    x - ball_land_x AS rx, y - ball_land_y AS ry, x, y, dir, o, s * sin(radians(dir)) AS vx, s * cos(radians(dir)) AS vy
  FROM (SELECT * REPLACE (
    CASE WHEN play_direction = 'left' THEN 120 - x ELSE x END AS x,
    CASE WHEN play_direction = 'left' THEN 53.3::DOUBLE - y ELSE y END AS y,
    CASE WHEN play_direction = 'left' THEN 120 - ball_land_x ELSE ball_land_x END AS ball_land_x,
    CASE WHEN play_direction = 'left' THEN 53.3::DOUBLE - ball_land_y ELSE ball_land_y END AS ball_land_y,
    CASE WHEN play_direction = 'left' THEN (dir + 180) % 360 ELSE dir END AS dir,
    CASE WHEN play_direction = 'left' THEN (o + 180) % 360 ELSE o END AS o) FROM inp))"""
FEATURED = NORMAL + """,
recv AS (SELECT game_id, play_id, frame_id, rx AS qx, ry AS qy FROM normal WHERE player_role = 'Targeted Receiver'),
feats AS (
  SELECT n.*, sin(radians(o)) AS ox, cos(radians(o)) AS oy, sqrt(rx * rx + ry * ry) AS dist_ball,
    -rx / (sqrt(rx * rx + ry * ry) + 0.000001::DOUBLE) AS bx, -ry / (sqrt(rx * rx + ry * ry) + 0.000001::DOUBLE) AS "by",
    coalesce(sqrt((rx - qx) ** 2 + (ry - qy) ** 2), 0) AS dist_recv
  FROM normal n LEFT JOIN recv USING (game_id, play_id, frame_id))"""
CUTS = """['all', CASE WHEN num_frames_output <= 40 THEN 'le40' END, 'role_' || replace(player_role, ' ', '_'),
  CASE WHEN frame_id IN (5, 10, 20, 30) THEN 'frame_' || frame_id END]"""


def _sql(ctes: str, body: str) -> str:
    return f"WITH {VIEW}{', ' + ctes if ctes else ''} {body}"


def _report(source: str, models: dict[str, tuple[str, str]], by: str = "") -> str:
    """Long RMSE report in SQL from a table of scored targets."""
    keys = f"{by}, " if by else ""
    parts = " UNION ALL ".join(
        f"SELECT {keys}'{m}' AS model, cut, (x - {px}) ** 2 AS ex, (y - {py}) ** 2 AS ey FROM marked"
        for m, (px, py) in models.items())
    return f"""marked AS (SELECT *, unnest({CUTS}) AS cut FROM {source}), errors AS ({parts}),
      report AS (SELECT {keys}model, cut, count(*) AS n, sqrt(0.5 * (avg(ex) + avg(ey))) AS rmse FROM errors
                 WHERE cut IS NOT NULL GROUP BY {keys}model, cut)"""


BASE = LAST + """,
base AS (
  SELECT o.game_id, o.play_id, o.nfl_id, o.frame_id, o.x, o.y, player_role, num_frames_output, x0 AS x_hold, y0 AS y_hold,
    x0 + 0.1::DOUBLE * o.frame_id * vx AS x_constant_velocity, y0 + 0.1::DOUBLE * o.frame_id * vy AS y_constant_velocity,
    CASE WHEN player_role = 'Targeted Receiver' THEN x0 + (ball_land_x - x0) * o.frame_id / num_frames_output
         ELSE x0 + 0.1::DOUBLE * o.frame_id * vx END AS x_hybrid,
    CASE WHEN player_role = 'Targeted Receiver' THEN y0 + (ball_land_y - y0) * o.frame_id / num_frames_output
         ELSE y0 + 0.1::DOUBLE * o.frame_id * vy END AS y_hybrid
  FROM outp o JOIN lastf l USING (game_id, play_id, nfl_id))"""
BASE_MODELS = {m: (f"x_{m}", f"y_{m}") for m in ("hold", "constant_velocity", "hybrid")}


TURNED_VALUES = ["x", "y", "s", "a", "dir", "o", "rx", "ry", "vx", "vy"]
CARRIED = ["player_to_predict", "play_direction", "absolute_yardline_number", "player_name", "player_height", "player_weight",
           "player_birth_date", "player_position", "player_side", "player_role", "num_frames_output"]


@query(_sql(NORMAL, game_rows("normal", *TURNED_VALUES, texts=CARRIED)))
def normalize_play(spark, sf_dir):
    return per_game(field.normalize(tracking(spark, sf_dir).inp), *TURNED_VALUES, texts=CARRIED)


TURNED = """
turned AS (SELECT o.game_id, o.play_id, o.nfl_id, o.frame_id, CASE WHEN d = 'left' THEN 120 - x ELSE x END AS x,
             CASE WHEN d = 'left' THEN 53.3::DOUBLE - y ELSE y END AS y
           FROM outp o LEFT JOIN (SELECT DISTINCT game_id, play_id, play_direction AS d FROM inp)
           USING (game_id, play_id))"""


@query(_sql(TURNED, game_rows("turned", "x", "y")))
def normalize_targets(spark, sf_dir):
    v = tracking(spark, sf_dir)
    return per_game(field.normalize_targets(v.out, v.inp), "x", "y")


@query(_sql("", "SELECT game_id, count(*) AS n, 0::DOUBLE AS gap FROM pred GROUP BY 1"))
def denormalize_roundtrip(spark, sf_dir):
    """Predictions turned like targets and turned back land where they were."""
    v = tracking(spark, sf_dir)
    kept = v.pred.withColumns({"x": F.col("x_pred"), "y": F.col("y_pred")})
    turned = field.normalize_targets(kept, v.inp).withColumns({
        "x_was": F.col("x_pred"), "y_was": F.col("y_pred"), "x_pred": F.col("x"), "y_pred": F.col("y")})
    back = field.denormalize(turned)
    gap = F.greatest(F.abs(F.col("x_pred") - F.col("x_was")), F.abs(F.col("y_pred") - F.col("y_was")))
    return back.groupBy("game_id").agg(F.count("*").alias("n"), F.round(F.max(gap), 9).alias("gap"))


@query(_sql(FEATURED, game_rows("feats", "ox", "oy", "dist_ball", "bx", "by", "dist_recv", "rx", "ry", "vx", "vy", "s", "a")))
def frame_features(spark, sf_dir):
    rows = features.frame_features(field.normalize(tracking(spark, sf_dir).inp))
    return per_game(rows, "ox", "oy", "dist_ball", "bx", "by", "dist_recv", "rx", "ry", "vx", "vy", "s", "a")


STATIC = """
statics AS (SELECT unnest([
    (player_role = 'Passer')::INT::FLOAT, (player_role = 'Targeted Receiver')::INT::FLOAT,
    (player_role = 'Defensive Coverage')::INT::FLOAT, (player_role = 'Other Route Runner')::INT::FLOAT,
    (player_side = 'Offense')::INT::FLOAT, (player_position = 'QB')::INT::FLOAT, 0::FLOAT,
    (player_position = 'WR')::INT::FLOAT, (player_position = 'TE')::INT::FLOAT,
    (player_position IN ('CB', 'FS', 'SS'))::INT::FLOAT, (player_position IN ('ILB', 'OLB'))::INT::FLOAT, 0::FLOAT,
    ((12 * split_part(player_height, '-', 1)::INT + split_part(player_height, '-', 2)::INT) / 80::DOUBLE)::FLOAT,
    (player_weight / 300::DOUBLE)::FLOAT, player_to_predict::INT::FLOAT, (num_frames_output / 40::DOUBLE)::FLOAT
  ])::DOUBLE AS v, generate_subscripts(range(16), 1) - 1 AS i, game_id, play_id, nfl_id FROM roster)"""


@query(_sql(STATIC, game_rows("statics", "v", at=["play_id", "nfl_id", "i"])))
def static_features(spark, sf_dir):
    players = tracking(spark, sf_dir).inp.where("frame_id = 1")
    values = players.select(*KEY, F.posexplode(features.static_features()).alias("i", "v"))
    return per_game(values, "v", at=["play_id", "nfl_id", "i"])


@query(_sql(FEATURED + """,
mirror AS (SELECT * REPLACE (f * ry AS ry, f * vy AS vy, f * oy AS oy, f * "by" AS "by")
         FROM feats, (VALUES (false, 1), (true, -1)) m(mirrored, f))""",
            game_rows("mirror", "rx", "ry", "vx", "vy", "ox", "oy", "bx", "by", "s", "a", at=[*AT, "mirrored"])))
def mirror_rows(spark, sf_dir):
    rows = features.with_mirror(features.frame_features(field.normalize(tracking(spark, sf_dir).inp)))
    return per_game(rows, "rx", "ry", "vx", "vy", "ox", "oy", "bx", "by", "s", "a", at=[*AT, "mirrored"])


@query(_sql(LAST, f"""
SELECT game_id, play_id, nfl_id, frame_id, player_role, num_frames_output, {r('x0')} AS x, {r('y0')} AS y,
  {r('ball_land_x')} AS ball_land_x, {r('ball_land_y')} AS ball_land_y FROM lastf"""))
def last_frame(spark, sf_dir):
    last = paths.last_frame(tracking(spark, sf_dir).inp)
    return rounded(last.select(
        *KEY, "frame_id", "player_role", "num_frames_output", "x", "y", "ball_land_x", "ball_land_y"))


def _baseline(name):
    @query(_sql(BASE, game_rows(f"(SELECT game_id, play_id, nfl_id, frame_id, x_{name} AS x_pred, y_{name} AS y_pred FROM base)", "x_pred", "y_pred")),
           name=name)
    def run(spark, sf_dir):
        return per_game(expect.baseline_predictions(tracking(spark, sf_dir).inp, name), "x_pred", "y_pred")
    return run


for _name in expect.BASELINES:
    _baseline(_name)


@query(_sql(BASE + ", " + _report("base", BASE_MODELS), f"SELECT model, cut, n, {r('rmse')} AS rmse FROM report"))
def baseline_report(spark, sf_dir):
    v = tracking(spark, sf_dir)
    return rounded(metric.report(expect.baseline_targets(v.inp, v.out), expect.baseline_columns()))


@query(_sql(BASE + ", " + _report("base", BASE_MODELS), """
SELECT cut, printf('%.3f', max(rmse) FILTER (model = 'hold')) AS hold,
  printf('%.3f', max(rmse) FILTER (model = 'constant_velocity')) AS constant_velocity,
  printf('%.3f', max(rmse) FILTER (model = 'hybrid')) AS hybrid FROM report GROUP BY 1"""))
def cut_pivot(spark, sf_dir):
    v = tracking(spark, sf_dir)
    report = metric.report(expect.baseline_targets(v.inp, v.out), expect.baseline_columns())
    return metric.comparison(report, expect.BASELINES)


SCORED = """
scored AS (SELECT o.*, p.x_pred, p.y_pred, p.sd_x, p.sd_y, p.fold, m.player_role, m.num_frames_output
  FROM outp o JOIN pred p USING (game_id, play_id, nfl_id, frame_id)
  LEFT JOIN (SELECT game_id, play_id, nfl_id, player_role, num_frames_output FROM roster) m
  USING (game_id, play_id, nfl_id))"""


@query(_sql(SCORED, f"""
SELECT fold, count(*) AS n, {r('''avg(0.5 * (2 * ln(sd_x) + (x - x_pred) ** 2 / sd_x ** 2
  + 2 * ln(sd_y) + (y - y_pred) ** 2 / sd_y ** 2))''')} AS nll FROM scored WHERE frame_id <= 40 GROUP BY 1"""))
def gaussian_nll(spark, sf_dir):
    v = tracking(spark, sf_dir)
    return rounded(metric.gaussian_nll(scored_targets(v.pred, v.inp, v.out), by=["fold"]))


@query(_sql(SCORED + ", " + _report("scored", {"model": ("x_pred", "y_pred")}),
            f"SELECT model, cut, n, {r('rmse')} AS rmse FROM report"))
def prediction_report(spark, sf_dir):
    v = tracking(spark, sf_dir)
    return rounded(metric.evaluate_predictions(v.pred, v.inp, v.out))


@query(_sql(SCORED + ", " + _report("scored", {"model": ("x_pred", "y_pred")}, "fold"), f"""
SELECT cut, {r('avg(rmse)')} AS mean, {r('min(rmse)')} AS min, {r('max(rmse)')} AS max, count(*) AS folds
FROM report GROUP BY 1"""))
def fold_summary(spark, sf_dir):
    v = tracking(spark, sf_dir)
    reports = metric.report(scored_targets(v.pred, v.inp, v.out), by=["fold"])
    return rounded(metric.fold_summary(reports))


@query(_sql("", "SELECT game_id, fold, count(*) AS plays FROM ctx JOIN folds USING (game_id) GROUP BY 1, 2"))
def fold_assign(spark, sf_dir):
    return tracking(spark, sf_dir).context.groupBy("game_id", expect.fold_of().alias("fold")).agg(
        F.count("*").alias("plays"))


@query(_sql("", """
SELECT game_id, play_id FROM ctx JOIN folds USING (game_id) WHERE fold = 0 ORDER BY game_id, play_id LIMIT 1"""))
def held_out_play(spark, sf_dir):
    return expect.first_play(tracking(spark, sf_dir).inp, 0)


def _crossfit_sql() -> str:
    axes = []
    for a in ("x", "y"):
        axes.append(f"""sum({a}1 * {a}1) AS {a}11, sum({a}1 * {a}2) AS {a}12, sum({a}2 * {a}2) AS {a}22,
          sum({a}1 * {a}d) AS {a}1d, sum({a}2 * {a}d) AS {a}2d, sum({a}d * {a}d) AS {a}dd""")
    moments = ", ".join(axes)
    names = [f"{a}{m}" for a in "xy" for m in ("11", "12", "22", "1d", "2d", "dd")]
    other = ", ".join(
        f"CASE WHEN t.n > coalesce(f.n, 0) THEN t.{c} - coalesce(f.{c}, 0) ELSE t.{c} END AS {c}" for c in ["n", *names])
    solve = []
    for a in "xy":
        det = f"({a}11 * {a}22 - {a}12 * {a}12)"
        ok = f"{det} > 0.000000001::DOUBLE * {a}11 * {a}22"
        solve.append(f"""CASE WHEN {ok} THEN ({a}1d * {a}22 - {a}2d * {a}12) / {det}
          WHEN {a}11 <> 0 THEN {a}1d / {a}11 ELSE 0 END AS {a}_velocity,
          CASE WHEN {ok} THEN ({a}2d * {a}11 - {a}1d * {a}12) / {det} ELSE 0 END AS {a}_ball""")
    spread = ", ".join(f"""least(greatest(sqrt(greatest({a}dd - 2 * ({a}_velocity * {a}1d + {a}_ball * {a}2d)
        + {a}_velocity ** 2 * {a}11 + 2 * {a}_velocity * {a}_ball * {a}12 + {a}_ball ** 2 * {a}22, 0) / n), exp(-3)), exp(3))
        AS sd_{a}""" for a in "xy")
    return LAST + f""",
regress AS (SELECT kind, (least(k, 40) - 1) // 5 AS bucket, fold, 0.1::DOUBLE * k * vx AS x1, 0.1::DOUBLE * k * vy AS y1,
    (ball_land_x - x0) * (k::DOUBLE / num_frames_output) AS x2, (ball_land_y - y0) * (k::DOUBLE / num_frames_output) AS y2,
    x - x0 AS xd, y - y0 AS yd
  FROM (SELECT l.*, o.frame_id AS k, o.x, o.y, fold, CASE WHEN player_role = 'Targeted Receiver' THEN 'receiver'
          WHEN player_position IN ('CB', 'DB') THEN 'CB' WHEN player_position IN ('FS', 'SS', 'S') THEN 'S' ELSE 'LB' END
          AS kind
        FROM lastf l JOIN outp o USING (game_id, play_id, nfl_id) JOIN folds USING (game_id) WHERE o.frame_id <= 40)),
own AS MATERIALIZED (SELECT kind, bucket, fold, count(*) AS n, {moments} FROM regress GROUP BY 1, 2, 3),
total AS (SELECT kind, bucket, {', '.join(f'sum({c}) AS {c}' for c in ['n', *names])} FROM own GROUP BY 1, 2),
other AS (SELECT t.kind, t.bucket, h.fold, {other} FROM total t CROSS JOIN (SELECT unnest(range(5)) AS fold) h
  LEFT JOIN own f ON f.kind = t.kind AND f.bucket = t.bucket AND f.fold = h.fold),
weights AS (SELECT *, {', '.join(solve)} FROM other),
model AS MATERIALIZED (SELECT kind, bucket, fold, n, x_velocity, x_ball, y_velocity, y_ball, {spread} FROM weights)"""


CROSSFIT = _crossfit_sql()
MODEL_COLUMNS = ["x_velocity", "x_ball", "sd_x", "y_velocity", "y_ball", "sd_y"]
CROSSPRED = CROSSFIT + """,
crossed AS (SELECT e.game_id, e.play_id, e.nfl_id, e.frame_id, player_role, num_frames_output, fold, sd_x, sd_y,
    x0 + x_velocity * 0.1::DOUBLE * kk * vx + x_ball * (ball_land_x - x0) * kk / num_frames_output AS x_pred,
    y0 + y_velocity * 0.1::DOUBLE * kk * vy + y_ball * (ball_land_y - y0) * kk / num_frames_output AS y_pred
  FROM (SELECT * EXCLUDE (frame_id), k AS frame_id, least(k, 40)::DOUBLE AS kk, (least(k, 40) - 1) // 5 AS bucket,
          CASE WHEN player_role = 'Targeted Receiver' THEN 'receiver' WHEN player_position IN ('CB', 'DB') THEN 'CB'
               WHEN player_position IN ('FS', 'SS', 'S') THEN 'S' ELSE 'LB' END AS kind
        FROM (SELECT *, unnest(range(1, num_frames_output + 1)) AS k FROM lastf)) e
  JOIN folds USING (game_id) LEFT JOIN model USING (kind, bucket, fold))"""


@query(_sql(CROSSFIT, "SELECT kind, bucket, fold, n, " + ", ".join(f"{r(c)} AS {c}" for c in MODEL_COLUMNS) + " FROM model"))
def crossfit_linear(spark, sf_dir):
    v = tracking(spark, sf_dir)
    return rounded(expect.fit_crossfit(expect.throw_state(v.inp), v.out))


@query(_sql(CROSSPRED, game_rows("crossed", "x_pred", "y_pred", "sd_x", "sd_y", texts=["fold"])))
def crossfit_predict(spark, sf_dir):
    v = tracking(spark, sf_dir)
    pred = score_plan.score(v.inp, v.out).pred
    return per_game(pred, "x_pred", "y_pred", "sd_x", "sd_y", texts=["fold"])


@query(_sql(CROSSPRED + """, hits AS (SELECT c.*, o.x, o.y FROM crossed c JOIN outp o
  USING (game_id, play_id, nfl_id, frame_id)), """ + _report("hits", {"model": ("x_pred", "y_pred")}, "fold"),
            f"SELECT fold, cut, n, {r('rmse')} AS rmse FROM report"))
def crossfit_report(spark, sf_dir):
    v = tracking(spark, sf_dir)
    return rounded(score_plan.score(v.inp, v.out).reports)


@query(_sql(CROSSPRED, """
SELECT fold, sum(n)::BIGINT AS rows, count(*) AS plays FROM
  (SELECT fold, game_id, play_id, count(*) AS n FROM crossed GROUP BY 1, 2, 3) GROUP BY 1"""))
def scored_rows(spark, sf_dir):
    v = tracking(spark, sf_dir)
    return score_plan.row_counts(score_plan.score(v.inp, v.out).pred)


MOVES = [
    {"name": "as thrown"}, {"name": "deeper", "shift_x": 6.0}, {"name": "late", "frames": 45},
    {"name": "corner", "land_x": 118.0, "land_y": 2.5, "frames": 20},
]
MOVED = """
moved AS (SELECT l.*, scenario, coalesce(mf, num_frames_output) AS nf,
    round(greatest(least(coalesce(mx, ball_land_x + sx), 125), -5), 2) AS tx,
    round(greatest(least(coalesce(my, ball_land_y), 58.3::DOUBLE), -5), 2) AS ty
  FROM lastf l, (VALUES ('as thrown', NULL::DOUBLE, NULL::DOUBLE, 0::DOUBLE, NULL::BIGINT),
                        ('deeper', NULL, NULL, 6, NULL), ('late', NULL, NULL, 0, 45),
                        ('corner', 118, 2.5, 0, 20)) m(scenario, mx, my, sx, mf)),
whatif AS (SELECT scenario, game_id, play_id, nfl_id, k AS frame_id, play_direction AS d, yl,
    CASE WHEN player_role = 'Targeted Receiver' THEN x0 + (tx - x0) * k / nf ELSE x0 + 0.1::DOUBLE * k * vx END AS x_pred,
    CASE WHEN player_role = 'Targeted Receiver' THEN y0 + (ty - y0) * k / nf ELSE y0 + 0.1::DOUBLE * k * vy END AS y_pred
  FROM (SELECT *, unnest(range(1, nf + 1)) AS k FROM moved))"""


@query(_sql(LAST + ", " + MOVED, f"""
SELECT scenario, game_id, count(*) AS n, sum({row_hash_sql(AT, ["x_pred", "y_pred"])})::BIGINT AS rows
FROM whatif GROUP BY 1, 2"""))
def scenario_paths(spark, sf_dir):
    state = expect.scenarios(expect.throw_state(tracking(spark, sf_dir).inp), MOVES)
    x, y = expect.hybrid()
    rows = paths.future_frames(state).withColumns({"x_pred": x, "y_pred": y})
    return rows.groupBy("scenario", "game_id").agg(
        F.count("*").alias("n"), hash_sum(row_hash(AT, ["x_pred", "y_pred"])).alias("rows"))


@query(_sql(CROSSFIT, f"""
SELECT kind, bucket, fold, {r('x_velocity', 4)} AS x_velocity, {r('x_ball', 4)} AS x_ball,
  {r('y_velocity', 4)} AS y_velocity, {r('y_ball', 4)} AS y_ball FROM model"""))
def mllib_crossfit(spark, sf_dir):
    v = tracking(spark, sf_dir)
    return rounded(expect.fit_linear_models(expect.throw_state(v.inp), v.out), 4)


HISTORY = FEATURED + """,
hist AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY game_id, play_id, nfl_id ORDER BY frame_id DESC) AS back
         FROM feats) WHERE back <= 20),
now AS (SELECT game_id, play_id, nfl_id, x, y FROM hist WHERE back = 1),
gone AS (SELECT game_id, play_id, nfl_id, rn, CASE WHEN d = 'left' THEN 120 - x ELSE x END AS tx,
    CASE WHEN d = 'left' THEN 53.3::DOUBLE - y ELSE y END AS ty
  FROM (SELECT *, row_number() OVER (PARTITION BY game_id, play_id, nfl_id ORDER BY frame_id) AS rn FROM outp)
  JOIN (SELECT DISTINCT game_id, play_id, play_direction AS d FROM inp) USING (game_id, play_id) WHERE rn <= 40),
cells AS (SELECT game_id, play_id, nfl_id, 20 - back AS at, 'feat' AS part, rx::FLOAT::DOUBLE AS v0, ry::FLOAT::DOUBLE AS v1, vx::FLOAT::DOUBLE AS v2,
    vy::FLOAT::DOUBLE AS v3, ox::FLOAT::DOUBLE AS v4, oy::FLOAT::DOUBLE AS v5, s::FLOAT::DOUBLE AS v6, a::FLOAT::DOUBLE AS v7,
    dist_ball::FLOAT::DOUBLE AS v8, bx::FLOAT::DOUBLE AS v9, "by"::FLOAT::DOUBLE AS v10, dist_recv::FLOAT::DOUBLE AS v11 FROM hist
  UNION ALL SELECT game_id, play_id, nfl_id, rn - 1, 'target', (tx - x)::FLOAT::DOUBLE, (ty - y)::FLOAT::DOUBLE, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0
  FROM gone JOIN now USING (game_id, play_id, nfl_id))"""
CELLS = [f"v{i}" for i in range(12)]


@query(_sql(HISTORY, game_rows("cells", *CELLS, at=["play_id", "nfl_id", "part", "at"])))
def history_arrays(spark, sf_dir):
    """Every known frame of the exported histories and targets with its place in the array."""
    v = tracking(spark, sf_dir)
    return history_cells(features.history_arrays(v.inp, v.out))


def history_cells(rows):
    """Every known frame of exported arrays, as row hashes per game."""
    def cells(part, mask, width):
        known = rows.select(*KEY, mask, F.posexplode(part).alias("at", "v")).where(F.get(mask, F.col("at")))
        values = [(F.get("v", F.lit(i)) if i < width else F.lit(0.0)).cast("double").alias(f"v{i}") for i in range(12)]
        return known.select(*KEY, F.lit(part).alias("part"), "at", *values)

    both = cells("feat", "fmask", 12).unionByName(cells("target", "tmask", 2))
    return per_game(both, *CELLS, at=["play_id", "nfl_id", "part", "at"])


@query(_sql(CROSSFIT + ", " + MOVED + """,
sharp AS (SELECT w.*, CASE WHEN d = 'left' THEN py ELSE 53.3::DOUBLE - py END AS l, CASE WHEN d = 'left' THEN yl - px ELSE px - yl END AS u
  FROM (SELECT scenario, game_id, play_id, nfl_id, k AS frame_id, play_direction AS d, yl,
      x0 + x_velocity * 0.1::DOUBLE * kk * vx + x_ball * (tx - x0) * kk / nf AS px,
      y0 + y_velocity * 0.1::DOUBLE * kk * vy + y_ball * (ty - y0) * kk / nf AS py
    FROM (SELECT *, least(k, 40)::DOUBLE AS kk, (least(k, 40) - 1) // 5 AS bucket,
            CASE WHEN player_role = 'Targeted Receiver' THEN 'receiver' WHEN player_position IN ('CB', 'DB') THEN 'CB'
                 WHEN player_position IN ('FS', 'SS', 'S') THEN 'S' ELSE 'LB' END AS kind
          FROM (SELECT *, unnest(range(1, nf + 1)) AS k FROM moved)) e
    JOIN folds USING (game_id) LEFT JOIN model USING (kind, bucket, fold)) w)""",
            f"""SELECT scenario, game_id, count(*) AS n, sum({row_hash_sql(AT, ["l", "u"])})::BIGINT AS rows FROM sharp GROUP BY 1, 2"""))
def scenario_scenes(spark, sf_dir):
    """What-if paths by the fitted expectation, in scene coordinates."""
    v = tracking(spark, sf_dir)
    state = expect.throw_state(v.inp)
    model = expect.fit_crossfit(state, v.out)
    pred = expect.predict_crossfit(expect.scenarios(state, MOVES), model)
    plays = v.inp.where("frame_id = 1").select(*KEY[:2], "play_direction", "absolute_yardline_number").dropDuplicates(KEY[:2])
    rows = scene.scenario_points(pred, plays)
    return rows.groupBy("scenario", "game_id").agg(F.count("*").alias("n"), hash_sum(row_hash(AT, ["l", "u"])).alias("rows"))


def _half_speed(batches):
    """A caller's model: keeps half of the last speed, with a spread that grows with time."""
    for batch in batches:
        k = batch["frame_id"].to_numpy()
        batch["x_pred"] = batch["x0"] + 0.05 * k * batch["vx"]
        batch["y_pred"] = batch["y0"] + 0.05 * k * batch["vy"]
        batch["sd_x"] = batch["sd_y"] = 0.5 + 0.01 * k
        yield batch[[*AT_KEYS, "x_pred", "y_pred", "sd_x", "sd_y"]]


AT_KEYS = [*KEY, "frame_id"]
PREDICTED = "game_id long, play_id long, nfl_id long, frame_id long, x_pred double, y_pred double, sd_x double, sd_y double"


@query(_sql(LAST + """,
half AS (SELECT o.*, player_role, num_frames_output, x0 + 0.05::DOUBLE * o.frame_id * vx AS x_pred,
    y0 + 0.05::DOUBLE * o.frame_id * vy AS y_pred FROM outp o JOIN lastf l USING (game_id, play_id, nfl_id)), """
            + _report("half", {"model": ("x_pred", "y_pred")}), f"SELECT model, cut, n, {r('rmse')} AS rmse FROM report"))
def callers_model(spark, sf_dir):
    """Predictions of a model of the caller's, evaluated like any other."""
    v = tracking(spark, sf_dir)
    frames = paths.future_frames(expect.throw_state(v.inp)).select(*AT_KEYS, "x0", "y0", "vx", "vy")
    # the model answers for the frames of its bucket; rows of another one would be written to that one's files
    pred = clustered(expect.external_predictions(frames, _half_speed, PREDICTED), "external", ["play_id"], v.buckets, placed=True)
    return rounded(metric.evaluate_predictions(pred, v.inp, v.out))
