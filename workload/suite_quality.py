"""Validation and reconciliation queries, on the derived tables with faults put in by arithmetic on the keys."""

from pyspark.sql import functions as F

from pursuit.operators import paths, quality, stretches
from pursuit.schema import FRAME
from pursuit.staging import staged
from workload.oracle_view import VIEW
from workload.registry import ORACLES, query, r, rounded
from workload.tracking import tracking


def _sql(ctes: str, body: str) -> str:
    return f"WITH {VIEW}{', ' + ctes if ctes else ''} {body}"


@query(_sql("", """
SELECT game_id, play_id, nfl_id, frame_id, d AS play_direction FROM (
  SELECT *, CASE WHEN nfl_id % 13 = 0 AND frame_id = 3 THEN 'up' WHEN nfl_id % 17 = 0 AND frame_id = 4 THEN NULL
            ELSE play_direction END AS d FROM inp) WHERE d NOT IN ('left', 'right')"""))
def domain_violations(spark, sf_dir):
    wrong = F.when((F.col("nfl_id") % 13 == 0) & (F.col("frame_id") == 3), "up").when(
        (F.col("nfl_id") % 17 != 0) | (F.col("frame_id") != 4), F.col("play_direction"))
    inp = tracking(spark, sf_dir).inp.withColumn("play_direction", wrong)
    return quality.domain_violations(inp).select(*FRAME, "play_direction")


@query(_sql("", """
SELECT game_id, play_id, nfl_id, min(frame_id) AS lo, max(frame_id) AS hi, count(*) AS n FROM inp
WHERE NOT (nfl_id % 7 = 0 AND frame_id = 5) GROUP BY 1, 2, 3
HAVING min(frame_id) <> 1 OR max(frame_id) <> count(*)"""))
def contiguity_violations(spark, sf_dir):
    inp = tracking(spark, sf_dir).inp.where("NOT (nfl_id % 7 = 0 AND frame_id = 5)")
    return quality.contiguity_violations(quality.player_profile(inp))


@query(_sql("""
announced AS (SELECT game_id, play_id, nfl_id, min(num_frames_output) AS num_frames_output FROM inp
              WHERE player_to_predict AND nfl_id % 23 <> 0 GROUP BY 1, 2, 3),
counts AS (SELECT game_id, play_id, nfl_id, count(*) AS n FROM outp
           WHERE nfl_id % 19 <> 0 AND NOT (nfl_id % 9 = 0 AND frame_id = 1) GROUP BY 1, 2, 3)""", """
SELECT * FROM announced FULL JOIN counts USING (game_id, play_id, nfl_id)
WHERE n IS NULL OR num_frames_output IS NULL OR n <> num_frames_output"""))
def count_reconciliation(spark, sf_dir):
    v = tracking(spark, sf_dir)
    out = v.out.where("nfl_id % 19 <> 0 AND NOT (nfl_id % 9 = 0 AND frame_id = 1)")
    return quality.count_violations(quality.player_profile(v.inp.where("nfl_id % 23 <> 0")), out)


@query(_sql("""
steps AS (SELECT week, s, radians(dir) AS rad,
            lead(x) OVER w - x AS dx, lead(y) OVER w - y AS dy
          FROM inp JOIN (SELECT game_id, play_id, week FROM ctx) USING (game_id, play_id) WINDOW w AS (PARTITION BY game_id, play_id, nfl_id ORDER BY frame_id)),
errors AS (SELECT week,
    sqrt(avg((dx - 0.1::DOUBLE * s * sin(rad)) ** 2 + (dy - 0.1::DOUBLE * s * cos(rad)) ** 2)) AS a,
    sqrt(avg((dx - 0.1::DOUBLE * s * cos(rad)) ** 2 + (dy - 0.1::DOUBLE * s * sin(rad)) ** 2)) AS b
  FROM steps WHERE dx IS NOT NULL AND s > 1 GROUP BY 1)""", f"SELECT 2023 AS season, week, {r('a')} AS a, {r('b')} AS b, a < b / 5 AS ok FROM errors"))
def angle_check(spark, sf_dir):
    v = tracking(spark, sf_dir)
    weeks = v.context.select("game_id", "play_id", "week", F.lit(2023).alias("season"))
    # frames meet the week of their play where they lie; stretches have no such layout any more and would be exchanged
    rows = stretches.stretches(v.inp.join(weeks.hint("shuffle_hash"), ["game_id", "play_id"]))
    return rounded(stretches.angle_errors(staged(rows, "stretches")))


@query(_sql("", """
SELECT game_id, play_id, count(*) AS n FROM (SELECT game_id, play_id FROM ctx
  UNION ALL SELECT game_id, play_id FROM ctx WHERE play_id % 50 = 0) GROUP BY 1, 2 HAVING count(*) > 1"""))
def unique_violations(spark, sf_dir):
    context = tracking(spark, sf_dir).context
    return quality.duplicate_plays(context.unionByName(context.where("play_id % 50 = 0")))


def _arrived(v, inp=None, pred=None):
    return paths.arrivals(inp if inp is not None else v.inp, v.out, pred if pred is not None else v.pred)


@query(_sql("", """
SELECT game_id, play_id, count(*) FILTER (role = 'Targeted Receiver') AS receivers FROM (
  SELECT game_id, play_id, nfl_id,
    arg_max(CASE WHEN nfl_id % 23 = 0 THEN 'Targeted Receiver' ELSE player_role END, frame_id) AS role
  FROM inp WHERE player_to_predict GROUP BY 1, 2, 3)
GROUP BY 1, 2 HAVING count(*) FILTER (role = 'Targeted Receiver') <> 1"""))
def receiver_violations(spark, sf_dir):
    v = tracking(spark, sf_dir)
    role = F.when(F.col("nfl_id") % 23 == 0, "Targeted Receiver").otherwise(F.col("player_role"))
    return quality.receiver_violations(_arrived(v, inp=v.inp.withColumn("player_role", role)))


@query(_sql("", """
SELECT DISTINCT game_id, play_id, nfl_id FROM inp WHERE player_to_predict AND nfl_id % 29 = 0"""))
def arrival_violations(spark, sf_dir):
    v = tracking(spark, sf_dir)
    return quality.arrival_violations(_arrived(v, pred=v.pred.where("nfl_id % 29 <> 0")))


@query(_sql("", """
SELECT DISTINCT game_id, play_id FROM inp i WHERE NOT EXISTS (
  SELECT 1 FROM ctx c WHERE c.play_id % 10 <> 3 AND c.game_id = i.game_id AND c.play_id = i.play_id)"""))
def context_anti(spark, sf_dir):
    v = tracking(spark, sf_dir)
    return quality.plays_without_context(v.inp, v.context.where("play_id % 10 <> 3"))


@query(_sql("", """
SELECT o.game_id, o.play_id, o.nfl_id, o.frame_id FROM outp o ANTI JOIN
  (SELECT * FROM pred WHERE NOT (frame_id % 6 = 0 AND nfl_id % 4 = 0)) p USING (game_id, play_id, nfl_id, frame_id)"""))
def prediction_anti(spark, sf_dir):
    v = tracking(spark, sf_dir)
    pred = v.pred.where("NOT (frame_id % 6 = 0 AND nfl_id % 4 = 0)")
    return quality.uncovered_targets(v.out, pred)


@query(_sql("""
two AS (SELECT * FROM pred UNION ALL SELECT * FROM pred WHERE frame_id % 9 = 0),
dup AS (SELECT game_id, play_id, nfl_id, frame_id FROM two GROUP BY 1, 2, 3, 4 HAVING count(*) > 1)""", """
SELECT game_id, play_id, nfl_id, frame_id, 2 AS n FROM dup SEMI JOIN outp USING (game_id, play_id, nfl_id, frame_id)"""))
def prediction_duplicates(spark, sf_dir):
    v = tracking(spark, sf_dir)
    pred = v.pred.unionByName(v.pred.where("frame_id % 9 = 0"))
    return quality.repeated_predictions(v.out, pred)


@query(_sql("""
other AS (SELECT game_id, play_id, nfl_id, frame_id,
            x_pred + CASE WHEN frame_id = 3 THEN 0.0005 ELSE 0 END::DOUBLE AS x_pred, y_pred
          FROM pred WHERE nfl_id % 31 <> 0),
sums AS (SELECT count(p.x_pred) AS rows_a, count(o.x_pred) AS rows_b, count(p.x_pred + o.x_pred) AS matched,
           max(greatest(abs(p.x_pred - o.x_pred), abs(p.y_pred - o.y_pred))) AS gap
         FROM pred p FULL JOIN other o USING (game_id, play_id, nfl_id, frame_id))""", f"""
SELECT rows_a, rows_b, matched, {r('gap')} AS gap, rows_a = matched AND rows_b = matched AND gap <= 0.001 AS ok
FROM sums"""))
def prediction_diff(spark, sf_dir):
    pred = tracking(spark, sf_dir).pred
    moved = F.col("x_pred") + F.when(F.col("frame_id") == 3, 0.0005).otherwise(0.0)
    return rounded(quality.prediction_gap(pred, pred.where("nfl_id % 31 <> 0").withColumn("x_pred", moved)))


@query(_sql("", """
SELECT 'x_pred' AS name, count(*) AS n FROM pred WHERE frame_id % 12 = 0
UNION ALL SELECT 'sd_x', count(*) FROM pred WHERE nfl_id % 37 = 0"""))
def finite_guard(spark, sf_dir):
    pred = tracking(spark, sf_dir).pred.withColumns({
        "x_pred": F.when(F.col("frame_id") % 12 == 0, F.lit(float("inf"))).otherwise(F.col("x_pred")),
        "sd_x": F.when(F.col("nfl_id") % 37 == 0, F.lit(float("nan"))).otherwise(F.col("sd_x")),
    })
    return quality.non_finite_values(pred)


@query(_sql("", """
SELECT game_id, play_id, nfl_id, min(frame_id) AS lo, max(frame_id) AS hi, count(*) AS n, 0 AS bad_direction,
  count(*) FILTER (player_to_predict) AS predicted,
  CASE WHEN bool_or(player_to_predict) THEN min(num_frames_output) END AS num_frames_output
FROM inp GROUP BY 1, 2, 3"""))
def player_profile(spark, sf_dir):
    return quality.player_profile(tracking(spark, sf_dir).inp)


@query(ORACLES["player_profile"])
def gathered_profile(spark, sf_dir):
    """The same profile from the pass that also gathers the angle errors."""
    return stretches.profile(stretches.stretches(tracking(spark, sf_dir).inp))


@query(_sql("", """
SELECT 'input' AS name, 'dir' AS missing, count(*) AS n FROM inp UNION ALL SELECT 'output', 'x', count(*) FROM outp"""))
def required_columns(spark, sf_dir):
    """What the check says about tables that lack a column each."""
    v = tracking(spark, sf_dir)
    rows = None
    for name, inp, out in (("input", v.inp.drop("dir"), v.out), ("output", v.inp, v.out.drop("x"))):
        try:
            quality.require_columns(inp, out)
        except quality.ValidationError as e:
            missing = str(e).split("['")[1].rstrip("']")
            row = (inp if name == "input" else out).agg(F.lit(name).alias("name"), F.lit(missing).alias("missing"), F.count("*").alias("n"))
            rows = row if rows is None else rows.unionByName(row)
    return rows


@query(_sql("", """
SELECT count(*) FILTER (frame_id = 1) AS rows, (SELECT count(*) FROM inp WHERE frame_id < 0) AS none, 'nothing to score' AS refused
FROM inp"""))
def empty_guard(spark, sf_dir):
    """A table with rows passes, one without is refused by name."""
    inp = tracking(spark, sf_dir).inp
    first, none = inp.where("frame_id = 1"), inp.where("frame_id < 0")
    quality.require_rows(first, "nothing to rate")
    refused = None
    try:
        quality.require_rows(none, "nothing to score")
    except quality.ValidationError as e:
        refused = str(e)
    return inp.agg(F.count_if(F.col("frame_id") == 1).alias("rows"), F.count_if(F.col("frame_id") < 0).alias("none"),
                   F.lit(refused).alias("refused"))
