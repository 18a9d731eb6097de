"""Published rows, nested documents, scenes, requests, streams and the publication job."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from pursuit.functions.geometry import from_scrimmage, to_scrimmage
from pursuit.operators import board, documents, gate, metric, quality, scene
from pursuit.plans import prepare, rate
from pursuit.plans import score as score_plan
from pursuit.schema import CONTEXT_COLUMNS, INPUT_SCHEMA, MAX_ROWS, OUTPUT_SCHEMA, PLAY
from pursuit.sources import documents as sinks
from pursuit.sources import requests as req
from pursuit.sources import tracking as files
from pursuit.staging import clustered, rename, staged, staging_path
from pursuit.streaming.requests import stream_requests
from pursuit.streaming.weeks import stream_weeks
from workload.oracle_view import VIEW
from workload.registry import AT, game_rows, hash_sum, per_game, query, r, rd, row_hash, row_hash_sql
from workload.suite_models import CROSSPRED, SCORED, _report
from workload.suite_ratings import CENTERED, GATED_CELLS, HALVES, PICKS, PLAYERS, PUBLISHED, SPREAD, base
from workload.tracking import source_state, tracking


def _sql(ctes: str, body: str) -> str:
    return f"WITH {VIEW}{', ' + ctes if ctes else ''} {body}"


@query(_sql(PUBLISHED, "SELECT * FROM published"))
def plays_export(spark, sf_dir):
    return documents.published(base(spark, sf_dir).table)


@query(_sql(PUBLISHED, "SELECT * FROM published"))
def columnar_roundtrip(spark, sf_dir):
    """Published rows written as columnar documents, one a play, read back and typed."""
    rows = base(spark, sf_dir).rows
    path = staging_path(spark, "columnar")
    sinks.write_columnar(rows, ["game", "play", "id"], ["game", "play"], path)
    return sinks.read_columnar(spark, path, rows.schema)


_documents = {}
_given = {}     # what queries take as given: the bodies of requests, and weeks as raw files


def derive(spark, sf_dir) -> None:
    """Write the inputs that the queries on requests and raw weeks read, so that a bench can time these alone."""
    bodies(spark, sf_dir)
    raw_weeks(spark, sf_dir)


def bodies(spark, sf_dir):
    at = ("bodies", *source_state(spark, sf_dir))
    if at not in _given:
        _given[at] = staged(request_bodies(spark, sf_dir), "bodies")
    return _given[at]


def raw_weeks(spark, sf_dir) -> str:
    at = ("weeks", *source_state(spark, sf_dir))
    if at not in _given:
        _given[at] = staging_path(spark, "raw")
        _write_raw_weeks(spark, sf_dir, _given[at])
    return _given[at]


def _plays(spark, sf_dir):
    at = source_state(spark, sf_dir)
    if at not in _documents:
        v = tracking(spark, sf_dir)
        docs = documents.play_documents(v.inp, v.out, v.pred, base(spark, sf_dir).table, v.context)
        # made of the entries without an exchange of frames, so they lie in the buckets of these already
        _documents[at] = clustered(docs, "play-documents", ["play_id"], v.buckets, placed=True)
    return _documents[at]


def reset(keep_entries: bool = False) -> None:
    from workload import suite_ratings

    _documents.clear()
    if not keep_entries:
        _given.clear()
    suite_ratings.reset(keep_entries)


INPUT_TEXTS = ["player_to_predict", "play_direction", "absolute_yardline_number", "player_name", "player_height", "player_weight",
               "player_birth_date", "player_position", "player_side", "player_role", "num_frames_output"]
INPUT_NUMBERS = ["x", "y", "s", "a", "dir", "o", "ball_land_x", "ball_land_y"]
CENTS = ", ".join(f"round({c}, 2) AS {c}" for c in INPUT_NUMBERS)
# every value of a document on one row per frame and path: inputs, actual and expected places
PATHS = f"""
cents AS (SELECT * REPLACE ({CENTS}) FROM inp),
values_of AS (
  SELECT game_id, play_id, nfl_id, frame_id, 'in' AS path, x AS v0, y AS v1, s AS v2, a AS v3, dir AS v4, o AS v5 FROM cents
  UNION ALL SELECT game_id, play_id, nfl_id, frame_id, 'out', round(x, 2), round(y, 2), 0, 0, 0, 0 FROM outp
  UNION ALL SELECT game_id, play_id, nfl_id, frame_id, 'pred', round(x_pred, 2), round(y_pred, 2), round(sd_x, 2), round(sd_y, 2), 0, 0 FROM pred)"""
VALUES = [f"v{i}" for i in range(6)]


def _frames(docs):
    """The frames of play documents, one row per frame and path."""
    def of(path, width):
        rows = docs.select("game_id", "play_id", "nfl_id", "run", F.posexplode(f"player.{path}").alias("at", "v"))
        return rows.select(
            "game_id", "play_id", "nfl_id", (F.col("run") * documents.TRACK_RUN + F.col("at") + 1).alias("frame_id"),
            F.lit(path).alias("path"), *[(F.get("v", F.lit(i)) if i < width else F.lit(0.0)).alias(f"v{i}") for i in range(6)])

    return of("in", 6).unionByName(of("out", 2)).unionByName(of("pred", 4))


@query(_sql(PATHS, game_rows("values_of", *VALUES, at=[*AT, "path"])))
def game_documents(spark, sf_dir):
    """Every frame of every game's documents."""
    return per_game(_frames(_plays(spark, sf_dir)), *VALUES, at=[*AT, "path"])


@query(_sql("", """
SELECT game_id AS game, arg_min(week, play_id) AS week, arg_min(home, play_id) AS home, arg_min(away, play_id) AS away,
  count(*) AS plays FROM ctx GROUP BY 1"""))
def game_headers(spark, sf_dir):
    return documents.game_headers(_plays(spark, sf_dir))


STATIC_TEXTS = ["run", "week", "home", "away", "desc", "q", "clock", "down", "dist", "off", "def", "result", "cov", "mz", "route", "dir",
                "yl", "nfo", "name", "pos", "side", "role", "h", "w", "b", "p", "rated", "rrole", "ex"]
STATIC_NUMBERS = ["lx", "ly", "zc", "yards"]


@query(_sql(CENTERED + f""",
docs AS (SELECT r.game_id, r.play_id, r.nfl_id, 0 AS run, c.week, c.home, c.away, c."desc", c.q, c.clock, c.down, c.dist, c.off, c.team AS def,
    c.result, c.cov, c.mz, c.route, play_direction AS dir, absolute_yardline_number AS yl, num_frames_output AS nfo,
    player_name AS name, player_position AS pos, player_side AS side, player_role AS role, player_height AS h, player_weight AS w,
    player_birth_date AS b, player_to_predict AS p, d.nfl_id IS NOT NULL AS rated, d.role AS rrole, d.ex AS ex,
    ball_land_x AS lx, ball_land_y AS ly, {rd('d.zc', 6)} AS zc, {rd('d.yards', 2)} AS yards
  FROM roster r JOIN ctx c USING (game_id, play_id) LEFT JOIN centered d ON d.game_id = r.game_id AND d.play_id = r.play_id AND d.nfl_id = r.nfl_id)""",
            game_rows("docs", *STATIC_NUMBERS, at=["play_id", "nfl_id"], texts=STATIC_TEXTS)))
def document_rows(spark, sf_dir):
    """What a document row says besides its frames: context, player and rating."""
    docs = _plays(spark, sf_dir)
    rows = docs.select(
        "game_id", "play_id", "nfl_id", *STATIC_TEXTS[:18], *[F.col(f"player.{c}").alias(c) for c in STATIC_TEXTS[18:26]],
        F.col("rating").isNotNull().alias("rated"), F.col("rating.role").alias("rrole"), F.col("rating.ex").alias("ex"),
        F.get("land", F.lit(0)).alias("lx"), F.get("land", F.lit(1)).alias("ly"), "rating.zc", "rating.yards")
    return per_game(rows, *STATIC_NUMBERS, at=["play_id", "nfl_id"], texts=STATIC_TEXTS)


@query(_sql(PATHS, game_rows("cents", *INPUT_NUMBERS, texts=INPUT_TEXTS)))
def api_rows_roundtrip(spark, sf_dir):
    """Game documents written as JSON, read back and turned into input rows again: all 23 columns."""
    docs = _plays(spark, sf_dir)
    path = staging_path(spark, "games")
    sinks.write_games(docs, documents.game_headers(docs), path)
    return per_game(documents.input_rows(sinks.read_games(spark, path, docs.schema)), *INPUT_NUMBERS, texts=INPUT_TEXTS)


@query(_sql(f"{PUBLISHED}, {PICKS}", f"""
SELECT p.id, p.game, p.play, week, home, away, name, zc, players, frames, rows
FROM picks p JOIN (SELECT game_id AS game, play_id AS play, count(DISTINCT nfl_id) AS players, count(*) AS frames,
    sum({row_hash_sql(["nfl_id", "frame_id"], ["x", "y"])})::BIGINT AS rows
  FROM (SELECT * REPLACE (round(x, 2) AS x, round(y, 2) AS y) FROM inp) GROUP BY 1, 2) USING (game, play)
JOIN (SELECT game_id AS game, play_id AS play, home, away FROM ctx) USING (game, play)"""))
def highlight_scenes(spark, sf_dir):
    reel = documents.highlights(board.highlight_picks(base(spark, sf_dir).rows), _plays(spark, sf_dir))
    pick = ["id", "game", "play", "week", "home", "away", "name", "zc"]
    frames = reel.select(*pick, F.col("scene.player.id").alias("nfl_id"), "scene.run", F.posexplode("scene.player.in").alias("at", "v"))
    frames = frames.withColumns({
        "frame_id": F.col("run") * documents.TRACK_RUN + F.col("at") + 1, "x": F.get("v", F.lit(0)), "y": F.get("v", F.lit(1))})
    return frames.groupBy(*pick).agg(
        F.count_distinct("nfl_id").alias("players"), F.count("*").alias("frames"), hash_sum(row_hash(["nfl_id", "frame_id"], ["x", "y"])).alias("rows"))


@query(_sql(f"{PLAYERS}, {SPREAD}, {GATED_CELLS}, {SCORED}, {_report('scored', {'model': ('x_pred', 'y_pred')}, 'fold')}", f"""
SELECT 'r1' AS run, count(*) AS plays, count(DISTINCT game_id) AS games, (SELECT count(*) FROM shrink) AS groups,
  (SELECT {r('sum(k)', 4)} FROM shrink) AS k, (SELECT count(*) FROM cells) AS cells, (SELECT {r('0.25 * sd')} FROM spread) AS "limit",
  (SELECT {r('avg(rmse)')} FROM report WHERE cut = 'all') AS rmse, (SELECT count(*) FROM report WHERE cut = 'all') AS folds
FROM (SELECT DISTINCT game_id, play_id FROM centered)"""))
def meta_counts(spark, sf_dir):
    """The run's metadata with its gate, shrinkage and fold summary."""
    b, v = base(spark, sf_dir), tracking(spark, sf_dir)
    summary = metric.fold_summary(metric.report(metric.scored_targets(v.pred, v.inp, v.out), by=["fold"]))
    meta = documents.meta_row(b.table, gate.gate(b.table, b.players), b.shrink, "r1", "2026-01-01T00:00:00Z", summary)
    ks = F.aggregate(F.map_values("shrink"), F.lit(0.0), lambda s, e: s + e["k"])
    every = F.try_element_at("summary", F.lit("all"))
    return meta.select(
        "run", "counts.plays", "counts.games", F.size("shrink").cast("long").alias("groups"), F.round(ks, 4).alias("k"),
        F.col("gate.cells.n").alias("cells"), F.round("gate.limit", 6).alias("limit"),
        F.round(every["mean"], 6).alias("rmse"), every["folds"].alias("folds"))


SCENE = """
ends AS MATERIALIZED (
  SELECT game_id, play_id, nfl_id, player_role, player_side, player_to_predict, play_direction AS d, absolute_yardline_number AS yl,
    n_in AS n, num_frames_output AS nfo, ball_land_x AS lx, ball_land_y AS ly, x0, y0,
    max(n_in) OVER (PARTITION BY game_id, play_id) AS n_max,
    x0 + 0.1::DOUBLE * (1 - n_in) * vx AS xf, y0 + 0.1::DOUBLE * (1 - n_in) * vy AS yf FROM roster),
points AS (
  SELECT i.game_id, i.play_id, i.nfl_id, n_max - n + frame_id - 1 AS frame, i.x, i.y, d, yl FROM inp i JOIN ends e
    USING (game_id, play_id, nfl_id)
  UNION ALL SELECT o.game_id, o.play_id, o.nfl_id, n_max + frame_id - 1, o.x, o.y, d, yl FROM outp o JOIN ends e
    USING (game_id, play_id, nfl_id)
  UNION ALL SELECT game_id, play_id, nfl_id, unnest(range(0, n_max - n)), xf, yf, d, yl FROM ends
  UNION ALL SELECT game_id, play_id, nfl_id, unnest(range(n_max, n_max + nfo)), x0, y0, d, yl FROM ends WHERE NOT player_to_predict),
scene AS (SELECT game_id, play_id, nfl_id, frame, CASE WHEN d = 'left' THEN y ELSE 53.3::DOUBLE - y END AS l,
    CASE WHEN d = 'left' THEN yl - x ELSE x - yl END AS u FROM points)"""
THROWER = """,
depth AS (SELECT *, CASE WHEN d = 'left' THEN yl - x0 ELSE x0 - yl END AS u0 FROM ends),
thrower AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY game_id, play_id ORDER BY
    CASE WHEN player_role = 'Passer' THEN 0 WHEN player_side = 'Offense' AND player_role <> 'Targeted Receiver' THEN 1 ELSE 2 END,
    CASE WHEN player_role <> 'Passer' AND player_side = 'Offense' AND player_role <> 'Targeted Receiver' THEN u0 ELSE 0 END, nfl_id) AS p
  FROM depth) WHERE p = 1)"""


ON_SCENE = ["play_id", "nfl_id", "frame"]


def _on_scene(v):
    """Scene frames of all players, with the ends of their paths staged in the buckets of the entries."""
    ends = clustered(scene.lazy_ends(v.inp, v.out), "player-ends", ["play_id"], v.buckets, placed=True)
    return scene.scrimmage_frames(v.inp, v.out, ends)


@query(_sql(SCENE, game_rows("scene", "l", "u", at=ON_SCENE)))
def scrimmage_frames(spark, sf_dir):
    v = tracking(spark, sf_dir)
    return per_game(_on_scene(v), "l", "u", at=ON_SCENE)


@query(_sql(SCENE + THROWER, "SELECT game_id, play_id, nfl_id FROM thrower"))
def passers(spark, sf_dir):
    v = tracking(spark, sf_dir)
    return scene.passer(scene.input_ends(v.inp))


@query(_sql(SCENE + THROWER + """,
spots AS (SELECT game_id, play_id, n_max, nfo, CASE WHEN d = 'left' THEN y0 ELSE 53.3::DOUBLE - y0 END AS al, u0 AS au,
    CASE WHEN d = 'left' THEN ly ELSE 53.3::DOUBLE - ly END AS bl, CASE WHEN d = 'left' THEN yl - lx ELSE lx - yl END AS bu
  FROM thrower),
flying AS (SELECT *, (f - n_max + 1)::DOUBLE / nfo AS s, least(9, 0.22::DOUBLE * sqrt((bl - al) ** 2 + (bu - au) ** 2)) AS h
  FROM (SELECT *, unnest(range(n_max - 1, n_max + nfo)) AS f FROM spots)),
ball AS (SELECT s.game_id, s.play_id, frame, l, u, 1.6::DOUBLE AS h FROM scene s JOIN thrower t USING (game_id, play_id, nfl_id) WHERE frame < n_max - 1
  UNION ALL SELECT game_id, play_id, f, al + (bl - al) * s, au + (bu - au) * s, 1.6::DOUBLE * (1 - s) + 4 * h * s * (1 - s) FROM flying)""",
            game_rows("ball", "l", "u", "h", at=["play_id", "frame"])))
def ball_track(spark, sf_dir):
    v = tracking(spark, sf_dir)
    return per_game(scene.ball_track(v.inp), "l", "u", "h", at=["play_id", "frame"])


@query(_sql(SCENE + """,
ahead AS (SELECT *, lead(l) OVER w AS l2, lead(u) OVER w AS u2 FROM scene
          WINDOW w AS (PARTITION BY game_id, play_id, nfl_id ORDER BY frame)),
fine AS (SELECT game_id, play_id, nfl_id, frame + j / 4::DOUBLE AS frame, CASE WHEN l2 IS NULL THEN l ELSE l + (l2 - l) * j / 4 END AS l,
    CASE WHEN l2 IS NULL THEN u ELSE u + (u2 - u) * j / 4 END AS u
  FROM ahead, (SELECT unnest(range(4)) AS j) WHERE l2 IS NOT NULL OR j = 0)""", game_rows("fine", "frame", "l", "u", at=["play_id", "nfl_id"])))
def path_resample(spark, sf_dir):
    v = tracking(spark, sf_dir)
    return per_game(scene.resample(_on_scene(v), 4), "frame", "l", "u", at=["play_id", "nfl_id"])


@query(_sql("""
ghost AS (SELECT game_id, play_id, nfl_id, 0 AS step, x0 AS x, y0 AS y, play_direction AS d, absolute_yardline_number AS yl
          FROM roster WHERE player_to_predict
  UNION ALL SELECT p.game_id, p.play_id, p.nfl_id, frame_id, x_pred, y_pred, play_direction, absolute_yardline_number
          FROM pred p JOIN roster USING (game_id, play_id, nfl_id)),
turned AS (SELECT game_id, play_id, nfl_id, step, CASE WHEN d = 'left' THEN y ELSE 53.3::DOUBLE - y END AS l,
    CASE WHEN d = 'left' THEN yl - x ELSE x - yl END AS u FROM ghost)""", game_rows("turned", "l", "u", at=["play_id", "nfl_id", "step"])))
def expected_points(spark, sf_dir):
    v = tracking(spark, sf_dir)
    return per_game(scene.expected_points(v.inp, v.pred), "l", "u", at=["play_id", "nfl_id", "step"])


@query(_sql("", game_rows("outp", "x", "y")))
def scrimmage_roundtrip(spark, sf_dir):
    """Actual places in scene coordinates and back on the field."""
    v = tracking(spark, sf_dir)
    plays = v.context.select(*PLAY)
    lines = v.inp.where("frame_id = 1").groupBy(*PLAY).agg(
        F.first("play_direction").alias("play_direction"), F.first("absolute_yardline_number").alias("absolute_yardline_number"))
    rows = v.out.join(lines.join(plays, PLAY), PLAY)
    across, downfield = to_scrimmage(F.col("x"), F.col("y"))
    x, y = from_scrimmage(across, downfield)
    return per_game(rows.withColumns({"_x": x, "_y": y}).select("game_id", *AT, F.col("_x").alias("x"), F.col("_y").alias("y")), "x", "y")


@query(_sql(CENTERED, """
SELECT e.game_id, e.play_id, min_by(nfl_id, (CASE WHEN nfl_id = p THEN 0 ELSE 1 END) * 1000000 + nfl_id) AS nfl_id
FROM roster e LEFT JOIN (SELECT game_id, play_id, min(nfl_id) AS p FROM plays WHERE role = 'primary' GROUP BY 1, 2) USING (game_id, play_id)
WHERE player_side <> 'Offense' AND (nfl_id = p OR player_to_predict) GROUP BY 1, 2"""))
def featured_defender(spark, sf_dir):
    v = tracking(spark, sf_dir)
    return scene.featured(scene.input_ends(v.inp), base(spark, sf_dir).plays)


# What is wrong with the request of a play, by play number modulo the length of this list.
FAULTS = ["none", "missing", "null", "two plays", "direction", "role", "height", "nobody", "too far", "two times", "not json",
          "no rows", "text", "many players", "quoted", "whole", "null flag", "point", "many rows"]


def request_bodies(spark, sf_dir):
    """One JSON body per play from its input frames, with a fault chosen by the play number.

    A body is a play's rows, so a body is as large as a play, which is what a request is."""
    inp = tracking(spark, sf_dir).inp
    fault = F.element_at(F.array(*[F.lit(f) for f in FAULTS]), (F.col("play_id") % len(FAULTS) + 1).cast("int"))
    inp = inp.withColumn("fault", fault)

    def when(name, value, column):
        return F.when(F.col("fault") == name, value).otherwise(F.col(column))

    first = F.col("frame_id") == 1
    text = {f.name: F.col(f.name).cast("string") for f in INPUT_SCHEMA.fields}
    raw = {
        **{f.name: F.col(f.name) for f in INPUT_SCHEMA.fields},
        "play_id": when("two plays", F.col("play_id") + F.col("frame_id") % 2, "play_id"),
        "play_direction": when("direction", F.lit("up"), "play_direction"),
        "player_role": when("role", F.lit("Kicker"), "player_role"),
        "player_height": when("height", F.lit("tall"), "player_height"),
        "player_to_predict": F.when(F.col("fault") == "nobody", "false").when((F.col("fault") == "null flag") & first, None).when(
            F.col("fault") == "quoted", F.upper(text["player_to_predict"])).otherwise(text["player_to_predict"]),
        "num_frames_output": F.when(F.col("fault") == "too far", F.lit(500)).when(
            (F.col("fault") == "two times") & first, F.col("num_frames_output") + 1).otherwise(F.col("num_frames_output")),
        "nfl_id": F.when(
            F.col("fault") == "many players", (F.col("nfl_id") * 1000 + F.col("frame_id")).cast("string")).when(
            F.col("fault") == "point", F.concat(text["nfl_id"], F.lit(".0"))).otherwise(text["nfl_id"]),
        "x": F.when((F.col("fault") == "missing") | ((F.col("fault") == "null") & first), None).when(
            (F.col("fault") == "text") & first, "fifty").otherwise(text["x"]),
    }
    row = F.struct(*[raw[f.name].alias(f.name) for f in INPUT_SCHEMA.fields])
    # a null x is left out of the object (a missing column) or kept as null (a null value)
    kept = F.to_json(row, {"ignoreNullFields": "false"})
    line = F.when(F.col("fault") == "missing", F.to_json(row)).otherwise(kept)
    bodies = inp.groupBy(*PLAY, "fault").agg(F.concat(F.lit('{"rows":['), F.array_join(F.collect_list(line), ","), F.lit("]}")).alias("b"))
    long = F.concat(F.lit('{"rows":['), F.array_join(F.array_repeat(F.lit("{}"), MAX_ROWS + 1), ","), F.lit("]}"))
    body = F.when(F.col("fault") == "not json", "{not json").when(F.col("fault") == "no rows", '{"rows":[]}').when(
        F.col("fault") == "many rows", long).otherwise(F.col("b"))
    return bodies.select(F.concat_ws("-", *PLAY).alias("request_id"), "fault", body.alias("body"))


REQUESTS = """
faulty AS (SELECT game_id, play_id, play_id % 19 AS f, n_players, n_rows FROM
  (SELECT game_id, play_id, count(DISTINCT nfl_id) AS n_players, count(*) AS n_rows FROM inp GROUP BY 1, 2)),
answers AS (SELECT CASE
    WHEN f IN (10, 11) THEN 'body must hold at least one row object' WHEN f = 1 THEN 'rows are missing columns x'
    WHEN f IN (2, 12) THEN 'null, infinite or wrongly typed values in x' WHEN f = 3 THEN 'expected exactly one play, got 2'
    WHEN f = 13 AND n_rows > 30 THEN 'at most 30 players, got ' || n_rows
    WHEN f = 4 THEN 'play_direction must be left or right'
    WHEN f = 5 THEN 'player_role must be one of Passer, Targeted Receiver, Defensive Coverage, Other Route Runner'
    WHEN f = 6 THEN 'player_height must look like 6-1' WHEN f = 7 THEN 'no row has player_to_predict true'
    WHEN f IN (8, 9) THEN 'num_frames_output must be one value from 1 to 100'
    WHEN f = 18 THEN 'at most 4000 rows, got 4001' END AS error, n_rows FROM faulty),
taken AS (SELECT inp.* REPLACE (CASE WHEN f = 13 THEN nfl_id * 1000 + frame_id ELSE nfl_id END AS nfl_id,
    player_to_predict AND NOT (f = 16 AND frame_id = 1) AS player_to_predict)
  FROM inp JOIN faulty USING (game_id, play_id) WHERE f IN (0, 14, 15, 16, 17) OR (f = 13 AND n_rows <= 30))"""


@query(_sql(REQUESTS, "SELECT error, count(*) AS requests FROM answers GROUP BY 1"))
def request_validation(spark, sf_dir):
    """The bodies are checked by the task that makes them and are not written, since they outweigh everything else here."""
    parsed = req.parse_requests(request_bodies(spark, sf_dir))
    return parsed.groupBy("error").agg(F.count("*").alias("requests"))


# Fixed value: a compressed file of bodies is read by one task.
REQUESTS_PER_FILE = 2000


@query(_sql(REQUESTS, f"""
SELECT 'accepted' AS kind, count(*) AS n, sum({row_hash_sql([*AT, *INPUT_TEXTS], INPUT_NUMBERS)})::BIGINT AS rows FROM taken
UNION ALL SELECT error, count(*), 0 FROM answers WHERE error IS NOT NULL GROUP BY 1"""))
def stream_request_tables(spark, sf_dir):
    """The same bodies as a file stream with an accepted and a refused table."""
    source, good, bad, checkpoint = (staging_path(spark, s) for s in ("bodies", "accepted", "refused", "stream"))
    bodies(spark, sf_dir).select("request_id", "body").write.option("compression", "gzip").option(
        "maxRecordsPerFile", REQUESTS_PER_FILE).json(source)
    stream = stream_requests(spark, source, good, bad, checkpoint)
    stream.awaitTermination()
    accepted = spark.read.parquet(good).agg(
        F.lit("accepted").alias("kind"), F.count("*").alias("n"), hash_sum(row_hash([*AT, *INPUT_TEXTS], INPUT_NUMBERS)).alias("rows"))
    refused = spark.read.parquet(bad).groupBy(F.col("error").alias("kind")).agg(F.count("*").alias("n"))
    return accepted.unionByName(refused.withColumn("rows", F.lit(0).cast("long")))


def _write_raw_weeks(spark, sf_dir, root):
    """The derived tables as weekly CSV folders, the way raw data arrives."""
    v = tracking(spark, sf_dir)
    weeks = v.context.select(*PLAY, "week")
    for kind, frames, names in (("input", v.inp, INPUT_SCHEMA.names), ("output", v.out, OUTPUT_SCHEMA.names)):
        path = staging_path(spark, f"raw-{kind}")
        # all weeks in one pass over the frames; a week's folder is then given its name
        frames.join(weeks, PLAY).select("week", *names).write.partitionBy("week").options(header=True, compression="gzip").csv(path)
        for week in range(1, 19):
            rename(spark, f"{path}/week={week}", files.week_paths(root, kind, [week])[0])


WEEKS = f"""
SELECT 2023 AS season, week, n, rows, air, moved
FROM (SELECT week, count(*) AS n, sum({row_hash_sql(["game_id", *AT, *INPUT_TEXTS], INPUT_NUMBERS)})::BIGINT AS rows
      FROM inp JOIN (SELECT game_id, play_id, week FROM ctx) USING (game_id, play_id) GROUP BY 1)
JOIN (SELECT week, count(*) AS air, sum({row_hash_sql(["game_id", *AT], ["x", "y"])})::BIGINT AS moved
      FROM outp JOIN (SELECT game_id, play_id, week FROM ctx) USING (game_id, play_id) GROUP BY 1) USING (week)"""


def _week_counts(spark, processed):
    inp, out = files.load_weeks(spark, processed, list(range(1, 19)), season=2023)
    air = out.groupBy("season", "week").agg(
        F.count("*").alias("air"), hash_sum(row_hash(["game_id", *AT], ["x", "y"])).alias("moved"))
    weeks = inp.groupBy("season", "week").agg(
        F.count("*").alias("n"), hash_sum(row_hash(["game_id", *AT, *INPUT_TEXTS], INPUT_NUMBERS)).alias("rows"))
    return weeks.join(air, ["season", "week"])


RAW_CONTEXT = {short: raw for raw, (short, _) in CONTEXT_COLUMNS.items()}


@query(_sql("", """
SELECT game_id, play_id, week, home, away, off, team, "desc", q, clock, down, dist, result, route, mz, cov, epa
FROM ctx ORDER BY game_id, play_id"""))
def context_csv(spark, sf_dir):
    """The context as a raw CSV file with its own column names, other columns and NA, read back."""
    rows = tracking(spark, sf_dir).context
    raw = {"man": "MAN_COVERAGE", "zone": "ZONE_COVERAGE"}
    rows = rows.withColumns({
        "mz": F.when(F.col("mz") == "man", raw["man"]).when(F.col("mz") == "zone", raw["zone"]),
        "route": F.when(F.col("route") != "unknown", F.col("route")), "cov": F.when(F.col("cov") != "unknown", F.col("cov"))})
    path = staging_path(spark, "context")
    rows.select(*[F.col(s).alias(raw_name) for s, raw_name in RAW_CONTEXT.items()], F.lit("x").alias("other")).write.option(
        "header", True).option("nullValue", "NA").csv(path)
    back = files.read_context_csv(spark, path)
    quality.raise_first([("context rows are not unique per play", quality.duplicate_plays(back))])
    return back


@query(_sql("", WEEKS))
def prepare_weeks(spark, sf_dir):
    """Weekly CSV read, validated, stored as parquet by week and loaded again."""
    raw, processed = raw_weeks(spark, sf_dir), staging_path(spark, "processed")
    prepare.prepare_weeks(spark, raw, processed, files.parse_weeks("1-18"))
    return _week_counts(spark, processed)


@query(_sql("", WEEKS))
def stream_landed_weeks(spark, sf_dir):
    """The same weeks found by a file stream over the raw folder."""
    raw, processed, checkpoint = raw_weeks(spark, sf_dir), staging_path(spark, "landed"), staging_path(spark, "stream")
    stream_weeks(spark, raw, processed, checkpoint).awaitTermination()
    return _week_counts(spark, processed)


PASSED = f"""{PUBLISHED}, {PICKS}, {PLAYERS[len(CENTERED) + 1:]}, {SPREAD}, {GATED_CELLS}, {HALVES},
verdict AS (SELECT (SELECT count(*) FROM cells WHERE NOT coalesce(abs(mean) <= 0.25 * (SELECT sd FROM spread), false)) = 0
  AND (SELECT coalesce(count(*) >= 30 AND corr(even, odd) >= 0.4, false) FROM halves)
  AND (SELECT abs(avg(zc)) <= 0.02 FROM rated)
  AND (SELECT count(*) FILTER (ex IS NOT NULL) <= 0.15 * count(*) FROM centered) AS ok)"""


@query(_sql(PASSED, """
SELECT * FROM (SELECT 'plays' AS artifact, count(*) AS n FROM centered
  UNION ALL SELECT 'games/games', count(DISTINCT game_id) FROM inp UNION ALL SELECT 'games/plays', count(*) FROM roster
  UNION ALL SELECT 'highlights', count(*) FROM roster JOIN picks p ON roster.game_id = p.game AND roster.play_id = p.play
  UNION ALL SELECT 'meta', count(*) FROM verdict UNION ALL SELECT 'players', count(DISTINCT nfl_id) FROM rated
  UNION ALL SELECT 'teams', count(DISTINCT team) FROM rated) WHERE (SELECT ok FROM verdict)
UNION ALL SELECT 'audit', count(*) FROM centered UNION ALL SELECT 'cells', count(*) FROM cells"""))
def gate_publish(spark, sf_dir):
    """The guarded publication: audit outputs always, public outputs only behind a passed gate."""
    v = tracking(spark, sf_dir)
    audit, public = staging_path(spark, "audit"), staging_path(spark, "public")
    result = rate.compute(v.inp, v.out, v.pred, v.context)
    counts = []
    try:
        rate.publish(result, v.inp, v.out, v.pred, v.context, audit, public)
        for name in ("plays", "games/games", "games/plays", "highlights", "meta"):
            counts.append((name, spark.read.json(f"{public}/{name}", schema=T.StructType([T.StructField("game", T.LongType())]))))
        counts += [(name, spark.read.parquet(f"{public}/{name}")) for name in ("players", "teams")]
    except rate.GateFailed:
        pass
    counts.append(("audit", spark.read.parquet(f"{audit}/plays")))
    counts.append(("cells", spark.read.parquet(f"{audit}/cells")))
    out = None
    for name, df in counts:
        row = df.agg(F.lit(name).alias("artifact"), F.count("*").alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


@query(_sql(CROSSPRED + ", " + "kept AS (SELECT * FROM crossed)", f"""
SELECT fold, count(*) AS n, sum({row_hash_sql(["game_id", *AT], ["x_pred", "y_pred", "sd_x", "sd_y"])})::BIGINT AS rows FROM kept GROUP BY 1"""))
def prediction_table(spark, sf_dir):
    """Cross-fitted predictions written by fold and read back under the column contract."""
    v = tracking(spark, sf_dir)
    pred = score_plan.score(v.inp, v.out).pred
    path = staging_path(spark, "predictions")
    files.write_predictions(pred, path)
    back = files.read_predictions(spark, path)
    return back.groupBy("fold").agg(
        F.count("*").alias("n"), hash_sum(row_hash(["game_id", *AT], ["x_pred", "y_pred", "sd_x", "sd_y"])).alias("rows"))
