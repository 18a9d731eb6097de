"""What is exchanged, written or sent to Python on the way to a result, on rows of their own."""

import pytest
from pyspark.sql import functions as F

from pursuit import staging
from pursuit.operators import documents, nesting, paths, scene, stretches
from pursuit.plans import rate
from pursuit.sources import games, requests
from tests.conftest import GAME, PLAY
from workload import suite_documents, suite_quality, tracking
from workload.registry import AT, hash_sum, per_game, row_hash

LINES = "l_orderkey long, l_suppkey long, l_quantity double, l_extendedprice double"


@pytest.fixture
def lines(spark, tmp_path):
    """Orders of four suppliers; one order and supplier twice, one order that is null."""
    rows = [(o, s, float((o * s) % 50 + 1), 900.0 + 7 * s + o) for o in range(1, 40) for s in range(1, 5)]
    rows += [(3, 2, 0.5, 9000.0), (None, 1, 4.0, 10.0)]
    spark.createDataFrame(rows, LINES).write.parquet(str(tmp_path / "lineitem.parquet"))
    return str(tmp_path)


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_entries_are_exchanged_once(spark, lines, monkeypatch):
    made = []
    monkeypatch.setattr(tracking, "clustered", lambda df, *args, **how: made.append(df) or staging.clustered(df, *args, **how))
    entries, buckets = tracking._entries(spark, lines)
    assert plan(made[0]).count("Exchange hashpartitioning") == 1
    # a file for each bucket with rows: no bucket was written by two tasks, and the rows lie where the table says
    assert len(entries.inputFiles()) <= buckets
    assert "Exchange" not in plan(entries.groupBy("o").count().where("o = 3"))
    assert entries.count() == 39 * 4 + 1 and entries.where("o = 3 AND sk = 2 AND q = 0.5 AND ep = 917.0").count() == 1
    assert {r.n for r in entries.where("o IS NOT NULL").groupBy("o").agg(F.sort_array(F.collect_list("rn")).alias("n")).select(
        F.concat_ws(",", "n").alias("n")).collect()} == {"1,2,3,4"}


def test_frames_go_to_python_as_numbers_and_flags(spark, rating_play):
    inp = rating_play[0]
    sent = stretches.stretches(inp.withColumn("week", F.lit(1)))._jdf.queryExecution().optimizedPlan().children().head().schema()
    assert {f.dataType().typeName() for f in sent.fields()} <= {"long", "integer", "double", "boolean"}
    # a batch ends by its rows; with a limit in bytes every row costs a sum over the buffers of all columns
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(2**31 - 1)
    odd = inp.withColumn("play_direction", F.when(F.col("nfl_id") == 1, None).when(F.col("nfl_id") == 2, "up").otherwise("left"))
    assert {r.nfl_id: r.bad_direction for r in stretches.profile(stretches.stretches(odd)).collect()} == {1: 0, 2: 9, 3: 0, 4: 0}


def test_requests_are_checked_without_being_written(spark, lines, monkeypatch):
    written = []
    monkeypatch.setattr(suite_documents, "staged", lambda df, label: written.append(label) or staging.staged(df, label))
    answers = {r.error: r.requests for r in suite_documents.request_validation(spark, lines).collect()}
    assert written == [] and sum(answers.values()) == 39  # an order that is null has no frames


def test_angle_check_exchanges_no_stretches_for_their_week(spark, lines, monkeypatch):
    made = []
    monkeypatch.setattr(suite_quality, "staged", lambda df, label: made.append(df) or staging.staged(df, label))
    assert suite_quality.angle_check(spark, lines).count() == 18
    assert "Exchange hashpartitioning" not in plan(made[0])


def test_frames_of_scenarios_are_not_sorted_to_meet_their_play(spark):
    pred = spark.createDataFrame([(s, 1, p, 5, k, 10.0 + k, 20.0) for s in ("a", "b") for p in (1, 2, 3) for k in (1, 2)],
                                 "scenario string, game_id long, play_id long, nfl_id long, frame_id long, x_pred double, y_pred double")
    plays = spark.createDataFrame([(1, 1, "left", 40), (1, 2, "right", 40)],
                                  "game_id long, play_id long, play_direction string, absolute_yardline_number long")
    points = scene.scenario_points(pred, plays)
    assert "ShuffledHashJoin" in plan(points) and "SortMergeJoin" not in plan(points)
    assert {(r.scenario, r.play_id, r.frame_id): r.u for r in points.collect()} == {
        (s, p, k): (30.0 - k if p == 1 else k - 30.0) for s in ("a", "b") for p in (1, 2) for k in (1, 2)}


def test_the_next_frame_is_found_without_making_the_frames_twice(spark):
    rows = spark.range(0, 2 * paths.RUN + 3).select(
        F.lit(1).alias("game_id"), F.lit(1).alias("play_id"), F.lit(1).alias("nfl_id"), F.col("id").alias("frame"), F.col("id").alias("l"))
    ahead = paths.with_next(rows, ["l"], order="frame")
    assert "Union" not in plan(ahead)
    got = {r.frame: r.next_l for r in ahead.collect()}
    assert len(got) == 2 * paths.RUN + 3 and all(v == (k + 1 if k < 2 * paths.RUN + 2 else None) for k, v in got.items())


def test_times_are_not_walked_to_the_end_of_the_path_for_every_row(spark):
    frames = spark.createDataFrame([(1, 1, 1, f, float(f), float(-f)) for f in (0, 1, 5, 20)], "game_id long, play_id long, nfl_id long, frame long, l double, u double")
    times = spark.createDataFrame([(1, 1, 1, t) for t in (-2.0, 0.5, 1.0, 3.0, 12.5, 30.0)] + [(1, 1, 2, 1.0)], "game_id long, play_id long, nfl_id long, t double")
    for bucket in (2, 4, 64):
        met = scene.path_at(frames, times, bucket=bucket)
        assert "unboundedfollowing" not in plan(met)
        assert {(r.nfl_id, r.t): (r.l, r.u) for r in met.collect()} == {
            (1, -2.0): (0.0, 0.0), (1, 0.5): (0.5, -0.5), (1, 1.0): (1.0, -1.0), (1, 3.0): (3.0, -3.0), (1, 12.5): (12.5, -12.5),
            (1, 30.0): (20.0, -20.0), (2, 1.0): (None, None)}


def test_scene_frames_meet_hashed_players_and_staged_ends(spark, lines):
    v = tracking.tracking(spark, lines)
    lazy = scene.scrimmage_frames(v.inp, v.out)
    assert "SortMergeJoin" not in plan(lazy.select("game_id", "frame")).split("SortAggregate")[0]
    staged_ends = suite_documents._on_scene(v)
    assert "Exchange hashpartitioning" not in plan(staged_ends) and "SortMergeJoin" not in plan(staged_ends)
    assert staged_ends.exceptAll(lazy).count() == 0 and lazy.exceptAll(staged_ends).count() == 0
    whole = staged_ends.groupBy("game_id", "play_id", "nfl_id").agg(F.min("frame").alias("lo"), F.max("frame").alias("hi"), F.count("*").alias("n"))
    assert whole.where("lo <> 0 OR hi + 1 <> n").count() == 0


def test_rows_of_a_request_are_counted_only_over_the_limit(spark):
    most = requests.MAX_ROWS
    bodies = {"over": '{"rows":[' + ",".join(["{}"] * (most + 2)) + "]}", "nulls over": '{"rows":[' + ",".join(["null"] * (most + 1)) + "]}",
              "full": '{"rows":[' + ",".join(["{}"] * most) + "]}", "one null": '{"rows":[null]}', "none": '{"rows":[]}',
              "no list": '{"rows":{"0":1}}', "text": '{"rows":"[{}]"}', "not json": "{", "no body": None}
    parsed = requests.parse_requests(spark.createDataFrame([*bodies.items()], "request_id string, body string"))
    empty = "body must hold at least one row object"
    errors = {r.request_id: r.error for r in parsed.select("request_id", "error").collect()}
    assert errors.pop("full").startswith("rows are missing columns game_id, play_id")
    assert errors == {"over": f"at most {most} rows, got {most + 2}", "nulls over": f"at most {most} rows, got {most + 1}", "one null": empty,
                      "none": empty, "no list": empty, "text": empty, "not json": empty, "no body": empty}
    # the other bodies are asked for single places, so that no row is copied to be counted
    logical = parsed._jdf.queryExecution().optimizedPlan().toString()
    assert f"$.rows[{most}]" in logical and "$.rows[0]" in logical


def test_sums_of_hashes_beyond_a_long_take_every_row(spark):
    most, n = 2 ** 40 - 1, 2 ** 23 + 5
    rows = spark.range(n).select((F.col("id") % 2).alias("game_id"), F.lit(most).alias("h"))
    around = (n * most + 2 ** 63) % 2 ** 64 - 2 ** 63
    assert n * most > 2 ** 63 and rows.agg(hash_sum(F.col("h")).alias("s")).first().s == around
    # a sum that a long holds is the plain one, and no rows have none
    assert {r.game_id: r.s for r in rows.groupBy("game_id").agg(hash_sum(F.col("h")).alias("s")).collect()} == {
        0: (n // 2 + 1) * most, 1: n // 2 * most}
    assert rows.where("false").agg(hash_sum(F.col("h")).alias("s")).first().s is None
    few = spark.createDataFrame([(1, 7, 3, 1, 2.0), (1, 7, 3, 2, None), (2, 7, 3, 1, 5.5)], "game_id long, play_id long, nfl_id long, frame_id long, x double")
    plain = few.groupBy("game_id").agg(F.sum(row_hash(AT, ["x"])).alias("rows"))
    assert per_game(few, "x").select("game_id", "rows").exceptAll(plain).count() == 0


def test_text_of_games_is_made_once(spark, rating_play):
    inp, out, pred, context = rating_play
    result = rate.compute(inp, out, pred, context)
    plays = nesting.nested_plays(staging.staged(documents.play_documents(inp, out, pred, result.table, context), "docs"))
    placed = games.placed_lines(plays)
    assert "rangepartitioning" not in plan(placed) and [(r.game, r.play) for r in placed.collect()] == [(GAME, PLAY)]


def test_frames_of_picked_plays_meet_a_lookup(spark, rating_play, tmp_path, monkeypatch):
    inp, out, pred, context = rating_play
    result = rate.compute(inp, out, pred, context)
    made = []
    monkeypatch.setattr(rate, "_require_passed", lambda *_: None)
    monkeypatch.setattr(documents, "play_documents", lambda *tables, real=documents.play_documents: made.append(tables[0]) or real(*tables))
    rate.release(result, inp, out, pred, context, str(tmp_path / "audit"), str(tmp_path / "public"))
    planned = made[1]._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in planned and "SortMergeJoin" not in planned
