"""Whole plays, game files, releases, clustered tables and paths at any time."""

import json
import math
import os

import pytest
from pyspark.sql import functions as F

from pursuit import staging
from pursuit.operators import board, documents, expect, features, field, metric, moments, nesting, playtable, quality, ratings, scene, stretches
from pursuit.plans import rate
from pursuit.schema import KEY
from pursuit.sources import clustered, games, names, release, shards
from pursuit.staging import clustered as clustered_staged
from pursuit.staging import staged
from tests.conftest import GAINED, GAME, IN, LAND, OUT, PLAY
from tests.test_rating import random_table
from workload import suite_documents, suite_models, suite_ratings
from workload.tracking import tracking


@pytest.fixture(scope="module")
def centered(rating_play):
    return ratings.center(rate.checked_play_table(*rating_play))


@pytest.fixture(scope="module")
def docs(rating_play, centered):
    """The known play, and the same play again in two more games."""
    inp, out, pred, context = rating_play
    one = documents.play_documents(inp, out, pred, centered, context)
    more = [one.withColumn("game_id", F.lit(GAME + g).cast("long")).withColumn("play_id", (F.col("play_id") + p).cast("long")) for g, p in ((0, 0), (0, 3), (5, 1))]
    return staged(more[0].unionByName(more[1]).unionByName(more[2]), "docs")


def test_a_play_is_one_row_with_its_lists(docs):
    plays = {(p.game, p.play): p for p in nesting.nested_plays(docs).collect()}
    assert set(plays) == {(GAME, PLAY), (GAME, PLAY + 3), (GAME + 5, PLAY + 1)}
    play = plays[GAME, PLAY]
    assert (play.part, play.home, play.week, play["def"], play.nfo, play.land) == (0, "SEA", 3, "SEA", OUT, list(LAND))
    assert [p.id for p in play.players] == [1, 2, 3, 4] and [p.run for p in play.players] == [0] * 4
    assert [len(p["in"]) for p in play.players] == [IN] * 4 and play.players[0].out is None and len(play.players[2].pred) == OUT
    assert {r.id: (r.role, r.yards) for r in play.ratings} == {3: ("primary", GAINED[3]), 4: ("help", GAINED[4])}


@pytest.mark.parametrize("part", [1, 3, 4])
def test_long_plays_go_on_in_parts_of_one_length(docs, part):
    plays = nesting.nested_plays(docs, part)
    parts = {(p.game, p.play, p.part): [x.id for x in p.players] for p in plays.collect()}
    assert parts == {(g, p, k): [1, 2, 3, 4][k * part:(k + 1) * part] for g, p in ((GAME, PLAY), (GAME, PLAY + 3), (GAME + 5, PLAY + 1))
                     for k in range(-(-4 // part))}
    assert sorted(r.id for p in plays.collect() for r in p.ratings) == [3] * 3 + [4] * 3
    back = nesting.player_rows(plays)
    assert back.select(docs.columns).exceptAll(docs).count() == 0 and back.count() == docs.count()


def test_plays_of_no_rows(docs):
    assert nesting.nested_plays(docs.where("false")).collect() == []


@pytest.mark.parametrize("part", [64, 2])
def test_a_game_is_one_file(spark, docs, tmp_path, part):
    games.write_game_files(nesting.nested_plays(docs, part), str(tmp_path / "games"))
    names = {f.name for f in (tmp_path / "games").iterdir() if not f.name.startswith(".")}
    assert names == {f"{GAME}.json", f"{GAME + 5}.json", "_SUCCESS"}
    game = json.loads((tmp_path / "games" / f"{GAME}.json").read_text())
    assert list(game) == ["game", "week", "home", "away", "plays"] and [p["play"] for p in game["plays"]] == [PLAY, PLAY + 3]
    play = game["plays"][0]
    assert list(play) == [*games.PLAY_FIELDS, "players", "ratings"] and play["land"] == list(LAND)
    first, _, corner, _ = play["players"]
    assert list(first) == ["id", "name", "pos", "side", "role", "h", "w", "b", "p", "in"] and len(first["in"][0]) == 6
    assert list(corner)[-2:] == ["out", "pred"] and len(corner["out"]) == OUT and len(corner["pred"][0]) == 4
    assert [(r["id"], r["yards"], r["ex"]) for r in play["ratings"]] == [(3, GAINED[3], None), (4, GAINED[4], None)]
    back = nesting.player_rows(games.read_game_files(spark, str(tmp_path / "games")))
    assert back.select(docs.columns).exceptAll(docs).count() == 0 and back.count() == docs.count()


def test_a_failed_write_leaves_no_folder(spark, docs, tmp_path):
    broken = nesting.nested_plays(docs).withColumn("week", F.when(F.col("game") == GAME, F.col("week")).otherwise(F.raise_error(F.lit("lost")).cast("long")))
    with pytest.raises(Exception, match="lost"):
        games.write_game_files(broken, str(tmp_path / "games"))
    assert not (tmp_path / "games").exists()


def passed(result):
    result.checks = result.checks.withColumn("passed", F.lit(True))
    return result


def test_readers_see_a_whole_release_or_the_one_before(spark, rating_play, tmp_path, monkeypatch):
    root, audit = str(tmp_path / "public"), str(tmp_path / "audit")
    assert release.current(spark, root) is None
    result = passed(rate.compute(*rating_play))
    first = rate.release(result, *rating_play, audit=audit, root=root, run="r1")
    assert release.current(spark, root) == first and spark.read.json(f"{first}/meta").first().run == "r1"

    def fails(*args):
        raise RuntimeError("in the middle")

    with monkeypatch.context() as m:
        m.setattr(rate.board, "highlight_picks", fails)
        with pytest.raises(RuntimeError, match="in the middle"):
            rate.release(result, *rating_play, audit=audit, root=root, run="r2")
    assert release.current(spark, root) == first and len(list((tmp_path / "public/versions").iterdir())) == 1
    assert spark.read.json(f"{first}/plays").count() == 2 and games.read_game_files(spark, f"{first}/games").count() == 1
    later = [rate.release(result, *rating_play, audit=audit, root=root, run=f"r{n}") for n in (3, 4)]
    assert release.current(spark, root) == later[-1]
    assert {f"{root}/versions/{f.name}" for f in (tmp_path / "public/versions").iterdir()} == set(later)  # two are kept


def test_a_failed_gate_releases_nothing(spark, rating_play, tmp_path):
    with pytest.raises(rate.GateFailed):
        rate.release(rate.compute(*rating_play), *rating_play, audit=str(tmp_path / "audit"), root=str(tmp_path / "public"))
    assert release.current(spark, str(tmp_path / "public")) is None and (tmp_path / "audit/plays").exists()


def along(path, t):
    """The point of a path ``{frame: (l, u)}`` at a time, by looking at every frame."""
    before, after = [f for f in path if f <= t], [f for f in path if f >= t]
    if not before or not after:
        return path[min(path) if not before else max(path)]
    f, g = max(before), min(after)
    share = (t - f) / (g - f) if g > f else 0.0
    return tuple(a + (b - a) * share for a, b in zip(path[f], path[g]))


@pytest.mark.parametrize("bucket", [1, 3, 256])
def test_paths_at_any_time(spark, bucket):
    paths = {(1, 1, 1): {f: (f * 1.0, f * f * 0.5) for f in range(12)}, (1, 1, 2): {f: (5.0 - f, f / 3) for f in (0, 1, 2, 9, 20)}, (1, 2, 1): {4: (7.0, 8.0)}}
    frames = spark.createDataFrame([(*k, f, *p) for k, path in paths.items() for f, p in path.items()], "game_id long, play_id long, nfl_id long, frame long, l double, u double")
    at = [-5.5, 0.0, 0.25, 1.0, 1.5, 2.9, 5.0, 8.999, 9.0, 11.0, 11.5, 14.2, 20.0, 1e9, 0.25]
    rows = [(*k, i, t) for k in [*paths, (9, 9, 9)] for i, t in enumerate(at)] + [(1, 1, 1, 98, None), (1, 1, 1, 99, float("nan"))]
    times = spark.createDataFrame(rows, "game_id long, play_id long, nfl_id long, at long, t double").withColumn("_b", F.lit("kept"))
    got = {(r.game_id, r.play_id, r.nfl_id, r["at"]): (r.l, r.u) for r in scene.path_at(frames, times, bucket=bucket).collect()}
    assert len(got) == len(rows)
    for *key, i, t in rows:
        want = along(paths[tuple(key)], t) if tuple(key) in paths and t is not None and not math.isnan(t) else (None, None)
        assert got[*key, i] == (pytest.approx(want) if want[0] is not None else want), (key, t)
    with_clash = scene.path_at(frames, times.where("false"), bucket=bucket)
    assert with_clash.columns == ["game_id", "play_id", "nfl_id", "at", "t", "_b", "l", "u"] and with_clash.collect() == []


def exchanges(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("== Initial Plan ==")[0].count("Exchange")


def test_clustered_tables_need_no_exchange_of_frames(spark, rating_play, tmp_path):
    inp, out, _, _ = rating_play
    names = clustered.write_clustered(inp, out, str(tmp_path / "tables"), buckets=4)
    inp2, out2 = clustered.read_clustered(spark, str(tmp_path / "tables"))
    assert inp2.exceptAll(inp).count() == 0 and inp2.count() == inp.count() and out2.count() == out.count() and len(names) == 2
    joined = inp2.select(*KEY, "frame_id", "x").join(out2.select(*KEY, F.col("frame_id").alias("k"), F.col("x").alias("x2")), KEY)
    assert exchanges(joined) == 0
    assert exchanges(inp2.groupBy(*KEY).agg(F.collect_list("x"))) == 0
    assert exchanges(features.history_arrays(inp2, out2)) == 0 < exchanges(features.history_arrays(inp, out))
    for name in names:  # another session knows only the files
        spark.sql(f"DROP TABLE {name}")
    again, _ = clustered.read_clustered(spark, str(tmp_path / "tables"))
    assert again.exceptAll(inp).count() == 0 and exchanges(again.groupBy(*KEY).agg(F.max("x"))) == 0


def derived(spark, path):
    """Lines of a few plays with four players each, one of them with 39."""
    rows = [(o, s, float((o * 7 + s) % 50 + 1), 900.0 + 13 * s + o) for o in range(1, 40) for s in range(1, 5)] + [(7, s, 3.0, 100.0) for s in range(5, 40)]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_suppkey long, l_quantity double, l_extendedprice double")
    lines.write.parquet(f"{path}/lineitem.parquet")
    return str(path)


def test_play_table_of_the_derived_ratings_is_exchanged_nowhere(spark, tmp_path):
    at = derived(spark, tmp_path)
    b, v = suite_ratings.base(spark, at), tracking(spark, at)
    plays = playtable.play_table_of(b.arrived, v.context)
    assert exchanges(plays) == 0
    assert 0 < b.plays.count() == plays.count() and b.plays.columns == plays.columns
    assert b.plays.select(*KEY, "z", "ex").exceptAll(plays.select(*KEY, "z", "ex")).count() == 0
    # staged once: the play table and the published rows are read from the centered table
    assert sorted(b.rows.inputFiles()) == sorted(b.table.inputFiles()) == sorted(b.plays.inputFiles())


def test_predictions_of_a_callers_model_meet_targets_where_they_lie(spark, tmp_path, monkeypatch):
    at, seen = derived(spark, tmp_path), []
    evaluate = metric.evaluate_predictions
    monkeypatch.setattr(metric, "evaluate_predictions", lambda pred, inp, out: seen.append(pred) or evaluate(pred, inp, out))
    assert suite_models.callers_model(spark, at).count() > 0
    v = tracking(spark, at)
    assert exchanges(metric.scored_targets(seen[0], v.inp, v.out, "left")) == 0
    assert seen[0].count() == v.out.count()


def test_records_of_placed_arrays_are_the_same_without_an_exchange(spark, tmp_path):
    at = derived(spark, tmp_path)
    v = tracking(spark, at)
    arrays = clustered_staged(features.history_arrays(v.inp, v.out), "arrays", ["play_id"], v.buckets, placed=True)
    records = shards.play_records(arrays, placed=True)
    assert exchanges(records) <= 1 < exchanges(shards.play_records(arrays))  # the few seats of large plays are broadcast
    rows = sorted(map(str, records.collect()))
    assert rows == sorted(map(str, shards.play_records(arrays).collect())) and len(rows) == v.context.count() + 1


def test_derived_frames_meet_by_play_without_an_exchange(spark, tmp_path):
    """Rows of one order and supplier that come twice, null keys, and one order with many suppliers."""
    rows = [(o, s, float(o % 50 + 1), 900.0 + s) for o in range(1, 40) for s in range(1, 5)] + [(7, s, 3.0, 100.0) for s in range(1, 60)]
    rows += [(None, 3, 5.0, 10.0), (12, None, 5.0, 10.0)]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_suppkey long, l_quantity double, l_extendedprice double")
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    v = tracking(spark, str(tmp_path))
    keys = lines.select("l_orderkey", "l_suppkey").distinct()
    assert v.roster.select("play_id", "nfl_id").exceptAll(keys).count() == 0 and v.roster.count() == keys.count()
    assert v.roster.inputFiles() and exchanges(v.roster.groupBy("play_id").agg(F.max("rn"))) == 0
    assert exchanges(features.history_arrays(v.inp, v.out)) == 0
    assert exchanges(metric.scored_targets(v.pred, v.inp, v.out)) == 0
    assert exchanges(expect.baseline_targets(v.inp, v.out)) == 0
    assert exchanges(field.normalize_targets(v.out, v.inp)) == 0
    frames = scene.scrimmage_frames(v.inp, v.out)
    assert exchanges(frames) == 0
    assert exchanges(scene.path_at(frames, v.roster.select(*KEY, F.lit(2.5).alias("t")))) == 0
    assert exchanges(scene.resample(frames, 4)) == 0


def test_whole_plays_are_put_together_where_the_documents_lie(spark, tmp_path):
    rows = [(o, s, float(o % 50 + 1), 900.0 + s) for o in range(1, 40) for s in range(1, 5)] + [(7, s, 3.0, 100.0) for s in range(1, 90)]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_suppkey long, l_quantity double, l_extendedprice double")
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    docs = suite_documents._plays(spark, str(tmp_path))
    # a file for each bucket with rows, so no bucket was written by two tasks
    assert len(docs.inputFiles()) == docs.select(F.input_file_name()).distinct().count() <= 39
    plays = nesting.nested_plays(docs)
    assert exchanges(plays) <= 1  # the few seats of large plays are broadcast, rows are not exchanged
    assert "Exchange hashpartitioning" not in plays._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    sizes = {(r.play, r.part): r.n for r in plays.select("play", "part", F.size("players").alias("n")).collect()}
    assert sizes[7, 0] == 64 and sizes[7, 1] == 25 and sizes[8, 0] == 4 and len(sizes) == 40


def test_clear_drops_clustered_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(staging, "application_dir", lambda _: str(tmp_path / "alone"))
    monkeypatch.setattr(staging, "_tables", [])
    made = clustered_staged(spark.range(100), "ids", ["id"], 3)
    (_, name), = staging._tables
    assert made.count() == 100 and len(made.inputFiles()) == 3 and spark.catalog.tableExists(name)
    staging.clear(spark)
    assert not spark.catalog.tableExists(name) and not os.path.exists(tmp_path / "alone") and staging._tables == []


def test_one_pass_gives_the_profile_and_the_angles(spark, rating_play):
    """Rows in any order and in small batches, with gaps, nulls, standing players and two weeks."""
    inp = rating_play[0]
    rows = inp.withColumn("season", F.lit(2023)).withColumn("week", F.lit(3))
    other = rows.withColumn("week", F.lit(4)).withColumn("game_id", F.col("game_id") + 1).withColumn("dir", (F.lit(90.0) - F.col("dir") + 360) % 360)
    other = other.where("not (nfl_id = 3 and frame_id = 4)").withColumn("x", F.when(~((F.col("nfl_id") == 2) & (F.col("frame_id") == 5)), F.col("x")))
    other = other.withColumn("play_direction", F.when(F.col("nfl_id") == 4, "up").when(F.col("nfl_id") == 2, None).otherwise(F.col("play_direction")))
    both = staged(rows.unionByName(other).orderBy(F.xxhash64("frame_id", "nfl_id")), "frames")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = staged(stretches.stretches(both), "stretches")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    want = quality.player_profile(both)
    assert stretches.profile(got).select(want.columns).exceptAll(want).count() == 0 and want.count() == 8
    angles = {r.week: (r.a, r.b, r.ok) for r in stretches.angle_errors(got).collect()}
    # a gap ends a stretch, while a lead goes over it; both leave a place that is null out
    plain = {r.week: (r.a, r.b, r.ok) for r in quality.angle_errors(both.where("not (week = 4 and nfl_id = 3)")).collect()}
    apart = {r.week: (r.a, r.b, r.ok) for r in stretches.angle_errors(got.where("not (week = 4 and nfl_id = 3)")).collect()}
    assert apart == {w: (pytest.approx(a), pytest.approx(b), ok) for w, (a, b, ok) in plain.items()} and plain[3][2] and not plain[4][2]
    assert set(angles) == {3, 4}
    assert stretches.stretches(both.where("false")).count() == 0


def test_ratings_follow_from_stored_moments(spark, tmp_path):
    t = random_table(spark, 51, 40, 60, 0.4).withColumn("week", (1 + F.col("play_id") % 6).cast("int")).withColumn(
        "ex", F.when(F.col("play_id") % 17 == 0, "not catchable")).withColumn("route", F.when(F.col("play_id") % 13 > 0, F.col("route")))
    t = staged(t, "plays")
    path = str(tmp_path / "moments")
    moments.write_moments(t.where("week < 6").withColumn("z", F.when(F.col("week") == 2, -F.col("z")).otherwise(F.col("z"))), path)
    moments.write_moments(t.where("week = 2"), path)   # a corrected week takes the place of the wrong one
    moments.write_moments(t.where("week = 6"), path)
    state = staged(moments.centered(moments.read_moments(spark, path)), "state")
    full = staged(ratings.center(t), "full")
    shrink = ratings.shrinkage(full)
    for mine, want, key in (
            (moments.shrinkage(state), shrink, "grp"), (moments.players(state, moments.shrinkage(state)), ratings.players(full, shrink), "nfl_id"),
            (moments.teams(state), ratings.teams(full), "team"), (moments.split_half(state), ratings.split_half(full), "players")):
        got, expected = ({r[key]: r.asDict() for r in df.collect()} for df in (mine, want))
        assert got.keys() == expected.keys() and got
        for k, row in expected.items():
            for c, v in row.items():
                assert got[k][c] == (pytest.approx(v, abs=1e-9) if isinstance(v, float) else v), (key, k, c)
    assert spark.read.parquet(path).select("week").distinct().count() == 6


@pytest.mark.parametrize("seats", [24, 3, 1])
def test_shards_read_back_as_the_arrays_they_hold(spark, rating_play, tmp_path, seats):
    arrays = staged(features.history_arrays(*rating_play[:2]), "arrays")
    records = shards.play_records(arrays, seats)
    rows = records.collect()
    assert len(rows) == -(-4 // seats) and all(len(r.pmask) == seats and len(r[c]) == w * seats for r in rows for c, w in shards.WIDTHS.items())
    shards.write_shards(records, str(tmp_path / "shards"), 2, 1)
    assert len(list((tmp_path / "shards").glob("part-*"))) >= len(rows)  # a task without records writes an empty file
    back = shards.read_shards(spark, str(tmp_path / "shards"))
    assert back.select(arrays.columns).exceptAll(arrays).count() == 0 and back.count() == 4


NAMES = ["Åsa Lindqvist", "Bo Åberg", "Keito", "Kei To", "Mary Kei Tolan", "Ann-Lo Ra", "Ra", "Io Steﬁn", "O'Lind Kam", "", "名前", "Lind Ra Lind"]


@pytest.mark.parametrize("typed", ["l", "lin", "lind", "kei to", "keito", "ra", "ra l", "o", "ÅBERG", "", " ", "zzz", "eito", "to", "lo ra", "stefin", "n r"])
def test_the_index_finds_what_a_search_finds(spark, tmp_path_factory, typed):
    path = str(tmp_path_factory.getbasetemp() / "names")
    rows = spark.createDataFrame([(i, n, i / 7.0) for i, n in enumerate(NAMES)], "id long, name string, rating double")
    if not os.path.exists(path):
        names.write_name_index(rows, path)
    want = [(r.id, r.score) for r in board.search(rows, typed, 5).collect()]
    assert [(r.id, r.score) for r in names.search_names(spark, path, typed, 5).collect()] == want


def test_a_search_reads_the_folders_of_its_letters(spark, tmp_path):
    rows = spark.createDataFrame([(i, n, i / 7.0) for i, n in enumerate(NAMES)], "id long, name string, rating double")
    names.write_name_index(rows, str(tmp_path / "names"))
    plan = names.search_names(spark, str(tmp_path / "names"), "lind")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "StartsWith(letters" in plan
