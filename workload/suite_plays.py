"""Whole plays, game files, the release, and paths at any time."""

from pyspark.sql import functions as F

from pursuit.operators import board, features, moments, nesting, scene
from pursuit.operators.documents import published
from pursuit.plans import rate
from pursuit.schema import KEY
from pursuit.sources import games as game_sink
from pursuit.sources import names, release, shards
from pursuit.staging import clustered, staged, staging_path
from workload.registry import AT, ORACLES, game_rows, hash_sum, per_game, query, rounded, row_hash, row_hash_sql
from workload.suite_documents import PASSED, PATHS, SCENE, VALUES, _frames, _on_scene, _plays, _sql
from workload.suite_models import history_cells
from workload.suite_ratings import PUBLISHED, base, flat
from workload.tracking import source_state, tracking

_nested = {}


def _whole_plays(spark, sf_dir):
    at = source_state(spark, sf_dir)
    docs = _plays(spark, sf_dir)
    if _nested.get(at, (None,))[0] is not docs:
        # not staged: the documents of a play lie together, and each reader takes them from there
        _nested[at] = docs, nesting.nested_plays(docs)
    return _nested[at][1]


@query(_sql(PATHS, game_rows("values_of", *VALUES, at=[*AT, "path"])))
def nested_plays(spark, sf_dir):
    """Every frame and path of every player of every whole play, in the order of its list."""
    return per_game(_frames(nesting.player_rows(_whole_plays(spark, sf_dir))), *VALUES, at=[*AT, "path"])


RATING_TEXTS, RATING_NUMBERS = ["id", "role", "ex"], ["d0", "dexp", "dact", "yards", "z", "zc"]
PEOPLE = ["name", "pos", "side", "role", "h", "w", "b", "p"]
LISTS = f"""{PUBLISHED},
who AS (SELECT game_id, play_id, nfl_id, player_name AS name, player_position AS pos, player_side AS side, player_role AS role,
    player_height AS h, player_weight AS w, player_birth_date AS b, player_to_predict AS p FROM roster),
people_of AS (SELECT game_id, play_id, count(*) AS players, string_agg(nfl_id, ',' ORDER BY nfl_id) AS ids,
    sum({row_hash_sql(["nfl_id", *PEOPLE])})::BIGINT AS people FROM who GROUP BY 1, 2),
rated_of AS (SELECT game AS game_id, play AS play_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids,
    sum({row_hash_sql(RATING_TEXTS, RATING_NUMBERS)})::BIGINT AS rows FROM published GROUP BY 1, 2),
play_list AS (SELECT game_id AS game, play_id AS play, week, home, away, "desc", q, clock, down, dist, off, team AS def, result, cov, mz, route,
    players, people_of.ids, people, coalesce(n, 0) AS rated, coalesce(rated_of.ids, '') AS rated_ids, coalesce(rows, 0) AS ratings
  FROM people_of JOIN ctx USING (game_id, play_id) LEFT JOIN rated_of USING (game_id, play_id))"""
PLAY_TEXTS = ["week", "home", "away", "desc", "q", "clock", "down", "dist", "off", "def", "result", "cov", "mz", "route"]


def _lists(plays):
    """One row for each whole play: its context, and its lists as ids in order and sums over whole rows."""
    def total(column, texts, numbers=()):
        hashes = F.transform(column, lambda e: row_hash([e[t] for t in texts], [e[n] for n in numbers]))
        return F.aggregate(hashes, F.lit(0).cast("long"), lambda s, h: s + h)

    return plays.select(
        "game", "play", *PLAY_TEXTS, F.size("players").cast("long").alias("players"),
        F.array_join(F.transform("players", lambda p: p["id"].cast("string")), ",").alias("ids"),
        total("players", ["id", *PEOPLE]).alias("people"), F.size("ratings").cast("long").alias("rated"),
        F.array_join(F.transform("ratings", lambda p: p["id"].cast("string")), ",").alias("rated_ids"),
        total("ratings", RATING_TEXTS, RATING_NUMBERS).alias("ratings"))


@query(_sql(LISTS, "SELECT * FROM play_list"))
def play_lists(spark, sf_dir):
    """The players and the ratings that each play lists, with the play's context."""
    return _lists(_whole_plays(spark, sf_dir))


@query(_sql(f"{LISTS}, {PATHS.lstrip()}, by_frame AS ({game_rows('values_of', *VALUES, at=[*AT, 'path'])})", f"""
SELECT by_frame.*, plays, lists FROM by_frame JOIN (
  SELECT game AS game_id, count(*) AS plays, sum({row_hash_sql(["play", *PLAY_TEXTS, "ids", "people", "rated_ids", "ratings"])})::BIGINT AS lists
  FROM (SELECT * REPLACE (arg_min(week, play) OVER g AS week, arg_min(home, play) OVER g AS home, arg_min(away, play) OVER g AS away)
        FROM play_list WINDOW g AS (PARTITION BY game)) GROUP BY 1) USING (game_id)"""))
def game_files(spark, sf_dir):
    """One JSON file per game, written and read back: all frames, players, ratings and contexts. A game has the week and the
    teams of its first play."""
    path = staging_path(spark, "game-files")
    game_sink.write_game_files(_whole_plays(spark, sf_dir), path)
    plays = game_sink.read_game_files(spark, path)
    context = ["play", *PLAY_TEXTS, "ids", "people", "rated_ids", "ratings"]
    lists = _lists(plays).groupBy(F.col("game").alias("game_id")).agg(
        F.count("*").alias("plays"), hash_sum(row_hash(context)).alias("lists"))
    return per_game(_frames(nesting.player_rows(plays)), *VALUES, at=[*AT, "path"]).join(lists, "game_id")


PUBLISHED_TEXTS = ["game", "play", "week", "id", "name", "pos", "grp", "team", "cov", "mz", "route", "result", "air", "role", "ex"]
PUBLISHED_NUMBERS = ["epa", "d0", "dexp", "dact", "yards", "z", "zc"]
ARTIFACTS = {
    "plays": ("published", PUBLISHED_TEXTS, PUBLISHED_NUMBERS),
    "games": ("values_of", ["game_id", *AT, "path"], VALUES),
    "highlights": ("(SELECT p.game, p.play, p.id, nfl_id, zc FROM roster JOIN picks p ON roster.game_id = p.game AND roster.play_id = p.play)",
                   ["game", "play", "id", "nfl_id"], ["zc"]),
    "meta": ("(SELECT 'r1' AS run, count(*) AS plays, count(DISTINCT game_id) AS games FROM (SELECT DISTINCT game_id, play_id FROM centered))",
             ["run", "plays", "games"], []),
    "players": ("players", ["nfl_id", "n", "name", "pos", "grp", "tier", "listed"], ["mean", "yards", "rating", "se"]),
    "teams": ("(SELECT team, count(*) AS n, avg(zc) AS mean, sqrt((SELECT var_samp(zc) FROM rated) / count(*)) AS se FROM rated GROUP BY 1)",
              ["team", "n"], ["mean", "se"]),
}
AUDIT = {"audit": ("centered", [*KEY, "role", "ex"], ["d0", "yards", "z", "zc"]), "cells": ("cells", ["dim", "cell", "n"], ["mean"])}


def _artifacts(of) -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS artifact, count(*) AS n, coalesce(sum({row_hash_sql(texts, numbers)}), 0)::BIGINT AS rows FROM {source}"
        for name, (source, texts, numbers) in of.items())


@query(_sql(f"{PASSED}, {PATHS.lstrip()}", f"SELECT * FROM ({_artifacts(ARTIFACTS)}) WHERE (SELECT ok FROM verdict) UNION ALL {_artifacts(AUDIT)}"))
def gate_release(spark, sf_dir):
    """The guarded publication as a release: what readers find through its manifest, and the audit outputs, by whole rows."""
    v = tracking(spark, sf_dir)
    audit, root = staging_path(spark, "audit"), staging_path(spark, "public")
    result = rate.compute(v.inp, v.out, v.pred, v.context)
    tables = {"audit": spark.read.parquet, "cells": spark.read.parquet}
    at = {name: f"{audit}/{folder}" for name, folder in (("audit", "plays"), ("cells", "cells"))}
    try:
        rate.release(result, v.inp, v.out, v.pred, v.context, audit, root, "r1")
        folder = release.current(spark, root)
        tables |= {"plays": spark.read.schema(published(result.table).schema).json, "players": spark.read.parquet, "teams": spark.read.parquet,
                   "meta": spark.read.json, "games": lambda path: game_sink.read_game_files(spark, path), "highlights": spark.read.json}
        at |= {name: f"{folder}/{name}" for name in ARTIFACTS}
    except rate.GateFailed:
        pass
    shape = {
        "games": lambda df: _frames(nesting.player_rows(df)),
        "highlights": lambda df: df.select("game", "play", "id", "zc", F.col("scene.player.id").alias("nfl_id")),
        "meta": lambda df: df.select("run", "counts.plays", "counts.games"),
    }
    out = None
    for name, read in tables.items():
        _, texts, numbers = {**ARTIFACTS, **AUDIT}[name]
        df = shape.get(name, lambda df: df)(read(at[name]))
        row = df.agg(F.lit(name).alias("artifact"), F.count("*").alias("n"), F.coalesce(hash_sum(row_hash(texts, numbers)), F.lit(0)).alias("rows"))
        out = row if out is None else out.unionByName(row)
    return out


ASKED = """
asked AS (SELECT r.game_id, r.play_id, r.nfl_id, k,
    (((r.play_id * 7 + r.nfl_id * 13) % 16 + k * 37) % 240)::DOUBLE / 4 - 3 AS t FROM roster r, (SELECT unnest(range(6)) AS k))"""
BOTH_SIDES = """,
lo AS (SELECT asked.*, s.frame AS f0, s.l AS l0, s.u AS u0 FROM asked ASOF LEFT JOIN scene s
  ON asked.game_id = s.game_id AND asked.play_id = s.play_id AND asked.nfl_id = s.nfl_id AND asked.t >= s.frame),
hi AS (SELECT lo.*, s.frame AS f1, s.l AS l1, s.u AS u1 FROM lo ASOF LEFT JOIN scene s
  ON lo.game_id = s.game_id AND lo.play_id = s.play_id AND lo.nfl_id = s.nfl_id AND lo.t <= s.frame),
located AS (SELECT game_id, play_id, nfl_id, k, t,
    CASE WHEN f0 IS NULL THEN l1 WHEN f1 IS NULL OR f1 = f0 THEN l0 ELSE l0 + (l1 - l0) * (t - f0) / (f1 - f0) END AS l,
    CASE WHEN f0 IS NULL THEN u1 WHEN f1 IS NULL OR f1 = f0 THEN u0 ELSE u0 + (u1 - u0) * (t - f0) / (f1 - f0) END AS u FROM hi)"""


@query(_sql(SCENE + "," + ASKED + BOTH_SIDES, game_rows("located", "t", "l", "u", at=["play_id", "nfl_id", "k"])))
def path_at(spark, sf_dir):
    """Every player's place at six times, some between frames, some before the first and after the last."""
    v = tracking(spark, sf_dir)
    start = (F.col("play_id") * 7 + F.col("nfl_id") * 13) % 16
    times = v.roster.select(*KEY, F.explode(F.sequence(F.lit(0), F.lit(5))).alias("k")).withColumn(
        "t", ((start + F.col("k") * 37) % 240).cast("double") / 4 - 3)
    return per_game(scene.path_at(_on_scene(v), times), "t", "l", "u", at=["play_id", "nfl_id", "k"])


_stored = {}


def _moments(spark, sf_dir):
    """Moments stored week by week: all but the last two, then a wrong week, then that week again and the last one."""
    at = source_state(spark, sf_dir)
    if at not in _stored:
        path, plays = staging_path(spark, "moments"), base(spark, sf_dir).plays
        moments.write_moments(plays.where("week < 17"), path)
        moments.write_moments(plays.where("week = 17").withColumn("z", F.col("z") * 3), path)
        for week in (17, 18):
            moments.write_moments(plays.where(F.col("week") == week), path)
        _stored[at] = staged(moments.centered(moments.read_moments(spark, path)), "centered-moments")
    return _stored[at]


@query(ORACLES["player_ratings"])
def incremental_ratings(spark, sf_dir):
    """Player ratings from moments that were stored by week."""
    state = _moments(spark, sf_dir)
    return rounded(flat(moments.players(state, moments.shrinkage(state))), 9)


@query(ORACLES["team_ratings"])
def incremental_teams(spark, sf_dir):
    return rounded(moments.teams(_moments(spark, sf_dir)))


@query(ORACLES["shrinkage"])
def incremental_shrinkage(spark, sf_dir):
    return rounded(moments.shrinkage(_moments(spark, sf_dir)))


@query(ORACLES["split_half"])
def incremental_split_half(spark, sf_dir):
    return rounded(moments.split_half(_moments(spark, sf_dir)))


_indexes = {}


def _indexed(name, typed):
    @query(ORACLES[name], name=f"{name}_indexed")
    def run(spark, sf_dir):
        """The same search in the stored index of names."""
        at = source_state(spark, sf_dir)
        if at not in _indexes:
            b, path = base(spark, sf_dir), staging_path(spark, "names")
            names.write_name_index(board.listed(b.rows, b.shrink), path)
            _indexes[at] = path
        return names.search_names(spark, _indexes[at], typed).select("id", "name", "score")
    return run


for _name, _typed in (("name_search", "Ra"), ("name_search_accents", " José Núñez "), ("name_search_inside", "kei to")):
    _indexed(_name, _typed)


@query(ORACLES["history_arrays"])
def training_shards(spark, sf_dir):
    """The training export as padded records per play, written in shards and read back."""
    v, path = tracking(spark, sf_dir), staging_path(spark, "shards")
    arrays = clustered(features.history_arrays(v.inp, v.out), "arrays", ["play_id"], v.buckets, placed=True)
    shards.write_shards(shards.play_records(arrays, placed=True), path, 16, 500)
    return history_cells(shards.read_shards(spark, path))
