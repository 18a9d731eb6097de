"""Play table, centering, rating, gate and leaderboard queries."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pursuit.functions import text
from pursuit.operators import board, gate, paths, playtable, ratings, scene
from pursuit.operators.documents import published
from pursuit.plans import rate
from pursuit.schema import KEY
from pursuit.staging import clustered, staged
from workload.oracle_view import VIEW
from workload.registry import hash_sum, query, r, rd, rounded, row_hash, row_hash_sql
from workload.suite_models import LAST
from workload.tracking import source_state, tracking

PLAYS = LAST + """,
arr AS MATERIALIZED (
  SELECT l.*, o.x, o.y, p.x_pred, p.y_pred, p.sd_x, p.sd_y, p.fold,
    sqrt((ball_land_x - x_pred) ** 2 + (ball_land_y - y_pred) ** 2) AS dexp,
    sqrt((ball_land_x - x0) ** 2 + (ball_land_y - y0) ** 2) AS d0,
    sqrt((o.x - ball_land_x) ** 2 + (o.y - ball_land_y) ** 2) AS dact
  FROM lastf l
  LEFT JOIN outp o ON o.game_id = l.game_id AND o.play_id = l.play_id AND o.nfl_id = l.nfl_id AND o.frame_id = num_frames_output
  LEFT JOIN pred p ON p.game_id = l.game_id AND p.play_id = l.play_id AND p.nfl_id = l.nfl_id AND p.frame_id = num_frames_output),
unit AS (SELECT *,
    CASE WHEN dexp < 1 THEN (ball_land_x - x0) / (d0 + 0.000000001::DOUBLE) ELSE (ball_land_x - x_pred) / (dexp + 0.000000001::DOUBLE) END AS ux,
    CASE WHEN dexp < 1 THEN (ball_land_y - y0) / (d0 + 0.000000001::DOUBLE) ELSE (ball_land_y - y_pred) / (dexp + 0.000000001::DOUBLE) END AS uy
  FROM arr),
geo AS MATERIALIZED (SELECT *, yards / sdu AS z FROM (
  SELECT *, (x - x_pred) * ux + (y - y_pred) * uy AS yards, sqrt((sd_x * ux) ** 2 + (sd_y * uy) ** 2) AS sdu FROM unit)),
plays AS MATERIALIZED (
  SELECT g.game_id, g.play_id, g.nfl_id, c.week, player_name AS name, player_position AS pos,
    CASE WHEN player_position IN ('CB', 'DB') THEN 'CB' WHEN player_position IN ('FS', 'SS', 'S') THEN 'S' ELSE 'LB' END AS grp,
    c.team, c.cov, c.mz, c.route, c.result, c.epa, num_frames_output AS frames,
    CASE WHEN num_frames_output <= 8 THEN '5-8' WHEN num_frames_output <= 12 THEN '9-12'
         WHEN num_frames_output <= 16 THEN '13-16' ELSE '17-40' END AS air,
    CASE WHEN rank() OVER (PARTITION BY g.game_id, g.play_id ORDER BY dexp) = 1 THEN 'primary' ELSE 'help' END AS role,
    CASE WHEN d0 < 5 THEN '0-5' WHEN d0 < 10 THEN '5-10' WHEN d0 < 20 THEN '10-20' ELSE '20+' END AS start,
    d0, dexp, dact, yards, sdu, z,
    CASE WHEN num_frames_output > 40 THEN 'over 40 frames'
         WHEN ball_land_x < 0 OR ball_land_x > 120 OR ball_land_y < 0 OR ball_land_y > 53.3::DOUBLE THEN 'out of bounds'
         WHEN recv_dist > 4 THEN 'not catchable' END AS ex, fold
  FROM geo g
  JOIN (SELECT game_id, play_id, dact AS recv_dist FROM geo WHERE player_role = 'Targeted Receiver') v
    ON v.game_id = g.game_id AND v.play_id = g.play_id
  LEFT JOIN ctx c ON c.game_id = g.game_id AND c.play_id = g.play_id
  WHERE player_role = 'Defensive Coverage')"""


def _pass(n: int, source: str, value: str, cells: list[str]) -> str:
    keys = ", ".join(cells)
    on_t = " AND ".join(f"s.{c} = t.{c}" for c in cells)
    on_f = " AND ".join(f"s.{c} = f.{c}" for c in cells)
    return f"""
t{n} AS (SELECT {keys}, sum({value}) AS ts, count(*) AS tn FROM {source} WHERE ex IS NULL GROUP BY {keys}),
f{n} AS (SELECT {keys}, fold, sum({value}) AS fs, count(*) AS fn FROM {source} WHERE ex IS NULL GROUP BY {keys}, fold),
pass{n} AS MATERIALIZED (SELECT s.*, {value} - coalesce(CASE WHEN tn - coalesce(fn, 0) > 0
    THEN (ts - coalesce(fs, 0)) / (tn - coalesce(fn, 0)) ELSE ts / tn END, 0) AS zc{n}
  FROM {source} s LEFT JOIN t{n} t ON {on_t} LEFT JOIN f{n} f ON {on_f} AND s.fold = f.fold)"""


PASS1 = PLAYS + "," + _pass(1, "plays", "z", ["air", "role", "grp"])
CENTERED = PASS1 + "," + _pass(2, "pass1", "zc1", ["route"]) + """,
centered AS MATERIALIZED (SELECT *, zc2 AS zc FROM pass2), rated AS (SELECT * FROM centered WHERE ex IS NULL)"""
SHRINK = CENTERED + """,
means AS (SELECT grp, nfl_id, count(*) AS n, avg(zc) AS m FROM rated GROUP BY 1, 2),
shrink AS MATERIALIZED (
  SELECT grp, within, between_, within / between_ AS k FROM (
    SELECT w.grp, within, greatest(CASE WHEN count(m) FILTER (n >= 30) >= 2
        THEN var_samp(m) FILTER (n >= 30) - within / avg(n) FILTER (n >= 30) ELSE 0 END, 0.000001::DOUBLE) AS between_
    FROM (SELECT grp, coalesce(var_samp(zc), 0) AS within FROM rated GROUP BY 1) w JOIN means USING (grp)
    GROUP BY w.grp, within))"""
PLAYERS = SHRINK + """,
team_n AS (SELECT nfl_id, string_agg(team, ',' ORDER BY n DESC, team) AS teams,
             string_agg(n::VARCHAR, ',' ORDER BY n DESC, team) AS team_n
           FROM (SELECT nfl_id, team, count(*) AS n FROM rated GROUP BY 1, 2 HAVING count(*) >= 10) GROUP BY 1),
agg AS (SELECT nfl_id, count(*) AS n, arg_max(name, play_id + game_id * 1000000000) AS name,
    arg_max(pos, play_id + game_id * 1000000000) AS pos, arg_max(grp, play_id + game_id * 1000000000) AS grp,
    avg(zc) AS mean, avg(yards) AS yards, avg(CASE WHEN result = 'C' THEN 1.0 WHEN result IS NOT NULL THEN 0.0 END) AS comp,
    avg(epa) AS epa FROM rated GROUP BY 1),
players AS MATERIALIZED (SELECT *, CASE WHEN rating > 2 * se THEN 'above' WHEN rating < -2 * se THEN 'below' ELSE 'average' END AS tier,
    n >= 30 AS listed
  FROM (SELECT a.*, coalesce(teams, '') AS teams, coalesce(team_n, '') AS team_n, mean * n / (n + k) AS rating,
          sqrt(within / (n + k)) AS se FROM agg a JOIN shrink USING (grp) LEFT JOIN team_n USING (nfl_id)))"""
PUBLISHED = CENTERED + f""",
published AS MATERIALIZED (SELECT game_id AS game, play_id AS play, week, nfl_id AS id, name, pos, grp, team, cov, mz, route, result,
  {rd('epa')} AS epa, frames AS air, role, {rd('d0')} AS d0, {rd('dexp')} AS dexp, {rd('dact')} AS dact,
  {rd('yards')} AS yards, {rd('z')} AS z, {rd('zc', 6)} AS zc, ex FROM centered)"""


def board_sql(where: str, min_plays: int) -> str:
    """Re-rating of the published rows that pass a predicate."""
    return f"""
kept AS (SELECT * FROM published WHERE ex IS NULL AND {where}),
bteams AS (SELECT id, string_agg(team, ',' ORDER BY n DESC, team) AS teams, string_agg(n::VARCHAR, ',' ORDER BY n DESC, team) AS team_n
           FROM (SELECT id, team, count(*) AS n FROM kept GROUP BY 1, 2 HAVING count(*) >= 10) GROUP BY 1),
bagg AS (SELECT id, count(*) AS n, arg_max(name, play + game * 1000000000) AS name, arg_max(pos, play + game * 1000000000) AS pos,
    arg_max(grp, play + game * 1000000000) AS grp, avg(zc) AS mean, avg(yards) AS yards,
    avg(CASE WHEN result = 'C' THEN 1.0 ELSE 0.0 END) AS comp, avg(epa) AS epa,
    (array_agg(team ORDER BY game DESC, zc DESC, play))[1] AS latest FROM kept GROUP BY 1 HAVING count(*) >= {min_plays}),
board AS MATERIALIZED (SELECT *, CASE WHEN rating > 2 * se THEN 'above' WHEN rating < -2 * se THEN 'below' ELSE 'average' END AS tier
  FROM (SELECT a.*, coalesce(teams, '') AS teams, coalesce(team_n, '') AS team_n,
          coalesce(split_part(teams, ',', 1), latest) AS main_team, mean * n / (n + k) AS rating, sqrt(within / (n + k)) AS se
        FROM bagg a JOIN shrink USING (grp) LEFT JOIN bteams USING (id)))"""


PUBLISHED_SHRINK = SHRINK + PUBLISHED[len(CENTERED):]
BOARD_SELECT = f"""id, name, pos, grp, n, {r('mean', 9)} AS mean, {r('yards', 9)} AS yards, {r('comp', 9)} AS comp,
  {r('epa', 9)} AS epa, teams, team_n, {r('rating', 9)} AS rating, {r('se', 9)} AS se, tier, main_team"""


def _sql(ctes: str, body: str) -> str:
    return f"WITH {VIEW}, {ctes} {body}"


@dataclass
class Base:
    arrived: DataFrame
    plays: DataFrame
    table: DataFrame
    shrink: DataFrame
    players: DataFrame
    rows: DataFrame


_bases: dict[tuple, Base] = {}


def base(spark, sf_dir) -> Base:
    """The checked rating of the derived tables, staged once per application and folder: arrival rows, centered table,
    shrinkage and players, each computed from all rows.

    The arrival rows lie in the buckets of the entries, so the play table is made of them without an exchange, once for the
    sums of centering and once for the centered table, which holds every column of it. It and the published rows are
    projections of the centered table."""
    at = source_state(spark, sf_dir)
    if at not in _bases:
        v = tracking(spark, sf_dir)
        arrived = clustered(paths.arrivals(v.inp, v.out, v.pred), "arrivals", ["play_id"], v.buckets, placed=True)
        table = staged(ratings.center(playtable.play_table_of(arrived, v.context)), "centered")
        shrink = ratings.shrinkage(table)
        players = staged(ratings.players(table, shrink), "players")
        _bases[at] = Base(arrived, table.select(*playtable.PLAY_TABLE), table, shrink, players, published(table))
    return _bases[at]


def reset(keep_entries: bool = False) -> None:
    """Forget staged results, so that the next query starts from the given tables."""
    from workload import tracking as view

    _bases.clear()
    if not keep_entries:
        view._rosters.clear()


def flat(df: DataFrame) -> DataFrame:
    """Lists as text."""
    lists = {f.name for f in df.schema.fields if f.dataType.typeName() == "array"}
    return df.select(*[
        F.coalesce(F.concat_ws(",", F.col(c).cast("array<string>")), F.lit("")).alias(c) if c in lists else F.col(c)
        for c in df.columns])


GEOMETRY = ["d0", "dexp", "dact", "yards", "sdu", "z"]


@query(_sql(PLAYS, "SELECT game_id, play_id, nfl_id, " + ", ".join(f"{r(c)} AS {c}" for c in GEOMETRY) + " FROM geo"))
def geometry(spark, sf_dir):
    v = tracking(spark, sf_dir)
    return rounded(playtable.geometry(paths.arrivals(v.inp, v.out, v.pred)).select(*KEY, *GEOMETRY))


@query(_sql(PLAYS, "SELECT ex, count(*) AS n FROM plays GROUP BY 1"))
def exclusion_counts(spark, sf_dir):
    return playtable.exclusion_counts(base(spark, sf_dir).plays)


@query(_sql(PLAYS, "SELECT * REPLACE (" + ", ".join(f"{r(c)} AS {c}" for c in [*GEOMETRY, "epa"]) + ") FROM plays"))
def play_table(spark, sf_dir):
    v = tracking(spark, sf_dir)
    return rounded(playtable.play_table(v.inp, v.out, v.pred, v.context))


@query(_sql(PASS1, f"SELECT game_id, play_id, nfl_id, {r('zc1')} AS zc FROM pass1"))
def center_pass(spark, sf_dir):
    return rounded(ratings.center(base(spark, sf_dir).plays, [["air", "role", "grp"]]).select(*KEY, "zc"))


@query(_sql(CENTERED, f"SELECT game_id, play_id, nfl_id, fold, {r('zc')} AS zc, ex FROM centered"))
def centered_table(spark, sf_dir):
    return rounded(ratings.center(base(spark, sf_dir).plays).select(*KEY, "fold", "zc", "ex"))


@query(_sql(SHRINK, f'SELECT grp, {r("within")} AS within, {r("between_")} AS "between", {r("k")} AS k FROM shrink'))
def shrinkage(spark, sf_dir):
    return rounded(ratings.shrinkage(base(spark, sf_dir).table))


@query(_sql(PLAYERS, f"""SELECT nfl_id, n, name, pos, grp, {r('mean', 9)} AS mean, {r('yards', 9)} AS yards,
  {r('comp', 9)} AS comp, {r('epa', 9)} AS epa, teams, team_n, {r('rating', 9)} AS rating, {r('se', 9)} AS se, tier, listed
FROM players"""))
def player_ratings(spark, sf_dir):
    b = base(spark, sf_dir)
    return rounded(flat(ratings.players(b.table, b.shrink)), 9).orderBy(F.desc("rating"), "nfl_id")


@query(_sql(CENTERED, f"""
SELECT team, count(*) AS n, {r('avg(zc)')} AS mean,
  {r('sqrt((SELECT var_samp(zc) FROM rated) / count(*))')} AS se FROM rated GROUP BY 1"""))
def team_ratings(spark, sf_dir):
    return rounded(ratings.teams(base(spark, sf_dir).table)).orderBy(F.desc("mean"), "team")


HALVES = """
halves AS (SELECT nfl_id, avg(zc) FILTER (game_id % 2 = 0) AS even, avg(zc) FILTER (game_id % 2 = 1) AS odd
  FROM rated GROUP BY 1 HAVING count(*) FILTER (game_id % 2 = 0) >= 15 AND count(*) FILTER (game_id % 2 = 1) >= 15)"""


@query(_sql(CENTERED + "," + HALVES, f"SELECT {r('corr(even, odd)')} AS r, count(*) AS players FROM halves"))
def split_half(spark, sf_dir):
    return rounded(ratings.split_half(base(spark, sf_dir).table))


def _cells_sql(dims) -> str:
    parts = " UNION ALL ".join(f"SELECT '{d}' AS dim, coalesce({d}, 'None') AS cell, zc FROM rated" for d in dims)
    return f"cells AS (SELECT dim, cell, count(*) AS n, avg(zc) AS mean FROM ({parts}) GROUP BY 1, 2 HAVING count(*) >= 100)"


SPREAD = "spread AS (SELECT stddev_samp(mean) AS sd, count(*) AS listed FROM players WHERE listed)"
GATED_CELLS = _cells_sql(["cov", "mz", "start", "route", "air", "role", "grp"])


@query(_sql(f"{PLAYERS}, {SPREAD}, {GATED_CELLS}", f"""
SELECT dim, cell, n, {r('mean')} AS mean, coalesce(abs(mean) <= 0.25 * (SELECT sd FROM spread), false) AS ok FROM cells"""))
def gate_cells(spark, sf_dir):
    b = base(spark, sf_dir)
    return rounded(gate.gate_cells(b.table, b.players)).drop("at").orderBy("dim", "cell")


@query(_sql(f"{PLAYERS}, {SPREAD}, {GATED_CELLS}, {HALVES}", f"""
SELECT passed AND bad = 0 AS passed, failed_cells, {r('lim')} AS "limit", {r('sd')} AS player_sd, {r('rr')} AS r, half_players,
  rel_ok, {r('league')} AS league_mean, league_ok, {r('share')} AS share, ex_ok, flagged, rated, listed, reasons, cells
FROM (SELECT *, rel_ok AND league_ok AND ex_ok AS passed FROM (
  SELECT *, 0.25 * sd AS lim, bad AS failed_cells, coalesce(rr >= 0.4 AND half_players >= 30, false) AS rel_ok,
    abs(league) <= 0.02 AS league_ok, share <= 0.15 AS ex_ok FROM (
    SELECT (SELECT sd FROM spread) AS sd, (SELECT listed FROM spread) AS listed,
      (SELECT count(*) FROM cells WHERE NOT coalesce(abs(mean) <= 0.25 * (SELECT sd FROM spread), false)) AS bad,
      (SELECT count(*) FROM cells) AS cells,
      (SELECT CASE WHEN count(*) >= 2 THEN corr(even, odd) END FROM halves) AS rr, (SELECT count(*) FROM halves) AS half_players,
      (SELECT avg(zc) FROM rated) AS league, (SELECT count(*) FROM centered) AS flagged, (SELECT count(*) FROM rated) AS rated,
      1 - (SELECT count(*) FROM rated)::DOUBLE / (SELECT count(*) FROM centered) AS share,
      (SELECT string_agg(ex || '=' || n, ',' ORDER BY ex) FROM (SELECT ex, count(*) AS n FROM centered WHERE ex IS NOT NULL GROUP BY 1))
        AS reasons)))"""))
def gate_report(spark, sf_dir):
    b = base(spark, sf_dir)
    reasons = F.transform(F.array_sort(F.map_entries("excluded.by_reason")),
                          lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return rounded(gate.gate(b.table, b.players).select(
        "passed", F.col("cells.failed").alias("failed_cells"), "limit", "player_sd", "reliability.r",
        F.col("reliability.players").alias("half_players"), F.col("reliability.ok").alias("rel_ok"),
        F.col("league_mean.value").alias("league_mean"), F.col("league_mean.ok").alias("league_ok"), "excluded.share",
        F.col("excluded.ok").alias("ex_ok"), "rows.flagged", "rows.rated", F.col("rows.players_listed").alias("listed"),
        F.array_join(reasons, ",").alias("reasons"), F.col("cells.n").alias("cells")))


@query(_sql(f"{CENTERED}, {_cells_sql(['result', 'team'])}", f"""
SELECT dim, {r('min(mean)')} AS low, {r('max(mean)')} AS high, count(*) AS cells FROM cells GROUP BY 1"""))
def info_range(spark, sf_dir):
    return rounded(gate.info_range(base(spark, sf_dir).table))


def _board(name, where, filters):
    @query(_sql(f"{PUBLISHED_SHRINK}, {board_sql(where, filters.min_plays)}", f"SELECT {BOARD_SELECT} FROM board"), name=name)
    def run(spark, sf_dir):
        b = base(spark, sf_dir)
        return rounded(flat(board.filtered_ratings(b.rows, b.shrink, filters)), 9)
    return run


_board("filtered_ratings", "grp = 'CB' AND mz = 'zone' AND role = 'primary'",
       board.Filters(grp="CB", cov="zone", role="primary", min_plays=10))
_board("coverage_ratings", "cov = 'COVER_3_ZONE' AND route = 'GO'",
       board.Filters(cov="COVER_3_ZONE", route="GO", min_plays=2))
_board("team_filtered_ratings", "team = 'T5'", board.Filters(team="T5", min_plays=1))
_board("group_board", "grp = 'S'", board.Filters(grp="S", min_plays=30))
LISTED = board_sql("true", 30)


@query(_sql(PUBLISHED, f"""
SELECT team, count(*) AS n, {r('avg(zc)')} AS mean, {r('''sqrt((SELECT var_samp(zc) FROM published WHERE ex IS NULL AND mz = 'man')
  / count(*))''')} AS se FROM published WHERE ex IS NULL AND mz = 'man' GROUP BY 1 HAVING count(*) >= 20"""))
def filtered_teams(spark, sf_dir):
    return rounded(board.filtered_teams(base(spark, sf_dir).rows, board.Filters(grp="CB", cov="man", min_plays=20)))


@query(_sql(f"{PUBLISHED_SHRINK}, {LISTED}", """
SELECT id, grp, rank, total, rank::VARCHAR || CASE WHEN rank % 100 BETWEEN 11 AND 13 THEN 'th' WHEN rank % 10 = 1 THEN 'st'
    WHEN rank % 10 = 2 THEN 'nd' WHEN rank % 10 = 3 THEN 'rd' ELSE 'th' END || ' of ' || total::VARCHAR || ' ' ||
    CASE grp WHEN 'CB' THEN 'corners' WHEN 'S' THEN 'safeties' WHEN 'LB' THEN 'linebackers' END AS rank_text
FROM (SELECT id, grp, row_number() OVER (PARTITION BY grp ORDER BY rating DESC, id) AS rank, count(*) OVER (PARTITION BY grp) AS total
      FROM board)"""))
def player_rank(spark, sf_dir):
    b = base(spark, sf_dir)
    return board.ranked(board.listed(b.rows, b.shrink)).select("id", "grp", "rank", "total", "rank_text")


@query(_sql(f"{PUBLISHED_SHRINK}, {board_sql('true', 1)}", "SELECT id, main_team FROM board"))
def main_team(spark, sf_dir):
    b = base(spark, sf_dir)
    return board.listed(b.rows, b.shrink, 1).select("id", "main_team")


@query(_sql(f"{PUBLISHED_SHRINK}, {board_sql('true', 1)}", f"""
SELECT id, name, n, {r('rating')} AS rating, tier, CASE WHEN n >= 30 THEN (SELECT count(*) FROM board o WHERE o.grp = b.grp AND o.n >= 30
    AND (o.rating > b.rating OR (o.rating = b.rating AND o.id < b.id))) + 1 END AS rank,
  (SELECT count(*) FROM board o WHERE o.grp = b.grp AND o.n >= 30) AS total
FROM board b WHERE id = 7"""))
def player_card(spark, sf_dir):
    b = base(spark, sf_dir)
    return rounded(board.player_card(b.rows, b.shrink, 7).select("id", "name", "n", "rating", "tier", "rank", "total"))


@query(_sql(PUBLISHED, "SELECT game, play, team, role, yards, zc FROM published WHERE ex IS NULL AND id = 7"))
def player_plays(spark, sf_dir):
    return board.player_plays(base(spark, sf_dir).rows, 7).select("game", "play", "team", "role", "yards", "zc")


@query(_sql(f"{PUBLISHED_SHRINK}, {LISTED}", f"""
SELECT grp, rank, id, name, {r('rating')} AS rating FROM (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY rating DESC, id) AS rank FROM board) WHERE rank <= 5"""))
def top_five(spark, sf_dir):
    b = base(spark, sf_dir)
    top = board.top_per_group(board.listed(b.rows, b.shrink))
    return rounded(top.select("grp", "rank", "id", "name", "rating"))


@query(_sql(PUBLISHED, " UNION ALL ".join(
    f"SELECT DISTINCT '{d}' AS dim, {d} AS value FROM published WHERE ex IS NULL" for d in ("cov", "route", "team"))))
def filter_options(spark, sf_dir):
    return board.filter_options(base(spark, sf_dir).rows).orderBy("dim", "value")


PICKS = """
best AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY zc DESC, game, play) AS mine
  FROM (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM published WHERE ex IS NULL)
  WHERE n >= 30 AND role = 'primary' AND air >= 15 AND dact < dexp) WHERE mine = 1),
picks AS MATERIALIZED (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY zc DESC, game, play) <= 2 AS on_floor FROM best)
  ORDER BY on_floor DESC, zc DESC, game, play LIMIT 8)"""


@query(_sql(f"{PUBLISHED}, {PICKS}", "SELECT id, game, play, name, pos, team, zc, yards, dexp, dact FROM picks"))
def highlights(spark, sf_dir):
    return board.highlight_picks(base(spark, sf_dir).rows)


def _search(name, typed, where_rank):
    fold = "lower(regexp_replace(strip_accents(name), '[^a-zA-Z0-9 ]', '', 'g'))"

    @query(_sql(f"{PUBLISHED_SHRINK}, {LISTED}", f"""
SELECT id, name, score FROM (SELECT *, CASE {where_rank} END AS score FROM (SELECT *, {fold} AS f FROM board))
WHERE score IS NOT NULL ORDER BY score, rating DESC, id LIMIT 8"""), name=name)
    def run(spark, sf_dir):
        b = base(spark, sf_dir)
        return board.search(board.listed(b.rows, b.shrink), typed).select("id", "name", "score")
    return run


def _ranks(q):
    close = q.replace(" ", "")
    return f"""WHEN starts_with(f, '{q}') THEN 0 WHEN len([w for w in string_split(f, ' ') if starts_with(w, '{q}')]) > 0 THEN 1
      WHEN contains(f, '{q}') OR contains(replace(f, ' ', ''), '{close}') THEN 2"""


_search("name_search", "Ra", _ranks("ra"))
_search("name_search_accents", " José Núñez ", _ranks("jose nunez"))
_search("name_search_inside", "kei to", _ranks("kei to"))


@query(_sql("lone AS (SELECT 1)", """
SELECT game_id, play_id, lag(play_id) OVER w AS prev_play_id, lead(play_id) OVER w AS next_play_id
FROM (SELECT DISTINCT game_id, play_id FROM roster) WINDOW w AS (PARTITION BY game_id ORDER BY play_id)"""))
def play_neighbors(spark, sf_dir):
    return board.play_neighbours(tracking(spark, sf_dir).inp)


@query(_sql(PUBLISHED, """
SELECT game, play, id, kind, who, gap, line FROM (
  SELECT game, play, id, CASE WHEN ex IS NULL THEN 'rated' ELSE 'unrated' END AS kind, name || ' · ' || pos || ' · ' || team AS who,
    CASE WHEN ex IS NULL THEN printf('%.2f', abs(yards)) END AS gap,
    CASE WHEN ex IS NOT NULL THEN 'not rated: ' || ex WHEN yards >= 0 THEN 'closer to the catch point than the model expected'
         ELSE 'farther from the catch point than the model expected' END AS line FROM published)"""))
def captions(spark, sf_dir):
    return scene.captions(base(spark, sf_dir).rows).select("game", "play", "id", "kind", "who", "gap", "line")


@query(_sql(PUBLISHED, """
SELECT lower(replace(cov, '_', ' ')) AS cov, CASE result WHEN 'C' THEN 'complete' WHEN 'I' THEN 'incomplete' ELSE 'intercepted' END
  AS result, CASE grp WHEN 'CB' THEN 'corner' WHEN 'S' THEN 'safety' ELSE 'linebacker' END AS grp, team, count(*) AS n,
  max(CASE WHEN yards < 0 THEN '−' ELSE '+' END || printf('%.2f', abs(yards))) AS top,
  floor(avg(CASE WHEN role = 'primary' THEN 1.0 ELSE 0.0 END) * 100 + 0.5)::BIGINT::VARCHAR || '%' AS share
FROM published GROUP BY 1, 2, 3, 4"""))
def text_labels(spark, sf_dir):
    rows = base(spark, sf_dir).rows
    primary = F.avg(F.when(F.col("role") == "primary", 1.0).otherwise(0.0))
    return rows.groupBy(
        text.label(F.col("cov")).alias("cov"), text.outcome(F.col("result")).alias("result"),
        text.group_name(F.col("grp"), many=False).alias("grp"), text.team_name(F.col("team")).alias("team"),
    ).agg(F.count("*").alias("n"), F.max(text.signed(F.col("yards"))).alias("top"), text.percent(primary).alias("share"))


@query(_sql("lone AS (SELECT 1)", r"""
SELECT player_name, count(*) AS n, any_value(upper(f[1] || words[-1][1])) AS initials,
  any_value(upper(regexp_extract(substr(plain, length(f) + 2), '((st\.?|van|vander|von|de|da|del|della|di|du|la|le) )*[^ ]+$', 0, 'i')))
    AS surname,
  any_value(lower(regexp_replace(strip_accents(player_name), '[^a-zA-Z0-9 ]', '', 'g'))) AS folded
FROM (SELECT *, split_part(plain, ' ', 1) AS f, string_split(plain, ' ') AS words FROM (
  SELECT player_name, regexp_replace(regexp_replace(replace(player_name, ',', ' '), '\s+(jr|sr|ii|iii|iv|v)\.?$', '', 'i'), ' +', ' ', 'g') AS plain
  FROM roster)) GROUP BY 1"""))
def name_texts(spark, sf_dir):
    name = F.col("player_name")
    players = tracking(spark, sf_dir).roster.groupBy(name).agg(F.count("*").alias("n"))
    return players.withColumns({
        "initials": text.initials(name), "surname": text.surname(name), "folded": text.folded(name)})


@query(_sql(f"{PLAYERS}, {SPREAD}, {GATED_CELLS}", f"""
SELECT 'plays' AS item, count(*) AS n, sum({row_hash_sql(["game_id", "play_id", "nfl_id", "role", "ex"], ["yards", "z", "zc"])})::BIGINT AS rows FROM centered
UNION ALL SELECT 'players', count(*), sum({row_hash_sql(["nfl_id", "name", "pos", "grp", "n", "tier"], ["mean", "rating", "se"])})::BIGINT FROM players
UNION ALL SELECT 'groups', count(*), sum({row_hash_sql(["grp"], ["within", "k"])})::BIGINT FROM shrink
UNION ALL SELECT 'cells', count(*), sum({row_hash_sql(["dim", "cell", "n"], ["mean"])})::BIGINT FROM cells
UNION ALL SELECT 'teams', count(*), sum({row_hash_sql(["team", "n"], ["mean"])})::BIGINT
  FROM (SELECT team, count(*) AS n, avg(zc) AS mean FROM rated WHERE team IS NOT NULL GROUP BY 1)"""))
def compute_rating(spark, sf_dir):
    """The whole rating plan from the derived tables, with all its checks: every row of what it returns."""
    v = tracking(spark, sf_dir)
    result = rate.compute(v.inp, v.out, v.pred, v.context)
    items = {
        "plays": (result.table, ["game_id", "play_id", "nfl_id", "role", "ex"], ["yards", "z", "zc"]),
        "players": (result.players, ["nfl_id", "name", "pos", "grp", "n", "tier"], ["mean", "rating", "se"]),
        "groups": (result.shrink, ["grp"], ["within", "k"]), "cells": (result.cells, ["dim", "cell", "n"], ["mean"]),
        "teams": (result.teams, ["team", "n"], ["mean"]),
    }
    rows = None
    for name, (df, texts, numbers) in items.items():
        row = df.agg(F.lit(name).alias("item"), F.count("*").alias("n"), hash_sum(row_hash(texts, numbers)).alias("rows"))
        rows = row if rows is None else rows.unionByName(row)
    return rows
