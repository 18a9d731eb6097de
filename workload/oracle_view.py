"""The derived tracking tables as SQL common table expressions, for the independent check of every query."""

import zlib

from workload import tracking as V


def _list(values):
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _folds() -> str:
    games = range(2023090700, 2023090700 + 272)
    return ", ".join(f"({g}, {zlib.crc32(str(g).encode()) % 5})" for g in games)


VIEW = f"""
entries AS (
  SELECT o, sk, q, ep, row_number() OVER (PARTITION BY o ORDER BY (sk * 7919 + o * 104729) % 1009, sk) AS rn
  FROM (SELECT l_orderkey AS o, l_suppkey AS sk, min(l_quantity) AS q, min(l_extendedprice) AS ep
        FROM lineitem GROUP BY 1, 2)
),
folds(game_id, fold) AS (VALUES {_folds()}),
shaped AS (
  SELECT o, sk, rn, q, 2023090700 + o % 272 AS game_id, o AS play_id, sk AS nfl_id,
    CASE WHEN rn = 1 THEN 'Targeted Receiver' WHEN rn = 2 THEN 'Passer' WHEN rn % 5 = 0 THEN 'Other Route Runner'
         ELSE 'Defensive Coverage' END AS player_role,
    CASE WHEN rn = 1 THEN 'WR' WHEN rn = 2 THEN 'QB' WHEN rn % 5 = 0 THEN 'TE'
         ELSE {_list(V.DEFENSE)}[1 + sk % 5] END AS player_position,
    CASE WHEN rn <= 2 OR rn % 5 = 0 THEN 'Offense' ELSE 'Defense' END AS player_side,
    (rn = 1 OR (rn > 2 AND rn % 5 <> 0)) AS player_to_predict,
    CASE WHEN o % 2 = 0 THEN 'left' ELSE 'right' END AS play_direction,
    20 + o % 80 AS absolute_yardline_number,
    {_list(V.FIRST_NAMES)}[1 + sk % 7] || ' ' || {_list(V.LAST_NAMES)}[1 + sk % 9] AS player_name,
    (5 + sk % 2)::VARCHAR || '-' || (sk % 12)::VARCHAR AS player_height,
    180 + sk % 120 AS player_weight,
    '199' || (sk % 10)::VARCHAR || '-01-15' AS player_birth_date,
    5 + (o * 7) % 37 AS num_frames_output, 8 + o % 17 AS n_in,
    (4 + (o * 13) % 120)::DOUBLE AS ball_land_x, (1 + (o * 11) % 54)::DOUBLE AS ball_land_y,
    1::DOUBLE + q / 10::DOUBLE AS s, q / 20::DOUBLE AS a, (floor(ep)::BIGINT % 360)::DOUBLE AS dir
  FROM entries
),
roster AS (
  SELECT *, (dir + 37::DOUBLE) % 360::DOUBLE AS o_deg,
    ball_land_x + (q - 25::DOUBLE) * 0.9::DOUBLE AS x0,
    ball_land_y + ((sk * 17 + o * 3) % 41 - 20)::DOUBLE * 0.5::DOUBLE + 0.13::DOUBLE AS y0,
    s * sin(radians(dir)) AS vx, s * cos(radians(dir)) AS vy,
    ((sk * 37) % 21 - 10)::DOUBLE / 20 + ((sk * 31 + o * 17) % 201 - 100)::DOUBLE / 100 AS gain,
    ((sk * 31 + o * 17) % 201 - 100)::DOUBLE / 100 AS noise
  FROM shaped
),
inp AS (
  SELECT game_id, play_id, player_to_predict, nfl_id, f AS frame_id, play_direction, absolute_yardline_number,
    player_name, player_height, player_weight, player_birth_date, player_position, player_side, player_role,
    x0 + 0.1::DOUBLE * (f - n_in)::DOUBLE * vx AS x, y0 + 0.1::DOUBLE * (f - n_in)::DOUBLE * vy AS y,
    s, a, dir, o_deg AS o, num_frames_output, ball_land_x, ball_land_y, n_in
  FROM (SELECT *, unnest(range(1, n_in + 1)) AS f FROM roster)
),
air AS (
  SELECT *, k::DOUBLE / num_frames_output AS t, x0 + 0.045::DOUBLE * k::DOUBLE * vx AS x_pred,
    y0 + 0.045::DOUBLE * k::DOUBLE * vy AS y_pred,
    sqrt((ball_land_x - x0) * (ball_land_x - x0) + (ball_land_y - y0) * (ball_land_y - y0)) AS dl
  FROM (SELECT *, unnest(range(1, num_frames_output + 1)) AS k FROM roster WHERE player_to_predict)
),
outp AS (
  SELECT game_id, play_id, nfl_id, k AS frame_id,
    CASE WHEN rn = 1 THEN x0 + (ball_land_x + noise * 4.15::DOUBLE - x0) * t
         ELSE x_pred + gain * t * (ball_land_x - x0) / dl END AS x,
    CASE WHEN rn = 1 THEN y0 + (ball_land_y - y0) * t
         ELSE y_pred + gain * t * (ball_land_y - y0) / dl END AS y
  FROM air
),
pred AS (
  SELECT game_id, play_id, nfl_id, k AS frame_id, x_pred, y_pred, 0.5::DOUBLE + 0.02::DOUBLE * k AS sd_x,
    0.4::DOUBLE + 0.02::DOUBLE * k AS sd_y, fold
  FROM air JOIN folds USING (game_id)
),
ctx AS (
  SELECT game_id, play_id, 1 + o % 18 AS week,
    CASE WHEN o % 2 = 0 THEN 'T' || ((o * 5) % 32)::VARCHAR ELSE 'T' || ((o * 5 + 1) % 32)::VARCHAR END AS home,
    CASE WHEN o % 2 = 0 THEN 'T' || ((o * 5 + 1) % 32)::VARCHAR ELSE 'T' || ((o * 5) % 32)::VARCHAR END AS away,
    'T' || ((o * 5 + 1) % 32)::VARCHAR AS off, 'T' || ((o * 5) % 32)::VARCHAR AS team,
    'pass ' || o::VARCHAR AS "desc", 1 + o % 4 AS q, '10:' || lpad((o % 60)::VARCHAR, 2, '0') AS clock,
    1 + o % 4 AS down, 1 + o % 15 AS dist, ['C', 'I', 'IN'][1 + o % 4] AS result,
    {_list(V.ROUTES)}[1 + (o * 3) % 7] AS route, {_list(V.MAN_ZONE)}[1 + o % 3] AS mz,
    {_list(V.COVERAGES)}[1 + o % 5] AS cov,
    CASE WHEN o % 11 <> 0 THEN ((o * 13) % 201 - 100)::DOUBLE / 50 END AS epa
  FROM roster WHERE rn = 1
)"""
