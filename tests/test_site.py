"""Leaderboards, documents, scenes, text, requests, files, streams and publication."""

import json
import math

import pytest
from pyspark.sql import functions as F

from pursuit.functions import text
from pursuit.operators import board, documents, ordering, quality, ratings, scene
from pursuit.plans import prepare, rate
from pursuit.schema import FRAME, INPUT_SCHEMA, OUTPUT_SCHEMA
from pursuit.sources import documents as sinks
from pursuit.sources import requests as req
from pursuit.sources import tracking as files
from pursuit.streaming.requests import stream_requests
from pursuit.streaming.weeks import stream_weeks
from tests.conftest import CORNER, GAINED, GAME, IN, LAND, OUT, PASSER, PLAY, RECEIVER, flight, rating_rows, track
from tests.test_rating import shrink_table

PUBLISHED = "game long, play long, week long, id long, name string, pos string, grp string, team string, cov string, mz string, " \
            "route string, result string, epa double, air long, role string, d0 double, dexp double, dact double, yards double, " \
            "z double, zc double, ex string"


def published_row(**over):
    row = dict(game=31, play=4, week=6, id=1, name="Ove", pos="CB", grp="CB", team="LV", cov="COVER_6_ZONE", mz="zone", route="POST",
               result="IN", epa=-0.3, air=22, role="primary", d0=8.0, dexp=4.5, dact=2.0, yards=0.7, z=1.1, zc=0.9, ex=None)
    return {**row, **over}


def published(spark, rows):
    names = [f.split(" ")[0] for f in PUBLISHED.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], PUBLISHED)


# one row per combination of these values; every filter must keep exactly the rows it describes
SHAPES = [(g, r, t, c) for g in ("CB", "S", "LB") for r in ("primary", "help") for t in ("LV", "SEA")
          for c in (("COVER_0_MAN", "man", "POST"), ("COVER_6_ZONE", "zone", "WHEEL"), ("COVER_2_MAN", "man", "WHEEL"))]


@pytest.mark.parametrize("chosen, rule", [
    ({"grp": "any"}, lambda g, r, t, c: True), ({"grp": "S"}, lambda g, r, t, c: g == "S"),
    ({"grp": "any", "role": "help"}, lambda g, r, t, c: r == "help"), ({"grp": "LB", "team": "SEA"}, lambda g, r, t, c: (g, t) == ("LB", "SEA")),
    ({"grp": "any", "cov": "man"}, lambda g, r, t, c: c[1] == "man"), ({"grp": "CB", "cov": "COVER_2_MAN"}, lambda g, r, t, c: g == "CB" and c[0] == "COVER_2_MAN"),
    ({"grp": "any", "route": "WHEEL", "cov": "zone"}, lambda g, r, t, c: c[2] == "WHEEL" and c[1] == "zone"),
])
def test_filters(spark, chosen, rule):
    rows = published(spark, [published_row(id=i, grp=g, role=r, team=t, cov=c[0], mz=c[1], route=c[2]) for i, (g, r, t, c) in enumerate(SHAPES)])
    got = {r.id for r in board.apply_filters(rows, board.Filters(**chosen)).collect()}
    assert got == {i for i, shape in enumerate(SHAPES) if rule(*shape)}


# id, name, group, mean score, plays: made for these tests
ROSTER = [
    (21, "Åsa Lindqvist", "CB", 0.40, 6), (22, "Bo Åkesson", "CB", 0.90, 2), (23, "Dov Ben-Ami", "CB", -0.20, 5),
    (24, "Io Steﬁn", "S", 0.60, 4), (25, "Lin Åberg", "S", 0.55, 8), (26, "Pat O'Lind", "LB", 1.50, 1),
]
SHRINK = {"CB": 2.0, "S": 6.0, "LB": 1.0}
LEAST = 2


@pytest.fixture(scope="module")
def people(spark):
    rows = [published_row(id=i, name=n, grp=g, pos=g, zc=z, play=100 * i + k) for i, n, g, z, plays in ROSTER for k in range(plays)]
    rows += [published_row(id=26, name="Pat O'Lind", grp="LB", pos="LB", zc=9.0, ex="out of bounds", play=9000 + k) for k in range(3)]
    return published(spark, rows).cache(), shrink_table(spark, [(g, 1.0, 1.0 / k, k) for g, k in SHRINK.items()])


def by_rating(group=None):
    """Ids by the rule: the mean times n / (n + k), of players with enough plays."""
    rated = [(-z * n / (n + SHRINK[g]), i) for i, _, g, z, n in ROSTER if n >= LEAST and group in (None, g)]
    return [i for _, i in sorted(rated)]


def test_boards_use_each_groups_shrinkage(people):
    order = [r.id for r in board.listed(*people, min_plays=LEAST).orderBy(*board.board_order()).collect()]
    assert order == by_rating() and 26 not in order
    for group in SHRINK:
        assert {r.id for r in board.board(*people, group, LEAST).collect()} == set(by_rating(group))


def test_ranks_and_cards(people):
    ranks = {r.id: (r.rank, r.total, r.rank_text) for r in board.ranked(board.listed(*people, min_plays=LEAST)).collect()}
    cb, s = by_rating("CB"), by_rating("S")
    words = {1: "1st", 2: "2nd", 3: "3rd"}
    assert ranks == {**{i: (k, 3, f"{words[k]} of 3 corners") for k, i in enumerate(cb, 1)}, **{i: (k, 2, f"{words[k]} of 2 safeties") for k, i in enumerate(s, 1)}}
    card = board.player_card(*people, player=25, min_plays=LEAST).first()
    assert (card["rank"], card.total, card.n) == (s.index(25) + 1, 2, 8)
    assert board.player_card(*people, player=26, min_plays=LEAST).first()["rank"] is None


@pytest.mark.parametrize("typed, ids", [
    ("lin", {21, 25}), ("ÅBERG", {25}), ("aberg", {25}), ("ben ami", {23}), ("benami", {23}), ("stefin", {24}), ("Steﬁn", {24}),
    ("bo", {22}), ("olind", set()), ("", set()), (" \t", set()), ("qqq", set()),
])
def test_search(people, typed, ids):
    assert {r.id for r in board.search(board.listed(*people, min_plays=LEAST), typed).collect()} == ids


def test_search_ranks_starts_before_words_before_parts(spark):
    rows = spark.createDataFrame([("Okko Arden", 9.0, 1), ("Una Kolt", 5.0, 2), ("Kole Vint", 1.0, 3), ("Kosta Ito", 0.5, 4)], "name string, rating double, id long")
    assert [r.id for r in board.search(rows, "ko").collect()] == [3, 4, 2, 1]
    assert board.search(rows, "o", 3).count() == 3


def test_main_team_falls_back_to_the_latest_game(spark):
    few = [published_row(id=81, game=g, team=t, zc=z) for g, t, z in ((402, "NO", 3.0), (407, "TB", -2.0), (405, "SF", 0.0))]
    many = [published_row(id=82, game=500 + g, team="NO" if g < 15 else "TB") for g in range(27)]
    got = {r.id: r.main_team for r in board.rate_players(published(spark, few + many), shrink_table(spark, [("CB", 1.0, 1.0, 1.0)]), 1).collect()}
    assert got == {81: "TB", 82: "NO"}


def test_team_board_drops_small_teams(spark):
    scores = {"LV": [0.2, 0.9, -0.6, 1.5, 0.0], "TB": [4.0, -4.0]}
    rows = [published_row(play=k, team=t, zc=z) for t, values in scores.items() for k, z in enumerate(values)]
    (r,) = board.filtered_teams(published(spark, rows), board.Filters(min_plays=3)).collect()
    every = scores["LV"] + scores["TB"]
    pooled = sum((v - sum(every) / 7) ** 2 for v in every) / 6  # the variance still uses every row
    assert r.team == "LV" and r.mean == pytest.approx(0.4) and r.se == pytest.approx(math.sqrt(pooled / 5))


def reel_rule(rows, n, least):
    """The picks by the rule, in plain Python: of each player with enough rated plays the best eligible play; the best two
    of every group first, then the best of the rest."""
    rated = [r for r in rows if r["ex"] is None]
    order = lambda r: (-r["zc"], r["game"], r["play"])
    best = {}
    for r in sorted(rated, key=order):
        enough = sum(x["id"] == r["id"] for x in rated) >= least
        if enough and r["role"] == "primary" and r["air"] >= 15 and r["dact"] < r["dexp"]:
            best.setdefault(r["id"], r)
    every = sorted(best.values(), key=order)
    floor = [r for g in {r["grp"] for r in every} for r in [x for x in every if x["grp"] == g][:2]]
    rest = [r for r in every if r not in floor]
    return sorted((sorted(floor, key=order) + rest)[:n], key=order)


@pytest.mark.parametrize("n", [8, 7, 4])
def test_highlights_follow_the_rule(spark, n):
    """Own table: scores by a formula, some plays short, far, excluded or helped."""
    rows = []
    for i in range(24):
        for k in range(4):
            rows.append(published_row(
                id=300 + i, game=40 + k, play=10 * i + k, grp=("LB", "S", "CB", "CB", "CB")[i % 5], zc=((i * 37 + k * 11) % 50) / 10,
                air=14 if (i + k) % 5 == 0 else 15, role="help" if (i * k) % 7 == 3 else "primary",
                ex="not catchable" if (i + 2 * k) % 9 == 4 else None, dexp=2.0 if (i + 3 * k) % 11 == 6 else 5.0))
    table = published(spark, rows[::-1])
    want = [(r["id"], r["game"], r["play"]) for r in reel_rule(rows, n, 3)]
    assert len(want) == n and [(r.id, r.game, r.play) for r in board.highlight_picks(table, n, min_plays=3).collect()] == want
    assert board.highlight_picks(table, min_plays=9).count() == 0


def test_ranks_and_neighbours_cross_the_seams_of_one_large_group(spark):
    """All rows in one group, spread over several partitions: ranks and neighbours equal a plain sort."""
    rows = spark.range(1, 5001).select(F.lit(1).alias("g"), ((F.col("id") * 7919) % 5003).alias("v"))
    values = sorted(r.v for r in rows.collect())
    ranked = ordering.with_rank(rows, ["g"], [F.asc("v")], total="total").collect()
    assert {r.v: r.rank for r in ranked} == {v: i + 1 for i, v in enumerate(values)} and {r.total for r in ranked} == {5000}
    near = {r.v: (r.prev_v, r.next_v) for r in ordering.with_neighbours(rows, ["g"], "v").collect()}
    assert near == {v: (values[i - 1] if i else None, values[i + 1] if i + 1 < 5000 else None) for i, v in enumerate(values)}


@pytest.fixture(scope="module")
def centered(rating_play):
    return ratings.center(rate.checked_play_table(*rating_play))


def test_play_documents_hold_everything_and_give_the_rows_back(rating_play, centered):
    inp, out, pred, context = rating_play
    docs = {d.nfl_id: d for d in documents.play_documents(inp, out, pred, centered, context).collect()}
    doc = docs[3]
    assert set(docs) == {1, 2, 3, 4} and {d.run for d in docs.values()} == {0}
    assert (doc.home, doc.away, doc.week, doc["def"], doc.off, doc.nfo, doc.land) == ("SEA", "LV", 3, "SEA", "LV", OUT, list(LAND))
    assert docs[1].player.out is None and docs[1].player.pred is None and len(docs[1].player["in"]) == IN and len(docs[1].player["in"][0]) == 6
    assert len(docs[2].player.out) == OUT and len(doc.player.pred[0]) == 4 and doc.player.p and not docs[1].player.p
    assert {i: (d.rating.role, d.rating.yards) for i, d in docs.items() if d.rating} == {3: ("primary", GAINED[3]), 4: ("help", GAINED[4])}
    plays = documents.play_documents(inp, out, pred, centered, context)
    gap = documents.input_rows(plays).select(*FRAME, *[F.col(c).alias(f"{c}_2") for c in ("x", "y", "player_height")]).join(inp, FRAME)
    row = gap.agg(F.count("*").alias("n"), F.max(F.abs(F.col("x") - F.col("x_2"))).alias("x"),
                  F.count_if(F.col("player_height") == F.col("player_height_2")).alias("same")).first()
    assert row.n == 4 * IN == row.same and row.x < 0.006
    moved = documents.input_rows(plays, (61.0, 3.0), 9).first()
    assert (moved.ball_land_x, moved.ball_land_y, moved.num_frames_output) == (61.0, 3.0, 9)


def test_long_tracks_are_runs_of_one_length(rating_play, centered, monkeypatch):
    inp, out, pred, context = rating_play
    monkeypatch.setattr(documents, "TRACK_RUN", 4)
    plays = documents.play_documents(inp, out, pred, centered, context)
    assert {(r.nfl_id, r.run) for r in plays.collect()} == {(i, k) for i in (1, 2, 3, 4) for k in range(3)}
    rows = documents.input_rows(plays)
    assert rows.count() == 4 * IN and rows.select(*FRAME).distinct().count() == 4 * IN
    assert rows.where(f"frame_id = {IN}").count() == 4
    (header,) = documents.game_headers(plays).collect()
    assert (header.game, header.week, header.home, header.away, header.plays) == (GAME, 3, "SEA", "LV", 1)


def test_published_numbers_are_rounded(spark, centered):
    rows = documents.published(centered.withColumn("zc", F.lit(0.1234567))).collect()
    assert {r.zc for r in rows} == {0.123457} and all(round(r.d0, 2) == r.d0 for r in rows)
    assert documents.published(centered).columns == [f.split(" ")[0] for f in PUBLISHED.split(", ")]


def test_columnar_documents_read_back(spark, tmp_path):
    rows = published(spark, [published_row(play=i, name='q"uo,te', epa=None if i % 2 else 0.5, ex="x" if i % 3 else None) for i in range(50)])
    docs = sinks.columnar_documents(rows, ["game", "play", "id"], ["game", "play"])
    assert docs.count() == 50
    doc = json.loads(docs.first().value)
    assert doc["columns"] == rows.columns and all(len(r) == 22 for r in doc["rows"])
    sinks.write_columnar(rows, ["game", "play", "id"], ["game", "play"], str(tmp_path / "plays"))
    assert sinks.read_columnar(spark, str(tmp_path / "plays"), rows.schema).exceptAll(rows).count() == 0


def test_nothing_that_is_not_finite_is_published(spark, tmp_path):
    rows = published(spark, [published_row(z=float("nan"))])
    with pytest.raises(quality.ValidationError, match=r"z \(1\)"):
        sinks.write_rows(rows, str(tmp_path / "plays"))


def test_scene_paths_are_padded_and_held(spark):
    rows = track(*PASSER) + track(*RECEIVER) + track(*CORNER, frames=IN - 3)
    inp = spark.createDataFrame(rows, INPUT_SCHEMA)
    out = spark.createDataFrame(flight(rows, 2) + flight(rows, 3, OUT - 2), OUTPUT_SCHEMA)
    last = IN + OUT - 1
    frames = {(r.nfl_id, r.frame): (r.l, r.u) for r in scene.scrimmage_frames(inp, out).collect()}
    assert len(frames) == 3 * (IN + OUT)
    assert frames[3, 0] == frames[3, 3] and frames[3, 4] != frames[3, 3]  # padded at the front
    assert frames[1, IN - 1] == frames[1, last]  # nobody knows where this one went: it stays
    assert frames[3, last] == frames[3, last - 2] != frames[3, last - 3]  # short output holds its last point
    assert frames[2, 0] == pytest.approx((53.3 - 15, 5.0))


def test_ball_flies_from_the_passer_to_the_spot(rating_play):
    ball = {r.frame: r for r in scene.ball_track(rating_play[0]).collect()}
    land = (53.3 - LAND[1], LAND[0] - 47)
    assert len(ball) == IN + OUT and ball[0].h == 1.6 and (ball[IN + OUT - 1].l, ball[IN + OUT - 1].u, ball[IN + OUT - 1].h) == pytest.approx((*land, 0.0))
    arc, share = min(9, 0.22 * math.dist(land, (53.3 - 26.5, 44 - 47))), 2 / OUT
    assert ball[IN + 1].h == pytest.approx(1.6 * (1 - share) + 4 * arc * share * (1 - share))


def test_passer_and_featured_fall_back(spark, rating_play, centered):
    inp = rating_play[0]
    ends = scene.input_ends(inp.withColumn("player_role", F.when(F.col("nfl_id") == 1, "Other Route Runner").otherwise(F.col("player_role"))))
    assert scene.passer(ends).first().nfl_id == 1
    assert scene.featured(ends, centered).first().nfl_id == 3
    assert scene.featured(ends, centered, 4).first().nfl_id == 4
    assert scene.featured(ends, centered, 2).first().nfl_id == 3
    assert scene.featured(ends, centered.where("false")).first().nfl_id == 3


def test_expected_points_start_at_the_throw_and_hold(rating_play):
    inp, _, pred, _ = rating_play
    steps = {r.step: r for r in scene.expected_points(inp, pred.where(f"frame_id < {OUT}")).where("nfl_id = 3").collect()}
    assert sorted(steps) == list(range(OUT + 1)) and steps[OUT].l == steps[OUT - 1].l != steps[OUT - 2].l


def test_resampling_blends_between_frames(rating_play):
    inp, out, _, _ = rating_play
    frames = scene.scrimmage_frames(inp, out).where("nfl_id = 2")
    fine = {r.frame: r.u for r in scene.resample(frames, 4).collect()}
    last = IN + OUT - 1
    assert len(fine) == last * 4 + 1 and fine[0.5] == pytest.approx(5.3) and fine[float(last)] == pytest.approx(5 + 0.6 * last)


def test_captions(spark):
    rows = scene.captions(published(spark, [
        published_row(yards=-1.234), published_row(id=2, yards=0.0), published_row(id=3, ex="out of bounds")]))
    got = {r.id: (r.kind, r.who, r.gap, r.line) for r in rows.collect()}
    assert got[1] == ("rated", "Ove · CB · LV", "1.23", "farther from the catch point than the model expected")
    assert got[2][3].startswith("closer to") and got[3] == ("unrated", "Ove · CB · LV", None, "not rated: out of bounds")


def one(spark, kind, value, fn):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v"))).first()[0]


def test_text_columns(spark):
    assert [one(spark, "double", v, text.signed) for v in (0.4249, -1.3, 0.0, -0.004)] == ["+0.42", "−1.30", "+0.00", "−0.00"]
    numbers = spark.createDataFrame([(n,) for n in (1, 2, 3, 4, 11, 12, 13, 21, 22, 101, 111, 112, 134)], "n long")
    assert [r[0] for r in numbers.select(text.ordinal(F.col("n"))).collect()] == [
        "1st", "2nd", "3rd", "4th", "11th", "12th", "13th", "21st", "22nd", "101st", "111th", "112th", "134th"]
    assert one(spark, "string", "COVER_3_ZONE", text.label) == "cover 3 zone" and one(spark, "double", 0.645, text.percent) == "65%"
    assert [one(spark, "string", v, text.outcome) for v in ("C", "I", "IN")] == ["complete", "incomplete", "intercepted"]
    assert [one(spark, "string", v, text.group_name) for v in ("LB", "XX")] == ["linebackers", "XX"]
    assert [one(spark, "string", v, text.team_name) for v in ("LA", "ZZZ")] == ["Los Angeles Rams", "ZZZ"] and len(text.TEAM_NAMES) == 32
    names = ["Nils Holm III", "Ugo Parr, Sr.", "Eli-Jo St. Clou", "Ida", "", "Per von Au", "Sr", "Lea di Rossi", "Ib Vander Kamp IV"]
    assert [one(spark, "string", v, text.initials) for v in names[:5]] == ["NH", "UP", "EC", "I", "?"]
    assert [one(spark, "string", v, text.surname) for v in names] == [
        "HOLM", "PARR", "ST. CLOU", "IDA", "", "VON AU", "SR", "DI ROSSI", "VANDER KAMP"]


@pytest.mark.parametrize("name", ["Åsa Lindqvist", "Io Steﬁn", "Ðor ½ Ĳs", "Ｆｕｌｌ Ｗｉｄｔｈ", "Ŀuc ǅan Ⅷ", "㎏ ™ ㏒ ⒜", "Łukasz Žák-Ňu", "名前 x", ""])
def test_names_fold_as_typed_text_does(spark, name):
    assert one(spark, "string", name, text.folded).strip() == text.folded_query(name)


def request(rows=None, **change):
    rows = rows if rows is not None else track(*PASSER) + track(*RECEIVER) + track(*CORNER)
    return [{**dict(zip(INPUT_SCHEMA.names, r)), **change} for r in rows]


def as_body(rows, **top):
    return json.dumps({"rows": rows, **top})


BASE = request()
REQUESTS = {
    "good": (as_body(BASE), None),
    "text flag": (as_body([{**r, "player_to_predict": str(r["player_to_predict"])} for r in BASE]), None),
    "missing": (as_body([{k: v for k, v in r.items() if k != "ball_land_x"} for r in BASE]), "missing columns ball_land_x"),
    "two plays": (as_body(BASE + request(play_id=2)), "exactly one play"),
    "text": (as_body([{**BASE[0], "x": "fifty"}] + BASE[1:]), "values in x"),
    "fraction": (as_body([{**BASE[0], "frame_id": 1.5}] + BASE[1:]), "values in frame_id"),
    "null flag": (as_body([{**BASE[0], "player_to_predict": None}] + BASE[1:]), None),
    "point": (as_body([{**r, "nfl_id": float(r["nfl_id"])} for r in BASE]), None),
    "no flag": (as_body([{k: v for k, v in r.items() if k != "player_to_predict"} for r in BASE]), "missing columns player_to_predict"),
    "null": (as_body([{**BASE[0], "player_role": None}] + BASE[1:]), "values in player_role"),
    "nan": (as_body(request(x=float("nan"))), "values in x"),
    "infinite": (as_body(request(x=float("inf"))), "values in x"),
    "overflow": (as_body(request(x=123456.0)).replace("123456.0", "1e400"), "values in x"),
    "not json": ("{not json", "at least one row"),
    "nested": ("[" * 2000, "at least one row"),
    "empty": ('{"rows": []}', "at least one row"),
    "no rows": ("{}", "at least one row"),
    "role": (as_body(request(player_role="Kicker")), "player_role"),
    "height": (as_body(request(player_height="tall")), "player_height"),
    "direction": (as_body(request(play_direction="up")), "play_direction"),
    "air": (as_body(request(num_frames_output=500)), "num_frames_output"),
    "nobody": (as_body(request(player_to_predict=False)), "no row has player_to_predict"),
    "players": (as_body([{**r, "nfl_id": r["nfl_id"] + 10 * i} for i in range(11) for r in BASE]), "at most 30 players"),
    "rows": (as_body(BASE * 149), f"at most 4000 rows, got {149 * 3 * IN}"),
}


def test_requests_get_the_first_rule_they_break(spark):
    bodies = spark.createDataFrame([(k, b) for k, (b, _) in REQUESTS.items()], "request_id string, body string")
    parsed = req.parse_requests(bodies)
    errors = {r.request_id: r.error for r in parsed.select("request_id", "error").collect()}
    for name, (_, want) in REQUESTS.items():
        assert (errors[name] is None) if want is None else want in errors[name], (name, errors[name])
    rows = req.accepted(parsed)
    assert rows.count() == 4 * 3 * IN and rows.where("request_id = 'good'").drop("request_id").schema.names == INPUT_SCHEMA.names
    flags = rows.where("request_id = 'null flag'").groupBy("player_to_predict").count().collect()
    assert {r.player_to_predict: r["count"] for r in flags} == {True: 2 * IN, False: IN}
    assert {r.nfl_id for r in rows.where("request_id = 'point'").collect()} == {1, 2, 3}
    assert req.quarantined(parsed).count() == len(REQUESTS) - 4


def test_base64_bodies(spark):
    bodies = spark.createDataFrame([("a", as_body(BASE), True), ("b", as_body(BASE), False)], "request_id string, body string, is_base64 boolean")
    bodies = bodies.withColumn("body", F.when(F.col("is_base64"), F.base64(F.encode("body", "UTF-8"))).otherwise(F.col("body")))
    assert [r.error for r in req.parse_requests(bodies).collect()] == [None, None]


def test_request_stream_replaces_a_batch_that_runs_again(spark, tmp_path):
    source = tmp_path / "in"
    bodies = spark.createDataFrame([("a", as_body(BASE)), ("b", "{")], "request_id string, body string")
    bodies.write.json(str(source))
    args = [str(tmp_path / n) for n in ("good", "bad", "checkpoint")]
    stream_requests(spark, str(source), *args).awaitTermination()
    stream_requests(spark, str(source), *args).awaitTermination()
    from pursuit.streaming.requests import write_batch
    write_batch(bodies, 0, *args[:2])
    assert spark.read.parquet(args[0]).count() == 3 * IN and spark.read.parquet(args[1]).count() == 1


def write_raw(folder, week, rows, out, season=2023):
    folder.mkdir(parents=True, exist_ok=True)

    def lines(names, data):
        return "\n".join([",".join(names), *[",".join(str(v) for v in r) for r in data]]) + "\n"

    (folder / f"input_{season}_w{week:02d}.csv").write_text(lines(INPUT_SCHEMA.names, rows))
    if out is not None:
        (folder / f"output_{season}_w{week:02d}.csv").write_text(lines(OUTPUT_SCHEMA.names, out))


def test_weeks_parse():
    assert files.parse_weeks("3") == [3] and files.parse_weeks("1-3") == [1, 2, 3]
    with pytest.raises(ValueError):
        files.parse_weeks("one")


def test_prepare_stores_and_loads_weeks(spark, tmp_path):
    rows, out, _ = rating_rows()
    for week in (1, 2):
        write_raw(tmp_path / "raw", week, [(week, *r[1:]) for r in rows], [(week, *r[1:]) for r in out])
    raw, processed = str(tmp_path / "raw"), str(tmp_path / "processed")
    prepare.prepare_weeks(spark, raw, processed, [1, 2])
    prepare.prepare_weeks(spark, raw, processed, [2])  # replaces week 2 only
    inp, air = files.load_weeks(spark, processed, [1, 2])
    assert inp.count() == 8 * IN and air.count() == 6 * OUT and inp.where("player_to_predict").count() == 6 * IN
    inp, air = files.load_weeks(spark, processed, [1, 2], columns=["x", "y"], games=[2])
    assert inp.columns == ["x", "y"] and inp.count() == 4 * IN and air.count() == 3 * OUT
    plan = files.load_weeks(spark, processed, [1], games=[1])[0].select("x")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(week" in plan and "PushedFilters: [IsNotNull(game_id), EqualTo(game_id" in plan
    assert "ReadSchema: struct<game_id:bigint,x:double>" in plan


def test_seasons_and_long_week_numbers_stand_side_by_side(spark, tmp_path):
    rows, out, _ = rating_rows()
    raw, processed = tmp_path / "raw", str(tmp_path / "processed")
    for season, week, game in ((2023, 1, 5), (2024, 1, 6), (2024, 104, 7)):
        write_raw(raw, week, [(game, *r[1:]) for r in rows], [(game, *r[1:]) for r in out], season)
    prepare.prepare_weeks(spark, str(raw), processed, [1], 2023)
    prepare.prepare_weeks(spark, str(raw), processed, [1, 104], 2024)
    inp, _ = files.load_weeks(spark, processed)
    assert {(r.season, r.week, r.game_id) for r in inp.select("season", "week", "game_id").distinct().collect()} == {
        (2023, 1, 5), (2024, 1, 6), (2024, 104, 7)}
    assert files.load_weeks(spark, processed, [1], season=2024)[0].count() == 4 * IN


def test_a_bad_week_and_a_bad_file_name_are_refused(spark, tmp_path):
    rows, out, _ = rating_rows()
    raw = tmp_path / "raw"
    write_raw(raw, 1, rows, out)
    turned = INPUT_SCHEMA.names.index("dir")
    write_raw(raw, 2, [(GAME + 1, *r[1:turned], (90 - r[turned]) % 360, *r[turned + 1:]) for r in rows], [(GAME + 1, *r[1:]) for r in out])
    with pytest.raises(quality.ValidationError, match="1 weeks fail the angle convention check"):
        prepare.prepare_weeks(spark, str(raw), str(tmp_path / "processed"), [1, 2])
    assert not (tmp_path / "processed").exists()
    (raw / "input_one.csv").write_text((raw / "input_2023_w01.csv").read_text())
    with pytest.raises(Exception, match="no season and week in the file name"):
        files.read_input_csv(spark, [str(raw / "input_one.csv")]).collect()


def test_landed_weeks_wait_for_both_files(spark, tmp_path):
    rows, out, _ = rating_rows()
    raw, processed, checkpoint = (tmp_path / n for n in ("raw", "processed", "checkpoint"))
    write_raw(raw, 1, rows, out)
    write_raw(raw, 2, [(2, *r[1:]) for r in rows], None)
    stream_weeks(spark, str(raw), str(processed), str(checkpoint)).awaitTermination()
    assert {r.week for r in files.load_weeks(spark, str(processed))[0].select("week").distinct().collect()} == {1}
    write_raw(raw, 2, [(2, *r[1:]) for r in rows], [(2, *r[1:]) for r in out])
    stream_weeks(spark, str(raw), str(processed), str(checkpoint)).awaitTermination()
    assert files.load_weeks(spark, str(processed))[0].count() == 8 * IN


def test_context_keeps_a_subset_and_fills_unknowns(spark, tmp_path):
    header = "extra,game_id,play_id,week,home_team_abbr,visitor_team_abbr,possession_team,defensive_team,play_description,quarter," \
             "game_clock,down,yards_to_go,pass_result,route_of_targeted_receiver,team_coverage_man_zone,team_coverage_type,expected_points_added"
    path = tmp_path / "context.csv"
    path.write_text(header + "\nx,31,4,6,LV,SEA,SEA,LV,out route,3,02:17,2,8,IN,OUT,MAN_COVERAGE,COVER_0_MAN,-1.25\n"
                    "y,31,9,6,LV,SEA,SEA,LV,screen,4,00:31,4,1,NA,NA,NA,NA,NA\n")
    one_, two = files.read_context_csv(spark, str(path)).orderBy("play_id").collect()
    assert (one_.mz, one_.cov, one_.epa, one_.clock, one_.dist) == ("man", "COVER_0_MAN", -1.25, "02:17", 8)
    assert (two.mz, two.route, two.cov, two.result, two.epa) == ("unknown", "unknown", "unknown", None, None)


def test_predictions_round_trip(spark, rating_play, tmp_path):
    pred = rating_play[2]
    files.write_predictions(pred, str(tmp_path / "p"))
    back = files.read_predictions(spark, str(tmp_path / "p"))
    assert back.exceptAll(pred).count() == 0 and back.count() == 3 * OUT


def test_a_failed_gate_writes_the_audit_and_leaves_the_public_data(spark, rating_play, tmp_path):
    result = rate.compute(*rating_play)
    with pytest.raises(rate.GateFailed, match="reliability"):
        rate.publish(result, *rating_play, audit=str(tmp_path / "audit"), public=str(tmp_path / "public"))
    assert spark.read.parquet(str(tmp_path / "audit/plays")).count() == 2 and not (tmp_path / "public").exists()
    assert spark.read.json(str(tmp_path / "audit/checks")).first().passed is False
    assert spark.read.parquet(str(tmp_path / "audit/cells")).columns == ["dim", "cell", "n", "mean", "ok"]


def test_a_passed_gate_publishes_everything(spark, rating_play, tmp_path):
    result = rate.compute(*rating_play)
    result.checks = result.checks.withColumn("passed", F.lit(True))
    public = tmp_path / "public"
    (public / "games" / "plays" / "game_id=999").mkdir(parents=True)
    rate.publish(result, *rating_play, audit=str(tmp_path / "audit"), public=str(public), run="r7")
    meta = spark.read.json(str(public / "meta")).first()
    assert meta.run == "r7" and meta.counts.plays == 1 and meta.min_plays == 30 and set(meta.shrink.asDict()) == {"CB", "S"}
    assert not (public / "games" / "plays" / "game_id=999").exists()
    (game,) = spark.read.json(str(public / "games/games")).collect()
    assert (game.game, game.plays) == (GAME, 1) and spark.read.json(str(public / "games/plays")).count() == 4
    assert spark.read.json(str(public / "plays")).count() == 2
