"""Leaderboards over the published play rows: filters, re-rating, ranks, search, options and highlights."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pursuit.functions import text
from pursuit.operators.ordering import with_neighbours, with_rank
from pursuit.operators.playtable import rated
from pursuit.operators.ratings import player_means, shrunk, teams
from pursuit.schema import HIGHLIGHT_AIR, MIN_PLAYS, PLAY
from pursuit.staging import lookup, staged

ANY = "any"


def best_first():
    return [F.desc("zc"), F.asc("game"), F.asc("play")]


def board_order():
    return [F.desc("rating"), F.asc("id")]


@dataclass(frozen=True)
class Filters:
    """Leaderboard filters; ``any`` switches one off. ``cov`` takes man, zone or one coverage type."""

    grp: str = ANY
    cov: str = ANY
    route: str = ANY
    role: str = ANY
    team: str = ANY
    min_plays: int = MIN_PLAYS


def apply_filters(rows: DataFrame, f: Filters) -> DataFrame:
    """Plain predicates, so they reach the scan of a published table."""
    for name in ("grp", "route", "role", "team"):
        if getattr(f, name) != ANY:
            rows = rows.where(F.col(name) == getattr(f, name))
    if f.cov != ANY:
        rows = rows.where(F.col("mz" if f.cov in ("man", "zone") else "cov") == f.cov)
    return rows


def rate_players(rows: DataFrame, shrink: DataFrame, min_plays: int = MIN_PLAYS) -> DataFrame:
    """The player ratings of whatever rows the filters left, with the season's shrinkage.

    Groups without shrinkage drop out, and a play without a result counts as not complete."""
    complete = F.coalesce(F.col("result") == "C", F.lit(False))
    p = player_means(rows, "id", ("game", "play"), complete).where(F.col("n") >= min_plays)
    p = shrunk(p, shrink, strict=False)
    main = F.coalesce(F.get("teams", F.lit(0)), F.col("latest_team"), F.lit(""))
    return p.withColumn("main_team", main).select(
        "id", "name", "pos", "grp", "n", "mean", "yards", "comp", "epa", "teams", "team_n", "rating", "se", "tier",
        "main_team",
    )


def filtered_ratings(rows: DataFrame, shrink: DataFrame, f: Filters) -> DataFrame:
    return rate_players(apply_filters(rated(rows), f), shrink, f.min_plays)


def filtered_teams(rows: DataFrame, f: Filters) -> DataFrame:
    """Team means under the coverage, route and role filters; groups and teams are always taken together."""
    kept = apply_filters(rated(rows), Filters(cov=f.cov, route=f.route, role=f.role))
    return teams(kept, f.min_plays)


def listed(rows: DataFrame, shrink: DataFrame, min_plays: int = MIN_PLAYS) -> DataFrame:
    return rate_players(rated(rows), shrink, min_plays)


def board(rows: DataFrame, shrink: DataFrame, grp: str, min_plays: int = MIN_PLAYS) -> DataFrame:
    """The leaderboard of one position group with no other filter."""
    return filtered_ratings(rows, shrink, Filters(grp=grp, min_plays=min_plays))


def ranked(players: DataFrame) -> DataFrame:
    """Listed players with their rank and the number of players in their group, and both in words."""
    rows = with_rank(players, ["grp"], board_order(), "rank", "total")
    return rows.withColumn("rank_text", text.rank_text(F.col("rank"), F.col("total"), F.col("grp")))


def player_card(rows: DataFrame, shrink: DataFrame, player: int, min_plays: int = MIN_PLAYS) -> DataFrame:
    """One player's rating over all rated plays, whatever their number, with the rank among the group's listed players.

    The rank counts the players ahead, so nothing is sorted. A player who is not listed has no rank.

    Stages its steps when called."""
    card = staged(rate_players(rated(rows).where(F.col("id") == player), shrink, 1), "card")
    mine = card.select(F.struct("grp", "rating", "id", "n")).scalar()
    group = listed(rows, shrink, min_plays).withColumn("_me", mine).where(F.col("grp") == F.col("_me.grp"))
    ahead = (F.col("rating") > F.col("_me.rating")) | (
        (F.col("rating") == F.col("_me.rating")) & (F.col("id") < F.col("_me.id")))
    place = group.agg(F.struct(F.count_if(ahead).alias("ahead"), F.count("*").alias("total"))).scalar()
    card = card.withColumn("_place", place)
    return card.withColumns({
        "rank": F.when(F.col("n") >= min_plays, F.col("_place.ahead") + 1), "total": F.col("_place.total"),
    }).drop("_place")


def top_per_group(players: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` of every group; Spark keeps ``n`` rows per group and task before the shuffle."""
    window = Window.partitionBy("grp").orderBy(*board_order())
    return players.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= n)


def player_plays(rows: DataFrame, player: int) -> DataFrame:
    """One player's rated plays, best first."""
    return rated(rows).where(F.col("id") == player).orderBy(*best_first())


def search(players: DataFrame, query: str, limit: int = 8) -> DataFrame:
    """Names that match what was typed: start of the name, then start of a word, then anywhere; board order inside."""
    q = text.folded_query(query)
    name = text.folded(F.col("name"))
    close = F.replace(name, F.lit(" "), F.lit(""))
    score = (
        F.when(name.startswith(q), 0)
        .when(F.exists(F.split(name, " "), lambda w: w.startswith(q)), 1)
        .when(name.contains(q) | close.contains(q.replace(" ", "")), 2)
    )
    found = players.withColumn("score", score).where(F.col("score").isNotNull() & F.lit(bool(q)))
    return found.orderBy("score", *board_order()).limit(limit)


def filter_options(rows: DataFrame) -> DataFrame:
    """The coverage types, routes and teams a filter can take, one row each."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).alias("value")) for d in ("cov", "route", "team")])
    return rated(rows).select(F.inline(pairs)).distinct()


def play_neighbours(plays: DataFrame) -> DataFrame:
    """Every play with the play before and after it in its game."""
    return with_neighbours(plays.select(*PLAY).distinct(), ["game_id"], "play_id")


def highlight_picks(rows: DataFrame, n: int = 8, min_plays: int = MIN_PLAYS, air: int = HIGHLIGHT_AIR) -> DataFrame:
    """The reel: at most one play per listed defender, the best two of every group first, then the best of the rest.

    A candidate is a rated play in the primary role with enough air time that ended nearer to the ball than expected.
    One aggregate counts a player's rated plays and keeps the best candidate; only those single rows are ordered.

    Stages its steps when called."""
    candidate = (F.col("role") == "primary") & (F.col("air") >= air) & (F.col("dact") < F.col("dexp"))
    order = F.when(candidate, F.struct(F.col("zc"), -F.col("game"), -F.col("play")))
    play = F.struct("game", "play", "name", "pos", "grp", "team", "zc", "yards", "dexp", "dact")
    best = rated(rows).groupBy("id").agg(F.count("*").alias("n"), F.max_by(play, order).alias("p"))
    best = staged(best.where((F.col("n") >= min_plays) & F.col("p").isNotNull()).select("id", "p.*"), "best-plays")
    first = Window.partitionBy("grp").orderBy(*best_first())
    floor = best.withColumn("_rn", F.row_number().over(first)).where("_rn <= 2").drop("_rn")
    floor = lookup(floor, "floor-plays")
    rest = best.join(floor.select("id"), "id", "left_anti").orderBy(*best_first()).limit(n)
    both = floor.withColumn("_floor", F.lit(1)).unionByName(rest.withColumn("_floor", F.lit(0)))
    picks = both.orderBy(F.desc("_floor"), *best_first()).limit(n)
    return picks.drop("_floor", "grp").orderBy(*best_first())
