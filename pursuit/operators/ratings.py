"""Situation centering, shrinkage, player and team ratings, and split-half reliability."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pursuit.operators.playtable import rated
from pursuit.schema import CENTERING, MIN_PLAYS, RULES, TEAM_PLAYS
from pursuit.staging import lookup, staged

BETWEEN_FLOOR = 1e-6


def _means(sums: DataFrame, cells: list[str], tag: str) -> tuple[DataFrame, DataFrame]:
    """Sum and count per cell, and per cell and fold."""
    def fold_up(keys, name):
        return sums.groupBy(*keys).agg(F.sum("s").alias(f"_{name}s{tag}"), F.sum("n").alias(f"_{name}n{tag}"))

    return fold_up(cells, "t"), fold_up([*cells, "fold"], "f")


def _other_folds_mean(tag: str):
    """The cell's mean over the other folds; over all folds when no other has rated rows; 0 when none has."""
    ts, tn = F.col(f"_ts{tag}"), F.col(f"_tn{tag}")
    fs, fn = F.coalesce(f"_fs{tag}", F.lit(0.0)), F.coalesce(f"_fn{tag}", F.lit(0))
    mean = F.when(tn > fn, F.try_divide(ts - fs, tn - fn)).otherwise(F.try_divide(ts, tn))
    return F.coalesce(mean, F.lit(0.0))


def cell_columns(passes=CENTERING) -> list[str]:
    return list(dict.fromkeys(c for cells in passes for c in cells))


def with_shift(table: DataFrame, sums: DataFrame, passes=CENTERING) -> DataFrame:
    """Adds ``_shift``, what centering takes off a row's value. ``sums`` are the staged sums ``s`` and counts ``n`` of the
    rated rows per combination of all cell columns and fold; the passes run on those few rows alone. A null cell shifts
    nothing."""
    columns, shift = cell_columns(passes), F.lit(0.0)
    for i, cells in enumerate(passes):
        by_cell, by_fold = (lookup(m, "means") for m in _means(sums, cells, str(i)))
        table = table.join(by_cell, cells, "left").join(by_fold, [*cells, "fold"], "left")
        shift = shift + _other_folds_mean(str(i))
        if i + 1 < len(passes):
            moved = sums.join(by_cell, cells, "left").join(by_fold, [*cells, "fold"], "left")
            moved = moved.withColumn("s", F.col("s") - F.col("n") * _other_folds_mean(str(i)))
            sums = staged(moved.select(*columns, "fold", "s", "n"), "cells")
    extra = [f"_{k}{i}" for i in range(len(passes)) for k in ("ts", "tn", "fs", "fn")]
    return table.withColumn("_shift", shift).drop(*extra)


def center(table: DataFrame, passes=CENTERING, value: str = "z") -> DataFrame:
    """Adds zc: ``value`` minus its cell's mean over the rated rows of the other folds, pass after pass.

    Every pass needs only sums per cell, and subtracting a cell mean changes those sums by count x mean. So the table is
    scanned once, into sums per combination of all cell columns and fold; the table then meets the staged cell means.
    Excluded rows are centered but never summed. A null cell stays as it is.

    Stages its steps when called."""
    sums = staged(
        rated(table).groupBy(*cell_columns(passes), "fold").agg(F.sum(value).alias("s"), F.count("*").alias("n")), "cells")
    return with_shift(table, sums, passes).withColumn("zc", F.col(value) - F.col("_shift")).drop("_shift")


def shrinkage(table: DataFrame) -> DataFrame:
    """Per position group: variance of zc over all rated rows (within), variance of the player means beyond what
    within explains (between), and k = within / between. A lookup: it has one row per group.

    One pass: rows combine into count, mean and squared deviations per player, players into groups.

    Stages its steps when called."""
    return group_shrinkage(rated(table).groupBy("grp", "nfl_id").agg(
        F.count("zc").alias("n"), F.avg("zc").alias("mean"), F.var_pop("zc").alias("v")))


def group_shrinkage(per_player: DataFrame) -> DataFrame:
    """``shrinkage`` from counts ``n``, means and population variances ``v`` of every player."""
    n, mean = F.col("n"), F.col("mean")
    listed = F.when(n >= MIN_PLAYS, mean)
    per_group = per_player.groupBy("grp").agg(
        F.sum("n").alias("rows"), F.sum(n * mean).alias("total"), F.sum(n * F.col("v") + n * mean * mean).alias("squares"),
        F.count(listed).alias("players"), F.var_samp(listed).alias("spread"),
        F.avg(F.when(n >= MIN_PLAYS, n)).alias("plays"),
    )
    within = F.coalesce(
        F.try_divide(F.col("squares") - F.col("total") * F.col("total") / F.col("rows"), F.col("rows") - 1), F.lit(0.0))
    groups = per_group.withColumn("within", F.greatest(within, F.lit(0.0)))
    between = F.when(F.col("players") >= 2, F.col("spread") - F.col("within") / F.col("plays")).otherwise(0.0)
    groups = groups.withColumn("between", F.greatest(between, F.lit(BETWEEN_FLOOR)))
    return lookup(
        groups.select("grp", "within", "between", (F.col("within") / F.col("between")).alias("k")), "shrinkage")


def tier(rating="rating", se="se"):
    return (
        F.when(F.col(rating) > 2 * F.col(se), "above").when(F.col(rating) < -2 * F.col(se), "below")
        .otherwise("average")
    )


def team_lists(entries: str = "_by_team"):
    """Teams with enough plays, most plays first, then by name: from collected (plays, team) pairs."""
    kept = F.array_sort(F.filter(entries, lambda e: e["n"] >= TEAM_PLAYS), lambda a, b: (
        F.when(a["n"] != b["n"], F.when(a["n"] > b["n"], -1).otherwise(1))
        .when(a["team"] < b["team"], -1).when(a["team"] > b["team"], 1).otherwise(0)
    ))
    return F.transform(kept, lambda e: e["team"]), F.transform(kept, lambda e: e["n"])


def player_means(rows: DataFrame, player="nfl_id", order=("game_id", "play_id"), complete=None) -> DataFrame:
    """Counts, means, last name, position and group, and the teams of every player.

    Rows combine per player and team first, then per player, so the team list comes from the same pass and one
    player's rows are never gathered: a player's list has at most one entry per team."""
    complete = F.col("result") == "C" if complete is None else complete
    per_team = rows.groupBy(player, "team").agg(
        F.count("*").alias("n"), F.sum("zc").alias("zc"), F.count("zc").alias("zcs"),
        F.sum("yards").alias("yards"), F.count("yards").alias("yds"),
        F.sum(complete.cast("long")).alias("done"), F.count(complete).alias("known"),
        F.sum("epa").alias("epa"), F.count("epa").alias("epas"),
        F.max_by(F.struct("name", "pos", "grp"), F.struct(*order)).alias("who"),
        F.max(F.struct(*order)).alias("at"),
        F.max(F.struct(F.col(order[0]), F.col("zc"), -F.col(order[1]))).alias("latest"),
    )
    return means_of_teams(per_team, player)


def means_of_teams(per_team: DataFrame, player: str = "nfl_id") -> DataFrame:
    """``player_means`` from the sums of every player on every team."""
    totals = [F.sum(c).alias(c) for c in ("n", "zc", "zcs", "yards", "yds", "done", "known", "epa", "epas")]
    p = per_team.groupBy(player).agg(
        *totals, F.max_by("who", "at").alias("who"), F.max_by("team", "latest").alias("latest_team"),
        F.collect_list(F.when(F.col("team").isNotNull(), F.struct("n", "team"))).alias("_by_team"),
    )
    names, counts = team_lists()
    return p.select(
        player, "n", "who.name", "who.pos", "who.grp", F.try_divide("zc", "zcs").alias("mean"),
        F.try_divide("yards", "yds").alias("yards"), F.try_divide("done", "known").alias("comp"),
        F.try_divide("epa", "epas").alias("epa"), names.alias("teams"), counts.alias("team_n"), "latest_team",
    )


def shrunk(p: DataFrame, shrink: DataFrame, strict: bool) -> DataFrame:
    """Rating, standard error and tier from the group's within and k.

    A group without shrinkage is an error when ``strict`` and drops out otherwise."""
    p = p.join(shrink.select("grp", "within", "k"), "grp", "left" if strict else "inner")
    if strict:
        message = F.concat(F.lit("no shrinkage for group "), F.coalesce("grp", F.lit("null")))
        p = p.withColumn("k", F.coalesce(F.col("k"), F.raise_error(message).cast("double")))
    n = F.col("n")
    p = p.withColumns({
        "rating": F.col("mean") * n / (n + F.col("k")), "se": F.sqrt(F.col("within") / (n + F.col("k"))),
    })
    return p.withColumn("tier", tier()).drop("within", "k")


def players(table: DataFrame, shrink: DataFrame) -> DataFrame:
    """One row per defender with the shrunk rating; a group without shrinkage is an error. Order it at the sink."""
    return rated_players(player_means(rated(table)), shrink)


def rated_players(means: DataFrame, shrink: DataFrame) -> DataFrame:
    """``players`` from the rows of ``player_means``."""
    p = means.drop("latest_team")
    # a player without any team of ten plays has no list
    p = p.withColumns({c: F.when(F.size("teams") > 0, F.col(c)) for c in ("team_n", "teams")})
    p = shrunk(p, shrink, strict=True).withColumn("listed", F.col("n") >= MIN_PLAYS)
    return p.select(
        "nfl_id", "n", "name", "pos", "grp", "mean", "yards", "comp", "epa", "teams", "team_n", "rating", "se", "tier",
        "listed",
    )


def teams(table: DataFrame, min_plays: int = 1) -> DataFrame:
    """One row per defensive team: plays, mean, and the standard error from the variance over all rated rows."""
    rows = rated(table)
    within = rows.select(F.coalesce(F.var_samp("zc"), F.lit(0.0))).scalar()
    t = rows.groupBy("team").agg(F.count("*").alias("n"), F.avg("zc").alias("mean")).where(F.col("n") >= min_plays)
    return t.withColumn("se", F.sqrt(within / F.col("n")))


def half_means(table: DataFrame) -> DataFrame:
    """Every player's mean over even and over odd games, for players with enough plays in both."""
    half = F.pmod("game_id", F.lit(2))
    halves = rated(table).groupBy("nfl_id").agg(
        F.avg(F.when(half == 0, F.col("zc"))).alias("even"), F.count_if(half == 0).alias("n_even"),
        F.avg(F.when(half == 1, F.col("zc"))).alias("odd"), F.count_if(half == 1).alias("n_odd"),
    )
    return long_halves(halves)


def long_halves(halves: DataFrame) -> DataFrame:
    need = int(RULES["half_plays"])
    return halves.where((F.col("n_even") >= need) & (F.col("n_odd") >= need))


def split_half(table: DataFrame) -> DataFrame:
    """Correlation of the two halves and the players behind it, as one row; null when it is not defined."""
    return correlated(half_means(table))


def correlated(halves: DataFrame) -> DataFrame:
    """``split_half`` from the players' means over both halves."""
    sums = halves.agg(
        F.covar_pop("even", "odd").alias("c"), F.stddev_pop("even").alias("se"), F.stddev_pop("odd").alias("so"),
        F.count("*").alias("players"),
    )
    r = F.when(F.col("players") >= 2, F.try_divide("c", F.col("se") * F.col("so")))
    return sums.select(F.when(~F.isnan(r), r).alias("r"), "players")
