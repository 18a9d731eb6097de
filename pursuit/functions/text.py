"""Text columns: labels, ordinals, outcomes and name handling."""

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words for results and position groups.
OUTCOMES = {"C": "complete", "I": "incomplete"}
OTHER_OUTCOME = "intercepted"
GROUP_WORDS = {"CB": ("corner", "corners"), "S": ("safety", "safeties"), "LB": ("linebacker", "linebackers")}
# Name suffixes and surname particles.
SUFFIX = r"(?i)^(jr|sr|ii|iii|iv|v)\.?$"
PARTICLE = r"(?i)^(st\.?|van|vander|von|de|da|del|della|di|du|la|le)$"
# Team codes and full names.
TEAM_NAMES = {
    "ARI": "Arizona Cardinals", "ATL": "Atlanta Falcons", "BAL": "Baltimore Ravens", "BUF": "Buffalo Bills",
    "CAR": "Carolina Panthers", "CHI": "Chicago Bears", "CIN": "Cincinnati Bengals", "CLE": "Cleveland Browns",
    "DAL": "Dallas Cowboys", "DEN": "Denver Broncos", "DET": "Detroit Lions", "GB": "Green Bay Packers",
    "HOU": "Houston Texans", "IND": "Indianapolis Colts", "JAX": "Jacksonville Jaguars", "KC": "Kansas City Chiefs",
    "LA": "Los Angeles Rams", "LAC": "Los Angeles Chargers", "LV": "Las Vegas Raiders", "MIA": "Miami Dolphins",
    "MIN": "Minnesota Vikings", "NE": "New England Patriots", "NO": "New Orleans Saints", "NYG": "New York Giants",
    "NYJ": "New York Jets", "PHI": "Philadelphia Eagles", "PIT": "Pittsburgh Steelers", "SEA": "Seattle Seahawks",
    "SF": "San Francisco 49ers", "TB": "Tampa Bay Buccaneers", "TEN": "Tennessee Titans",
    "WAS": "Washington Commanders",
}
MINUS = "−"


def _lookup(values: dict, key: Column, default: Column) -> Column:
    pairs = F.create_map(*[F.lit(v) for pair in values.items() for v in pair])
    return F.coalesce(F.try_element_at(pairs, key), default)


def signed(value: Column, digits: int = 2) -> Column:
    """+0.42 or a real minus sign and the number."""
    sign = F.when(value < 0, MINUS).otherwise("+")
    return F.concat(sign, F.format_string(f"%.{digits}f", F.abs(value)))


def percent(value: Column) -> Column:
    return F.concat(F.floor(value * 100 + 0.5).cast("string"), F.lit("%"))


def label(code: Column) -> Column:
    """COVER_3_ZONE as cover 3 zone."""
    return F.lower(F.replace(code, F.lit("_"), F.lit(" ")))


def ordinal(n: Column) -> Column:
    teen = (n % 100).between(11, 13)
    last = n % 10
    ending = F.when(teen, "th").when(last == 1, "st").when(last == 2, "nd").when(last == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), ending)


def outcome(result: Column) -> Column:
    return _lookup(OUTCOMES, result, F.lit(OTHER_OUTCOME))


def group_name(grp: Column, many: bool = True) -> Column:
    return _lookup({k: v[1 if many else 0] for k, v in GROUP_WORDS.items()}, grp, grp)


def rank_text(rank: Column, total: Column, grp: Column) -> Column:
    return F.concat_ws(" ", ordinal(rank), F.lit("of"), total.cast("string"), group_name(grp))


def team_name(code: Column) -> Column:
    return _lookup(TEAM_NAMES, code, code)


def _plain(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if c.isascii() and (c.isalnum() or c == " "))


def folded_query(text: str) -> str:
    """What was typed, without case, accents and punctuation."""
    return _plain(text).lower().strip()


@cache
def _foldings() -> tuple[dict[str, str], dict[str, str]]:
    """Every character beyond ASCII whose decomposition has letters, digits or spaces: those that become one character,
    and ligatures, fractions and the like that become several."""
    singles, several = {}, {}
    for code in range(0x80, sys.maxunicode + 1):
        letter = chr(code)
        plain = _plain(letter)
        if plain:
            (singles if len(plain) == 1 else several)[letter] = plain
    return singles, several


def folded(name: Column) -> Column:
    """The name without case, accents and punctuation, as ``folded_query`` has it for typed text.

    Characters that become several are looked up one by one, and only in names that are not plain after the first step."""
    singles, several = _foldings()
    text = F.translate(name, "".join(singles), "".join(singles.values()))
    keys, values = list(several), list(several.values())
    table = F.map_from_arrays(F.split(F.lit("\t".join(keys)), "\t"), F.split(F.lit("\t".join(values)), "\t"))
    each = F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
    text = F.when(text.rlike(r"[^\x00-\x7F]"), each).otherwise(text)
    return F.lower(F.regexp_replace(text, "[^a-zA-Z0-9 ]", ""))


def name_words(name: Column) -> Column:
    return F.filter(F.split(F.replace(name, F.lit(","), F.lit(" ")), r"\s+"), lambda w: w != "")


def initials(name: Column) -> Column:
    """First letters of the first and the last name, suffixes left out; ? for no name."""
    words = F.filter(name_words(name), lambda w: ~w.rlike(SUFFIX))
    first = F.substring(F.get(words, F.lit(0)), 1, 1)
    last = F.substring(F.try_element_at(words, F.lit(-1)), 1, 1)
    text = F.when(F.size(words) > 1, F.concat(first, last)).otherwise(first)
    return F.coalesce(F.upper(text), F.lit("?"))


def surname(name: Column) -> Column:
    """The name to label a player with: suffixes dropped, particles kept, the first name never taken in."""
    words = name_words(name)
    # keep[i]: word i or a later one is not a suffix; the first word always stays
    indexed = F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    last = F.greatest(
        F.coalesce(F.array_max(F.transform(F.filter(indexed, lambda e: ~e["w"].rlike(SUFFIX)), lambda e: e["i"])), F.lit(0)),
        F.lit(0))
    # the surname starts after the last word that is no particle, and never at the first word while there is another
    before = F.filter(indexed, lambda e: (e["i"] < last) & ((~e["w"].rlike(PARTICLE)) | (e["i"] == 0)))
    start = F.when(last == 0, F.lit(0)).otherwise(F.array_max(F.transform(before, lambda e: e["i"])) + 1)
    return F.upper(F.array_join(F.slice(words, start + 1, last - start + 1), " "))
