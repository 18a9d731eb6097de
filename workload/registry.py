"""The registered queries: a Spark callable and, where SQL can say it, the same result in SQL."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUERIES: dict[str, object] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(fn):
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn
    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Every double column rounded, so that engines may differ in the last bits."""
    doubles = {f.name for f in df.schema.fields if f.dataType.typeName() == "double"}
    return df.select(*[F.round(c, digits).alias(c) if c in doubles else F.col(c) for c in df.columns])


# A number goes into a row's hash in steps of about a thousandth; the odd step keeps decimals off the edges of a step, where
# the last bits in which engines differ would matter.
STEP, SHIFT = 997.0631, 0.5123
AT = ["play_id", "nfl_id", "frame_id"]


def row_hash(texts, numbers=()):
    """Forty bits from all the given columns of a row, so that a swapped or changed value shows in a sum of them."""
    def column(c):
        return c if isinstance(c, Column) else F.col(c)

    def code(c):
        return F.floor(column(c).cast("double") * F.lit(STEP) + F.lit(SHIFT)).cast("string")

    parts = [F.coalesce(column(c).cast("string"), F.lit("~")) for c in texts]
    parts += [F.coalesce(code(c), F.lit("~")) for c in numbers]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 10), 16, 10).cast("long")


# Halves of a hash, summed apart: a sum of whole hashes leaves the range of a long at some 17 million rows.
HALF = 20


def hash_sum(hashes):
    """The sum of ``row_hash`` values as a long, null without rows. A sum that no long can hold goes on around the range of one
    (modulo 2^64), so it is the sum that SQL gives wherever SQL has one, and every row takes part at any size."""
    whole, half = (F.lit(str(n)).cast("decimal(20,0)") for n in (2 ** 64, 2 ** (64 - 1)))
    high, low = F.sum(F.shiftright(hashes, HALF)), F.sum(hashes.bitwiseAND(F.lit(2 ** HALF - 1)))
    total = (high.cast("decimal(20,0)") * F.lit(str(2 ** HALF)).cast("decimal(7,0)") + low.cast("decimal(20,0)")) % whole
    return F.when(total >= half, total - whole).otherwise(total).cast("long")


def row_hash_sql(texts, numbers=()) -> str:
    """``row_hash`` in SQL. Texts must be texts, whole numbers or truth values."""
    parts = [f"""coalesce("{c}"::VARCHAR, '~')""" for c in texts]
    parts += [f"""coalesce(floor("{c}"::DOUBLE * {STEP}::DOUBLE + {SHIFT}::DOUBLE)::BIGINT::VARCHAR, '~')""" for c in numbers]
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 10))::BIGINT"


def per_game(df: DataFrame, *columns, at=AT, by="game_id", texts=()) -> DataFrame:
    """Row count and the sum of the hashes of whole rows, places included, per game: every value of a large result counts."""
    return df.groupBy(by).agg(F.count("*").alias("n"), hash_sum(row_hash([*at, *texts], columns)).alias("rows"))


def game_rows(source: str, *columns, at=AT, by="game_id", texts=()) -> str:
    """``per_game`` in SQL."""
    return f"SELECT {by}, count(*) AS n, sum({row_hash_sql([*at, *texts], columns)})::BIGINT AS rows FROM {source} GROUP BY 1"


def r(expr: str, digits: int = 6) -> str:
    """SQL rounding without a negative zero."""
    return f"round({expr}, {digits}) + 0.0"


def game_sums(source: str, *columns, game="game_id", digits: int = 3) -> str:
    total = 'sum("{}")'
    sums = "".join(f", {r(total.format(c), digits)} AS sum_{c}" for c in columns)
    return f"SELECT {game} AS game_id, count(*) AS n{sums} FROM {source} GROUP BY 1"


def rd(column: str, digits: int = 2) -> str:
    """SQL rounding of the number as it is written, half away from zero, which is what Spark's ``round`` does."""
    return f"(round({column}::VARCHAR::DECIMAL(32, 20), {digits})::DOUBLE)"
