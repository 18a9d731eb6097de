"""A stored index of names, so that a search reads the few folders its first letters name and not every name.

Every name is folded once, when the index is written. Each place of the folded name, and of the name without spaces, is an
entry under the two characters that follow it; the entry says whether the place starts the name or a word. A name's row
stands beside each of its entries, so a search needs nothing else."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pursuit.functions import text
from pursuit.operators.board import board_order

LETTERS = 2  # characters that name a folder


def _entries(players: DataFrame) -> DataFrame:
    name = F.col("_name")
    close = F.replace(name, F.lit(" "), F.lit(""))

    def places(of, closed):
        def entry(i):
            start = F.substring(of, (i + 1).cast("int"), F.length(of))
            word = F.lit(False) if closed else (i == 0) | (F.substring(of, i.cast("int"), F.lit(1)) == " ")
            return F.struct(start.alias("rest"), (F.lit(not closed) & (i == 0)).alias("first"), word.alias("word"), F.lit(closed).alias("closed"))

        return F.when(F.length(of) > 0, F.transform(F.sequence(F.lit(0), F.length(of) - 1), entry))

    rows = players.withColumn("_row", F.struct("*")).withColumn("_name", text.folded(F.col("name"))).where("_name <> ''")
    # a name without spaces has nothing to say beyond itself
    both = F.concat(places(name, False), F.when(close != name, places(close, True)).otherwise(F.array()))
    return rows.select("_row", F.explode(both).alias("e")).select(
        F.substring("e.rest", 1, LETTERS).alias("letters"), "e.*", F.col("_row").alias("row"))


def write_name_index(players: DataFrame, path: str) -> None:
    """Index the rows of a board or a list of players by ``name``, replacing what is under ``path``. The folders' names are
    hexadecimal, since a name may have a space there."""
    rows = _entries(players).withColumn("letters", F.concat(F.lit("x"), F.lower(F.hex("letters"))))
    # dealt by the entry, not by the letters, so that a common start is no single task
    placed = rows.repartitionByRange("letters", "rest").sortWithinPartitions("letters", "rest")
    placed.write.partitionBy("letters").mode("overwrite").parquet(path)


def search_names(spark: SparkSession, path: str, typed: str, limit: int = 8) -> DataFrame:
    """``board.search`` from the index: the start of the name, then the start of a word, then anywhere, with ``score``."""
    q = text.folded_query(typed)
    close = q.replace(" ", "")
    index = spark.read.parquet(path)
    schema = index.schema["row"].dataType
    folder = F.lit(False)
    for start in dict.fromkeys((q, close)):
        folder = folder | F.col("letters").startswith(f"x{start[:LETTERS].encode().hex()}")
    whole = ~F.col("closed") & F.col("rest").startswith(q)
    score = F.when(whole & F.col("first"), 0).when(whole & F.col("word") & F.lit(" " not in q), 1).otherwise(2)
    found = index.where(folder & F.lit(bool(q))).where(whole | F.col("rest").startswith(close)).select(
        F.col("row.id").alias("_id"), score.alias("score"), "row")
    best = found.groupBy("_id").agg(F.min("score").alias("score"), F.first("row").alias("row"))
    return best.select(*[F.col(f"row.`{c}`").alias(c) for c in schema.names], "score").orderBy("score", *board_order()).limit(limit)
