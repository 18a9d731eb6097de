"""Mixing sources to target weights.

Each document gets a hash-random key. Keys are cut into ranges of equal width, so a range holds about the same number of
documents of a source however large the source is; rows are sorted inside (source, range), and the words before a range
come from a tree of partial sums. A document is taken while its source's budget lasts, the last one in part; a budget
over the source's size repeats whole epochs first.
"""

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pursuit.llm.names import unused
from pursuit.llm.registry import query, table
from pursuit.operators.ordering import with_rank
from pursuit.staging import staged

WORD = r"[^\x20\x09-\x0D]+"
KEY_BITS = 52
WIDTH_BITS = 10


def words(text: str = "text"):
    """The number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_key(seed: str = "mix"):
    """52 hash-random bits of the document; documents without an id are told apart by their text."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce("text", F.lit("")))))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name)), 1, 13), 16, 10).cast("long")


def _before(totals: DataFrame, bits: int) -> DataFrame:
    """Words of a source in the ranges before each range. ``totals``: src, range, words. Beyond 2**WIDTH_BITS ranges
    the sums of blocks of ranges come first, so no window holds more than 2**WIDTH_BITS rows."""
    along = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    if bits <= WIDTH_BITS:
        along = Window.partitionBy("src").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        return totals.select("src", "range", F.coalesce(F.sum("words").over(along), F.lit(0)).alias("before"))
    inner = totals.withColumn("block", F.shiftright("range", WIDTH_BITS))
    blocks = inner.groupBy("src", F.col("block").alias("range")).agg(F.sum("words").alias("words"))
    blocks = _before(blocks, bits - WIDTH_BITS).withColumnsRenamed({"range": "block", "before": "block_before"})
    along = Window.partitionBy("src", "block").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    inner = inner.withColumn("inner", F.coalesce(F.sum("words").over(along), F.lit(0)))
    return inner.join(blocks, ["src", "block"]).select(
        "src", "range", (F.col("inner") + F.col("block_before")).alias("before"))


def targets(sources: DataFrame, weights=(3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Adds ``target`` to ``src, source_size``: ``share`` of all words by weight, no source above ``most`` times its
    size, the excess reshared by weight until none is above. Weights repeat along the order of ``src``."""
    ranked = with_rank(sources.withColumn("_all", F.lit(1)), ["_all"], [F.col("src")], "place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("place") - 1, len(weights)).cast("int") + 1)
    shares = staged(ranked.select("src", "source_size", weight.alias("w"), F.lit(False).alias("full")), "shares")
    total = shares.agg(F.sum("source_size")).first()[0] or 0
    while True:
        open_w, held, full = shares.agg(
            F.sum(F.when(~F.col("full"), F.col("w"))), F.sum(F.when(F.col("full"), F.col("source_size"))),
            F.count(F.when(F.col("full"), 1))).first()
        level = F.lit((share * total - most * (held or 0)) / open_w if open_w else 0.0)
        shares = shares.withColumn("full", F.col("full") | (F.col("w") * level > most * F.col("source_size")))
        shares = staged(shares, "shares")
        if shares.where("full").count() == full:
            break
    return shares.select("src", "source_size", F.when(
        F.col("full"), most * F.col("source_size")).otherwise(F.col("w") * level).alias("target"))


def mix(docs: DataFrame, weights=(3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, seed: str = "mix",
        range_rows: int = 256) -> DataFrame:
    """How much of every document the mix takes: ``doc_id, source, fa, size, source_size, target, taken``,
    ``fa`` being a hash of the text.

    ``taken`` counts words, repeats included: whole epochs of the source, then its documents in the order of their
    keys up to the budget, which is ``target`` rounded; the document at the cut gives its first words. A null text has
    size 0, a null source is a source of its own, repeated rows are documents of their own, an empty table gives an
    empty mix. Sizes are staged and targets computed when called."""
    sized = staged(docs.select(
        "doc_id", "source", F.coalesce(F.concat(F.lit("a"), F.col("source")), F.lit("b")).alias("src"),
        words().alias("size"), hash_key(seed).alias("key"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("fa")), "sized")
    bits = min(40, max(0, math.ceil(math.log2(max(1, sized.count()) / range_rows))))
    sized = sized.withColumn("range", F.shiftright("key", KEY_BITS - bits))
    totals = staged(sized.groupBy("src", "range").agg(F.sum("size").alias("words")), "ranges")
    budgets = targets(totals.groupBy("src").agg(F.sum("words").alias("source_size")), weights, share, most)
    before = _before(totals, bits).join(budgets, "src")
    inside = Window.partitionBy("src", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = sized.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(before, ["src", "range"])
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(F.lit(0))
    left = F.col("budget") - F.col("epochs") * F.col("source_size") - F.col("before") - F.col("inner")
    return rows.withColumn("budget", budget).withColumn("epochs", epochs).select(
        "doc_id", "source", "fa", "size", "source_size", "target",
        (F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left))).cast("long").alias("taken"))


SQL = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, source, CASE WHEN source IS NULL THEN 'b' ELSE 'a' || source END AS src,
           coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
           substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'text ' || md5(coalesce(text, '')))), 1, 13) AS key
    FROM documents
), s AS (
    SELECT src, sum(size)::BIGINT AS source_size,
           [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY src) - 1) % 3 + 1)::INT] AS w
    FROM d GROUP BY src
), r AS (
    SELECT 0 AS i, src, source_size, w, false AS closed, 0::DOUBLE AS level FROM s
    UNION ALL
    SELECT i + 1, src, source_size, w, closed OR w * lv > 2.0 * source_size, lv
    FROM (SELECT *, coalesce((1.5 * sum(source_size) OVER () - 2.0 * coalesce(sum(CASE WHEN closed THEN source_size END) OVER (), 0))
                 / nullif(sum(CASE WHEN NOT closed THEN w END) OVER (), 0), 0) AS lv FROM r)
    WHERE i < (SELECT count(*) + 1 FROM s)
), t AS (
    SELECT src, source_size, CASE WHEN closed THEN 2.0 * source_size ELSE w * level END::DOUBLE AS target
    FROM r WHERE i = (SELECT max(i) FROM r)
), p AS (
    SELECT d.*, t.source_size, t.target, round(t.target)::BIGINT AS budget,
           coalesce(sum(size) OVER (PARTITION BY src ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
    FROM d JOIN t USING (src)
), e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM p)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, budget - epochs * source_size - before)))::BIGINT AS taken
FROM e
"""


@query(SQL)
def op2_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def mixed(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the mix itself. One row for each epoch in which a document is taken: its columns, ``epoch`` from 0
    and ``taken``, the words of that row. The text of a document at the cut ends after its last taken word. Rows that
    repeat a document wholly all get the largest amount any of them got."""
    ident, origin, fa, size, most, key, epoch, now = unused(docs, "_id", "_source", "_fa", "_size", "_taken", "_key", "_epoch", "_now")
    amounts = mix(docs).where("taken > 0").groupBy(
        F.col("doc_id").alias(ident), F.col("source").alias(origin), F.col("fa").alias(fa), F.col("size").alias(size)) \
        .agg(F.max("taken").alias(most))
    rows = docs.withColumn(key, F.xxhash64(F.coalesce("text", F.lit("")))).join(
        amounts, F.col("doc_id").eqNullSafe(F.col(ident)) & F.col("source").eqNullSafe(F.col(origin)) & (F.col(key) == F.col(fa)))
    epochs = F.sequence(F.lit(0), F.ceil(F.col(most) / F.col(size)).cast("int") - 1)
    rows = rows.withColumn(epoch, F.explode(epochs)).withColumn(
        now, F.least(F.col(size), F.col(most) - F.col(epoch) * F.col(size)))
    begun = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)), 1, F.col(now).cast("int")), "")
    text = F.when(F.col(now) == F.col(size), F.col("text")).otherwise(begun)
    rows = rows.withColumn("text", text)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    own = [F.col(f"`{c}`") for c in docs.columns if c not in ("epoch", "taken")]
    return rows.select(*own, F.col(epoch).alias("epoch"), F.col(now).alias("taken"))
