"""Chat formatting by linking quotations.

Quoted passages of a message are hashed in a normal form and joined to the messages that first said them. A message
answers the one its outermost quotation comes from, or else the one before it. The conversation is then put in reply
order, every answer after what it answers, with the quotations taken out.
"""

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pursuit.llm.registry import query, table
from pursuit.operators.ordering import with_neighbours, with_rank
from pursuit.staging import lookup, staged

MARK = re.compile(r"^\s{0,3}((?:>[ \t]?)+)(.*)$", re.S)
FIRST = -2 ** 62        # sorts a run's own messages before the runs that hang on them
ATTRIBUTION = re.compile(r"(?:wrote|writes|schrieb|a écrit|escribió)\s?:\s*$", re.I)


def normal(passage: str) -> str:
    return " ".join(passage.lower().split())


def digest(passage: str) -> int:
    return int.from_bytes(hashlib.blake2b(normal(passage).encode(), digest_size=8).digest(), "big", signed=True)


def parse(text: str) -> tuple[str, list[tuple[int, str]]]:
    """The text without quotations, and the quoted passages with their nesting level.

    A passage is a run of lines of one level; a blank line ends it. The line that introduces a quotation ("… wrote:")
    goes with it."""
    own, quotes, run, level = [], [], [], 0

    def close():
        if any(x.strip() for x in run):
            quotes.append((level, "\n".join(run)))
        run.clear()

    for line in text.split("\n"):
        m = MARK.match(line)
        at, rest = (m[1].count(">"), m[2]) if m else (0, line)
        if at != level or at and not rest.strip():
            close()
            if at and not level and own and ATTRIBUTION.search(own[-1]):
                own.pop()
            level = at
        if at and rest.strip():
            run.append(rest)
        elif not at:
            own.append(line)
    close()
    return "\n".join(own).strip("\n") if quotes else text, quotes


def sentences(passage: str) -> list[str]:
    return re.split(r"(?<=[.!?;:])\s+", " ".join(passage.split()))


def said(own: str) -> set[int]:
    """Hashes of what a message says itself: its paragraphs, its lines and its sentences."""
    paragraphs = re.split(r"\n[ \t]*\n", own)
    parts = paragraphs + own.split("\n") + [s for p in paragraphs for s in sentences(p)]
    return {digest(p) for p in parts if p.strip()}


def asked(passage: str) -> list[tuple[int, int]]:
    """``(hash, unit)`` by which a quoted passage is looked up: the whole passage and its lines (unit 0), and its sentences
    (unit 1), for a quotation of a part of a line."""
    found = {digest(p): 0 for p in [passage, *passage.split("\n")] if p.strip()}
    for s in sentences(passage):
        if s.strip():
            found.setdefault(digest(s), 1)
    return list(found.items())


PARSED = "conv_id long, turn long, role string, text string, said array<long>, quotes array<struct<level:int,unit:int,hash:long>>, n_quotes int"


def _parse_rows(batches):
    for batch in batches:
        rows = []
        for conv, turn, role, text in zip(batch["conv_id"], batch["turn"], batch["role"], batch["text"]):
            own, quotes = parse(text or "")
            rows.append((conv, turn, role, own, sorted(said(own)),
                         [{"level": level, "unit": unit, "hash": h} for level, p in quotes for h, unit in asked(p)], len(quotes)))
        yield pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text", "said", "quotes", "n_quotes"]).astype(
            {"conv_id": "Int64", "turn": "Int64"})


def last_start(nodes: DataFrame) -> DataFrame:
    """Adds ``start``: the latest turn at or before this one in the conversation where ``starts`` is true. Conversations
    of any size are cut into ranges; only one row a range goes over the seams."""
    rows = staged(nodes.repartitionByRange("conv_id", "turn").withColumn("_chunk", F.spark_partition_id()), "chunks")
    mark = F.when(F.col("starts"), F.col("turn"))
    seams = rows.groupBy("conv_id", "_chunk").agg(F.max(mark).alias("_last"))
    before = Window.partitionBy("conv_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    seams = lookup(seams.select("conv_id", "_chunk", F.max("_last").over(before).alias("_before")), "seams")
    inside = Window.partitionBy("conv_id", "_chunk").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_in", F.max(mark).over(inside)).join(seams, ["conv_id", "_chunk"]).withColumn(
        "start", F.coalesce("_in", "_before")).drop("_in", "_before", "_chunk")


def paths(nodes: DataFrame) -> DataFrame:
    """Adds ``path``, which sorts a conversation in reply order. ``nodes``: conv_id, turn, prev_turn, parent.

    Messages that answer the one right before them form runs; only runs are linked. A run comes whole, then the runs that
    hang on its messages, those on later messages first. Its path is minus the turn it hangs on and its own first turn,
    after the path of the run it hangs on; pointer doubling finds it in as many rounds as the logarithm of the nesting."""
    nodes = staged(last_start(nodes.withColumn("starts", F.col("parent").isNull() | (F.col("parent") != F.col("prev_turn")))), "runs")
    of = nodes.select("conv_id", F.col("turn").alias("hang"), F.col("start").alias("up"))
    runs = nodes.where("starts").select("conv_id", "start", F.col("parent").alias("hang")).join(of, ["conv_id", "hang"], "left")
    path = F.when(F.col("hang").isNotNull(), F.array(-F.col("hang"), "start")).otherwise(F.array().cast("array<bigint>"))
    runs = staged(runs.select("conv_id", "start", "up", path.alias("path")), "paths")
    while not runs.where("up is not null").isEmpty():
        higher = runs.select("conv_id", F.col("start").alias("up"), F.col("up").alias("next"), F.col("path").alias("above"))
        runs = staged(runs.join(higher, ["conv_id", "up"], "left").select(
            "conv_id", "start", F.col("next").alias("up"),
            F.when(F.col("above").isNotNull(), F.concat("above", "path")).otherwise(F.col("path")).alias("path")), "paths")
    return nodes.join(runs.select("conv_id", "start", F.col("path").alias("above")), ["conv_id", "start"]).withColumn(
        "path", F.concat("above", F.array(F.lit(FIRST).cast("long"), "turn"))).drop("above", "start", "starts")


def link_conversations(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, reply_to, position, depth, n_quotes, n_linked`` for every message. A row without a
    conversation or a turn has no place: its ``reply_to``, ``position`` and ``depth`` are null and it links nothing.

    ``text`` has no quotations; ``reply_to`` is the turn answered, null for the first message; ``position`` counts from 1
    in reply order; ``depth`` counts the jumps back from the start. A passage is linked to the earliest message of the
    conversation that says it, if that is before the quoting one; of several the outermost level, then a whole passage or
    line before a sentence, and then the latest turn decides. Rows of one turn are put together in the order of their texts. Null texts count as empty. Runs its
    stages when called."""
    rows = messages.select(*[F.col(c).cast(t).alias(c) for c, t in (("conv_id", "long"), ("turn", "long"), ("role", "string"), ("text", "string"))])
    parsed = staged(rows.mapInPandas(_parse_rows, PARSED), "messages")
    rows = parsed.where("conv_id is not null and turn is not null")
    first = rows.select("conv_id", F.explode("said").alias("hash"), "turn").groupBy("conv_id", "hash").agg(F.min("turn").alias("origin"))
    quoted = rows.select("conv_id", "turn", F.explode("quotes").alias("q")).select(
        "conv_id", "turn", "q.level", "q.unit", "q.hash").groupBy("conv_id", "turn", "hash").agg(F.min(F.struct("level", "unit")).alias("at"))
    links = quoted.join(first, ["conv_id", "hash"]).where("origin < turn").groupBy("conv_id", "turn").agg(
        F.min(F.struct("at.level", "at.unit", (-F.col("origin")).alias("back"))).alias("best"), F.count_distinct("origin").alias("n_linked"))
    nodes = with_neighbours(rows.select("conv_id", "turn").distinct(), ["conv_id"], "turn").drop("next_turn")
    nodes = nodes.join(links, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "prev_turn", F.coalesce(-F.col("best.back"), "prev_turn").alias("parent"),
        F.coalesce("n_linked", F.lit(0)).alias("n_linked"))
    placed = rows.join(paths(nodes), ["conv_id", "turn"]).withColumn("_tie", F.xxhash64("role", "text"))
    unique = with_rank(placed.drop("said", "quotes", "prev_turn"), ["conv_id"], [F.col("path"), F.col("_tie"), F.col("text")], "position")
    linked = unique.select(
        "conv_id", "turn", "role", "text", F.col("parent").alias("reply_to"), F.col("position").cast("long").alias("position"),
        (F.size("path") / 2 - 1).cast("int").alias("depth"), "n_quotes", F.col("n_linked").cast("int").alias("n_linked"))
    loose = parsed.where("conv_id is null or turn is null").select(
        "conv_id", "turn", "role", "text", *[F.lit(None).cast(t).alias(c) for c, t in (("reply_to", "long"), ("position", "long"), ("depth", "int"))],
        "n_quotes", F.lit(0).alias("n_linked"))
    return linked.unionByName(loose)


@query()
def op10_chat_format(spark, sf_dir):
    return link_conversations(table(spark, sf_dir, "conversations"))
