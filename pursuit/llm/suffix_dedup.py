"""Removal of byte strings that repeat across documents, by sampled positions, runs and window hashes.

Prefix doubling over every byte would move every position once per round, many times the size of the texts. Positions are
thinned instead, without loss: of all strings of ``seed`` bytes inside a window of ``least`` bytes the one with the smallest
hash speaks for the window, and equal windows have the same one at the same place. Then

1. positions are ranked by their ``seed`` bytes, and those whose rank no other text has are dropped;
2. two rounds of (rank, next bytes) on each side, a few bytes further each, bound which windows can still repeat; they only
   narrow what the next step hashes;
3. the windows of ``least`` bytes that are left are grouped by their hashes, which decides, and the smallest document of each is taken.

Equal texts are one class with its smallest id before any of it. Ranks are 64-bit hashes; a run of windows is known by its
rank and a second hash. The first step moves packed arrays by hash range, one entry for each batch of texts and string;
later steps move the few positions left.
"""

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from pursuit.llm.names import unused
from pursuit.llm.registry import query, table
from pursuit.llm.words import BASE, mix, pieces, powers
from pursuit.staging import release, staged

LEAST = 50
SEED = 25
OFFSETS = (4, 8)
GRAM_PIECE = 1 << 19
BUCKET_BYTES = 16 << 20
SLICES = 4              # passes over the runs by their rank, so that the files of one pass are gone before the next
BYTE = np.random.default_rng(97).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_ranks(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit rank of the ``size`` bytes from every position, from ranks of doubled lengths."""
    now, length, out, done, bits = BYTE[data], 1, None, 0, size
    while True:
        if bits & 1:
            n = len(data) - done - length + 1
            out = now[:n] if out is None else out[:n] + powers(BASE, done + 1)[done] * now[done:done + n]
            done += length
        bits >>= 1
        if not bits:
            return mix(out)
        n = len(data) - 2 * length + 1
        now = now[:n] + powers(BASE, length + 1)[length] * now[length:length + n]
        length *= 2


def sampled(data: np.ndarray, offsets: np.ndarray, least: int = LEAST, seed: int = SEED):
    """Runs of windows that one position speaks for: ``(text, first window, last window, position, rank)``."""
    none = np.zeros(0, np.int64)
    if len(data) < least:
        return none, none, none, none, none.astype(np.uint64)
    rank = gram_ranks(data, seed)
    low, span, reach = (rank & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(rank), dtype=np.uint64), 1, least - seed + 1
    while 2 * span <= reach:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < reach:
        low = np.minimum(low[:len(low) - (reach - span)], low[reach - span:])
    place = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:len(place)]
    whole = np.arange(len(place)) + least <= offsets[text + 1]
    first, last = whole.copy(), whole.copy()
    new = place[1:] != place[:-1]
    first[1:] &= new | ~whole[:-1]
    last[:-1] &= new | ~whole[1:]
    first, last = np.flatnonzero(first), np.flatnonzero(last)
    return text[first], first, last, place[first], rank[place[first]]


def _spread(buckets: int, least: int, seed: int):
    """Per piece and hash range: ``heads`` (text fingerprint, entries) and ``ranks``, 5 bytes of each entry's rank."""
    def spread(batches):
        for rows, data, offsets in pieces(batches, limit=GRAM_PIECE):
            text, _, _, _, rank = sampled(data, offsets, least, seed)
            if not len(text):
                continue
            fa = rows.column("fa").to_numpy(zero_copy_only=False)
            bucket = bucket_of(rank, buckets)
            order = np.lexsort((text, bucket))
            text, rank, bucket = text[order], rank[order], bucket[order]
            packed = rank.view(np.uint8).reshape(-1, 8)[:, :5]
            out = []
            for b in np.unique(bucket):
                lo, hi = np.searchsorted(bucket, [b, b + 1])
                at = np.flatnonzero(np.diff(text[lo:hi], prepend=-1))
                heads = np.stack([fa[text[lo:hi][at]], np.diff(np.append(at, hi - lo))])
                out.append((int(b), heads[0].astype(np.int64).tobytes(), heads[1].astype(np.int32).tobytes(), packed[lo:hi].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))],
                names=["bucket", "heads", "counts", "ranks"])
    return spread


def bucket_of(rank: np.ndarray, buckets: int) -> np.ndarray:
    return ((rank >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)


def _shared(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Of one hash range, the ranks that several texts have, by text."""
    heads = np.concatenate([np.repeat(np.frombuffer(h, np.int64), np.frombuffer(c, np.int32)) for h, c in zip(rows["heads"], rows["counts"])])
    packed = np.concatenate([np.frombuffer(r, np.uint8) for r in rows["ranks"]]).reshape(-1, 5)
    rank = np.zeros((len(packed), 8), np.uint8)
    rank[:, :5] = packed
    rank = rank.view(np.uint64)[:, 0]
    order = np.lexsort((heads, rank))
    rank, heads = rank[order], heads[order]
    at = np.flatnonzero(np.diff(rank, prepend=rank[:1] + np.uint64(1)))
    several = np.repeat(heads[at] != heads[np.append(at[1:], len(rank)) - 1], np.diff(np.append(at, len(rank))))
    rank, heads = rank[several], heads[several]
    order = np.lexsort((rank, heads))
    rank, heads = rank[order], heads[order]
    once = np.ones(len(rank), bool)
    once[1:] = (rank[1:] != rank[:-1]) | (heads[1:] != heads[:-1])
    rank, heads = rank[once], heads[once]
    at = np.flatnonzero(np.diff(heads, prepend=heads[:1] + 1)) if len(heads) else np.zeros(0, int)
    ends = np.append(at[1:], len(heads)) if len(at) else at
    body = rank.view(np.uint8).reshape(-1, 8)[:, :5] if len(rank) else None
    return pd.DataFrame({"fa": heads[at], "bucket": np.full(len(at), key[0], np.int32),
                         "ranks": [body[a:b].tobytes() for a, b in zip(at, ends)]})


def _pack(batches):
    import zstandard

    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("fa"), pa.array([press.compress((t or "").encode()) for t in batch.column("text").to_pylist()], pa.binary())],
            names=["doc_id", "fa", "packed"])


def _unpacked(batches, limit: int = GRAM_PIECE):
    """``(rows, texts as bytes)`` in slices of about ``limit`` bytes."""
    import zstandard

    press = zstandard.ZstdDecompressor()
    for batch in batches:
        lo, held, size = 0, [], 0
        for i, packed in enumerate(batch.column("packed").to_pylist()):
            held.append(press.decompress(packed))
            size += len(held[-1])
            if size >= limit or i == batch.num_rows - 1:
                yield batch.slice(lo, i + 1 - lo), held
                lo, held, size = i + 1, [], 0


def _runs(buckets: int, least: int, seed: int):
    """Runs of windows whose rank another text has, with their bytes."""
    def runs(batches):
        for rows, texts in _unpacked(batches):
            data = np.frombuffer(b"".join(texts), np.uint8)
            offsets = np.append(0, np.cumsum([len(t) for t in texts]))
            text, first, last, place, rank = sampled(data, offsets, least, seed)
            groups = rows.column("shared")
            owner = np.repeat(np.arange(len(groups)), groups.value_lengths().to_numpy(zero_copy_only=False))
            inner = groups.flatten()
            packs = inner.field("ranks").to_pylist()
            places = (owner << 32) + inner.field("bucket").to_numpy(zero_copy_only=False)
            places = np.repeat(places, [len(x) // 5 for x in packs])
            theirs = np.zeros((len(places), 8), np.uint8)
            theirs[:, :5] = np.frombuffer(b"".join(packs), np.uint8).reshape(-1, 5)
            theirs = mix(theirs.view(np.uint64)[:, 0] ^ mix(places.astype(np.uint64)))
            bucket = bucket_of(rank, buckets)
            short = np.zeros((len(rank), 8), np.uint8)
            short[:, :5] = rank.view(np.uint8).reshape(-1, 8)[:, :5]
            mine = mix(short.view(np.uint64)[:, 0] ^ mix((text * np.int64(1 << 32) + bucket).astype(np.uint64)))
            keep = np.flatnonzero(np.isin(mine, theirs))
            raw = data.tobytes()
            ids, fas = rows.column("doc_id").to_numpy(), rows.column("fa").to_numpy()
            t, a, z, p = text[keep], first[keep], last[keep], place[keep]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[t], pa.int64()), pa.array(fas[t], pa.int64()), pa.array(a - offsets[t], pa.int64()),
                 pa.array(p - a, pa.int32()), pa.array(rank[keep].view(np.int64), pa.int64()),
                 pa.array([raw[x:y + least] for x, y in zip(a, z)], pa.binary())],
                names=["doc_id", "fa", "at", "lead", "rank", "run"])
    return runs


RUN = "doc_id long, fa long, at long, lead int, rank long, run binary"


def _side_ranks(right: bool, seed: int):
    """The ranks of a run's string with the bytes at growing offsets on one side, null where the run has none there."""
    rank, length, out = F.col("rank"), 0, []
    have = F.length("run") - F.col("lead") - seed if right else F.col("lead")
    for step in OFFSETS:
        length += step
        at = F.col("lead") + seed + 1 + length - step if right else F.col("lead") - length + 1
        rank = F.xxhash64(rank, F.substring("run", at, F.lit(step)))
        out.append(F.when(have >= length, rank))
    return out


def _reach(runs: DataFrame, side: str, beyond: int) -> DataFrame:
    """``rank, ra, <side>``: how many bytes beyond the ranked string can repeat on that side. Ranks pair with the bytes at
    growing offsets; a run leaves as soon as its rank is unique, or at its end."""
    alive, done, length = runs.select("rank", "ra", *[f"{side}{i}" for i in range(len(OFFSETS))]), None, 0
    for i, step in enumerate(OFFSETS):
        length += step
        rank = F.col(f"{side}{i}")
        going = alive.where(rank.isNotNull())
        several = going.groupBy(rank.alias("_rank")).agg(F.count("*").alias("k")).where("k > 1").select("_rank", "k")
        paired = staged(going.join(several, rank == F.col("_rank"), "left"), "paired")
        ended = alive.where(rank.isNull()).select("rank", "ra", F.lit(beyond).alias(side)).union(
            paired.where("k is null").select("rank", "ra", F.lit(length - 1).alias(side)))
        done = ended if done is None else done.union(ended)
        alive = paired.where("k is not null").drop("_rank", "k")
    return done.union(alive.select("rank", "ra", F.lit(beyond).alias(side)))


def _resolved(runs: DataFrame, least: int, seed: int) -> DataFrame:
    """``rank, ra, first, covered`` for every distinct run: the smallest document that has it whole, and the windows of
    it that a smaller document than that one has in another run."""
    kinds = staged(runs.groupBy("rank", "ra", "lead", "run").agg(F.min("doc_id").alias("first")), "kinds")
    many = kinds.groupBy("rank").agg(F.count("*").alias("k")).where("k > 1").select("rank")
    sides = [r.alias(f"{side}{i}") for side in ("right", "left") for i, r in enumerate(_side_ranks(side == "right", seed))]
    open_ = staged(kinds.select("rank", "ra", "lead", F.length("run").alias("n"), *sides).join(many, "rank", "left_semi"), "open")
    bounded = open_.select("rank", "ra", "lead", "n")
    for side in ("right", "left"):
        bounded = bounded.join(_reach(open_, side, least - seed), ["rank", "ra"])
    # window i of a run has lead - i bytes before the ranked string, and the rest of its bytes after it
    lo = F.greatest(F.lit(0), F.col("lead") - F.col("left"))
    hi = F.least(F.col("n") - least, F.col("lead") - (least - seed) + F.col("right"))
    bounded = bounded.select("rank", "ra", lo.alias("lo"), hi.alias("hi")).where("lo <= hi")
    windows = kinds.join(bounded, ["rank", "ra"]).withColumn("i", F.explode(F.sequence("lo", "hi")))
    cut = F.substring("run", F.col("i") + 1, F.lit(least))
    windows = staged(windows.select(F.xxhash64("rank", cut).alias("wa"), F.hash(cut).alias("wb"), "first", "rank", "ra", "i"), "windows")
    low = windows.groupBy("wa", "wb").agg(F.min("first").alias("low"), F.max("first").alias("high")).where("low < high")
    partial = windows.join(low, ["wa", "wb"]).where("low < first").groupBy("rank", "ra").agg(F.collect_set("i").alias("covered"))
    out = staged(kinds.select("rank", "ra", "first").join(partial, ["rank", "ra"], "left"), "resolved")
    release(kinds, open_, windows)
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, text, fa, fb``: the id as a long, the text without nulls and two 64-bit fingerprints of it."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"),
                       F.xxhash64(F.lit(1), text).alias("fa"), F.xxhash64(F.lit(2), text).alias("fb"))


def repeated_spans(docs: DataFrame, least: int = LEAST, seed: int = SEED) -> DataFrame:
    """``doc_id, fa, spans`` of the texts that repeat something: ``spans`` are byte ranges ``(a, z)``, in any order and
    overlapping, that together hold every byte of a string of ``least`` bytes which also starts in a document with a
    smaller id. ``fa`` tells texts of one id apart; rows repeated wholly have one row here. Rows without an id take no part. Runs its stages when called."""
    texts = fingerprints(docs)
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(16, -(-total // BUCKET_BYTES))
    known = texts.where("doc_id is not null").select("doc_id", "fa", "fb", F.octet_length("text").alias("n"))
    members = staged(known, "members")
    classes = staged(members.groupBy("fa", "fb", "n").agg(F.min("doc_id").alias("rep")), "classes")
    copies = members.where(F.col("n") >= least).join(classes, ["fa", "fb", "n"]).where("doc_id > rep").select(
        "doc_id", "fa", "n").dropDuplicates(["doc_id", "fa"]).select(
        "doc_id", "fa", F.array(F.struct(F.lit(0).cast("long").alias("a"), F.col("n").cast("long").alias("z"))).alias("spans"))

    entries = texts.where("doc_id is not null").select("fa", "text").mapInArrow(
        _spread(buckets, least, seed), "bucket int, heads binary, counts binary, ranks binary")
    shared = staged(entries.groupBy("bucket").applyInPandas(_shared, "fa long, bucket int, ranks binary"), "shared")
    wanted = shared.groupBy("fa").agg(F.collect_list(F.struct("bucket", "ranks")).alias("shared")).join(
        classes.select("fa", F.col("rep").alias("doc_id")), "fa")
    packed = texts.where("doc_id is not null").select("doc_id", "fa", "text").mapInArrow(_pack, "doc_id long, fa long, packed binary")
    runs = packed.join(wanted, ["doc_id", "fa"]).mapInArrow(_runs(buckets, least, seed), RUN)
    runs = staged(runs.withColumn("ra", F.xxhash64("run")), "runs")
    release(shared)

    resolved = None
    for part in range(SLICES):
        some = _resolved(runs.where(F.pmod("rank", F.lit(SLICES)) == part), least, seed)
        resolved = some if resolved is None else resolved.union(some)
    found = runs.select("doc_id", "fa", "at", F.length("run").alias("n"), "rank", "ra").join(resolved, ["rank", "ra"])
    # a range as one number while it travels: it begins at a 64-bit place less 16 bits and is shorter than 2**16
    span = lambda a, n: F.shiftleft(a.cast("long"), 16) + n
    spans = F.when(F.col("doc_id") > F.col("first"), F.array(span(F.col("at"), F.col("n")))).otherwise(
        F.transform("covered", lambda i: span(F.col("at") + i, F.lit(least))))
    found = found.select("doc_id", "fa", F.explode(spans).alias("span")).groupBy("doc_id", "fa").agg(F.collect_set("span").alias("spans"))
    whole = F.transform("spans", lambda s: F.struct(
        F.shiftright(s, 16).alias("a"), (F.shiftright(s, 16) + F.pmod(s, F.lit(1 << 16))).alias("z")))
    found = staged(found.select("doc_id", "fa", whole.alias("spans")), "found")
    release(runs, resolved)
    return found.unionByName(copies)


def merged(spans) -> list[tuple[int, int]]:
    """Byte ranges as maximal ranges in order; ranges that touch are one."""
    out: list[list[int]] = []
    for a, z in sorted((s["a"], s["z"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [(a, z) for a, z in out]


def cut_out(text: bytes, spans) -> bytes:
    kept, at = [], 0
    for a, z in spans:
        kept.append(text[at:a])
        at = z
    return b"".join(kept) + text[at:]


def merged_lists(spans):
    """``merged`` for an Arrow column of lists: ``(row, start, end)`` of all maximal ranges, by row and place."""
    row = np.repeat(np.arange(len(spans)), np.nan_to_num(spans.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))
    inner = spans.flatten()
    if not len(row):
        return (np.zeros(0, np.int64),) * 3
    shift = row << 40
    a, z = (inner.field(c).to_numpy(zero_copy_only=False) + shift for c in ("a", "z"))
    order = np.argsort(a, kind="stable")
    a, z, row = a[order], np.maximum.accumulate(z[order]), row[order]
    first = np.ones(len(a), bool)
    first[1:] = a[1:] > z[:-1]
    at = np.flatnonzero(first)
    shift = row[at] << 40
    return row[at], a[at] - shift, z[np.append(at[1:], len(a)) - 1] - shift


def _digest(batches):
    for rows, texts in _unpacked(batches):
        row, start, end = merged_lists(rows.column("spans"))
        begin = np.searchsorted(row, np.arange(len(texts) + 1)).tolist()
        start, end = start.tolist(), end.tolist()
        out = []
        for i, text in enumerate(texts):
            ranges = list(zip(start[begin[i]:begin[i + 1]], end[begin[i]:begin[i + 1]]))
            out.append((len(text), sum(z - a for a, z in ranges), len(ranges), hashlib.sha256(cut_out(text, ranges)).hexdigest()))
        columns = list(zip(*out)) or [()] * 4
        yield pa.RecordBatch.from_arrays(
            [rows.column("doc_id"), *[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.string())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def removal_report(docs: DataFrame, least: int = LEAST, seed: int = SEED) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every row of ``docs``: what ``repeated_spans`` takes
    out of it. Null texts count as empty; texts shorter than ``least`` and rows without an id keep everything; rows of
    one id never remove from one another."""
    spans = staged(repeated_spans(docs, least, seed), "spans")
    packed = fingerprints(docs).select("doc_id", "fa", "text").mapInArrow(_pack, "doc_id long, fa long, packed binary")
    return packed.join(spans, ["doc_id", "fa"], "left").mapInArrow(
        _digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, least: int = LEAST, seed: int = SEED) -> DataFrame:
    """``docs`` with the repeated bytes taken out of ``text`` and, where there is one, ``n_chars`` counted anew. What is
    left of a character that a cut goes through is dropped. Texts that repeat nothing stay as they are."""
    rows, lost = with_cuts(docs, least, seed)
    return rows.drop(lost)


def with_cuts(docs: DataFrame, least: int = LEAST, seed: int = SEED) -> tuple[DataFrame, str]:
    """``remove_repeats`` with one more column, whose name is given too: whether the text lost anything."""
    spans, names = staged(repeated_spans(docs, least, seed), "spans"), docs.columns
    ident, same, held, key, lost = unused(docs, "_id", "_fa", "_spans", "_key", "_lost")

    def cut(batches):
        for batch in batches:
            ranges = batch.column(held).to_pylist()
            texts = [t if s is None else cut_out((t or "").encode(), merged(s)).decode("utf-8", "ignore")
                     for t, s in zip(batch.column("text").to_pylist(), ranges)]
            columns = [pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([s is not None for s in ranges])], names=[*names, lost])

    fa = F.xxhash64(F.lit(1), F.coalesce("text", F.lit("")))
    spans = spans.select(F.col("doc_id").alias(ident), F.col("fa").alias(same), F.col("spans").alias(held))
    schema = StructType([*docs.schema.fields, StructField(lost, BooleanType())])
    rows = docs.withColumn(key, fa).join(
        spans, (F.col("doc_id").cast("long") == F.col(ident)) & (F.col(key) == F.col(same)), "left") \
        .select(*[F.col(f"`{c}`") for c in names], held).mapInArrow(cut, schema)
    if "n_chars" in names:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows, lost


@query()
def op5_suffix_dedup(spark, sf_dir):
    return removal_report(table(spark, sf_dir, "documents"))


def without_repeats(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: texts without repeated passages; documents of which nothing is left go. Documents that had no text
    before stay as they are."""
    rows, lost = with_cuts(docs)
    return rows.where(~F.col(lost) | (F.col("text") != "")).drop(lost)
