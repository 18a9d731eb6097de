"""Stretches of words that repeat with a period, found octave by octave in overlapping tiles.

Periods from ``m`` to ``2m - 1`` are one octave. A stretch of that period and of at least two periods has a match run (places
``i`` whose word equals the word ``i + q``) that is long enough to hold a whole window of ``k`` words at a multiple of ``k``.
So a tile compares, for each of its boundaries ``c`` and each period ``q`` of the octave, the window at ``c`` with the one at
``c + q``, and reads from there how far the words go on to be equal in both directions: the values of a Z-function of the
boundary, up to the next boundaries. Windows of 1, 2, 4, ... words have 64-bit names made of the names of their halves, so
that each value takes as many comparisons as its length has bits. What a tile finds of a match run are fragments, which
meet by document and period and are stitched where they touch.
"""

from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pursuit.llm.registry import query, table
from pursuit.llm.words import mix, pieces
from pursuit.staging import staged

TILE = 1 << 16  # words of a tile's own part; eight times the period where that is more
RUN = "struct<start:long,length:long,period:long>"
FOUND = "key long, doc_id long, text string, pieces array<struct<period:long,lo:long,hi:long>>"
HALVES = np.uint64(0x9E3779B97F4A7C15)


class Names:
    """Names of the windows of 1, 2, 4, ... words at every place; equal windows, and no others, have equal names."""

    def __init__(self, codes: np.ndarray):
        self.level = [mix(codes.astype(np.uint64) + np.uint64(1))]

    def at(self, j: int, size: int) -> np.ndarray:
        """Names of the windows of ``2 ** j`` words at the first ``size`` places."""
        while len(self.level) <= j:
            last, half = self.level[-1][:size], 1 << (len(self.level) - 1)
            other = np.empty_like(last)
            other[:max(0, len(last) - half)] = last[half:]
            other[max(0, len(last) - half):] = last[-1:]  # the last word of a tile stands nowhere else
            self.level.append(mix(last * HALVES + other))
        return self.level[j]


@lru_cache(maxsize=64)
def _largest_divisors(m: int) -> np.ndarray:
    """For the periods of an octave, ``q / p`` for each prime divisor ``p`` of ``q``, filled up with 0."""
    rows = []
    rest = np.arange(m, 2 * m)
    for p in range(2, int((2 * m) ** 0.5) + 1):
        hit = rest % p == 0
        if hit.any() and all(p % d for d in range(2, int(p ** 0.5) + 1)):
            rows.append(np.where(hit, np.arange(m, 2 * m) // p, 0))
            while hit.any():
                rest = np.where(hit, rest // p, rest)
                hit = rest % p == 0
    rows.append(np.where(rest > 1, np.arange(m, 2 * m) // np.maximum(rest, 1), 0))
    table = np.sort(np.array(rows), axis=0)[::-1]
    return table[:max(1, int((table > 0).any(axis=1).sum()))]


def window_bits(octave: int, least: int) -> int:
    """The largest window, in bits, such that every match run of the octave holds one at a multiple of its size."""
    m = 1 << octave
    shortest = min(max(least - q, q) for q in (m, min(2 * m - 1, max(m, least // 2))))
    return ((shortest + 1) // 2).bit_length() - 1


def match_runs(names: Names, size: int, octave: int, least: int, first: int, last: int):
    """``(period, lo, hi)`` of the match runs of one octave around the boundaries from ``first`` up to ``last``, among the
    first ``size`` words of a tile, merged where they touch. Periods that are multiples of a shorter period are left out."""
    m, bits = 1 << octave, window_bits(octave, least)
    k = 1 << bits
    window = names.at(bits, size)
    c, q = [], []
    step = max(1, (1 << 20) // m)
    first += -first % k
    for a in range(first, min(last, size - m), k * step):
        at = np.arange(a, min(a + k * step, last, size - m), k)
        whole = at[at + 2 * m <= size]
        for part, width in ((whole, m), *((at[i:i + 1], int(size - m - at[i])) for i in range(len(whole), len(at)))):
            if len(part):
                view = np.lib.stride_tricks.as_strided(
                    window[part[0] + m:], (len(part), width), (window.itemsize * k, window.itemsize), writeable=False)
                row, col = np.nonzero(view == window[part][:, None])
                c.append(part[row])
                q.append(col + m)
    c, q = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (c, q))
    for d in _largest_divisors(m):  # a stretch whose period has a shorter one is found by that one
        d = d[q - m]
        span = np.maximum(q - d, 1)
        multiple = d > 0
        for j in {octave - 1, octave} - {-1}:
            name = names.at(j, size)
            here = multiple & (span >= 1 << j) & ((span < 2 << j) | (j == octave))
            for at in (c, c + span - (1 << j)):
                here[here] = name[at[here]] == name[(at + d)[here]]
            multiple &= ~((span >= 1 << j) & ((span < 2 << j) | (j == octave))) | here
        c, q = c[~multiple], q[~multiple]
    ahead, back = np.full(len(c), k), np.zeros(len(c), np.int64)
    for j in range(bits - 1, -1, -1):
        name, step = names.at(j, size), 1 << j
        ahead += step * (name[np.minimum(c + ahead, size - 1)] == name[np.minimum(c + q + ahead, size - 1)])
        at = c - back - step
        back += step * ((at >= 0) & (name[np.maximum(at, 0)] == name[np.maximum(at, 0) + q]))
    return merged(q, c - back, c + ahead)


def merged(period: np.ndarray, lo: np.ndarray, hi: np.ndarray):
    """Intervals of one period that overlap or touch, as one."""
    if not len(lo):
        return period, lo, hi
    order = np.lexsort((lo, period))
    period, lo, hi = period[order], lo[order], hi[order]
    far = hi.max() + 1  # lifts every period above the one before, so that one running maximum serves them all
    level = np.searchsorted(np.unique(period), period)
    reach = np.maximum.accumulate(hi + level * far)
    new = np.append(True, (lo + level * far)[1:] > reach[:-1])
    start = np.flatnonzero(new)
    return period[start], lo[start], np.append(reach[start[1:] - 1], reach[-1]) - level[start] * far


def _whole(docs: list[np.ndarray], least: int):
    """Match runs of documents that are whole in one tile, each followed by a word of its own: longer documents come first,
    so that the documents of an octave are the beginning of the tile."""
    order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
    sizes = np.array([len(docs[i]) for i in order])
    start = np.append(0, np.cumsum(sizes + 1))
    tile = np.empty(start[-1], np.int64)
    for n, i in enumerate(order):
        tile[start[n]:start[n + 1] - 1] = docs[i]
        tile[start[n + 1] - 1] = -2 - n
    names = Names(tile)
    for octave in range(64):
        alive = int(np.searchsorted(-sizes, -max(least, 2 << octave), "right"))
        if not alive:
            return
        q, lo, hi = match_runs(names, int(start[alive]), octave, least, 0, int(start[alive]))
        long = hi - lo >= np.maximum(least - q, q)
        q, lo, hi = q[long], lo[long], hi[long]
        doc = np.searchsorted(start, lo, "right") - 1
        for n, *run in zip(doc.tolist(), q.tolist(), (lo - start[doc]).tolist(), (hi - start[doc]).tolist()):
            yield order[n], tuple(run)


def _tiled(doc: np.ndarray, least: int, tile: int):
    """Fragments of the match runs of one long document, tile by tile; those that may go on in a neighbouring tile are kept
    at any length."""
    for octave in range(64):
        if len(doc) < max(least, 2 << octave):
            return
        m, k = 1 << octave, 1 << window_bits(octave, least)
        own = max(tile, 8 * m)
        own += -own % k
        for t in range(0, len(doc), own):
            base, end = max(0, t - k), min(len(doc), t + own + 2 * m + 2 * k)
            names = Names(np.append(doc[base:end], -2))
            q, lo, hi = match_runs(names, end - base + 1, octave, least, t - base, t - base + own)
            lo, hi = lo + base, hi + base
            keep = (hi - lo >= np.maximum(least - q, q)) | (t > 0) & (lo <= t) | (hi >= t + own)
            yield from zip(q[keep].tolist(), lo[keep].tolist(), hi[keep].tolist())


def _solve(least: int, tile: int, repeating: bool):
    """Documents with fragments, one row each; or, unless ``repeating``, the documents without any."""
    def solve(batches):
        key = TaskContext.get().partitionId() << 33
        for part, data, offsets in pieces(batches):
            number_of = defaultdict()
            number_of.default_factory = number_of.__len__
            texts = [data[a:b].tobytes().split() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            docs = [np.fromiter(map(number_of.__getitem__, t), np.int64, len(t)) for t in texts]
            found = [[] for _ in docs]
            short = [i for i, d in enumerate(docs) if len(d) <= tile]
            for i, run in _whole([docs[i] for i in short], least) if short else ():
                found[short[i]].append(run)
            for i, d in enumerate(docs):
                if len(d) > tile:
                    found[i] = list(_tiled(d, least, tile))
            at = [i for i in range(len(docs)) if bool(found[i]) == repeating]
            ids = part.column("doc_id").take(pa.array(at, pa.int64()))
            joined = pa.array([b" ".join(texts[i]).decode() for i in at], pa.string())
            if repeating:
                runs = pa.array([[{"period": q, "lo": lo, "hi": hi} for q, lo, hi in found[i]] for i in at],
                                pa.list_(pa.struct([("period", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key + i for i in at], pa.int64()), ids, joined, runs], names=["key", "doc_id", "text", "pieces"])
            else:
                yield pa.RecordBatch.from_arrays([ids, joined], names=["doc_id", "collapsed"])
            key += len(docs)
    return solve


def _collapse(batches):
    """Words that no run holds after its first period."""
    for batch in batches:
        out = []
        for text, runs in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist()):
            words = text.split(" ")
            edge = np.zeros(len(words) + 1, np.int64)
            for r in runs:
                edge[r["start"] + r["period"]] += 1
                edge[r["start"] + r["length"]] -= 1
            out.append(" ".join(words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("runs"), pa.array(out, pa.string())],
                                         names=["doc_id", "runs", "collapsed"])


def stitched(fragments: DataFrame, least: int) -> DataFrame:
    """``key, start, length, period`` of the runs that fragments ``(key, period, lo, hi)`` of match runs make up."""
    w = Window.partitionBy("key", "period").orderBy("lo")
    reach = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    chained = fragments.withColumn("new", F.coalesce(F.col("lo") > reach, F.lit(True)).cast("long")) \
        .withColumn("chain", F.sum("new").over(w))
    whole = chained.groupBy("key", "period", "chain").agg(F.min("lo").alias("start"), F.max("hi").alias("hi"))
    return whole.select("key", "start", (F.col("hi") - F.col("start") + F.col("period")).alias("length"), "period") \
        .where(F.col("length") >= F.greatest(F.lit(least), 2 * F.col("period")))


def periodic_runs(docs: DataFrame, least: int = 12, tile: int = TILE) -> DataFrame:
    """``doc_id, runs, collapsed`` for every row of ``docs``: the maximal periodic runs of words of its whole text, by start
    and period, and the text without the words that a run repeats, joined by single spaces.

    A run has the smallest period ``q``, at least ``max(least, 2 * q)`` words, and no neighbouring word keeps its period. Words
    are ``[^\\x20\\x09-\\x0D]+``, case counts. A null text or one without words has no runs and collapses to an empty text.
    Rows with equal or null ids stay apart; an empty table gives an empty table; other columns are not looked at. Documents
    with runs are written to the shared folder when called; the others are found again in a second pass and never moved."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = staged(rows.mapInArrow(_solve(least, tile, True), FOUND), "periodic")
    runs = stitched(found.select("key", F.inline("pieces")), least).groupBy("key").agg(
        F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    runs = runs.select("key", F.transform("runs", lambda r: F.struct(r["start"], r["length"], r["period"])).cast(f"array<{RUN}>").alias("runs"))
    none = F.array().cast(f"array<{RUN}>")
    repeating = found.select("key", "doc_id", "text").join(runs, "key", "left").select("doc_id", "text", F.coalesce("runs", none).alias("runs"))
    collapsed = repeating.mapInArrow(_collapse, f"doc_id long, runs array<{RUN}>, collapsed string")
    plain = rows.mapInArrow(_solve(least, tile, False), "doc_id long, collapsed string")
    return collapsed.unionByName(plain.select("doc_id", none.alias("runs"), "collapsed"))


def planted(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: in documents whose hash is divisible by 10, the words from a place on repeat with a period."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size("words")
    a = F.pmod(F.col("g"), F.greatest(n, F.lit(1))).cast("int")
    p = (1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))).cast("int")
    cycle = F.slice("words", F.col("a") + 1, F.col("p"))
    times = F.ceil((n - F.col("a")) / F.col("p")).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(cycle, times)), F.lit(1), n - F.col("a"))
    rows = docs.select("doc_id", "text", h.alias("h"), g.alias("g"))
    chosen = (F.col("h") % 10 == 0) & F.col("text").isNotNull()
    made = rows.where(chosen).withColumn("words", words).withColumn("a", a).withColumn("p", p) \
        .select("doc_id", F.concat_ws(" ", F.slice("words", F.lit(1), F.col("a")), tail).alias("text"))
    return made.unionByName(rows.where(~F.coalesce(chosen, F.lit(False))).select("doc_id", "text"))


@query()
def op13_periodic_runs(spark, sf_dir):
    """The longest run of every document, and digests of its runs and of its collapsed text."""
    found = periodic_runs(planted(table(spark, sf_dir, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]))
    text = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    return found.withColumn("best", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.p")).alias("period"),
        F.expr("best.length * 1000 div -best.p").alias("exponent_milli"),
        F.sha2(text, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
