"""Hard negatives: for every anchor and positive, the best rows of other labels whose score lies in a window below it.

Rows are sorted by label and along a Hilbert curve and written as Parquet blocks, each with the least and the greatest value
of every component: its zone. Anchors are packed into tiles in the same order. A search has windows of scores, each of one
anchor: interval arithmetic on an anchor and a zone bounds the scores that a block can hold, and a window reads only blocks
that may hold a score inside. Every window first reads its most promising block, which gives it a floor (the k-th score found),
then every block whose bound reaches the floor. Positives are the window without ends over the anchor's own label.
"""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pursuit.llm.registry import query, table
from pursuit.staging import staged

BLOCK, TILE, ZONES = 1024, 256, 256   # rows of a block, anchors of a tile, zones of a row
AXES, BITS = 7, 9                     # projections a curve runs over, and bits of each
LOWEST, HIGHEST = -2 ** 63, 2 ** 63 - 1
PACKED = "pack long, dim int, label long, keys binary, ids binary, matrix binary, lo binary, hi binary"
WINDOWS = "tile long, dim int, label long, keys binary, ids binary, matrix binary, who binary, floor binary, ceiling binary, " \
          "positive_id binary, positive_score binary"
REQUESTS = "tile long, block long, win binary, least binary"
LISTS = "tile long, win binary, score binary, vec_id binary"
NEGATIVES = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def eligible(df: DataFrame, scale: int = 256) -> DataFrame:
    """``(vec_id, label, v, dim)``: rows with a label and a vector of finite components, each floored to ``scale`` times its
    value. Every row stays, also rows of one id."""
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
                     F.col("embedding").cast("array<double>").alias("v")) \
        .where("vec_id is not null and label is not null and v is not null").where(finite) \
        .select("vec_id", "label", F.transform("v", lambda c: _floor(c * scale)).alias("v"), F.size("v").alias("dim"))


def _floor(c):
    """Whole numbers as doubles; beyond 2**53 every double is one."""
    return F.when(F.abs(c) < 2.0 ** 53, F.floor(c).cast("double")).otherwise(c)


def curve_position(x: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve through a grid of ``2 ** bits`` cells an axis, for rows of cell numbers."""
    x = x.astype(np.int64).copy()
    axes = x.shape[1]
    for b in range(bits - 1, 0, -1):  # undo the turns of the cells from the largest to the smallest
        low = (1 << b) - 1
        for i in range(axes):
            upper = (x[:, i] >> b & 1).astype(bool)
            swap = np.where(upper, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(upper, low, swap)
            x[:, i] ^= swap
    for i in range(1, axes):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(len(x), np.int64)
    for b in range(bits - 1, 0, -1):
        turn ^= np.where(x[:, -1] >> b & 1, (1 << b) - 1, 0)
    x ^= turn[:, None]
    place = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(axes):
            place = place << 1 | (x[:, i] >> b & 1)
    return place


def _place(batches):
    """Adds the place of a vector's direction, on projections whose axes depend on the number of components alone."""
    axes = {}
    for batch in batches:
        dims, vectors = batch.column("dim").to_numpy(), batch.column("v")
        place = np.zeros(len(dims), np.int64)
        for dim in np.unique(dims):
            if not dim:
                continue
            rows = np.flatnonzero(dims == dim)
            x = np.array(vectors.take(pa.array(rows)).flatten()).reshape(len(rows), dim)
            if dim not in axes:
                way = np.random.default_rng(int(dim)).standard_normal((dim, AXES))
                axes[dim] = way / np.linalg.norm(way, axis=0)
            x = x / np.maximum(abs(x).max(axis=1, keepdims=True), 1)
            at = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) @ axes[dim] * dim ** 0.5 / 3
            place[rows] = curve_position(np.clip((at + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1), BITS)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place)], names=[*batch.schema.names, "place"])


def _pack(size: int):
    """Sorted rows as packs of at most ``size`` rows of one length and label, each with its zone."""
    def pack(batches):
        number = TaskContext.get().partitionId() << 32
        held, head = [], None

        def packed():
            x = np.array([r[2] for r in held], np.float64).reshape(len(held), head[0])
            values = [number, *head, np.array([r[0] for r in held], np.int64).tobytes(), np.array([r[1] for r in held], np.int64).tobytes(),
                      x.tobytes(), x.min(axis=0).tobytes(), x.max(axis=0).tobytes()]
            types = [pa.int64(), pa.int32(), pa.int64()] + [pa.binary()] * 5
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)],
                                              names=["pack", "dim", "label", "keys", "ids", "matrix", "lo", "hi"])

        for batch in batches:
            for key, vec_id, label, v, dim in zip(*(batch.column(c).to_pylist() for c in ("key", "vec_id", "label", "v", "dim"))):
                if held and ((dim, label) != head or len(held) == size):
                    yield packed()
                    number, held = number + 1, []
                head = dim, label
                held.append((key, vec_id, v))
        if held:
            yield packed()
    return pack


def packs(rows: DataFrame, size: int, label: str) -> DataFrame:
    """Rows in the order of the curve, cut and written."""
    order = ["dim", "label", "place", "vec_id", "key"]
    tasks = max(1, -(-rows.count() // (16 * size)))
    return staged(rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order).mapInArrow(_pack(size), PACKED), label)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers; what a long cannot hold is held at its ends."""
    top = float(abs(a).max(initial=0)) * float(abs(b).max(initial=0)) * max(a.shape[1], 1)
    if top < 2.0 ** 53:
        return (a @ b.T).astype(np.int64)
    if top < 2.0 ** 62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    whole = np.frompyfunc(int, 1, 1)
    return np.clip(whole(a) @ whole(b).T, LOWEST, HIGHEST).astype(np.int64)


def score_bounds(a: np.ndarray, lo: np.ndarray, hi: np.ndarray):
    """Least and greatest score that each row of ``a`` can have with a vector inside each zone, rounded outwards."""
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    least, greatest = up @ lo.T + down @ hi.T, up @ hi.T + down @ lo.T
    slack = 1e-12 * (abs(a) @ np.maximum(abs(lo), abs(hi)).T) * max(a.shape[1], 1)
    return least - slack, greatest + slack


def _matrix(data: bytes, dim: int, n: int) -> np.ndarray:
    return np.frombuffer(data, np.float64).reshape(n, dim)


def _longs(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.int64)


def _wanted(k: int, same_label: bool, probe: bool):
    """The blocks that each window must read, one row for each tile and block. ``probe`` asks for the one block of the zones at
    hand whose bound is best; otherwise the floor is the k-th score found so far."""
    def wanted(batches):
        for batch in batches:
            for r in batch.to_pylist():
                x = _matrix(r["matrix"], r["dim"], len(_longs(r["keys"])))
                who, floor, ceiling = _longs(r["who"]), _longs(r["floor"]).copy(), _longs(r["ceiling"])
                if not probe and r["win"] is not None:
                    win, score = _longs(r["win"]), _longs(r["score"])
                    full = np.bincount(win, minlength=len(who)) >= k  # lists are sorted by window and falling score
                    floor[full] = np.maximum(floor[full], score[np.searchsorted(win, np.flatnonzero(full), "right") - 1])
                zones = [z for z in r["zones"] if (z["label"] == r["label"]) == same_label]
                if not zones or not len(who):
                    continue
                n = len(zones)
                least, greatest = score_bounds(x, *(_matrix(b"".join(z[c] for z in zones), r["dim"], n) for c in ("lo", "hi")))
                may = (greatest[who] >= floor[:, None].astype(np.float64)) & (least[who] <= ceiling[:, None].astype(np.float64))
                if probe:
                    best = np.where(may, greatest[who], -np.inf).argmax(axis=1)
                    may &= np.arange(n) == best[:, None]
                for at in np.flatnonzero(may.any(axis=0)):
                    win = np.flatnonzero(may[:, at])
                    yield _row([r["tile"], zones[at]["block"], win.tobytes(), floor[win].tobytes()],
                               [pa.int64(), pa.int64(), pa.binary(), pa.binary()], ["tile", "block", "win", "least"])
    return wanted


def _row(values, types, names):
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=names)


def _best(win, score, ids, k: int):
    """The first ``k`` of each window by falling score, ties by smaller id."""
    order = np.lexsort((ids, ~score, win))  # ~score falls as the score rises, at the ends of a long too
    win, score, ids = win[order], score[order], ids[order]
    keep = np.arange(len(win)) - np.searchsorted(win, win) < k
    return win[keep], score[keep], ids[keep]


def _lists(tile, win, score, ids):
    return _row([tile, win.astype(np.int64).tobytes(), score.tobytes(), ids.tobytes()],
                [pa.int64(), pa.binary(), pa.binary(), pa.binary()], ["tile", "win", "score", "vec_id"])


def _read(k: int, step: int = 64):
    """What each requested block holds for the windows that asked for it; a row is never found by itself."""
    def read(batches):
        for batch in batches:
            for r in batch.to_pylist():
                keys, ids = _longs(r["c_keys"]), _longs(r["c_ids"])
                own = _longs(r["keys"])
                x, c = _matrix(r["matrix"], r["dim"], len(own)), _matrix(r["c_matrix"], r["dim"], len(keys))
                who, ceiling, win, least = _longs(r["who"]), _longs(r["ceiling"]), _longs(r["win"]), _longs(r["least"])
                found = []
                anchors, of = np.unique(who[win], return_inverse=True)
                score = products(x[anchors], c)
                for lo in range(0, len(win), step):
                    w = win[lo:lo + step]
                    s = score[of[lo:lo + step]]
                    inside = (s >= least[lo:lo + step, None]) & (s <= ceiling[w][:, None]) & (keys != own[who[w]][:, None])
                    if s.shape[1] > 4 * k:  # a row below the k-th score inside is not among the first k
                        held = np.where(inside, s, LOWEST)
                        inside &= s >= np.partition(held, s.shape[1] - k, axis=1)[:, s.shape[1] - k][:, None]
                    row, col = np.nonzero(inside)
                    found.append(_best(w[row], s[row, col], ids[col], k))
                yield _lists(r["tile"], *(np.concatenate(v) for v in zip(*found)))
    return read


def _merge(k: int):
    """One list a tile from lists sorted by tile; holds one list and the row at hand."""
    def merge(batches):
        tile, held = None, None
        for batch in batches:
            for t, *lists in zip(*(c.to_pylist() for c in batch.columns)):
                new = [_longs(v) for v in lists]
                if t != tile and tile is not None:
                    yield _lists(tile, *held)
                held = new if t != tile else _best(*(np.concatenate(v) for v in zip(held, new)), k)
                tile = t
        if tile is not None:
            yield _lists(tile, *held)
    return merge


def search(windows: DataFrame, blocks: DataFrame, zones: DataFrame, groups: int, tasks: int, k: int, same_label: bool) -> DataFrame:
    """The first ``k`` rows inside each window, as one row of lists for each tile.

    Tiles meet rows of zones, not zones; tiles travel to the blocks that they ask for, so a block moves once."""
    spread = windows.withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    near = spread.join(zones, ["dim", "group"])
    held = None
    for probe in (True, False):
        if probe:
            asked = near.withColumn("win", F.lit(None).cast("binary")).withColumn("score", F.lit(None).cast("binary"))
        else:
            asked = near.join(held.select("tile", "win", "score"), "tile", "left")
        requests = asked.select("tile", "dim", "label", "keys", "matrix", "who", "floor", "ceiling", "zones", "win", "score") \
            .mapInArrow(_wanted(k, same_label, probe), REQUESTS)
        loaded = requests.join(windows.select("tile", "dim", "keys", "matrix", "who", "ceiling"), "tile") \
            .join(blocks.select(F.col("pack").alias("block"), F.col("keys").alias("c_keys"), F.col("ids").alias("c_ids"),
                                F.col("matrix").alias("c_matrix")), "block")
        lists = loaded.mapInArrow(_read(k), LISTS).repartition(tasks, "tile").sortWithinPartitions("tile")
        held = staged(lists.mapInArrow(_merge(k), LISTS), "window_lists")
    return held


def _below(low: int, high: int):
    """Windows of the negatives of each positive: between ``low`` and ``high`` hundredths of its score."""
    def below(batches):
        for batch in batches:
            for r in batch.to_pylist():
                who, score = _longs(r["win"]), _longs(r["score"])
                ends = [(max(-(-low * s // 100), LOWEST), min(high * s // 100, HIGHEST)) for s in map(int, score)]
                if ends:
                    floor, ceiling = (np.array(v, np.int64).tobytes() for v in zip(*ends))
                    yield _row([r["tile"], r["dim"], r["label"], r["keys"], r["ids"], r["matrix"], r["win"], floor, ceiling, r["vec_id"], r["score"]],
                               [pa.int64(), pa.int32(), pa.int64()] + [pa.binary()] * 8,
                               ["tile", "dim", "label", "keys", "ids", "matrix", "who", "floor", "ceiling", "positive_id", "positive_score"])
    return below


def _report(batches):
    for batch in batches:
        for r in batch.to_pylist():
            win, score, ids, who = (_longs(r[c]) for c in ("win", "score", "vec_id", "who"))
            rank = np.arange(len(win)) - np.searchsorted(win, win) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(v) for v in (_longs(r["ids"])[who[win]], _longs(r["positive_id"])[win], rank.astype(np.int32), ids,
                                       _longs(r["positive_score"])[win], score)],
                names=["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])


def hard_negatives(rows: DataFrame, anchors, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
                   block: int = BLOCK, tile: int = TILE, zones: int = ZONES) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the rows ``anchors`` (a condition) of
    ``rows``, which are ``(vec_id, label, v, dim)`` as ``eligible`` gives them.

    An anchor's positives are its best ``positives`` other rows of its label; the negatives of a positive are the best
    ``negatives`` rows of other labels with ``low * positive <= 100 * negative <= high * positive``. Ties go to smaller ids.
    Vectors of different lengths have no score. Rows of one id are rows of their own, and may be each other's positives. Scores
    that a long cannot hold are held at its ends. Few or no rows give short or empty results; empty vectors score 0.
    Runs when called, up to the last step: blocks, tiles and the lists of each round are written to the shared folder."""
    placed = staged(rows.withColumn("key", F.monotonically_increasing_id()).mapInArrow(
        _place, "vec_id long, label long, v array<double>, dim int, key long, place long"), "placed")
    blocks = packs(placed, block, "blocks")
    tiles = packs(placed.where(anchors), tile, "anchor_tiles")
    n = blocks.count()
    groups = max(1, -(-n // zones))
    zone_rows = staged(blocks.select("dim", F.pmod(F.xxhash64("pack"), F.lit(groups)).alias("group"), F.col("pack").alias("block"),
                                     "label", "lo", "hi").groupBy("dim", "group").agg(
        F.collect_list(F.struct("block", "label", "lo", "hi")).alias("zones")), "zones")
    tasks = max(8, min(2000, tiles.count() // 4))
    start = tiles.select(F.col("pack").alias("tile"), "dim", "label", "keys", "ids", "matrix").mapInArrow(_alone, WINDOWS)
    best = search(staged(start, "anchor_windows"), blocks, zone_rows, groups, tasks, positives, True)
    below = staged(start.select("tile", "dim", "label", "keys", "ids", "matrix").join(best, "tile")
                   .mapInArrow(_below(low, high), WINDOWS), "negative_windows")
    found = search(below, blocks, zone_rows, groups, tasks, negatives, False)
    return below.select("tile", "ids", "who", "positive_id", "positive_score").join(found, "tile").mapInArrow(_report, NEGATIVES)


def _alone(batches):
    """One window without ends for each anchor."""
    for batch in batches:
        for r in batch.to_pylist():
            n = len(_longs(r["keys"]))
            ends = [np.arange(n).tobytes(), np.full(n, LOWEST).tobytes(), np.full(n, HIGHEST).tobytes(), b"", b""]
            yield _row([r["tile"], r["dim"], r["label"], r["keys"], r["ids"], r["matrix"], *ends],
                       [pa.int64(), pa.int32(), pa.int64()] + [pa.binary()] * 8,
                       ["tile", "dim", "label", "keys", "ids", "matrix", "who", "floor", "ceiling", "positive_id", "positive_score"])


SQL = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        [floor(256 * x::DOUBLE) FOR x IN embedding] AS e
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
    SELECT a.vec_id AS anchor_id, c.vec_id, c.label = a.label AS same, list_dot_product(a.e, c.e)::BIGINT AS score
    FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id AND len(a.e) = len(c.e)
), positive AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score
    FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), ranked AS (
    SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank,
        vec_id AS negative_id, positive_score, score AS negative_score
    FROM positive JOIN scored USING (anchor_id)
    WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
)
SELECT * FROM ranked WHERE rank <= 10
"""


@query(SQL)
def op12_hard_negatives(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(eligible(vectors.withColumn("label", label)), "vec_id % 100 = 0")
