"""Exact top-k search by inner product: tiled matrix products, partial selection per tile, tree merging.

Vectors are hashed into tiles of a bounded number of rows, and tiles into groups. Every group of query tiles meets every
group of candidate tiles once, in a task of its own, so a tile travels once for each group and not for each tile. A product
of two tiles leaves only the k best of each query; these short lists are merged inside the task, and then in a tree of fixed
fan-in, so no task ever holds more than ``FAN * k`` entries of a query.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pursuit.llm.hard_negatives import products
from pursuit.llm.registry import query, table
from pursuit.staging import staged

FAN = 16
QUERY_GROUP, GROUP = 8, 16  # tiles of a group
LOWEST = -2 ** 63 + 1       # so that a score and its negative fit a long
PACKED = "tile long, dim int, keys binary, ids binary, kind string, matrix binary"
HITS = "key long, query_id long, part long, top array<struct<loss:long,vec_id:long>>"


def quantised(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """``(key, vec_id, v)`` with every component floored to ``scale`` times its value, as whole numbers in doubles; ``key``
    tells rows apart. Stage it before it is read twice.

    Left out: a null id, and a vector that is null or holds a null or non-finite component. Rows of one id all stay."""
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform("v", lambda c: F.when(F.abs(c * scale) < 2.0 ** 53, F.floor(c * scale).cast("double")).otherwise(c * scale))
    return df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")) \
        .where("vec_id is not null and v is not null").where(finite) \
        .select(F.monotonically_increasing_id().alias("key"), "vec_id", whole.alias("v"))


def _narrow(matrix: np.ndarray) -> np.ndarray:
    """The matrix in the smallest type that holds its whole numbers."""
    top = abs(matrix).max(initial=0)
    return matrix.astype(next((t for t, limit in (("i1", 2 ** 7), ("i2", 2 ** 15), ("i4", 2 ** 31)) if top < limit), "f8"))


def _pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["vec_id", "key"], kind="stable")
    dim = int(key[1])
    matrix = _narrow(np.array(rows["v"].tolist(), dtype=np.float64).reshape(len(rows), dim))
    return pd.DataFrame({"tile": [key[0]], "dim": [dim], "keys": [rows["key"].to_numpy(np.int64).tobytes()],
                         "ids": [rows["vec_id"].to_numpy(np.int64).tobytes()], "kind": [matrix.dtype.str], "matrix": [matrix.tobytes()]})


def _tiles(df: DataFrame, count: int) -> DataFrame:
    placed = df.select("key", "vec_id", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("key"), F.lit(count)).alias("tile"))
    return placed.groupBy("tile", "dim").applyInPandas(_pack, PACKED)


def _product(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers; what a long cannot hold is held at its ends."""
    return np.maximum(products(q.astype(np.float64), c.astype(np.float64)), LOWEST)


def _first(row, value, ids, k: int):
    """The ``k`` first of each row by falling value, ties by smaller id."""
    order = np.lexsort((ids, -value, row))
    row, value, ids = row[order], value[order], ids[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], value[keep], ids[keep]


def best_of_tile(qkeys, q, ckeys, cids, c, k: int):
    """``(query row, score, candidate id)`` of the k best candidates of each query in one tile, ties to smaller ids. A
    query's own row is no candidate."""
    score = _product(q, c)
    other = ckeys[None, :] != qkeys[:, None]
    if len(cids) > k + 1:  # one more than k, since the own row may stand among them
        bar = np.partition(score, len(cids) - k - 1, axis=1)[:, len(cids) - k - 1]
        other &= score >= bar[:, None]
    row, col = np.nonzero(other)
    return _first(row, score[row, col], cids[col], k)


def _unpacked(tile):
    keys, ids = np.frombuffer(tile.keys, np.int64), np.frombuffer(tile.ids, np.int64)
    return keys, ids, np.frombuffer(tile.matrix, tile.kind).reshape(len(ids), tile.dim)


def _multiply(k: int, block: int = 512):
    def multiply(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        tiles = [_unpacked(b) for b in right.itertuples()] if len(left) else []
        for a in left.itertuples():
            qkeys, qids, q = _unpacked(a)
            for lo in range(0, len(qids), block):
                best = [best_of_tile(qkeys[lo:lo + block], q[lo:lo + block], ckeys, cids, c, k) for ckeys, cids, c in tiles]
                if not best:
                    continue
                row, score, ids = _first(*(np.concatenate(x) for x in zip(*best)), k)
                begin = np.flatnonzero(np.diff(row, prepend=-1))
                for i, j in zip(begin, np.append(begin[1:], len(row))):
                    top = [{"loss": -int(s), "vec_id": int(v)} for s, v in zip(score[i:j], ids[i:j])]
                    out.append((int(qkeys[lo + row[i]]), int(qids[lo + row[i]]), int(key[2]), top))
        return pd.DataFrame(out, columns=["key", "query_id", "part", "top"])
    return multiply


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, query_tile: int = 1024, tile: int = 4096) -> DataFrame:
    """The ``k`` candidates of highest inner product for each query: ``query_id, rank, vec_id, score``.

    Both inputs are ``(key, vec_id, v)`` as ``quantised`` gives them; rows with equal keys are the same row. Ties go to the
    smaller id, a query's own row is never its answer, and vectors of another length are no candidates. Rows of one id are
    queries and candidates of their own. A score that a long cannot hold is held at its end. A query without candidates
    gives no rows; empty inputs give an empty table. Counting the inputs and staging them runs when called."""
    queries, candidates = staged(queries, "queries"), staged(candidates, "candidates")
    nq, nc = -(-queries.count() // query_tile) or 1, -(-candidates.count() // tile) or 1
    q_groups, groups = -(-nq // QUERY_GROUP), -(-nc // GROUP)

    def grid(tiles, own, size, other, count):
        return tiles.withColumn(own, F.floor(F.col("tile") / size)).withColumn(
            other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))))

    left = grid(_tiles(queries, nq), "q", QUERY_GROUP, "c", groups)
    right = grid(_tiles(candidates, nc), "c", GROUP, "q", q_groups)
    lists = left.groupBy("dim", "q", "c").cogroup(right.groupBy("dim", "q", "c")).applyInPandas(_multiply(k), HITS)
    while groups > 1:
        groups = -(-groups // FAN)
        lists = lists.groupBy("key", "query_id", F.floor(F.col("part") / FAN).alias("part")).agg(
            F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k).alias("top"))
    return lists.select("query_id", F.posexplode("top").alias("pos", "hit")).select(
        "query_id", (F.col("pos") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"),
        (-F.col("hit.loss")).alias("score"))


SQL = """
WITH v AS (
    SELECT row_number() OVER () AS key, vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS e
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
    SELECT q.key, q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.key <> c.key AND len(q.e) = len(c.e)
), ranked AS (
    SELECT query_id, row_number() OVER (PARTITION BY key ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
    FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query(SQL)
def op1_topk_search(spark, sf_dir):
    vectors = staged(quantised(table(spark, sf_dir, "embeddings")), "vectors")
    return top_k(vectors.where("vec_id % 50 = 0"), vectors)
