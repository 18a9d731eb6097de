"""SentencePiece codec, hard negatives and periodic runs against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pursuit.llm import hard_negatives, periodic_runs, piece_codec
from pursuit.llm.suite import QUERIES
from tests.llm.conftest import SMALL

public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL = "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def model():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(MODEL))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


ODD_TEXTS = [
    None, "", " ", "  ", "a", " a", "a ", "  a   b  ", "x▁y▁▁z", "<s>hi</s><unk>", "\n", "a\n b\n\nc", "a\tb", "\xa0a　b", "é é", "\x00a \x00",
    "日本語 テスト", "😀😀 x", "﻿a ​ b", "mot " * 5, " " * 40 + "end" + " " * 40, "w" * 3000 + " " + "w" * 3000, "<0x0A> <0xE2>", "long text " * 4000,
]


def test_ids_and_decoding_are_those_of_the_library(spark, docs_of, model):
    rows = [(i, t, "x", "s") for i, t in enumerate(ODD_TEXTS)] + [(3, "  ", None, None), (3, "  ", None, None), (None, "a b", None, None)]
    docs = docs_of(rows).withColumn("ids", F.lit(1)).withColumn("block", F.lit("clash")).withColumn("part", F.lit(0.5))
    got = piece_codec.encode(docs, public_tokenizers.path(MODEL)).collect()
    want = [(i, model.encode(t or ""), model.decode(model.encode(t or ""))) for i, t, *_ in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_small_blocks_and_a_forgetful_table(spark, docs_of, model, monkeypatch):
    monkeypatch.setattr(piece_codec, "BLOCK_BYTES", 50)
    monkeypatch.setattr(piece_codec, "SLICE_CODES", 4)
    monkeypatch.setattr(piece_codec, "KNOWN", 3)
    rows = [(i, " ".join(random.Random(i).choices(["the", "a", "", "wörd", "zq"], k=i % 9)), None, None) for i in range(60)]
    got = piece_codec.encode(docs_of(rows).repartition(3), public_tokenizers.path(MODEL)).collect()
    assert {r.doc_id: (r.ids, r.decoded) for r in got} == {i: (model.encode(t), model.decode(model.encode(t))) for i, t, *_ in rows}


def test_codec_of_no_documents(spark, docs_of):
    assert piece_codec.encode(docs_of([]), public_tokenizers.path(MODEL)).collect() == []


def test_packing_round_trip():
    for values in ([], [0], [2**32 - 1, 5, 70000]):
        assert piece_codec.unpack(piece_codec.pack(np.array(values, np.int64))).tolist() == values
    for texts in ([], [""], ["a", "", "é\x00"]):
        assert piece_codec.unpack_texts(piece_codec.pack_texts(texts)) == texts


def test_query_of_the_codec_on_given_documents(spark, given, model):
    want = {}
    for r in given("documents").collect():
        ids = model.encode(r.text or "")
        want[r.doc_id] = len(ids), sha(",".join(map(str, ids))), sha(model.decode(ids))
    got = QUERIES["op11_piece_codec"](spark, SMALL).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == want


# --- periodic runs


def brute_runs(words, least=12):
    """Maximal stretches by trying every period at every start."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = j
    return sorted((lo, hi - lo, q) for (lo, hi), q in found.items())


def brute_collapse(words, runs):
    return " ".join(w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs))


def split(text):
    return [w.decode() for w in (text or "").encode().split()]


def periodic_texts(seed, n):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        words = []
        while len(words) < rng.choice([0, 3, 20, 60, 200]):
            unit = rng.choices("abcd", k=rng.choice([1, 1, 2, 3, 4, 5, 7, 8, 12, 16, 30]))
            words += (unit * rng.randint(1, 6))[:rng.randint(1, 70)]
        out.append(rng.choice([" ", "\n", "\t \x0b"]).join(words))
    return out + ["a " * 100, "ab " * 11, "ab " * 12, ("x y z " * 30) + "x y", "fib " * 2]


@pytest.mark.parametrize("seed,least,tile", [(1, 12, 1 << 16), (2, 12, 16), (3, 5, 24), (4, 2, 8), (5, 12, 40)])
def test_runs_and_collapsed_texts(spark, docs_of, seed, least, tile):
    rows = [(i, t, "x", "y") for i, t in enumerate(periodic_texts(seed, 60))] + [(7, None, None, None), (None, "", None, None), (7, "a b " * 20, None, None), (7, "a b " * 20, None, None)]
    docs = docs_of(rows).withColumn("key", F.lit("k")).withColumn("runs", F.lit(1)).withColumn("period", F.lit(2))
    got = periodic_runs.periodic_runs(docs.repartition(3), least, tile).collect()
    want = []
    for i, t, *_ in rows:
        words = split(t)
        runs = brute_runs(words, least)
        want.append((i, runs, brute_collapse(words, runs)))
    assert sorted(((r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in got), key=repr) == sorted(want, key=repr)


def test_fibonacci_words_have_runs_of_many_periods(spark, docs_of):
    a, b = ["a"], ["a", "b"]
    while len(b) < 600:
        a, b = b, b + a
    got = periodic_runs.periodic_runs(docs_of([(1, " ".join(b), None, None)]), 2, 64).collect()
    assert [tuple(x) for x in got[0].runs] == brute_runs(b, 2)


def test_runs_of_no_documents(spark, docs_of):
    assert periodic_runs.periodic_runs(docs_of([])).collect() == []


def test_query_of_runs_on_given_documents(spark, given):
    want = {}
    for r in given("documents").collect():
        words, h = split(r.text), zlib.crc32(str(r.doc_id).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        if n > 1500:  # the brute force is quadratic
            continue
        runs = brute_runs(words)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        want[r.doc_id] = (len(runs), *best, best[1] and 1000 * best[1] // best[2], sha("".join(f"{s},{k},{q}\n" for s, k, q in runs)),
                          sha(brute_collapse(words, runs)))
    got = QUERIES["op13_periodic_runs"](spark, SMALL)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = {r[0]: tuple(r[1:]) for r in got.collect()}
    assert len(got) == given("documents").count() and {i: got[i] for i in want} == want


# --- hard negatives


def brute_negatives(rows, anchor, k=5, n=10, low=30, high=90):
    out = []
    for i, (a, label, v) in enumerate(rows):
        if not anchor(a):
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), b, other == label) for j, (b, other, w) in enumerate(rows) if j != i and len(w) == len(v)]
        for s, b, _ in sorted(x for x in scored if x[2])[:k]:
            inside = sorted((t, c) for t, c, same in scored if not same and low * -s <= 100 * -t <= high * -s)[:n]
            out += [(a, b, r + 1, c, -s, -t) for r, (t, c) in enumerate(inside)]
    return sorted(out)


@pytest.mark.parametrize("seed,block,tile,zones", [(1, 1024, 256, 256), (2, 4, 3, 2), (3, 16, 5, 3)])
def test_negatives_of_small_blocks(spark, seed, block, tile, zones):
    rng = random.Random(seed)
    rows = [(i, rng.randint(0, 3), [rng.randint(-9, 12) for _ in range(rng.choice([3, 3, 3, 2]))]) for i in range(150)]
    rows += [(i, 1, [5, 5, 5]) for i in range(150, 210)] + [(211, 2, []), (215, 3, [])]
    df = spark.createDataFrame([(i, y, [x / 256 for x in v]) for i, y, v in rows], "vec_id long, label int, embedding array<double>")
    df = df.withColumn("key", F.lit("clash")).withColumn("place", F.lit(0)).withColumn("dim", F.lit(0)).withColumn("v", F.lit(0))
    got = hard_negatives.hard_negatives(hard_negatives.eligible(df), "vec_id % 5 = 0", 3, 4, block=block, tile=tile, zones=zones)
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows, lambda i: i % 5 == 0, 3, 4)


def test_rows_that_take_no_part(spark):
    rows = [(100, 1, [1.0, 1.0]), (100, 1, [1.0, 1.0]), (2, None, [1.0, 1.0]), (3, 1, None), (4, 1, [1.0, None]), (5, 1, [float("nan"), 1.0]),
            (6, 1, [float("inf"), 1.0]), (7, 2, [0.5, 0.5]), (7, 2, [0.5, 0.5]), (None, 2, [0.5, 0.5]), (8, 2, [1e300, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = hard_negatives.hard_negatives(hard_negatives.eligible(df), "vec_id % 100 = 0").collect()
    one = [(100, 100, 1, 7, 131072, 65536), (100, 100, 2, 7, 131072, 65536)]
    assert sorted(map(tuple, got)) == sorted(one * 2)
    assert hard_negatives.hard_negatives(hard_negatives.eligible(df.where("false")), "true").collect() == []


def test_products_beyond_a_double_and_a_long():
    a = np.array([[2.0**30, 3], [1, 2.0**30 + 1]])
    assert hard_negatives.products(a, a).tolist() == [[2**60 + 9, 2**30 + 3 * (2**30 + 1)], [2**30 + 3 * (2**30 + 1), 1 + (2**30 + 1) ** 2]]
    b = np.array([[2.0**40, 1]])
    assert hard_negatives.products(b, b).tolist() == [[2**63 - 1]] and hard_negatives.products(b, -b).tolist() == [[-2**63]]


@pytest.mark.parametrize("axes,bits", [(2, 4), (3, 3)])
def test_curve_goes_from_cell_to_neighbouring_cell(axes, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes), -1).reshape(-1, axes)
    place = hard_negatives.curve_position(grid, bits)
    assert sorted(place.tolist()) == list(range(len(grid)))
    assert (abs(np.diff(grid[np.argsort(place)], axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold_every_score():
    rng = np.random.default_rng(3)
    a, c = rng.integers(-50, 50, (20, 6)).astype(float), rng.integers(-50, 50, (200, 6)).astype(float)
    least, greatest = hard_negatives.score_bounds(a, c.min(axis=0)[None], c.max(axis=0)[None])
    score = hard_negatives.products(a, c)
    assert (score >= least).all() and (score <= greatest).all()
