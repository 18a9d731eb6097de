"""The n-gram join and the removal of repeats against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pursuit.llm import components, ngram_join, suffix_dedup

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_join(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    top = {i: i for i, _ in sets if i is not None}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if None not in (i, j) and s and t and 100 * len(s & t) >= 80 * len(s | t):
                x, y = find(i), find(j)
                top[max(x, y)] = min(x, y)
    return sorted(((i, len(s), find(i) if i is not None else None) for i, s in sets), key=str)


def brute_removal(rows, least=50):
    texts = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in texts:
        if i is not None:
            for a in range(len(b) - least + 1):
                w = b[a:a + least]
                first[w] = min(first.get(w, i), i)
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for a in range(len(b) - least + 1):
            if i is not None and first[b[a:a + least]] < i:
                gone[a:a + least] = b"\1" * least
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def varied(seed, n=70):
    """Short and long texts with copies, small edits, shared passages, long runs of one word, and odd characters."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdéñ你") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    word = lambda: rng.choice(vocabulary)
    passage = " ".join(word() for _ in range(30))
    texts = [None, "", " \n\t", "one", "ONE", "one two three", "same " * 400, "same " * 399, "x" * 300, "x" * 49, "x" * 50]
    while len(texts) < n:
        kind = rng.random()
        base = rng.choice([t for t in texts if t] or ["a"])
        if kind < 0.3:
            texts.append(" ".join(word() for _ in range(rng.choice([3, 6, 8, 12, 40, 150]))))
        elif kind < 0.65:
            w = base.split(" ")
            for _ in range(rng.choice([0, 1, 1, 2, 5])):
                w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w))
        elif kind < 0.75:
            texts.append(base.upper() if rng.random() < 0.5 else base)
        else:
            texts.append(" ".join(word() for _ in range(20)) + " " + passage[rng.randrange(40):] + word())
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    return rows + rows[:3] + [(None, passage), (None, passage), (rows[5][0], "another text of the same id " + passage)]


@pytest.mark.parametrize("seed", [1, 2])
def test_join_equals_brute_force(docs_of, seed):
    rows = varied(seed)
    got = ngram_join.join(docs_of([(i, t, None, None) for i, t in rows])).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_join(rows)


def test_join_in_blocks(docs_of, monkeypatch):
    rows = varied(3)
    monkeypatch.setattr(ngram_join, "FAMILY_ELEMENTS", 120)
    got = ngram_join.join(docs_of([(i, t, None, None) for i, t in rows])).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_join(rows)


def test_weak_sets_meet_under_other_hashes(docs_of, monkeypatch):
    monkeypatch.setattr(ngram_join, "halves", lambda scheme: np.full(np.shape(scheme), 2, np.uint64))
    rows = [(k, " ".join(f"{w}{k // 2}" for w in "a b c d e f g h i j k l".split()) + (" z" if k % 2 else "")) for k in range(12)]
    got = ngram_join.join(docs_of([(i, t, None, None) for i, t in rows])).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_join(rows)
    assert {r.component_id for r in got} == {0, 2, 4, 6, 8, 10}


def test_join_of_nothing(docs_of):
    assert ngram_join.join(docs_of([])).collect() == []


def test_signatures_needed_never_exceed_those_shared():
    rng = np.random.default_rng(5)
    for n in [4, 5, 9, 30, 200, 900]:
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        lost = n // 10
        b = np.sort(np.append(a[lost:], rng.integers(0, 2**63, lost // 2, dtype=np.uint64)))
        common = len(np.intersect1d(a, b))
        if 100 * common < 80 * (len(a) + len(b) - common):
            continue
        small, large = sorted((a, b), key=len)
        scheme = ngram_join.schemes_of(np.array([len(small)]))[0]
        assert scheme[0] in [x[0] for x in ngram_join.schemes_of(np.array([len(large)]))]
        sig = [ngram_join.signatures(s, np.zeros(len(s), int), np.array([len(s)]), scheme) for s in (small, large)]
        assert len(np.intersect1d(sig[0][0], sig[1][0])) >= max(sig[0][2][0] - len(small) // 4, sig[1][2][0] - 2 * len(large) // 9)


@pytest.mark.parametrize("seed", [4, 5])
def test_removal_equals_brute_force(docs_of, seed):
    rows = varied(seed)
    got = suffix_dedup.removal_report(docs_of([(i, t, None, None) for i, t in rows])).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_removal(rows)


def test_removal_on_given_documents(given):
    rows = [(r.doc_id, r.text) for r in given("documents").collect()]
    got = suffix_dedup.removal_report(given("documents")).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_removal(rows)


def test_removal_from_repeated_rows(docs_of):
    copied, passage = "a text that is copied with its head and its tail, and more of it", "a passage of more than fifty bytes that two of the texts share"
    rows = [(1, copied)] + [(2, copied)] * 5 + [(3, passage + " and an end")] + [(4, "a head and " + passage)] * 4
    docs = docs_of([(i, t, None, None) for i, t in rows])
    assert sorted((tuple(r) for r in suffix_dedup.removal_report(docs).collect()), key=str) == brute_removal(rows)
    assert sorted(r.doc_id for r in suffix_dedup.without_repeats(None, docs, "").collect()) == [1, 3, 4, 4, 4, 4]
    spans = [(r.doc_id, len(r.spans)) for r in suffix_dedup.repeated_spans(docs).collect()]
    once = [(r.doc_id, len(r.spans)) for r in suffix_dedup.repeated_spans(docs.distinct()).collect()]
    assert sorted(spans) == sorted(once) and {i for i, _ in spans} == {2, 4}


def test_removal_of_nothing(docs_of):
    assert suffix_dedup.removal_report(docs_of([])).collect() == []


def test_texts_without_repeats(docs_of):
    passage = "p q r s t u v w x y z é " * 4
    docs = docs_of([(1, "head " + passage, "en", "a"), (2, "é" + passage + "tail", "en", None), (3, passage, "en", "b"), (4, None, None, "b"), (5, "", None, "c")])
    kept = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs).collect()}
    assert kept[1].text == "head " + passage and kept[2].text.endswith("tail") and len(kept[2].text) < 20 and kept[3].text == ""
    assert kept[2].n_chars == len(kept[2].text) and kept[4].text is None and kept[2].taken == 8
    assert suffix_dedup.without_repeats(None, docs, "").columns == docs.columns
    assert {r.doc_id for r in suffix_dedup.without_repeats(None, docs, "").collect()} == {1, 2, 4, 5}  # 5 had no text to lose


def test_sampled_windows_have_one_speaker():
    data = np.frombuffer(("abcd efgh " * 3 + "x" * 120 + "the rest of a text that does not repeat at all, or so").encode(), np.uint8)
    text, first, last, place, rank = suffix_dedup.sampled(data, np.array([0, 100, len(data)]))
    covered = [(t, i) for t, a, z in zip(text, first, last) for i in range(a, z + 1)]
    assert sorted(covered) == [(0, i) for i in range(51)] + [(1, i) for i in range(100, len(data) - 49)]
    assert ((place >= first) & (place <= last + 25)).all()


def test_merged_ranges():
    spans = [{"a": 5, "z": 9}, {"a": 0, "z": 2}, {"a": 2, "z": 4}, {"a": 6, "z": 7}]
    assert suffix_dedup.merged(spans) == [(0, 4), (5, 9)] and suffix_dedup.cut_out(b"0123456789", [(0, 4), (5, 9)]) == b"49"


def test_merged_lists_equal_merged():
    rng = random.Random(8)
    lists = [None, []] + [[{"a": a, "z": a + rng.randint(1, 9)} for a in (rng.randrange(60) for _ in range(rng.randint(0, 7)))] for _ in range(60)]
    column = pa.array(lists, pa.list_(pa.struct([("a", pa.int64()), ("z", pa.int64())])))
    for part, at in ((column, 0), (column.slice(5, 20), 5)):
        row, start, end = suffix_dedup.merged_lists(part)
        for i in range(len(part)):
            assert list(zip(start[row == i].tolist(), end[row == i].tolist())) == suffix_dedup.merged(lists[at + i])


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 103), (103, 101), (101, 101), (7, 7), (None, 3), (500, 500)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_keep_first(docs_of):
    t = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    docs = docs_of([(3, t, None, None), (2, t + " 1", None, None), (9, "other words stand here", None, None), (None, t, None, None), (8, None, None, None)])
    kept = ngram_join.keep_first(None, docs, "")
    assert kept.columns == docs.columns and sorted((r.doc_id for r in kept.collect()), key=str) == sorted([2, 8, 9, None], key=str)
    assert docs.where(F.col("doc_id") == 3).count() == 1
