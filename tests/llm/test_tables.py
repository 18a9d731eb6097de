"""Top-k search, mixing, token counts and decontamination."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pursuit.llm import decontaminate, mixing, token_counts, topk_search
from pursuit.llm.suite import ORACLES, QUERIES
from tests.llm.conftest import SMALL
from workload import check


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, given, name):
    df = QUERIES[name](spark, SMALL)
    columns, want = check.oracle(SMALL, ORACLES[name])
    assert check._bag(df.columns, [tuple(r) for r in df.collect()]) == check._bag(columns, want)


def brute_top(rows, queries, k):
    out = []
    for i, q in queries:
        scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in rows if j != i and len(v) == len(q))
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("tile", [3, 64])
def test_top_k_with_ties_and_many_tiles(spark, tile):
    rng = random.Random(tile)
    rows = {i: [rng.randint(-2, 2) for _ in range(3)] for i in range(60)}
    rows |= {i: [1, 1, 1] for i in range(60, 90)} | {200: [5, 5], 201: [1, 2], 202: [3]}
    df = spark.createDataFrame([(i, [x / 256 for x in v]) for i, v in rows.items()], "vec_id long, embedding array<double>")
    vectors = topk_search.quantised(df)
    got = topk_search.top_k(vectors.where("vec_id % 5 = 0"), vectors, 4, query_tile=4, tile=tile)
    assert sorted(map(tuple, got.collect())) == brute_top(list(rows.items()), [(i, v) for i, v in rows.items() if i % 5 == 0], 4)


def test_vectors_that_take_no_part(spark):
    rows = [(1, [0.5, 0.25]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]),
            (None, [1.0, 1.0]), (6, [-0.001, 1.0]), (8, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit("clash")).withColumn("key", F.lit(1))
    assert {r.vec_id: r.v for r in topk_search.quantised(df).collect()} == {1: [128, 64], 6: [-1, 256], 8: []}
    vectors = topk_search.quantised(df)
    got = topk_search.top_k(vectors, vectors).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 6, -128 + 64 * 256), (6, 1, 1, -128 + 64 * 256)]
    none = vectors.where("false")
    assert topk_search.top_k(none, none).collect() == [] and topk_search.top_k(vectors, none).collect() == []


def test_rows_of_one_id_and_scores_beyond_a_long(spark):
    rows = [(50, [1.0, 0.0]), (1, [0.25, 9.0]), (1, [0.5, 9.0]), (2, [0.25, 0.0]), (50, [1.0, 0.0]), (3, [1e300, 0.0]), (4, [2.0**40, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    vectors = topk_search.quantised(df)
    got = topk_search.top_k(vectors.where("vec_id = 50"), vectors, 6).collect()
    one = [(50, 1, 3, 2**63 - 1), (50, 2, 4, 2**56), (50, 3, 50, 2**16), (50, 4, 1, 2**15), (50, 5, 1, 2**14), (50, 6, 2, 2**14)]
    assert sorted(map(tuple, got)) == sorted(one * 2)


def test_query_equals_its_sql_on_repeated_ids(spark, given, tmp_path):
    rng = random.Random(5)
    rows = [(rng.choice([0, 50, 100, 3, 7, 9]), [rng.randint(-3, 3) / 4 for _ in range(rng.choice([2, 2, 3]))], 1) for _ in range(80)]
    rows += [(51, None, 1), (52, [None, 1.0], 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").coalesce(1).write.parquet(str(tmp_path / "e"))
    (file,) = (tmp_path / "e").glob("part-*.parquet")
    import os
    import shutil
    for name in os.listdir(SMALL):
        os.symlink(f"{SMALL}/{name}", tmp_path / name) if name != "embeddings.parquet" else shutil.copy(file, tmp_path / name)
    df = QUERIES["op1_topk_search"](spark, str(tmp_path))
    columns, want = check.oracle(str(tmp_path), ORACLES["op1_topk_search"])
    assert check._bag(df.columns, [tuple(r) for r in df.collect()]) == check._bag(columns, want) and want


def test_large_products_are_exact():
    a = np.array([[2**30, 3], [1, 2**30 + 1]])
    assert topk_search._product(a, a).tolist() == [[2**60 + 9, 2**30 + 3 * (2**30 + 1)], [2**30 + 3 * (2**30 + 1), 1 + (2**30 + 1) ** 2]]


def documents(seed, n=120):
    rng = random.Random(seed)
    return [(i, " ".join("w" for _ in range(rng.choice([0, 1, 5, 40]))), None, rng.choice(["b", "a", "Z", None, "é"] + ["a"] * 5)) for i in range(n)]


def test_mix_meets_its_targets(docs_of):
    rows = documents(1) + [(500, None, None, "nothing"), (None, "w w w", None, "a"), (None, "w w w", None, "a"), (3, "w " * 9, None, "b")]
    got = mixing.mix(docs_of(rows), range_rows=4).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
        assert 0 <= r.taken <= 2 * r.size
    assert sum(x[0].target for x in by.values()) == pytest.approx(1.5 * sum(r.size for r in got))
    for rows_of in by.values():
        assert sum(r.taken for r in rows_of) == round(rows_of[0].target)
        assert rows_of[0].source_size == sum(r.size for r in rows_of) and rows_of[0].target <= 2 * rows_of[0].source_size
        partial = [r for r in rows_of if r.size and r.taken % r.size]
        assert len(partial) <= 1
    again = mixing.mix(docs_of(list(reversed(rows))), range_rows=1000).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mix_of_nothing_and_of_empty_texts(docs_of):
    assert mixing.mix(docs_of([])).collect() == []
    got = mixing.mix(docs_of([(1, "", None, "a"), (2, None, None, None)])).collect()
    assert {(r.doc_id, r.size, r.target, r.taken) for r in got} == {(1, 0, 0.0, 0), (2, 0, 0.0, 0)}


def test_prefix_sums_over_levels(spark, monkeypatch):
    monkeypatch.setattr(mixing, "WIDTH_BITS", 2)
    rows = [(s, i, i * 3 + len(s)) for s in ("a", "bb") for i in range(0, 100, 3)]
    df = spark.createDataFrame(rows, "src string, range long, words long")
    got = {(r.src, r.range): r.before for r in mixing._before(df, 7).collect()}
    assert got == {(s, i): sum(w for t, j, w in rows if t == s and j < i) for s, i, _ in rows}


def test_mixed_rows(docs_of):
    docs = docs_of([(1, "a b  c d", None, "x"), (2, " e\tf g h", None, "y"), (3, "i j k l", None, "z"), (4, None, None, "z")])
    rows = mixing.mixed(None, docs, "").collect()
    amounts = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    for r in rows:
        assert len(r.text.split()) == r.taken and r.n_chars == len(r.text)
    assert {i: sum(r.taken for r in rows if r.doc_id == i) for i in (1, 2, 3)} == {i: amounts[i] for i in (1, 2, 3)}


def test_token_counts(docs_of, given):
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    path = public.path("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    rng = random.Random(3)
    pool = [chr(c) for c in [*range(0x530), *range(0x2000, 0x2070), 0x3000, 0x4E00, 0x1F600, 0x200B, 0xFEFF]]
    texts = [None, "", "a <|endoftext|> b<|endoftext|>", "\t\t x", "word " * 3000, "x" * 20000, "it's we'll '' 's ''s"]
    texts += ["".join(rng.choice(rng.choice([pool, list(" \t\n'sretvml\x1c\x85\xa0ab1!")])) for _ in range(rng.randint(0, 40))) for _ in range(500)]
    docs = docs_of([(i if i % 7 else None, t, None, None) for i, t in enumerate(texts)])
    got = sorted((r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(docs, path).collect())
    want = [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]
    assert got == sorted((len((t or "").encode()), n, n > 1024) for t, n in zip(texts, want))
    assert token_counts.token_counts(docs_of([]), path).collect() == []


ITEM = "Anna buys 12 apples and Tom sells 7 pears for 3 dollars in the market, so how many are left with Anna?"
ASKED = "x y z. Maria buys 40 apples and Peter sells 9.5 pears for 5 dollars in the market, so how many are left with {}? End"


def test_reparameterised_questions(spark, docs_of):
    items = spark.createDataFrame([(1, ITEM), (1, ITEM), (2, "one two three four five"), (3, None), (4, ""), (None, "red green blue white")], "item_id long, text string")
    docs = docs_of([(1, ASKED.format("Maria"), None, None), (1, ASKED.format("Maria"), None, None), (2, ASKED.format("Peter"), None, None),
                    (3, "and one two three four five is", None, None), (4, None, None, None), (5, "", None, None),
                    (6, "one two three four six", None, None), (7, "red, green; blue - white", None, None), (8, ITEM[:40], None, None),
                    (None, "so " * 3000 + ITEM, None, None)])
    got = {(r.doc_id, r.item_id): (r.n_slots, r.n_changed) for r in decontaminate.leaks(docs, items).collect()}
    assert got == {(1, 1): (6, 5), (3, 2): (0, 0), (7, None): (0, 0), (None, 1): (6, 0)}
    assert decontaminate.leaks(docs_of([]), items).collect() == [] and decontaminate.leaks(docs, items.where("false")).collect() == []


def leaked(spark, docs_of, items, texts):
    """``{(doc, item)}`` of items and texts numbered by place."""
    rows = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs_of([(i, t, None, None) for i, t in enumerate(texts)]), rows).collect()}


def test_short_items_in_any_context_and_case(spark, docs_of):
    rng = random.Random(6)
    items = []
    for n in range(4, 14):
        w = ["".join(rng.choice("abcdefghi") for _ in range(5)) for _ in range(n)]
        items.append(" ".join([w[0].capitalize(), *w[1:-1], w[-1].capitalize()]) + "?")
    items += ["Émile va à la plage où Zoé dort près de Noël", "Иван дал Анне семь яблок утром", "Die Straße nach Köln ist länger als Öl"]
    around = ["so they say {} and on", "{}", "End. {}", "it is {}"]
    texts = [a.format(t) for t in items for a in (*around[:3], around[3].format(t.lower()), around[3].format(t.upper()))]
    got = leaked(spark, docs_of, items, texts)
    assert got == {(5 * i + k, i) for i in range(len(items)) for k in range(5)}


def test_reparameterised_short_items_in_any_context_and_case(spark, docs_of):
    items = ["Anna buys 12 apples and keeps them", "Yesterday the farmer gave Anna and Tom 3 pears"]
    texts = ["so Maria buys 40 apples and keeps them now", "so maria buys 40 apples and keeps them now", "SO MARIA BUYS 40 APPLES AND KEEPS THEM NOW",
             "yesterday the farmer gave eva and ben 5 pears", "yesterday the farmer gave eva and eva 5 pears", "so Maria sells 40 apples and keeps them"]
    assert leaked(spark, docs_of, items, texts) == {(0, 0), (1, 0), (2, 0), (3, 1)}


def test_items_of_values_short_items_and_scripts_without_spaces(spark, docs_of):
    items = ["12 + 7 = 19, 19 - 4 = 15", "GIVE THE NAME OF THE TALLEST MOUNTAIN IN ALL OF EUROPE TODAY PLEASE", "12 34 56 78 90 11 13 15 17 19 21 23 25 27",
             "Who was Jane Mary Smith", "Bonn 7", "Zugspitze", "水的化学式是什么？请回答。", "りんごは、いくつありますか", "น้ำเดือดที่อุณหภูมิเท่าใด"]
    texts = [f"so it said {t} and more" for t in items] + [f"前文。{items[6]}后文", "水的 化学", "so 12 + 7 = 19, 19 - 5 = 15", "Bonn 8 and the mountain", "“Zugspitze”—yes"]
    n = len(items)
    assert leaked(spark, docs_of, items, texts) == {(i, i) for i in range(n)} | {(n, 6), (n + 4, 5)}


def brute_leaks(docs, items):
    """Pairs by plain windows of words; on text without numbers it is what templates must find at least."""
    import re

    tokens = lambda t: re.findall(r"[A-Za-z\u0080-￿]+", t.lower())
    known = {}
    for i, t in items:
        w = tokens(t)
        for a in range(len(w) - 7):
            known.setdefault(tuple(w[a:a + 8]), set()).add((i, a))
    found = {}
    for d, t in docs:
        w = tokens(t)
        for a in range(len(w) - 7):
            for i, b in known.get(tuple(w[a:a + 8]), ()):
                found.setdefault((d, i, a - b), set()).add(b)
    return {(d, i) for (d, i, _), at in found.items() if len(at) >= 8}


def test_leaks_of_given_tables(given):
    docs = [(r.doc_id, r.text) for r in given("documents").collect()]
    items = [(r.item_id, r.text) for r in given("benchmark").collect()]
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(given("documents"), given("benchmark")).collect()}
    assert brute_leaks(docs, items) == got and got


def test_pre_tokens_are_encoded_a_few_thousand_at_a_time(monkeypatch):
    """However many pre-tokens a row holds; what is remembered starts anew beyond the bound and counts stay the same."""
    sizes = []

    class Library:
        def encode_batch(self, texts, add_special_tokens):
            sizes.append(len(texts))
            return texts

    monkeypatch.setattr(token_counts, "KNOWN_BYTES", 1 << 10)
    counter = object.__new__(token_counts.Pieces)
    counter.tokenizer, counter.known, counter.held = Library(), {}, 0
    words = [f"w{i}" for i in range(3 * token_counts.AT_ONCE + 7)]
    for _ in range(2):
        known = counter.count(words)
        assert all(known[w] == len(w) for w in words)
    assert max(sizes) <= token_counts.AT_ONCE and sum(sizes) == 2 * len(words)
