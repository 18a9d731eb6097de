"""The pipeline's stages, each judged on its own input by a plain version of it."""

import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pursuit.llm import decontaminate, mixing, ngram_join, quality
from pursuit.staging import staged
from tests.llm.conftest import SMALL
from tests.llm.test_near_and_repeats import brute_join, brute_removal
from tests.llm.test_tables import brute_leaks


WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain_score(text, rules, intercept):
    """The statistics and the rules of the classifier, one text at a time."""
    import regex

    text = text or ""
    words, lines = WORDS.findall(text), text.split("\n")
    count = lambda pattern: len(regex.findall(pattern, text))
    share = lambda a, b: a / b if b else 0.0
    n = len(text)
    stats = {
        "length": n, "words": len(words), "word_length": share(n, len(words)), "upper": share(count(r"\p{Lu}"), n),
        "symbols": share(count(r"""[^\p{L}\p{N} \t\n\x0b\f\r.,;:'"!?()-]"""), n), "digits": share(count(r"\p{Nd}"), n),
        "exclaim": share(text.count("!"), n), "other": share(count(r"[^\p{L}\p{M}\p{N} \t\n\x0b\f\r]"), n),
        "distinct": share(len(set(words)), len(words)), "lines": len(lines), "distinct_lines": share(len(set(lines)), len(lines))}
    values = [float(stats[s]) for s in quality.STATISTICS]
    z = intercept + sum(w for rule, w in rules if all((values[f] > t) == above for f, above, t in rule))
    return 1 / (1 + math.exp(-z))


def plain_mix(docs, weights=(3, 1, 2), share=1.5, most=2.0):
    """``(doc_id, epoch, words, text)`` of the mix of ``(doc_id, text, source)`` by loops over sources, keys and epochs."""
    size = [len(WORDS.findall(t or "")) for _, t, _ in docs]
    sources = sorted({s for _, _, s in docs}, key=lambda s: (s is None, s or ""))
    held = {s: sum(n for n, d in zip(size, docs) if d[2] == s) for s in sources}
    weight, full = {s: weights[i % len(weights)] for i, s in enumerate(sources)}, set()
    while True:
        free = [s for s in sources if s not in full]
        level = (share * sum(held.values()) - sum(most * held[s] for s in full)) / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if weight[s] * level > most * held[s]}
        if not over:
            break
        full |= over
    out = []
    for s in sources:
        budget = math.floor((most * held[s] if s in full else weight[s] * level) + 0.5)
        mine = sorted((int(hashlib.md5(f"mix:{d[0]}".encode()).hexdigest()[:13], 16), d[0], n, d[1]) for n, d in zip(size, docs) if d[2] == s)
        epoch = 0
        while budget > 0 and held[s]:
            for _, i, n, text in mine:
                now = min(n, budget)
                if now:
                    end = [m.end() for m in WORDS.finditer(text)][now - 1]
                    out.append((i, epoch, now, text if now == n else text[:end]))
                budget -= now
            epoch += 1
    return out


def test_stages(spark, given):
    docs = given("documents")
    items = [(r.item_id, r.text) for r in given("benchmark").collect()]
    for name, stage in corpus_pipeline.STAGES:
        after = staged(stage(spark, docs, SMALL), "stage")
        had, has = ([(r.doc_id, r.text) for r in x.collect()] for x in (docs, after))
        work = stage.__wrapped__
        if work is quality.keep_good:
            rules, intercept = quality.fit(docs, given("labels"), quality.held_out_mod(5, 0))
            scores = {i: plain_score(t, rules, intercept) for i, t in had}
            assert {r.doc_id: r.score for r in quality.score(docs, given("labels")).collect()} == pytest.approx(scores, abs=1e-9)
            assert sorted(has) == sorted(x for x in had if scores[x[0]] >= 0.3) and len(has) < len(had)
        elif work is ngram_join.keep_first:
            keep = {i for i, _, c in brute_join(had) if i == c}
            assert sorted(has) == sorted(x for x in had if x[0] in keep) and len(has) < len(had)
        elif work is decontaminate.without_leaks:
            assert {i for i, _ in had} - {i for i, _ in has} == {d for d, _ in brute_leaks(had, items)}
        elif name == "suffix-array dedup":
            removed = {i: (n, gone) for i, n, gone, _, _ in brute_removal(had)}
            assert {i for i, _ in has} == {i for i, (n, gone) in removed.items() if gone < n or not n}
            texts = dict(has)
            assert all(0 <= n - gone - len((texts[i] or "").encode()) <= 6 * 20 for i, (n, gone) in removed.items() if i in texts)
        else:
            assert work is mixing.mixed
            want = plain_mix([(r.doc_id, r.text, r.source) for r in docs.collect()])
            assert sorted((r.doc_id, r.epoch, r.taken, r.text) for r in after.collect()) == sorted(want)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == given("documents").columns and after.dtypes == given("documents").dtypes
        docs = after
    assert docs.count() > 0


CLASHES = ["_id", "_key", "_fa", "_spans", "_lost", "_n", "_words", "_lines", "stats", "score", "held_out", "predicted", "_epoch", "_now", "_size",
           "_source", "_taken", "fa", "key", "rep", "family", "text_", "run", "part"]


@pytest.mark.parametrize("number", range(5))
def test_stages_keep_columns_of_any_name(spark, given, number):
    name, stage = corpus_pipeline.STAGES[number]
    docs = given("documents")
    for i, c in enumerate(CLASHES):
        docs = docs.withColumn(c, F.concat(F.lit(f"{i} of "), F.col("doc_id").cast("string")))
    after = stage(spark, docs, SMALL)
    assert set(docs.columns) <= set(after.columns) and (after.columns == docs.columns or number == 4)
    rows = after.collect()
    assert rows and all(r[c] == f"{i} of {r.doc_id}" for r in rows for i, c in enumerate(CLASHES))
