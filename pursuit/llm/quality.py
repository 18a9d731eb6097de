"""Quality classifier: a sparse ensemble of rules over statistics of a text.

Small trees are grown on a bounded sample of labelled statistics; every path from a root is a conjunctive rule; a
logistic regression with a lasso penalty keeps the rules that matter. What is left is compiled into one Spark column
expression, so scoring is a projection.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pursuit.llm.language_id import held_out_mod
from pursuit.llm.names import unused
from pursuit.llm.registry import query, table

SAMPLE = 4000           # labelled rows that training may read
STATISTICS = ["length", "words", "word_length", "upper", "symbols", "digits", "exclaim", "other", "distinct", "lines", "distinct_lines"]
WORD = r"[^\x20\x09-\x0D]+"


def with_statistics(df: DataFrame, name: str = "stats") -> DataFrame:
    """Adds ``name``, a struct of the statistics of ``text``: counts and shares that need nothing but the text. A null
    text counts as empty; shares of nothing are 0."""
    words, lines, counts = unused(df, "_words", "_lines", "_n")
    text = F.coalesce(F.col("text"), F.lit(""))
    left = lambda pattern: F.length(F.regexp_replace(text, pattern, ""))
    rows = df.withColumn(words, F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).withColumn(lines, F.split(text, "\n"))
    rows = rows.withColumn(counts, F.struct(
        F.length(text).alias("length"), F.size(words).alias("words"),
        F.size(F.array_distinct(words)).alias("kinds"),
        F.size(lines).alias("lines"), F.size(F.array_distinct(lines)).alias("line_kinds"),
        left(r"\P{Lu}+").alias("upper"), left(r"\P{Nd}+").alias("digits"),
        left(r"""[\p{L}\p{N}\s.,;:'"!?()-]+""").alias("symbols"), left(r"[\p{L}\p{M}\p{N}\s]+").alias("other"),
        left("[^!]+").alias("exclaim")))
    n = lambda of: F.col(f"{counts}.{of}").cast("double")
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    stats = {
        "length": n("length"), "words": n("words"), "word_length": share(n("length"), n("words")),
        "upper": share(n("upper"), n("length")), "symbols": share(n("symbols"), n("length")),
        "digits": share(n("digits"), n("length")), "exclaim": share(n("exclaim"), n("length")),
        "other": share(n("other"), n("length")), "distinct": share(n("kinds"), n("words")),
        "lines": n("lines"), "distinct_lines": share(n("line_kinds"), n("lines")),
    }
    return rows.withColumn(name, F.struct(*[stats[s].alias(s) for s in STATISTICS])).drop(words, lines, counts)


def grow(x, y, features, depth: int, smallest: int = 8, path=()):
    """Rules, as tuples of (feature, above, threshold), of every path of a tree that splits by the Gini index."""
    rules = [path] if path else []
    if depth == 0 or len(y) < 2 * smallest or y.min() == y.max():
        return rules
    best = (1e-9, None, None)
    impurity = y.mean() * (1 - y.mean())
    for f in features:
        for t in np.unique(np.quantile(x[:, f], np.linspace(0.04, 0.96, 24))):
            above = x[:, f] > t
            k = int(above.sum())
            if smallest <= k <= len(y) - smallest:
                a, b = y[above].mean(), y[~above].mean()
                gain = impurity - (k * a * (1 - a) + (len(y) - k) * b * (1 - b)) / len(y)
                if gain > best[0]:
                    best = (gain, f, float(t))
    _, f, t = best
    if f is None:
        return rules
    above = x[:, f] > t
    return rules + grow(x[above], y[above], features, depth - 1, smallest, (*path, (f, True, t))) \
        + grow(x[~above], y[~above], features, depth - 1, smallest, (*path, (f, False, t)))


def holds(rule, x):
    out = np.ones(len(x), bool)
    for f, above, t in rule:
        out &= (x[:, f] > t) == above
    return out


def lasso(design, y, penalty: float = 2e-4, steps: int = 600):
    """Weights and intercept of a logistic regression with an L1 penalty, by accelerated proximal gradient steps."""
    n, m = design.shape
    rate = 4.0 / (np.linalg.norm(design, 2) ** 2 / n + 1)
    w, b = np.zeros(m), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    look, look_b, t = w, b, 1.0
    for _ in range(steps):
        error = 1 / (1 + np.exp(-(design @ look + look_b))) - y
        new = look - rate * (design.T @ error) / n
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        new_b = look_b - rate * error.mean()
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look, look_b = new + (t - 1) / after * (new - w), new_b + (t - 1) / after * (new_b - b)
        w, b, t = new, new_b, after
    return w, b


def fit_rules(x, y, trees: int = 30, depth: int = 3, seed: int = 11):
    """``(rules with weights, intercept)``. Without rows of both kinds there are no rules, only the share of good rows,
    or one half without any rows."""
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return [], float(np.log(share / (1 - share)))
    rng = np.random.default_rng(seed)
    rules = set()
    for _ in range(trees):
        rows = rng.integers(0, len(y), len(y))
        rules.update(grow(x[rows], y[rows], rng.choice(x.shape[1], 4, replace=False), depth))
    rules = sorted(rules)
    design = np.stack([holds(r, x) for r in rules], axis=1).astype(float)
    keep = np.unique(design, axis=1, return_index=True)[1]
    rules, design = [rules[i] for i in sorted(keep)], design[:, np.sort(keep)]
    w, b = lasso(design, y)
    return [(r, float(v)) for r, v in zip(rules, w) if abs(v) > 1e-6], float(b)


RULES = "array<struct<w:double,c:array<struct<f:int,above:boolean,t:double>>>>"


def compiled(rules, intercept: float, name: str = "stats") -> Column:
    """The probability of a good text as a column over the statistics ``name``.

    The rules are one constant array that an aggregate walks, so the expression and its code are as small for many rules as
    for few. The statistics travel in the aggregate's state, which takes them once a row."""
    def condition(f, above, t):
        return F.struct(F.lit(f + 1).alias("f"), F.lit(above).alias("above"), F.lit(t).alias("t"))

    table = F.array(*[F.struct(F.lit(w).alias("w"), F.array(*[condition(*c) for c in rule]).alias("c")) for rule, w in rules]).cast(RULES)
    start = F.struct(F.lit(float(intercept)).alias("z"), F.array(*[F.col(f"{name}.{s}") for s in STATISTICS]).alias("v"))

    def add(state, rule):
        met = F.forall(rule["c"], lambda c: (F.element_at(state["v"], c["f"]) > c["t"]) == c["above"])
        return F.struct((state["z"] + F.when(met, rule["w"]).otherwise(0.0)).alias("z"), state["v"].alias("v"))

    return F.aggregate(table, start, add, lambda state: 1 / (1 + F.exp(-state["z"])))


def _fitted(batches):
    """The rules of a sample, one row each, and the intercept under a null rule."""
    found = [b for b in batches if len(b)] or [pd.DataFrame(columns=["doc_id", "quality", *STATISTICS])]
    rows = pd.concat(found).sort_values(["doc_id", "quality", *STATISTICS])
    rules, intercept = fit_rules(rows[STATISTICS].to_numpy(float), rows["quality"].to_numpy(float))
    yield pd.DataFrame({
        "rule": [None, *[[{"f": int(f), "above": bool(above), "t": float(t)} for f, above, t in r] for r, _ in rules]],
        "weight": [intercept, *[w for _, w in rules]]})


def fit(docs: DataFrame, labels: DataFrame, held_out, sample: int = SAMPLE):
    """Rules learned from labelled rows that are not ``held_out``; the rows are chosen by the hash of their id. Rules are
    fitted in a task, on at most four times ``sample`` rows; the driver reads the rules alone."""
    chosen = labels.where("doc_id is not null and quality is not null").where(~held_out).select("doc_id", "quality") \
        .orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    rows = with_statistics(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")) \
        .select("doc_id", "quality", "stats.*").limit(4 * sample).coalesce(1)
    got = rows.mapInPandas(_fitted, "rule array<struct<f:int,above:boolean,t:double>>, weight double").collect()
    rules = sorted((tuple((c.f, c.above, c.t) for c in r.rule), r.weight) for r in got if r.rule is not None)
    return rules, next((r.weight for r in got if r.rule is None), 0.0)


def with_score(docs: DataFrame, labels: DataFrame, bar: float, held_out, names) -> DataFrame:
    """``docs`` with the three results of ``score`` under ``names``, which no column of ``docs`` has."""
    rules, intercept = fit(docs, labels, held_out)
    (stats,) = unused(docs, "stats")
    rows = with_statistics(docs, stats).withColumn(names[0], held_out).withColumn(names[1], compiled(rules, intercept, stats)).drop(stats)
    return rows.withColumn(names[2], F.when(F.col(names[1]) >= bar, 1).otherwise(0))


def score(docs: DataFrame, labels: DataFrame, bar: float = 0.3, held_out=None) -> DataFrame:
    """Every row of ``docs`` with all its columns, and ``held_out, score, predicted``, which take the place of columns of
    these names. Null and empty texts are scored by their statistics like any other; without labels every score is one
    half. The rules are fitted when called."""
    names = ("held_out", "score", "predicted")
    return with_score(docs.drop(*names), labels, bar, held_out_mod(5, 0) if held_out is None else held_out, names)


@query()
def op8_quality(spark, sf_dir):
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(
        "doc_id", "held_out", "score", "predicted")


def keep_good(spark, docs: DataFrame, sf_dir: str, bar: float = 0.3) -> DataFrame:
    """Pipeline stage: documents that the classifier does not reject, with the columns they came with."""
    names = unused(docs, "held_out", "score", "predicted")
    scored = with_score(docs, table(spark, sf_dir, "labels"), bar, held_out_mod(5, 0), names)
    return scored.where(F.col(names[2]) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])
