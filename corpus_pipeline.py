"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next.

Documents of low quality go, one of each group of near duplicates stays, passages that repeat across documents are taken
out of the later ones, documents that contain benchmark items go, and the rest is mixed to the weights of its sources.
Every stage does its whole work on what the one before kept.
"""

from functools import wraps

from pursuit.llm.decontaminate import without_leaks
from pursuit.llm.mixing import mixed
from pursuit.llm.ngram_join import keep_first
from pursuit.llm.quality import keep_good
from pursuit.llm.suffix_dedup import without_repeats
from pursuit.staging import staged, sweep


def swept(stage):
    """The stage after a collection on the driver, which frees what the plans of the stage before it held, and the shuffle
    files behind them."""
    @wraps(stage)
    def run_stage(spark, docs, sf_dir):
        sweep(spark)
        return stage(spark, docs, sf_dir)
    return run_stage


STAGES = [
    ("quality classifier", swept(keep_good)),
    ("n-gram Jaccard join", swept(keep_first)),
    ("suffix-array dedup", swept(without_repeats)),
    ("benchmark decontamination", swept(without_leaks)),
    ("mixing sources to target weights", swept(mixed)),
]

# trained weights and similarity joins cannot be said in SQL; tests/llm/test_pipeline.py compares what every stage keeps with a
# plain version of it (the repeats' texts by their length)
ORACLE_SQL = None


def run(spark, sf_dir):
    """The rows the last stage leaves of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
