"""A corpus cleaned and packed for training: five stages, each written as Parquet and reread.

A stage is (name, function of (spark, docs, sf_dir)) and works on all that its predecessor
kept; all but the last return the columns of ``documents``.
"""

from quercus.llm import decontamination, jaccard_join, packing, substring_dedup, toxicity
from quercus.workspace import Workspace


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark, docs, sf_dir):
    """Documents whose nearest labelled examples call them toxic go."""
    return toxicity.kept(docs, _table(spark, sf_dir, "labels"), Workspace(spark))


def drop_near_duplicates(spark, docs, sf_dir):
    """One document of each group of near-duplicates stays."""
    return jaccard_join.one_of_each(docs, Workspace(spark))


def cut_repeats(spark, docs, sf_dir):
    """Passages that an earlier document holds are cut out."""
    return substring_dedup.deduplicated(docs)


def cut_benchmark(spark, docs, sf_dir):
    """Passages of the benchmark are cut out."""
    return decontamination.decontaminated(docs, _table(spark, sf_dir, "benchmark"), Workspace(spark))


def pack(spark, docs, sf_dir):
    """The pieces of the packed sequences, with their token ids."""
    return packing.packed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("decontamination", cut_benchmark),
    ("packing", pack),
]

#: Nearest neighbours and a tokenizer are beyond SQL; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``; returns the last one's rows as written."""
    ws = Workspace(spark)
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = ws.table(stage(spark, docs, sf_dir), name)
    return docs
