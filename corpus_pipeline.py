"""A corpus pipeline: toxic and poor documents go, near duplicates and contaminated documents go, what stays is mixed.

Each stage takes (spark, docs, sf_dir), where docs is all that the stage before kept, and decides about every row of it; labels and
benchmark items come from sf_dir. Every stage but the last returns the columns of documents, whatever they are.

Defined results are those of the operators: a null or empty text is judged like any other, stays its own group and matches no
benchmark item; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from onceflow.llm.common import materialize, table
from onceflow.llm.decontam import drop_contaminated
from onceflow.llm.jaccard import drop_near_duplicates
from onceflow.llm.mixing import mix
from onceflow.llm.quality import drop_poor
from onceflow.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.5."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of 0.3 and more."""
    return drop_poor(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group whose five-word shingles link at a similarity of 0.8 and more."""
    return drop_near_duplicates(docs, k=5, num=80, den=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within its edit budget."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes; sources weigh 3, 1, 2, repeating, and share 150% of all words."""
    return mix(docs, weights=[3, 1, 2], share=1.5, most=2)


STAGES = [
    ("toxicity", toxicity),
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: The classifiers, the join and the edit matching are beyond SQL. Tests hold near duplicates, decontamination and mixing against brute force, and the classifiers' stages
#: against their scores, whose features, sums and thresholds are tested in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
