"""From raw documents to packed training sequences.

Stages, in order: documents of no recognised language go; toxic ones go; of each group of near copies
one stays; sources are interleaved to target weights; token sequences are packed. All but the last
return the columns of documents. Each learns only from its own input (and labels), reads whole texts,
and its result is written before the next one begins, so a lost executor costs no more than its tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm import common, langid, mixing, packing, toxicity
from heddle.llm import near_copies as shingled

#: SQL can't express the fitted models, XXH64 fingerprints and token ids; tests hold the stages against brute force.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those without a letter go, and those that no language gets half of."""
    return langid.keep_known(docs, langid.fit(docs))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, common.read(spark, sf_dir, "labels")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies (Jaccard similarity of five-word shingles >= 0.8) the document with the smallest id."""
    return shingled.keep_first(docs)


#: Target weights of sources; None: by their document counts.
WEIGHTS: dict[str | None, float] | None = None


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in an order that interleaves sources to their target weights."""
    return mixing.mix(docs, WEIGHTS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document, with its place in a sequence of at most 1024 ids.

    Sequences follow the mixed order. Files keep no order of rows, so it is taken from the sources again.
    """
    return packing.pack(docs, places=common.stored(mixing.places(docs, WEIGHTS), "mixed_places"))


STAGES = [
    ("language ID", language),
    ("toxicity", toxic),
    ("SimHash near-dedup", near_copies),
    ("mixing", mixed),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents, each but the last written to the shared folder and read again."""
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
