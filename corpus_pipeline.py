"""A training corpus from raw documents, in five stages.

Each stage is (spark, docs, sf_dir) -> DataFrame over all that its predecessor
kept. ``run`` writes each stage's result to the shared folder and reads it back
as the next one's ``docs``; all but the last keep the columns of ``documents``.
When a stage's result is written, what was staged for it is removed, and so is
the result before it.

Cases: null and empty texts pass the filters and are one end token each; rows
without doc_id are treated by their text as all others (they are no labelled
rows); of repeated rows one stays; rows of one doc_id with different texts stay
apart; texts of any length are read whole; an empty table gives an empty result;
extra columns, however they are named, are kept up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from claimhound.llm.decontamination import without_overlaps
from claimhound.llm.jaccard import one_of_each
from claimhound.llm.mixing import poisson_mix
from claimhound.llm.staging import new_path, step, table, written
from claimhound.llm.token_files import wavelet_tokens
from claimhound.llm.toxicity import toxicity_model, without_toxic
from claimhound.sources.shared import remove_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return without_toxic(docs, toxicity_model(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that the n-gram Jaccard join connects."""
    return one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no passage with the benchmark."""
    return without_overlaps(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated, by Poisson counts, to the sources' target weights."""
    return poisson_mix(docs, number_copies=False)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shards of token ids; returns their index of documents, read from the files."""
    return wavelet_tokens(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_output", write_tokens),
]

#: Learning, similarity and tokens cannot be expressed in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = new_path(spark, f"corpus-{name}")
        with step(spark):
            docs = written(stage(spark, docs, sf_dir), path)
        if last:
            remove_folder(spark, last)
        last = path
    return docs
