"""A training corpus from ``documents``: clean, deduplicate, mix, pack.

Stages, each over all rows that the one before kept, written as Parquet in
between: toxic documents go; later copies of line runs are cut (a document that
loses every line goes); of near-duplicate documents (a Jaccard of 0.8 over five
words, where op10 has 0.85 over four) one stays; sources are mixed
to their target weights, with repeats; the result is packed into sequences. All
but the last return the columns of ``documents``; the last returns one row for
each packed piece with its text, so that a sequence is the texts of its bin by
``bin_offset``, and a ``row`` that tells copies of one document apart.

Defined results: texts that are null or have no word pass the first three stages
as they are (no score, no lines, an empty set), and mixing leaves them out or in
with size 0; rows with null ids and repeated rows are rows like others, but that
one of several equal texts stays; texts of any length are read whole; ties go by
id, then by text hash (in mixing, by a hash of all columns); further columns pass through all stages but the last,
whatever their names; empty input gives empty output at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from subtide.llm import line_dedup, mixing, ngram_jaccard, packing, queries, toxicity
from subtide.llm._tables import written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean_rows(docs, queries.toxicity_model(spark, docs, sf_dir))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_rows(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_jaccard.keep_one(docs, n=5, pct=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_rows(docs)


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_texts(docs, queries.TOKENIZER)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard", drop_near_copies),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_bins),
]

#: A trained classifier decides the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
