"""A corpus pipeline over ``documents``: drop toxic and poor texts, keep one of each group of near-duplicates, mix, encode.

Every stage takes ``(spark, docs, sf_dir)`` and returns a table; all but the last return the columns of ``docs``. A stage's result is
written and read again before the next one starts, so a lost executor repeats at most one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.llm import bpe_automaton, mixing, quality_mil, simhash_golay, toxicity_mil
from locusframe.llm.common import materialise, table
from locusframe.llm.queries import MIX_EPOCHS, MIX_SEED, MIX_WEIGHTS, mix_domain, tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; texts without words score 0 and stay. Fitted on the labelled ones among ``docs``."""
    model = toxicity_mil.train(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity_mil.scorer(docs, model)(F.col("text")) < 0.5)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality scores 0.3 or more. Fitted on the labelled ones among ``docs``; without labels all stay."""
    model = quality_mil.train(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality_mil.scorer(docs, model)(F.col("text")) >= 0.3)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates.

    Rows that repeat an id are one document: it goes if any of them is linked to a smaller id, else the row of the smallest text stays.
    Rows without an id stay.
    """
    found = materialise(simhash_golay.near_duplicates(docs).where("doc_id is not null").groupBy("doc_id").agg(
        F.min("component_id").alias("least"), F.count(F.lit(1)).alias("n")))
    # stored, so that Spark knows their true sizes: short lists of ids are broadcast and no text is shuffled for them
    gone = materialise(found.where("least <> doc_id or n > 1").select("doc_id"))
    repeated = materialise(found.where("least = doc_id and n > 1").select("doc_id"))
    once = docs.join(gone, "doc_id", "left_anti")
    columns = docs.columns
    again = docs.join(repeated, "doc_id", "left_semi").select("doc_id", F.struct(F.col("text").alias("_t"), F.struct(*columns).alias("_row")).alias("_s"))
    first = again.groupBy("doc_id").agg(F.min_by("_s", F.coalesce("_s._t", F.lit(""))).alias("_s")).select("_s._row.*")
    return once.select(*columns).unionByName(first.select(*columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents picked for the target weights, once for each epoch that takes them; the total is the number of tokens there are.

    A document at which a budget ends stays whole, so a source exceeds its budget by less than one document.
    """
    picks = mixing.mix(docs, MIX_WEIGHTS, mix_domain(), epochs=MIX_EPOCHS, seed=MIX_SEED)
    return picks.select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of every picked document: ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""
    return bpe_automaton.round_trip(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("quality", keep_quality), ("near_duplicates", keep_one_of_each), ("mixing", mix_sources), ("bpe", encode)]

# Models, fingerprints and merges are beyond SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, over the whole documents table."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
