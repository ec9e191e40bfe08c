"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
it as Parquet in the shared folder and gives the reread table to the next one.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outfold.llm import decontaminate, langid, minhash, packing, pii
from outfold.llm.common import Workspace
from outfold.llm.queries import DEMO_KEY, tokenizer_path
from outfold.plans.registry import table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in none of the learned languages go: null, without a letter, or
    coded so badly by every language that it is another script or noise
    (``langid.rejected``). The languages are learned from the labelled documents
    that are not held out; without any, only null and letterless documents go."""
    model = langid.fit(docs.where(~langid.held_out()))
    if not model.langs:
        return langid.with_letter(docs)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return langid.predict(docs, model, row).where(~langid.rejected(F.col("kept.text"))).select("kept.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the
    smallest id: five words, similarity 0.8. Documents without words or without
    an id stay. A document is its id and its text, so rows that only share an id
    are judged apart; rows equal in both stay or go together."""
    ws = Workspace(spark, "neardup")
    row = F.xxhash64("doc_id", "text")
    found = minhash.near_duplicates(docs.select(row.alias("_row"), "text"), words=5, percent=80, id_col="_row")
    found = ws.save(found.where("n_shingles > 0").select("_row", "component_id").distinct(), "found")
    several = found.groupBy("component_id").agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    found = ws.save(found.join(several, "component_id"), "several")
    ids = docs.where("doc_id is not null").select(row.alias("_row"), "doc_id")
    named = ws.save(ids.hint("merge").join(found, "_row"), "named")
    first = named.groupBy("component_id").agg(F.min(F.struct("doc_id", "_row")).alias("_first"))
    gone = ws.save(named.join(first, "component_id").where(F.struct("doc_id", "_row") != F.col("_first"))
                   .select(F.col("_row").alias("_gone_row")).distinct(), "gone")
    return docs.hint("merge").join(gone, row == gone["_gone_row"], "left_anti")


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal numbers, dates, addresses and tokens are replaced in place."""
    return pii.pseudonymise(docs, DEMO_KEY)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences of 4096 tokens."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", clean_of_benchmark),
    ("pseudonyms", pseudonyms),
    ("packing", packed),
]

#: The stages are hashed, learned or iterative; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    ws = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = ws.save(stage(spark, docs, sf_dir), name)
    return docs
