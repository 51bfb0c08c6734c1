"""From raw documents to packed training sequences: language, near copies, repeated passages, benchmarks, packing.

Each stage takes what its predecessor kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontaminate, jaccard_join, langid, packing, substring_dedup
from quarry.llm.common import apart, fold, materialize, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told, lang being the language told; what cannot be told goes.

    That are documents without a letter, and those none of whose n-grams is in any profile. Where no profile was learnt,
    all with a letter stay, and keep their lang.
    """
    training = F.col("lang").isNotNull() & F.coalesce(fold("doc_id", 5) != 0, F.lit(True))
    profiles = langid.learn_profiles(docs.where(training))
    (told,) = apart(docs, "lang_id")
    known = F.col(f"{told}.n_known" if profiles else f"{told}.n_grams") > 0
    lang = F.col(f"{told}.lang_pred").alias("lang") if profiles else F.col("lang")
    return langid.predict(docs, profiles, told=told).where(known).select(*[lang if c == "lang" else F.col(f"`{c}`") for c in docs.columns])


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least id."""
    return jaccard_join.one_of_each(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that stood before; those of which nothing is left go."""
    (told,) = apart(docs, "repeats")
    done = substring_dedup.deduplicate(docs, told=told)
    left = (F.col(f"{told}.n_removed") == 0) | (F.col(f"{told}.n_removed") < F.col(f"{told}.n_sentences"))
    size = F.length("text").cast("bigint").alias("n_chars")
    return done.where(left).select(*[size if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item's window occurs."""
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1,024 token ids."""
    return packing.pack(docs)


STAGES = [
    ("language_id", known_language),
    ("jaccard_join", one_of_near_copies),
    ("substring_dedup", without_repeats),
    ("decontamination", without_benchmarks),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Profiles, components and packing have no SQL form; tests/llm compares the stages with brute force.
ORACLE_SQL = None
