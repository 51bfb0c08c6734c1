"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import chat, decontaminate, html_extract, jaccard_join, langid, media, packing, prefix_trie, quality, resampling, simhash, substring_dedup, token_files
from quarry.llm.common import fold, materialize, table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql("SELECT * FROM VALUES " + ", ".join(f"({c}L, {t}L, '{r}', '{x}')" for c, t, r, x in chat.EXTRA) + " AS t(conv_id, turn, role, text)")
    return chat.digest(chat.format_turns(chat.ranked_branches(chat.replies(rows.unionByName(extra)))))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    return langid.identify(docs.select("doc_id", "text", "lang"), ~held_out).select("doc_id", held_out.alias("held_out"), "lang_id.lang_pred", "lang_id.score")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents")).drop("ids")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(fold("doc_id", 4) != 2).select("doc_id", F.col("quality").alias("label"))
    scored = quality.train_and_score(table(spark, sf_dir, "documents"), labels)
    return scored.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.features(materialize(media.store(table(spark, sf_dir, "documents")), "media"))
    digest = F.concat_ws(":", F.size("prints"), F.sha2(F.array_join("prints", ","), 256)).alias("feature")
    return found.select(*[c for c in found.columns if c != "prints"], digest)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring_dedup.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "repeats.n_sentences", "repeats.n_removed", "text")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages")).select("*", F.length("text").cast("bigint").alias("n_chars"))


def op11_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_copies(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_chat_formatting, op3_jaccard_join, op4_language_id, op5_token_files, op6_quality, op7_packing, op8_media_columns, op9_substring_dedup, op10_html_extraction, op11_simhash_dedup, op12_importance_resampling, op13_prefix_trie)}
ORACLES = {"op1_decontamination": decontaminate.SQL, "op2_chat_formatting": chat.SQL, "op12_importance_resampling": resampling.SQL, "op13_prefix_trie": prefix_trie.SQL}
