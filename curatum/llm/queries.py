"""Registered queries of the corpus operators: each over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import ann, bpe, centroids, licenses, linededup, matroska, minhash, mixing, ngram_lm, prefixtrie, quality, quotes, wrapper
from .support import table


def tokenizer_path() -> str:
    """The byte-level BPE file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    return ngram_lm.lm_score(table(spark, sf_dir, "documents"), held_out)


def op4_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.reply_ordered(table(spark, sf_dir, "conversations"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_deleted", "text")


def op6_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_matroska_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.read_back(matroska.media(table(spark, sf_dir, "documents")))


def op8_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.main_text(table(spark, sf_dir, "pages"))


def op9_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.node_table(table(spark, sf_dir, "documents"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_report(table(spark, sf_dir, "documents"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_report(table(spark, sf_dir, "embeddings"))


def quotation_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The former name of op4 over quotations of all levels, which op4 now is."""
    return op4_quotation_linking(spark, sf_dir)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_quality_classifier, op2_source_mixing, op3_lm_scoring, op4_quotation_linking, op5_line_dedup, op6_permutation_index, op7_matroska_packets, op8_wrapper_induction, op9_bpe_encoding, op10_minhash_near_dedup, op11_conversation_trie, op12_license_scan, op13_centroid_clustering, pipeline)}

#: Beside the numbered queries.
MORE = {"quotation_threads": quotation_threads}

ORACLES = {"op2_source_mixing": mixing.ORACLE, "op4_quotation_linking": quotes.ORACLE, "quotation_threads": quotes.ORACLE, "op11_conversation_trie": prefixtrie.ORACLE, "op12_license_scan": licenses.ORACLE, "op13_centroid_clustering": centroids.ORACLE}
