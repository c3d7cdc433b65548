"""Registered queries of the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table
from .bpe import bpe_digests
from .chat import preference_pairs
from .jaccard import jaccard_classes
from .maxent import score_documents
from .mixing import mixture
from .oracles import CHAT_SQL, MIX_SQL, TOPK_SQL
from .quality import weak_quality
from .sharding import balanced_shards
from .suffixes import cut_repeats
from .topk import exact_top_k
from .toxicity import toxicity


def op1_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read_table(spark, sf_dir, "documents"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixture(read_table(spark, sf_dir, "documents"), flatten=0.5, max_passes=2.0)
    return out.select("doc_id", "source", F.col("mix_pass").cast("long").alias("mix_pass"), "n_tokens", "mix_block", "mix_block_key", "mix_row_key")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(read_table(spark, sf_dir, "documents"), n=3, percent=90)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the passages of 50 words or more that an earlier document has; spans as text, lo:hi in words."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = cut_repeats(docs, min_words=50)
    spans = F.array_join(F.transform("cut_spans", lambda s: F.concat_ws(":", s["lo"].cast("string"), s["hi"].cast("string"))), ",")
    return out.select("doc_id", "n_words", "n_cut_words", spans.alias("cut_spans"), F.sha2(F.col("cut_text").cast("binary"), 256).alias("cut_sha256"))


def op5_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = weak_quality(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(read_table(spark, sf_dir, "documents"), vocab_path())


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(read_table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(50)) == 0, k=5)


def op8_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced_shards(read_table(spark, sf_dir, "documents"), shards=8)


def op9_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2k (chosen) and 2k+1 (rejected) are pair k; spans as text, start:end."""
    talks = read_table(spark, sf_dir, "conversations")
    out = preference_pairs(talks, F.floor(F.col("conv_id") / 2), F.pmod("conv_id", F.lit(2)) == 0)
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",").alias(c)
    return out.select("pair_id", "chosen_id", "rejected_id", "n_prompt_turns", "prompt", "chosen", "rejected", spans("chosen_spans"), spans("rejected_spans"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def vocab_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def queries() -> dict:
    own = [op1_maxent_lm, op2_mix_sources, op3_jaccard_join, op4_suffix_dedup, op5_weak_quality, op6_bpe, op7_exact_top_k, op8_balanced_shards, op9_preference_pairs, op10_toxicity]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op2_mix_sources": MIX_SQL, "op7_exact_top_k": TOPK_SQL, "op9_preference_pairs": CHAT_SQL}
