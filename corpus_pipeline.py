"""Corpus pipeline: toxic documents go, near copies go, repeated passages go, sources are mixed, texts are encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.bpe import bpe_encode
from marlstone.llm.common import drop, stash
from marlstone.llm.jaccard import one_of_each
from marlstone.llm.mixing import mixture
from marlstone.llm.queries import vocab_path
from marlstone.llm.suffixes import cut_repeats
from marlstone.llm.toxicity import score_toxicity, toxicity_model
from marlstone.sources.tables import read_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOXIC, SHINGLE_WORDS, JACCARD_PERCENT, PASSAGE_WORDS = 0.7, 5, 80, 50


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.7; learned from the labels of documents that aren't held out."""
    model = toxicity_model(docs, read_table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model, score_col="__score").filter(F.col("__score") < TOXIC).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of 5-word shingles at a Jaccard similarity of 0.8 connect, the one with the least id stays.

    Documents without words stay. Of rows equal in id and text one stays; rows that bear a kept id but another text stay
    or go by that text.
    """
    return one_of_each(docs, n=SHINGLE_WORDS, percent=JACCARD_PERCENT).select(*COLUMNS)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document has are cut; a document left without words goes."""
    out = cut_repeats(docs.select(*COLUMNS), min_words=PASSAGE_WORDS)
    out = out.filter((F.col("n_cut_words") == 0) | (F.col("n_cut_words") < F.col("n_words")))
    changed = F.col("n_cut_words") > 0
    return out.select(
        "doc_id", F.when(changed, F.col("cut_text")).otherwise(F.col("text")).alias("text"), "lang", "source",
        F.when(changed, F.length("cut_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"),
    )


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at flattened shares: every document at least once, those of small sources up to twice."""
    return mixture(docs, flatten=0.5, max_passes=2.0, keep=COLUMNS).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (packed little-endian 32-bit) of each text, their number, and a digest of what they decode to."""
    out = bpe_encode(docs, vocab_path(), ids_col="ids", decoded_col="decoded", keep=["doc_id", "source"])
    return out.select("doc_id", "source", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("suffix_array_dedup", cut_passages),
    ("mix_sources", mix_sources),
    ("bpe", encode),
]

#: A learned lexicon, links without bound and token merges can't be put in SQL; tests run brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over the documents, each written to the shared folder and read again by the next."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        after = stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
        drop(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
