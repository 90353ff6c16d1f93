"""From raw documents to token ids: five stages, each a corpus operator at work on all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and
read again before the next one starts.  All but the last return the columns of their
input, whatever their names and however many, with all values but text and n_chars as they
were; the last one keeps the ids and adds the token ids.

Defined results for odd input, in every stage: an empty table stays empty; very long texts
are worked on whole.  Rows without an id count as rows of their own, known by their text.
Repeated rows: the near-duplicate stage keeps one; the others treat them alike, except that
the second of two equal texts is cut as a later copy.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrove.llm import decontaminate, golay_simhash, importance_resampling, piece_codec, suffix_dedup
from lexigrove.llm.common import materialise, table

#: Tokenizer file of the last stage; None takes the public one that is installed.
TOKENIZER = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Importance resampling against labelled good text; what the draw leaves goes, and with it texts without words.  Ties at the cut stay."""
    return importance_resampling.keep_good(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles alike to 0.8 or more) the row with the smallest doc_id stays.

    Null and blank texts are alike; of several texts with the smallest id the one with the least hash stays.
    """
    return golay_simhash.keep_one(docs, similarity=Fraction(4, 5), shingle=5)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of strings of 100 bytes are cut out; n_chars follows.  Null texts stay null."""
    found = suffix_dedup.remove_repeats(docs, report=False)
    return found.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else found


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go, all others stay as they are; null and blank texts are clean."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and the text read back from them; a null text has none and reads back empty."""
    path = TOKENIZER
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    found = piece_codec.encode_documents(docs, path, decoded="decoded")
    return found.select("doc_id", "lang", "source", "n_chars", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", F.col("decoded").alias("text"))


STAGES = [("quality classifier", quality), ("simhash near-dedup", near_copies), ("suffix-array dedup", repeats), ("benchmark decontamination", benchmark), ("sentencepiece", tokens)]

#: No SQL for the whole: SimHash, the drawn sample and the tokenizer are not SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = materialise(stage(spark, docs, sf_dir), f"stage{number}")
    return docs
