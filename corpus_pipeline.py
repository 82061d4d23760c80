"""From raw documents to packed token sequences, by five of the corpus operators.

Each stage works on all documents the one before it kept, written as Parquet and read again. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica.llm import decontaminate, language_crf, line_dedup, minhash, packing
from episodica.llm.base import stage, table
from episodica.llm.queries import word_bpe

#: A document stays if the words' mean posterior for its language reaches this.
LEAST_SCORE = 0.5
#: Documents whose runs of five words have this Jaccard similarity, in hundredths, are near copies.
SIMILAR_PERCENT = 80
END_ID = 2


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters and those in which no language holds half of the words.

    Null and empty texts go, repeated rows stay or go alike, an empty table stays empty. The input's columns are packed
    into one meanwhile, so columns of any name (``score`` too) come back as they were.
    """
    whole = F.struct(*[docs[f"`{c}`"].alias(f"c{k}") for k, c in enumerate(docs.columns)]).alias("whole")
    scored = language_crf.predict(docs.select(whole, "text"), language_crf.train(docs), carried=["whole"])
    kept = scored.where((F.col("lang_pred") != language_crf.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.select(*[F.col(f"whole.c{k}").alias(c) for k, c in enumerate(docs.columns)])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that are near copies of an earlier line, and documents of which nothing is left.

    Null texts stay, of equal lines the first by (doc_id, place) stays, ``n_chars`` follows the text where the table has it.
    """
    kept = line_dedup.clean(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else kept


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest doc_id; texts without words all stay."""
    return minhash.deduplicate(docs, percent=SIMILAR_PERCENT)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which a twentieth or more lies in passages of the benchmark; texts without words stay."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of powers of two, with their ids; an empty text holds its end id alone."""
    return packing.pack(docs, word_bpe(), END_ID)


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("benchmark", benchmark),
    ("packing", pack),
]

#: A trained model and a tokenizer are beyond SQL. The tests call the stages in a row and check columns, counts and the sum of tokens;
#: they rebuild no result of the whole pipeline, and ``run`` itself is called by none.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
