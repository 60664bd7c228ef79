"""From documents to packed sequences: five stages, each over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estrado.llm import langid, mixing, packing, simhash, suffixes
from estrado.llm.common import written
from estrado.llm.tokens import default_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document is rejected if no language holds this mean posterior, or if it has no letters.
LANGUAGE_SCORE = 0.4
#: Two documents are near-duplicates if they have this share of shingles of so many words in common.
SHINGLE_WORDS = 5
SIMILARITY = 0.8


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that is recognised; lang stays what the table says.

    A null text, or one without a letter, is in none and goes. Texts of any length are labelled word by word to their end, so one that switches between
    languages stays if one of them holds LANGUAGE_SCORE of it. Nulls in other columns, and rows that repeat, are no matter. An empty table keeps nothing.
    """
    field = langid.fit(docs.select("doc_id", "text", "lang"))
    kept = langid.predict(docs.select(*COLUMNS), field)
    return kept.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LANGUAGE_SCORE)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays whose texts are linked by four fifths or more of their shingles of five words.

    It is that of the smallest doc_id; a null doc_id comes after all others, of rows that share it the text of the least hash stays, of equal rows any. Texts
    without words are one group, texts of fewer than five words are one shingle. An empty table stays empty.
    """
    return simhash.keep_one(docs.select(*COLUMNS), n=SHINGLE_WORDS, similarity=SIMILARITY)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes or more that a smaller doc_id has already go; bytes of a character cut in two go with it.

    A null text comes back empty. Rows that share a doc_id are judged alike against smaller ids and never against each other, a null doc_id counts as the
    largest. Documents stay even where nothing is left of them. n_chars is counted anew. An empty table stays empty.
    """
    docs = docs.select(*COLUMNS)
    cut = suffixes.remove_repeats(docs, extra=("lang", "source"))
    return cut.select("doc_id", suffixes.text_of("kept").alias("text"), "lang", "source").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it.

    Texts without words are never taken. A null source is a source of its own; rows that are equal in all columns draw once each. An empty table stays empty.
    """
    return mixing.apply_mix(docs.select(*COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places.

    A null text counts as empty and is its end id alone. Rows that repeat are packed as often as they stand there, a null doc_id like any other; only texts of
    more than the capacity are cut. An empty table gives no rows.
    """
    return packing.pack(docs.select("doc_id", "text"), default_path())


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mix", mix),
    ("pack", pack),
]

#: No SQL has the tokenizer, the field or the hashes; tests/llm holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
