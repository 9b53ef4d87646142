"""The corpus pipeline: five stages over documents, each written and read again by the next.

Every function takes ``(spark, docs, sf_dir)`` and works on all rows that the stage before it kept.
All but the last give rows with the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postwatch.llm import byte_bpe, common, decontaminate, language, line_dedup, ngram_join
from postwatch.session import fresh_dir

#: A language that the network gives less than this is not taken for one.
LEAST_LANGUAGE_SCORE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in a language that the labelled rows teach. Null texts and texts without letters go."""
    return language.with_known_language(docs, language.learned(docs), LEAST_LANGUAGE_SCORE)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without the lines that another document of smaller id holds.

    A row that loses lines and has nothing but white space left is a copy, and goes. Null, empty and
    blank texts that lose nothing stay, repeated rows are judged alike.
    """
    return line_dedup.without_shared_lines(docs, keep_emptied=False)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, the one of the smallest id.

    Rows without an id are kept only where no row of their group has one. Rows without words stay.
    """
    return ngram_join.first_of_each(docs)


def drop_benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that share no ten words in a row with a benchmark item.

    Null and empty texts share nothing and stay, repeated rows are judged alike, and a benchmark
    without items takes nothing away.
    """
    return decontaminate.remove_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, n_tokens, ids binary, ids_sha256)`` of every row that is left.

    Null and empty texts have no tokens; repeated rows and null ids pass through.
    """
    return byte_bpe.encode(docs).select("doc_id", "n_tokens", "ids",
                                        F.sha2("ids", 256).alias("ids_sha256"))


STAGES = [
    ("language", identify_language),
    ("line_dedup", drop_shared_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", drop_benchmark_text),
    ("byte_bpe", encode_tokens),
]

#: Neither the network nor the encoding can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``, each stage's rows kept as Parquet."""
    docs = common.table(spark, sf_dir, "documents")
    path = fresh_dir(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
    return docs
