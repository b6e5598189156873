"""A corpus pipeline: quality rules, line dedup, SimHash near-dedup, benchmark decontamination, encoding.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept. All but the last
return the columns of documents; the last adds the ids of every text. Columns besides doc_id and text are carried along.
An empty table gives an empty table in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.functions.session import delete_shared, shared_folder
from verdigris.llm import decontaminate, line_dedup, piece_codec, quality_rules, simhash
from verdigris.llm.queries import model_path, read


def _recounted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """n_chars follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*columns)


def keep_good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or the forest reject go. Null and empty texts have no words and go; repeated rows are judged alike."""
    return quality_rules.keep_good(docs, read(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated and nearly repeated lines go; the first (smallest doc_id, null before all, then place) stays.

    A document whose lines all go stays, empty. Null and empty texts stay as they are. Rows alike in id and text are one
    document and keep the same lines.
    """
    found = line_dedup.deduplicate_lines(docs)
    return _recounted(found.withColumn("text", line_dedup.kept_text()), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: the smallest doc_id (null after all others), then the smallest digest.

    Null, empty and blank texts are alike. Of rows alike in id and text one stays; texts that share an id without being
    near each other all stay.
    """
    return simhash.deduplicate(docs)


def remove_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words inside occurrences of test phrases go from the texts. Null texts stay null; no row goes, repeated ones included."""
    return _recounted(decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark")), docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the ids of their texts; null and empty texts have none. Columns named ids or n_tokens are replaced."""
    return piece_codec.with_ids(docs, model_path())


STAGES = [
    ("quality_rules", keep_good_documents),
    ("line_dedup", drop_repeated_lines),
    ("simhash", drop_near_duplicates),
    ("decontamination", remove_benchmark_passages),
    ("sentencepiece", encode),
]

#: SQL cannot express the forest or the encoding; the tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder, and deleted when the next is complete.

    The last, which the result reads, is deleted when the application ends.
    """
    folder = shared_folder(spark, "corpus_pipeline")
    docs, before = read(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}_{name}")
        docs = spark.read.parquet(f"{folder}/{k}_{name}")
        if before:
            delete_shared(spark, before)
        before = f"{folder}/{k}_{name}"
    return docs
