"""The corpus pipeline: quality rules, exact copies, near copies, repeated passages, packing.

Every stage takes the documents that the one before kept, with their columns as they are, and works on all of them. All
but the last return the columns that came, extra ones of any name included. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from purchaseflow.llm import exact_dedup, minhash, packing, quality_rules, suffix_dedup
from purchaseflow.llm.common import folders_made, remove, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the newest policy of the rule ledger. Null and empty texts have no words and go; null ids and
    repeated rows fare like any others; long texts are measured whole."""
    return quality_rules.keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal but for white space runs, the one with the smallest id. Null texts count as empty, a null id
    stays only where all of its group are null; rows that repeat an id and text stay or go together."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (five-word shingles, similarity 0.8 or more), the document with the smallest id.
    Texts without words and rows with a null id are linked with nothing and stay; rows that repeat the id that stays, too."""
    return minhash.drop_near(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 bytes or more that an earlier one has. The text is cut, n_chars follows; a
    document of which only white space is left goes, so null and empty texts do. Rows of one id, and null ids among
    each other, take nothing from each other; null ids come after all others."""
    found = suffix_dedup.cut_repeats(docs).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return found


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of permitted lengths, filled with the words of all documents: one row per piece of a document. Null
    texts have no words and are in no sequence; rows that repeat an id or have none are packed as documents of their own."""
    return packing.best_fit(docs, packing.word_count())


STAGES = [("quality_rules", quality), ("exact_dedup", exact), ("near_dedup", near), ("suffix_dedup", passages), ("packing", packed)]

#: Near copies, passages and best fit are beyond SQL over whole tables; the tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next. Once a stage's rows are written, its own
    intermediate tables and the rows of the stage before go."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        with folders_made() as made:
            docs = written(spark, stage(spark, docs, sf_dir), name)
        remove(spark, [*before, *made[:-1]])
        before = made[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
