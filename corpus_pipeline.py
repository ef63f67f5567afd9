"""From documents to packed training sequences in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes every
stage as Parquet in the shared work folder and reads it again for the next one.  All
but the last return the columns of ``documents``:

1. ``quality``: documents that the base rules or the tokeniser bands reject go;
2. ``near_duplicates``: one document of each group of near copies stays, the one with
   the smallest id (rows that repeat it are one);
3. ``passages``: bytes of passages that occur elsewhere go, ``n_chars`` follows;
4. ``secrets``: every span found is replaced by the name of its kind in brackets,
   ``n_chars`` follows;
5. ``packing``: the remaining texts are tokenised and packed.

Defined cases: documents without text fail the quality rules, so they go; a null id
never makes documents equal; columns that ``documents`` has beyond those named here
are carried through unchanged, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipsight.llm import bestfit_packing, fertility, oph_dedup, secret_scan, suffix_dedup
from clipsight.llm.queries import PIECE_VOCABULARY, WORD_VOCABULARY
from clipsight.llm.shared import tables, work_folder


def _with_length(docs: DataFrame) -> DataFrame:
    """``n_chars`` as the text now has it, where the table carries it."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return fertility.kept_rows(docs, public_tokenizers.path(PIECE_VOCABULARY))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return oph_dedup.kept_rows(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with_length(suffix_dedup.deduplicated(docs))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with_length(secret_scan.redacted(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bestfit_packing.pack_documents(docs, public_tokenizers.path(WORD_VOCABULARY))


STAGES = [
    ("quality rules", quality),
    ("MinHash near-dedup", near_duplicates),
    ("suffix-array dedup", passages),
    ("secret scans", secrets),
    ("best-fit packing", packing),
]
#: Tokenisation and packing have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = tables(spark, sf_dir, "documents")
    folder = work_folder(spark)
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/stage-{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
