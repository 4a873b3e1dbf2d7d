"""A corpus from raw documents: quality selection, line dedup, near-duplicate removal, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet to the shared folder and reads
it back as the next stage's docs. All but the last return the columns of documents; n_chars follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyweft.llm.common import documents, row_keyed, saved
from storyweft.llm.lines import drop_repeated_lines
from storyweft.llm.mixing import mix, mixture
from storyweft.llm.neardup import near_duplicates
from storyweft.llm.packing import pack, token_pieces
from storyweft.llm.quality import fit_quality

PERCENT = 80  # similarity from which documents count as near duplicates


def _measured(docs: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of `like`, n_chars counted anew where there is one."""
    if "n_chars" in like.columns:
        docs = docs.withColumn("n_chars", F.char_length("text").cast(like.schema["n_chars"].dataType))
    return docs.select(*like.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the draw leaves out go. Null and empty texts weigh 0 and are drawn like others; rows of one id and
    text stand or fall together, rows of a null id share one noise; without good labels, or documents, all stay."""
    return fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).apply(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from every document but the first holder; a document may end up empty but stays, a null text
    stays null. Rows of one id are one holder; rows of a null id keep all lines."""
    return _measured(drop_repeated_lines(docs), docs)


def near_duplicate_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the row of least id stays; documents without words are in no group and stay. Rows of a repeated or
    null id are documents of their own, the latter coming last."""
    keyed, key = row_keyed(docs)
    gone = near_duplicates(keyed, PERCENT, id_col=key).filter("NOT kept").select(F.col("doc_id").alias(key))
    return keyed.join(gone, key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each taking of a document; documents without words, and those that are not taken, go; the last of a
    source may be cut. Rows of a repeated or null id are documents of their own; a null source is a source."""
    keyed, key = row_keyed(docs)
    if key == "doc_id":
        return _measured(mixture(docs, mix(docs)[2]), docs)
    return _measured(mixture(keyed, mix(keyed, uid_col=key)[2], id_col=key, key="uid"), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences with their places. row tells takings apart: each row of docs is packed for itself, with
    a null id or text too (the latter as empty)."""
    row = "row"
    while row in docs.columns:
        row += "_"
    return pack(token_pieces(docs.withColumn(row, F.monotonically_increasing_id()), row_col=row))


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_duplicates", near_duplicate_removal), ("mixing", mixing), ("packing", packing)]

#: The stages draw at random, compare sets and tokenize; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
