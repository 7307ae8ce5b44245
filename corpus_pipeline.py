"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of `documents`. Stages that change texts set n_chars anew. Rows with a null or empty text, without letters or words,
or in a table without rows are handled as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larchpoint.llm import langid, minhash, packing, pii, suffixdedup
from larchpoint.llm.common import shared_folder, table


def _with_length(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language, among those learned from the corpus; a text that fits several of them stays."""
    model = langid.fit(docs.where(~langid.fold_of_language(docs)).select("doc_id", "text", "lang"))
    found = langid.predict(docs, model)
    return found.where(F.col("lang_pred") != "und").select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of near copies; of rows that repeat an id and a text, one.

    Rows without an id are no copies of others, as nothing could name the group; all of them stay.
    """
    kept = minhash.near_duplicates(docs).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    named = docs.join(kept.hint("merge"), "doc_id").select(*docs.columns)
    nth = F.row_number().over(Window.partitionBy("doc_id", F.sha2("text", 256)).orderBy("doc_id"))
    return named.withColumn("__nth", nth).where("__nth = 1").drop("__nth").unionByName(docs.where("doc_id IS NULL"))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that also start elsewhere."""
    return _with_length(suffixdedup.without_repeats(docs))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data generalised and disclosing terms removed."""
    return _with_length(pii.sanitise(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [
    ("language", known_language),
    ("near_duplicates", one_of_each_group),
    ("repeats", without_repeats),
    ("personal_data", without_personal_data),
    ("packing", packed),
]

#: SQL can't express the tokenizer of the last stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = shared_folder(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
