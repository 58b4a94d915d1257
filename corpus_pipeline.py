"""A training corpus from ``documents``, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one
before it kept; its result is written as Parquet and read again as the
next one's ``docs``.  All but the last return the columns of ``docs``.

1. language_id: documents without a language (``und``: null texts, texts
   without letters) go; ``lang`` becomes the prediction.  Short or mixed
   texts stay, whatever their score.
2. near_dedup: one document of each class of near copies stays.
3. secrets: secrets in the texts are replaced by a placeholder.
4. mix: sources are brought to their target weights; a document comes
   once for each round that takes words of it, with those words.
5. bpe: the documents' token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lifetrail.llm import bpe, language_id, mixing, near_dedup, secrets
from lifetrail.llm.common import TOKENIZER, WRITTEN, drop_written, materialise, ship, table

#: Words of a block of the mix; longer than the operator's default, to keep passages whole.
MIX_BLOCK_WORDS = 512

ORACLE_SQL = None


def _recount(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; ``lang`` becomes the prediction.

    Null, empty and letterless texts go; very long ones are read whole; ties
    go to the language that sorts first; repeated rows and null ids stay as
    they are; own columns pass through whatever their names; an empty table
    gives no rows."""
    ship(spark)
    columns = docs.columns
    model = language_id.train(language_id.training_rows(docs))
    prefix = "language_id_"
    while any(c.lower().startswith(prefix) for c in columns):  # the documents' own columns pass through
        prefix += "_"
    pred = f"{prefix}lang_pred"
    found = language_id.annotate(docs, model, prefix).where(F.col(pred) != language_id.UND)
    return found.withColumn("lang", F.col(pred)).select(*columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the smallest ``doc_id``
    (null ids last), of rows that share it the first.

    Null texts are no copies of each other and stay; empty texts are equal;
    very long texts are compared whole; own columns pass through whatever
    their names and types; an empty table gives no rows."""
    ship(spark)
    return near_dedup.representatives(docs)


def replace_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the union of the found spans replaced by a placeholder.

    Null and empty texts stay as they are; very long ones are scanned whole;
    overlapping spans are one; repeated rows are scanned one by one; own
    columns pass through; an empty table gives no rows."""
    ship(spark)
    return _recount(secrets.redact(docs, secrets.train(secrets.labelled_tokens(docs))))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, once for each round, with the words it takes.

    Texts without words are never taken; the null source is a source of its
    own; repeated rows and equal places are ordered by a seeded hash; very
    long texts may be taken in part, by whole blocks; own columns pass
    through whatever their names; an empty table gives no rows."""
    ship(spark)
    return _recount(mixing.mixed_documents(docs, block_words=MIX_BLOCK_WORDS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids`` of every row, in whole texts.

    Null and empty texts have no ids; repeated rows are encoded one by one;
    other columns go; an empty table gives no rows."""
    ship(spark)
    return bpe.encode(docs, TOKENIZER).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_copies),
    ("secrets", replace_secrets),
    ("mix", mix_sources),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``.  What a stage wrote for itself, and its
    input, are deleted once its result is written."""
    docs = table(spark, sf_dir, "documents")
    before = len(WRITTEN)
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        drop_written(spark, before, keep=WRITTEN[-1])
    return docs
