"""Corpus preparation in five stages, from quality to packed windows.

1. ``quality``: documents that the classifier rejects go.
2. ``lines``: lines that many documents share go, save in their largest doc_id.
3. ``near``: one document of each class of near duplicates stays.
4. ``substrings``: passages that occur more than once go.
5. ``packing``: the rest is cut into tokens and packed into windows.

Each stage reads what its predecessor wrote, whole.  All but the last return the
columns of ``documents``; the last returns the pieces with their windows.  No SQL
can train the classifier or run the tokenizer, so the pipeline is tested against
a brute-force version on small tables instead.

Defined results, for every stage
--------------------------------
Nulls in any column, also in ``doc_id``, are values like any other and stay.  Null and
empty texts are judged by ``quality`` like any text, have one empty line in ``lines`` (which
makes a null text the empty one), are alone in their class in ``near`` (all of them stay),
have no words in ``substrings``, and the end token alone in ``packing``.  Very long texts
take part whole.  Rows equal in id and text are one document for ``lines``, one of them
stays in ``near``.  Ties between classes go to the least doc_id.  An empty table gives an empty
one, and without labels ``quality`` keeps all.  Columns beyond those of documents are left out.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.frames import take
from cadenza.llm.line_dedup import line_dedup
from cadenza.llm.ngram_join import keep_one
from cadenza.llm.packing import pack
from cadenza.llm.quality_model import quality_model
from cadenza.llm.storage import cut, free, made
from cadenza.llm.substring_dedup import substring_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def measured(docs: DataFrame) -> DataFrame:
    """The columns of documents, with the length of the text as it is now."""
    own = take(docs, *COLUMNS)
    return own.withColumn("n_chars", F.char_length("text").cast("long"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_model(take(docs, *COLUMNS), labels).filter("predicted = 1").select(COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return measured(line_dedup(take(docs, *COLUMNS)))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(take(docs, *COLUMNS))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return measured(substring_dedup(take(docs, *COLUMNS)))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("lines", lines), ("near", near), ("substrings", substrings), ("packing", packing)]

#: The first stage trains a model and the last runs a tokenizer: SQL expresses neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; every stage's table is written to the shared folder and read again.

    What a stage wrote for itself, and its input, is deleted when its result is written.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first = len(made(spark))
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
            free(spark, first, keep=1)
    return docs
