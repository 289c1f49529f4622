"""The training-data pipeline: five stages, each over all that its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's docs; all but the last return the columns of
documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from millrace.llm import mixing, packing, pii, simhash, toxicity
from millrace.llm.common import stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; labels of rows that are not held out are learnt from.

    Null or empty text scores as a text without evidence does, and stays. Very long texts are scored whole. A null
    doc_id is never learnt from; repeated rows are each scored; a score equal to the threshold goes. An empty table
    gives no rows. Other columns, whatever their names, are carried along.
    """
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the least doc_id.

    Null, empty and blank texts are copies of each other. A null doc_id comes last, and a group of nulls alone keeps
    one row too. Ties of doc_id go by the text's hashes; repeated rows are one. An empty table gives no rows. Other
    columns, whatever their names, are carried along.
    """
    return simhash.deduplicate(docs)


def redact_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to the name of its kind; n_chars follows the text.

    A null text stays null, an empty one empty. Texts are read whole, repeated rows each on their own. An empty table
    gives no rows. Other columns, whatever their names, are carried along.
    """
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the targets of their sources take them.

    Null, empty and blank texts have no words and are never taken. A null source is one of its own; a null doc_id draws
    as the empty string does. Ties go by doc_id, then the text's hash; repeated rows each count. The one document on
    which a source's budget ends is cut to it. An empty table gives no rows. Other columns, whatever their names, are
    carried along.
    """
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: a row for each piece of a document, with its token ids (little-endian unsigned 32-bit).

    A null or empty text is the closing id alone; texts of any length are cut into pieces, never dropped. A null doc_id
    is kept as null; rows that mixing repeats are packed each on their own. An empty table gives no rows.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), keep_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("pii", redact_private),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Toxicity, personal data and token ids are no matter for SQL; tests hold run() against plain Python.
ORACLE_SQL = None
