"""A training corpus from documents: stages in a row, each written and reread as the next one's input.

``STAGES`` names the stages; each takes the session, what its predecessor kept and the folder of
tables. All but the last return the columns of documents, whatever these are and are called.

Edge cases, for all stages. A null text is the empty text. An empty table gives an empty one. Equal
rows and ties are treated alike, but where a stage says otherwise. A null doc_id is a row like others.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from strandloom.llm import langid, mixing, packing, quality, simhash
from strandloom.llm.common import read, shared_folder
from strandloom.llm.queries import VOCABULARY, language_model, quality_model


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is identified, learned from those of ``docs`` that are not held
    out. Texts without letters go, and those whose cosine with their language's prototype is under
    what their number of n-grams lets expect (``langid.least_cosine``). Without any lang to learn from
    nothing is identified."""
    return langid.keep_identified(docs, language_model(docs))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the quality classifier accepts, learned from the labels of ``docs`` that are
    not held out. Null labels aren't learned from; without labels every text scores 0.5 and goes."""
    return quality.keep_good(docs, quality_model(docs, read(spark, sf_dir, "labels")), quality.THRESHOLD)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies. SimHash fingerprints are joined by tries and link at 2 or
    fewer differing bits, as in op 9; an exact check on five-word shingles follows (similarity 0.5 or more, so
    that a repeated line alone makes no copies). Texts whose fingerprints differ in more bits are near copies at a
    similarity of 0.8 or more. Kept is the smallest doc_id (and md5 of the text); rows without a doc_id stay."""
    return simhash.keep_one_near(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and leaves out documents so that sources have their target shares; a null source is a
    source of its own, and documents without words go."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids with their places in sequences of 2048; an empty text is its end id."""
    return packing.pack_documents(docs, VOCABULARY)


STAGES = [("language", language), ("quality", good), ("near_dedup", distinct), ("mix", mixed), ("pack", packed)]

#: The learned stages can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the stages' tables go to the shared checkpoint folder."""
    base = shared_folder(spark)
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{base}/corpus-{uuid.uuid4().hex}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
