"""From raw documents to packed training sequences, in five stages.

Each stage is a function of (spark, docs, sf_dir).  Its result is written as
Parquet and reread as the next one's docs; all but the last return the columns
of ``documents``.  Every stage takes an empty table, columns besides those of
``documents`` (of any name, which come back as they were), nulls in any column,
texts of any length, and rows that repeat, in the way that it says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm.common import named, table
from tidewire.llm.lines import line_dedup
from tidewire.llm.neardup import keep_one_of_each_class
from tidewire.llm.packing import pack_documents
from tidewire.llm.quality import quality_rules
from tidewire.llm.toxicity import fit_toxicity, score_toxicity
from tidewire.session import materialize_alone


def _carried(docs: DataFrame, *needed: str) -> DataFrame:
    """What an operator reads, and all other columns as one struct, so that no name of the caller's can clash with an added one."""
    rest = [named(c) for c in docs.columns if c not in needed]
    return docs.select(F.struct(F.lit(0).alias("_"), *rest).alias("_row"), *needed)


def _back(rows: DataFrame, docs: DataFrame, *needed: str, **changed: Column) -> DataFrame:
    """The columns of ``docs`` from rows that were ``_carried``, but for those ``changed``."""
    own = {c: F.col(c) if c in needed else F.col("_row").getField(c) for c in docs.columns}
    return rows.select(*(changed.get(c, x).cast(docs.schema[c].dataType).alias(c) for c, x in own.items()))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or lie far outside their language and source go.

    Null and empty texts fail it.  A null language or source is a value of its
    own.  Rows that repeat stay or go together.
    """
    needed = ("text", "lang", "source")
    return _back(quality_rules(_carried(docs, *needed), carry=("_row", *needed)).filter("kept"), docs, *needed)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a lexicon learned from ``labels`` calls toxic go.

    Null and empty texts hold no term and stay, as do rows without doc_id whose
    text is clean.  Rows that repeat stay or go together.
    """
    lexicon = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return _back(score_toxicity(_carried(docs, "text"), lexicon).filter("predicted = 0"), docs, "text")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines stay in one document; n_chars follows the text.

    A null text comes back as an empty one.  Rows that repeat a doc_id count as
    one document and are treated alike; a row without doc_id isn't changed.
    """
    text = F.col("kept_text")
    return _back(line_dedup(_carried(docs, "doc_id", "text")), docs, "doc_id", text=text, n_chars=F.length(text))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, that of least doc_id.

    Texts without words (null and empty ones too) are near nothing and stay.
    Of rows that repeat a doc_id one stays; rows without doc_id stay.
    """
    return keep_one_of_each_class(docs, 5, 0.8).select(*(named(c) for c in docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two lengths, each a sequence of its own.

    A null or empty text is the end id alone; rows that repeat give their
    pieces each time; columns besides doc_id and text are ignored.
    """
    return pack_documents(docs, 1024, 0)


STAGES = [
    ("quality rules", quality),
    ("toxicity", toxicity),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("packing", packing),
]

#: Learning, hashing and tokenization can't be said in SQL; a brute-force version is in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``: the last one's rows.  A stage's own scratch tables go once its result is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize_alone(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
