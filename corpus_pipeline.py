"""Corpus pipeline: from raw documents to token ids.

Stages, each written as Parquet and read again as the next one's input: language ID, line dedup, near-dedup (SimHash,
and MinHash for what lies beyond its two bits), mixing to target weights, byte-level BPE. All but the last return the
columns of ``documents``, and columns beyond those stay, whatever their names. Rows are documents: null or repeated ids are
allowed in every stage, empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm import bpe, language, line_dedup, minhash, mixing
from netloom.llm.common import held_out
from netloom.storage import materialize

#: Documents whose language is less sure than this are rejected.
LEAST_SCORE = 0.5


#: Columns that operators read; the others go through them under names of their own.
OWN = ("doc_id", "text", "lang", "source", "n_chars")


def _apart(docs: DataFrame) -> DataFrame:
    """``docs`` with neutral names for all columns that operators don't read, so that none is like one that they add."""
    return docs.toDF(*[c if c in OWN else f"extra{i}" for i, c in enumerate(docs.columns)])


def _back(done: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` of a table made from ``_apart(docs)``."""
    return done.select(*_apart(docs).columns).toDF(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose text is in a known language; ``und`` and unsure ones go.

    The model learns from the given languages of documents that aren't held out; ``lang`` stays as it is. Null, empty
    and letterless texts are ``und``. Repeated rows are judged alike. If no document has a language, none is known.
    """
    model = language.fit(docs.filter(~held_out(F.col("doc_id"))))
    judged = language.predict(_apart(docs), model, _apart(docs).columns)
    return _back(judged.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE)), docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete later copies of repeated line runs and single lines (the rule of op7_line_dedup). Documents stay, if with an
    empty text; a null text stays null. Rows that agree in id and text are one document and keep the same lines.
    """
    return _back(line_dedup.dedup_lines(_apart(docs), lone_words=line_dedup.LONE_WORDS), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group linked by a similarity of 0.8 or more of 5-word shingles: the smallest id, null last.

    Candidates are SimHash links and, beyond its two bits, MinHash keys; all are verified. Null, empty and blank texts are
    copies of each other. Unlike texts under one id, or without an id, all stay.
    """
    return _back(minhash.keep_one(_apart(docs)), docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mix sources to their targets: a row for each document and pass, with the words it gives.

    Documents without words give none and have no row; a null source is a source. Rows that agree in id, source and
    text are documents of their own and share the other columns of one of them, the same in every run.
    """
    return _back(mixing.mix_documents(_apart(docs)), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, with digests: ``doc_id`` and the added columns; others end here. A null text counts as empty."""
    import public_tokenizers

    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.encode_documents(docs, ranks, public_tokenizers.PATTERN)


STAGES = [("language_id", language_id), ("line_dedup", dedup_lines), ("near_dedup", near_dedup), ("mixing", mix), ("byte_bpe", encode)]

#: Language models and similarity of shingles are beyond SQL; tests hold the stages against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each but the last through a written table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
