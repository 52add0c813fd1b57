"""Language identification: known words first, then shorter and shorter character n-grams.

A word that the model knows scores by its log frequency in each language. An unseen word backs off: of
its character n-grams (the word's ends count as characters) the longest length with any known n-gram
counts, by the mean log frequency of those known. A text's language is the one with the largest sum.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import materialize
from .common import bounded_batches, held_out, sampled, steps, table, words_of

#: Training documents at most (about), words kept for each language, n-grams kept for each language and
#: length, longest n-gram. They bound the model, whatever the corpus.
TRAIN_DOCS, WORDS, GRAMS, LONGEST = 20_000, 40_000, 10_000, 4
#: A text counts as at most so many words in ``score``, so that long texts keep a graded confidence.
EVIDENCE_WORDS = 8
UNKNOWN = "und"
NO_LETTERS = r"[^\p{L}]+"


@dataclass
class LanguageModel:
    """``words`` and ``grams[k]`` give the row of ``word_logs`` and ``gram_logs[k]``, one column a language."""

    languages: list[str]
    words: dict[str, int]
    word_logs: np.ndarray
    grams: dict[int, dict[str, int]]
    gram_logs: dict[int, np.ndarray]

    def score(self, words: list[str]) -> np.ndarray:
        """Log score of each word in each language."""
        out = np.zeros((len(words), len(self.languages)))
        at = np.fromiter((self.words.get(w, -1) for w in words), np.int64, len(words))
        known = at >= 0
        out[known] = self.word_logs[at[known]]
        rest = np.flatnonzero(~known)
        for k in sorted(self.grams, reverse=True):
            if not len(rest):
                break
            find = self.grams[k].get
            owner, rows = [], []
            for r in rest.tolist():
                word = f"^{words[r]}$"
                found = [g for i in range(len(word) - k + 1) if (g := find(word[i : i + k])) is not None]
                owner += [r] * len(found)
                rows += found
            if rows:
                owner, logs = np.array(owner), self.gram_logs[k][rows]
                starts = np.flatnonzero(np.diff(owner, prepend=-1))
                sums = np.add.reduceat(logs, starts, axis=0)
                counts = np.diff([*starts, len(owner)])
                out[owner[starts]] = sums / counts[:, None]
                rest = np.setdiff1d(rest, owner[starts], assume_unique=True)
        return out


def _count_words(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            rows, words = words_of(batch.column("text"), NO_LETTERS)
            codes = words.dictionary_encode()
            langs = batch.column("lang").dictionary_encode()
            pairs, counts = np.unique(langs.indices.to_numpy()[rows] * (len(codes.dictionary) + 1) + codes.indices.to_numpy(zero_copy_only=False), return_counts=True)
            lang, word = np.divmod(pairs, len(codes.dictionary) + 1)
            yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(lang)), codes.dictionary.take(pa.array(word)), pa.array(counts.astype(np.int64))], ["lang", "word", "n"])

    return docs.select("lang", "text").mapInArrow(run, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _count_grams(words: DataFrame, longest: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple[str, int, str], int] = {}
            for lang, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                word = f"^{word}$"
                for k in range(1, longest + 1):
                    for i in range(len(word) - k + 1):
                        key = (lang, k, word[i : i + k])
                        sums[key] = sums.get(key, 0) + n
            lang, k, gram = zip(*sums) if sums else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(k, pa.int32()), pa.array(gram, pa.string()), pa.array(sums.values(), pa.int64())], ["lang", "k", "gram", "n"])

    return words.select("lang", "word", "n").mapInArrow(run, "lang string, k int, gram string, n bigint").groupBy("lang", "k", "gram").agg(F.sum("n").alias("n"))


def _logs(rows: pd.DataFrame, languages: list[str], totals: dict[str, int]) -> tuple[dict[str, int], np.ndarray]:
    """Rows (lang, term, n) as a matrix of log frequencies, with half a count added to each."""
    names, at = np.unique(rows["term"].to_numpy(object), return_inverse=True)
    counts = np.full((len(names), len(languages)), 0.5)
    counts[at, np.searchsorted(languages, rows["lang"].to_numpy(object))] += rows["n"]
    return {t: i for i, t in enumerate(names.tolist())}, np.log(counts / (np.array([totals.get(lang, 0) for lang in languages]) + 1.0))


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS, words: int = WORDS, grams: int = GRAMS, longest: int = LONGEST) -> LanguageModel:
    """Learn a model from ``text`` and ``lang`` of about ``train_docs`` rows of ``docs``.

    Rows with a null text or lang teach nothing. The model has at most ``words`` words and
    ``longest * grams`` n-grams for each language; only it comes to the driver.
    """
    bounded_batches(docs.sparkSession)
    known = docs.filter("text IS NOT NULL AND lang IS NOT NULL")
    counted = materialize(_count_words(sampled(known, F.col("doc_id"), train_docs, "language")), "words")
    per_gram = materialize(_count_grams(counted, longest), "grams")
    totals = dict(counted.groupBy("lang").agg(F.sum("n")).collect())
    languages = sorted(totals)
    top = counted.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).filter(F.col("r") <= words)
    word_ids, word_logs = _logs(top.select("lang", F.col("word").alias("term"), "n").toPandas(), languages, totals)
    top = per_gram.withColumn("r", F.row_number().over(Window.partitionBy("lang", "k").orderBy(F.desc("n"), "gram"))).filter(F.col("r") <= grams)
    kept, all_grams = top.select("k", "lang", F.col("gram").alias("term"), "n").toPandas(), {}
    gram_totals = {(k, lang): n for k, lang, n in per_gram.groupBy("k", "lang").agg(F.sum("n")).collect()}
    for k in range(1, longest + 1):
        all_grams[k] = _logs(kept[kept["k"] == k], languages, {lang: gram_totals.get((k, lang), 0) for lang in languages})
    return LanguageModel(languages, word_ids, word_logs, {k: v[0] for k, v in all_grams.items()}, {k: v[1] for k, v in all_grams.items()})


def predict(docs: DataFrame, model: LanguageModel, columns: list[str]) -> DataFrame:
    """``columns`` of every row, with ``lang_pred`` and ``score`` (0 to 1) from its whole text.

    ``lang_pred`` is ``und`` with score 0 for null texts, texts without a letter, and if the model knows
    no language. Equal scores go to the language first by code point. A column of ``docs`` named like an
    added one is replaced.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    added = ("lang_pred", "score")
    kept = [c for c in columns if c not in added]
    narrow = docs.select(*kept, F.col("text").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = pa.array([*model.languages, UNKNOWN], pa.string())
        wide = len(model.languages)
        for batch in steps(batches, "__text"):
            rows, words = words_of(batch.column("__text"), NO_LETTERS)
            codes = words.dictionary_encode()
            n = np.bincount(rows, minlength=batch.num_rows)
            best, score = np.full(batch.num_rows, wide), np.zeros(batch.num_rows)
            if wide and len(rows):
                by_word = model.score(codes.dictionary.to_pylist())
                at = codes.indices.to_numpy(zero_copy_only=False)
                sums = np.stack([np.bincount(rows, by_word[at, k], batch.num_rows) for k in range(wide)], axis=1)
                some = n > 0
                logs = sums[some] * (np.minimum(n, EVIDENCE_WORDS) / np.maximum(n, 1))[some, None]
                odds = np.exp(logs - logs.max(axis=1, keepdims=True))
                best[some] = odds.argmax(axis=1)
                score[some] = odds.max(axis=1) / odds.sum(axis=1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), names.take(pa.array(best)), pa.array(score)], [*kept, *added])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1])
    return narrow.mapInArrow(run, f"{schema}, lang_pred string, score double")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of all documents, learned from those that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(~held_out(F.col("doc_id"))))
    marked = docs.withColumn("held_out", held_out(F.col("doc_id")))
    return predict(marked, model, ["doc_id", "held_out"])
