"""Pieces that several corpus operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch. Texts may be long, so that batches of Spark's default 10,000 rows could
#: exceed a worker's memory.
ROWS_PER_BATCH = 512
#: UTF-8 bytes of text that a vectorised step handles at once.
BYTES_PER_STEP = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of texts small in this session (never raises a smaller setting)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) not in range(1, ROWS_PER_BATCH + 1):
        spark.conf.set(key, str(ROWS_PER_BATCH))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(columns: list[str]) -> list[Column]:
    """Columns by name, whatever signs the names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def steps(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = BYTES_PER_STEP) -> Iterator[pa.RecordBatch]:
    """Cut batches into slices of at most ``most`` bytes of text (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        step = (np.cumsum(sizes) - sizes) // most
        cuts = np.flatnonzero(np.diff(step, prepend=-1))
        for lo, hi in zip(cuts, [*cuts[1:], batch.num_rows]):
            yield batch.slice(lo, hi - lo)


def held_out(doc_id: Column) -> Column:
    """True for documents that no model may learn from: crc32(doc_id as text) mod 5 = 0, or no id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def sampled(df: DataFrame, key: Column, rows: int, salt: str) -> DataFrame:
    """About ``rows`` rows of ``df`` chosen by a hash of ``key``; all of them if there are fewer.

    The sample depends on keys alone, so that reruns agree, and it needs neither a sort nor one task.
    """
    total = df.count()
    if total <= rows:
        return df
    share = F.pmod(F.xxhash64(F.lit(salt), key), F.lit(1 << 20))
    return df.filter(share < int(rows / total * (1 << 20)))


def words_of(texts: pa.Array, pattern: str | None, lower: bool = True) -> tuple[np.ndarray, pa.Array]:
    """Split whole texts into words: (row number of each word, the words).

    ``pattern`` matches what separates words; None: ASCII white space. Null texts have none.
    """
    texts = pc.fill_null(texts, "")
    if lower:
        texts = pc.utf8_lower(texts)
    if pattern is None:
        lists = pc.ascii_split_whitespace(texts)
    else:
        texts = pc.utf8_trim(pc.replace_substring_regex(texts, pattern, " "), " ")
        lists = pc.split_pattern(texts, " ")
    words = pc.list_flatten(lists)
    rows = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    full = pc.greater(pc.binary_length(words), 0)
    keep = full.to_numpy(zero_copy_only=False)
    return (rows, words) if keep.all() else (rows[keep], words.filter(full))
