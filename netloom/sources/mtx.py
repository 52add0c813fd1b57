"""Count matrices from files: coordinate lists, dense tables, and folders of them."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialize, numbered
from .tables import default_barcodes

HEADER = r"^\d+\s+\d+\s+\d+\s*$"
ENTRY = r"^\s*(\d+)\s+(\d+)\s+(\S+)\s*$"


#: Order of lines: file, block of the file, place in the block.
ORDER = ["file", "block", "m"]
#: Bytes of an archive's member that a task holds at once.
CHUNK = 1 << 22


def _opened(file: str):
    """A file of any system that Arrow knows, for reading in any order; nothing is read ahead."""
    scheme, _, rest = file.partition(":")
    if scheme == "file":
        return open("/" + rest.lstrip("/"), "rb")
    system, path = fs.FileSystem.from_uri(f"s3:{rest}" if scheme == "s3a" else file)
    return system.open_input_file(path)


def archive_lines(file: str) -> Iterator[list[str]]:
    """Lines of the first member of a zip archive, about CHUNK bytes at a time."""
    with _opened(file) as raw, zipfile.ZipFile(raw) as archive, io.BufferedReader(archive.open(archive.namelist()[0]), 1 << 20) as member:
        while rows := member.readlines(CHUNK):
            yield [r.decode().rstrip("\r\n") for r in rows]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a text file or of a folder's files (``value``), in a zip of its first member, with what orders them.

    An archive is streamed by one task, as it can't be read from the middle, and its lines written as a table that tasks then share.
    """
    if not path.endswith(".zip"):
        rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
        return rows.withColumn("m", F.monotonically_increasing_id())

    def unzip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                for block, lines in enumerate(archive_lines(file)):
                    n = len(lines)
                    yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string()), pa.array([file] * n, pa.string()), pa.array([block] * n, pa.int64()), pa.array(range(n), pa.int64())], ["value", *ORDER])

    files = spark.read.format("binaryFile").load(path).select("path")  # names only: contents never become a row
    return materialize(files.mapInArrow(unzip, "value string, file string, block long, m long"), "unzipped")


def _names(spark: SparkSession, path: str) -> DataFrame:
    """First tab-separated column of each line (``name``) with its number ``n`` from 1."""
    lines = _lines(spark, path).select(F.split_part("value", F.lit("\t"), F.lit(1)).alias("name"), *ORDER)
    return numbered(lines, *ORDER).select((F.col("n") + 1).alias("n"), "name")


def _named(spark: SparkSession, rows: DataFrame, genes: str, barcodes: str | None, n_cells: int, label: str) -> DataFrame:
    g = _names(spark, genes).withColumnsRenamed({"n": "i", "name": "gene"})
    c = _names(spark, barcodes).withColumnsRenamed({"n": "j", "name": "cell"}) if barcodes else default_barcodes(spark, n_cells).select((F.col("cell_pos") + 1).alias("j"), "cell")
    named = rows.join(g, "i").join(c, "j")
    return named.groupBy(F.lit(label).alias("label"), "gene", "cell").agg(F.sum("value").alias("value")).filter("value <> 0")


def read_mtx_sparse(spark: SparkSession, matrix: str, genes: str, barcodes: str | None = None, label: str = "all") -> DataFrame:
    """Entries of a coordinate list (``.txt``, ``.mtx``, ``.gz`` or ``.zip``).

    Lines before the first that holds three whole numbers (the sizes) are skipped, as is that one. Repeated
    coordinates are summed. Without a barcode file cells are named barcode_0, barcode_1, ...
    """
    if not matrix.endswith((".txt", ".mtx", ".gz", ".zip")):
        raise ValueError(f"not a coordinate list: {matrix}")
    lines = _lines(spark, matrix)
    head = lines.filter(F.col("value").rlike(HEADER)).orderBy(*ORDER).limit(1).collect()
    if not head:
        raise ValueError(f"no line of sizes in {matrix}")
    file, block, m = ((F.col(c), F.lit(head[0][c])) for c in ORDER)
    after = (file[0] > file[1]) | (file[0] == file[1]) & ((block[0] > block[1]) | (block[0] == block[1]) & (m[0] > m[1]))
    body = lines.filter(after & F.col("value").rlike(ENTRY))
    part = lambda k: F.regexp_extract("value", ENTRY, k)
    rows = body.select(part(1).cast("long").alias("i"), part(2).cast("long").alias("j"), part(3).try_cast("double").alias("value"))
    return _named(spark, rows, genes, barcodes, int(head[0].value.split()[1]), label)


def read_mtx_dense(spark: SparkSession, matrix: str, genes: str, barcodes: str | None = None, label: str = "all") -> DataFrame:
    """Entries of a table without header or index (``.tsv`` or ``.csv``), names from the side files."""
    lines = numbered(_lines(spark, matrix), *ORDER, name="i").select((F.col("i") + 1).alias("i"), "value")
    rows = lines.select("i", F.posexplode(F.split("value", "\t" if ".tsv" in matrix else ",")).alias("at", "v"))
    rows = rows.select("i", (F.col("at") + 1).cast("long").alias("j"), F.col("v").try_cast("double").alias("value")).filter("value <> 0")
    n_cells = rows.agg(F.max("j")).first()[0] or 0
    return _named(spark, rows, genes, barcodes, n_cells, label)


def read_folder(spark: SparkSession, folder: str, label: str = "all", matrix: str = "matrix", genes: str = "genes", barcodes: str = "barcodes") -> DataFrame:
    """Entries of the files in ``folder`` whose names hold the given words; barcodes may be missing."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    found = [f.getPath().toString() for f in path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)]
    pick = lambda word: next((f for f in sorted(found) if word in f.rsplit("/", 1)[-1]), None)
    files = {w: pick(w) for w in (matrix, genes, barcodes)}
    if not files[matrix] or not files[genes]:
        raise FileNotFoundError(f"no {matrix} or {genes} file in {folder}")
    dense = any(x in files[matrix].rsplit("/", 1)[-1] for x in (".tsv", ".csv"))
    return (read_mtx_dense if dense else read_mtx_sparse)(spark, files[matrix], files[genes], files[barcodes], label)


#: Steps of a run and the columns their tables are partitioned by. Cells and genes belong to quality control.
STEP_KEYS = {"qc": ["label"], "cells": ["label"], "genes": [], "nc": ["label", "net_id"], "td": ["label"], "ko": ["label"], "ma": [], "dr": []}


def write_step(df: DataFrame, folder: str, step: str, keywords: dict | None = None) -> None:
    """Write the table of a step under ``folder``, partitioned by its keys, and the step's keywords as JSON."""
    if step not in STEP_KEYS:
        raise ValueError(f"unknown step: {step}")
    df.write.mode("overwrite").partitionBy(*STEP_KEYS[step]).parquet(f"{folder}/{step}")
    text = json.dumps(keywords or {}, sort_keys=True)
    df.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/{step}_kws.json")


def read_step(spark: SparkSession, folder: str, step: str) -> tuple[DataFrame, dict]:
    if step not in STEP_KEYS:
        raise ValueError(f"unknown step: {step}")
    (row,) = spark.read.text(f"{folder}/{step}_kws.json", wholetext=True).collect()
    return spark.read.parquet(f"{folder}/{step}"), json.loads(row[0])


#: Files of the steps that other programs read, under their step's folder.
CSV_FILES = {"ma": "manifold_alignment.csv", "dr": "d_regulation.csv"}


def _complex_text(real: Column, imaginary: Column) -> Column:
    sign = F.when((imaginary < 0) | (imaginary.cast("string") == "-0.0"), "").otherwise("+")
    return F.concat(F.lit("("), real.cast("string"), sign, imaginary.cast("string"), F.lit("j)"))


def write_csv(df: DataFrame, folder: str, step: str) -> str:
    """The table of step ``ma`` or ``dr`` as headed CSV files in a folder of the step's name; the path.

    ``ma``: first column X_<gene> or Y_<gene>, then NLMA_1, NLMA_2, ... (complex numbers like (1.5-0.25j) if any is). ``dr``: the row's number, then
    the columns of the table. Rows are in order through the files, as many as there are parts of them.
    """
    if step not in CSV_FILES:
        raise ValueError(f"no CSV of step: {step}")
    path = f"{folder}/{step}/{CSV_FILES[step]}"
    if step == "dr":
        rows = numbered(df, "`p-value`", "Gene", name="__n")
        rows = rows.repartitionByRange("__n").sortWithinPartitions("__n").select(F.col("__n").alias(" "), *[F.col(f"`{c}`") for c in df.columns])
    else:
        width = df.agg(F.max(F.size("coords"))).first()[0] or 0
        imaginary = "coords_im" in df.columns and bool(df.filter(F.exists("coords_im", lambda v: v != 0)).take(1))
        value = lambda k: _complex_text(F.col("coords")[k], F.col("coords_im")[k]) if imaginary else F.col("coords")[k]
        rows = df.repartitionByRange("side", "gene").sortWithinPartitions("side", "gene")
        rows = rows.select(F.concat_ws("_", "side", "gene").alias(" "), *[value(k).alias(f"NLMA_{k + 1}") for k in range(width)])
    rows.write.mode("overwrite").option("header", True).csv(path)
    return path


def read_csv(spark: SparkSession, folder: str, step: str) -> DataFrame:
    """What ``write_csv`` wrote, as the table of the step."""
    rows = spark.read.csv(f"{folder}/{step}/{CSV_FILES[step]}", header=True)
    first, *rest = rows.columns
    if step == "dr":
        return rows.select("Gene", *[F.col(f"`{c}`").cast("double").alias(c) for c in rest if c != "Gene"])
    number = r"^\(?([-+]?[0-9.]+(?:[eE][-+]?[0-9]+)?)(?:([-+][0-9.]+(?:[eE][-+]?[0-9]+)?)j\))?$"
    part = lambda k: F.array(*[F.coalesce(F.nullif(F.regexp_extract(F.col(c), number, k), F.lit("")).cast("double"), F.lit(0.0)) for c in rest])
    name = F.col(f"`{first}`")
    return rows.select(F.substring(name, 1, 1).alias("side"), F.expr(f"substring(`{first}`, 3)").alias("gene"), part(1).alias("coords"), part(2).alias("coords_im"))
