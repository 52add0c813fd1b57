"""Tables written between steps, in the folder that all executors share.

Iterations and branches that are read more than once are cut here instead of with a cache: a
Parquet table in ``spark.checkpoint.dir`` survives the loss of any executor, and the plan that
follows starts from a plain scan.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"
#: Whether shuffle files go with the query that made them, not when the driver happens to collect its garbage.
FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows that one task sorts or groups (see ``dealt``).
TASK_ROWS = 250_000


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: the session's ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; elsewhere a local folder
    would be invisible to other machines, so this raises.
    """
    set_dir = spark.conf.get(CHECKPOINT_DIR, None)
    if set_dir:
        return set_dir.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{CHECKPOINT_DIR} must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="netloom-")
    spark.conf.set(CHECKPOINT_DIR, own)
    return own


@contextmanager
def _own_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries run inside leave no shuffle files; the session's setting is put back."""
    before = spark.conf.get(FILE_CLEANUP, None)
    spark.conf.set(FILE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(FILE_CLEANUP) if before is None else spark.conf.set(FILE_CLEANUP, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back with the same schema.

    The shuffle files of the write are deleted at its end, as no other query reads them: disk holds those of one step at a time.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/netloom-{uuid.uuid4().hex}/{name}"
    with _own_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """``df`` dealt by ``by`` over so many tasks that one of ``rows`` rows in all has about TASK_ROWS: what a task holds doesn't grow with the table.

    A given number of partitions isn't merged again by the size of the compressed shuffle.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)), *by)


def numbered(df: DataFrame, *by: str, name: str = "n") -> DataFrame:
    """``df`` with the place of each row in the order of ``by``, from 0; no single task sees all rows.

    Parts of a range partitioning are numbered on their own; the rows of the parts before are added, of which
    the driver holds one number a part.
    """
    parts = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__id", F.monotonically_increasing_id())
    parts = materialize(parts, "numbered")
    part, at = F.shiftright("__id", 33), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes, first, rows = sorted(map(tuple, parts.groupBy(part.alias("part")).count().collect())), 0, []
    for number, size in sizes:
        rows.append((number, first))
        first += size
    offsets = df.sparkSession.createDataFrame(rows, "__part long, __first long")
    joined = parts.join(F.broadcast(offsets), part == F.col("__part"))
    return joined.withColumn(name, F.col("__first") + at).drop("__id", "__part", "__first")


def _file_system(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of any file system that Spark reads; none if it isn't there."""
    place, system = _file_system(spark, path)
    return sorted(f.getPath().getName() for f in system.listStatus(place)) if system.exists(place) else []


def listing(spark: SparkSession, path: str) -> list[list]:
    """Name, size and time of a file, or of the files in a folder."""
    place, system = _file_system(spark, path)
    return sorted([f.getPath().toString(), f.getLen(), f.getModificationTime()] for f in system.listStatus(place))


def remove(spark: SparkSession, path: str) -> None:
    place, system = _file_system(spark, path)
    system.delete(place, True)


def discard(df: DataFrame) -> None:
    """Delete the table behind a ``materialize`` result that nothing reads any more."""
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        remove(df.sparkSession, parent)
