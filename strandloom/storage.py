"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Bytes of a Parquet row group of an intermediate table: what a writing task holds in memory.
ROW_GROUP = 32 << 20
# Bytes of input files per task of a shuffle that is dealt by deal_by.
DEALT, MOST_TASKS = 1 << 21, 20_000
# Bytes per core up to which a table counts as small (see spread).
SMALL = 16 << 20
# Whether the shuffle files of a statement are removed when it has ended, not when the driver's JVM happens to collect garbage.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Tables that materialize gave since a block of ``passing`` began.
_held: list[list[DataFrame]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``. Where that is unset: a temporary one under a local master, else an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="strandloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def scratch(spark: SparkSession) -> str:
    """A new folder name in the shared folder; what is written there is removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    place, files = _place(spark, path)
    files.mkdirs(place)
    files.deleteOnExit(place)
    return path


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """For a block that writes: the shuffle files of every statement in it go when it has ended."""
    before = spark.conf.get(CLEAN, "false")
    spark.conf.set(CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEAN, before)


@contextmanager
def passing() -> Iterator[None]:
    """For a block that leaves nothing behind that reads the tables it materializes, such as one that writes files: these tables are removed at its end."""
    _held.append([])
    try:
        yield
    finally:
        release(*_held.pop())


def together(tables: list[DataFrame]) -> DataFrame:
    """The rows of tables that materialize gave, all of one schema, as one table."""
    return tables[0].sparkSession.read.schema(tables[0].schema).parquet(*(t.table_path for t in tables))


def materialize(df: DataFrame) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again: cuts the lineage, survives lost executors.

    The files are removed by ``release``, at the latest when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    with cleaned(spark):
        df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    place, files = _place(spark, path)
    files.deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out.table_path = path
    if _held:
        _held[-1].append(out)
    return out


def release(*tables: DataFrame) -> None:
    """Removes the files of tables that ``materialize`` gave and that nothing reads any more."""
    for df in tables:
        remove(df.sparkSession, df.table_path)


def remove(spark: SparkSession, path: str) -> None:
    """Removes a file or folder that nothing reads any more."""
    place, files = _place(spark, path)
    files.delete(place, True)


def one_file(spark: SparkSession, folder: str, path: str, head: str | None = None) -> None:
    """The text files of a folder, in the order of their names, as one file at path (after the line ``head``); the folder goes.

    HDFS appends the files to each other without copying them. Elsewhere the driver's JVM copies them from stream to stream, a few megabytes at
    a time, as one file can only be written by one writer.
    """
    place, files = _place(spark, folder)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    parts = sorted((s.getPath() for s in files.listStatus(place) if s.getPath().getName().startswith("part-") and s.getLen() > 0), key=lambda p: p.getName())
    out = files.create(target)
    try:
        if head is not None:
            out.write(bytearray(f"{head}\n".encode()))
        if files.getScheme() != "hdfs":
            for part in parts:
                source = files.open(part)
                try:
                    spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 4 << 20, False)
                finally:
                    source.close()
    finally:
        out.close()
    if files.getScheme() == "hdfs" and parts:
        every = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Path, len(parts))
        for k, part in enumerate(parts):
            every[k] = part
        files.concat(target, every)
    files.delete(place, True)


def deal_by(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys to as many tasks as the files it is read from ask for, DEALT bytes each, whatever the number of shuffle partitions is.

    Windows and groups within the keys go on from there without a further shuffle; what a task sorts stays as large as it is when the input grows.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(min(MOST_TASKS, max(cores, size // DEALT + 1)), *keys)


def spread(df: DataFrame) -> DataFrame:
    """A small df over at least as many partitions as there are cores: a few large row groups would keep most of them idle.

    A table of more than SMALL bytes a core, or of many splits, is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df if size > cores * SMALL or df.rdd.getNumPartitions() >= cores else df.repartition(cores)
