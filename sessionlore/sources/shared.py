"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine a temporary folder
    takes its place, and the session is told of it; on a cluster that is an error,
    as no executor would see another's files.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="sessionlore-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def scratch_root(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables."""
    return f"{shared_dir(spark)}/sessionlore-{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in it."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write to Parquet in the shared folder, in a folder for each value of ``by``, and read it back.

    Unlike a checkpoint, the files keep columns apart, so later readers scan
    only what they need.
    """
    path = scratch(df.sparkSession, name)
    writer = df.write if by is None else df.write.partitionBy(by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Opening a file counts as so many bytes of a task's share. Spark's own 4 MB would give a task 32
#: files of a session each, and a tree of many sessions as many tasks and small tables as a 32nd of them.
OPEN_BYTES = 128 << 10
#: Tasks that list folders, for each one that the session runs at a time.
LISTING_TASKS = 4


@contextmanager
def small_files(spark: SparkSession) -> Iterator[None]:
    """The session's settings for many small files while they are listed or read: few tasks of many
    files each, and folders are listed by tasks, not one after another on the driver."""
    own = {
        "spark.sql.files.openCostInBytes": OPEN_BYTES,
        "spark.sql.sources.parallelPartitionDiscovery.threshold": 1,
        "spark.sql.sources.parallelPartitionDiscovery.parallelism": LISTING_TASKS * spark.sparkContext.defaultParallelism,
    }
    before = {key: spark.conf.get(key) for key in own}
    try:
        for key, value in own.items():
            spark.conf.set(key, str(value))
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def write_files(rows: DataFrame, root: str, *order: str) -> None:
    """A text file below ``root`` for each ``file`` (a path) of ``rows``: its values as lines, in order.

    For files as many as sessions: Spark's own writer makes a folder for each, and where it has
    no native library starts three processes a file. A task streams a file beside its place and
    moves it there once it is whole, so a task that is run again does no harm, and an older file
    is replaced. Those of a job that fails half-way stay.
    """
    if "://" not in root and ":/" in root:  # a scheme without an authority
        root = root.replace(":/", ":///", 1)
    system, base = arrow_fs.FileSystem.from_uri(root)
    system.create_dir(base)
    dealt = rows.select("file", *order, "value").repartition("file").sortWithinPartitions("file", *order).select("file", "value")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = arrow_fs.FileSystem.from_uri(root)
        made, at, out, beside, folders = 0, None, None, "", set()

        def close() -> int:
            if out is None:
                return 0
            out.close()
            system.move(beside, f"{base}/{at}")
            return 1

        for batch in batches:
            files, values = (batch.column(i).to_pylist() for i in (0, 1))
            begin = 0
            for end in range(1, len(files) + 1):
                if end < len(files) and files[end] == files[begin]:
                    continue
                if files[begin] != at:
                    made += close()
                    at = files[begin]
                    folder, _, name = at.rpartition("/")
                    if folder not in folders:
                        system.create_dir(f"{base}/{folder}")
                        folders.add(folder)
                    beside = f"{base}/{folder}/.{name}.{uuid.uuid4().hex}"
                    out = system.open_output_stream(beside)
                out.write("".join(f"{v}\n" for v in values[begin:end]).encode())
                begin = end
        made += close()
        yield pa.RecordBatch.from_pydict({"files": pa.array([made], pa.int64())})

    dealt.mapInArrow(put, "files long").agg(F.sum("files")).collect()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, on any file system Spark can write."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def clear(spark: SparkSession) -> None:
    """Remove this application's intermediate tables, once nothing that reads them is needed."""
    remove(spark, scratch_root(spark))
