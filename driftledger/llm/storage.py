"""Shared folder handling: staged tables and raw files that every executor and the driver can see."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Paths handed out in this process, for release().
_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only where that is unset on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "local")):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        root = "file://" + tempfile.mkdtemp(prefix="driftledger-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def bounded_batches(spark: SparkSession, most: int = 8 << 20) -> SparkSession:
    """Lower the bytes that go to a Python worker at once, where the session has not lowered them itself.

    Only the size of batches depends on it, no result.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(\d+)b?", spark.conf.get(key))
    if now and not 0 < int(now[1]) <= most:
        spark.conf.set(key, str(most))
    return spark


@contextmanager
def short_reads(spark: SparkSession, rows: int = 128, most: int = 2 << 20) -> Iterator[None]:
    """Within, Parquet files of whole texts are read ``rows`` at a time, not 4096, and ``most`` bytes go to a worker at once.

    Only the size of batches depends on it, no result. Settings that are lower stay; all are put back.
    """
    rows_key, bytes_key = "spark.sql.parquet.columnarReaderBatchSize", "spark.sql.execution.arrow.maxBytesPerBatch"
    before = {k: spark.conf.get(k) for k in (rows_key, bytes_key)}
    try:
        spark.conf.set(rows_key, str(min(int(before[rows_key]), rows)))
        bounded_batches(spark, most)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within, the shuffle files of a query go when it ends, not when the driver happens to collect garbage.

    What staged() writes is read from its files, so that no later query reads those shuffles. The setting is put back.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has used before."""
    _MADE.append(f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}")
    return _MADE[-1]


def staged(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write the frame as Parquet in the shared folder and read it back, which cuts the lineage for lost executors."""
    spark = df.sparkSession
    path = new_path(spark, label)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def free_name(taken: list[str], name: str) -> str:
    """The name, with underscores before it until no column has it, in any case of letters."""
    held = {c.lower() for c in taken}
    while name.lower() in held:
        name = f"_{name}"
    return name


def without(docs: DataFrame, of: list[Column], keys: DataFrame, anti: bool = True, most_bytes: int = 8 << 20) -> DataFrame:
    """Rows of docs whose expressions ``of`` equal no row of ``keys``, nulls being equal; or with ``anti`` false, those that do.

    The keys are broadcast if their counted size is at most ``most_bytes``; beyond that, both sides are dealt by them.
    """
    names = []
    for k in range(len(of)):
        names.append(free_name([*docs.columns, *names], f"key_{k}"))
    keys = keys.toDF(*names)
    if keys.count() * 16 * len(of) <= most_bytes:
        keys = F.broadcast(keys)
    same = F.lit(True)
    for name, x in zip(names, of, strict=True):
        same = same & x.eqNullSafe(F.col(name))
    return docs.join(keys, same, "left_anti" if anti else "left_semi")


def drop_staged(df: DataFrame) -> None:
    """Delete what staged() wrote, once nothing reads it any more."""
    delete(df.sparkSession, df._staged_path)


def delete(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def release(spark: SparkSession) -> None:
    """Delete all that this process staged; frames that were made of it can no longer be read."""
    while _MADE:
        delete(spark, _MADE.pop())


def open_filesystem(uri: str):
    """(filesystem, path) for raw bytes at a URI: local mounts, HDFS, S3 and GCS, as pyarrow knows them."""
    from pyarrow import fs

    if urlparse(uri).scheme in ("", "file"):
        return fs.LocalFileSystem(), urlparse(uri).path
    return fs.FileSystem.from_uri(uri)


def write_bytes(folder: str, name: str, chunks) -> int:
    """Write a file whole or not at all: a hidden file of this attempt, renamed when complete.

    A task that runs twice writes the same bytes under the same name, so either attempt may win.
    """
    filesystem, path = open_filesystem(folder)
    filesystem.create_dir(path, recursive=True)
    attempt, size = f"{path}/.{name}.{uuid.uuid4().hex}", 0
    with filesystem.open_output_stream(attempt) as out:
        for chunk in chunks:
            out.write(chunk)
            size += len(chunk)
    try:
        filesystem.move(attempt, f"{path}/{name}")
    except OSError:  # stores whose rename refuses an existing name: the other attempt wrote the same
        filesystem.delete_file(attempt)
    return size


def read_bytes(folder: str, name: str) -> bytes:
    filesystem, path = open_filesystem(folder)
    with filesystem.open_input_stream(f"{path}/{name}") as f:
        return f.read()
