"""Shared storage of driver and executors, and lineage cuts through it."""

from __future__ import annotations

import hashlib
import tempfile
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, in local mode only, a fresh one where it is unset."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    fresh = "file://" + tempfile.mkdtemp(prefix="skeinwork-")
    spark.sparkContext.setCheckpointDir(fresh)
    return fresh


#: Paths of tables for each scratch() that is open, innermost last.
_SCRATCH: ContextVar[tuple[list[str], ...]] = ContextVar("scratch", default=())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the tables that were stored within it, but for kept ones, which belong to the scratch() around it.

    So whatever is made within and still read afterwards has to read kept tables alone.
    """
    token = _SCRATCH.set((*_SCRATCH.get(), []))
    try:
        yield
    finally:
        made = _SCRATCH.get()[-1]
        _SCRATCH.reset(token)
        for path in made:
            discard(spark, path)


def checkpointed(df: DataFrame) -> DataFrame:
    """df, cut from its lineage by a table in the shared folder, which is computed once (a checkpoint computes it twice)."""
    return stored(df, "step")


def stored(df: DataFrame, label: str, partition_by: Iterable[str] = (), keep: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder; it survives lost executors and costs less disk than a checkpoint.

    Within scratch() it is deleted at the end, unless it is to be kept.
    """
    path = f"{shared_dir(df.sparkSession)}/skeinwork-{label}-{uuid.uuid4().hex}"
    if owners := _SCRATCH.get()[: -1 if keep else None]:
        owners[-1].append(path)
    writer = df.write.option("compression", "zstd")
    names = list(partition_by)
    (writer.partitionBy(*names) if names else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared storage, whatever file system holds it; none is no error."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def files_digest(spark: SparkSession, files: list[str], label: str = "") -> str:
    """A name for what is made of some files, as long as they, their sizes and times stay as they are; their contents are not read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(files).select("path", "length", "modificationTime")
    each = F.sha2(F.concat_ws("|", "path", "length", F.unix_micros("modificationTime")), 256)
    facts = listed.agg(F.sha2(F.array_join(F.sort_array(F.collect_list(each)), ""), 256)).first()[0]
    return hashlib.sha256(f"{label}\n{facts}".encode()).hexdigest()[:32]


def finished(spark: SparkSession, pattern: str) -> list[str]:
    """The folders of a glob pattern that a writer has finished, in order of their names."""
    glob = spark._jvm.org.apache.hadoop.fs.Path(f"{pattern}/_SUCCESS")
    found = glob.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(glob)
    return sorted(str(status.getPath().getParent()) for status in found or [])


def join_files(spark: SparkSession, folder: str, path: str) -> None:
    """The files that a writer left in a folder, in order of their names, as one file at path, which appears whole.

    The file system appends them itself where it can (as HDFS does); elsewhere their bytes are streamed into the new file.
    """
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    fs = hadoop.Path(folder).getFileSystem(conf)
    parts = sorted((s.getPath() for s in fs.globStatus(hadoop.Path(f"{folder}/part-*"))), key=str)
    target, whole = hadoop.Path(path), hadoop.Path(f"{folder}/whole")
    out = fs.create(whole)
    try:
        if fs.getScheme() == "hdfs" and parts:
            out.close()
            gateway = spark.sparkContext._gateway
            array = gateway.new_array(hadoop.Path, len(parts))
            for i, part in enumerate(parts):
                array[i] = part
            fs.concat(whole, array)
        else:
            for part in parts:
                source = fs.open(part)
                try:
                    spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 20, False)
                finally:
                    source.close()
    finally:
        out.close()
    put_in_place(spark, str(whole), str(target))


def put_in_place(spark: SparkSession, source: str, path: str) -> None:
    """Renames a file to path over what is there, at once."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    a, b = hadoop.Path(source), hadoop.Path(path)
    context = hadoop.FileContext.getFileContext(a.getFileSystem(spark._jsc.hadoopConfiguration()).getUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    options[0] = hadoop.Options.Rename.OVERWRITE
    context.rename(a, b, options)


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def write_small(spark: SparkSession, path: str, text: str) -> None:
    """A small file of the driver's."""
    fs, where = _fs(spark, path)
    out = fs.create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_small(spark: SparkSession, path: str) -> str | None:
    """The text of a small file, or None where there is none."""
    fs, where = _fs(spark, path)
    try:
        source = fs.open(where)
    except Exception as error:
        if "FileNotFoundException" in str(error):
            return None
        raise
    try:
        return bytes(source.readAllBytes()).decode()
    finally:
        source.close()


def folders(spark: SparkSession, pattern: str) -> list[tuple[str, float]]:
    """Name and time of change, in seconds, of what matches a glob pattern."""
    fs, where = _fs(spark, pattern)
    return [(status.getPath().getName(), status.getModificationTime() / 1000) for status in fs.globStatus(where) or []]


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of all files below a folder, or of a file."""
    fs, where = _fs(spark, path)
    return fs.getContentSummary(where).getLength()


def claim(spark: SparkSession, path: str, limit: float, clock: Callable[[], float] = time.time) -> Callable[[], None] | None:
    """An exclusive file, and what releases it; None while another one holds it that is younger than limit seconds."""
    fs, where = _fs(spark, path)
    held = read_small(spark, path)
    if held is not None:
        try:
            since = float(held)
        except ValueError:  # just made, and not written yet
            since = clock()
        if clock() - since <= limit:
            return None
        fs.delete(where, False)
    try:
        out = fs.create(where, False)
    except Exception as error:
        if "AlreadyExists" in str(error):
            return None
        raise
    out.write(bytearray(str(clock()).encode()))
    out.close()
    return lambda: fs.delete(where, False)
