"""The folder that all executors share, and small files in it: digests of inputs, and publication by one rename."""

from __future__ import annotations

import atexit
import hashlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a temporary folder where that is unset and Spark runs on this machine alone."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="sparkloom-")
    spark.conf.set("spark.checkpoint.dir", own)
    spark.sparkContext.setCheckpointDir(own)
    return own


def _at(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _at(spark, path)
    return fs.exists(at)


def delete(spark: SparkSession, path: str) -> None:
    fs, at = _at(spark, path)
    fs.delete(at, True)


def unique() -> str:
    """A name that no other folder has."""
    return uuid.uuid4().hex


def kept(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table of their own in the shared folder, so that what made them runs once and a lost executor loses
    none; it goes when the driver ends."""
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/{name}-{unique()}"
    df.write.parquet(path)
    return kept_at(spark, path, df.schema)


def kept_at(spark: SparkSession, path: str, schema) -> DataFrame:
    """A table that was written in the shared folder; it goes when the driver ends."""

    def gone() -> None:
        try:
            delete(spark, path)
        except Exception:  # the session has ended before the driver did
            pass

    atexit.register(gone)
    return spark.read.schema(schema).parquet(path)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of what is in a folder; none of a folder that isn't there."""
    fs, at = _at(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []


def read_text(spark: SparkSession, path: str) -> str:
    fs, at = _at(spark, path)
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def publish(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small file under another name and renames it. False, and nothing changes, where it is there already:
    of two writers one wins."""
    fs, at = _at(spark, path)
    if fs.exists(at):
        return False
    _, draft = _at(spark, f"{path}.{hashlib.sha256(text.encode()).hexdigest()[:16]}.draft")
    stream = fs.create(draft, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    won = not fs.exists(at) and fs.rename(draft, at)
    if not won:
        fs.delete(draft, False)
    return won


def input_digest(spark: SparkSession, df: DataFrame, *options: object) -> str:
    """A digest of the files that a DataFrame reads (path, length, time of change), and of options."""
    parts = [repr(options)]
    for name in sorted(df.inputFiles()):
        fs, at = _at(spark, name)
        status = fs.getFileStatus(at)
        parts.append(f"{name}\0{status.getLen()}\0{status.getModificationTime()}")
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()[:32]
