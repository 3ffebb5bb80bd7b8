"""What the training-data operators share: shared-folder tables, checkpoints, text columns."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


FILTER_BITS = 26  # a filter that is sent to tasks has 2^26 bits, 8 MB, whatever it was made from
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder. Texts that come in fewer splits than there are cores, so in a small file, are dealt out."""
    found = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return found.repartition(cores) if name == "documents" and found.rdd.getNumPartitions() < cores else found


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a local one where that is unset (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="sparkloom-")
    spark.conf.set("spark.checkpoint.dir", own)
    spark.sparkContext.setCheckpointDir(own)
    return own


class Tables:
    """Parquet tables in the shared folder that cut lineage; a lost executor loses none of them.

    drop() removes one as soon as no plan reads it any more; the rest goes when the driver ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tables-{uuid.uuid4().hex}"
        atexit.register(self._end)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(f"{self.root}/{name}")

    def _delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def _end(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # the session has ended before the driver did
            pass


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def binaries(column: pa.Array) -> Iterator[bytes]:
    """The values of a column of strings or binaries as bytes, one at a time, so that no list holds a batch's copies."""
    return (x.as_py() for x in column.cast(pa.binary()))


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers with their bits mixed, one to one."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _bit(keys: np.ndarray) -> np.ndarray:
    """The bit of the filter that stands for a key."""
    return (mixed(keys.astype(np.uint64)) & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)


def among(spark: SparkSession, keys: DataFrame, column: Column) -> Column:
    """Whether a column of longs may be among the keys (one column of longs without nulls): false only where it is not.

    The filter's size is fixed: the driver gets a row for each of its words that holds a bit, 2^20 at most. It
    passes next to nothing else up to some ten million keys; with many more it passes more and more, at last
    everything, and the join that stands behind it has more to do.
    """

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            bit = _bit(pdf["key"].to_numpy())
            yield pd.DataFrame({"word": bit >> 6, "bits": np.left_shift(np.int64(1), bit & 63)})

    set_bits = keys.toDF("key").mapInPandas(words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    filled = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    filled[set_bits["word"].to_numpy()] = set_bits["bits"].to_numpy()
    shared = spark.sparkContext.broadcast(filled)

    @F.pandas_udf("boolean")
    def may_be(asked: pd.Series) -> pd.Series:
        bit = _bit(asked.to_numpy())
        return pd.Series((shared.value[bit >> 6] >> (bit & 63)) & 1 == 1)

    return may_be(F.coalesce(column, F.lit(0).cast("long")))  # with nulls, pandas would make doubles of them
