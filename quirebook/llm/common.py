"""What the operators of this subpackage share: the cluster's shared folder, and tables written to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where a local session (as in tests) has none, a temporary one is set."""
    context = spark.sparkContext
    path = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir")
    if not path:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="quirebook-")
        context.setCheckpointDir(path)
    elif not context.getCheckpointDir():
        context.setCheckpointDir(path)
    return path


class Scratch:
    """Parquet tables below the shared folder. A table outlives the executors that wrote it, so a lost executor costs
    a re-read instead of a recomputation."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/quirebook-{uuid.uuid4().hex}"

    def write(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def pack(values: np.ndarray) -> bytes:
    """Whole numbers as compressed planes of bytes."""
    values = np.ascontiguousarray(values, "<u8")
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + zstandard.compress(planes.tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data[1:]), np.uint8).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : data[0]] = planes.T
    return out.view("<u8").ravel()


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once a row, however often body or its lambdas use it. (Catalyst merges
    neighbouring projections and may otherwise evaluate value once for each element of a lambda.)"""
    return F.element_at(F.transform(F.array(value), body), 1)


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo n. A null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(n))
