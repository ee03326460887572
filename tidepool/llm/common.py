"""What the operators of this subpackage share: reading tables, cutting lineage, walking sorted runs."""
from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Rows that a Python worker turns into Python objects at a time; texts may be long.
SLICE = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a master within one machine may do without."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return folder or tempfile.mkdtemp(prefix="tidepool-")


def sample_by_hash(rows: DataFrame, key: Column, n: int, most: int, seed: int) -> DataFrame:
    """About `most` of the n rows, chosen by a hash of key; all of them if there are no more.

    The hash is compared in 63 bits, so that the share kept is right for any n.
    """
    if n <= most:
        return rows
    return rows.where(F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 1) < F.lit((most << 63) // n))


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def new_path(spark: SparkSession, what: str) -> str:
    """A path of its own in the shared folder."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(spark))
    return f"{sc._jsc.sc().getCheckpointDir().get()}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str, path: str | None = None) -> DataFrame:
    """df written as Parquet to the shared folder and read back: smaller on disk than a checkpoint."""
    spark = df.sparkSession
    path = path or new_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder that written() made, on whatever file system it is."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def slices(batches: Iterable[pa.RecordBatch], n: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of n at most, so that few texts are Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, n):
            yield batch.slice(at, n)
