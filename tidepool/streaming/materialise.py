"""Streams of versions: a log folder followed into a state, and per-shard buffers flushed by age."""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Fixed value: how many microseconds of versions a shard buffers before it flushes.
FLUSH_SPAN = 5_000_000


def follow(spark: SparkSession, log_path: str, schema, files_per_trigger: int = 8) -> DataFrame:
    """The log's files as a stream, a bounded number of them a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(log_path)


def _newest(rows: DataFrame) -> DataFrame:
    return rows.groupBy("k").agg(F.max("version").alias("version"), F.max_by("value", "version").alias("value"))


class State:
    """The newest entry of each key (k, version, value), as a base and the changes of each batch since.

    A batch writes its own keys only, under its own number, so one that is tried again leaves the same result. Every `compact`
    batches the changes are folded into a new base, and what it replaces is deleted.
    """

    def __init__(self, spark: SparkSession, path: str, compact: int = 16):
        self.spark, self.path, self.compact = spark, path.rstrip("/"), compact
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _epochs(self, kind: str) -> list[int]:
        folder = self._path(f"{self.path}/{kind}")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n) for n in names if n.isdigit() and self._fs.exists(self._path(f"{self.path}/{kind}/{n}/_SUCCESS")))

    def _parts(self) -> list[str]:
        base = self._epochs("base")[-1:]
        return [f"{self.path}/base/{e}" for e in base] + [f"{self.path}/changes/{e}" for e in self._epochs("changes") if not base or e > base[-1]]

    def read(self, schema) -> DataFrame:
        parts = self._parts()
        if not parts:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(*parts)
        return rows if len(parts) == 1 else _newest(rows)

    def sink(self, batch: DataFrame, epoch: int) -> None:
        """For foreachBatch."""
        new = _newest(batch)
        new.write.mode("overwrite").parquet(f"{self.path}/changes/{epoch}")
        if (epoch + 1) % self.compact == 0:
            if epoch not in self._epochs("base"):  # a batch that is tried again finds its base
                self.read(new.schema).write.mode("overwrite").parquet(f"{self.path}/base/{epoch}")
            for kind, keep in (("base", epoch), ("changes", epoch + 1)):
                for old in self._epochs(kind):
                    if old < keep:
                        self._fs.delete(self._path(f"{self.path}/{kind}/{old}"), True)


def materialise(spark: SparkSession, log_path: str, schema, state_path: str, checkpoint: str, files_per_trigger: int = 8, compact: int = 16) -> DataFrame:
    """Follows the log to its present end; k, version, value of every key, cleared ones with a null value."""
    state = State(spark, state_path, compact)
    log = follow(spark, log_path, schema, files_per_trigger)
    q = log.writeStream.foreachBatch(state.sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return state.read(log.select("k", "version", "value").schema)


def buffered(log: DataFrame, span: int = FLUSH_SPAN) -> DataFrame:
    """tag, first, last, n of each flush of a streaming log (tag, version): a shard's buffer is flushed by
    the first version that lies `span` or more after its oldest one, which is flushed with it. Files may come in any
    order within a trigger; the versions of a later trigger must be above those of the ones before.

    The state of a shard is three numbers: the versions themselves belong to the sink.
    """

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState):
        first, last, n = state.get if state.exists else (0, 0, 0)
        out = []
        versions = sorted(v for f in frames for v in f["version"])
        for v in versions:
            first, last, n = (v if n == 0 else first), v, n + 1
            if last - first >= span:
                out.append((int(key[0]), int(first), int(last), int(n)))
                first = last = n = 0
        state.update((int(first), int(last), int(n)))
        yield pd.DataFrame(out, columns=["tag", "first", "last", "n"])

    return log.groupBy("tag").applyInPandasWithState(step, "tag long, first long, last long, n long", "first long, last long, n long", "append", GroupStateTimeout.NoTimeout)
