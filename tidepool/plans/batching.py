"""Cutting an ordered stream into batches: commit batches, chunks, intake batches and their queue."""
from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: Transactions and microseconds of a commit batch, bytes and microseconds of a chunk, and the limits of a persistence queue.
COMMIT_MOST, COMMIT_SPAN = 32, 4_000
CHUNK_BYTES, CHUNK_GAP = 64 * 1024 * 1024, 5_000_000
QUEUE_CAPACITY, QUEUE_RETRIES, QUEUE_BACKOFF_MS = 1024, 5, 25


def batches(rows: DataFrame, by: str, at: str, size: str | None = None, most: int | None = None, bytes_: int | None = None, span: int | None = None, gap: int | None = None) -> DataFrame:
    """rows with batch (0, 1, ... for each value of by, in the order of at).

    A row starts a new batch if the batch before it is full: it has `most` rows, its sizes sum to `bytes_` or more, the row lies
    `span` or more after the batch's first, or `gap` or more after its last. What is full depends on where the batch began, so each
    value of `by` (a shard, a proxy) is walked in order by one task, which keeps four numbers whatever it walks.
    """
    names = [*rows.columns, "batch"]

    def walk(parts):
        last, n, total, first, before, batch = None, 0, 0, 0, 0, 0
        for part in parts:
            who, when = part.column(names.index(by)).to_pylist(), part.column(names.index(at)).to_pylist()
            sizes = part.column(names.index(size)).to_pylist() if size else [0] * len(who)
            out = np.zeros(len(who), np.int64)
            for i, (b, t, s) in enumerate(zip(who, when, sizes, strict=True)):
                if b != last or not n:
                    last, n, total, first, batch = b, 0, 0, t, 0
                elif (most and n >= most) or (bytes_ and total >= bytes_) or (span and t - first >= span) or (gap and t - before >= gap):
                    n, total, first, batch = 0, 0, t, batch + 1
                n, total, before = n + 1, total + (s or 0), t
                out[i] = batch
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out)], names)

    return rows.repartition(by).sortWithinPartitions(by, at).mapInArrow(walk, StructType([*rows.schema.fields, StructField("batch", LongType())]))


def chunk_plan(log: DataFrame, bytes_: int = CHUNK_BYTES, gap: int = CHUNK_GAP) -> DataFrame:
    """tag, chunk, min_version, max_version, n, bytes of the chunks that a writer of transactions (tag, version, size) flushes."""
    cut = batches(log.select("tag", "version", "size"), "tag", "version", "size", bytes_=bytes_, gap=gap)
    return cut.groupBy("tag", F.col("batch").alias("chunk")).agg(
        F.min("version").alias("min_version"), F.max("version").alias("max_version"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")
    )


@dataclass
class PersistenceQueue:
    """What a flusher has still to store: pending, scheduled for another try, or in flight under a token."""

    capacity: int = QUEUE_CAPACITY
    retries: int = QUEUE_RETRIES
    backoff_ms: int = QUEUE_BACKOFF_MS
    pending: deque = field(default_factory=deque)
    scheduled: list = field(default_factory=list)  # (due, payload, attempt) by due time
    in_flight: dict = field(default_factory=dict)
    tokens: count = field(default_factory=lambda: count(1))

    def __post_init__(self):
        if self.capacity < 1 or self.retries < 0 or self.backoff_ms < 1:
            raise ValueError("a queue needs a capacity, a number of retries and a backoff")

    def _due(self, now: int) -> None:
        while self.scheduled and self.scheduled[0][0] <= now:
            self.pending.append(self.scheduled.pop(0)[1:])

    def enqueue(self, payload, now: int = 0) -> bool:
        """False where the queue is full."""
        self._due(now)
        if len(self.pending) + len(self.scheduled) + len(self.in_flight) >= self.capacity:
            return False
        self.pending.append((payload, 0))
        return True

    def dequeue(self, now: int = 0):
        """(token, payload) of the oldest entry that is due, or None."""
        self._due(now)
        if not self.pending:
            return None
        token, entry = next(self.tokens), self.pending.popleft()
        self.in_flight[token] = entry
        return token, entry[0]

    def ack(self, token: int) -> bool:
        return self.in_flight.pop(token, None) is not None

    def nack(self, token: int, now: int = 0) -> str:
        """rescheduled, dropped (after the last try) or unknown_token; each wait is twice the one before."""
        self._due(now)
        if token not in self.in_flight:
            return "unknown_token"
        payload, attempt = self.in_flight.pop(token)
        if attempt + 1 > self.retries:
            return "dropped"
        self.scheduled.append((now + self.backoff_ms * 2**attempt, payload, attempt + 1))
        self.scheduled.sort(key=lambda e: e[0])
        return "rescheduled"

    def counts(self) -> dict[str, int]:
        return {"pending": len(self.pending), "scheduled": len(self.scheduled), "in_flight": len(self.in_flight), "lag": len(self.pending) + len(self.scheduled)}

    def next_retry_due(self) -> int | None:
        return self.scheduled[0][0] if self.scheduled else None
