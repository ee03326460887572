"""Quality of whole texts by supervised subword embeddings.

Features of a text are its white-space words and the character 3- to 5-grams of <word>, hashed into
`BUCKETS`; each bucket has a learned vector, a text is the mean of its features' vectors, and a
softmax over two outputs gives the chance of label 1. Vectors and outputs are trained together by
stochastic gradient descent in numpy, on the driver, over at most about `train_rows` labelled rows chosen
by a hash of the id; the rows arrive as counts of buckets, so their size is bounded by that number
and BUCKETS. As outputs are linear in the mean, scoring needs one number for each bucket: a word's
features are summed once and kept in a bounded worker cache. Every whole text is read.

Defined results: a null text counts as empty and scores the bias; without a labelled row every text
scores 0.5; of several labels of one document the largest counts, of several texts of one id the first by code point is
learned from; very long texts count like others, by the mean over their features; a score of exactly 0.5 is
label 1; repeated rows each give a row; an empty table gives an empty result; a null id is never held out; other
columns are ignored, whatever their names.
"""
from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import sample_by_hash, slices
from .language_id import held_out
from .piece_sums import PieceSums
from .shingles import mix

_WORKER: dict = {}
BUCKETS = 1 << 14
DIMENSION = 8


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words' features, and for each the place of its word: the word's own and its n-grams'."""
    at = np.arange(len(words))
    own = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))
    buckets, of = [own % np.uint64(BUCKETS)], [at]
    c = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    word = np.repeat(at, np.fromiter((len(w) + 2 for w in words), np.int64, len(words)))
    for k in (3, 4, 5):
        n = len(c) - k + 1
        if n <= 0:
            continue
        h = np.full(n, k, np.uint64)
        for j in range(k):
            h = h * np.uint64(0x9E3779B97F4A7C15) + c[j : j + n]
        inside = word[:n] == word[k - 1 :]
        buckets.append(mix(h[inside]) % np.uint64(BUCKETS))
        of.append(word[:n][inside])
    return np.concatenate(buckets).astype(np.int64), np.concatenate(of)


def _bucket_counts(batches):
    for batch in slices(batches, 64):
        texts = [(x or "").split() for x in batch.column(1).to_pylist()]
        place: dict[str, int] = {}
        for ws in texts:
            for w in ws:
                place.setdefault(w, len(place))
        buckets, of = features(list(place))
        ids, counts = [], []
        for ws in texts:
            often = np.bincount(np.fromiter(map(place.__getitem__, ws), np.int64, len(ws)), minlength=len(place)) if ws else np.zeros(len(place))
            n = np.bincount(buckets, often[of], BUCKETS)
            at = np.flatnonzero(n)
            ids.append(at.astype(np.int32))
            counts.append(n[at].astype(np.float32))
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), pa.array(ids, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.float32()))], ["y", "ids", "n"])


def train(rows: list, epochs: int = 12, rate: float = 0.5, seed: int = 5) -> tuple[np.ndarray, float]:
    """rows: (label, bucket ids, counts). The log-odds a bucket adds, and the bias."""
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 1 / DIMENSION, (BUCKETS, DIMENSION))
    output, bias = np.zeros((DIMENSION, 2)), np.zeros(2)
    data = [(int(y > 0), np.asarray(i, np.int64), np.asarray(n, float) / max(1.0, float(np.sum(n)))) for y, i, n in rows]
    steps, done = epochs * max(1, len(data)), 0
    for _ in range(epochs):
        for k in rng.permutation(len(data)):
            y, ids, share = data[k]
            at = rate * (1 - done / steps)
            done += 1
            v = share @ vectors[ids]
            z = v @ output + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = output @ p
            output -= at * np.outer(v, p)
            bias -= at * 0.1 * p
            # A bucket's step is its share of the text over the root of the shares' power: long texts move their buckets too.
            vectors[ids] -= at * np.outer(share / np.sqrt(max(1e-12, share @ share)), back)
    odds = output[:, 1] - output[:, 0]
    return vectors @ odds, float(bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, parts: int, out_part: int, train_rows: int) -> tuple[np.ndarray, float]:
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col, parts, out_part))
    known = known.groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("y"))
    known = sample_by_hash(known, F.col("__id"), known.count(), train_rows, 7)
    texts = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).cast("string").alias("text"))
    rows = texts.join(F.broadcast(known), F.col("__doc") == F.col("__id"))
    rows = rows.groupBy("__doc").agg(F.min("text").alias("text"), F.max("y").alias("y"))  # of an id's texts the first
    found = rows.orderBy("__doc").select("y", "text").mapInArrow(_bucket_counts, "y int, ids array<int>, n array<float>").toArrow()
    table = list(zip(found["y"].to_pylist(), (x.values.to_numpy() for x in found["ids"]), (x.values.to_numpy() for x in found["n"]), strict=True))
    if not table:
        return np.zeros(BUCKETS), 0.0
    return train(table)


def score(docs: DataFrame, model: tuple[np.ndarray, float], keep: list[Column], text_col: str = "text") -> DataFrame:
    """The columns `keep`, which may have any names but __text and __score, and __score of each row."""
    shared, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches):
        made = _WORKER.get("sums")
        if made is None or made[0] != name:
            odds, bias = shared.value

            def vectors(pieces: list[str]) -> np.ndarray:
                buckets, of = features(pieces)
                return np.stack([np.bincount(of, odds[buckets], len(pieces)), np.bincount(of, minlength=len(pieces))], 1)

            made = _WORKER["sums"] = (name, bias, PieceSums(vectors, 2))
        _, bias, sums = made
        for batch in slices(batches):
            s = sums.sums(batch.column(batch.num_columns - 1).to_pylist())
            z = np.clip(np.round(s[:, 0] / np.maximum(s[:, 1], 1) + bias, 9), -500, 500)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(1 / (1 + np.exp(-z)))], [*batch.schema.names[:-1], "__score"])

    source = docs.select(*keep, F.col(text_col).cast("string").alias("__text"))
    return source.mapInArrow(run, source.drop("__text").schema.add("__score", "double"))


def classify(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", parts: int = 3, out_part: int = 1, train_rows: int = 2000
) -> DataFrame:
    """id_col, held_out, score, predicted; learns from the labelled rows that are not held out."""
    model = fit(docs, labels, id_col, text_col, label_col, parts, out_part, train_rows)
    scored = score(docs, model, [F.col(id_col)], text_col)
    return scored.select(id_col, held_out(id_col, parts, out_part).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", parts: int = 3, out_part: int = 1, train_rows: int = 2000) -> DataFrame:
    """The rows of docs that the classifier predicts to be of quality 1."""
    model = fit(docs, labels, id_col, text_col, label_col, parts, out_part, train_rows)
    whole = score(docs, model, [F.struct(*docs.columns).alias("__row")], text_col)  # as one column: no name of theirs can clash
    return whole.where("__score >= 0.5").select("__row.*")
