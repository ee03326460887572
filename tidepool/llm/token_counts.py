"""Token counts of whole texts, as a tokenizers-library vocabulary gives them.

Two tiers. A compact table of frequent pre-tokens and their token counts is broadcast (bounded
by `frequent_size` entries); other pre-tokens are encoded by the library itself and kept in bounded
caches of the Python workers, as are the sums of " word" pieces, so that most words cost one lookup. No
pre-token is ever shuffled: the table's frequencies come from mergeable fixed-size frequency sketches over all
texts, merged FAN at a time in as many levels as it takes.
The table and the caches only save work: counts are the library's for any table, also an empty one.

Defined results: a null text counts as empty (0 bytes, 0 tokens); a very long text is counted whole; repeated
rows each give a row; an empty table gives an empty result; ties in frequency change the table, never a count;
other columns are ignored, and the result's names win over theirs. The added special token's string inside a
text is one token, the library's default. A vocabulary with a normaliser or another kind of pre-tokens than
byte-level ones encodes whole texts.
"""
from __future__ import annotations

import json
import os
import uuid

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

from .chunks import KEEP_CHARS, Cache, pieces
from .common import cut, slices

_WORKER: dict = {}
#: Fixed value: the byte-level pre-token pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Sketches that one task merges.
FAN = 8


def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def specials(t) -> list[str]:
    return [x.content for x in t.get_added_tokens_decoder().values()]


def lengths(t, texts: list[str]) -> list[int]:
    many = getattr(t, "encode_batch_fast", t.encode_batch)
    return [len(e.ids) for e in many(texts, add_special_tokens=False)]


def frequent_pretokens(docs: DataFrame, text_col: str, size: int) -> list[str]:
    """The `size` most frequent pre-tokens of the most frequent words (what stands between spaces) over all texts.

    Words are counted by approximate top-k sketches: each partition keeps one of at most 4 * size items, and no task
    ever merges more than FAN of them.
    """
    words = docs.where(F.col(text_col).isNotNull()).select(
        F.explode(F.split(F.col(text_col), " ")).alias("w"), F.floor(F.spark_partition_id() / FAN).alias("g")
    ).where("length(w) between 1 and 64")
    tracked = 4 * size
    level = cut(words.groupBy("g").agg(F.expr(f"approx_top_k_accumulate(w, {tracked})").alias("s")))
    groups = level.agg(F.max("g")).first()[0]
    while groups:
        level = level.groupBy(F.floor(F.col("g") / FAN).alias("g")).agg(F.expr(f"approx_top_k_combine(s, {tracked})").alias("s"))
        groups //= FAN
    top = level.select(F.expr(f"approx_top_k_estimate(s, {size})").alias("top")).collect()
    seen: dict[str, int] = {}
    for row in top:
        for x in row["top"] or []:
            for p in regex.findall(PATTERN, " " + (x["item"] or "")):
                seen[p] = seen.get(p, 0) + x["count"]
    return sorted(seen, key=lambda p: (-seen[p], p))[:size]


def frequent_table(t, words: list[str]) -> dict[str, int]:
    words = [w for w in words if not any(s in w for s in specials(t))]
    return dict(zip(words, lengths(t, words), strict=True))


def by_pretokens(t) -> bool:
    """Whether pre-tokens are those of the byte-level pattern and can be encoded alone."""
    kind = json.loads(t.to_str())
    pre = kind.get("pre_tokenizer") or {}
    return kind.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)


class Counter:
    """Token counts of pieces: the table of frequent pre-tokens first, then a bounded cache of encoded ones."""

    def __init__(self, t, table: dict[str, int], most: int = 400_000):
        self.t, self.table, self.most = t, table, most
        self.find = regex.compile(PATTERN).findall
        self.cache: dict[str, int] = {}

    def __call__(self, texts: list[str]) -> list[int]:
        found = [self.find(x) for x in texts]
        table = self.table
        rare = {p for f in found for p in f if p not in table}
        missing = rare - self.cache.keys()
        if len(self.cache) + len(missing) > self.most:
            self.cache = {}
            missing = rare
        new = list(missing)
        cache = self.cache
        cache.update(zip(new, lengths(self.t, new), strict=True))
        out = [sum(table[p] if p in table else cache[p] for p in f) for f in found]
        for p in new:
            if len(p) > KEEP_CHARS:
                del cache[p]
        return out


def count_tokens(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", frequent_size: int = 16384, words: list[str] | None = None
) -> DataFrame:
    """id_col, n_bytes and n_tokens of each row. words: a table of frequent pre-tokens made before."""
    t = tokenizer(path)
    whole = not by_pretokens(t)
    table = {} if whole else frequent_table(t, frequent_pretokens(docs, text_col, frequent_size) if words is None else words)
    shared, name = docs.sparkSession.sparkContext.broadcast(table), uuid.uuid4().hex

    def count(batches):
        made = _WORKER.get(path)
        if made is None or made[0] != name:
            t = tokenizer(path)
            made = _WORKER[path] = (name, t, specials(t), Cache(Counter(t, shared.value)))
        _, t, special, cache = made
        for batch in slices(batches):
            col = batch.column(1)
            texts = [x or "" for x in col.to_pylist()]
            cut = [None if whole or any(s in x for s in special) else pieces(x) for x in texts]
            drop = cache.fill([c for c in cut if c])
            get = cache.known.__getitem__
            heads = iter(cache.many([c[0] for c in cut if c]))
            uncut = iter(lengths(t, [x for c, x in zip(cut, texts, strict=True) if not c]))
            n = [next(heads) + sum(map(get, c[1:])) if c else next(uncut) for c in cut]
            cache.forget(drop)
            size = pc.fill_null(pc.binary_length(col.cast(pa.string())), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)
