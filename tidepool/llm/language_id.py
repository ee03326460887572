"""Language of whole texts: known words first, then ever shorter character n-grams.

A known word scores its log frequency in each language. An unseen word backs off: at each of its
positions the longest known character n-gram (5 down to 1, with ^ and $ as its borders) scores its
log frequency, and the word scores the mean over its positions; a position without any known n-gram
says nothing. A text's score for a language is the sum over its words, and the reported score is the
soft maximum of those sums over the root of the number of words.

The model is fitted on a sample of the learnable rows, chosen by a hash of the id: about `train_rows` of them at
most and about `train_chars` characters of text at most. Every word and n-gram of the sample is in the model: no
table is cut by its size. The bound on the characters bounds the model, which is a sorted array of 64-bit keys
with the languages that each was seen in; workers look up all new words of a slice at once. Prediction
reads every whole text, and nothing but the text.

Defined results: a null text, or one without a letter, is `und` with score 0; without a learnable row
every text is `und` with score 0; ties go to the first language by code point; very long texts are read whole,
their words like those of others; repeated rows each give a row and count each when learned from; an empty table
gives an empty result; a null id is never held out; other columns are ignored.
"""
from __future__ import annotations

import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from .common import sample_by_hash, slices
from .piece_sums import PieceSums
from .shingles import U, mix

_WORKER: dict = {}
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
LONGEST = 5
#: Added to every count, so that a word has some chance in languages that it was not seen in.
SMOOTH = 0.1


def words_of(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def held_out(id_col: str, parts: int, part: int) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == part, F.lit(False))


def keys_of(words: list[str]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """A key for each word, and for each n-gram length from 1 up: key, word and place (over all words) of every n-gram of ^word$."""
    size = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    c = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(words)), size)
    start = np.cumsum(size) - size
    at = np.arange(len(c)) - start[word]
    whole = mix(np.add.reduceat(mix(c + at.astype(np.uint64) * U(0x9E3779B97F4A7C15)), start) + size.astype(np.uint64)) if len(words) else np.zeros(0, np.uint64)
    grams = []
    for k in range(1, LONGEST + 1):
        n = max(0, len(c) - k + 1)
        h = np.full(n, k, np.uint64)
        for j in range(k):
            h = mix(h * U(0x9E3779B97F4A7C15) + c[j : j + n])
        inside = word[:n] == word[k - 1 :]
        grams.append((h[inside], word[:n][inside], np.flatnonzero(inside)))
    return whole, grams


def _count_words(batches):
    for batch in slices(batches):
        seen: dict[str, Counter] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            seen.setdefault(lang, Counter()).update(words_of(text))
        rows = [(lang, w, n) for lang, c in seen.items() for w, n in c.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["lang", "word", "n"])


def _count_keys(batches):
    """From (lang, word, n): lang, k (0: words, else the length of n-grams), key, n."""
    for batch in slices(batches, 8192):
        langs = batch.column(0).dictionary_encode()
        lang, n = langs.indices.to_numpy(), batch.column(2).to_numpy()
        whole, grams = keys_of(batch.column(1).to_pylist())
        out = [(lang, np.zeros(len(whole), np.int32), whole, n)]
        for k, (key, word, _) in enumerate(grams, 1):
            pair = np.stack([lang[word].astype(np.uint64), key], 1)
            found, of = np.unique(pair, axis=0, return_inverse=True)
            out.append((found[:, 0].astype(np.int32), np.full(len(found), k, np.int32), found[:, 1], np.bincount(of.ravel(), n[word], len(found)).astype(np.int64)))
        lang, k, key, n = (np.concatenate(x) for x in zip(*out, strict=True))
        yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(lang)), pa.array(k), pa.array(key.view(np.int64)), pa.array(n)], ["lang", "k", "key", "n"])


class Model:
    """Log frequencies by language: `base` of what a language has not seen, plus `more` where it has.

    One sorted table for words (0) and one for n-grams of each length; a key's entries are from `first` on.
    """

    def __init__(self, langs: list[str], lang: np.ndarray, k: np.ndarray, key: np.ndarray, n: np.ndarray):
        self.langs = langs
        self.base = np.zeros((LONGEST + 1, len(langs)))
        self.keys, self.first, self.lang, self.more = [], [], [], []
        for length in range(LONGEST + 1):
            own = np.flatnonzero(k == length)
            own = own[np.lexsort((lang[own], key[own]))]
            keys, first = np.unique(key[own], return_index=True)
            total = np.bincount(lang[own], n[own], len(langs))
            if len(keys):
                self.base[length] = np.log(SMOOTH / (total + SMOOTH * len(keys)))
            self.keys.append(keys)
            self.first.append(np.append(first, len(own)).astype(np.int64))
            self.lang.append(lang[own].astype(np.int32))
            self.more.append(np.log(1 + n[own] / SMOOTH))

    def find(self, length: int, key: np.ndarray) -> np.ndarray:
        """The place of each key in its table, -1 where it is not known."""
        keys = self.keys[length]
        if not len(keys):
            return np.full(len(key), -1)
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where(keys[at] == key, at, -1)

    def add(self, out: np.ndarray, row: np.ndarray, length: int, at: np.ndarray) -> None:
        """Adds the log frequencies of the entries `at` to these rows of out."""
        m = len(self.langs)
        out += np.bincount(row, minlength=len(out))[:, None] * self.base[length]
        first = self.first[length][at]
        n = self.first[length][at + 1] - first
        entry = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        out += np.bincount(np.repeat(row, n) * m + self.lang[length][entry], self.more[length][entry], len(out) * m).reshape(out.shape)

    def scores(self, words: list[str]) -> np.ndarray:
        """A row for each word, a number for each language."""
        out = np.zeros((len(words), len(self.langs)))
        if not words or not self.langs:
            return out
        whole, grams = keys_of(words)
        known = self.find(0, whole)
        self.add(out, np.flatnonzero(known >= 0), 0, known[known >= 0])
        new = known < 0
        backed, places = np.zeros_like(out), np.zeros(len(words))
        free = new[grams[0][1]]  # the places of new words where no n-gram has been found yet
        for length in range(LONGEST, 0, -1):
            key, word, place = grams[length - 1]
            some = free[place]
            key, word, place = key[some], word[some], place[some]
            found = self.find(length, key)
            word, place, found = word[found >= 0], place[found >= 0], found[found >= 0]
            self.add(backed, word, length, found)
            places += np.bincount(word, minlength=len(words))
            free[place] = False
        return np.where(new[:, None], backed / np.maximum(places, 1)[:, None], out)


def fit(learn: DataFrame) -> Model:
    """learn: lang, text, neither null, as many rows as the driver may hold the words of."""
    words = learn.select("lang", "text").mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = words.mapInArrow(_count_keys, "lang string, k int, key long, n long").groupBy("lang", "k", "key").agg(F.sum("n").alias("n"))
    found = counts.toArrow().combine_chunks()
    of = found["lang"].combine_chunks().dictionary_encode() if found.num_rows else pa.array([], pa.string()).dictionary_encode()
    names = of.dictionary.to_pylist()
    langs = sorted(names)
    place = np.array([langs.index(x) for x in names], np.int64)
    lang = place[of.indices.to_numpy()] if found.num_rows else np.zeros(0, np.int64)
    return Model(langs, lang, found["k"].to_numpy(), found["key"].to_numpy().view(np.uint64), found["n"].to_numpy())


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, lang_pred and score of each row."""
    shared, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches):
        made = _WORKER.get("sums")
        if made is None or made[0] != name:
            m = shared.value
            width = len(m.langs) + 1

            def vectors(pieces: list[str]) -> np.ndarray:
                found = [words_of(p) for p in pieces]
                n = np.fromiter(map(len, found), np.int64, len(found))
                row = np.repeat(np.arange(len(found)), n)
                words: dict[str, int] = {}
                at = np.fromiter((words.setdefault(w, len(words)) for f in found for w in f), np.int64, len(row))
                out = np.zeros((len(pieces), width))
                out[:, 0] = n
                np.add.at(out[:, 1:], row, m.scores(list(words))[at])
                return out

            made = _WORKER["sums"] = (name, m.langs, PieceSums(vectors, width, max(10_000, min(500_000, 8_000_000 // width))))
        _, langs, sums = made
        for batch in slices(batches):
            s = sums.sums(batch.column(1).to_pylist())
            pred, score = [], []
            for n, *of in s:
                if not n or not langs:
                    pred.append("und")
                    score.append(0.0)
                    continue
                z = np.round(np.array(of), 9) / np.sqrt(n)
                e = np.exp(z - z.max())
                pred.append(langs[int(z.argmax())])
                score.append(float(e.max() / e.sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["id", "lang_pred", "score"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def identify(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", parts: int = 4, out_part: int = 2, train_rows: int = 20_000, train_chars: int = 50_000_000
) -> DataFrame:
    """id_col, held_out, lang_pred, score; learns from the rows that are not held out."""
    out = held_out(id_col, parts, out_part)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    learn = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("__id", parts, out_part))
    n, chars = learn.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    most = min(train_rows, max(1, n * train_chars // max(1, chars)))
    model = fit(sample_by_hash(learn, F.col("__id"), n, most, 7))
    return predict(docs, model, id_col, text_col).select(id_col, out.alias("held_out"), "lang_pred", "score")
