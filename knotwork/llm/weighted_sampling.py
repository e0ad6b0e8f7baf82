"""Fingerprints by consistent weighted sampling: two of them collide as often as their texts' words are alike.

A text's terms are its words, A-Z as lower case; a word weighs its occurrences times its code points, since short words are
common everywhere. For each of SAMPLES draws, a term has its own r and c from a gamma distribution of shape 2 and its own
uniform shift b, all from a hash of the word. A weight is rounded down on the term's own logarithmic grid, t = floor(ln w / r +
b), and the term with the least ln c - r (t - b + 1) is taken. Two texts take the same (term, t) with the probability of their
generalised Jaccard similarity, the sum of the lesser weights over the sum of the greater ones. A fingerprint has 16 bits of a
hash of each draw as four hexadecimal digits.

next_edits() compares each text with an edited one, which ends with the beginning of the next text by id. The texts are
dealt out by ranges of ids and read in order, once; a task knows the next row but at its end. It keeps its first and last
text aside for that: at most two for each task, which are joined by the number of the range that follows.

Defined results: null counts as an empty text. A text without words has an empty fingerprint, which is like itself (1) and
unlike all others (0). Rows are ordered by id, null ids first, and rows of one id by a hash of their text, so repeated rows
follow each other. A single row is its own next. An empty table gives no rows. Texts of any length are read whole. Ids are
read as long integers. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotwork.llm.common import map_batches, slices, texts_of
from knotwork.session import materialize

SAMPLES = 64
#: Words whose numbers a task keeps; rows of a table that are compared or made at once.
_KEPT, _ROWS, _MADE = 1 << 15, 1 << 10, 1 << 8
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]
#: Minus the logarithm of the middle of each of 2^16 steps between 0 and 1.
_EXPONENTIAL = -np.log((np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.float32)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX[1]
    x = (x ^ (x >> np.uint64(33))) * _MIX[2]
    return x ^ (x >> np.uint64(33))


def _numbers(words: np.ndarray, samples: int, nth: int) -> np.ndarray:
    """A 32-bit number for each word and draw: a sum of products, whose bits are then spread. Words are hashes, so once is enough."""
    keys = _mixed(np.arange(1, samples + 1, dtype=np.uint64) * _MIX[0] + np.uint64(nth))
    low, high = (words & np.uint64(0xFFFFFFFF)).astype(np.uint32), (words >> np.uint64(32)).astype(np.uint32)
    x = low[:, None] * (keys.astype(np.uint32) | np.uint32(1))
    x += high[:, None] * ((keys >> np.uint64(32)).astype(np.uint32) | np.uint32(1))
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(15)
    return x


def draws(words: np.ndarray, samples: int = SAMPLES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r, ln c and b of hashed words, a row for each word and a column for each draw."""
    one, two, three = (_numbers(words, samples, nth) for nth in range(3))
    r, c = (_EXPONENTIAL.take(x & np.uint32(0xFFFF)) + _EXPONENTIAL.take(x >> np.uint32(16)) for x in (one, two))
    return r, np.log(c), (three >> np.uint32(8)).astype(np.float32) * np.float32(2.0**-24)


def _steps(weight: np.ndarray, r: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The logarithms of weights on the terms' own grids."""
    return np.floor(weight / r + b)


def _values(weights: np.ndarray, r: np.ndarray, c: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What the least of is taken, for words of such weights."""
    t = _steps(np.log(weights).astype(np.float32)[:, None], r, b)
    t -= b
    t += np.float32(1)
    t *= r
    return np.subtract(c, t, out=t)


class Sampler:
    """Fingerprints of texts, one after the other. What it keeps of frequent words changes no result."""

    def __init__(self, samples: int = SAMPLES) -> None:
        self.samples, self.place = samples, {}
        self.hashes, self.lengths = np.zeros(_KEPT, np.uint64), np.zeros(_KEPT, np.int64)
        self.r, self.c, self.b, self.single = (np.zeros((_KEPT, samples), np.float32) for _ in range(4))

    def _rows(self, words: list[bytes]) -> np.ndarray:
        """Where the numbers of at most _ROWS distinct words lie in the tables; new words are added."""
        rows = np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(rows < 0)
        begin = len(self.place)
        if begin + len(missing) > _KEPT:
            self.place.clear()
            return self._rows(words)
        rows[missing] = np.arange(begin, begin + len(missing))
        new = [words[i] for i in missing.tolist()]
        self.place.update(zip(new, range(begin, begin + len(new)), strict=True))
        for k in range(0, len(new), _MADE):
            some = new[k : k + _MADE]
            at = slice(begin + k, begin + k + len(some))
            self.hashes[at] = list(map(xxhash.xxh3_64_intdigest, some))
            self.lengths[at] = [len(w.decode()) for w in some]
            self.r[at], self.c[at], self.b[at] = r, c, b = draws(self.hashes[at], self.samples)
            self.single[at] = _values(self.lengths[at], r, c, b)
        return rows

    def fingerprint(self, text: str) -> np.ndarray:
        """The draws of a text as 16-bit numbers, none where it has no words."""
        counted = Counter(text.encode().lower().split())
        words, often = list(counted), np.fromiter(counted.values(), np.int64, len(counted))
        least, taken, column = np.full(self.samples, np.inf, np.float32), np.zeros(self.samples, np.uint64), np.arange(self.samples)
        for at in range(0, len(words), _ROWS):
            rows = self._rows(words[at : at + _ROWS])
            weight = often[at : at + _ROWS] * self.lengths[rows]
            value = self.single.take(rows, axis=0)
            repeated = np.flatnonzero(often[at : at + _ROWS] > 1)
            again = rows[repeated]
            value[repeated] = _values(weight[repeated], self.r[again], self.c[again], self.b[again])
            first = value.argmin(axis=0)
            found, row = value[first, column], rows[first]
            t = _steps(np.log(weight[first]).astype(np.float32), self.r[row, column], self.b[row, column])
            label = _mixed(self.hashes[row] + t.astype(np.int64).astype(np.uint64) * _MIX[0])
            taken = np.where(found < least, label, taken)
            least = np.minimum(found, least)
        return (taken >> np.uint64(48)).astype(">u2") if words else np.zeros(0, ">u2")


def likeness(one: np.ndarray, two: np.ndarray) -> float:
    """The share of draws that collide."""
    if not len(one) or not len(two):
        return float(len(one) == len(two))
    return float(np.mean(one == two))


def edited_text(text: str, following: str) -> str:
    """text with its last quarter replaced by as much of the beginning of the following one."""
    part = len(text) // 4
    return text[: len(text) - part] + following[:part]


def fingerprints(df: DataFrame, text: str = "text", into: str = "fingerprint", samples: int = SAMPLES) -> DataFrame:
    """Adds the fingerprint of a text column as hexadecimal digits. A map over rows; a column of that name is replaced."""
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        sampler = Sampler(samples)
        for values in batches:
            yield values.map(lambda x: sampler.fingerprint(x or "").tobytes().hex())

    return df.withColumn(into, run(F.col(f"`{text}`")))


#: Columns of a result, and what else a task tells: 0 a result, 1 its first text, 2 its last one, whose next it doesn't see.
_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_TOLD = f"{_RESULT}, kind int, part int, text string"


def _result(sampler: Sampler, ident: int | None, text: str, own: np.ndarray, following: str, other: np.ndarray) -> tuple:
    changed = edited_text(text, following)
    edited = own if changed == text else sampler.fingerprint(changed)
    return ident, len(text), hashlib.sha256(changed.encode()).hexdigest(), own.tobytes().hex(), edited.tobytes().hex(), likeness(own, edited), likeness(own, other)


def next_edits(df: DataFrame, key: str = "doc_id", text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """A row for each of df: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    source = df.select(F.col(f"`{key}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("_row"))
    order = ["id", F.xxhash64("text"), "_row"]  # the last deals out even equal rows
    dealt = source.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text")
    from pyspark.sql.pandas.types import to_arrow_schema

    told = df.sparkSession.createDataFrame([], _TOLD).schema
    arrow = to_arrow_schema(told)
    none = (None,) * 7

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, part, last = Sampler(samples), TaskContext.get().partitionId(), None

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)], schema=arrow)

        for batch in batches:
            for piece in slices(batch):
                rows = []
                for ident, value in zip(piece.column("id").to_pylist(), texts_of(piece), strict=True):
                    own = sampler.fingerprint(value)
                    if last is None:
                        rows.append((*none, 1, part, value))
                    else:
                        rows.append((*_result(sampler, *last, value, own), 0, part, None))
                    last = ident, value, own
                yield batch_of(rows)
        if last is not None:
            yield batch_of([(last[0], *none[1:], 2, part, last[1])])

    found = materialize(dealt.mapInArrow(read, told), "fingerprints")
    parts = found.where("kind = 1").select("part")  # a row for each task
    whole = Window.orderBy("part")
    following = parts.withColumn("_next", F.coalesce(F.lead("part").over(whole), F.first("part").over(whole)))
    heads = found.where("kind = 1").select(F.col("part").alias("_next"), F.col("text").alias("following"))
    ends = found.where("kind = 2").select(F.col("doc_id").alias("id"), "part", "text").join(following, "part").join(heads, "_next").select("id", "text", "following")

    def make():
        sampler = Sampler(samples)

        def work(batch: pa.RecordBatch) -> Iterator[dict[str, list]]:
            rows = [_result(sampler, i, t, sampler.fingerprint(t), n, sampler.fingerprint(n)) for i, t, n in zip(batch.column("id").to_pylist(), texts_of(batch), texts_of(batch, "following"), strict=True)]
            yield {name.split()[0]: [r[i] for r in rows] for i, name in enumerate(_RESULT.split(", "))}

        return work

    results = [name.split()[0] for name in _RESULT.split(", ")]
    return found.where("kind = 0").select(*results).unionByName(map_batches(ends, make, _RESULT))
