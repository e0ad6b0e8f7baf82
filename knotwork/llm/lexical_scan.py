"""Ranked lexical search by scanning documents with one automaton of all terms asked for, without an index.

Texts are folded byte by byte: A-Z to lower case, every ASCII character that is neither letter nor digit to a space, runs of
spaces to one. In such a text each term stands between two spaces, so an Aho-Corasick automaton of ` term ` finds terms as
wholes and nothing within longer ones; neighbours share their space. Bytes are read as Latin-1, which keeps the automaton's
alphabet small and changes no match.

The items asked for are taken in blocks of at most ITEMS items and about TERMS distinct terms (a single item may have more),
whose automaton is broadcast. Each block scans the documents twice. The first scan counts, in each task, the documents that
hold each term, and the documents and terms in all; these counts give the weights. The second scan scores: an automaton's
outputs lead over their terms to the items that ask for them. A task keeps each item's best documents only, so what is
shuffled is a few rows for each item and task, however many documents score.

Defined results: null texts, and texts without a term, hold nothing, count as no document and are never found. Each row of
items is an item of its own, also where an id comes twice; an item without terms finds nothing. Rows of documents are
documents of their own, also where they repeat. Equal scores are ordered by id, null ids last; ids of documents are read as
long integers. Empty tables give no rows. Texts of any length are read whole. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from math import floor, log
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotwork.llm.common import slices, texts_of

#: Bounds of a block: items, and distinct terms, beyond which no further item joins it.
ITEMS, TERMS = 1024, 1 << 17
#: Fixed value: what a term is.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_FOLD = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in bytes(range(256)).lower())
#: Cells of documents and items that are scored at once.
_CELLS = 1 << 19
_ID = itemgetter(1)


def terms_of(text: str | None) -> list[str]:
    """The terms of a text in order, as Latin-1 readings of their bytes."""
    return [t.decode("latin-1") for t in (text or "").encode().translate(_FOLD).split()]


@dataclass
class Block:
    """Items by number, their distinct terms, and for each term the items that hold it, with repeats."""

    ids: list = field(default_factory=list)
    terms: dict[str, int] = field(default_factory=dict)
    held: list[list[tuple[int, int]]] = field(default_factory=list)
    weights: list[int] = field(default_factory=list)

    def add(self, ident: object, text: str | None) -> None:
        for term, times in Counter(terms_of(text)).items():
            at = self.terms.setdefault(term, len(self.terms))
            if at == len(self.held):
                self.held.append([])
            self.held[at].append((len(self.ids), times))
        self.ids.append(ident)

    def automaton(self) -> ahocorasick.Automaton:
        machine = ahocorasick.Automaton()
        for term, at in self.terms.items():
            machine.add_word(f" {term} ", at)
        machine.make_automaton()
        return machine


def blocks_of(items: DataFrame, key: str, text: str) -> Iterator[Block]:
    """The items in blocks; the driver holds one at a time."""
    block = Block()
    for row in items.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).toLocalIterator():
        if len(block.ids) >= ITEMS or len(block.terms) >= TERMS:
            yield block
            block = Block()
        block.add(row.key, row.text)
    if block.ids:
        yield block


def _occurrences(text: str, machine: ahocorasick.Automaton) -> tuple[int, Counter]:
    """How many terms a text has, and how often those of the automaton occur."""
    parts = text.encode().translate(_FOLD).split()
    if not parts:
        return 0, Counter()
    return len(parts), Counter(map(_ID, machine.iter(f" {b' '.join(parts).decode('latin-1')} ")))


def _statistics(docs: DataFrame, block: Block) -> tuple[int, int, dict[int, int]]:
    """Documents with a term, terms in all, and for each of the block's terms the documents that hold it."""
    shared = docs.sparkSession.sparkContext.broadcast(block)
    fields = pa.schema([("term", pa.int32()), ("counted", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, holding, documents, total = shared.value.automaton(), Counter(), 0, 0
        for batch in batches:
            for part in slices(batch):
                for text in texts_of(part):
                    n, found = _occurrences(text, machine)
                    documents, total = documents + (n > 0), total + n
                    holding.update(found.keys())
        rows = [(-1, documents), (-2, total), *holding.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=fields)

    counted = docs.mapInArrow(count, "term int, counted long").groupBy("term").agg(F.sum("counted").alias("counted"))
    found = {r.term: r.counted for r in counted.collect()}  # at most a row for each of the block's terms, and two
    shared.unpersist()
    return found.pop(-1, 0), found.pop(-2, 0), found


class _Best:
    """The k best documents of each item of those seen so far: highest scores first, equal ones by id."""

    def __init__(self, items: int, k: int) -> None:
        self.k, self.least, self.waiting, self.room = k, np.ones(items, np.int64), 0, 4 * k * items + (1 << 16)
        self.rows: list[tuple[np.ndarray, ...]] = []

    def add(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        """scores: a row for each document, a column for each item."""
        doc, item = np.nonzero(scores >= self.least)
        if len(doc):
            self.rows.append((item, scores[doc, item], null[doc], ids[doc]))
            self.waiting += len(doc)
            if self.waiting > self.room:
                self.settle()

    def settle(self) -> tuple[np.ndarray, ...]:
        if not self.rows:
            return tuple(np.zeros(0, t) for t in (np.int64, np.int64, bool, np.int64))
        item, score, null, ident = (np.concatenate(c) for c in zip(*self.rows, strict=True))
        order = np.lexsort((ident, null, -score, item))
        item, score, null, ident = item[order], score[order], null[order], ident[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        kept, last = place < self.k, place == self.k - 1
        self.least[item[last]] = score[last]
        self.rows = [(item[kept], score[kept], null[kept], ident[kept])]
        self.waiting = int(kept.sum())
        return self.rows[0]


def _best(docs: DataFrame, block: Block, documents: int, total: int, k: int) -> DataFrame:
    """(item, score, doc_id): each item's k best documents of every task, item as its number in the block."""
    shared = docs.sparkSession.sparkContext.broadcast(block)
    fields = pa.schema([("item", pa.int32()), ("score", pa.int64()), ("doc_id", pa.int64())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        machine, weight, items = asked.automaton(), np.array(asked.weights, np.int64), len(asked.ids)
        many = np.fromiter(map(len, asked.held), np.int64, len(asked.held))
        begin = np.cumsum(many) - many
        item, times = (np.fromiter((pair[i] for own in asked.held for pair in own), np.int64, int(many.sum())) for i in (0, 1))
        best = _Best(items, k)
        for batch in batches:
            for part in slices(batch, max(1, min(512, _CELLS // items))):
                found = [_occurrences(text, machine) for text in texts_of(part)]
                size = np.fromiter((len(f) for _, f in found), np.int64, len(found))
                term = np.fromiter((t for _, f in found for t in f), np.int64, int(size.sum()))
                often = np.fromiter((c for _, f in found for c in f.values()), np.int64, len(term))
                damping = np.array([75 + 25 * n * documents // total for n, _ in found], np.int64)
                doc = np.repeat(np.arange(len(found)), size)
                value = weight[term] * (1_000_000_000 * often // (1000 * often + 12 * damping[doc]))
                each = many[term]
                at = np.repeat(begin[term] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
                scores = np.zeros(len(found) * items, np.int64)
                np.add.at(scores, np.repeat(doc * items, each) + item[at], np.repeat(value, each) * times[at])
                ids = part.column("id")
                best.add(scores.reshape(len(found), items), ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False))
        item_of, scored, null, ident = best.settle()
        yield pa.RecordBatch.from_arrays([pa.array(item_of, pa.int32()), pa.array(scored, pa.int64()), pa.array(ident, pa.int64(), mask=null)], schema=fields)

    return docs.mapInArrow(score, "item int, score long, doc_id long")


def search(docs: DataFrame, items: DataFrame, k: int = 20, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """Each item's k best documents with a score above 0: item_id, rank (from 1), doc_id, score."""
    spark, kind = docs.sparkSession, items.schema[item_key].dataType.simpleString()
    source = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    found = [spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")]
    for block in blocks_of(items, item_key, item_text):
        if not block.terms:
            continue
        documents, total, holding = _statistics(source, block)
        if not documents:
            break
        block.weights = [floor(1000 * log((2 * documents + 2) / (2 * holding.get(t, 0) + 1))) for t in range(len(block.terms))]
        names = spark.createDataFrame(list(enumerate(block.ids)), f"item int, item_id {kind}")
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = _best(source, block, documents, total, k).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        found.append(ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))  # names: at most ITEMS rows
    return reduce(DataFrame.unionByName, found)
