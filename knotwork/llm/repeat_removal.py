"""Removal of byte strings that repeat anywhere in a corpus, by suffix arrays over shards of candidates.

A string of `least` bytes is repeated if it also starts at another place, in the same text or another. Each place where
such a string starts has an anchor: in the string, the gram of the least hash (the leftmost of equal ones). Equal strings
have equal grams at equal distance, so strings need to be compared only where their anchors' grams are equal, whatever
texts they lie in. An anchor owns a run of consecutive starts, and its context is all bytes of their strings.

1. Every text gives a row for each anchor, about one in 75 bytes: hashes of its gram and of its context, and where it is.
2. Counts by gram tell anchors that stand alone (dropped), those whose contexts are all equal (repeated throughout), and
   the mixed ones. Of these, equal contexts are counted (repeated throughout if there are two), and each different one is
   fetched from one text.
3. Different contexts of a gram meet in a shard, which builds the suffix array of what it holds by induced sorting and
   the permuted common prefixes; a start is repeated if it shares `least` bytes with a neighbour. A gram with more
   contexts than a shard should hold is no group of its own: its strings are hashed one by one and counted, which Spark
   adds up in each task before it shuffles.
4. The runs go back to the texts, whose covered bytes are removed.

Anchors, counts and runs are joined by Spark; hot keys are counted by partial aggregation, or joined by sort-merge joins
that adaptive execution splits. Grams and contexts are named by 64-bit hashes, rows of texts by a 64-bit hash of id and text.

Defined results: null and empty texts, and those shorter than `least`, lose nothing. Rows with equal id and text are
repeats of each other and lose all that is long enough. Overlapping occurrences count. Other columns are passed through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.llm.common import map_batches, slices, texts_of
from knotwork.llm.suffix_array import repeated_places
from knotwork.session import materialize

_ODD, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xFF51AFD7ED558CCD)
#: Texts are read in blocks of this many bytes, so that a place fits the low bits of an anchor's rank.
_BLOCK = 1 << 23


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the gram at each place, by doubling: the hash of two neighbours from theirs."""
    power, hashes, joined, length = _ODD, data.astype(np.uint64) + np.uint64(1), None, 0
    span, left = 1, gram
    while left:
        if left & 1:
            if joined is None:
                joined, length = hashes, span
            else:
                n = len(data) - length - span + 1
                joined, length = joined[:n] * np.uint64(power) + hashes[length : length + n], length + span
        left >>= 1
        if left:
            n = len(data) - 2 * span + 1
            if n <= 0:
                return np.zeros(0, np.uint64)
            hashes = hashes[:n] * np.uint64(power) + hashes[span : span + n]
            power, span = power * power % (1 << 64), 2 * span
    joined = (joined ^ (joined >> np.uint64(32))) * _MIX
    return joined ^ (joined >> np.uint64(29))


def anchors(data: bytes, least: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of gram, first start, last start) of each anchor, in order of starts."""
    found = []
    for at in range(0, max(1, len(data) - least + 1), _BLOCK):
        block = np.frombuffer(data[at : at + _BLOCK + least - 1], np.uint8)
        if len(block) < least:
            break
        hashes = gram_hashes(block, gram)
        low = np.uint64((1 << 24) - 1)
        rank = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
        window, span = least - gram + 1, 1
        while span * 2 <= window:
            rank, span = np.minimum(rank[:-span], rank[span:]), span * 2
        if window > span:
            rank = np.minimum(rank[: len(rank) - window + span], rank[window - span :])
        place = (rank & low).astype(np.int64)
        first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        last = np.append(first[1:], len(place)) - 1
        found.append((hashes[place[first]].view(np.int64), first + at, last + at))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _keyed(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.withColumn("_rid", F.xxhash64(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("null")), F.col(f"`{text}`")))


def _anchor_rows(keyed: DataFrame, least: int, gram: int, text: str) -> DataFrame:
    def make():
        def work(batch: pa.RecordBatch) -> Iterator[dict[str, list]]:
            for part in slices(batch, 256):
                out: dict[str, list] = {c: [] for c in ("rid", "gram", "context", "start", "starts")}
                for rid, value in zip(part.column("rid").to_pylist(), texts_of(part), strict=True):
                    data = value.encode()
                    if len(data) < least:
                        continue
                    hashes, first, last = anchors(data, least, gram)
                    digest = xxhash.xxh3_64_intdigest
                    context = np.array([digest(data[i:j]) for i, j in zip(first.tolist(), (last + least).tolist(), strict=True)], np.uint64)
                    for c, x in (("rid", np.full(len(hashes), rid)), ("gram", hashes), ("context", context.view(np.int64)), ("start", first), ("starts", (last - first + 1).astype(np.int32))):
                        out[c].append(x)
                if out["rid"]:
                    yield {c: np.concatenate(x) for c, x in out.items()}

        return work

    return map_batches(keyed.select(F.col("_rid").alias("rid"), F.col(f"`{text}`").alias("text")), make, "rid long, gram long, context long, start long, starts int")


def _contexts(keyed: DataFrame, wanted: DataFrame, least: int, text: str) -> DataFrame:
    """(gram, context, data): the bytes of each wanted context, from the text that was named for it."""
    lists = wanted.groupBy("rid").agg(F.collect_list(F.struct("start", "starts", "gram", "context")).alias("asked"))
    texts = keyed.select(F.col("_rid").alias("rid"), F.col(f"`{text}`").alias("text")).join(lists, "rid")

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[dict[str, list]]:
            out: dict[str, list] = {"gram": [], "context": [], "data": []}
            for value, asked in zip(texts_of(batch), batch.column("asked").to_pylist(), strict=True):
                data = value.encode()
                for x in asked:
                    out["gram"].append(x["gram"])
                    out["context"].append(x["context"])
                    out["data"].append(data[x["start"] : x["start"] + x["starts"] + least - 1])
            yield out

        return work

    # equal rows of texts would fetch the same context again
    return map_batches(texts.select("text", "asked"), make, "gram long, context long, data binary").dropDuplicates(["gram", "context"])


def _runs(flags: np.ndarray) -> list[int]:
    """Begin and end (exclusive) of each run of true flags, in one list."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return edges.tolist()


def _sharded(contexts: DataFrame, least: int, shard_bytes: int) -> DataFrame:
    """(gram, context, runs): the repeated starts of each context among the different contexts of its gram."""

    def solve(rows: list[tuple[int, int, bytes]]) -> dict[str, list]:
        # 0xfe and 0xff never occur in UTF-8: the one parts the contexts, the other leaves room for letters from 1
        joined = np.frombuffer(b"\xfe".join(d for _, _, d in rows), np.uint8)
        letters = joined + np.uint8(1)
        found = repeated_places(letters, least)
        out: dict[str, list] = {"gram": [], "context": [], "runs": []}
        at = 0
        for gram, context, data in rows:
            runs = _runs(found[at : at + len(data) - least + 1])
            at += len(data) + 1
            if runs:
                out["gram"].append(gram)
                out["context"].append(context)
                out["runs"].append(runs)
        return out

    placed = contexts.repartition("gram").sortWithinPartitions("gram", "context").select("gram", "context", "data")

    from pyspark.sql.pandas.types import to_arrow_schema

    fields = contexts.sparkSession.createDataFrame([], "gram long, context long, runs array<int>").schema
    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("gram", "context", "data")), strict=True):
                if size >= shard_bytes and held[-1][0] != row[0]:
                    yield pa.RecordBatch.from_pydict(solve(held), schema=arrow)
                    held, size = [], 0
                held.append(row)
                size += len(row[2])
        if held:
            yield pa.RecordBatch.from_pydict(solve(held), schema=arrow)

    return placed.mapInArrow(run, fields)


def _hashed(contexts: DataFrame, least: int) -> DataFrame:
    """The same for grams of very many contexts: each string hashed and counted."""

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[dict[str, list]]:
            for part in slices(batch, 256):
                out: dict[str, list] = {c: [] for c in ("gram", "context", "at", "string")}
                for gram, context, data in zip(*(part.column(c).to_pylist() for c in ("gram", "context", "data")), strict=True):
                    for i in range(len(data) - least + 1):
                        out["gram"].append(gram)
                        out["context"].append(context)
                        out["at"].append(i)
                        out["string"].append(xxhash.xxh3_64_intdigest(data[i : i + least]) - (1 << 63))
                yield out

        return work

    rows = map_batches(contexts, make, "gram long, context long, at int, string long")
    twice = rows.groupBy("gram", "string").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram", "string")
    starts = rows.join(twice, ["gram", "string"], "left_semi").groupBy("gram", "context").agg(F.sort_array(F.collect_list("at")).alias("at"))
    # a run ends where the next start is not the next place
    edge = F.filter(F.transform("at", lambda x, i: F.when(F.coalesce(F.get("at", i - 1), F.lit(-2)) != x - 1, x)), lambda x: x.isNotNull())
    stop = F.filter(F.transform("at", lambda x, i: F.when(F.coalesce(F.get("at", i + 1), F.lit(-2)) != x + 1, x + 1)), lambda x: x.isNotNull())
    return starts.select("gram", "context", F.flatten(F.zip_with(edge, stop, lambda a, b: F.array(a, b))).alias("runs"))


def repeated_runs(df: DataFrame, least: int = 200, gram: int = 40, shard_bytes: int = 2 << 20, most_contexts: int = 1 << 14, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(rid, runs): for each text with repeats, by the hash of id and text, begin and end of its runs of repeated starts."""
    keyed = _keyed(df, key, text)
    rows = materialize(_anchor_rows(keyed, least, gram, text), "anchors")
    grams = rows.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.min("context").alias("low"), F.max("context").alias("high")).where("n > 1").select("gram", (F.col("low") != F.col("high")).alias("mixed"))
    grams = materialize(grams, "grams")  # so that both sides of the join are plain shuffles, which Spark can split where a gram is hot
    shared = materialize(rows.join(grams, "gram"), "shared")
    mixed = shared.where("mixed")
    kinds = mixed.groupBy("gram", "context").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rid", "start", "starts")).alias("one"))
    kinds = materialize(kinds.select("gram", "context", "n", "one.rid", "one.start", "one.starts"), "kinds")
    hot = materialize(kinds.groupBy("gram").agg(F.count(F.lit(1)).alias("contexts")).where(F.col("contexts") > most_contexts).select("gram"), "hot")
    contexts = materialize(_contexts(keyed, kinds, least, text), "contexts")
    partly = _sharded(contexts.join(hot, "gram", "left_anti"), least, shard_bytes).unionByName(_hashed(contexts.join(hot, "gram", "left_semi"), least))
    partly = materialize(partly, "partly")
    whole = kinds.where("n > 1").select("gram", "context", F.lit(True).alias("whole"))
    solved = whole.join(partly, ["gram", "context"], "full").select("gram", "context", F.coalesce("whole", F.lit(False)).alias("whole"), "runs")
    solved = materialize(solved, "solved")
    of_mixed = mixed.join(solved, ["gram", "context"]).select("rid", "start", F.when(F.col("whole"), F.array(F.lit(0), F.col("starts"))).otherwise(F.col("runs")).alias("runs"))
    of_equal = shared.where("not mixed").select("rid", "start", F.array(F.lit(0), F.col("starts")).alias("runs"))
    moved = of_mixed.unionByName(of_equal).select("rid", F.transform("runs", lambda x: x + F.col("start")).alias("runs"))
    # equal rows of texts have each run once for every row; a set keeps the list as long as one text's
    return moved.groupBy("rid").agg(F.flatten(F.sort_array(F.collect_set("runs"))).alias("runs"))


def kept_parts(data: bytes, runs: list[int] | None, least: int) -> tuple[list[tuple[int, int]], int]:
    """The parts that stay, and the number of maximal removed runs."""
    removed: list[list[int]] = []
    pairs = sorted(zip((runs or [])[::2], (runs or [])[1::2], strict=True))
    for begin, end in pairs:
        if removed and begin <= removed[-1][1]:
            removed[-1][1] = max(removed[-1][1], end - 1 + least)
        else:
            removed.append([begin, end - 1 + least])
    edges = [0, *(x for span in removed for x in span), len(data)]
    return [(a, b) for a, b in zip(edges[::2], edges[1::2], strict=True) if a < b], len(removed)


def removal_digests(df: DataFrame, least: int = 200, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    runs = repeated_runs(df, least, key=key, text=text)
    joined = _keyed(df.select(F.col(f"`{key}`"), F.col(f"`{text}`")), key, text).join(runs.withColumnRenamed("rid", "_rid"), "_rid", "left")
    kind = df.schema[key].dataType.simpleString()

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[dict[str, list]]:
            for part in slices(batch):
                out: dict[str, list] = {key: part.column("key").to_pylist(), "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []}
                for value, found in zip(texts_of(part), part.column("runs").to_pylist(), strict=True):
                    data = value.encode()
                    parts, spans = kept_parts(data, found, least)
                    rest = b"".join([data[a:b] for a, b in parts])
                    out["n_bytes"].append(len(data))
                    out["n_removed"].append(len(data) - len(rest))
                    out["n_spans"].append(spans)
                    out["kept_sha256"].append(hashlib.sha256(rest).hexdigest())
                yield out

        return work

    return map_batches(joined.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), "runs"), make, f"`{key}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(df: DataFrame, least: int = 200, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df with the repeated bytes of every text removed; a character that is cut by a removed run goes with it. Null stays null.
    Other columns pass through, whatever their names."""
    runs = repeated_runs(df, least, key=key, text=text)
    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), F.struct(*(F.col(f"`{c}`") for c in df.columns if c != text)).alias("row"))
    joined = _keyed(rows, "key", "text").join(runs.withColumnRenamed("rid", "_rid"), "_rid", "left")

    rest = F.pandas_udf(lambda texts, found: pd.Series([_rest(t, r, least) for t, r in zip(texts, found, strict=True)], dtype=object), "string")
    cut = F.when(F.col("runs").isNull(), F.col("text")).otherwise(rest(F.col("text"), F.col("runs")))
    return joined.select(*(cut.alias(text) if c == text else F.col(f"row.`{c}`") for c in df.columns))


def _rest(value: str | None, runs: list[int] | None, least: int) -> str | None:
    if value is None or runs is None:
        return value
    data = value.encode()
    parts, _ = kept_parts(data, [int(x) for x in runs], least)
    return "".join([data[a:b].decode(errors="ignore") for a, b in parts])
