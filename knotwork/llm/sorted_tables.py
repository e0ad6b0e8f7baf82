"""Token ids in sorted-string-table shards: documents keyed by identifier, found by binary search.

A shard holds a range of keys in ascending order. Its file is a run of blocks, a sparse index (the first key and place of
each block), a Bloom filter over the keys, and a footer of fixed length that tells where these lie. In a block, a key is
written as the length of what it shares with the key before it and the bytes that follow; its ids are unsigned
little-endian integers of two bytes if the block's fit, else four. Blocks are compressed.

Rows are dealt into shards by ranges of the key and sorted there; Spark writes a shard in one task, under a temporary
name that is renamed when whole, so a task that runs again replaces its file with the same one. Writing returns one row
of metadata for each shard, which stands for the file list; the counts before each shard follow from it.

Defined results: null text counts as empty. A null key sorts first. Rows of equal keys are kept, in the order of their
texts; a lookup gives all of them. An empty table gives no shard. Other columns play no part.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.llm.common import map_batches, slices, texts_of
from knotwork.llm.word_cache import cached_tokenizer

MAGIC = b"KWSST001"
#: index offset, index length, filter offset, filter length, filter probes, documents, tokens, magic.
FOOTER = struct.Struct("<QQQQIQQ8s")
BLOCK_BYTES, BITS_A_KEY, PROBES = 1 << 16, 10, 7


def key_bytes(key: int | None) -> bytes:
    """Bytes that sort as the keys do; null first."""
    return b"\x00" if key is None else b"\x01" + struct.pack(">Q", key + (1 << 63))


def key_of(data: bytes) -> int | None:
    return None if data == b"\x00" else struct.unpack(">Q", data[1:])[0] - (1 << 63)


def _probes(key: bytes, bits: int, probes: int) -> list[int]:
    a, b = struct.unpack("<QQ", hashlib.blake2b(key, digest_size=16).digest())
    return [(a + i * (b | 1)) % (1 << 64) % bits for i in range(probes)]


class ShardWriter:
    """Takes (key, ids) in ascending order of key and writes one shard to a binary file."""

    def __init__(self, file, block_bytes: int = BLOCK_BYTES) -> None:  # noqa: ANN001
        self.file, self.block_bytes, self.at = file, block_bytes, 0
        self.rows: list[tuple[bytes, np.ndarray]] = []
        self.size = self.docs = self.tokens = 0
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[bytes] = []

    def add(self, key: bytes, ids: np.ndarray) -> None:
        self.rows.append((key, ids))
        if not self.keys or self.keys[-1] != key:
            self.keys.append(key)
        self.size += len(ids) * 4
        self.docs += 1
        self.tokens += len(ids)
        if self.size >= self.block_bytes:
            self._flush()

    def _put(self, data: bytes) -> tuple[int, int]:
        self.file.write(data)
        self.at += len(data)
        return self.at - len(data), len(data)

    def _flush(self) -> None:
        if not self.rows:
            return
        wide = any(len(ids) and ids.max() > 0xFFFF for _, ids in self.rows)
        before, parts = b"", [struct.pack("<BI", wide, len(self.rows))]
        for key, ids in self.rows:
            shared = next((i for i, (x, y) in enumerate(zip(before, key, strict=False)) if x != y), min(len(before), len(key)))
            parts += [struct.pack("<BBI", shared, len(key) - shared, len(ids)), key[shared:], ids.astype("<u4" if wide else "<u2").tobytes()]
            before = key
        raw = b"".join(parts)
        at, length = self._put(struct.pack("<I", len(raw)) + pa.compress(raw, "zstd", asbytes=True))
        self.index.append((self.rows[0][0], at, length))
        self.rows, self.size = [], 0

    def close(self) -> None:
        self._flush()
        index = b"".join(struct.pack("<BQI", len(k), at, length) + k for k, at, length in self.index)
        bits = max(64, len(self.keys) * BITS_A_KEY)
        bloom = np.zeros(-(-bits // 8), np.uint8)
        for key in self.keys:
            for bit in _probes(key, bits, PROBES):
                bloom[bit >> 3] |= 1 << (bit & 7)
        filter_bytes = struct.pack("<Q", bits) + bloom.tobytes()
        places = (*self._put(index), *self._put(filter_bytes))
        self._put(FOOTER.pack(*places, PROBES, self.docs, self.tokens, MAGIC))


class ShardReader:
    """Opens a shard by its footer; reads it in order or looks one key up."""

    def __init__(self, file) -> None:  # noqa: ANN001
        self.file = file
        size = file.size()
        at, length, filter_at, filter_length, self.probes, self.docs, self.tokens, magic = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        data, i, self.firsts, self.places = self._read(at, length), 0, [], []
        while i < len(data):
            n, block_at, block_length = struct.unpack_from("<BQI", data, i)
            i += 13
            self.firsts.append(data[i : i + n])
            self.places.append((block_at, block_length))
            i += n
        found = self._read(filter_at, filter_length)
        self.bits, self.bloom = struct.unpack_from("<Q", found)[0], found[8:]

    def _read(self, at: int, length: int) -> bytes:
        self.file.seek(at)
        return self.file.read(length)

    def block(self, i: int) -> Iterator[tuple[bytes, np.ndarray]]:
        data = self._read(*self.places[i])
        raw = pa.decompress(data[4:], struct.unpack_from("<I", data)[0], "zstd", asbytes=True)
        wide, n = struct.unpack_from("<BI", raw)
        at, key = 5, b""
        for _ in range(n):
            shared, more, length = struct.unpack_from("<BBI", raw, at)
            key = key[:shared] + raw[at + 6 : at + 6 + more]
            at += 6 + more
            yield key, np.frombuffer(raw, "<u4" if wide else "<u2", length, at)
            at += length * (4 if wide else 2)

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for i in range(len(self.places)):
            yield from self.block(i)

    def may_hold(self, key: bytes) -> bool:
        return all(self.bloom[b >> 3] >> (b & 7) & 1 for b in _probes(key, self.bits, self.probes))

    def get(self, key: bytes) -> list[np.ndarray]:
        """The ids of each row of a key: the filter, then binary search in the index, then one block (more for equal keys)."""
        if not self.firsts or not self.may_hold(key):
            return []
        i = max(0, bisect_right(self.firsts, key) - 1)
        while i > 0 and self.firsts[i] == key:
            i -= 1
        found: list[np.ndarray] = []
        while i < len(self.firsts) and self.firsts[i] <= key:
            found += [ids for k, ids in self.block(i) if k == key]
            i += 1
        return found


@dataclass(frozen=True)
class Shard:
    path: str
    first_key: int | None
    last_key: int | None
    docs: int
    tokens: int
    tokens_before: int


def _open(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri)


def write_shards(df: DataFrame, folder: str, encoder: Callable[[], Callable[[str], np.ndarray]], end_id: int = 1, key: str = "doc_id", text: str = "text") -> list[Shard]:
    """Writes the ids of every text, each with end_id after it, to shards below folder (a uri); returns their metadata in order."""
    source = df.select(F.col(f"`{key}`").cast("long").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    ranged = source.repartitionByRange(F.col("key").asc_nulls_first()).sortWithinPartitions(F.col("key").asc_nulls_first(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        part = TaskContext.get().partitionId()
        store, root = _open(folder)
        store.create_dir(root, recursive=True)
        final = f"{root}/shard-{part:06d}.sst"
        draft = f"{final}.{TaskContext.get().taskAttemptId()}"
        first = last = None
        docs = tokens = 0
        with store.open_output_stream(draft) as file:
            writer = ShardWriter(file)
            for batch in batches:
                for piece in slices(batch):
                    for k, value in zip(piece.column("key").to_pylist(), texts_of(piece), strict=True):
                        first = k if not docs else first
                        last = k
                        docs += 1
                        ids = np.append(encode(value), np.uint32(end_id))
                        tokens += len(ids)
                        writer.add(key_bytes(k), ids)
            writer.close()
        if docs:
            store.move(draft, final)
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [f"{folder}/shard-{part:06d}.sst"], "first_key": [first], "last_key": [last], "docs": [docs], "tokens": [tokens]}, schema=pa.schema([("part", pa.int32()), ("path", pa.string()), ("first_key", pa.int64()), ("last_key", pa.int64()), ("docs", pa.int64()), ("tokens", pa.int64())]))
        else:
            store.delete_file(draft)

    found = sorted(ranged.mapInArrow(run, "part int, path string, first_key long, last_key long, docs long, tokens long").collect(), key=lambda r: r.part)
    shards, before = [], 0
    for row in found:
        shards.append(Shard(row.path, row.first_key, row.last_key, row.docs, row.tokens, before))
        before += row.tokens
    return shards


def read_shards(spark: SparkSession, shards: list[Shard], key: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """Every document of the shards, a task for each: key, start (ids before it), n_tokens, ids_crc32 and, unless told not to, ids."""
    rows = [(s.path, s.tokens_before) for s in shards]
    listed = spark.createDataFrame(rows, "path string, before long").repartition(max(1, len(rows)))
    schema = f"`{key}` long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[dict[str, list]]:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist(), strict=True):
                store, name = _open(path)
                with store.open_input_file(name) as file:
                    reader = ShardReader(file)
                    for i in range(len(reader.places)):
                        out: dict[str, list] = {key: [], "start": [], "n_tokens": [], "ids_crc32": [], "ids": []}
                        for k, ids in reader.block(i):
                            out[key].append(key_of(k))
                            out["start"].append(start)
                            out["n_tokens"].append(len(ids))
                            out["ids_crc32"].append(zlib.crc32(ids.astype("<u4").tobytes()))
                            if with_ids:
                                out["ids"].append(ids.astype(np.int32))
                            start += len(ids)
                        yield out

        return work

    return map_batches(listed, make, schema)


def lookup(shards: list[Shard], key: int | None) -> list[np.ndarray]:
    """The ids of each row of one key, by binary search over the shards' ranges and then within those that may hold it."""
    wanted = key_bytes(key)
    firsts = [key_bytes(s.first_key) for s in shards]
    i = bisect_right(firsts, wanted) - 1
    found: list[np.ndarray] = []
    while i >= 0 and key_bytes(shards[i].last_key) >= wanted:
        store, name = _open(shards[i].path)
        with store.open_input_file(name) as file:
            found = ShardReader(file).get(wanted) + found
        i -= 1
    return found


def tokenizer_encoder(tokenizer_file: str, spaced: bool) -> Callable[[], Callable[[str], np.ndarray]]:
    """What write_shards wants, for a file of the tokenizers library."""
    return lambda: cached_tokenizer(tokenizer_file, spaced).ids
