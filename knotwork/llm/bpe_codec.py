"""Byte-level BPE with the tiktoken library and a local rank file.

Texts are encoded by the ranks with the given pre-splitting pattern and no special tokens. A long text is cut first, at
boundaries where the pattern must end a match whatever surrounds them, so that memory and time of one call stay bounded
while the ids are those of the whole text. A long run of white space is cut out too: such patterns match it but for its last
character as one piece (to the end of the text as a whole), and their engine can't step through it without limit. Decoding
gives raw bytes: ids of a part need not be valid UTF-8.

The cuts rest on what patterns of this family have in common: a match holds white space at its beginning or nothing else,
and `\\s+(?!\\S)` takes runs of it.

Defined results: null counts as an empty text, which has no ids and decodes to no bytes. Rows are independent, so
repeated rows, ties and empty tables need no care; other columns are passed through.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.llm.common import map_batches, slices, texts_of

#: One space between two characters that are not white space: every match that covers the first ends there.
_SAFE = re.compile(r"(?<=\S)(?= \S)")
#: Fixed value: what the pattern's engine takes as white space. A run of so many characters is encoded by itself.
_BLANK = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LONG_RUN = 1 << 16
_RUN = re.compile(f"[{_BLANK}]{{{_LONG_RUN},}}")


@lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str) -> tiktoken.Encoding:
    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_parts(text: str, length: int) -> Iterator[str]:
    """Cuts text at safe boundaries into parts of about length characters; a part is longer where no boundary lies."""
    begin = 0
    while len(text) - begin > length:
        cut = _SAFE.search(text, begin + length)
        if cut is None:
            break
        yield text[begin : cut.start()]
        begin = cut.start()
    yield text[begin:]


def encode(text: str, codec: tiktoken.Encoding, part: int = _LONG_RUN - 1) -> list[int]:
    if len(text) <= part:
        return codec.encode_ordinary(text)
    ids: list[int] = []
    begin = 0
    for run in _RUN.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        for piece in safe_parts(text[begin : run.start()], part):
            ids += codec.encode_ordinary(piece)
        ids += codec._encode_single_piece(text[run.start() : end])
        begin = end
    for piece in safe_parts(text[begin:], part):
        ids += codec.encode_ordinary(piece)
    return ids


def decode(ids: list[int], codec: tiktoken.Encoding) -> bytes:
    return codec.decode_bytes(ids)


def encode_column(df: DataFrame, rank_file: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds the ids of a text column as array<int>."""

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = encoding(rank_file, pattern)
        for values in batches:
            yield values.map(lambda x: encode(x or "", codec))

    return df.withColumn(ids, run(F.col(f"`{text}`")))


def decode_column(df: DataFrame, rank_file: str, pattern: str, ids: str = "ids", data: str = "data") -> DataFrame:
    """Adds the raw bytes of a column of ids; null ids give no bytes."""

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = encoding(rank_file, pattern)
        for values in batches:
            yield values.map(lambda x: decode([] if x is None else list(x), codec))

    return df.withColumn(data, run(F.col(f"`{ids}`")))


def round_trip_digests(df: DataFrame, rank_file: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes and decodes each text; returns key, n_tokens, ids_sha256 and decoded_sha256. No shuffle."""

    def make():
        codec = encoding(rank_file, pattern)
        names = [str(i) for i in range(codec.n_vocab)]

        def work(batch: pa.RecordBatch) -> Iterator[dict[str, list]]:
            for part in slices(batch):
                out: dict[str, list] = {key: part.column("key").to_pylist(), "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
                for value in texts_of(part):
                    ids = encode(value, codec)
                    out["n_tokens"].append(len(ids))
                    out["ids_sha256"].append(hashlib.sha256(" ".join([names[i] for i in ids]).encode()).hexdigest())
                    out["decoded_sha256"].append(hashlib.sha256(decode(ids, codec)).hexdigest())
                yield out

        return work

    kind = df.schema[key].dataType.simpleString()
    source = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    return map_batches(source, make, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
