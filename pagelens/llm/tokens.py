"""Token-ID output: patched frame-of-reference blocks.

The token ids of a document are cut into blocks of 128. A block stores its minimum and the differences from it,
packed at the width that ``share`` of them fit in (a percentile chosen per block); the others are patched: their
low bits are packed like the rest and a list of exceptions holds their places and full values. ``block_starts``
is the index: where each block begins in ``data``, so a reader decodes any block alone.

Layout of a block, little endian: minimum (4 bytes), count - 1 (1), width (1), number of exceptions (1), packed
differences (ceil(count * width / 8) bytes), exception places (1 byte each), exception differences (4 each).

Results for special input:

* a null or empty text: no tokens, no blocks, empty data;
* a null id or repeated rows: each row gives one row; other columns are ignored; an empty table: no rows;
* strings of special tokens in a text are ordinary text.
"""

from __future__ import annotations

import base64
import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.llm._spark import slices, small_batches

BLOCK, HEAD = 128, 7


@functools.cache
def encoder(path: str):
    """A byte-level BPE tokenizer from a file of ranks."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... for count[i] numbers each, one after the other."""
    total = np.cumsum(count)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(start - (total - count), count)


def bit_length(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1].astype(np.int64)


def encode(ids: np.ndarray, counts: np.ndarray, share: float = 0.9) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of all documents of a batch: (bytes, start of each block, first block and first byte of each document, with an end)."""
    per = -(-counts // BLOCK)
    first_block = np.concatenate([[0], np.cumsum(per)])
    blocks = int(first_block[-1])
    if not blocks:
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), first_block, np.zeros(len(counts) + 1, np.int64)
    doc = np.repeat(np.arange(len(counts)), per)
    nth = np.arange(blocks) - first_block[doc]
    n = np.minimum(BLOCK, counts[doc] - nth * BLOCK)
    begin = np.concatenate([[0], np.cumsum(counts)])[doc] + nth * BLOCK
    lane = np.arange(BLOCK)
    live = lane < n[:, None]
    value = ids[np.minimum(begin[:, None] + lane, len(ids) - 1)].astype(np.int64)
    low = np.where(live, value, np.iinfo(np.int64).max).min(1)
    delta = np.where(live, value - low[:, None], 0)
    ranked = np.sort(np.where(live, delta, np.iinfo(np.int64).max), axis=1)
    width = bit_length(ranked[np.arange(blocks), np.ceil(share * n).astype(np.int64) - 1])
    odd = live & (delta >> width[:, None] != 0)
    exceptions = odd.sum(1)
    packed = -(-n * width // 8)
    size = HEAD + packed + 5 * exceptions
    end = np.cumsum(size)
    start = end - size
    out = np.zeros(int(end[-1]), np.uint8)
    for i in range(4):
        out[start + i] = (low >> (8 * i)) & 255
    out[start + 4], out[start + 5], out[start + 6] = n - 1, width, exceptions
    for w in np.unique(width):
        if not w:
            continue
        rows = np.flatnonzero(width == w)
        bits = ((delta[rows, :, None] >> np.arange(w)) & 1).astype(np.uint8).reshape(len(rows), -1)
        data = np.packbits(bits, axis=1, bitorder="little")
        out[_ranges(start[rows] + HEAD, packed[rows])] = data[np.arange(data.shape[1]) < packed[rows, None]]
    at = start + HEAD + packed
    out[_ranges(at, exceptions)] = np.broadcast_to(lane, odd.shape)[odd]
    out[_ranges(at + exceptions, 4 * exceptions)] = delta[odd].astype("<u4").view(np.uint8)
    return out, start, first_block, np.concatenate([[0], end])[first_block]


def decode_block(data: bytes, start: int) -> np.ndarray:
    """The ids of the block that begins at ``start``."""
    n, w, e = data[start + 4] + 1, data[start + 5], data[start + 6]
    at = start + HEAD
    size = -(-n * w // 8)
    bits = np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=n * w, bitorder="little").reshape(n, w).astype(np.int64)
    delta = bits @ (1 << np.arange(w, dtype=np.int64))
    at += size
    delta[np.frombuffer(data, np.uint8, e, at)] = np.frombuffer(data, "<u4", e, at + e)
    return delta + int.from_bytes(data[start : start + 4], "little")


def decode(data: bytes, block_starts: list[int]) -> np.ndarray:
    return np.concatenate([decode_block(data, s) for s in block_starts]) if len(block_starts) else np.zeros(0, np.int64)


def token_blocks(docs: DataFrame, tokenizer: str | None = None, share: float = 0.9, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, block_starts, data): the token ids of every document, in packed blocks.

    ``tokenizer`` is the path of a file of BPE ranks that every executor can read.
    """
    small_batches(docs.sparkSession)
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.tiktoken")
    tokenizer = str(tokenizer)
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches):
        enc = encoder(tokenizer)
        for b in slices(batches, "text", 1 << 20):
            each = [np.array(enc.encode_ordinary(t), np.uint32) if t else np.zeros(0, np.uint32) for t in b.column(1).to_pylist()]
            counts = np.array([len(x) for x in each], np.int64)
            data, start, block, byte = encode(np.concatenate(each), counts, share)
            starts = start - byte[np.repeat(np.arange(len(counts)), np.diff(block))]
            raw = data.tobytes()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(counts), pa.ListArray.from_arrays(pa.array(block, pa.int32()), pa.array(starts, pa.int32())), pa.array([raw[x:y] for x, y in zip(byte[:-1].tolist(), byte[1:].tolist())], pa.binary())],
                ["doc_id", "n_tokens", "block_starts", "data"],
            )

    return src.mapInArrow(run, "doc_id LONG, n_tokens LONG, block_starts ARRAY<INT>, data BINARY")


def op1_token_blocks(spark, sf_dir: str) -> DataFrame:
    return token_blocks(spark.read.parquet(f"{sf_dir}/documents.parquet"))
