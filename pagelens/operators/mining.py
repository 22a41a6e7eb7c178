"""Phrases for benchmarks: runs of words that are frequent in a document, in neither too few nor too many documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BASE = np.uint64(0x9E3779B97F4A7C15)


def phrases(docs: DataFrame, words_col: str = "words", block: int | None = None, shortest: int = 2, longest: int = 8, least_count: int = 5, least_docs: int = 8, most_docs: int = 256, letters: int = 4) -> DataFrame:
    """(n, gram, df, tf): phrases of ``shortest`` to ``longest`` words with at least one word of ``letters`` letters.

    A phrase counts in a document if it occurs ``least_count`` times there, within blocks of ``block`` words. Each
    document is counted where it is, by hashes; only the phrases that pass become text and are shuffled. Null
    and empty arrays have no phrases.
    """

    def count(batches):
        for b in batches:
            for k in range(0, b.num_rows, 256):
                yield _counted(b.column(0).slice(k, 256), block, shortest, longest, least_count, letters)

    per = docs.select(F.col(words_col).alias("w")).mapInArrow(count, "n INT, gram STRING, k LONG")
    return per.groupBy("n", "gram").agg(F.count("*").alias("df"), F.sum("k").alias("tf")).filter(F.col("df").between(least_docs, most_docs))


def _counted(lists: pa.Array, block: int | None, shortest: int, longest: int, least: int, letters: int) -> pa.RecordBatch:
    words = lists.flatten()
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    n = len(words)
    doc = np.repeat(np.arange(len(size)), size)
    place = np.arange(n) - np.repeat(np.cumsum(size) - size, size)
    section = doc * (1 << 32) + (place // block if block else 0)
    coded = words.dictionary_encode()
    code = coded.indices.to_numpy().astype(np.uint64)
    long = (pc.utf8_length(coded.dictionary).to_numpy() >= letters)[coded.indices.to_numpy()] if n else np.zeros(0, bool)
    upto = np.concatenate([[0], np.cumsum(long)])
    h = np.zeros(n, np.uint64)
    out: dict[str, list] = {"n": [], "gram": [], "k": []}
    text = words.to_pylist()
    for m in range(1, min(longest, n) + 1):
        # The hash of m words from each place on, from that of m - 1.
        h = h[: n - m + 1] * _BASE + (code[m - 1 :] + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        if m < shortest:
            continue
        at = np.flatnonzero((section[: n - m + 1] == section[m - 1 :]) & (upto[m:] > upto[: n - m + 1]))
        order = at[np.lexsort((h[at], doc[at]))]
        new = np.flatnonzero(np.append(True, (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1]))) if len(order) else order
        many = np.diff(np.append(new, len(order)))
        for i, k in zip(order[new[many >= least]].tolist(), many[many >= least].tolist()):
            out["n"].append(m)
            out["gram"].append(" ".join(text[i : i + m]))
            out["k"].append(k)
    return pa.RecordBatch.from_pydict({"n": pa.array(out["n"], pa.int32()), "gram": pa.array(out["gram"], pa.string()), "k": pa.array(out["k"], pa.int64())})
