"""Packing: order-preserving dynamic programming over window cuts, with monotone-queue transitions.

Documents keep their order, which is that of (id, hash of the text, row), null ids last. This order is cut into shards
of about ``shard_docs`` documents, whatever the gaps between ids and however many rows share one: shard bounds are
quantiles of the keys of rows that a hash of the row number chooses. A task reads a shard in order, some megabytes of text at
a time, and cuts it into windows of at most ``window`` tokens; every token is in exactly one window: nothing is cut
off. A cut may be behind any token p; it costs

    nothing                                 at the end of a document
    split                                   at the end of a sentence within a document
    split + truncation * min(rest, window)  within a sentence; its other ``rest`` tokens open the next window

and a window costs its padding. All windows hold all tokens, so the padding is window * (number of windows) less a
constant, and h(p) = cost of the cut + window + min of h(q), p - window <= q < p, h(0) = 0, finds the cuts with the
least total. That minimum moves over h as a monotone queue does; it is taken for blocks of ``window`` tokens at once,
as the least of the last values of the block before (minima from its end) and of the first ones of the same block
(minima from its start). Two cuts in a block are enough: of three, the middle one could be left out. So all cuts take
time linear in the number of tokens. Of equal costs the cut nearest to p wins.

A token is a maximal run of characters other than white space; a sentence ends after a run of ``.``, ``!`` or ``?``
that white space follows, and at a line break.

Results for special input:

* a null or empty text, or one of white space only: no token, so the document is in no window;
* null ids: these rows come last;
* rows that repeat an id or a whole row: each is packed, next to the others;
* a sentence longer than the window, a very long text: it goes on in the next windows;
* an empty table: no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelens.llm._spark import slices, with_row_id
from pagelens.llm._text import SPACE, points, runs, tables

_OUT = "shard LONG, window_no INT, n_tokens INT, padding INT, truncated INT, doc_ids ARRAY<LONG>, segments ARRAY<STRUCT<doc_id: LONG, start: INT, end: INT, tokens: INT>>, text STRING"


def units(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end, tokens) of every sentence with a token; starts and ends are characters in the text."""
    p = points(col)
    c = p.points
    space = (tables()[0][c] & SPACE) != 0
    start, end = runs(~space, p.at)
    if not len(start):
        return (np.zeros(0, np.int64),) * 4
    text = np.searchsorted(p.at, start, side="right") - 1
    stop = np.isin(c, np.array([ord(x) for x in ".!?"], np.uint32))
    line = np.zeros(len(c) + 1, np.int64)
    np.cumsum(c == 10, out=line[1:])
    following = np.append(start[1:], len(c))
    last = stop[end - 1] | (line[following] > line[end]) | np.append(text[1:] != text[:-1], True)
    stops = np.flatnonzero(last)
    begins = np.append(0, stops[:-1] + 1)
    of = text[stops]
    return of, start[begins] - p.at[of], end[stops] - p.at[of], stops - begins + 1


def cuts(sizes: np.ndarray, first: np.ndarray, window: int, truncation: float, split: float) -> list[int]:
    """Ends (exclusive) of the cheapest windows if a window may lose what it doesn't hold, at ``truncation`` a token.

    ``first`` tells which units begin a document. ``pack_documents`` loses nothing and uses ``token_cuts``.
    """
    n = len(sizes)
    total = [0, *np.cumsum(sizes).tolist()]
    late = [0.0 if x else split for x in first.tolist()]
    cost, back = [0.0] * (n + 1), [0] * (n + 1)
    queue: deque[tuple[float, int]] = deque()  # values rise from left to right
    left, least, least_at = 0, float("inf"), -1  # units before ``left`` don't fit any more
    for j in range(1, n + 1):
        i = j - 1
        value = cost[i] + total[i] + late[i]
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, i))
        low = total[j] - window
        while total[left] < low:
            over = cost[left] - truncation * total[left] + late[left]
            if over <= least:
                least, least_at = over, left
            left += 1
        while queue and queue[0][1] < left:
            queue.popleft()
        a = queue[0][0] + window - total[j] if queue else float("inf")
        b = least + truncation * (total[j] - window)
        if a <= b:
            cost[j], back[j] = a, queue[0][1]
        else:
            cost[j], back[j] = b, least_at
    out, j = [], n
    while j:
        out.append(j)
        j = back[j]
    return out[::-1]


def token_cuts(sizes: np.ndarray, first: np.ndarray, window: int, truncation: float, split: float) -> list[int]:
    """Ends (exclusive, in tokens) of the cheapest windows that hold all tokens of the units."""
    to, whole = np.cumsum(sizes), np.append(first[1:], True)
    n = int(to[-1]) if len(to) else 0
    cost = np.zeros(n + 1)
    for a in range(0, n, window):
        p = np.arange(a + 1, min(a + window, n) + 1)
        unit = np.searchsorted(to, p)
        rest = to[unit] - p
        own = window + np.where(rest == 0, np.where(whole[unit], 0.0, split), split + truncation * np.minimum(rest, window))
        before = np.minimum.accumulate(cost[a - window + 1 : a + 1][::-1])[::-1][: len(p)] if a else 0.0
        c = before + own
        c[1:] = np.minimum(c[1:], np.minimum.accumulate(c)[:-1] + own[1:])
        cost[p] = c
    out, p = [], n
    while p:
        out.append(p)
        p -= 1 + int(cost[max(0, p - window) : p][::-1].argmin())
    return out[::-1]


def _bounds(keys: DataFrame, rows: int, shard_docs: int, most: int = 100_000) -> np.ndarray:
    """Keys at which a new shard begins, at most ``most``; ``keys`` has (null, id, h, row)."""
    want = -(-rows // shard_docs)
    if want < 2:
        return np.zeros(0, "S25")
    every = max(1, rows // min(64 * want, most))
    some = keys.filter(F.pmod(F.xxhash64("row"), F.lit(every)) == 0).toArrow()
    found = np.sort(_key(*(c.to_numpy() for c in some.columns)))
    return np.unique(found[np.arange(1, want) * len(found) // want]) if len(found) > want else found


def _key(null: np.ndarray, *values: np.ndarray) -> np.ndarray:
    """Bytes that compare like (null, id, h, row)."""
    out = np.zeros((len(null), 25), np.uint8)
    out[:, 0] = null
    for k, v in enumerate(values):
        out[:, 1 + 8 * k : 9 + 8 * k] = (v.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").view(np.uint8).reshape(-1, 8)
    return out.reshape(-1).view("S25")


def _pack(ids: list, texts: pa.Array, window: int, truncation: float, split: float) -> Iterator[dict]:
    """The windows of documents in their order."""
    of, begin, end, tokens = [np.concatenate(x) for x in zip(*_units(texts, len(ids)))]
    if not len(of):
        return
    first = np.append(True, of[1:] != of[:-1])
    to = np.cumsum(tokens)
    at, held, text, split_unit, inner = 0, -1, "", -1, None

    def content(k: int) -> str:
        nonlocal held, text
        if k != held:
            held, text = k, texts[k].as_py()
        return text

    def token(u: int, i: int):
        """Start and end of token i of unit u; its tokens are found once for all windows it is in."""
        nonlocal split_unit, inner
        if u != split_unit:
            split_unit, inner = u, _tokens(content(int(of[u]))[begin[u] : end[u]])
        return int(begin[u] + inner[0][i]), int(begin[u] + inner[1][i])

    for stop in token_cuts(tokens, first, window, truncation, split):
        segments, parts = [], []
        x, y = int(np.searchsorted(to, at, side="right")), int(np.searchsorted(to, stop))
        bounds = np.unique(np.concatenate([[x], np.flatnonzero(first[x : y + 1]) + x, [y + 1]]))
        for a, b in zip(bounds[:-1], bounds[1:]):
            k, s, e = int(of[a]), int(begin[a]), int(end[b - 1])
            since, until = int(to[a] - tokens[a]), int(to[b - 1])
            if since < at:
                s, since = token(a, at - since)[0], at
            if until > stop:
                e, until = token(b - 1, stop - 1 - int(to[b - 1] - tokens[b - 1]))[1], stop
            segments.append({"doc_id": ids[k], "start": s, "end": e, "tokens": until - since})
            parts.append(content(k)[s:e])
        yield {"n_tokens": stop - at, "padding": window - (stop - at), "truncated": 0, "doc_ids": list(dict.fromkeys(s["doc_id"] for s in segments)), "segments": segments, "text": "\n\n".join(parts)}
        at = stop


def pack_documents(docs: DataFrame, window: int = 2048, truncation: float = 1.0, split: float = 8.0, shard_docs: int = 4096, part_bytes: int = 8 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per window: its documents in order, the character span of each, and their text.

    ``padding`` counts tokens; ``truncated``, the tokens that are in no window, is always 0. Segments of one document
    that touch are one segment. Texts of different documents are put together with an empty line between them. Windows
    don't cross shards, nor the ends of documents at which ``part_bytes`` of text are full.
    """
    src = with_row_id(docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")), "row")
    src = src.filter(F.col("text").rlike(r"[^ \t\n\r\f\x0B]")).withColumn("h", F.xxhash64("text"))
    key = [F.col("id").isNull().cast("long").alias("null"), F.coalesce("id", F.lit(0)).alias("id"), F.col("h"), F.col("row")]
    sent = docs.sparkSession.sparkContext.broadcast(_bounds(src.select(*key), src.count(), shard_docs))

    @F.pandas_udf(T.LongType())
    def shard_of(null: pd.Series, i: pd.Series, h: pd.Series, row: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(sent.value, _key(*(x.to_numpy() for x in (null, i, h, row))), side="right"))

    # Only numbers go to Python here, and only if there is more than one shard.
    ordered = src.withColumn("shard", shard_of(*key) if len(sent.value) else F.lit(0).cast("long"))
    ordered = ordered.repartitionById(len(sent.value) + 1, F.col("shard").cast("int")).sortWithinPartitions("shard", F.col("id").isNull(), "id", "h", "row").select("shard", "id", "text")

    def run(batches):
        now, no, ids, texts, size = None, 0, [], [], 0

        def flush():
            nonlocal no, ids, texts, size
            rows = []
            for r in _pack(ids, pa.chunked_array(texts, pa.string()).combine_chunks() if texts else pa.array([], pa.string()), window, truncation, split):
                rows.append({"shard": now, "window_no": no} | r)
                no += 1
            ids, texts, size = [], [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _schema())

        for b in slices(batches, "text"):
            shard = b.column(0).to_numpy()
            at = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
            for x, y in zip(at, np.append(at[1:], len(shard))):
                if shard[x] != now:
                    yield from flush()
                    now, no = int(shard[x]), 0
                part = b.slice(x, y - x)
                ids += part.column(1).to_pylist()
                texts.append(part.column(2))
                size += sum(len(t) for t in part.column(2).to_pylist())
                if size >= part_bytes:
                    yield from flush()
        yield from flush()

    return ordered.mapInArrow(run, _OUT)


def _units(col: pa.ChunkedArray, n: int):
    """Units of all texts, some megabytes at a time."""
    yield tuple(np.zeros(0, np.int64) for _ in range(4))
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    col = pa.chunked_array([col]).combine_chunks() if not isinstance(col, pa.Array) else col
    size = np.cumsum([0, *(len(x.as_py() or "") for x in col)])
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(size, size[at] + (1 << 20))))
        of, a, b, t = units(col.slice(at, min(to, n) - at))
        yield of + at, a, b, t
        at = to


def _tokens(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the tokens of ``text``."""
    p = points(pa.array([text]))
    return runs((tables()[0][p.points] & SPACE) == 0, p.at)


def _schema() -> pa.Schema:
    seg = pa.struct([("doc_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("tokens", pa.int32())])
    return pa.schema([("shard", pa.int64()), ("window_no", pa.int32()), ("n_tokens", pa.int32()), ("padding", pa.int32()), ("truncated", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("segments", pa.list_(seg)), ("text", pa.string())])


def op6_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
