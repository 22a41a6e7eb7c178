"""Benchmark decontamination with an FM-index per training shard.

A shard is a stretch of documents with about ``shard_words`` words, read by one task. Its words become symbols; the
symbols are those of the phrases, and every other word is a separator that no phrase contains. The text of a shard
is the sequence of its symbol runs, each ended by a separator; a run shorter than the shortest phrase can't hold
one and is left out, which changes no answer. Over this text the shard builds

* a suffix array (by prefix doubling), from it the Burrows-Wheeler transform,
* a wavelet matrix over the transform, which answers rank(symbol, i) in one step per bit of the alphabet,
* samples of suffix positions, every ``sample``-th place of the text and the place after every separator.

All phrases (runs of ``n`` words of a benchmark item; a whole item if it has ``least`` to n - 1 words) are searched
backward together, one word at a time; occurrences are located by walking to the next sample. Hits of a document
that overlap or touch are merged to one removal span. Nothing is shuffled: documents stay in their partitions.

The table of distinct phrases, with the smallest item id of each, is made once, as arrays, and sent to every task in
parts of at most ``broadcast_bytes``; each further part is a further pass over the same stream of documents, which
carries the spans found so far. The parts don't change the result.

Words are runs of letters and digits in lower case, so punctuation and case don't hide a passage. Results for
special input:

* a null or empty text: no spans; the row stays as it is. A null benchmark text: no phrases;
* a benchmark item with a null id is searched like any other; where its phrases are found, ``items`` ends with a null;
* very long texts are one shard, whole;
* an item of fewer than ``least`` words: no phrase; no items at all, or no documents: nothing is found;
* repeated items: equal phrases count for the smallest item id; repeated rows: each row has its own spans;
* a document of which no word remains is removed by ``decontaminate``; other columns are kept there.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelens.llm._spark import BROADCAST_BYTES, fresh, keep, slices, small_batches
from pagelens.llm._text import Words, points, spans_hash, words

_NULL = np.iinfo(np.int64).max
SPANS = "array<struct<s:int,e:int,ws:int,we:int,items:array<bigint>>>"


@dataclass
class Phrases:
    """Phrases as rows of symbols, by length; ``vocabulary`` has the sorted word hashes, symbol i + 1 is vocabulary[i]."""

    vocabulary: np.ndarray
    by_length: dict[int, tuple[np.ndarray, np.ndarray]]


def phrase_table(benchmark: DataFrame, n: int, least: int, item_col: str, text_col: str) -> DataFrame:
    """(words, item): every phrase once, as packed word hashes, with the smallest id of the items that have it.

    Null ids come last, so a phrase has the item null only if no item with an id has it.
    """
    bench = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("i"), F.col(f"`{text_col}`").cast("string").alias("t")).filter("t IS NOT NULL")

    def cut(batches):
        for b in slices(batches, "t"):
            w = words(points(b.column(1)))
            raw, keys, items = w.hash.tobytes(), [], []
            for k, item in enumerate(b.column(0).to_pylist()):
                x, y = int(w.first[k]), int(w.first[k + 1])
                if y - x >= least:
                    own = {raw[8 * p : 8 * min(p + n, y)] for p in range(x, max(x, y - n) + 1)}
                    keys += own
                    items += [item] * len(own)
            yield pa.RecordBatch.from_pydict({"words": pa.array(keys, pa.binary()), "item": pa.array(items, pa.int64())})

    return bench.mapInArrow(cut, "words BINARY, item LONG").groupBy("words").agg(F.min("item").alias("item"))


def phrases(keys: list[bytes], items: list[int | None]) -> Phrases:
    """The rows of a phrase table as arrays; the id of a null item is the largest number."""
    ids = np.array([_NULL if x is None else x for x in items], np.int64)
    size = np.array([len(k) // 8 for k in keys], np.int64)
    rows = {int(m): np.flatnonzero(size == m) for m in np.unique(size)}
    hashes = {m: np.frombuffer(b"".join(keys[i] for i in r), np.uint64).reshape(len(r), m) for m, r in rows.items()}
    vocabulary = np.unique(np.concatenate([np.unique(h) for h in hashes.values()])) if hashes else np.zeros(0, np.uint64)
    out = {}
    for m, h in hashes.items():
        symbols = (np.searchsorted(vocabulary, h) + 1).astype(np.int32)
        order = np.lexsort(symbols.T[::-1])
        out[m] = symbols[order], ids[rows[m]][order]
    return Phrases(vocabulary, out)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Prefix doubling: each round sorts by twice as many symbols, until all suffixes differ."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        second = np.zeros(n, np.int64)
        second[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        ranked = key[order]
        new[order] = np.cumsum(np.append(0, ranked[1:] != ranked[:-1]))
        rank = new
        if rank[order[-1]] == n - 1 or step >= n:
            return order
        step *= 2


class Wavelet:
    """A wavelet matrix: per bit of the symbols, the ones before each place."""

    def __init__(self, text: np.ndarray, symbols: int):
        self.ones, self.zeros = [], []
        for bit in range(max(1, int(symbols).bit_length()) - 1, -1, -1):
            b = (text >> bit) & 1
            ones = np.zeros(len(text) + 1, np.int32)
            np.cumsum(b, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(text) - int(ones[-1]))
            text = np.concatenate([text[b == 0], text[b == 1]])

    def rank(self, symbol: np.ndarray, *places: np.ndarray) -> list[np.ndarray]:
        """How often ``symbol`` occurs before each of the places."""
        at = [np.zeros_like(symbol), *places]
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            one = ((symbol >> (len(self.ones) - 1 - k)) & 1).astype(bool)
            at = [np.where(one, zeros + ones[i], i - ones[i]) for i in at]
        return [i - at[0] for i in at[1:]]


class FMIndex:
    """``text`` holds symbols 1..symbols, and 0 as separator, also at its end."""

    def __init__(self, text: np.ndarray, symbols: int, sample: int = 16):
        n = len(text)
        # Separators differ from each other and precede all symbols, so no comparison goes past one.
        distinct = np.where(text == 0, np.cumsum(text == 0) - 1, text + np.count_nonzero(text == 0))
        sa = suffix_array(distinct)
        self.bwt = text[sa - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols + 1))])
        self.wavelet = Wavelet(self.bwt, symbols)
        sampled = (sa % sample == 0) | (self.bwt == 0)
        self.sampled, self.number, self.place = sampled, np.cumsum(sampled) - 1, sa[sampled]
        self.n = n

    def search(self, pattern: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of all rows of ``pattern``: the range of suffixes that begin with each."""
        lo, hi = np.zeros(len(pattern), np.int64), np.full(len(pattern), self.n, np.int64)
        for k in range(pattern.shape[1] - 1, -1, -1):
            c = pattern[:, k].astype(np.int64)
            a, b = self.wavelet.rank(c, lo, hi)
            lo, hi = self.before[c] + a, self.before[c] + b
        return lo, np.maximum(lo, hi)

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Positions of suffixes, from the next sample to the left of each."""
        row, steps, out = row.copy(), np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
        todo = np.arange(len(row))
        while len(todo):
            done = self.sampled[row[todo]]
            at = todo[done]
            out[at] = self.place[self.number[row[at]]] + steps[at]
            todo = todo[~done]
            c = self.bwt[row[todo]]
            row[todo] = self.before[c] + self.wavelet.rank(c, row[todo])[0]
            steps[todo] += 1
        return out


def occurrences(w: Words, p: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, number of words, item) of every occurrence of a phrase in a shard."""
    empty = (np.zeros(0, np.int64),) * 3
    if not p.by_length or not len(w.hash):
        return empty
    at = np.minimum(np.searchsorted(p.vocabulary, w.hash), len(p.vocabulary) - 1)
    known = p.vocabulary[at] == w.hash
    text = w.text
    bounds = np.flatnonzero(np.append(True, (known[1:] != known[:-1]) | (text[1:] != text[:-1])))
    ends = np.append(bounds[1:], len(known))
    good = known[bounds] & (ends - bounds >= min(p.by_length))
    bounds, ends = bounds[good], ends[good]
    if not len(bounds):
        return empty
    size = ends - bounds + 1
    stop = np.cumsum(size)
    word = np.arange(stop[-1]) + np.repeat(bounds - (stop - size), size)
    word[stop - 1] = -1
    symbols = np.where(word < 0, 0, at[word] + 1)
    index = FMIndex(symbols, len(p.vocabulary))
    first, many, item = [], [], []
    for length, (rows, items) in p.by_length.items():
        lo, hi = index.search(rows)
        count = hi - lo
        total = np.cumsum(count)
        place = index.locate(np.arange(total[-1]) + np.repeat(lo - (total - count), count))
        first.append(word[place])
        many.append(np.full(len(place), length))
        item.append(np.repeat(items, count))
    return np.concatenate(first), np.concatenate(many), np.concatenate(item)


def merged(first: np.ndarray, end: np.ndarray, items: list[list[int]]) -> list[tuple[int, int, list[int]]]:
    """Spans of words that overlap or touch, put together, with the items of all."""
    out: list = []
    for i in np.lexsort((end, first)):
        if out and first[i] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], int(end[i]))
            out[-1][2].update(items[i])
        else:
            out.append([int(first[i]), int(end[i]), set(items[i])])
    return [(a, b, sorted(c)) for a, b, c in out]


def _annotate(docs: DataFrame, text_col: str, spans: str, part, shard_words: int, carried: bool) -> DataFrame:
    schema = T.StructType([*[f for f in docs.schema if f.name != spans], T.StructField(spans, T._parse_datatype_string(SPANS))])
    at = docs.columns.index(text_col)
    kind = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("ws", pa.int32()), ("we", pa.int32()), ("items", pa.list_(pa.int64()))]))
    old = docs.columns.index(spans) if carried else None

    def run(batches):
        p = part.value

        def shard(waiting):
            parts = []
            for b, pt, w in waiting:
                parts.append(w)
            size = np.cumsum([0, *(len(w.hash) for w in parts)])
            texts = np.cumsum([0, *(len(w.first) - 1 for w in parts)])
            joint = Words(*(np.concatenate([getattr(w, k) for w in parts]) for k in ("start", "end", "hash")), np.concatenate([w.first[:-1] + s for w, s in zip(parts, size)] + [size[-1:]]))
            first, many, item = occurrences(joint, p)
            text = np.searchsorted(joint.first, first, side="right") - 1
            order = np.argsort(text, kind="stable")
            first, many, item, text = first[order], many[order], item[order], text[order]
            for k, (b, pt, w) in enumerate(waiting):
                out = b.column(old).to_pylist() if old is not None else [[] for _ in range(b.num_rows)]
                lo, hi = np.searchsorted(text, [texts[k], texts[k + 1]])
                cut = np.flatnonzero(np.append(True, text[lo + 1 : hi] != text[lo : hi - 1])) + lo if hi > lo else []
                for x, y in zip(cut, [*cut[1:], hi]):
                    i = int(text[x] - texts[k])
                    f, e, its = first[x:y] - size[k] - w.first[i], first[x:y] + many[x:y] - size[k] - w.first[i], [[j] for j in item[x:y].tolist()]
                    if out[i]:
                        f = np.append(f, [o["ws"] for o in out[i]])
                        e = np.append(e, [o["we"] for o in out[i]])
                        its += [[_NULL if j is None else j for j in o["items"]] for o in out[i]]
                    out[i] = [{"s": int(w.start[w.first[i] + a] - pt.at[i]), "e": int(w.end[w.first[i] + z - 1] - pt.at[i]), "ws": a, "we": z, "items": [None if j == _NULL else j for j in its_]} for a, z, its_ in merged(f, e, its)]
                cols = [c for c, n in zip(b.columns, b.schema.names) if n != spans]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(out, kind)], [*[n for n in b.schema.names if n != spans], spans])

        waiting, n = [], 0
        for b in slices(batches, text_col):
            pt = points(b.column(at))
            w = words(pt)
            waiting.append((b, type(pt)(pt.points[:0], pt.at), w))
            n += len(w.hash)
            if n >= shard_words:
                yield from shard(waiting)
                waiting, n = [], 0
        if waiting:
            yield from shard(waiting)

    return docs.mapInArrow(run, schema)


def with_spans(docs: DataFrame, benchmark: DataFrame, spans: str, n: int = 8, least: int = 5, shard_words: int = 500_000, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` with a column ``spans`` of merged removal spans (characters s..e, words ws..we, item ids)."""
    small_batches(docs.sparkSession)
    table = keep(phrase_table(benchmark, n, least, item_col, item_text_col))
    size = table.agg(F.sum(F.octet_length("words") + 8)).first()[0] or 0
    parts = max(1, -(-int(size) // max(1, broadcast_bytes)))
    out = docs
    for k in range(parts):
        # The phrases of one part; their size was counted above, and as arrays they take no more.
        rows = (table if parts == 1 else table.filter(F.pmod(F.xxhash64("words"), F.lit(parts)) == k)).toArrow()
        sent = docs.sparkSession.sparkContext.broadcast(phrases(rows["words"].to_pylist(), rows["item"].to_pylist()))
        out = _annotate(out, text_col, spans, sent, shard_words, k > 0)
    return out


def find_spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """(doc_id, start_word, end_word, start, end, items): one row per removal span."""
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    out = with_spans(src, benchmark, "spans", **kw).select("doc_id", F.explode("spans").alias("x"))
    return out.select("doc_id", F.col("x.ws").alias("start_word"), F.col("x.we").alias("end_word"), F.col("x.s").alias("start"), F.col("x.e").alias("end"), F.col("x.items").alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **kw) -> DataFrame:
    """``docs`` with all removal spans cut out; a row goes if no letter or digit of its text remains."""
    (spans,) = fresh(docs, "spans")
    marked = with_spans(docs, benchmark, spans, text_col=text_col, **kw)
    text, s = F.col(f"`{text_col}`"), F.col(spans)
    gap = F.transform(F.sequence(F.lit(0), F.size(s)), lambda i: F.substring(
        text, F.when(i == 0, 1).otherwise(F.element_at(s, F.greatest(i, F.lit(1)))["e"] + 1),
        F.when(i == F.size(s), F.length(text)).otherwise(F.element_at(s, F.least(i + 1, F.size(s)))["s"]) - F.when(i == 0, 0).otherwise(F.element_at(s, F.greatest(i, F.lit(1)))["e"]),
    ))
    new = F.when(F.size(s) > 0, F.array_join(gap, "")).otherwise(text)
    out = marked.select(*[(new.alias(c) if c == text_col else F.col(f"`{c}`")) for c in docs.columns], F.size(s).alias(spans))
    return out.filter((F.col(spans) == 0) | text.rlike(r"[\p{L}\p{N}]")).drop(spans)


ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
g AS (SELECT doc_id, p AS ws, p + 8 AS we, array_to_string(w[p + 1:p + 8], ' ') AS g FROM (SELECT doc_id, w, unnest(range(0, len(w) - 7)) AS p FROM w)),
b AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark),
ph AS (SELECT array_to_string(w[p + 1:p + 8], ' ') AS g, min(item_id) AS item_id FROM (SELECT item_id, w, unnest(range(0, len(w) - 7)) AS p FROM b) GROUP BY 1),
h AS (SELECT doc_id, ws, we, item_id FROM g JOIN ph USING (g)),
m AS (SELECT *, max(we) OVER (PARTITION BY doc_id ORDER BY ws ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM h),
k AS (SELECT *, sum(CASE WHEN before >= ws THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY ws) AS island FROM m)
SELECT doc_id, CAST(min(ws) AS INTEGER) AS start_word, CAST(max(we) AS INTEGER) AS end_word,
       string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items
FROM k GROUP BY doc_id, island
"""


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    out = find_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "start_word", "end_word", F.array_join(F.sort_array(F.col("items").cast("array<string>")), ",").alias("items"))
