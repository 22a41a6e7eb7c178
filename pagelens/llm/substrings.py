"""Substring dedup: prefix-partitioned suffix trees over words.

A repeat is a run of at least ``length`` words that occurs at two places or more, in one document or in several.
A removal span is the union of the repeats of a document that overlap or touch.

* **Suffixes.** Each window of ``length`` words has an anchor: the leftmost smallest of the hashes of its runs of
  ``prefix`` words. Equal windows have equal anchors at equal offsets, so a tree for each anchor holds all windows
  that could be equal. A suffix begins at an anchor and carries the words before it that its windows reach.
* **Counting.** The anchors' hashes are counted first. One that occurs once starts no repeat, and its suffix is
  never shuffled. The repeated ones are known to all tasks through a Bloom filter of at most ``broadcast_bytes``;
  beyond that size the places of anchors are shuffled, counted, and joined to their documents.
* **Variable-length prefixes.** Suffixes are split into groups by their anchor, a prefix of ``prefix`` words; many
  small groups are read by one task. The prefix of a group with more than ``cap`` suffixes is extended to the whole
  ``length`` words: such a group is one node of the tree, needs no words any more, and is aggregated by its
  (128-bit) key.
* **Subtrees.** A group's suffixes are sorted by prefix doubling, and the longest common prefixes of neighbours are
  the internal nodes of its tree. Those ``length`` words deep or more give the repeats: a leaf's deepest one is its
  longest repeat, as far as its suffix reaches; where that ends, the suffix of the next anchor goes on.

``find_repeats`` gives, for each document, the runs of repeated words (``duplicate`` false) and those that
remain if the first occurrence of every window stays (``duplicate`` true); order is that of (id, row, word).
``dedup_substrings`` cuts the latter.

The number of segments of the hash space, in which anchors are counted and trees are grown, follows the bytes of text.

Words are runs of letters and digits in lower case. Results for special input: very long texts are cut nowhere; a null, empty or short text has no
repeats; null ids come last; rows with equal ids and equal rows are separate documents, in the order of the table; a
passage that repeats within one document counts, also where it overlaps itself; other columns are kept by
``dedup_substrings`` and ignored by ``find_repeats``; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelens.llm._spark import BROADCAST_BYTES, each_segment, fresh, keep, segments_for, slices, store, with_row_id
from pagelens.llm._text import _WORD_BASE, mix, points, spans_hash, words
from pagelens.llm.lines import Bloom, _tester

_NULL = np.iinfo(np.int64).max


def anchors(hash_: np.ndarray, first: np.ndarray, length: int, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, anchor place, anchor hash) of every suffix; windows with one anchor are consecutive."""
    n = len(hash_)
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    if n < length:
        return none
    start = np.arange(n - prefix + 1)
    grams = spans_hash(hash_, start, start + prefix)
    wide = length - prefix + 1
    views = np.lib.stride_tricks.sliding_window_view(grams, wide)
    place = np.empty(len(views), np.int64)
    for a in range(0, len(views), 1 << 16):
        place[a : a + (1 << 16)] = views[a : a + (1 << 16)].argmin(1)
    place += np.arange(len(views))
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    valid = np.flatnonzero(text[: len(views)] == text[length - 1 : length - 1 + len(views)])
    if not len(valid):
        return none
    a = place[valid]
    cut = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (np.diff(valid) != 1)))
    # Smallest hashes are small: mixed again, they spread over the segments.
    return valid[cut], np.diff(np.append(cut, len(valid))), a[cut], mix(grams[a[cut]])


def by_segment(h: np.ndarray, shift: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order that puts equal segments together, and (segment, from, to) in that order."""
    seg = (h >> np.uint64(shift)).astype(np.int64)
    order = np.argsort(seg, kind="stable")
    seg = seg[order]
    at = np.flatnonzero(np.append(True, seg[1:] != seg[:-1])) if len(seg) else np.zeros(0, np.int64)
    return order, [(int(seg[a]), int(a), int(b)) for a, b in zip(at, np.append(at[1:], len(seg)))]


def depths(text: np.ndarray, begin: np.ndarray, size: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(node, depth) of the suffixes of ``text`` at ``start``, in the tree of the paths text[begin:begin + size].

    The suffixes are sorted by prefix doubling, and the longest common prefixes of neighbours come from the ranks of
    all rounds. Runs of neighbours with a common prefix of ``length`` words or more hang below one deep internal node;
    ``depth`` is that of the deepest such node above a suffix (0: there is none), which is the length of its longest repeat.
    """
    n, paths = len(text), len(begin)
    flat = np.zeros(n + paths, np.int64)
    shift = np.repeat(np.arange(paths), size)
    flat[np.arange(n) + shift] = np.unique(text, return_inverse=True)[1] + paths
    flat[begin + size + np.arange(paths)] = np.arange(paths)  # every path ends with a word of its own
    start = start + shift[start]
    ranks, step, n = [np.unique(flat, return_inverse=True)[1].astype(np.int32)], 1, len(flat)
    while step < size.max(initial=0):
        second = np.zeros(n, np.int64)
        second[: n - step] = ranks[-1][step:] + 1
        ranks.append(np.unique(ranks[-1].astype(np.int64) * (n + 1) + second, return_inverse=True)[1].astype(np.int32))
        step *= 2
    order = np.argsort(ranks[-1][start], kind="stable")
    a, b = start[order[:-1]].copy(), start[order[1:]].copy()
    common = np.zeros(len(a), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        same = (np.maximum(a, b) < n) & (ranks[k][np.minimum(a, n - 1)] == ranks[k][np.minimum(b, n - 1)])
        move = same.astype(np.int64) << k
        common, a, b = common + move, a + move, b + move
    deep = common >= length
    node, depth = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
    node[order] = np.cumsum(np.append(0, ~deep))
    common = np.where(deep, common, 0)
    depth[order] = np.maximum(np.append(0, common), np.append(common, 0))
    return node, depth


def leaves(anchor, doc, row, lo, count, flat, length: int):
    """(doc, row, word, end of its longest repeat, duplicate) of every leaf below a deep internal node of the groups' trees."""
    size = count + length - 1
    end = np.cumsum(size)
    begin = end - size
    _, group, members = np.unique(anchor, return_inverse=True, return_counts=True)
    live = np.flatnonzero(members[group] > 1)
    if not len(live):
        return None
    # Suffixes with the same words are one path of the tree.
    same = spans_hash(flat.astype(np.uint64), begin[live], end[live])
    _, rep, path = np.unique(mix(same) ^ anchor[live], return_index=True, return_inverse=True)
    text = np.concatenate([flat[begin[i] : end[i]] for i in live[rep]])
    at = np.concatenate([[0], np.cumsum(size[live[rep]])])[:-1]
    many = count[live[rep]]
    total = np.concatenate([[0], np.cumsum(many)])
    offset = np.arange(total[-1]) - np.repeat(total[:-1], many)
    node, depth = depths(text, at, size[live[rep]], np.repeat(at, many) + offset, length)
    # Several suffixes on one path repeat each other up to its end.
    shared = np.bincount(path, minlength=len(rep)) > 1
    depth = np.where(np.repeat(shared, many), np.repeat(size[live[rep]], many) - offset, depth)
    c = count[live]
    t = np.cumsum(c)
    j = np.arange(t[-1]) - np.repeat(t - c, c)
    leaf = node[np.repeat(total[path], c) + j]
    reach = depth[np.repeat(total[path], c) + j]
    who = np.repeat(live, c)
    many = reach > 0
    leaf, who, word = leaf[many], who[many], lo[who[many]] + j[many]
    end = word + reach[many]
    if not len(leaf):
        return None
    d, r = doc[who], row[who]
    order = np.lexsort((word, r, d, leaf))
    dup = np.empty(len(leaf), bool)
    dup[order] = ~np.append(True, leaf[order][1:] != leaf[order][:-1])
    return d, r, word, end, dup


def intervals(d, r, word, end, dup, length: int) -> pa.Table:
    """Repeats of the leaves as (doc, row, duplicate, ws, we), put together where they overlap or touch."""
    out = []
    for flag in (False, True):
        use = np.flatnonzero(dup) if flag else np.arange(len(word))
        use = use[np.lexsort((word[use], r[use]))]
        x, y = r[use], word[use]
        # A later copy is one window for each leaf: its longest repeat may be with a copy that comes after it.
        z = y + length if flag else end[use]
        cut = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (y[1:] > z[:-1]))) if len(use) else np.zeros(0, np.int64)
        to = np.maximum.reduceat(z, cut) if len(cut) else z
        out.append(pa.table({"doc": d[use[cut]], "row": x[cut], "duplicate": np.full(len(cut), flag), "ws": y[cut].astype(np.int32), "we": to.astype(np.int32)}))
    return pa.concat_tables(out)


_INTERVAL = "doc LONG, row LONG, duplicate BOOLEAN, ws INT, we INT"


def _suffixes(b: pa.RecordBatch, length: int, prefix: int):
    w = words(points(b.column(2)))
    lo, count, place, h = anchors(w.hash, w.first, length, prefix)
    text = np.searchsorted(w.first, lo, side="right") - 1
    docs = np.array([_NULL if x is None else x for x in b.column(0).to_pylist()], np.int64)
    rows = np.asarray(b.column(1).to_pylist(), np.int64)
    return w, lo, count, place, h, docs[text], rows[text], lo - w.first[text], place - w.first[text]


def _intervals(src: DataFrame, length: int, prefix: int, segments: int, cap: int, broadcast_bytes: int) -> DataFrame:
    """(doc, row, duplicate, ws, we) of windows that repeat, before they are put together."""
    spark, shift = src.sparkSession, 64 - (segments.bit_length() - 1)

    def places(batches):
        for b in slices(batches, "t"):
            _, _, _, _, h, _, rows, _, at = _suffixes(b, length, prefix)
            order, parts = by_segment(h, shift)
            h, rows, at = h[order], rows[order], at[order].astype(np.int32)
            yield pa.RecordBatch.from_pydict({"segment": pa.array([s for s, _, _ in parts], pa.int64()), "h": pa.array([h[x:y].tobytes() for _, x, y in parts], pa.binary()), "rows": pa.array([rows[x:y].tobytes() for _, x, y in parts], pa.binary()), "places": pa.array([at[x:y].tobytes() for _, x, y in parts], pa.binary())})

    def counted(table):
        h = np.concatenate([np.frombuffer(x, np.uint64) for x in table["h"].to_pylist()])
        return h, *np.unique(h, return_inverse=True, return_counts=True)

    def filters(segment, table):
        _, u, _, n = counted(table)
        twice = u[n > 1]
        f = Bloom(len(twice))
        f.add(twice)
        return pa.table({"segment": pa.array([segment], pa.int64()), "m": pa.array([f.m], pa.int64()), "bits": pa.array([f.packed()], pa.binary()), "hot": pa.array([u[n > cap].tobytes()], pa.binary())})

    def addresses(segment, table):
        _, _, i, n = counted(table)
        n = n[i]
        rows = np.concatenate([np.frombuffer(x, np.int64) for x in table["rows"].to_pylist()])
        at = np.concatenate([np.frombuffer(x, np.int32) for x in table["places"].to_pylist()])
        return pa.table({"r": rows[n > 1], "place": at[n > 1], "hot": n[n > 1] > cap})

    packed = src.mapInArrow(places, "segment LONG, h BINARY, rows BINARY, places BINARY")
    known = keep(each_segment(packed.select("segment", "h"), segments, filters, "segment LONG, m LONG, bits BINARY, hot BINARY"))
    size = known.agg(F.sum(F.length("bits") + F.length("hot"))).first()[0] or 0
    if size <= broadcast_bytes:
        sent = spark.sparkContext.broadcast([tuple(r) for r in known.collect()])
        joined = src
    else:
        sent = None
        found = each_segment(packed, segments, addresses, "r LONG, place INT, hot BOOLEAN").groupBy("r").agg(F.collect_list(F.struct("place", "hot")).alias("found"))
        joined = src.join(found, F.col("row") == F.col("r")).select("doc", "row", "t", "found")

    def chosen(batches):
        """Suffixes of the batches' documents, which of them are shuffled, and which of these are in hot groups."""
        if sent is not None:
            has = _tester([r[:3] for r in sent.value], segments, shift)
            hot_set = np.unique(np.concatenate([np.frombuffer(r[3], np.uint64) for r in sent.value])) if sent.value else np.zeros(0, np.uint64)
        for b in slices(batches, "t"):
            w, lo, count, place, h, docs, rows, rel, at = _suffixes(b, length, prefix)
            if sent is not None:
                use, hot = has(h), np.isin(h, hot_set)
            else:
                told = {(r, f["place"]): f["hot"] for r, fs in zip(b.column(1).to_pylist(), b.column(3).to_pylist()) for f in fs}
                pair = [told.get(x) for x in zip(rows.tolist(), at.tolist())]
                use, hot = np.array([x is not None for x in pair], bool), np.array([bool(x) for x in pair], bool)
            yield w, lo, count, h, docs, rows, rel, use, hot

    columns = ("anchor", "docs", "rows", "lo", "count", "words")

    def suffixes(batches):
        for w, lo, count, h, docs, rows, rel, use, hot in chosen(batches):
            sel = np.flatnonzero(use & ~hot)
            order, parts = by_segment(h[sel], shift)
            sel = sel[order]
            low = w.hash.astype(np.uint32)
            out: dict[str, list] = {k: [] for k in ("segment", *columns)}
            for s, x, y in parts:
                i = sel[x:y]
                run = np.concatenate([low[lo[k] : lo[k] + count[k] + length - 1] for k in i])
                for k, v in zip(out, (s, h[i], docs[i], rows[i], rel[i].astype(np.int32), count[i].astype(np.int32), run)):
                    out[k].append(v if k == "segment" else v.tobytes())
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64() if k == "segment" else pa.binary()) for k, v in out.items()})

    def windows(batches):
        for w, lo, count, _, docs, rows, rel, use, hot in chosen(batches):
            sel = np.flatnonzero(use & hot)
            if not len(sel):
                continue
            c = count[sel]
            t = np.cumsum(c)
            j = np.arange(t[-1]) - np.repeat(t - c, c)
            start = np.repeat(lo[sel], c) + j
            keys = [spans_hash(v, start, start + length, base).view(np.int64) for v, base in ((w.hash, _WORD_BASE), (mix(w.hash), 0xC2B2AE3D27D4EB4F))]
            yield pa.RecordBatch.from_pydict({"doc": np.repeat(docs[sel], c), "row": np.repeat(rows[sel], c), "ws": (np.repeat(rel[sel], c) + j).astype(np.int32), "w1": keys[0], "w2": keys[1]})

    shipped = joined.mapInArrow(suffixes, "segment LONG, " + ", ".join(f"{k} BINARY" for k in columns))

    def subtree(segment, table):
        get = lambda k, t: np.concatenate([np.frombuffer(x, t) for x in table[k].to_pylist()])
        found = leaves(get("anchor", np.uint64), get("docs", np.int64), get("rows", np.int64), get("lo", np.int32).astype(np.int64), get("count", np.int32).astype(np.int64), get("words", np.uint32), length)
        return intervals(*(found or (np.zeros(0, np.int64),) * 4 + (np.zeros(0, bool),)), length)

    trees = each_segment(shipped, segments, subtree, _INTERVAL)
    if not any(r[0] for r in known.select(F.length("hot") > 0).distinct().collect()):
        return trees
    # The keys of hot groups are rows of five numbers, written once for the two uses below.
    each = joined.mapInArrow(windows, "doc LONG, row LONG, ws INT, w1 LONG, w2 LONG")
    each = store(each)
    one = each.groupBy("w1", "w2").agg(F.min(F.struct("doc", "row", "ws")).alias("o"), F.count("*").alias("n")).filter("n > 1")
    hit = each.join(one, ["w1", "w2"]).select("doc", "row", ((F.col("o.row") != F.col("row")) | (F.col("o.ws") != F.col("ws"))).alias("later"), "ws", (F.col("ws") + length).alias("we"))
    return trees.unionByName(hit.select("doc", "row", F.lit(False).alias("duplicate"), "ws", "we")).unionByName(hit.filter("later").select("doc", "row", F.lit(True).alias("duplicate"), "ws", "we"))


def _spans(docs: DataFrame, id_col: str, text_col: str, length: int, prefix: int, segments: int | None, cap: int, broadcast_bytes: int) -> DataFrame:
    """(doc, row, duplicate, ws, we), put together where they overlap or touch; ``docs`` has a column ``row``."""
    if segments is None:
        segments = segments_for(docs, "t", 8 << 20, 1 << 20)
    parts = _intervals(docs, length, prefix, segments, cap, broadcast_bytes)
    w = Window.partitionBy("row", "duplicate").orderBy("ws", "we")
    new = F.coalesce(F.max("we").over(w.rowsBetween(Window.unboundedPreceding, -1)) < F.col("ws"), F.lit(True))
    island = F.sum(F.col("new").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = parts.withColumn("new", new).withColumn("island", island).groupBy("row", "duplicate", "island")
    return out.agg(F.nullif(F.first("doc"), F.lit(int(_NULL))).alias("doc"), F.min("ws").alias("ws"), F.max("we").alias("we")).drop("island")


def find_repeats(docs: DataFrame, length: int = 50, prefix: int = 20, cap: int = 20_000, id_col: str = "doc_id", text_col: str = "text", segments: int | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, start_word, end_word, duplicate)."""
    src = with_row_id(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text_col}`").cast("string").alias("t")), "row").select("doc", "row", "t")
    out = _spans(src, id_col, text_col, length, prefix, segments, cap, broadcast_bytes)
    return out.select(F.col("doc").alias("doc_id"), F.col("ws").alias("start_word"), F.col("we").alias("end_word"), "duplicate")


def dedup_substrings(docs: DataFrame, length: int = 50, prefix: int = 20, cap: int = 20_000, id_col: str = "doc_id", text_col: str = "text", segments: int | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` without repeats after their first occurrence; the text between two words that stay is untouched."""
    row, spans, r = fresh(docs, "row", "spans", "r")
    whole = with_row_id(docs, row)
    src = whole.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(row).alias("row"), F.col(f"`{text_col}`").cast("string").alias("t"))
    found = _spans(src, id_col, text_col, length, prefix, segments, cap, broadcast_bytes).filter("duplicate")
    found = store(found.groupBy(F.col("row").alias(r)).agg(F.collect_list(F.struct("ws", "we")).alias(spans)))
    joined = whole.join(found, F.col(row) == F.col(r), "left").select(*[F.col(f"`{c}`") for c in docs.columns], spans)
    at = docs.columns.index(text_col)

    def cut(batches):
        for b in slices(batches, text_col):
            p = points(b.column(at))
            w = words(p)
            texts = b.column(at).to_pylist()
            for i, s in enumerate(b.column(b.num_columns - 1).to_pylist()):
                if s:
                    a, out, last = w.first[i], [], 0
                    for x in sorted(s, key=lambda x: x["ws"]):
                        out.append(texts[i][last : int(w.start[a + x["ws"]] - p.at[i])])
                        last = int(w.end[a + x["we"] - 1] - p.at[i])
                    texts[i] = "".join(out) + texts[i][last:]
            cols = list(b.columns)[:-1]
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, b.schema.names[:-1])

    return joined.mapInArrow(cut, docs.schema)


ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
g AS (SELECT doc_id, p AS ws, md5(array_to_string(w[p + 1:p + 50], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(0, len(w) - 49)) AS p FROM w)),
n AS (SELECT *, count(*) OVER (PARTITION BY g) AS n, row_number() OVER (PARTITION BY g ORDER BY doc_id, ws) AS k FROM g),
u AS (SELECT doc_id, ws, FALSE AS duplicate FROM n WHERE n > 1 UNION ALL SELECT doc_id, ws, TRUE FROM n WHERE k > 1),
m AS (SELECT *, coalesce(lag(ws) OVER (PARTITION BY doc_id, duplicate ORDER BY ws) + 50 < ws, TRUE) AS new FROM u),
i AS (SELECT *, sum(CAST(new AS INTEGER)) OVER (PARTITION BY doc_id, duplicate ORDER BY ws) AS island FROM m)
SELECT doc_id, CAST(min(ws) AS INTEGER) AS start_word, CAST(max(ws) + 50 AS INTEGER) AS end_word, duplicate FROM i GROUP BY doc_id, duplicate, island
"""


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return find_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
