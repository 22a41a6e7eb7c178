"""N-gram Jaccard join: an exact metric-space join by pivots, Voronoi regions and triangle-inequality windows.

A document is the set of its runs of ``n`` words; d(x, y) = 1 - |x & y| / |x | y| is a metric. All pairs with
d <= r = 1 - ``least`` are found, exactly.

**Blocks.** Almost all documents are at distance 1, or nearly, from any pivot, so in the whole corpus no window
separates anything (measured in the README). The space is therefore first cut where no pair can cross. A pair within
r must share one of the first |x| - ceil(least * |x|) + 1 runs of both, in any common order; in the order of rising
document frequency those of an ordinary document occur nowhere else, and it drops out. Documents that share
one are connected, and the components are the blocks. Frequencies are exact counts over all documents.

**Regions.** In a block, pivots are chosen by hash, and a document has its home at the nearest pivot, if that is
within BALL; the others are far and form a region of their own. A pair is reported in the region of the smaller home
(far comes last), so the other document must be there too. If x has its home at p, then d(y, p) <= d(x, p) + r, which
is at most BALL + r, and at most d(y, q) + 2r for the home q of y: these two windows say which documents a region
takes in besides its own, and no pair is lost. Regions, the far one included, are split again with new pivots until
they are small, or no longer shrink; then they are compared directly, by the lists of documents of each run. Blocks of
more than ``region`` documents are split by a distributed round first, and what stays larger is compared tile by tile,
so no task holds more than two tiles. Before that round, the first of each set is found in the whole block, and only
the firsts go on, so the result doesn't depend on ``region``.

**Equal sets** are compared once: the first document (by id, row) of each set stands for it.

``classes`` gives a row for each document: the smallest id of its class (the documents it is connected with by
links) and the number of its links, which are all other documents within r, copies included. Tasks count links and
keep a spanning forest where they compare, so what they return has the size of their input, however many pairs there
are. ``jaccard_pairs`` gives the links themselves, between the first documents of different sets, and each copy with
its first.

Results for special input:

* a text of 1 to n - 1 words is the set of one run, of all its words; null, empty and wordless texts have no links
  and are a class of their own; very long texts are compared whole;
* a pair is ordered by (id, row), null ids last; rows with equal ids or equal rows are separate documents; the class
  of documents without any id is null;
* distance exactly r counts; other columns are ignored by ``classes`` and ``jaccard_pairs`` and kept by ``keep_one``;
* an empty table: no rows.

The runs are counted in segments of the hash space, as many as the bytes of text ask for (at most 16,384, so beyond
130 GB a segment grows with the data).
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelens.llm._spark import BROADCAST_BYTES, each_segment, fresh, keep, segments_for, slices, with_row_id
from pagelens.llm._text import mix, ngrams, points, words

_NULL = np.iinfo(np.int64).max


def gram_sets(col: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (hash, text), by text and hash."""
    h, t = ngrams(words(points(col)), n)
    order = np.lexsort((h, t))
    h, t = h[order], t[order]
    new = np.append(True, (h[1:] != h[:-1]) | (t[1:] != t[:-1])) if len(h) else np.zeros(0, bool)
    return h[new], t[new]


def prefix_size(size: np.ndarray, least: float) -> np.ndarray:
    return size - np.ceil(least * size - 1e-9).astype(np.int64) + 1


def bounds(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values begin and end."""
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return at, np.append(at[1:], len(key)) if len(key) else at


def edges(src: DataFrame, n: int, least: float, segments: int) -> DataFrame:
    """(a, b): rows that share a run in their prefixes, as stars around the smallest row of each run."""
    bits = segments.bit_length() - 1
    shift = np.uint64(64 - bits)
    empty = lambda: np.zeros(0, np.int64)
    # The more segments, the more text is packed at once, so that their rows don't become too short.
    piece = (2 << 20) if segments <= 256 else (8 << 20)

    def grams(batches):
        for b in (x.slice(k, 60_000) for x in slices(batches, "t", piece) for k in range(0, x.num_rows, 60_000)):
            h, t = ngrams(words(points(b.column(1))), n)
            m = b.num_rows
            place = (h >> shift).astype(np.int64) * m + t
            order = np.lexsort((h, place))
            place, h = place[order], h[order]
            if len(h):
                new = np.append(True, (place[1:] != place[:-1]) | (h[1:] != h[:-1]))
                place, h = place[new], h[new]
            doc = place % m
            rows = b.column(0).to_numpy()
            # The sizes go along, in groups of their own; a batch is named by its first row.
            out = {"segment": [-1 - int(rows[0]) % segments], "batch": [int(rows[0])], "docs": [np.bincount(doc, minlength=m).astype(np.uint32).tobytes()], "h": [rows.tobytes()]}
            for x, y in zip(*bounds(place // m)):
                out["segment"].append(int(place[x] // m))
                out["batch"].append(int(rows[0]))
                out["docs"].append(doc[x:y].astype(np.uint16).tobytes())
                out["h"].append(h[x:y].astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_pydict(out)

    def frequency(segment, table):
        if segment < 0:
            return table.select(["batch", "segment", "docs", "h"]).append_column("df", pa.array([b""] * table.num_rows, pa.binary()))
        parts = [np.frombuffer(x, np.uint32) for x in table["h"].to_pylist()]
        _, inverse, many = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        df = np.minimum(many, 65535).astype(np.uint16)[inverse]
        out = {"batch": table["batch"].to_pylist(), "segment": [segment] * table.num_rows, "docs": [], "h": [], "df": []}
        at = 0
        for docs, p in zip(table["docs"].to_pylist(), parts):
            d = df[at : at + len(p)]
            at += len(p)
            shared = d > 1
            for k, v in (("docs", np.frombuffer(docs, np.uint16)), ("h", p), ("df", d)):
                out[k].append(v[shared].tobytes())
        return pa.table(out, schema=pa.schema([("batch", pa.int64()), ("segment", pa.int64()), ("docs", pa.binary()), ("h", pa.binary()), ("df", pa.binary())]))

    def prefixes(key, table):
        sizes = rows = None
        docs, keys, dfs = [empty()], [empty()], [empty()]
        for seg, c, h, d in zip(*(table[k].to_pylist() for k in ("segment", "docs", "h", "df"))):
            if seg < 0:
                sizes, rows = np.frombuffer(c, np.uint32).astype(np.int64), np.frombuffer(h, np.int64)
                continue
            docs.append(np.frombuffer(c, np.uint16).astype(np.int64))
            keys.append((seg << 32) | np.frombuffer(h, np.uint32).astype(np.int64))
            dfs.append(np.frombuffer(d, np.uint16).astype(np.int64))
        doc, k, df = np.concatenate(docs), np.concatenate(keys), np.concatenate(dfs)
        order = np.lexsort((k, df, doc))
        doc, k = doc[order], k[order]
        shared = np.bincount(doc, minlength=len(sizes))
        want = prefix_size(sizes, least) - (sizes - shared)  # what occurs once comes first and meets nobody
        rank = np.arange(len(doc)) - np.searchsorted(doc, np.arange(len(sizes)))[doc]
        use = rank < want[doc]
        k, row = k[use], rows[doc[use]]
        order = np.argsort(k, kind="stable")
        k, row = k[order], row[order]
        at, to = bounds(k >> 32)
        return pa.table({"segment": pa.array([int(k[a] >> 32) for a in at], pa.int64()), "h": pa.array([(k[a:z] & 0xFFFFFFFF).astype(np.uint32).tobytes() for a, z in zip(at, to)], pa.binary()), "rows": pa.array([row[a:z].tobytes() for a, z in zip(at, to)], pa.binary())})

    def stars(segment, table):
        h = np.concatenate([np.frombuffer(x, np.uint32) for x in table["h"].to_pylist()])
        row = np.concatenate([np.frombuffer(x, np.int64) for x in table["rows"].to_pylist()])
        order = np.lexsort((row, h))
        h, row = h[order], row[order]
        at, to = bounds(h)
        pair = np.stack([np.repeat(row[at], to - at), row], 1)
        pair = np.unique(pair[pair[:, 0] != pair[:, 1]], axis=0)
        table = forest(pair[:, 0], pair[:, 1])
        return table.append_column("part", pa.array(np.full(table.num_rows, segment // 8, np.int64)))

    packed = src.select("row", "t").mapInArrow(grams, "segment LONG, batch LONG, docs BINARY, h BINARY")
    counted = each_segment(packed, segments, frequency, "batch LONG, segment LONG, docs BINARY, h BINARY, df BINARY")
    chosen = counted.groupBy("batch").applyInArrow(prefixes, "segment LONG, h BINARY, rows BINARY")
    # Forests of eight segments are put together before the components are sought among all.
    one = each_segment(chosen, segments, stars, "a LONG, b LONG, part LONG")
    return one.groupBy("part").applyInArrow(lambda key, table: forest(table["a"].to_numpy(), table["b"].to_numpy()), "a LONG, b LONG")


def forest(a: np.ndarray, b: np.ndarray) -> pa.Table:
    """(a, b): each node with the smallest node that the edges connect it with."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    pairs = [(find(x), x) for x in list(parent)]
    pairs = np.array([p for p in pairs if p[0] != p[1]], np.int64).reshape(-1, 2)
    return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})


def components(pairs: DataFrame, at_once: int = 2_000_000) -> DataFrame:
    """(node, root): the smallest node that each node of the graph (a, b) is connected with.

    Up to ``at_once`` edges are joined by one task. More are first cut to forests of so many edges each, and then
    every node takes the smallest root among its neighbours, and the root of that one, until none changes.
    """
    pairs = keep(pairs.select("a", "b"))
    parts = max(1, -(-pairs.count() // at_once))
    trees = pairs.withColumn("part", F.pmod(F.xxhash64("a", "b"), F.lit(parts)) if parts > 1 else F.lit(0))
    trees = trees.groupBy("part").applyInArrow(lambda key, table: forest(table["a"].to_numpy(), table["b"].to_numpy()), "a LONG, b LONG")
    if parts == 1:
        trees = keep(trees)
        return trees.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(trees.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
    both = keep(trees.unionByName(trees.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = keep(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")))
    while True:
        near = both.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("m"))
        step = label.join(near, "node").select("node", F.least("root", "m").alias("m"), "root")
        # Jump to the root of the root, which halves the paths.
        jump = step.join(label.select(F.col("node").alias("m"), F.col("root").alias("far")), "m").select("node", F.least("m", "far").alias("root"), (F.least("m", "far") != F.col("root")).alias("moved"))
        jump = keep(jump)
        if not jump.agg(F.max("moved")).first()[0]:
            return jump.select("node", "root")
        label = jump.select("node", "root")


class Sets:
    """Sets of hashes, and for every hash the sets that hold it."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        _, self.flat, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        self.holders = np.repeat(np.arange(len(sets)), self.size)[np.argsort(self.flat, kind="stable")]
        self.begin, self.many = np.concatenate([[0], np.cumsum(many)[:-1]]), many

    def similarity(self, i: int) -> np.ndarray:
        """Jaccard similarity of set i to every set; only sets that share a hash are touched."""
        own = self.flat[self.at[i] : self.at[i + 1]]
        count = self.many[own]
        end = np.cumsum(count)
        hit = self.holders[np.arange(end[-1]) + np.repeat(self.begin[own] - (end - count), count)]
        both = np.bincount(hit, minlength=len(self.size))
        return both / (self.size[i] + self.size - both)


#: A document further than this from all pivots has no home among them; it goes to the region of the far.
BALL = 0.3


def assign(d: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray]:
    """Home of each row of distances to pivots (the number of pivots for the far), and who is in each pivot's region."""
    nearest = d.min(1, initial=np.inf)
    home = np.where(nearest <= BALL, d.argmin(1) if d.shape[1] else 0, d.shape[1])
    return home, d <= np.minimum(BALL + r, nearest + 2 * r)[:, None] + 1e-12


def voronoi_join(sets: Sets, least: float, small: int = 128, pivots: int = 16) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """All (i, [j], [similarity]) with i != j and similarity of at least ``least``; each pair once."""
    r = 1 - least
    # A region is (members, [(home of every member, number of the region)]): it reports a pair if the smaller home is its own.
    todo: list[tuple[np.ndarray, list]] = [(np.arange(len(sets.size)), [])]
    while todo:
        members, rules = todo.pop()
        if len(members) > small:
            order = np.argsort(mix(members.astype(np.uint64) + np.uint64(len(rules))))[:pivots]
            d = 1 - np.stack([sets.similarity(int(members[p]))[members] for p in order], 1)
            home, near = assign(d, r)
            inside = [*(np.flatnonzero(near[:, q]) for q in range(len(order))), np.flatnonzero(home == len(order))]
            if max(map(len, inside)) <= 0.8 * len(members):
                todo += [(members[x], [*((h[x], k) for h, k in rules), (home[x], q)]) for q, x in enumerate(inside) if len(x) > 1]
                continue
        place = np.full(len(sets.size), -1)
        place[members] = np.arange(len(members))
        for x, i in enumerate(members.tolist()):
            s = sets.similarity(i)
            j = np.flatnonzero(s >= least - 1e-12)
            y = place[j]
            use = y > x
            j, y = j[use], y[use]
            for h, q in rules:
                ok = np.minimum(h[x], h[y]) == q
                j, y = j[ok], y[ok]
            if len(j):
                yield i, j, s[j]


_PAIR = "row_a LONG, row_b LONG, doc_a LONG, doc_b LONG, jaccard DOUBLE"
_LINK = "row LONG, doc LONG, links LONG, root LONG"
_MEMBER = "region LONG, q INT, home INT, chunk INT, ci INT, cj INT, many LONG, row LONG, doc LONG, grams BINARY"
_PLACE = ["q", "home", "chunk", "ci", "cj"]


class _Region:
    """The members of one region, or of one tile of it, with the first of each set."""

    def __init__(self, t: pa.Table):
        get = lambda k: t[k].to_numpy()
        self.docs, self.rows, self.home, self.chunk = get("doc"), get("row"), get("home"), get("chunk")
        self.q, self.ci, self.cj = (int(get(k)[0]) for k in ("q", "ci", "cj"))
        grams, many = t["grams"].to_pylist(), get("many")
        seen: dict[bytes, int] = {}
        self.of = np.zeros(len(grams), np.int64)  # number of each member's set
        for i in np.lexsort((self.rows, self.docs)).tolist():
            self.of[i] = seen.setdefault(grams[i], len(seen))
        order = np.lexsort((self.rows, self.docs))
        self.first = order[np.unique(self.of[order], return_index=True)[1]]
        self.many = np.bincount(self.of, many, len(seen)).astype(np.int64)
        self.sets = [np.frombuffer(grams[i], np.uint64) for i in self.first]

    def reports(self, a, b) -> np.ndarray:
        """Which pairs of members are this region's, and no other's."""
        h, c, d = self.home, np.minimum(self.chunk[a], self.chunk[b]), np.maximum(self.chunk[a], self.chunk[b])
        return (np.minimum(h[a], h[b]) == self.q) & (c == self.ci) & (d == self.cj)

    def near(self, least: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Links between different sets, by number of the set."""
        if len(self.sets) > 1:
            for i, j, s in voronoi_join(Sets(self.sets), least):
                use = self.reports(self.first[i], self.first[j])
                if use.any():
                    yield i, j[use], s[use]

    def pairs(self, least: float) -> Iterator[pa.RecordBatch]:
        def batch(a, b, s):
            d, r = self.docs, self.rows
            swap = (d[a] > d[b]) | ((d[a] == d[b]) & (r[a] > r[b]))
            a, b = np.where(swap, b, a), np.where(swap, a, b)
            return pa.RecordBatch.from_pydict({"row_a": r[a], "row_b": r[b], "doc_a": _null(d[a]), "doc_b": _null(d[b]), "jaccard": s})

        copy = np.flatnonzero(self.first[self.of] != np.arange(len(self.of)))
        copy = copy[self.reports(self.first[self.of[copy]], copy)]
        yield batch(self.first[self.of[copy]], copy, np.ones(len(copy)))
        for i, j, s in self.near(least):
            yield batch(np.full(len(j), self.first[i]), self.first[j], s)

    def links(self, least: float) -> pa.RecordBatch:
        count = np.where(self.reports(self.first, self.first), self.many - 1, 0)
        label = np.arange(len(self.first))
        for i, j, _ in self.near(least):
            count[i] += self.many[j].sum()
            count[j] += self.many[i]
            other = j[label[j] != label[i]]
            if len(other):
                met = np.unique(np.append(label[other], label[i]))
                label[np.isin(label, met)] = met[0]
        return pa.RecordBatch.from_pydict({"row": self.rows, "doc": _null(self.docs), "links": count[self.of], "root": self.rows[self.first[label[self.of]]]})


def _null(v: np.ndarray) -> pa.Array:
    return pa.array(v, mask=v == _NULL)


def _regions(table: pa.Table) -> Iterator[_Region]:
    table = table.sort_by("region").combine_chunks()
    for x, y in zip(*bounds(table["region"].to_numpy())):
        yield _Region(table.slice(x, y - x))


def _members(src: DataFrame, n: int, least: float, region: int, segments: int | None, broadcast_bytes: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of ``src`` (row, doc, t) that may have links, by task; and (row_a, row_b, doc_a, doc_b) of copies that stay out of them."""
    shuffle = int(src.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    segments = segments or segments_for(src, "t", 8 << 20, 1 << 14)
    blocks = components(edges(src, n, least, segments)).select(F.col("node").alias("r"), F.col("root").alias("block"))
    sizes = blocks.groupBy("block").count()
    many, largest = sizes.agg(F.sum("count"), F.max("count")).first()
    # A few numbers a document; beyond the limit both sides are shuffled.
    near = lambda df, rows: F.broadcast(df) if (rows or 0) * 64 <= broadcast_bytes else df
    whole = lambda df, many: df.select("r", F.col("block").alias("region"), *[F.lit(0).alias(c) for c in _PLACE], many.cast("long").alias("many"))
    place, copies = whole(blocks, F.lit(1)), None
    if (largest or 0) > region:
        big = sizes.filter(F.col("count") > region).select("block")
        marked, first = _firsts(src, blocks.join(big, "block"), n, broadcast_bytes)
        reps = first.count()
        copies = marked.join(near(first.select("key", F.col("row").alias("row_a"), F.col("doc").alias("doc_a")), reps), "key").filter(F.col("row") != F.col("row_a"))
        copies = copies.select("row_a", F.col("row").alias("row_b"), "doc_a", F.col("doc").alias("doc_b"))
        left = first.groupBy("block").count()
        alone, still = left.filter(F.col("count") <= region).select("block"), left.filter(F.col("count") > region)
        first = first.select("block", F.col("row").alias("r"), "many")
        split = _split(src, first.join(still, "block").drop("many"), n, least, region, broadcast_bytes).join(first.select("r", "many"), "r")
        split = keep(split.select("r", "region", *_PLACE, "many").unionByName(whole(first.join(alone, "block"), F.col("many"))))
        place = place.join(big.select(F.col("block").alias("region")), "region", "left_anti").unionByName(split)
        many += split.count()
    inside = src.join(near(place, many), F.col("row") == F.col("r")).select("region", *_PLACE, "many", "row", "doc", "t")

    def sets(batches):
        for b in slices(batches, "t"):
            h, t = gram_sets(b.column(9), n)
            at = np.searchsorted(t, np.arange(b.num_rows + 1))
            docs = pa.array([_NULL if x is None else x for x in b.column(8).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:8], docs, pa.array([h[x:y].tobytes() for x, y in zip(at[:-1], at[1:])], pa.binary())], [*b.schema.names[:9], "grams"])

    members = inside.mapInArrow(sets, _MEMBER)
    return members.withColumn("task", F.pmod(F.xxhash64("region"), F.lit(4 * shuffle))), copies


def row_pairs(src: DataFrame, n: int, least: float, region: int, segments: int | None, broadcast_bytes: int) -> DataFrame:
    """Pairs of rows of ``src`` (row, doc, t)."""
    members, copies = _members(src, n, least, region, segments, broadcast_bytes)

    def join(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _regions(pa.Table.from_batches(list(batches))):
            yield from r.pairs(least)

    pairs = members.groupBy("task").applyInArrow(join, _PAIR)
    return pairs if copies is None else pairs.unionByName(copies.withColumn("jaccard", F.lit(1.0)))


def row_classes(src: DataFrame, n: int, least: float, region: int, segments: int | None, broadcast_bytes: int) -> DataFrame:
    """(r, links, first_row, class): of the rows of ``src`` (row, doc, t) that have links."""
    members, copies = _members(src, n, least, region, segments, broadcast_bytes)

    def join(key, table):
        return pa.Table.from_batches([r.links(least) for r in _regions(table)])

    found = keep(members.groupBy("task").applyInArrow(join, _LINK))
    edge = found.filter(F.col("row") != F.col("root")).select(F.col("root").alias("a"), F.col("row").alias("b"))
    links = found.groupBy("row").agg(F.first("doc").alias("doc"), F.sum("links").alias("links"))
    if copies is not None:
        edge = edge.unionByName(copies.select(F.col("row_a").alias("a"), F.col("row_b").alias("b")))
        own = links.select(F.col("row").alias("row_a"), "links")
        links = links.unionByName(copies.join(own, "row_a").select(F.col("row_b").alias("row"), F.col("doc_b").alias("doc"), "links"))
    groups = components(edge)
    named = keep(links.filter("links > 0").join(groups, F.col("row") == F.col("node")).select("row", "doc", "links", "root"))
    order = F.struct(F.col("doc").isNull().alias("x"), "doc", "row")
    first = named.groupBy("root").agg(F.min(order).alias("o"))
    return named.join(first, "root").select(F.col("row").alias("r"), "links", F.col("o.row").alias("first_row"), F.col("o.doc").alias("class"))


def _firsts(src: DataFrame, blocks: DataFrame, n: int, broadcast_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(key, block, row, doc) of the rows of large blocks, and of the first of each set among them.

    ``blocks`` has (block, r). The key is a digest of 32 bytes of the whole sorted set, so equal keys are equal sets.
    """

    def digests(batches):
        for b in slices(batches, "t"):
            h, t = gram_sets(b.column(3), n)
            at = np.searchsorted(t, np.arange(b.num_rows + 1))
            key = [blake2b(h[x:y].tobytes(), digest_size=32).digest() for x, y in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), *b.columns[:3]], ["key", "block", "row", "doc"])

    small = blocks.count() * 32 <= broadcast_bytes
    inside = src.join(F.broadcast(blocks) if small else blocks, F.col("row") == F.col("r")).select("block", "row", "doc", "t")
    marked = keep(inside.mapInArrow(digests, "key BINARY, block LONG, row LONG, doc LONG"))
    order = F.struct(F.col("doc").isNull().alias("x"), "doc", "row", "block")
    first = marked.groupBy("key").agg(F.min(order).alias("o"), F.count("*").alias("many")).select("key", "many", "o.block", "o.row", "o.doc")
    return marked, keep(first)


def _split(src: DataFrame, blocks: DataFrame, n: int, least: float, region: int, broadcast_bytes: int) -> DataFrame:
    """Where the rows of large blocks go: Voronoi regions, and pairs of tiles for regions that stay large.

    ``blocks`` has (block, r, count). The pivots' texts are sent to all tasks if they have at most half of
    ``broadcast_bytes``; else they are shuffled to cells of some thousand members of their block, before those.
    """
    w = Window.partitionBy("block").orderBy(F.xxhash64("r"), "r")
    chosen = blocks.withColumn("i", F.row_number().over(w)).filter(F.col("i") <= F.least(F.lit(32), 4 * F.ceil(F.col("count") / region))).select("block", "r", "count")
    chosen = keep(chosen)
    few = F.broadcast(chosen) if chosen.count() * 32 <= broadcast_bytes else chosen
    texts = src.join(few, F.col("row") == F.col("r")).select("block", "count", "row", "t")
    small = (blocks.count() or 0) * 32 <= broadcast_bytes
    inside = src.join(F.broadcast(blocks) if small else blocks, F.col("row") == F.col("r")).select("block", "count", "row", "t")

    def assigned(block: int, rows: list[int], col: pa.Array, ps: list[np.ndarray], out: dict) -> None:
        h, t = gram_sets(col, n)
        at = np.searchsorted(t, np.arange(len(col) + 1))
        sizes = np.array([len(p) for p in ps], np.int64)
        for i, row in enumerate(rows):
            x = h[at[i] : at[i + 1]]
            both = np.array([np.isin(p, x, assume_unique=True).sum() for p in ps], np.int64)
            home, near = assign((1 - both / np.maximum(1, len(x) + sizes - both))[None, :], 1 - least)
            for q in sorted({*np.flatnonzero(near[0]).tolist(), int(home[0])}):
                for k, v in zip(out, (row, int(mix(np.array([block * 64 + q], np.int64).view(np.uint64)).view(np.int64)[0]), q, int(home[0]))):
                    out[k].append(v)

    def batch(out: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64() if k in ("r", "region") else pa.int32()) for k, v in out.items()})

    def fresh_rows() -> dict:
        return {"r": [], "region": [], "q": [], "home": []}

    if (texts.agg(F.sum(F.octet_length("t"))).first()[0] or 0) <= broadcast_bytes // 2:
        pivots: dict[int, list[np.ndarray]] = {}
        for block, row, t in sorted(texts.select("block", "row", "t").collect(), key=lambda x: x[1]):
            pivots.setdefault(block, []).append(gram_sets(pa.array([t]), n)[0])
        sent = src.sparkSession.sparkContext.broadcast(pivots)

        def regions(batches):
            for b in slices(batches, "t"):
                out = fresh_rows()
                block = b.column(0).to_numpy()
                order = np.argsort(block, kind="stable")
                for x, y in zip(*bounds(block[order])):
                    at = pa.array(order[x:y])
                    assigned(int(block[order[x]]), b.column(1).take(at).to_pylist(), b.column(2).take(at), sent.value.get(int(block[order[x]]), []), out)
                yield batch(out)

        placed = inside.select("block", "row", "t").mapInArrow(regions, "r LONG, region LONG, q INT, home INT")
    else:
        salts = F.ceil(F.col("count") / region).cast("int")
        left = texts.select("block", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(0).alias("kind"), "row", "t")
        right = inside.select("block", F.pmod(F.xxhash64("row"), salts).cast("int").alias("salt"), F.lit(1).alias("kind"), "row", "t")
        cells = left.unionByName(right).repartition("block", "salt").sortWithinPartitions("block", "salt", "kind", F.when(F.col("kind") == 0, F.col("row")))

        def stream(batches):
            cell, ps = None, []
            for b in slices(batches, "t"):
                out, key = fresh_rows(), list(zip(*(b.column(i).to_pylist() for i in range(3))))
                x = 0
                while x < len(key):
                    y = next((i for i in range(x, len(key)) if key[i] != key[x]), len(key))
                    if key[x][:2] != cell:
                        cell, ps = key[x][:2], []
                    if key[x][2] == 0:
                        ps += [gram_sets(b.column(4).slice(i, 1), n)[0] for i in range(x, y)]
                    else:
                        assigned(cell[0], b.column(3).slice(x, y - x).to_pylist(), b.column(4).slice(x, y - x), ps, out)
                    x = y
                yield batch(out)

        placed = cells.mapInArrow(stream, "r LONG, region LONG, q INT, home INT")
    placed = keep(placed)
    tiles = placed.groupBy("region").agg(F.ceil(F.count("*") / region).cast("int").alias("c"))
    x = placed.join(tiles, "region").withColumn("chunk", F.pmod(F.xxhash64("r"), F.col("c")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
    x = x.withColumn("ci", F.least("chunk", "o").cast("int")).withColumn("cj", F.greatest("chunk", "o").cast("int"))
    return x.select("r", F.xxhash64("region", "ci", "cj").alias("region"), *_PLACE)


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text_col}`").cast("string").alias("t"))
    return with_row_id(src, "row").select("row", "doc", "t")


def jaccard_pairs(docs: DataFrame, n: int = 3, least: float = 0.6, region: int = 4000, id_col: str = "doc_id", text_col: str = "text", segments: int | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_a, doc_b, jaccard): the links between first documents, and each copy with its first."""
    return row_pairs(_source(docs, id_col, text_col), n, least, region, segments, broadcast_bytes).select("doc_a", "doc_b", "jaccard")


def classes(docs: DataFrame, n: int = 3, least: float = 0.6, region: int = 4000, id_col: str = "doc_id", text_col: str = "text", segments: int | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, class_id, links): one row for each row of ``docs``."""
    src = _source(docs, id_col, text_col)
    found = row_classes(src, n, least, region, segments, broadcast_bytes)
    joined = src.select("row", "doc").join(found, F.col("row") == F.col("r"), "left")
    return joined.select(F.col("doc").alias("doc_id"), F.when(F.col("r").isNull(), F.col("doc")).otherwise(F.col("class")).alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


def keep_one(docs: DataFrame, n: int = 3, least: float = 0.6, region: int = 4000, id_col: str = "doc_id", text_col: str = "text", segments: int | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` without the documents whose class has one before them in the order of (id, row)."""
    row, r = fresh(docs, "row", "r")
    whole = with_row_id(docs, row)
    src = whole.select(F.col(row).alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text_col}`").cast("string").alias("t"))
    gone = row_classes(src, n, least, region, segments, broadcast_bytes).filter(F.col("r") != F.col("first_row")).select(F.col("r").alias(r))
    return whole.join(gone, F.col(row) == F.col(r), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, g FROM (
  SELECT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(0, len(w) - 2), lambda p: array_to_string(w[p + 1:p + 3], ' ')) ELSE [array_to_string(w, ' ')] END) AS g
  FROM w WHERE len(w) > 0)),
s AS (SELECT doc_id, md5(string_agg(g, '|' ORDER BY g)) AS s, count(*) AS n FROM g GROUP BY doc_id),
f AS MATERIALIZED (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY s) AS first FROM s),
r AS (SELECT g.doc_id, g.g, f.n FROM g JOIN f USING (doc_id) WHERE f.first = doc_id),
p AS (SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, count(*) AS shared, any_value(a.n) AS na, any_value(b.n) AS nb
      FROM r a JOIN r b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT doc_a AS a, doc_b AS b FROM p WHERE shared / (na + nb - shared) >= 0.6 - 1e-12),
c(a, b) AS (SELECT DISTINCT first, first FROM f UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a),
k AS (SELECT a, min(b) AS class_id FROM c GROUP BY a),
m AS (SELECT first, count(*) AS many FROM f GROUP BY first),
l AS (SELECT e.a, CAST(sum(m.many) AS BIGINT) AS links FROM e JOIN m ON m.first = e.b GROUP BY e.a)
SELECT d.doc_id, coalesce(k.class_id, d.doc_id) AS class_id, CAST(coalesce(m.many - 1, 0) + coalesce(l.links, 0) AS BIGINT) AS links
FROM documents d LEFT JOIN f USING (doc_id) LEFT JOIN k ON k.a = f.first LEFT JOIN m ON m.first = f.first LEFT JOIN l ON l.a = f.first
"""


def op3_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
