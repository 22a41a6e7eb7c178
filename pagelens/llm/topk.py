"""Exact top-k search: tiled matrix products of queries and shards, partial selection, tree merging.

Queries and vectors are packed into tiles of at most ``tile`` rows. A task holds the query tiles and reads its tiles of
vectors one after the other; each pair of tiles is one matrix product in double precision, of which only the best ``k``
of every query are selected and merged into the task's list. The lists of all tasks are then merged in a tree of
``fan`` lists at a time until one is left, so no task ever holds more than ``fan`` lists of a query tile.

Query tiles of at most ``broadcast_bytes`` together are sent to all tasks, and the vectors never move. Beyond that size
the products form a grid: query tiles are dealt to bands of that size, vectors to ``columns`` columns; each cell of the
grid is one task that keeps its band and streams its column. The number of cells follows the queries, not the square
of the tiles.

Results for special input:

* a null id, a null vector, or a vector with a null, infinite or NaN element: the row is neither query nor answer;
* vectors are compared only with vectors of the same length; an empty vector has no answers;
* a vector of zeros has similarity 0 to everything;
* equal scores (after rounding to 9 decimals) go by smaller id; rows that repeat an id are one item each, and a
  row is never an answer to a row with its own id;
* queries that repeat an id or a whole row: each row has a list of its own;
* fewer than ``k`` others: all of them; an empty table: no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.llm._spark import BROADCAST_BYTES, keep


def _pack(batches: Iterable[pa.RecordBatch], tile: int) -> Iterator[pa.RecordBatch]:
    """Rows of one partition to tiles of one vector length; a tile's vectors have length 1."""
    waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

    def out(dim: int, ids: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        norm = np.sqrt((v * v).sum(1, keepdims=True))
        v = np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)
        return pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "ids": [ids.tobytes()], "vectors": [v.tobytes()]})

    for b in batches:
        at = b.column(1).offsets.to_numpy()
        values = b.column(1).values.to_numpy(zero_copy_only=False)  # null elements as NaN
        use = np.flatnonzero(pc.and_(b.column(0).is_valid(), b.column(1).is_valid()).to_numpy(zero_copy_only=False))
        ids = pc.fill_null(b.column(0), 0).to_numpy()
        size = np.diff(at)
        for dim in np.unique(size[use]).tolist():
            rows = use[size[use] == dim]
            v = values[at[rows][:, None] + np.arange(dim)]
            good = np.isfinite(v).all(1)
            if not dim or not good.any():
                continue
            kept = waiting.setdefault(dim, [])
            kept.append((ids[rows[good]], v[good]))
            if sum(len(x) for x, _ in kept) >= tile:
                i, v = np.concatenate([x for x, _ in kept]), np.concatenate([y for _, y in kept])
                whole = len(i) // tile * tile
                for k in range(0, whole, tile):
                    yield out(dim, i[k : k + tile], v[k : k + tile])
                waiting[dim] = [(i[whole:], v[whole:])] if whole < len(i) else []
    for dim, kept in waiting.items():
        if kept:
            yield out(dim, np.concatenate([x for x, _ in kept]), np.concatenate([y for _, y in kept]))


def select(scores: np.ndarray, qid: np.ndarray, sid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Partial selection in a tile: what could be among a query's ``k`` best, ties at the edge decided by id."""
    scores = np.where(qid[:, None] == sid[None, :], -np.inf, scores)
    n = scores.shape[1]
    edge = np.partition(scores, n - k, axis=1)[:, n - k] if n > k else np.full(len(scores), -np.inf)
    row, col = np.nonzero((scores >= edge[:, None] - 2e-9) & (scores > -np.inf))
    width = max(1, int(np.bincount(row, minlength=len(scores)).max(initial=1)))
    at = np.arange(len(row)) - np.searchsorted(row, np.arange(len(scores)))[row]
    ids, out = np.full((len(scores), width), np.iinfo(np.int64).max), np.full((len(scores), width), -np.inf)
    ids[row, at], out[row, at] = sid[col], np.round(scores[row, col], 9) + 0.0
    order = np.lexsort((ids, -out), axis=1)[:, :k]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(out, order, 1)


def _search(q: list[tuple[int, int, np.ndarray, np.ndarray]], tiles, k: int, step: int = 512):
    """(number of the query tile, ids, scores): the best ``k`` among ``tiles`` of (dim, ids, vectors) for each query tile."""
    none = np.iinfo(np.int64).max
    best = [(np.full((len(i), k), none), np.full((len(i), k), -np.inf)) for _, _, i, _ in q]
    for dim, sid, c in tiles:
        for t, (_, d, qid, a) in enumerate(q):
            if d != dim:
                continue
            for i in range(0, len(qid), step):
                x, y = select(a[i : i + step] @ c.T, qid[i : i + step], sid, k)
                ids, scores = np.concatenate([best[t][0][i : i + step], x], 1), np.concatenate([best[t][1][i : i + step], y], 1)
                order = np.lexsort((ids, -scores), axis=1)[:, :k]
                best[t][0][i : i + step], best[t][1][i : i + step] = np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)
    for (no, _, _, _), (ids, scores) in zip(q, best):
        if np.isfinite(scores).any():
            yield no, ids, scores


def _tile(r: dict) -> tuple[int, np.ndarray, np.ndarray]:
    ids = np.frombuffer(r["ids"], np.int64)
    return r["dim"], ids, np.frombuffer(r["vectors"]).reshape(len(ids), -1)


_TILE, _LIST = "dim INT, ids BINARY, vectors BINARY", "q LONG, s LONG, ids BINARY, scores BINARY"


def exact_topk(vectors: DataFrame, queries: DataFrame | None = None, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, tile: int = 4096, fan: int = 8, columns: int = 64, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(query_id, rank, neighbor_id, score): the ``k`` most cosine-similar other vectors of every row of ``queries``.

    ``queries`` has the columns of ``vectors``; without it every vector is a query.
    """
    spark = vectors.sparkSession
    plain = lambda df: df.select(F.col(f"`{id_col}`").cast("long").alias("i"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    src = plain(vectors)
    asked = plain(vectors if queries is None else queries)
    # The query tiles are written once: their numbers name the lists.
    n = asked.count()
    asked = asked.repartition(max(1, -(-n // tile))).mapInArrow(lambda b: _pack(b, tile), _TILE)
    asked = keep(asked.withColumn("q", F.monotonically_increasing_id()).select("q", *_names(_TILE)))
    size = asked.agg(F.sum(F.octet_length("vectors") + F.octet_length("ids"))).first()[0] or 0

    if size <= broadcast_bytes:
        sent = spark.sparkContext.broadcast([(r["q"], *_tile(r.asDict())) for r in asked.collect()])

        def product(batches):
            for no, ids, scores in _search(sent.value, (_tile(r) for b in _pack(batches, tile) for r in b.to_pylist()), k):
                yield _row(no, 0, ids, scores)

        lists = src.mapInArrow(product, _LIST).withColumn("s", F.spark_partition_id().cast("long"))
        parts = src.rdd.getNumPartitions()
    else:
        bands = -(-int(size) // max(1, broadcast_bytes))
        parts = columns
        packed = src.mapInArrow(lambda b: _pack(b, tile), _TILE)
        # A cell's queries come before its vectors, so it holds the queries and one tile of vectors.
        left = asked.withColumn("band", F.pmod(F.xxhash64("q"), F.lit(bands))).withColumn("column", F.explode(F.sequence(F.lit(0), F.lit(columns - 1)))).withColumn("kind", F.lit(0))
        right = packed.withColumn("column", F.pmod(F.xxhash64("ids"), F.lit(columns)).cast("int")).withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(bands - 1)).cast("array<long>"))).withColumn("kind", F.lit(1)).withColumn("q", F.lit(None).cast("long"))
        cells = left.unionByName(right).withColumn("cell", F.col("band") * columns + F.col("column"))
        cells = cells.repartition(bands * columns, "cell").sortWithinPartitions("cell", "kind").select("cell", "column", "kind", "q", *_names(_TILE))

        def product(batches):
            rows = (r for b in batches for i in range(b.num_rows) for r in b.slice(i, 1).to_pylist())
            for _, cell in itertools.groupby(rows, key=lambda r: r["cell"]):
                held, column = [], 0
                for kind, part in itertools.groupby(cell, key=lambda r: r["kind"]):
                    if kind == 0:
                        held = []
                        for r in part:
                            held.append((r["q"], *_tile(r)))
                            column = r["column"]
                    else:
                        for no, ids, scores in _search(held, map(_tile, part), k):
                            yield _row(no, column, ids, scores)

        lists = cells.mapInArrow(product, _LIST)

    def merge(key, table):
        ids, scores = [], []
        for i, x in zip(table["ids"].to_pylist(), table["scores"].to_pylist()):
            ids.append(np.frombuffer(i, np.int64).reshape(-1, k))
            scores.append(np.frombuffer(x).reshape(-1, k))
        ids, scores = np.concatenate(ids, 1), np.concatenate(scores, 1)
        order = np.lexsort((ids, -scores), axis=1)[:, :k]
        return pa.Table.from_batches([_row(key[0].as_py(), key[1].as_py(), np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1))])

    while parts > 1:
        lists = lists.withColumn("g", F.floor(F.col("s") / fan).cast("long")).groupBy("q", "g").applyInArrow(merge, _LIST)
        parts = -(-parts // fan)

    def flat(batches):
        for b in batches:
            for qids, ids, scores in zip(*(b.column(i).to_pylist() for i in range(3))):
                qid = np.frombuffer(qids, np.int64)
                ids, scores = np.frombuffer(ids, np.int64).reshape(len(qid), k), np.frombuffer(scores).reshape(len(qid), k)
                row, col = np.nonzero(scores > -np.inf)
                yield pa.RecordBatch.from_pydict({"query_id": qid[row], "rank": (col + 1).astype(np.int32), "neighbor_id": ids[row, col], "score": scores[row, col]})

    named = lists.select("q", F.col("ids").alias("found"), "scores").join(asked.select("q", F.col("ids").alias("qids")), "q")
    return named.select("qids", "found", "scores").mapInArrow(flat, "query_id LONG, rank INT, neighbor_id LONG, score DOUBLE")


def _names(ddl: str) -> list[str]:
    return [x.split()[0] for x in ddl.split(", ")]


def _row(q: int, s: int, ids: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"q": [q], "s": [s], "ids": [np.ascontiguousarray(ids).tobytes()], "scores": [np.ascontiguousarray(scores).tobytes()]})


ORACLE_SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS l FROM v),
p AS (
  SELECT a.vec_id AS query_id, b.vec_id AS neighbor_id,
         round(CASE WHEN a.l > 0 AND b.l > 0 THEN list_dot_product(a.e, b.e) / (a.l * b.l) ELSE 0 END, 9) AS s
  FROM n a JOIN n b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, neighbor_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, neighbor_id, round(s, 6) AS score FROM r WHERE rank <= 10
"""


def op5_exact_topk(spark, sf_dir: str) -> DataFrame:
    """The rows whose id is divisible by 50 are the queries; all rows are searched."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return exact_topk(vectors, vectors.filter("vec_id % 50 = 0")).withColumn("score", F.round("score", 6))
