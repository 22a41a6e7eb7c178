"""Session helpers shared by the operators: the shared folder, row identity and schema plumbing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a driver sends to every task at once stays below this; each operator has another way beyond it.
BROADCAST_BYTES = 64 << 20


# Buffers go back to the system when they are freed, so a worker's memory follows what it holds.
pa.set_memory_pool(pa.system_memory_pool())


def small_batches(spark: SparkSession, rows: str = "1000") -> None:
    """Send whole texts to Python in batches of 1,000 rows, unless the session says otherwise than Spark's 10,000."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, rows)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; on one machine only (tests), one of our own where it is unset."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return sc._jsc.sc().getCheckpointDir().get()
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="pagelens-")
    sc.setCheckpointDir(path)
    return sc._jsc.sc().getCheckpointDir().get()


def keep(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder once and cut its lineage there; survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def store(df: DataFrame) -> DataFrame:
    """Like ``keep``, but as compressed Parquet, whose columns later readers can prune."""
    path = f"{shared_dir(df.sparkSession)}/t-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def segments_for(src: DataFrame, text: str, each: int, most: int) -> int:
    """A power of two, so that every segment of the hash space has about ``each`` bytes of text; 16 at least."""
    size = src.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return min(most, 1 << max(4, (-(-int(size) // each) - 1).bit_length()))


def each_segment(df: DataFrame, segments: int, run: Callable[[int, pa.Table], pa.Table], schema: str, most: int = 20_000) -> DataFrame:
    """``run`` for all rows of each segment (a column of ``df``), in partitions of one segment each up to ``most`` of them.

    Beyond that a partition reads several, one after the other. Numbers below 0 are segments of their own.
    """
    n = min(segments, most)
    df = df.repartitionById(n, F.pmod(F.col("segment"), F.lit(n)).cast("int"))
    if segments > n:
        df = df.sortWithinPartitions("segment")
    at = df.columns.index("segment")

    def parts(batches):
        waiting: dict[int, list[pa.RecordBatch]] = {}
        for b in batches:
            seg = b.column(at).to_numpy()
            for k in dict.fromkeys(seg.tolist()):
                if segments > n and k not in waiting and waiting:
                    yield from flush(waiting)
                waiting.setdefault(k, []).append(b if (seg == k).all() else b.filter(pa.array(seg == k)))
        yield from flush(waiting)

    def flush(waiting):
        while waiting:
            k, own = waiting.popitem()
            yield from run(k, pa.Table.from_batches(own)).to_batches()

    return df.mapInArrow(parts, schema)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores in front until no column of ``df`` has that name."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


_MOVES = ("Exchange", "Join", "Aggregate", "Sort", "Window", "Union", "Limit", "Sample", "Python", "Arrow", "Pandas", "Generate")


def with_row_id(df: DataFrame, name: str) -> DataFrame:
    """Add a BIGINT that tells rows apart even if they are equal.

    The id counts rows of a scan, so it is the same whenever a plan that only scans, filters and projects
    runs again. Any other plan could deliver its rows in another order after a retry, so its rows are
    written to the shared folder first and counted there.
    """
    small_batches(df.sparkSession)
    plan = df._jdf.queryExecution().sparkPlan().toString()
    if any(m in plan for m in _MOVES):
        df = store(df)
    return df.withColumn(name, F.monotonically_increasing_id())


def slices(batches: Iterable[pa.RecordBatch], text: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the texts of one piece have at most ``limit`` bytes, or it is one row."""
    for b in batches:
        col, start, size = b.column(b.schema.get_field_index(text)), 0, 0
        if col.nbytes <= limit:
            if b.num_rows:
                yield b
            continue
        lengths = pc.fill_null(pc.binary_length(col), 0).to_pylist()
        for i, n in enumerate(lengths):
            if size + n > limit and i > start:
                yield b.slice(start, i - start)
                start, size = i, 0
            size += n
        if b.num_rows > start:
            yield b.slice(start)


def struct(*fields: tuple[str, str]) -> T.StructType:
    """A schema from (name, DDL type) pairs; names may hold any character."""
    return T.StructType([T.StructField(n, T._parse_datatype_string(t)) for n, t in fields])
