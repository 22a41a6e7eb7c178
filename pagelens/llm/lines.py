"""Line dedup: two Bloom filters find suspected repeats; only those are shuffled, confirmed and ordered.

1. Every task hashes the lines of its rows. The 64-bit hashes of a task go, packed, to the segment that their
   upper bits name. A segment keeps two Bloom filters: a hash that finds itself in the *once* filter enters the
   *twice* filter. Segments are independent, and there is one for every 8 MB of text (at most 262,144), so the
   filters grow in number with the data, not in size.
2. The twice filters together hold repeated lines only. If they have at most ``broadcast_bytes``, every task
   gets them and tests its lines in place. Beyond that size the hashes travel instead: packed (hash, row, line)
   triples go to their segment, are tested there, and only the addresses of suspects return.
3. Suspected lines are shuffled as text. Equal texts (never only equal hashes) are repeats; the first
   occurrence stays, in the order of (id, row, line), and the others are removed from their documents.

Lines are what line feeds separate; they are equal if all their characters are. Results for special input:

* a line of blanks, tabs and carriage returns only, or with fewer than ``min_chars`` characters, always stays;
* a null or empty text stays as it is; null ids come last in the order of occurrence;
* equal ids, or equal rows: separate rows, in the order of the table; the first row keeps the line;
* a repeat within one document: the first of its lines stays;
* a document that loses all its lines has the text '' (or goes, with ``drop_emptied``);
* very long lines and texts are compared whole;
* other columns are kept, whatever their names; an empty table: no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.llm._spark import BROADCAST_BYTES, each_segment, fresh, keep, segments_for, slices, with_row_id
from pagelens.llm._text import mix

_BITS, _HASHES = 16, 4


def places(h: np.ndarray, m: np.ndarray | int) -> list[np.ndarray]:
    """The places of every hash in a filter of ``m`` bits, a power of two."""
    g = mix(h)
    a, b = g & np.uint64(0xFFFFFFFF), (g >> np.uint64(32)) | np.uint64(1)
    mask = np.asarray(m, np.uint64) - np.uint64(1)
    return [((a + np.uint64(i) * b) & mask).astype(np.int64) for i in range(_HASHES)]


def bits_for(n: int) -> int:
    return max(64, 1 << int(np.ceil(np.log2(max(1, n) * _BITS))))


class Bloom:
    def __init__(self, n: int):
        self.m = bits_for(n)
        self.bit = np.zeros(self.m, bool)

    def add(self, h: np.ndarray) -> None:
        for p in places(h, self.m):
            self.bit[p] = True

    def has(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for p in places(h, self.m):
            out &= self.bit[p]
        return out

    def packed(self) -> bytes:
        return np.packbits(self.bit, bitorder="little").tobytes()


def split(text: str | None, min_chars: int) -> tuple[list[str], list[int]]:
    """The lines that may be removed, and their numbers."""
    if not text:
        return [], []
    pairs = [(x, i) for i, x in enumerate(text.split("\n")) if len(x) >= min_chars and x.strip(" \t\r")]
    return [p[0] for p in pairs], [p[1] for p in pairs]


def hashes(lines: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(x.encode()) for x in lines), np.uint64, len(lines))


def _filters(src: DataFrame, text: str, shift: int, min_chars: int) -> DataFrame:
    """(segment, m, bits): the twice filter of every segment that has one."""

    def collect(batches):
        waiting, size = [], 0

        def flush():
            h, n = np.unique(np.concatenate(waiting), return_counts=True)
            seg = (h >> np.uint64(shift)).astype(np.int64)
            at = np.flatnonzero(np.append(True, seg[1:] != seg[:-1]))
            to = np.append(at[1:], len(h))
            return pa.RecordBatch.from_pydict({"segment": seg[at], "h": [h[a:b].tobytes() for a, b in zip(at, to)], "again": [h[a:b][n[a:b] > 1].tobytes() for a, b in zip(at, to)]})

        for b in batches:
            for t in b.column(0).to_pylist():
                h = hashes(split(t, min_chars)[0])
                if len(h):
                    waiting.append(h)
                    size += len(h)
            if size > 4_000_000:
                yield flush()
                waiting, size = [], 0
        if size:
            yield flush()

    def build(segment, table):
        rows = [(np.frombuffer(h, np.uint64), np.frombuffer(a, np.uint64)) for h, a in zip(table["h"].to_pylist(), table["again"].to_pylist())]
        once, twice = Bloom(sum(len(h) for h, _ in rows)), []
        for h, again in rows:
            twice += [h[once.has(h)], again]
            once.add(h)
        found = np.unique(np.concatenate(twice))
        second = Bloom(len(found))
        second.add(found)
        keep = slice(0, int(len(found) > 0))
        return pa.table({"segment": pa.array([segment][keep], pa.int64()), "m": pa.array([second.m][keep], pa.int64()), "bits": pa.array([second.packed()][keep], pa.binary())})

    packed = src.select(text).mapInArrow(collect, "segment LONG, h BINARY, again BINARY")
    return each_segment(packed, 1 << (64 - shift), build, "segment LONG, m LONG, bits BINARY")


def _tester(rows: list[tuple[int, int, bytes]], segments: int, shift: int):
    """A function that tells which hashes are in the twice filters ``rows``."""
    size, at, parts, n = np.ones(segments, np.int64), np.zeros(segments, np.int64), [np.zeros(64, np.uint8)], 64
    for seg, m, bits in rows:
        size[seg], at[seg] = m, n
        parts.append(np.frombuffer(bits, np.uint8))
        n += m // 8
    flat = np.concatenate(parts)

    def has(h: np.ndarray) -> np.ndarray:
        seg = (h >> np.uint64(shift)).astype(np.int64)
        m, base = size[seg], at[seg]
        out = m > 1
        for p in places(h, m):
            out &= ((flat[base + (p >> 3)] >> (p & 7).astype(np.uint8)) & 1).astype(bool)
        return out

    return has


def suspects(src: DataFrame, row: str, doc: str, text: str, min_chars: int, segments: int, broadcast_bytes: int) -> DataFrame:
    """(doc, row, line, content) of every line that may occur more than once."""
    spark, shift = src.sparkSession, 64 - (segments.bit_length() - 1)
    filters = keep(_filters(src, text, shift, min_chars))
    schema = "doc LONG, row LONG, line INT, content STRING"
    if (filters.agg(F.sum(F.length("bits"))).first()[0] or 0) <= broadcast_bytes:
        sent = spark.sparkContext.broadcast([tuple(r) for r in filters.collect()])

        def test(batches):
            has = _tester(sent.value, segments, shift)
            for b in slices(batches, text):
                docs, rows, lines, contents = [], [], [], []
                for d, r, t in zip(*(b.column(i).to_pylist() for i in range(3))):
                    part, no = split(t, min_chars)
                    hit = np.flatnonzero(has(hashes(part))).tolist() if part else []
                    docs += [d] * len(hit)
                    rows += [r] * len(hit)
                    lines += [no[i] for i in hit]
                    contents += [part[i] for i in hit]
                yield pa.RecordBatch.from_pydict({"doc": pa.array(docs, pa.int64()), "row": pa.array(rows, pa.int64()), "line": pa.array(lines, pa.int32()), "content": pa.array(contents, pa.string())})

        return src.select(F.col(doc).cast("long").alias(doc), row, text).mapInArrow(test, schema)

    def address(batches):
        for b in slices(batches, text):
            h, rows, lines = [], [], []
            for r, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                part, no = split(t, min_chars)
                h.append(hashes(part))
                rows.append(np.full(len(no), r, np.int64))
                lines.append(np.array(no, np.int32))
            h, rows, lines = np.concatenate(h), np.concatenate(rows), np.concatenate(lines)
            order = np.argsort(h)
            h, rows, lines = h[order], rows[order], lines[order]
            seg = (h >> np.uint64(shift)).astype(np.int64)
            at = np.flatnonzero(np.append(True, seg[1:] != seg[:-1])) if len(h) else []
            to = np.append(at[1:], len(h)) if len(h) else []
            yield pa.RecordBatch.from_pydict({"segment": pa.array([int(seg[a]) for a in at], pa.int64()), "h": pa.array([h[a:z].tobytes() for a, z in zip(at, to)], pa.binary()), "rows": pa.array([rows[a:z].tobytes() for a, z in zip(at, to)], pa.binary()), "lines": pa.array([lines[a:z].tobytes() for a, z in zip(at, to)], pa.binary())})

    def there(batches):
        for b in batches:
            for seg, h, rows, lines, m, bits in zip(*(c.to_pylist() for c in b.columns)):
                h = np.frombuffer(h, np.uint64)
                hit = _tester([(seg, m, bits)], segments, shift)(h)
                yield pa.RecordBatch.from_pydict({"r": np.frombuffer(rows, np.int64)[hit], "line": np.frombuffer(lines, np.int32)[hit]})

    packed = src.select(row, text).mapInArrow(address, "segment LONG, h BINARY, rows BINARY, lines BINARY")
    hits = packed.join(filters.hint("shuffle_hash"), "segment").select("segment", "h", "rows", "lines", "m", "bits").mapInArrow(there, "r LONG, line INT")
    back = src.join(hits, F.col(row) == F.col("r"))
    return back.select(F.col(doc).cast("long").alias("doc"), F.col(row).alias("row"), "line", F.element_at(F.split(text, "\n", -1), F.col("line") + 1).alias("content"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 1, drop_emptied: bool = False, removed_col: str | None = None, segments: int | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` without repeated lines; ``removed_col`` adds the number of lines that a row lost."""
    row, gone, r, d, t = fresh(docs, "row", "gone", "r", "d", "t")
    src = with_row_id(docs, row)
    plain = src.select(F.col(f"`{id_col}`").cast("long").alias(d), F.col(row), F.col(f"`{text_col}`").cast("string").alias(t))
    segments = segments or segments_for(plain, t, 8 << 20, 1 << 18)
    lines = keep(suspects(plain, row, d, t, min_chars, segments, broadcast_bytes))
    order = F.struct(F.col("doc").isNull().alias("a"), "doc", "row", "line")
    first = lines.groupBy("content").agg(F.min(order).alias("o"), F.count("*").alias("n")).filter("n > 1")
    later = lines.join(first, "content").filter((F.col("row") != F.col("o.row")) | (F.col("line") != F.col("o.line")))
    drops = later.groupBy(F.col("row").alias(r)).agg(F.collect_list("line").alias(gone))
    text = F.col(f"`{text_col}`")
    kept = F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains(F.col(gone), i)), "\n")
    out = src.join(drops, F.col(row) == F.col(r), "left")
    new = F.when(F.col(gone).isNull(), text).otherwise(kept)
    out = out.select(*[(new.alias(c) if c == text_col else F.col(f"`{c}`")) for c in docs.columns], F.coalesce(F.size(gone), F.lit(0)).alias(gone))
    if drop_emptied:
        out = out.filter((F.col(gone) == 0) | (F.trim(F.translate(text, "\t\r\n", "   ")) != ""))
    return out.withColumnRenamed(gone, removed_col) if removed_col else out.drop(gone)


ORACLE_SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
k AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) <> '' AND row_number() OVER (PARTITION BY line ORDER BY doc_id, i) > 1 AS repeated FROM l)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT repeated), '') AS text,
       CAST(count(*) FILTER (repeated) AS INTEGER) AS removed_lines
FROM k GROUP BY doc_id
"""


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs, removed_col="removed_lines")
