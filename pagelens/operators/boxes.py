"""Markup to boxes and pages: the one step that runs in Python, Arrow-batched, once per document."""

from __future__ import annotations

import time
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelens.functions import markup as M
from pagelens.functions import shapes
from pagelens.functions.sanitize import sanitize

#: Bytes of markup that a task works on at a time; a longer document is a piece of its own.
PIECE = 4 << 20
FEATURES = {
    "TEXT": ["text", "trailing", "hyphen_start", "dehyphenated"],
    "OFFSETS": ["text_off", "src_len", "dehyphenated_off"],
    "COORDINATES": ["ulx", "uly", "lrx", "lry"],
    "CONFIDENCE": ["confidence"],
    "ALTERNATIVES": ["alternatives"],
    "PAGES": ["page_idx", "page_id", "page_width", "page_height"],
}
_ARROW = pa.struct([
    ("box_seq", pa.int32()), ("text", pa.string()), ("text_off", pa.int64()), ("src_len", pa.int32()), ("trailing", pa.string()),
    ("ulx", pa.float32()), ("uly", pa.float32()), ("lrx", pa.float32()), ("lry", pa.float32()), ("confidence", pa.float64()),
    ("page_idx", pa.int32()), ("page_id", pa.string()), ("page_width", pa.int32()), ("page_height", pa.int32()),
    ("line_seq", pa.int32()), ("par_seq", pa.int32()), ("block_seq", pa.int32()), ("section_seq", pa.int32()),
    ("alternatives", pa.list_(pa.struct([("text", pa.string()), ("off", pa.int64())]))),
    ("hyphen_start", pa.bool_()), ("dehyphenated", pa.string()), ("dehyphenated_off", pa.int64()),
])
_BOX = (
    "STRUCT<box_seq: INT, text: STRING, text_off: BIGINT, src_len: INT, trailing: STRING, ulx: FLOAT, uly: FLOAT, lrx: FLOAT, lry: FLOAT, confidence: DOUBLE, "
    "page_idx: INT, page_id: STRING, page_width: INT, page_height: INT, line_seq: INT, par_seq: INT, block_seq: INT, section_seq: INT, "
    "alternatives: ARRAY<STRUCT<text: STRING, off: BIGINT>>, hyphen_start: BOOLEAN, dehyphenated: STRING, dehyphenated_off: BIGINT>"
)


_PAGE = M.Page(None)


def _columns(text: str, fix: bool, formats: tuple[M.Format, ...], out: list[list]) -> tuple[str | None, int]:
    """Append the words of a document to the columns ``out``; (format, number of words)."""
    name = M.detect(text, formats)
    boxes, pages = M.parse(sanitize(text, fix), name, formats)
    of = [pages[b.page_idx] if 0 <= b.page_idx < len(pages) else _PAGE for b in boxes]
    seq = [b.seq for b in boxes]
    values = (
        range(len(boxes)), [b.text for b in boxes], [b.text_off for b in boxes], [b.src_len for b in boxes], [b.trailing for b in boxes],
        [b.ulx for b in boxes], [b.uly for b in boxes], [b.lrx for b in boxes], [b.lry for b in boxes], [b.confidence for b in boxes],
        [b.page_idx for b in boxes], [p.id for p in of], [p.width for p in of], [p.height for p in of],
        [s[4] for s in seq], [s[3] for s in seq], [s[2] for s in seq], [s[1] for s in seq],
        [[{"text": t, "off": o} for t, o in b.alternatives] if b.alternatives else () for b in boxes],
        [b.hyphen_start for b in boxes], [b.dehyphenated for b in boxes], [b.dehyphenated_off for b in boxes],
    )
    for column, v in zip(out, values):
        column.extend(v)
    return name, len(boxes)


def parsed(docs: DataFrame, id_col: str = "doc_id", markup_col: str = "markup", fix: bool = False, time_allowed_ms: int | None = None, columns: list[str] | None = None) -> DataFrame:
    """(doc_id, format, boxes, error): one row per document; a bad document has an error, never an exception.

    ``columns`` are the columns of boxes that are asked for, since Spark can't drop what Python sends; None: all.

    ``time_allowed_ms`` bounds the work of a task: documents it doesn't get to have the error ``time``.
    """
    kind, known = docs.schema[id_col].dataType, tuple(M.FORMATS)  # tasks know formats that were registered
    box = T._parse_datatype_string(_BOX)
    fields = [f for f in _ARROW if columns is None or f.name in columns]
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("format", T.StringType()), T.StructField("boxes", T.ArrayType(T.StructType([box[f.name] for f in fields]))), T.StructField("error", T.StringType())])

    readers: dict[str, shapes.Reader] = {}

    def reader_of(name):
        if name not in readers:
            handler = next((f.handler for f in known if f.name == name), None)
            readers[name] = shapes.Reader(handler) if handler in shapes.READ else None
        return readers[name]

    def run(batches):
        began = time.monotonic()
        for b in batches:
            # Some megabytes of markup at a time: what is built from them stays small, however long documents are.
            size, k = 0, 0
            for i, n in enumerate(pc.fill_null(pc.binary_length(b.column(1)), 0).to_pylist()):
                size += n
                if size >= PIECE or i == b.num_rows - 1:
                    yield piece(b.slice(k, i + 1 - k), began)
                    size, k = 0, i + 1

    def piece(part, began):
        names, errors, out, counts = [], [], [[] for _ in _ARROW], []
        plain = {}  # documents of one plain shape by format; their words are put together at the end
        for i, text in enumerate(part.column(1).to_pylist()):
            name, n, error = None, 0, None
            if time_allowed_ms is not None and (time.monotonic() - began) * 1000 >= time_allowed_ms:
                error = "time"
            elif text is not None:
                try:
                    text = text.decode("utf-8", "replace") if isinstance(text, bytes) else text
                    name = M.detect(text, known)
                    reader = None if fix else reader_of(name)
                    if reader is not None:
                        if reader not in plain:
                            reader.begin()
                        if reader.add(text):
                            plain.setdefault(reader, []).append(i)
                            n = None
                    if n is not None:
                        name, n = _columns(text, fix, known, out)
                    error = "unknown format" if name is None and text.strip() else None
                except Exception as e:  # noqa: BLE001  (one bad document must not fail the others)
                    error = f"{type(e).__name__}: {e}"
            names.append(name)
            errors.append(error)
            counts.append(n)
        words = [pa.StructArray.from_arrays([pa.array(v, f.type) for v, f in zip(out, _ARROW) if f in fields], fields=fields)]
        rows, sizes = [i for i, n in enumerate(counts) if n is not None], [n for n in counts if n is not None]
        for reader, its in plain.items():
            n, found = reader.words(fields)
            words.append(found)
            rows += its
            sizes += n
        at = pa.array([0, *accumulate(sizes)], pa.int32())
        listed = pa.ListArray.from_arrays(at, words[0] if not plain else words[1] if len(plain) == 1 and not len(words[0]) else pa.concat_arrays(words))
        if rows != sorted(rows):
            listed = listed.take(pa.array(sorted(range(len(rows)), key=rows.__getitem__)))
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), listed, pa.array(errors, pa.string())], ["doc_id", "format", "boxes", "error"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(markup_col).alias("markup")).mapInArrow(run, schema)


def boxes(docs: DataFrame, id_col: str = "doc_id", markup_col: str = "markup", features: list[str] | None = None, **kw) -> DataFrame:
    """One row per word; ``features`` chooses groups of columns."""
    flat = parsed(docs, id_col, markup_col, **kw).select("doc_id", "format", F.inline("boxes"))
    if features is None:
        return flat
    return flat.select("doc_id", "box_seq", "line_seq", "par_seq", "block_seq", "section_seq", *[c for f in features for c in FEATURES[f]])


def format_of(markup: Column) -> Column:
    """The format of a value, without Python."""
    sample = F.substring(markup, 1, 2048)
    out = F.lit(None).cast("string")
    for f in reversed(M.FORMATS):
        out = F.when(sample.rlike(f.test.pattern), f.name).otherwise(out)
    return out


def text_of(boxes: DataFrame) -> DataFrame:
    """(doc_id, text): what is indexed; a complete hyphenation appears once, in its joined form."""
    part = F.when(F.col("hyphen_start") & F.col("dehyphenated").isNotNull(), F.col("dehyphenated")).when(F.col("hyphen_start") == F.lit(False), F.lit("")).otherwise(F.col("text"))
    piece = F.concat(part, F.coalesce("trailing", F.lit("")))
    listed = F.array_sort(F.collect_list(F.struct("box_seq", piece.alias("s"))))
    return boxes.groupBy("doc_id").agg(F.trim(F.array_join(F.transform(listed, lambda x: x["s"]), "")).alias("text"))
