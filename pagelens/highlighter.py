"""Requests: parameters and a query in; documents, snippets and totals out.

A request is answered in two phases, as search engines do. The first finds the most relevant documents (``rows`` of
them, so their ids are few) and the second reads only their postings, units and boxes. With a time limit the second
phase works through the documents in batches, and Spark's jobs are interrupted when time is up: the documents that were
not reached have no snippets, and the response is marked as partial.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens import options as O
from pagelens.operators import index as I
from pagelens.operators import passages as P
from pagelens.operators import query as Q
from pagelens.operators import sinks as K
from pagelens.operators import snippets as S


def snippets(matches: DataFrame, units: DataFrame, boxes: DataFrame | Callable[[DataFrame], DataFrame], o: O.HighlightOptions) -> tuple[DataFrame, DataFrame]:
    """(words of the best passages with their tags, totals) of matches: what all results are made of.

    ``boxes`` can be what gives the boxes of passages, where they aren't stored.
    """
    n = P.numbered(P.bounded(matches, units, o))
    best = P.best(P.scored(n, o), o)
    return S.words(best, boxes(best) if callable(boxes) else boxes, S.spans(matches), o), P.totals(n, o)


def respond(matches: DataFrame, units: DataFrame, boxes: DataFrame | Callable[[DataFrame], DataFrame], o: O.HighlightOptions, name: str = "ocr_text") -> DataFrame:
    """(doc_id, response): JSON of all documents with matches."""
    w, totals = snippets(matches, units, boxes, o)
    r = S.regions(w, o)
    return K.responses(S.texts(w), r, S.merged_lines(S.highlights(w, r, o), r), totals, name, o)


@dataclass
class Response:
    """``docs`` is (doc_id, score) in order, with the fields of ``fl``; ``highlighting`` is (doc_id, response)."""

    docs: DataFrame
    highlighting: DataFrame | None = None
    plain: dict[str, DataFrame] = field(default_factory=dict)
    partial: bool = False

    def json(self) -> str:
        """The whole response; it has as many documents as the request's ``rows``."""
        out: dict = {"response": {"docs": [r.asDict(True) for r in self.docs.collect()]}}
        if self.highlighting is not None:
            out["ocrHighlighting"] = {str(r[0]): json.loads(r[1]) for r in self.highlighting.collect()}
        for name, df in self.plain.items():
            for r in df.orderBy("doc_id", "rank").collect():
                out.setdefault("highlighting", {}).setdefault(str(r["doc_id"]), {}).setdefault(name, []).append(r["text"])
        if self.partial:
            out["partialOcrHighlights"] = True
        return json.dumps(out, default=str)


class Highlighter:
    """Answers requests over an index of one OCR field, and stored fields of plain text."""

    def __init__(self, index: I.Index, name: str = "ocr_text", stored: DataFrame | None = None, id_col: str = "doc_id", clock: Callable[[], float] = time.monotonic):
        self.index, self.name, self.stored, self.id_col, self.clock = index, name, stored, id_col, clock
        self._one = None

    def parse(self, text: str, params: Mapping[str, object], parser: str | None = None):
        """A query in the terms of the index; the parser ``simple`` takes all text as words."""
        if parser == "simple":
            q = Q.Bool("or", tuple(Q.Term(w) for w in dict.fromkeys(Q.words(text))))
        else:
            q = Q.parse(text, "and" if str(params.get("q.op", "or")).lower() == "and" else "or")
        return Q.analysed(self._without_field(q), self.index.analysis) or Q.Bool("or", ())

    def _without_field(self, q):
        """The index has one field: its name in a query says nothing."""
        if isinstance(q, Q.Bool):
            return Q.Bool(q.kind, tuple(self._without_field(p) for p in q.parts))
        return Q.replace(q, field=None) if q.field == self.name else q

    def find(self, params: Mapping[str, object]) -> DataFrame:
        """(doc_id, score) of the documents of the page that the request asks for, most relevant first."""
        x = self.index
        found = Q.scores(x.postings, self.parse(str(params["q"]), params), lengths=x.lengths, terms=x.terms)
        filters = params.get("fq", ())
        for f in [filters] if isinstance(filters, (str, DataFrame)) else filters:
            within = f if isinstance(f, DataFrame) else Q.documents(x.postings, self.parse(f, params), terms=x.terms)
            found = found.join(within.select("doc_id"), "doc_id", "left_semi")
        rows, start = int(params.get("rows", 10)), int(params.get("start", 0))
        return found.orderBy(F.col("score").desc(), "doc_id").offset(start).limit(rows)

    def highlight(self, ids: list, q, o: O.HighlightOptions) -> list[tuple]:
        """(doc_id, response) of the documents with the given ids, which reach the scans of all tables.

        The words of their best passages, at most ``snippets`` for each id, are brought here; what is left is the layout
        of the response, planned without exchanges between tasks.
        """
        x, few = self.index, F.col("doc_id").isin(ids or [None])
        m = Q.matches(x.postings.filter(few), q, weight_matches=o.weight_matches, strict_phrases=o.use_phrase_highlighter, multi_term=o.highlight_multi_term, terms=x.terms)
        boxes, units = x.boxes.filter(few), x.units.filter(few)
        if o.context_block == "word" or I.SEQ[o.context_block] not in boxes.columns:
            units = units.unionByName(I.units(boxes, o.context_block))  # levels that the index doesn't keep
        w, totals = (self._here(df) for df in snippets(m, units, boxes, o))
        r = self._here(S.regions(w, o))
        h = S.merged_lines(S.highlights(w, r, o), r)
        return [tuple(row) for row in K.responses(S.texts(w), r, h, totals, self.name, o).collect()]

    def _here(self, df: DataFrame) -> DataFrame:
        """A small result as a table of a session that plans for one task."""
        if self._one is None:
            self._one = df.sparkSession.newSession()
            self._one.conf.set("spark.sql.shuffle.partitions", "1")
            self._one.conf.set("spark.sql.adaptive.enabled", "false")
        return self._one.createDataFrame(df.toArrow(), df.schema)

    def search(self, params: Mapping[str, object], batch: int = 10) -> Response:
        """The response to a request: ``q``, ``q.op``, ``fq``, ``rows``, ``start``, ``fl``, ``timeAllowed`` and all of ``hl``."""
        began = self.clock()
        docs = self.find(params)
        spark = docs.sparkSession
        rows = [(r["doc_id"], r["score"]) for r in docs.collect()]  # as many as ``rows``
        ids = [r[0] for r in rows]
        order = spark.createDataFrame([(i, k, s) for k, (i, s) in enumerate(rows)], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, k INT, score DOUBLE")
        wanted = [c for c in str(params.get("fl", "")).replace(",", " ").split() if self.stored is not None and c in self.stored.columns and c != self.id_col]
        stored = None if self.stored is None else self.stored.filter(F.col(self.id_col).isin(ids or [None]))
        out = order.join(stored.select(F.col(self.id_col).alias("doc_id"), *wanted), "doc_id", "left") if wanted else order
        response = Response(out.orderBy("k").drop("k"))
        if not O.enabled(params):
            return response
        o = O.resolve(params, self.name)
        q = self.parse(str(params.get("hl.ocr.q", params.get("hl.q", params["q"]))), params, params.get("hl.ocr.qparser", params.get("hl.qparser")))
        if stored is not None:
            asked = O.fields(str(params.get("hl.fl", "")), [c for c in stored.columns if c != self.id_col])
            terms = [t for leaf in Q.leaves(q) for t in (leaf.terms if isinstance(leaf, Q.Phrase) else (leaf.text,)) if t]
            response.plain = {c: S.sentences(stored, terms, c, self.id_col, o, scored=True) for c in O.regular_fields(asked, [self.name])}
        # The limit of the request and that of its highlighting: whichever ends first.
        limits = [float(v) for v in (params.get("timeAllowed"), o.time_allowed_ms) if v is not None and float(v) >= 0]
        done = [] if limits else self.highlight(ids, q, o)
        for k in range(0, len(ids), batch) if limits else ():
            got = self._until(began + min(limits) / 1000, lambda k=k: self.highlight(ids[k : k + batch], q, o))
            if got is None:
                response.partial = True
                break
            done += got
        response.highlighting = spark.createDataFrame(done, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, response STRING")
        return response

    def _until(self, end: float, work: Callable[[], list]) -> list | None:
        """What ``work`` collects, or None if it isn't done at ``end``; its jobs are interrupted then."""
        left = end - self.clock()
        if left <= 0:
            return None
        context, tag, late = self.index.boxes.sparkSession.sparkContext, f"highlight-{uuid.uuid4().hex}", threading.Event()

        def stop() -> None:
            late.set()
            context.cancelJobsWithTag(tag)

        timer = threading.Timer(left, stop)
        context.addJobTag(tag)
        timer.start()
        try:
            out = work()
            return None if late.is_set() else out
        except Exception:
            if late.is_set():
                return None
            raise
        finally:
            timer.cancel()
            context.removeJobTag(tag)


def register(spark, name: str = "ocr_words") -> None:
    """A table function for SQL: ``SELECT * FROM docs, LATERAL ocr_words(markup)`` has a row for each word."""
    from pagelens.functions import markup as M

    formats = tuple(M.FORMATS)

    class Words:
        def eval(self, markup: str):
            if markup is not None:
                boxes, pages = M.parse(markup, formats=formats)
                for i, b in enumerate(boxes):
                    page = pages[b.page_idx].id if 0 <= b.page_idx < len(pages) else None
                    yield i, b.text, b.text_off, b.ulx, b.uly, b.lrx, b.lry, page

    spark.udtf.register(name, F.udtf(Words, returnType="box_seq INT, text STRING, text_off BIGINT, ulx FLOAT, uly FLOAT, lrx FLOAT, lry FLOAT, page_id STRING"))
