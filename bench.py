"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

A positional index is built once (its time is reported), then phrases of the corpus are searched: the 50 most relevant
documents, five snippets each, whole phrases as spans. Searches are means of three runs after a first one; how much of
their time is highlighting, and how long it takes to find the documents, is reported too. Parsing and building run once.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from pagelens.highlighter import Highlighter, snippets
    from pagelens.operators import boxes as B
    from pagelens.operators import index as I
    from pagelens.operators import query as Q
    from pagelens.operators import snippets as S
    from pagelens.options import HighlightOptions
    from pagelens.plans import cases, catalog, layout  # noqa: F401  (cases adds to the catalogue)

    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    tmp = tempfile.mkdtemp(prefix="bench-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"{tmp}/shared").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def timed(name: str, run, repeat: int = 3, warm: bool = True) -> None:
        if warm:
            run()
        began = time.time()
        for _ in range(repeat):
            run()
        times[name] = round((time.time() - began) / repeat, 3)

    noop = lambda df: df.write.format("noop").mode("overwrite").save()
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    layout.miniocr(docs).repartition(int(cpus)).write.parquet(f"{tmp}/markup")
    markup = spark.read.parquet(f"{tmp}/markup")
    timed("parse_miniocr", lambda: noop(B.boxes(markup)), 1, False)
    opened = []
    timed("build_index", lambda: opened.append(I.build(layout.boxes(docs), f"{tmp}/index")), 1, False)
    index = opened[0]
    api = Highlighter(index)
    bench = spark.read.parquet(f"{d}/benchmark.parquet")
    phrases = [" ".join(r[0].lower().replace(".", " ").replace(",", " ").split()[k : k + n]) for n, r in zip((2, 3, 4, 5, 8), bench.orderBy("item_id").select("text").take(5)) for k in (3,)]
    o = HighlightOptions(snippets=5, norm="none", weight_matches=True)
    found: dict[str, float] = {}

    def search(name: str, text: str, repeat: int = 3) -> None:
        """The 50 most relevant documents, then their snippets; the first run isn't counted."""
        each = []
        for _ in range(repeat + 1):
            began = time.time()
            ids = [r["doc_id"] for r in api.find({"q": text, "rows": 50}).collect()]
            first = time.time() - began
            few, q = F.col("doc_id").isin(ids or [None]), api.parse(text, {})
            w, _ = snippets(Q.matches(index.postings.filter(few), q, weight_matches=True, terms=index.terms), index.units.filter(few), index.boxes.filter(few), o)
            noop(S.texts(w))
            each.append((time.time() - began, first))
        times[name] = round(sum(x for x, _ in each[1:]) / repeat, 3)
        found[name] = round(sum(x for _, x in each[1:]) / repeat, 3)

    for i, p in enumerate([*phrases, "of the"]):
        search(f"phrase_{i}", f'"{p}"')
    search("term", "with")
    search("sloppy", '"of the"~3')
    search("prefix", "thon*")
    search("fuzzy", "thing~1")
    timed("response_json", lambda: api.search({"q": '"of the"', "rows": 10, "hl": "on", "hl.snippets": 5, "hl.weightMatches": "on"}).json(), 1)
    timed("doc_bm25_topk", lambda: noop(Q.bm25(index.postings, ["with", "of"], lengths=index.lengths).orderBy(F.col("score").desc(), "doc_id").limit(10)), 3)
    timed("term_postings", lambda: noop(index.postings.filter("term = 'with'")), 3)
    one = HighlightOptions(snippets=2, norm="none")
    timed("snippet_regions", lambda: noop(S.regions(snippets(Q.matches(index.postings, Q.parse("on")), index.units, index.boxes, one)[0], one)), 1)
    for name in ("ngram_miner", "format_detect", "rel_join_agg", "rel_window_topk"):
        timed(name, lambda name=name: noop(catalog.QUERIES[name](spark, d)), 1)
    highlight = sum(times[k] - found[k] for k in found) / sum(times[k] for k in found)
    print(json.dumps({"metric": "headline_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "highlight_share": round(highlight, 3), "seconds_to_find": found, "sf": float(os.path.basename(d.rstrip("/")).removeprefix("sf") or 0) if os.path.basename(d.rstrip("/")).startswith("sf") else 0}))


if __name__ == "__main__":
    main()
