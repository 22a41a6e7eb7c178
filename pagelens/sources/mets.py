"""METS files of newspaper issues: articles with their metadata, and pointers to the regions of their blocks.

An article is a division of the logical structure with areas: blocks of page files. Its text is where these blocks are in
the files, so a document is a source pointer with byte regions, in the order of files; within a file regions go by start.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NS = {"mets": "http://www.loc.gov/METS/", "mods": "http://www.loc.gov/mods/v3"}
_HREF = "{http://www.w3.org/1999/xlink}href"
_FIELDS = ("issue_id", "article_id", "title", "author", "date", "newspaper_title", "newspaper_part", "error")


def parse(issue_id: str, mets: str) -> list[dict]:
    """The articles of an issue, each with its areas: (block id, path of the page file), in document order."""
    tree = ET.fromstring(mets)
    files = {f.get("ID"): next(iter(f)).get(_HREF, "").removeprefix("file://").removeprefix("./") for f in tree.iterfind(".//mets:fileGrp[@USE='Text']/mets:file", _NS)}
    issue = tree.find(".//mets:dmdSec[@ID='MODSMD_PRINT']//mods:titleInfo", _NS)
    sections = {s.get("ID"): s for s in tree.iterfind(".//mets:dmdSec", _NS)}
    date = tree.findtext(".//mods:dateIssued", None, _NS)
    find = lambda e, path: e.findtext(path, None, _NS) if e is not None else None
    out = []
    for division in tree.iterfind(".//mets:structMap[@TYPE='LOGICAL']//mets:div[@TYPE='ARTICLE']", _NS):
        name = division.get("DMDID") or ""
        mods = sections[name].find(".//mods:mods", _NS) if name in sections else None
        areas = [(a.get("BEGIN"), files.get(a.get("FILEID"))) for a in division.iterfind(".//mets:fptr//mets:area", _NS)]
        out.append({
            "issue_id": issue_id, "article_id": f"{issue_id}-{name.replace('MODSMD_ARTICLE', '')}", "title": find(mods, ".//mods:titleInfo/mods:title"), "author": find(mods, ".//mods:name/mods:namePart"),
            "date": f"{date}T00:00:00Z" if date else None, "newspaper_title": find(issue, "./mods:title"), "newspaper_part": find(issue, "./mods:partNumber"), "error": None,
            "areas": [{"block": b, "path": p} for b, p in areas if b and p],
        })
    return out


def articles(issues: DataFrame, id_col: str = "issue_id", mets_col: str = "mets") -> DataFrame:
    """(issue_id, article_id, title, author, date, newspaper_title, newspaper_part, error, areas).

    An issue that can't be read has one row with its error, and no areas; a null issue has none.
    """
    schema = pa.schema([*((f, pa.string()) for f in _FIELDS), ("areas", pa.list_(pa.struct([("block", pa.string()), ("path", pa.string())])))])

    def run(batches):
        for b in batches:
            rows = []
            for i, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    rows += parse(i, m) if m is not None else []
                except ET.ParseError as e:
                    rows.append(dict.fromkeys(_FIELDS) | {"issue_id": i, "error": str(e), "areas": []})
            yield pa.RecordBatch.from_pylist(rows, schema)

    src = issues.select(F.col(id_col).cast("string"), F.col(mets_col).cast("string"))
    return src.mapInArrow(run, ", ".join(f"{f} STRING" for f in _FIELDS) + ", areas ARRAY<STRUCT<block: STRING, path: STRING>>")


def regions(page: bytes, blocks: list[str]) -> dict[str, tuple[int, int]]:
    """Where elements with the given ids begin and end (behind their end tag) in a page file."""
    out, wanted = {}, set(blocks)
    for m in re.finditer(rb'<([A-Za-z]+)\s[^<>]*?\bID="([^"]+)"', page):
        name = m[2].decode("utf-8", "replace")
        if name in wanted:
            end = page.find(b"</" + m[1] + b">", m.end())
            if end >= 0:
                out[name] = m.start(), end + len(m[1]) + 3
    return out


def pointers(articles: DataFrame, pages: DataFrame, path_col: str = "path", content_col: str = "content", prefix: str = "") -> DataFrame:
    """(article_id, pointer, missing): the source pointer of each article, and how many of its blocks weren't found.

    Every page file is looked through once, for the blocks of all articles on it.
    """
    a = articles.select("article_id", F.posexplode("areas").alias("n", "a")).select("article_id", "n", "a.block", "a.path")
    wanted = a.groupBy("path").agg(F.collect_set("block").alias("blocks"))
    found = pages.select(F.col(path_col).alias("path"), F.col(content_col).alias("content")).join(wanted, "path")

    def locate(batches):
        for b in batches:
            for path, content, blocks in zip(*(b.column(i).to_pylist() for i in range(3))):
                r = regions(content, blocks) if content is not None else {}
                yield pa.RecordBatch.from_pydict({"path": pa.array([path] * len(r), pa.string()), "block": pa.array(list(r), pa.string()), "s": pa.array([x for x, _ in r.values()], pa.int64()), "e": pa.array([y for _, y in r.values()], pa.int64())})

    at = found.select("path", "content", "blocks").mapInArrow(locate, "path STRING, block STRING, s LONG, e LONG")
    each = a.join(at, ["path", "block"], "left")
    part = F.array_join(F.transform(F.array_sort(F.collect_set(F.when(F.col("s").isNotNull(), F.struct("s", "e")))), lambda r: F.concat_ws(":", r["s"].cast("string"), r["e"].cast("string"))), ",")
    files = each.groupBy("article_id", "path").agg(F.min("n").alias("n"), part.alias("r"), F.count_if(F.col("s").isNull()).alias("missing"))
    listed = files.groupBy("article_id").agg(F.array_sort(F.collect_list(F.when(F.col("r") != "", F.struct("n", F.concat(F.lit(prefix), "path", F.lit("["), "r", F.lit("]")).alias("p"))))).alias("ps"), F.sum("missing").alias("missing"))
    return listed.select("article_id", F.array_join(F.transform("ps", lambda p: p["p"]), "+").alias("pointer"), "missing")
