"""Passages to snippets: text with tags, pages, regions, and highlight rectangles."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelens.operators.passages import score
from pagelens.options import HighlightOptions


def spans(matches: DataFrame) -> DataFrame:
    """(doc_id, span_id, s, e, first, last): matches that overlap or touch, put together; first and last are boxes."""
    w = Window.partitionBy("doc_id").orderBy("start_off", "end_off")
    before = F.max("end_off").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce((F.col("start_off") > before).cast("int"), F.lit(1))
    x = matches.select("doc_id", "start_off", "end_off", "start_box", "end_box").withColumn("new", new).withColumn("span_id", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    return x.groupBy("doc_id", "span_id").agg(F.min("start_off").alias("s"), F.max("end_off").alias("e"), F.min("start_box").alias("first"), F.max("end_box").alias("last"))


def words(passages: DataFrame, boxes: DataFrame, spans: DataFrame, options: HighlightOptions) -> DataFrame:
    """The boxes of each passage with the highlight spans in each.

    ``marked`` is the text with tags: a tag opens in the word where a span begins and closes where it ends; with
    ``align_spans`` at the edges of the words. A span that ends in the first part of a hyphenated word goes on to the
    second part, and a passage that ends there takes the second part in. Spans know their boxes and meet the words of
    the passages on (document, box).
    """
    cols = boxes.columns
    hyphen = "hyphen_start" in cols
    bounds = passages.select("doc_id", "rank", "score", "p_start", "p_end", "p_first", "p_last")
    inside = bounds.join(boxes, "doc_id").filter(F.col("box_seq").between(F.col("p_first"), F.col("p_last") + (1 if hyphen else 0)))
    order = Window.partitionBy("doc_id", "rank").orderBy("box_seq")
    if hyphen:
        inside = inside.withColumn("prev_start", F.coalesce(F.lag("hyphen_start").over(order) & (F.col("hyphen_start") == F.lit(False)), F.lit(False)))
        inside = inside.filter((F.col("box_seq") <= F.col("p_last")) | F.col("prev_start"))
    else:
        inside = inside.withColumn("hyphen_start", F.lit(None).cast("boolean")).withColumn("dehyphenated", F.lit(None).cast("string")).withColumn("prev_start", F.lit(False))
    end = F.col("text_off") + F.col("src_len")
    # The offsets of a hyphenated word count its joined form from the first part on.
    joined = F.coalesce(F.col("hyphen_start"), F.lit(False)) & (F.col("e") <= F.col("text_off") + F.octet_length("dehyphenated"))
    each = spans.select("doc_id", "span_id", "s", "e", F.explode(F.sequence("first", "last")).alias("box_seq"))
    hits = inside.select("doc_id", "rank", "box_seq", "text_off", "hyphen_start", "dehyphenated", end.alias("end")).join(each, ["doc_id", "box_seq"]).filter((F.col("s") < F.col("end")) & (F.col("e") > F.col("text_off")))
    # Tags go in from the right, so earlier places stay valid.
    lo, hi = F.greatest(F.col("s"), F.col("text_off")) - F.col("text_off"), F.least(F.col("e"), F.col("end")) - F.col("text_off")
    tags = hits.groupBy("doc_id", "rank", "box_seq").agg(F.array_sort(F.collect_list(F.struct((-lo).alias("k"), lo.alias("lo"), hi.alias("hi"), (F.col("s") >= F.col("text_off")).alias("opens"), ((F.col("e") <= F.col("end")) | F.coalesce(joined, F.lit(False))).alias("closes"), "span_id"))).alias("tags"))
    x = inside.join(tags, ["doc_id", "rank", "box_seq"], "left")
    pre, post = F.lit(options.tag_pre), F.lit(options.tag_post)
    if options.align_spans:
        first, last = F.element_at("tags", -1), F.element_at("tags", 1)
        marked = F.when(F.col("tags").isNull(), F.col("text")).otherwise(F.concat(F.when(first["opens"], pre).otherwise(""), F.col("text"), F.when(last["closes"], post).otherwise("")))
    else:
        raw = F.encode("text", "utf-8")
        cut = lambda a, z: F.decode(F.substring(F.col("_raw"), (a + 1).cast("int"), F.greatest(z - a, F.lit(0)).cast("int")), "utf-8")
        size = F.octet_length(F.col("_raw")).cast("long")
        x = x.withColumn("_raw", raw)
        step = F.aggregate("tags", F.struct(F.lit("").alias("out"), size.alias("at")), lambda acc, t: F.struct(
            F.concat(F.when(t["opens"], pre).otherwise(""), cut(t["lo"], F.least(t["hi"], size)), F.when(t["closes"], post).otherwise(""), cut(F.least(t["hi"], size), acc["at"]), acc["out"]).alias("out"), t["lo"].cast("long").alias("at")))
        marked = F.when(F.col("tags").isNull(), F.col("text")).otherwise(F.concat(cut(F.lit(0).cast("long"), step["at"]), step["out"]))
        x = x.withColumn("marked", marked).drop("_raw")
    if options.align_spans:
        x = x.withColumn("marked", marked)
    x = x.withColumn("span_id", F.element_at("tags", 1)["span_id"])
    return x.withColumn("span_id", F.coalesce("span_id", F.when(F.col("prev_start"), F.lag("span_id").over(order)))).drop("tags")


def _text(items: Column) -> Column:
    """Marked words in order to text; a whole hyphenation once, a first part alone with a hyphen."""
    def piece(x: Column, i: Column) -> Column:
        nxt = F.get(items, i + 1)
        whole = x["hyphen_start"] & nxt.isNotNull() & (nxt["hyphen_start"] == F.lit(False))
        second = (x["hyphen_start"] == F.lit(False)) & (i > 0) & F.get(items, i - 1)["hyphen_start"]
        tag = F.when(x["marked"] != x["text"], F.replace(x["marked"], x["text"], x["dehyphenated"])).otherwise(x["dehyphenated"])
        body = F.when(F.coalesce(whole, F.lit(False)), tag).when(F.coalesce(second, F.lit(False)), F.lit("")).when(F.coalesce(x["hyphen_start"], F.lit(False)), F.concat(F.rtrim(x["marked"]), F.when(x["marked"].endswith("-"), "").otherwise("-"))).otherwise(x["marked"])
        return F.concat(body, F.coalesce(x["trailing"], F.lit("")))

    return F.trim(F.array_join(F.transform(items, piece), ""))


def _items() -> Column:
    return F.array_sort(F.collect_list(F.struct("box_seq", "marked", "text", "trailing", "hyphen_start", "dehyphenated")))


def regions_of(words: DataFrame) -> DataFrame:
    """``words`` with ``region``: a new one where a word is far above the last tall word (a new column) or on a new page."""
    w = Window.partitionBy("doc_id", "rank").orderBy("box_seq")
    prev = F.last(F.when(F.col("lry") - F.col("uly") > 5, F.struct("uly", (F.col("lry") - F.col("uly")).alias("h"))), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    column = F.coalesce(F.col("uly") + prev["h"] * 5 < prev["uly"], F.lit(False))
    page = F.coalesce(F.lag("page_idx").over(w) != F.col("page_idx"), F.lit(False))
    return words.withColumn("brk", (column | page).cast("int")).withColumn("region", F.sum("brk").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("brk")


def regions(words: DataFrame, options: HighlightOptions) -> DataFrame:
    """(doc_id, rank, region, page_idx, page_id, ulx, uly, lrx, lry, text); blank regions are dropped, tags are closed at region edges."""
    g = regions_of(words).groupBy("doc_id", "rank", "region").agg(F.min("page_idx").alias("page_idx"), F.min_by("page_id", "box_seq").alias("page_id"), F.min("ulx").alias("ulx"), F.min("uly").alias("uly"), F.max("lrx").alias("lrx"), F.max("lry").alias("lry"), _items().alias("items"))
    text = _text(F.col("items"))
    opened = F.instr(text, options.tag_pre)
    closed = F.instr(text, options.tag_post)
    count = lambda t: (F.length(text) - F.length(F.replace(text, F.lit(t), F.lit("")))) / len(t)
    before = F.when((closed > 0) & ((opened == 0) | (closed < opened)), options.tag_pre).otherwise("")
    after = F.when(count(options.tag_pre) + (before != "").cast("int") > count(options.tag_post), options.tag_post).otherwise("")
    return g.select("doc_id", "rank", "region", "page_idx", "page_id", "ulx", "uly", "lrx", "lry", F.concat(before, text, after).alias("text")).filter(F.trim("text") != "")


def texts(words: DataFrame) -> DataFrame:
    """(doc_id, rank, score, text)."""
    return words.groupBy("doc_id", "rank").agg(F.first("score").alias("score"), _items().alias("items")).select("doc_id", "rank", "score", _text(F.col("items")).alias("text"))


def highlights(words: DataFrame, regions: DataFrame, options: HighlightOptions) -> DataFrame:
    """(doc_id, rank, span_id, box_seq, region, ulx, uly, lrx, lry, text): a rectangle for each highlighted word.

    The region is the first that contains the word (a containment join within the snippet). Coordinates are relative
    to it, as a share of its size where the document has relative units, unless ``absolute_highlights``.
    """
    hl = words.filter(F.col("span_id").isNotNull()).select("doc_id", "rank", "span_id", "box_seq", "page_idx", *(F.col(c).alias(f"w_{c}") for c in ("ulx", "uly", "lrx", "lry")), F.col("text"))
    r = regions.drop("text", "page_id").withColumnRenamed("page_idx", "r_page")
    inside = (F.col("w_ulx") >= F.col("ulx")) & (F.col("w_uly") >= F.col("uly")) & (F.col("w_lrx") <= F.col("lrx")) & (F.col("w_lry") <= F.col("lry")) & F.col("page_idx").eqNullSafe(F.col("r_page"))
    x = hl.join(r, ["doc_id", "rank"]).filter(inside)
    w = Window.partitionBy("doc_id", "rank", "span_id", "box_seq").orderBy("region")
    x = x.withColumn("n", F.row_number().over(w)).filter("n = 1")
    if options.absolute_highlights:
        return x.select("doc_id", "rank", "span_id", "box_seq", "region", *(F.col(f"w_{c}").alias(c) for c in ("ulx", "uly", "lrx", "lry")), "text")
    unit = ((F.col("w_ulx") > 0) & (F.col("w_ulx") < 1)) | ((F.col("w_uly") > 0) & (F.col("w_uly") < 1))

    def relative(c: str) -> Column:
        o, size = (F.col("ulx"), F.col("lrx") - F.col("ulx")) if c.endswith("x") else (F.col("uly"), F.col("lry") - F.col("uly"))
        d = F.col(f"w_{c}") - o
        return F.when(unit, F.floor(d / size * 10000) / 10000).otherwise(d).cast("float").alias(c)

    return x.select("doc_id", "rank", "span_id", "box_seq", "region", *(relative(c) for c in ("ulx", "uly", "lrx", "lry")), "text")


def merged_lines(highlights: DataFrame, regions: DataFrame) -> DataFrame:
    """(doc_id, rank, span_id, line, region, ulx, uly, lrx, lry, text): neighbours of a span on one line as one rectangle.

    The comparison is with the rectangle so far, whose top can move, so it is a fold over the words of a span.
    """
    r = regions.select("doc_id", "rank", "region", F.col("uly").alias("r_uly"), "page_idx")
    x = highlights.join(r, ["doc_id", "rank", "region"])
    listed = x.groupBy("doc_id", "rank", "span_id").agg(F.array_sort(F.collect_list(F.struct("box_seq", "region", "r_uly", "page_idx", "ulx", "uly", "lrx", "lry", "text"))).alias("bs"))
    kind = "array<struct<region:int,r_uly:float,page_idx:int,ulx:float,uly:float,lrx:float,lry:float,text:string>>"

    def box(b: Column) -> Column:
        return F.struct(*[b[c].alias(c) for c in ("region", "r_uly", "page_idx", "ulx", "uly", "lrx", "lry", "text")])

    def step(acc: Column, b: Column) -> Column:
        cur = F.element_at(acc, -1)
        far = F.abs((b["r_uly"] + b["uly"]) - (cur["r_uly"] + cur["uly"])) > 0.75 * (cur["lry"] - cur["uly"])
        new = far | ~b["page_idx"].eqNullSafe(cur["page_idx"])
        one = F.struct(cur["region"].alias("region"), cur["r_uly"].alias("r_uly"), cur["page_idx"].alias("page_idx"), cur["ulx"].alias("ulx"), F.least(cur["uly"], b["uly"]).alias("uly"), F.greatest(cur["lrx"], b["lrx"]).alias("lrx"), F.greatest(cur["lry"], b["lry"]).alias("lry"), F.concat(cur["text"], F.lit(" "), b["text"]).alias("text"))
        return F.when((F.size(acc) == 0) | new, F.concat(acc, F.array(box(b)))).otherwise(F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(one)))

    folded = listed.withColumn("ls", F.aggregate("bs", F.array().cast(kind), step))
    return folded.select("doc_id", "rank", "span_id", F.posexplode("ls").alias("line", "l")).select("doc_id", "rank", "span_id", "line", "l.region", "l.ulx", "l.uly", "l.lrx", "l.lry", "l.text")


def sentences(docs: DataFrame, terms: list[str], text_col: str = "text", id_col: str = "doc_id", options: HighlightOptions | None = None, scored: bool = False) -> DataFrame:
    """Plain text: (doc_id, sentence_no, text) of the sentences with a term, its occurrences tagged.

    With ``scored`` they go through the same scores as passages of a layout, and (doc_id, rank, score, text) are the
    best of each document, every sentence a passage. No terms: no sentences.
    """
    o = options or HighlightOptions()
    parts = F.filter(F.split(F.col(text_col), r"[.!?]+"), lambda s: F.trim(s) != "")
    each = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text_col).alias("content"), F.posexplode(parts).alias("sentence_no", "s"))
    word = rf"(?<![\p{{L}}\p{{N}}])({'|'.join(map(re.escape, sorted(terms, key=len, reverse=True))) or '(?!)'})(?![\p{{L}}\p{{N}}])"
    pre, post = (t.replace("\\", "\\\\").replace("$", "\\$") for t in (o.tag_pre, o.tag_post))
    hit = each.filter(F.lower("s").rlike(word)).withColumn("text", F.trim(F.regexp_replace("s", f"(?iu){word}", f"{pre}$1{post}")))
    if not scored:
        return hit.select("doc_id", "sentence_no", "text")
    one = hit.select("doc_id", "sentence_no", "content", F.octet_length("s").alias("size"), F.explode(F.regexp_extract_all(F.lower("s"), F.lit(word), 1)).alias("term"))
    f = one.groupBy("doc_id", "sentence_no", "term").agg(F.count("*").alias("f"), F.first("size").alias("size"), F.first("content").alias("content"))
    f = f.withColumn("tf", F.sum("f").over(Window.partitionBy("doc_id", "term")))
    s = f.groupBy("doc_id", "sentence_no").agg(F.sum(score(F.col("f"), F.col("tf"), F.col("content"), F.col("size"), o)).alias("score"))
    w = Window.partitionBy("doc_id").orderBy(F.col("score").desc(), "sentence_no")
    best = s.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= o.snippets)
    return best.join(hit, ["doc_id", "sentence_no"]).select("doc_id", "rank", "score", "text")
