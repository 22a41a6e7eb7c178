"""Results for consumers: nested responses, annotation lists, manifests, crop addresses, rendered markup."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelens.options import HighlightOptions


def coordinate(c: Column) -> Column:
    """A value of at least 1, or 0, is written as a truncated whole number; any other as it is."""
    return F.when((c >= 1) | (c == 0), c.cast("int").cast("string")).otherwise(c.cast("string"))


def responses(texts: DataFrame, regions: DataFrame, highlights: DataFrame, totals: DataFrame, field: str = "ocr_text", options: HighlightOptions | None = None) -> DataFrame:
    """(doc_id, response): JSON {field: {snippets: [...], numTotal: n}}; documents without snippets have no row."""
    o = options or HighlightOptions()
    key = ["doc_id", "rank"]
    r = regions.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("region", "page_id", "ulx", "uly", "lrx", "lry", "text"))).alias("rs"))
    pages = F.array_distinct(F.transform("rs", lambda x: x["page_id"]))
    r = r.select(*key, pages.alias("page_ids"), F.transform("rs", lambda x: F.struct(x["ulx"].alias("ulx"), x["uly"].alias("uly"), x["lrx"].alias("lrx"), x["lry"].alias("lry"), x["text"].alias("text"), (F.array_position(pages, x["page_id"]) - 1).cast("int").alias("pageIdx"))).alias("regions"))
    h = highlights.groupBy(*key, "span_id").agg(F.array_sort(F.collect_list(F.struct("line", "ulx", "uly", "lrx", "lry", "text", F.col("region").alias("parentRegionIdx")))).alias("hs"))
    h = h.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("span_id", "hs"))).alias("spans"))
    box = lambda x: F.struct(*[x[c].alias(c) for c in ("ulx", "uly", "lrx", "lry", "text", "parentRegionIdx")])
    h = h.select(*key, F.transform("spans", lambda s: F.transform(s["hs"], box)).alias("highlights"))
    x = texts.join(r, key).join(h, key, "left")
    parts = [F.col("text"), F.col("score").cast("float").alias("score")]
    if o.track_pages:
        parts.append(F.transform("page_ids", lambda p: F.struct(p.alias("id"))).alias("pages"))
    snippet = F.struct(*parts, "regions", F.col("highlights"))
    by_doc = x.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", snippet.alias("s")))), lambda y: y["s"]).alias("snippets")).join(totals, "doc_id")
    return by_doc.select("doc_id", F.to_json(F.struct(F.struct("snippets", F.col("num_total").alias("numTotal")).alias(field))).alias("response"))


def crop_url(base: Column, page_id: Column, ulx: Column, uly: Column, lrx: Column, lry: Column, width: int | None = None) -> Column:
    """The address of an image region of a page."""
    size = "full" if width is None else f"{width},"
    return F.format_string(f"%s/%s/%d,%d,%d,%d/{size}/0/default.jpg", base, page_id, ulx.cast("int"), uly.cast("int"), (lrx - ulx).cast("int"), (lry - uly).cast("int"))


def merge_fragments(value: Column, fragments: Column, pre: str = "<em>", post: str = "</em>") -> Column:
    """A stored value with its highlighted fragments put back in: each one replaces its own plain text."""
    plain = lambda f: F.replace(F.replace(f, F.lit(pre), F.lit("")), F.lit(post), F.lit(""))
    return F.aggregate(fragments, value, lambda v, f: F.replace(v, plain(f), f))


def annotations(texts: DataFrame, highlights: DataFrame, regions: DataFrame, unit_factor: float | None = None, options: HighlightOptions | None = None) -> DataFrame:
    """(doc_id, rank, span_id, line, page_id, xywh, chars, before, match, after): one annotation for each absolute highlight.

    The n-th span of a snippet is its n-th tagged text; what is before and after it has no tags.
    """
    o = options or HighlightOptions()
    k = unit_factor or 1.0
    number = highlights.select("doc_id", "rank", "span_id").distinct().withColumn("hit", F.row_number().over(Window.partitionBy("doc_id", "rank").orderBy("span_id")))
    x = highlights.withColumnRenamed("text", "chars").join(number, ["doc_id", "rank", "span_id"]).join(regions.select("doc_id", "rank", "region", "page_id"), ["doc_id", "rank", "region"]).join(texts.select("doc_id", "rank", F.col("text").alias("snippet")), ["doc_id", "rank"])
    n = lambda c: F.floor(c * k).cast("int")
    # Pieces that end with an opening tag: the first is before all hits, and piece i begins with hit i.
    pieces = F.split("snippet", re.escape(o.tag_pre))
    plain = lambda c: F.replace(c, F.lit(o.tag_post), F.lit(""))
    own = F.get(pieces, F.col("hit"))
    cut = F.instr(own, o.tag_post)
    match = F.when(cut > 0, F.substring(own, F.lit(1), cut - 1)).otherwise(own)
    rest = F.when(cut > 0, F.substring(own, cut + len(o.tag_post), F.length(own))).otherwise(F.lit(""))
    before = plain(F.array_join(F.slice(pieces, 1, F.col("hit")), ""))
    after = plain(F.concat(rest, F.array_join(F.slice(pieces, F.col("hit") + 2, F.greatest(F.size(pieces) - F.col("hit") - 1, F.lit(0))), "")))
    xywh = F.concat_ws(",", n(F.col("ulx")), n(F.col("uly")), n(F.col("lrx") - F.col("ulx")), n(F.col("lry") - F.col("uly")))
    return x.select("doc_id", "rank", "span_id", "line", "page_id", xywh.alias("xywh"), "chars", before.alias("before"), match.alias("match"), after.alias("after"))


def manifests(boxes: DataFrame, base: str = "https://example.org", metadata: DataFrame | None = None) -> DataFrame:
    """(doc_id, manifest): JSON with the pages of each document in order, and its metadata.

    A page has the size that the markup gives it, or else that of its words. ``metadata`` is (doc_id, metadata: map).
    """
    size = lambda c, d: F.coalesce(F.max(c), F.max(d).cast("int")) if c in boxes.columns else F.max(d).cast("int")
    pages = boxes.groupBy("doc_id", "page_idx").agg(F.first("page_id").alias("page_id"), size("page_width", "lrx").alias("width"), size("page_height", "lry").alias("height"))
    canvas = F.struct(F.format_string(f"{base}/%s/canvas/%s", F.col("doc_id").cast("string"), F.col("page_id")).alias("id"), F.col("page_id").alias("label"), "width", "height")
    listed = pages.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("page_idx", canvas.alias("c")))), lambda x: x["c"]).alias("canvases"))
    more = []
    if metadata is not None:
        listed, more = listed.join(metadata.select("doc_id", "metadata"), "doc_id", "left"), ["metadata"]
    return listed.select("doc_id", F.to_json(F.struct(F.format_string(f"{base}/%s/manifest", F.col("doc_id").cast("string")).alias("id"), *more, "canvases")).alias("manifest"))


def manifests(boxes: DataFrame, base: str = "https://example.org") -> DataFrame:
    """(doc_id, manifest): JSON with the pages of each document in order."""
    pages = boxes.groupBy("doc_id", "page_idx").agg(F.first("page_id").alias("page_id"), F.max("lrx").cast("int").alias("width"), F.max("lry").cast("int").alias("height"))
    canvas = F.struct(F.format_string(f"{base}/%s/canvas/%s", F.col("doc_id").cast("string"), F.col("page_id")).alias("id"), F.col("page_id").alias("label"), "width", "height")
    listed = pages.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("page_idx", canvas.alias("c")))), lambda x: x["c"]).alias("canvases"))
    return listed.select("doc_id", F.to_json(F.struct(F.format_string(f"{base}/%s/manifest", F.col("doc_id").cast("string")).alias("id"), "canvases")).alias("manifest"))


def to_miniocr(boxes: DataFrame, relative: bool = False) -> DataFrame:
    """(doc_id, markup): boxes of any format written as MiniOCR, in document order.

    ``relative`` writes coordinates as shares of the page's size, for formats whose unit isn't the pixel; pages without
    a size keep theirs.
    """
    if relative:
        share = lambda c, size: F.coalesce((F.round(F.col(c) / F.col(size), 4)).cast("float"), F.col(c)).alias(c)
        boxes = boxes.withColumns({c: share(c, "page_width" if c.endswith("x") else "page_height") for c in ("ulx", "uly", "lrx", "lry")})
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    word = F.concat(F.lit('<w x="'), F.concat_ws(" ", coordinate(F.col("ulx")), coordinate(F.col("uly")), coordinate(F.col("lrx") - F.col("ulx")), coordinate(F.col("lry") - F.col("uly"))), F.lit('">'), esc(F.col("text")), F.lit("</w>"), esc(F.coalesce("trailing", F.lit(""))))
    ordered = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", c.alias("s")))), lambda x: x["s"]), "")
    lines = boxes.groupBy("doc_id", "page_idx", "page_id", "block_seq", F.col("line_seq").alias("line")).agg(F.concat(F.lit("<l>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("box_seq", word.alias("s")))), lambda x: x["s"]), ""), F.lit("</l>")).alias("s"))
    blocks = lines.withColumn("k", F.col("line")).groupBy("doc_id", "page_idx", "page_id", "block_seq").agg(F.concat(F.lit("<b>"), ordered(F.col("s")), F.lit("</b>")).alias("s"))
    pages = blocks.withColumn("k", F.col("block_seq")).groupBy("doc_id", "page_idx", "page_id").agg(F.concat(F.lit('<p xml:id="'), F.coalesce("page_id", F.lit("")), F.lit('">'), ordered(F.col("s")), F.lit("</p>")).alias("s"))
    return pages.withColumn("k", F.col("page_idx")).groupBy("doc_id").agg(F.concat(F.lit("<ocr>"), ordered(F.col("s")), F.lit("</ocr>")).alias("markup"))


def difference(a: DataFrame, b: DataFrame, key: list[str], text_col: str = "text") -> DataFrame:
    """Snippets of ``a`` whose text is not in ``b``, by hash: what changed but scores."""
    h = lambda d: d.select(*key, F.sha2(text_col, 256).alias("hash"))
    return h(a).exceptAll(h(b))
