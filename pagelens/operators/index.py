"""The positional index: postings with positions and byte offsets, statistics of terms and documents, units of the layout.

``build`` writes all of it once: postings sorted by term, boxes and units sorted by document, the dictionary of terms and
the lengths of documents. A query then reads the row groups of its terms, and of the documents that it found.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelens.functions import analysis as A
from pagelens.functions import markup as M

#: Column of the ordinal of each level, from the finest to the coarsest.
SEQ = {"word": "box_seq", "line": "line_seq", "paragraph": "par_seq", "block": "block_seq", "section": "section_seq", "page": "page_idx"}


def place(columns: list[str]) -> Column:
    """Where a box is: its number and the ordinals of all levels above it. Places compare like boxes."""
    return F.struct(*[(F.col(c) if c in columns else F.lit(-1)).cast("int").alias(c) for c in SEQ.values()])


def postings(boxes: DataFrame, alternatives: bool = True, stop_words: list[str] | None = None, stemmed: bool = False) -> DataFrame:
    """(doc_id, term, pos, start_off, end_off, box_seq, place, is_alt).

    A word can hold several tokens; positions count tokens of the document. A complete hyphenation is one token at
    its first part. Stop words are removed after positions are given, so phrases keep their gaps.

    Alternatives have the position of the word they replace. A word that is split has none; of an alternative that is
    split only the beginning counts, and those after it don't. All forms of a word and the marks between them may
    have ``MAX_TOKEN`` characters; alternatives beyond are left out.

    Boxes with ``base``, the number of tokens before each, need no window, hence no shuffle.
    """
    cols = set(boxes.columns)
    text = F.col("text")
    src = boxes
    if "hyphen_start" in cols:
        src = src.filter(~((F.col("hyphen_start") == F.lit(False)) & F.col("dehyphenated").isNotNull()))
        text = F.when(F.col("hyphen_start"), F.coalesce("dehyphenated", "text")).otherwise(text)
    toks = F.regexp_extract_all(text, F.lit(f"({A.TOKEN})"))
    gaps = F.split(text, A.TOKEN, -1)
    before = Window.partitionBy("doc_id").orderBy("box_seq").rowsBetween(Window.unboundedPreceding, -1)
    # What is before token k of a word: gaps 0..k and tokens 0..k-1, in bytes.
    size = lambda a, n: F.aggregate(F.slice(a, 1, n), F.lit(0), lambda s, x: s + F.octet_length(x))
    placed = F.transform(toks, lambda t, k: F.struct(F.lower(t).alias("term"), k.alias("k"), (size(gaps, k + 1) + size(toks, k)).alias("at"), F.octet_length(t).alias("len")))
    src = src.select("doc_id", "box_seq", "text_off", place(boxes.columns).alias("place"), text.alias("form"), placed.alias("ts"), *(["base"] if "base" in cols else []), *(["alternatives"] if alternatives and "alternatives" in cols else []))
    src = src.withColumn("base", F.col("base") if "base" in cols else F.coalesce(F.sum(F.size("ts")).over(before), F.lit(0)))
    one = src.select("doc_id", "box_seq", "place", "text_off", "base", F.inline("ts"))
    out = one.select("doc_id", "term", (F.col("base") + F.col("k")).cast("int").alias("pos"), (F.col("text_off") + F.col("at")).alias("start_off"), (F.col("text_off") + F.col("at") + F.col("len")).alias("end_off"), "box_seq", "place", F.lit(False).alias("is_alt"))
    if alternatives and "alternatives" in cols:
        # The forms stand one after the other, each with two marks and its offset before it.
        alts = F.col("alternatives")
        upto = lambda i: F.slice(alts, 1, i + 1)
        room = lambda i: F.length("form") + F.aggregate(upto(i), F.lit(0), lambda n, y: n + 4 + F.length(y["off"].cast("string")) + F.length(y["text"]))
        whole = F.transform(alts, lambda x, i: F.struct(x["text"].alias("text"), x["off"].alias("off"), ((room(i) <= A.MAX_TOKEN) & F.forall(F.slice(alts, 1, i), lambda y: y["text"].rlike(f"^{A.TOKEN}$"))).alias("ok")))
        alt = src.filter((F.size(alts) > 0) & F.col("form").rlike(f"^{A.TOKEN}$")).select("doc_id", "box_seq", "place", "base", F.inline(whole))
        first = F.regexp_extract("text", f"^({A.TOKEN})", 1)
        alt = alt.filter(F.col("ok") & (first != ""))
        out = out.unionByName(alt.select("doc_id", F.lower(first).alias("term"), F.col("base").cast("int").alias("pos"), F.col("off").alias("start_off"), (F.col("off") + F.octet_length(first)).alias("end_off"), "box_seq", "place", F.lit(True).alias("is_alt")))
    if stop_words:
        out = out.filter(~F.col("term").isin(stop_words))
    if stemmed:
        out = out.withColumn("term", A.stem(F.col("term")))
    return out


def units(boxes: DataFrame, *levels: str) -> DataFrame:
    """(doc_id, level, first_only, content, ids, starts, ends, firsts, lasts, page_ids, in_line, ..., in_page): a row for each document and level.

    The arrays go through the units of the level in order: ordinal, offsets (a unit ends where the next begins), first
    and last box, the page's id, and the ordinals of the other levels at its first box. ``content`` is the length of the document.
    """
    cols = boxes.columns
    out = None
    end = F.col("text_off") + F.col("src_len") + 1
    page = F.col("page_id") if "page_id" in cols else F.lit(None).cast("string")
    only = F.col("format").isin([f.name for f in M.FORMATS if f.first_limit_only]) if "format" in cols else F.lit(False)
    for level in levels or [k for k, c in SEQ.items() if k != "word" and c in cols]:
        name = SEQ[level]
        src = boxes.select("doc_id", place(cols).alias("p"), F.col("text_off").alias("s"), end.alias("e"), F.coalesce(only, F.lit(False)).alias("o"), page.alias("g"))
        if level == "word":
            each = src.select("doc_id", "o", F.struct(F.col("p.box_seq").alias("unit"), "s", "e", F.col("p.box_seq").alias("l"), "p", "g").alias("u"))
        else:
            each = src.groupBy("doc_id", F.col(f"p.{name}").alias("unit")).agg(F.min("s").alias("s"), F.max("e").alias("e"), F.max("p.box_seq").alias("l"), F.min(F.struct("p", "g")).alias("x"), F.first("o").alias("o"))
            each = each.select("doc_id", "o", F.struct("unit", "s", "e", "l", F.col("x.p").alias("p"), F.col("x.g").alias("g")).alias("u"))
        one = each.groupBy("doc_id").agg(F.first("o").alias("first_only"), F.array_sort(F.collect_list("u")).alias("us"), F.max("u.e").alias("content"))
        ends = F.concat(F.slice("us.s", 2, F.greatest(F.size("us") - 1, F.lit(1))), F.array(F.element_at("us.e", -1)))
        ends = F.when(F.size("us") > 1, ends).otherwise(F.col("us.e"))
        one = one.select("doc_id", F.lit(level).alias("level"), "first_only", "content", F.col("us.unit").alias("ids"), F.col("us.s").alias("starts"), ends.alias("ends"), F.col("us.p.box_seq").alias("firsts"), F.col("us.l").alias("lasts"), F.col("us.g").alias("page_ids"), *[F.col(f"us.p.{c}").alias(f"in_{k}") for k, c in SEQ.items() if k != "word"])
        out = one if out is None else out.unionByName(one)
    return out


@dataclass(frozen=True)
class Index:
    """What ``build`` wrote."""

    postings: DataFrame
    boxes: DataFrame
    units: DataFrame
    terms: DataFrame
    lengths: DataFrame
    analysis: A.Analysis


def build(boxes: DataFrame, path: str, analysis: A.Analysis | None = None, partitions: int | None = None) -> Index:
    """Write the index of ``boxes`` to the folder ``path`` and open it."""
    analysis = analysis or A.Analysis()
    spark = boxes.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    boxes.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "box_seq").write.mode("overwrite").parquet(f"{path}/boxes")
    boxes = spark.read.parquet(f"{path}/boxes")
    write(postings(boxes, stop_words=list(analysis.stop_words), stemmed=analysis.stemmed), f"{path}/postings", n)
    p = read(spark, f"{path}/postings")
    units(boxes).repartitionByRange(n, "level", "doc_id").sortWithinPartitions("level", "doc_id").write.mode("overwrite").parquet(f"{path}/units")
    term_statistics(p).repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
    document_lengths(p).repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.mode("overwrite").parquet(f"{path}/lengths")
    return open_index(spark, path, analysis)


def open_index(spark: SparkSession, path: str, analysis: A.Analysis | None = None) -> Index:
    return Index(*(spark.read.parquet(f"{path}/{k}") for k in ("postings", "boxes", "units", "terms", "lengths")), analysis or A.Analysis())


def write(postings: DataFrame, path: str, partitions: int | None = None) -> None:
    """Parquet sorted by term, so that a scan for a term reads the row groups that have it."""
    n = partitions or int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    postings.repartitionByRange(n, "term", "doc_id").sortWithinPartitions("term", "doc_id", "pos").write.mode("overwrite").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def term_statistics(postings: DataFrame) -> DataFrame:
    """(term, df, tf): two levels, so that a frequent term is counted by document first."""
    return postings.groupBy("term", "doc_id").count().groupBy("term").agg(F.count("*").alias("df"), F.sum("count").alias("tf"))


def document_lengths(postings: DataFrame) -> DataFrame:
    return postings.filter(~F.col("is_alt")).groupBy("doc_id").agg(F.count("*").alias("n_tokens"))


def upsert(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """The latest row of each key; of equal versions the new one."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.col(version).desc(), F.col("_new").desc())
    return both.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", "_new")


def delete(docs: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return docs.join(gone.select(key), key, "left_anti")
