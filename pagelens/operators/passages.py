"""Matches to passages: context and limit blocks, merging, scores, the best of each document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelens.operators.index import SEQ
from pagelens.options import HighlightOptions


def preceding(units: DataFrame, level: str, offsets: DataFrame) -> DataFrame:
    """As-of lookup: for (doc_id, off) the start of the unit at or before it, and the start of the next."""
    u = units.filter(F.col("level") == level).select("doc_id", F.col("starts").alias("_s"), F.col("ends").alias("_e"))
    at = F.size(F.filter("_s", lambda s: s <= F.col("off"))) - 1
    joined = offsets.join(u, "doc_id", "left").withColumn("_at", at)
    inside = (F.col("_at") >= 0) & (F.col("off") < F.get("_e", F.col("_at")))
    found = joined.filter(F.col("_s").isNull() | inside)
    return found.select(*offsets.columns, F.get("_s", F.col("_at")).alias("u_start"), F.get("_e", F.col("_at")).alias("u_end"))


def bounded(matches: DataFrame, units: DataFrame, options: HighlightOptions) -> DataFrame:
    """``matches`` with tf, content, p_start, p_end (offsets) and p_first, p_last (boxes): context around each, within its limit.

    A limit is the chosen level and all levels above it, in formats that say so the chosen level alone; a level that a
    document doesn't have limits nothing. The matches of a document meet the units of its layout, one row, in one join on
    the document; the rest is local to it. ``tf`` counts a term in the document before pages are filtered; matches that
    go beyond the content are left out.
    """
    base, n = options.context_block, options.context_size
    u = units.filter(F.col("level") == base).drop("level")
    counted = matches.withColumn("tf", F.count("*").over(Window.partitionBy("doc_id", "term")))
    if options.page_id is not None:
        # Before anything is built, so that other pages cost nothing.
        pages = units.filter(F.col("level") == "page").select("doc_id", F.explode(F.arrays_zip("ids", "page_ids")).alias("p")).filter(F.col("p.page_ids") == options.page_id)
        counted = counted.join(pages.select("doc_id", F.col("p.ids").alias("_page")), "doc_id").filter(F.col("start_at.page_idx") == F.col("_page")).drop("_page")
    cols = [c for c in counted.columns if c != "doc_id"]
    each = counted.groupBy("doc_id").agg(F.collect_list(F.struct(*cols)).alias("_ms")).join(u, "doc_id")
    ids, last = F.col("ids"), F.size("ids") - 1
    first_id = F.get("ids", F.lit(0))
    even = F.get("ids", last) - first_id == last  # ordinals without gaps are places in the arrays

    def below(x: Column) -> Column:
        """How many units have a smaller ordinal."""
        return F.when(even, F.greatest(F.lit(0), F.least(last + 1, x - first_id))).otherwise(F.size(F.filter(ids, lambda i: i < x)))

    def limits(m: Column, levels: tuple[str, ...]) -> tuple[Column, Column]:
        lo, hi = [F.lit(0)], [last]
        for level in levels:
            if level == base or level == "word":
                lo.append(below(m["start_at"][SEQ[base]]))
                hi.append(below(m["end_at"][SEQ[base]]))
                continue
            inside = F.col(f"in_{level}")
            a, z = F.array_position(inside, m["start_at"][SEQ[level]]), F.array_position(F.reverse(inside), m["end_at"][SEQ[level]])
            lo.append(F.when(a > 0, a.cast("int") - 1).otherwise(below(m["start_at"][SEQ[base]])))
            hi.append(F.when(z > 0, last + 1 - z.cast("int")).otherwise(below(m["end_at"][SEQ[base]])))
        return (F.greatest(*lo) if len(lo) > 1 else lo[0]), (F.least(*hi) if len(hi) > 1 else hi[0])

    def context(m: Column) -> Column:
        every, chosen = limits(m, options.limit_levels()), limits(m, options.limit_levels(True))
        lo, hi = (F.when(F.col("first_only"), c).otherwise(e) for c, e in zip(chosen, every))
        a = F.greatest(below(m["start_at"][SEQ[base]] - n), lo)
        z = F.least(below(m["end_at"][SEQ[base]] + n + 1) - 1, hi)
        return F.struct(m.alias("m"), a.alias("a"), z.alias("z"))

    def looked_up(x: Column) -> Column:
        m, a, z = x["m"], x["a"], x["z"]
        return F.struct(*[m[c].alias(c) for c in cols], F.get("starts", a).alias("p_start"), F.least(F.get("ends", z), F.col("content")).alias("p_end"), F.get("firsts", a).alias("p_first"), F.get("lasts", z).alias("p_last"))

    out = each.select("doc_id", "content", F.explode(F.transform(F.transform("_ms", context), looked_up)).alias("m")).select("doc_id", "m.*", "content")
    return out.filter((F.col("start_off") < F.col("content")) & (F.col("end_off") <= F.col("content")))


_ORDER = ("start_off", "end_off", "term")


def numbered(bounded: DataFrame) -> DataFrame:
    """Gaps and islands: a match begins a new passage iff its bounds begin at or after the end of the one before it."""
    w = Window.partitionBy("doc_id").orderBy(*_ORDER)
    new = F.coalesce((F.col("p_start") >= F.lag("p_end").over(w)).cast("int"), F.lit(1))
    return bounded.withColumn("new", new).withColumn("passage_no", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))


def totals(numbered: DataFrame, options: HighlightOptions) -> DataFrame:
    """(doc_id, num_total): passages up to the limit, plus every match beyond it."""
    over = F.col("passage_no") > options.passage_limit
    return numbered.groupBy("doc_id").agg((F.least(F.max("passage_no"), F.lit(options.passage_limit)) + F.count_if(over)).cast("int").alias("num_total"))


def _built(numbered: DataFrame, options: HighlightOptions) -> DataFrame:
    """Matches that passages are built from: those up to the limit, and the first one behind it.

    The limit is looked at before the passage in progress counts, so there is one more, which ends with its first match.
    """
    return numbered.filter((F.col("passage_no") <= options.passage_limit) | ((F.col("passage_no") == options.passage_limit + 1) & (F.col("new") == 1)))


def passages(numbered: DataFrame, options: HighlightOptions) -> DataFrame:
    """(doc_id, passage_no, p_start, p_end, p_first, p_last, n_matches): a passage ends where its last match does."""
    last = F.max(F.struct(*_ORDER, "p_end", "p_last")).alias("z")
    p = _built(numbered, options).groupBy("doc_id", "passage_no").agg(F.min(F.struct(*_ORDER, "p_start", "p_first")).alias("a"), last, F.count("*").alias("n_matches"))
    return p.select("doc_id", "passage_no", "a.p_start", "z.p_end", "a.p_first", "z.p_last", "n_matches")


def score(freq: Column, doc_freq: Column, content: Column, length: Column, o: HighlightOptions) -> Column:
    """What one term adds to the score of a passage."""
    docs = 1 + content / o.pivot
    weight = (o.k1 + 1) * F.log(1 + (docs + 0.5) / (doc_freq + 0.5))
    return weight * freq / (freq + o.k1 * ((1 - o.b) + o.b * length / o.pivot))


def scored(numbered: DataFrame, options: HighlightOptions) -> DataFrame:
    """Passages with a score; ``norm`` of the options decides how the start counts."""
    w = Window.partitionBy("doc_id", "passage_no")
    built = _built(numbered, options).groupBy("doc_id", "passage_no", "term").agg(F.count("*").alias("f"), F.first("tf").alias("tf"), F.first("content").alias("content"), F.min(F.struct(*_ORDER, "p_start", "p_first")).alias("a"), F.max(F.struct(*_ORDER, "p_end", "p_last")).alias("z"))
    built = built.withColumn("a", F.min("a").over(w)).withColumn("z", F.max("z").over(w))
    p = built.groupBy("doc_id", "passage_no").agg(
        F.first("a.p_start").alias("p_start"), F.first("z.p_end").alias("p_end"), F.first("a.p_first").alias("p_first"), F.first("z.p_last").alias("p_last"), F.sum("f").alias("n_matches"),
        F.sum(score(F.col("f"), F.col("tf"), F.col("content"), F.col("z.p_end") - F.col("a.p_start"), options)).alias("raw"),
    )
    norm = F.lit(1.0)
    if options.norm == "reference":
        norm = 1 + 1 / F.log(F.lit(options.pivot) + F.col("p_start")) if options.boost_early else F.col("p_start").cast("double")
    return p.withColumn("score", F.col("raw") * norm).drop("raw")


def best(scored: DataFrame, options: HighlightOptions) -> DataFrame:
    """The ``snippets`` best passages of each document, with their rank; of equal scores the later passage wins."""
    if options.score_passages:
        # The filter on the rank directly above the window gives a bounded top-k in every partition.
        w = Window.partitionBy("doc_id").orderBy(F.col("score").desc(), F.col("p_start").desc())
    else:
        first = Window.partitionBy("doc_id").orderBy("p_start")
        scored = scored.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= options.snippets).drop("_n")
        w = Window.partitionBy("doc_id").orderBy(F.col("score").desc(), "p_start")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= options.snippets)
