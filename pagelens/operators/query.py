"""The query language: terms, fields, phrases, proximity, wildcards, fuzzy terms, boolean operators, boosts.

A query is parsed to a tree; ``analysed`` puts its words through the analysis of the index, ``documents`` evaluates it
to a set of documents, ``scores`` to their relevance and ``matches`` to the spans that its terms and phrases match.
Every leaf filters postings by terms first, so phrase joins see only postings of their words, and all joins of phrases
are on (document, position). Wildcards and fuzzy terms are looked up in the dictionary of terms, if there is one.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.functions.analysis import TOKEN, Analysis
from pagelens.operators.index import document_lengths, place


@dataclass(frozen=True)
class Term:
    text: str
    field: str | None = None
    boost: float = 1.0
    fuzzy: int | None = None

    @property
    def wildcard(self) -> bool:
        return "*" in self.text or "?" in self.text


@dataclass(frozen=True)
class Phrase:
    terms: tuple[str, ...]
    slop: int = 0
    field: str | None = None
    boost: float = 1.0
    gaps: tuple[int, ...] = ()  # place of each term in the phrase, if stop words left gaps

    @property
    def places(self) -> tuple[int, ...]:
        return self.gaps or tuple(range(len(self.terms)))


@dataclass(frozen=True)
class Bool:
    kind: str  # and, or, not
    parts: tuple


_LEX = re.compile(r"""\s*(?:(?P<op>\(|\)|AND\b|OR\b|NOT\b|&&|\|\|)|(?P<sign>[+\-!])(?=[\w"(*?])|(?:(?P<field>[\w.]+):)?(?:"(?P<phrase>[^"]*)"(?:~(?P<slop>\d+))?|(?P<word>[^\s()":~^]+)(?P<fuzzy>~\d?)?)(?:\^(?P<boost>[\d.]+))?)""")
_WORD = re.compile(r"[^\W_]+")


def parse(text: str, default: str = "or"):
    """A query tree. ``AND`` binds closer than ``OR``; bare terms are joined by ``default``."""
    items = []
    at = 0
    while at < len(text) and text[at:].strip():
        m = _LEX.match(text, at)
        if not m or m.end() == at:
            raise ValueError(f"can't read the query at {text[at:]!r}")
        items.append(m)
        at = m.end()
    place = 0

    def leaf(m):
        boost = float(m["boost"] or 1)
        if m["phrase"] is not None:
            words = tuple(_WORD.findall(m["phrase"].lower()))
            return Phrase(words, int(m["slop"] or 0), m["field"], boost) if len(words) > 1 else Term(words[0] if words else "", m["field"], boost)
        word = m["word"].lower()
        if m["fuzzy"] is not None:
            return Term(word, m["field"], boost, min(2, int(m["fuzzy"][1:] or 2)))
        if "*" in word or "?" in word:
            return Term(word, m["field"], boost)
        words = tuple(_WORD.findall(word))
        return Term(words[0] if words else "", m["field"], boost) if len(words) < 2 else Phrase(words, 0, m["field"], boost)

    def single():
        nonlocal place
        m = items[place]
        place += 1
        if m["op"] == "(":
            out = any_of()
            place += 1
            return out
        if m["op"] == "NOT" or m["sign"] in ("-", "!"):
            return Bool("not", (single(),))
        if m["sign"] == "+":
            return Bool("must", (single(),))
        return leaf(m)

    def all_of():
        nonlocal place
        parts = [single()]
        while place < len(items) and items[place]["op"] in ("AND", "&&"):
            place += 1
            parts.append(single())
        return parts[0] if len(parts) == 1 else Bool("and", tuple(parts))

    def any_of():
        nonlocal place
        parts = [all_of()]
        while place < len(items) and items[place]["op"] != ")":
            if items[place]["op"] in ("OR", "||"):
                place += 1
            parts.append(all_of())
        must = tuple(p.parts[0] if isinstance(p, Bool) and p.kind == "must" else p for p in parts if isinstance(p, Bool) and p.kind in ("must", "not"))
        plain = tuple(p for p in parts if not (isinstance(p, Bool) and p.kind in ("must", "not")))
        if any(isinstance(p, Bool) and p.kind == "must" for p in parts):
            return must[0] if len(must) == 1 else Bool("and", must)
        if must:  # only negative clauses beside plain ones
            return Bool("and", (plain[0] if len(plain) == 1 else Bool(default, plain), *must)) if plain else Bool("and", must)
        return plain[0] if len(plain) == 1 else Bool(default, plain)

    if not items:
        return Bool("or", ())
    return any_of()


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def leaves(q) -> list:
    if isinstance(q, Bool):
        return [] if q.kind == "not" else [x for p in q.parts for x in leaves(p)]
    return [q]


def analysed(q, analysis: Analysis):
    """The query in the terms of an index: stemmed, without stop words, whose places in phrases stay empty."""
    if isinstance(q, Bool):
        parts = tuple(x for x in (analysed(p, analysis) for p in q.parts) if x is not None)
        return Bool(q.kind, parts) if parts or not q.parts else None
    if isinstance(q, Term):
        if q.wildcard or q.fuzzy is not None:
            return q
        (t,) = analysis.terms([q.text])
        return None if t is None else replace(q, text=t)
    kept = [(k, t) for k, t in zip(q.places, analysis.terms(q.terms)) if t is not None]
    if len(kept) < 2:
        return Term(kept[0][1], q.field, q.boost) if kept else None
    return replace(q, terms=tuple(t for _, t in kept), gaps=tuple(k - kept[0][0] for k, _ in kept))


def wildcard_pattern(text: str) -> str:
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in text) + "$"


def fuzzy_condition(c: Column, text: str, most: int) -> Column:
    """Terms within ``most`` (at most 2) edits; two neighbours that change places are one edit, and aren't edited again."""
    near = lambda x, t, d: F.levenshtein(x, F.lit(t), d) >= 0
    swap = lambda i: text[i + 1] + text[i]
    places = [i for i in range(len(text) - 1) if text[i] != text[i + 1]]
    cond = near(c, text, most)
    if most == 1 and places:
        cond = cond | c.isin([text[:i] + swap(i) + text[i + 2 :] for i in places])
    if most > 1:
        for i in places:  # one change of places, and one other edit before or behind it
            front, back = text[:i] + swap(i), swap(i) + text[i + 2 :]
            cond = cond | (c.endswith(back) & near(F.left(c, F.length(c) - len(back)), text[:i], 1)) | (c.startswith(front) & near(F.substring(c, len(front) + 1, 2**31 - 1), text[i + 2 :], 1))
        twice = [text[:i] + swap(i) + text[i + 2 : j] + swap(j) + text[j + 2 :] for i in places for j in places if j > i + 1]
        cond = cond | c.isin(twice) if twice else cond
    return (F.abs(F.length(c) - len(text)) <= most) & cond


def term_condition(t: Term, column: Column | None = None) -> Column:
    """Which terms of the index a term of the query stands for; a bare ``*`` stands for none."""
    c = F.col("term") if column is None else column
    if t.text in ("*", ""):
        return F.lit(False)
    if t.wildcard:
        prefix = re.split(r"[*?]", t.text)[0]
        cond = c.rlike(wildcard_pattern(t.text))
        return c.startswith(prefix) & cond if prefix else cond
    if t.fuzzy is not None:
        return fuzzy_condition(c, t.text, t.fuzzy) if t.fuzzy else c == t.text
    return c == t.text


#: So many terms of the dictionary become literals, which reach the scan of the postings; more are joined.
LITERALS = 1000


def with_term(p: DataFrame, t: Term, terms: DataFrame | None = None) -> DataFrame:
    """The postings of the terms that ``t`` stands for; ``terms`` is the dictionary."""
    cond = term_condition(t)
    if terms is None or not (t.wildcard or t.fuzzy):
        return p.filter(cond)
    found = terms.filter(cond).select("term")
    few = [r[0] for r in found.limit(LITERALS + 1).collect()]
    return p.filter(F.col("term").isin(few)) if len(few) <= LITERALS else p.join(found, "term", "left_semi")


def wanted(leaves: list) -> Callable[[str], bool]:
    """Whether a token in lower case can be one that ``leaves`` stand for: all of these, and of fuzzy terms some more.

    Its ``lengths`` and ``firsts`` are the numbers of characters and the first characters that such tokens have, or None;
    ``sought`` has the terms and wildcards that they are, or is None.
    """
    exact, patterns, wild, fuzzy, firsts = set(), [], set(), [], set()
    for x in leaves:
        if isinstance(x, Phrase):
            exact |= set(x.terms)
        elif x.text not in ("*", ""):
            if x.wildcard:
                patterns.append(re.compile(wildcard_pattern(x.text)))
                wild.add(x.text)
                firsts.add(x.text[0])
            else:
                exact.add(x.text)
                if x.fuzzy:
                    fuzzy.append((x.text, x.fuzzy))

    def near(a: str, b: str, most: int) -> bool:
        # An edit adds, drops or changes one character: what one of them has more of comes from at least as many edits.
        return abs(len(a) - len(b)) <= most and sum(max(0, a.count(c) - b.count(c)) for c in set(a)) <= most

    def want(t: str) -> bool:
        return t in exact or any(p.search(t) for p in patterns) or any(near(t, text, most) for text, most in fuzzy)

    firsts |= {x[0] for x in exact if x}
    want.lengths = None if patterns else sorted({len(x) for x in exact} | {len(x) + i for x, most in fuzzy for i in range(-most, most + 1)})
    want.firsts = None if fuzzy or firsts & {"*", "?"} else sorted(firsts)
    want.sought = None if fuzzy else sorted(exact | wild)
    return want


def every_token() -> Callable[[str], bool]:
    """As ``wanted`` gives it, for all tokens."""

    def want(t: str) -> bool:
        return True

    want.lengths = want.firsts = want.sought = None
    return want


_SPAN = ("doc_id", "start_off", "end_off", "start_box", "end_box", "start_at", "end_at", "term")


def _field(p: DataFrame, field: str | None, default: str | None) -> DataFrame:
    name = field or default
    return p.filter(F.col("field") == name) if name and "field" in p.columns else p


def _placed(p: DataFrame) -> DataFrame:
    return p if "place" in p.columns else p.withColumn("place", place(p.columns))


def _term_spans(p: DataFrame, t: Term, terms: DataFrame | None = None) -> DataFrame:
    hit = with_term(_placed(p), t, terms)
    return hit.select("doc_id", "pos", F.col("pos").alias("last"), "start_off", "end_off", F.col("box_seq").alias("start_box"), F.col("box_seq").alias("end_box"), F.col("place").alias("start_at"), F.col("place").alias("end_at"), "term")


def phrase_spans(p: DataFrame, terms: tuple[str, ...], slop: int = 0, places: tuple[int, ...] | None = None) -> DataFrame:
    """Spans of a phrase: positions less their place in the phrase differ by at most ``slop``.

    A word joins the first one on (document, position); with slop the first one's position stands for all positions that
    the word may have.
    """
    p, out, places = _placed(p), None, places or tuple(range(len(terms)))
    for i, (t, k) in enumerate(zip(terms, places)):
        one = p.filter(F.col("term") == t).select("doc_id", *(F.col(c).alias(f"{c}_{i}") for c in ("pos", "start_off", "end_off", "place")))
        if out is None:
            out = one
            continue
        if slop == 0:
            out = out.join(one.withColumn("pos_0", F.col(f"pos_{i}") - (k - places[0])), ["doc_id", "pos_0"])
        else:
            at = F.col("pos_0") + (k - places[0])
            differs = reduce(lambda a, b: a & b, (F.col(f"pos_{i}") != F.col(f"pos_{j}") for j in range(i)))
            out = out.withColumn(f"pos_{i}", F.explode(F.sequence(at - slop, at + slop))).join(one, ["doc_id", f"pos_{i}"]).filter(differs)
    n = len(terms)
    cols = lambda c: [F.col(f"{c}_{i}") for i in range(n)]
    if slop:
        moved = [F.col(f"pos_{i}") - k for i, k in enumerate(places)]
        out = out.filter(F.greatest(*moved) - F.least(*moved) <= slop)
    first, last = F.least(*cols("place")), F.greatest(*cols("place"))
    return out.select("doc_id", F.least(*cols("pos")).alias("pos"), F.greatest(*cols("pos")).alias("last"), F.least(*cols("start_off")).alias("start_off"), F.greatest(*cols("end_off")).alias("end_off"), first["box_seq"].alias("start_box"), last["box_seq"].alias("end_box"), first.alias("start_at"), last.alias("end_at"), F.lit(" ".join(terms)).alias("term"))


def spans(p: DataFrame, q, default_field: str | None = None, terms: DataFrame | None = None) -> DataFrame:
    p = _field(p, q.field, default_field)
    return phrase_spans(p, q.terms, q.slop, q.places) if isinstance(q, Phrase) and len(q.terms) > 1 else _term_spans(p, q if isinstance(q, Term) else Term(q.terms[0]), terms)


def _holds(q, leaf):
    """The query over what ``leaf`` makes of its leaves, by & and | and ~."""
    if not isinstance(q, Bool):
        return leaf(q)
    parts = [_holds(x, leaf) for x in q.parts]
    if q.kind == "not":
        return ~parts[0]
    return reduce((lambda a, b: a & b) if q.kind == "and" else (lambda a, b: a | b), parts)


def _in_one_pass(p: DataFrame, q: Bool, default_field: str | None) -> DataFrame | None:
    """(doc_id) of a query of terms, by what each document has of them; None if documents without any can match."""
    each: dict[Term, str] = {}
    note = lambda x: each.setdefault(x, f"_{len(each)}")
    if _holds(q, lambda x: note(x) and _NOTHING) is not _NOTHING:
        return None
    of = lambda t: term_condition(t) & (F.col("field") == name if (name := t.field or default_field) and "field" in p.columns else F.lit(True))
    has = {c: F.coalesce(of(t), F.lit(False)) for t, c in each.items()}
    found = p.filter(reduce(lambda a, b: a | b, has.values())).groupBy("doc_id").agg(*[F.bool_or(x).alias(c) for c, x in has.items()])
    return found.filter(_holds(q, lambda t: F.col(each[t]))).select("doc_id")


class _Truth:
    """A truth value for ``_holds``."""

    def __init__(self, value: bool):
        self.value = value

    def __and__(self, other):
        return _EVERYTHING if self.value and other.value else _NOTHING

    def __or__(self, other):
        return _EVERYTHING if self.value or other.value else _NOTHING

    def __invert__(self):
        return _NOTHING if self.value else _EVERYTHING


_NOTHING, _EVERYTHING = _Truth(False), _Truth(True)


def _every_leaf(q) -> list:
    return [x for p in q.parts for x in _every_leaf(p)] if isinstance(q, Bool) else [q]


def needed(q) -> list | None:
    """The leaves whose postings decide which documents match; None if documents without any of them can match."""
    return None if _has_empty(q) or _holds(q, lambda x: _NOTHING) is not _NOTHING else _every_leaf(q)


def _has_empty(q) -> bool:
    return isinstance(q, Bool) and (not q.parts or any(map(_has_empty, q.parts)))


def documents(p: DataFrame, q, default_field: str | None = None, terms: DataFrame | None = None) -> DataFrame:
    """(doc_id) of the documents that a query matches; a query of terms reads the postings once, however many it has."""
    if isinstance(q, Bool) and not _has_empty(q) and all(isinstance(x, Term) and not (terms is not None and (x.wildcard or x.fuzzy)) for x in _every_leaf(q)):
        found = _in_one_pass(p, q, default_field)
        if found is not None:
            return found
    if not isinstance(q, Bool):
        return spans(p, q, default_field, terms).select("doc_id").distinct()
    if q.kind == "not":
        return p.select("doc_id").distinct().join(documents(p, q.parts[0], default_field, terms), "doc_id", "left_anti")
    if not q.parts:
        return p.select("doc_id").filter(F.lit(False))
    if q.kind in ("or", "must"):
        return reduce(DataFrame.unionByName, (documents(p, x, default_field, terms) for x in q.parts)).distinct()
    yes = [x for x in q.parts if not (isinstance(x, Bool) and x.kind == "not")]
    out = reduce(lambda a, b: a.join(b, "doc_id", "left_semi"), (documents(p, x, default_field, terms) for x in yes)) if yes else p.select("doc_id").distinct()
    for x in q.parts:
        if isinstance(x, Bool) and x.kind == "not":
            out = out.join(documents(p, x.parts[0], default_field, terms), "doc_id", "left_anti")
    return out


def matches(p: DataFrame, q, default_field: str | None = None, within: DataFrame | None = None, weight_matches: bool = False, strict_phrases: bool = True, multi_term: bool = True, terms: DataFrame | None = None, unique: bool = False) -> DataFrame:
    """Spans to highlight: (doc_id, start_off, end_off, start_box, end_box, start_at, end_at, term).

    A phrase gives one span per word, or one for the whole phrase with ``weight_matches``; without
    ``strict_phrases`` its words match everywhere. Without ``multi_term`` wildcards and fuzzy terms give none.

    Spans are distinct. Of ``unique`` postings (one for a place of a document) those of a single term, or of words that
    match everywhere, are so without a shuffle.
    """
    p = _placed(p)
    if within is not None:
        p = p.join(within.select("doc_id"), "doc_id", "left_semi")
    out = []
    for leaf in leaves(q):
        if isinstance(leaf, Term):
            if (leaf.wildcard or leaf.fuzzy is not None) and not multi_term:
                continue
            out.append(spans(p, leaf, default_field, terms).select(*_SPAN))
            continue
        if not strict_phrases:
            own = _field(p, leaf.field, default_field).filter(F.col("term").isin(list(leaf.terms)))
            out.append(own.select("doc_id", "start_off", "end_off", F.col("box_seq").alias("start_box"), F.col("box_seq").alias("end_box"), F.col("place").alias("start_at"), F.col("place").alias("end_at"), "term"))
            continue
        whole = spans(p, leaf, default_field)
        if weight_matches:
            out.append(whole.select(*_SPAN))
        else:
            words = _field(p, leaf.field, default_field).filter(F.col("term").isin(list(leaf.terms)))
            # A hit is as many positions as it is long, so the words inside it are an equi-join.
            covered = whole.select("doc_id", F.explode(F.sequence("pos", "last")).alias("pos")).distinct()
            inside = words.join(covered, ["doc_id", "pos"])
            out.append(inside.select("doc_id", "start_off", "end_off", F.col("box_seq").alias("start_box"), F.col("box_seq").alias("end_box"), F.col("place").alias("start_at"), F.col("place").alias("end_at"), "term"))
    if not out:
        return _term_spans(p, Term("")).select(*_SPAN)
    if unique and len(out) == 1 and (not strict_phrases or not any(isinstance(x, Phrase) for x in leaves(q))):
        return out[0]
    return out[0].distinct() if len(out) == 1 else reduce(DataFrame.unionByName, out).distinct()


def bm25(p: DataFrame, terms: list[str], k1: float = 1.2, b: float = 0.75, lengths: DataFrame | None = None) -> DataFrame:
    """(doc_id, score): relevance of each document for the terms; ``lengths`` (doc_id, n_tokens) as the index has them."""
    counted = p.filter(F.col("term").isin(terms)).groupBy("doc_id", "term").agg(F.count("*").alias("f"))
    return _bm25(counted.withColumn("boost", F.lit(1.0)), p, k1, b, lengths)


def _bm25(counted: DataFrame, p: DataFrame, k1: float, b: float, lengths: DataFrame | None) -> DataFrame:
    """(doc_id, score) from (doc_id, term, f, boost)."""
    lengths = document_lengths(p) if lengths is None else lengths
    total = lengths.agg(F.count("*").alias("n"), F.avg("n_tokens").alias("mean"))
    df = counted.groupBy("term").agg(F.count("*").alias("df"))
    # One row of totals, and one row per query term.
    x = counted.join(F.broadcast(df), "term").join(lengths, "doc_id").crossJoin(F.broadcast(total))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return x.groupBy("doc_id").agg(F.sum(F.col("boost") * idf * F.col("f") / (F.col("f") + k1 * (1 - b + b * F.col("n_tokens") / F.col("mean")))).alias("score"))


def boosted(q, fields: dict[str, float]):
    """A query for several fields at once: every leaf without a field stands for all of them, each with its boost."""
    if isinstance(q, Bool):
        return Bool(q.kind, tuple(boosted(p, fields) for p in q.parts))
    if q.field is not None:
        return q
    each = tuple(replace(q, field=f, boost=q.boost * b) for f, b in fields.items())
    return each[0] if len(each) == 1 else Bool("or", each)


def scores(p: DataFrame, q, default_field: str | None = None, k1: float = 1.2, b: float = 0.75, lengths: DataFrame | None = None, terms: DataFrame | None = None) -> DataFrame:
    """(doc_id, score) of the documents that a query matches: BM25 of its leaves, each times its boost.

    A phrase counts as one term, as often as it occurs; a wildcard or fuzzy term counts constantly 1 times its boost.
    With ``lengths`` by (doc_id, field) each field has its own lengths.
    """
    found = documents(p, q, default_field, terms)
    flat, constant = [], []
    for i, leaf in enumerate(leaves(q)):
        hits = spans(p, leaf, default_field, terms).select("doc_id")
        if isinstance(leaf, Term) and (leaf.wildcard or leaf.fuzzy is not None):
            constant.append(hits.distinct().withColumn("score", F.lit(float(leaf.boost))))
        else:
            flat.append(hits.groupBy("doc_id").agg(F.count("*").alias("f")).select("doc_id", F.lit(f"{i}").alias("term"), "f", F.lit(float(leaf.boost)).alias("boost")))
    parts = [*constant, *([_bm25(reduce(DataFrame.unionByName, flat), p, k1, b, lengths)] if flat else [])]
    if not parts:
        return found.withColumn("score", F.lit(0.0))
    summed = reduce(DataFrame.unionByName, parts).groupBy("doc_id").agg(F.sum("score").alias("score"))
    return found.join(summed, "doc_id", "left").select("doc_id", F.coalesce("score", F.lit(0.0)).alias("score"))


def fielded(q, field: str):
    """The same query for another field."""
    return Bool(q.kind, tuple(fielded(p, field) for p in q.parts)) if isinstance(q, Bool) else replace(q, field=field)


__all__ = ["TOKEN", "Bool", "Phrase", "Term", "analysed", "bm25", "boosted", "documents", "fielded", "leaves", "matches", "parse", "phrase_spans", "replace", "scores", "spans", "term_condition", "words"]
