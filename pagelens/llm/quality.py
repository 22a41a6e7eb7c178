"""Quality classifier: histogram gradient-boosted trees over document statistics.

``train`` boosts depth-limited trees on the logistic loss. Features are cut into at most ``bins`` bins at
quantiles; the gain of every split comes from histograms of gradients and Hessians. The trees are flattened into
four arrays (feature, threshold, left child, value), and ``predict`` walks all rows of a batch through all trees
at once, level by level, with numpy indexing.

A document is good if its quality label is 1 and it isn't labelled toxic. For the latter, some statistics count words
that are typical of toxic documents: those that occur in more of them than chance explains (``LEAST_Z`` standard
deviations), with their log odds. While the trees are fitted, a document's words are looked up in a table of the
other half of the sample, so the trees learn how far to trust it.

The model is fitted on at most ``sample`` labelled documents (those with the smallest hash of their id, so the
choice is the same in every run), of each id one row; scoring covers every document, whole texts.

Results for special input:

* a null or empty text: all statistics are 0; it gets the score of such a document like any other;
* a null quality label, or a label without document: not used for training; a null toxic label, or no such column, is
  0; of repeated labels the larger counts, of documents with one id the text with the smallest hash; with one class
  only, every score is near 0 or 1 as the labels are, and 1 without any label;
* a null or repeated id, repeated rows: each row is scored by its own text; ids only tie labels to documents;
* an empty table: no rows; other columns are kept by ``reject`` and ignored by ``score``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.llm._spark import fresh, slices, small_batches, store, struct
from pagelens.llm._text import DIGIT, LETTER, SPACE, UPPER, points, runs, spans_hash, tables, words

FEATURES = [
    "chars", "words", "word_length", "letter_share", "digit_share", "space_share", "symbol_share", "upper_share", "stop_share", "comma_share",
    "distinct_words", "top_word_share", "long_word_share", "one_letter_share", "lines", "line_length", "distinct_lines", "sentence_length",
    "symbol_per_word", "upper_word_share", "mark_run_share", "bracket_share", "typical_words", "typical_share", "typical_most",
]
LEAST_Z, TYPICAL = 5.0, 2048


@dataclass
class Typical:
    """Hashes of words that are typical of toxic documents, sorted, and their log odds."""

    hash: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    odds: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def of(self, h: np.ndarray) -> np.ndarray:
        """The log odds of every word; 0 if it isn't typical."""
        out = np.zeros(len(h))
        if len(self.hash):
            known = np.zeros(1 << 16, bool)
            known[self.hash & np.uint64(0xFFFF)] = True
            may = np.flatnonzero(known[h & np.uint64(0xFFFF)])
            at = np.minimum(np.searchsorted(self.hash, h[may]), len(self.hash) - 1)
            out[may] = np.where(self.hash[at] == h[may], self.odds[at], 0)
        return out


def statistics(col: pa.Array, typical: Typical | None = None) -> np.ndarray:
    """One row of FEATURES per text."""
    p = points(col)
    n, c, at = len(p.at) - 1, p.points, p.at
    cls = tables()[0][c]
    out = np.zeros((n, len(FEATURES)), np.float64)

    def per_text(flag: np.ndarray) -> np.ndarray:
        s = np.zeros(len(flag) + 1, np.int64)
        np.cumsum(flag, out=s[1:])
        return s[at[1:]] - s[at[:-1]]

    def count(of: np.ndarray, weights=None) -> np.ndarray:
        return np.bincount(of, weights, n).astype(np.float64)[:n] if len(of) else np.zeros(n)

    def distinct(of: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct values and the count of the most frequent one."""
        if not len(of):
            return np.zeros(n), np.zeros(n)
        order = np.lexsort((h, of))
        of, h = of[order], h[order]
        new = np.append(True, (of[1:] != of[:-1]) | (h[1:] != h[:-1]))
        begin = np.flatnonzero(new)
        top = np.zeros(n)
        np.maximum.at(top, of[begin], np.diff(np.append(begin, len(of))))
        return count(of[begin]), top

    w = words(p)
    odds = (typical or Typical()).of(w.hash)
    hit = np.flatnonzero(odds)
    most = np.zeros(n)
    np.maximum.at(most, w.text[hit], odds[hit])
    wt, length = w.text, (w.end - w.start).astype(np.float64)
    chars, many = np.diff(at).astype(np.float64), np.diff(w.first).astype(np.float64)
    safe, per_word = np.maximum(chars, 1), np.maximum(many, 1)
    letters, upper = per_text((cls & LETTER) != 0), per_text((cls & UPPER) != 0)
    symbol = cls == 0
    stops, commas = np.isin(c, np.array([46, 33, 63], np.uint32)), np.isin(c, np.array([44, 59, 58], np.uint32))
    odd = symbol & ~stops & ~commas
    ls, le = runs(c != 10, at)
    lt = np.searchsorted(at, ls, side="right") - 1
    lines = np.maximum(count(lt), 1)
    values = tables()[2][c]
    dw, top = distinct(wt, w.hash)
    dl, _ = distinct(lt, spans_hash(values, ls, le))
    all_upper = np.zeros(len(c) + 1, np.int64)
    np.cumsum((cls & UPPER) != 0, out=all_upper[1:])
    ss, _ = runs(stops, at)
    ms, me = runs(symbol, at)
    mt = np.searchsorted(at, ms, side="right") - 1
    cols = [
        np.log1p(chars), np.log1p(many), count(wt, length) / per_word, letters / safe, per_text((cls & DIGIT) != 0) / safe, per_text((cls & SPACE) != 0) / safe,
        per_text(odd) / safe, upper / np.maximum(letters, 1), per_text(stops) / safe, per_text(commas) / safe,
        dw / per_word, top / per_word, count(wt, length > 14) / per_word, count(wt, length == 1) / per_word, np.log1p(lines), np.log1p(chars / lines), dl / lines,
        np.log1p(many / np.maximum(count(np.searchsorted(at, ss, side="right") - 1), 1)),
        per_text(odd) / per_word, count(wt, (all_upper[w.end] - all_upper[w.start] == length) & (length > 1)) / per_word, count(mt, me - ms > 1) / per_word,
        per_text(np.isin(c, np.array([ord(x) for x in "()[]{}<>|"], np.uint32))) / safe,
        np.log1p(count(wt[hit])), count(wt[hit]) / per_word, most,
    ]
    for i, x in enumerate(cols):
        out[:, i] = x
    return out


@dataclass
class Forest:
    """Flattened trees: node i of tree t goes to left[t, i] if x[feature] <= threshold, else to the next node."""

    base: float
    feature: np.ndarray = field(default_factory=lambda: np.zeros((0, 1), np.int32))
    threshold: np.ndarray = field(default_factory=lambda: np.zeros((0, 1)))
    left: np.ndarray = field(default_factory=lambda: np.zeros((0, 1), np.int32))
    value: np.ndarray = field(default_factory=lambda: np.zeros((0, 1)))
    depth: int = 0

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The probability of the class 1 for each row."""
        score = np.full(len(x), self.base)
        if len(self.feature) and len(x):
            rows = np.arange(len(x))
            for t in range(len(self.feature)):
                node = np.zeros(len(x), np.int32)
                f, th, left = self.feature[t], self.threshold[t], self.left[t]
                for _ in range(self.depth):
                    # A leaf is its own left child, with an infinite threshold.
                    node = left[node] + (x[rows, f[node]] > th[node])
                score += self.value[t][node]
        return 1 / (1 + np.exp(-np.clip(score, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, least: float = 5.0, l2: float = 1.0) -> Forest:
    """Second-order boosting of the logistic loss, with histograms of at most ``bins`` bins a feature."""
    n, m = x.shape
    good = float(y.mean()) if n else 1.0
    base = float(np.log((good + 1e-6) / (1 - good + 1e-6)))
    if n == 0 or good in (0.0, 1.0):
        return Forest(base if n else 40.0)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    b = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(m)], 1)
    flat = b + np.arange(m) * bins
    size = 2 ** (depth + 1) - 1
    feature, threshold = np.zeros((trees, size), np.int32), np.full((trees, size), np.inf)
    left, value = np.tile(np.arange(size, dtype=np.int32), (trees, 1)), np.zeros((trees, size))
    score = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int32)
        free, level = 1, [0]
        for d in range(depth + 1):
            nxt = []
            for q in level:
                rows = np.flatnonzero(node == q)
                gs, hs = g[rows].sum(), h[rows].sum()
                value[t, q] = -rate * gs / (hs + l2)
                if d == depth or hs < 2 * least * 0.05 or len(rows) < 2 * least:
                    continue
                idx = flat[rows].ravel()
                hg = np.bincount(idx, np.repeat(g[rows], m), m * bins).reshape(m, bins).cumsum(1)
                hh = np.bincount(idx, np.repeat(h[rows], m), m * bins).reshape(m, bins).cumsum(1)
                hc = np.bincount(idx, minlength=m * bins).reshape(m, bins).cumsum(1)
                gain = hg**2 / (hh + l2) + (gs - hg) ** 2 / (hs - hh + l2) - gs**2 / (hs + l2)
                gain[(hc < least) | (len(rows) - hc < least)] = -1
                j, k = np.unravel_index(int(gain.argmax()), gain.shape)
                if gain[j, k] <= 1e-6 or k >= len(edges[j]):
                    continue
                feature[t, q], threshold[t, q], left[t, q] = j, edges[j][k], free
                node[rows] = free + (b[rows, j] > k)
                nxt += [free, free + 1]
                free += 2
            level = nxt
        score += value[t][node]
    return Forest(base, feature, threshold, left, value, depth)


@dataclass
class Model:
    forest: Forest
    typical: Typical = field(default_factory=Typical)

    def score(self, texts: pa.Array) -> np.ndarray:
        """The probability that each text is good."""
        return self.forest.predict(statistics(texts, self.typical))


def _sample(docs: DataFrame, labels: DataFrame, sample: int, id_col: str, text_col: str, label_col: str, toxic_col: str) -> DataFrame:
    """(half, y, toxic, text) of the labelled documents with the smallest hashes of their ids, one row for each id."""
    small_batches(docs.sparkSession)
    toxic = F.coalesce(F.col(f"`{toxic_col}`").cast("double"), F.lit(0.0)) > 0.5 if toxic_col in labels.columns else F.lit(False)
    few = labels.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{label_col}`").cast("double").alias("q"), toxic.alias("toxic")).dropna()
    few = few.groupBy("i").agg(F.max("q").alias("q"), F.max("toxic").alias("toxic")).orderBy(F.xxhash64("i"), "i").limit(sample)
    # At most ``sample`` rows of numbers.
    src = docs.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").cast("string").alias("text")).join(F.broadcast(few), "i")
    # A repeated id brings one text, that with the smallest hash: what goes to the driver is bounded by ``sample``.
    src = src.groupBy("i").agg(F.min_by(F.struct("q", "toxic", "text"), F.struct(F.xxhash64("text"), F.octet_length("text"))).alias("x"))
    return store(src.select(F.pmod(F.xxhash64("i", F.lit(1)), F.lit(2)).alias("half"), ((F.col("x.q") > 0.5) & ~F.col("x.toxic")).cast("double").alias("y"), F.col("x.toxic").cast("double").alias("toxic"), F.col("x.text").alias("text")))


def typical_words(src: DataFrame) -> Typical:
    """The words of (toxic, text) that are typical of the toxic ones; at most ``TYPICAL``, the most certain first."""

    def counted(batches):
        for b in slices(batches, "text"):
            w = words(points(b.column(1)))
            order = np.lexsort((w.text, w.hash))
            h, t = w.hash[order], w.text[order]
            new = np.append(True, (h[1:] != h[:-1]) | (t[1:] != t[:-1])) if len(h) else np.zeros(0, bool)
            h, bad = h[new], b.column(0).to_numpy()[t[new]]
            u, i = np.unique(h, return_inverse=True)
            yield pa.RecordBatch.from_pydict({"h": u.view(np.int64), "t": np.bincount(i, bad, len(u)), "n": np.bincount(i, minlength=len(u)).astype(np.float64)})

    docs, bad = src.agg(F.count("*"), F.sum("toxic")).first()
    if not docs or not bad or bad == docs:
        return Typical()
    p = bad / docs
    per = src.select("toxic", "text").mapInArrow(counted, "h LONG, t DOUBLE, n DOUBLE").groupBy("h").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
    per = per.withColumn("z", (F.col("t") - F.col("n") * p) / F.sqrt(F.col("n") * (p * (1 - p)))).filter(F.col("z") >= LEAST_Z)
    rows = per.orderBy(F.col("z").desc(), "h").limit(TYPICAL).collect()
    h = np.array([r["h"] for r in rows], np.int64).view(np.uint64)
    odds = np.array([np.log((r["t"] + 0.5) / (bad + 1)) - np.log((r["n"] - r["t"] + 0.5) / (docs - bad + 1)) for r in rows])
    return Typical(h[np.argsort(h)], odds[np.argsort(h)])


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", toxic_col: str = "toxic", **kw) -> Model:
    src = _sample(docs, labels, sample, id_col, text_col, label_col, toxic_col)
    halves = [typical_words(src.filter(F.col("half") != k)) for k in (0, 1)]

    def stats(batches):
        for b in slices(batches, "text"):
            half, out = b.column(0).to_numpy(), np.zeros((b.num_rows, len(FEATURES)))
            for k in (0, 1):
                own = np.flatnonzero(half == k)
                if len(own):
                    out[own] = statistics(b.column(2).take(pa.array(own)), halves[k])
            yield pa.RecordBatch.from_pydict({"y": b.column(1), "x": pa.array(list(out), pa.list_(pa.float64()))})

    rows = src.select("half", "y", "text").mapInArrow(stats, "y DOUBLE, x ARRAY<DOUBLE>").toArrow()
    if not rows.num_rows:
        return Model(train(np.zeros((0, len(FEATURES))), np.zeros(0), **kw))
    y, x = rows["y"].to_numpy(), np.array(rows["x"].to_pylist(), np.float64)
    order = np.lexsort([*x.T, y])  # whatever order the rows came in, the model is the same
    return Model(train(x[order], y[order], **kw), typical_words(src))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score): the probability that a document is good."""
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches):
        for b in slices(batches, "text"):
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "score": model.score(b.column(1))})

    return src.mapInArrow(run, "doc_id LONG, score DOUBLE")


def reject(docs: DataFrame, model: Model, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores at least ``least``."""
    (p,) = fresh(docs, "p")
    schema = struct(*((f.name, f.dataType.simpleString()) for f in docs.schema), (p, "double"))
    at = docs.columns.index(text_col)

    def run(batches):
        for b in slices(batches, text_col):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.score(b.column(at)))], [*b.schema.names, p])

    return docs.mapInArrow(run, schema).filter(F.col(p) >= least).select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).withColumn("keep", F.col("score") >= 0.5)
