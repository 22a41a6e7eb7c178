"""HTML extraction: gradient-boosted trees over DOM-node features, decoded along the hierarchy.

``parse`` builds the element tree of a page in the tolerant way of browsers: void elements, implied end tags, stray
end tags, comments, raw text of scripts and styles. Every element with text below it becomes a row of FEATURES
(subtree text and element density, link share, attribute tokens, depth, sibling statistics, ...), which
``quality.Forest`` scores. The decoder keeps a set of elements that contains the parent of each of its members and
has the largest sum of log odds: from the leaves up, best(v) = max(0, logit(v) + sum of best(children)). An element
is kept if its parent is and best is positive, so no choice contradicts that of an ancestor or descendant.

The model is fitted on at most ``sample`` pages (those with the smallest hash of their id), labelled by the corpus:
of the documents that share runs of ``GRAM`` words with a page, the one that shares most is its source, and an
element is content if most of the runs in its text are in the source. Extraction covers every page, whole.

Results for special input:

* a null page: null text; a page that is empty, or without elements: its text outside of tags; no rows for an empty
  table; null or repeated ids and repeated rows: one row for each; other columns are ignored;
* unclosed, crossed or unknown tags, unterminated comments, bad entities: never an error, and time linear in the
  page's length; a < whose tag never ends is text; very long pages are parsed whole;
* tags and comments in scripts, styles and the like: not parsed; the first end tag of its own name ends the element;
* no page with a source document (or no documents): all elements count as content.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.llm._spark import slices, small_batches
from pagelens.llm._text import ngrams, points, words
from pagelens.llm.quality import Forest, train

GRAM, TOKENS = 4, 16
_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_EDGE = re.compile(r"""[>"']""")
_ATTRIBUTE = re.compile(r"""(?<![-\w:.])([a-zA-Z_:][-\w:.]*+)\s*+=\s*+("[^"]*"|'[^']*'|[^\s"'>]+)""")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea title svg iframe".split())
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.I | re.A) for t in _RAW}
_BLOCK = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_CLOSES = {t: frozenset(c.split()) for t, c in {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option", "tbody": "thead tbody tr td th", "tfoot": "thead tbody tr td th"}.items()}
_SCOPE = frozenset("ul ol dl table div section article main aside nav header footer body html td th".split())
_KINDS = ["p", "div", "span", "a", "li", "ul", "ol", "h1", "h2", "h3", "table", "tr", "td", "article", "main", "section", "nav", "footer", "header", "aside", "b", "strong", "em", "i", "blockquote", "pre", "code", "form", "body", "html"]
_KIND = {k: i + 1 for i, k in enumerate(_KINDS)}
FEATURES = [
    "kind", "parent_kind", "block", "heading", "list", "link", "depth", "own_text", "subtree_text", "subtree_elements", "density", "link_share", "page_share",
    "children", "sibling_index", "siblings", "same_siblings", "sibling_share", "words", "word_length", "stop_share", "comma_share", "upper_share", "digit_share",
    "place", "has_attributes", "in_boilerplate", "in_article", *(f"token_{i}" for i in range(TOKENS)),
]


@dataclass
class Tree:
    """Elements in document order; chunks are (element, text) in document order."""

    tag: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    attributes: list[str] = field(default_factory=list)
    chunks: list[tuple[int, str]] = field(default_factory=list)
    breaks: list[int] = field(default_factory=list)


class _Tags:
    """Tags of a page from left to right, in time linear in its length, however broken it is."""

    def __init__(self, source: str):
        self.source, self.last = source, source.rfind(">")
        self.loose = False  # quotes don't match up to the end of the page: from here on a tag ends at the next >
        self.cdata = True  # a CDATA section may still be closed

    def end(self, at: int) -> int:
        """Where the tag that begins before ``at`` ends: the first > outside of quotes, or else the first one."""
        s, p = self.source, at
        while not self.loose:
            m = _EDGE.search(s, p)
            if m is None:
                break
            if m[0] == ">":
                return m.end()
            p = s.find(m[0], m.end()) + 1
            if not p:
                break
        self.loose = True
        return s.find(">", at) + 1

    def next(self, at: int) -> tuple[int, int, re.Match | None, str] | None:
        """(start, end, name, attributes) of the next tag, comment or declaration; the latter two have no name."""
        s = self.source
        while at <= self.last:
            i = s.find("<", at)
            if i < 0 or i > self.last and not s.startswith("<!--", i):
                break
            if s.startswith("<!--", i):
                z = s.find("-->", i + 4)
                return i, z + 3 if z >= 0 else len(s), None, ""
            if self.cdata and s.startswith("<![CDATA[", i):
                z = s.find("]]>", i)
                if z >= 0:
                    return i, z + 3, None, ""
                self.cdata = False
            if s.startswith(("<!", "<?"), i):
                return i, s.find(">", i) + 1, None, ""
            m = _NAME.match(s, i + 1)
            if m:
                z = self.end(m.end())
                return i, z, m, s[m.end() : z - 1]
            at = i + 1
        i = s.find("<!--", at)
        return (i, len(s), None, "") if i >= 0 else None


def parse(source: str) -> Tree:
    t, stack, at = Tree(), [], 0
    where: dict[str, list[int]] = {}  # places in the stack of the open elements of a name
    tags = _Tags(source)

    def text(to: int) -> None:
        if to > at:
            s = source[at:to]
            if s.strip():
                t.chunks.append((stack[-1] if stack else -1, html.unescape(s) if "&" in s else s))
            elif t.chunks:
                t.chunks.append((stack[-1] if stack else -1, " "))

    def last(names) -> int:
        """The place of the innermost open element that has one of the names, or -1."""
        return max((where[k][-1] for k in names if where.get(k)), default=-1)

    def close(k: int) -> None:
        while len(stack) > k:
            where[t.tag[stack.pop()]].pop()

    while found := tags.next(at):
        start, stop, m, attributes = found
        text(start)
        at = stop
        if m is None:
            continue
        name = m[2].lower()
        if m[1]:
            k = last((name,))
            if k >= 0 and (name in _BLOCK or last(_SCOPE) <= k):
                close(k)
            if name in _BLOCK:
                t.breaks.append(len(t.chunks))
            continue
        if name in _VOID:
            if name in ("br", "hr"):
                t.breaks.append(len(t.chunks))
            continue
        if name in _RAW:
            if not attributes.endswith("/"):  # nothing counts in it but its own end tag
                end = _RAW_END[name].search(source, at)
                at = end.end() if end else len(source)
            continue
        if name in _BLOCK:
            t.breaks.append(len(t.chunks))
            k = last(("p",))
            if k >= 0 and last(_SCOPE) < k:  # a block ends an open paragraph
                close(k)
        closes = _CLOSES.get(name)
        if closes:
            k = last(closes)
            if k >= 0 and last(("ul", "ol", "dl", "table")) < k:
                close(k)
        t.tag.append(name)
        t.parent.append(stack[-1] if stack else -1)
        t.depth.append(len(stack))
        t.attributes.append(attributes)
        if not attributes.endswith("/"):
            where.setdefault(name, []).append(len(stack))
            stack.append(len(t.tag) - 1)
    text(len(source))
    return t


_STOP = re.compile(r"[.!?]")
_BOILER, _ARTICLE = frozenset(("nav", "footer", "header", "aside", "form")), frozenset(("article", "main"))


def features(t: Tree) -> np.ndarray:
    """One row of FEATURES per element; all zero for an element without text below."""
    n = len(t.tag)
    out = np.zeros((n, len(FEATURES)))
    if not n:
        return out
    own = np.zeros((n, 7))  # characters, words, letters of words, stops, commas, capitals, digits
    link, place = np.zeros(n), np.full(n, np.inf)
    in_link, boiler, article = [False] * n, [False] * n, [False] * n
    parent, tag = t.parent, t.tag
    children: list[list[int]] = [[] for _ in range(n + 1)]
    for i in range(n):
        p = parent[i]
        children[p].append(i)
        in_link[i] = tag[i] == "a" or (p >= 0 and in_link[p])
        boiler[i] = tag[i] in _BOILER or (p >= 0 and boiler[p])
        article[i] = tag[i] in _ARTICLE or (p >= 0 and article[p])
    seen = 0
    for v, s in t.chunks:
        if v < 0:
            continue
        w = s.split()
        size = sum(map(len, w))
        own[v] += (len(s), len(w), size, len(_STOP.findall(s)), s.count(","), sum(map(str.isupper, s)) if size else 0, sum(map(str.isdigit, s)) if size else 0)
        link[v] += len(s) if in_link[v] else 0
        place[v] = min(place[v], seen)
        seen += len(s)
    own_text = own[:, 0].copy()
    elements = np.ones(n)
    for i in range(n - 1, -1, -1):
        p = parent[i]
        if p >= 0:
            own[p] += own[i]
            link[p] += link[i]
            elements[p] += elements[i]
            place[p] = min(place[p], place[i])
    total = max(1.0, seen)
    size, many = np.maximum(own[:, 0], 1), np.maximum(own[:, 1], 1)
    for siblings in children:
        whole = max(1.0, sum(own[i, 0] for i in siblings))
        count: dict[str, int] = {}
        for i in siblings:
            count[tag[i]] = count.get(tag[i], 0) + 1
        for k, i in enumerate(siblings):
            out[i, 14:18] = (k, len(siblings), count[tag[i]], own[i, 0] / whole)
    for i in range(n):
        p, name = parent[i], tag[i]
        out[i, :7] = (_KIND.get(name, 0), _KIND.get(tag[p], 0) if p >= 0 else -1, name in _BLOCK, name in ("h1", "h2", "h3", "h4", "h5", "h6"), name in ("ul", "ol", "li"), in_link[i], t.depth[i])
        out[i, 13] = len(children[i])
        if t.attributes[i].strip(" /"):
            out[i, 25] = 1
            for k, value in _ATTRIBUTE.findall(t.attributes[i]):
                if k.lower() in ("class", "id", "role", "itemprop"):
                    for token in re.split(r"[\s_-]+", value.strip("\"'").lower()):
                        if token:
                            out[i, 28 + sum(token.encode()) % TOKENS] = 1
    out[:, 7], out[:, 8], out[:, 9] = np.log1p(own_text), np.log1p(own[:, 0]), np.log1p(elements)
    out[:, 10], out[:, 11], out[:, 12] = own[:, 0] / elements, link / size, own[:, 0] / total
    out[:, 18], out[:, 19] = np.log1p(own[:, 1]), own[:, 2] / many
    out[:, 20], out[:, 21], out[:, 22], out[:, 23] = own[:, 3] / many, own[:, 4] / many, own[:, 5] / size, own[:, 6] / size
    out[:, 24] = np.where(np.isfinite(place), place, total) / total
    out[:, 26], out[:, 27] = boiler, article
    out[own[:, 1] == 0] = 0
    return out


def decode(parent: list[int], logit: np.ndarray) -> np.ndarray:
    """Which elements to keep: the best set that has the parent of each of its members."""
    best = np.asarray(logit, np.float64).copy()
    for i in range(len(parent) - 1, -1, -1):
        if best[i] > 0 and parent[i] >= 0:
            best[parent[i]] += best[i]
    kept = best > 0
    for i, p in enumerate(parent):
        if p >= 0 and not kept[p]:
            kept[i] = False
    return kept


def render(t: Tree, kept: np.ndarray) -> str:
    """Kept text, a line for each block."""
    breaks, lines, line = set(t.breaks), [], []
    for i, (v, s) in enumerate(t.chunks):
        if i in breaks and line:
            lines.append(" ".join("".join(line).split()))
            line = []
        if v < 0 or kept[v]:
            line.append(s)
    lines.append(" ".join("".join(line).split()))
    return "\n".join(x for x in lines if x)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def extract_batch(sources: list[str | None], model: Forest | None) -> list[tuple[str | None, int, int]]:
    """(text, elements, kept elements) of every page."""
    trees = [parse(s) if s is not None else None for s in sources]
    rows = [features(t) if t is not None else np.zeros((0, len(FEATURES))) for t in trees]
    x = np.concatenate(rows) if rows else np.zeros((0, len(FEATURES)))
    logit = _logit(model.predict(x)) if model is not None else np.ones(len(x))
    # The root decides nothing, and neither does an element without text.
    logit = np.where((x[:, 8] > 0) & (x[:, 0] < _KIND["body"]), logit, 0) if len(x) else logit
    out, at = [], 0
    for t, r in zip(trees, rows):
        if t is None:
            out.append((None, 0, 0))
            continue
        kept = decode(t.parent, logit[at : at + len(r)])
        at += len(r)
        out.append((render(t, kept), len(r), int(kept.sum())))
    return out


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Runs of exactly GRAM words: (hash, text)."""
    w = words(points(pa.array(texts, pa.string())))
    h, t = ngrams(w, GRAM)
    long = np.diff(w.first)[t] >= GRAM
    return h[long], t[long]


def fit(pages: DataFrame, documents: DataFrame, sample: int = 300, id_col: str = "page_id", html_col: str = "html", text_col: str = "text", share: float = 0.3, **kw) -> Forest | None:
    """Train on at most ``sample`` pages, labelled by their source documents; None if no page has one."""
    few = pages.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{html_col}`").cast("string").alias("h")).filter("h IS NOT NULL")
    # The ids' hashes decide first, so that no task sends more pages than belong to the sample.
    last = few.select(F.xxhash64("i").alias("k")).orderBy("k").limit(sample).agg(F.max("k")).first()[0]
    sources = [r[1] for r in few.filter(F.xxhash64("i") <= F.lit(last)).orderBy(F.xxhash64("i"), "h").limit(sample).collect()]
    trees = [parse(s) for s in sources]
    chunk_text = [s for t in trees for _, s in t.chunks]
    chunk_page = np.repeat(np.arange(len(trees)), [len(t.chunks) for t in trees])
    if not chunk_text:
        return None
    gram, chunk = _grams(chunk_text)
    pairs = np.unique(np.stack([gram, chunk_page[chunk].astype(np.uint64)], 1), axis=0)
    sizes = np.bincount(pairs[:, 1].astype(np.int64), minlength=len(trees))
    # The runs of the sample: bounded by it, whatever the size of the corpus.
    sent = documents.sparkSession.sparkContext.broadcast((pairs[:, 0].copy(), pairs[:, 1].astype(np.int64), sizes))

    def match(batches):
        keys, page, size = sent.value
        for b in slices(batches, "text"):
            w = words(points(b.column(0)))
            h, t = ngrams(w, GRAM)
            lo = np.searchsorted(keys, h)
            hit = keys[np.minimum(lo, len(keys) - 1)] == h if len(keys) else np.zeros(len(h), bool)
            h, t, lo = h[hit], t[hit], lo[hit]
            hi = np.searchsorted(keys, h, side="right")
            count = hi - lo
            total = np.cumsum(count)
            row = np.arange(total[-1] if len(total) else 0) + np.repeat(lo - (total - count), count)
            triple = np.unique(np.stack([np.repeat(t, count), page[row], row], 1), axis=0)
            found: dict[tuple[int, int], list[int]] = {}
            for d, p, r in triple.tolist():
                found.setdefault((d, p), []).append(r)
            good = [(p, r) for (_, p), r in found.items() if len(r) >= share * size[p]]
            yield pa.RecordBatch.from_pydict({"p": pa.array([p for p, _ in good], pa.int64()), "n": pa.array([len(r) for _, r in good], pa.int64()), "g": pa.array([np.array(r, np.int64).tobytes() for _, r in good], pa.binary())})

    matches = documents.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(match, "p LONG, n LONG, g BINARY")
    best = {r["p"]: np.frombuffer(r["x"]["g"], np.int64) for r in matches.groupBy("p").agg(F.max(F.struct("n", "g")).alias("x")).collect()}
    xs, ys = [], []
    at = 0
    for p, t in enumerate(trees):
        here = np.flatnonzero((chunk >= at) & (chunk < at + len(t.chunks)))
        if p in best:
            inside = np.isin(gram[here], pairs[best[p], 0])
            n = len(t.tag)
            yes, all_ = np.zeros(n), np.zeros(n)
            for c, ok in zip((chunk[here] - at).tolist(), inside.tolist()):
                v = t.chunks[c][0]
                if v >= 0:
                    all_[v] += 1
                    yes[v] += ok
            for i in range(n - 1, -1, -1):
                if t.parent[i] >= 0:
                    all_[t.parent[i]] += all_[i]
                    yes[t.parent[i]] += yes[i]
            label = np.where(all_ > 0, (yes * 2 >= all_).astype(float), 0)
            for i in range(n):  # without a run of its own, an element has the label of its surroundings
                if all_[i] == 0 and t.parent[i] >= 0:
                    label[i] = label[t.parent[i]]
            for i in range(n):  # links and lists whose words are too few to tell
                if all_[i] == 0 and t.tag[i] in ("nav", "ul", "ol", "li", "a", "menu"):
                    label[i] = 0
            x = features(t)
            use = x[:, 8] > 0
            xs.append(x[use])
            ys.append(label[use])
        at += len(t.chunks)
    if not xs:
        return None
    return train(np.concatenate(xs), np.concatenate(ys), **({"trees": 50, "depth": 4} | kw))


def extract(pages: DataFrame, model: Forest | None, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, text, elements, kept): the content of every page."""
    small_batches(pages.sparkSession)
    src = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{html_col}`").cast("string").alias("html"))

    def run(batches):
        for b in slices(batches, "html", 1 << 20):
            out = extract_batch(b.column(1).to_pylist(), model)
            yield pa.RecordBatch.from_pydict({"page_id": b.column(0), "text": pa.array([o[0] for o in out], pa.string()), "elements": pa.array([o[1] for o in out], pa.int32()), "kept": pa.array([o[2] for o in out], pa.int32())})

    return src.mapInArrow(run, "page_id LONG, text STRING, elements INT, kept INT")


def op10_html(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages, fit(pages, spark.read.parquet(f"{sf_dir}/documents.parquet")))
