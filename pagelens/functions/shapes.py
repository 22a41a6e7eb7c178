"""Documents whose words all have one plain shape, many words at a time.

Such a document is cut at its words. Each distinct tag of a word, and each distinct piece between two words, goes to the
format's own handler once; what it makes of them holds wherever they stand, so texts, offsets and ordinals follow from sums
over arrays. A document that has anything else is left to the parser.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pagelens.functions import markup as M
from pagelens.functions.sanitize import sanitize

#: A word; its groups are the tag before the text, the text, and in ALTO the tag behind it. Then what is around these groups.
_SHAPES = {
    M.Hocr: (re.compile(r"<span( [^<>]*ocrx_word[^<>]*)>([^<>]+)</span>"), "<span", ">", "</span>"),
    M.MiniOcr: (re.compile(r"<w( [^<>]*)>([^<>]+)</w>"), "<w", ">", "</w>"),
    M.Alto: (re.compile(r'<String( (?:[^<>]* )?)CONTENT="([^"<>]+)"([^<>]*)/>'), "<String", 'CONTENT="', "/>"),
}
#: What can mean more than it says: soft hyphens, other readings, declarations.
_SPECIAL = re.compile(f"[{M.SHY}{M.ALTERNATIVE}]|&shy|&#|ALTERNATIVE|<[!?]")
_BODY = re.compile(r"""(?:[^<>"']|"[^"<>]*"|'[^'<>]*')*+""")
_BETWEEN = re.compile(r"""(?:[^<>]+|<\/?[^\s<>/!?]+(?:[^<>"']|"[^"<>]*"|'[^'<>]*')*+>)*+""")
#: Handlers whose documents can be read so.
READ = frozenset(_SHAPES)
_LEVELS = ("line", "par", "block", "section")
_MOST = 1 << 16


class _Known(dict):
    """Numbers of strings, each read when it is first met; -1 for one that the parser must see in its place."""

    def __init__(self, read):
        self.read, self.rows = read, []

    def __missing__(self, key):
        row = self.read(key)
        self[key] = number = -1 if row is None else len(self.rows)
        if row is not None:
            self.rows.append(row)
        return number

    def of(self, keys) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, keys), np.int32, len(keys))

    def column(self, i: int, kind=np.int64) -> np.ndarray:
        return np.array([r[i] for r in self.rows], kind)


@dataclass
class _Tag:
    shape: tuple
    handler: type

    def __call__(self, key: str):
        """(ulx, uly, lrx, lry, confidence, bytes before the text, bytes behind it)."""
        before, _, behind = key.partition("\0")
        _, opening, middle, closing = self.shape
        if not (_BODY.fullmatch(before) and _BODY.fullmatch(behind)) or "CONTENT" in key:
            return None
        tail = ('"' if self.handler is M.Alto else "") + behind + closing
        h = self.handler("")
        h.run(opening + before + middle + "x" + tail)
        if len(h.boxes) != 1 or h.pages or any(v >= 0 for v in h.ordinal.values()):
            return None
        b = h.boxes[0]
        if b.text != "x" or b.hyphen_start is not None or b.dehyphenated is not None or b.alternatives or b.ulx < 0 and b.uly < 0 and b.lrx < 0 and b.lry < 0:
            return None
        return b.ulx, b.uly, b.lrx, b.lry, np.nan if b.confidence is None else b.confidence, b.confidence is None, len((opening + before + middle).encode()), len(tail.encode())


@dataclass
class _Between:
    handler: type
    first: bool  # before the first word of a document

    def __call__(self, key: str):
        """(bytes, what trails the word, number of each level, pages, explicit space, any space)."""
        if not _BETWEEN.fullmatch(key):
            return None

        def run(explicit):
            h = self.handler("")
            h.boxes = [] if self.first else [M.Box(text="x")]
            h.explicit = explicit
            h.run(key)
            return h

        h, again = run(False), run(True)
        if len(h.boxes) != 1 - self.first or h.boxes and (h.boxes[0].text != "x" or h.boxes[0].alternatives):
            return None
        trailing = h.boxes[0].trailing if h.boxes else ""
        return (len(key.encode()), trailing, *(h.ordinal[k] + 1 for k in _LEVELS), tuple((p.id, p.width, p.height) for p in h.pages), bool(h.explicit), bool(again.boxes and again.boxes[0].trailing))


class Reader:
    """What was read from the tags of one format so far."""

    def __init__(self, handler: type):
        self.handler, self.shape = handler, _SHAPES[handler]
        self._new()

    def _new(self):
        self.tags, self.heads, self.gaps = _Known(_Tag(self.shape, self.handler)), _Known(_Between(self.handler, True)), _Known(_Between(self.handler, False))
        self.docs, self.texts, self.pages, self.n = [], [], [], []

    def begin(self) -> None:
        if max(len(self.tags), len(self.heads), len(self.gaps)) > _MOST:
            self._new()
        self.docs, self.texts, self.pages, self.n = [], [], [], []

    def add(self, markup: str) -> bool:
        """Take a document in; False if the parser must read it."""
        if _SPECIAL.search(markup):
            return False
        parts = self.shape[0].split(markup)
        k = self.shape[0].groups + 1
        if len(parts) == 1:
            return False
        head, gaps = self.heads[parts[0]], self.gaps.of(parts[k::k])
        if head < 0 or gaps.min() < 0:
            return False
        tags = self.tags.of(parts[1::k] if k == 3 else [f"{a}\0{b}" for a, b in zip(parts[1::k], parts[3::k])])
        if tags.min() < 0:
            return False
        rest = "".join(parts[::k])  # words close what they open
        if sanitize(rest) != rest:
            return False
        pages = list(self.heads.rows[head][6])
        rows = self.gaps.rows
        gap_pages = [rows[g][6] for g in gaps.tolist() if rows[g][6]]
        pages += [p for x in gap_pages for p in x]
        self.docs.append((head, tags, gaps, self.handler is M.Alto and "<SP" in markup[:2048]))
        self.texts += parts[2::k]
        self.pages += pages
        self.n.append((len(tags), len(pages)))
        return True

    def words(self, fields) -> tuple[list[int], pa.StructArray]:
        """(words of each document taken in, all their words as ``fields``)."""
        counts = np.array([n for n, _ in self.n], np.int64)
        first = np.concatenate([[0], np.cumsum(counts)])
        total = int(first[-1])
        doc = np.repeat(np.arange(len(counts)), counts)
        tag, gap = (np.concatenate([d[i] for d in self.docs]) for i in (1, 2))
        head = np.array([d[0] for d in self.docs])

        def before(each, of_head):
            """What is before each word of its document: in the head, and behind the words before."""
            sums = np.concatenate([[0], np.cumsum(each)])
            return sums[:-1] - sums[first[:-1]][doc] + of_head[doc]

        text = pa.array(self.texts, pa.string())
        size = pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64)
        lead, tail = (self.tags.column(i)[tag] for i in (6, 7))
        off = before(lead + size + tail + self.gaps.column(0)[gap], self.heads.column(0)[head]) + lead
        if pc.any(amp := pc.match_substring(text, "&")).as_py():
            mask = amp.to_numpy(zero_copy_only=False)
            text = pc.replace_with_mask(text, amp, pa.array([M.entities(self.texts[i]) for i in np.flatnonzero(mask)], pa.string()))
        seq = {k: before(self.gaps.column(2 + i)[gap], self.heads.column(2 + i)[head]) - 1 for i, k in enumerate(_LEVELS)}
        n_pages = lambda known: np.array([len(r[6]) for r in known.rows], np.int64)
        page = before(n_pages(self.gaps)[gap], n_pages(self.heads)[head]) - 1
        at = np.concatenate([[0], np.cumsum([n for _, n in self.n])])[:-1][doc] + page
        at = pa.array(at, mask=page < 0)
        trailing = pa.array([r[1] for r in self.gaps.rows], pa.string()).take(pa.array(gap))
        if self.handler is M.Alto:
            said = before(self.gaps.column(7)[gap], self.heads.column(7)[head]) + self.gaps.column(7)[gap] + np.array([d[3] for d in self.docs])[doc] > 0
            trailing = pa.array([" ", ""]).take(pa.array((said & ~self.gaps.column(8, bool)[gap]).astype(np.int8)))
        float_of = lambda i: pa.array(self.tags.column(i, np.float64)[tag].astype(np.float32))
        have = {
            "box_seq": np.arange(total) - first[:-1][doc], "text": text, "text_off": off, "src_len": size, "trailing": trailing,
            **{k: float_of(i) for i, k in enumerate(("ulx", "uly", "lrx", "lry"))}, "confidence": pa.array(self.tags.column(4, np.float64)[tag], mask=self.tags.column(5, bool)[tag]),
            "page_idx": page, **{f"{k}_seq": v for k, v in seq.items()},
            **{k: pa.array([p[i] for p in self.pages], pa.string() if k == "page_id" else pa.int32()).take(at) for i, k in enumerate(("page_id", "page_width", "page_height"))},
        }

        def column(f):
            if f.name == "alternatives":
                return pa.ListArray.from_arrays(pa.array(np.zeros(total + 1, np.int32)), pa.array([], f.type.value_type))
            v = have.get(f.name)
            return pa.nulls(total, f.type) if v is None else v if isinstance(v, pa.Array) else pa.array(v).cast(f.type)

        return counts.tolist(), pa.StructArray.from_arrays([column(f) for f in fields], fields=list(fields))
