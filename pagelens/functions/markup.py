"""Parsers for hOCR, ALTO and MiniOCR: markup to word boxes, with byte offsets.

One scanner yields events of a possibly broken or concatenated document; a handler for each format turns them into
boxes. Offsets count bytes of the UTF-8 markup. Unlike a validating parser, the scanner ignores declarations and
doctypes and never fails.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain
from types import MappingProxyType

SHY = "­"
ALTERNATIVE = "⇿"
LEVELS = ("page", "section", "block", "par", "line")
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([^\s<>/!?]+)((?:[^<>"']|"[^"]*"|'[^']*')*+|[^<>]*)>""", re.S)
_OPEN = re.compile(r"<!--.*|<!\[CDATA\[(.*)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=<>"'/]+)\s*=\s*(?:"([^"]*)"|'([^']*)')""")
_ENTITY = re.compile(r"&(#x[0-9A-Fa-f]+|#[0-9]+|[A-Za-z][A-Za-z0-9]*);")
_NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "shy": SHY, "nbsp": " ", "ensp": " ", "emsp": " ", "thinsp": " ", "zwnj": "‌", "zwj": "‍"}


def entities(s: str) -> str:
    """Known entities to characters; an unknown one stays, with its ampersand escaped."""

    def one(m: re.Match) -> str:
        e = m[1]
        if e[0] == "#":
            return html.unescape(m[0])
        return _NAMED.get(e, f"&amp;{e};")

    return _ENTITY.sub(one, s) if "&" in s else s


_NONE: Mapping = MappingProxyType({})


@dataclass(slots=True)
class Event:
    kind: str  # start, end or text
    name: str = ""
    attributes: Mapping[str, str] = _NONE
    places: Mapping[str, int] = _NONE  # of the values, from ``base`` on
    base: int = 0
    text: str = ""
    at: int = 0
    length: int = 0


#: Tags and titles repeat on every line, so what was read from the last ones is kept; longer ones are read anew.
_KEPT, _SHORT = 1 << 14, 256


def _attributes(body: str) -> tuple[Mapping[str, str], Mapping[str, int]]:
    """The attributes of a tag, and where their values begin in it."""
    attributes, places = {}, {}
    for a in _ATTRIBUTE.finditer(body):
        key, value, g = a[1], a[2], 2
        if value is None:
            value, g = a[3], 3
        if ":" in key and not key.startswith("xml:"):
            key = key.rpartition(":")[2]
        attributes[key] = entities(value)
        places[key] = a.start(g)
    return MappingProxyType(attributes), MappingProxyType(places)


_kept_attributes = lru_cache(_KEPT)(_attributes)


def events(markup: str) -> Iterator[Event]:
    at = 0
    # Behind the last > only a comment or a section that never ends can begin; with a > ahead, no tag is sought to the end in vain.
    last = markup.rfind(">") + 1
    for m in chain(_TOKEN.finditer(markup, 0, last), _OPEN.finditer(markup, last)) if last < len(markup) else _TOKEN.finditer(markup):
        begin, end = m.span()
        if begin < at:
            continue
        if begin > at:
            yield Event("text", text=entities(markup[at:begin]), at=at, length=begin - at)
        at = end
        if at == last and m[0].startswith(("<!--", "<![CDATA[")) and not m[0].endswith(("-->", "]]>")):
            at = len(markup)
        if m[1] is not None:
            inside = m[1] if at == end else markup[m.start(1) :]
            yield Event("text", text=inside, at=m.start(1), length=len(inside))
        elif m.re is _TOKEN and m[3]:
            name = m[3]
            if ":" in name:
                name = name.rpartition(":")[2]
            if m[2]:
                yield Event("end", name)
                continue
            body = m[4]
            attributes, places = (_kept_attributes if len(body) < _SHORT and "CONTENT" not in body else _attributes)(body)  # words differ
            yield Event("start", name, attributes, places, m.start(4), at=begin)
            if body.rstrip().endswith("/"):
                yield Event("end", name)
    if at < len(markup):
        yield Event("text", text=entities(markup[at:]), at=at, length=len(markup) - at)


@dataclass(slots=True)
class Box:
    text: str | None = None
    text_off: int = -1
    src_len: int = 0
    trailing: str | None = ""
    ulx: float = -1
    uly: float = -1
    lrx: float = -1
    lry: float = -1
    confidence: float | None = None
    page_idx: int = -1
    seq: tuple = ()
    offsets: tuple = ()
    alternatives: list[tuple[str, int]] = field(default_factory=list)
    hyphen_start: bool | None = None
    dehyphenated: str | None = None
    dehyphenated_off: int | None = None
    hyphenated: bool = False


@dataclass
class Page:
    id: str | None
    width: int | None = None
    height: int | None = None
    start_off: int = 0


def number(s: str | None) -> float | None:
    try:
        return float(s) if s else None
    except ValueError:
        return None


@lru_cache(_KEPT)
def _word_title(title: str | None) -> tuple[tuple[tuple[str, float], ...], float | None]:
    """(coordinates by name, confidence) of a word's title."""
    props = properties(title)
    read = zip(("ulx", "uly", "lrx", "lry"), map(number, props.get("bbox", "").split()))
    return tuple((k, float(int(v))) for k, v in read if v is not None), number(props.get("x_wconf"))


def properties(title: str | None) -> dict[str, str]:
    """The properties of an hOCR title: ``bbox 1 2 3 4; x_wconf 90; image "a.png"``."""
    out = {}
    for part in (title or "").split(";"):
        part = part.strip()
        name, _, value = part.partition(" ")
        value = value.strip()
        if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'":
            value = value[1:-1]
        if name:
            out[name] = value
    return out


class _Handler:
    """What the formats share: pages, block ordinals, the text between words."""

    def __init__(self, markup: str):
        self.boxes: list[Box] = []
        self.pages: list[Page] = []
        self.ordinal = dict.fromkeys(LEVELS, -1)
        self.offset = dict.fromkeys(LEVELS, 0)
        self.place = tuple(self.ordinal.values()), tuple(self.offset.values())
        self.open: Box | None = None

    def block(self, level: str, at: int) -> None:
        self.ordinal[level] += 1
        self.offset[level] = at
        self.place = tuple(self.ordinal.values()), tuple(self.offset.values())

    def page(self, page: Page) -> None:
        self.pages.append(page)
        self.block("page", page.start_off)

    def begin(self, box: Box) -> None:
        box.page_idx = len(self.pages) - 1
        box.seq, box.offsets = self.place
        self.boxes.append(box)

    def between(self, text: str) -> None:
        if not self.boxes:
            return
        last = self.boxes[-1]
        if not text.strip():
            if text and not last.trailing.endswith(" "):
                last.trailing += " "
        else:
            last.trailing += text

    def line_space(self) -> None:
        if self.boxes and " " not in self.boxes[-1].trailing:
            self.boxes[-1].trailing += " "

    def soft_hyphens(self, lone: Callable[[Box], None]) -> None:
        """Pair each word that ends with a soft hyphen, or is followed by one, with the next word."""
        for i in range(len(self.boxes) - 1, -1, -1):
            b = self.boxes[i]
            inside = b.text is not None and b.text.endswith(SHY)
            if not inside and not b.trailing.startswith(SHY):
                continue
            if inside:
                b.text = b.text.replace(SHY, "")
            b.trailing = None
            if i + 1 < len(self.boxes) and self.boxes[i + 1].text is not None:
                end = self.boxes[i + 1]
                whole = (b.text or "") + end.text
                b.hyphen_start, b.dehyphenated, end.hyphen_start, end.dehyphenated = True, whole, False, whole
            else:
                lone(b)
                b.hyphen_start = b.dehyphenated = None


class Hocr(_Handler):
    BLOCKS = {"ocr_page": "page", "ocr_chapter": "section", "ocr_section": "section", "ocr_subsection": "section", "ocr_subsubsection": "section", "ocr_carea": "block", "ocrx_block": "block", "ocr_par": "par", "ocr_line": "line", "ocrx_line": "line"}

    def run(self, markup: str) -> None:
        depth, word, done, deleted, ins = 0, None, False, False, False
        for e in events(markup):
            if word is not None:
                if e.kind == "text":
                    if ins:
                        word.text, word.text_off, word.src_len, done = e.text, e.at, e.length, True
                    elif deleted:
                        word.alternatives.append((e.text, e.at))
                    elif not done and word.text is None and depth == 0:
                        word.text, word.text_off, word.src_len = e.text, e.at, e.length
                elif e.kind == "start":
                    depth += 1
                    ins, deleted = e.name == "ins", e.name == "del"
                else:
                    ins = deleted = False
                    depth -= 1
                    if depth < 0:
                        word = None
                continue
            if e.kind == "text":
                self.between(e.text)
            elif e.kind == "start":
                kinds = (e.attributes.get("class") or "").split()
                for k in kinds:
                    level = self.BLOCKS.get(k)
                    if level == "page":
                        props = properties(e.attributes.get("title"))
                        b = [number(x) for x in props.get("bbox", "").split()]
                        whole = len(b) == 4 and None not in b
                        name = e.attributes.get("id") or props.get("x_source") or props.get("ppageno")
                        self.page(Page(name, int(b[2]) if whole else None, int(b[3]) if whole else None, e.at))
                    elif level:
                        self.block(level, e.at)
                        if level == "line" and e.name == "span":
                            self.line_space()
                if "ocrx_word" in kinds:
                    word, depth, done, ins, deleted = Box(), 0, False, False, False
                    coordinates, word.confidence = _word_title(e.attributes.get("title"))
                    for name, x in coordinates:
                        setattr(word, name, x)
                    self.begin(word)

        def lone(b: Box) -> None:
            if b.text is not None and not b.text.endswith("-"):
                b.text += "-"

        self.soft_hyphens(lone)


class Alto(_Handler):
    BLOCKS = {"Page": "page", "TextBlock": "block", "TextLine": "line"}

    def __init__(self, markup: str):
        super().__init__(markup)
        self.explicit = "<SP" in markup[:2048]

    def run(self, markup: str) -> None:
        spaces, alternative = 0, False

        def finish() -> None:
            if self.boxes:
                self.boxes[-1].trailing = " " if not self.explicit or spaces else ""

        for e in events(markup):
            if e.kind == "start":
                a = e.attributes
                if e.name == "String":
                    finish()
                    spaces = 0
                    b = Box(text=a.get("CONTENT"), text_off=e.base + e.places["CONTENT"] if "CONTENT" in e.places else -1)
                    b.src_len = _attribute_length(markup, b.text_off)
                    kind = a.get("SUBS_TYPE")
                    if kind is not None:
                        b.hyphen_start, b.dehyphenated, b.dehyphenated_off = kind == "HypPart1", a.get("SUBS_CONTENT"), e.base + e.places["SUBS_CONTENT"] if "SUBS_CONTENT" in e.places else None
                        if b.hyphen_start:
                            b.text = (b.text or "") + "-"
                    x, y, w, h = (number(a.get(k)) for k in ("HPOS", "VPOS", "WIDTH", "HEIGHT"))
                    if x is not None:
                        b.ulx = float(int(x))
                        b.lrx = float(int(x) + int(w)) if w is not None else -1
                    if y is not None:
                        b.uly = float(int(y))
                        b.lry = float(int(y) + int(h)) if h is not None else -1
                    b.confidence = number(a.get("WC"))
                    self.begin(b)
                elif e.name == "SP":
                    self.explicit = True
                    spaces += 1
                elif e.name == "ALTERNATIVE":
                    alternative = True
                elif e.name in self.BLOCKS:
                    if e.name == "Page":
                        w, h = number(a.get("WIDTH")), number(a.get("HEIGHT"))
                        whole = w is not None and h is not None
                        self.page(Page(a.get("ID"), int(w) if whole else None, int(h) if whole else None, e.at))
                    else:
                        self.block(self.BLOCKS[e.name], e.at)
                        spaces += e.name == "TextLine"
            elif e.kind == "text":
                if alternative and self.boxes:
                    self.boxes[-1].alternatives.append((e.text, e.at))
            elif e.name == "ALTERNATIVE":
                alternative = False
        finish()
        i = 0
        while i < len(self.boxes):
            b = self.boxes[i]
            if b.hyphen_start:
                end = self.boxes[i + 1] if i + 1 < len(self.boxes) else None
                if end is not None and end.hyphen_start is False:
                    b.trailing = ""
                else:
                    b.hyphen_start = b.dehyphenated = b.dehyphenated_off = None
                i += 1
            i += 1


def _attribute_length(markup: str, at: int) -> int:
    return max(0, markup.find(markup[at - 1], at) - at) if at > 0 else 0


@lru_cache(_KEPT)
def _numbers(s: str) -> tuple[float | None, ...]:
    return tuple(number(x) for x in s.split())


class MiniOcr(_Handler):
    BLOCKS = {"p": "page", "s": "section", "b": "block", "l": "line"}

    def run(self, markup: str) -> None:
        word = None
        for e in events(markup):
            if e.kind == "text":
                if word is not None:
                    if word.text is None:
                        parts, at = e.text.split(ALTERNATIVE), e.at
                        word.text, word.text_off, word.src_len = parts[0], e.at, e.length if len(parts) == 1 else len(parts[0])
                        for p in parts[1:]:
                            at = markup.find(ALTERNATIVE, at) + 1
                            word.alternatives.append((p, at))
                else:
                    self.between(e.text)
            elif e.kind == "end":
                if e.name == "w":
                    word = None
            elif e.name == "w":
                word = Box()
                v = _numbers(e.attributes.get("x", ""))
                if len(v) > 0 and v[0] is not None:
                    word.ulx = v[0]
                if len(v) > 1 and v[1] is not None:
                    word.uly = v[1]
                if len(v) > 2 and v[2] is not None:
                    word.lrx = word.ulx + v[2]
                if len(v) > 3 and v[3] is not None:
                    word.lry = word.uly + v[3]
                word.confidence = number(e.attributes.get("c"))
                self.begin(word)
            elif e.name == "p":
                d = [number(x) for x in e.attributes.get("wh", "").split()]
                whole = len(d) == 2 and None not in d
                self.page(Page(e.attributes.get("xml:id") or e.attributes.get("pid"), int(d[0]) if whole else None, int(d[1]) if whole else None, e.at))
            elif e.name in self.BLOCKS:
                self.block(self.BLOCKS[e.name], e.at)
                if e.name == "l":
                    self.line_space()

        def lone(b: Box) -> None:
            if b.text is not None and not b.text.endswith("-"):
                b.trailing = "-"

        self.soft_hyphens(lone)


@dataclass(frozen=True)
class Format:
    """A markup format; ``register`` adds one. Its handler turns events into boxes."""

    name: str
    test: re.Pattern
    handler: type[_Handler]
    first_limit_only: bool


FORMATS = [
    Format("hocr", re.compile(r"ocr_page|ocr_chapter|ocr_section|ocr_subsection|ocr_subsubsection|ocr_carea|ocrx_block|ocr_par|ocr_line|ocrx_line|ocrx_word"), Hocr, False),
    Format("alto", re.compile(r"<alto|[<:](?:Page|TextBlock|TextLine|String)[ >]|:alto"), Alto, True),
    Format("miniocr", re.compile(r"<[sblw][ >]"), MiniOcr, True),
]


def register(new: Format, before: str | None = None) -> None:
    """Add a format, in place of one of the same name; it is tried before the format ``before``, or last."""
    rest = [f for f in FORMATS if f.name != new.name]
    at = next((i for i, f in enumerate(rest) if f.name == before), len(rest))
    FORMATS[:] = [*rest[:at], new, *rest[at:]]


def detect(sample: str, formats: Sequence[Format] | None = None) -> str | None:
    """The first format whose test finds something in the first 2,048 characters."""
    return next((f.name for f in formats or FORMATS if f.test.search(sample[:2048])), None)


def parse(markup: str, format_name: str | None = None, formats: Sequence[Format] | None = None) -> tuple[list[Box], list[Page]]:
    """Boxes and pages; boxes without text or without any coordinate are left out. Unknown formats have none."""
    name = format_name or detect(markup, formats)
    spec = next((f for f in formats or FORMATS if f.name == name), None)
    if spec is None:
        return [], []
    h = spec.handler(markup)
    h.run(markup)
    boxes = [b for b in h.boxes if b.text and not (b.ulx < 0 and b.uly < 0 and b.lrx < 0 and b.lry < 0)]
    if not markup.isascii():
        place = [0]
        for c in markup:
            o = ord(c)
            place.append(place[-1] + (1 if o < 128 else 2 if o < 2048 else 3 if o < 65536 else 4))
        for b in boxes:
            if b.text_off >= 0:
                b.src_len = place[b.text_off + b.src_len] - place[b.text_off]
                b.text_off = place[b.text_off]
            b.alternatives = [(t, place[o]) for t, o in b.alternatives]
            b.dehyphenated_off = place[b.dehyphenated_off] if b.dehyphenated_off is not None else None
            b.offsets = tuple(place[o] for o in b.offsets)
        for p in h.pages:
            p.start_off = place[p.start_off]
    return boxes, h.pages


def boxes_to_text(boxes: list[Box]) -> str:
    """Plain text: a complete hyphenation once, in its joined form; a start alone gets a hyphen."""
    out, i = [], 0
    while i < len(boxes):
        b = boxes[i]
        trailing = b.trailing
        if b.hyphen_start:
            nxt = boxes[i + 1] if i + 1 < len(boxes) else None
            if nxt is not None and nxt.hyphen_start is False:
                out.append(nxt.dehyphenated or "")
                trailing = nxt.trailing
                i += 1
            else:
                t = (b.text or "").strip()
                out.append(t if t.endswith("-") else t + "-")
        else:
            out.append(b.text or "")
        out.append(trailing or "")
        i += 1
    return "".join(out).strip()
