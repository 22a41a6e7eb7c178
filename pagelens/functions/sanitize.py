"""Markup repair that never moves an offset: what is wrong is overwritten, what is missing is appended."""

from __future__ import annotations

import re

_NAME = re.compile(r"[^\s/>]*")
_ENTITY = re.compile(r"&(?:#x([0-9A-Fa-f]*)|#([0-9]*)|([A-Za-z][\w.\-:]*));")
_STRIPPED = frozenset({"br"})


def _legal(m: re.Match) -> bool:
    if m[1] is not None:
        return m[1] != "" and int(m[1], 16) <= 0x10FFFF
    return m[2] != "" if m[2] is not None else True


def _mask_entities(s: str) -> str:
    """``&`` that begins no entity becomes ``_``."""
    if "&" not in s:
        return s
    out, at = [], 0
    while (i := s.find("&", at)) >= 0:
        m = _ENTITY.match(s, i)
        ok = m is not None and _legal(m)
        out += [s[at:i], m[0] if ok else "_"]
        at = m.end() if ok else i + 1
    return "".join(out) + s[at:]


def sanitize(markup: str, fix: bool = False) -> str:
    """Close what is open at the end, blank closing tags that don't match, ``<br>`` and further doctypes.

    With ``fix`` also illegal entities, isolated ``<``, bad instructions and declarations, and tags whose name has
    other characters than letters and colons are masked by ``_``. Everything keeps its place; only closing tags are
    added at the end.
    """
    out: list[str] = []
    stack: list[str] = []
    at, n, doctype = 0, len(markup), False
    clean = _mask_entities if fix else str
    close, comment = -1, True  # the next >; whether a comment can still end
    while True:
        i = markup.find("<", at)
        if i < 0:
            out.append(clean(markup[at:]))
            break
        out.append(clean(markup[at:i]))
        if comment and markup.startswith("<!--", i):
            end = markup.find("-->", i + 4)
            if end >= 0:
                out.append(markup[i : end + 3])
                at = end + 3
                continue
            comment = False
        if markup.startswith("<![CDATA[", i):
            end = markup.find("]]>", i)
            end = n if end < 0 else end + 3
            out.append(markup[i:end])
            at = end
            continue
        if close < i:
            close = markup.find(">", i)
            close = n if close < 0 else close
        again = markup.find("<", i + 1)
        if close == n or (fix and 0 <= again < close):
            out.append("_" if fix else "<")
            at = i + 1
            continue
        tag = markup[i : close + 1]
        at = close + 1
        if tag.startswith("<?"):
            out.append("<_" + tag[2:] if fix and not tag.endswith("?>") else tag)
        elif tag.startswith("<!"):
            if tag[2:9].upper() == "DOCTYPE":
                out.append(" " * len(tag) if doctype else tag)
                doctype = True
            else:
                out.append("_" + tag[1:-1] + "_" if fix else tag)
        else:
            closing = tag.startswith("</")
            name = _NAME.match(tag, 2 if closing else 1)[0]
            if fix and not (name and all(c.isalpha() or c == ":" for c in name)):
                out.append("_" + tag[1:-1] + "_")
            elif closing:
                if stack and stack[-1] == name:
                    stack.pop()
                    out.append(tag)
                else:
                    out.append(" " * len(tag))
            elif name in _STRIPPED:
                out.append(" " * len(tag))
            else:
                if not tag.endswith("/>"):
                    stack.append(name)
                out.append(tag)
    out += [f"</{name}>" for name in reversed(stack)]
    return "".join(out)
