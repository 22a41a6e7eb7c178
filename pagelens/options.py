"""Highlight parameters: request keys to a frozen set of options, with fallbacks and per-field overrides."""

from __future__ import annotations

import fnmatch
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

LEVEL_ORDER = ("word", "line", "paragraph", "block", "section", "page")


@dataclass(frozen=True)
class HighlightOptions:
    snippets: int = 1
    context_block: str = "line"
    context_size: int = 2
    limit_block: str = "block"
    absolute_highlights: bool = False
    align_spans: bool = False
    track_pages: bool = True
    score_passages: bool = True
    max_passages: int = 100
    page_id: str | None = None
    time_allowed_ms: int | None = None
    tag_pre: str = "<em>"
    tag_post: str = "</em>"
    k1: float = 1.2
    b: float = 0.75
    pivot: float = 87.0
    boost_early: bool = False
    norm: str = "reference"
    weight_matches: bool = False
    use_phrase_highlighter: bool = True
    highlight_multi_term: bool = True

    @property
    def passage_limit(self) -> int:
        return max(self.snippets, self.max_passages)

    def limit_levels(self, first_only: bool = False) -> tuple[str, ...]:
        """The chosen level and all above it; formats that honour only the first one say so."""
        if self.limit_block == "none":
            return ()
        levels = LEVEL_ORDER[LEVEL_ORDER.index(self.limit_block) :]
        return levels[:1] if first_only else levels


_KEYS = {
    "snippets": ("snippets", int), "contextBlock": ("context_block", str), "contextSize": ("context_size", int), "limitBlock": ("limit_block", str),
    "absoluteHighlights": ("absolute_highlights", bool), "alignSpans": ("align_spans", bool), "trackPages": ("track_pages", bool), "scorePassages": ("score_passages", bool),
    "maxPassages": ("max_passages", int), "pageId": ("page_id", str), "timeAllowed": ("time_allowed_ms", int), "tag.pre": ("tag_pre", str), "tag.post": ("tag_post", str),
    "score.k1": ("k1", float), "score.b": ("b", float), "score.pivot": ("pivot", float), "score.boostEarly": ("boost_early", bool),
    "weightMatches": ("weight_matches", bool), "usePhraseHighlighter": ("use_phrase_highlighter", bool), "highlightMultiTerm": ("highlight_multi_term", bool),
}


def _cast(value, kind):
    if kind is bool:
        return value if isinstance(value, bool) else str(value).lower() in ("true", "on", "yes", "1")
    return kind(value)


def enabled(params: Mapping[str, object]) -> bool:
    """``hl.ocr`` decides; without it ``hl``."""
    return _cast(params.get("hl.ocr", params.get("hl", False)), bool)


def resolve(params: Mapping[str, object], field: str | None = None) -> HighlightOptions:
    """Options from request keys: ``f.<field>.hl.ocr.x``, ``f.<field>.hl.x``, ``hl.ocr.x``, ``hl.x``, in this order."""
    out = {}
    for key, (name, kind) in _KEYS.items():
        for k in ([f"f.{field}.hl.ocr.{key}", f"f.{field}.hl.{key}"] if field else []) + [f"hl.ocr.{key}", f"hl.{key}"]:
            if k in params:
                out[name] = _cast(params[k], kind)
                break
    return HighlightOptions(**out)


def fields(patterns: str | Iterable[str], stored: Iterable[str]) -> list[str]:
    """Stored fields that one of the patterns (names or globs) names, in the order of the patterns."""
    stored = list(stored)
    listed = patterns.replace(",", " ").split() if isinstance(patterns, str) else list(patterns)
    return list(dict.fromkeys(f for p in listed for f in stored if fnmatch.fnmatchcase(f, p)))


def regular_fields(requested: Iterable[str], ocr: Iterable[str]) -> list[str]:
    """What is left for the highlighter of plain text."""
    ocr = set(ocr)
    return [f for f in requested if f not in ocr]
