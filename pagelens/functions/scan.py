"""Texts of the layout in one pass over their characters, without a row or a regular expression for each word.

A task reads Arrow batches, some megabytes of text at a time, and keeps what a query asks for: the tokens of its terms, the
units of the layout near them, and the words there. Texts that can't have such a token are left out by a regular expression
of Arrow before; where it only matters whether a text has a term, that is all there is to do.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Bytes of text that a task works on at a time; a longer document is a piece of its own.
PIECE = 1 << 18
HIT = "STRUCT<tok: STRING, pos: INT, start_off: BIGINT, end_off: BIGINT, box_seq: INT>"


@lru_cache(1)
def _letters() -> list[tuple[int, int]]:
    """The ranges of letters and numbers."""
    out = []
    for is_one, run in groupby(range(sys.maxunicode + 1), lambda c: unicodedata.category(chr(c))[0] in "LN"):
        if is_one:
            first = last = next(run)
            for last in run:
                pass
            out.append((first, last + 1))
    return out


@lru_cache(1)
def _forms() -> dict[str, list[str]]:
    """For characters in lower case, all others that they, or they among others, can come from."""
    out: dict[str, list[str]] = {"ς": ["Σ"]}
    for c in map(chr, range(sys.maxunicode + 1)):
        if (low := c.lower()) != c:
            for x in low:
                out.setdefault(x, []).append(c)
    return out


def _one_of(chars) -> str:
    return "[" + "".join(f"\\x{{{ord(c):x}}}" for c in chars) + "]"


def _sought(texts: list[str] | None) -> str | None:
    """A regular expression that is found in all texts with a token that ``texts``, with * and ?, stand for in lower case."""
    each = []
    for t in texts or ():
        part = max(t.split("*"), key=lambda x: len(x.replace("?", "")))
        if not part.strip("?"):
            return None
        each.append("".join("(?s:.)" if c == "?" else _one_of([c, *_forms().get(c, ())]) for c in part))
    # One character becomes two in lower case.
    return None if texts is None else "|".join([*each, _one_of("İ")])


def plain(term: str) -> bool:
    """Whether ``holding`` finds ``term``: letters and numbers up to U+00FF, in lower case, whose upper case is the same everywhere."""
    return bool(term) and term == term.lower() and all(c <= "ÿ" and unicodedata.category(c)[0] in "LN" for c in term)


def holding(docs: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id, term): which ``terms``, all of them ``plain``, are tokens in lower case of each of ``docs`` (doc_id, text); each once."""
    letters = "".join(f"\\x{{{a:x}}}-\\x{{{z - 1:x}}}" for a, z in _letters())
    form = lambda c: _one_of([c, *(x for x in _forms().get(c, ()) if x.lower() == c)])
    patterns = {t: rf"(?:\A|[^{letters}]){''.join(map(form, t))}(?:[^{letters}]|\z)" for t in terms}
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("term", T.StringType())])
    return docs.select("doc_id", "text").mapInArrow(_holding_task(patterns), schema)


def _holding_task(patterns):
    """The function of a task; it goes to workers by value."""

    def run(batches):
        import pyarrow.compute as pc

        for b in batches:
            texts = b.column(1)
            try:
                texts.validate(full=True)
            except pa.ArrowInvalid:  # what isn't UTF-8 is between words
                texts = pa.array([None if x is None else x.decode("utf-8", "replace") for x in texts.cast(pa.binary()).to_pylist()], pa.string())
            for t, pattern in patterns.items():
                ids = b.column(0).filter(pc.match_substring_regex(texts, pattern))
                if len(ids):
                    yield pa.RecordBatch.from_arrays([ids, pa.repeat(pa.scalar(t), len(ids))], ["doc_id", "term"])

    return run


def near(docs: DataFrame, wanted: Callable, size: int = 1, around: int = 0, units: bool = False, words: bool = False) -> DataFrame:
    """(doc_id, hits[, content, n, ids, starts, ends][, w_ids, ws, offs]) of ``docs`` (doc_id, text) that have a wanted token.

    ``wanted`` decides on tokens in lower case; those that it can want begin with one of its ``firsts`` and, of ASCII, have one
    of its ``lengths``, and what it ``sought`` is all that it can want, if these aren't None. Units have ``size`` words: their numbers, where they begin and end; and ``words``
    are those in units at most ``around`` units from a token: number, text and offset.
    """
    types = {"hits": f"ARRAY<{HIT}>"}
    if units:
        types |= {"content": "BIGINT", "n": "INT", "ids": "ARRAY<INT>", "starts": "ARRAY<BIGINT>", "ends": "ARRAY<BIGINT>"}
    if words:
        types |= {"w_ids": "ARRAY<INT>", "ws": "ARRAY<STRING>", "offs": "ARRAY<BIGINT>"}
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(k, T._parse_datatype_string(v)) for k, v in types.items())])
    return docs.select("doc_id", "text").mapInArrow(_task(wanted, size, around, units, words, PIECE, _letters(), *_before(wanted)), schema)


def _before(wanted: Callable) -> tuple[str | None, list[int] | None]:
    """What texts with a wanted token have in them, and the characters that such a token can begin with."""
    begins = None if wanted.firsts is None else sorted({ord(c) for f in wanted.firsts for c in (f, *_forms().get(f, ()))})
    return _sought(wanted.sought), begins


def _task(wanted, size, around, with_units, with_words, most, letters, pattern, first_chars):
    """The function of a task; it goes to workers by value, so that they needn't find this package."""

    def run(batches):
        import numpy as np
        import pyarrow.compute as pc

        kinds = np.zeros(0x110000, np.uint8)  # 1: between words, 2: of a token
        for a, z in letters:
            kinds[a:z] = 2
        kinds[[9, 10, 13, 32]] = 1
        known: dict[str, bool] = {}
        count = np.int64
        sizes = wanted.lengths
        begins = np.zeros(0x110000, bool)
        begins[first_chars or []] = True

        def asked(token):
            if token not in known:
                if len(known) > 1 << 18:
                    known.clear()
                known[token] = wanted(token.lower())
            return known[token]

        def summed(x):
            out = np.zeros(len(x) + 1, count)
            np.cumsum(x, out=out[1:])
            return out

        def lists(at, values):
            return pa.ListArray.from_arrays(pa.array(at, pa.int32()), values)

        def piece(ids, texts):
            raw = b"".join(texts)
            try:
                whole = raw.decode()
                chars = np.array([len(t) for t in texts] if whole.isascii() else [len(t.decode()) for t in texts], np.int64)
            except UnicodeDecodeError:
                parts = [t.decode("utf-8", "replace") for t in texts]
                whole, chars = "".join(parts), np.array([len(t) for t in parts], np.int64)
                raw = whole.encode()
            nonlocal count
            count = np.int32 if len(raw) < 1 << 30 else np.int64
            raw = np.frombuffer(raw, np.uint8)
            cp = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
            at = summed(chars)  # where each text begins
            kind = kinds[cp]
            blank, token = kind == 1, kind == 2
            width = np.ones(len(cp), np.uint8)
            if len(raw) > len(cp):
                width += (cp >= 0x80).view(np.uint8)
                width += (cp >= 0x800).view(np.uint8)
                width += (cp >= 0x10000).view(np.uint8)
            edge = np.zeros(len(cp) + 1, bool)  # a text begins here
            edge[at] = True
            starts_at = lambda of: np.flatnonzero(of & ~(np.concatenate([[False], of[:-1]]) & ~edge[:-1]))
            ends_at = lambda of: np.flatnonzero(of & ~(np.concatenate([of[1:], [False]]) & ~edge[1:])) + 1
            s, e, w = starts_at(token), ends_at(token), starts_at(~blank)
            size_at = summed(width)
            ink = summed(np.where(blank, 0, width))  # bytes of words before each character
            w_of, t_of = np.searchsorted(w, at), np.searchsorted(s, at)  # words, tokens before each text
            # Each distinct token is looked at once.
            n_bytes = size_at[e] - size_at[s]
            data = raw[token] if len(raw) == len(cp) else raw[np.repeat(token, width)]
            toks = pa.StringArray.from_buffers(len(s), pa.py_buffer(summed(n_bytes).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))
            may = np.ones(len(s), bool)
            if sizes is not None:
                may &= np.isin(n_bytes, sizes)
                if len(raw) > len(cp):
                    may |= n_bytes != e - s  # other letters may change in lower case
            if first_chars is not None:
                may &= begins[cp[s]]
            may = np.flatnonzero(may)
            coded = toks.take(pa.array(may)).dictionary_encode()
            good = np.fromiter(map(asked, coded.dictionary.to_pylist()), bool, len(coded.dictionary))
            hit = may[good[np.asarray(coded.indices)]] if len(good) else may
            if not len(hit):
                return None
            d = np.searchsorted(at, s[hit], "right") - 1  # the text of each hit
            box = np.searchsorted(w, s[hit], "right") - 1 - w_of[d]
            begin = ink[s[hit]] - ink[at[d]] + box
            per = np.bincount(d, minlength=len(texts))
            rows = np.flatnonzero(per)
            fields = [pa.field("tok", pa.string()), pa.field("pos", pa.int32()), pa.field("start_off", pa.int64()), pa.field("end_off", pa.int64()), pa.field("box_seq", pa.int32())]
            hits = pa.StructArray.from_arrays([toks.take(pa.array(hit)), pa.array(hit - t_of[d], pa.int32()), pa.array(begin, pa.int64()), pa.array(begin + n_bytes[hit], pa.int64()), pa.array(box, pa.int32())], fields=fields)
            out = [ids.take(pa.array(rows)), lists(summed(per[rows]), hits)]
            if not (with_units or with_words):
                return out
            n_words = np.diff(w_of)
            n_units = -(-n_words // size)
            u_of = summed(n_units)
            # Units near a hit: the marks where these begin and end are summed up over all units.
            near = np.zeros(u_of[-1] + 1, np.int64)
            np.add.at(near, u_of[d] + np.maximum(box // size - around, 0), 1)
            np.add.at(near, u_of[d] + np.minimum(box // size + around + 1, n_units[d]), -1)
            kept = np.flatnonzero(np.cumsum(near[:-1]) > 0)
            w_text = np.repeat(np.arange(len(texts)), n_words)
            off = ink[w] - ink[at[w_text]] + np.arange(len(w)) - w_of[w_text]
            content = ink[at[1:]] - ink[at[:-1]] + n_words
            if with_units:  # all of a text: their ordinals are then places in the arrays
                every = np.flatnonzero(np.repeat(np.bincount(d, minlength=len(texts)) > 0, n_units))
                of = np.searchsorted(u_of, every, "right") - 1
                number = every - u_of[of]
                per = np.bincount(of, minlength=len(texts))[rows]
                after = (number + 1) * size
                ends = np.where(after < n_words[of], off[np.minimum(w_of[of] + after, len(w) - 1)], content[of])
                out += [pa.array(content[rows], pa.int64()), pa.array(n_words[rows], pa.int32())]
                out += [lists(summed(per), pa.array(x, t)) for x, t in ((number, pa.int32()), (off[w_of[of] + number * size], pa.int64()), (ends, pa.int64()))]
            if with_words:
                here = np.zeros(u_of[-1], bool)
                here[kept] = True
                unit = u_of[w_text] + (np.arange(len(w)) - w_of[w_text]) // size
                k = np.flatnonzero(here[unit])
                z = ends_at(~blank)
                lengths = size_at[z[k]] - size_at[w[k]]
                marks = np.zeros(len(cp) + 1, np.int8)
                marks[w[k]] += 1
                np.add.at(marks, z[k], -1)
                chosen = np.cumsum(marks[:-1], dtype=np.int8) > 0
                data = raw[chosen] if len(raw) == len(cp) else raw[np.repeat(chosen, width)]
                text = pa.StringArray.from_buffers(len(k), pa.py_buffer(summed(lengths).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))
                per = summed(np.bincount(w_text[k], minlength=len(texts))[rows])
                out += [lists(per, pa.array(k - w_of[w_text[k]], pa.int32())), lists(per, text), lists(per, pa.array(off[k], pa.int64()))]
            return out

        names = ["doc_id", "hits", *(["content", "n", "ids", "starts", "ends"] if with_units else []), *(["w_ids", "ws", "offs"] if with_words else [])]
        for b in batches:
            if pattern is not None:
                b = b.filter(pc.match_substring_regex(b.column(1), pattern))
            bytes_of = pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False)
            total, k = 0, 0
            for i, n in enumerate(bytes_of.tolist()):
                total += n
                if total >= most or i == b.num_rows - 1:
                    texts = [x or b"" for x in b.column(1).slice(k, i + 1 - k).cast(pa.binary()).to_pylist()]
                    out = piece(b.column(0).slice(k, i + 1 - k), texts) if total else None
                    if out is not None:
                        yield pa.RecordBatch.from_arrays(out, names)
                    total, k = 0, i + 1

    return run
