"""Several values packed in one field (problem 3).

A quote-aware finite-state tokenizer walks the special characters of a field and
keeps the open quotation mark, escapes and nesting depth.  A delimiter ends a value
only outside quotes and brackets and only where a new value (or nothing) follows,
so that commas, slashes and middle dots of a room name stay inside the value.
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.arrow import arrow_type, slices

_DAY = r"[월화수목금토일](?:요일)?"
_NUM = r"[0-9０-９]{1,2}"
_RANGE = rf"{_NUM}(?:\s*[-~∼～〜–－,]\s*{_NUM})*"
_MEETING = re.compile(rf"(?:[0-9０-９]{{1,4}}\s*분반\s*)?{_DAY}\s*(?:[(（]\s*{_RANGE}\s*(?:교시)?\s*[)）]|{_RANGE}(?:\s*교시)?)")
#: Quotation marks and the mark that closes each.
_QUOTES = {'"': '"', "'": "'", "“": "”", "‘": "’", "「": "」", "『": "』"}
_CLOSERS = frozenset(_QUOTES.values())
_OPEN, _CLOSE = "([{（", ")]}）"
_DELIM = re.compile(r"<br\s*/?>|//|[|｜/／;；、，,\n\r\t&＆·ㆍ+]", re.I)
_SPECIAL = re.compile(r"<br\s*/?>|//|[|｜/／;；、，,\n\r\t&＆·ㆍ+\"'“”‘’「」『』\\()\[\]{}（）]", re.I)
_SKIP = re.compile(r"(?:\s|<br\s*/?>|[|｜/／;；、，,&＆·ㆍ+])*", re.I)


class _Ahead:
    """What follows a place of a text: whether a value, quoted or not, or the end does.

    The answer is the same anywhere in a run of blanks and delimiters, so each run is read once.
    """

    def __init__(self, text: str, head: re.Pattern):
        self.text, self.head, self.begin, self.end, self.known = text, head, 0, -1, False

    def starts_value(self, at: int) -> bool:
        if not self.begin <= at <= self.end:
            self.begin, self.end = at, _SKIP.match(self.text, at).end()
            self.known = self._value(self.end)
        return self.known

    def _value(self, at: int) -> bool:
        if at >= len(self.text):
            return True
        if self.text[at] in _QUOTES:
            at = _space(self.text, at + 1)
        return self.head.match(self.text, at) is not None


def tokenize(text: str, head: re.Pattern = _MEETING, inner_quotes: bool = True) -> list[str]:
    """The values of ``text`` in order; values are stripped and unquoted, empty places are left out.

    A text whose quotes or brackets stay open is read once more from there, with
    quotation marks and brackets inside values as ordinary characters.  Linear: a place
    from which a quotation mark was found never to close is not walked again.
    """
    out: list[str] = []
    ahead = _Ahead(text, head)
    open_from: dict[str, bytearray] = {}  # by closing mark: places from which it never comes
    i, n = 0, len(text)
    while i < n:
        i = _SKIP.match(text, i).end()
        if i >= n:
            break
        start, buf = i, []
        close = _QUOTES.get(text[i])
        if close:  # quoted value
            j, walked, never = i + 1, [], open_from.setdefault(close, bytearray(n + 2))
            while j < n and not never[j]:
                walked.append(j)
                c = text[j]
                if c == "\\" and j + 1 < n:
                    buf.append(text[j + 1])
                    j += 2
                elif c == close:
                    if close in "\"'" and text[j + 1 : j + 2] == close:
                        buf.append(close)
                        j += 2
                    elif (rest := _DELIM.match(text, after := _space(text, j + 1))) or after >= n or ahead.starts_value(j + 1):
                        j = rest.start() if rest else j + 1
                        break
                    else:
                        buf.append(c)
                        j += 1
                else:
                    buf.append(c)
                    j += 1
            else:
                close = None  # never closed: an ordinary character
                for k in walked:
                    never[k] = 1
            if close:
                out.append("".join(buf).strip())
                i = j
                continue
            if head.match(text, _space(text, i + 1)):
                start = i = i + 1
        depth, inner = 0, ""
        at = i
        end = n
        while m := _SPECIAL.search(text, at):
            c = m.group()
            at = m.end()
            if c == "\\":
                at += 1
            elif inner:
                if c == inner:
                    inner = ""
            elif c in _OPEN and inner_quotes:
                depth += 1
            elif c in _CLOSE:
                depth = max(0, depth - 1)
            elif c in _QUOTES or c in _CLOSERS:
                if inner_quotes and c in _QUOTES:
                    inner = _QUOTES[c]
            elif depth == 0 and ahead.starts_value(at):
                end = m.start()
                break
        if (inner or depth) and end == n and inner_quotes and len(head.findall(text[start:])) > 1:
            return out + tokenize(text[start:], head, inner_quotes=False)
        out.append(text[start:end].strip())
        i = end
    return [v for v in out if v]


def _space(text: str, i: int) -> int:
    while i < len(text) and text[i].isspace():
        i += 1
    return i


def _objects(text: str) -> list[str]:
    """The complete ``{...}`` objects of a text at their outermost level, by nesting depth and quotes."""
    out, depth, quote, begin, i, n = [], 0, "", 0, 0, len(text)
    while i < n:
        c = text[i]
        if quote:
            if c == "\\":
                i += 1
            elif c == quote:
                quote = ""
        elif c in "\"'" and depth:
            quote = c
        elif c == "{":
            if not depth:
                begin = i
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if not depth:
                out.append(text[begin : i + 1])
        i += 1
    return out


def _decoded(text: str):
    try:
        return json.loads(text)
    except ValueError:
        pass
    if text[0] in "\"'" and text[0] * 2 in text:
        return None  # doubled marks of a quoted value, which a literal would read as two texts
    try:
        return ast.literal_eval(text)
    except (ValueError, SyntaxError, MemoryError, RecursionError, TypeError):
        return None


def displays(text: str, key: str = "display", depth: int = 0) -> list[str]:
    """The ``key`` texts of a JSON field, after undoing the notation around them.

    Understood: an array of objects or of texts, one object, JSON that is itself a
    JSON text, single-quoted literals, objects or quoted texts set in a row with any
    delimiter, and arrays that break off (their complete objects count).
    """
    text = text.strip()
    if not text or depth > 4:
        return []
    if text[0] in "\"'" and text[0] * 2 in text and text[-1] == text[0] and text[1:].lstrip()[:1] in ("[", "{"):
        return displays(text[1:-1].replace(text[0] * 2, text[0]), key, depth + 1)
    value = _decoded(text) if text[0] in "[{\"'" else None
    if isinstance(value, str):
        return displays(value, key, depth + 1)
    if isinstance(value, dict):
        value = [value]
    if isinstance(value, (list, tuple)):
        out = []
        for x in value:
            if isinstance(x, dict):
                out.append(x.get(key))
            elif isinstance(x, str):
                out += displays(x, key, depth + 1) or [x]
        return [x.strip() for x in out if isinstance(x, str) and x.strip()]
    if "{" in text:
        out = [_decoded(x) for x in _objects(text)]
        found = [x[key].strip() for x in out if isinstance(x, dict) and isinstance(x.get(key), str) and x[key].strip()]
        if found or text[0] not in "\"'":
            return found
        return displays(text.strip("\"'").replace('\\"', '"').replace('""', '"'), key, depth + 1)
    return tokenize(text)


@lru_cache(maxsize=50_000)
def meetings(text: str, is_json: bool) -> tuple[str, ...]:
    """The meetings of one field, in order."""
    values = displays(text) if is_json else tokenize(text)
    return tuple(v for v in values if _MEETING.match(v))


def split_packed(df: DataFrame, key: str, fields: dict[str, bool], min_values: int = 2) -> DataFrame:
    """One row per value of each packed field: ``key, field_name, pos, value``.

    ``fields`` maps a field to whether it holds JSON.  Nulls, empty texts and fields
    with fewer than ``min_values`` values give no row; repeated values keep their
    places; a text of any length is walked once; other columns are ignored.
    Narrow: no shuffle.
    """
    schema = f"{key} {df.schema[key].dataType.simpleString()}, field_name string, pos int, value string"
    target = pa.schema([(key, arrow_type(df, key)), ("field_name", pa.string()), ("pos", pa.int32()), ("value", pa.string())])
    names = list(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            keys, ids, fs, ps, vs = b.column(0).to_pylist(), [], [], [], []
            for k, f in enumerate(names):
                for id_, text in zip(keys, b.column(k + 1).to_pylist()):
                    if text and len(got := meetings(text, fields[f])) >= min_values:
                        ids += [id_] * len(got)
                        fs += [f] * len(got)
                        ps += range(1, len(got) + 1)
                        vs += got
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip((ids, fs, ps, vs), target)], schema=target)

    return df.select(F.col(key), *[F.col(f).cast("string") for f in names]).mapInArrow(run, schema)
