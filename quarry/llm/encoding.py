"""Garbled text from wrong character encoding (problem 4).

Round-trip repair: a stretch of characters is encoded again under the encoding it was
wrongly read with and strictly decoded as the intended one; the result is accepted when
a garbling cost drops, and the step is repeated for nested layers.  Strict decoding is
what separates garbled stretches from foreign words: ``São`` or ``论语`` re-encoded are
no valid UTF-8.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.arrow import arrow_type, slices

#: Bytes that cp1252 leaves undefined are read as C1 controls by lenient readers.
_WESTERN = {chr(b): b for b in range(0x80, 0x100)}
for _b in range(0x80, 0xA0):
    try:
        _WESTERN[bytes([_b]).decode("cp1252")] = _b
    except UnicodeDecodeError:
        pass
#: Encodings a reader may have used for bytes that were UTF-8.
_READ_AS = ("mac_roman", "cp949", "cp932", "gbk", "big5", "euc_jp", "cp437", "cp850", "koi8_r", "cp1251", "iso8859_2", "iso8859_15", "cp1250")
_WEST_RUN = re.compile("[" + re.escape("".join(_WESTERN)) + "]+")
_RUN = re.compile(r"[^\x00-\x7f]+")
_HAN = re.compile(r"[㐀-鿿]{2,}")
_LOST = re.compile(r"[�\x80-\x84\x86-\x9f﷐-﷯\U00040000-\U000dffff]")
#: The syllables of KS X 1001: what people write, as against what wrong decoding yields.
_KSX = frozenset(bytes((a, b)).decode("euc_kr") for a in range(0xB0, 0xC9) for b in range(0xA1, 0xFF))
#: Lines without any such character are passed by: everything but ASCII, common syllables, jamo, kana, wide forms and plain signs.
_ODD = re.compile("[^\\x00-\\x7f" + "".join(sorted(_KSX)) + "\u1100-\u11ff\u3000-\u3002\u3041-\u30ff\uff01-\uff5e\u200b-\u200f\u2060\ufeff\xa0\u2000-\u200a▷▶■※▸▲…☎]")


def _western_bytes(run: str) -> bytes | None:
    try:
        return bytes(_WESTERN[c] for c in run)
    except KeyError:
        return None


def _strict(data: bytes | None, encoding: str) -> str | None:
    if data is None:
        return None
    try:
        return data.decode(encoding)
    except UnicodeDecodeError:
        return None


def _common_hangul(ch: str) -> bool:
    return ch in _KSX


def cost(text: str) -> float:
    """How garbled a text looks: high for lost characters, controls, symbols among letters and rare syllables."""
    total = 0.0
    for ch in text:
        o = ord(ch)
        if o < 0x80:
            continue
        if "가" <= ch <= "힣":
            total += 0.1 if _common_hangul(ch) else 1.2
        elif o == 0xFFFD or 0xE000 <= o < 0xF900:
            total += 4
        elif 0x80 <= o < 0xA0:
            total += 3
        elif o < 0x250 or ch in _WESTERN:
            total += 1
        else:
            category = unicodedata.category(ch)
            total += 3 if category == "Cn" else 0.7 if category in ("Lo", "Lm") else 0.6
    return total


def _plausible(text: str) -> bool:
    """Every character is one that people write: no control, private or unassigned one."""
    return all(c in "\t\n\r" or unicodedata.category(c) not in ("Cc", "Cn", "Co", "Cs") or "\x80" <= c < "\xa0" for c in text)


def _utf8_run(run: str) -> str | None:
    """The run's text if it was UTF-8 read as something else."""
    if (got := _strict(_western_bytes(run), "utf-8")) and _plausible(got) and cost(got) < cost(run):
        return got
    for encoding in _READ_AS:
        try:
            data = run.encode(encoding)
        except UnicodeEncodeError:
            continue
        got = _strict(data, "utf-8")
        # A lone two-byte sequence of letters is too weak a sign: real words re-encode to one by chance.
        if got and (len(data) > 2 or not run.isalpha()) and len(got) < len(data) and all(ord(c) > 0x7F for c in got) and _plausible(got) and cost(got) < cost(run):
            return got
    return None


def _korean_run(run: str) -> str | None:
    """The run's text if it was cp949 read as a Western encoding.

    Accepted for two syllables or more, or for one whose characters are not both letters.
    """
    data = _western_bytes(run)
    if data is None or len(data) % 2 or len(data) < 2:
        return None
    got = _strict(data, "cp949")
    if not got or not any(map(_common_hangul, got)) or cost(got) >= cost(run):
        return None
    hangul = sum(map(_common_hangul, got))
    if hangul * 2 < len(got) or (len(got) == 1 and all(c.isalpha() for c in run)):
        return None
    return got


def _ascii_pairs(run: str) -> str | None:
    """The run's text if it was ASCII read as UTF-16."""
    for encoding in ("utf-16-le", "utf-16-be"):
        data = run.encode(encoding)
        if all(0x20 <= b < 0x7F for b in data) and sum(chr(b).isalnum() or b == 0x20 for b in data) == len(data):
            return data.decode("ascii")
    return None


def _utf8_line(line: str, run: re.Pattern) -> str:
    return run.sub(lambda m: _utf8_run(m.group()) or m.group(), line)


def _korean_line(line: str) -> str:
    """Once one run is surely cp949 (and no UTF-8), its neighbours on the line are read as cp949 too."""
    if not any(_korean_run(m.group()) and _strict(_western_bytes(m.group()), "utf-8") is None for m in _WEST_RUN.finditer(line)):
        return line
    got = _WEST_RUN.sub(lambda m: _strict(_western_bytes(m.group()), "cp949") or m.group(), line)
    # Trail bytes of cp949 may be ASCII letters: then the line as a whole is decoded.
    whole = _strict(_mixed_bytes(line), "cp949")
    return whole if whole and cost(whole) < cost(got) else got


def _step(line: str) -> str:
    """One layer of repair of a line: the reading that leaves it least garbled."""
    best = min((line, _utf8_line(line, _WEST_RUN), _utf8_line(line, _RUN), _korean_line(line)), key=cost)
    return best if best != line else _HAN.sub(lambda m: _ascii_pairs(m.group()) or m.group(), line)


def _mixed_bytes(line: str) -> bytes | None:
    try:
        return bytes(ord(c) if ord(c) < 0x80 else _WESTERN[c] for c in line)
    except KeyError:
        return None


def repair_line(line: str, layers: int = 4) -> tuple[str, bool]:
    """A line's repaired form, and whether it is a case.

    A line is a case if a layer could be undone or if a character was lost on decoding.
    """
    lost = bool(_LOST.search(line))
    now = line
    for _ in range(layers):
        if (got := _step(now)) == now:
            break
        now = got
    return now, lost or now != line


@lru_cache(maxsize=20_000)
def _cached(line: str) -> tuple[str, bool]:
    return repair_line(line)


def repair_text(text: str) -> tuple[str, bool, bool]:
    """The repaired text, whether it is a case, whether something stays lost."""
    if not _ODD.search(text):
        return text, False, False
    out, case = [], False
    for line in text.split("\n"):
        if not _ODD.search(line):
            out.append(line)
        else:
            got, hit = _cached(line)
            case |= hit
            out.append(got)
    fixed = "\n".join(out)
    return fixed, case, bool(_LOST.search(fixed))


def repair_encoding(df: DataFrame, key: str, fields: list[str], only_cases: bool = True) -> DataFrame:
    """One row per garbled field: ``key, field_name, repaired, lost``.

    ``lost`` tells that characters remain that no encoding brings back.  Null, empty and
    plain fields give no row unless ``only_cases`` is off (then null stays null); texts of
    any length are read whole; other columns are ignored.  Narrow: no shuffle.
    """
    kind = df.schema[key].dataType.simpleString()
    target = pa.schema([(key, arrow_type(df, key)), ("field_name", pa.string()), ("repaired", pa.string()), ("lost", pa.bool_()), ("is_case", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            keys, rows = b.column(0).to_pylist(), []
            for k, f in enumerate(fields):
                for id_, text in zip(keys, b.column(k + 1).to_pylist()):
                    fixed, case, lost = repair_text(text) if text else (text, False, False)
                    if case or not only_cases:
                        rows.append((id_, f, fixed, lost, case))
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows) if rows else [[]] * 5, target)], schema=target)

    return df.select(F.col(key), *[F.col(f).cast("string") for f in fields]).mapInArrow(run, f"{key} {kind}, field_name string, repaired string, lost boolean, is_case boolean")
