"""Text columns: cleaning, tokens, titles, codes.  All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Hangul and ASCII letters, digits and ``_ . / + -``: the token alphabet.
TOKEN = r"([가-힣A-Za-z0-9_./+-]+)"
#: Course codes: two letters or more and three digits, bounded by non-alphanumerics.
CODE = r"(?:^|[^A-Za-z0-9])([A-Za-z]{2,}[0-9]{3})(?![A-Za-z0-9])"
#: Texts that stand for a missing value (trimmed, lower case).
MISSING = ("", "none", "null", "nan", "n/a", "no data", "no data.")


def clean_text(c: Column) -> Column:
    """Line feeds only, single blanks, at most one empty line in a row, no blanks around; null becomes empty."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"\r\n?", "\n")
    c = F.regexp_replace(c, r"[ \t]+", " ")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    return F.regexp_replace(c, r"^[ \t\n\f\r]+|[ \t\n\f\r]+$", "")


def clean_extracted(c: Column) -> Column:
    """Like ``clean_text`` for extracted files: no byte-order mark, control characters as blanks."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), "﻿", "")
    c = F.regexp_replace(F.regexp_replace(c, r"\r\n?", "\n"), r"[\x00-\x08\x0b\x0c\x0e-\x1f]", " ")
    c = F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\n[ \t\n]*\n[ \t\n]*\n", "\n\n")
    return F.regexp_replace(c, r"^[ \t\n]+|[ \t\n]+$", "")


def tokenize(c: Column) -> Column:
    """Lower-case tokens of two characters or more, in order, with repetitions; null gives none."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(TOKEN), F.lit(1))
    return F.filter(F.transform(found, F.lower), lambda t: F.length(t) >= 2)


def normalize_title(c: Column) -> Column:
    """Roman numerals spelled in letters, lower case, only ASCII letters, digits and Hangul kept."""
    for sign, letters in zip("ⅠⅡⅢⅣⅤ", ("I", "II", "III", "IV", "V")):
        c = F.replace(c, F.lit(sign), F.lit(letters))
    return F.regexp_replace(F.lower(c), r"[^0-9a-z가-힣]", "")


def normalize_name(c: Column) -> Column:
    """Letters and digits of any script, lower case."""
    return F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))


def normalize_question(c: Column) -> Column:
    """White space collapsed, lower case, closing punctuation off: the cache key of a question."""
    c = F.lower(F.regexp_replace(F.trim(F.regexp_replace(c, r"[ \t\n\f\r]+", " ")), r"[?!.,。！？]+$", ""))
    return F.trim(c)


def course_codes(c: Column) -> Column:
    """Upper-case course codes in order of first mention, each once."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(CODE), F.lit(1)), F.upper))


def missing(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit("")))).isin(*MISSING)


def canonical_credit(c: Column) -> Column:
    """``3.0`` as ``3``."""
    return F.regexp_replace(F.trim(c), r"\.0+$", "")


def bare_code(c: Column) -> Column:
    """A course code in one spelling: ASCII width, no blanks, upper case."""
    wide, narrow = "".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F)))
    return F.upper(F.regexp_replace(F.translate(c, wide, narrow), r"[ \t\n　 ]+", ""))


def zfill(c: Column, n: int) -> Column:
    """Zero-padded to ``n``; longer texts are not cut, as ``lpad`` would."""
    return F.when(F.length(c) < n, F.lpad(c, n, "0")).otherwise(c)


def excerpt(text: Column, needle: Column, size: int = 240) -> Column:
    """A window of ``size`` characters that begins a third before the first match; null without one."""
    at = F.instr(text, needle)
    begin = F.greatest(F.lit(1), at - F.lit(size // 3))
    body = F.substring(text, begin, F.lit(size))
    return F.when(at > 0, F.concat(F.when(begin > 1, F.lit("…")).otherwise(""), body, F.when(begin + size - 1 < F.length(text), F.lit("…")).otherwise("")))


def best_sentence(text: Column, tokens: Column, limit: int = 260) -> Column:
    """The first of the sentences that hold most of the distinct query tokens, cut to ``limit``."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"[.!?\n]+"), lambda s: F.regexp_replace(s, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")), lambda s: s != "")
    scored = F.transform(parts, lambda s, i: F.struct(F.size(F.filter(F.array_distinct(tokens), lambda t: F.contains(F.lower(s), t))).alias("hits"), (-i).alias("neg"), F.substring(s, 1, limit).alias("s")))
    return F.array_max(scored)["s"]


_UNDECIDED = r"(?iu)수업유형\s+(?:대면\s+대면\s+)?(?:비대면\s+비대면\s+)?(?:병행\(대면&비대면 동시\)\s+병행\(대면&비대면 동시\)\s+)?미정"
#: Fixed value: the sentence of an empty form, which says nothing of the course.
_NOT_ENTERED = r"평가방법이\s*입력\s*되지\s*않았습니다[.]?"


def without_checklists(c: Column) -> Column:
    """A cleaned text without its lists of activities, whatever is ticked in them, and without undecided class types."""
    c = F.regexp_replace(clean_text(c), r"(?isu)활동유형.*?(?=(?:▷\s*)?평가방법)", "")
    return clean_text(F.regexp_replace(c, _UNDECIDED, ""))


def without_empty_forms(c: Column) -> Column:
    """A text without the options of lists whose ticks are lost, undecided class types, and sentences of empty forms.

    A list that says what was selected stays.  Null becomes empty.
    """
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"\r\n?", "\n")
    c = F.regexp_replace(c, r"(?isu)활동유형(?!\s*선택 확인)(?:(?!선택 확인:).)*?(?=(?:▷\s*)?평가방법)", "")
    c = F.regexp_replace(F.regexp_replace(c, _UNDECIDED, ""), _NOT_ENTERED, "")
    c = F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


def similarity_key(c: Column) -> Column:
    """What two records' texts are compared by: without the paragraph in front, addresses of the web, white space and letter case."""
    c = F.coalesce(c, F.lit(""))
    body = F.when(F.contains(c, F.lit("\n\n")), F.substring(c, F.instr(c, F.lit("\n\n")) + 2, F.length(c))).otherwise(c)
    return F.lower(F.regexp_replace(F.regexp_replace(body, r"https?://[^\s]+", " "), r"\s+", ""))


def spaced_key(c: Column) -> Column:
    """Lower case, white space of any kind single, none around."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))


def file_stem(code: Column, class_no: Column, name: Column) -> Column:
    """``code_class_name`` with everything but letters, digits, Hangul and ``_.-`` in the name as ``_``; without the name where nothing of it is left."""
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), r"[^A-Za-z0-9가-힣_.-]+", "_"), r"^_+|_+$", "")
    stem = F.concat_ws("_", code, class_no)
    return F.when(plain != "", F.concat_ws("_", stem, plain)).otherwise(stem)


def attachment_link(page: Column) -> Column:
    """The first link of an HTML text that leads to a PDF or a download, its ampersands plain; null without one."""
    links = F.regexp_extract_all(F.coalesce(page, F.lit("")), F.lit(r"(?i)(?:href|src)\s*=\s*[\"']([^\"']+)[\"']"), F.lit(1))
    plain = F.transform(links, lambda x: F.replace(x, F.lit("&amp;"), F.lit("&")))
    return F.get(F.filter(plain, lambda x: F.lower(x).rlike("filedownloader|[.]pdf")), F.lit(0))


def in_scope(question: Column, year: int) -> Column:
    """Whether a question is about the collected year's regular first term: it names no other year and no other term."""
    q = F.lower(F.coalesce(question, F.lit("")))
    years = F.regexp_extract_all(q, F.lit(r"(20[0-9]{2})\s*학년도?"), F.lit(1))
    other = F.size(F.filter(years, lambda y: y != str(year))) > 0
    return ~other & ~q.rlike("2학기|여름학기|겨울학기|계절학기")


def meeting(value: Column, class_no: Column) -> Column:
    """A meeting as written (day, periods, place) as a struct with its periods as numbers and its clock range; null where it isn't one."""
    narrow = F.translate(value, "０１２３４５６７８９～〜∼–－（）", "0123456789~~~--()")
    pattern = r"^(?:([0-9]{1,4})\s*분반\s*)?([월화수목금토일])(?:요일)?\s*\(?\s*([0-9]{1,2})(?:\s*[-~]\s*([0-9]{1,2}))?\s*(?:교시)?\s*\)?\s*(?:\([0-9:~-]+\))?\s*[,·]?\s*(.*)$"
    got = lambda k: F.regexp_extract(narrow, pattern, k)
    start = got(3).try_cast("int")
    end = F.coalesce(got(4).try_cast("int"), start)
    day, room = got(2), F.trim(got(5))
    clock = lambda p, minutes: F.concat(zfill((8 + p).cast("string"), 2), F.lit(minutes))
    periods = F.when(start == end, start.cast("string")).otherwise(F.concat_ws("-", start.cast("string"), end.cast("string")))
    section = zfill(F.when(got(1) != "", got(1)).otherwise(F.coalesce(class_no, F.lit(""))), 2)
    display = F.concat(day, F.lit("요일 "), periods, F.lit("교시 ("), clock(start, ":00"), F.lit("-"), clock(end, ":50"), F.lit(")"), F.when(room != "", F.concat(F.lit(", "), room)).otherwise(""))
    return F.when(day != "", F.struct(section.alias("class_no"), day.alias("day"), F.concat(day, F.lit("요일")).alias("day_name"), start.alias("start_period"), end.alias("end_period"), periods.alias("periods"), clock(start, ":00").alias("start_time"), clock(end, ":50").alias("end_time"), room.alias("room"), display.alias("display")))


def canonical_json(value: Column, kind) -> Column:
    """A struct as JSON with the names of its fields in order at every level; null fields are left out."""
    from pyspark.sql.types import ArrayType, StructType

    def ordered(v: Column, k) -> Column:
        if isinstance(k, StructType):
            return F.when(v.isNotNull(), F.struct(*[ordered(v[f.name], f.dataType).alias(f.name) for f in sorted(k.fields, key=lambda f: f.name)]))
        if isinstance(k, ArrayType):
            return F.transform(v, lambda x: ordered(x, k.elementType))
        return v

    return F.to_json(ordered(value, kind))
