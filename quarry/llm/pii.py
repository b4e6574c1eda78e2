"""Personal information inside free text (problem 5).

Offset-preserving deobfuscation: transducers rewrite wide and look-alike characters,
invisible characters, spelled digits and at/dot disguises while they keep, for every
character written, the span of the source it came from.  Identifiers are detected in
the rewritten text; their spans are mapped back and replaced in the source.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from urllib.parse import unquote_plus

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.arrow import arrow_type, slices

TYPES = ("email", "phone", "id_number", "address", "person_name")
PLACEHOLDERS = {t: f"[{t.upper()}]" for t in TYPES}

# --- transducers -------------------------------------------------------------------

_LOOK = dict(zip("АВЕКМНОРСТХаеорсухіѕјΑΒΕΖΗΙΚΜΝΟΡΤΥΧο", "ABEKMHOPCTXaeopcyxisjABEZHIKMNOPTYXo"))
_ONE = {i: i - 0xFEE0 for i in range(0xFF01, 0xFF5F)} | {ord(k): v for k, v in _LOOK.items()}
_ONE |= dict.fromkeys(map(ord, "              　"), " ")
_ONE |= dict.fromkeys(map(ord, "‐‑‒–—−﹣"), "-") | {ord("。"): ".", ord("․"): ".", ord("∼"): "~"}
_INVISIBLE = re.compile("[­​-‏‪-‮⁠-⁤﻿]+")
_DIGITS = dict(zip("영공일이삼사오육륙칠팔구", "001234566789"))
_WORDS = {w: str(i) for i, w in enumerate("zero one two three four five six seven eight nine".split())} | {"oh": "0"}
_KO_DIGIT = "[" + "".join(_DIGITS) + "]"
_SPELLED = re.compile(rf"{_KO_DIGIT}{{2,4}}(?:[-. ]{_KO_DIGIT}{{3,4}}){{1,2}}(?!{_KO_DIGIT})|(?<![가-힣])[공영]{_KO_DIGIT}{{8,10}}(?![가-힣])")
_SPELLED_EN = re.compile(rf"\b(?:{'|'.join(_WORDS)})(?:[ -](?:{'|'.join(_WORDS)})){{6,}}\b", re.I)
_AT = re.compile(r"[ \t]*[(\[{<][ \t]*(?:at|골뱅이|@|앳)[ \t]*[)\]}>][ \t]*|[ \t]*골뱅이[ \t]*|(?<=[A-Za-z0-9])[ \t]+@[ \t]*(?=[A-Za-z0-9])|(?<=[A-Za-z0-9])@[ \t]+(?=[A-Za-z0-9-]+\.)|[ \t]+at[ \t]+(?=[A-Za-z0-9-]+[ \t]+dot[ \t])", re.I)
_DOT = re.compile(r"[ \t]*[(\[{][ \t]*(?:dot|점|닷|\.)[ \t]*[)\]}][ \t]*|(?<=[A-Za-z0-9])[ \t]+(?:dot|점|닷)[ \t]+(?=[A-Za-z])", re.I)


class Mapped:
    """A rewritten text with, per piece, where its source began and ended."""

    __slots__ = ("text", "cuts", "spans")

    def __init__(self, text: str):
        # cuts: begins of pieces in the text; spans: (source begin, source end, copied one to one)
        self.text, self.cuts, self.spans = text, [0], [(0, len(text), True)]

    def source(self, begin: int, end: int) -> tuple[int, int]:
        """The source span of ``text[begin:end]``."""
        i, j = bisect_right(self.cuts, begin) - 1, bisect_right(self.cuts, end - 1) - 1
        a, b = self.spans[i], self.spans[j]
        return (a[0] + begin - self.cuts[i] if a[2] else a[0]), (b[0] + end - self.cuts[j] if b[2] else b[1])

    def rewrite(self, pattern: re.Pattern, put) -> None:
        """Replace every match; ``put`` gives the new text of a match."""
        found = list(pattern.finditer(self.text))
        if not found:
            return
        text, cuts, spans, at, size = [], [], [], 0, 0

        def copy(begin: int, end: int) -> None:
            nonlocal size
            while begin < end:
                i = bisect_right(self.cuts, begin) - 1
                stop = min(end, self.cuts[i + 1] if i + 1 < len(self.cuts) else len(self.text))
                a = self.spans[i]
                text.append(self.text[begin:stop])
                cuts.append(size)
                spans.append((a[0] + begin - self.cuts[i], a[0] + stop - self.cuts[i], True) if a[2] else a)
                size += stop - begin
                begin = stop

        for m in found:
            copy(at, m.start())
            new = put(m)
            if new:
                text.append(new)
                cuts.append(size)
                spans.append((*self.source(m.start(), m.end()), False))
                size += len(new)
            at = m.end()
        copy(at, len(self.text))
        self.text = "".join(text)
        self.cuts, self.spans = (cuts, spans) if cuts else ([0], [(0, 0, True)])


def deobfuscate(text: str) -> Mapped:
    """The transducers, one after the other."""
    m = Mapped(text if text.isascii() else text.translate(_ONE))
    if not text.isascii():
        m.rewrite(_INVISIBLE, lambda x: "")
        m.rewrite(_SPELLED, lambda x: "".join(_DIGITS.get(c, c) for c in x.group()))
    m.rewrite(_SPELLED_EN, lambda x: "".join(_WORDS[w.lower()] for w in re.split("[ -]", x.group())))
    m.rewrite(_AT, lambda x: "@")
    if "@" in m.text:
        m.rewrite(_DOT, lambda x: ".")
    return m


# --- detectors, over the rewritten text --------------------------------------------

_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])(?:mailto:)?[A-Za-z0-9_](?:[A-Za-z0-9._%+'-]{0,63})@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,62})\.)+[A-Za-z]{2,24}(?![A-Za-z0-9])")
_GROUP = re.compile(r"[0-9]+")
_GAP = re.compile(r"\)?[ .\t-]{0,6}\(?")

#: Fixed values of the public numbering plan, without the trunk 0: prefixes whose numbers have seven or eight more digits.
AREA_CODES = ("2", "31", "32", "33", "41", "42", "43", "44", "51", "52", "53", "54", "55", "61", "62", "63", "64")
MOBILE_CODES = ("10", "11", "16", "17", "18", "19")
SERVICE_CODES = ("70", "80", "50", *(f"50{d}" for d in range(10)))
_LOCAL = frozenset((*AREA_CODES, *MOBILE_CODES, *SERVICE_CODES))
_ABROAD = frozenset((*AREA_CODES, *MOBILE_CODES, "70"))  # what can be called from abroad
COUNTRY = "82"


def _by_plan(rest: str, codes: frozenset[str], at: int, cuts: set[int]) -> bool:
    """``rest`` is a code and seven or eight digits, written apart only behind the code and before the last four."""
    end = at + len(rest)
    return any(rest[:k] in codes and len(rest) - k in (7, 8) and cuts <= {at, at + k, end - 4} for k in (1, 2, 3))


def _is_phone(number: str, cuts: set[int], abroad: bool) -> bool:
    """Whether digits, with the places where they are written apart, make a number of the plan or of another country."""
    if abroad or number.startswith("00"):
        skip = 0 if abroad else 2
        if number.startswith(COUNTRY, skip):
            at = skip + len(COUNTRY)
            trunk = at + number.startswith("0", at)
            return _by_plan(number[trunk:], _ABROAD, trunk, cuts - {skip, at})
        n = len(number) - skip
        return any(c + a + m + 4 == n and cuts <= {skip, skip + c, skip + c + a, skip + c + a + m} for c in (1, 2, 3) for a in (2, 3, 4) for m in (3, 4))
    return number.startswith("0") and _by_plan(number[1:], _LOCAL, 1, cuts - {1})


def _phones(t: str, groups: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    """Phone numbers among the groups of digits of a text: neighbours that, together, the numbering plan knows."""
    out, last = [], 0
    for i, (begin, _) in enumerate(groups):
        at = begin
        while at > last and t[at - 1] in "(+":
            at -= 1
        label = re.search(r"(?i)tel:[ \t]*\Z", t[max(last, at - 8) : at])
        at -= len(label.group()) if label else 0
        if begin < last or (at and t[at - 1].isascii() and t[at - 1].isalnum()) or (at > 1 and t[at - 1] in "-.," and "0" <= t[at - 2] <= "9"):
            continue
        opening = t[at:begin].lower().lstrip("tel: \t")
        if opening not in ("", "(", "+", "+("):
            continue
        number, cuts = "", set()
        for k in range(i, min(i + 6, len(groups))):
            b, e = groups[k]
            if k > i:
                gap = t[groups[k - 1][1] : b]
                if not _GAP.fullmatch(gap):
                    break
                cuts.add(len(number))
            number += t[b:e]
            if len(number) > 17:
                break
            american = opening == "(" and k == i + 2 and [y - x for x, y in groups[i : k + 1]] == [3, 3, 4] and t[groups[i][1]] == ")" and gap in (".", "-")
            if len(number) >= 9 and (american or _is_phone(number, cuts, "+" in opening)) and not re.match("-[0-9]", t[e : e + 2]):
                out.append((at, e, "phone"))
                last = e
                break
    return out


#: The words of labels that numbers of persons stand behind, in order; blanks and hyphens may part them.
ID_LABELS = (
    *((who, what) for who in ("student", "staff", "user", "employee", "member") for what in ("id", "no", "number")),
    ("std_id",), ("sid",), ("rrn",), ("passport", "number"), ("passport", "no"), ("passport",),
    ("학번",), ("사번",), ("교번",), ("교직원", "번호"), ("직원", "번호"), ("학생", "번호"), ("주민", "등록", "번호"), ("주민", "번호"), ("외국인", "등록", "번호"), ("식별", "번호"), ("여권", "번호"),
)
_LABELLED = re.compile(r"(?i)(?<![A-Za-z])(?:" + "|".join(r"[ \t_-]*".join(map(re.escape, words)) for words in ID_LABELS) + r")[ \t]*\.?[ \t]*[:=#]?[ \t]*(?P<prefix>[A-Za-z]{0,2}-?)(?=[0-9])")
_DASH = re.compile(r"[ \t]*-[ \t]*")
_WEIGHTS = (2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5)


def _resident(number: str) -> bool:
    """Thirteen digits that begin with a date of birth and a mark of the century."""
    return number[2:4] in _MONTHS and number[4:6] in _DAYS and number[6] in "12345678"


_MONTHS = frozenset(f"{m:02}" for m in range(1, 13))
_DAYS = frozenset(f"{d:02}" for d in range(1, 32))


def _checked(number: str) -> bool:
    """The last digit agrees with the others, as those of resident numbers do."""
    total = sum(w * int(d) for w, d in zip(_WEIGHTS, number))
    return (11 - total % 11) % 10 == int(number[12])


def _id_numbers(t: str, groups: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    """Numbers behind a label, and resident numbers: with their hyphen, or in one piece if the check digit agrees."""
    out = []
    of = {b: k for k, (b, _) in enumerate(groups)}

    def pair(k: int) -> int | None:
        """The end of six and seven digits with a hyphen between."""
        if k + 1 < len(groups) and groups[k][1] - groups[k][0] == 6 and groups[k + 1][1] - groups[k + 1][0] == 7 and _DASH.fullmatch(t[groups[k][1] : groups[k + 1][0]]):
            return groups[k + 1][1]

    for m in _LABELLED.finditer(t):
        k = of.get(m.end())
        if k is not None and (end := None if m["prefix"] else pair(k)):
            out.append((m.end(), end, "id_number"))
        elif k is not None and 5 <= groups[k][1] - groups[k][0] <= 13:
            out.append((m.start("prefix"), groups[k][1], "id_number"))
    for k, (b, e) in enumerate(groups):
        free = not b or not (t[b - 1].isascii() and t[b - 1].isalnum() or t[b - 1] == "-")
        if free and (end := pair(k)) and _resident(t[b:e] + t[groups[k + 1][0] : end]):
            out.append((b, end, "id_number"))
        elif free and e - b == 13 and _resident(t[b:e]) and _checked(t[b:e]):
            out.append((b, e, "id_number"))
    return out


_ZIP = r"(?:\(?\d{5}\)?[ \t]+)?"
_REGION = r"(?:[가-힣]{1,6}(?:특별자치시|특별자치도|특별시|광역시|시|도)[ \t]+)?[가-힣]{1,6}(?:시|군|구)[ \t]+(?:[가-힣]{1,6}(?:구|읍|면)[ \t]+)?"
_DETAIL = r"(?:[ \t]*,?[ \t]*(?:\([가-힣A-Za-z0-9 ]{2,30}\)|\d{1,4}동(?:[ \t]+\d{1,5}호)?|\d{1,3}층|\d{1,5}호|[가-힣]{2,8}(?:아파트|빌라|빌딩|오피스텔)))*"
_ADDRESS = re.compile(
    rf"(?<![가-힣0-9]){_ZIP}(?:{_REGION}(?:[가-힣0-9]{{1,8}}(?:대로|로|길)[ \t]*\d{{1,4}}(?:-\d{{1,4}})?(?:번길[ \t]*\d{{1,4}}(?:-\d{{1,4}})?)?(?!\d*(?:명|회|개|주|시간|교시|%))"
    rf"|(?:[가-힣0-9]{{1,8}}(?:읍|면|동|리|가)[ \t]*){{1,2}}(?:산[ \t]*)?\d{{1,5}}(?:-\d{{1,4}})?(?:번지)?(?![0-9가-힣]))"
    rf"|[가-힣0-9]{{1,8}}(?:로|길)[ \t]*\d{{1,4}}(?:번길[ \t]*\d{{1,4}}|-\d{{1,4}}(?=[ \t]*[,(])|(?=[ \t]*,?[ \t]*(?:\([가-힣]+(?:빌라|아파트|빌딩|오피스텔)|\d+동[ \t]+\d+호)))"
    rf"|(?:[가-힣]{{1,6}}(?:읍|면|동|리)[ \t]*){{1,2}}(?:산[ \t]*)?\d{{1,5}}(?:-\d{{1,4}})?번지){_DETAIL}"
    r"|(?<![A-Za-z0-9])\d{1,4}(?:-\d{1,4})?,?[ \t]+[A-Z][A-Za-z]{1,20}-?(?:daero|ro|gil|beon-gil)\b(?:[ \t]*\d{1,4}-gil)?(?:,?[ \t]+[A-Z][A-Za-z]+(?:-(?:gu|si|do|gun|dong|eup|myeon))?){0,4}(?:,?[ \t]+\d{5})?"
    r"|(?<![A-Za-z0-9])\d{1,5}[ \t]+(?:[A-Z][a-z]+[ \t]+){1,3}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Boulevard|Blvd|Drive|Dr)\b\.?(?:,[ \t]*[A-Z][A-Za-z ]{2,30})?(?:[ \t]+\d{5})?"
)

#: Frequent Korean family names.
_SURNAMES = "김이박최정강조윤장임한오서신권황안송류전홍고문양손배백허유남심노하곽성차주우구민진지엄채원천방공현함변염여추도소석선설마길연위표명기반왕금옥육인맹제모탁국은편용예경봉"
#: Words that begin like a name and stand where a name may stand.
_NO_NAMES = frozenset("이메일 연구실 이름은 추후공 전화는 문의는 한국어 정보학 이론과 공지사 안내문 인원은 성적은 지원자 전임교 현직자 조교는 조교가 주임교 지도교 전담교 선택과 한학기 이번학 연락처 문의처 성명은 전공과 임용된 미지정 공석임 진행은 신청은".split())
_KO_NAME = rf"(?:(?:남궁|황보|제갈|사공|선우|서문|독고)[가-힣]{{1,2}}|[{_SURNAMES}][가-힣]{{2}})"
_EN_NAME = r"(?:[A-Z][a-z]+,[ \t]?[A-Z][a-z]+(?:-[A-Za-z][a-z]+)?|[A-Z][a-z]+(?:-[A-Za-z][a-z]+)?(?:[ \t]+[A-Z]\.)?(?:[ \t]+[A-Z][a-z]+){1,2})"
_NAME = rf"(?P<n>{_KO_NAME}(?=[^가-힣]|에게|에게서|께|$|[ \t]*(?:교수|강사|조교|선생|박사|튜터|님|씨))|{_EN_NAME})"
_LABEL_COLON = r"(?:담당[ \t]*)?(?:교수(?:명|자|진)?|교원|강사(?:명)?|조교|튜터|작성자|담당자|책임자|대표|이름|성명|멘토|연락|문의|Instructor|Professor|Lecturer|Teacher|Tutor|Contact|Author|Name|TA|Mentor|Advisor)"
_LABEL_BARE = r"(?:교수|강사|조교|튜터|작성자|담당자|대표|문의|상담은|Instructor|Professor|Lecturer|Teaching assistant|Tutor|TA|Ask|Prof\.|Dr\.|Mr\.|Ms\.|Mrs\.)"
_TITLE = r"(?:[ \t]*\((?:조교|교수|강사|튜터|tutor|TA|instructor|lecturer|teaching assistant)\)|[ \t]*(?:교수님?|강사님?|조교님?|선생님?|박사님?|튜터|멘토)(?![가-힣]{2}))"
_NAMES = (
    re.compile(rf"(?<![가-힣A-Za-z]){_LABEL_COLON}[ \t]*[:=-][ \t]*{_NAME}"),
    re.compile(rf"(?<![A-Za-z]){_LABEL_BARE}[ \t]+{_NAME}"),
    re.compile(rf"(?<![가-힣A-Za-z])(?P<n>{_KO_NAME}|{_EN_NAME}){_TITLE}"),
)
_BEFORE_EMAIL = re.compile(rf"(?<![가-힣A-Za-z])(?P<n>{_KO_NAME}|{_EN_NAME})[ \t]*[(<\[,][ \t]*$")
_NAME_HINT = re.compile(r"교수|교원|강사|조교|튜터|작성자|담당자|책임자|대표|이름|성명|멘토|문의|상담은|연락|선생|박사|[Ii]nstructor|[Pp]rof|[Ll]ecturer|[Tt]each|[Tt]utor|Contact|Author|Name|TA|[Mm]entor|Advisor|Ask|Dr\.|M[rs]s?\.")
_ADDRESS_HINT = re.compile(r"(?:로|길|번지|동|리|면|읍|가|ro|gil|St|Street|Ave|Avenue|Road|Rd|Lane|Ln|Blvd|Boulevard|Drive)[ \t]*\d|-ro\b|-gil\b|daero\b|번지|\d[ \t]+(?:[A-Z][a-z]+[ \t]+){1,3}(?:St|Ave|R[do]|L[an]|B[lo]|Dr)")


def _detect(t: str) -> list[tuple[int, int, str]]:
    """Non-overlapping (begin, end, type) of a rewritten text, in order."""
    found: list[tuple[int, int, str]] = []
    if "@" in t:
        for m in _EMAIL.finditer(t):
            found.append((m.start(), m.end(), "email"))
    emails = list(found)
    groups = [m.span() for m in _GROUP.finditer(t)]
    if groups:
        if sum(e - b for b, e in groups) >= 5:
            found += _id_numbers(t, groups) + _phones(t, groups)
        if _ADDRESS_HINT.search(t):
            for m in _ADDRESS.finditer(t):
                found.append((m.start(), m.end(), "address"))
    if _NAME_HINT.search(t):
        for p in _NAMES:
            for m in p.finditer(t):
                if m["n"] not in _NO_NAMES:
                    found.append((m.start("n"), m.end("n"), "person_name"))
    for b, _, _ in emails:
        if (m := _BEFORE_EMAIL.search(t, max(0, b - 60), b)) and m["n"] not in _NO_NAMES:
            found.append((m.start("n"), m.end("n"), "person_name"))
    found.sort(key=lambda x: (x[0], TYPES.index(x[2])))
    out: list[tuple[int, int, str]] = []
    for x in found:
        if not out or x[0] >= out[-1][1]:
            out.append(x)
    return out


def find_in_line(line: str) -> list[tuple[int, int, str]]:
    """Source spans of the personal information in one line: (begin, end, type)."""
    m = deobfuscate(line)
    return [(*m.source(b, e), t) for b, e, t in _detect(m.text)]


# --- URLs --------------------------------------------------------------------------

_BY_NAME = {
    "email": re.compile(r"(?i)^(?:e-?)?mail$|^email"),
    "phone": re.compile(r"(?i)^(?:tel|phone|mobile|hp|cell|fax)"),
    "id_number": re.compile(r"(?i)^(?:sid|(?:std|stu|student|staff|user|emp|member)[_-]?(?:id|no))$"),
    "address": re.compile(r"(?i)^addr"),
    "person_name": re.compile(r"(?i)^(?:prof|professor|name|teacher|instructor|lecturer|author|tutor|user_?name)$"),
}
_PART = re.compile(r"([?&#;])([^?&#;]*)")
_VALUE = {
    "email": re.compile(r".*@"),
    "phone": re.compile(r"(?:\D*\d){9,}"),
    "id_number": re.compile(r"(?:\D*\d){5,}"),
    "address": re.compile(r".*\d"),
    "person_name": re.compile(rf"\s*(?:{_KO_NAME}|{_EN_NAME}|[A-Z][a-z]+)\s*$"),
}


def find_in_url(url: str) -> list[tuple[int, int, str]]:
    """Spans of a URL's parameters and fragment that carry personal information; empty parameters carry none."""
    out = []
    for m in _PART.finditer(url):
        name, eq, value = m[2].partition("=")
        begin = m.start(2) + (len(name) + 1 if eq else 0)
        plain = unquote_plus(value if eq else name).strip()
        if not plain:
            continue
        kind = next((t for t in TYPES if eq and _BY_NAME[t].search(name) and _VALUE[t].match(plain) or t == "email" and "@" in plain and _EMAIL.search(plain)), None)
        if kind is None and (got := [t for b, e, t in _detect(deobfuscate(plain).text) if t in ("email", "phone") or t == "address"]):
            kind = got[0]
        if kind:
            out.append((begin, m.end(), kind))
    head = re.split(r"[?&#;]", url, maxsplit=1)[0]
    out += [x for x in find_in_line(head) if x[2] == "email"]
    return sorted(out)


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span replaced by the placeholder of its type."""
    out, at = [], 0
    for b, e, t in spans:
        out += [text[at:b], PLACEHOLDERS[t]]
        at = e
    return "".join(out) + text[at:]


#: Lines without any of these are passed by; a necessary condition of every detector.
_MAYBE = re.compile(rf"@|＠|골뱅이|[0-9０-９]{{3}}|{_KO_DIGIT}{{3}}|(?i:zero|one|two|three)|(?:로|길|리|동|면|읍|가|-ro|-gil)[ \t]*[0-9]|{_NAME_HINT.pattern}|(?i:[(\[{{]at)")


def scan_text(text: str) -> tuple[list[tuple[int, str]], str]:
    """(line number, type) of what a text holds, and the redacted text."""
    hits, out = [], []
    for k, line in enumerate(text.split("\n"), 1):
        spans = find_in_line(line) if _MAYBE.search(line) else []
        hits += [(k, t) for _, _, t in spans]
        out.append(redact(line, spans) if spans else line)
    return hits, "\n".join(out)


def scan_url(url: str) -> tuple[list[tuple[int, str]], str]:
    spans = find_in_url(url)
    return [(1, t) for _, _, t in spans], redact(url, spans)


def find_pii(df: DataFrame, key: str, texts: list[str], urls: list[str]) -> DataFrame:
    """One row per field, line and type that occurs in it: ``key, field_name, line_no, pii_type``.

    Null and empty fields give no row; texts of any length are read whole, line by line;
    a type that occurs twice in a line gives one row; other columns are ignored.  Narrow.
    """
    return _scan(df, key, texts, urls).select(key, "field_name", F.explode("hits").alias("h")).select(key, "field_name", F.col("h.line_no").alias("line_no"), F.col("h.pii_type").alias("pii_type"))


def redact_pii(df: DataFrame, key: str, texts: list[str], urls: list[str]) -> DataFrame:
    """One row per field that is not null, with its placeholders: ``key, field_name, redacted, n_found``."""
    return _scan(df, key, texts, urls, True).select(key, "field_name", "redacted", F.size("hits").alias("n_found"))


def _scan(df: DataFrame, key: str, texts: list[str], urls: list[str], with_text: bool = False) -> DataFrame:
    kind = df.schema[key].dataType.simpleString()
    hit = pa.struct([("line_no", pa.int32()), ("pii_type", pa.string())])
    target = pa.schema([(key, arrow_type(df, key)), ("field_name", pa.string()), ("hits", pa.list_(hit)), ("redacted", pa.string())])
    fields = [(f, scan_text) for f in texts] + [(f, scan_url) for f in urls]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            keys, rows = b.column(0).to_pylist(), []
            for k, (f, scan) in enumerate(fields):
                for id_, text in zip(keys, b.column(k + 1).to_pylist()):
                    if text is None:
                        continue
                    hits, redacted = scan(text)
                    if hits or with_text:
                        rows.append((id_, f, [{"line_no": n, "pii_type": t} for n, t in dict.fromkeys(hits)], redacted if with_text else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows) if rows else [[]] * 4, target)], schema=target)

    return df.select(F.col(key), *[F.col(f).cast("string") for f, _ in fields]).mapInArrow(run, f"{key} {kind}, field_name string, hits array<struct<line_no: int, pii_type: string>>, redacted string")
