"""Landed files: decoding, kind of attachment, text of HTML, DOCX and PDF files."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Tags after whose text a line ends.
_BLOCK = frozenset("p div br tr li ul ol table h1 h2 h3 h4 h5 h6 section article header footer dl dt dd form fieldset".split())
_SILENT = frozenset(("script", "style", "noscript", "button", "template"))
CHOSEN = "선택 확인: "


def landed(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``path, content`` of every file under a folder."""
    return spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter=glob).load(path).select("path", "content")


def decode(data: bytes | None) -> str | None:
    """UTF-8, else cp949, else UTF-8 with what can't be read replaced."""
    if data is None:
        return None
    for encoding in ("utf-8-sig", "cp949"):
        try:
            return data.decode(encoding)
        except UnicodeDecodeError:
            pass
    return data.decode("utf-8", "replace")


def extension(url: Column, path: Column, content: Column) -> Column:
    """Extension by the URL's name, else the path's, else the first bytes, else ``.bin``."""
    named = lambda c: F.nullif(F.lower(F.regexp_extract(F.coalesce(c, F.lit("")), r"(\.[A-Za-z0-9]{2,5})(?:[?#].*)?$", 1)), F.lit(""))
    head = F.hex(F.substring(content, 1, 4))
    magic = F.when(head == "25504446", ".pdf").when(head.startswith("504B"), ".docx").when(head == "D0CF11E0", ".hwp")
    return F.coalesce(named(url), named(path), magic, F.lit(".bin"))


class _Page(HTMLParser):
    """Text of a page as a reader sees it, with only those form choices that are made."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[str] = [""]
        self.silent = 0
        self.label: dict | None = None  # the label or option that is open
        self.cells = 0
        self.labels_of: dict[str, str] = {}  # texts of labels by the control they name
        self.boxes: list[tuple[int, str]] = []  # (line, control) of chosen controls without a label around them

    def put(self, text: str) -> None:
        text = re.sub(r"\s+", " ", text)
        if text.strip() or self.lines[-1]:
            self.lines[-1] += text

    def end_line(self) -> None:
        if self.lines[-1].strip():
            self.lines.append("")
        else:
            self.lines[-1] = ""

    def handle_starttag(self, tag: str, attrs) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag in _SILENT:
            self.silent += 1
        elif tag in ("label", "option"):
            self.label = {"tag": tag, "text": "", "for": a.get("for", ""), "chosen": tag == "option" and "selected" in a, "control": tag == "option"}
        elif tag == "input" and a.get("type", "").lower() in ("checkbox", "radio"):
            if self.label is not None:
                self.label["control"] = True
                self.label["chosen"] |= "checked" in a
            elif "checked" in a:
                self.boxes.append((len(self.lines) - 1, a.get("id", "") or "=" + a.get("value", "")))
            elif a.get("id"):
                self.labels_of.setdefault("-" + a["id"], "")
        elif tag in ("td", "th"):
            if self.cells and self.lines[-1].strip():
                self.lines[-1] = self.lines[-1].rstrip() + " | "
            self.cells += 1
        elif tag in _BLOCK:
            if tag == "tr":
                self.cells = 0
            self.end_line()

    def handle_endtag(self, tag: str) -> None:
        if tag in _SILENT:
            self.silent = max(0, self.silent - 1)
        elif self.label is not None and tag == self.label["tag"]:
            done, self.label = self.label, None
            text = re.sub(r"\s+", " ", done["text"]).strip()
            if done["for"]:
                self.labels_of[done["for"]] = text
            elif not done["control"]:
                self.put(text)
            elif done["chosen"] and text:
                self.end_line()
                self.put(CHOSEN + text)
                self.end_line()
        elif tag in _BLOCK:
            self.end_line()

    def handle_data(self, data: str) -> None:
        if self.silent:
            return
        if self.label is not None:
            self.label["text"] += data
        else:
            self.put(data)

    def text(self) -> str:
        for line, control in reversed(self.boxes):
            name = control[1:] if control.startswith("=") else self.labels_of.get(control, "")
            if name:
                self.lines.insert(line + 1, CHOSEN + name)
        return "\n".join(x for x in (re.sub(r"[ \t]+", " ", line).strip(" |") for line in self.lines) if x)


def html_text(html: str | None) -> str | None:
    """Text of an HTML page: blocks as lines, table cells set off by bars, scripts out, choices only where made."""
    if html is None:
        return None
    p = _Page()
    p.feed(html)
    p.close()
    return p.text()


def docx_text(data: bytes) -> str:
    """Paragraphs of a DOCX file, then its table rows with their cells set off by bars."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{w}body")
    words = lambda e: "".join(t.text or "" for t in e.iter(f"{w}t")).strip()
    lines = [words(p) for p in body.findall(f"{w}p")]
    lines += [" | ".join(words(c) for c in r.findall(f"{w}tc")) for t in body.findall(f"{w}tbl") for r in t.findall(f"{w}tr")]
    return "\n".join(x for x in lines if x)


def pdf_text(data: bytes) -> str:
    """Pages of a PDF file, each after its number; needs the optional reader."""
    from pypdf import PdfReader

    return "\n".join(f"[page {n}]\n{page.extract_text() or ''}" for n, page in enumerate(PdfReader(io.BytesIO(data)).pages, 1))


READERS = {".html": lambda d: html_text(decode(d)), ".htm": lambda d: html_text(decode(d)), ".txt": decode, ".docx": docx_text, ".pdf": pdf_text}


def extract(df: DataFrame, path: str = "path", content: str = "content", kind: str = "extension") -> DataFrame:
    """``path, text, error`` of every landed file by its extension; a failure stays in its row and says why."""
    target = pa.schema([(path, pa.string()), ("text", pa.string()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for p, data, ext in zip(*(b.column(i).to_pylist() for i in range(3))):
                text = error = None
                if ext not in READERS:
                    error = f"unsupported:{ext}"
                elif data is None:
                    error = "empty file"
                else:
                    try:
                        text = READERS[ext](data)
                    except ImportError:
                        error = f"no reader for {ext}"
                    except Exception as e:  # one bad file fails its own row only
                        error = f"{type(e).__name__}: {e}"[:300]
                rows.append((p, text, error))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)] if rows else [pa.array([], pa.string())] * 3, schema=target)

    return df.select(F.col(path), F.col(content), F.col(kind)).mapInArrow(run, f"{path} string, text string, error string")


# --- course lists in pages -----------------------------------------------------------

def table_rows(df: DataFrame, key: str, html: str) -> DataFrame:
    """``key, row_no, cells``: the table rows of a page, tags and entities undone, all in the JVM."""
    rows = df.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))).alias("row_no", "r"))
    cells = F.regexp_extract_all("r", F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1))
    plain = lambda c: F.trim(F.regexp_replace(_entities(F.regexp_replace(c, r"(?s)<[^>]*>", " ")), r"\s+", " "))
    return rows.select(key, "row_no", F.transform(cells, plain).alias("cells")).where(F.size("cells") > 0)


def _entities(c: Column) -> Column:
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(sign))
    return c


def call_arguments(df: DataFrame, key: str, html: str, function: str) -> DataFrame:
    """``key, call_no, args``: the arguments of every call of a script function in a page; commas inside quotes don't split."""
    one = r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|[^,'"()]+"""
    calls = F.regexp_extract_all(html, F.lit(rf"{function}\s*\(((?:{one}|,)*)\)"), F.lit(1))
    args = F.regexp_extract_all("c", F.lit(rf"({one})"), F.lit(1))
    bare = lambda a: F.regexp_replace(F.regexp_replace(F.trim(a), r"""^(['"])(.*)\1$""", "$2"), r"\\(.)", "$1")
    return df.select(key, F.posexplode(calls).alias("call_no", "c")).select(key, "call_no", F.transform(F.filter(args, lambda a: F.trim(a) != ""), bare).alias("args"))
