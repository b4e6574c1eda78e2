import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quarry.sources import collections as C, files as X


def test_collection(spark, tmp_path):
    lines = ['{"course_code": "A100", "credit": 3, "text": "이수구분: 전공필수", "schedule_entries": [{"day": "월", "start_period": 1}, "x", null], "extra": 1}', "", '{"course_code": null, "completion_type": "교양선택"}', ""]
    (tmp_path / "a.jsonl").write_text("\n".join(lines), encoding="utf-8")
    got = C.read_collection(spark, str(tmp_path / "a.jsonl")).orderBy(F.desc("course_code")).collect()
    assert [r["course_code"] for r in got] == ["A100", ""]
    assert got[0]["credit"] == "3" and got[0]["completion_type"] == "전공필수" and [e["day"] for e in got[0]["schedule_entries"]] == ["월"]
    assert got[1]["completion_type"] == "교양선택" and got[1]["schedule_entries"] == [] and got[1]["text"] == ""
    with pytest.raises(Exception, match="a row without"):
        C.strict(C.read_collection(spark, str(tmp_path / "a.jsonl"))).collect()


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([("A1", 'say "hi", you\nthere', [("월", 1)]), ("B2", None, [])], "code string, note string, e array<struct<day: string, n: int>>")
    C.write_list(df, str(tmp_path / "l"), ["note", "code", "e"])
    back = {r["code"]: r for r in C.read_list(spark, str(tmp_path / "l")).collect()}
    assert back["A1"]["note"] == 'say "hi", you\nthere' and json.loads(back["A1"]["e"]) == [{"day": "월", "n": 1}] and back["B2"]["note"] is None
    C.write_snapshot(df, str(tmp_path / "s"), "code")
    assert spark.read.json(str(tmp_path / "s")).count() == 2
    (tmp_path / "bom.csv").write_bytes("﻿code,name\nA,가\n".encode())
    assert C.read_list(spark, str(tmp_path / "bom.csv")).columns == ["code", "name"]


def test_decode():
    assert X.decode("한글".encode()) == X.decode("한글".encode("cp949")) == "한글" and X.decode(b"\xff\xff\xff") == "���" and X.decode(None) is None


def test_html():
    page = """<html><style>x{}</style><script>var a = "<p>no</p>"</script><h1>과목명 &amp; 개요</h1><p>one<br>two</p>
    <table><tr><th>주</th><td>내용</td></tr><tr><td>1</td><td>시작 <b>강조</b></td></tr></table>
    <label><input type="checkbox" checked> 토론</label><label><input type="checkbox"> 발표</label>
    <input type="radio" id="r1" checked><label for="r1">대면</label><input type="radio" id="r2"><label for="r2">비대면</label>
    <select><option>상</option><option selected>중</option></select><button>저장</button><noscript>no</noscript></html>"""
    text = X.html_text(page)
    assert text.split("\n")[:5] == ["과목명 & 개요", "one", "two", "주 | 내용", "1 | 시작 강조"]
    for there in ("토론", "대면", "중"):
        assert X.CHOSEN + there in text.split("\n")
    for gone in ("발표", "비대면", "상", "저장", "no", "var"):
        assert gone not in text.replace("시작 강조", "")
    assert X.html_text("") == "" and X.html_text(None) is None


def docx():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = "<w:p><w:r><w:t>{}</w:t></w:r></w:p>"
    body = p.format("첫 줄") + "<w:tbl><w:tr><w:tc>" + p.format("a") + "</w:tc><w:tc>" + p.format("b") + "</w:tc></w:tr></w:tbl>" + p.format("끝 줄")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def test_extract(spark, tmp_path):
    for name, data in {"a.docx": docx(), "b.html": "<p>안녕</p>".encode("cp949"), "c.zip": b"PK", "d.docx": b"broken", "e": docx()}.items():
        (tmp_path / name).write_bytes(data)
    df = X.landed(spark, str(tmp_path)).withColumn("extension", X.extension(F.lit(None).cast("string"), F.col("path"), F.col("content")))
    got = {r["path"].rsplit("/", 1)[1]: (r["text"], r["error"]) for r in X.extract(df).collect()}
    assert got["a.docx"] == got["e"] == ("첫 줄\n끝 줄\na | b", None) and got["b.html"] == ("안녕", None)
    assert got["c.zip"] == (None, "unsupported:.zip") and got["d.docx"][0] is None and got["d.docx"][1]


def test_lists_in_pages(spark):
    page = """<tr class=h><th>코드</th></tr><tr><td><a href='#'>A100</a>&nbsp;x</td><td> b &lt;c </td></tr> <a onclick="view('A100', 'it\\'s, ok', 3)">v</a> view()"""
    df = spark.createDataFrame([(1, page), (2, None), (3, "")], "id int, html string")
    assert [list(r["cells"]) for r in X.table_rows(df, "id", "html").orderBy("row_no").collect()] == [["코드"], ["A100 x", "b <c"]]
    assert [list(r["args"]) for r in X.call_arguments(df, "id", "html", "view").collect()][0] == ["A100", "it's, ok", "3"]


def test_intermediate_tables_need_a_shared_folder():
    """Without a folder of the cluster, only a session of one process may take a temporary one."""
    from types import SimpleNamespace

    from quarry.functions.storage import shared_dir

    def session(master, held=None):
        conf = SimpleNamespace(get=lambda k, d=None: held, set=lambda k, v: None)
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda k: None)))

    assert shared_dir(session("spark://host:7077", "hdfs://shared/")) == "hdfs://shared"
    assert shared_dir(session("local[4]")).startswith("file:///")
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(RuntimeError):
            shared_dir(session(master))


def test_strict_and_reports(spark, tmp_path):
    df = spark.createDataFrame([("A1", "x", ["p", "q"], [(1, "z")]), ("A2", 'say "hi", all', None, None)], "course_code string, text string, tags array<string>, parts array<struct<n: int, t: string>>")
    assert C.strict(df).count() == 2
    with pytest.raises(ValueError):
        C.strict(df.limit(0))
    with pytest.raises(Exception, match="a row without text"):
        C.strict(df.withColumn("text", F.lit(" "))).collect()
    got = C.write_reports({"all": df, "none": df.limit(0)}, str(tmp_path / "r"))
    assert sorted(map(tuple, got.collect())) == [("all", 2), ("none", 0)]
    rows = {r["course_code"]: r for r in C.read_list(spark, str(tmp_path / "r" / "all")).collect()}
    assert rows["A1"]["tags"] == "p,q" and json.loads(rows["A1"]["parts"]) == [{"n": 1, "t": "z"}] and rows["A2"]["text"] == 'say "hi", all'
    assert spark.read.json(str(tmp_path / "r" / "manifest")).count() == 2
