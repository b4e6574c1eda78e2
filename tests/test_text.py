import json

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import rules as R


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


def test_forms_of_texts(spark):
    listed = "앞 활동유형 강의 발표 토론 ▷ 평가방법 시험 뒤"
    assert one(spark, T.without_checklists, listed) == "앞 ▷ 평가방법 시험 뒤" and one(spark, T.without_empty_forms, listed) == "앞 ▷ 평가방법 시험 뒤"
    chosen = "활동유형 선택 확인: 발표 평가방법 시험"
    assert one(spark, T.without_empty_forms, chosen) == chosen and one(spark, T.without_checklists, chosen) == "평가방법 시험"
    assert one(spark, T.without_empty_forms, "수업유형  대면 대면 비대면 비대면 미정\n평가방법이 입력 되지  않았습니다.\n\n\n\n끝") == "끝"
    assert one(spark, T.without_empty_forms, "활동유형 강의") == "활동유형 강의"  # no list without what ends it
    assert one(spark, T.similarity_key, "Head 01\n\nBody  https://h.example/x?y z\n\nTail") == "bodyztail" and one(spark, T.similarity_key, None) == ""
    assert one(spark, T.spaced_key, " A\n\tb  C ") == "a b c"
    stem = lambda n: spark.createDataFrame([("AB101", "01", n)], "c string, k string, n string").select(T.file_stem(F.col("c"), F.col("k"), F.col("n"))).first()[0]
    assert stem(" 통계 (영강)/A-1 ") == "AB101_01_통계_영강_A-1" and stem("//") == stem(None) == "AB101_01"
    assert one(spark, T.attachment_link, "<a href='x.html'>1</a><a HREF=\"/d/fileDownloader?a=1&amp;b=2\">2</a><img src='y.pdf'>") == "/d/fileDownloader?a=1&b=2" and one(spark, T.attachment_link, None) is None


@pytest.mark.parametrize("value, want", [
    ("월(1-2) 가온관 101", ("03", "월", 1, 2, "1-2", "09:00", "10:50", "가온관 101")), ("02분반 화요일 3교시 (11:00-11:50), 누리관", ("02", "화", 3, 3, "3", "11:00", "11:50", "누리관")),
    ("수7~8", ("03", "수", 7, 8, "7-8", "15:00", "16:50", "")), ("목요일 5교시 · 온라인", ("03", "목", 5, 5, "5", "13:00", "13:50", "온라인")), ("금（１－２）", ("03", "금", 1, 2, "1-2", "09:00", "10:50", "")),
])
def test_meeting(spark, value, want):
    got = spark.createDataFrame([(value, "3")], "v string, k string").select(T.meeting(F.col("v"), F.col("k")).alias("m")).first()["m"]
    assert tuple(got[f] for f in ("class_no", "day", "start_period", "end_period", "periods", "start_time", "end_time", "room")) == want
    assert got["display"].startswith(f"{want[1]}요일 {want[4]}교시 ({want[5]}-{want[6]})")


def test_meeting_of_other_texts(spark):
    for value in ("시간 미지정", "", None):
        assert spark.createDataFrame([(value, None)], "v string, k string").select(T.meeting(F.col("v"), F.col("k")).alias("m")).first()["m"] is None


def test_canonical_json(spark):
    df = spark.createDataFrame([({"b": 1, "a": {"z": "x", "y": [{"q": 2, "p": None}]}},)], "s struct<b: int, a: struct<z: string, y: array<struct<q: int, p: int>>>>")
    got = df.select(T.canonical_json(F.col("s"), df.schema["s"].dataType)).first()[0]
    assert got == json.dumps(json.loads(got), sort_keys=True, separators=(",", ":")) == '{"a":{"y":[{"q":2}],"z":"x"},"b":1}'


def test_scope_and_terms(spark):
    scope = lambda q: one(spark, lambda c: T.in_scope(c, 2031), q)
    assert scope("통계 수업") and scope("2031학년도 수업") and scope(None) and not scope("2030 학년도") and not scope("2031학년 2학기") and not scope("계절학기")
    holds = lambda q, terms: one(spark, lambda c: R.contains_any(c, terms), q)
    assert holds("바이브코딩을", ("코딩",)) and not holds("인코딩과 디코딩", ("코딩",)) and not holds("encoding", ("coding",)) and holds("Live CODING", ("coding",))
    assert one(spark, lambda c: R.contains_phrase(c, ("팀 활동",)), "팀  활\n동") and not holds(None, ("a",))
    assert one(spark, R.retrieval_query, "과제 있나") == "과제 있나 평가방식 성적 중간고사 기말고사 과제 출석 발표"
    empty = "No data " * 4 + "평가방법이 입력 되지 않았습니다"
    assert one(spark, R.low_information, empty) and not one(spark, R.low_information, empty[8:]) and not one(spark, R.low_information, None)
