import pytest
from pyspark.sql import functions as F

from quarry.functions.text import tokenize
from quarry.operators import search as S


def questions(spark, rows):
    return spark.createDataFrame(rows, "qid string, question string").withColumn("section", F.lit("clash"))


def passages(spark, rows):
    df = spark.createDataFrame(rows, "pid long, course_code string, course_name string, professor string, section string, text string")
    return df.withColumn("tokens", tokenize(F.concat_ws(" ", "course_code", "course_name", "professor", "section", "text")))


def test_named_courses(spark):
    courses = spark.createDataFrame([("DEMO101", "통계학"), ("DEMO201", "통계학 입문"), ("DEMO202", "통계학입문(영강)"), ("demo301", "데이터"), ("", "빈 코드"), ("DEMO401", None)], "code string, course_name string")
    asked = questions(spark, [("a", "DEMO201과 demo101 비교"), ("b", "통계학 입문 시험"), ("c", "통계학 시험"), ("d", "DEMO999 통계학"), ("e", None), ("f", ""), ("g", "빈 코드 수업"), ("h", "데이타, 데이터와 통계학")])
    got = {}
    for r in S.named_courses(asked, courses).orderBy("at").collect():
        got.setdefault(r["qid"], []).append(r["code"])
    assert sorted(got.pop("b")) == ["DEMO201", "DEMO202"]  # one title, with and without the remark
    assert got == {"a": ["DEMO201", "DEMO101"], "c": ["DEMO101"], "h": ["DEMO301", "DEMO101"]}


def test_keyword_scores(spark):
    """Boosts by hand, over passages that share no term with each other."""
    p = passages(spark, [(1, "AB101", "통계", "김", "기본정보", "aa"), (2, "CD202", "확률", "", "평가방법", "퀴즈 한 번, quiz 둘"), (3, "", "", "", "지원및윤리", "zz yy"), (4, "EF303", "실험", "박", "수업운영", "none of it")])
    asked = questions(spark, [("code", "ab101 어때"), ("name", "통계 배점"), ("prof", "박 교수님"), ("syn", "쪽지 시험 있어"), ("off", "zz 과목"), ("nothing", "과목"), ("null", None)])
    got = {(r["qid"], r["pid"]): r["score"] for r in S.keyword_scores(p, asked).collect()}
    assert 18 < got.pop(("code", 1)) < 20  # 8 as the course's code, 10 as the hint, the code as a term
    assert 18 < got.pop(("name", 1)) < 20  # 8 as the name, 10 as the hint, the name as a term
    assert 3 <= got.pop(("prof", 4)) < 4
    assert 2.4 + 0.32 < got.pop(("syn", 2)) < 12  # two words of the group, terms, and the section
    off = got.pop(("off", 3))
    assert -0.35 < off < 2  # no word of the avoided section in the question
    assert {q for q, _ in got} <= {"name", "syn", "prof"}


def test_rerank_and_relevance(spark):
    empty = "no data " * 4 + "평가방법이 입력 되지 않았습니다"
    p = passages(spark, [(1, "A101", "", "", "", "코딩 실습 programming"), (2, "A101", "", "", "", "무관"), (3, "B202", "", "", "", empty), (4, "C303", "", "", "", "코딩 기초")])
    asked = questions(spark, [("q", "코딩 과목 추천해줘"), ("n", "무관 DEMO101"), ("e", "추천")])
    lexical = spark.createDataFrame([("q", 1, 4.0, 1), ("q", 3, 2.0, 2), ("n", 2, 1.0, 1), ("e", 3, 1.0, 1)], "qid string, pid long, score double, rank int")
    semantic = spark.createDataFrame([("q", 4, 0.9, 1), ("q", 2, 0.1, 2), ("n", 2, 0.2, 1)], "qid string, pid long, cosine double, rank int")
    ranked = S.rerank(asked, lexical, semantic, p)
    got = {(r["qid"], r["pid"]): r for r in ranked.collect()}
    assert ("q", 3) not in got and ("e", 3) in got  # an empty form is left out unless there is nothing else
    one, four = 0.30 + 0.15, 0.55 * 0.9 + 0.15
    assert got["q", 1]["evidence"] == pytest.approx(one) and got["q", 1]["score"] == pytest.approx(one + 0.85)
    assert got["q", 4]["score"] == pytest.approx(four + 0.85) and got["q", 1]["broad"] and not got["n", 2]["broad"]
    courses = spark.createDataFrame([("DEMO101", "무엇")], "code string, course_name string")
    kept = {(r["qid"], r["pid"]) for r in S.relevant(ranked, asked, p, courses).collect()}
    # 2 is far and shares no term; the code exempts n; e has no anchor and its evidence is its best.
    assert kept == {("q", 1), ("q", 4), ("n", 2), ("e", 3)}
    order = [(r["pid"]) for r in S.reranked(ranked, p, 7).where("qid = 'q'").orderBy("position").collect()]
    assert order[0] == 4 and sorted(order) == [1, 4]  # one of a course


def test_contained(spark):
    t = spark.createDataFrame([("a", "xx yy xx"), ("b", None), ("c", "")], "id string, text string")
    n = spark.createDataFrame([("xx",), ("yy x",), ("zz",), ("",), (None,), ("xx",)], "name string")
    assert sorted(map(tuple, S.contained(t, n, "id", "text", "name").collect())) == [("a", "xx", 1), ("a", "yy x", 4)]
