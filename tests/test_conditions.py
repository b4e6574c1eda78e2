from pyspark.sql import functions as F

from quarry.operators import conditions as C, conversation as V


def test_conditions(spark):
    """A small catalog in which every kind of condition has one record that meets it and one that nearly does."""
    rows = [
        (1, "통계 PBL", "전공필수", "3.0", "김하나", "팀 프로젝트 30%\n중간고사: 없음"), (2, "통계(영강)", "전공선택", "3", "이두리", "학과(부)별 전공역량 팀 프로젝트\n중간고사 30%"),
        (3, "캡스톤디자인", "교양필수", None, "김하나", "학점 3.0 안내\nfinal exam 0%"), (4, "확률", "전공필수", "2", None, "조별  발표와 질문과 토의\nQuiz: | 10"), (5, None, None, None, None, None),
    ]
    records = spark.createDataFrame(rows, "record_id long, course_name string, completion_type string, credit string, professor string, text string").withColumn("kind", F.lit("clash"))
    asked = {
        "a": "전공 필수 3학점", "b": "김하나 이두리 교수", "c": "중간고사 없는 과목", "d": "팀플 있는 PBL", "e": "캡스톤", "f": "영어 강의", "g": "토론과 퀴즈", "h": "중간고사 있는 과목", "i": None, "j": "기말시험 안 보는 과목", "k": "확률", "l": "프로젝트 과목", "m": "김하나 교수 3.0 학점",
    }
    questions = spark.createDataFrame(list(asked.items()), "qid string, question string")
    demands = C.asked(questions, records.select("professor"))
    got = {}
    for r in demands.collect():
        got.setdefault(r["qid"], set()).add((r["kind"], r["value"]))
    assert got == {
        "a": {("completion", "전공필수"), ("credit", "3")}, "b": {("professor", "김하나"), ("professor", "이두리")}, "c": {("absence", "중간고사")}, "d": {("title", "pbl"), ("feature", "teamwork")}, "e": {("title", "capstone")},
        "f": {("title", "english")}, "g": {("feature", "토론"), ("feature", "퀴즈")}, "j": {("absence", "기말고사")}, "l": {("feature", "프로젝트")}, "m": {("professor", "김하나"), ("credit", "3")},
    }
    offers = C.offered(records)
    met = lambda **how: {q: sorted(r["record_id"] for r in rs) for q, rs in _grouped(C.meeting_all(demands, offers, **how).collect()).items()}
    want = {"a": [1], "c": [1], "d": [1], "e": [3], "f": [2], "g": [4], "j": [3], "l": [1, 3], "m": [1, 3]}
    assert met() == want  # several professors, all demanded: none
    assert met(any_of=("professor",)) == want | {"b": [1, 2, 3]}
    assert C.meeting_all(demands.limit(0), offers).count() == 0


def _grouped(rows):
    out = {}
    for r in rows:
        out.setdefault(r["qid"], []).append(r)
    return out


def test_mentions_and_what_is_left_out(spark):
    courses = spark.createDataFrame([("AB101", "통계 PBL"), ("CD202", "PBL 실험"), ("EF303", ""), ("", "이름만")], "code string, course_name string")
    turns = spark.createDataFrame([(1, 1, "user", "통계 PBL 어때"), (1, 2, "assistant", "ab101은 좋다"), (1, 3, "user", "나머지 PBL"), (2, 1, "user", "나머지 PBL"), (2, 2, "assistant", "PBL 실험과 EF303, 이름만"), (3, 1, "user", None)], "conv_id long, turn int, role string, text string")
    said = V.mentions_by_name(turns, courses)
    assert sorted(map(tuple, said.collect())) == [(1, 1, "user", "AB101"), (1, 2, "assistant", "AB101"), (2, 2, "assistant", "CD202"), (2, 2, "assistant", "EF303")]
    asking = spark.createDataFrame([(1, 3, "pbl"), (2, 1, "pbl"), (2, 3, "pbl")], "conv_id long, turn int, category string")
    category = spark.createDataFrame([("pbl", "AB101"), ("pbl", "CD202"), ("x", "EF303")], "category string, code string")
    assert sorted(map(tuple, V.missing_of_category(asking, said, category).collect())) == [(1, 3, "CD202"), (2, 3, "AB101")]
