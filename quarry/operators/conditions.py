"""Questions as conditions on records: what a question asks, what a record offers, and who meets all of it.

Both sides are rows of (kind, value), so that a conjunction is an equality join and a count,
whatever the number of questions and records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import canonical_credit, normalize_title
from . import rules
from .search import contained

# What a line of a syllabus must hold to be evidence of team work, and what makes a line none.
TEAMWORK = (r"팀\s*프로젝트", r"팀\s*기반(?:의)?\s*(?:과제|프로젝트|학습|활동)", r"팀별로?\s*(?:발표|분석|과제|프로젝트)", r"팀원(?:들)?(?:과|의)?\s*협업", r"조별\s*(?:활동|과제|프로젝트|발표|준비)", r"(?:team|group)\s+projects?")
ACTIVITY_NOISE = ("학과(부)별 전공역량", "타인과 협력할 수 있는 공감능력", "핵심역량개척정신공유협력", "실험실습 안전")
FEATURE_NOISE = ACTIVITY_NOISE + (
    "본교의 교육활동에 참여하는 학생", "Students participating in the educational activities", "장애학생은", "과제 관련 지원", "과제정보는 자유롭게", "학습과정에서 과제물 표절", "표절검사시스템", "1학기는 16주 구성", "문화유산 실무‧실습 역량", "Pragmatic Practice | Pragmatic Practice", "Class Activity | Lecture | Presentation | Discussion | Experiment | Practice",
)
# The same for each topic that a question may ask for.
TOPICS = {
    "코딩": (r"(?:Python|파이썬|SAS|JavaScript|R\s*(?:언어)?).{0,45}(?:프로그래밍|programming|프로그램|코딩|구현|실습|활용|이용)", r"(?:프로그래밍|programming|프로그램|코딩|구현).{0,45}(?:Python|파이썬|SAS|JavaScript|R\s*(?:언어)?)", r"programming\s+(?:skills?|session)", r"basic\s+programming", r"프로그래밍의\s*기초", r"utilize\s+Python.{0,45}JavaScript"),
    "실습": (r"실습을?\s*(?:통하여|통해|병행|진행)", r"(?:이론|강의)(?:과|와|,|\s및)?\s*실습", r"실습\s*(?:평가|점수|중심|위주)", r"(?:R|딥러닝|소개)\s*(?:및\s*)?실습", r"with\s+practices?", r"\bV\s+Practice\b"),
    "발표": (r"발표\s*(?:점수|평가|로|를|와|및|&)", r"(?:중간|기말|조별|PPT|프로젝트|결과|분석)\s*(?:팀\s*)?발표", r"(?:Problem\s+Solving|Final).{0,40}Presentation", r"Presentation.{0,40}(?:Report|Assignment)", r"team\s+project\s*/\s*presentation", r"to\s+present\s+corresponding\s+results"),
    "토론": (r"질문과\s*토의", r"질의\s*응답\s*및\s*토의", r"team\s+project\s*/\s*presentation\s*/\s*discussion", r"\bV\s+Discussion\b"),
    "과제": (r"과제를?\s*(?:풀어서|부여|출제|제출)", r"수시\s*과제(?:가|는|를|\s있)", r"(?:개인|팀\s*기반)\s*(?:수시)?과제", r"진도에\s*따른\s*수시과제", r"수업내용\s*복습을\s*위한\s*과제", r"과제는\s*수업시간에", r"Quiz\s+and\s+assignments?\s+are\s+given", r"(?:Assignment|Homework)\s*\d+", r"Assignment\s+\d+\s+(?:Project|Midterm)", r"(?:Final\s+)?Report\s+Assignment", r"(?:발표와\s*한번의|Final)\s*(?:레포트|Report)"),
    "퀴즈": (r"Quiz:\s*\|\s*\d+", r"Quiz\s+and\s+assignments?\s+are\s+given", r"\bV\s+Quiz\b", r"쪽지\s*시험"),
    "프로젝트": (r"팀\s*프로젝트", r"(?:개인|개별)\s*프로젝트", r"(?:team|group)\s+projects?", r"(?:individual|personal)\s+projects?", r"Project\s*\d+", r"실제\s*데이터를\s*다루는\s*프로젝트"),
}
TOPIC_TITLES = {"프로젝트": r"프로젝트학기|PBL|캡스톤"}
TOPIC_WORDS = {t: rules.SYNONYMS[t] for t in TOPICS if t != "프로젝트"} | {"프로젝트": ("프로젝트", "프로젝트형", "프로젝트 중심", "project", "project based learning")}
# Kinds of completion, examinations with their names, and words of absence.
COMPLETION = ("전공필수", "전공선택", "교양필수", "교양선택", "일반선택")
EXAMINATIONS = {"중간고사": ("중간고사", "중간시험", "midterm"), "기말고사": ("기말고사", "기말시험", "final exam")}
ABSENT = ("없", "안 보", "보지 않", "미실시", "제외")
# Kinds of titles, with the words of a question and of a name.
TITLES = {"pbl": "pbl", "capstone": "캡스톤"}


def evidence_line(text: Column, patterns: tuple[str, ...], noise: tuple[str, ...]) -> Column:
    """The first line of a text, its white space collapsed, that a pattern finds and no noise stands in; null without one."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\r\n|[\n\r]"), lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " ")))
    found = "(?iu)" + "|".join(patterns)
    quiet = lambda x: ~F.greatest(*[F.contains(x, F.lit(n)) for n in noise])
    return F.get(F.filter(lines, lambda x: x.rlike(found) & quiet(x)), F.lit(0))


def states_absence(text: Column, names: tuple[str, ...]) -> Column:
    """Whether a text says outright that an examination isn't held, before or behind its name."""
    any_of = "|".join(names)
    behind = rf"(?:{any_of})\s*(?:[:：-]\s*)?(?:없음|없다|미실시|실시하지\s*않음|0(?:\.0+)?\s*%)"
    before = rf"(?:없음|미실시|실시하지\s*않음)\s*(?:[:：-]\s*)?(?:{any_of})"
    return F.coalesce(text, F.lit("")).rlike(f"(?iu){behind}|{before}")


def offered(records: DataFrame, key: str = "record_id") -> DataFrame:
    """``key, kind, value``: every condition that a record meets; one pass, no join.

    Missing fields meet nothing; a credit counts as the field states it or as the text does.
    """
    name, text = F.coalesce("course_name", F.lit("")), F.coalesce("text", F.lit(""))
    title = normalize_title(name)
    one = lambda kind, value, holds: F.when(holds, F.struct(F.lit(kind).alias("kind"), F.lit(value).alias("value")))
    field = lambda kind, value: F.when(value != "", F.struct(F.lit(kind).alias("kind"), value.alias("value")))
    single = [one("title", kind, title.contains(word)) for kind, word in TITLES.items()]
    single.append(one("title", "english", name.contains("영강") | name.contains("영어강의")))
    single += [field("completion", F.coalesce("completion_type", F.lit(""))), field("professor", F.coalesce("professor", F.lit("")))]
    single += [one("absence", exam, states_absence(text, names)) for exam, names in EXAMINATIONS.items()]
    single.append(one("feature", "teamwork", evidence_line(text, TEAMWORK, ACTIVITY_NOISE).isNotNull()))
    for topic, patterns in TOPICS.items():
        by_title = name.rlike("(?i)" + TOPIC_TITLES[topic]) if topic in TOPIC_TITLES else F.lit(False)
        single.append(one("feature", topic, by_title | evidence_line(text, patterns, FEATURE_NOISE).isNotNull()))
    stated = F.regexp_extract_all(text, F.lit(r"학점\s+([0-9]+(?:\.[0-9]+)?)(?=\s|$)"), F.lit(1))
    credits = F.filter(F.transform(F.array_append(stated, F.coalesce("credit", F.lit(""))), canonical_credit), lambda c: c != "")
    every = F.concat(F.array(*single), F.transform(credits, lambda c: F.struct(F.lit("credit").alias("kind"), c.alias("value"))))
    return records.select(key, F.explode(F.array_distinct(F.filter(every, lambda s: s.isNotNull()))).alias("s")).select(key, "s.*")


def asked(questions: DataFrame, professors: DataFrame, qid: str = "qid", text: str = "question") -> DataFrame:
    """``qid, kind, value``: the conditions of a question, each once.

    Team work, and titles of projects, stand in place of projects in general; absences count
    only with a word of absence.  ``professors`` has a column ``professor``; a question asks
    for each one it names.  Null questions ask nothing.
    """
    q = F.coalesce(F.col(text), F.lit(""))
    title, compact = normalize_title(q), F.regexp_replace(F.lower(q), r"(?U)\s+", "")
    one = lambda kind, value, holds: F.when(holds, F.struct(F.lit(kind).alias("kind"), F.lit(value).alias("value")))
    parts = [one("title", kind, title.contains(word)) for kind, word in TITLES.items()]
    project_title = F.greatest(*[title.contains(word) for word in TITLES.values()])
    parts.append(one("title", "english", rules.contains_phrase(q, rules.SYNONYMS["영강"])))
    parts += [one("completion", c, compact.contains(c)) for c in COMPLETION]
    credit = F.regexp_replace(F.regexp_extract(F.lower(q), r"([0-9]+(?:\.[0-9]+)?)\s*학점", 1), r"\.0+$", "")
    parts.append(F.when(credit != "", F.struct(F.lit("credit").alias("kind"), credit.alias("value"))))
    absent = F.greatest(*[F.lower(q).contains(w) for w in ABSENT])
    parts += [one("absence", exam, absent & F.greatest(*[F.lower(q).contains(n) for n in names])) for exam, names in EXAMINATIONS.items()]
    teamwork = rules.contains_phrase(q, rules.SYNONYMS["팀활동"])
    parts.append(one("feature", "teamwork", teamwork))
    for topic, words in TOPIC_WORDS.items():
        parts.append(one("feature", topic, rules.contains_phrase(q, words) & ~((teamwork | project_title) if topic == "프로젝트" else F.lit(False))))
    plain = questions.select(F.col(qid).alias("qid"), F.explode(F.filter(F.array(*parts), lambda s: s.isNotNull())).alias("s")).select("qid", "s.*")
    named = contained(questions.select(F.col(qid).alias("qid"), F.col(text).alias("q")), professors, "qid", "q", "professor")
    return plain.unionByName(named.select("qid", F.lit("professor").alias("kind"), F.col("name").alias("value")))


def meeting_all(asked: DataFrame, offered: DataFrame, key: str = "record_id", any_of: tuple[str, ...] = ()) -> DataFrame:
    """``qid, key``: the records that meet every condition of a question; of the kinds in ``any_of`` one value is enough.

    With ``("professor",)`` several professors of a question are alternatives, else all are
    demanded of one record.  Questions that ask the same share one search.
    """
    demand = F.when(F.col("kind").isin(*any_of), F.col("kind")).otherwise(F.concat_ws(":", "kind", "value")) if any_of else F.concat_ws(":", "kind", "value")
    own = asked.distinct().withColumn("demand", demand)
    sets = own.groupBy("qid").agg(F.sort_array(F.collect_set(F.struct("kind", "value", "demand"))).alias("wanted"))
    sets = sets.withColumn("wish", F.xxhash64("wanted", F.lit(1)))
    wishes = sets.groupBy("wish").agg(F.any_value("wanted").alias("wanted"))
    need = wishes.select("wish", F.size(F.array_distinct(F.transform("wanted", lambda s: s["demand"]))).alias("n_demands"), F.explode("wanted").alias("s")).select("wish", "n_demands", "s.*")
    met = need.join(offered.distinct(), ["kind", "value"]).groupBy("wish", key, "n_demands").agg(F.countDistinct("demand").alias("n_met")).where("n_met = n_demands")
    return sets.select("qid", "wish").join(met.select("wish", key), "wish").select("qid", key)
