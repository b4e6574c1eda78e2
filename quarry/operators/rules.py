"""Rule tables of questions and the column expressions that apply them.  All stay in the JVM."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, functions as F

from ..functions.text import course_codes, tokenize

# What a question's words stand for.
SYNONYMS = {
    "팀활동": ("팀활동", "팀 활동", "팀플", "팀프젝", "팀플젝", "팀 프로젝트", "팀프로젝트", "팀 과제", "팀과제", "팀 협력", "팀협력", "팀워크", "협업", "협동", "조별", "조별 활동", "조별활동", "조별 과제", "조별과제", "조별 프로젝트", "조별플젝", "그룹 활동", "그룹활동", "그룹 프로젝트", "group project", "team project"),
    "프로젝트": ("프로젝트", "프로젝트형", "프로젝트 중심", "PBL", "캡스톤", "project", "project based learning"),
    "코딩": ("코딩", "프로그래밍", "개발", "구현", "코드", "coding", "programming"),
    "실습": ("실습", "실습형", "실습 중심", "실습위주", "실습 위주", "직접 해보는", "practice", "hands-on", "lab"),
    "발표": ("발표", "프레젠테이션", "presentation", "세미나 발표"),
    "토론": ("토론", "토의", "discussion", "debate"),
    "파이썬": ("파이썬", "python"),
    "R언어": ("R언어", "R 언어", "R프로그래밍", "R 프로그래밍"),
    "시험": ("시험", "중간고사", "기말고사", "고사", "평가"),
    "중간고사": ("중간고사", "중간", "midterm"),
    "기말고사": ("기말고사", "기말", "final"),
    "과제": ("과제", "숙제", "레포트", "리포트", "assignment", "homework", "보고서"),
    "퀴즈": ("퀴즈", "쪽지시험", "쪽지 시험", "quiz", "퀴즈형 시험"),
    "출석": ("출석", "attendance"),
    "평가": ("평가", "성적", "비율", "배점", "grading"),
    "영강": ("영강", "영어 수업", "영어수업", "영어 강의", "영어강의", "English"),
    "학습내용": ("학습내용", "학습 내용", "수업내용", "수업 내용", "강의내용", "강의 내용", "주별학습내용", "주별 학습내용", "커리큘럼", "뭘 배워", "무엇을 배워", "배우는 내용", "다루는 내용"),
}
# Words of a question that carry no topic, and particles in the order they are tried.
STOPWORDS = ("강의", "강의가", "과목", "과목이", "과목은", "과목을", "교과목", "수업", "수업이", "수업은", "수업을", "내용", "내용을", "알려줘", "보여줘", "설명해줘", "추천해줘", "말해줘", "있어", "있나요", "있는", "뭐가", "무엇", "어떤", "어때", "배우는", "배우고", "대해", "대한", "관련", "그리고", "또는")
SUFFIXES = ("에서는", "으로는", "에게는", "이라는", "이라고", "에서", "으로", "이나", "하고", "처럼", "보다", "부터", "까지", "은", "는", "이", "가", "을", "를", "과", "와", "로", "도", "만", "나")
# What a question must hold for a section to be preferred, and the section that is avoided without its words.
SECTION_TERMS = {
    "평가방법": ("평가", "시험", "중간", "기말", "과제", "출석", "성적", "배점"),
    "주별학습내용": ("무엇", "내용", "배우", "학습", "다루", "커리큘럼", "주차", "주별", "프로젝트", "project", "발표", "presentation", "실습", "practice", "hands-on"),
    "수업운영": ("수업방법", "운영", "실습", "practice", "hands-on", "lab", "토론", "discussion", "발표", "presentation", "팀", "team", "group", "프로젝트", "project"),
    "교과목개요": ("내용", "무엇", "배우", "개요", "추천"),
    "학습목표": ("목표", "배우", "역량", "추천"),
    "교재및과제": ("교재", "책", "과제", "소프트웨어", "도구"),
    "기본정보": ("교수", "학점", "이수구분", "전공필수", "전공선택"),
}
AVOIDED_SECTION, AVOIDED_TERMS = "지원및윤리", ("장애", "지원", "윤리", "표절")
# The words of each intent of a question, and what in a passage answers it.
CODING_TERMS = ("코딩", "프로그래밍", "파이썬", "python", "r언어", "r 언어", "소프트웨어", "분석 도구")
CODING_EVIDENCE = ("코딩", "프로그래밍", "파이썬", "python", "r ", " r/", "소프트웨어", "데이터분석소프트웨어", "통계학과파이썬", "실습", "분석", "알고리즘", "머신러닝", "딥러닝")
PRACTICE_EVIDENCE = ("실습", "구현", "소프트웨어", "python", "파이썬", "pbl", "캡스톤")
PROJECT_TERMS = SYNONYMS["팀활동"] + SYNONYMS["프로젝트"]
PROJECT_EVIDENCE = ("프로젝트", "pbl", "캡스톤", "발표", "팀")
ASSESSMENT_TERMS = ("평가", "성적", "시험", "중간고사", "기말고사", "과제", "출석")
ASSESSMENT_EVIDENCE = ("평가", "중간고사", "기말고사", "과제", "출석", "성적")
BROAD_TERMS = ("추천", "알려", "어떤", "있어", "목록", "비교", "수업", "과목")
#: Words that are part of unlike ones: encoding and decoding are no programming.
_BOUNDED = {"코딩": "(?<![인디엔])코딩", "coding": "(?<![a-z])coding(?![a-z])"}


def term_pattern(terms: Iterable[str], compact: bool = False) -> str:
    """A pattern that finds any of the terms in a lower-case text (without white space if ``compact``)."""
    plain = [re.sub(r"\s+", "", t) if compact else t for t in terms]
    return "|".join(_BOUNDED.get(t, re.escape(t)) for t in dict.fromkeys(x.lower() for x in plain))


def contains_any(text: Column, terms: Iterable[str]) -> Column:
    """Whether a text, whatever its case, holds one of the terms; null holds none."""
    return F.lower(F.coalesce(text, F.lit(""))).rlike(term_pattern(terms))


def contains_phrase(text: Column, phrases: Iterable[str]) -> Column:
    """Like ``contains_any``, white space aside."""
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", "")).rlike(term_pattern(phrases, compact=True))


def stem(token: Column) -> Column:
    """A token without the first particle of the table it ends in, if two characters stay; else null."""
    return F.coalesce(*[F.when(F.endswith(token, F.lit(s)) & (F.length(token) - len(s) >= 2), F.substring(token, F.lit(1), F.length(token) - len(s))) for s in SUFFIXES])


def expanded(tokens: Column) -> Column:
    """Query tokens without stopwords, each followed by its stem, then the tokens of every synonym group of which they hold a word; each once."""
    own = F.filter(F.flatten(F.transform(tokens, lambda t: F.when(~t.isin(*STOPWORDS), F.array(t, stem(t))).otherwise(F.array().cast("array<string>")))), lambda t: t.isNotNull() & ~t.isin(*STOPWORDS))

    def with_groups(own: Column) -> Column:
        row = F.array_join(own, " ")
        none = F.array().cast("array<string>")
        added = [F.when(contains_any(row, (key, *words)), tokenize(F.lit(" ".join(words)))).otherwise(none) for key, words in SYNONYMS.items()]
        return F.array_distinct(F.concat(own, *added))

    return F.transform(F.array(own), with_groups)[0]  # binds the tokens, so that they are made once


def preferred_sections(question: Column) -> Column:
    """The sections whose words the question holds; the avoided one is among them if the question holds its words."""
    q = F.lower(F.coalesce(question, F.lit("")))
    terms = SECTION_TERMS | {AVOIDED_SECTION: AVOIDED_TERMS}
    return F.array_compact(F.array(*[F.when(q.rlike("|".join(map(re.escape, words))), F.lit(name)) for name, words in terms.items()]))


def section_gain(preferred: Column, section: Column) -> Column:
    """What a section gains or loses, from a question's preferred sections."""
    held = F.array_contains(preferred, section)
    return F.when((section != AVOIDED_SECTION) & held, F.lit(0.32)).otherwise(0.0) - F.when((section == AVOIDED_SECTION) & ~held, F.lit(0.35)).otherwise(0.0)


def section_priority(question: Column, section: Column) -> Column:
    """0.32 for a section whose words the question holds, -0.35 for the avoided one without its words."""
    return section_gain(preferred_sections(question), section)


_INTENTS = ((CODING_TERMS, CODING_EVIDENCE, 0.85), (SYNONYMS["실습"], PRACTICE_EVIDENCE, 0.35), (PROJECT_TERMS, PROJECT_EVIDENCE, 0.7), (ASSESSMENT_TERMS, ASSESSMENT_EVIDENCE, 0.45))


def intents(question: Column) -> Column:
    """For each intent, whether the question has it."""
    return F.array(*[contains_any(question, asked) for asked, _, _ in _INTENTS])


def answers(evidence: Column) -> Column:
    """For each intent, whether the passage answers it."""
    return F.array(*[contains_any(evidence, words) for _, words, _ in _INTENTS])


def intent_gain(asked: Column, answered: Column) -> Column:
    """What a passage gains, from a question's intents and those that it answers."""
    parts = [F.when(asked[i] & answered[i], F.lit(gain)).otherwise(0.0) for i, (_, _, gain) in enumerate(_INTENTS)]
    return parts[0] + parts[1] + parts[2] + parts[3]


def intent_boost(question: Column, evidence: Column) -> Column:
    """What a passage gains if it answers what a question is after: coding 0.85, practice 0.35, project 0.7, assessment 0.45."""
    return intent_gain(intents(question), answers(evidence))


def low_information(text: Column) -> Column:
    """A form that was left empty: four times "no data", and the sentence that nothing was entered on assessment."""
    text = F.coalesce(text, F.lit(""))
    return (F.regexp_count(text, F.lit(r"(?i)no\s*data")) >= 4) & F.contains(text, F.lit("평가방법이 입력 되지 않았습니다"))


def substantive(question: Column) -> Column:
    """Whether a question asks for more than an empty form can tell."""
    return F.contains(F.coalesce(question, F.lit("")), F.lit("추천")) | contains_any(question, CODING_TERMS) | contains_any(question, PROJECT_TERMS) | contains_any(question, SYNONYMS["실습"])


def broad(question: Column) -> Column:
    """Whether a question is after many courses and names none by its code."""
    return contains_any(question, BROAD_TERMS) & (F.size(course_codes(question)) == 0)


# What is added to a question for a vector search, by intent.
_ADDED = (
    (CODING_TERMS, "Python R 프로그래밍 코딩 데이터분석 소프트웨어 실습 알고리즘 머신러닝"), (PROJECT_TERMS, "프로젝트 PBL 캡스톤 팀 프로젝트 발표 과제"),
    (SYNONYMS["실습"], "실습 구현 분석 소프트웨어 프로젝트 PBL"), (ASSESSMENT_TERMS, "평가방식 성적 중간고사 기말고사 과제 출석 발표"),
)


def retrieval_query(question: Column) -> Column:
    """A question with words of its intents behind it."""
    return F.concat_ws(" ", question, *[F.when(contains_any(question, terms), F.lit(words)) for terms, words in _ADDED])
