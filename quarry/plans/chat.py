"""Conversation queries over chat_turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..operators import conditions as C, conversation as V, rules as R
from ..sources.tables import table
from .catalog import _BARE


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.deliveries_once(table(spark, sf_dir, "chat_turns"))


def _codes(spark, sf_dir):
    return table(spark, sf_dir, "courses").select(T.bare_code(F.col("course_code")).alias("code")).where("code <> ''").distinct()


def _said(spark, sf_dir):
    return V.mentions(_turns(spark, sf_dir), _codes(spark, sf_dir))


def contains_theta_join(spark, sf_dir):
    """Which known courses each turn names."""
    return _said(spark, sf_dir)


def latest_assistant_mention(spark, sf_dir):
    """The courses of each conversation's latest answer that names any."""
    return V.latest_mentioned(_said(spark, sf_dir))


def unique_mention_resolution(spark, sf_dir):
    """What "that course" refers to in each conversation."""
    return V.unique_reference(_said(spark, sf_dir))


def history_truncation(spark, sf_dir):
    """The last eight messages of each conversation, 1,200 characters each."""
    return V.history(_turns(spark, sf_dir))


def semi_previous_set(spark, sf_dir):
    """Required courses among those of the conversation's latest answer."""
    last = V.latest_mentioned(_said(spark, sf_dir)).select("conv_id", "code")
    required = table(spark, sf_dir, "courses").where(F.col("completion_type").isin("전공필수", "교양필수")).select(T.bare_code(F.col("course_code")).alias("code"))
    return last.join(required, "code", "left_semi").select("conv_id", "code")


def anti_missing_set(spark, sf_dir):
    """Required courses of the departments a conversation names that none of its turns does."""
    said = _said(spark, sf_dir).select("conv_id", "code").distinct()
    required = table(spark, sf_dir, "courses").where("completion_type = '전공필수' and credit = '3'").select(F.col("dept_code"), T.bare_code(F.col("course_code")).alias("code")).distinct()
    asked = said.select("conv_id", F.regexp_extract("code", "^([A-Z]+)", 1).alias("dept_code")).distinct()
    return asked.join(required, "dept_code").select("conv_id", "code").distinct().join(said, ["conv_id", "code"], "left_anti")


def _named(spark, sf_dir):
    """Distinct codes and names of the course list."""
    return table(spark, sf_dir, "courses").select(T.bare_code(F.col("course_code")).alias("code"), "course_name").distinct()


def mentions_by_name(spark, sf_dir):
    """Which known courses each turn names, by code or by name."""
    return V.mentions_by_name(_turns(spark, sf_dir), _named(spark, sf_dir))


def latest_answer_courses(spark, sf_dir):
    """The courses, by code or name, of each conversation's latest answer that names any."""
    return V.latest_mentioned(mentions_by_name(spark, sf_dir))


def reference_by_name(spark, sf_dir):
    """What "that course" refers to in each conversation, codes and names looked for."""
    return V.unique_reference(mentions_by_name(spark, sf_dir))


#: Kinds of titles, with the words that ask for them.
CATEGORIES = {"pbl": ("pbl", "피비엘"), "캡스톤": ("캡스톤", "캡스톤디자인"), "현장실습": ("현장실습", "인턴십"), "영강": ("영강", "영어수업", "영어강의")}


def left_out_courses(spark, sf_dir):
    """For user turns that name a kind of title: the courses of that kind that the latest answer before them doesn't name."""
    turns = _turns(spark, sf_dir).where("role = 'user' and text is not null")
    title, name = T.normalize_title(F.col("text")), T.normalize_title(F.col("course_name"))
    kinds = F.array(*[F.when(F.greatest(*[title.contains(w) for w in words]), F.lit(k)) for k, words in CATEGORIES.items()])
    asking = turns.select("conv_id", "turn", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("category"))
    of = F.array(*[F.when(name.contains(k), F.lit(k)) for k in CATEGORIES])
    category = _named(spark, sf_dir).where("code <> ''").select("code", F.explode(F.filter(of, lambda x: x.isNotNull())).alias("category")).distinct()
    return V.missing_of_category(asking, mentions_by_name(spark, sf_dir), category).distinct()


def question_conditions(spark, sf_dir):
    """What each user question demands of a course: kinds and values."""
    professors = table(spark, sf_dir, "courses").select("professor").distinct()
    return C.asked(table(spark, sf_dir, "chat_turns").where("role = 'user'"), professors, "log_id", "text").withColumnRenamed("qid", "log_id")


def condition_matches(spark, sf_dir):
    """For each user question, how many records meet all it demands; several professors are alternatives."""
    demands = question_conditions(spark, sf_dir).withColumnRenamed("log_id", "qid")
    got = C.meeting_all(demands, C.offered(table(spark, sf_dir, "syllabus")), any_of=("professor",))
    return got.groupBy(F.col("qid").alias("log_id")).agg(F.count("*").alias("n_records"))


def mode_routing(spark, sf_dir):
    """The mode of each user question: the first cue that holds, in the cascade's order."""
    t = F.lower(F.coalesce("text", F.lit("")))
    has = lambda *words: F.greatest(*[t.contains(w).cast("int") for w in words], F.lit(0)) == 1
    mode = (
        F.when(has("시간표", "요일", "교시", "monday"), "schedule").when(has("교수", "학점", "professor", "credit"), "course_metadata")
        .when(has("평가", "시험", "grading"), "assessment").when(has("비교", "차이", "compare"), "comparison")
        .when(has("목록", "보여", "list"), "catalog").when(F.size(T.course_codes(F.col("text"))) > 0, "learning").otherwise("fallback")
    )
    return _turns(spark, sf_dir).where("role = 'user'").select("conv_id", "turn", mode.alias("mode"))


def turn_latency(spark, sf_dir):
    """Delivery delay per answer mode: mean, exact median and exact 95th percentile by rank, in seconds."""
    from ..operators.quality import percentile_by_rank

    d = table(spark, sf_dir, "chat_turns").where("asked_at is not null and received_at is not null and role = 'assistant'")
    s = d.select(F.coalesce("answer_mode", F.lit("none")).alias("answer_mode"), F.timestamp_diff("SECOND", F.col("asked_at").cast("timestamp"), F.col("received_at").cast("timestamp")).cast("double").alias("seconds"))
    return percentile_by_rank(s, ["answer_mode"], "seconds", 0.95)


_ONCE = "once AS (SELECT * FROM chat_turns t WHERE log_id = (SELECT min(log_id) FROM chat_turns u WHERE u.conv_id = t.conv_id AND u.turn = t.turn))"
_SAID = f"""{_ONCE}, known AS (SELECT DISTINCT {_BARE} AS code FROM courses WHERE {_BARE} <> ''),
raw AS (SELECT conv_id, turn, role, unnest(list_distinct(list_transform(regexp_extract_all(regexp_replace(text, '([^A-Za-z0-9])', '\\1\\1', 'g'), '(?:^|[^A-Za-z0-9])[A-Za-z]{{2,}}[0-9]{{3}}(?:$|[^A-Za-z0-9])'), lambda x: upper(regexp_extract(x, '[A-Za-z]{{2,}}[0-9]{{3}}'))))) AS code FROM once WHERE text IS NOT NULL),
said AS (SELECT * FROM raw WHERE code IN (SELECT code FROM known)),
latest AS (SELECT conv_id, turn, code FROM said WHERE role = 'assistant' AND turn = (SELECT max(turn) FROM said s WHERE s.conv_id = said.conv_id AND s.role = 'assistant'))
"""
_TITLE = lambda c: f"regexp_replace(lower(replace(replace(replace(replace(replace(coalesce({c}, ''), 'Ⅰ', 'I'), 'Ⅱ', 'II'), 'Ⅲ', 'III'), 'Ⅳ', 'IV'), 'Ⅴ', 'V')), '[^0-9a-z가-힣]', '', 'g')"
_BY_NAME = f"""{_ONCE}, known AS (SELECT DISTINCT {_BARE} AS code, coalesce(course_name, '') AS name FROM courses WHERE {_BARE} <> ''),
named AS (SELECT DISTINCT conv_id, turn, role, code FROM once, known WHERE contains(upper(text), code) OR (name <> '' AND contains(text, name)))"""
_HAS = lambda *w: "(" + " OR ".join(f"contains(t, '{x}')" for x in w) + ")"

SQL = {
    "contains_theta_join": f"WITH {_SAID} SELECT * FROM said",
    "latest_assistant_mention": f"WITH {_SAID} SELECT * FROM latest",
    "unique_mention_resolution": f"""WITH {_SAID}, one AS (SELECT conv_id, turn, role, min(code) AS code FROM said GROUP BY ALL HAVING count(*) = 1)
        SELECT conv_id, turn, code FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY (role = 'user') DESC, turn DESC, code DESC) AS r FROM one) WHERE r = 1""",
    "mentions_by_name": f"WITH {_BY_NAME} SELECT * FROM named",
    "latest_answer_courses": f"WITH {_BY_NAME} SELECT conv_id, turn, code FROM named WHERE role = 'assistant' AND turn = (SELECT max(turn) FROM named s WHERE s.conv_id = named.conv_id AND s.role = 'assistant')",
    "reference_by_name": f"""WITH {_BY_NAME}, one AS (SELECT conv_id, turn, role, min(code) AS code FROM named GROUP BY ALL HAVING count(*) = 1)
        SELECT conv_id, turn, code FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY (role = 'user') DESC, turn DESC, code DESC) AS r FROM one) WHERE r = 1""",
    "left_out_courses": f"""WITH {_BY_NAME}, a AS ({" UNION ALL ".join(f"SELECT conv_id, turn, '{k}' AS category FROM once WHERE role = 'user' AND (" + " OR ".join(f"contains({_TITLE('text')}, '{w}')" for w in words) + ")" for k, words in CATEGORIES.items())}),
        c AS ({" UNION ALL ".join(f"SELECT DISTINCT code, '{k}' AS category FROM known WHERE contains({_TITLE('name')}, '{k}')" for k in CATEGORIES)}),
        l AS (SELECT a.conv_id, a.turn, category, max(n.turn) AS answered FROM a JOIN named n ON n.conv_id = a.conv_id AND n.role = 'assistant' AND n.turn < a.turn GROUP BY ALL)
        SELECT DISTINCT l.conv_id, l.turn, c.code FROM l JOIN c USING (category) WHERE NOT EXISTS (SELECT 1 FROM named n WHERE n.conv_id = l.conv_id AND n.turn = l.answered AND n.role = 'assistant' AND n.code = c.code)""",
    "history_truncation": f"""WITH {_ONCE}, b AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM once)
        SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INT) AS pos, role, substr(coalesce(text, ''), 1, 1200) AS text FROM b WHERE back <= 8""",
    "semi_previous_set": f"WITH {_SAID} SELECT conv_id, code FROM latest WHERE code IN (SELECT {_BARE} FROM courses WHERE completion_type IN ('전공필수', '교양필수'))",
    "anti_missing_set": f"""WITH {_SAID}, a AS (SELECT DISTINCT conv_id, regexp_extract(code, '^[A-Z]+') AS dept_code FROM said), r AS (SELECT DISTINCT dept_code, {_BARE} AS code FROM courses WHERE completion_type = '전공필수' AND credit = '3')
        SELECT DISTINCT conv_id, code FROM a JOIN r USING (dept_code) EXCEPT SELECT conv_id, code FROM said""",
    "mode_routing": f"""WITH {_ONCE}, q AS (SELECT conv_id, turn, lower(coalesce(text, '')) AS t FROM once WHERE role = 'user')
        SELECT conv_id, turn, CASE WHEN {_HAS("시간표", "요일", "교시", "monday")} THEN 'schedule' WHEN {_HAS("교수", "학점", "professor", "credit")} THEN 'course_metadata' WHEN {_HAS("평가", "시험", "grading")} THEN 'assessment'
        WHEN {_HAS("비교", "차이", "compare")} THEN 'comparison' WHEN {_HAS("목록", "보여", "list")} THEN 'catalog' WHEN regexp_matches(t, '(?:^|[^a-z0-9])[a-z]{{2,}}[0-9]{{3}}(?:$|[^a-z0-9])') THEN 'learning' ELSE 'fallback' END AS mode FROM q""",
    "turn_latency": """WITH d AS (SELECT coalesce(answer_mode, 'none') AS answer_mode, CAST(trunc((epoch_us(received_at) - epoch_us(asked_at)) / 1000000.0) AS DOUBLE) AS s FROM chat_turns WHERE asked_at IS NOT NULL AND received_at IS NOT NULL AND role = 'assistant'),
        r AS (SELECT *, row_number() OVER (PARTITION BY answer_mode ORDER BY s) - 1 AS i, count(*) OVER (PARTITION BY answer_mode) AS n FROM d)
        SELECT answer_mode, count(*) AS n, round(avg(s), 6) AS mean, max(CASE WHEN i = floor(0.95 * (n - 1)) THEN s END) AS percentile FROM r GROUP BY answer_mode""",
}
QUERIES = {f.__name__: f for f in (contains_theta_join, latest_assistant_mention, unique_mention_resolution, history_truncation, semi_previous_set, anti_missing_set, mode_routing, turn_latency, mentions_by_name, latest_answer_courses, reference_by_name, left_out_courses, question_conditions, condition_matches)}
