"""Catalog queries: filters, counts, intervals, schedules and evidence lines over courses and syllabi."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions import text as T
from ..operators import catalog as C
from ..sources.tables import table


def _courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "courses")


def _syllabus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "syllabus")


def catalog_filter_eq(spark, sf_dir):
    """Rows of one completion type; the filter reaches the scan."""
    return _courses(spark, sf_dir).where("completion_type = '전공필수'").select("row_id", "course_code", "class_no", "course_name")


def catalog_filter_and(spark, sf_dir):
    """Required courses of three credits that meet on Monday."""
    s = _syllabus(spark, sf_dir).where(F.col("completion_type").isin("전공필수", "교양필수") & (T.canonical_credit(F.col("credit")) == "3"))
    return s.where(F.exists("schedule_entries", lambda e: e["day"] == "월")).select("record_id", "course_code")


def catalog_filter_or(spark, sf_dir):
    """Records whose text names any of several activities."""
    return _syllabus(spark, sf_dir).where(F.col("text").rlike("PBL|팀 과제|토론 참여")).select("record_id")


def catalog_count(spark, sf_dir):
    """Rows and distinct codes by completion type and canonical credit."""
    c = _courses(spark, sf_dir).where(~T.missing(F.col("completion_type")) & ~T.missing(F.col("credit")))
    return c.groupBy("completion_type", T.canonical_credit(F.col("credit")).alias("credit")).agg(F.count("*").alias("n"), F.countDistinct(T.bare_code(F.col("course_code"))).alias("codes"))


def catalog_enumerated(spark, sf_dir):
    """Each department's distinct codes, numbered; departments never share a window."""
    c = _courses(spark, sf_dir).where("dept_code is not null and course_code is not null").select("dept_code", T.bare_code(F.col("course_code")).alias("code")).distinct()
    return c.withColumn("n", F.row_number().over(W.partitionBy("dept_code").orderBy("code")))


def title_contains(spark, sf_dir):
    """Rows whose name in one form holds a key word."""
    t = T.normalize_title(F.col("course_name"))
    return _courses(spark, sf_dir).where(t.contains("캡스톤") | t.contains("영강") | t.contains("pbl")).select("row_id", t.alias("title"))


def longest_name_match(spark, sf_dir):
    """The longest course name contained in each question, all ties kept."""
    turns = table(spark, sf_dir, "chat_turns").where("role = 'user'").select("log_id", "text")
    names = _courses(spark, sf_dir).select("course_name").union(_syllabus(spark, sf_dir).select("course_name"))
    return C.longest_contained(turns, names, "log_id", "text", "course_name")


def explicit_absence(spark, sf_dir):
    """Records whose text says outright that an examination isn't held."""
    return _syllabus(spark, sf_dir).where(F.col("text").rlike("(?:중간고사|기말고사|시험)[^\n]{0,6}(?:없음|미실시|0%)|(?:midterm|final exam) 0%")).select("record_id", "course_code")


def first_evidence_line(spark, sf_dir):
    """The first line of each text that speaks of team work."""
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike("팀 과제|모둠|명씩|[Tt]eam"))
    return _syllabus(spark, sf_dir).where(F.col("text").isNotNull() & (F.size(lines) > 0)).select("record_id", F.get(lines, F.lit(0)).alias("line"))


def feature_evidence(spark, sf_dir):
    """Topics that each text gives evidence for; the topics' patterns are a parameter of the operator."""
    return C.topics(_syllabus(spark, sf_dir), "record_id", "text", TOPICS)


TOPICS = {"project": "프로젝트|캡스톤|[Pp]ortfolio|포트폴리오", "coding": "Python|SQL|코드|(?:^|[^A-Za-z])R로", "practice": "실습|lab ", "debate": "토론|발표|presentation"}


def interval_overlap(spark, sf_dir):
    """Meetings that overlap periods 3 to 5 (both ends included), by day."""
    e = _syllabus(spark, sf_dir).select("record_id", F.explode("schedule_entries").alias("e"))
    return e.where((F.col("e.end_period") >= 3) & (F.col("e.start_period") <= 5)).select("record_id", F.col("e.day").alias("day"), F.col("e.start_period").alias("start_period"), F.col("e.end_period").alias("end_period"))


def point_in_interval(spark, sf_dir):
    """Records per day and period: a meeting counts for each period it covers."""
    e = _syllabus(spark, sf_dir).select("record_id", F.explode("schedule_entries").alias("e")).where("e.start_period <= e.end_period")
    return e.select("record_id", F.col("e.day").alias("day"), F.explode(F.sequence("e.start_period", "e.end_period")).alias("period")).distinct().groupBy("day", "period").agg(F.count("*").alias("n_records"))


def clock_from_period(spark, sf_dir):
    """Each meeting's clock range from its periods, and whether the stored one agrees."""
    e = _syllabus(spark, sf_dir).select("record_id", F.posexplode("schedule_entries").alias("pos", "e")).where("e.start_period is not null and e.end_period is not null")
    begin, end = C.period_begin(F.col("e.start_period")), C.period_end(F.col("e.end_period"))
    return e.select("record_id", "pos", begin.alias("start_time"), end.alias("end_time"), ((begin == F.col("e.start_time")) & (end == F.col("e.end_time"))).alias("agrees"))


def credit_canonical(spark, sf_dir):
    """Spellings of a credit and how many rows use them."""
    c = _courses(spark, sf_dir).where("credit is not null")
    return c.groupBy("credit", T.canonical_credit(F.col("credit")).alias("canonical")).agg(F.count("*").alias("n"))


def class_number_padded(spark, sf_dir):
    """Class numbers padded to two digits, never cut."""
    c = _courses(spark, sf_dir).where("class_no is not null").groupBy("class_no").agg(F.count("*").alias("n"))
    return c.select("class_no", T.zfill(F.trim("class_no"), 2).alias("padded"), "n")


def schedule_filter(spark, sf_dir):
    """Records with a meeting on Thursday that overlaps periods 2 to 4, with those meetings' displays joined."""
    hit = F.filter("schedule_entries", lambda e: (e["day"] == "목") & (e["end_period"] >= 2) & (e["start_period"] <= 4))
    return _syllabus(spark, sf_dir).where(F.size(hit) > 0).select("record_id", F.array_join(F.transform(hit, lambda e: e["display"]), " / ").alias("schedule"))


def group_codes(spark, sf_dir):
    """The codes of each professor, in order."""
    s = _syllabus(spark, sf_dir).where(~T.missing(F.col("professor"))).select("professor", T.bare_code(F.col("course_code")).alias("code")).where("code <> ''").distinct()
    return s.groupBy("professor").agg(F.array_join(F.sort_array(F.collect_list("code")), ",").alias("codes"), F.count("*").cast("bigint").alias("n"))


def search_ahead(spark, sf_dir):
    """Distinct course, code and professor rows whose joined text holds a typed word."""
    c = _courses(spark, sf_dir).where(F.lower(F.concat_ws(" ", "course_name", "course_code", "professor")).contains("영상"))
    return c.select("course_name", T.bare_code(F.col("course_code")).alias("code"), "professor").distinct()


def question_filters(spark, sf_dir):
    """What users filter by (a weekday, a code, both): how many questions ask it, how many courses meet it."""
    q = table(spark, sf_dir, "chat_turns").where("role = 'user'").select(C.weekday(F.col("text")).alias("day"), F.get(T.course_codes(F.col("text")), F.lit(0)).alias("code"))
    q = q.where("day is not null or code is not null").groupBy("day", "code").agg(F.count("*").alias("n_questions"))
    facts = _syllabus(spark, sf_dir).select(T.bare_code(F.col("course_code")).alias("code"), F.explode("schedule_entries").alias("e")).select("code", F.col("e.day").alias("day")).where("code <> '' and day is not null").withColumn("course", F.col("code"))
    n = C.conjunctive_matches(facts, q, ["day", "code"], "course").groupBy(F.col("day").alias("_d"), F.col("code").alias("_c")).agg(F.count("*").alias("n"))
    j = q.join(n, F.col("day").eqNullSafe(F.col("_d")) & F.col("code").eqNullSafe(F.col("_c")), "left")
    return j.select("day", "code", "n_questions", F.coalesce("n", F.lit(0)).alias("n_courses"))


def attachment_kinds(spark, sf_dir):
    """Extension of each attachment from its URL, else its path, else .bin, against the stored one."""
    c = _courses(spark, sf_dir).where("attachment_url <> '' or attachment_path <> ''")
    ext = lambda x: F.nullif(F.lower(F.regexp_extract(F.coalesce(F.col(x), F.lit("")), r"(\.[A-Za-z0-9]{2,5})(?:[?#].*)?$", 1)), F.lit(""))
    return c.groupBy(F.coalesce(ext("attachment_url"), ext("attachment_path"), F.lit(".bin")).alias("extension"), "attachment_ext").agg(F.count("*").alias("n"))


_BARE = "upper(regexp_replace(translate(course_code, '" + "".join(map(chr, range(0xFF01, 0xFF5F))) + "', '" + "".join(map(chr, range(0x21, 0x7F))).replace("'", "''") + "'), '[ \\t\\n　 ]+', '', 'g'))"
_MISS = "lower(trim(coalesce({c}, ''))) IN ('', 'none', 'null', 'nan', 'n/a', 'no data', 'no data.')"
_CREDIT = "regexp_replace(trim(credit), '\\.0+$', '')"
_TITLE = "regexp_replace(lower(replace(replace(replace(replace(replace(course_name, 'Ⅰ', 'I'), 'Ⅱ', 'II'), 'Ⅲ', 'III'), 'Ⅳ', 'IV'), 'Ⅴ', 'V')), '[^0-9a-z가-힣]', '', 'g')"
_EXT = "nullif(lower(regexp_extract(coalesce({c}, ''), '(\\.[A-Za-z0-9]{{2,5}})(?:[?#].*)?$', 1)), '')"

SQL = {
    "catalog_filter_eq": "SELECT row_id, course_code, class_no, course_name FROM courses WHERE completion_type = '전공필수'",
    "catalog_filter_and": f"SELECT record_id, course_code FROM syllabus WHERE completion_type IN ('전공필수', '교양필수') AND {_CREDIT} = '3' AND len(list_filter(schedule_entries, lambda e: e.day = '월')) > 0",
    "catalog_filter_or": "SELECT record_id FROM syllabus WHERE contains(text, 'PBL') OR contains(text, '팀 과제') OR contains(text, '토론 참여')",
    "catalog_count": f"SELECT completion_type, {_CREDIT} AS credit, count(*) AS n, count(DISTINCT {_BARE}) AS codes FROM courses WHERE NOT {_MISS.format(c='completion_type')} AND NOT {_MISS.format(c='credit')} GROUP BY 1, 2",
    "catalog_enumerated": f"SELECT dept_code, code, row_number() OVER (PARTITION BY dept_code ORDER BY code) AS n FROM (SELECT DISTINCT dept_code, {_BARE} AS code FROM courses WHERE dept_code IS NOT NULL AND course_code IS NOT NULL)",
    "title_contains": f"SELECT row_id, title FROM (SELECT row_id, {_TITLE} AS title FROM courses) WHERE contains(title, '캡스톤') OR contains(title, '영강') OR contains(title, 'pbl')",
    "longest_name_match": f"""WITH n AS (SELECT DISTINCT title FROM (SELECT {_TITLE} AS title FROM courses UNION SELECT {_TITLE} FROM syllabus) WHERE length(title) >= 2),
        t AS (SELECT log_id, {_TITLE.replace('course_name', 'text')} AS q FROM chat_turns WHERE role = 'user' AND text IS NOT NULL),
        h AS (SELECT log_id, title, rank() OVER (PARTITION BY log_id ORDER BY length(title) DESC) AS r FROM t JOIN n ON contains(q, title))
        SELECT log_id, title FROM h WHERE r = 1""",
    "explicit_absence": "SELECT record_id, course_code FROM syllabus WHERE regexp_matches(text, '(?:중간고사|기말고사|시험)[^\\n]{0,6}(?:없음|미실시|0%)|(?:midterm|final exam) 0%')",
    "first_evidence_line": "SELECT record_id, l[1] AS line FROM (SELECT record_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '팀 과제|모둠|명씩|[Tt]eam')) AS l FROM syllabus) WHERE len(l) > 0",
    "feature_evidence": "SELECT record_id, topic FROM syllabus, (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in TOPICS.items()) + ") AS t(topic, p) WHERE regexp_matches(text, p)",
    "interval_overlap": "SELECT record_id, e.day AS day, e.start_period AS start_period, e.end_period AS end_period FROM (SELECT record_id, unnest(schedule_entries) AS e FROM syllabus) WHERE e.end_period >= 3 AND e.start_period <= 5",
    "point_in_interval": "SELECT day, period, count(*) AS n_records FROM (SELECT DISTINCT record_id, e.day AS day, CAST(unnest(generate_series(e.start_period, e.end_period)) AS INT) AS period FROM (SELECT record_id, unnest(schedule_entries) AS e FROM syllabus) WHERE e.start_period <= e.end_period) GROUP BY day, period",
    "clock_from_period": """SELECT record_id, CAST(pos AS INT) AS pos, b AS start_time, n AS end_time, (b = e.start_time) AND (n = e.end_time) AS agrees FROM (
        SELECT record_id, pos - 1 AS pos, e, lpad(CAST(8 + e.start_period AS VARCHAR), 2, '0') || ':00' AS b, lpad(CAST(8 + e.end_period AS VARCHAR), 2, '0') || ':50' AS n FROM (SELECT record_id, unnest(schedule_entries) AS e, generate_subscripts(schedule_entries, 1) AS pos FROM syllabus) WHERE e.start_period IS NOT NULL AND e.end_period IS NOT NULL)""",
    "credit_canonical": f"SELECT credit, {_CREDIT} AS canonical, count(*) AS n FROM courses WHERE credit IS NOT NULL GROUP BY 1, 2",
    "class_number_padded": "SELECT class_no, CASE WHEN length(trim(class_no)) < 2 THEN lpad(trim(class_no), 2, '0') ELSE trim(class_no) END AS padded, count(*) AS n FROM courses WHERE class_no IS NOT NULL GROUP BY 1, 2",
    "schedule_filter": "SELECT record_id, array_to_string(list_transform(h, lambda e: e.display), ' / ') AS schedule FROM (SELECT record_id, list_filter(schedule_entries, lambda e: e.day = '목' AND e.end_period >= 2 AND e.start_period <= 4) AS h FROM syllabus) WHERE len(h) > 0",
    "group_codes": f"SELECT professor, string_agg(code, ',' ORDER BY code) AS codes, count(*) AS n FROM (SELECT DISTINCT professor, {_BARE} AS code FROM syllabus WHERE NOT {_MISS.format(c='professor')}) WHERE code <> '' GROUP BY professor",
    "search_ahead": f"SELECT DISTINCT course_name, {_BARE} AS code, professor FROM courses WHERE contains(lower(concat_ws(' ', course_name, course_code, professor)), '영상')",
    "question_filters": f"""WITH t AS (SELECT nullif(regexp_extract(text, '([월화수목금토일])요일', 1), '') AS day, nullif(upper(regexp_extract(regexp_extract(regexp_replace(text, '([^A-Za-z0-9])', '\\1\\1', 'g'), '(?:^|[^A-Za-z0-9])[A-Za-z]{{2,}}[0-9]{{3}}(?:$|[^A-Za-z0-9])'), '[A-Za-z]{{2,}}[0-9]{{3}}')), '') AS code FROM chat_turns WHERE role = 'user'),
        q AS (SELECT day, code, count(*) AS n_questions FROM t WHERE day IS NOT NULL OR code IS NOT NULL GROUP BY day, code),
        f AS (SELECT DISTINCT {_BARE} AS code, e.day AS day FROM (SELECT course_code, unnest(schedule_entries) AS e FROM syllabus))
        SELECT q.day, q.code, n_questions, (SELECT count(DISTINCT f.code) FROM f WHERE f.code <> '' AND f.day IS NOT NULL AND (q.day IS NULL OR f.day = q.day) AND (q.code IS NULL OR f.code = q.code)) AS n_courses FROM q""",
    "attachment_kinds": f"SELECT coalesce({_EXT.format(c='attachment_url')}, {_EXT.format(c='attachment_path')}, '.bin') AS extension, attachment_ext, count(*) AS n FROM courses WHERE attachment_url <> '' OR attachment_path <> '' GROUP BY 1, 2",
}
QUERIES = {
    f.__name__: f
    for f in (catalog_filter_eq, catalog_filter_and, catalog_filter_or, catalog_count, catalog_enumerated, title_contains, longest_name_match, explicit_absence, first_evidence_line, feature_evidence, interval_overlap, point_in_interval, clock_from_period, credit_canonical, class_number_padded, schedule_filter, group_codes, search_ahead, question_filters, attachment_kinds)
}
