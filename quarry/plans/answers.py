"""What answers are made of: fields, assessments, topics and sections of the courses that questions name; keys and forms of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..operators import dedup as D, rules as R, segment
from ..operators.multivalue import split_packed
from ..sources.tables import table
from . import search
from .catalog import _BARE
from .dedup import _NAME, _links, _named
from .extraction import _ITEMS, _LINES, _assessment, weekly_topics
from .search import _NAMED
from .text import _ANY, _CLEAN, R as _RULES


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "syllabus").select("record_id", T.bare_code(F.col("course_code")).alias("code"), "course_name", "professor", "completion_type", "credit", "schedule_summary")


def _asked(spark, sf_dir, terms: tuple[str, ...]) -> DataFrame:
    """``log_id, code``: the courses named by user questions that hold one of the terms."""
    about = table(spark, sf_dir, "chat_turns").where("role = 'user'").where(R.contains_any(F.col("text"), terms)).select("log_id")
    return search.named_courses(spark, sf_dir).join(about, "log_id")


def course_metadata(spark, sf_dir):
    """For questions on teachers, credits or kinds of completion: what the records of the courses they name say, each reading with its number of records."""
    fields = ["professor", "completion_type", "credit"]
    said = _records(spark, sf_dir).unpivot(["record_id", "code"], fields, "field", "value").where(~T.missing(F.col("value")))
    per = said.groupBy("code", "field", F.trim("value").alias("value")).agg(F.count("*").alias("n_records"))
    return _asked(spark, sf_dir, METADATA).join(per, "code").select("log_id", "code", "field", "value", "n_records")


def course_assessment(spark, sf_dir):
    """For questions on assessment: the items of the courses they name, with the least and the largest share that a record states."""
    per = _assessment(spark, sf_dir).join(_records(spark, sf_dir).select("record_id", "code"), "record_id").groupBy("code", "item").agg(F.min("share").alias("least"), F.max("share").alias("most"), F.countDistinct("record_id").alias("n_records"))
    return _asked(spark, sf_dir, GRADING).join(per, "code").select("log_id", "code", "item", "least", "most", "n_records")


def course_learning(spark, sf_dir):
    """For all questions that name a course: how many weeks and different topics its records list."""
    per = weekly_topics(spark, sf_dir).join(_records(spark, sf_dir).select("record_id", "code"), "record_id").groupBy("code").agg(F.countDistinct("week").alias("n_weeks"), F.countDistinct("topic").alias("n_topics"))
    return search.named_courses(spark, sf_dir).join(per, "code").select("log_id", "code", "n_weeks", "n_topics")


#: Words of questions on fields, and on assessment.
METADATA = ("교수", "학점", "이수구분", "professor", "credit")
GRADING = ("평가", "시험", "중간", "기말", "과제", "출석", "성적", "midterm", "grading")


def retrieval_queries(spark, sf_dir):
    """User questions as they go to a vector search, by their digest, and whether they are in the collection's scope."""
    t = table(spark, sf_dir, "chat_turns").where("role = 'user' and text is not null")
    return t.select("log_id", F.md5(R.retrieval_query(F.col("text"))).alias("query"), T.in_scope(F.col("text"), 2031).alias("in_scope"))


def text_forms(spark, sf_dir):
    """Digests of every record's text in its forms: cleaned, without checklists, as a key of similarity, with single blanks."""
    c = F.col("text")
    forms = {"cleaned": T.clean_text(c), "without_checklists": T.without_checklists(c), "similarity_key": T.similarity_key(c), "spaced": T.spaced_key(c)}
    return table(spark, sf_dir, "syllabus").where("text is not null").select("record_id", *[F.md5(x).alias(n) for n, x in forms.items()])


def sanitized_lengths(spark, sf_dir):
    """How much of every text lists without ticks and sentences of empty forms take."""
    return table(spark, sf_dir, "syllabus").where("text is not null").select("record_id", (F.length("text") - F.length(T.without_empty_forms(F.col("text")))).alias("n_removed"))


def file_stems(spark, sf_dir):
    """File names of the sections, with how many rows share them."""
    c = table(spark, sf_dir, "courses").where("course_code is not null and class_no is not null")
    return c.groupBy(T.file_stem(F.col("course_code"), F.col("class_no"), F.col("course_name")).alias("stem")).agg(F.count("*").alias("n"))


def schedule_structs(spark, sf_dir):
    """Every meeting of the raw schedules, in any notation, as its day, periods, clock range and place."""
    c = table(spark, sf_dir, "courses")
    values = split_packed(c, "row_id", {"schedule_raw": False}, 1)
    return values.join(c.select("row_id", "class_no"), "row_id").select("row_id", "pos", T.meeting(F.col("value"), F.col("class_no")).alias("m")).where("m is not null").select("row_id", "pos", "m.*")


def section_texts(spark, sf_dir):
    """Per record and section, its text in one piece: digest and length."""
    chunks = segment.section_chunks(table(spark, sf_dir, "syllabus"), "record_id", "text")
    ordered = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_no", "chunk"))), lambda x: x["chunk"]), "\n")
    return chunks.groupBy("record_id", "section").agg(F.length(ordered).alias("n_chars"), F.md5(ordered).alias("digest"))


def dedup_report(spark, sf_dir):
    """Every record with the record that stands for it and what was decided: kept, copy, or near copy with its similarity."""
    members, classes, links = _links(spark, sf_dir)
    rank = classes.select("class", F.struct((-F.col("longest")).alias("n"), "class").alias("rank"))
    kept = D.greedy_survivors(classes, links, rank)
    both = links.select("a", "b", "similarity").union(links.select("b", "a", "similarity")).toDF("class", "keeper", "similarity")
    j = members.join(kept, "class").join(both, ["class", "keeper"], "left").join(_named(spark, sf_dir).select("record_id", "name"), "record_id")
    decision = F.when(F.col("class") != F.col("keeper"), "near copy").when(F.col("record_id") != F.col("class"), "copy").otherwise("kept")
    return j.select("name", "record_id", F.col("keeper").alias("stands_for_it"), F.round(F.coalesce("similarity", F.lit(1.0)), 6).alias("similarity"), F.lit(0.8).alias("threshold"), decision.alias("decision"))


def canonical_records(spark, sf_dir):
    """Digest of each record's meetings as JSON with sorted names, and how many records share it."""
    s = table(spark, sf_dir, "syllabus")
    kind = s.schema["schedule_entries"].dataType.elementType
    each = F.array_join(F.transform("schedule_entries", lambda e: T.canonical_json(e, kind)), ",")
    return s.where(F.size("schedule_entries") > 0).groupBy(F.md5(each).alias("digest")).agg(F.count("*").alias("n_records"), F.min("record_id").alias("first"))


_Q = "SELECT log_id AS qid, text AS q FROM chat_turns WHERE role = 'user'"
_NAMES = _NAMED(_Q, "SELECT course_code AS code, course_name FROM courses")
_REC = f"rec AS (SELECT record_id, {_BARE} AS code, professor, completion_type, credit FROM syllabus)"
_ABOUT = lambda terms: f"about AS (SELECT qid, code FROM named WHERE qid IN (SELECT log_id FROM chat_turns WHERE role = 'user' AND {_ANY('text', terms)}))"
_MISSING = "lower(trim(v)) NOT IN ('', 'none', 'null', 'nan', 'n/a', 'no data', 'no data.')"
_UNDECIDED = "(?i)수업유형\\s+(?:대면\\s+대면\\s+)?(?:비대면\\s+비대면\\s+)?(?:병행\\(대면&비대면 동시\\)\\s+병행\\(대면&비대면 동시\\)\\s+)?미정"
_CLEANED = lambda c: _CLEAN.replace("coalesce(text, '')", c)
_QUERY = "concat_ws(' ', text, " + ", ".join(f"CASE WHEN {_ANY('text', terms)} THEN '{words}' END" for terms, words in _RULES._ADDED) + ")"

SQL = {
    "course_metadata": f"""WITH {_NAMES}, {_REC}, {_ABOUT(METADATA)}, f AS (SELECT code, field, trim(v) AS value, count(*) AS n_records FROM (UNPIVOT rec ON professor, completion_type, credit INTO NAME field VALUE v) WHERE {_MISSING} GROUP BY ALL)
        SELECT qid AS log_id, code, field, value, n_records FROM about JOIN f USING (code)""",
    "course_assessment": f"""WITH {_NAMES}, {_REC}, {_ABOUT(GRADING)}, {_ITEMS}, f AS (SELECT code, item, min(share) AS least, max(share) AS most, count(DISTINCT record_id) AS n_records FROM items JOIN rec USING (record_id) GROUP BY ALL)
        SELECT qid AS log_id, code, item, least, most, n_records FROM about JOIN f USING (code)""",
    "course_learning": f"""WITH {_NAMES}, {_REC}, {_LINES}, w AS (SELECT record_id, CAST(regexp_extract(line, '^(?:Week )?([0-9]{{1,2}})', 1) AS INT) AS week, regexp_extract(line, '^(?:[0-9]{{1,2}}주차|Week [0-9]{{1,2}}): ([^\\r]*)', 1) AS topic FROM lines WHERE regexp_matches(line, '^(?:[0-9]{{1,2}}주차|Week [0-9]{{1,2}}): ')),
        f AS (SELECT code, count(DISTINCT week) AS n_weeks, count(DISTINCT topic) AS n_topics FROM w JOIN rec USING (record_id) GROUP BY code)
        SELECT qid AS log_id, code, n_weeks, n_topics FROM named JOIN f USING (code)""",
    "retrieval_queries": f"""SELECT log_id, md5({_QUERY}) AS query, len(list_filter(regexp_extract_all(lower(text), '(20[0-9]{{2}})\\s*학년도?', 1), lambda y: y <> '2031')) = 0 AND NOT regexp_matches(lower(text), '2학기|여름학기|겨울학기|계절학기') AS in_scope FROM chat_turns WHERE role = 'user' AND text IS NOT NULL""",
    "text_forms": f"""SELECT record_id, md5({_CLEAN}) AS cleaned, md5({_CLEANED(f"regexp_replace(regexp_replace({_CLEAN}, '(?is)활동유형.*?((?:▷[[:space:]]*)?평가방법)', '\\1', 'g'), '{_UNDECIDED}', '', 'g')")}) AS without_checklists,
        md5(lower(regexp_replace(regexp_replace(CASE WHEN contains(text, chr(10) || chr(10)) THEN substr(text, strpos(text, chr(10) || chr(10)) + 2) ELSE text END, 'https?://[^ \\t\\n\\v\\f\\r]+', ' ', 'g'), '[ \\t\\n\\v\\f\\r]+', '', 'g'))) AS similarity_key,
        md5(lower(trim(regexp_replace(text, '[ \\t\\n\\v\\f\\r]+', ' ', 'g')))) AS spaced FROM syllabus WHERE text IS NOT NULL""",
    "file_stems": "SELECT course_code || '_' || class_no || CASE WHEN n <> '' THEN '_' || n ELSE '' END AS stem, count(*) AS n FROM (SELECT *, regexp_replace(regexp_replace(coalesce(course_name, ''), '[^A-Za-z0-9가-힣_.-]+', '_', 'g'), '^_+|_+$', '', 'g') AS n FROM courses WHERE course_code IS NOT NULL AND class_no IS NOT NULL) GROUP BY 1",
}
QUERIES = {f.__name__: f for f in (course_metadata, course_assessment, course_learning, retrieval_queries, text_forms, sanitized_lengths, file_stems, schedule_structs, section_texts, dedup_report, canonical_records)}
