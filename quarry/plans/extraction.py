"""Extraction queries: labelled fields, weekly topics, assessments, schedules, context selection, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions import text as T
from ..operators import evaluation as E
from ..operators import retrieval as R
from ..sources.pages import json_objects
from ..sources.tables import table
from .catalog import _BARE
from .retrieval import _CASE, _COS, _case_scores, _questions, _vectors


def _syllabus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "syllabus")


def _lines(spark, sf_dir):
    """Lines of every text, narrow: one row per line, with its place."""
    return _syllabus(spark, sf_dir).where("text is not null").select("record_id", "site_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def labelled_fields(spark, sf_dir):
    """Code, section, credit and term as the text's header states them, and whether the record's own fields agree."""
    s = _syllabus(spark, sf_dir).where("text is not null")
    got = lambda p: F.nullif(F.regexp_extract("text", p, 1), F.lit(""))
    code, credit = got(r"(?:학수번호|Code): ?([A-Z]{4}[0-9]{3})"), got(r"(?:학점|Credit) ([0-9]+)")
    return s.select("record_id", code.alias("code"), got(r"(?:분반|Section): ?([0-9]+)").alias("section"), credit.alias("credit"), got(r"(?:학기|Term) ([0-9]{4}-[0-9][A-Z])").alias("term"), (code == T.bare_code(F.col("course_code"))).alias("code_agrees"), (credit == T.canonical_credit(F.col("credit"))).alias("credit_agrees"))


def weekly_topics(spark, sf_dir):
    """Week and topic of every weekly line."""
    k = _lines(spark, sf_dir).where(F.col("line").rlike(r"^(?:[0-9]{1,2}주차|Week [0-9]{1,2}): "))
    week = F.regexp_extract("line", r"^(?:Week )?([0-9]{1,2})", 1).cast("int")
    return k.select("record_id", "line_no", week.alias("week"), F.regexp_extract("line", r"^(?:[0-9]{1,2}주차|Week [0-9]{1,2}): ([^\r]*)", 1).alias("topic"))


def _assessment(spark, sf_dir):
    k = _lines(spark, sf_dir).where(F.col("line").rlike("^(?:평가방법|Grading): "))
    items = F.regexp_extract_all("line", F.lit(r"([가-힣A-Za-z ]+) [0-9]{1,3}%"), F.lit(1))
    shares = F.regexp_extract_all("line", F.lit(r"[가-힣A-Za-z ]+ ([0-9]{1,3})%"), F.lit(1))
    return k.select("record_id", "line_no", F.explode(F.arrays_zip(items.alias("item"), shares.alias("share"))).alias("z")).select("record_id", "line_no", F.trim("z.item").alias("item"), F.col("z.share").cast("int").alias("share"))


def assessment_items(spark, sf_dir):
    """Items and percentages of every assessment line."""
    return _assessment(spark, sf_dir)


def assessment_conflicts(spark, sf_dir):
    """Sections whose records state different percentages for one item: all are shown, none is chosen."""
    from pyspark.sql.functions import countDistinct

    key = _syllabus(spark, sf_dir).select("record_id", F.concat_ws("-", "year", "term", T.bare_code(F.col("course_code")), F.trim("class_no")).alias("section")).where("course_code is not null and class_no is not null")
    j = _assessment(spark, sf_dir).join(key, "record_id")
    return j.groupBy("section", "item").agg(countDistinct("share").alias("n_shares"), F.array_join(F.transform(F.sort_array(F.collect_set("share")), lambda x: x.cast("string")), ",").alias("shares")).where("n_shares > 1")


def assessment_spread(spark, sf_dir):
    """Courses whose records state different percentages for one item: all are shown, none is chosen."""
    key = _syllabus(spark, sf_dir).select("record_id", T.bare_code(F.col("course_code")).alias("code")).where("code <> ''")
    per = _assessment(spark, sf_dir).join(key, "record_id").groupBy("code", "item").agg(F.collect_set("share").alias("s")).where(F.size("s") > 1)
    return per.select("code", "item", F.size("s").cast("bigint").alias("n_shares"), F.array_join(F.transform(F.sort_array("s"), lambda x: x.cast("string")), ",").alias("shares"))


def section_summary(spark, sf_dir):
    """The first 420 characters after each text's heading of objectives, up to the line's end."""
    s = _syllabus(spark, sf_dir).where("text is not null").select("record_id", F.regexp_extract("text", r"(?:▷ 수업목표|학습목표:|\[목표\]|Objectives:) ([^\r\n]*)", 1).alias("t"))
    return s.where("t <> ''").select("record_id", F.substring("t", 1, 420).alias("summary"))


def sanitized_texts(spark, sf_dir):
    """Length of each text with and without attachment marks, empty form lines and site buttons."""
    noise = r"(?md)^(?:\[첨부[^\n]*\]|학번: +이름: +\([^\n]*\)|\[목록으로\] \[맨 위로\])\r?$"
    return _syllabus(spark, sf_dir).where("text is not null").select("record_id", F.length("text").alias("before"), F.length(F.regexp_replace("text", noise, "")).alias("after"))


def schedule_rebuilt(spark, sf_dir):
    """Each record's schedule summary rebuilt from its entries."""
    s = _syllabus(spark, sf_dir).where(F.size("schedule_entries") > 0)
    display = F.array_join(F.transform(F.filter("schedule_entries", lambda e: F.coalesce(e["display"], F.lit("")) != ""), lambda e: e["display"]), " / ")
    return s.select("record_id", F.size("schedule_entries").alias("n_entries"), display.alias("summary"))


def schedule_projection(spark, sf_dir):
    """Day, periods and clock range of every entry, in order."""
    e = _syllabus(spark, sf_dir).select("record_id", F.posexplode("schedule_entries").alias("pos", "e"))
    return e.select("record_id", "pos", F.concat_ws("|", "e.day", "e.periods", "e.start_time", "e.end_time").alias("entry"))


def schedule_objects(spark, sf_dir):
    """The meetings in the JSON of the course list, where it is JSON: day and display of every object."""
    c = json_objects(table(spark, sf_dir, "courses").select("row_id", "schedule_entries_json"), "row_id", "schedule_entries_json")
    return c.select("row_id", "object_no", F.col("fields")["day"].alias("day"), F.col("fields")["display"].alias("display"))


def vector_hit_lookup(spark, sf_dir):
    """Each query vector's five nearest rows with the document of the same id, where there is one."""
    hits = R.cosine_top_k(*_vectors(spark, sf_dir), 5)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "course_code")
    return hits.join(docs, "vec_id", "left").select("qid", "vec_id", "rank", F.coalesce("course_code", F.lit("unknown")).alias("course_code"))


def _ranked(spark, sf_dir, k):
    return R.top_k(_case_scores(spark, sf_dir), k).join(table(spark, sf_dir, "documents").select("doc_id", "course_code", "source"), "doc_id")


def source_payload(spark, sf_dir):
    """Each question's courses in the order of their best document, with the sources of their documents."""
    r = _ranked(spark, sf_dir, 20).where("course_code is not null")
    return r.groupBy("qid", "course_code").agg(F.min("rank").alias("rank"), F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"))


def explicit_priority(spark, sf_dir):
    """Documents of the courses a question names come first, at most two each, then the rest by rank."""
    q = _questions(spark, sf_dir).select(F.col("id").alias("qid"), T.course_codes(F.col("question")).alias("codes"))
    r = _ranked(spark, sf_dir, 20).join(q, "qid").withColumn("named", F.coalesce(F.array_contains("codes", F.col("course_code")), F.lit(False)))
    r = r.withColumn("nth", F.row_number().over(W.partitionBy("qid", "course_code", "named").orderBy("rank"))).withColumn("first", F.col("named") & (F.col("nth") <= 2))
    return r.select("qid", "doc_id", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("first"), "rank")).alias("position"), "first")


def context_selection(spark, sf_dir):
    """The five best documents and, of the two best courses, the next document that isn't among them."""
    r = _ranked(spark, sf_dir, 30)
    courses = E.ranked_codes(r.where("rank <= 5")).where("pos <= 2").select("qid", F.col("code").alias("course_code"))
    more = r.where("rank > 5").join(courses, ["qid", "course_code"], "left_semi").withColumn("n", F.row_number().over(W.partitionBy("qid", "course_code").orderBy("rank"))).where("n = 1")
    return r.where("rank <= 5").select("qid", "doc_id", "rank").union(more.select("qid", "doc_id", "rank"))


def label_evidence(spark, sf_dir):
    """Labelled snippets per section, over all cases."""
    return E.snippets(table(spark, sf_dir, "retrieval_cases")).groupBy("section").agg(F.count("*").alias("n"), F.countDistinct("snippet").alias("distinct_snippets"))


def coverage_join(spark, sf_dir):
    """Per code of the course list: its rows and how many records were extracted for it."""
    c = table(spark, sf_dir, "courses").groupBy(T.bare_code(F.col("course_code")).alias("code")).agg(F.count("*").alias("n_rows")).where("code <> ''")
    s = _syllabus(spark, sf_dir).groupBy(T.bare_code(F.col("course_code")).alias("code")).agg(F.count("*").alias("n"))
    return c.join(s, "code", "left").select("code", "n_rows", F.coalesce("n", F.lit(0)).alias("n_records"))


def answer_mode_counts(spark, sf_dir):
    """Turns, distinct questions and conversations by answer mode."""
    t = table(spark, sf_dir, "chat_turns")
    return t.groupBy(F.coalesce("answer_mode", F.lit("none")).alias("answer_mode"), "role").agg(F.count("*").alias("n"), F.countDistinct("text").alias("texts"), F.countDistinct("conv_id").alias("conversations"))


def orders_by_nation(spark, sf_dir):
    """Orders and totals by region and nation: the star's small sides are looked up, the large one is scanned once."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.count("*").alias("n_orders"), F.sum("o_totalprice").alias("total"))
    return j.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("r_name", "n_name", "n_orders", F.round("total", 2).alias("total"))


_LINES = "lines AS (SELECT record_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS line_no FROM (SELECT record_id, string_split(text, chr(10)) AS l FROM syllabus WHERE text IS NOT NULL))"
_ITEMS = f"""{_LINES}, a AS (SELECT record_id, line_no, regexp_extract_all(line, '([가-힣A-Za-z ]+) [0-9]{{1,3}}%', 1) AS i, regexp_extract_all(line, '[가-힣A-Za-z ]+ ([0-9]{{1,3}})%', 1) AS s FROM lines WHERE regexp_matches(line, '^(?:평가방법|Grading): ')),
items AS (SELECT record_id, CAST(line_no AS INT) AS line_no, trim(unnest(i)) AS item, CAST(unnest(s) AS INT) AS share FROM a)"""
_GOT = lambda p: f"nullif(regexp_extract(text, '{p}', 1), '')"
_CREDIT = "regexp_replace(trim(credit), '\\.0+$', '')"
_CODES = "list_transform(regexp_extract_all(regexp_replace(question, '([^A-Za-z0-9])', '\\1\\1', 'g'), '(?:^|[^A-Za-z0-9])[A-Za-z]{2,}[0-9]{3}(?:$|[^A-Za-z0-9])'), lambda x: upper(regexp_extract(x, '[A-Za-z]{2,}[0-9]{3}')))"

SQL = {
    "labelled_fields": f"SELECT record_id, code, section, c AS credit, term, code = {_BARE} AS code_agrees, c = {_CREDIT} AS credit_agrees FROM (SELECT record_id, course_code, credit, {_GOT('(?:학수번호|Code): ?([A-Z]{4}[0-9]{3})')} AS code, {_GOT('(?:분반|Section): ?([0-9]+)')} AS section, {_GOT('(?:학점|Credit) ([0-9]+)')} AS c, {_GOT('(?:학기|Term) ([0-9]{4}-[0-9][A-Z])')} AS term FROM syllabus WHERE text IS NOT NULL)",
    "weekly_topics": f"WITH {_LINES} SELECT record_id, CAST(line_no AS INT) AS line_no, CAST(regexp_extract(line, '^(?:Week )?([0-9]{{1,2}})', 1) AS INT) AS week, regexp_extract(line, '^(?:[0-9]{{1,2}}주차|Week [0-9]{{1,2}}): ([^\\r]*)', 1) AS topic FROM lines WHERE regexp_matches(line, '^(?:[0-9]{{1,2}}주차|Week [0-9]{{1,2}}): ')",
    "assessment_items": f"WITH {_ITEMS} SELECT * FROM items",
    "assessment_conflicts": f"""WITH {_ITEMS}, k AS (SELECT record_id, concat_ws('-', year, term, {_BARE}, trim(class_no)) AS section FROM syllabus WHERE course_code IS NOT NULL AND class_no IS NOT NULL)
        SELECT section, item, count(DISTINCT share) AS n_shares, array_to_string(list_sort(list(DISTINCT share)), ',') AS shares FROM items JOIN k USING (record_id) GROUP BY section, item HAVING count(DISTINCT share) > 1""",
    "assessment_spread": f"WITH {_ITEMS}, k AS (SELECT record_id, {_BARE} AS code FROM syllabus) SELECT code, item, count(DISTINCT share) AS n_shares, array_to_string(list_sort(list(DISTINCT share)), ',') AS shares FROM items JOIN k USING (record_id) WHERE code <> '' GROUP BY code, item HAVING count(DISTINCT share) > 1",
    "section_summary": "SELECT record_id, substr(t, 1, 420) AS summary FROM (SELECT record_id, regexp_extract(text, '(?:▷ 수업목표|학습목표:|\\[목표\\]|Objectives:) ([^\\r\\n]*)', 1) AS t FROM syllabus WHERE text IS NOT NULL) WHERE t <> ''",
    "sanitized_texts": "SELECT record_id, CAST(length(text) AS INT) AS before, CAST(length(regexp_replace(text, '(?m)^(?:\\[첨부[^\\n]*\\]|학번: +이름: +\\([^\\n]*\\)|\\[목록으로\\] \\[맨 위로\\])\\r?$', '', 'g')) AS INT) AS after FROM syllabus WHERE text IS NOT NULL",
    "schedule_rebuilt": "SELECT record_id, CAST(len(schedule_entries) AS INT) AS n_entries, array_to_string(list_transform(list_filter(schedule_entries, lambda e: coalesce(e.display, '') <> ''), lambda e: e.display), ' / ') AS summary FROM syllabus WHERE len(schedule_entries) > 0",
    "schedule_projection": "SELECT record_id, CAST(i - 1 AS INT) AS pos, concat_ws('|', e.day, e.periods, e.start_time, e.end_time) AS entry FROM (SELECT record_id, unnest(schedule_entries) AS e, generate_subscripts(schedule_entries, 1) AS i FROM syllabus)",
    "schedule_objects": """WITH j AS (SELECT row_id, CASE WHEN json_type(schedule_entries_json) = 'OBJECT' THEN '[' || schedule_entries_json || ']' ELSE schedule_entries_json END AS j FROM courses WHERE json_valid(schedule_entries_json) AND json_type(schedule_entries_json) IN ('ARRAY', 'OBJECT')),
        u AS (SELECT row_id, unnest(e) AS e, generate_subscripts(e, 1) AS i FROM (SELECT row_id, CAST(j AS JSON[]) AS e FROM j))
        SELECT row_id, CAST(row_number() OVER (PARTITION BY row_id ORDER BY i) - 1 AS INT) AS object_no, e->>'day' AS day, e->>'display' AS display FROM u WHERE json_type(e) = 'OBJECT'""",
    "vector_hit_lookup": f"WITH {_COS} SELECT qid, vec_id, rank, coalesce(course_code, 'unknown') AS course_code FROM near LEFT JOIN documents ON doc_id = vec_id WHERE rank <= 5",
    "source_payload": f"{_CASE} SELECT qid, course_code, min(rank) AS rank, coalesce(array_to_string(list_sort(list(DISTINCT source) FILTER (WHERE source IS NOT NULL)), ','), '') AS sources FROM ranked JOIN documents USING (doc_id) WHERE rank <= 20 AND course_code IS NOT NULL GROUP BY qid, course_code",
    "explicit_priority": f"""{_CASE}, r AS (SELECT ranked.qid, doc_id, course_code, rank, coalesce(list_contains({_CODES}, course_code), FALSE) AS named FROM ranked JOIN documents USING (doc_id) JOIN q ON q.qid = ranked.qid WHERE rank <= 20),
        f AS (SELECT *, named AND row_number() OVER (PARTITION BY qid, course_code, named ORDER BY rank) <= 2 AS first FROM r)
        SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY first DESC, rank) AS position, first FROM f""",
    "context_selection": f"""{_CASE}, r AS (SELECT qid, doc_id, course_code, rank FROM ranked JOIN documents USING (doc_id) WHERE rank <= 30),
        c AS (SELECT * FROM (SELECT qid, course_code, row_number() OVER (PARTITION BY qid ORDER BY min(rank)) AS pos FROM r WHERE rank <= 5 AND course_code IS NOT NULL GROUP BY qid, course_code) WHERE pos <= 2),
        m AS (SELECT qid, doc_id, rank FROM (SELECT r.*, row_number() OVER (PARTITION BY r.qid, r.course_code ORDER BY rank) AS n FROM r JOIN c ON c.qid = r.qid AND c.course_code = r.course_code WHERE rank > 5) WHERE n = 1)
        SELECT qid, doc_id, rank FROM r WHERE rank <= 5 UNION ALL SELECT * FROM m""",
    "label_evidence": "SELECT section, count(*) AS n, count(DISTINCT snippet) AS distinct_snippets FROM (SELECT e.section AS section, unnest(e.snippets) AS snippet FROM (SELECT unnest(c.evidence) AS e FROM (SELECT unnest(expected_courses) AS c FROM retrieval_cases))) GROUP BY section",
    "coverage_join": f"WITH c AS (SELECT {_BARE} AS code, count(*) AS n_rows FROM courses GROUP BY 1), s AS (SELECT {_BARE} AS code, count(*) AS n FROM syllabus GROUP BY 1) SELECT c.code, n_rows, coalesce(n, 0) AS n_records FROM c LEFT JOIN s USING (code) WHERE c.code <> ''",
    "answer_mode_counts": "SELECT coalesce(answer_mode, 'none') AS answer_mode, role, count(*) AS n, count(DISTINCT text) AS texts, count(DISTINCT conv_id) AS conversations FROM chat_turns GROUP BY 1, 2",
    "orders_by_nation": "SELECT r_name, n_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2",
}
QUERIES = {
    f.__name__: f
    for f in (labelled_fields, weekly_topics, assessment_items, assessment_conflicts, assessment_spread, section_summary, sanitized_texts, schedule_rebuilt, schedule_projection, schedule_objects, vector_hit_lookup, source_payload, explicit_priority, context_selection, label_evidence, coverage_join, answer_mode_counts, orders_by_nation)
}
