"""Search queries over passages of the syllabi and documents.

A search takes as queries every row whose id is divisible by 100, against all rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.storage import materialize
from ..functions.text import tokenize
from ..operators import retrieval as R, rules, search as S
from ..operators.scoring import bm25_top_k
from ..sources.tables import table
from .catalog import _BARE
from .retrieval import TOK, _questions, _vectors
from .text import _ANY, _GROUPS, _HAS, _STEM, _STOP


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _questions(spark, sf_dir).select(F.col("id").alias("qid"), "question")


def keyword_search(spark, sf_dir):
    """Seven diverse passages of the syllabi for each question."""
    p = S.passages(table(spark, sf_dir, "syllabus"))
    return S.diversified(S.keyword_scores(p, _asked(spark, sf_dir)), p, 7)


def _records(spark, sf_dir):
    """Whole records as passages; the section is the one their first line would have."""
    s = table(spark, sf_dir, "syllabus").where("length(text) > 0")
    got = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return materialize(s.select(F.col("record_id").alias("pid"), got("course_code"), got("course_name"), got("professor"), F.lit("평가방법").alias("section"), "text").withColumn("tokens", tokenize(F.concat_ws(" ", "course_code", "course_name", "professor", "text"))))


def keyword_ranking(spark, sf_dir):
    """The 20 best whole records of each question by keyword score, as if all were on assessment."""
    return R.top_k(S.keyword_scores(_records(spark, sf_dir), _asked(spark, sf_dir)), 20, tie="pid")


def _documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select(F.col("doc_id").alias("pid"), F.coalesce("course_code", F.lit("")).alias("course_code"), F.lit("").alias("course_name"), F.lit("").alias("professor"), F.lit("평가방법").alias("section"), "text")


#: Found passages that are broadcast, at most.
FEW = 200_000


def _reranked(spark, sf_dir):
    """Documents that have a vector ask with their whole text and their vector; of the documents, those in one of the lists are kept."""
    docs = _documents(spark, sf_dir)
    asked = docs.where("pid % 100 = 0").select(F.col("pid").alias("qid"), F.col("text").alias("question"))
    lexical = materialize(bm25_top_k(docs, R.query_terms(asked, "qid", "question"), 15, "pid").withColumnRenamed("doc_id", "pid"))
    semantic = materialize(R.cosine_top_k(*_vectors(spark, sf_dir), 24).withColumnRenamed("vec_id", "pid"))
    found = materialize(lexical.select("pid").union(semantic.select("pid")).distinct())
    met = docs.join(F.broadcast(found) if found.count() <= FEW else found, "pid", "left_semi")
    kept = materialize(met.withColumn("tokens", tokenize(F.col("text"))), "zstd")
    return kept, asked, S.rerank(asked, lexical, semantic, kept)


def hybrid_rerank(spark, sf_dir):
    """Both lists of each query document, weighed by intent and section, empty forms left out."""
    return _reranked(spark, sf_dir)[2].drop("broad", "course_code")


def hybrid_answer(spark, sf_dir):
    """Seven diverse documents of each query document's rerank."""
    docs, _, ranked = _reranked(spark, sf_dir)
    return S.reranked(ranked, docs, 7)


def relevant_matches(spark, sf_dir):
    """What of the rerank is near enough: anchors, exemption of named courses, floors for broad and narrow questions."""
    docs, asked, ranked = _reranked(spark, sf_dir)
    courses = table(spark, sf_dir, "syllabus").select(F.col("course_code").alias("code"), "course_name")
    return S.relevant(ranked, asked, docs, courses).select("qid", "pid", "evidence")


def named_courses(spark, sf_dir):
    """The courses that user questions name, by code or else by the longest name."""
    asked = table(spark, sf_dir, "chat_turns").where("role = 'user'").select("log_id", "text")
    courses = table(spark, sf_dir, "courses").select(F.coalesce(F.col("course_code"), F.lit("")).alias("code"), "course_name")
    return S.named_courses(asked, courses, "log_id", "text").select(F.col("qid").alias("log_id"), "code")


_TITLE = lambda c: f"regexp_replace(lower(replace(replace(replace(replace(replace(coalesce({c}, ''), 'Ⅰ', 'I'), 'Ⅱ', 'II'), 'Ⅲ', 'III'), 'Ⅳ', 'IV'), 'Ⅴ', 'V')), '[^0-9a-z가-힣]', '', 'g')"
_CODES = lambda c: f"list_transform(regexp_extract_all(regexp_replace(coalesce({c}, ''), '([^A-Za-z0-9])', '\\1\\1', 'g'), '(?:^|[^A-Za-z0-9])[A-Za-z]{{2,}}[0-9]{{3}}(?:$|[^A-Za-z0-9])'), lambda x: upper(regexp_extract(x, '[A-Za-z]{{2,}}[0-9]{{3}}')))"
_NAMED = lambda asked, courses: f"""  -- nq: qid, q; nc: code, course_name
nq AS ({asked}), nc AS (SELECT DISTINCT upper(code) AS code, course_name FROM ({courses}) WHERE code <> ''),
nk AS (SELECT qid, list_distinct({_CODES('q')}) AS codes, {_TITLE('q')} AS t FROM nq),
nt AS (SELECT DISTINCT code, unnest([{_TITLE('course_name')}, {_TITLE("regexp_replace(course_name, '[(](?:영강|영어강의)[)]', '', 'g')")}]) AS title FROM nc),
nm AS (SELECT qid, code, length(title) AS n FROM nk, nt WHERE len(codes) = 0 AND title <> '' AND contains(t, title)),
named AS (SELECT DISTINCT qid, code FROM (SELECT qid, unnest(codes) AS code FROM nk) WHERE code IN (SELECT code FROM nc)
  UNION SELECT DISTINCT qid, code FROM (SELECT *, max(n) OVER (PARTITION BY qid) AS m FROM nm) WHERE n = m)"""  # noqa: E731
_HELD = ", ".join("(" + " + ".join(f"contains(lower(text), '{w.lower()}')::INT" for w in words) + ")" for words in rules.SYNONYMS.values())
_PHRASE = lambda words: _HAS("lower(regexp_replace(question, '[[:space:]]+', '', 'g'))", [w.replace(" ", "") for w in words]).replace("코딩", "(?:^|[^인디엔])코딩", 1).replace("coding", "(?:^|[^a-z])coding(?:[^a-z]|$)", 1)
_HOLDS = ", ".join(f"{_PHRASE((key, *words))}::INT" for key, words in rules.SYNONYMS.items())

SQL = {
    "named_courses": f"WITH {_NAMED('SELECT log_id AS qid, text AS q FROM chat_turns WHERE role = ' + chr(39) + 'user' + chr(39), 'SELECT course_code AS code, course_name FROM courses')} SELECT qid AS log_id, code FROM named",
    "keyword_ranking": f"""WITH q AS (SELECT id AS qid, question, {TOK.format(c="question")} AS raw FROM retrieval_cases WHERE CAST(regexp_extract(id, '([0-9]+)$', 1) AS BIGINT) % 100 = 0),
k AS (SELECT qid, list_filter(raw, lambda t: t NOT IN ({_STOP})) AS kept FROM q),
o AS (SELECT qid, list_filter(flatten(list_transform(kept, lambda t: [t, {_STEM}])), lambda t: t IS NOT NULL AND t NOT IN ({_STOP})) AS own FROM k),
ro AS (SELECT qid, own, array_to_string(own, ' ') AS row FROM o),
qt AS (SELECT qid, unnest(list_distinct(flatten([own, {_GROUPS}]))) AS term FROM ro),
p AS (SELECT record_id AS pid, coalesce(course_code, '') AS code, coalesce(course_name, '') AS name, coalesce(professor, '') AS prof, text, {TOK.format(c="concat_ws(' ', coalesce(course_code, ''), coalesce(course_name, ''), coalesce(professor, ''), text)")} AS tokens FROM syllabus WHERE length(text) > 0),
st AS (SELECT count(*) AS n, greatest(avg(len(tokens)), 1.0) AS avgdl FROM p),
po AS (SELECT pid, dl, term, count(*) AS tf FROM (SELECT pid, len(tokens) AS dl, unnest(tokens) AS term FROM p) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM po GROUP BY term),
bm AS (SELECT qid, pid, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM po JOIN qt USING (term) JOIN df USING (term), st GROUP BY qid, pid),
{_NAMED("SELECT qid, question AS q FROM q", "SELECT code, name AS course_name FROM p")},
hint AS (SELECT qid, arg_min(named.code, f) AS code FROM named JOIN (SELECT upper(code) AS code, min(pid) AS f FROM p GROUP BY 1) USING (code) GROUP BY qid),
pw AS (SELECT pid, [{_HELD}] AS held FROM p), qw AS (SELECT qid, [{_HOLDS}] AS holds FROM q),
every AS (
  SELECT q.qid, p.pid, coalesce(bm.score, 0) + CASE WHEN p.code <> '' AND contains(lower(question), lower(p.code)) THEN 8.0 ELSE 0 END + CASE WHEN p.name <> '' AND contains(question, p.name) THEN 8.0 ELSE 0 END
         + CASE WHEN p.prof <> '' AND contains(question, p.prof) THEN 3.0 ELSE 0 END + CASE WHEN upper(p.code) = hint.code THEN 10.0 ELSE 0 END + 1.2::DOUBLE * list_dot_product(held::DOUBLE[], holds::DOUBLE[]) AS score,
         CASE WHEN {_HAS('lower(question)', rules.SECTION_TERMS['평가방법'])} THEN 0.32::DOUBLE ELSE 0 END AS more
  FROM q CROSS JOIN p JOIN pw USING (pid) JOIN qw ON qw.qid = q.qid LEFT JOIN bm ON bm.qid = q.qid AND bm.pid = p.pid LEFT JOIN hint ON hint.qid = q.qid
  WHERE q.qid IN (SELECT qid FROM qt)),
s AS (SELECT qid, pid, round(score + more, 6) AS score FROM every WHERE score > 0)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid) AS rank FROM s) WHERE rank <= 20""",
}
QUERIES = {f.__name__: f for f in (keyword_search, keyword_ranking, hybrid_rerank, hybrid_answer, relevant_matches, named_courses)}
