"""Evaluation queries over retrieval_cases; rankings are made for the stated query set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..operators import evaluation as E
from ..operators import retrieval as R
from ..operators.quality import percentile_by_rank
from ..sources.tables import table
from .catalog import _BARE
from .retrieval import _CASE, _case_scores, _questions


def _ranked(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    return R.top_k(_case_scores(spark, sf_dir), k).join(table(spark, sf_dir, "documents").select("doc_id", "course_code"), "doc_id")


def case_metrics(spark, sf_dir):
    """Recall at 5, reciprocal rank and nDCG of each question whose id is divisible by 100."""
    return E.case_metrics(_questions(spark, sf_dir), _ranked(spark, sf_dir))


def recall_at_5(spark, sf_dir):
    """Mean metrics by category, of the questions whose id is divisible by 100 only."""
    m = case_metrics(spark, sf_dir).join(_questions(spark, sf_dir).select(F.col("id").alias("qid"), "category"), "qid")
    return m.groupBy("category").agg(F.count("*").alias("n"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("rr"), 6).alias("mrr"), F.round(F.avg("ndcg"), 6).alias("ndcg"))


def evidence_recall(spark, sf_dir):
    """Labelled snippets found in the ten best documents, for the questions whose id is divisible by 100."""
    return E.evidence_recall(_questions(spark, sf_dir), _ranked(spark, sf_dir), table(spark, sf_dir, "documents").select("doc_id", "text"))


def label_validation(spark, sf_dir):
    """Problems of the labels, over all cases."""
    codes = table(spark, sf_dir, "courses").select(T.bare_code(F.col("course_code")).alias("code")).distinct()
    return E.label_problems(table(spark, sf_dir, "retrieval_cases"), codes)


def label_checks(spark, sf_dir):
    """How many expected codes, snippets and courses with evidence were checked, and how many are wrong."""
    codes = table(spark, sf_dir, "courses").select(T.bare_code(F.col("course_code")).alias("code")).distinct()
    return E.label_checks(table(spark, sf_dir, "retrieval_cases"), codes, 30)


def group_consistency(spark, sf_dir):
    """Questions that read the same: how many cases, how many different expected sets, whether they agree."""
    c = table(spark, sf_dir, "retrieval_cases").select(T.normalize_question(F.col("question")).alias("q"), F.array_join(F.sort_array(F.array_distinct("expected_codes")), ",").alias("codes"))
    return c.groupBy("q").agg(F.count("*").alias("n_cases"), F.countDistinct("codes").alias("n_sets")).withColumn("consistent", F.col("n_sets") <= 1)


def stress_category_summary(spark, sf_dir):
    """Length of the questions by category: count, mean and the value at rank int(.95 (n - 1))."""
    c = table(spark, sf_dir, "retrieval_cases").where("category is not null").select("category", F.length("question").cast("double").alias("n_chars"))
    return percentile_by_rank(c.where("n_chars is not null"), ["category"], "n_chars", 0.95)


def intersect_ordered(spark, sf_dir):
    """Expected codes that the labelled courses name too, in the first list's order."""
    both = F.array_intersect("expected_codes", F.transform("expected_courses", lambda c: c["course_code"]))
    return table(spark, sf_dir, "retrieval_cases").where("expected_codes is not null and expected_courses is not null").select("id", F.array_join(both, ",").alias("codes"))


#: Question templates for every known course code; the spelling of a question varies with its number.
TEMPLATES = ("{} 시간표", "{} 교수님 누구야", "{} 평가방법 알려줘", "Which section of {} has three credits?")


def mutation_templates(spark, sf_dir):
    """Generated questions: every template for every distinct code, blanks and case varied by a hash of both."""
    codes = table(spark, sf_dir, "courses").select(T.bare_code(F.col("course_code")).alias("code")).where("code <> ''").distinct()
    q = codes.select("code", F.posexplode(F.array(*[F.lit(t) for t in TEMPLATES])).alias("template", "t"))
    plain = F.replace("t", F.lit("{}"), F.col("code"))
    kind = (F.ascii(F.substring("code", -1, 1)) + F.col("template")) % 3
    return q.select("code", "template", F.when(kind == 0, plain).when(kind == 1, F.lower(plain)).otherwise(F.replace(plain, F.lit(" "), F.lit("  "))).alias("question"))


def conversation_digest(spark, sf_dir):
    """SHA-256 of each conversation's texts in order."""
    from ..operators.conversation import deliveries_once

    t = deliveries_once(table(spark, sf_dir, "chat_turns"))
    ordered = F.sort_array(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))))
    return t.groupBy("conv_id").agg(ordered.alias("o")).select("conv_id", F.sha2(F.array_join(F.transform("o", lambda x: x["text"]), "\n"), 256).alias("digest"))


_Q = "retrieval_cases WHERE CAST(regexp_extract(id, '([0-9]+)$', 1) AS BIGINT) % 100 = 0"
_METRICS = f"""{_CASE},
exp AS (SELECT DISTINCT id AS qid, unnest(expected_codes) AS code FROM {_Q}),
top AS (SELECT qid, course_code AS code, min(rank) AS rank FROM ranked JOIN documents USING (doc_id) WHERE rank <= 5 AND course_code IS NOT NULL GROUP BY ALL),
got AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank) AS pos FROM top),
hits AS (SELECT qid, count(*) AS hits, min(pos) AS first, sum(1 / log2(pos + 1.0::DOUBLE)) AS dcg FROM got WHERE (qid, code) IN (SELECT (qid, code) FROM exp) GROUP BY qid),
m AS (
  SELECT e.qid, round(coalesce(hits / n::DOUBLE, 0), 6) AS recall, round(coalesce(1.0::DOUBLE / first, 0), 6) AS rr,
         round(coalesce(dcg / list_sum(list_transform(generate_series(1, greatest(least(n, coalesce(returned, 0)), 1)), lambda x: 1 / log2(x + 1.0::DOUBLE))), 0), 6) AS ndcg
  FROM (SELECT qid, count(*) AS n FROM exp GROUP BY qid) e LEFT JOIN hits USING (qid) LEFT JOIN (SELECT qid, count(*) AS returned FROM got GROUP BY qid) g USING (qid))
"""
_SNIP = "(SELECT qid, c.course_code AS code, unnest(c.evidence) AS e FROM (SELECT id AS qid, unnest(expected_courses) AS c FROM {of}))"

SQL = {
    "case_metrics": f"{_METRICS} SELECT qid, recall, rr, ndcg FROM m",
    "recall_at_5": f"{_METRICS} SELECT category, count(*) AS n, round(avg(recall), 6) AS recall, round(avg(rr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM m JOIN retrieval_cases ON id = qid GROUP BY category",
    "evidence_recall": f"""{_CASE}, s AS (SELECT DISTINCT qid, code, unnest(e.snippets) AS snippet FROM {_SNIP.format(of=_Q)}),
        f AS (SELECT DISTINCT s.qid, s.code, s.snippet FROM s JOIN ranked r ON r.qid = s.qid AND r.rank <= 10 JOIN documents d ON d.doc_id = r.doc_id AND d.course_code = s.code WHERE contains(d.text, s.snippet))
        SELECT qid, count(*) AS n_snippets, coalesce((SELECT count(*) FROM f WHERE f.qid = s.qid), 0) AS found FROM s GROUP BY qid""",
    "label_validation": f"""WITH exp AS (SELECT DISTINCT id AS qid, unnest(expected_codes) AS code FROM retrieval_cases), s AS (SELECT qid, code, unnest(e.snippets) AS snippet FROM {_SNIP.format(of="retrieval_cases")})
        SELECT DISTINCT qid, 'unknown code' AS problem FROM exp WHERE code NOT IN (SELECT {_BARE} FROM courses WHERE course_code IS NOT NULL)
        UNION SELECT qid, 'short snippet' FROM s WHERE length(snippet) < 8 UNION SELECT qid, 'evidence of another course' FROM s WHERE NOT EXISTS (SELECT 1 FROM exp WHERE exp.qid = s.qid AND exp.code = s.code)""",
    "label_checks": f"""WITH exp AS (SELECT DISTINCT id AS qid, unnest(expected_codes) AS code FROM retrieval_cases), s AS (SELECT qid, code, unnest(e.snippets) AS snippet FROM {_SNIP.format(of="retrieval_cases")})
        SELECT 'expected codes' AS check, count(*) AS n_checked, CAST(count_if(code NOT IN (SELECT {_BARE} FROM courses WHERE course_code IS NOT NULL)) AS BIGINT) AS n_problems FROM exp
        UNION ALL SELECT 'snippets', count(*), CAST(count_if(length(snippet) < 30) AS BIGINT) FROM s
        UNION ALL SELECT 'courses with evidence', count(*), CAST(count_if((qid, code) NOT IN (SELECT (qid, code) FROM exp)) AS BIGINT) FROM (SELECT DISTINCT qid, code FROM s)""",
    "group_consistency": "SELECT q, count(*) AS n_cases, count(DISTINCT codes) AS n_sets, count(DISTINCT codes) <= 1 AS consistent FROM (SELECT trim(regexp_replace(trim(regexp_replace(lower(question), '[ \\t\\n\\f\\r]+', ' ', 'g')), '[?!.,。！？]+$', '')) AS q, array_to_string(list_sort(list_distinct(expected_codes)), ',') AS codes FROM retrieval_cases) GROUP BY q",
    "stress_category_summary": "WITH r AS (SELECT category, length(question)::DOUBLE AS v, row_number() OVER (PARTITION BY category ORDER BY length(question)) - 1 AS i, count(*) OVER (PARTITION BY category) AS n FROM retrieval_cases WHERE category IS NOT NULL AND question IS NOT NULL) SELECT category, count(*) AS n, round(avg(v), 6) AS mean, max(CASE WHEN i = floor(0.95 * (n - 1)) THEN v END) AS percentile FROM r GROUP BY category",
    "intersect_ordered": "SELECT id, array_to_string(list_filter(expected_codes, lambda x: list_contains(list_transform(expected_courses, lambda c: c.course_code), x)), ',') AS codes FROM retrieval_cases WHERE expected_codes IS NOT NULL AND expected_courses IS NOT NULL",
    "mutation_templates": f"""WITH c AS (SELECT DISTINCT {_BARE} AS code FROM courses), t AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{t}')" for i, t in enumerate(TEMPLATES))}) AS v(template, t)),
        q AS (SELECT code, CAST(template AS INT) AS template, replace(t, '{{}}', code) AS p, (ascii(right(code, 1)) + template) % 3 AS k FROM c, t WHERE code <> '')
        SELECT code, template, CASE k WHEN 0 THEN p WHEN 1 THEN lower(p) ELSE replace(p, ' ', '  ') END AS question FROM q""",
    "conversation_digest": "WITH once AS (SELECT * FROM chat_turns t WHERE log_id = (SELECT min(log_id) FROM chat_turns u WHERE u.conv_id = t.conv_id AND u.turn = t.turn)) SELECT conv_id, sha256(string_agg(coalesce(text, ''), chr(10) ORDER BY turn)) AS digest FROM once GROUP BY conv_id",
}
QUERIES = {f.__name__: f for f in (case_metrics, recall_at_5, evidence_recall, label_validation, label_checks, group_consistency, stress_category_summary, intersect_ordered, mutation_templates, conversation_digest)}
