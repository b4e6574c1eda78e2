"""Retrieval queries: term statistics, BM25, cosine, fusion, thresholds, snippets.

A search takes as queries every row whose id is divisible by 100, against all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.storage import scratch
from ..functions.text import best_sentence, excerpt, tokenize
from ..operators import index, retrieval as R
from ..operators.scoring import bm25_top_k
from ..sources.tables import table

TOK = "list_filter(list_transform(regexp_extract_all(coalesce({c}, ''), '[가-힣A-Za-z0-9_./+-]+'), lambda x: lower(x)), lambda x: length(x) >= 2)"
_D = TOK.format(c="text")


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = table(spark, sf_dir, "retrieval_cases")
    return cases.where(F.regexp_extract("id", r"([0-9]+)$", 1).cast("bigint") % 100 == 0)


def _case_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.bm25(table(spark, sf_dir, "documents"), R.query_terms(_questions(spark, sf_dir), "id", "question"))


def bm25_topk(spark, sf_dir):
    """The ten best documents of each question."""
    return R.top_k(_case_scores(spark, sf_dir), 10)


def indexed_search(spark, sf_dir):
    """The same search over a stored index."""
    at = scratch(spark, "index")
    index.build(table(spark, sf_dir, "documents"), at)
    return index.search(spark, at, R.query_terms(_questions(spark, sf_dir), "id", "question"), 10)


def bm25_term_stats(spark, sf_dir):
    """Document frequency and inverse document frequency of every term."""
    return R.term_stats(table(spark, sf_dir, "documents")).withColumn("idf", F.round("idf", 6))


def doc_lengths(spark, sf_dir):
    """Tokens and distinct tokens of every document."""
    t = tokenize(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(t).alias("n_tokens"), F.size(F.array_distinct(t)).alias("n_distinct"))


def _vectors(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return v, v.where(F.col("vec_id") % 100 == 0)


def cosine_topk(spark, sf_dir):
    """The ten nearest rows of each query vector."""
    return R.cosine_top_k(*_vectors(spark, sf_dir), 10).select("qid", "vec_id", "cosine", "rank")


def cosine_topk_indexed(spark, sf_dir):
    """The ten nearest rows of each query vector among the lists of rows nearest to it."""
    return R.cosine_top_k_indexed(*_vectors(spark, sf_dir), 10).select("qid", "vec_id", "cosine", "rank")


def _lists(spark, sf_dir, whole=False):
    """Lexical and semantic lists for the query documents that have a vector: their first line, or their whole text, against all documents, their vector against all vectors."""
    docs = table(spark, sf_dir, "documents")
    asked = docs.where(F.col("doc_id") % 100 == 0).select("doc_id", (F.col("text") if whole else F.substring_index("text", "\n", 1)).alias("asked"))
    lexical = bm25_top_k(docs, R.query_terms(asked, "doc_id", "asked"), 15)
    semantic = R.cosine_top_k(*_vectors(spark, sf_dir), 24).withColumnRenamed("vec_id", "doc_id")
    return lexical, semantic


def rrf_fusion(spark, sf_dir):
    """Both lists fused by reciprocal rank."""
    return R.rrf(list(_lists(spark, sf_dir)))


def rrf_fusion_whole(spark, sf_dir):
    """Both lists fused by reciprocal rank; the whole text of each query document is its query."""
    return R.rrf(list(_lists(spark, sf_dir, True)))


def _hybrid(spark, sf_dir, whole=False):
    return R.hybrid_evidence(*_lists(spark, sf_dir, whole))


def hybrid_evidence_rank(spark, sf_dir):
    """The seven best by combined evidence."""
    return R.top_k(_hybrid(spark, sf_dir), 7, score="evidence").select("qid", "doc_id", "evidence", "rank")


def hybrid_evidence_rank_whole(spark, sf_dir):
    """The seven best by combined evidence; the whole text of each query document is its query."""
    return R.top_k(_hybrid(spark, sf_dir, True), 7, score="evidence").select("qid", "doc_id", "evidence", "rank")


def relevance_threshold(spark, sf_dir):
    """What passes the absolute and the relative floor of evidence."""
    return R.relevance_threshold(_hybrid(spark, sf_dir)).select("qid", "doc_id", "evidence")


def relevance_threshold_whole(spark, sf_dir):
    """What passes the floors of evidence; the whole text of each query document is its query."""
    return R.relevance_threshold(_hybrid(spark, sf_dir, True)).select("qid", "doc_id", "evidence")


def per_group_cap(spark, sf_dir):
    """The 30 best per question, at most two of a course."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "course_code")
    top = R.top_k(_case_scores(spark, sf_dir), 30).join(docs, "doc_id")
    return R.per_group_cap(top, "course_code", 2).select("qid", "doc_id", "course_code", "rank", "in_group")


def mmr_diversify(spark, sf_dir):
    """Seven diverse documents out of each question's 24 best."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "course_code", F.array_distinct(tokenize(F.col("text"))).alias("tokens"))
    return R.mmr(R.top_k(_case_scores(spark, sf_dir), 24).join(docs, "doc_id"), 7, 2)


def best_snippet(spark, sf_dir):
    """For each of the five best documents of a question, its best sentence."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    q = _questions(spark, sf_dir).select(F.col("id").alias("qid"), tokenize(F.col("question")).alias("q"))
    top = R.top_k(_case_scores(spark, sf_dir), 5).join(q, "qid").join(docs, "doc_id")
    return top.select("qid", "doc_id", best_sentence(F.col("text"), F.col("q")).alias("snippet"))


def evidence_excerpt(spark, sf_dir):
    """A window around the first expected code in each document that a case's code names."""
    cases = table(spark, sf_dir, "retrieval_cases").select("id", F.explode("expected_codes").alias("course_code"))
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "course_code", "text")
    asked = cases.select("course_code").distinct()
    got = docs.join(asked, "course_code", "left_semi")
    return got.select("doc_id", "course_code", excerpt(F.col("text"), F.col("course_code")).alias("excerpt")).where("excerpt is not null")


def keyword_boost_rank(spark, sf_dir):
    """BM25 with boosts for a course code (+8) and a section cue (+0.32) of the question in the document, ten best."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "course_code", F.lower("text").alias("low"))
    q = _questions(spark, sf_dir).select(F.col("id").alias("qid"), F.lower("question").alias("question"))
    j = _case_scores(spark, sf_dir).join(q, "qid").join(docs, "doc_id")
    code = F.lower(F.coalesce("course_code", F.lit("")))
    boost = F.when((code != "") & F.contains("question", code), 8.0).otherwise(0.0)
    cue = F.when(F.contains("question", F.lit("시간표")) & F.contains("low", F.lit("주차")) | F.contains("question", F.lit("평가")) & F.contains("low", F.lit("평가방법")), 0.32).otherwise(0.0)
    return R.top_k(j.select("qid", "doc_id", F.round(F.col("score") + boost + cue, 6).alias("score")), 10)


def token_jaccard_pairs(spark, sf_dir):
    """Token Jaccard of each question's ten best documents with the question's best one."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.array_distinct(tokenize(F.col("text"))).alias("t"))
    top = R.top_k(_case_scores(spark, sf_dir), 10).join(docs, "doc_id")
    first = top.where("rank = 1").select("qid", F.col("t").alias("t1"))
    both = top.join(first, "qid")
    union = F.greatest(F.size(F.array_union("t", "t1")), F.lit(1))
    return both.select("qid", "doc_id", F.round(F.size(F.array_intersect("t", "t1")) / union, 6).alias("jaccard"))


_SQL_Q = f"""q AS (SELECT id AS qid, question, {TOK.format(c="question")} AS tokens FROM retrieval_cases WHERE CAST(regexp_extract(id, '([0-9]+)$', 1) AS BIGINT) % 100 = 0)"""
_SQL_BM25 = """
d AS (SELECT doc_id, tokens, len(tokens) AS dl FROM (SELECT doc_id, {tok} AS tokens FROM documents)),
st AS (SELECT count(*) AS n, greatest(avg(dl), 1.0) AS avgdl FROM d),
qt AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest(tokens) AS term FROM q) GROUP BY ALL),
po AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, dl, unnest(tokens) AS term FROM d) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM po GROUP BY term),
scored AS (
  SELECT qid, doc_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score
  FROM po JOIN qt USING (term) JOIN df USING (term), st GROUP BY qid, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM scored)
""".format(tok=_D)
_CASE = f"WITH {_SQL_Q}, {_SQL_BM25}"
_COS = """
pairs AS (SELECT a.vec_id AS qid, b.vec_id AS vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0),
near AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY cosine DESC, vec_id) AS rank FROM pairs)
"""
_HYBRID = f"""WITH q AS (SELECT doc_id AS qid, {TOK.format(c="split_part(text, chr(10), 1)")} AS tokens FROM documents WHERE doc_id % 100 = 0), {_SQL_BM25}, {_COS},
lex AS (SELECT qid, doc_id, score, rank FROM ranked WHERE rank <= 15),
sem AS (SELECT qid, vec_id AS doc_id, cosine, rank FROM near WHERE rank <= 24),
j AS (
  SELECT coalesce(lex.qid, sem.qid) AS qid, coalesce(lex.doc_id, sem.doc_id) AS doc_id, coalesce(score, 0.0) AS lexical, CASE WHEN cosine IS NULL THEN 0.0 ELSE greatest(0.0, least(1.0, cosine)) END AS semantic,
         coalesce(1.0::DOUBLE / (60 + lex.rank), 0.0) + coalesce(1.0::DOUBLE / (60 + sem.rank), 0.0) AS fused
  FROM lex FULL JOIN sem ON lex.qid = sem.qid AND lex.doc_id = sem.doc_id),
ev AS (
  SELECT qid, doc_id, round(0.55::DOUBLE * semantic + 0.30::DOUBLE * lexical / greatest(max(lexical) OVER (PARTITION BY qid), 1e-9) + 0.15::DOUBLE * fused / greatest(max(fused) OVER (PARTITION BY qid), 1e-9), 6) AS evidence FROM j)
"""

SQL = {
    "bm25_topk": f"{_CASE} SELECT qid, doc_id, score, rank FROM ranked WHERE rank <= 10",
    "bm25_term_stats": f"WITH t AS (SELECT unnest(list_distinct({_D})) AS term FROM documents) SELECT term, count(*) AS df, round(ln(1 + ((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5)), 6) AS idf FROM t GROUP BY term",
    "doc_lengths": f"SELECT doc_id, CAST(len({_D}) AS INT) AS n_tokens, CAST(len(list_distinct({_D})) AS INT) AS n_distinct FROM documents",
    "cosine_topk": f"WITH {_COS} SELECT qid, vec_id, cosine, rank FROM near WHERE rank <= 10",
    "rrf_fusion": f"{_HYBRID} SELECT qid, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS rrf FROM (SELECT qid, doc_id, rank FROM lex UNION ALL SELECT qid, doc_id, rank FROM sem) GROUP BY qid, doc_id",
    "hybrid_evidence_rank": f"{_HYBRID} SELECT * FROM (SELECT qid, doc_id, evidence, row_number() OVER (PARTITION BY qid ORDER BY evidence DESC, doc_id) AS rank FROM ev) WHERE rank <= 7",
    "relevance_threshold": f"{_HYBRID} SELECT qid, doc_id, evidence FROM (SELECT *, max(evidence) OVER (PARTITION BY qid) AS top FROM ev) WHERE evidence >= greatest(0.18::DOUBLE, 0.42::DOUBLE * top)",
    "per_group_cap": f"{_CASE} SELECT * FROM (SELECT qid, doc_id, course_code, rank, row_number() OVER (PARTITION BY qid, course_code ORDER BY rank) AS in_group FROM ranked JOIN documents USING (doc_id) WHERE rank <= 30) WHERE in_group <= 2",
    "keyword_boost_rank": f"""{_CASE}, b AS (
        SELECT r.qid, r.doc_id, round(r.score + CASE WHEN coalesce(d.course_code, '') <> '' AND contains(lower(q.question), lower(d.course_code)) THEN 8.0 ELSE 0.0 END
               + CASE WHEN contains(lower(q.question), '시간표') AND contains(lower(d.text), '주차') OR contains(lower(q.question), '평가') AND contains(lower(d.text), '평가방법') THEN 0.32 ELSE 0.0 END, 6) AS score
        FROM scored r JOIN q USING (qid) JOIN documents d USING (doc_id))
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM b) WHERE rank <= 10""",
    "token_jaccard_pairs": f"""{_CASE}, t AS (SELECT r.qid, r.doc_id, r.rank, list_distinct(d.tokens) AS t FROM ranked r JOIN d USING (doc_id) WHERE r.rank <= 10)
        SELECT a.qid, a.doc_id, round(len(list_intersect(a.t, b.t)) / greatest(len(list_distinct(list_concat(a.t, b.t))), 1)::DOUBLE, 6) AS jaccard FROM t a JOIN t b ON a.qid = b.qid AND b.rank = 1""",
    "evidence_excerpt": """WITH asked AS (SELECT DISTINCT unnest(expected_codes) AS course_code FROM retrieval_cases),
        f AS (SELECT doc_id, course_code, text, strpos(text, course_code) AS p, greatest(1, strpos(text, course_code) - 80) AS b FROM documents WHERE text IS NOT NULL AND course_code IN (SELECT course_code FROM asked))
        SELECT doc_id, course_code, CASE WHEN b > 1 THEN '…' ELSE '' END || substr(text, b, 240) || CASE WHEN b + 239 < length(text) THEN '…' ELSE '' END AS excerpt FROM f WHERE p > 0""",
    "best_snippet": f"""{_CASE}, top AS (SELECT r.qid, r.doc_id, list_distinct(q.tokens) AS q, d.text FROM ranked r JOIN q USING (qid) JOIN documents d USING (doc_id) WHERE r.rank <= 5),
        s AS (SELECT qid, doc_id, q, unnest(parts) AS s, generate_subscripts(parts, 1) AS i FROM (SELECT *, list_filter(list_transform(regexp_split_to_array(text, '[.!?\\n]+'), lambda x: regexp_replace(x, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')), lambda x: x <> '') AS parts FROM top)),
        h AS (SELECT *, len(list_filter(q, lambda t: contains(lower(s), t))) AS hits FROM s)
        SELECT qid, doc_id, substr(s, 1, 260) AS snippet FROM (SELECT *, row_number() OVER (PARTITION BY qid, doc_id ORDER BY hits DESC, i) AS r FROM h) WHERE r = 1""",
}
SQL["indexed_search"] = SQL["bm25_topk"]
QUERIES = {f.__name__: f for f in (bm25_topk, indexed_search, bm25_term_stats, doc_lengths, cosine_topk, cosine_topk_indexed, rrf_fusion, rrf_fusion_whole, hybrid_evidence_rank, hybrid_evidence_rank_whole, relevance_threshold, relevance_threshold_whole, per_group_cap, mmr_diversify, best_snippet, evidence_excerpt, keyword_boost_rank, token_jaccard_pairs)}
