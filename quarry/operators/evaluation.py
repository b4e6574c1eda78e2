"""Retrieval evaluation: recall, reciprocal rank, nDCG, evidence recall, label checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def expected(cases: DataFrame) -> DataFrame:
    """``qid, code`` of every case, each code once."""
    return cases.select(F.col("id").alias("qid"), F.explode(F.array_distinct("expected_codes")).alias("code"))


def ranked_codes(ranked: DataFrame) -> DataFrame:
    """``qid, code, pos``: distinct courses in the order of their best document."""
    first = ranked.where("course_code is not null").groupBy("qid", F.col("course_code").alias("code")).agg(F.min("rank").alias("rank"))
    return first.select("qid", "code", F.row_number().over(W.partitionBy("qid").orderBy("rank")).alias("pos"))


def case_metrics(cases: DataFrame, ranked: DataFrame, k: int = 5) -> DataFrame:
    """``qid, recall, rr, ndcg`` per case: recall of the distinct courses within ``k`` documents, reciprocal rank over distinct courses, nDCG whose ideal is min(expected, returned)."""
    exp = expected(cases)
    size = exp.groupBy("qid").agg(F.count("*").alias("n"))
    within = ranked.where(F.col("rank") <= k)
    got = ranked_codes(within)
    hits = got.join(exp, ["qid", "code"], "left_semi").groupBy("qid").agg(F.count("*").alias("hits"), F.min("pos").alias("first"), F.sum(1 / (F.log2(F.col("pos") + 1.0))).alias("dcg"))
    returned = got.groupBy("qid").agg(F.count("*").alias("returned"))
    j = size.join(hits, "qid", "left").join(returned, "qid", "left")
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least("n", F.coalesce("returned", F.lit(0))), F.lit(1)).cast("int")), F.lit(0.0), lambda a, x: a + 1 / F.log2(x + 1.0))
    zero = F.lit(0.0)
    return j.select("qid", F.round(F.coalesce(F.col("hits") / F.col("n"), zero), 6).alias("recall"), F.round(F.coalesce(1.0 / F.col("first"), zero), 6).alias("rr"), F.round(F.coalesce(F.col("dcg") / ideal, zero), 6).alias("ndcg"))


def snippets(cases: DataFrame) -> DataFrame:
    """``qid, code, section, snippet``: the labels' nested evidence, flattened."""
    c = cases.select(F.col("id").alias("qid"), F.explode("expected_courses").alias("c")).select("qid", F.col("c.course_code").alias("code"), F.explode("c.evidence").alias("e"))
    return c.select("qid", "code", F.col("e.section").alias("section"), F.explode("e.snippets").alias("snippet"))


def evidence_recall(cases: DataFrame, ranked: DataFrame, texts: DataFrame) -> DataFrame:
    """``qid, n_snippets, found``: the labels' snippets that a ranked document of their course contains."""
    s = snippets(cases).select("qid", "code", "snippet").distinct()
    docs = ranked.select("qid", "doc_id", F.col("course_code").alias("code")).join(texts, "doc_id")
    hit = s.join(docs, ["qid", "code"]).where(F.contains("text", "snippet")).select("qid", "code", "snippet").distinct().groupBy("qid").agg(F.count("*").alias("found"))
    return s.groupBy("qid").agg(F.count("*").alias("n_snippets")).join(hit, "qid", "left").select("qid", "n_snippets", F.coalesce("found", F.lit(0)).alias("found"))


def label_problems(cases: DataFrame, codes: DataFrame) -> DataFrame:
    """``qid, problem``: cases with unknown codes, short snippets or evidence for a course that isn't expected."""
    exp = expected(cases)
    unknown = exp.join(codes, "code", "left_anti").select("qid", F.lit("unknown code").alias("problem"))
    s = snippets(cases)
    short = s.where(F.length("snippet") < 8).select("qid", F.lit("short snippet").alias("problem"))
    stray = s.join(exp, ["qid", "code"], "left_anti").select("qid", F.lit("evidence of another course").alias("problem"))
    return unknown.union(short).union(stray).distinct()


def label_checks(cases: DataFrame, codes: DataFrame, least: int = 8) -> DataFrame:
    """``check, n_checked, n_problems``: what ``label_problems`` looks at, and how much of it is wrong; a row per check, whatever is found."""
    exp, s = expected(cases), snippets(cases)
    known = exp.join(codes.select("code").distinct().withColumn("known", F.lit(1)), "code", "left")
    own = s.select("qid", "code").distinct().join(exp.withColumn("known", F.lit(1)), ["qid", "code"], "left")
    count = lambda df, name, wrong: df.agg(F.count("*").alias("n_checked"), F.count_if(wrong).alias("n_problems")).select(F.lit(name).alias("check"), "n_checked", "n_problems")
    return count(known, "expected codes", F.col("known").isNull()).union(count(s, "snippets", F.length("snippet") < least)).union(count(own, "courses with evidence", F.col("known").isNull()))
