"""Best documents of many queries: the same as from all scores, without shuffling a row per query and document."""

import pytest
from pyspark.sql import functions as F

from quarry import plans
from quarry.operators import retrieval as R
from quarry.operators.scoring import bm25_top_k


@pytest.mark.parametrize("block, query_block, k", ((8192, 512, 15), (7, 3, 4), (16, 5, 200)))
def test_same_as_all_scores(spark, block, query_block, k):
    """Whole texts ask, so that scores tie at copies; null and empty texts, and queries that nothing answers."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs.union(docs.withColumn("doc_id", F.col("doc_id") + 5000)).union(spark.createDataFrame([(9001, None), (9002, ""), (9003, "zz zz zz"), (9004, "zz")], docs.schema))
    asked = docs.where("doc_id % 20 = 0 or doc_id > 9000").select(F.concat(F.lit("q"), "doc_id").alias("id"), "text").union(spark.createDataFrame([("none", "qqqqq"), (None, "zz zz")], "id string, text string"))
    terms = R.query_terms(asked, "id", "text")
    got = bm25_top_k(docs, terms, k, block=block, query_block=query_block).select("qid", "doc_id", "score", "rank").collect()
    want = R.top_k(R.bm25(docs, terms), k).select("qid", "doc_id", "score", "rank").collect()
    assert len(want) > 20 and sorted(map(repr, map(tuple, got))) == sorted(map(repr, map(tuple, want)))


def test_nothing(spark):
    docs = spark.createDataFrame([(1, "aa bb"), (2, None)], "doc_id long, text string")
    terms = R.query_terms(docs, "doc_id", "text")
    assert bm25_top_k(docs.limit(0), terms, 3).count() == bm25_top_k(docs, terms.limit(0), 3).count() == 0
    assert bm25_top_k(docs.where("doc_id = 2"), terms, 3).count() == 0


@pytest.fixture(scope="module")
def large(spark, tmp_path_factory):
    """20,000 documents that all share words with each of the 200 that ask."""
    at = tmp_path_factory.mktemp("large")
    word = lambda n, m: F.concat(F.lit(f"w{n}x"), F.pmod(F.xxhash64("doc_id", F.lit(n)), F.lit(m)).cast("string"))
    docs = spark.range(1, 20_001, 1, 4).withColumnRenamed("id", "doc_id")
    line = F.concat_ws(" ", F.lit("common words of all"), word(1, 3), word(2, 50))
    docs.select("doc_id", F.concat(line, F.lit("\n"), F.concat_ws(" ", *[word(n, 5) for n in range(3, 20)], word(20, 5000))).alias("text"), F.lit("AB101").alias("course_code")).write.parquet(f"{at}/documents.parquet")
    spark.range(300).select(F.col("id").alias("vec_id"), F.array(*[F.rand(i) - 0.5 for i in range(8)]).alias("embedding")).write.parquet(f"{at}/embeddings.parquet")
    spark.read.parquet("/root/testdata/sf0.001/syllabus.parquet").write.parquet(f"{at}/syllabus.parquet")
    return str(at)


def shuffled_mb(spark) -> float:
    return sum(x.totalShuffleWrite() for x in (lambda s: [s.apply(i) for i in range(s.size())])(spark.sparkContext._jsc.sc().statusStore().executorList(True))) / 1e6


@pytest.mark.parametrize("name", ("hybrid_evidence_rank", "relevance_threshold_whole", "hybrid_evidence_rank_whole", "relevant_matches", "rrf_fusion", "hybrid_answer", "hybrid_rerank", "relevance_threshold", "rrf_fusion_whole"))
def test_pairs_are_not_shuffled(spark, large, name):
    """Four million pairs of query and document take tens of MB, the best of each a small part of that."""
    before = shuffled_mb(spark)
    assert plans.queries()[name](spark, large).count() > 300
    took = shuffled_mb(spark) - before
    print(f"{name}: {took:.1f} MB shuffled")
    assert took < 6


def sent_mb(node) -> float:
    """What the plan's functions over Arrow batches were given."""
    inner = [node.executedPlan()] if node.nodeName() == "AdaptiveSparkPlan" else [node.plan()] if "QueryStage" in node.nodeName() else [node.children().apply(i) for i in range(node.children().size())]
    own = node.metrics().apply("pythonDataSent").value() / 1e6 if node.metrics().contains("pythonDataSent") else 0
    return own + sum(map(sent_mb, inner))


def test_blocks_are_sent_once(spark, large):
    """25 blocks of queries meet each block of documents, which is sent with the first of them only; else it fills the executors' memory."""
    docs = spark.read.parquet(f"{large}/documents.parquet")
    best = bm25_top_k(docs, R.query_terms(docs.where("doc_id % 100 = 0"), "doc_id", "text"), 5, query_block=8)
    assert len(best.collect()) == 1000
    took = sent_mb(best._jdf.queryExecution().executedPlan())
    print(f"{took:.1f} MB sent")
    assert 1 < took < 15
