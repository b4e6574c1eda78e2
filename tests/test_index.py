from pyspark.sql import functions as F

from quarry.operators import index, retrieval as R


def test_index(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    q = R.query_terms(docs.where("doc_id % 50 = 0").select("doc_id", F.substring_index("text", "\n", 1).alias("t")), "doc_id", "t")
    direct = lambda d: sorted(map(tuple, R.top_k(R.bm25(d, q), 5).collect()))
    index.build(docs, str(tmp_path / "a"))
    assert sorted(map(tuple, index.search(spark, str(tmp_path / "a"), q, 5).collect())) == direct(docs) != []
    later = docs.where("doc_id > 20").withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" more words"))).otherwise(F.col("text"))).union(spark.createDataFrame([(10_000, "new words here"), (10_001, None)], docs.schema))
    actions = {r["action"]: r["count"] for r in index.refresh(spark, str(tmp_path / "a"), later, str(tmp_path / "b")).groupBy("action").count().collect()}
    assert actions["delete"] == 20 and actions["insert"] == 2 and actions["update"] > 10 and actions["keep"] > 50
    assert sorted(map(tuple, index.search(spark, str(tmp_path / "b"), q, 5).collect())) == direct(later)
