"""A stored inverted index: built once, searched often, refreshed by what changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import tokenize
from . import retrieval as R

#: Folders of terms; a search reads those of its terms only.
BUCKETS = 64


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    rows = docs.select(F.col(key).alias("doc_id"), tokenize(F.col(text)).alias("tokens"))
    flat = rows.select("doc_id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term"))
    return flat.groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf")).withColumn("bucket", _bucket(F.col("term")))


def _documents(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("doc_id"), F.size(tokenize(F.col(text))).alias("dl"), F.sha2(F.coalesce(text, F.lit("")), 256).alias("content"))


def _write(postings: DataFrame, documents: DataFrame, path: str) -> None:
    # Range partitions of (bucket, term) split a bucket's hot terms over files, each with narrow term statistics.
    postings.repartitionByRange("bucket", "term", "doc_id").sortWithinPartitions("bucket", "term").write.mode("errorifexists").partitionBy("bucket").parquet(f"{path}/postings")
    documents.write.mode("errorifexists").parquet(f"{path}/documents")


def build(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> None:
    """Write the index of ``docs`` under ``path``: postings by bucket of terms, lengths and content hashes of all documents (null texts have length 0)."""
    _write(_postings(docs, key, text), _documents(docs, key, text), path)


def search(spark: SparkSession, path: str, terms: DataFrame, k: int) -> DataFrame:
    """``qid, doc_id, score, rank``: the ``k`` best documents per query of ``terms`` (``qid, term, qtf``), as ``bm25`` ranks them.

    The join on bucket and term prunes the buckets that no query names.
    """
    asked = terms.withColumn("bucket", _bucket(F.col("term")))
    postings = spark.read.parquet(f"{path}/postings").join(asked.select("bucket", "term").distinct(), ["bucket", "term"], "left_semi")
    stats = spark.read.parquet(f"{path}/documents").agg(F.count("*").alias("n_docs"), F.greatest(F.avg("dl"), F.lit(1.0)).alias("avgdl"))
    return R.top_k(R.bm25_scores(postings, stats, terms), k)


def refresh(spark: SparkSession, old: str, docs: DataFrame, new: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write under ``new`` the index of ``docs``, taking from ``old`` all that hasn't changed; ``doc_id, action`` of every document.

    Only inserted and updated documents are tokenised; an interrupted run leaves ``old`` as it was.
    """
    had = spark.read.parquet(f"{old}/documents")
    now = docs.select(F.col(key).alias("doc_id"), F.sha2(F.coalesce(text, F.lit("")), 256).alias("content"))
    from .dedup import refresh_diff

    actions = refresh_diff(had, now, "doc_id", "content")
    changed = docs.join(actions.where("action IN ('insert', 'update')").select(F.col("doc_id").alias(key)), key, "left_semi")
    kept = actions.where("action = 'keep'").select("doc_id")
    old_postings = spark.read.parquet(f"{old}/postings").join(kept, "doc_id", "left_semi")
    fresh = _postings(changed, key, text)
    _write(old_postings.select(fresh.columns).unionByName(fresh), had.join(kept, "doc_id", "left_semi").unionByName(_documents(changed, key, text)), new)
    return actions
