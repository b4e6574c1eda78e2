"""Ranking: BM25, cosine, rank fusion, thresholds, diversification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.storage import materialize
from ..functions.text import tokenize

K1, B = 1.5, 0.75


def idf(n_docs: Column, df: Column) -> Column:
    return F.log(1 + (n_docs - df + 0.5) / (df + 0.5))


def term_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """``term, df, idf`` over the distinct terms of each document; the count is combined before the shuffle."""
    n = docs.select(F.count("*").alias("n_docs"))
    terms = docs.select(F.explode(F.array_distinct(tokenize(F.col(text)))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return terms.join(F.broadcast(n)).select("term", "df", idf(F.col("n_docs"), F.col("df")).alias("idf"))


def query_terms(queries: DataFrame, qid: str, text: str) -> DataFrame:
    """``qid, term, qtf``."""
    return queries.select(F.col(qid).alias("qid"), F.explode(tokenize(F.col(text))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))


def bm25(docs: DataFrame, terms: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``qid, doc_id, score`` of every document that shares a term with a query.

    Only the terms asked for become postings: the term join comes before any shuffle of
    tokens and lengths are counted in the row.  The postings are written once; document
    frequencies and scores are read off them.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), tokenize(F.col(text)).alias("tokens"))
    sized = rows.withColumn("dl", F.size("tokens"))
    stats = sized.agg(F.count("*").alias("n_docs"), F.greatest(F.avg("dl"), F.lit(1.0)).alias("avgdl"))
    asked = terms.select("term").distinct()
    postings = sized.select("doc_id", "dl", F.explode("tokens").alias("term")).join(asked, "term", "left_semi").groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"))
    return bm25_scores(materialize(postings), stats, terms)


def bm25_scores(postings: DataFrame, stats: DataFrame, terms: DataFrame) -> DataFrame:
    """``qid, doc_id, score`` from the asked terms' postings (``doc_id, dl, term, tf``) and the corpus statistics (``n_docs, avgdl``)."""
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    weighted = terms.join(df, "term").join(F.broadcast(stats)).select("qid", "term", "qtf", "avgdl", idf(F.col("n_docs"), F.col("df")).alias("idf"))
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return postings.join(weighted, "term").groupBy("qid", "doc_id").agg(F.round(F.sum(part), 6).alias("score"))


def top_k(scored: DataFrame, k: int, by: str = "qid", score: str = "score", tie: str = "doc_id") -> DataFrame:
    """The ``k`` best per group with their ranks; ties go to the smaller id.  Spark prunes each partition to k per group before the shuffle."""
    w = W.partitionBy(by).orderBy(F.desc(score), tie)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def cosine_top_k(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", block: int = 2048, query_block: int = 512) -> DataFrame:
    """``qid, key, cosine``: exact k nearest rows of every query by cosine.

    Rows travel in blocks: a block of queries meets a block of rows in one matrix product,
    and only its k best per query leave the task.  Null or zero vectors score nothing.
    """

    def packed(name: str, size: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids: list = []
            rows: list = []

            def flush() -> pa.RecordBatch:
                m = np.asarray(rows, dtype=np.float64)
                norm = np.linalg.norm(m, axis=1)
                keep = norm > 0
                m = m[keep] / norm[keep, None]
                return pa.RecordBatch.from_arrays([pa.array([[i for i, x in zip(ids, keep) if x]], pa.list_(pa.int64())), pa.array([m.shape[1]], pa.int32()), pa.array([m.tobytes()], pa.binary())], names=[f"{name}_ids", f"{name}_dim", name])

            for b in batches:
                for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    if v:
                        ids.append(i)
                        rows.append(v)
                        if len(ids) == size:
                            yield flush()
                            ids.clear()
                            rows.clear()
            if ids:
                yield flush()

        return run, f"{name}_ids array<bigint>, {name}_dim int, {name} binary"

    run, schema = packed("r", block)
    row_blocks = vectors.select(F.col(key).cast("bigint"), vector).mapInArrow(run, schema)
    run, schema = packed("q", query_block)
    query_blocks = queries.select(F.col(key).cast("bigint"), vector).mapInArrow(run, schema)

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                a = np.frombuffer(r["q"]).reshape(-1, r["q_dim"])
                m = np.frombuffer(r["r"]).reshape(-1, r["r_dim"])
                scores = np.round(a @ m.T, 6)
                rows_ids = np.asarray(r["r_ids"])
                order = np.lexsort((np.broadcast_to(rows_ids, scores.shape), -scores), axis=1)[:, :k]
                n = order.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(r["q_ids"], n), pa.int64()), pa.array(rows_ids[order].ravel(), pa.int64()), pa.array(np.take_along_axis(scores, order, 1).ravel(), pa.float64())], names=["qid", key, "cosine"])

    near = query_blocks.join(row_blocks).mapInArrow(product, f"qid bigint, {key} bigint, cosine double")
    return top_k(near, k, score="cosine", tie=key)


#: Rows that the centroids of a vector index are fitted on, at most; every row is indexed.
SAMPLE = 8_192


def fit_centroids(vectors: DataFrame, lists: int, key: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE, rounds: int = 20) -> np.ndarray:
    """At most ``lists`` unit vectors that the rows gather around, by spherical k-means on a bounded sample: the ``sample`` rows of smallest key hash."""
    rows = vectors.where(F.size(vector) > 0).select(F.xxhash64(key).alias("h"), vector).orderBy("h").limit(sample).collect()
    if not rows:
        return np.zeros((0, 1))
    m = np.asarray([r[vector] for r in rows], dtype=np.float64)
    norm = np.linalg.norm(m, axis=1)
    m = m[norm > 0] / norm[norm > 0, None]
    # The first centroid is the first row, each further one the row that is farthest from those before.
    chosen, near = [0], np.full(len(m), -np.inf)
    while len(chosen) < min(lists, len(m)):
        near = np.maximum(near, m @ m[chosen[-1]])
        chosen.append(int(near.argmin()))
    c = m[chosen] if len(m) else m
    for _ in range(rounds if len(m) else 0):
        of = (m @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, of, m)
        size = np.linalg.norm(sums, axis=1)
        c = np.where(size[:, None] > 0, sums / np.maximum(size, 1e-12)[:, None], c)
    return c


def cosine_top_k_indexed(vectors: DataFrame, queries: DataFrame, k: int, lists: int = 64, probes: int = 40, key: str = "vec_id", vector: str = "embedding", block: int = 2048) -> DataFrame:
    """``qid, key, cosine, rank`` like ``cosine_top_k``, over the ``probes`` lists of rows nearest to each query.

    Every row is in the list of its nearest centroid.  Rows of a list travel in blocks, so
    that a list that holds a third of all rows is many rows of the join, which AQE splits;
    queries meet the blocks of their lists by an equality join.  What is in no probed list
    isn't found: recall is measured against the exact search in the tests.  Vectors that
    gather in directions need few probes; the default gives 0.9 and more even where they
    don't gather at all, and reads six rows of ten.  Null, empty and zero vectors score nothing.
    """
    centroids = fit_centroids(vectors, lists, key, vector)
    held = vectors.sparkSession.sparkContext.broadcast(centroids)

    def placed(n: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = held.value
            for b in batches:
                ids, rows = [], []
                for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    if v and any(v):
                        ids.append(i)
                        rows.append(v)
                if not ids or not len(c):
                    continue
                m = np.asarray(rows, dtype=np.float64)
                m /= np.linalg.norm(m, axis=1)[:, None]
                best = np.argsort(-(m @ c.T), axis=1, kind="stable")[:, :n]
                yield pa.RecordBatch.from_arrays([pa.array(best.ravel(), pa.int32()), pa.array(np.repeat(ids, best.shape[1]), pa.int64()), pa.array([r.tobytes() for r in m for _ in range(best.shape[1])], pa.binary())], names=["list", "id", "v"])

        return run, "list int, id bigint, v binary"

    def packed(size: int, name: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, ids, rows = None, [], []

            def flush() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([b"".join(rows)], pa.binary())], names=["list", f"{name}_ids", name])

            for b in batches:
                for g, i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                    if ids and (g != at or len(ids) == size):
                        yield flush()
                        ids, rows = [], []
                    at = g
                    ids.append(i)
                    rows.append(v)
            if ids:
                yield flush()

        return run, f"list int, {name}_ids array<bigint>, {name} binary"

    def blocks(df: DataFrame, n: int, size: int, name: str) -> DataFrame:
        run, schema = placed(n)
        rows = df.select(F.col(key).cast("bigint"), vector).mapInArrow(run, schema).sortWithinPartitions("list")
        run, schema = packed(size, name)
        return rows.mapInArrow(run, schema)

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dim = held.value.shape[1]
        for batch in batches:
            for r in batch.to_pylist():
                a, m = np.frombuffer(r["q"]).reshape(-1, dim), np.frombuffer(r["r"]).reshape(-1, dim)
                scores, ids = np.round(a @ m.T, 6), np.asarray(r["r_ids"])
                order = np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)[:, :k]
                n = order.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(r["q_ids"], n), pa.int64()), pa.array(ids[order].ravel(), pa.int64()), pa.array(np.take_along_axis(scores, order, 1).ravel(), pa.float64())], names=["qid", key, "cosine"])

    met = blocks(queries, probes, 512, "q").join(blocks(vectors, 1, block, "r"), "list").select("q_ids", "q", "r_ids", "r")
    return top_k(met.mapInArrow(product, f"qid bigint, {key} bigint, cosine double"), k, score="cosine", tie=key)


def rrf(lists: list[DataFrame], key: str = "doc_id", by: str = "qid", c: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists (``by, key, rank``): the sum of 1 / (c + rank)."""
    union = lists[0].select(by, key, "rank")
    for x in lists[1:]:
        union = union.unionByName(x.select(by, key, "rank"))
    return union.groupBy(by, key).agg(F.round(F.sum(1.0 / (c + F.col("rank"))), 6).alias("rrf"))


def hybrid_evidence(lexical: DataFrame, semantic: DataFrame, key: str = "doc_id", by: str = "qid") -> DataFrame:
    """Both lists joined in full: 0.55 semantic + 0.30 lexical / best + 0.15 fused rank / best, per query."""
    a = lexical.select(by, key, F.col("score").alias("lexical"), F.col("rank").alias("lexical_rank"))
    b = semantic.select(by, key, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("cosine"))).alias("semantic"), F.col("rank").alias("semantic_rank"))
    j = a.join(b, [by, key], "full_outer")
    fused = F.coalesce(1.0 / (60 + F.col("lexical_rank")), F.lit(0.0)) + F.coalesce(1.0 / (60 + F.col("semantic_rank")), F.lit(0.0))
    j = j.select(by, key, F.coalesce("lexical", F.lit(0.0)).alias("lexical"), F.coalesce("semantic", F.lit(0.0)).alias("semantic"), fused.alias("fused"))
    w = W.partitionBy(by)
    best = lambda c: F.greatest(F.max(c).over(w), F.lit(1e-9))
    return j.withColumn("evidence", F.round(0.55 * F.col("semantic") + 0.30 * F.col("lexical") / best("lexical") + 0.15 * F.col("fused") / best("fused"), 6))


def relevance_threshold(ranked: DataFrame, floor: float = 0.18, share: float = 0.42, by: str = "qid", score: str = "evidence") -> DataFrame:
    """Rows of at least ``floor`` and ``share`` of the query's best score."""
    top = F.max(score).over(W.partitionBy(by))
    return ranked.withColumn("top", top).where(F.col(score) >= F.greatest(F.lit(floor), F.lit(share) * F.col("top"))).drop("top")


def per_group_cap(ranked: DataFrame, group: str, cap: int, by: str = "qid", rank: str = "rank") -> DataFrame:
    """At most ``cap`` rows of each group per query, the best ranked ones."""
    return ranked.withColumn("in_group", F.row_number().over(W.partitionBy(by, group).orderBy(rank))).where(F.col("in_group") <= cap)


def mmr(candidates: DataFrame, k: int, cap: int, by: str = "qid", key: str = "doc_id", group: str = "course_code", score: str = "score", tokens: str = "tokens", weight: float = 0.78) -> DataFrame:
    """Greedy diversification of each query's candidates (a bounded over-fetch): ``by, key, position``.

    Each step takes the largest ``weight * score / best - (1 - weight) * most similar chosen``
    (token Jaccard), at most ``cap`` per group, the earlier candidate on ties.
    """
    schema = f"{by} {candidates.schema[by].dataType.simpleString()}, {key} {candidates.schema[key].dataType.simpleString()}, position int"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([score, key], ascending=[False, True], kind="stable")
        sets = [frozenset(t) if t is not None else frozenset() for t in pdf[tokens]]
        best = max(float(pdf[score].max()), 0.0) or 1.0
        base = weight * pdf[score].to_numpy() / best
        groups, ids = pdf[group].tolist(), pdf[key].tolist()
        similar = np.zeros(len(pdf))
        left, used, out = list(range(len(pdf))), {}, []
        while left and len(out) < k:
            left = [i for i in left if groups[i] is None or used.get(groups[i], 0) < cap]
            if not left:
                break
            i = max(left, key=lambda x: (base[x] - (1 - weight) * similar[x], -x))
            out.append(ids[i])
            used[groups[i]] = used.get(groups[i], 0) + 1
            left.remove(i)
            for x in left:
                union = len(sets[x] | sets[i])
                similar[x] = max(similar[x], len(sets[x] & sets[i]) / union if union else 0.0)
        return pd.DataFrame({by: [pdf[by].iloc[0]] * len(out), key: out, "position": range(1, len(out) + 1)})

    return candidates.groupBy(by).applyInPandas(run, schema)
