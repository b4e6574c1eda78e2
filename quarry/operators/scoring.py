"""BM25 of many queries over many documents, of which only the best of each query leave their task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..functions.storage import materialize
from ..functions.text import tokenize
from . import retrieval as R

#: Matrix products take so many times less per element than postings that are added one by one; terms of one pair of blocks that may be rows of a matrix; postings added at a time.
DENSE, ROWS, CHUNK = 400, 1024, 1_000_000
#: Relative error of single-precision sums, many times over, and that of rounding to six digits.
LOOSE, DIGITS = 2e-5, 2e-6


def _blocks(docs: DataFrame, doc_id: str, text: str, block: int, tokens: int = 4_000_000) -> DataFrame:
    """Documents in blocks, a row each: ids and lengths, and by term the places in the block (as gaps) with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, pa.Array]] = []

        def flush() -> pa.RecordBatch:
            ids = np.concatenate([i for i, _ in held])
            dl = np.concatenate([pc.list_value_length(t).to_numpy(zero_copy_only=False) for _, t in held]).astype(np.int32)
            coded = pa.concat_arrays([t.flatten() for _, t in held]).dictionary_encode()
            n = len(ids)
            at, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * n + np.repeat(np.arange(n), dl), return_counts=True)
            term, place = np.divmod(at, n)
            df = np.bincount(term, minlength=len(coded.dictionary)).astype(np.int32)
            gaps = np.diff(place, prepend=0)
            begins = (np.cumsum(df) - df)[df > 0]
            gaps[begins] = place[begins]
            cells = [ids.tobytes(), dl.tobytes(), n, int(dl.sum()), coded.dictionary.to_pylist(), df, gaps.astype(np.uint16).tobytes(), tf.astype(np.int32).tobytes()]
            kinds = [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds)], names=["r_ids", "r_dl", "n_docs", "n_tokens", "r_terms", "r_df", "r_gaps", "r_tf"])

        n = size = 0
        for b in batches:
            begin = 0
            while begin < b.num_rows:
                part = b.slice(begin, min(block - n, 512))
                held.append((part.column(0).to_numpy(), part.column(1)))
                begin, n, size = begin + part.num_rows, n + part.num_rows, size + len(part.column(1).flatten())
                if n >= block or size >= tokens:
                    yield flush()
                    held.clear()
                    n = size = 0
        if held:
            yield flush()

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), tokenize(F.col(text)).alias("tokens"))
    return rows.mapInArrow(run, "r_ids binary, r_dl binary, n_docs bigint, n_tokens bigint, r_terms array<string>, r_df array<int>, r_gaps binary, r_tf binary")


def _query_blocks(weighted: DataFrame, block: int) -> DataFrame:
    """Queries (``qid, term, weight, avgdl``) in blocks, a row each: ids, and by term the queries with their weights."""
    qid = weighted.schema["qid"].dataType.simpleString()
    rows = weighted.groupBy("qid").agg(F.collect_list("term").alias("terms"), F.collect_list("weight").alias("weights"), F.first("avgdl").alias("avgdl"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for begin in range(0, b.num_rows, block):
                ids, terms, weights, avgdl = b.slice(begin, block).columns
                lengths = pc.list_value_length(terms).to_numpy(zero_copy_only=False)
                coded = terms.flatten().dictionary_encode()
                code = coded.indices.to_numpy()
                order = np.argsort(code, kind="stable")
                query = np.repeat(np.arange(len(ids), dtype=np.int32), lengths)[order]
                cells = [avgdl[0].as_py(), coded.dictionary.to_pylist(), np.bincount(code, minlength=len(coded.dictionary)).astype(np.int32), query.tobytes(), weights.flatten().to_numpy()[order].tobytes()]
                kinds = [pa.float64(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays([0, len(ids)], ids), *[pa.array([c], k) for c, k in zip(cells, kinds)]], names=["q_ids", "avgdl", "q_terms", "q_n", "q_at", "q_weight"])

    packed = rows.mapInArrow(run, f"q_ids array<{qid}>, avgdl double, q_terms array<string>, q_n array<int>, q_at binary, q_weight binary")
    return packed.withColumn("q_no", F.monotonically_increasing_id())


class _Rows:
    """A block of documents, read from its row."""

    def __init__(self, ids, dl, terms: pa.Array, df: np.ndarray, gaps, tf, avgdl: float):
        self.ids, dl, gaps, tf = np.frombuffer(ids, np.int64), np.frombuffer(dl, np.int32), np.frombuffer(gaps, np.uint16).astype(np.int64), np.frombuffer(tf, np.int32)
        self.terms, self.df, self.begin = terms, df, np.cumsum(df) - df
        run = np.cumsum(gaps)
        self.place = (run - np.repeat(run[self.begin] - gaps[self.begin], df)).astype(np.int32) if len(df) else run.astype(np.int32)
        self.share = tf / (tf + R.K1 * (1 - R.B + R.B * dl[self.place] / avgdl))


def _scores(rows: _Rows, nq: int, known: np.ndarray, count: np.ndarray, at: np.ndarray, weight: np.ndarray):
    """(the sums of rare terms, exact; those of frequent ones as two factors) of a block of queries and a block of documents."""
    n = len(rows.ids)
    ends = np.cumsum(count)
    cost = np.where(known >= 0, count * rows.df[known].astype(np.int64), 0) if len(rows.df) else np.zeros(len(known), np.int64)
    dense = np.argsort(-cost, kind="stable")[:ROWS]
    dense = dense[cost[dense] * DENSE > nq * n]
    left, across = np.zeros((nq, len(dense))), np.zeros((n, len(dense)))
    for j, t in enumerate(dense):
        left[at[ends[t] - count[t] : ends[t]], j] = weight[ends[t] - count[t] : ends[t]]
        b = rows.begin[known[t]]
        across[rows.place[b : b + rows.df[known[t]]], j] = rows.share[b : b + rows.df[known[t]]]
    cost[dense] = 0
    entries = np.flatnonzero(np.repeat(cost > 0, count))
    entries = entries[np.argsort(at[entries], kind="stable")]
    term = known[np.repeat(np.arange(len(known)), count)[entries]]
    many = rows.df[term].astype(np.int64) if len(entries) else np.zeros(0, np.int64)
    total = np.zeros(nq * n)
    cuts = np.searchsorted(np.cumsum(many), np.arange(CHUNK, int(many.sum()) + CHUNK, CHUNK), "left") + 1 if len(entries) else []
    begin = 0
    for end in np.unique(np.minimum(cuts, len(entries))) if len(entries) else []:
        m, e = many[begin:end], entries[begin:end]
        first = np.cumsum(m) - m
        where = np.repeat(rows.begin[term[begin:end]] - first, m) + np.arange(int(m.sum()))
        low, high = int(at[e[0]]) * n, (int(at[e[-1]]) + 1) * n
        cells = np.repeat(at[e].astype(np.int64) * n - low, m) + rows.place[where]
        total[low:high] += np.bincount(cells, np.repeat(weight[e], m) * rows.share[where], high - low)
        begin = end
    return total.reshape(nq, n), left, across


def _best(rows: _Rows, floor: np.ndarray, k: int, total: np.ndarray, left: np.ndarray, across: np.ndarray):
    """(query, document, score) of the k best of every query that reach its ``floor``, which is raised to the k-th score.

    Single precision finds who may be among them, with room for its error; their scores are summed in double.
    """
    near = left.astype(np.float32) @ across.astype(np.float32).T
    near += total
    low = np.maximum(floor * (1 - LOOSE) - DIGITS, 1e-30)
    met = near >= low.astype(np.float32)[:, None]
    many = np.flatnonzero(np.count_nonzero(met, axis=1) > 4 * k)
    if len(many):
        kth = np.partition(near[many], near.shape[1] - k, axis=1)[:, near.shape[1] - k].astype(np.float64)
        met[many] = near[many] >= np.maximum(low[many], kth * (1 - LOOSE) - DIGITS).astype(np.float32)[:, None]
    q, d = np.divmod(np.flatnonzero(met), near.shape[1])
    score = total[q, d]
    for b in range(0, len(q), 8192):
        part = slice(b, b + 8192)
        score[part] += np.einsum("ij,ij->i", left[q[part]], across[d[part]])
    score = np.round(score, 6)
    order = np.lexsort((rows.ids[d], -score, q))
    q, d, score = q[order], d[order], score[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    full = rank == k - 1
    floor[q[full]] = np.maximum(floor[q[full]], score[full])
    keep = (rank < k) & (score >= floor[q])
    return q[keep], d[keep], score[keep]


def bm25_top_k(docs: DataFrame, terms: DataFrame, k: int, doc_id: str = "doc_id", text: str = "text", block: int = 8192, query_block: int = 512) -> DataFrame:
    """``qid, doc_id, score, rank``: the ``k`` best documents of every query of ``terms`` (``qid, term, qtf``), as ``top_k`` of ``bm25`` has them.

    Every document that shares a term with a query gets its score, but in memory: a block of
    queries meets a block of documents, frequent terms as a matrix product and rare ones by
    their postings, and the k best of each pair of blocks are all that is shuffled.  On disk
    are the blocks (texts are tokenised once) and the queries.  Ids of documents are unique numbers.
    """
    rows = materialize(_blocks(docs, doc_id, text, block), "zstd")
    stats = rows.agg(F.sum("n_docs").alias("n_docs"), F.greatest(F.sum("n_tokens") / F.sum("n_docs"), F.lit(1.0)).alias("avgdl"))
    df = rows.select(F.explode(F.arrays_zip("r_terms", "r_df")).alias("x")).groupBy(F.col("x.r_terms").alias("term")).agg(F.sum("x.r_df").alias("df"))
    weight = F.col("qtf") * R.idf(F.col("n_docs"), F.col("df")) * (R.K1 + 1)
    weighted = terms.join(df, "term").join(F.broadcast(stats)).select("qid", "term", weight.alias("weight"), "avgdl")
    queries = materialize(_query_blocks(weighted, query_block), "zstd")

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no, held = None, None
        floors: dict[int, np.ndarray] = {}
        for batch in batches:
            c = dict(zip(batch.schema.names, batch.columns))
            for i in range(batch.num_rows):
                raw = lambda name: c[name][i].as_buffer()  # noqa: B023, E731
                if c["r_ids"][i].is_valid:
                    no = c["r_no"][i].as_py()
                    held = _Rows(raw("r_ids").to_pybytes(), *[raw("r_dl").to_pybytes(), pa.concat_arrays([c["r_terms"][i].values]), c["r_df"][i].values.to_numpy().copy(), raw("r_gaps").to_pybytes(), raw("r_tf").to_pybytes()], c["avgdl"][i].as_py())
                if no != c["r_no"][i].as_py():
                    raise RuntimeError("a block of queries came before its block of documents")
                ids = c["q_ids"][i].values
                known = pc.fill_null(pc.index_in(c["q_terms"][i].values, value_set=held.terms), -1).to_numpy(zero_copy_only=False)
                parts = _scores(held, len(ids), known, c["q_n"][i].values.to_numpy(), np.frombuffer(raw("q_at"), np.int32), np.frombuffer(raw("q_weight"), np.float64))
                floor = floors.setdefault(c["q_no"][i].as_py(), np.zeros(len(ids)))
                q, d, score = _best(held, floor, min(k, len(held.ids)), *parts) if k <= len(held.ids) else _best(held, np.zeros(len(ids)), len(held.ids), *parts)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(q)), pa.array(held.ids[d]), pa.array(score)], names=["qid", "doc_id", "score"])

    # Every block of documents meets all queries in one task, one after the other, and travels with the first of them only.
    asked = queries.coalesce(1).withColumn("first", F.monotonically_increasing_id() == 0)
    joined = rows.withColumn("r_no", F.monotonically_increasing_id()).join(asked.hint("shuffle_replicate_nl"))
    met = joined.select("r_no", *[F.when(F.col("first"), F.col(c)).alias(c) for c in ("r_ids", "r_dl", "r_terms", "r_df", "r_gaps", "r_tf")], *queries.columns)
    best = met.mapInArrow(product, f"qid {terms.schema['qid'].dataType.simpleString()}, doc_id bigint, score double")
    return R.top_k(best, k)
