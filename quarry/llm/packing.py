"""Filling fixed-capacity containers with items (problem 7).

Sum-of-squares packing: each document goes where the sum of the squared counts of open
containers per residual gap becomes smallest, which keeps every gap that a later item
may need in stock.  No item is moved once it is placed.  What decides is only how many
open containers have which gap, an array no longer than the capacity.

Items are spread by a hash over shards of bounded size and packed shard by shard; as
sum-of-squares leaves few containers open, the shards cost a few containers each.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.storage import materialize

#: Items that one task packs, whatever the size of the corpus.
SHARD_ITEMS = 20_000


def sum_of_squares(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item, in the order given; sizes from 1 to ``capacity``."""
    count = np.zeros(capacity + 1, dtype=np.int64)  # open containers by gap
    opened = np.empty(capacity + 1, dtype=np.int64)  # the gaps that some open container has, in order: opened[:n]
    of_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    out = np.empty(len(sizes), dtype=np.int64)
    n = bins = 0
    for i, s in enumerate(sizes.tolist()):
        # Change of the sum: for gap g to g - s, 2 - 2 N(g) + 2 N(g - s); a perfect fit, 1 - 2 N(s); a new one, 1 + 2 N(C - s).
        best, where = (1 + 2 * int(count[capacity - s]) if s < capacity else 0), -1
        first = int(opened[:n].searchsorted(s))
        if first < n:
            gaps = opened[first:n]
            change = 2 - 2 * count[gaps] + 2 * count[gaps - s]
            if gaps[0] == s:
                change[0] = 1 - 2 * count[s]
            k = int(change.argmin())
            if change[k] <= best:
                where = int(gaps[k])
        if where < 0:
            b, where = bins, capacity
            bins += 1
        else:
            b = of_gap[where].pop()
            count[where] -= 1
            if not count[where]:
                at = first + k
                opened[at : n - 1] = opened[at + 1 : n]
                n -= 1
        out[i] = b
        if (left := where - s) > 0:
            if not count[left]:
                at = int(opened[:n].searchsorted(left))
                opened[at + 1 : n + 1] = opened[at:n]
                opened[at] = left
                n += 1
            count[left] += 1
            of_gap[left].append(b)
    return out


def pack_windows(sizes: DataFrame, windows: DataFrame, key: str = "doc_id", tokens: str = "n_tokens", shard_items: int = SHARD_ITEMS) -> DataFrame:
    """The place of every document in containers of each window: ``window_name, bin_id, key, piece_no, token_begin, token_end``.

    A document is divided only if it exceeds the capacity: into full pieces, each a
    container of its own, and a rest that is packed like any other item.  A document
    without tokens takes part with an empty piece.  ``windows`` is a table of at most
    1,000 rows; rows with no capacity or one below 1 are left out.  Repeated keys are
    packed each by itself; an empty table gives an empty result.
    """
    caps = [(r["window_name"], int(r["capacity"])) for r in windows.where("capacity >= 1").limit(1001).collect()]
    if len(caps) > 1000:
        raise ValueError("more than 1000 windows")
    kind = sizes.schema[key].dataType.simpleString()
    sizes = materialize(sizes.select(key, F.coalesce(tokens, F.lit(0)).cast("bigint").alias("n")))
    shards = max(1, math.ceil(sizes.count() / shard_items))
    each = sizes.withColumn("w", F.explode(F.array(*[F.struct(F.lit(w).alias("window_name"), F.lit(c).alias("c")) for w, c in caps])) if caps else F.lit(None).cast("struct<window_name:string,c:int>")).where("w is not null").select(key, "n", "w.*")
    full = F.when(F.col("n") > F.col("c"), F.floor(F.col("n") / F.col("c"))).otherwise(F.lit(0)).cast("int")
    each = each.withColumn("full", full)
    whole = each.where("full > 0").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("full") - 1)))
    whole = whole.select(
        "window_name", F.concat_ws("-", F.lit("full"), key, "piece").alias("bin_id"), key, (F.col("piece") + 1).alias("piece_no"),
        (F.col("piece") * F.col("c")).cast("bigint").alias("token_begin"), ((F.col("piece") + 1) * F.col("c")).cast("bigint").alias("token_end"),
    )
    items = each.withColumn("begin", F.col("full") * F.col("c")).withColumn("size", F.col("n") - F.col("begin")).where("size > 0 or full = 0")
    items = items.select("window_name", "c", F.pmod(F.xxhash64(key), F.lit(shards)).alias("shard"), F.xxhash64(key, F.lit(7)).alias("order"), key, (F.col("full") + 1).alias("piece_no"), F.col("begin").cast("bigint").alias("token_begin"), F.col("n").alias("token_end"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["order", key], kind="stable")
        size = (pdf.token_end - pdf.token_begin).to_numpy()
        bins = np.zeros(len(pdf), dtype=np.int64)  # empty documents share the first container
        bins[size > 0] = sum_of_squares(size[size > 0], int(pdf.c.iloc[0]))
        shard = f"{pdf['shard'].iloc[0]}-"
        return pdf.assign(bin_id=[f"{shard}{b}" for b in bins.tolist()])[["window_name", "bin_id", key, "piece_no", "token_begin", "token_end"]]

    packed = items.groupBy("window_name", "c", "shard").applyInPandas(one, f"window_name string, bin_id string, {key} {kind}, piece_no int, token_begin bigint, token_end bigint")
    return packed.unionByName(whole)
