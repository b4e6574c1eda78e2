"""Duplicates: canonical choice, near-duplicates with greedy survival, field coalescing, schedule merging, index refresh."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.storage import materialize, scratch


def shingles(text: Column, words: int = 5) -> Column:
    """Distinct hashes of the runs of ``words`` words of a text; a shorter text is one shingle, a blank one none."""
    words_of = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\s\p{Z}]+"), lambda x: x != "")

    def runs(w: Column) -> Column:
        n = F.size(w)
        hashes = F.transform(F.sequence(F.lit(1), F.greatest(n - words + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, words)))
        return F.when(n > 0, F.array_distinct(hashes)).otherwise(F.array().cast("array<bigint>"))

    # The one-element array binds the words to a variable: else every run would split the text anew.
    return F.transform(F.array(words_of), runs)[0]


def near_duplicate_classes(df: DataFrame, key: str, text: str, block: Column) -> tuple[DataFrame, DataFrame]:
    """Members and classes: ``key, class`` of every row, and ``class, block, s, size, longest`` of each set of equal shingles within a block.

    Rows of one class are copies of each other (texts without a word are copies too); only
    classes are compared.  Sets are told apart by 128 bits.  ``longest`` is the length of a
    class's longest text.
    """
    s = F.sort_array(shingles(F.col(text)))
    hashed = df.select(key, block.alias("block"), s.alias("s"), F.coalesce(F.length(text), F.lit(0)).alias("n_chars"))
    rows = materialize(hashed.select("*", F.xxhash64("block", "s", F.lit(1)).alias("h1"), F.xxhash64(F.lit(2), "s", "block").alias("h2")))
    classes = materialize(rows.groupBy("h1", "h2").agg(F.min(key).alias("class"), F.first("block").alias("block"), F.first("s").alias("s"), F.count("*").alias("size"), F.max("n_chars").alias("longest")))
    return rows.select(key, "h1", "h2").join(classes.select("h1", "h2", "class"), ["h1", "h2"]).select(key, "class"), classes.drop("h1", "h2")


def near_duplicate_links(classes: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``a, b, similarity`` (a < b): classes of one block whose shingle sets have a Jaccard of ``threshold`` or more.

    Prefix filtering, exact: sets whose Jaccard reaches t share one of the first
    |s| - ceil(t |s|) + 1 shingles in any common order; the rarest come first, and a
    shingle that occurs once meets nobody, nor does a class that is alone in its block.
    Sizes must agree within t; what is left is compared in full.
    """
    several = classes.where(F.size("s") > 0).groupBy("block").agg(F.count("*").alias("k")).where("k > 1").select("block")
    met = classes.where(F.size("s") > 0).join(several, "block", "left_semi")
    # A shingle of a block is one number, so that the rows that are shuffled are narrow.
    flat = met.select("class", F.size("s").alias("n"), F.explode(F.transform("s", lambda x: F.xxhash64("block", x))).alias("x"))
    shared = flat.groupBy("x").agg(F.count("*").alias("df")).where("df > 1")
    ordered = flat.join(shared, "x").groupBy("class", "n").agg(F.sort_array(F.collect_list(F.struct("df", "x"))).alias("o"))
    # Those that occur once stand before the shared ones in the order.
    keep = F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - 1e-9) + 1 - (F.col("n") - F.size("o"))
    prefix = materialize(ordered.where(keep > 0).select("class", "n", F.explode(F.slice("o", F.lit(1), keep.cast("int"))).alias("e")).select("class", "n", F.col("e.x").alias("x")))
    a, b = (prefix.select("x", F.col("class").alias(c), F.col("n").alias(f"n_{c}")) for c in "ab")
    fits = (F.col("a") < F.col("b")) & (F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * F.lit(threshold) - 1e-9)
    pairs = a.join(b, "x").where(fits).select("a", "b").distinct()
    sets = [met.select(F.col("class").alias(c), F.col("block").alias(f"block_{c}"), F.col("s").alias(f"s{c}")) for c in "ab"]
    both = pairs.join(sets[0], "a").join(sets[1], "b").where("block_a = block_b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.select("a", "b", (common / (F.size("sa") + F.size("sb") - common)).alias("similarity")).where(F.col("similarity") >= threshold - 1e-9)


def greedy_survivors(classes: DataFrame, links: DataFrame, rank: DataFrame) -> DataFrame:
    """``class, keeper``: best first, each class survives unless a better survivor is linked to it; the best such one keeps it.

    ``rank`` gives ``class, rank`` (smaller is better).  Every round drops all classes at
    once that are linked to a better one that waits for none, until no class waits; that
    is what the order one by one gives.  Each round settles the best waiting class at
    least, so the rounds end; a chain takes half as many as it has classes.
    """
    better = links.select(F.col("a").alias("class"), F.col("b").alias("other")).union(links.select(F.col("b").alias("class"), F.col("a").alias("other")))
    r = rank.select(F.col("class").alias("other"), F.col("rank").alias("other_rank"))
    edges = materialize(better.join(rank, "class").join(r, "other").where("other_rank < rank").select("class", "other", "other_rank"))
    waiting, at, n = edges.select("class", "other"), scratch(edges.sparkSession, "gone"), 0
    dropped = waiting.select("class").schema
    while True:
        sure = waiting.select("other").distinct().join(waiting.select(F.col("class").alias("other")), "other", "left_anti")
        waiting.join(sure, "other", "left_semi").select("class").distinct().write.parquet(f"{at}/round={n}")
        gone = edges.sparkSession.read.schema(dropped).parquet(f"{at}/round={n}")
        waiting = materialize(waiting.join(gone, "class", "left_anti").join(gone.select(F.col("class").alias("other")), "other", "left_anti").select("class", "other"))
        if waiting.isEmpty():
            break
        n += 1
    gone = edges.sparkSession.read.schema(dropped).parquet(at).select("class")
    keepers = edges.join(gone, "class", "left_semi").join(gone.select(F.col("class").alias("other")), "other", "left_anti").groupBy("class").agg(F.min_by("other", "other_rank").alias("keeper"))
    return classes.join(gone, "class", "left_anti").select("class", F.col("class").alias("keeper")).unionByName(keepers)


def coalesce_fields(df: DataFrame, by: list[Column], fields: list[str], order: str) -> DataFrame:
    """One row per group: each field's first value that isn't empty, in ``order``; partial minima, no window."""
    filled = lambda f: F.col(f).isNotNull() & (F.trim(f) != "")
    return df.groupBy(*by).agg(*[F.min_by(F.col(f), F.when(filled(f), F.col(order))).alias(f) for f in fields], F.count("*").alias("n_rows"))


def refresh_diff(existing: DataFrame, expected: DataFrame, key: str, content: str) -> DataFrame:
    """``key, action``: what brings an index from one state to the other: delete, insert, update or keep."""
    j = existing.select(key, F.col(content).alias("old")).join(expected.select(key, F.col(content).alias("new")), key, "full_outer")
    action = F.when(F.col("new").isNull(), "delete").when(F.col("old").isNull(), "insert").when(F.col("old") != F.col("new"), "update").otherwise("keep")
    return j.select(key, action.alias("action"))
