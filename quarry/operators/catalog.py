"""Catalog operators: contained names, topic evidence, clock ranges of periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import normalize_title, zfill


def period_begin(period: Column) -> Column:
    """Period n begins at 8 + n o'clock."""
    return F.concat(zfill((8 + period).cast("string"), 2), F.lit(":00"))


def period_end(period: Column) -> Column:
    """Period n ends ten minutes before the next hour."""
    return F.concat(zfill((8 + period).cast("string"), 2), F.lit(":50"))


def topics(df: DataFrame, key: str, text: str, patterns: dict[str, str]) -> DataFrame:
    """``key, topic`` for every topic whose pattern a text matches: one scan, no join."""
    hits = F.filter(F.array(*[F.when(F.col(text).rlike(p), F.lit(t)) for t, p in patterns.items()]), lambda t: t.isNotNull())
    return df.select(key, F.explode(hits).alias("topic"))


def longest_contained(texts: DataFrame, names: DataFrame, key: str, text: str, name: str, least: int = 2) -> DataFrame:
    """``key, title``: the longest normalised names that a text contains, all ties kept.

    An equi-join instead of a nested loop: a text offers its substrings of the lengths
    that names have, and only these meet the names.
    """
    titles = names.select(normalize_title(F.col(name)).alias("title")).where(F.length("title") >= least).distinct()
    lengths = titles.agg(F.sort_array(F.collect_set(F.length("title"))).alias("lengths"))
    t = texts.where(F.col(text).isNotNull()).select(key, normalize_title(F.col(text)).alias("q")).join(F.broadcast(lengths))
    t = t.select(key, "q", F.explode("lengths").alias("n")).where(F.length("q") >= F.col("n"))
    parts = t.select(key, "n", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("q") - F.col("n") + 1), lambda i: F.substring(F.col("q"), i, F.col("n"))))).alias("title"))
    found = parts.join(titles, "title", "left_semi")
    best = F.rank().over(W.partitionBy(key).orderBy(F.desc("n")))
    return found.withColumn("r", best).where("r = 1").select(key, "title")


def weekday(question: Column) -> Column:
    """The first weekday that a question names, by its full name; null without one."""
    day = F.regexp_extract(question, "([월화수목금토일])요일", 1)
    return F.when(day != "", day)


def period_range(question: Column) -> tuple[Column, Column]:
    """First and last period that a question names (``3-5교시``, ``2교시``); null without one."""
    number = lambda p: F.regexp_extract(question, p, 1).try_cast("int")
    first = number(r"([0-9]{1,2})(?:\s*(?:-|~|부터)\s*[0-9]{1,2})?\s*교시")
    return first, F.coalesce(number(r"[0-9]{1,2}\s*(?:-|~|부터)\s*([0-9]{1,2})\s*교시"), first)


def conjunctive_matches(facts: DataFrame, asked: DataFrame, dims: list[str], item: str) -> DataFrame:
    """``dims..., item``: the items with a fact that meets every condition of a row of ``asked`` (null: no condition).

    Each fact offers itself under every choice of conditions, so that an equality join
    does what would be a nested loop over questions and facts; four dimensions at most.
    """
    if not 1 <= len(dims) <= 4:
        raise ValueError("from one to four dimensions")
    masks = F.array(*[F.struct(*[(F.col(d) if m >> i & 1 else F.lit(None).cast(facts.schema[d].dataType)).alias(d) for i, d in enumerate(dims)]) for m in range(1 << len(dims))])
    offers = facts.select(*dims, item).distinct().select(F.col(item), F.explode(masks).alias("m")).select(item, *[F.col(f"m.{d}").alias(f"_{d}") for d in dims]).distinct()
    on = [F.col(d).eqNullSafe(F.col(f"_{d}")) for d in dims]
    return asked.select(*dims).distinct().join(offers, on).select(*dims, item)
