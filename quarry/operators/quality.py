"""Audits: missing values, frequencies, exact percentiles, redaction counters, label checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import missing


def missingness(df: DataFrame, fields: list[str]) -> DataFrame:
    """``field, n_missing, pct``: one aggregate over all fields, then unpivoted."""
    agg = df.agg(F.count("*").alias("n"), *[F.sum(missing(F.col(f).cast("string")).cast("bigint")).alias(f) for f in fields])
    return agg.unpivot("n", fields, "field", "n_missing").select("field", F.coalesce("n_missing", F.lit(0)).alias("n_missing"), F.round(100.0 * F.col("n_missing") / F.greatest("n", F.lit(1)), 2).alias("pct"))


#: Groups up to this size are ranked as a whole.
WHOLE = 100_000


def percentile_by_rank(df: DataFrame, by: list[str], value: str, p: float) -> DataFrame:
    """``by..., n, mean, percentile``: the value at 0-based rank ``int(p (n - 1))``, exactly.

    A sketch brackets the value of a large group between ranks p - 0.001 and p + 0.001 (its
    error is a tenth of that); what lies below is only counted, and the ranks run over the
    different values inside the bracket, so no group of any size is sorted as a whole.
    """
    from pyspark.sql import Window as W

    edge = [max(0.0, p - 1e-3), min(1.0, p + 1e-3)]
    sketch = df.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"), F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.percentile_approx(value, edge, 10_000).alias("_q"))
    large = F.col("n") > WHOLE
    sketch = sketch.select(*by, "n", "mean", F.when(large, F.col("_q")[0]).otherwise(F.col("_lo")).alias("_lo"), F.when(large, F.col("_q")[1]).otherwise(F.col("_hi")).alias("_hi"))
    j = df.select(*by, value).join(sketch, by).where(F.col(value) <= F.col("_hi"))
    counts = j.groupBy(*by, "n", "mean", F.when(F.col(value) >= F.col("_lo"), F.col(value)).alias("v")).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(W.partitionBy(*by).orderBy(F.asc_nulls_first("v")).rowsBetween(W.unboundedPreceding, 0))
    rank = F.floor(F.lit(p) * (F.col("n") - 1))
    ranked = counts.withColumn("_upto", upto)
    return ranked.where((F.col("_upto") > rank) & (F.col("_upto") - F.col("c") <= rank)).select(*by, "n", "mean", F.col("v").alias("percentile"))


#: What is redacted, in order, with the counter of each rule.
RULES = (
    ("emails", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[email removed]"),
    ("phones", r"(?:\+82[ .-]?10|010|0[2-6][0-9]?)[ .)-]{0,2}[0-9]{3,4}[ .-]?[0-9]{4}", "[phone removed]"),
    ("ids", r"[0-9]{6} ?- ?[1-8][0-9]{6}", "[id removed]"),
)


def redact(text: Column) -> tuple[Column, list[Column]]:
    """The redacted text and, per rule, the matches counted on the text as the rules before left it."""
    counts = []
    for name, pattern, put in RULES:
        counts.append(F.regexp_count(text, F.lit(pattern)).alias(name))
        text = F.regexp_replace(text, pattern, put)
    return text, counts


def safe_url(url: Column, keep: tuple[str, ...] = ("year", "term", "dept_cd", "cour_cd", "cour_cls")) -> Column:
    """The URL with only the parameters of the allow-list and no fragment; null unless it is http(s) with a host and without credentials."""
    ok = url.rlike(r"^https?://[^/?#@\s\\]+(?:[/?#]|$)")
    base = F.regexp_extract(url, r"^([^?#]*)", 1)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda p: F.substring_index(p, "=", 1).isin(*keep) & p.contains("="))
    return F.when(ok, F.concat(base, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))
