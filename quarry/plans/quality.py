"""Audit queries: missing values, frequencies, medians, preservation, redaction, URLs, event percentiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..operators import quality as Q, redaction as D
from ..operators.multivalue import split_packed
from ..sources.tables import table
from .catalog import _BARE, _MISS

FIELDS = ["course_code", "class_no", "course_name", "professor", "completion_type", "credit", "class_hours", "schedule_summary", "syllabus_url"]


def missingness_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing values per field of the course list."""
    return Q.missingness(table(spark, sf_dir, "courses"), FIELDS)


def frequency_counts(spark, sf_dir):
    """Collection status by term."""
    return table(spark, sf_dir, "courses").groupBy("year", "term", "collection_status").agg(F.count("*").alias("n"))


def median_minmax_chars(spark, sf_dir):
    """Length of the texts per site: least, exact median, most, sum."""
    s = table(spark, sf_dir, "syllabus").where("text is not null").withColumn("n", F.length("text"))
    return s.groupBy("site_id").agg(F.min("n").alias("least"), F.median("n").alias("median"), F.max("n").alias("most"), F.sum("n").alias("total"))


def distinct_counts(spark, sf_dir):
    """Distinct codes, sections and year-terms."""
    c = table(spark, sf_dir, "courses")
    return c.agg(F.countDistinct(T.bare_code(F.col("course_code"))).alias("codes"), F.countDistinct("year", "term").alias("terms"), F.countDistinct("dept_code").alias("departments"))


def format_counts(spark, sf_dir):
    """Per attachment extension: rows, rows that collected well, rows with a path."""
    c = table(spark, sf_dir, "courses")
    return c.groupBy("attachment_ext").agg(F.count("*").alias("n"), F.count_if(F.col("collection_status") == "ok").alias("ok"), F.count_if(~T.missing(F.col("attachment_path"))).alias("with_path"))


def char_count_errors(spark, sf_dir):
    """Records whose stored length isn't the text's."""
    s = table(spark, sf_dir, "syllabus").where("text is not null")
    return s.where(F.col("char_count").isNull() | (F.col("char_count") != F.length("text"))).select("record_id", "char_count", F.length("text").alias("n_chars"))


def exact_p95(spark, sf_dir):
    """Value at rank int(.95 (n - 1)) per event type."""
    return Q.percentile_by_rank(table(spark, sf_dir, "events").where("value is not null"), ["event_type"], "value", 0.95)


def set_preservation(spark, sf_dir):
    """Per code, whether every meeting day of the course list is in the extracted records too."""
    days = lambda df: df
    s = table(spark, sf_dir, "syllabus").select(T.bare_code(F.col("course_code")).alias("code"), F.explode("schedule_entries").alias("e")).select("code", F.col("e.day").alias("day")).where("code <> ''").distinct()
    c = table(spark, sf_dir, "courses").select(T.bare_code(F.col("course_code")).alias("code"), F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("schedule_entries_json", F.lit("")), F.lit('"day": "([월화수목금토일])"'), F.lit(1)))).alias("day")).where("code <> ''").distinct()
    j = c.join(s.withColumn("there", F.lit(1)), ["code", "day"], "left")
    return days(j).groupBy("code").agg(F.count("*").alias("n_days"), F.count("there").alias("n_kept"), (F.count("*") == F.count("there")).alias("preserved"))


#: A day in an object, complete or broken off, whatever quotes and escapes are around it.
_DAY_OF_OBJECT = r"""["'\\]day["'\\]+\s*:\s*["'\\]+(u[0-9a-fA-F]{4}|[월화수목금토일])"""


def set_preservation_whole(spark, sf_dir):
    """Like ``set_preservation``, with the days of the course list read from every notation of the field.

    Days are those of the meetings that problem 3 reads and those of objects that break off.
    """
    s = table(spark, sf_dir, "syllabus").select(T.bare_code(F.col("course_code")).alias("code"), F.explode("schedule_entries").alias("e")).select("code", F.col("e.day").alias("day")).where("code <> ''").distinct()
    c = table(spark, sf_dir, "courses").select(T.bare_code(F.col("course_code")).alias("code"), "schedule_entries_json").where("code <> ''")
    read = split_packed(c, "code", {"schedule_entries_json": True}, 1).select("code", F.regexp_extract("value", r"^(?:[0-9０-９]{1,4}\s*분반\s*)?([월화수목금토일])", 1).alias("day"))
    letter = lambda x: F.coalesce(*[F.when(F.lower(x) == f"u{ord(d):04x}", d) for d in "월화수목금토일"], F.when(F.length(x) == 1, x))
    named = c.select("code", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("schedule_entries_json", F.lit(_DAY_OF_OBJECT), F.lit(1)), letter))).alias("day"))
    days = read.union(named).where("day <> ''").distinct()
    j = days.join(s.withColumn("there", F.lit(1)), ["code", "day"], "left")
    return j.groupBy("code").agg(F.count("*").alias("n_days"), F.count("there").alias("n_kept"), (F.count("*") == F.count("there")).alias("preserved"))


def redaction_counts(spark, sf_dir):
    """Matches per redaction rule and site, each counted on the text as the rules before left it."""
    _, counts = Q.redact(F.col("text"))
    per = table(spark, sf_dir, "syllabus").where("text is not null").select("site_id", *counts)
    return per.groupBy("site_id").agg(*[F.sum(n).alias(n) for n, _, _ in Q.RULES])


def redaction_residuals(spark, sf_dir):
    """Records where a rule still matches after redaction; none may."""
    text, _ = Q.redact(F.col("text"))
    left = table(spark, sf_dir, "syllabus").where("text is not null").select("record_id", text.alias("t"))
    return left.select("record_id", *[F.regexp_count("t", F.lit(p)).alias(n) for n, p, _ in Q.RULES]).where(" + ".join(n for n, _, _ in Q.RULES) + " > 0")


def redaction_totals(spark, sf_dir):
    """Per site, what each rule of the whole redaction takes out of its records' texts."""
    t = table(spark, sf_dir, "syllabus").where("text is not null").select("site_id", D.redacted(F.col("text")).alias("r"))
    return t.groupBy("site_id").agg(*[F.sum(f"r.{c}").alias(c) for c in D.COUNTERS])


def redaction_invariants(spark, sf_dir):
    """Per rule, how many texts were checked and how many still hold a match after redaction; none may."""
    return D.residuals(table(spark, sf_dir, "syllabus"), "record_id", "text")


def redacted_records(spark, sf_dir):
    """Every record with the texts in its fields, and in the structs of its meetings, redacted."""
    s = table(spark, sf_dir, "syllabus").select("record_id", "professor", "schedule_summary", "text", "schedule_entries")
    return D.redact_table(s, ["schedule_summary", "text", "schedule_entries"])


def shown_urls(spark, sf_dir):
    """Every syllabus URL as it may be shown, and what was taken off."""
    c = D.checked_url(F.col("syllabus_url"))
    return table(spark, sf_dir, "syllabus").select("record_id", c.alias("c")).select("record_id", "c.*")


def secret_flags(spark, sf_dir):
    """How many texts were searched for keys, and how many hold one."""
    s = table(spark, sf_dir, "documents").where("text is not null")
    found = D.secrets(s, "doc_id", "text").select("doc_id").distinct().agg(F.count("*").alias("n_found"))
    return s.agg(F.count("*").alias("n_searched")).join(F.broadcast(found))


def safe_url_filter(spark, sf_dir):
    """Every syllabus URL with only its course parameters."""
    return table(spark, sf_dir, "syllabus").select("record_id", Q.safe_url(F.col("syllabus_url")).alias("url"))


def mojibake_signals(spark, sf_dir):
    """Records per site with each sign of damage: replacement characters, runs of Latin-1, text set as Han."""
    s = table(spark, sf_dir, "syllabus").where("text is not null")
    return s.groupBy("site_id").agg(F.count_if(F.col("text").contains("�")).alias("replaced"), F.count_if(F.col("text").rlike("[À-ÿ]{3}")).alias("latin"), F.count_if(F.col("text").rlike("[慴扥湡潦牧]{2}")).alias("han"))


def domain_checks(spark, sf_dir):
    """Sources of syllabus rows against the sites' hosts: rows per site and host, and whether they agree."""
    s = table(spark, sf_dir, "syllabus").select("site_id", F.regexp_extract(F.coalesce("syllabus_url", F.lit("")), r"^https?://([^/?#]+)", 1).alias("found"))
    sites = table(spark, sf_dir, "sites").select("site_id", "host")
    return s.groupBy("site_id", "found").agg(F.count("*").alias("n")).join(sites, "site_id", "left").select("site_id", "found", "n", (F.col("found") == F.col("host")).alias("agrees"))


_R = "text"
_STEPS = []
for _n, _p, _put in Q.RULES:
    _STEPS.append((_n, f"len(regexp_extract_all({_R}, '{_p}'))"))
    _R = f"regexp_replace({_R}, '{_p}', '{_put}', 'g')"

SQL = {
    "missingness_report": "SELECT field, CAST(count_if(" + _MISS.format(c="v") + ") AS BIGINT) AS n_missing, round(100.0::DOUBLE * count_if(" + _MISS.format(c="v") + ") / greatest(count(*), 1), 2) AS pct FROM (SELECT unnest([" + ", ".join(f"'{f}'" for f in FIELDS) + "]) AS field, unnest([" + ", ".join(FIELDS) + "]) AS v FROM courses) GROUP BY field",
    "frequency_counts": "SELECT year, term, collection_status, count(*) AS n FROM courses GROUP BY ALL",
    "median_minmax_chars": "SELECT site_id, CAST(min(n) AS INT) AS least, median(n) AS median, CAST(max(n) AS INT) AS most, CAST(sum(n) AS BIGINT) AS total FROM (SELECT site_id, length(text) AS n FROM syllabus WHERE text IS NOT NULL) GROUP BY site_id",
    "distinct_counts": f"SELECT count(DISTINCT {_BARE}) AS codes, count(DISTINCT CASE WHEN year IS NOT NULL AND term IS NOT NULL THEN year || '|' || term END) AS terms, count(DISTINCT dept_code) AS departments FROM courses",
    "format_counts": f"SELECT attachment_ext, count(*) AS n, CAST(count_if(collection_status = 'ok') AS BIGINT) AS ok, CAST(count_if(NOT {_MISS.format(c='attachment_path')}) AS BIGINT) AS with_path FROM courses GROUP BY 1",
    "char_count_errors": "SELECT record_id, char_count, CAST(length(text) AS INT) AS n_chars FROM syllabus WHERE text IS NOT NULL AND (char_count IS NULL OR char_count <> length(text))",
    "exact_p95": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, max(CASE WHEN i = floor(0.95 * (n - 1)) THEN value END) AS percentile FROM r GROUP BY event_type",
    "set_preservation": f"""WITH s AS (SELECT DISTINCT {_BARE} AS code, e.day AS day FROM (SELECT course_code, unnest(schedule_entries) AS e FROM syllabus)),
        c AS (SELECT DISTINCT {_BARE} AS code, unnest(regexp_extract_all(coalesce(schedule_entries_json, ''), '"day": "([월화수목금토일])"', 1)) AS day FROM courses)
        SELECT c.code, count(*) AS n_days, count(s.code) AS n_kept, count(*) = count(s.code) AS preserved FROM c LEFT JOIN s ON c.code = s.code AND c.day = s.day WHERE c.code <> '' GROUP BY c.code""",
    "redaction_counts": "SELECT site_id, " + ", ".join(f"CAST(sum({x}) AS BIGINT) AS {n}" for n, x in _STEPS) + " FROM syllabus WHERE text IS NOT NULL GROUP BY site_id",
    "redaction_residuals": f"SELECT record_id, " + ", ".join(f"CAST(len(regexp_extract_all(t, '{p}')) AS INT) AS {n}" for n, p, _ in Q.RULES) + f" FROM (SELECT record_id, {_R} AS t FROM syllabus WHERE text IS NOT NULL) WHERE " + " OR ".join(f"regexp_matches(t, '{p}')" for _, p, _ in Q.RULES),
    "secret_flags": "SELECT count(*) AS n_searched, CAST(count_if(" + " OR ".join(f"regexp_matches(text, '{p}')" for p in D.SECRETS.values()) + ") AS BIGINT) AS n_found FROM documents WHERE text IS NOT NULL",
    "safe_url_filter": """WITH p AS (SELECT record_id, syllabus_url AS u, regexp_extract(syllabus_url, '^([^?#]*)', 1) AS b, list_filter(string_split(regexp_extract(syllabus_url, '^[^?#]*\\?([^#]*)', 1), '&'), lambda x: split_part(x, '=', 1) IN ('year', 'term', 'dept_cd', 'cour_cd', 'cour_cls') AND contains(x, '=')) AS k FROM syllabus)
        SELECT record_id, CASE WHEN regexp_matches(u, '^https?://[^/?#@\\s\\\\]+(?:[/?#]|$)') THEN b || CASE WHEN len(k) > 0 THEN '?' || array_to_string(k, '&') ELSE '' END END AS url FROM p""",
    "mojibake_signals": "SELECT site_id, CAST(count_if(contains(text, '�')) AS BIGINT) AS replaced, CAST(count_if(regexp_matches(text, '[À-ÿ]{3}')) AS BIGINT) AS latin, CAST(count_if(regexp_matches(text, '[慴扥湡潦牧]{2}')) AS BIGINT) AS han FROM syllabus WHERE text IS NOT NULL GROUP BY site_id",
    "domain_checks": "SELECT s.site_id, found, n, found = host AS agrees FROM (SELECT site_id, regexp_extract(coalesce(syllabus_url, ''), '^https?://([^/?#]+)', 1) AS found, count(*) AS n FROM syllabus GROUP BY 1, 2) s LEFT JOIN sites USING (site_id)",
}
QUERIES = {f.__name__: f for f in (missingness_report, frequency_counts, median_minmax_chars, distinct_counts, format_counts, char_count_errors, exact_p95, set_preservation, set_preservation_whole, redaction_counts, redaction_residuals, redaction_totals, redaction_invariants, redacted_records, shown_urls, secret_flags, safe_url_filter, mojibake_signals, domain_checks)}
