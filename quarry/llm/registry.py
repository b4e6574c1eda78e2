"""Queries of the training-data operators, and the SQL of those that SQL expresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.tables import table
from . import boilerplate, encoding, fusion, lookalike, packing, pii, tokenizing

FUSED = ["professor", "completion_type", "credit", "schedule_summary", "text"]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that at least 8 and a tenth of their site's records contain."""
    return boilerplate.repeated_lines(table(spark, sf_dir, "syllabus"), date=F.col("collected_at"))


def p1_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record's text without those lines that three different documents and two dates at least hold."""
    return boilerplate.remove_repeated_lines(table(spark, sf_dir, "syllabus"), date=F.col("collected_at"))


def p1_boilerplate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of three different documents and two dates at least, with their counts by site."""
    keyed = boilerplate.materialize(boilerplate.line_keys(table(spark, sf_dir, "syllabus"), "record_id", "site_id", "text", F.col("collected_at")))
    return boilerplate.excessive_lines(keyed, "site_id", min_clusters=3, min_dates=2)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record whose value is first in the stated order, by group and field; it leaves nothing to the votes of ``p2_posterior``."""
    return fusion.by_order(table(spark, sf_dir, "syllabus"), table(spark, sf_dir, "source_trust"), FUSED)


def p2_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value of largest posterior by the votes alone, by group and field."""
    return fusion.fuse(table(spark, sf_dir, "syllabus"), table(spark, sf_dir, "source_trust"), FUSED)


def p2_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per group, built of the surviving values."""
    syllabus = table(spark, sf_dir, "syllabus")
    return fusion.built(fusion.by_order(syllabus, table(spark, sf_dir, "source_trust"), FUSED), syllabus, FUSED)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields with a garbled stretch."""
    return encoding.repair_encoding(table(spark, sf_dir, "syllabus"), "record_id", ["text", "sources"]).select("record_id", "field_name")


def p4_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same fields with what could be restored."""
    return encoding.repair_encoding(table(spark, sf_dir, "syllabus"), "record_id", ["text", "sources"]).select("record_id", "field_name", "repaired", "lost")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with personal information, by type."""
    return pii.find_pii(table(spark, sf_dir, "syllabus"), "record_id", ["text"], ["syllabus_url"])


def p5_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text and URL with placeholders."""
    return pii.redact_pii(table(spark, sf_dir, "syllabus"), "record_id", ["text"], ["syllabus_url"])


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return tokenizing.encode_corpus(table(spark, sf_dir, "documents"))


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every document in the containers of each window."""
    sizes = tokenizing.encode_corpus(table(spark, sf_dir, "documents"), counts_only=True)
    return packing.pack_windows(sizes, table(spark, sf_dir, "context_windows"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents of the same look and different characters."""
    return lookalike.same_look_pairs(table(spark, sf_dir, "documents"))


def p8_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of equal look."""
    return lookalike.same_look_summary(table(spark, sf_dir, "documents"))


def p8_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one form."""
    return lookalike.canonical_text(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_clean, p1_boilerplate, p2_found, p2_posterior, p2_records, p4_found, p4_repaired, p5_found, p5_redacted, p6_ids, p7_packed, p8_found, p8_classes, p8_canonical)}

_KEYED = """
keyed AS (
  SELECT *, year || '-' || term || '-' || code || '-' || CASE WHEN ltrim(num, '0') = '' THEN '0' ELSE ltrim(num, '0') END AS course_key FROM (
    SELECT *, upper(regexp_replace(translate(course_code, '{wide}', '{narrow}'), '[\\s\\p{{Z}}]+', '', 'g')) AS code,
           regexp_extract(translate(class_no, '{wide}', '{narrow}'), '[0-9]+') AS num
    FROM syllabus)
  WHERE code <> '' AND num <> '' AND year IS NOT NULL AND term IS NOT NULL),
grouped AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY course_key) AS n FROM keyed) WHERE n >= 2),
named AS (
  SELECT g.record_id, g.course_key, g.collected_at, g.professor, g.completion_type, g.credit, g.schedule_summary, g.text,
         coalesce((SELECT max(t.trust) FROM source_trust t WHERE regexp_matches(' ' || regexp_replace(lower(g.sources), ':[^;|+,]*', ':', 'g') || ' ', '[^a-z0-9_]' || t.source_kind || '[^a-z0-9_]')), 0) AS trust
  FROM grouped g),
claimed AS (
  SELECT * FROM (UNPIVOT named ON professor, completion_type, credit, schedule_summary, text INTO NAME field_name VALUE v)
  WHERE lower(trim(v, ' ' || chr(9) || chr(10) || chr(13))) NOT IN ('', 'none', 'null', 'nan', 'n/a', 'no data', 'no data.')),
won AS (
  SELECT course_key, field_name, record_id, v FROM (
    SELECT *, row_number() OVER (PARTITION BY course_key, field_name ORDER BY trust DESC, collected_at DESC NULLS LAST, record_id) AS r FROM claimed)
  WHERE r = 1)
""".format(wide=fusion._WIDE, narrow=fusion._NARROW.replace("'", "''"))

SQL = {
    "p2_found": f"WITH {_KEYED} SELECT course_key, field_name, record_id FROM won",
    "p2_records": f"WITH {_KEYED} SELECT course_key, " + ", ".join(f"max(CASE WHEN field_name = '{f}' THEN v END) AS {f}" for f in FUSED) + " FROM won GROUP BY course_key",
}
