"""Readers and writers of document collections: JSON lines, CSV lists, extraction reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

ENTRY = T.StructType([T.StructField(c, T.IntegerType() if c.endswith("_period") else T.StringType()) for c in ("class_no", "day", "day_name", "start_period", "end_period", "periods", "start_time", "end_time", "room", "display")])
SCALARS = ("course_code", "class_no", "course_name", "professor", "completion_type", "credit", "class_hours", "schedule_summary", "syllabus_url", "text_path", "sources", "text")
#: Completion types that a text may name after its label.
COMPLETION = "전공필수|전공선택|교양필수|교양선택|일반선택"


def entries(json: Column) -> Column:
    """Schedule entries of a JSON array text.  Bad JSON gives none; elements that are no objects are left out (one of them would make a typed parse null the whole array)."""
    items = F.coalesce(F.from_json(json, "array<string>"), F.array().cast("array<string>"))
    return F.transform(F.filter(items, lambda e: e.rlike(r"^\s*\{")), lambda e: F.from_json(e, ENTRY))


def completion_type(text: Column) -> Column:
    """The first completion type named after its label in a text; empty without one."""
    return F.regexp_extract(F.coalesce(text, F.lit("")), rf"이수\s*구분\s*[:：|]?\s*({COMPLETION})", 1)


def read_collection(spark: SparkSession, path: str) -> DataFrame:
    """Course documents of JSON lines.

    Numbers and other scalars become text, missing keys and nulls the empty text, unknown
    keys and blank lines are passed over, and a missing completion type is read off the text.
    """
    raw = spark.read.schema(T.StructType([T.StructField(c, T.StringType()) for c in (*SCALARS, "schedule_entries")])).json(path)
    filled = raw.select(*[F.coalesce(c, F.lit("")).alias(c) for c in SCALARS], entries(F.coalesce("schedule_entries", F.lit("[]"))).alias("schedule_entries"))
    return filled.withColumn("completion_type", F.when(F.col("completion_type") == "", completion_type(F.col("text"))).otherwise(F.col("completion_type")))


def strict(df: DataFrame, required: tuple[str, ...] = ("course_code", "text")) -> DataFrame:
    """Fails on a collection without a row, and, when run, on a row without one of the required fields."""
    if df.isEmpty():
        raise ValueError("the collection holds no row")
    for c in required:
        ok = F.col(c).isNotNull() & (F.trim(c) != "")
        df = df.withColumn(c, F.when(ok, F.col(c)).otherwise(F.raise_error(F.lit(f"a row without {c}"))))
    return df


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """A course list of CSV with a header, all text, quotes doubled inside quotes; a byte-order mark is no part of the first name."""
    return spark.read.options(header=True, multiLine=True, escape='"').csv(path)


def write_collection(df: DataFrame, path: str) -> None:
    """One JSON object per line; nulls are left out by the reader's rule that a missing key is empty."""
    df.write.mode("overwrite").json(path)


def write_list(df: DataFrame, path: str, columns: list[str]) -> None:
    """CSV with a header and a fixed order of columns; nested columns as JSON text."""
    nested = (T.ArrayType, T.StructType, T.MapType)
    cols = [(F.to_json(c) if isinstance(df.schema[c].dataType, nested) else F.col(c)).alias(c) for c in columns]
    df.select(*cols).write.mode("overwrite").options(header=True, escape='"').csv(path)


def write_snapshot(df: DataFrame, path: str, key: str) -> None:
    """A deterministic snapshot: rows in order of ``key``, range-partitioned so that no task holds them all."""
    df.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").json(path)


def write_reports(reports: dict[str, DataFrame], path: str) -> DataFrame:
    """Each report as a CSV list under its name, and ``report, n_rows`` of all as the manifest, which is written last and returned.

    Arrays of plain values are joined by commas, other nested columns are JSON text.
    """
    spark = next(iter(reports.values())).sparkSession
    counts = []
    for name, df in reports.items():
        plain = [F.array_join(F.col(f.name).cast("array<string>"), ",").alias(f.name) if isinstance(f.dataType, T.ArrayType) and not isinstance(f.dataType.elementType, (T.StructType, T.ArrayType, T.MapType)) else F.col(f.name) for f in df.schema.fields]
        write_list(df.select(*plain), f"{path}/{name}", df.columns)
        counts.append((name, read_list(spark, f"{path}/{name}").count()))
    manifest = spark.createDataFrame(counts, "report string, n_rows long")
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return manifest
