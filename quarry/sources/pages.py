"""Course lists in landed pages: JSON of any shape, calls of a script function, or table rows, whichever a page holds."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.arrow import arrow_type, slices
from ..functions.text import zfill
from .files import call_arguments, table_rows

#: What a course code looks like, and a key of an object that is about a course.
CODE = r"\b([A-Z]{2,}[A-Z0-9]*[0-9]{3,})\b"
ABOUT_COURSES = r"(?i)cour|course|haksu|subj|cls|bunban"
#: The fields of a course, its own key of the one system and what keys of others look like.
FIELDS = {"course_name": ("cour_nm", r"name|nm|kor|subject"), "professor": ("prof_nm", r"prof|교수|담당"), "completion_type": ("isu_nm", r"isu|이수"), "credit": ("credit", "^credit$"), "class_hours": ("time", "^time$"), "schedule_raw": ("time_room", r"time_room|시간.*강의실")}


def json_objects(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, object_no, fields``: every object in a JSON text at any depth, outer before inner, its plain fields as text by name in lower case.

    Texts that are no JSON, and nulls, give no row; null fields are empty; nested values are
    left to the rows of their objects; of names that differ in case the last one counts.
    """
    kind = df.schema[key].dataType.simpleString()
    target = pa.schema([(key, arrow_type(df, key)), ("object_no", pa.int32()), ("fields", pa.map_(pa.string(), pa.string()))])

    def objects(text: str) -> Iterator[dict]:
        try:
            left = [json.loads(text)]
        except (ValueError, RecursionError):
            return
        while left:
            x = left.pop()
            if isinstance(x, dict):
                yield x
            if isinstance(x, (dict, list)):
                left += reversed(list(x.values() if isinstance(x, dict) else x))

    plain = lambda v: "" if v is None else v if isinstance(v, str) else json.dumps(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = [(id_, n, list({k.lower(): plain(v) for k, v in x.items() if not isinstance(v, (dict, list))}.items())) for id_, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if t for n, x in enumerate(objects(t))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 3, target)], schema=target)

    return df.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, f"{key} {kind}, object_no int, fields map<string, string>")


def _value(pattern: str, of: str = ".+") -> Column:
    """The first field whose name and value match; null without one."""
    return F.get(F.filter(F.map_entries("fields"), lambda e: e["key"].rlike(f"(?i){pattern}") & F.trim(e["value"]).rlike(of)), F.lit(0))["value"]


def _from_json(pages: DataFrame, key: str, text: str) -> DataFrame:
    about = json_objects(pages, key, text).where(F.exists(F.map_keys("fields"), lambda k: k.rlike(ABOUT_COURSES)))
    own = F.coalesce(F.trim(F.col("fields")["cour_cd"]), F.lit("")) != ""
    anywhere = F.regexp_extract(F.array_join(F.map_values("fields"), " "), CODE, 1)
    given = F.nullif(F.trim(F.col("fields")["cour_cls"]), F.lit(""))
    packed = F.nullif(F.regexp_extract(F.coalesce(F.col("fields")["params"], F.lit("")), r"^[^@]*@(.*)$", 1), F.lit(""))
    class_no = F.when(own, F.coalesce(given, packed)).otherwise(F.trim(_value("cls|class|bunban|ban", r"^[0-9]{1,2}$")))
    rest = [F.coalesce(F.when(own, F.col("fields")[name]).otherwise(_value(pattern)), F.lit("")).alias(f) for f, (name, pattern) in FIELDS.items()]
    return about.select(key, F.col("object_no").alias("at"), F.when(own, F.trim(F.col("fields")["cour_cd"])).otherwise(anywhere).alias("code"), F.coalesce(class_no, F.lit("00")).alias("class_no"), *rest)


def _from_calls(pages: DataFrame, key: str, text: str, function: str) -> DataFrame:
    args = call_arguments(pages, key, text, function)
    code = F.get(F.filter("args", lambda a: a.rlike(r"^[A-Z]{2,}[A-Z0-9]*[0-9]{3,}$")), F.lit(0))
    class_no = F.element_at(F.filter("args", lambda a: a.rlike(r"^[0-9]{2}$")), -1)
    return args.where(F.exists("args", lambda a: a.rlike(r"^[0-9]{2}$"))).select(key, F.col("call_no").alias("at"), code.alias("code"), class_no.alias("class_no"), *[F.lit("").alias(f) for f in FIELDS])


def _from_rows(pages: DataFrame, key: str, text: str) -> DataFrame:
    rows = table_rows(pages, key, text).withColumn("cells", F.filter("cells", lambda c: c != "")).withColumn("row", F.array_join("cells", " "))
    rows = rows.withColumn("code", F.regexp_extract("row", CODE, 1)).where("code <> ''")
    class_no = F.coalesce(F.nullif(F.regexp_extract("row", r"\b([0-9]{2})\b", 1), F.lit("")), F.lit("00"))
    at = F.array_position(F.transform("cells", lambda c: F.contains(c, F.col("code"))), True).cast("int")
    after = F.filter(F.slice("cells", at + 1, F.size("cells")), lambda c: ~c.rlike(r"^[0-9\s:~(),.-]+$") & ~F.contains(c, F.col("code")))
    known = {"course_name": F.get(after, F.lit(0)), "professor": F.get(F.filter("cells", lambda c: c.rlike("교수|강사|담당")), F.lit(0))}
    return rows.select(key, F.col("row_no").alias("at"), "code", class_no.alias("class_no"), *[F.coalesce(known.get(f, F.lit("")), F.lit("")).alias(f) for f in FIELDS])


def page_courses(pages: DataFrame, key: str, text: str, function: str = "fnPlanView") -> DataFrame:
    """``key, form, code, class_no, course_name, ...``: the courses of a page, read as JSON, else off script calls, else off table rows.

    Each code and class once, as its first place says; classes have two digits at least.
    Pages that hold no course in any form, and null ones, give no row.
    """
    forms = {"json": _from_json(pages, key, text), "calls": _from_calls(pages, key, text, function), "rows": _from_rows(pages, key, text)}
    every = reduce(DataFrame.unionByName, [df.where("code <> ''").withColumn("form", F.lit(name)).withColumn("order", F.lit(n)) for n, (name, df) in enumerate(forms.items())])
    every = every.withColumn("class_no", zfill(F.trim("class_no"), 2)).withColumn("code", F.trim("code"))
    rest = F.struct(*[F.trim(f).alias(f) for f in FIELDS])
    first = every.groupBy(key, "order", "form", "code", "class_no").agg(F.min_by(rest, "at").alias("c"))
    best = every.groupBy(key).agg(F.min("order").alias("order"))
    return first.join(best, [key, "order"], "left_semi").select(key, "form", "code", "class_no", "c.*")
