"""Every query over the whole tables of the smallest size: columns as stated, no repeated rows."""

import pytest

from quarry.llm import registry
from quarry.plans import multivalue

DATA = "/root/testdata/sf0.001"
COLUMNS = {
    "p1_found": "record_id bigint, line_no int",
    "p2_found": "course_key string, field_name string, record_id bigint",
    "p3_found": "row_id bigint, field_name string, pos int, value string",
    "p4_found": "record_id bigint, field_name string",
    "p5_found": "record_id bigint, field_name string, line_no int, pii_type string",
    "p6_ids": "doc_id bigint, ids array<int>",
    "p8_found": "doc_id_a bigint, doc_id_b bigint",
}


@pytest.mark.parametrize("name", sorted(registry.QUERIES | multivalue.QUERIES))
def test_query(spark, name):
    df = (registry.QUERIES | multivalue.QUERIES)[name](spark, DATA)
    rows = df.collect()
    if name in COLUMNS:
        assert ", ".join(f"{c} {t}" for c, t in df.dtypes) == COLUMNS[name]
    assert len({repr(r) for r in rows}) == len(rows)
    assert rows or name in ("p1_found", "p1_boilerplate")


def test_no_row_is_dropped(spark):
    docs = {r["doc_id"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id").collect()}
    for name in ("p6_ids", "p7_packed", "p8_canonical"):
        assert {r["doc_id"] for r in registry.QUERIES[name](spark, DATA).select("doc_id").collect()} == docs
    records = spark.read.parquet(f"{DATA}/syllabus.parquet")
    assert registry.QUERIES["p1_clean"](spark, DATA).count() == records.count()
