import json
import time

import pytest
from hypothesis import given, settings, strategies as st

from quarry.operators.multivalue import displays, meetings, split_packed, tokenize

ROOMS = ["", " 가온관 101", ' 가온관 "대강당"', " 하늘관 160/161", " 정보관 B-6·C-3", " 이음관(동편) 3", " 마루관 110, 111"]
HEADS = ["월(1-2)", "화 (3)", "수요일 5-6교시", "목7", "금(7~9)"]
DELIMS = ["|", " / ", "//", ";", "；", "、", "\n", "\t", "<br>", "<br/>", " & ", " + ", ", "]


def quoted(v, mark):
    if mark == '"':
        return '"' + v.replace('"', '""') + '"'
    return {"“": f"“{v}”", "'": f"'{v}'", "": v}[mark]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(HEADS), st.sampled_from(ROOMS), st.sampled_from(["", '"', "“", "'"])), min_size=1, max_size=5), st.data())
def test_round_trip(parts, data):
    """Values packed with any delimiter and quoting come out as they went in."""
    values = [h + r for h, r, _ in parts]
    text = ""
    for v, (_, _, mark) in zip(values, parts):
        text += (data.draw(st.sampled_from(DELIMS)) if text else "") + quoted(v, mark)
    assert tokenize(text) == values


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(HEADS), st.sampled_from(ROOMS)), min_size=1, max_size=4), st.sampled_from(["array", "string", "literal", "row", "texts"]))
def test_json_notations(parts, how):
    values = [h + r for h, r in parts]
    objects = [{"class_no": "01", "display": v} for v in values]
    text = {
        "array": json.dumps(objects),
        "string": json.dumps(json.dumps(objects, ensure_ascii=False), ensure_ascii=False),
        "literal": repr(objects),
        "row": ";".join(json.dumps(o, ensure_ascii=False) for o in objects),
        "texts": json.dumps(values, ensure_ascii=False),
    }[how]
    assert displays(text) == values


def test_edges():
    assert tokenize("") == [] and meetings("null", True) == () and meetings("시간 미지정", False) == ()
    assert tokenize("월(1-2) | | 화(3);") == ["월(1-2)", "화(3)"]
    assert displays('[{"display": "월요일 1교시"}, {"display": "화') == ["월요일 1교시"]
    assert len(meetings("|".join(["월(1-2) 가온관 1"] * 20000), False)) == 20000


def test_doubled_marks_in_a_row_of_texts():
    """Quotation marks inside quoted values, doubled, come out single and not as two texts set together."""
    values = ["토요일 5-6교시 (13:00-14:50), 이음관 107", '금요일 5-7교시 (13:00-15:50), 이음관 "대강당"', "수요일 2교시"]
    assert displays(",".join(quoted(v, '"') for v in values)) == values
    assert displays(quoted(json.dumps([{"display": v} for v in values], ensure_ascii=False), '"')) == values


@pytest.mark.parametrize("unit", ["“월1 ”x, ", '"월1, ', "“월(1-2) 가온관 ", "'월1 x''y ", '"월1 "x | ', "월1 |||||||", "“월1|", '\\"월1,"" '])
def test_time_is_linear(unit):
    """Quotation marks that never close, and runs of delimiters, are walked once."""

    def took(times):
        best = []
        for _ in range(3):
            began = time.perf_counter()
            tokenize("“" + unit * times)
            tokenize(unit * times + "|" * 10 * times + "x")
            best.append(time.perf_counter() - began)
        return min(best)

    small, large = took(1_000), took(8_000)
    assert large < 24 * small + 0.1, (small, large)


def test_operator(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "월1|화2", "x"), (3, "월1|화2", "x"), (4, "월1", "x")]
    df = spark.createDataFrame(rows, "row_id long, schedule_raw string, value string")
    got = split_packed(df, "row_id", {"schedule_raw": False}).collect()
    assert sorted(map(tuple, got)) == sorted([(3, "schedule_raw", 1, "월1"), (3, "schedule_raw", 2, "화2")] * 2)
    assert split_packed(df.limit(0), "row_id", {"schedule_raw": False}).count() == 0


def test_found_has_the_stated_columns(spark):
    from quarry.plans.multivalue import QUERIES

    df = QUERIES["p3_found"](spark, "/root/testdata/sf0.001")
    assert ", ".join(f"{c} {t}" for c, t in df.dtypes) == "row_id bigint, field_name string, pos int, value string"
    rows = [tuple(r) for r in df.collect()]
    assert len(set(rows)) == len(rows) > 0
