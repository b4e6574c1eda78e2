import json

from quarry.sources.pages import json_objects, page_courses


def pages(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "page long, body string").selectExpr("*", "'x' AS form", "1 AS object_no")


def test_courses_of_pages(spark):
    own = {"list": [{"cour_cd": "AB101", "cour_cls": "1", "cour_nm": "통계", "prof_nm": "김", "time_room": "월(1-2)", "credit": 3}, {"COUR_CD": "AB101", "cour_cls": "01"}, {"cour_cd": "CD202", "params": "x@03"}, {"other": 1}]}
    loose = [{"subjNo": "EF303-1", "bunban": "7", "korName": "확률", "담당교수": None, "profName": "이", "deep": {"courseTitle": "GH404", "classTitle": "KL606"}, "else": {"classTitle": "KL606"}}]
    calls = "<a onclick=\"fnPlanView('2031','AB101','통계','02')\">x</a><a onclick=\"fnPlanView('AB101', '02')\"> <tr><td>ZZ999</td></tr>"
    rows = "<table><tr><th>코드</th></tr><tr><td>01</td><td>IJ505</td><td>3(3)</td><td>실험 <b>A</b></td><td>박 교수</td></tr></table>"
    got = {}
    for r in page_courses(pages(spark, [json.dumps(own), json.dumps(loose, ensure_ascii=False), calls, rows, "nothing", None, "[1, \"AB101\"]"]), "page", "body").collect():
        got.setdefault(r["page"], []).append((r["form"], r["code"], r["class_no"], r["course_name"], r["professor"], r["credit"], r["schedule_raw"]))
    assert sorted(got.pop(0)) == [("json", "AB101", "01", "통계", "김", "3", "월(1-2)"), ("json", "CD202", "03", "", "", "", "")]
    assert sorted(got.pop(1)) == [("json", "EF303", "07", "확률", "이", "", ""), ("json", "GH404", "00", "", "", "", "")]
    assert got == {2: [("calls", "AB101", "02", "", "", "", "")], 3: [("rows", "IJ505", "01", "실험 A", "박 교수", "", "")]}


def test_objects(spark):
    deep = '{"a": {"b": [{"C": null, "d": true}]}, "e": "x"}'
    got = [(r["page"], r["object_no"], r["fields"]) for r in json_objects(pages(spark, [deep, "no json", None, "[]", '"text"']), "page", "body").orderBy("page", "object_no").collect()]
    assert got == [(0, 0, {"e": "x"}), (0, 1, {}), (0, 2, {"c": "", "d": "true"})]
