from pyspark.sql import functions as F

from quarry.operators import redaction as Q

PAGE = "h.example.ac/view.jsp"


def test_urls(spark):
    good = f"https://{PAGE}?year=2031&term=1R&cour_cd=AB101&cour_cls=01"
    cases = {
        good: good, good + "&std_id=9#top": good, f"https://{PAGE}?year=2031": "", f"https://{PAGE}": "", "HTTPS://other.example/a": "https://other.example/a", "https://other.example/a?x=1": "", "https://other.example/a#b": "https://other.example/a", "http://u:p@other.example/": "",
        "http://localhost/": "", "http://nodot/": "", "http://10.1.2.3/": "", "http://172.20.0.1/x": "", "http://8.8.8.8/x": "http://8.8.8.8/x", "http://[::1]/": "", "ftp://other.example/": "", "javascript:alert(1)": "", "": "", None: "", "https://other.example:8443/a": "https://other.example:8443/a",
    }
    df = spark.createDataFrame([(u,) for u in cases], "u string").select("u", Q.checked_url(F.col("u"), PAGE).alias("c"))
    got = {r["u"]: r["c"] for r in df.collect()}
    assert {u: c["url"] for u, c in got.items()} == cases
    assert tuple(got[good + "&std_id=9#top"])[1:] == (0, 1, 1) and tuple(got["https://other.example/a?x=1"])[1:] == (1, 1, 0) and got[""]["unsafe"] == got[None]["unsafe"] == 0


TEXT = "\n".join(["mail A.b+c@dept.example.ac.kr or mailto:x@y.zz  ", "tel:02-1234-5678, +82 10 1234 5678 (031) 123 4567 but 2024-12-01 and 12345", "학번: 2031-0001 std_id=abcd 990101-1234567", r"C:\Users\me\a.txt", "/home/me/b.pdf|cell", "see https://other.example/a?x=1, or https://other.example/b.", "氠瑢漠杳", "", "", "", "전공필수 3학점"])


def test_text(spark):
    out = spark.createDataFrame([(TEXT,), (None,), ("",)], "t string").select(Q.redacted(F.col("t")).alias("r")).collect()
    r = out[0]["r"]
    assert r["text"] == "\n".join(["mail [email removed] or [email removed]", "[phone removed], [phone removed] [phone removed] but 2024-12-01 and 12345", "학번: [id removed] std_id=[id removed] [id removed]", "[path removed]", "[path removed]|cell", "see [address removed], or https://other.example/b.", "", "전공필수 3학점"])
    assert {c: r[c] for c in Q.COUNTERS} == {"local_paths": 2, "urls": 2, "emails": 2, "phones": 3, "resident_ids": 1, "labelled_ids": 2, "marks": 2, "unsafe_urls": 1, "url_parameters": 1, "url_fragments": 0}
    assert out[1]["r"]["text"] is None and out[2]["r"]["text"] == ""


def test_nested_values_and_what_is_left(spark):
    df = spark.createDataFrame([(1, TEXT, [("a@b.cc", 3, ["010-1234-5678", None])], 5), (2, None, None, None), (3, "plain", [], 1)], "id long, text string, parts array<struct<x: string, n: int, more: array<string>>>, n int")
    got = {r["id"]: r for r in Q.redact_table(df, ["text", "parts"]).collect()}
    assert got[1]["parts"][0].asDict() == {"x": "[email removed]", "n": 3, "more": ["[phone removed]", None]} and got[2]["parts"] is None and got[3]["parts"] == [] and got[1]["n"] == 5
    left = {r["counter"]: (r["n_checked"], r["n_left"]) for r in Q.residuals(df, "id", "text").collect()}
    assert left == {n: (2, 0) for n, _, _ in Q.RULES}
    once = Q.redact_table(df, ["text"])
    assert Q.redact_table(once, ["text"]).exceptAll(once).count() == 0  # redacting again changes nothing
    assert Q.residuals(df.limit(0), "id", "text").where("n_left = 0").count() == len(Q.RULES)


def test_secrets(spark):
    df = spark.createDataFrame([(1, "key AIza" + "a" * 35), (2, "-----BEGIN RSA PRIVATE KEY-----"), (3, "AIza short"), (4, None)], "id long, t string")
    assert sorted(map(tuple, Q.secrets(df, "id", "t").collect())) == [(1, "service_key"), (2, "private_key")]
