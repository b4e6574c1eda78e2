import json
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import dedup as D, quality as Q, retrieval as R, rules as R_, segment as S
from quarry.plans import quality as plans_quality, retrieval as plans_retrieval, text as plans_text


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


def test_text_columns(spark):
    assert one(spark, T.clean_text, " a \t b\r\n\r\n\r\n\r\nc ") == "a b\n\nc" and one(spark, T.clean_text, None) == ""
    assert one(spark, T.tokenize, "Ab 가나 c D-e. über") == ["ab", "가나", "d-e.", "ber"]
    assert one(spark, T.normalize_title, "자료구조 Ⅱ (A-1)") == "자료구조iia1"
    assert one(spark, T.course_codes, "abcd101 and ABCD101, XY999Z AB123") == ["ABCD101", "AB123"]
    assert one(spark, T.canonical_credit, "3.00") == "3" and one(spark, lambda c: T.zfill(c, 2), "123") == "123"
    assert one(spark, lambda c: T.excerpt(c, F.lit("needle"), 30), "x" * 50 + "needle" + "y" * 50).startswith("…xxxxxxxxxxneedle")
    assert one(spark, lambda c: T.best_sentence(c, F.array(F.lit("b"), F.lit("c"))), "a b. b c d! c b") == "b c d"


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "aa bb aa"), (2, "bb cc"), (3, None), (4, "dd")], "doc_id long, text string")
    q = spark.createDataFrame([("q", "aa bb zz")], "id string, text string")
    got = {r["doc_id"]: r["score"] for r in R.bm25(docs, R.query_terms(q, "id", "text")).collect()}
    avg, n = 6 / 4, 4
    idf = lambda d: np.log(1 + (n - d + 0.5) / (d + 0.5))
    w = lambda tf, dl: tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg))
    assert got == {1: round(idf(1) * w(2, 3) + idf(2) * w(1, 3), 6), 2: round(idf(2) * w(1, 2), 6)}


def test_cosine_blocks(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(90, 8)).round(3)
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(90, None), (91, [0.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["qid"], r["vec_id"]): r["cosine"] for r in R.cosine_top_k(df, df.where("vec_id < 7"), 5, block=16, query_block=3).collect()}
    u = v / np.linalg.norm(v, axis=1)[:, None]
    for q in range(7):
        s = (u @ u[q]).round(6)
        for i in sorted(range(90), key=lambda i: (-s[i], i))[:5]:
            assert abs(got[q, i] - s[i]) < 2e-6
    assert len(got) == 35


@pytest.mark.parametrize("size", ("sf0.01", "sf0.1"))
def test_recall_of_the_vector_index(spark, size):
    """Nine of ten true neighbours at least, for query vectors spread over the table."""
    v = spark.read.parquet(f"/root/testdata/{size}/embeddings.parquet")
    asked = v.where("vec_id % 20 = 0")
    found = R.cosine_top_k_indexed(v, asked, 10)
    want = {(r["qid"], r["vec_id"]) for r in R.cosine_top_k(v, asked, 10).collect()}
    got = {(r["qid"], r["vec_id"]) for r in found.collect()}
    print(f"{size}: recall {len(want & got) / len(want):.3f}")
    assert len(want & got) >= 0.9 * len(want)


def test_vector_index_of_odd_tables(spark):
    rows = [(i, [1.0, i / 100, 0.0]) for i in range(3000)] + [(3000, None), (3001, []), (3002, [0.0, 0.0, 0.0]), (3003, [0.0, 0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("list", F.lit(1))
    got = R.cosine_top_k_indexed(df, df.where("vec_id in (0, 3000, 3003)"), 3, lists=4, probes=4, block=100)
    exact = R.cosine_top_k(df, df.where("vec_id in (0, 3000, 3003)"), 3)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, exact.collect()))
    assert R.cosine_top_k_indexed(df.limit(0), df, 3).count() == 0 and R.cosine_top_k_indexed(df, df.limit(0), 3).count() == 0


def test_mmr(spark):
    rows = [("q", 1, 1.0, "a", ["x", "y"]), ("q", 2, 0.9, "b", ["x", "y"]), ("q", 3, 0.8, "c", ["z"]), ("q", 4, 0.7, "a", ["w"]), ("q", 5, 0.6, "a", ["v"])]
    df = spark.createDataFrame(rows, "qid string, doc_id long, score double, course_code string, tokens array<string>")
    assert [r["doc_id"] for r in R.mmr(df, 5, 2).orderBy("position").collect()] == [1, 3, 4, 2]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .\n|", max_size=400), st.integers(20, 90), st.integers(0, 15))
def test_windows_cover(text, size, overlap):
    out = S.windows(text, size, overlap)
    assert all(0 < b - a <= size and text[a:b] == text[a:b].strip() for a, b in out)
    seen = set().union(*(range(a, b) for a, b in out)) if out else set()
    assert all(text[i].isspace() for i in set(range(len(text))) - seen)


def test_windows_end_at_breaks():
    text = "x" * 300 + ". " + "y" * 300 + " | " + "z" * 290 + "\n" + "w" * 400
    assert S.windows(text, 700, 100) == [(0, 602), (503, 895), (796, 1296)]
    with pytest.raises(ValueError):
        S.windows("x", 10, 10)


def test_sections():
    """Tables of weeks and support notices keep the lines that name other sections, until something of their own ends them."""
    text = "\n".join(["과목명: 통계", "[page 1]", "free body", "교과목개요", "about", "주별 학습내용", "1주차 교재 읽기", "2주차 평가방법 안내", "장애학생 지원", "과제물 연장", "Week  Learning Contents", "3주차 Midterm", "[강의계획안 HTML]", "수업방법 강의", "\u25b7 평가방법", "시험   50%", "", "", "[첨부 강의계획서: a.pdf]", "분반: 01"])
    assert S.sections(text) == [
        ("기본정보", "과목명: 통계"), ("강의계획서본문", "[page 1]\nfree body"), ("교과목개요", "교과목개요\nabout"), ("주별학습내용", "주별 학습내용\n1주차 교재 읽기\n2주차 평가방법 안내"), ("지원및윤리", "장애학생 지원\n과제물 연장"),
        ("주별학습내용", "Week Learning Contents\n3주차 Midterm"), ("강의계획안HTML", "[강의계획안 HTML]"), ("수업운영", "수업방법 강의"), ("평가방법", "\u25b7 평가방법\n시험 50%"), ("기본정보", "[첨부 강의계획서: a.pdf]\n분반: 01"),
    ]
    assert S.sections("") == S.sections(" \n ") == []


def test_lines_passed_by_begin_no_section():
    """The words that a line is looked through for hold for every line of the tables that a rule finds."""
    import duckdb

    texts = [t for (t,) in duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/syllabus.parquet' WHERE text IS NOT NULL").fetchall()]
    words = ["강의계획서 URL: x", "Class Type", "Course Outline", "주별 학습내용", "주차별  강의계획", "Week | Period", "Weekly Learning Content", "Support for Disabled", "Student Learning Ethics", "주 기간 회차 a 학습내용", "[강의계획안 HTML]", "수업자료", "Study Objectives"]
    for line in {x.strip() for t in texts for x in t.split("\n")} | set(words):
        if any(p.search(line) for rules in S._AFTER.values() for _, p in rules):
            assert any(h in line.lower() for h in S._HINTS), line


def test_section_chunks_with_evidence(spark):
    """Chunks are whole in their evidence, which is bounded, and stand in their own section only."""
    long = "교과목개요\n" + "\n".join(f"line {i} of the overview, with words enough to need several windows." for i in range(120))
    df = spark.createDataFrame([(1, long + "\n평가방법\n시험 60%"), (1, "평가방법 없음"), (2, None), (3, ""), (4, " \n "), (5, "x" * 5000)], "record_id long, text string").selectExpr("*", "'y' AS section", "'z' AS parts")
    got = S.section_chunks(df, "record_id", "text").collect()
    bodies = dict(S.sections(long + "\n평가방법\n시험 60%"))
    mine = [r for r in got if r["record_id"] == 1 and r["chunk"] != "평가방법 없음"]
    assert [r["chunk_no"] for r in mine] == list(range(len(mine))) and len(mine) > 8
    for r in mine:
        assert r["chunk"] in r["evidence"] and r["evidence"] in bodies[r["section"]] and len(r["evidence"]) <= 2200
    assert mine[-1]["section"] == "평가방법" and mine[-1]["evidence"] == "평가방법\n시험 60%"
    assert [len(r["chunk"]) for r in got if r["record_id"] == 5] == [900] * 6 + [320] and {r["record_id"] for r in got} == {1, 5}
    again = S.section_chunks(df.where("record_id = 5"), "record_id", "text").where("chunk_no = 3").first()
    assert len(again["evidence"]) == 2200
    with pytest.raises(ValueError):
        S.section_chunks(df, "record_id", "text", size=3000)


def test_evidence_window(spark):
    at = lambda parent, child: spark.createDataFrame([(parent, child)], "p string, c string").select(S.evidence_window(F.col("p"), F.col("c"))).first()[0]
    w = at("p" * 3000 + "needle" + "q" * 3000, "needle")
    assert len(w) == 2200 and w.index("needle") == 1097
    assert at("other", "needle") == "needle" and at("needle at the front" + " x" * 2000, "needle").startswith("needle at") and at("a needle", "needle") == "a needle"
    assert at("x" * 4000, "x" * 2201) == "x" * 2201


def test_headed_chunks(spark):
    records = spark.createDataFrame([(i, f"AB{100 + i}", "01", "통계", None, "전공", "3", "3(3)", None, f"과목명: 통계 {i}\n평가방법\n시험 {i}%") for i in range(30)], "record_id long, course_code string, class_no string, course_name string, professor string, completion_type string, credit string, class_hours string, schedule_summary string, text string")
    got = S.headed_chunks(S.section_chunks(records, "record_id", "text"), records, "record_id").orderBy("record_id", "chunk_no").collect()
    assert [r["chunk_id"] for r in got] == [f"AB{100 + i // 2}_01_{i:04}" for i in range(60)]
    assert got[1]["document"] == "과목명: 통계\n학수번호: AB100\n분반: 01\n교수명: \n이수구분: 전공\n학점: 3\n학점/시수: 3(3)\n수업시간 및 강의실: 미정 또는 별도 운영\n문서 구역: 평가방법\n\n평가방법\n시험 0%"


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(4)
    base = [[f"w{rng.randrange(40)}" for _ in range(60)] for _ in range(8)]
    rows = []
    for i in range(160):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            w[rng.randrange(60)] = f"n{rng.randrange(500)}"
        rows.append((i, "hot" if i % 3 else "b", " ".join(w)))
    rows += [(900, "b", "short one"), (901, "b", "Short  one"), (902, "b", ""), (903, "b", None), (904, None, "short one")]
    df = spark.createDataFrame(rows, "id long, name string, text string").withColumn("s", F.lit("clash"))
    members, classes = D.near_duplicate_classes(df, "id", "text", F.coalesce("name", F.lit("")))
    links = {(r["a"], r["b"]) for r in D.near_duplicate_links(classes).collect()}
    sets, block, first = {}, {}, {}
    for i, n, t in rows:
        w = (t or "").lower().split()
        if w:
            s = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))
            first.setdefault((n, s), i)
            sets[first[n, s]], block[first[n, s]] = s, n
    want = {(a, b) for a in sets for b in sets if a < b and block[a] == block[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9}
    assert links == want and len(want) > 20
    assert {r["id"]: r["class"] for r in members.collect()} == {i: first[n, frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))] for i, n, t in rows if (w := (t or "").lower().split())} | {902: 902, 903: 902}
    kept, keeper = [], {}
    for c in sorted({*sets, 902}):  # texts without a word are a class that nothing is linked to
        better = [k for k in kept if (min(c, k), max(c, k)) in want]
        keeper[c] = better[0] if better else c
        kept += [] if better else [c]
    got = D.greedy_survivors(classes, D.near_duplicate_links(classes), classes.select("class", F.col("class").alias("rank")))
    assert {r["class"]: r["keeper"] for r in got.collect()} == keeper


def test_greedy_survivors_of_a_long_chain(spark):
    """A chain settles few classes a round; a class that several survivors are linked to goes to the best, however late that one is settled."""
    links = [(i, i + 1) for i in range(1, 64)] + [(100, 101), (101, 102), (102, 104), (103, 104)]
    near = {i: set() for i in [*range(1, 65), *range(100, 106)]}
    for a, b in links:
        near[a].add(b), near[b].add(a)
    kept, keeper = [], {}
    for c in sorted(near):
        keeper[c] = next((k for k in kept if k in near[c]), c)
        kept += [c] if keeper[c] == c else []
    classes = spark.createDataFrame([(c,) for c in near], "class long")
    rank = classes.select("class", F.col("class").alias("rank"))
    got = D.greedy_survivors(classes, spark.createDataFrame(links, "a long, b long"), rank).collect()
    assert len(got) == len(near) and {r["class"]: r["keeper"] for r in got} == keeper and keeper[64] == 63 and keeper[104] == 102
    none = spark.createDataFrame([], "a long, b long")
    assert {r["class"]: r["keeper"] for r in D.greedy_survivors(classes, none, rank).collect()} == {c: c for c in near}


def test_refresh(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "id string, content string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "id string, content string")
    assert {r["id"]: r["action"] for r in D.refresh_diff(old, new, "id", "content").collect()} == {"a": "keep", "b": "update", "c": "delete", "d": "insert"}


def test_percentile_and_urls(spark):
    df = spark.createDataFrame([("a", float(i % 7)) for i in range(41)], "k string, v double")
    assert Q.percentile_by_rank(df, ["k"], "v", 0.95).first()["percentile"] == sorted(i % 7 for i in range(41))[int(0.95 * 40)]
    for url, want in {"https://h.example/p?year=1&std_id=9&term=2#f": "https://h.example/p?year=1&term=2", "https://u:p@h.example/": None, "ftp://h/": None, "https://h.example": "https://h.example", "https://h.example/?x=1": "https://h.example/"}.items():
        assert one(spark, Q.safe_url, url) == want


def test_expansion_vocabulary():
    assert list(R_.SUFFIXES).index("에서는") < list(R_.SUFFIXES).index("는")


def test_percentile_of_a_large_group(spark):
    df = spark.range(250_000).selectExpr("'a' AS k", "CAST(pmod(xxhash64(id), 1000003) AS DOUBLE) AS v")
    got = Q.percentile_by_rank(df, ["k"], "v", 0.95).first()
    want = sorted(r["v"] for r in df.collect())[int(0.95 * 249_999)]
    assert got["n"] == 250_000 and got["percentile"] == want


def test_question_conditions(spark):
    from quarry.operators import catalog as C

    df = spark.createDataFrame([("금요일 3-5교시 수업",), ("2교시",), ("토 3부터 4교시, 월요일",), ("none",), (None,)], "q string")
    got = [tuple(r) for r in df.select(C.weekday(F.col("q")), *C.period_range(F.col("q"))).collect()]
    assert got == [("금", 3, 5), (None, 2, 2), ("월", 3, 4), (None, None, None), (None, None, None)]
    facts = spark.createDataFrame([("월", "3", "A"), ("월", "2", "B"), ("화", "3", "A"), (None, "3", "C")], "day string, credit string, course string")
    asked = spark.createDataFrame([("월", None), (None, "3"), ("화", "2"), ("월", "3"), ("월", "3")], "day string, credit string")
    got = sorted(map(str, map(tuple, C.conjunctive_matches(facts, asked, ["day", "credit"], "course").collect())))
    assert got == sorted(map(str, [("월", None, "A"), ("월", None, "B"), (None, "3", "A"), (None, "3", "C"), ("월", "3", "A")]))


def test_days_of_every_notation(spark, tmp_path):
    """Each course holds its meetings in another notation; one day of each isn't in the extracted records."""
    shown = {"월": "월요일 1-2교시 (09:00-10:50), 가온관 101", "금": "금요일 3교시 (11:00-11:50)", "토": "토요일 4교시"}
    objects = [{"class_no": "01", "day": d, "day_name": f"{d}요일", "display": v} for d, v in shown.items()]
    plain = json.dumps(objects, ensure_ascii=False)
    fields = {
        "array": plain, "ascii": json.dumps(objects), "literal": repr(objects),
        "nested": json.dumps(plain, ensure_ascii=False), "nested_ascii": json.dumps(json.dumps(objects)),
        "texts": json.dumps([*shown.values()], ensure_ascii=False), "row": ";".join(f'"{v}"' for v in shown.values()),
        "objects": ";".join(json.dumps(x, ensure_ascii=False) for x in objects), "cut": plain[: plain.index('"day_name": "토')], "cut_literal": repr(objects)[: repr(objects).index("'day_name': '토")],
    }
    courses = [(f"{n}101", f) for n, f in fields.items()] + [("none1", "null"), ("none2", "[]"), ("none3", None), (None, plain)]
    spark.createDataFrame(courses, "course_code string, schedule_entries_json string").write.parquet(f"{tmp_path}/courses.parquet")
    kept = [(f"{n}101", [(d,) for d in "월금"]) for n in fields]
    spark.createDataFrame(kept, "course_code string, schedule_entries array<struct<day: string>>").write.parquet(f"{tmp_path}/syllabus.parquet")
    got = {r["code"]: (r["n_days"], r["n_kept"], r["preserved"]) for r in plans_quality.set_preservation_whole(spark, str(tmp_path)).collect()}
    assert got == {f"{n}101".upper(): (3, 2, False) for n in fields}


def test_fused_lists_of_whole_texts(spark, tmp_path):
    """Documents that share only later lines with the query document are in its lists, with the scores of the whole text."""
    texts = {0: "aa bb\ncc dd cc\nee", 1: "cc xx", 2: "ee yy zz", 3: "aa", 4: "ww", 5: None}
    vectors = {0: [1.0, 0.0], 1: [0.0, 1.0], 4: [0.6, 0.8]}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    words = {i: (t or "").split() for i, t in texts.items()}
    avg = sum(map(len, words.values())) / len(words)
    df = lambda t: sum(t in w for w in words.values())
    part = lambda t, w: np.log(1 + (len(words) - df(t) + 0.5) / (df(t) + 0.5)) * w.count(t) * 2.5 / (w.count(t) + 1.5 * (0.25 + 0.75 * len(w) / avg))
    lexical = {i: round(sum(part(t, w) for t in words[0]), 6) for i, w in words.items() if set(w) & set(words[0])}
    cosine = {0: 1.0, 4: 0.6, 1: 0.0}
    place = lambda scores: {i: k + 1 for k, i in enumerate(sorted(scores, key=lambda i: (-scores[i], i)))}
    a, b = place(lexical), place(cosine)
    rrf = {i: (1 / (60 + a[i]) if i in a else 0) + (1 / (60 + b[i]) if i in b else 0) for i in a | b}
    evidence = {i: 0.55 * cosine.get(i, 0) + 0.3 * lexical.get(i, 0) / max(lexical.values()) + 0.15 * rrf[i] / max(rrf.values()) for i in rrf}
    got = {r["doc_id"]: r["rrf"] for r in plans_retrieval.rrf_fusion_whole(spark, str(tmp_path)).collect()}
    assert got == pytest.approx(rrf, abs=2e-6) and {1, 2} <= set(lexical)
    got = {r["doc_id"]: r["evidence"] for r in plans_retrieval.hybrid_evidence_rank_whole(spark, str(tmp_path)).collect()}
    assert got == pytest.approx(evidence, abs=2e-6)
    got = {r["doc_id"] for r in plans_retrieval.relevance_threshold_whole(spark, str(tmp_path)).collect()}
    assert got == {i for i, e in evidence.items() if e >= max(0.18, 0.42 * max(evidence.values()))}


def test_expansion_by_synonyms(spark, tmp_path):
    asked = ["Quiz 있나", "그룹은 활동 많아", "인코딩 방식", "바이브코딩 수업", "encoding table", "퀴즈와 attendance", "the course", None]
    quiz, team = {"퀴즈", "쪽지시험", "쪽지", "시험", "quiz", "퀴즈형"}, {"팀활동", "팀플", "협업", "그룹", "활동", "group", "project", "team"}
    rows = [(i, "user", t) for i, t in enumerate(asked)] + [(90, "assistant", "quiz")]
    spark.createDataFrame(rows, "log_id long, role string, text string").write.parquet(f"{tmp_path}/chat_turns.parquet")
    got = {}
    for r in plans_text.query_expansion_terms_whole(spark, str(tmp_path)).collect():
        got.setdefault(r["log_id"], []).append(r["term"])
    assert all(len(set(v)) == len(v) for v in got.values()) and set(got) == {0, 1, 2, 3, 4, 5, 6} and got[6] == ["the", "course"]
    assert set(got[0]) == quiz | {"있나"} and team | {"그룹은", "많아"} <= set(got[1])
    assert got[2] == ["인코딩", "방식"] and got[4] == ["encoding", "table"] and set(got[3]) == {"바이브코딩", "코딩", "프로그래밍", "개발", "구현", "코드", "coding", "programming"}
    assert set(got[5]) == quiz | {"퀴즈와", "출석", "attendance"} and len(R_.SYNONYMS) == 17
