from hypothesis import given, settings, strategies as st

from quarry.llm.pii import deobfuscate, find_in_line, find_in_url, find_pii, redact, redact_pii, scan_text

FOUND = {
    "문의: kim2015@byeol.test": {"email"},
    "E-mail: nuneul56＠hansol.example": {"email"},
    "chan (at) byeol (dot) test": {"email"},
    "bomgyeo39 [at] lab.ieum.invalid": {"email"},
    "이메일 riri65(골뱅이)stu.marun.example": {"email"},
    "kang2026 @ lab.ieum.invalid": {"email"},
    "조교 안별결 (ON_SAEM+TA@LAB.IEUM.INVALID)": {"email", "person_name"},
    "전화 010-1787-5860": {"phone"},
    "☎ 010.1435.7233": {"phone"},
    "급한 용무는 ０１０－１５５３－５９６１": {"phone"},
    "Tel. 공일공-영일삼일-칠팔일사": {"phone"},
    "Tel. +1 (202) 555-0140": {"phone"},
    "연락처: tel:0082 10 1733 7054": {"phone"},
    "전화 031)090-8853": {"phone"},
    "등록: 760715-2946056": {"id_number"},
    "확인용 식별번호 ７９０３１４－２２２３５１４": {"id_number"},
    "student no. : 2021760680": {"id_number"},
    "여권번호 M47573462": {"id_number"},
    "사번=K-97007": {"id_number"},
    "주소: (04063) 가람도 온빛시 달빛마루길 109": {"address"},
    "우편 제출: 하늘광역시 이음구 솔향기길 20번길 31": {"address"},
    "현장 실습지 새벽특별시 나래구 노을동 313-38번지": {"address"},
    "Mail your portfolio to 14 Eunmorae-ro, Onbit 00864": {"address"},
    "교수명: 유봄솔": {"person_name"},
    "Instructor: Bithan Cho": {"person_name"},
    "상담은 김누누(조교)에게 신청": {"person_name"},
    "임겨결 교수 면담 가능": {"person_name"},
    "Dr. Gyeolbit Jung reviews the drafts": {"person_name"},
    "수강 대표 Kwon, Hanram 820208-1037888": {"person_name", "id_number"},
    "김겨람 강사 자택 누리도 별빛군 별무리길 26 8층, 010-0609-2754": {"person_name", "address", "phone"},
}
NONE = ["", "데코레이터 @property 와 @dataclass", "튜터: 추후 공지", "학번:            이름:            (양식에 직접 기재)", "Contact hours: 674 per term; Prof. office hours by appointment", "문서번호 110-20322 양식을 사용", "참고 자료 ISBN 979-11-01023-456-7", "예산 202,000원 안에서 02-13 단원을 구현", "담당 교수와 면담 후 수강 가능", "조교에게 문의하기 전 공지 확인", "Week 8: Bayes inference - lecture transcripts", "강의실은 정보관 783호, 실습실은 공학관 3층", "게시일 2020.02.25 | 추천 7066", "베이즈 추론과 가우스 소거법", "Printed from the portal on 2025.06.13 at 14:34", "장애학생은 수업 전 지원센터와 교수 학습 지원을 협의할 수 있음", "데이터 크기 99727876행, 열 27개"]


def test_cases():
    for line, types in FOUND.items():
        assert {t for _, _, t in find_in_line(line)} == types, line
    for line in NONE:
        assert not find_in_line(line), line


def test_placeholders_leave_the_rest():
    line = "면담: 공일공-일삼오팔-육삼육사 또는 nu.kim [at] gaon-univ.example 까지"
    assert redact(line, find_in_line(line)) == "면담: [PHONE] 또는 [EMAIL] 까지"
    line = "급한​ 용무는 ０１０－１５５３－５９６１ (저녁)"
    assert redact(line, find_in_line(line)) == "급한​ 용무는 [PHONE] (저녁)"
    hits, out = scan_text("a\n교수명: 유봄솔\r\n\nkim@byeol.test, lee@byeol.test")
    assert hits == [(2, "person_name"), (4, "email"), (4, "email")] and out == "a\n교수명: [PERSON_NAME]\r\n\n[EMAIL], [EMAIL]"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="a1@＠．.공일​ 골뱅이(at)[dot]Аe\n-", max_size=60))
def test_offsets_cover_the_source(text):
    """Every rewritten character maps into the source, in order."""
    m = deobfuscate(text)
    last = 0
    for i in range(len(m.text)):
        b, e = m.source(i, i + 1)
        assert 0 <= b <= e <= len(text) and b >= last - 20
        last = b
    assert redact(text, find_in_line(text)) is not None


def test_urls():
    base = "https://a.example/plan?year=2020&term=1S&cour_cls=01"
    assert not find_in_url(base) and not find_in_url(base + "&std_id=&device=WW") and not find_in_url("")
    for part, kind in {"&mail=sol.kwon%40stu.test": "email", "#ga.cho@hansol.example": "email", "&staff_id=2024533469": "id_number", "&tel=010-0562-5634": "phone", "&prof=%EC%9C%A4%EA%B2%B0%EC%86%94": "person_name", "&prof=강샘봄": "person_name", "&addr=%ED%95%98%EB%8A%98%EC%8B%9C%2065": "address"}.items():
        spans = find_in_url(base + part)
        assert [t for _, _, t in spans] == [kind]
        assert redact(base + part, spans).startswith(base)


def test_operator(spark):
    rows = [(1, "교수명: 유봄솔\n전화 010-1787-5860\n전화 010-1787-5861, 010-1787-5862", "https://a.example/?sid=2019951904"), (2, None, None), (3, "", ""), (4, "x " * 50_000 + "kim@byeol.test", None)]
    df = spark.createDataFrame(rows, "record_id long, text string, syllabus_url string").selectExpr("*", "'x' AS hits", "'y' AS field_name")
    got = sorted(map(tuple, find_pii(df, "record_id", ["text"], ["syllabus_url"]).collect()))
    assert got == [(1, "syllabus_url", 1, "id_number"), (1, "text", 1, "person_name"), (1, "text", 2, "phone"), (1, "text", 3, "phone"), (4, "text", 1, "email")]
    assert redact_pii(df, "record_id", ["text"], ["syllabus_url"]).count() == 5
    assert find_pii(df.limit(0), "record_id", ["text"], []).count() == 0


def test_numbers_of_the_plan():
    """Every code of the plan, in one piece, written apart, and from abroad; numbers of other lengths or codes are none."""
    from quarry.llm.pii import AREA_CODES, MOBILE_CODES, find_in_line

    for code in (*AREA_CODES, *MOBILE_CODES, "70"):
        for line in (f"0{code}-123-4567", f"0{code} 1234 5678", f"0{code}12345678", f"(0{code}) 1234-5678", f"+82 {code} 1234 5678", f"+82-(0){code}-123-4567", f"0082{code}12345678"):
            assert [t for _, _, t in find_in_line(f"call {line}, please")] == ["phone"], line
            b, e, _ = find_in_line(f"call {line}, please")[0]
            assert f"call {line}, please"[b:e] == line
    for line in ("0101-2345-678", "029-1234-5678", "2024-03-11 10:30", "ISBN 978-89-1234-567-8", "010-12-345678", "1-010-1234-5678", "02-1234-5678-9"):
        assert "phone" not in [t for _, _, t in find_in_line(line)], line
    assert [t for _, _, t in find_in_line("(212) 555-0199 or +1 212 555 0199")] == ["phone", "phone"]


def test_resident_numbers():
    from quarry.llm.pii import find_in_line

    assert [t for _, _, t in find_in_line("990101-1234567 and 9901011234563")] == ["id_number", "id_number"]  # the second by its check digit
    for line in ("9901011234564", "991301-1234567", "990101-9234567", "x990101-1234567"):
        assert find_in_line(line) == [], line
