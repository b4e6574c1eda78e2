from hypothesis import given, settings, strategies as st

from quarry.llm.encoding import _WESTERN, repair_encoding, repair_line, repair_text

SENTENCES = ["강의개요 자료를 단계별로 고쳐 쓴다.", "평가방법: 기말고사 40%, 발표 20%", "3주차: 영상 분할 코드 점검", "한글 문장과 English words", "팀 과제 10%"]
PLAIN = SENTENCES + ["São Paulo 자료와 naïve 모형을 비교 (567)", "Ångström 단위로 환산", "온도는 25°C ± 0.5, § 28 참조", "論語와 孟子의 원문", "Año académico, niñez y educação", "El Niño y la señal: über 3 Å", "Привет, мир", "数理と論理の授業", "① m² · ▷ … “quoted” — 5€", "Ωmega αβγ", "", "\t", "두 번째 짠 음식 체크"]


def west(data: bytes) -> str:
    back = {}
    for c, b in _WESTERN.items():
        back[b] = c  # cp1252 where it has a character, C1 controls elsewhere
    return "".join(chr(b) if b < 0x80 else back[b] for b in data)


def test_plain_text_is_left_alone():
    for x in PLAIN:
        assert repair_text(x) == (x, False, False), x
    assert repair_text("\n".join(PLAIN))[1] is False


@settings(max_examples=200, deadline=None)
@given(st.sampled_from(SENTENCES[:4]), st.sampled_from(["west", "latin", "mac", "twice", "thrice", "korean"]))
def test_round_trip(text, how):
    data = text.encode("utf-8")
    bad = {"west": lambda: west(data), "latin": lambda: data.decode("latin-1"), "mac": lambda: data.decode("mac_roman"), "twice": lambda: west(west(data).encode()), "thrice": lambda: west(west(west(data).encode()).encode()), "korean": lambda: west(text.encode("cp949"))}[how]()
    assert repair_line(bad) == (text, True)
    assert repair_text(f"plain\n{bad}\nplain") == (f"plain\n{text}\nplain", True, False)


def test_stretches():
    assert repair_line("See SeÃ±or case") == ("See Señor case", True)
    assert repair_line("weeks 3â€“5") == ("weeks 3–5", True)
    assert repair_line("See na√Øve guesses") == ("See naïve guesses", True)
    assert repair_line("동료 평가 湡档牯 30%") == ("동료 평가 anchor 30%", True)
    assert repair_line("현장 활동 30%, Ãâ¼® 20%") == ("현장 활동 30%, 출석 20%", True)
    assert repair_line("신호 ó�� ����")[1] and repair_text("잃은 � 글자")[1:] == (True, True)


def test_operator(spark):
    bad = west("강의개요".encode())
    rows = [(1, bad, "pdf"), (2, None, None), (3, "", bad), (4, "São", "html"), (5, "x" * 200_000 + bad, "y"), (5, "x" * 200_000 + bad, "y")]
    df = spark.createDataFrame(rows, "record_id long, text string, sources string").selectExpr("*", "1 AS lost")
    got = repair_encoding(df, "record_id", ["text", "sources"]).collect()
    assert sorted((r["record_id"], r["field_name"]) for r in got) == [(1, "text"), (3, "sources"), (5, "text"), (5, "text")]
    assert all(r["repaired"].endswith("강의개요") and not r["lost"] for r in got)
    assert repair_encoding(df, "record_id", ["text"], only_cases=False).count() == 6
    assert repair_encoding(df.limit(0), "record_id", ["text"]).count() == 0
