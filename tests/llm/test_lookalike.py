import re
import unicodedata
from collections import defaultdict

from quarry.llm.lookalike import TO_LATIN, canonical_text, fold, same_look_pairs, same_look_summary, suspects

SKELETON = {ord(k): v for k, v in TO_LATIN.items()}


def brute(rows):
    by = defaultdict(list)
    for i, t in rows:
        if t is not None and (f := fold(t)) and not f.isspace():
            by[f.translate(SKELETON)].append((i, t))
    return sorted({(min(a, b), max(a, b)) for v in by.values() for k, (a, x) in enumerate(v) for b, y in v[k + 1 :] if x != y and a != b})


def test_fold():
    same = [("ＡＢ１：", "AB1:"), ("a\xa0b　c", "a b c"), ("z​e\xadro", "zero"), ("café", "café"), ("한", "한"), ("ﬁne", "fine"), ("Ⅲ", "III"), ("Ω Å", "Ω Å"), ("a‐b‑c", "a-b-c"), ("가ㆍ나・다‧라", "가·나·다·라"), ("論", "論"), ("ｶﾞ", "ガ")]
    for a, b in same:
        assert fold(a) == b
    for a, b in [("A", "a"), ("é", "e"), ("m²", "m2"), ("①", "1"), ("a.", "a,"), ("a\n", "a\r\n"), ("a  b", "a b"), ("–", "-")]:
        assert fold(a) != fold(b)


def test_scripts_of_tokens():
    assert suspects("LIВX101 и другие")["LIВX101"] == "LIBX101"  # Latin with a Cyrillic letter
    assert suspects("каpтy города") == {"каpтy": "карту"}  # Cyrillic with Latin letters
    assert suspects("Вo время")["Вo"] == "Во"  # look-alikes only: the script of the text
    assert suspects("LIBX101 СССР в обзоре").keys() == {"LIBX101"} - {"LIBX101"}  # real words stay
    assert suspects("soil taxonοmy") == {"taxonοmy": "taxonomy"} and suspects("plain ASCII") == {} and suspects("α β γ") == {}


def rows():
    a, ru = "Course: Soil taxonomy PBL (SMGD424)\n15주차: é m² ①", "Во время практики участники описывают карту."
    out = [(1, a), (2, a.replace("PBL", "РВL")), (3, a.replace(" ", " ", 1)), (4, a.replace("é", "é")), (5, a), (6, a.replace("é", "e")), (7, a.replace("²", "2")), (8, a.lower())]
    out += [(10, ru), (11, ru.replace("карту", "каpту").replace("Во", "Bo")), (12, ru.replace("о", "o")), (13, ru + " "), (14, None), (15, ""), (16, "​ 　"), (17, "​\xa0"), (18, "Ｘ" * 3000), (19, "X" * 3000)]
    return out


def test_pairs_against_brute_force(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string").selectExpr("*", "'x' AS canon", "'y' AS stored")
    got = sorted(map(tuple, same_look_pairs(df).collect()))
    assert got == brute(rows())
    assert {(1, 2), (1, 3), (2, 5), (10, 11), (10, 12), (18, 19)} <= set(got) and not {(1, 5), (1, 6), (1, 7), (1, 8), (10, 13), (16, 17)} & set(got)
    assert same_look_pairs(df.limit(0)).count() == 0


def test_classes_agree_with_pairs(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string")
    got = {r["doc_id"]: r for r in same_look_summary(df).collect()}
    assert set(got) == {i for i, t in rows() if t and not fold(t).isspace() and fold(t)}
    assert got[1]["n_forms"] == 4 and got[1]["n_rows"] == 5 and got[5]["class"] == 1 and got[12]["class"] == 10
    for a, b in brute(rows()):
        assert got[a]["class"] == got[b]["class"]


def test_repair_needs_the_corpus(spark):
    df = spark.createDataFrame([(1, "the PBL course"), (2, "the РВL course"), (3, "the ХYZQ course"), (4, None), (5, " ")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in canonical_text(df).collect()}
    assert got == {1: "the PBL course", 2: "the PBL course", 3: "the ХYZQ course", 4: None, 5: " "}


def test_accented_look_alikes(spark):
    """Look-alikes that carry accents, composed or not, against a skeleton of decomposed letters that knows nothing of folding."""
    words = ["naïve résumé café", "tres párrafos del año", "Noël à Ásópé", "всё её", "όταν"]
    swaps = [("e\u0301", "е\u0301"), ("a\u0301", "а\u0301"), ("i\u0308", "ї"), ("o\u0301", "ο\u0301"), ("o\u0301", "ό"), ("e\u0308", "ё"), ("A\u0301", "А\u0301"), ("a\u0300", "а\u0300"), ("ё", "ë"), ("ό", "ó"), ("ό", "о\u0301")]
    texts = [*words]
    for w in words:
        for a, b in swaps:
            for x in (w, unicodedata.normalize("NFD", w)):
                texts += [x.replace(a, b), x.replace(unicodedata.normalize("NFC", a), b)]
    texts += ["naive resume cafe", "naïve résume café", "tres pàrrafos del año"]
    data = list(enumerate(dict.fromkeys(texts)))
    look = lambda t: unicodedata.normalize("NFD", t).translate(SKELETON)
    want = sorted((i, k) for i, x in data for k, y in data if i < k and look(x) == look(y))
    got = sorted(map(tuple, same_look_pairs(spark.createDataFrame(data, "doc_id long, text string")).collect()))
    assert got == want and len(want) > 60
    assert suspects("саfе\u0301") == {"саfе\u0301": "café"} and "ещё" not in suspects("ещё раз")


def test_copies_of_one_form_never_meet(spark):
    """Rows are joined by their form, never by their class alone: N copies and one variant are N candidates, not N * N."""
    n = 3000
    df = spark.range(n + 1).selectExpr("id AS doc_id", "IF(id = 7, 'the РВL course', 'the PBL course') AS text")
    found = same_look_pairs(df)
    assert sorted(map(tuple, found.collect())) == sorted((min(7, i), max(7, i)) for i in range(n + 1) if i != 7)
    joins = re.findall(r"Join \[canon#\d+\], \[canon#\d+\], Inner.*", found._jdf.queryExecution().executedPlan().toString())
    assert joins and not [x for x in joins if re.search(r"key_[ab]|doc_id", x)]


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert sorted(map(tuple, same_look_pairs(df).collect())) == brute([tuple(r) for r in df.select("doc_id", "text").collect()])
