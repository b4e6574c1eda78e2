import pytest
from hypothesis import given, settings, strategies as st

from quarry.llm.tokenizing import VOCABULARY, _codes, _encode, chunk_table, chunked, cuts, encode_corpus, packed, units, unpacked


@pytest.fixture(scope="module")
def encode():
    return _encode(VOCABULARY)


def exact(encode, text, mean=8):
    pieces = units(text, mean)
    assert "".join(pieces) == text
    assert [i for p in pieces for i in encode(p)] == encode(text)


@settings(max_examples=800, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab's ll'tre \n\t\x1c\x85 가나한.,1２é́<|endoftext|>😀ﷺ漢'"), max_size=400))
def test_exact(encode, text):
    exact(encode, text)
    exact(encode, text * 3, 3)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=300))
def test_any_text(encode, text):
    exact(encode, text.encode("utf-8", "ignore").decode(), 4)


def test_cuts_depend_on_content():
    body = "".join(chr(97 + i * i % 26) + " word" * (i % 3) for i in range(500))
    a, b = cuts(_codes(body), 16).tolist(), cuts(_codes("something before. " + body), 16).tolist()
    assert len(a) > 10 and {x + 18 for x in a} <= set(b)
    assert len(set(units(body, 16)) & set(units("something before. " + body, 16))) > 10


def test_no_boundary_and_long(encode):
    for text in ("가" * 50_000, "ab" * 30_000 + " x", " " * 20_000 + "y", "\n" * 999, "漢字" * 3_000):
        exact(encode, text)


def test_joins_are_repaired(encode):
    """Cuts inside pre-tokens alone would give other ids."""
    text = "internationalization of responsibilities, characteristically uncomfortable " * 20
    at = [0, *cuts(_codes(text), 8).tolist(), len(text)]
    assert [i for a, b in zip(at, at[1:]) for i in encode(text[a:b])] != encode(text)
    exact(encode, text)


def test_every_chunk_is_encoded_once(spark):
    shared = "this passage, which many documents hold, is long enough to be cut into several chunks of its own; " * 3
    df = spark.createDataFrame([(i, f"head {i} " + shared + f" tail {i % 7}") for i in range(200)], "doc_id long, text string")
    cut = chunked(df, mean=16)
    pieces = [u for r in cut.collect() for u in r["units"]]
    table = chunk_table(cut).collect()
    assert len(table) == len({(r["h1"], r["h2"]) for r in table}) == len(set(pieces)) < len(pieces) / 5


def test_operator(spark, encode):
    rows = [(1, "교수명: 유봄솔 teaches <|endoftext|>"), (2, None), (3, ""), (4, " "), (1, "again"), (1, "again"), (5, "긴 글 " * 30_000), (None, "x y")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS units", "3 AS row", "4 AS pos", "5 AS h1")
    got = encode_corpus(df).collect()
    assert sorted(((r["doc_id"] or 0, list(r["ids"])) for r in got)) == sorted((i or 0, encode(t) if t else []) for i, t in rows)
    assert {r["doc_id"]: r["n_tokens"] for r in encode_corpus(df, counts_only=True).where("doc_id > 1").collect()} == {2: 0, 3: 0, 4: 1, 5: len(encode("긴 글 " * 30_000))}
    assert encode_corpus(df.limit(0)).count() == 0


def test_whole_table(spark, encode):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert {r["doc_id"]: list(r["ids"]) for r in encode_corpus(docs).collect()} == {r["doc_id"]: encode(r["text"] or "") for r in docs.collect()}


@pytest.mark.parametrize("ids", ([], [0], [1, 65_535], [1, 65_536], [2**31 - 1]))
def test_packed_ids(ids):
    assert unpacked(packed(ids)).tolist() == ids
