"""Encoding of the whole corpus with a public tokenizer (problem 6).

Content-defined chunk reuse: a rolling hash over the characters cuts a text at places
that depend on what stands there only, so that passages which documents share give the
same chunks wherever they stand.  The different chunks of the whole corpus form one
table, of which each is encoded once; the documents get their ids back by a join.

A cut may fall inside a pre-token, where the tokens of the two chunks would differ from
those of the whole text.  Every such join is repaired: the stretch from the last sure
boundary before the cut to the first one after it is taken out of both chunks and encoded
anew, as an entry of the same table.  A boundary is sure if no pre-token can hold both of
its sides and matching from it on depends on nothing before it; between two sure
boundaries the ids are those of the whole text, whatever stands around.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.arrow import arrow_type, slices
from ..functions.storage import materialize

#: Where the public tokenizers' files lie; a parameter of every function that needs them.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-token pattern that belongs to the vocabulary: a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: What the pattern's ``\s`` matches.
_WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
#: Rolling-hash window, and the mean distance of cuts, in characters.
WINDOW, MEAN = 6, 128
_POWERS = np.array([pow(1_000_003, k, 1 << 64) for k in range(WINDOW)], dtype=np.uint64)


def encoder(path: str = VOCABULARY):
    """The encoder of a rank file, without special tokens: their texts are ordinary text."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def cuts(codes: np.ndarray, mean: int = MEAN) -> np.ndarray:
    """Places to cut a text, by a rolling hash of the ``WINDOW`` characters before each."""
    n = len(codes)
    if n <= WINDOW:
        return np.empty(0, dtype=np.int64)
    wide = codes.astype(np.uint64)
    h = np.zeros(n - WINDOW, dtype=np.uint64)
    for k in range(WINDOW):
        h += wide[WINDOW - 1 - k : n - 1 - k] * _POWERS[k]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return np.flatnonzero((h >> np.uint64(32)) % np.uint64(mean) == 0) + WINDOW


_OPEN, _SPACE, _LETTER, _NUMBER, _OTHER = range(5)
_tables: dict[str, np.ndarray] = {}


def _kinds() -> np.ndarray:
    """Space, letter, number or other sign for every character; open where versions of Unicode differ, as the tokenizer's may be any, and in the last planes."""
    if "kinds" not in _tables:
        of = {"L": _LETTER, "N": _NUMBER}
        old, new = unicodedata.ucd_3_2_0.category, unicodedata.category
        kinds = np.zeros(0x110000, dtype=np.uint8)
        for o in range(0x30000):
            c = chr(o)
            a, b = old(c), new(c)
            if a == b and a != "Cn":
                kinds[o] = of.get(a[0], _OTHER)
        kinds[[ord(c) for c in _WHITE]] = _SPACE
        _tables["kinds"] = kinds
    return _tables["kinds"]


def sure(codes: np.ndarray) -> np.ndarray:
    """The sure boundaries of a text, its ends included.

    A pre-token is of one kind of character, but for a blank in front and an apostrophe
    before a short ending; so a change of kind is sure unless it leads from a space to
    something visible or from an apostrophe to a letter.
    """
    kinds = _kinds()[codes]
    a, b = kinds[:-1], kinds[1:]
    change = (a != b) & (a > _SPACE) & (b > _OPEN) & ~((codes[:-1] == 39) & (b == _LETTER))
    return np.concatenate([[0], np.flatnonzero(change) + 1, [len(codes)]])


def units(text: str | None, mean: int = MEAN) -> list[str]:
    """The text in pieces whose ids, one after the other, are its ids: chunks and the repaired joins between them."""
    if not text:
        return [""]
    codes = _codes(text)
    at = cuts(codes, mean)
    if not len(at):
        return [text]
    safe = sure(codes)
    before, after = safe[np.searchsorted(safe, at, "right") - 1], safe[np.searchsorted(safe, at, "left")]
    edges = np.unique(np.concatenate([[0], before, after, [len(codes)]])).tolist()
    return [text[a:b] for a, b in zip(edges, edges[1:])]


_encoders: dict[str, object] = {}


def _encode(path: str):
    """This worker's encoder."""
    if path not in _encoders:
        _encoders[path] = encoder(path).encode_ordinary
    return _encoders[path]


def chunked(df: DataFrame, key: str = "doc_id", text: str = "text", mean: int = MEAN) -> DataFrame:
    """``key, row, units``: the pieces of every text, as a table; ``row`` tells repeated keys apart."""
    kind = df.schema[key].dataType.simpleString()
    target = pa.schema([(key, arrow_type(df, key)), ("units", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches, 256):
            yield pa.RecordBatch.from_arrays([rows.column(0).cast(target[0].type), pa.array([units(t, mean) for t in rows.column(1).to_pylist()], target[1].type)], schema=target)

    cut = df.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, f"{key} {kind}, units array<string>")
    return materialize(cut.select(key, F.monotonically_increasing_id().alias("row"), "units"))


def packed(ids: list[int]) -> bytes:
    """Ids in two bytes each where they fit, else in four, behind a byte that says which."""
    wide = max(ids, default=0) > 0xFFFF
    return (b"4" if wide else b"2") + np.asarray(ids, dtype="<u4" if wide else "<u2").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u4" if data[:1] == b"4" else "<u2", offset=1)


def chunk_table(cut: DataFrame, path: str = VOCABULARY, counts_only: bool = False) -> DataFrame:
    """``h1, h2, ids`` (packed; or ``n``) of every different piece of the corpus, each encoded once."""
    value = pa.int32() if counts_only else pa.binary()
    name = "n" if counts_only else "ids"
    target = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), (name, value)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encode(path)
        for rows in slices(batches, 4096):
            ids = [encode(t) for t in rows.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array([len(x) if counts_only else packed(x) for x in ids], value)], schema=target)

    different = cut.select(F.explode("units").alias("unit")).distinct()
    return different.select(*_hashes(), "unit").mapInArrow(run, f"h1 bigint, h2 bigint, {name} {'int' if counts_only else 'binary'}")


def _hashes():
    """128 bits that stand for a piece."""
    return F.xxhash64("unit").alias("h1"), F.xxhash64(F.lit(1), "unit").alias("h2")


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY, counts_only: bool = False, mean: int = MEAN) -> DataFrame:
    """``key, ids`` of every row (``key, n_tokens`` with ``counts_only``), by the public tokenizer at ``path``.

    Empty and null texts have no ids (an empty list, never null); repeated rows give
    repeated rows; texts of any length are encoded whole; other columns are ignored.
    Pieces that many documents share are combined before the shuffle of the table, and
    meet their ids in a join that AQE splits where it is skewed.
    """
    cut = chunked(df, key, text, mean)
    table = chunk_table(cut, path, counts_only)
    pieces = cut.select(key, "row", F.posexplode("units").alias("pos", "unit")).select(key, "row", "pos", *_hashes())
    coded = pieces.join(table, ["h1", "h2"])
    if counts_only:
        return coded.groupBy(key, "row").agg(F.sum("n").cast("int").alias("n_tokens")).select(key, "n_tokens")
    whole = coded.groupBy(key, "row").agg(F.sort_array(F.collect_list(F.struct("pos", "ids"))).alias("p"))
    kind = df.schema[key].dataType.simpleString()
    target = pa.schema([(key, arrow_type(df, key)), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches, 256):
            ids = [np.concatenate([unpacked(x) for x in pieces]).astype(np.int32) for pieces in rows.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32)))
            yield pa.RecordBatch.from_arrays([rows.column(0).cast(target[0].type), lists], schema=target)

    return whole.select(key, F.transform("p", lambda x: x["ids"]).alias("ids")).mapInArrow(run, f"{key} {kind}, ids array<int>")
