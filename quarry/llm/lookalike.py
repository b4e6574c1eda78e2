"""Visually identical text with different characters (problem 8).

First every text is folded: composed forms, character width, the kind of blank,
invisible characters, ligatures and signs of one look.  Then look-alike letters are
repaired token by token, aware of scripts: in a token of mixed scripts the letters of
the weaker script give way to those of the dominant one, if the result is a word of the
corpus.  Letter case, accents, raised and circled digits, punctuation and line ends stay.

Two rules go beyond mixed-script tokens and corpus words, as equal look demands: a token
of look-alikes only takes the script of the text's other letters, and a form that two
different spellings lead to counts as a word.

One pass over the texts gives their digests, their suspicious tokens and the hashes of
the corpus vocabulary; only texts with suspicious tokens are looked at again.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..functions.arrow import arrow_type, slices
from ..functions.storage import materialize

_LATIN_OF_CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТХҮаеорсухіѕјԁһӏԛԝ", "ABESIJKMHOPCTXYaeopcyxisjdhlqw"))
_LATIN_OF_GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧον", "ABEZHIKMNOPTYXov"))
TO_LATIN = _LATIN_OF_CYRILLIC | _LATIN_OF_GREEK
_CYRILLIC = {v: k for k, v in reversed(_LATIN_OF_CYRILLIC.items())}
_GREEK = {v: k for k, v in reversed(_LATIN_OF_GREEK.items())}
#: Signs of one look.
_SIGNS = {**dict.fromkeys("‐‑", "-"), **dict.fromkeys("‧・ㆍ⋅·∙", "·"), "℃": "°C", "℉": "°F", "µ": "μ"}


def _table() -> dict[int, str]:
    """What a character is folded to, by rules over the whole of Unicode."""
    out: dict[int, str] = {}
    for o in range(0x80, sys.maxunicode + 1):
        c = chr(o)
        category = unicodedata.category(c)
        if category == "Cf" or c in "͏ᅟᅠ឴឵ㅤﾠ" or 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF or 0x180B <= o <= 0x180F:
            out[o] = ""
        elif category == "Zs":
            out[o] = " "
        elif unicodedata.decomposition(c).startswith(("<wide>", "<narrow>")) or 0xFB00 <= o <= 0xFB06 or 0x2160 <= o <= 0x217F or 0x2E80 <= o <= 0x2FD5 and unicodedata.decomposition(c):
            out[o] = unicodedata.normalize("NFKC", c)
    out |= {ord(k): v for k, v in _SIGNS.items()}
    return {k: "".join(_SIGNS.get(c, c) for c in v) for k, v in out.items()}


_FOLD = _table()


def _runs(points: list[int]) -> str:
    """The inside of a character class, as ranges."""
    out: list[list[int]] = []
    for o in sorted(points):
        if out and out[-1][1] == o - 1:
            out[-1][1] = o
        else:
            out.append([o, o])
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in out)


_CHANGES = re.compile(f"[{_runs(list(_FOLD))}]")
#: Combining marks belong to the word they stand in.
_MARKS = "".join(c for o in range(0x300, sys.maxunicode + 1) if unicodedata.category(c := chr(o))[0] == "M")
#: The rare planes stand apart, behind a look at the plane: one set of all marks would be searched one by one.
_MARK = "(?:[" + "".join(c for c in _MARKS if c <= "\uffff") + "]|(?=[\U00010000-\U0010ffff])[" + "".join(c for c in _MARKS if c > "\uffff") + "])"
_TOKEN = re.compile(rf"\w+(?:{_MARK}+\w*)*")
_FOREIGN = re.compile("[Ͱ-ϿЀ-ԯἀ-῿]")
_ALIKE = re.compile("[" + "".join(TO_LATIN) + "]")
#: Letters that resemble no other script's: Cyrillic, Greek, and all others (digits count with these).
_OWN_CYRILLIC = re.compile("(?![" + "".join(_LATIN_OF_CYRILLIC) + "])[Ѐ-ԯ]")
_OWN_GREEK = re.compile("(?![" + "".join(_LATIN_OF_GREEK) + "])[Ͱ-Ͽ]")
_OWN_OTHER = re.compile("(?![" + "".join({*TO_LATIN, *TO_LATIN.values()}) + "_])[^\\WͰ-ϿЀ-ԯ]")


def fold(text: str) -> str:
    """One form for width, blanks, invisible characters, composition and signs of one look."""
    if text.isascii():
        return text
    composed = unicodedata.normalize("NFC", text)
    folded = _CHANGES.sub(lambda m: _FOLD[ord(m.group())], composed)
    return composed if folded == composed else unicodedata.normalize("NFC", folded)


def suspects(folded: str) -> dict[str, str]:
    """Tokens that may hold look-alikes, each with its form in its dominant script.

    The script of a token is that of its letters that resemble no other script's; a token
    of look-alikes only takes the script of the text's other letters, Latin if they are.
    Letters are looked at without their accents, composed or not.
    """
    if not _FOREIGN.search(folded):
        return {}
    letters = unicodedata.normalize("NFD", folded)
    own_cyrillic, own_greek = bool(_OWN_CYRILLIC.search(letters)), bool(_OWN_GREEK.search(letters))
    if not (own_cyrillic or own_greek or _ALIKE.search(letters)):
        return {}
    out: dict[str, str] = {}
    for raw in set(_TOKEN.findall(folded)):
        token = raw if raw.isascii() else unicodedata.normalize("NFD", raw)
        cyrillic, greek = bool(_OWN_CYRILLIC.search(token)), bool(_OWN_GREEK.search(token))
        if cyrillic and greek:
            continue
        if not (cyrillic or greek):
            if _OWN_OTHER.search(token) or not (own_cyrillic or own_greek):
                script = None
            else:
                script = _CYRILLIC if own_cyrillic else _GREEK
        else:
            script = _CYRILLIC if cyrillic else _GREEK
        fixed = "".join(TO_LATIN.get(c, c) for c in token)
        if script:
            fixed = "".join(script.get(c, c) for c in fixed)
        if fixed != token:
            out[raw] = unicodedata.normalize("NFC", fixed)
    return out


def repair(folded: str, words: dict[str, str]) -> str:
    """The folded text with the given tokens replaced."""
    return unicodedata.normalize("NFC", _TOKEN.sub(lambda m: words.get(m.group(), m.group()), folded)) if words else folded


def _digest(text: str) -> bytes:
    return xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))


def _visible(folded: str) -> bool:
    return not (not folded or folded.isspace())


#: Letters that a repaired form holds one of at least; words without any are no part of the vocabulary.
_REPAIRED = re.compile("[A-Za-z\u00c0-\u024f\u0370-\u052f\u1e00-\u1fff]")
#: Hashes of words per row, and in memory before a task hands them on.
_ROW_WORDS, _HELD_WORDS = 5_000, 200_000


def _hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) - (1 << 63)


def _scanned(df: DataFrame, key: str, text: str, whole: bool) -> tuple[DataFrame, DataFrame]:
    """Texts and words, by one pass.

    ``row, key, stored, canon, folded, suspects`` of every text with a visible character (of
    every row if ``whole``): digests as stored and folded, the folded text where it has
    suspicious tokens (everywhere if ``whole``), and these tokens with their repaired form
    and its hash.  ``h``: the hashes of the corpus words that no look-alike is suspected in.
    """
    kind = df.schema[key].dataType.simpleString()
    found = pa.struct([("raw", pa.string()), ("fixed", pa.string()), ("h", pa.int64())])
    target = pa.schema([(key, arrow_type(df, key)), ("stored", pa.binary()), ("canon", pa.binary()), ("folded", pa.string()), ("suspects", pa.list_(found)), ("words", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: set[int] = set()

        def words() -> list:
            every = list(held)
            held.clear()
            return [(None, None, None, None, None, every[i : i + _ROW_WORDS]) for i in range(0, len(every), _ROW_WORDS)]

        def batch(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows) if rows else [[]] * 6, target)], schema=target)

        for b in slices(batches):
            rows, fresh = [], set()
            for id_, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if t is None:
                    rows.append((id_, None, None, None, [], None))
                    continue
                f = fold(t)
                bad = suspects(f)
                tokens = set(_TOKEN.findall(f))
                fresh |= tokens - bad.keys() if bad else tokens
                if whole or _visible(f):
                    rows.append((id_, _digest(t), _digest(f), f if whole or bad else None, [{"raw": r, "fixed": x, "h": _hash(x)} for r, x in bad.items()], None))
            held.update(_hash(w) for w in fresh if _REPAIRED.search(w))
            yield batch(rows + (words() if len(held) >= _HELD_WORDS else []))
        yield batch(words())

    rows = df if whole else df.where(F.col(text).isNotNull())
    schema = f"{key} {kind}, stored binary, canon binary, folded string, suspects array<struct<raw: string, fixed: string, h: bigint>>, words array<bigint>"
    got = materialize(rows.select(key, text).mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()))
    return got.where("words is null").drop("words"), got.where("words is not null").select(F.explode("words").alias("h"))


#: Broadcast bound: distinct suspicious tokens that an executor holds without strain.
BROADCAST_WORDS = 200_000


def _replacements(texts: DataFrame, words: DataFrame) -> DataFrame:
    """``row, words``: per text with suspicious tokens that are to be replaced, these tokens and what replaces them.

    A repaired form counts as a word of the corpus if it occurs as it is, or if different
    suspicious tokens lead to it.
    """
    tokens = texts.where(F.size("suspects") > 0).select("row", F.explode("suspects").alias("s")).select("row", "s.*")
    pairs = materialize(tokens.select("raw", "fixed", "h").distinct())
    small = pairs.count() <= BROADCAST_WORDS
    bounded = F.broadcast if small else lambda df: df
    forms = pairs.groupBy("h").agg(F.countDistinct("raw").alias("n"))
    known = words.join(bounded(forms), "h", "left_semi").distinct().union(forms.where("n > 1").select("h")).distinct()
    valid = materialize(pairs.join(known, "h", "left_semi").select("raw", "fixed"))
    return tokens.join(bounded(valid), ["raw", "fixed"], "left_semi").groupBy("row").agg(F.collect_set(F.struct("raw", "fixed")).alias("words"))


def _repaired(texts: DataFrame, words: DataFrame, key: str, digests: bool) -> DataFrame:
    """``key, stored, canon`` (or ``key, text``) of the texts with suspicious tokens, these replaced."""
    kind = texts.schema[key].dataType.simpleString()
    target = pa.schema([(key, arrow_type(texts, key)), ("stored", pa.binary()), ("canon", pa.binary())] if digests else [(key, arrow_type(texts, key)), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for id_, stored, f, w in zip(*(b.column(i).to_pylist() for i in range(4))):
                out = repair(f, {x["raw"]: x["fixed"] for x in w or ()})
                rows.append((id_, stored, _digest(out)) if digests else (id_, out))
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows) if rows else [[]] * len(target), target)], schema=target)

    joined = texts.where(F.size("suspects") > 0).select("row", key, "stored", "folded").join(words, "row", "left").select(key, "stored", "folded", "words")
    return joined.mapInArrow(run, f"{key} {kind}, stored binary, canon binary" if digests else f"{key} {kind}, text string")


def canonical_text(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row with its text in one form: ``key, text``.

    Null stays null; blank texts keep their blanks; repeated rows stay repeated; other
    columns are ignored.  Only texts with suspicious tokens are shuffled.
    """
    texts, words = _scanned(df, key, text, True)
    plain = texts.where(F.size("suspects") == 0).select(key, F.col("folded").alias("text"))
    return plain.union(_repaired(texts, _replacements(texts, words), key, False))


def same_look_classes(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, stored, canon`` of every text with a visible character; equal ``canon`` means equal look."""
    texts, words = _scanned(df, key, text, False)
    plain = texts.where(F.size("suspects") == 0).select(key, "stored", "canon")
    return plain.union(_repaired(texts, _replacements(texts, words), key, True))


def same_look_pairs(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pairs of rows whose texts look the same but are not equal as stored: ``key_a, key_b``, the smaller first.

    Only classes with two different stored forms are joined: each pair of forms with the
    rows of either, so that copies of one form never meet.  Texts equal as stored give no
    pair, texts without a visible character and null ones take no part.
    """
    docs = materialize(same_look_classes(df, key, text))
    several = docs.select("canon", "stored").distinct().groupBy("canon").agg(F.count("*").alias("forms")).where("forms > 1").select("canon")
    of = materialize(docs.join(several, "canon", "left_semi"))
    forms = of.select("canon", "stored").distinct()
    a, b = (forms.select("canon", F.col("stored").alias(f"stored_{x}")) for x in "ab")
    pairs = a.join(b, "canon").where("stored_a < stored_b")
    ka, kb = (of.select("canon", F.col("stored").alias(f"stored_{x}"), F.col(key).alias(f"key_{x}")) for x in "ab")
    found = pairs.join(ka, ["canon", "stored_a"]).join(kb, ["canon", "stored_b"]).where("key_a <> key_b")
    return found.select(F.least("key_a", "key_b").alias(f"{key}_a"), F.greatest("key_a", "key_b").alias(f"{key}_b"))


def same_look_summary(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, class, n_forms, n_rows`` of every text with a visible character: its class is the smallest key of the same look.

    The form without pairs: its rows are as many as the texts, whatever a class holds.
    """
    docs = materialize(same_look_classes(df, key, text))
    forms = docs.groupBy("canon", "stored").agg(F.min(key).alias("least"), F.count("*").alias("n"))
    classes = forms.groupBy("canon").agg(F.min("least").alias("class"), F.count("*").alias("n_forms"), F.sum("n").alias("n_rows"))
    return docs.select(key, "canon").join(classes, "canon").select(key, "class", "n_forms", "n_rows")
