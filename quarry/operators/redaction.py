"""Redaction of contacts, numbers, paths, addresses of the web and known marks, with a counter per rule.

Everything is a column expression: a rule counts and replaces on the text as the rules
before it left it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructType

# Fixed values of the public numbering plan, without the trunk 0.
_CODES = "|".join(("2", *(f"3{d}" for d in range(1, 4)), *(f"4{d}" for d in range(1, 5)), *(f"5{d}" for d in range(1, 6)), *(f"6{d}" for d in range(1, 5)), "1[016-9]", "70", "80", "50[0-9]?"))
_GAP = r"[ .\t-]{0,3}"
#: What is replaced, in order: counter, pattern, replacement (``$1`` is the pattern's first group).
RULES = (
    ("local_paths", r"(?i)(?:file://|(?<![a-z0-9])[a-z]:[\\/]|\\\\[a-z0-9_.-]+\\|/(?:Users|home|mnt|tmp)/)[^\r\n<>\[\]\"|]+", "[path removed]"),
    ("urls", r"(?i)https?://[^\s<>\[\]\"'‘’“”()]+", None),
    ("emails", r"(?i)(?:mailto:)?[a-z0-9][a-z0-9.!#$%&'*+/=?^_`{|}~-]*@[a-z0-9][a-z0-9-]*(?:\.[a-z0-9-]+)*\.[a-z]{2,}", "[email removed]"),
    ("phones", rf"(?i)(?<![a-z0-9])(?:tel:)?(?:(?:\+|00)82{_GAP}\(?0?|\(?0)(?:{_CODES})\)?{_GAP}[0-9]{{3,4}}{_GAP}[0-9]{{4}}(?![0-9])", "[phone removed]"),
    ("resident_ids", r"(?<![0-9])[0-9]{6}[ \t]*-[ \t]*[1-8][0-9]{6}(?![0-9])", "[id removed]"),
    ("labelled_ids", r"(?i)((?:(?:student|staff|user|employee)[ _-]*(?:id|no)|std_id|학번|사번|교번|주민등록번호)[ \t]*[:=][ \t]*)(?!\[id)[a-z0-9_-]{4,}", "$1[id removed]"),
    ("marks", "氠瑢|漠杳|捤獥|汤捯|湰灧|慤桥|潴景", ""),
)
COUNTERS = tuple(name for name, _, _ in RULES) + ("unsafe_urls", "url_parameters", "url_fragments")
#: Parameters that a course page needs; the first four must be there.
COURSE_PARAMETERS = ("year", "term", "cour_cd", "cour_cls", "dept_cd", "grad_cd", "col_cd")
#: Hosts in number form that aren't public.
_PRIVATE = r"^(?:0|10|127|22[4-9]|2[3-5][0-9])\.|^169\.254\.|^192\.168\.|^192\.0\.[02]\.|^198\.1[89]\.|^198\.51\.100\.|^203\.0\.113\.|^172\.(?:1[6-9]|2[0-9]|3[01])\.|^100\.(?:6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\."


def checked_url(url: Column, endpoint: str | None = None, keep: tuple[str, ...] = COURSE_PARAMETERS, need: int = 4) -> Column:
    """``url, unsafe, parameters, fragments``: the URL as it may be shown, and what was taken off.

    Empty unless it is http(s) with a public host and without credentials.  A URL with
    parameters is shown only if it is the ``endpoint`` (host and path): with the parameters
    of ``keep``, of which the first ``need`` must be there; others have to go as a whole.
    Fragments are cut; null gives an empty URL that isn't counted.
    """
    u = F.coalesce(url, F.lit(""))
    host = F.lower(F.regexp_extract(u, r"(?i)^https?://([a-z0-9.-]+)(?::[0-9]{1,5})?(?:[/?#]|$)", 1))
    public = (host != "") & host.contains(".") & ~host.rlike(_PRIVATE)
    base = F.regexp_extract(u, r"^([^?#]*)", 1)
    given = F.filter(F.split(F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1), "&"), lambda p: p != "")
    named = F.lit(False) if endpoint is None else F.regexp_replace(base, r"(?i)^https?://", "") == endpoint
    name = lambda p: F.substring_index(p, "=", 1)
    kept = F.when(named, F.filter(given, lambda p: name(p).isin(*keep) & p.rlike(r"=[A-Za-z0-9_-]{1,20}$"))).otherwise(F.array().cast("array<string>"))
    has = F.transform(kept, name)
    complete = F.size(F.array_intersect(has, F.array(*[F.lit(k) for k in keep[:need]]))) == need
    shown = public & ((F.size(given) == 0) | (named & complete)) & (~named | complete)
    lower = F.regexp_replace(F.regexp_replace(base, "(?i)^https://", "https://"), "(?i)^http://", "http://")
    safe = F.when(shown, F.concat(lower, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))).otherwise("")
    return F.struct(
        safe.alias("url"), (~shown & (u != "")).cast("int").alias("unsafe"),
        F.when(public, F.size(given) - F.when(shown, F.size(kept)).otherwise(F.lit(0))).otherwise(0).alias("parameters"), (shown & u.contains("#")).cast("int").alias("fragments"),
    )


def redacted(text: Column, endpoint: str | None = None, shown: str = "[address removed]") -> Column:
    """``text`` and a field per counter: the text after all rules, white space before line ends off, empty lines one in a row; null stays null.

    A URL inside a text gives way to its safe form, or to ``shown`` if it has none; full
    stops and commas behind it are no part of it.
    """
    counts: list[Column] = []
    extra = {c: F.lit(0) for c in COUNTERS[len(RULES) :]}
    for name, pattern, put in RULES:
        counts.append(F.regexp_count(text, F.lit(pattern)).alias(name))
        if put is None:
            found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
            tail = lambda x: F.regexp_extract(x, r"([.,;:]*)$", 1)
            checked = F.transform(found, lambda x: checked_url(F.regexp_replace(x, r"[.,;:]+$", ""), endpoint))
            total = lambda field: F.aggregate(checked, F.lit(0), lambda a, c: a + c[field])  # noqa: B023, E731
            extra = {"unsafe_urls": total("unsafe"), "url_parameters": total("parameters"), "url_fragments": total("fragments")}
            new = F.zip_with(checked, found, lambda c, x: F.concat(F.when(c["url"] == "", F.lit(shown)).otherwise(c["url"]), tail(x)))  # noqa: B023
            text = F.array_join(F.zip_with(F.split(text, pattern, -1), F.array_append(new, F.lit("")), lambda a, b: F.concat(a, b)), "")
        else:
            text = F.regexp_replace(text, pattern, put)
    tidy = F.regexp_replace(F.regexp_replace(text, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n")
    return F.struct(F.regexp_replace(tidy, r"(?U)\A\s+|\s+\z", "").alias("text"), *counts, *[c.alias(n) for n, c in extra.items()])


def redacted_value(value: Column, kind: DataType, endpoint: str | None = None) -> Column:
    """A value with every text in it redacted, whatever arrays and structs it stands in."""
    if isinstance(kind, StringType):
        return F.transform(F.array(value), lambda v: redacted(v, endpoint)["text"])[0]
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: redacted_value(x, kind.elementType, endpoint))
    if isinstance(kind, StructType):
        return F.when(value.isNotNull(), F.struct(*[redacted_value(value[f.name], f.dataType, endpoint).alias(f.name) for f in kind.fields]))
    return value


def redact_table(df: DataFrame, fields: list[str], endpoint: str | None = None) -> DataFrame:
    """The table with the texts of some of its fields redacted; narrow."""
    return df.select(*[redacted_value(F.col(f.name), f.dataType, endpoint).alias(f.name) if f.name in fields else F.col(f.name) for f in df.schema.fields])


def residuals(df: DataFrame, key: str, text: str, endpoint: str | None = None) -> DataFrame:
    """``counter, n_checked, n_left``: per rule, how many texts were checked and how many still hold a match after redaction; URLs count if they aren't safe."""
    after = df.where(F.col(text).isNotNull()).select(redacted(F.col(text), endpoint)["text"].alias("t"))
    holds = [F.sum(F.col("t").rlike(p).cast("bigint")).alias(n) for n, p, put in RULES if put is not None]
    unsafe = F.exists(F.regexp_extract_all("t", F.lit(RULES[1][1]), F.lit(0)), lambda x: checked_url(F.regexp_replace(x, r"[.,;:]+$", ""), endpoint)["url"] == "")
    return after.agg(F.count("*").alias("n_checked"), *holds, F.sum(unsafe.cast("bigint")).alias("urls")).unpivot("n_checked", [n for n, _, _ in RULES], "counter", "n_left").select("counter", "n_checked", F.coalesce("n_left", F.lit(0)).alias("n_left"))


#: Formats of keys that must never stand in a text: fixed values of their issuers.
SECRETS = {"service_key": r"AIza[0-9A-Za-z_-]{30,}", "repository_token": r"gh[pousr]_[0-9A-Za-z]{25,}|github_pat_[0-9A-Za-z_]{30,}", "model_key": r"sk-[0-9A-Za-z_-]{30,}", "cloud_key": r"AKIA[0-9A-Z]{16}", "private_key": r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----"}


def secrets(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, kind`` for every kind of secret that a text holds; the secret itself is never shown."""
    kinds = F.filter(F.array(*[F.when(F.col(text).rlike(p), F.lit(k)) for k, p in SECRETS.items()]), lambda k: k.isNotNull())
    return df.select(key, F.explode(kinds).alias("kind"))
