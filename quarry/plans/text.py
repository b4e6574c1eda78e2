"""Text queries: cleaning, titles, codes, chunks, expansion of questions."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..operators import rules as R, segment
from ..operators.rules import STOPWORDS, SUFFIXES
from ..sources.tables import table
from .retrieval import TOK

def cleaned_text_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length and lines of every syllabus text after cleaning."""
    c = T.clean_text(F.col("text"))
    return table(spark, sf_dir, "syllabus").select("record_id", F.length(c).alias("n_chars"), F.size(F.split(c, "\n")).alias("n_lines"))


def normalized_titles(spark, sf_dir):
    """Distinct course names in one form, with how many spellings and rows share it."""
    c = table(spark, sf_dir, "courses").where("course_name is not null").groupBy("course_name").agg(F.count("*").alias("n"))
    return c.groupBy(T.normalize_title(F.col("course_name")).alias("title")).agg(F.count("*").alias("spellings"), F.sum("n").alias("n_rows"))


def code_extraction(spark, sf_dir):
    """Course codes that each document's text mentions, in order."""
    codes = T.course_codes(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(codes).alias("pos", "code"))


def query_expansion_terms(spark, sf_dir):
    """Tokens of user questions without stopwords, with the stem before the first particle they end in, each once."""
    turns = table(spark, sf_dir, "chat_turns").where("role = 'user'")
    kept = F.filter(T.tokenize(F.col("text")), lambda t: ~t.isin(*STOPWORDS))
    stems = F.filter(F.transform(kept, R.stem), lambda s: s.isNotNull() & ~s.isin(*STOPWORDS))
    return turns.select("log_id", F.explode(F.array_distinct(F.concat(kept, stems))).alias("term"))


def query_expansion_terms_whole(spark, sf_dir):
    """Like ``query_expansion_terms``, with the tokens of every synonym group that the question's tokens and stems, set in a row, hold a word of."""
    turns = table(spark, sf_dir, "chat_turns").where("role = 'user'")
    return turns.select("log_id", F.explode(R.expanded(T.tokenize(F.col("text")))).alias("term"))


def question_keys(spark, sf_dir):
    """How often each question was asked, by its cache key."""
    turns = table(spark, sf_dir, "chat_turns").where("role = 'user' and text is not null")
    return turns.groupBy(T.normalize_question(F.col("text")).alias("question")).agg(F.count("*").alias("n"), F.countDistinct("client_digest").alias("clients"))


def fixed_window_chunks(spark, sf_dir):
    """Windows of 900 characters, 120 shared with the next, until the end of the text is covered."""
    return segment.fixed_windows(table(spark, sf_dir, "documents"), "doc_id", "text", 900, 120)


def section_chunks(spark, sf_dir):
    """Sections of every syllabus, cut to chunks of 900 characters that share 120."""
    return segment.section_chunks(table(spark, sf_dir, "syllabus"), "record_id", "text")


def section_priority_rank(spark, sf_dir):
    """Characters of each section per site, ranked within the site."""
    from pyspark.sql import Window as W

    lines = segment.section_lines(table(spark, sf_dir, "syllabus"), ["record_id", "site_id"], "text")
    per = lines.groupBy("site_id", "section").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))
    return per.withColumn("rank", F.row_number().over(W.partitionBy("site_id").orderBy(F.desc("n_chars"), "section")))


def section_priority(spark, sf_dir):
    """What each section of a syllabus gains or loses by each user question; sections that neither gain nor lose are left out."""
    asked = table(spark, sf_dir, "chat_turns").where("role = 'user' and text is not null").select("log_id", "text", F.explode(F.array(*[F.lit(n) for n in (*R.SECTION_TERMS, R.AVOIDED_SECTION)])).alias("section"))
    return asked.select("log_id", "section", R.section_priority(F.col("text"), F.col("section")).alias("boost")).where("boost <> 0")


def question_intents(spark, sf_dir):
    """Whether user questions ask for more than an empty form can tell, and whether they are after many courses."""
    asked = table(spark, sf_dir, "chat_turns").where("role = 'user' and text is not null")
    return asked.select("log_id", R.substantive(F.col("text")).alias("substantive"), R.broad(F.col("text")).alias("broad"), R.contains_phrase(F.col("text"), R.SYNONYMS["팀활동"]).alias("teamwork"))


def headed_chunks(spark, sf_dir):
    """Section chunks under their record's header, as they go into a vector index."""
    s = table(spark, sf_dir, "syllabus")
    return segment.headed_chunks(segment.section_chunks(s, "record_id", "text"), s, "record_id")


def _dq(s: str) -> str:
    return s.replace("'", "''")


_CLEAN = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g'), '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^[ \\t\\n\\f\\r]+|[ \\t\\n\\f\\r]+$', '', 'g')"
_TITLE = "regexp_replace(lower(replace(replace(replace(replace(replace(course_name, 'Ⅰ', 'I'), 'Ⅱ', 'II'), 'Ⅲ', 'III'), 'Ⅳ', 'IV'), 'Ⅴ', 'V')), '[^0-9a-z가-힣]', '', 'g')"
_STOP = ", ".join(f"'{_dq(s)}'" for s in STOPWORDS)
_STEM = "CASE " + " ".join(f"WHEN ends_with(t, '{s}') AND length(t) - {len(s)} >= 2 THEN substr(t, 1, length(t) - {len(s)})" for s in SUFFIXES) + " END"

SQL = {
    "cleaned_text_lengths": f"SELECT record_id, CAST(length(c) AS INT) AS n_chars, CAST(len(string_split(c, chr(10))) AS INT) AS n_lines FROM (SELECT record_id, {_CLEAN} AS c FROM syllabus)",
    "normalized_titles": f"SELECT {_TITLE} AS title, count(DISTINCT course_name) AS spellings, count(*) AS n_rows FROM courses WHERE course_name IS NOT NULL GROUP BY 1",
    "code_extraction": """WITH m AS (SELECT doc_id, list_transform(regexp_extract_all(regexp_replace(text, '([^A-Za-z0-9])', '\\1\\1', 'g'), '(?:^|[^A-Za-z0-9])[A-Za-z]{2,}[0-9]{3}(?:$|[^A-Za-z0-9])'), lambda x: upper(regexp_extract(x, '[A-Za-z]{2,}[0-9]{3}'))) AS c FROM documents WHERE text IS NOT NULL),
        u AS (SELECT doc_id, unnest(c) AS code, generate_subscripts(c, 1) AS i FROM m),
        f AS (SELECT doc_id, code, min(i) AS i FROM u GROUP BY doc_id, code)
        SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS pos, code FROM f""",
    "query_expansion_terms": f"""WITH k AS (SELECT log_id, list_filter({TOK.format(c="text")}, lambda t: t NOT IN ({_STOP})) AS kept FROM chat_turns WHERE role = 'user'),
        s AS (SELECT log_id, unnest(list_distinct(list_concat(kept, list_filter(list_transform(kept, lambda t: {_STEM}), lambda s: s IS NOT NULL AND s NOT IN ({_STOP}))))) AS term FROM k)
        SELECT log_id, term FROM s""",
    "question_keys": "SELECT trim(regexp_replace(trim(regexp_replace(lower(text), '[ \\t\\n\\f\\r]+', ' ', 'g')), '[?!.,。！？]+$', '')) AS question, count(*) AS n, count(DISTINCT client_digest) AS clients FROM chat_turns WHERE role = 'user' AND text IS NOT NULL GROUP BY 1",
    "fixed_window_chunks": """WITH w AS (SELECT doc_id, text, length(text) AS n, unnest(generate_series(0, greatest(0, CAST(ceil((length(text) - 900) / 780.0) AS BIGINT)))) AS k FROM documents WHERE length(text) > 0)
        SELECT doc_id, CAST(k AS INT) AS chunk_no, CAST(k * 780 AS INT) AS begin, substr(text, k * 780 + 1, 900) AS chunk FROM w WHERE regexp_replace(substr(text, k * 780 + 1, 900), '[ \\t\\n\\f\\r]', '', 'g') <> ''""",
}
_OR = lambda terms: "|".join(re.escape(t) for t in dict.fromkeys(x.lower() for x in terms))
_HAS = lambda c, terms: f"regexp_matches({c}, '{_OR(terms)}')"
_ANY = lambda c, terms: _HAS(f"lower({c})", terms).replace("코딩", "(?:^|[^인디엔])코딩", 1).replace("coding", "(?:^|[^a-z])coding(?:[^a-z]|$)", 1)
_GROUPS = ", ".join(f"CASE WHEN {_ANY('row', (key, *words))} THEN {TOK.format(c=chr(39) + ' '.join(words) + chr(39))} ELSE [] END" for key, words in R.SYNONYMS.items())
SQL["query_expansion_terms_whole"] = f"""WITH k AS (SELECT log_id, list_filter({TOK.format(c="text")}, lambda t: t NOT IN ({_STOP})) AS kept FROM chat_turns WHERE role = 'user'),
    o AS (SELECT log_id, list_filter(flatten(list_transform(kept, lambda t: [t, {_STEM}])), lambda t: t IS NOT NULL AND t NOT IN ({_STOP})) AS own FROM k),
    r AS (SELECT log_id, own, array_to_string(own, ' ') AS row FROM o)
    SELECT log_id, unnest(list_distinct(flatten([own, {_GROUPS}]))) AS term FROM r"""
SQL["section_priority"] = "WITH a AS (SELECT log_id, lower(text) AS q FROM chat_turns WHERE role = 'user' AND text IS NOT NULL) " + " UNION ALL ".join(
    [f"SELECT log_id, '{name}' AS section, 0.32::DOUBLE AS boost FROM a WHERE {_HAS('q', terms)}" for name, terms in R.SECTION_TERMS.items()] + [f"SELECT log_id, '{R.AVOIDED_SECTION}', -0.35::DOUBLE FROM a WHERE NOT {_HAS('q', R.AVOIDED_TERMS)}"]
)
SQL["question_intents"] = f"""SELECT log_id, contains(text, '추천') OR {_ANY('text', R.CODING_TERMS)} OR {_ANY('text', R.PROJECT_TERMS)} OR {_ANY('text', R.SYNONYMS['실습'])} AS substantive,
    {_ANY('text', R.BROAD_TERMS)} AND NOT regexp_matches(text, '(?:^|[^A-Za-z0-9])[A-Za-z]{{2,}}[0-9]{{3}}(?:[^A-Za-z0-9]|$)') AS broad,
    {_HAS("lower(regexp_replace(text, '[[:space:]]+', '', 'g'))", [t.replace(' ', '') for t in R.SYNONYMS['팀활동']])} AS teamwork FROM chat_turns WHERE role = 'user' AND text IS NOT NULL"""
_SECTION = "CASE " + " ".join(f"WHEN regexp_matches(line, '(?i){p}') THEN '{n}'" for n, p in segment.SECTIONS) + " END"
SQL["section_priority_rank"] = f"""WITH l AS (SELECT record_id, site_id, unnest(x) AS line, generate_subscripts(x, 1) AS i FROM (SELECT record_id, site_id, string_split(text, chr(10)) AS x FROM syllabus WHERE length(text) > 0)),
    n AS (SELECT *, coalesce(last_value({_SECTION} IGNORE NULLS) OVER (PARTITION BY record_id, site_id ORDER BY i ROWS UNBOUNDED PRECEDING), 'body') AS section FROM l),
    p AS (SELECT site_id, section, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM n WHERE trim(line, ' ') <> '' GROUP BY 1, 2)
    SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY n_chars DESC, section) AS rank FROM p"""
QUERIES = {f.__name__: f for f in (cleaned_text_lengths, normalized_titles, code_extraction, query_expansion_terms, query_expansion_terms_whole, question_keys, fixed_window_chunks, section_chunks, section_priority_rank, section_priority, question_intents, headed_chunks)}
