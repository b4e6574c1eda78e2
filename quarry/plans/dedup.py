"""Duplicate queries: canonical rows, near-duplicates, merged schedules, refresh of an index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..operators import dedup as D
from ..sources.tables import table
from .catalog import _BARE


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "syllabus").where("text is not null").withColumn("name", T.normalize_name(F.coalesce("course_name", F.lit(""))))


def canonical_dedup_rank(spark, sf_dir):
    """Per course name, the record that survives: other sources than a bare form first, then the longest text, then the first record."""
    rank = F.struct((F.lower(F.trim(F.coalesce("sources", F.lit("")))) != "html").alias("other"), F.length("text").alias("n"), (-F.col("record_id")).alias("neg"))
    return _named(spark, sf_dir).groupBy("name").agg((-F.max(rank)["neg"]).alias("record_id"), F.count("*").alias("n_records"))


def _links(spark, sf_dir):
    members, classes = D.near_duplicate_classes(_named(spark, sf_dir), "record_id", "text", F.col("name"))
    return members, classes, D.materialize(D.near_duplicate_links(classes))


def near_duplicate_links(spark, sf_dir):
    """Every record with its class of copies, and the class's links to other classes of its name."""
    members, _, links = _links(spark, sf_dir)
    ends = links.select(F.col("a").alias("class")).union(links.select(F.col("b").alias("class"))).groupBy("class").agg(F.count("*").alias("links"))
    return members.join(ends, "class", "left").select("record_id", "class", F.coalesce("links", F.lit(0)).alias("links"))


def near_duplicate_greedy(spark, sf_dir):
    """Every record with the record that stands for it; the longest text survives, then the first."""
    members, classes, links = _links(spark, sf_dir)
    rank = classes.select("class", F.struct((-F.col("longest")).alias("n"), "class").alias("rank"))
    kept = D.greedy_survivors(classes, links, rank)
    return members.join(kept, "class").select("record_id", "class", "keeper")


def source_coalesce_dedup(spark, sf_dir):
    """One row per code and class: each field's first non-empty value in the order of the rows."""
    c = table(spark, sf_dir, "courses").where("course_code is not null and class_no is not null")
    return D.coalesce_fields(c, [T.bare_code(F.col("course_code")).alias("code"), F.trim("class_no").alias("class_no")], ["course_name", "professor", "syllabus_url"], "row_id")


def schedule_merge_distinct(spark, sf_dir):
    """Distinct meetings of each code's records, with how many records hold them."""
    e = table(spark, sf_dir, "syllabus").select("record_id", T.bare_code(F.col("course_code")).alias("code"), F.explode("schedule_entries").alias("e")).where("code <> ''")
    return e.groupBy("code", "e.day", "e.start_period", "e.end_period", "e.room").agg(F.countDistinct("record_id").alias("n_records"))


def union_sections(spark, sf_dir):
    """Sections represented in the collection: the records' own and those they stand for."""
    s = table(spark, sf_dir, "syllabus")
    own = s.select(T.bare_code(F.col("course_code")).alias("code"), F.trim("class_no").alias("class_no"))
    other = s.select(F.explode("duplicate_sections").alias("d")).select(T.bare_code(F.col("d.course_code")).alias("code"), F.trim("d.class_no").alias("class_no"))
    return own.union(other).where("code <> '' and class_no <> ''").distinct()


def index_refresh_diff(spark, sf_dir):
    """What brings an index of the sections as collected up to 2023 to all that is collected: actions and how many."""
    c = table(spark, sf_dir, "courses").where("collected_at is not null").select(F.concat_ws("-", "year", "term", T.bare_code(F.col("course_code")), F.trim("class_no")).alias("section"), "collected_at", "row_id", F.sha2(F.concat_ws("|", F.coalesce("course_name", F.lit("")), F.coalesce("professor", F.lit("")), F.coalesce("credit", F.lit(""))), 256).alias("content"))
    last = lambda x: x.groupBy("section").agg(F.max_by("content", F.struct("collected_at", "row_id")).alias("content"))
    return D.refresh_diff(last(c.where("collected_at < '2024-01-01'")), last(c), "section", "content").groupBy("action").agg(F.count("*").alias("n"))


_NAME = "lower(regexp_replace(coalesce(course_name, ''), '[^\\p{L}\\p{N}]', '', 'g'))"
_SH = """w AS (SELECT record_id, name, length(text) AS n_chars, list_filter(regexp_split_to_array(lower(text), '[\\s\\p{Z}]+'), lambda x: x <> '') AS w FROM named),
s AS (SELECT record_id, name, n_chars, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(generate_series(1, greatest(len(w) - 4, 1)), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
c AS (SELECT name, list_sort(s) AS s, min(record_id) AS class, max(n_chars) AS longest FROM s GROUP BY 1, 2),
l AS (SELECT a.class AS a, b.class AS b FROM c a JOIN c b ON a.name = b.name AND a.class < b.class WHERE len(a.s) > 0 AND len(b.s) > 0 AND len(list_intersect(a.s, b.s)) >= 0.8 * (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) - 1e-9)"""

SQL = {
    "canonical_dedup_rank": f"SELECT name, record_id, n AS n_records FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY (lower(trim(coalesce(sources, ''))) <> 'html') DESC, length(text) DESC, record_id) AS r, count(*) OVER (PARTITION BY name) AS n FROM (SELECT *, {_NAME} AS name FROM syllabus WHERE text IS NOT NULL)) WHERE r = 1",
    "near_duplicate_links": f"""WITH named AS (SELECT record_id, text, {_NAME} AS name FROM syllabus WHERE text IS NOT NULL), {_SH}
        SELECT s.record_id, c.class, (SELECT count(*) FROM l WHERE l.a = c.class OR l.b = c.class) AS links FROM s JOIN c ON c.name = s.name AND c.s = list_sort(s.s)""",
    "near_duplicate_greedy": f"""WITH RECURSIVE named AS (SELECT record_id, text, {_NAME} AS name FROM syllabus WHERE text IS NOT NULL), {_SH},
        o AS (SELECT name, class, row_number() OVER (PARTITION BY name ORDER BY longest DESC, class) AS i FROM c),
        e AS (SELECT x.class, x.i, y.class AS other, y.i AS other_i FROM (SELECT a, b FROM l UNION ALL SELECT b, a FROM l) t JOIN o x ON x.class = t.a JOIN o y ON y.class = t.b WHERE y.i < x.i),
        n AS (SELECT o.name, o.class, o.i, coalesce((SELECT list(other) FROM e WHERE e.class = o.class), []) AS better FROM o),
        r AS (SELECT name, i, [class] AS kept FROM n WHERE i = 1
              UNION ALL SELECT n.name, n.i, CASE WHEN list_has_any(r.kept, n.better) THEN r.kept ELSE list_append(r.kept, n.class) END FROM r JOIN n ON n.name = r.name AND n.i = r.i + 1),
        k AS (SELECT name, unnest(kept) AS class FROM r WHERE i = (SELECT max(i) FROM n WHERE n.name = r.name)),
        g AS (SELECT class, class AS keeper FROM k UNION ALL SELECT e.class, arg_min(other, other_i) FROM e WHERE e.class NOT IN (SELECT class FROM k) AND e.other IN (SELECT class FROM k) GROUP BY e.class)
        SELECT s.record_id, c.class, g.keeper FROM s JOIN c ON c.name = s.name AND c.s = list_sort(s.s) JOIN g ON g.class = c.class""",
    "source_coalesce_dedup": f"SELECT code, class_no, first(course_name ORDER BY row_id) FILTER (WHERE trim(course_name) <> '') AS course_name, first(professor ORDER BY row_id) FILTER (WHERE trim(professor) <> '') AS professor, first(syllabus_url ORDER BY row_id) FILTER (WHERE trim(syllabus_url) <> '') AS syllabus_url, count(*) AS n_rows FROM (SELECT row_id, {_BARE} AS code, trim(class_no) AS class_no, course_name, professor, syllabus_url FROM courses WHERE course_code IS NOT NULL AND class_no IS NOT NULL) GROUP BY code, class_no",
    "schedule_merge_distinct": f"SELECT code, e.day AS day, e.start_period AS start_period, e.end_period AS end_period, e.room AS room, count(DISTINCT record_id) AS n_records FROM (SELECT record_id, {_BARE} AS code, unnest(schedule_entries) AS e FROM syllabus) WHERE code <> '' GROUP BY ALL",
    "union_sections": f"SELECT DISTINCT code, class_no FROM (SELECT {_BARE} AS code, trim(class_no) AS class_no FROM syllabus UNION ALL SELECT {_BARE.replace('course_code', 'd.course_code')}, trim(d.class_no) FROM (SELECT unnest(duplicate_sections) AS d FROM syllabus)) WHERE code <> '' AND class_no <> ''",
    "index_refresh_diff": f"""WITH c AS (SELECT concat_ws('-', year, term, {_BARE}, trim(class_no)) AS section, collected_at, row_id, sha256(coalesce(course_name, '') || '|' || coalesce(professor, '') || '|' || coalesce(credit, '')) AS content FROM courses WHERE collected_at IS NOT NULL),
        o AS (SELECT section, arg_max(content, (collected_at, row_id)) AS x FROM c WHERE collected_at < TIMESTAMP '2024-01-01' GROUP BY section), n AS (SELECT section, arg_max(content, (collected_at, row_id)) AS y FROM c GROUP BY section)
        SELECT CASE WHEN y IS NULL THEN 'delete' WHEN x IS NULL THEN 'insert' WHEN x <> y THEN 'update' ELSE 'keep' END AS action, count(*) AS n FROM o FULL JOIN n USING (section) GROUP BY 1""",
}
QUERIES = {f.__name__: f for f in (canonical_dedup_rank, near_duplicate_links, near_duplicate_greedy, source_coalesce_dedup, schedule_merge_distinct, union_sections, index_refresh_diff)}
