"""Search over passages of records: keyword score with boosts, hybrid rerank, relevance, named courses.

Whatever a question shares with a passage (a term, a name, a group of synonyms) is found by
an equality join; the parts are added up per question and passage, so no question meets a
passage it has nothing in common with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.storage import materialize
from ..functions.text import course_codes, normalize_title, tokenize
from . import retrieval as R, rules, segment


def passages(records: DataFrame, key: str = "record_id", text: str = "text") -> DataFrame:
    """``pid, key, course_code, course_name, professor, section, text, tokens``: the section chunks of the records with their course's fields.

    ``pid`` orders the passages as they stand in the collection: the key (below 2^43), then
    the place in the text.  Tokens are of the fields, the section's name and the text.
    Written once, as every part of a search reads it.
    """
    fields = ["course_code", "course_name", "professor", "completion_type", "schedule_summary"]
    chunks = segment.section_chunks(records, key, text).select(key, "chunk_no", "section", F.col("chunk").alias("text"))
    j = chunks.join(records.select(key, *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in fields]), key)
    tokens = tokenize(F.concat_ws(" ", *fields, "section", "text"))
    return materialize(j.select((F.shiftleft(F.col(key).cast("bigint"), 20) + F.col("chunk_no")).alias("pid"), key, "course_code", "course_name", "professor", "section", "text", tokens.alias("tokens")))


def contained(texts: DataFrame, names: DataFrame, key: str, text: str, name: str) -> DataFrame:
    """``key, name, at``: every name that a text contains, with the place of its first occurrence.

    An equi-join instead of a nested loop: every place of a text offers what follows it,
    and meets the names that begin with the same two characters.  Empty and null names are
    in no text.
    """
    known = names.select(F.col(name).alias("name")).where(F.length("name") > 0).distinct().withColumn("begin", F.substring("name", 1, 2))
    shape = known.agg(F.array_distinct(F.collect_set(F.length("begin"))).alias("begins"), F.max(F.length("name")).alias("most"))
    t = texts.where(F.length(text) > 0).select(key, F.col(text).alias("t")).join(F.broadcast(shape))
    places = t.select(key, F.posexplode(F.transform(F.sequence(F.lit(1), F.length("t")), lambda i: F.substring(F.col("t"), i, F.col("most")))).alias("at", "rest"), "begins")
    offers = places.select(key, "at", "rest", F.explode("begins").alias("n")).select(key, "at", "rest", F.substring(F.col("rest"), F.lit(1), F.col("n")).alias("begin"))
    met = offers.join(known, "begin").where(F.startswith("rest", "name"))
    return met.groupBy(key, "name").agg((F.min("at") + 1).alias("at"))


def named_courses(questions: DataFrame, courses: DataFrame, qid: str = "qid", text: str = "question") -> DataFrame:
    """``qid, code, at``: the courses a question names explicitly, with the place where it first does.

    By code where it holds codes of the collection's form, and then by these alone; else by
    the longest name it contains (marks, case and blanks aside; a name counts with and
    without the remark that it is held in English).  ``courses`` has ``code`` and ``course_name``.
    """
    q = questions.select(F.col(qid).alias("qid"), F.col(text).alias("q")).withColumn("codes", course_codes(F.col("q")))
    known = courses.select(F.upper("code").alias("code")).where("code <> ''").distinct()
    by_code = q.select("qid", F.upper("q").alias("q"), F.explode("codes").alias("code")).join(known, "code", "left_semi").select("qid", "code", F.instr("q", F.col("code")).alias("at"))
    whole = normalize_title(F.coalesce("course_name", F.lit("")))
    bare = normalize_title(F.regexp_replace(F.coalesce("course_name", F.lit("")), r"\((?:영강|영어강의)\)", ""))
    titles = courses.where("code <> ''").select(F.upper("code").alias("code"), F.explode(F.array_distinct(F.array(whole, bare))).alias("title")).where("title <> ''").distinct()
    unnamed = q.where(F.size("codes") == 0).select("qid", normalize_title(F.col("q")).alias("t"))
    found = contained(unnamed, titles, "qid", "t", "title")
    longest = found.groupBy("qid").agg(F.max(F.length("name")).alias("n"))
    best = found.join(longest, "qid").where(F.length("name") == F.col("n"))
    by_name = best.join(titles, F.col("name") == F.col("title")).groupBy("qid", "code").agg(F.min("at").alias("at"))
    return by_code.unionByName(by_name)


def keyword_scores(passages: DataFrame, questions: DataFrame, qid: str = "qid", text: str = "question") -> DataFrame:
    """``qid, pid, score`` of every passage that a question's terms, names or synonyms lead to.

    BM25 of the expanded terms; 8 for its course code in the question, 8 for its course's name,
    3 for its professor, 10 for the course the question hints at (the first it names), 1.2 for
    each word of a synonym group the question holds; where this is above 0, what the
    question gives the section.  Missing codes and names earn nothing.
    """
    q = questions.select(F.col(qid).alias("qid"), F.col(text).alias("q")).where("q is not null")
    terms = q.select("qid", F.explode(rules.expanded(tokenize(F.col("q")))).alias("term")).withColumn("qtf", F.lit(1))
    sized = passages.select(F.col("pid").alias("doc_id"), F.size("tokens").alias("dl"), "tokens")
    stats = sized.agg(F.count("*").alias("n_docs"), F.greatest(F.avg("dl"), F.lit(1.0)).alias("avgdl"))
    postings = sized.select("doc_id", "dl", F.explode("tokens").alias("term")).join(terms.select("term").distinct(), "term", "left_semi").groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"))
    asked = terms.select("qid").distinct()  # a question without terms finds nothing
    parts = [R.bm25_scores(materialize(postings), stats, terms).select("qid", F.col("doc_id").alias("pid"), "score")]

    low = q.join(asked, "qid", "left_semi").select("qid", "q", F.lower("q").alias("low"))
    fields = passages.select("pid", F.lower("course_code").alias("code"), "course_name", "professor")
    for question, field, gain in (("low", "code", 8.0), ("q", "course_name", 8.0), ("q", "professor", 3.0)):
        hit = contained(low, fields, "qid", question, field).select("qid", F.col("name").alias(field))
        parts.append(fields.join(hit, field).select("qid", "pid", F.lit(gain).alias("score")))
    first = passages.where("course_code <> ''").groupBy(F.upper("course_code").alias("code"), "course_name").agg(F.min("pid").alias("first"))
    hints = named_courses(low.select("qid", F.col("q").alias("question")), first).join(first.groupBy("code").agg(F.min("first").alias("first")), "code").groupBy("qid").agg(F.min_by("code", "first").alias("code"))
    parts.append(fields.select("pid", F.upper("code").alias("code")).join(hints, "code").select("qid", "pid", F.lit(10.0).alias("score")))

    groups = F.array(*[F.when(rules.contains_phrase(F.col("q"), (key, *words)), F.lit(key)) for key, words in rules.SYNONYMS.items()])
    holds = low.select("qid", F.explode(F.filter(groups, lambda g: g.isNotNull())).alias("group"))
    text_ = F.col("low_text")
    held = lambda words: sum((F.contains(text_, F.lit(w.lower())).cast("int") for w in words[1:]), F.contains(text_, F.lit(words[0].lower())).cast("int"))
    counts = F.array(*[F.struct(F.lit(key).alias("group"), held(words).alias("n")) for key, words in rules.SYNONYMS.items()])
    words = passages.select("pid", F.lower("text").alias("low_text")).select("pid", F.explode(F.filter(counts, lambda c: c["n"] > 0)).alias("c")).select("pid", "c.*")
    parts.append(words.join(holds, "group").select("qid", "pid", (1.2 * F.col("n")).alias("score")))

    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    total = union.groupBy("qid", "pid").agg(F.sum("score").alias("score")).where("score > 0")
    placed = total.join(passages.select("pid", "section"), "pid").join(low.select("qid", "q"), "qid")
    return placed.select("qid", "pid", F.round(F.col("score") + rules.section_priority(F.col("q"), F.col("section")), 6).alias("score"))


def diversified(scored: DataFrame, passages: DataFrame, k: int, cap: int = 2, fetch: int = 60) -> DataFrame:
    """``qid, pid, position``: ``k`` of each question's ``fetch`` best passages, chosen one by one for score and novelty, ``cap`` of a course at most."""
    top = R.top_k(scored.select("qid", "pid", "score"), fetch, tie="pid").join(passages.select("pid", "course_code", F.array_distinct("tokens").alias("tokens")), "pid")
    return R.mmr(top, k, cap, key="pid")


def rerank(questions: DataFrame, lexical: DataFrame, semantic: DataFrame, passages: DataFrame, qid: str = "qid", text: str = "question") -> DataFrame:
    """``qid, pid, course_code, lexical, semantic, evidence, score, broad``: both lists fused and weighed by what the question is after.

    To the evidence (0.55 semantic, 0.30 lexical and 0.15 fused rank, the latter two by the
    question's best) come the gain by intent and by section.  Where a question asks for
    substance, passages of empty forms are left out, unless it has no others.  ``lexical``
    has ``qid, pid, score, rank``, ``semantic`` ``qid, pid, cosine, rank``.
    """
    fused = R.hybrid_evidence(lexical, semantic, key="pid")
    # What counts of a question and of a passage is told before they meet, so that no text is shuffled.
    t = F.col(text)
    q = questions.select(F.col(qid).alias("qid"), rules.intents(t).alias("asked"), rules.preferred_sections(t).alias("preferred"), rules.substantive(t).alias("substantive"), rules.broad(t).alias("broad"))
    seen = F.concat_ws(" ", "course_code", "course_name", "professor", "text")
    told = passages.select("pid", "course_code", "section", rules.answers(seen).alias("answered"), rules.low_information(F.col("text")).alias("low"))
    j = fused.join(q, "qid").join(told, "pid")
    gain = rules.intent_gain(F.col("asked"), F.col("answered")) + rules.section_gain(F.col("preferred"), F.col("section"))
    j = j.withColumn("score", F.round(F.col("evidence") + gain, 6)).withColumn("empty", F.col("substantive") & F.col("low"))
    others = F.min("empty").over(W.partitionBy("qid"))  # false where a question has a passage that isn't empty
    return j.withColumn("all_empty", others).where(~F.col("empty") | F.col("all_empty")).select("qid", "pid", "course_code", "lexical", "semantic", "evidence", "score", "broad")


def reranked(ranked: DataFrame, passages: DataFrame, k: int, fetch: int = 60) -> DataFrame:
    """``qid, pid, position``: the diversified choice from a rerank: one passage of a course for broad questions, two for others."""
    of = lambda broad, cap: diversified(ranked.where("broad" if broad else "not broad"), passages, k, cap, fetch)
    return of(True, 1).unionByName(of(False, 2))


def relevant(ranked: DataFrame, questions: DataFrame, passages: DataFrame, courses: DataFrame, qid: str = "qid", text: str = "question") -> DataFrame:
    """The rows of a rerank that are near enough to their question.

    All stay where the question names a course.  Else a passage must be close (a cosine of
    0.7), or share terms and hold one of the question's longest tokens; and its evidence must
    reach 0.18 and 0.42 of the best (0.12 and 0.30 for broad questions).
    """
    q = questions.select(F.col(qid).alias("qid"), F.col(text).alias("q"))
    named = named_courses(q, courses, "qid", "q").select("qid").distinct().withColumn("named", F.lit(True))
    tokens = q.select("qid", rules.expanded(tokenize(F.col("q"))).alias("t"))
    longest = F.coalesce(F.array_max(F.transform("t", F.length)), F.lit(0))
    anchors = tokens.select("qid", F.filter("t", lambda x: F.length(x) >= F.greatest(F.lit(4), longest - 1)).alias("anchors"))
    coded = q.select("qid", (F.size(course_codes(F.col("q"))) > 0).alias("coded"))
    seen = F.lower(F.concat_ws(" ", "course_code", "course_name", "professor", "text"))
    j = ranked.join(anchors, "qid").join(coded, "qid").join(named, "qid", "left").join(passages.select("pid", seen.alias("seen")), "pid")
    exempt: Column = F.coalesce("named", F.lit(False)) | F.col("coded")
    anchored = (F.size("anchors") == 0) | F.exists("anchors", lambda a: F.contains(F.col("seen"), a))
    j = j.withColumn("exempt", exempt).where(F.col("exempt") | (F.col("semantic") >= 0.70) | (F.col("lexical") > 0) & anchored)
    top = F.max("evidence").over(W.partitionBy("qid"))
    floor = F.when(F.col("broad"), F.greatest(F.lit(0.12), 0.30 * F.col("top"))).otherwise(F.greatest(F.lit(0.18), 0.42 * F.col("top")))
    return j.withColumn("top", top).where(F.col("exempt") | (F.col("evidence") >= floor)).select(*ranked.columns)
