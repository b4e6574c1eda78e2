"""Conversation operators: mentions, the latest answer's set, references, history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.text import course_codes
from .search import contained


def deliveries_once(turns: DataFrame) -> DataFrame:
    """One row per (conv_id, turn): the delivery with the smallest log_id; one shuffle, no join."""
    rest = F.struct(*[c for c in turns.columns if c not in ("conv_id", "turn")])
    kept = turns.groupBy("conv_id", "turn").agg(F.min_by(rest, "log_id").alias("r"))
    return kept.select(*[F.col(c) if c in ("conv_id", "turn") else F.col(f"r.{c}").alias(c) for c in turns.columns])


def mentions(turns: DataFrame, codes: DataFrame) -> DataFrame:
    """``conv_id, turn, role, code``: known course codes that a turn's text names, each once.

    The codes are read off the text and looked up by equality, so no nested loop arises.
    """
    said = turns.select("conv_id", "turn", "role", F.explode(course_codes(F.col("text"))).alias("code"))
    return said.join(codes, "code", "left_semi")


def mentions_by_name(turns: DataFrame, courses: DataFrame) -> DataFrame:
    """``conv_id, turn, role, code``: courses that a turn's text names by their code, whatever its case, or by their name as it stands; each once.

    ``courses`` has ``code`` and ``course_name``; empty ones name nothing.  Codes and names
    are found by an equality join on what stands at each place of the text.
    """
    said = turns.select("conv_id", "turn", "role", "text").where("text is not null").withColumn("id", F.struct("conv_id", "turn", "role"))
    known = courses.where("code <> ''").select(F.upper("code").alias("code"), F.coalesce("course_name", F.lit("")).alias("course_name")).distinct()
    by_code = contained(said.select("id", F.upper("text").alias("t")), known, "id", "t", "code").select("id", F.col("name").alias("code"))
    by_name = contained(said.select("id", "text"), known, "id", "text", "course_name").join(known, F.col("name") == F.col("course_name")).select("id", "code")
    return by_code.union(by_name).distinct().select("id.*", "code")


def missing_of_category(turns: DataFrame, said: DataFrame, category: DataFrame) -> DataFrame:
    """``conv_id, turn, code``: for turns that ask what an answer left out, the courses of the asked category that the latest answer before them doesn't name.

    ``turns`` has ``conv_id, turn, category`` of such turns, ``said`` the courses named by
    turn, ``category`` the courses (``category, code``).  Turns without an earlier answer
    that names any course give no row.
    """
    answers = said.where("role = 'assistant'").select("conv_id", F.col("turn").alias("answered")).distinct()
    last = turns.join(answers, "conv_id").where("answered < turn").groupBy("conv_id", "turn", "category").agg(F.max("answered").alias("answered"))
    named = said.where("role = 'assistant'").select("conv_id", F.col("turn").alias("answered"), "code").distinct()
    return last.join(category.distinct(), "category").join(named, ["conv_id", "answered", "code"], "left_anti").select("conv_id", "turn", "code")


def latest_mentioned(said: DataFrame, role: str = "assistant") -> DataFrame:
    """``conv_id, turn, code`` of the latest turn of a role that names anything, per conversation."""
    of = said.where(F.col("role") == role)
    last = of.groupBy("conv_id").agg(F.max("turn").alias("turn"))
    return of.join(last, ["conv_id", "turn"]).select("conv_id", "turn", "code")


def unique_reference(said: DataFrame) -> DataFrame:
    """``conv_id, turn, code``: what "that course" means: the newest user turn that names exactly one course, else the newest other turn that does."""
    one = said.groupBy("conv_id", "turn", "role").agg(F.min("code").alias("code"), F.count("*").alias("n")).where("n = 1")
    best = one.groupBy("conv_id").agg(F.max(F.struct((F.col("role") == "user").alias("user"), "turn", "code")).alias("b"))
    return best.select("conv_id", F.col("b.turn").alias("turn"), F.col("b.code").alias("code"))


def history(turns: DataFrame, last: int = 8, chars: int = 1200) -> DataFrame:
    """The last messages of each conversation, cut, oldest first: ``conv_id, pos, role, text``."""
    recent = turns.withColumn("back", F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn")))).where(F.col("back") <= last)
    pos = F.row_number().over(W.partitionBy("conv_id").orderBy("turn"))
    return recent.select("conv_id", pos.alias("pos"), "role", F.substring(F.coalesce("text", F.lit("")), 1, chars).alias("text"))
