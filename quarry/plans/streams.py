"""Event queries: windows, admission, caches, and Structured Streaming over the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.storage import scratch
from ..functions.text import normalize_question
from ..sources.tables import table
from ..streaming import admission as A


def sliding_window_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the user in the hour that ends with each event."""
    return A.window_counts(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 3600)


def sliding_admission(spark, sf_dir):
    """Which turns a limit of two accepted per client and minute lets through."""
    t = table(spark, sf_dir, "chat_turns").where("client_digest is not null")
    return A.admit(t, "client_digest", "asked_at", "log_id", 2, 60)


def ttl_cache_hits(spark, sf_dir):
    """Which questions a cache of two answers per client, kept for ten minutes, has at hand."""
    t = table(spark, sf_dir, "chat_turns").where("role = 'user' and client_digest is not null and text is not null").withColumn("question", normalize_question(F.col("text")))
    return A.cache_hits(t, "client_digest", "question", "asked_at", "log_id", 2, 600)


def event_bursts(spark, sf_dir):
    """Bursts per client: turns less than two minutes apart."""
    t = table(spark, sf_dir, "chat_turns").where("client_digest is not null and asked_at is not null").withColumn("at", F.unix_micros(F.col("asked_at").cast("timestamp")))
    b = A.bursts(t.select("client_digest", "at"), "client_digest", "at", 120 * A.MICRO)
    return b.groupBy("client_digest", "burst").agg(F.count("*").alias("n"), F.max("at").alias("last"))


def client_admission(spark, sf_dir):
    """Which turns get through with two accepted per client and minute, 50 clients at once and ten minutes for each."""
    return A.admit_clients(table(spark, sf_dir, "chat_turns"), "client_digest", "asked_at", "log_id", 2, 60, 50, 600)


def budget_admission(spark, sf_dir):
    """Which answers a budget of three an hour for all together lets through."""
    return A.admit_all(table(spark, sf_dir, "chat_turns").where("role = 'assistant'"), "asked_at", "log_id", 3, 3600)


def repeated_questions(spark, sf_dir):
    """User questions that the same client asked in the same words within the ten minutes before."""
    t = table(spark, sf_dir, "chat_turns").where("role = 'user' and client_digest is not null and text is not null").withColumn("question", normalize_question(F.col("text")))
    keyed = t.withColumn("asked", F.struct("client_digest", "question"))
    return A.window_counts(keyed, "asked", "asked_at", "log_id", 600).where("n > 1")


def _to_table(stream: DataFrame, spark: SparkSession) -> DataFrame:
    """Run a stream over what is there, into a table in the shared folder."""
    at = scratch(spark, "stream")
    q = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


#: Files that the events come in, each a micro-batch of its own.
FILES = 3


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of several files, in the order in which they came in."""
    e = table(spark, sf_dir, "events")
    at = scratch(spark, "landed")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    edges = e.select(micros.alias("t")).approxQuantile("t", [k / FILES for k in range(1, FILES)], 0.001)
    part = sum((F.coalesce(micros >= F.lit(x), F.lit(False)).cast("int") for x in edges), F.lit(0)).alias("part")
    kept = e.withColumn("part", part)
    for k in range(FILES):  # one after the other: a source takes older files first
        kept.where(F.col("part") == k).drop("part").coalesce(1).write.parquet(f"{at}/part={k}")
    return spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/part=*")


def stream_window_counts(spark, sf_dir):
    """Events and values per type and hour, for the hours that the watermark (ten minutes behind the latest event) has passed."""
    e = _events(spark, sf_dir).withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "10 minutes")
    agg = e.groupBy(F.window("at", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return _to_table(agg.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", "total"), spark)


def stream_admission(spark, sf_dir):
    """Admission of two events per user and hour, by a stateful stream of several micro-batches."""
    return _to_table(A.admit_stream(_events(spark, sf_dir), "user_id", "ts", "event_id", 2, 3600), spark).select("event_id", "accepted")


def batch_admission(spark, sf_dir):
    """The same by the batch operator."""
    return A.admit(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 2, 3600)


_ADMIT = """WITH RECURSIVE e AS (SELECT {tie} AS tie, {key} AS k, epoch_us({ts}) AS us, row_number() OVER (PARTITION BY {key} ORDER BY {ts}, {tie}) AS i FROM {of} WHERE {ts} IS NOT NULL AND {key} IS NOT NULL),
    r AS (
      SELECT k, i, tie, TRUE AS accepted, [us] AS kept FROM e WHERE i = 1
      UNION ALL
      SELECT e.k, e.i, e.tie, len(list_filter(r.kept, lambda t: e.us - t < {w})) < {limit},
             CASE WHEN len(list_filter(r.kept, lambda t: e.us - t < {w})) < {limit} THEN list_append(list_filter(r.kept, lambda t: e.us - t < {w}), e.us) ELSE list_filter(r.kept, lambda t: e.us - t < {w}) END
      FROM r JOIN e ON e.k = r.k AND e.i = r.i + 1)
    SELECT tie AS {tie}, accepted FROM r"""

SQL = {
    "sliding_window_count": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS n FROM events WHERE ts IS NOT NULL",
    "sliding_admission": _ADMIT.format(tie="log_id", key="client_digest", ts="asked_at", of="chat_turns", w=60_000_000, limit=2),
    "batch_admission": _ADMIT.format(tie="event_id", key="user_id", ts="ts", of="events", w=3_600_000_000, limit=2),
    "stream_admission": _ADMIT.format(tie="event_id", key="user_id", ts="ts", of="events", w=3_600_000_000, limit=2),
    "stream_window_counts": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2 HAVING hour + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)",
    "budget_admission": _ADMIT.format(tie="log_id", key="1", ts="asked_at", of="(SELECT * FROM chat_turns WHERE role = 'assistant')", w=3_600_000_000, limit=3).replace("1 IS NOT NULL", "TRUE"),
    "repeated_questions": """WITH q AS (SELECT log_id, client_digest, epoch_us(asked_at) AS us, trim(regexp_replace(trim(regexp_replace(lower(text), '[ \\t\\n\\f\\r]+', ' ', 'g')), '[?!.,。！？]+$', '')) AS question FROM chat_turns WHERE role = 'user' AND client_digest IS NOT NULL AND text IS NOT NULL AND asked_at IS NOT NULL)
        SELECT log_id, n FROM (SELECT log_id, count(*) OVER (PARTITION BY client_digest, question ORDER BY us RANGE BETWEEN 599999999 PRECEDING AND CURRENT ROW) AS n FROM q) WHERE n > 1""",
    "event_bursts": """WITH e AS (SELECT client_digest, epoch_us(asked_at) AS us FROM chat_turns WHERE client_digest IS NOT NULL AND asked_at IS NOT NULL),
        p AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY client_digest ORDER BY us) < 120000000 THEN 0 ELSE 1 END AS s FROM e),
        g AS (SELECT *, sum(s) OVER (PARTITION BY client_digest ORDER BY us, s DESC ROWS UNBOUNDED PRECEDING) AS g FROM p)
        SELECT client_digest, min(us) AS burst, count(*) AS n, max(us) AS last FROM g GROUP BY client_digest, g""",
}
QUERIES = {f.__name__: f for f in (sliding_window_count, sliding_admission, ttl_cache_hits, event_bursts, stream_window_counts, stream_admission, batch_admission, client_admission, budget_admission, repeated_questions)}
