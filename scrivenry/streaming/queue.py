"""Stateful work: leases, retries, monitors and rates, as batch transitions and as streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scrivenry.functions import numbers as N
from scrivenry.sources import shared_dir


def claimable(now: Column) -> Column:
    """Whether a job can be taken: due and queued, or running on a lease that ended."""
    return ((F.col("status") == "queued") & (F.col("available_at") <= now)) | ((F.col("status") == "running") & (F.col("lease_expires_at") < now))


def claim(jobs: DataFrame, now: Column, limit: int = 10, lease_seconds: int = 300) -> DataFrame:
    """The jobs that each type's worker takes in one tick, first due first: at most 25, leased for 30 s to an hour."""
    limit, lease_seconds = max(1, min(limit, 25)), max(30, min(lease_seconds, 3600))
    at = Window.partitionBy("job_type").orderBy(F.coalesce("available_at", "created_at"), "created_at", "job_id")
    taken = jobs.filter(claimable(now)).withColumn("place", F.row_number().over(at).cast("long")).filter(F.col("place") <= limit)
    return taken.select("job_type", "job_id", "place", (F.col("attempts") + 1).alias("attempts"), (now + F.expr(f"INTERVAL {lease_seconds} SECOND")).alias("lease_expires_at"))


def failed(jobs: DataFrame, most_attempts: int = 3) -> DataFrame:
    """(job_id, next_status, delay_seconds): what becomes of jobs that failed: tried again later, or given up."""
    again = F.col("retryable") & (F.col("attempts") < most_attempts)
    return jobs.select("job_id", F.when(again, "queued").otherwise("dead_letter").alias("next_status"), F.when(again, N.backoff_seconds(F.col("attempts"))).alias("delay_seconds"))


def monitor_scan(monitors: DataFrame, docs: DataFrame, seen: DataFrame, most: int = 100) -> DataFrame:
    """(monitor_id, doc_id, fingerprint, found, advance): new documents for each monitor, oldest first.

    ``monitors``: (monitor_id, jurisdiction_code, topic, since); a null topic takes all. The mark of
    a monitor advances only if fewer than ``most`` were found.
    """
    topic = F.col("topic").isNull() | F.array_contains(F.split(F.lower(F.coalesce("title", F.lit(""))), r"[^\p{L}\p{N}]+"), F.col("topic"))
    hits = docs.join(F.broadcast(monitors), "jurisdiction_code").filter(topic & (F.col("retrieved_at") >= F.col("since")))
    hits = hits.withColumn("fingerprint", F.concat_ws(":", F.lit("monitor"), "monitor_id", "doc_id", "content_hash"))
    fresh = hits.join(seen.select("fingerprint"), "fingerprint", "left_anti")
    at = Window.partitionBy("monitor_id").orderBy("retrieved_at", "doc_id")
    kept = fresh.withColumn("at", F.row_number().over(at)).filter(F.col("at") <= most)
    found = F.count("*").over(Window.partitionBy("monitor_id"))
    return kept.select("monitor_id", "doc_id", "fingerprint", found.alias("found"), (found < most).alias("advance"))


def over_rate(events: DataFrame, most: int = 8, seconds: int = 3600) -> DataFrame:
    """(event_id, user_id, in_window): events of users who already had ``most`` others in the seconds before."""
    when = F.unix_micros(F.col("ts").cast("timestamp"))
    at = Window.partitionBy("user_id").orderBy(F.col("us")).rangeBetween(-seconds * 1_000_000, -1)
    counted = events.withColumn("us", when).withColumn("in_window", F.count("*").over(at))
    return counted.filter(F.col("in_window") >= most).select("event_id", "user_id", "in_window")


def windowed_stream(spark: SparkSession, folder: str, name: str, minutes: int = 60, late: str = "1 hour") -> DataFrame:
    """(window_start, event_type, n, total) from a stream over the events, with a watermark; each micro-batch replaces the windows it touched.

    The stream ends when all that is there has been read. State is kept in the shared folder.
    """
    schema = spark.read.parquet(f"{folder}/{name}").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder).withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    counts = stream.groupBy(F.window("at", f"{minutes} minutes").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    counts = counts.select(F.unix_seconds("w.start").alias("window_start"), "event_type", "n", "total")
    out = f"{shared_dir(spark)}/scrivenry/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("append").parquet(f"{out}/rows")

    query = counts.writeStream.outputMode("update").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    rows = spark.read.parquet(f"{out}/rows")
    return rows.groupBy("window_start", "event_type").agg(F.max_by("n", "batch").alias("n"), F.max_by("total", "batch").alias("total"))
