"""Streaming queries: each reads events as a file stream to its end and returns what the sink holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.shared import shared_folder
from ..streaming import runs as R
from .registry import load, query


def drained(spark: SparkSession, stream: DataFrame, mode: str, keys: tuple[str, ...] = ()) -> tuple[DataFrame, str]:
    """Run a stream over what is there now into Parquet files, a folder for each trigger; what is there, and the checkpoint.

    With keys, the rows of the last trigger that gave a key are the key's.
    """
    folder = shared_folder(spark, "stream")

    def keep(batch: DataFrame, number: int) -> None:  # a trigger that is run again writes the same folder
        batch.write.mode("overwrite").parquet(f"{folder}/rows/trigger={number}")

    stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(StructType([*stream.schema.fields, StructField("trigger", LongType())])).parquet(f"{folder}/rows")
    if keys:
        last = rows.groupBy(*keys).agg(F.max_by(F.struct(*stream.columns), "trigger").alias("_r"))
        rows = last.select("_r.*")
    return rows.select(*stream.columns), f"{folder}/checkpoint"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.readStream.schema(load(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/event[s].parquet")


@query("SELECT event_type, count(*) AS n_windows, CAST(sum(n) AS BIGINT) AS n FROM (SELECT event_type, date_trunc('hour', ts) AS w, count(*) AS n FROM events GROUP BY ALL) GROUP BY 1")
def st_windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling windows with a watermark over a stream."""
    e = event_stream(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    return drained(spark, R.windowed_counts(e, "ts", "event_type"), "update", ("start", "event_type"))[0].groupBy("event_type").agg(F.count("*").alias("n_windows"), F.sum("n").alias("n"))


@query("""WITH seen AS (SELECT user_id AS sequence, event_id AS f, (event_id % 10) / 10.0 AS confidence, (event_id // 40) % 3 * 5 AS x, lag(event_id) OVER q AS pf, lag((event_id // 40) % 3 * 5) OVER q AS px FROM events WHERE event_id % 6 <> 0 WINDOW q AS (PARTITION BY user_id ORDER BY event_id)),
r AS (SELECT *, CAST(sum(CASE WHEN pf IS NULL OR f - pf > 3 OR greatest(0, 20 - abs(x - px)) * 20.0 / (800 - greatest(0, 20 - abs(x - px)) * 20) < 0.55 THEN 1 ELSE 0 END) OVER (PARTITION BY sequence ORDER BY f) AS BIGINT) AS run FROM seen)
SELECT sequence, run, min(f) AS first_frame, max(f) AS last_frame, count(*) AS n, max(confidence) AS top, CAST(0 AS BIGINT) AS n_late FROM r GROUP BY sequence, run HAVING max(confidence) >= 0.5""")
def st_accepted_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run acceptance over a stream (W01, W03): the runs that have ended, and from the state those open at its end."""
    e = event_stream(spark, sf_dir)
    x = F.when(F.col("event_id") % 6 != 0, (F.expr("event_id div 40") % 3 * 5).cast("double"))
    frames = e.select(F.col("user_id").alias("sequence"), F.col("event_id").alias("frame_index"), (F.col("event_id") % 10 / 10.0).alias("confidence"), x.alias("x"), F.lit(0.0).alias("y"), F.lit(20.0).alias("w"), F.lit(20.0).alias("h"))
    ended, checkpoint = drained(spark, R.accepted_runs(frames, 0.0, 0.5, 1), "append")
    return ended.union(R.open_runs(spark, checkpoint, 0.5, 1))
