"""Record schema, severities, and the canonical log view over an events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Severities in order; the position is the persisted id (fixed values).
LEVELS = ["TRACE", "DEBUG", "INFO", "WARN", "ERROR"]
#: A token that is read as another severity (fixed value).
LEVEL_ALIASES = {"FATAL": "ERROR"}
MAX_OFFSET = (1 << 32) - 1
MAX_TRUNK_RECORDS = 65_535
MAX_TRUNKS = (1 << 24) - 1
DEFAULT_PATTERN = "[%logger] [%context] %message"
RECORD_SCHEMA = (
    "timestamp_millis long, offset_millis long, level string, level_id int, source string, context string, "
    "message string, attributes map<string,string>, file string, trunk_index int, record_index long, buffered boolean"
)
VIRTUAL_TRUNK = 512


def events_as_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as log records in virtual trunks of ``VIRTUAL_TRUNK``."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    ids = {"view": 0, "click": 1, "signup": 2, "purchase": 3, "error": 4}
    level = F.lit(None).cast("int")
    for name, i in ids.items():
        level = F.when(F.col("event_type") == name, F.lit(i)).otherwise(level)
    out = ev.select(
        F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp_millis"),
        level.alias("level_id"),
        F.lit("events").alias("source"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("context"),
        F.concat(F.col("event_type"), F.lit(" user="), F.col("user_id").cast("string"), F.lit(" props="), F.col("props")).alias("message"),
        F.col("event_id").alias("record_index"),
        F.floor(F.col("event_id") / VIRTUAL_TRUNK).cast("int").alias("trunk_index"),
        "user_id",
    )
    return out.withColumn("level", F.element_at(F.array(*[F.lit(x) for x in LEVELS]), F.col("level_id") + 1))
