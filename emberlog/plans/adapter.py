"""The test tables as logs: ``events`` as entries of four sources, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import severity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, line_no, raw, message, level, ts, fields) from ``events``."""
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    level = F.when((kind == "error") & (F.col("value") >= 75), 50).when(kind == "error", 40).when((kind == "purchase") & (F.col("value") >= 50), 30).when(kind == "signup", 25).otherwise(20)
    message = F.concat(F.lit("["), kind, F.lit("] user "), F.col("user_id").cast("string"), F.lit(" took "), F.round("value").cast("long").cast("string"), F.lit("ms k="), F.regexp_extract("props", "[0-9]+", 0))
    out = e.select(F.concat(F.lit("shard"), (F.col("user_id") % 4).cast("string")).alias("source"), (F.col("event_id") + 1).alias("line_no"), message.alias("message"), level.alias("level"), F.col("ts").cast("timestamp").alias("ts"))
    raw = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" "), severity.level_name(F.col("level")), F.lit(" "), F.col("message"))
    return out.select("source", "line_no", raw.alias("raw"), "message", "level", "ts", F.create_map().cast("map<string,string>").alias("fields"))


ENTRIES_SQL = """
ent AS (
  SELECT 'shard' || CAST(user_id % 4 AS VARCHAR) AS source, event_id + 1 AS line_no, ts,
    CASE WHEN event_type = 'error' AND value >= 75 THEN 50 WHEN event_type = 'error' THEN 40
         WHEN event_type = 'purchase' AND value >= 50 THEN 30 WHEN event_type = 'signup' THEN 25 ELSE 20 END AS level,
    '[' || event_type || '] user ' || CAST(user_id AS VARCHAR) || ' took ' || CAST(CAST(round(value) AS BIGINT) AS VARCHAR) || 'ms k=' || regexp_extract(props, '[0-9]+') AS message
  FROM events),
lin AS (
  SELECT *, strftime(ts, '%Y-%m-%d %H:%M:%S') || ' '
    || CASE level WHEN 50 THEN 'CRITICAL' WHEN 40 THEN 'ERROR' WHEN 30 THEN 'WARNING' WHEN 25 THEN 'NOTICE' ELSE 'INFO' END || ' ' || message AS raw
  FROM ent)"""


def sql_literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def normalize_sql(column: str) -> str:
    """The template rules in DuckDB's regular expressions."""
    from ..functions.text import TEMPLATE_RULES

    out = rf"regexp_replace({column}, '^\s+|\s+$', '', 'g')"
    for pattern, placeholder in TEMPLATE_RULES:
        out = f"regexp_replace({out}, {sql_literal(pattern)}, '{placeholder}', 'g')"
    return f"trim({out})"


def clusters_sql(least: int = 30) -> str:
    return f"""
tem AS (SELECT *, {normalize_sql('message')} AS template FROM ent WHERE level >= {least}),
clu AS (
  SELECT source, template, level, count(*) AS count, count(ts) AS timed, min(line_no) AS first_line, arg_min(message, line_no) AS rep_message,
    min(ts) AS first_seen, max(ts) AS last_seen, level * 1000 + ln(1 + count(*)) AS score
  FROM tem GROUP BY source, template, level),
ran AS (
  SELECT *, nullif(regexp_extract(template, '^[\\s>]*[\\[(]([A-Za-z0-9_.\\-/]+)[\\])]', 1), '') AS component,
    row_number() OVER (PARTITION BY source ORDER BY score DESC, first_line) AS rank
  FROM clu)"""
