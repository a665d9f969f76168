"""The registered queries and the DuckDB SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scoring, severity, text
from ..operators import anomaly, clusters, correlation, digests, drain, parsing, semantic
from ..scratch import folder, kept
from ..sinks import push
from ..sources import text as sources
from ..streaming import live
from .adapter import ENTRIES_SQL, clusters_sql, entries, normalize_sql, sql_literal, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

BASE = f"WITH {ENTRIES_SQL}"
RANKED = f"WITH {ENTRIES_SQL}, {clusters_sql()}"
WIDTH = 3600  # seconds of a bucket where the automatic width would hide the shape


def _query(name: str, sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def _six(*columns: str):
    return [F.round(c, 6).alias(c) for c in columns]


def _clusters(spark: SparkSession, sf_dir: str, top: int | None = None) -> tuple[DataFrame, DataFrame]:
    return clusters.cluster_and_rank(entries(spark, sf_dir), top)


# --- parsing ---------------------------------------------------------------------------------------------------------


@_query("top_error_signatures", f"{RANKED} SELECT source, template, level, count, first_line, rep_message, component, rank FROM ran WHERE rank <= 10")
def _top(spark, sf_dir):
    return _clusters(spark, sf_dir, 10)[1].select("source", "template", "level", "count", "first_line", "rep_message", "component", "rank")


def _parsed(spark, sf_dir, raw, fmt):
    lines = entries(spark, sf_dir).select("source", "line_no", raw.alias("raw"))
    return lines.withColumn("e", parsing.parse_with(F.col("raw"), fmt)).select("source", "line_no", "e.message", "e.level", "e.ts", "e.fields")


@_query("parse_text_events", f"{BASE} SELECT source, line_no, message, level, date_trunc('second', ts) AS ts FROM lin")
def _parse_text(spark, sf_dir):
    return _parsed(spark, sf_dir, F.col("raw"), "text").drop("fields")


@_query("parse_jsonl_events", f"{BASE} SELECT source, line_no, message, CASE WHEN level = 20 THEN NULL ELSE level END AS level, date_trunc('second', ts) AS ts, 'svc' AS service FROM ent")
def _parse_json(spark, sf_dir):
    name = F.when(F.col("level") == 20, F.lit(None)).otherwise(severity.level_name(F.col("level")))
    raw = F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.lower(name).alias("level"), F.col("message").alias("msg"), F.lit("svc").alias("service")))
    return _parsed(spark, sf_dir, raw, "json").withColumn("service", F.try_element_at("fields", F.lit("service"))).drop("fields")


@_query("parse_logfmt_events", f"{BASE} SELECT source, line_no, message, level, date_trunc('second', ts) AS ts, '2' AS seen FROM ent")
def _parse_logfmt(spark, sf_dir):
    raw = F.concat(F.lit("ts="), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(" LEVEL="), F.lower(severity.level_name(F.col("level"))), F.lit(' seen=1 msg="'), F.col("message"), F.lit('" seen=2'))
    return _parsed(spark, sf_dir, raw, "logfmt").withColumn("seen", F.try_element_at("fields", F.lit("seen"))).drop("fields")


@_query(
    "parse_clf_events",
    f"""{BASE} SELECT source, line_no, 'GET /u/' || line_no || ' -> ' || CAST(100 + level * 10 AS VARCHAR) AS message,
    CASE WHEN 100 + level * 10 >= 500 THEN 40 WHEN 100 + level * 10 >= 400 THEN 30 ELSE 20 END AS level, date_trunc('second', ts) AS ts, '10.0.0.1' AS ip FROM ent""",
)
def _parse_clf(spark, sf_dir):
    raw = F.concat(F.lit("10.0.0.1 - - ["), F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), F.lit(' +0000] "GET /u/'), F.col("line_no").cast("string"), F.lit(' HTTP/1.1" '), (100 + F.col("level") * 10).cast("string"), F.lit(' 12 "-" "curl"'))
    return _parsed(spark, sf_dir, raw, "clf").withColumn("ip", F.try_element_at("fields", F.lit("ip"))).drop("fields")


@_query(
    "parse_syslog_events",
    f"""{BASE} SELECT source, line_no, '[app] ' || message AS message, CASE line_no % 8 WHEN 0 THEN 50 WHEN 1 THEN 50 WHEN 2 THEN 50 WHEN 3 THEN 40 WHEN 4 THEN 30 WHEN 5 THEN 25 WHEN 6 THEN 20 ELSE 10 END AS level,
    CASE WHEN line_no % 2 = 0 THEN date_trunc('second', ts) ELSE make_timestamp(1900, month(ts), day(ts), hour(ts), minute(ts), CAST(second(ts) AS DOUBLE)) END AS ts FROM ent""",
)
def _parse_syslog(spark, sf_dir):
    pri = F.concat(F.lit("<"), (16 * 8 + F.col("line_no") % 8).cast("string"), F.lit(">"))
    new = F.concat(pri, F.lit("1 "), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(" host app 4711 ID47 - "), F.col("message"))
    old = F.concat(pri, F.date_format("ts", "MMM d HH:mm:ss"), F.lit(" host app[77]: "), F.col("message"))
    return _parsed(spark, sf_dir, F.when(F.col("line_no") % 2 == 0, new).otherwise(old), "syslog").drop("fields")


def _conversation_lines(spark, sf_dir):
    split = table(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), (F.col("conv_id") % 5).cast("string")).alias("source"), "conv_id", "turn", F.posexplode(F.split(F.concat(F.col("text"), F.lit("\n  at frame\n\n")), "\n")).alias("k", "value"))
    n = F.row_number().over(Window.partitionBy("source").orderBy("conv_id", "turn", "k"))
    return split.select("source", n.cast("long").alias("n"), "value")


LINES_SQL = r"""
WITH raw AS (SELECT 'c' || CAST(conv_id % 5 AS VARCHAR) AS source, conv_id, turn, string_split(text || chr(10) || '  at frame' || chr(10) || chr(10), chr(10)) AS parts FROM conversations),
spl AS (SELECT source, conv_id, turn, unnest(parts) AS value, generate_subscripts(parts, 1) AS k FROM raw),
num AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY conv_id, turn, k) AS n, value FROM spl),
sta AS (SELECT *, CASE WHEN n = 1 OR trim(value) = '' OR NOT regexp_matches(value, @) THEN 1 ELSE 0 END AS s FROM num),
rec AS (SELECT source, n, value, sum(s) OVER (PARTITION BY source ORDER BY n ROWS UNBOUNDED PRECEDING) AS r FROM sta)
""".replace("@", sql_literal(parsing.CONTINUATION.removeprefix("(?U)").replace('\\"', '"')))


@_query("stitch_multiline", LINES_SQL + "SELECT source, CAST(r AS BIGINT) AS n, string_agg(value, chr(10) ORDER BY n) AS value FROM rec GROUP BY source, r")
def _stitch(spark, sf_dir):
    return parsing.stitch_lines(_conversation_lines(spark, sf_dir))


@_query("detect_format", "SELECT * FROM (VALUES ('j', 'json'), ('l', 'logfmt'), ('m', 'text'), ('s', 'syslog'), ('t', 'text'), ('w', 'clf')) AS t(source, format)")
def _detect(spark, sf_dir):
    e = entries(spark, sf_dir).select("line_no", "raw", "message")
    stamp = F.lit("2026-06-14T09:03:14Z")
    shapes = {
        "t": F.col("raw"),
        "j": F.to_json(F.struct("message")),
        "l": F.concat(F.lit('level=info msg="'), F.col("message"), F.lit('"')),
        "s": F.concat(F.lit("<34>1 "), stamp, F.lit(" host app 1 - - "), F.col("message")),
        "w": F.concat(F.lit('1.2.3.4 - - [14/Jun/2026:09:03:14 +0000] "GET / HTTP/1.1" 200 '), F.col("line_no").cast("string")),
        "m": F.when(F.col("line_no") % 2 == 0, F.to_json(F.struct("message"))).otherwise(F.col("raw")),
    }
    lines = e.select(F.explode(F.create_map(*[x for k, v in shapes.items() for x in (F.lit(k), v)])).alias("source", "value"), F.col("line_no").alias("n"))
    return parsing.detect_formats(lines)


@_query("severity_filter", f"{BASE} SELECT source, line_no, level, CASE level WHEN 50 THEN 'CRITICAL' WHEN 40 THEN 'ERROR' ELSE 'WARNING' END AS level_name FROM ent WHERE level >= 30")
def _filter(spark, sf_dir):
    return entries(spark, sf_dir).where(severity.at_least(F.col("level"), 30)).select("source", "line_no", "level", severity.level_name(F.col("level")).alias("level_name"))


def _signs(level: int) -> str:
    return sql_literal("|".join(dict(severity.SIGNS)[level]))


@_query("infer_severity", f"SELECT doc_id, CASE WHEN regexp_matches(lower(text), {_signs(50)}) THEN 50 WHEN regexp_matches(lower(text), {_signs(40)}) THEN 40 WHEN regexp_matches(lower(text), {_signs(30)}) THEN 30 END AS level FROM documents")
def _infer(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.lit("d").alias("source"), "doc_id", F.col("text").alias("message"), F.lit(None).cast("int").alias("level"))
    return parsing.infer_levels(d).select("doc_id", "level")


# --- templates, redaction --------------------------------------------------------------------------------------------


@_query("normalize_events", f"{BASE} SELECT source, line_no, {normalize_sql('message')} AS template FROM ent")
def _normalize_events(spark, sf_dir):
    return entries(spark, sf_dir).select("source", "line_no", text.normalize(F.col("message")).alias("template"))


@_query("normalize_documents", f"SELECT doc_id, {normalize_sql('text')} AS template FROM documents")
def _normalize_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.normalize(F.col("text")).alias("template"))


@_query("normalize_pages", f"SELECT page_id, {normalize_sql('url')} AS template FROM pages")
def _normalize_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.normalize(F.col("url")).alias("template"))


#: DuckDB knows no word boundary beside accented letters, so a card number whose last separator such a letter follows is taken first.
FAR_CARD = r"\b((?:\d[ -]?){12,15}\d[ -])([^\x00-\x7f])"


def _redact_sql(column: str, before: str | None = None) -> str:
    out = column
    for kind, pattern in text.SECRETS:
        if kind == before:
            break
        if kind == "CREDITCARD":
            out = rf"regexp_replace({out}, {sql_literal(FAR_CARD)}, 'farcard\2', 'g')"  # a word, as the number was
        out = f"regexp_replace({out}, {sql_literal(pattern)}, '[REDACTED:{kind}]', 'g')"
        if kind == "CREDITCARD":
            out = f"replace({out}, 'farcard', '[REDACTED:{kind}]')"
    return out


def _count_sql(kind: str, pattern: str) -> str:
    so_far = _redact_sql("text", kind)
    if kind != "CREDITCARD":
        return f"CAST(len(regexp_extract_all({so_far}, {sql_literal(pattern)})) AS INTEGER) AS {kind.lower()}"
    far = rf"regexp_replace({so_far}, {sql_literal(FAR_CARD)}, 'farcard\2', 'g')"
    return f"CAST(len(regexp_extract_all({so_far}, {sql_literal(FAR_CARD)})) + len(regexp_extract_all({far}, {sql_literal(pattern)})) AS INTEGER) AS {kind.lower()}"


@_query("redact_text", f"SELECT doc_id, {_redact_sql('text')} AS redacted FROM documents")
def _redact(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.redact(F.col("text")).alias("redacted"))


@_query("redact_counts", f"SELECT doc_id, {', '.join(_count_sql(k, p) for k, p in text.SECRETS)} FROM documents")
def _redact_counts(spark, sf_dir):
    counted = text.redact_counted(table(spark, sf_dir, "documents"), "text")
    return counted.select("doc_id", *[F.coalesce(F.try_element_at("counts", F.lit(k)), F.lit(0)).alias(k.lower()) for k in text.KINDS])


@_query("signature_hash", f"{BASE} SELECT source, line_no, substr(sha1({normalize_sql('message')}), 1, 10) AS signature FROM ent")
def _signature(spark, sf_dir):
    return entries(spark, sf_dir).select("source", "line_no", text.signature(F.col("message")).alias("signature"))


# --- clusters --------------------------------------------------------------------------------------------------------


@_query("cluster_regex", f"{RANKED} SELECT source, template, level, count, timed, first_line, rep_message, first_seen, last_seen, round(score, 6) AS score FROM ran")
def _cluster(spark, sf_dir):
    return _clusters(spark, sf_dir)[1].select("source", "template", "level", "count", "timed", "first_line", "rep_message", "first_seen", "last_seen", *_six("score"))


@_query("component_rollup", f"{RANKED} SELECT source, component, count(*) AS clusters, CAST(sum(count) AS BIGINT) AS events FROM ran GROUP BY source, component")
def _rollup(spark, sf_dir):
    return _clusters(spark, sf_dir)[1].groupBy("source", "component").agg(F.count(F.lit(1)).alias("clusters"), F.sum("count").alias("events"))


@_query(
    "loki_streams",
    f"""{BASE}, row_ AS (SELECT source, CASE level WHEN 50 THEN 'critical' WHEN 40 THEN 'error' WHEN 30 THEN 'warning' WHEN 25 THEN 'notice' ELSE 'info' END AS level_name,
    substr(sha1({normalize_sql('message')}), 1, 10) AS cluster, epoch_us(ts) * 1000 AS ts_ns, epoch_us(ts) // 3600000000 AS slice, line_no, raw FROM lin)
    SELECT source, level_name, cluster, slice, count(*) AS n, sha1(string_agg(CAST(ts_ns AS VARCHAR) || ' ' || raw, chr(10) ORDER BY ts_ns, line_no)) AS digest FROM row_ GROUP BY source, level_name, cluster, slice""",
)
def _streams(spark, sf_dir):
    s = clusters.streams(entries(spark, sf_dir))
    line = F.array_join(F.transform("values", lambda v: F.concat(v["ts_ns"].cast("string"), F.lit(" "), v["line"])), "\n")
    return s.select("source", "level_name", "cluster", "slice", F.size("values").cast("long").alias("n"), F.sha1(line).alias("digest"))


HALF = "(SELECT max(event_id) / 2 FROM events)"


@_query(
    "diff_signatures",
    f"""{BASE}, tem AS (SELECT *, {normalize_sql('message')} AS template, line_no - 1 <= {HALF} AS early FROM ent WHERE level >= 30),
    clu AS (SELECT early, template, level, count(*) AS count, level * 1000 + ln(1 + count(*)) AS score, min(line_no) AS first_line FROM tem GROUP BY early, template, level),
    ran AS (SELECT *, row_number() OVER (PARTITION BY early ORDER BY score DESC, first_line) AS rank FROM clu),
    one AS (SELECT * FROM ran QUALIFY row_number() OVER (PARTITION BY early, template ORDER BY rank DESC) = 1),
    joi AS (SELECT coalesce(a.template, b.template) AS template, coalesce(a.level, b.level) AS level, coalesce(b.count, 0) AS before, coalesce(a.count, 0) AS after
      FROM (SELECT * FROM one WHERE early) b FULL JOIN (SELECT * FROM one WHERE NOT early) a ON a.template = b.template)
    SELECT template, level, before, after, after - before AS delta,
      CASE WHEN before = 0 THEN 'new' WHEN after = 0 THEN 'resolved' WHEN after > before THEN 'worsened' WHEN after < before THEN 'improved' ELSE 'unchanged' END AS status FROM joi""",
)
def _diff(spark, sf_dir):
    middle = table(spark, sf_dir, "events").agg((F.max("event_id") / 2).alias("middle"))
    e = entries(spark, sf_dir).crossJoin(F.broadcast(middle)).withColumn("source", F.lit("all"))  # one row
    early = F.col("line_no") - 1 <= F.col("middle")
    before, after = clusters.cluster_and_rank(e.where(early))[1], clusters.cluster_and_rank(e.where(~early))[1]
    return clusters.diff_clusters(before, after).drop("order")


@_query("diff_status_counts", ORACLE_SQL["diff_signatures"].replace("SELECT template, level, before, after, after - before AS delta,", "SELECT status, count(*) AS count FROM (SELECT") + ") GROUP BY status")
def _status_counts(spark, sf_dir):
    return clusters.status_counts(_diff(spark, sf_dir))


@_query("cluster_totals", f"{RANKED} SELECT source, count(*) AS clusters, CAST(sum(count) AS BIGINT) AS total FROM ran GROUP BY source")
def _totals(spark, sf_dir):
    return clusters.totals(_clusters(spark, sf_dir)[1])


@_query("severe_total", f"{BASE} SELECT count(*) AS n FROM ent WHERE level >= 40")
def _severe(spark, sf_dir):
    return clusters.severe_total(entries(spark, sf_dir))


@_query("line_filter", f"{BASE} SELECT source, line_no, raw FROM lin WHERE contains(lower(raw), 'error') AND NOT contains(raw, 'k=7')")
def _line_filter(spark, sf_dir):
    return clusters.line_filter(entries(spark, sf_dir), contains="ERROR", without="k=7", case=False).select("source", "line_no", "raw")


@_query("clock_times", f"{BASE} SELECT source, line_no, CASE WHEN line_no % 10 = 0 THEN '--:--:--' ELSE strftime(ts, '%H:%M:%S') END AS clock FROM ent")
def _clock(spark, sf_dir):
    return entries(spark, sf_dir).select("source", "line_no", text.clock(F.when(F.col("line_no") % 10 != 0, F.col("ts"))).alias("clock"))


@_query("component_from_fields", f"{BASE}, tem AS (SELECT *, {normalize_sql('message')} AS template FROM ent WHERE level >= 30) SELECT source, template, level, count(*) AS count, 'svc' || arg_min(line_no, line_no) % 3 AS component FROM tem GROUP BY source, template, level")
def _field_components(spark, sf_dir):
    """Components that JSON lines name in their fields, of the earliest line of each cluster."""
    e = entries(spark, sf_dir).where("level >= 30")
    service = F.concat(F.lit(" svc"), (F.col("line_no") % 3).cast("string"), F.lit(" "))
    raw = F.to_json(F.struct(F.lower(severity.level_name(F.col("level"))).alias("level"), F.col("message").alias("msg"), F.lit(7).alias("component"), service.alias("service")))
    parsed = e.select("source", "line_no", raw.alias("raw")).withColumn("e", parsing.parse_with(F.col("raw"), "json")).select("source", "line_no", "raw", "e.*")
    return clusters.cluster_and_rank(parsed)[1].select("source", "template", "level", "count", "component")


def _written(spark, sf_dir) -> str:
    """Every third entry of the four logs, a file each, in four shapes of line; shard3's is compressed."""
    e = entries(spark, sf_dir).where("line_no % 3 = 0")
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    name = severity.level_name(F.col("level"))
    shape = (
        F.when(F.col("source") == "shard0", F.col("raw"))
        .when(F.col("source") == "shard1", F.to_json(F.struct(stamp.alias("timestamp"), F.lower(name).alias("level"), F.col("message").alias("msg"))))
        .when(F.col("source") == "shard2", F.concat(F.lit("ts="), stamp, F.lit(" level="), F.lower(name), F.lit(' msg="'), F.col("message"), F.lit('"')))
        .otherwise(F.concat(F.lit("<"), (8 * 16 + F.when(F.col("level") == 50, 2).when(F.col("level") == 40, 3).when(F.col("level") == 30, 4).when(F.col("level") == 25, 5).otherwise(6)).cast("string"), F.lit(">1 "), stamp, F.lit(" host app 1 - - "), F.col("message")))
    )
    where = folder(spark, "logs")
    lines = e.select("source", "line_no", shape.alias("value"))
    for source in ("shard0", "shard1", "shard2", "shard3"):
        file = lines.where(F.col("source") == source).repartition(1).sortWithinPartitions("line_no").select("value")
        file.write.option("compression", "gzip" if source == "shard3" else "none").text(f"{where}/{source}")
    return where


@_query(
    "read_files",
    f"""{BASE}, pic AS (SELECT *, row_number() OVER (ORDER BY source, line_no) AS n FROM ent WHERE line_no % 3 = 0)
    SELECT n AS line_no, level, date_trunc('second', ts) AS ts, CASE WHEN source = 'shard3' THEN '[app] ' || message ELSE message END AS message FROM pic""",
)
def _read_files(spark, sf_dir):
    """Plain and compressed files found below a folder, their formats detected, read as one log."""
    lines = sources.read_lines(spark, _written(spark, sf_dir))
    return sources.renumber(parsing.parse_lines(lines)).select("line_no", "level", "ts", "message")


@_query("log_volume_by_level", f"{BASE} SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, level, count(*) AS n FROM ent GROUP BY 1, 2")
def _volume(spark, sf_dir):
    return entries(spark, sf_dir).groupBy(F.window("ts", "1 hour").alias("w"), "level").count().select(F.col("w.start").alias("start"), "level", F.col("count").alias("n"))


@_query("top_error_clusters", f"{BASE} SELECT substr(sha1({normalize_sql('message')}), 1, 10) AS cluster, level, count(*) AS n FROM ent WHERE level >= 40 GROUP BY ALL ORDER BY n DESC, cluster, level LIMIT 15")
def _top_clusters(spark, sf_dir):
    e = entries(spark, sf_dir).where("level >= 40").groupBy(text.signature(F.col("message")).alias("cluster"), "level").agg(F.count(F.lit(1)).alias("n"))
    return e.orderBy(F.desc("n"), "cluster", "level").limit(15)


# --- time ------------------------------------------------------------------------------------------------------------

LADDER = "CASE " + " ".join(f"WHEN span / {w} <= {anomaly.MOST_BUCKETS} THEN {w}" for w in anomaly.WIDTHS) + f" ELSE {anomaly.WIDTHS[-1]} END"
GRID = f"""
spa AS (SELECT source, min(ts) AS origin, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS span FROM ent WHERE ts IS NOT NULL GROUP BY source),
cnt AS (SELECT e.source, (epoch_us(ts) - epoch_us(origin)) // {WIDTH * 1_000_000} AS idx, count(*) AS total, count(*) FILTER (level >= 40) AS errors, count(*) FILTER (level BETWEEN 30 AND 39) AS warnings
  FROM ent e JOIN spa USING (source) GROUP BY 1, 2),
slo AS (SELECT source, origin, unnest(generate_series(0, CAST(floor(span / {WIDTH}) AS BIGINT))) AS idx FROM spa),
buc AS (SELECT source, idx, make_timestamp(epoch_us(origin) + idx * {WIDTH * 1_000_000}) AS start, coalesce(total, 0) AS total, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings
  FROM slo LEFT JOIN cnt USING (source, idx))"""
TIMED = f"WITH RECURSIVE {ENTRIES_SQL}, {GRID}"


def _buckets(spark, sf_dir):
    return anomaly.bucketize(entries(spark, sf_dir), WIDTH)


@_query("bucket_width", f"{BASE}, spa AS (SELECT source, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS span, min(ts) AS origin FROM ent GROUP BY source) SELECT source, origin, CAST({LADDER} AS INTEGER) AS width FROM spa")
def _width(spark, sf_dir):
    return anomaly.spans(entries(spark, sf_dir)).select("source", "origin", "width")


@_query("bucketize", f"{TIMED} SELECT * FROM buc")
def _bucketize(spark, sf_dir):
    return _buckets(spark, sf_dir).drop("width")


BASELINE = "bas AS (SELECT hour(start) AS hour, avg(errors) AS expected FROM buc WHERE source <> 'shard0' GROUP BY 1), ove AS (SELECT avg(errors) AS overall FROM buc WHERE source <> 'shard0')"


@_query("baseline_by_hour", f"{TIMED}, {BASELINE} SELECT CAST(hour AS INTEGER) AS hour, round(expected, 6) AS expected, round(overall, 6) AS overall FROM bas, ove")
def _baseline(spark, sf_dir):
    return anomaly.learn_baseline(_buckets(spark, sf_dir).where("source <> 'shard0'")).select("hour", *_six("expected", "overall"))


@_query("seasonal_z", f"{TIMED}, {BASELINE} SELECT source, idx, errors, round((errors - coalesce(expected, overall)) / sqrt(coalesce(expected, overall) + 1), 6) AS z FROM buc LEFT JOIN bas ON hour(start) = bas.hour, ove WHERE source = 'shard0'")
def _seasonal(spark, sf_dir):
    b = _buckets(spark, sf_dir)
    return anomaly.seasonal_z(b.where("source = 'shard0'"), anomaly.learn_baseline(b.where("source <> 'shard0'"))).select("source", "idx", "errors", *_six("z"))


EWMA = """
ewm AS (
  SELECT source, idx, start, errors, CAST(errors AS DOUBLE) AS mean, CAST(0 AS DOUBLE) AS var, CAST(0 AS DOUBLE) AS z FROM buc WHERE idx = 0
  UNION ALL
  SELECT b.source, b.idx, b.start, b.errors, e.mean + 0.3 * (b.errors - e.mean), 0.7 * (e.var + 0.3 * (b.errors - e.mean) * (b.errors - e.mean)),
    CASE WHEN sqrt(e.var) > 1e-9 THEN (b.errors - e.mean) / sqrt(e.var) WHEN b.errors > e.mean THEN CAST('inf' AS DOUBLE) ELSE 0 END
  FROM ewm e JOIN buc b ON b.source = e.source AND b.idx = e.idx + 1)"""


@_query("ewma_zscore", f"{TIMED}, {EWMA} SELECT source, idx, errors, round(least(z, 1e6), 6) AS z FROM ewm")
def _ewma(spark, sf_dir):
    return anomaly.ewma_z(_buckets(spark, sf_dir)).select("source", "idx", "errors", F.round(F.least("z", F.lit(1e6)), 6).alias("z"))


SPIKES = "spi AS (SELECT * FROM (SELECT *, coalesce(avg(errors) OVER (PARTITION BY source ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS baseline FROM ewm) WHERE z >= 2.5 AND errors > 0)"


@_query("spikes", f"{TIMED}, {EWMA}, {SPIKES} SELECT source, idx, start, errors, round(least(z, 1e6), 6) AS z, round(baseline, 6) AS baseline FROM spi")
def _spikes(spark, sf_dir):
    return anomaly.spikes(anomaly.ewma_z(_buckets(spark, sf_dir))).select("source", "idx", "start", "errors", F.round(F.least("z", F.lit(1e6)), 6).alias("z"), *_six("baseline"))


CUSUM = """
med AS (SELECT source, quantile_cont(errors, 0.5) AS centre FROM buc GROUP BY source),
mad AS (SELECT source, any_value(centre) AS centre, quantile_cont(abs(errors - centre), 0.5) * 1.4826 AS m FROM buc JOIN med USING (source) GROUP BY source),
sca AS (SELECT source, centre, CASE WHEN m <= 0 THEN 1.0 ELSE m END AS scale FROM mad),
cum AS (SELECT source, idx, start, errors, centre, scale, sum(errors - centre - 0.5 * scale) OVER (PARTITION BY source ORDER BY idx ROWS UNBOUNDED PRECEDING) AS p FROM buc JOIN sca USING (source)),
cus AS (SELECT *, p - least(0, min(p) OVER (PARTITION BY source ORDER BY idx ROWS UNBOUNDED PRECEDING)) AS s FROM cum),
cha AS (SELECT source, min(start) AS changed FROM cus WHERE s > 4 * scale AND errors > centre GROUP BY source)"""


@_query("median_mad", f"{TIMED}, {CUSUM} SELECT source, round(centre, 6) AS centre, round(scale, 6) AS scale FROM sca")
def _mad(spark, sf_dir):
    return anomaly.robust_centre(_buckets(spark, sf_dir)).select("source", *_six("centre", "scale"))


@_query("cusum", f"{TIMED}, {CUSUM} SELECT source, idx, round(s, 4) AS s FROM cus")
def _cusum(spark, sf_dir):
    return anomaly.cusum(_buckets(spark, sf_dir)).select("source", "idx", F.round("s", 4).alias("s"))


@_query("cusum_onset", f"{TIMED}, {CUSUM} SELECT * FROM cha")
def _change(spark, sf_dir):
    return anomaly.change_point(_buckets(spark, sf_dir))


@_query(
    "onset",
    f"""{TIMED}, {EWMA}, {SPIKES}, {CUSUM}, fir AS (SELECT source, min(start) AS spiked, arg_min(z, idx) AS z, count(*) AS n FROM spi GROUP BY source),
    ons AS (SELECT s.source, least(spiked, changed) AS onset, z, coalesce(n, 0) AS spikes FROM sca s LEFT JOIN fir USING (source) LEFT JOIN cha USING (source))
    SELECT o.source, any_value(onset) AS onset, round(coalesce(avg(errors) FILTER (onset IS NULL OR start < onset), 0), 6) AS baseline_errors, max(errors) AS peak_errors, any_value(spikes) AS spikes,
      round(any_value(CASE WHEN spikes > 0 THEN 1 / (1 + exp(-(0.9 * (CASE WHEN isinf(z) THEN 6 ELSE greatest(z, 0) END - 2.5) + 0.5 * greatest(spikes - 1, 0)))) WHEN onset IS NOT NULL THEN 0.6 ELSE 0 END), 6) AS onset_confidence
    FROM ons o JOIN buc USING (source) GROUP BY o.source""",
)
def _onset(spark, sf_dir):
    b = kept(_buckets(spark, sf_dir))  # one row for each hour of a source
    return anomaly.onset(b, anomaly.spikes(anomaly.ewma_z(b))).select("source", "onset", *_six("baseline_errors"), "peak_errors", "spikes", *_six("onset_confidence"))


WIN = f"""
win AS (SELECT source, template, level, ts, count(*) OVER w AS held, min(ts) OVER w AS start FROM tem WHERE ts IS NOT NULL
  WINDOW w AS (PARTITION BY source, template, level ORDER BY ts RANGE BETWEEN INTERVAL {WIDTH} SECONDS PRECEDING AND CURRENT ROW)),
den AS (SELECT source, template, level, count(*) AS events, max(held) AS peak_count FROM win GROUP BY ALL),
pea AS (SELECT d.*, min(start) AS peak_start FROM den d JOIN win w USING (source, template, level) WHERE held = peak_count GROUP BY ALL)"""


@_query("burst_windows", f"{RANKED}, {WIN} SELECT source, template, level, events, peak_count, peak_start FROM pea")
def _windows(spark, sf_dir):
    assigned, _ = _clusters(spark, sf_dir)
    return anomaly.densest_windows(assigned, anomaly.spans(entries(spark, sf_dir), WIDTH), ["source", "template", "level"])


@_query(
    "bursts",
    f"""WITH {ENTRIES_SQL}, eda AS (SELECT * REPLACE (source || strftime(ts, '-%d') AS source) FROM ent), {clusters_sql().replace("FROM ent", "FROM eda")}, {WIN.replace(f"INTERVAL {WIDTH}", "INTERVAL 21600")}, bur AS (SELECT p.source, p.template, p.level, r.count, r.rank, peak_count, peak_start, peak_count / events AS concentration FROM pea p JOIN ran r USING (source, template, level) WHERE events >= 4 AND peak_count / events >= 0.6)
    SELECT source, template, level, count, peak_count, peak_start, round(concentration, 6) AS concentration, round(1 / (1 + exp(-(4 * (concentration - 0.6) + 0.4 * ln(1 + count) - 0.5))), 6) AS confidence,
      row_number() OVER (PARTITION BY source ORDER BY peak_count DESC, concentration DESC, rank) AS "order" FROM bur""",
)
def _bursts(spark, sf_dir):
    """Each day of a log as a source of its own, in windows of six hours."""
    e = entries(spark, sf_dir).withColumn("source", F.concat("source", F.date_format("ts", "-dd")))
    assigned, ranked = clusters.cluster_and_rank(e)
    found = anomaly.bursts(assigned, ranked, anomaly.spans(e, 21_600))
    return found.select("source", "template", "level", "count", "peak_count", "peak_start", *_six("concentration", "confidence"), F.col("order").cast("long").alias("order"))


# --- correlation -----------------------------------------------------------------------------------------------------

TOP = 25
TIMELINE = f"""
tim AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY first_seen, rank) - 1 AS "order" FROM ran WHERE rank <= {TOP} AND first_seen IS NOT NULL),
ori AS (SELECT source, min(first_seen) AS origin FROM tim GROUP BY source),
occ AS (SELECT DISTINCT t.source, l."order", (epoch_us(t.ts) - epoch_us(origin)) // {WIDTH * 1_000_000} AS idx FROM tem t JOIN tim l ON t.source = l.source AND t.template = l.template AND t.level = l.level JOIN ori ON ori.source = t.source),
siz AS (SELECT source, "order", count(*) AS n FROM occ GROUP BY ALL),
pai AS (SELECT a.source, a."order" AS cause, b."order" AS effect, count(*) AS shared FROM occ a JOIN occ b ON a.source = b.source AND a.idx = b.idx AND a."order" < b."order" GROUP BY ALL),
jac AS (SELECT p.*, shared / (x.n + y.n - shared) AS jaccard FROM pai p JOIN siz x ON x.source = p.source AND x."order" = cause JOIN siz y ON y.source = p.source AND y."order" = effect),
can AS (SELECT j.source, cause, effect, jaccard, (epoch_us(e.first_seen) - epoch_us(c.first_seen)) / 1e6 AS lag, c.level >= e.level AS ordered, row_number() OVER (PARTITION BY j.source, effect ORDER BY cause) AS k
  FROM jac j JOIN tim c ON c.source = j.source AND c."order" = cause JOIN tim e ON e.source = j.source AND e."order" = effect
  WHERE c.first_seen < e.first_seen AND (epoch_us(e.first_seen) - epoch_us(c.first_seen)) / 1e6 <= 600 AND jaccard >= 0.2),
fol AS (
  SELECT source, effect, k, cause, jaccard, lag, ordered FROM can WHERE k = 1
  UNION ALL
  SELECT c.source, c.effect, c.k, CASE WHEN c.jaccard > round(f.jaccard, 3) THEN c.cause ELSE f.cause END, CASE WHEN c.jaccard > round(f.jaccard, 3) THEN c.jaccard ELSE f.jaccard END,
    CASE WHEN c.jaccard > round(f.jaccard, 3) THEN c.lag ELSE f.lag END, CASE WHEN c.jaccard > round(f.jaccard, 3) THEN c.ordered ELSE f.ordered END
  FROM fol f JOIN can c ON c.source = f.source AND c.effect = f.effect AND c.k = f.k + 1),
lin_ AS (SELECT * FROM fol QUALIFY row_number() OVER (PARTITION BY source, effect ORDER BY k DESC) = 1)"""
LINKED = f"WITH RECURSIVE {ENTRIES_SQL}, {clusters_sql(20)}, {TIMELINE}"


def _correlated(spark, sf_dir):
    assigned, ranked = clusters.cluster_and_rank(entries(spark, sf_dir), TOP, least=20)
    return assigned, ranked, anomaly.spans(entries(spark, sf_dir), WIDTH)


@_query("timeline", f'{LINKED} SELECT source, template, level, "order", first_seen, component FROM tim')
def _timeline(spark, sf_dir):
    return correlation.timeline(_correlated(spark, sf_dir)[1]).select("source", "template", "level", F.col("order").cast("long").alias("order"), "first_seen", "component")


@_query("occupancy_jaccard", f"{LINKED} SELECT source, cause, effect, shared, round(jaccard, 6) AS jaccard FROM jac")
def _jaccard(spark, sf_dir):
    assigned, ranked, widths = _correlated(spark, sf_dir)
    return correlation.overlaps(correlation.occupancy(assigned, correlation.timeline(ranked), widths)).select("source", F.col("cause").cast("long").alias("cause"), F.col("effect").cast("long").alias("effect"), "shared", *_six("jaccard"))


@_query("cascade_links", f"{LINKED} SELECT source, cause, effect, round(lag, 6) AS lag_seconds, round(jaccard, 6) AS score, round(1 / (1 + exp(-(4 * jaccard + 1.5 * (1 - least(lag / 600, 1)) + CASE WHEN ordered THEN 0.6 ELSE -0.6 END - 2.5))), 6) AS confidence FROM lin_")
def _links(spark, sf_dir):
    found = correlation.correlate(*_correlated(spark, sf_dir))[1]
    return found.select("source", F.col("cause").cast("long").alias("cause"), F.col("effect").cast("long").alias("effect"), *_six("lag_seconds", "score", "confidence"))


@_query(
    "trigger",
    f"""{LINKED}, nod AS (SELECT t.source, t."order", first_seen, level, (SELECT count(*) FROM lin_ l WHERE l.source = t.source AND l.cause = t."order") AS effects,
      (SELECT count(*) FROM lin_ l WHERE l.source = t.source AND l.effect = t."order") AS inbound, dense_rank() OVER (PARTITION BY t.source ORDER BY level) AS place FROM tim t),
    lev AS (SELECT source, count(DISTINCT level) AS levels FROM tim GROUP BY source),
    pic AS (SELECT n.*, effects > 0 AND inbound = 0 AS is_root, place / levels AS severity_rank FROM nod n JOIN lev USING (source)
      QUALIFY row_number() OVER (PARTITION BY n.source ORDER BY CASE WHEN effects > 0 AND inbound = 0 THEN 0 WHEN level >= 40 THEN 1 ELSE 2 END, first_seen, CASE WHEN effects > 0 AND inbound = 0 THEN -level ELSE 0 END, "order") = 1)
    SELECT source, "order" AS trigger, is_root, effects, round(severity_rank, 6) AS severity_rank, round(1 / (1 + exp(-(CASE WHEN is_root THEN 1.2 ELSE -0.5 END + 0.5 * effects + 0.3 * severity_rank - 1))), 6) AS confidence FROM pic""",
)
def _trigger(spark, sf_dir):
    t = correlation.correlate(*_correlated(spark, sf_dir))[2]
    return t.select("source", F.col("trigger").cast("long").alias("trigger"), "is_root", "effects", *_six("severity_rank", "confidence"))


PICKED = """
nod AS (SELECT t.source, t."order", first_seen, level, (SELECT count(*) FROM lin_ l WHERE l.source = t.source AND l.cause = t."order") AS effects, (SELECT count(*) FROM lin_ l WHERE l.source = t.source AND l.effect = t."order") AS inbound FROM tim t),
pic AS (SELECT source, "order" AS start FROM nod
  QUALIFY row_number() OVER (PARTITION BY source ORDER BY CASE WHEN effects > 0 AND inbound = 0 THEN 0 WHEN level >= 40 THEN 1 ELSE 2 END, first_seen, CASE WHEN effects > 0 AND inbound = 0 THEN -level ELSE 0 END, "order") = 1),
ste AS (SELECT source, cause, effect FROM lin_ QUALIFY row_number() OVER (PARTITION BY source, cause ORDER BY round(jaccard, 3) DESC, effect) = 1),
way AS (SELECT source, 0 AS step, start AS "order", [start] AS been FROM pic WHERE source IN (SELECT source FROM lin_)
  UNION ALL SELECT w.source, step + 1, effect, list_append(been, effect) FROM way w JOIN ste s ON s.source = w.source AND s.cause = w."order" WHERE NOT list_contains(been, effect))"""


@_query("cascade_chain", f'{LINKED}, {PICKED} SELECT source, step, "order" FROM way')
def _chain(spark, sf_dir):
    """Links are one for each effect at most and effects at most ``TOP`` a source, so the walk is the driver's."""
    _, found, trigger = correlation.correlate(*_correlated(spark, sf_dir))
    start = {r["source"]: r["trigger"] for r in trigger.collect()}
    rows = [r.asDict() for r in found.orderBy("source", "effect").collect()]
    ways = {source: correlation.chain([(r["cause"], r["effect"], r["jaccard"]) for r in rows if r["source"] == source], t) for source, t in start.items()}
    return spark.createDataFrame([(source, k, int(order)) for source, way in ways.items() for k, order in enumerate(way)], "source string, step int, order long")


@_query("affected_components", f'{LINKED} SELECT source, coalesce(component, \'(uncomponented)\') AS component, min("order") AS first FROM tim GROUP BY ALL')
def _components(spark, sf_dir):
    c = correlation.components_in_order(correlation.timeline(_correlated(spark, sf_dir)[1]))
    return c.select("source", "component", F.col("first").cast("long").alias("first"))


@_query(
    "confidence_scores",
    """WITH v AS (SELECT event_id, value / 100 AS c, event_id % 50 AS n FROM events),
    s AS (SELECT event_id, 1 / (1 + exp(-(4 * (c - 0.6) + 0.4 * ln(1 + n) - 0.5))) AS burst, 1 / (1 + exp(-(0.9 * (greatest(c * 10, 0) - 2.5) + 0.5 * greatest(n - 1, 0)))) AS onset FROM v)
    SELECT event_id, round(burst, 6) AS burst, round(onset, 6) AS onset, CASE WHEN burst >= 0.8 THEN 'high' WHEN burst >= 0.55 THEN 'moderate' WHEN burst >= 0.35 THEN 'low' ELSE 'tentative' END AS label FROM s""",
)
def _scores(spark, sf_dir):
    v = table(spark, sf_dir, "events").select("event_id", (F.col("value") / 100).alias("c"), (F.col("event_id") % 50).alias("n"))
    s = v.select("event_id", scoring.burst(F.col("c"), F.col("n")).alias("burst"), scoring.onset(F.col("c") * 10, F.col("n")).alias("onset"))
    return s.select("event_id", *_six("burst", "onset"), scoring.label(F.col("burst")).alias("label"))


# --- wording, mining, digests, streams ---------------------------------------------------------------------------------


WEIGHTS = """
tok AS (SELECT source, rank, unnest(regexp_extract_all(lower(template), '[a-z]+')) AS token FROM ran),
cou AS (SELECT source, rank, token, count(*) AS n FROM tok GROUP BY ALL), tot AS (SELECT source, rank, sum(n) AS words FROM cou GROUP BY ALL),
dfs AS (SELECT source, token, count(*) AS df FROM cou GROUP BY ALL), num AS (SELECT source, count(*) AS clusters FROM ran GROUP BY source),
wei AS (SELECT c.source, c.rank, c.token, n / words * (ln((clusters + 1) / (df + 1)) + 1) AS w FROM cou c JOIN tot USING (source, rank) JOIN dfs USING (source, token) JOIN num USING (source)),
nor AS (SELECT source, rank, sqrt(sum(w * w)) AS norm FROM wei GROUP BY ALL),
cos AS (SELECT a.source, a.rank AS a, b.rank AS b, sum(a.w * b.w) / (any_value(x.norm) * any_value(y.norm)) AS cosine FROM wei a JOIN wei b ON a.source = b.source AND a.token = b.token AND a.rank < b.rank
  JOIN nor x ON x.source = a.source AND x.rank = a.rank JOIN nor y ON y.source = b.source AND y.rank = b.rank GROUP BY a.source, a.rank, b.rank)"""


@_query("tfidf_cosine", f"{RANKED}, {WEIGHTS} SELECT source, a, b, round(cosine, 6) AS cosine FROM cos")
def _cosine(spark, sf_dir):
    pairs = semantic.similar_pairs(semantic.tfidf(_clusters(spark, sf_dir)[1]), -1.0)
    return pairs.select("source", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), *_six("cosine"))


#: Groups by reaching out from each cluster, then the members of a group folded one by one in rank order.
MERGED = f"""
sim AS (SELECT source, a, b FROM cos WHERE cosine >= {semantic.THRESHOLD} UNION ALL SELECT source, b, a FROM cos WHERE cosine >= {semantic.THRESHOLD}),
rea AS (SELECT source, rank AS a, rank AS b FROM ran UNION SELECT r.source, r.a, s.b FROM rea r JOIN sim s ON s.source = r.source AND s.a = r.b),
gro AS (SELECT source, a AS rank, min(b) AS head FROM rea GROUP BY source, a),
mem AS (SELECT r.*, head, row_number() OVER (PARTITION BY source, head ORDER BY rank) AS k FROM ran r JOIN gro USING (source, rank)),
fol AS (
  SELECT source, head, k, template, level, count FROM mem WHERE k = 1
  UNION ALL
  SELECT f.source, f.head, m.k, CASE WHEN f.count >= m.count THEN f.template ELSE m.template END, greatest(f.level, m.level), f.count + m.count FROM fol f JOIN mem m ON m.source = f.source AND m.head = f.head AND m.k = f.k + 1),
las AS (SELECT * FROM fol QUALIFY row_number() OVER (PARTITION BY source, head ORDER BY k DESC) = 1)"""


@_query("semantic_merge", f"WITH RECURSIVE {ENTRIES_SQL}, {clusters_sql()}, {WEIGHTS}, {MERGED} SELECT source, template, level, count, row_number() OVER (PARTITION BY source ORDER BY level * 1000 + ln(1 + count) DESC, head) AS rank FROM las")
def _merge(spark, sf_dir):
    return semantic.merge_similar(_clusters(spark, sf_dir)[1]).select("source", "template", "level", "count", F.col("rank").cast("long").alias("rank"))


#: Messages are ``[kind] user u took nms k=j``: six tokens, three of them equal within a kind, so each (source, kind) is one
#: leaf and one group; a template keeps the tokens that all lines so far have in common.
MINED = r"""
spt AS (SELECT source, line_no, level, message, string_split(message, ' ') AS t FROM ent WHERE level >= 30),
lea AS (SELECT *, t[1] AS leaf FROM spt),
fst AS (SELECT source, leaf, row_number() OVER (PARTITION BY source ORDER BY min(line_no)) - 1 AS group_id FROM lea GROUP BY source, leaf),
sof AS (SELECT source, leaf, line_no, level, message, """ + ", ".join(f"CASE WHEN min(t[{i}]) OVER w = max(t[{i}]) OVER w THEN t[{i}] ELSE '<*>' END AS r{i}, CASE WHEN min(t[{i}]) OVER a = max(t[{i}]) OVER a THEN t[{i}] ELSE '<*>' END AS f{i}" for i in range(1, 7)) + r"""
  FROM lea WINDOW w AS (PARTITION BY source, leaf ORDER BY line_no ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY source, leaf)),
min_ AS (SELECT source, line_no, level, message, group_id, concat_ws(' ', r1, r2, r3, r4, r5, r6) AS running, concat_ws(' ', f1, f2, f3, f4, f5, f6) AS template FROM sof JOIN fst USING (source, leaf))"""


@_query("drain_templates", f"{BASE}, {MINED} SELECT source, line_no, group_id, running, template FROM min_")
def _drain(spark, sf_dir):
    return drain.mine(entries(spark, sf_dir).where("level >= 30")).withColumn("group_id", F.col("group_id").cast("long"))


@_query(
    "drain_clusters",
    f"""{BASE}, {MINED}, grp AS (SELECT source, template, level, count(*) AS count, min(line_no) AS first_line FROM min_ GROUP BY source, template, level)
    SELECT source, template, level, count, row_number() OVER (PARTITION BY source ORDER BY level * 1000 + ln(1 + count) DESC, first_line) AS rank FROM grp QUALIFY rank <= 10""",
)
def _drain_clusters(spark, sf_dir):
    return clusters.cluster_and_rank(entries(spark, sf_dir), 10, method="drain")[1].select("source", "template", "level", "count", F.col("rank").cast("long").alias("rank"))


DIGEST = """'[' || CASE level WHEN 50 THEN 'CRITICAL' WHEN 40 THEN 'ERROR' ELSE 'WARNING' END || ' x' || count || '] | window ' || strftime(first_seen, '%Y-%m-%dT%H:%M:%S') || ' → ' || strftime(last_seen, '%Y-%m-%dT%H:%M:%S')
      || chr(10) || '  template: ' || template || chr(10) || '  example:  ' || rep_message"""


@_query(
    "token_budget_pack",
    f"""WITH RECURSIVE {ENTRIES_SQL}, {clusters_sql()}, dig AS (SELECT source, rank, {DIGEST} AS digest FROM ran),
    est AS (SELECT *, greatest(1, length(digest) // 4) AS tokens FROM dig),
    pac AS (SELECT source, rank, digest, tokens, 0 AS batch, tokens AS used FROM est WHERE rank = 1
      UNION ALL SELECT e.source, e.rank, e.digest, e.tokens, CASE WHEN p.used + e.tokens > 200 THEN p.batch + 1 ELSE p.batch END, CASE WHEN p.used + e.tokens > 200 THEN e.tokens ELSE p.used + e.tokens END FROM pac p JOIN est e ON e.source = p.source AND e.rank = p.rank + 1)
    SELECT source, rank, digest, CAST(tokens AS INTEGER) AS tokens, batch FROM pac""",
)
def _pack(spark, sf_dir):
    return digests.pack(digests.build_digests(_clusters(spark, sf_dir)[1]), 200).select("source", F.col("rank").cast("long").alias("rank"), "digest", "tokens", "batch")


@_query(
    "surface_lines",
    f"""{BASE} SELECT source, line_no, level, date_trunc('second', ts) AS ts, message || ' by [REDACTED:EMAIL]' AS message, {normalize_sql("message || ' by u' || line_no || '@mail.org'")} AS template FROM lin WHERE level >= 40""",
)
def _surface(spark, sf_dir):
    """What following the logs shows, secrets masked: stateless, so a table does as well as a stream."""
    raw = F.concat("raw", F.lit(" by u"), F.col("line_no").cast("string"), F.lit("@mail.org"))
    lines = entries(spark, sf_dir).select("source", F.col("line_no").alias("n"), raw.alias("value"))
    return live.surface(lines, redact=True)


@_query(
    "push_requests",
    f"""{BASE}, row_ AS (SELECT source, CASE level WHEN 50 THEN 'critical' WHEN 40 THEN 'error' ELSE 'warning' END AS level, substr(sha1({normalize_sql('message')}), 1, 10) AS cluster, epoch_us(ts) * 1000 AS ts_ns, line_no, raw FROM lin WHERE level >= 30)
    SELECT source, level, cluster, ts_ns, raw AS line, 'emberlog' AS job FROM row_""",
)
def _push(spark, sf_dir):
    """The bodies that would be sent, a row for each line."""
    kept_ = clusters.streams(entries(spark, sf_dir).where("level >= 30"))

    def bodies(batches):
        import pandas as pd

        for batch in batches:
            for body in push.requests(r._asdict() for r in batch.rename(columns={"values": "lines"}).itertuples(index=False)):
                yield pd.DataFrame([(x["stream"]["source"], x["stream"]["level"], x["stream"]["cluster"], int(ns), line, x["stream"]["job"]) for x in body for ns, line in x["values"]], columns=["source", "level", "cluster", "ts_ns", "line", "job"])

    return kept_.mapInPandas(bodies, "source string, level string, cluster string, ts_ns long, line string, job string")


@_query("stream_novelty", f"{BASE}, tem AS (SELECT source, line_no, level, {normalize_sql('message')} AS template FROM ent WHERE level >= 40) SELECT source, line_no, level, template, row_number() OVER (PARTITION BY source, template ORDER BY line_no) = 1 AS is_new FROM tem")
def _novelty(spark, sf_dir):
    """The streaming job over all of ``events``, until it has nothing left to read."""
    return live.novelty_of_table(spark, entries(spark, sf_dir), 40)
