"""From lines to entries: stitching, format detection, and the parsers of five formats as Column expressions.

An entry is (source, line_no, raw, message, level, ts, fields). All parsers are one projection, so a line is parsed by
the parser of its source's format and by no other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import severity
from ..functions.text import strip
from ..functions.timestamps import parse_timestamp

FORMATS = ("json", "syslog", "clf", "logfmt", "text")
SAMPLE, MAJORITY = 20, 0.6
RUN = 1 << 16  # lines of a window when records are numbered

#: Keys that hold a level, a message or a time, the first that is there counts.
LEVEL_KEYS = ("level", "lvl", "severity", "loglevel", "log_level")
MESSAGE_KEYS = ("message", "msg", "text", "event", "error")
TIME_KEYS = ("timestamp", "time", "ts", "@timestamp", "datetime", "date")

#: The shapes of the formats' lines. (?U): Unicode classes; (?d): only \n ends a line.
CONTINUATION = r"(?U)^(\s+|Traceback \(|\s*at\s+\w|\s*Caused by:|\s*\.\.\.\s+\d+\s+more|\s*File \"|\s*[A-Za-z_.]+(?:Error|Exception):)"
TEXT_TIME = r"^\[?(\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2})?)\]?"
LEADING_LEVEL = rf"(?i)^(?:level=)?\[?({severity.TEXT_TOKENS})\]?(?![A-Za-z])"
ANY_LEVEL = rf"(?i)(?<![A-Za-z])(?:level=)?\[?({severity.TEXT_TOKENS})\]?(?![A-Za-z])"
PAIR = r'(?Ud)(\w[\w.\-]*)=("(?:[^"\\]|\\.)*"|\S+)'
SYSLOG_NEW = r"(?Ud)^<(\d{1,3})>\d+\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(?:-|\[.*?\])\s*(.*)$"
SYSLOG_OLD = r"(?Ud)^(?:<(\d{1,3})>)?([A-Z][a-z]{2}\s+\d{1,2}\s\d{2}:\d{2}:\d{2})\s+(\S+)\s+([^:\[]+)(?:\[\d+\])?:\s*(.*)$"
CLF = r'(?Ud)^(\S+)\s+\S+\s+\S+\s+\[([^\]]+)\]\s+"(\S+)\s+(\S+)\s+([^"]+)"\s+(\d{3})\s+(\S+)'

_BLANK = r"(?U)^\s*$"
_NO_FIELDS = "map<string,string>"


def stitch_lines(lines: DataFrame) -> DataFrame:
    """(source, n, value) with each continuation line joined to the record before it; n counts records, blanks too.

    Islands by a running sum: a record starts at the first line, at a blank line, and at a line that continues nothing.
    """
    starts = (F.col("n") == 1) | F.col("value").rlike(_BLANK) | ~F.col("value").rlike(CONTINUATION)
    marked = lines.select("source", "n", "value", starts.cast("int").alias("start"), F.floor(F.col("n") / RUN).alias("run"))
    # a running sum in two steps, so that no window holds more than a run of lines
    runs = marked.groupBy("source", "run").agg(F.sum("start").alias("starts"))
    runs = runs.select("source", "run", F.coalesce(F.sum("starts").over(Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.sum("start").over(Window.partitionBy("source", "run").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    of = marked.withColumn("within", within).join(runs, ["source", "run"]).select("source", "n", "value", (F.col("within") + F.col("before")).alias("record"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("n", "value"))), lambda x: x["value"])
    return of.groupBy("source", "record").agg(F.array_join(parts, "\n").alias("value")).select("source", F.col("record").alias("n"), "value")


def _is_json(text: Column) -> Column:
    return text.startswith("{") & text.endswith("}") & F.from_json(text, _NO_FIELDS).isNotNull()


def _is_logfmt(text: Column) -> Column:
    first = F.element_at(F.split(text, r"(?U)\s+"), 1)
    return first.contains("=") & (F.size(F.regexp_extract_all(text, F.lit(PAIR), F.lit(1))) >= 2)


def detect_formats(lines: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(source, format): what most of a source's first ``sample`` lines that aren't blank look like; else text."""
    text = strip(F.col("value"))
    # the first lines of a source are few, so each task hands on no more than it has of them
    shown = lines.select("source", "n", text.alias("t")).where(F.col("t") != "").withColumn("k", F.row_number().over(Window.partitionBy("source").orderBy("n"))).where(F.col("k") <= sample)
    tests = {"json": _is_json(F.col("t")), "syslog": F.col("t").rlike(SYSLOG_NEW) | F.col("t").rlike(SYSLOG_OLD), "clf": F.col("t").rlike(CLF), "logfmt": _is_logfmt(F.col("t"))}
    share = shown.groupBy("source").agg(*[F.avg(F.coalesce(test, F.lit(False)).cast("int")).alias(name) for name, test in tests.items()])
    found = F.coalesce(*[F.when(F.col(name) >= MAJORITY, name) for name in FORMATS[:-1]], F.lit("text"))
    sources = lines.select("source").distinct()
    return sources.join(share.select("source", found.alias("format")), "source", "left").select("source", F.coalesce("format", F.lit("text")).alias("format"))


def _entry(message: Column, level: Column, ts: Column, fields: Column | None = None) -> Column:
    fields = F.create_map().cast(_NO_FIELDS) if fields is None else fields
    return F.struct(message.alias("message"), level.cast("int").alias("level"), ts.alias("ts"), fields.alias("fields"))


def _first(fields: Column, keys: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.nullif(F.try_element_at(fields, F.lit(k)), F.lit("")) for k in keys])


def _group(text: Column, pattern: str, k: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, k), F.lit(""))


def parse_text(raw: Column) -> Column:
    """A leading time goes; a leading level goes too; a level further on is read but stays."""
    text = strip(raw)
    has_time = text.rlike(TEXT_TIME)
    body = F.when(has_time, F.regexp_replace(F.regexp_replace(text, TEXT_TIME, ""), r"(?U)^\s+", "")).otherwise(text)
    leading = body.rlike(LEADING_LEVEL)
    level = severity.level_of(F.when(leading, F.regexp_extract(body, LEADING_LEVEL, 1)).otherwise(_group(body, ANY_LEVEL, 1)))
    message = F.when(leading, F.regexp_replace(F.regexp_replace(body, LEADING_LEVEL, ""), r"(?U)^\s+", "")).otherwise(body)
    return _entry(message, level, F.when(has_time, parse_timestamp(_group(text, TEXT_TIME, 1))))


def _keyed(raw: Column, fields: Column) -> Column:
    time = _first(fields, TIME_KEYS)
    return _entry(F.coalesce(_first(fields, MESSAGE_KEYS), strip(raw)), severity.level_of(_first(fields, LEVEL_KEYS)), parse_timestamp(time), fields)


def _once(value: Column, body) -> Column:
    """body(value) with the value worked out once, however often the body refers to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _last_wins(pairs: Column) -> Column:
    """A map of (key, value) pairs in which the last value of a repeated key counts, whatever the session's policy."""
    return F.aggregate(pairs, F.create_map().cast(_NO_FIELDS), lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["key"]), F.create_map(p["key"], p["value"])))


def parse_json(raw: Column) -> Column:
    """An object's keys; anything else that is JSON is its own message; what isn't JSON is text."""
    text = strip(raw)
    read = F.from_json(text, _NO_FIELDS)  # a repeated key is in it twice
    fields = _once(read, lambda m: F.when(F.size(F.array_distinct(F.map_keys(m))) == F.size(m), m).when(m.isNotNull(), _last_wins(F.map_entries(m))))
    other = F.try_parse_json(text).isNotNull()
    nothing = F.lit(None).cast("timestamp")
    return _once(fields, lambda f: F.when(text.startswith("{") & f.isNotNull(), _keyed(raw, f)).when(other, _entry(text, F.lit(None), nothing)).otherwise(parse_text(raw)))


def logfmt_fields(raw: Column) -> Column:
    keys = F.transform(F.regexp_extract_all(raw, F.lit(PAIR), F.lit(1)), F.lower)
    quoted = lambda v: F.length(v).__ge__(2) & v.startswith('"') & v.endswith('"')
    inner = lambda v: F.replace(F.substr(v, F.lit(2), F.length(v) - 2), F.lit('\\"'), F.lit('"'))
    values = F.transform(F.regexp_extract_all(raw, F.lit(PAIR), F.lit(2)), lambda v: F.when(quoted(v), inner(v)).otherwise(v))
    return _last_wins(F.zip_with(keys, values, lambda k, v: F.struct(k.alias("key"), v.alias("value"))))


def parse_logfmt(raw: Column) -> Column:
    return _once(logfmt_fields(raw), lambda f: F.when(F.size(f) > 0, _keyed(raw, f)).otherwise(parse_text(raw)))


def parse_syslog(raw: Column) -> Column:
    """RFC 5424, else RFC 3164, else text; the message is ``[app] text``."""
    text = F.regexp_replace(raw, r"\n+$", "")

    def found(pattern: str, tag: int, body: int) -> Column:
        message = strip(F.regexp_extract(text, pattern, body))
        level = F.coalesce(severity.from_priority(_group(text, pattern, 1)), severity.level_of(_group(message, ANY_LEVEL, 1)))
        name = F.regexp_extract(text, pattern, tag)
        return _entry(F.when(name == "-", message).otherwise(F.concat(F.lit("["), strip(name), F.lit("] "), message)), level, parse_timestamp(F.regexp_extract(text, pattern, 2)))

    return F.when(text.rlike(SYSLOG_NEW), found(SYSLOG_NEW, 4, 7)).when(text.rlike(SYSLOG_OLD), found(SYSLOG_OLD, 4, 5)).otherwise(parse_text(raw))


def parse_clf(raw: Column) -> Column:
    part = lambda k: F.regexp_extract(raw, CLF, k)
    status = part(6).try_cast("int")
    level = F.when(status >= 500, 40).when(status >= 400, 30).otherwise(20)
    fields = F.create_map(F.lit("ip"), part(1), F.lit("method"), part(3), F.lit("path"), part(4), F.lit("status"), part(6))
    return F.when(raw.rlike(CLF), _entry(F.concat(part(3), F.lit(" "), part(4), F.lit(" -> "), part(6)), level, parse_timestamp(part(2)), fields)).otherwise(parse_text(raw))


PARSERS = {"json": parse_json, "syslog": parse_syslog, "clf": parse_clf, "logfmt": parse_logfmt, "text": parse_text}


def parse_with(raw: Column, fmt: Column | str) -> Column:
    """The entry struct of a line in a format; an unknown format is text."""
    if isinstance(fmt, str):
        return PARSERS.get(fmt, parse_text)(raw)
    out = parse_text(raw)
    for name in FORMATS[:-1]:
        out = F.when(fmt == name, PARSERS[name](raw)).otherwise(out)
    return out


def parse_lines(lines: DataFrame, fmt: str | None = None, stitch: bool = True) -> DataFrame:
    """(source, n, value) -> entries. Blank records are skipped but keep their numbers."""
    detected = None if fmt else detect_formats(stitch_lines(lines) if stitch else lines)
    records = stitch_lines(lines) if stitch else lines
    shown = records.where(~F.col("value").rlike(_BLANK))
    if fmt:
        parsed = shown.withColumn("e", parse_with(F.col("value"), fmt))
    else:
        parsed = shown.join(detected, "source").withColumn("e", parse_with(F.col("value"), F.col("format")))
    return parsed.select("source", F.col("n").cast("long").alias("line_no"), F.col("value").alias("raw"), "e.message", "e.level", "e.ts", "e.fields")


def infer_levels(entries: DataFrame) -> DataFrame:
    """Entries whose null levels are filled from their messages where those tell; ``inferred`` marks them."""
    guess = F.when(F.col("level").isNull(), severity.infer_level(F.col("message")))
    return entries.withColumn("__guess", guess).withColumn("inferred", F.col("__guess").isNotNull()).withColumn("level", F.coalesce("level", "__guess")).drop("__guess")


def count_inferred(entries: DataFrame) -> DataFrame:
    return entries.groupBy("source").agg(F.count_if("inferred").alias("filled"))
