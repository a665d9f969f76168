from datetime import datetime

import pytest

from emberlog.operators import parsing
from emberlog.sources import text as sources
from emberlog.functions.timestamps import parse_timestamp
from pyspark.sql import functions as F


def parse(spark, lines, fmt=None, **kw):
    return parsing.parse_lines(sources.from_iterable(spark, lines, "s"), fmt, **kw).orderBy("line_no").collect()


def one(spark, line, fmt):
    return parse(spark, [line], fmt)[0]


def test_text(spark):
    r = one(spark, "2026-06-14 09:03:14 ERROR [db] Connection to 10.0.4.21:5432 failed", "text")
    assert (r.level, r.message, r.ts) == (40, "[db] Connection to 10.0.4.21:5432 failed", datetime(2026, 6, 14, 9, 3, 14))
    assert one(spark, "2026-06-14 09:03:16 WARN  [w] Tick", "text").level == 30
    r = one(spark, "request failed level=error code 7", "text")
    assert (r.level, r.message) == (40, "request failed level=error code 7")
    assert one(spark, "MYERRORS happen", "text").level is None


def test_json(spark):
    r = one(spark, '{"timestamp": "2026-06-14T11:00:15.220Z", "level": "error", "msg": "502 upstream", "n": {"a": 1}}', "json")
    assert (r.level, r.message, r.ts, r.fields["n"]) == (40, "502 upstream", datetime(2026, 6, 14, 11, 0, 15, 220000), '{"a":1}')
    assert one(spark, "this is not json ERROR boom", "json").level == 40
    r = one(spark, '{"level": 30, "time": 1718000000, "message": "x"}', "json")
    assert (r.level, r.ts, r.message) == (None, None, "x")
    r = one(spark, "[1, 2]", "json")
    assert (r.message, r.level) == ("[1, 2]", None)
    assert one(spark, '{"msg": "a", "msg": "b"}', "json").message == "b"


def test_logfmt(spark):
    r = one(spark, 'level=error msg="db \\"x\\" failed" Service=payments ts=2026-06-14T09:03:14Z service=last', "logfmt")
    assert (r.level, r.message, r.fields["service"]) == (40, 'db "x" failed', "last")


def test_syslog(spark):
    r = one(spark, "<34>Oct 11 22:14:15 myhost su[1234]: authentication failure for admin", "syslog")
    assert (r.level, r.message, r.ts) == (50, "[su] authentication failure for admin", datetime(1900, 10, 11, 22, 14, 15))
    r = one(spark, "<165>1 2026-06-14T09:03:14Z host app 4711 ID47 - database connection refused", "syslog")
    assert (r.level, r.message) == (25, "[app] database connection refused")
    assert one(spark, "Feb 29 10:00:00 h t: ERROR x", "syslog").ts is None
    # a stitched record isn't one line, so it is read as text
    r = parse(spark, ["<34>Oct 11 22:14:15 h su: ERROR boom", "  at frame"], "syslog")[0]
    assert r.message.startswith("<34>") and r.level == 40


def test_clf(spark):
    r = one(spark, '10.0.0.1 - - [14/Jun/2026:09:03:14 +0200] "GET /api/x HTTP/1.1" 503 120 "-" "curl"', "clf")
    assert (r.level, r.message, r.ts, r.fields["ip"]) == (40, "GET /api/x -> 503", datetime(2026, 6, 14, 7, 3, 14), "10.0.0.1")


TIMES = {
    "2026-06-14T11:00:15.220Z": datetime(2026, 6, 14, 11, 0, 15, 220000), "2026-06-14T11:00:15+02:00": datetime(2026, 6, 14, 9, 0, 15), "2026-06-14 11:00:15,5": datetime(2026, 6, 14, 11, 0, 15, 500000),
    "[2026-06-14 11:00:15]": datetime(2026, 6, 14, 11, 0, 15), "2026-6-1 1:2:3": datetime(2026, 6, 1, 1, 2, 3), "Oct  1 02:03:04": datetime(1900, 10, 1, 2, 3, 4),
    "2026-06-14T11:00:15.123456789": None, "2026-06-14T11:00:15,5": None, "2026-06-14 11:00:15+0000": None, "2026": None, "2026-06-14T11:00": None, "": None, "x": None,
}


def test_timestamps(spark):
    df = spark.createDataFrame([(k,) for k in TIMES], "t string").select("t", parse_timestamp(F.col("t")).alias("ts"))
    assert {r.t: r.ts for r in df.collect()} == TIMES


def test_stitch_and_blank_lines(spark):
    lines = ["2026-06-14 09:00:00 ERROR boom", "Traceback (most recent call last):", '  File "x.py"', "ValueError: bad", "", "  indented after blank", "2026-06-14 09:00:01 INFO ok"]
    rows = parse(spark, lines, "text")
    assert [r.line_no for r in rows] == [1, 2, 3]
    assert rows[0].raw.count("\n") == 3 and rows[1].message == "indented after blank" and rows[2].level == 20


def test_long_runs_are_numbered_alike(spark, monkeypatch):
    lines = sources.from_iterable(spark, ["a", " b", "c", "", " d", "e"] * 5, "s")
    want = parsing.stitch_lines(lines).orderBy("n").collect()
    monkeypatch.setattr(parsing, "RUN", 4)
    assert parsing.stitch_lines(lines).orderBy("n").collect() == want


@pytest.mark.parametrize(
    ("lines", "fmt"),
    [(['{"a": 1}'] * 3 + ["x"] * 2, "json"), (['{"a": 1}'] * 2 + ["x"] * 2, "text"), (["<34>Oct 11 22:14:15 h su: x"] * 3, "syslog"), (["a=1 b=2"] * 3, "logfmt"), (["", " "], "text")],
)
def test_detect(spark, lines, fmt):
    assert parsing.detect_formats(sources.from_iterable(spark, lines, "s")).first()["format"] == fmt


def test_inference(spark):
    rows = [("fatal error: kernel panic", None), ("returned HTTP 503", None), ("API is deprecated", None), ("user alice viewed", None), ("room 1", 20)]
    df = parsing.infer_levels(spark.createDataFrame([("s", m, x) for m, x in rows], "source string, message string, level int"))
    assert [r.level for r in df.collect()] == [50, 40, 30, None, 20]
    assert parsing.count_inferred(df).first()["filled"] == 3


def test_files(spark, tmp_path):
    import gzip

    (tmp_path / "sub").mkdir()
    (tmp_path / "x.log").write_bytes(b"ERROR a\xff\r\nINFO b\n")
    (tmp_path / "sub" / "y.txt").write_text("WARN c\n")
    (tmp_path / "ignore.bin").write_text("ERROR no\n")
    with gzip.open(tmp_path / "z.log.gz", "wt") as f:
        f.write("ERROR d\n")
    got = sources.renumber(parsing.parse_lines(sources.read_lines(spark, [str(tmp_path)]), "text")).orderBy("line_no").collect()
    assert [r.line_no for r in got] == [1, 2, 3, 4]
    assert {r.message for r in got} == {"a�", "b", "c", "d"}
    assert sources.read_lines(spark, str(tmp_path / "x.log")).count() == 2
    with pytest.raises(ValueError):
        sources.check_upload(sources.MAX_UPLOAD_BYTES + 1)
