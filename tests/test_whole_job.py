"""Queries work on all of their input, not on a part chosen beforehand."""

import pytest

from emberlog.operators import parsing
from emberlog.plans import catalogue

SF = "/root/testdata/sf0.001"


def test_detect_format_reads_every_line(spark, monkeypatch):
    detect, given = parsing.detect_formats, []
    monkeypatch.setattr(parsing, "detect_formats", lambda lines: given.append(lines) or detect(lines))
    assert catalogue.QUERIES["detect_format"](spark, SF).count() == 6
    assert given[0].count() == 6 * catalogue.entries(spark, SF).count() > 6 * 40


@pytest.mark.parametrize("name", ["tfidf_cosine", "semantic_merge", "token_budget_pack"])
def test_all_signatures_are_compared(spark, monkeypatch, name):
    clusters, tops = catalogue._clusters, []
    monkeypatch.setattr(catalogue, "_clusters", lambda spark, sf_dir, top=None: tops.append(top) or clusters(spark, sf_dir, top))
    assert catalogue.QUERIES[name](spark, SF).columns and tops == [None]


def test_long_line_does_not_stop_a_tail(tmp_path):
    from emberlog.sources import tail

    log = tmp_path / "a.log"
    log.write_bytes(b"x" * (tail.MOST_BYTES + 1000))
    assert tail._lines(str(log), 0, 0)[0] == []  # not ended yet
    with log.open("ab") as file:
        file.write(b"\nERROR y\n")
    rows, done, n = tail._lines(str(log), 0, 0)
    rows += tail._lines(str(log), done, n)[0]
    assert [len(r[2]) for r in rows] == [tail.MOST_BYTES + 1000, 7] and rows[1][1:] == (2, "ERROR y")


def test_nothing_vanishes_beyond_what_is_shown(spark, monkeypatch):
    from emberlog.plans import incident
    from emberlog.sources import text as sources

    monkeypatch.setattr(incident, "SHOWN", 3)
    lines = [f"2026-06-14 09:00:{i:02} ERROR [part{chr(97 + i)}] fault {chr(97 + i) * 3}" for i in range(8) for _ in range(2)]
    plan = incident.plan(parsing.parse_lines(sources.from_iterable(spark, lines, "s"), "text"), incident.Options(top=None))
    found = incident.findings(plan, "s")
    plan.release()
    out = incident.to_dict(found)
    assert found.total == 16 and len(found.clusters) == 3 and {k: out["not_shown"][k] for k in ("clusters", "timeline")} == {"clusters": 5, "timeline": 5}
    assert all(x["effect_component"] for x in out["cascade"])


def test_ewma_of_many_buckets(spark):
    from pyspark.sql import functions as F

    from emberlog.operators import anomaly

    rows = spark.range(1_000_000).select(F.lit("s").alias("source"), F.col("id").alias("idx"), F.timestamp_seconds("id").alias("start"), F.lit(1).alias("width"), F.lit(1).alias("total"), F.when(F.col("id") == 999_999, 5).otherwise(F.col("id") % 2).alias("errors"), F.lit(0).alias("warnings"))
    assert [r.idx for r in anomaly.ewma_z(rows).where("z > 5 and idx > 10").collect()] == [999_999]


def test_a_stray_time_fails_clearly(spark):
    from emberlog.operators import anomaly

    rows = spark.sql("SELECT 's' AS source, timestamp'1900-01-01' AS ts, 40 AS level UNION ALL SELECT 's', timestamp'2026-01-01', 40")
    with pytest.raises(Exception, match="stray time"):
        anomaly.bucketize(rows, 1).count()
    assert anomaly.bucketize(rows, 3600).count() > 1_000_000


def test_requests_are_cut(monkeypatch):
    from emberlog.sinks import push

    monkeypatch.setattr(push, "MOST_LINES", 10)
    rows = [{"source": "s", "level_name": "error", "cluster": c, "lines": [{"ts_ns": i, "line": f"{c}{i}"} for i in range(n)]} for c, n in (("a", 25), ("b", 3), ("c", 4))]
    sent = list(push.requests(rows))
    assert [sum(len(x["values"]) for x in body) for body in sent] == [10, 10, 8, 4]
    assert [v[1] for body in sent for x in body for v in x["values"]] == [v["line"] for r in rows for v in r["lines"]]


def test_embedders(spark):
    from emberlog.operators import semantic

    assert isinstance(semantic.get_similarity("ollama").__closure__[0].cell_contents, semantic.LocalServer)
    ranked = spark.createDataFrame([("s", 1, "a b c"), ("s", 2, "a b c d"), ("s", 3, "x y")], "source string, rank int, template string")
    by_name = semantic.get_similarity("anything")(ranked, 0.5).select("a", "b").collect()
    dense = semantic.embedded_pairs(ranked, lambda texts: [[t.count("a"), t.count("x")] for t in texts], 0.9).select("a", "b").collect()
    assert by_name == dense == [(1, 2)]
    with pytest.raises(ValueError, match="at most 2"):
        semantic.embedded_pairs(ranked, lambda texts: [[1.0]] * len(texts), 0.9, most=2)
