import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from emberlog import cli, service
from emberlog.functions import text
from emberlog.narration import providers
from emberlog.operators import anomaly, clusters, digests, drain, parsing, semantic
from emberlog.plans import incident
from emberlog.reports import report as reports
from emberlog.sinks import push
from emberlog.sources import simulator
from emberlog.sources import text as sources
from emberlog.sources.tail import TailReader
from emberlog.streaming import live

T0 = datetime(2026, 6, 14, 9)
ENTRY = "source string, line_no long, raw string, message string, level int, ts timestamp, fields map<string,string>"


def entries(spark, rows):
    """rows: (seconds or None, level, message)"""
    return spark.createDataFrame([("s", i, m, m, x, None if t is None else T0 + timedelta(seconds=t), {}) for i, (t, x, m) in enumerate(rows, 1)], ENTRY)


#: (seconds from 11:00, level, service, message)
SHOP_LOG = [
    (1.12, "info", "store", "start on port 81"), (4.0, "info", "edge", "ready in 12 ms"), (7.5, "info", "store", "user ann signed in"), (10.2, "info", "store", "order 71 accepted"),
    (12.5, "warning", "store", "slow answer from ledger: 900 ms"), (15.22, "error", "store", "PUT /pay/1 502: ledger hung up"), (16.9, "error", "store", "PUT /pay/2 502: ledger hung up"),
    (18.3, "error", "ledger", "no free connection in pool"), (18.9, "error", "store", "PUT /pay/3 502: ledger hung up"), (19.5, "error", "ledger", "no free connection in pool"),
    (21.7, "warning", "edge", "circuit to store half open"), (22.6, "error", "store", "PUT /pay/4 502: ledger hung up"), (24.0, "critical", "ledger", "main database gone"),
    (25.5, "error", "ledger", "no free connection in pool"), (27.64, "warning", "store", "basket kept in memory"), (29.5, "error", "store", "PUT /pay/5 502: ledger hung up"),
    (33.5, "critical", "ledger", "main database gone"), (50.0, "info", "ledger", "main database back"), (62.14, "info", "store", "order 72 accepted"),
]


def test_worked_example(spark, tmp_path):
    log = tmp_path / "shop.jsonl"
    log.write_text("".join(json.dumps({"timestamp": f"2026-06-14T11:{int(t // 60):02}:{t % 60:06.3f}Z", "level": level, "service": service, "msg": message}) + "\n" for t, level, service, message in SHOP_LOG))
    rows = parsing.parse_lines(sources.read_lines(spark, str(log)))
    p = incident.plan(rows)
    f = incident.findings(p, rows.first()["source"])
    assert (f.bucket_seconds, f.onset_confidence, f.peak_errors, f.baseline_errors) == (2, 0.959, 2, 0.0)
    assert [(s["idx"], s["errors"]) for s in f.spikes] == [(7, 2)] and f.bursts == []
    assert [(x["cause"], x["effect"], x["lag_seconds"], x["jaccard"], x["confidence"]) for x in f.cascade] == [(1, 2, 3.08, 0.333, 0.716)]
    assert (f.trigger, f.trigger_confidence) == (1, 0.711)
    assert reports.components(f) == ["store", "ledger", "edge"]
    assert [c["count"] for c in f.clusters] == [2, 5, 3, 1, 1, 1]
    assert json.loads(json.dumps(incident.to_dict(f), allow_nan=False))["spikes"][0]["zscore"] == "Infinity"
    assert "Trigger" in reports.evidence(f)
    r = reports.deterministic_report(f)
    assert "<h1>" in r.to_html() and json.loads(r.to_json())["total_errors"] == 13 and r.to_markdown().startswith("# Incident")


def test_simulated_incident(spark):
    assert len(simulator.incident_script()) == 26
    f = incident.findings(incident.plan(parsing.parse_lines(simulator.simulated(spark))), "simulator")
    assert f.onset and f.timeline[f.trigger]["component"] in {"storage", "checkout"}


def test_rank_ties_and_diff(spark):
    e = entries(spark, [(0, 40, "beta"), (1, 40, "alpha"), (2, 50, "gamma"), (3, 30, "alpha")])
    ranked = clusters.cluster_and_rank(e)[1]
    assert [r.template for r in ranked.orderBy("rank").collect()] == ["gamma", "beta", "alpha", "alpha"]
    after = clusters.cluster_and_rank(entries(spark, [(0, 40, "beta"), (1, 40, "beta"), (2, 40, "new one")]))[1]
    d = {r.template: (r.before, r.after, r.status) for r in clusters.diff_clusters(ranked, after).collect()}
    assert d == {"alpha": (1, 0, "resolved"), "beta": (1, 2, "worsened"), "gamma": (1, 0, "resolved"), "new one": (0, 1, "new")}  # alpha by its least severe cluster


def test_onset_and_bursts(spark):
    e = entries(spark, [(i, 20, "ok") for i in range(30)] + [(31 + i / 10, 40, "bad") for i in range(20)])
    b = anomaly.bucketize(e, 5)
    o = anomaly.onset(b, anomaly.spikes(anomaly.ewma_z(b))).first()
    assert o.onset >= T0 + timedelta(seconds=30) and o.spikes > 0
    assigned, ranked = clusters.cluster_and_rank(entries(spark, [(i / 5, 40, "x failed") for i in range(10)] + [(500, 40, "x failed")]))
    found = anomaly.bursts(assigned, ranked, anomaly.spans(assigned, 30)).first()
    assert (found.peak_count, found.count) [0] == 10 and found.concentration > 0.9
    flat = anomaly.bucketize(entries(spark, [(i, 40, "e") for i in range(20)]), 1)
    assert anomaly.change_point(flat).count() == 0
    assert anomaly.spans(entries(spark, [(None, 40, "x")])).count() == 0


def test_dense_windows_against_a_sweep(spark):
    rng = random.Random(3)
    times = sorted(rng.choice(range(200)) for _ in range(80))
    a = clusters.assign_templates(entries(spark, [(t, 40, "x") for t in times]))
    for width in (5, 30):
        got = anomaly.densest_windows(a, anomaly.spans(a, width), ["source", "template", "level"]).first()
        best, start, left = 1, times[0], 0
        for right, t in enumerate(times):
            while t - times[left] > width:
                left += 1
            if right - left + 1 > best:
                best, start = right - left + 1, times[left]
        assert (got.peak_count, got.peak_start) == (best, T0 + timedelta(seconds=start))


def sequential_drain(messages, depth, threshold, most):
    """One pass over all messages with a plain tree."""
    tree, groups, out = {}, [], []
    for m in messages:
        tokens = m.split()
        if not tokens:
            out.append((-1, ""))
            continue
        node = tree.setdefault(len(tokens), {})
        for tok in tokens[: depth - 2]:
            key = "<*>" if any(c.isdigit() for c in tok) else "=" + tok
            if key not in node and key != "<*>" and sum(k != "<*>" for k in node) >= most:
                key = "<*>"
            node = node.setdefault(key, {})
        leaf = node.setdefault("", [])
        sims = [sum(a in ("<*>", b) for a, b in zip(groups[g], tokens)) / len(tokens) for g in leaf]
        if sims and max(sims) >= threshold:
            g = leaf[sims.index(max(sims))]
            groups[g] = [a if a == b else "<*>" for a, b in zip(groups[g], tokens)]
        else:
            g = len(groups)
            groups.append(tokens)
            leaf.append(g)
        out.append((g, " ".join(groups[g])))
    return [(g, running, " ".join(groups[g]) if g >= 0 else "") for g, running in out]


@pytest.mark.parametrize("most", [1, 2, 100])
def test_drain_is_the_sequential_miner(spark, most):
    rng = random.Random(most)
    messages = [" ".join(rng.choice(["a", "b", "c", "d1", "e"]) for _ in range(rng.randrange(0, 6))) for _ in range(150)]
    df = spark.createDataFrame([("s", i, m) for i, m in enumerate(messages)], "source string, line_no long, message string")
    got = drain.mine(df, max_children=most).orderBy("line_no").collect()
    assert [(r.group_id, r.running, r.template) for r in got] == sequential_drain(messages, 4, 0.4, most)
    with pytest.raises(ValueError):
        drain.check_depth(2)


def test_semantic_merge(spark):
    rows = [(0, 40, "database connection lost")] * 3 + [(1, 50, "database connection lost again")] * 2 + [(2, 40, "login rejected")]
    ranked = clusters.cluster_and_rank(entries(spark, rows))[1]
    merged = semantic.merge_similar(ranked, 0.5).orderBy("rank").collect()
    assert [(r.template, r.level, r["count"]) for r in merged] == [("database connection lost", 50, 5), ("login rejected", 40, 1)]


SECRETS = {
    "mail bob@example.com from 10.1.2.3": {"EMAIL": 1, "IPV4": 1},
    "Authorization: Bearer abcdefghijklmnop": {"BEARER": 1},
    "eyJhbGciOi.eyJzdWIi.c2lnbmF0dXJl": {"JWT": 1},
    "api_key=12345678": {"APIKEY": 1},
    "4111 1111 1111 1111 é": {"CREDITCARD": 1},
    "nothing": {},
}


def test_redaction_matches_python(spark):
    import re

    df = text.redact_counted(spark.createDataFrame([(k,) for k in SECRETS], "t string"), "t")
    for r in df.collect():
        want = r.t
        for kind, pattern in text.SECRETS:
            want = re.sub(pattern, f"[REDACTED:{kind}]", want)
        assert r.redacted == want and r.counts == SECRETS[r.t]


def test_digests_and_narration(spark):
    e = entries(spark, [(i, 40, f"failure of part {chr(97 + i % 26)}{chr(97 + i // 26)} for a@b.com") for i in range(40)])
    ranked = clusters.cluster_and_rank(e)[1]
    d = digests.pack(digests.build_digests(ranked, redact=True), 200).collect()
    assert max(r.batch for r in d) > 0 and not any("a@b.com" in r.digest for r in d)

    class Fake(providers.Offline):
        asked = 0

        def generate(self, prompt, system=None):
            Fake.asked += 1
            return "## SUMMARY:\nshort\n**ROOT_CAUSE**\ndb"

    assert "short" in providers.build_context(ranked, "s", Fake(), budget=200) and Fake.asked
    f = incident.findings(incident.plan(e), "s")
    r = providers.narrate(f, "ctx", Fake())
    assert (r.summary, r.root_cause, r.remediation) == ("short", "db", reports.MISSING)
    assert reports.model_report(f, "free text", "p", "m").summary == "free text"
    with pytest.raises(providers.NarrationError):
        providers.get_provider("nobody")


def test_novelty_stream(spark, tmp_path):
    log = tmp_path / "app.log"
    log.write_text("INFO a\nERROR x 1\n")
    reader = TailReader({"path": str(log), "from_end": "false"})
    rows, at = reader.read(reader.initialOffset())
    assert [r[2] for r in rows] == ["INFO a", "ERROR x 1"]
    with log.open("a") as f:
        f.write("ERROR x 2\nCRITICAL y\npart")
    rows, end = reader.read(at)
    assert [r[1:] for r in rows] == [(3, "ERROR x 2"), (4, "CRITICAL y")]
    assert [r[2] for r in reader.readBetweenOffsets(at, end)] == ["ERROR x 2", "CRITICAL y"]
    got = list(service.surfaced_rows(spark, str(log), "text", polls=1, wait=0))
    assert [(r["message"], r["is_new"]) for r in got] == [("x 1", True), ("x 2", False), ("y", True)]
    assert live.head_format(spark, str(log)) == "text"


def test_sinks(spark, tmp_path, monkeypatch):
    sent = []
    monkeypatch.setattr(push, "post", lambda url, payload, timeout, headers=None: (sent.append(payload), (204, ""))[1])
    r = reports.Report("s", "sum", "cause", "parts", "steps")
    assert [push.write_report(r, str(tmp_path / n)) for n in ("a.html", "a.json", "a.md")] == ["html", "json", "markdown"]
    push.notify(r, "http://x", "generic")
    assert sent[-1]["summary"] == "sum"
    monkeypatch.setattr(push, "post", lambda *a, **k: (500, "no"))
    with pytest.raises(push.PushError):
        push.notify(r, "http://x")
    s = clusters.streams(entries(spark, [(1, 40, "a 1"), (0, 40, "a 2"), (0, 30, "b")])).collect()
    assert sorted((len(x.cluster), [v.line for v in x["values"]]) for x in s) == [(10, ["a 2", "a 1"]), (10, ["b"])]


def test_command_line(spark, tmp_path, capsys):
    log = tmp_path / "a.log"
    log.write_text("\n".join(simulator.script_lines()) + "\n")
    assert cli.main(["analyze", str(log), "--no-llm", "--json", "--output", str(tmp_path / "r.html")]) == 0
    assert json.loads(capsys.readouterr().out)["cluster_count"] > 0 and (tmp_path / "r.html").exists()
    assert cli.main(["analyze", str(log), "--provider", "offline", "--redact"]) == 0
    assert cli.main(["analyze", str(log), "--min-level", "LOUD"]) == 2
    empty = tmp_path / "e.log"
    empty.write_text("")
    assert cli.main(["analyze", str(empty), "--no-llm"]) == 1
    assert cli.main(["diff", str(empty), str(log)]) == 0
    assert "new" in capsys.readouterr().out


def test_service(spark, tmp_path):
    out = service.analyze_text(spark, "\n".join(simulator.script_lines()))
    assert out["findings"]["timeline"] and out["report"]["summary"]
    with pytest.raises(PermissionError):
        service.inside(str(tmp_path), "../x")
    assert list(service.sse([{"a": 1}]))[1] == 'data: {"a": 1}\n\n'
