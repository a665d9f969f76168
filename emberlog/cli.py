"""``python -m emberlog``: analyze, diff, ship, watch, serve. Notices go to stderr, results to stdout.

Exit codes: 0 done, 1 no lines, 2 a bad level, 3 a model or sink failed, 4 something optional is missing.
"""

from __future__ import annotations

import argparse
import itertools
import json
import sys

from pyspark.sql import functions as F

from . import session
from .functions import severity
from .narration import providers
from .operators import clusters, parsing
from .plans import incident
from .reports import report as reports
from .scratch import folder
from .sinks import push
from .sources import text as sources
from .streaming import live


TABLE_ROWS = 10_000


def _say(message: str) -> None:
    print(message, file=sys.stderr)


def _entries(spark, paths: list[str], fmt: str | None, source: str | None = None):
    """Entries of all inputs as one log, named after them."""
    parsed = sources.renumber(parsing.parse_lines(sources.read_lines(spark, paths), fmt))
    return parsed.withColumn("source", F.lit(source or ", ".join(p.rsplit("/", 1)[-1] for p in paths)))


def _positive(value: str) -> int:
    if (n := int(value)) < 1:
        raise argparse.ArgumentTypeError("it is at least 1")
    return n


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="emberlog", description="Triage logs with Spark.")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, about: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=about)
        c.add_argument("--format", choices=parsing.FORMATS)
        c.add_argument("--min-level", default="WARNING")
        c.add_argument("--redact", action="store_true")
        return c

    a = command("analyze", "signatures, onset, cascade and a report")
    a.add_argument("paths", nargs="+", help="files, directories, or - for standard input")
    a.add_argument("--top", type=_positive, default=8)
    a.add_argument("--drain", action="store_true")
    a.add_argument("--semantic", action="store_true")
    a.add_argument("--embedder", choices=("tfidf", "ollama"), default="tfidf")
    a.add_argument("--infer-severity", action="store_true")
    a.add_argument("--baseline", help="a healthy log to learn expected error rates from")
    a.add_argument("--provider")
    a.add_argument("--model")
    a.add_argument("--no-llm", action="store_true")
    a.add_argument("--token-budget", type=int, default=providers.BUDGET)
    a.add_argument("--output")
    a.add_argument("--json", action="store_true")
    a.add_argument("--webhook")
    a.add_argument("--notify-style", choices=("slack", "generic"), default="slack")
    d = command("diff", "what changed between two logs")
    d.add_argument("before")
    d.add_argument("after")
    d.add_argument("--drain", action="store_true")
    d.add_argument("--all", action="store_true", help="unchanged signatures too")
    s = command("ship", "push a log's streams to a log store")
    s.add_argument("paths", nargs="+")
    s.add_argument("--url", default="http://localhost:3100")
    s.add_argument("--source", help="the source's name in the store")
    w = command("watch", "follow growing files")
    w.set_defaults(min_level="ERROR")
    w.add_argument("path", help="a path or pattern")
    w.add_argument("--from-start", action="store_true")
    w.add_argument("--interval", default="1 second")
    v = command("serve", "an HTTP service")
    v.add_argument("--host", default="127.0.0.1")
    v.add_argument("--port", type=int, default=8000)
    v.add_argument("--logs", default=".", help="the folder that may be read")
    v.add_argument("--provider", help="the model that answers questions")
    return p


def analyze(spark, args, least: int) -> int:
    entries = _entries(spark, args.paths, args.format).cache()
    n = entries.count()
    if not n:
        _say("There are no log lines.")
        return 1
    options = incident.Options(args.top, least, "drain" if args.drain else "regex", args.semantic, args.infer_severity, embedder=args.embedder, baseline=_entries(spark, [args.baseline], args.format) if args.baseline else None)
    p = incident.plan(entries, options)
    source = entries.select("source").first()[0]
    f = incident.findings(p, source, args.redact)
    if not f.clusters:
        _say(f"{n} lines, none at {args.min_level} or above.")
        return 0
    if not args.json:
        print(reports.render(f))
    if args.no_llm:
        r = reports.deterministic_report(f)
    else:
        try:
            model = providers.get_provider(args.provider, args.model)
            r = providers.narrate(f, providers.build_context(p.clusters, source, model, args.redact, args.token_budget), model)
        except providers.NarrationError as e:
            _say(f"The model failed: {e}")
            return 3
    print(r.to_json() if args.json else "\n" + r.to_markdown())
    if args.output:
        _say(f"{push.write_report(r, args.output)} written to {args.output}")
    if args.webhook:
        try:
            push.notify(r, args.webhook, args.notify_style)
        except push.PushError as e:
            _say(f"The webhook failed: {e}")
    return 0


def diff(spark, args, least: int) -> int:
    method = "drain" if args.drain else "regex"
    sides = [clusters.cluster_and_rank(_entries(spark, [p], args.format), None, least, method)[1] for p in (args.before, args.after)]
    changes = clusters.diff_clusters(*sides)
    shown = clusters.ordered_diff(changes if args.all else changes.where("status <> 'unchanged'"))
    counts = {r["status"]: r["count"] for r in clusters.status_counts(changes).collect()}  # five at most
    print(reports.render_counts({x: counts[x] for x in clusters.STATUS_ORDER if x in counts}))
    rows = (r.asDict() | {"level": incident.NAMES.get(r["level"], "?")} for r in shown.toLocalIterator())
    columns = ["status", "level", "before", "after", "template"]
    print(reports.table(list(itertools.islice(rows, TABLE_ROWS)), columns))
    while more := list(itertools.islice(rows, TABLE_ROWS)):  # all of them, aligned so many at a time
        print(reports.table(more, columns))
    return 0


def ship(spark, args, least: int) -> int:
    entries = _entries(spark, args.paths, args.format, args.source).where(severity.at_least(F.col("level"), least))
    try:
        _say(f"{push.push_streams(clusters.streams(entries, args.redact), args.url)} lines pushed")
    except Exception as e:  # noqa: BLE001 - a task's failure comes wrapped
        _say(f"The push failed: {str(e)[:300]}")
        return 3
    return 0


def watch(spark, args, least: int) -> int:
    from .sources.tail import TailSource

    spark.dataSource.register(TailSource)
    lines = spark.readStream.format("tail").option("path", args.path).option("from_end", str(not args.from_start).lower()).load()
    fmt = args.format or live.head_format(spark, args.path)
    rows = live.flag_new(live.surface(lines, fmt, least, args.redact))

    def show(batch, _):
        for r in batch.orderBy("line_no").toLocalIterator():
            print(json.dumps(r.asDict(), default=str, ensure_ascii=False), flush=True)

    query = rows.writeStream.foreachBatch(show).trigger(processingTime=args.interval).option("checkpointLocation", folder(spark, "watch")).start()
    try:
        query.awaitTermination()
    except KeyboardInterrupt:
        query.stop()
    return 0


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    least = severity.level_number(args.min_level)
    if least is None:
        _say(f"{args.min_level!r} is no level; there are {', '.join(severity.LEVELS)}.")
        return 2
    if args.command == "serve":
        from . import service

        try:
            model = providers.get_provider(args.provider) if args.provider else None
        except providers.NarrationError as e:
            _say(f"That provider isn't to be had: {e}")
            return 4
        return service.serve(session.get_session(), args.host, args.port, args.logs, model)
    return {"analyze": analyze, "diff": diff, "ship": ship, "watch": watch}[args.command](session.get_session(), args, least)
