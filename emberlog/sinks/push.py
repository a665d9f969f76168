"""Where results go: report files, a log store's push API, webhooks. HTTP is the standard library's."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Iterable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..reports.report import Report

PUSH_PATH = "/loki/api/v1/push"
JOB = "emberlog"
MOST_LINES = 5000  # of a request
PUSH_SECONDS, WEBHOOK_SECONDS = 30.0, 15.0


class PushError(RuntimeError):
    """A sink didn't take what it was sent."""


def post(url: str, payload: dict, timeout: float, headers: dict | None = None) -> tuple[int, str]:
    """(status, body); PushError if nobody answers."""
    request = urllib.request.Request(url, json.dumps(payload).encode(), {"Content-Type": "application/json"} | (headers or {}))
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return answer.status, answer.read().decode("utf-8", "replace")
    except urllib.error.HTTPError as e:
        return e.code, e.read().decode("utf-8", "replace")
    except OSError as e:
        raise PushError(f"{url} can't be reached: {e}") from e


def write_report(report: Report, path: str) -> str:
    """By the path's ending: ``.html`` or ``.htm``, ``.json``, else Markdown. Returns which."""
    kind = {".html": "html", ".htm": "html", ".json": "json"}.get(Path(path).suffix.lower(), "markdown")
    Path(path).write_text(getattr(report, f"to_{kind}")(), encoding="utf-8")
    return kind


def push_streams(streams: DataFrame, url: str, timeout: float = PUSH_SECONDS) -> int:
    """Push `operators.clusters.streams` rows from the executors, at most ``MOST_LINES`` a request; returns the number of lines.

    A stream's slices lie in one partition and in order.
    """
    endpoint = url.rstrip("/") + PUSH_PATH

    def send(batches):
        import pandas as pd

        for batch in batches:
            for body in requests(r._asdict() for r in batch.rename(columns={"values": "lines"}).itertuples(index=False)):
                status, text = post(endpoint, {"streams": body}, timeout)
                if status not in (200, 204):
                    raise PushError(f"{endpoint} answered {status}: {text[:300]}")
                yield pd.DataFrame({"n": [sum(len(s["values"]) for s in body)]})

    key = ["source", "level_name", "cluster"]
    return streams.repartition(*key).sortWithinPartitions(*key, "slice").mapInPandas(send, "n long").groupBy().sum("n").first()[0] or 0


def requests(rows: Iterable[dict]) -> Iterator[list[dict]]:
    """The streams of each request: rows of source, level_name, cluster and lines, cut and gathered to ``MOST_LINES``."""
    body: list[dict] = []
    held = 0
    for r in rows:
        for at in range(0, len(r["lines"]), MOST_LINES):
            part = [[str(v["ts_ns"]), v["line"]] for v in r["lines"][at : at + MOST_LINES]]
            if body and held + len(part) > MOST_LINES:
                yield body
                body, held = [], 0
            body.append({"stream": {"job": JOB, "source": r["source"], "level": r["level_name"], "cluster": r["cluster"]}, "values": part})
            held += len(part)
    if body:
        yield body


class PushSink(DataSource):
    """The same as a data source: ``streams.write.format("logpush").option("url", ...).mode("append").save()``."""

    @classmethod
    def name(cls) -> str:
        return "logpush"

    def schema(self) -> str:
        return "source string, level_name string, cluster string, slice long, values array<struct<ts_ns: bigint, line: string>>"

    def writer(self, schema, overwrite: bool) -> PushWriter:
        return PushWriter(self.options["url"].rstrip("/") + PUSH_PATH)


class PushWriter(DataSourceWriter):
    def __init__(self, endpoint: str):
        self.endpoint = endpoint

    def _send(self, body: list[dict]) -> None:
        status, text = post(self.endpoint, {"streams": body}, PUSH_SECONDS)
        if status not in (200, 204):
            raise PushError(f"{self.endpoint} answered {status}: {text[:300]}")

    def write(self, rows) -> WriterCommitMessage:
        for body in requests({"source": r["source"], "level_name": r["level_name"], "cluster": r["cluster"], "lines": r["values"]} for r in rows):
            self._send(body)
        return WriterCommitMessage()


def chat_text(report: Report) -> dict:
    """The payload of a chat webhook."""
    return {"text": f"*Incident: {report.source}*\n_{report.total} lines, {report.clusters} signatures, {report.provider}/{report.model}_\n\n*Summary*\n{report.summary}\n\n*Root cause*\n{report.root_cause}\n\n*Remediation*\n{report.remediation}"}


def notify(report: Report, url: str, style: str = "slack", timeout: float = WEBHOOK_SECONDS) -> None:
    """style: ``slack`` for a chat message, ``generic`` for the report's fields."""
    status, text = post(url, chat_text(report) if style == "slack" else report.to_dict(), timeout)
    if status >= 300:
        raise PushError(f"{url} answered {status}: {text[:200]}")
