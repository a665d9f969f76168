"""A small HTTP service over the same operators, on the standard library's server.

GET /healthz, / and /api/stream?path=; POST /api/analyze (a log as the body, or a form of file, path, level, drain and
semantic), /api/simulate?speed=, /api/simulate/stop and /api/chat ({"question": ..., "log": ..., "path": ...}).
"""

from __future__ import annotations

import email
import json
import tempfile
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path
from urllib.parse import parse_qs, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import severity
from .narration import providers
from .operators import parsing
from .plans import incident
from .reports import report as reports
from .sources import simulator
from .sources import text as sources
from .sources.tail import TailReader
from .streaming import live

#: The page follows a log, and has it analysed anew every three seconds.
PAGE = """<!doctype html><meta charset="utf-8"><title>emberlog</title><h1>emberlog</h1>
<form id="ask"><input name="path" placeholder="log in the folder"> <select name="level"><option>WARNING<option>ERROR<option>CRITICAL<option>INFO</select>
<label><input type="checkbox" name="drain"> drain</label> <label><input type="checkbox" name="semantic"> merge alike</label> <button>Follow</button></form>
<h2>Live</h2><pre id="live"></pre><h2>Findings</h2><pre id="found"></pre>
<script>
const ask = document.getElementById("ask"), live = document.getElementById("live"), found = document.getElementById("found");
let stream, clock;
const analyse = async () => { const r = await fetch("/api/analyze", {method: "POST", body: new URLSearchParams(new FormData(ask))}); found.textContent = JSON.stringify(await r.json(), null, 1); };
ask.onsubmit = event => {
  event.preventDefault(); if (stream) stream.close(); clearInterval(clock); live.textContent = "";
  stream = new EventSource("/api/stream?path=" + encodeURIComponent(ask.path.value));
  stream.onmessage = e => { const x = JSON.parse(e.data); live.textContent += (x.is_new ? "NEW " : "    ") + x.ts + " " + x.message + "\\n"; };
  analyse(); clock = setInterval(analyse, 3000);
};
</script>"""


def inside(folder: str, name: str) -> Path:
    """The path of a name within the folder; PermissionError for one outside."""
    root = Path(folder).resolve()
    path = (root / name).resolve()
    if not path.is_relative_to(root):
        raise PermissionError(f"{name} is outside the log folder")
    return path


def analyze_text(spark: SparkSession, body: str, source: str = "upload", redact: bool = True, least: int = 30, method: str = "regex", merge: bool = False) -> dict:
    """Findings over all clusters of a log, and a report."""
    return _analyzed(spark, sources.from_iterable(spark, body.splitlines(), source), source, redact, incident.Options(None, least, method, merge))


def analyze_file(spark: SparkSession, path: Path, redact: bool = True, **options) -> dict:
    lines = sources.read_lines(spark, str(path))
    return _analyzed(spark, lines.withColumn("source", F.lit(path.name)), path.name, redact, incident.Options(None, **options))


def _analyzed(spark: SparkSession, lines: DataFrame, source: str, redact: bool, options: incident.Options) -> dict:
    plan = incident.plan(parsing.parse_lines(lines), options)
    f = incident.findings(plan, source, redact)
    plan.release()
    return {"findings": incident.to_dict(f), "report": reports.deterministic_report(f).to_dict(), "clusters": [{k: str(v) for k, v in c.items()} for c in f.clusters]}


def form_fields(body: str, kind: str) -> dict[str, str]:
    """The fields of a multipart or url-encoded form; any other body is the field ``file``."""
    if kind.startswith("multipart/form-data"):
        message = email.message_from_string(f"Content-Type: {kind}\n\n{body}")
        parts = message.get_payload() if message.is_multipart() else []
        return {p.get_param("name", header="content-disposition"): p.get_payload(decode=False).removesuffix("\n") for p in parts}
    if kind.startswith("application/x-www-form-urlencoded"):
        return {k: v[0] for k, v in parse_qs(body).items()}
    return {"file": body}


def sse(rows, seconds: float | None = None):
    """Server-sent events: one that says connected, then a JSON object for each row."""
    yield ": connected\n\n"
    for row in rows:
        yield f"data: {json.dumps(row, default=str, ensure_ascii=False)}\n\n"


def surfaced_rows(spark: SparkSession, path: str, fmt: str, least: int = 40, redact: bool = False, polls: int | None = None, wait: float = 0.5):
    """What a growing file surfaces, batch by batch, with first sightings of the session marked."""
    reader = TailReader({"path": path, "from_end": "false"})
    at, seen = reader.initialOffset(), set()
    while polls is None or polls > 0:
        rows, at = reader.read(at)
        if rows := list(rows):
            batch = live.surface(spark.createDataFrame(rows, sources.LINES), fmt, least, redact)
            for r in batch.orderBy("line_no").toLocalIterator():
                yield r.asDict() | {"is_new": r["template"] not in seen}
                seen.add(r["template"])
        polls = None if polls is None else polls - 1
        time.sleep(wait)


def make_handler(spark: SparkSession, logs: str, provider: providers.Provider | None = None):
    simulated = simulator.Writer(str(Path(tempfile.mkdtemp(prefix="emberlog-sim-")) / "simulated.log"))

    class Handler(BaseHTTPRequestHandler):
        def _send(self, status: int, body: str, kind: str = "application/json") -> None:
            data = body.encode()
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def _json(self, value, status: int = 200) -> None:
            self._send(status, json.dumps(value, default=str))

        def do_GET(self) -> None:  # noqa: N802
            url = urlparse(self.path)
            if url.path == "/healthz":
                return self._json({"status": "ok"})
            if url.path == "/":
                return self._send(200, PAGE, "text/html")
            if url.path != "/api/stream":
                return self._json({"error": "not found"}, 404)
            name = parse_qs(url.query).get("path", [""])[0]
            try:
                path = inside(logs, name) if name else Path(simulated.path)
            except PermissionError as e:
                return self._json({"error": str(e)}, 403)
            if not path.exists():
                return self._json({"error": "no such log"}, 404)
            self.send_response(200)
            self.send_header("Content-Type", "text/event-stream")
            self.end_headers()
            try:
                for event in sse(surfaced_rows(spark, str(path), live.head_format(spark, str(path)))):
                    self.wfile.write(event.encode())
                    self.wfile.flush()
            except (BrokenPipeError, ConnectionResetError):
                return None

        def do_POST(self) -> None:  # noqa: N802
            size = int(self.headers.get("Content-Length") or 0)
            try:
                sources.check_upload(size)
            except ValueError as e:
                return self._json({"error": str(e)}, 413)
            body = self.rfile.read(size).decode("utf-8", "replace")
            url = urlparse(self.path)
            if url.path == "/api/analyze":
                return self._analyze(form_fields(body, self.headers.get("Content-Type") or "") | {k: v[0] for k, v in parse_qs(url.query).items()})
            if url.path == "/api/simulate":
                simulated.speed = max(0.1, float(parse_qs(url.query).get("speed", ["1"])[0]))
                return self._json({"started": simulated.start(), "path": simulated.path, "speed": simulated.speed})
            if self.path == "/api/simulate/stop":
                simulated.stop()
                return self._json({"stopped": True})
            if self.path == "/api/chat":
                try:
                    asked = json.loads(body)
                    facts = json.dumps(analyze_text(spark, asked["log"]), default=str) if asked.get("log") else ""
                    if asked.get("path"):
                        facts += json.dumps(analyze_file(spark, inside(logs, asked["path"])), default=str)
                    model = provider or providers.get_provider()
                    return self._json({"answer": model.generate(f"{facts}\n\n{asked['question']}", providers.TRIAGE)})
                except PermissionError as e:
                    return self._json({"error": str(e)}, 403)
                except (ValueError, KeyError):
                    return self._json({"error": "send {\"question\": ..., \"log\": ..., \"path\": ...}"}, 400)
                except providers.NarrationError as e:
                    return self._json({"error": str(e)}, 502)
            return self._json({"error": "not found"}, 404)

        def _analyze(self, asked: dict[str, str]) -> None:
            """path: a log in the folder, else ``file`` or the body is one; level, drain, semantic as on the command line."""
            least = severity.level_number(asked.get("level") or "WARNING")
            if least is None:
                return self._json({"error": f"{asked['level']!r} is no level"}, 400)
            yes = lambda name: asked.get(name, "").lower() in ("1", "true", "on", "yes")
            method = "drain" if yes("drain") else "regex"
            try:
                if asked.get("path"):
                    path = inside(logs, asked["path"])
                    if not path.exists():
                        return self._json({"error": "no such log"}, 404)
                    return self._json(analyze_file(spark, path, least=least, method=method, semantic=yes("semantic")))
            except PermissionError as e:
                return self._json({"error": str(e)}, 403)
            body = asked.get("file", "")
            if not body.strip():
                return self._json({"error": "an empty log"}, 400)
            return self._json(analyze_text(spark, body, least=least, method=method, merge=yes("semantic")))

        def log_message(self, *args) -> None:
            pass

    return Handler


def serve(spark: SparkSession, host: str, port: int, logs: str, provider: providers.Provider | None = None) -> int:
    server = ThreadingHTTPServer((host, port), make_handler(spark, logs, provider))
    try:
        server.serve_forever()
    except KeyboardInterrupt:
        server.server_close()
    return 0
