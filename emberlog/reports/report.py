"""Reports on one source's findings: evidence text, a report without a model, section parsing, and encoders.

All of it is plain Python over the few rows in `Findings`.
"""

from __future__ import annotations

import html
import json
import re
from dataclasses import dataclass, field
from datetime import datetime
from string import Template

from ..functions.scoring import label_of
from ..plans.incident import NAMES, Findings

PRODUCT = "emberlog"
#: How much of each kind the evidence shows.
SPIKES, LINKS, BURSTS, TEMPLATE_CHARS = 5, 8, 5, 60
SECTIONS = ("SUMMARY", "ROOT_CAUSE", "AFFECTED_COMPONENTS", "REMEDIATION")
MISSING = "(the model gave none)"


def _clock(ts: datetime | None) -> str:
    return f"{ts:%H:%M:%S}" if ts else "--:--:--"


def _sure(value: float) -> str:
    return f"confidence {value:.2f}, {label_of(value)}"


def _node(f: Findings, i: int) -> str:
    return f"[{f.events[i]['component'] or '?'}]"


def components(f: Findings) -> list[str]:
    return list(dict.fromkeys(e["component"] or "(uncomponented)" for e in f.timeline))


def evidence(f: Findings) -> str:
    """The computed facts, as lines of text."""
    out = ["=== Computed evidence: deterministic, to be preferred to guesses ===", f"Bucket width: {f.bucket_seconds} s"]
    if f.onset:
        out.append(f"Onset: {f.onset.isoformat()} ({f.baseline_errors} errors a bucket before, {f.peak_errors} at the peak; {_sure(f.onset_confidence)})")
    else:
        out.append("Onset: none, errors are spread evenly")
    if f.spikes:
        out.append("Spikes: " + ", ".join(f"{_clock(s['start'])} with {s['errors']} errors (z={s['z']:.1f})" for s in f.spikes[:SPIKES]))
    if f.trigger is not None:
        e = f.events[f.trigger]
        out.append(f"Trigger: {e['template']} at {_clock(e['first_seen'])} ({_sure(f.trigger_confidence)})")
    if f.cascade:
        out.append("Cascade:")
        for x in f.cascade[:LINKS]:
            cause, effect = (f.events[x[k]]["template"][:TEMPLATE_CHARS] for k in ("cause", "effect"))
            out.append(f"  {cause} -> {effect} (after {x['lag_seconds']:.0f} s, overlap {x['jaccard']}, confidence {x['confidence']})")
    if f.bursts:
        out.append("Bursts:")
        out += [f"  {NAMES.get(b['level'], '?')} {b['template'][:TEMPLATE_CHARS]}: {b['peak_count']} of {b['count']} within a bucket's width ({b['concentration']:.0%})" for b in f.bursts[:BURSTS]]
    return "\n".join(out)


@dataclass
class Report:
    source: str
    summary: str
    root_cause: str
    affected_components: str
    remediation: str
    provider: str = "none"
    model: str = PRODUCT
    clusters: int = 0
    total: int = 0
    generated_at: datetime = field(default_factory=datetime.now)
    raw: str = ""

    def to_dict(self) -> dict:
        return {
            "source": self.source, "generated_at": self.generated_at.isoformat(), "provider": self.provider, "model": self.model, "cluster_count": self.clusters, "total_errors": self.total,
            "summary": self.summary, "root_cause": self.root_cause, "affected_components": self.affected_components, "remediation": self.remediation,
        }

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), indent=2, ensure_ascii=False)

    def _parts(self) -> list[tuple[str, str]]:
        return [("Summary", self.summary), ("Likely root cause", self.root_cause), ("Affected components", self.affected_components), ("Remediation", self.remediation)]

    def _head(self) -> str:
        return f"{self.total} lines in {self.clusters} signatures; by {self.provider}/{self.model}, {self.generated_at:%Y-%m-%d %H:%M:%S}"

    def to_markdown(self) -> str:
        return "\n\n".join([f"# Incident report: {self.source}", f"*{self._head()}*", *(f"## {title}\n\n{body}" for title, body in self._parts())]) + "\n"

    def to_html(self) -> str:
        body = "\n".join(f"<section><h2>{html.escape(t)}</h2><p>{html.escape(b).replace(chr(10), '<br>')}</p></section>" for t, b in self._parts())
        return _PAGE.substitute(source=html.escape(self.source), head=html.escape(self._head()), body=body)


_PAGE = Template("""<!doctype html>
<html lang="en">
<head>
<meta charset="utf-8">
<title>Incident report: $source</title>
<style>body{font-family:sans-serif;max-width:50rem;margin:auto;padding:1rem}section{border-top:1px solid #999}</style>
</head>
<body>
<h1>Incident report: $source</h1>
<p>$head</p>
$body
</body>
</html>
""")


def deterministic_report(f: Findings) -> Report:
    """A report from the findings alone."""
    parts = components(f)
    if f.onset:
        summary = f"Errors rose at {_clock(f.onset)}, from about {f.baseline_errors} to {f.peak_errors} in {f.bucket_seconds} s."
    else:
        summary = f"No sudden rise: errors stayed at about {f.baseline_errors} in {f.bucket_seconds} s."
    summary += f" Spikes: {len(f.spikes)}; bursty signatures: {len(f.bursts)}; components: {len(parts)}."
    steps = []
    if f.trigger is None:
        cause = "The times point at no single origin; look at the top signatures."
    else:
        e = f.events[f.trigger]
        after = sum(x["cause"] == f.trigger for x in f.cascade)
        summary += f" First to fail was {_node(f, f.trigger)}; failures that followed it: {after}."
        cause = f"Probably {e['template']}, first at {_clock(e['first_seen'])}, seen {e['count']} times ({_sure(f.trigger_confidence)})."
        if path := f.chain():
            cause += " It spread along " + " -> ".join(_node(f, i) for i in path) + "."
        steps.append(f"Look into {_node(f, f.trigger)}: it failed first.")
    if f.onset:
        steps.append(f"Compare with deployments and configuration changes around {_clock(f.onset)}.")
    if f.bursts:
        b = f.bursts[0]
        steps.append(f"Alert on the rate of '{b['template'][:50]}': {b['peak_count']} came within {f.bucket_seconds} s.")
    steps.append("Alert on errors that leave their usual rate.")
    return Report(
        f.source, summary, cause, "\n".join(f"- {p}" for p in parts) or "- (none)", "\n".join(f"{i}. {s}" for i, s in enumerate(steps, 1)),
        "deterministic", PRODUCT, len(f.clusters), f.total, raw=evidence(f),
    )


def split_sections(answer: str) -> dict[str, str]:
    """What a model wrote under each of ``SECTIONS``; marks around a heading don't matter."""
    heading = re.compile(r"^[#*\s]*(" + "|".join(SECTIONS) + r")[\s:*]*$", re.IGNORECASE | re.MULTILINE)
    pieces = heading.split(answer)
    return {name.upper(): body.strip() for name, body in zip(pieces[1::2], pieces[2::2], strict=True)}


def model_report(f: Findings, answer: str, provider: str, model: str) -> Report:
    """A report of a model's answer; without headings all of it is the summary."""
    s = split_sections(answer)
    return Report(f.source, s.get("SUMMARY", answer.strip()), s.get("ROOT_CAUSE", MISSING), s.get("AFFECTED_COMPONENTS", MISSING), s.get("REMEDIATION", MISSING), provider, model, len(f.clusters), f.total, raw=answer)


def table(rows: list[dict], columns: list[str]) -> str:
    """Rows as an aligned text table."""
    cells = [columns, *[[str(r.get(c, "")) for c in columns] for r in rows]]
    widths = [max(len(r[i]) for r in cells) for i in range(len(columns))]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(r, widths, strict=True)).rstrip() for r in cells)


def _titled(title: str, rows: list[dict], columns: list[str]) -> str:
    return f"{title}\n{'-' * len(title)}\n{table(rows, columns)}" if rows else ""


def render(f: Findings) -> str:
    """Clusters, timeline, cascade, bursts and evidence for a terminal."""
    named = lambda c: {"level": NAMES.get(c["level"], "?"), "count": c["count"], "component": c.get("component") or "", "template": c["template"][:90]}
    events = [named(e) | {"": ">" if e["order"] == f.trigger else "", "first seen": f"{e['first_seen']:%H:%M:%S}"} for e in f.timeline]
    links = [{"cause": _node(f, x["cause"]), "effect": _node(f, x["effect"]), "lag": f"{x['lag_seconds']:.1f}s", "overlap": x["jaccard"], "confidence": x["confidence"]} for x in f.cascade]
    bursts = [named(b) | {"in one window": f"{b['peak_count']} ({b['concentration']:.0%})", "confidence": b["confidence"]} for b in f.bursts]
    blocks = [
        _titled("Signatures", [named(c) for c in f.clusters], ["level", "count", "component", "template"]),
        _titled("Timeline (> is the likely trigger)", events, ["", "first seen", "level", "count", "component", "template"]),
        _titled("Cascade", links, ["cause", "effect", "lag", "overlap", "confidence"]),
        _titled("Bursts", bursts, ["level", "in one window", "confidence", "template"]),
        evidence(f),
    ]
    more = [f"{n} more {kind} aren't shown" for kind, n in f.not_shown.items()]
    return "\n\n".join(x for x in [*blocks, *more] if x)


def render_counts(counts: dict[str, int]) -> str:
    """A diff's first line: how many signatures of each status there are."""
    return ", ".join(f"{n} {status}" for status, n in counts.items()) or "no signatures"
