"""Language models that put findings into words: an interface, an offline stand-in, and HTTP providers.

Keys come from the environment, by each service's usual name. All providers post JSON and read one text out of the
answer, so they differ only in a row of a table.
"""

from __future__ import annotations

import os
from abc import ABC, abstractmethod
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import digests
from ..plans.incident import Findings
from ..reports.report import SECTIONS, Report, evidence, model_report
from ..sinks.push import PushError, post

TIMEOUT = 120.0
BUDGET, LEAST_BATCH = 6000, 1000
DEFAULT = "ollama"


class NarrationError(RuntimeError):
    """A model couldn't be asked or gave no answer."""


class Provider(ABC):
    name = "abstract"

    def __init__(self, model: str, timeout: float = TIMEOUT):
        self.model, self.timeout = model, timeout

    @abstractmethod
    def generate(self, prompt: str, system: str | None = None) -> str: ...


class Offline(Provider):
    """Answers with the prompt's first lines; for tests and machines without a network."""

    name = "offline"

    def __init__(self, model: str = "echo", timeout: float = TIMEOUT):
        super().__init__(model, timeout)

    def generate(self, prompt: str, system: str | None = None) -> str:
        return "SUMMARY\n" + "\n".join(prompt.splitlines()[:5])


@dataclass(frozen=True)
class Service:
    url: str
    key: str | None
    model: str
    headers: Callable[[str], dict]
    body: Callable[[str, str, str | None], dict]
    answer: Callable[[dict], str]


def _chat(model: str, prompt: str, system: str | None) -> dict:
    return {"model": model, "messages": [*([{"role": "system", "content": system}] if system else []), {"role": "user", "content": prompt}]}


def _bearer(key: str) -> dict:
    return {"Authorization": f"Bearer {key}"}


#: The public addresses and shapes of the services.
SERVICES = {
    "ollama": Service("http://localhost:11434/api/generate", None, "llama3.1", lambda k: {}, lambda m, p, s: {"model": m, "prompt": p, "stream": False} | ({"system": s} if s else {}), lambda a: a["response"]),
    "openai": Service("https://api.openai.com/v1/chat/completions", "OPENAI_API_KEY", "gpt-4o-mini", _bearer, _chat, lambda a: a["choices"][0]["message"]["content"]),
    "openrouter": Service("https://openrouter.ai/api/v1/chat/completions", "OPENROUTER_API_KEY", "meta-llama/llama-3.1-8b-instruct:free", _bearer, _chat, lambda a: a["choices"][0]["message"]["content"]),
    "gemini": Service(
        "https://generativelanguage.googleapis.com/v1beta/models/{model}:generateContent", "GEMINI_API_KEY", "gemini-2.0-flash", lambda k: {"x-goog-api-key": k},
        lambda m, p, s: {"contents": [{"parts": [{"text": p}]}]} | ({"system_instruction": {"parts": [{"text": s}]}} if s else {}), lambda a: a["candidates"][0]["content"]["parts"][0]["text"],
    ),
    "anthropic": Service(
        "https://api.anthropic.com/v1/messages", "ANTHROPIC_API_KEY", "claude-3-5-haiku-latest", lambda k: {"x-api-key": k, "anthropic-version": "2023-06-01"},
        lambda m, p, s: {"model": m, "max_tokens": 1024, "messages": [{"role": "user", "content": p}]} | ({"system": s} if s else {}), lambda a: a["content"][0]["text"],
    ),
}


class HttpProvider(Provider):
    def __init__(self, name: str, model: str | None = None, timeout: float = TIMEOUT, url: str | None = None):
        self.name, self.service = name, SERVICES[name]
        super().__init__(model or self.service.model, timeout)
        self.url = url or self.service.url.format(model=self.model)

    def generate(self, prompt: str, system: str | None = None) -> str:
        key = os.environ.get(self.service.key) if self.service.key else ""
        if key is None:
            raise NarrationError(f"set {self.service.key} to ask {self.name}")
        import json

        try:
            status, body = post(self.url, self.service.body(self.model, prompt, system), self.timeout, self.service.headers(key))
        except PushError as e:
            raise NarrationError(str(e)) from e
        if status >= 400:
            raise NarrationError(f"{self.name} answered {status}: {body[:200]}")
        try:
            answer = self.service.answer(json.loads(body))
        except (ValueError, KeyError, IndexError, TypeError) as e:
            raise NarrationError(f"{self.name} gave an answer of another shape") from e
        if not answer:
            raise NarrationError(f"{self.name} gave an empty answer")
        return str(answer).strip()


def available() -> list[str]:
    return sorted([*SERVICES, Offline.name])


def get_provider(name: str | None = None, model: str | None = None, timeout: float = TIMEOUT) -> Provider:
    """By name, else by $EMBERLOG_PROVIDER, else the default."""
    name = (name or os.environ.get("EMBERLOG_PROVIDER") or DEFAULT).lower()
    if name == Offline.name:
        return Offline(**({"model": model} if model else {}), timeout=timeout)
    if name not in SERVICES:
        raise NarrationError(f"no provider is called {name!r}; there are {', '.join(available())}")
    return HttpProvider(name, model, timeout)


REDUCE = "Shorten these log error signatures to the distinct failures, how severe and frequent each is. Keep the signatures' own words. Don't speculate."
TRIAGE = "You are an engineer on call. Explain the incident from the evidence; where evidence and signatures disagree, the evidence is right."


def _tokens(x: str) -> int:
    return max(1, len(x) // text.CHARS_PER_TOKEN)


def build_context(ranked: DataFrame, source: str, provider: Provider, redact: bool = False, budget: int = BUDGET) -> str:
    """The digests of a source's ranked clusters if they fit the budget; else each batch of them is shortened by the
    model, and, if that is still too long, all of it once more."""
    d = digests.pack(digests.build_digests(ranked.where(F.col("source") == source), redact), max(LEAST_BATCH, budget // 2))
    rows = d.orderBy("rank").select("digest", "batch").collect()  # as many as the ranking's top-n
    whole = "\n\n".join(r["digest"] for r in rows)
    if _tokens(whole) <= budget:
        return whole
    batches: dict[int, list[str]] = {}
    for r in rows:
        batches.setdefault(r["batch"], []).append(r["digest"])
    short = [provider.generate(f"Batch {i} of {len(batches)}:\n\n" + "\n\n".join(b), REDUCE) for i, b in enumerate(batches.values(), 1)]
    joined = "\n\n".join(f"## Batch {i}\n{s}" for i, s in enumerate(short, 1))
    return joined if _tokens(joined) <= budget else provider.generate(f"Shorten these further, into one:\n\n{joined}", REDUCE)


def narrate(f: Findings, context: str, provider: Provider) -> Report:
    """Ask for the four sections over the evidence and the context. Both come redacted if the findings were."""
    heads = "\n".join(SECTIONS)
    prompt = f"Write a report with these headings, each on its own line:\n{heads}\n\n{evidence(f)}\n\n=== Signatures, most severe first ===\n{context}"
    return model_report(f, provider.generate(prompt, TRIAGE), provider.name, provider.model)
