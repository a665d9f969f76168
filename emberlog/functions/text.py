"""Message functions: templates, components, signatures, redaction, token estimates, tokenizers. JVM only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What varies in messages, in the order of replacement. ``(?U)``: classes cover all of Unicode.
TEMPLATE_RULES = (
    (r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", "<UUID>"),
    (r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?::\d+)?\b", "<IP>"),
    (r"0x[0-9a-fA-F]+", "<HEX>"),
    (r"\b[0-9a-fA-F]{16,}\b", "<HASH>"),
    (r"\b\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?\b", "<TS>"),
    (r"/[\w./\-]+", "<PATH>"),
    (r"(?i)\b\d+(?:\.\d+)?(?:ms|s|kb|mb|gb)?\b", "<NUM>"),
    (r'"[^"]*"', "<STR>"),
    (r"'[^']*'", "<STR>"),
    (r"\s+", " "),
)
#: Fixed value: the tag at a message's beginning.
COMPONENT = r"^[\s>]*[\[(]([A-Za-z0-9_.\-/]+)[\])]"
#: What is redacted, in order.
SECRETS = (
    ("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
    ("JWT", r"\beyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\b"),
    ("BEARER", r"(?i)\b(bearer|token|authorization)\s*[:=]?\s*[A-Za-z0-9._\-]{12,}"),
    ("APIKEY", r"(?i)\b(?:api[_-]?key|secret|password|passwd|pwd|access[_-]?key)\s*[:=]\s*\S+"),
    ("SECRET_PREFIX", r"\b(?:sk|pk|ghp|gho|xox[baprs]|AKIA)[-_][A-Za-z0-9]{8,}\b"),
    ("CREDITCARD", r"\b(?:\d[ -]?){13,16}\b"),
    ("IPV6", r"\b(?:[A-Fa-f0-9]{1,4}:){2,7}[A-Fa-f0-9]{1,4}\b"),
    ("IPV4", r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b"),
)
CHARS_PER_TOKEN = 4


def strip(text: Column) -> Column:
    """Without white space at either end; `trim` takes spaces only."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalize(message: Column) -> Column:
    """The template of a message: what varies becomes a placeholder."""
    return strip(reduce(lambda text, rule: F.regexp_replace(text, "(?U)" + rule[0], rule[1]), TEMPLATE_RULES, strip(message)))


def component_of(message: Column) -> Column:
    """The ``[name]`` or ``(name)`` that a message begins with, or null."""
    return F.nullif(F.regexp_extract(message, "(?U)" + COMPONENT, 1), F.lit(""))


def signature(message: Column) -> Column:
    return template_signature(normalize(message))


def template_signature(template: Column) -> Column:
    """Ten hex digits that name a template."""
    return F.substring(F.sha1(template), 1, 10)


KINDS = tuple(kind for kind, _ in SECRETS)


def redact(text: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """The text with what is secret or personal replaced by ``[REDACTED:KIND]``."""
    return reduce(lambda x, rule: F.regexp_replace(x, "(?U)" + rule[1], f"[REDACTED:{rule[0]}]") if rule[0] in kinds else x, SECRETS, text)


def redact_counted(df, column: str, text: str = "redacted", counts: str = "counts", kinds: tuple[str, ...] = KINDS):
    """A DataFrame with the redacted text and how often each kind was found, on the text as redacted so far.

    Each rule is a column of its own, so that its count and the next rule read the same text.
    """
    rules = [r for r in SECRETS if r[0] in kinds]
    steps = [f"__r{i}" for i in range(len(rules) + 1)]
    df = df.withColumn(steps[0], F.col(column))
    for i, (kind, pattern) in enumerate(rules):
        df = df.withColumn(f"__n{i}", F.regexp_count(steps[i], F.lit("(?U)" + pattern))).withColumn(steps[i + 1], F.regexp_replace(steps[i], "(?U)" + pattern, f"[REDACTED:{kind}]"))
    found = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(kind).alias("k"), F.col(f"__n{i}").alias("n")) for i, (kind, _) in enumerate(rules)]), lambda e: e["n"] > 0))
    return df.withColumn(counts, found).withColumn(text, F.col(steps[-1])).drop(*steps, *[f"__n{i}" for i in range(len(rules))])


def estimate_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / CHARS_PER_TOKEN).cast("int"))


def split_words(text: Column) -> Column:
    """Words between white space; none in a blank text."""
    return F.filter(F.split(strip(text), r"(?U)\s+"), lambda x: x != "")


def letter_words(text: Column) -> Column:
    """Lower-case runs of A-Z."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))


def clock(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "HH:mm:ss"), F.lit("--:--:--"))
