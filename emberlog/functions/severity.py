"""Severities as integers, so that their order is the integers' order; null is no severity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

#: The severities and what they are called in logs.
LEVELS = {"TRACE": 5, "DEBUG": 10, "INFO": 20, "NOTICE": 25, "WARNING": 30, "ERROR": 40, "CRITICAL": 50}
ALIASES = {
    "TRACE": 5, "DEBUG": 10, "DBG": 10, "INFO": 20, "INFORMATION": 20, "NOTICE": 25, "WARN": 30, "WARNING": 30,
    "ERROR": 40, "ERR": 40, "FATAL": 50, "CRIT": 50, "CRITICAL": 50, "EMERGENCY": 50, "PANIC": 50,
}
TEXT_TOKENS = "TRACE|DEBUG|DBG|INFO|NOTICE|WARN|WARNING|ERROR|ERR|FATAL|CRIT|CRITICAL|EMERGENCY|PANIC"
SYSLOG_LEVELS = (50, 50, 50, 40, 30, 25, 20, 10)  # by PRI modulo 8
#: Words that tell a severity, most severe first; case doesn't matter, nor what stands around them.
SIGNS = (
    (50, ("panic", "fatal", "segfault", "segmentation fault", "out of memory", "oom", "emergency", "unrecoverable", "data loss", "corruption", "kernel", "core dumped")),
    (40, ("error", "exception", "traceback", "stack trace", "stacktrace", "failed", "failure", "cannot", "could not", "couldn't", "unable", "refused", "timeout", "timed out",
          "denied", "rejected", "crash", "abort", "unhandled", "500", "502", "503", "504")),
    (30, ("warn", "warning", "deprecated", "deprecation", "retry", "retrying", "slow", "throttl", "degraded", "fallback", "high latency", "backpressure", "near capacity", "429")),
)


def _lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def level_of(text: Column) -> Column:
    """The severity that a level word names, or null."""
    return _lookup(ALIASES, F.upper(strip(text)))


def level_name(level: Column) -> Column:
    return _lookup({v: k for k, v in LEVELS.items()}, level)


def level_number(name: str) -> int | None:
    """The same as `level_of`, for an option's value."""
    return ALIASES.get(name.strip().upper())


def from_priority(priority: Column) -> Column:
    """The severity of a syslog PRI, or null."""
    return F.element_at(F.array(*map(F.lit, SYSLOG_LEVELS)), (priority.cast("int") % 8 + 1).cast("int"))


def infer_level(message: Column) -> Column:
    """The most severe sign in a message, or null."""
    return reduce(lambda rest, sign: F.when(message.rlike("(?i)" + "|".join(sign[1])), sign[0]).otherwise(rest), reversed(SIGNS), F.lit(None).cast("int"))


def at_least(level: Column, least: int | None) -> Column:
    """Whether a row's level reaches ``least``; a null level doesn't. None lets all rows pass."""
    return F.lit(True) if least is None else F.coalesce(level >= least, F.lit(False))


def is_error(level: Column) -> Column:
    return F.coalesce(level >= 40, F.lit(False))


def is_warning(level: Column) -> Column:
    return F.coalesce(level.between(30, 39), F.lit(False))
