"""Following growing files: a streaming data source that remembers a byte offset for each file.

Spark's own file stream takes a file once; this one reads what was appended since. A file that shrank is read from its
start. Files are opened on the machine that runs the reader, so the paths must be mounted there.
"""

from __future__ import annotations

import glob
import json
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

SCHEMA = "source string, n long, value string"
MOST_BYTES = 8 << 20  # of a file in one batch, unless a line alone is longer


class TailSource(DataSource):
    """``spark.dataSource.register(TailSource)``; then ``readStream.format("tail").option("path", glob).option("from_end", "true")``."""

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema: StructType) -> TailReader:
        return TailReader(self.options)


class TailReader(SimpleDataSourceStreamReader):
    """Offsets are ``{path: [bytes, lines]}``, as JSON in one field."""

    def __init__(self, options: dict):
        self.pattern = options["path"]
        self.from_end = str(options.get("from_end", "true")).lower() == "true"

    def initialOffset(self) -> dict:
        start = {p: [os.path.getsize(p), 0] for p in self._files()} if self.from_end else {}
        return {"at": json.dumps(start, sort_keys=True)}

    def _files(self) -> list[str]:
        return sorted(glob.glob(self.pattern))

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, at = [], json.loads(start["at"])
        for path in self._files():
            done, lines = at.get(path, [0, 0])
            if os.path.getsize(path) < done:
                done, lines = 0, 0
            new, done, lines = _lines(path, done, lines)
            rows += new
            at[path] = [done, lines]
        return iter(rows), {"at": json.dumps(at, sort_keys=True)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        before, after = json.loads(start["at"]), json.loads(end["at"])
        for path, (stop, _) in sorted(after.items()):
            done, lines = before.get(path, [0, 0])
            if stop < done:
                done, lines = 0, 0
            yield from _lines(path, done, lines, stop)[0]

    def commit(self, end: dict) -> None:
        pass


def _lines(path: str, done: int, lines: int, stop: int | None = None) -> tuple[list[tuple], int, int]:
    """Whole lines from byte ``done`` on; a line that isn't ended yet waits."""
    with open(path, "rb") as file:
        file.seek(done)
        data = file.read(MOST_BYTES if stop is None else stop - done)
        if stop is None and b"\n" not in data:  # a long line: read on to its end, if that is written yet
            parts = [data]
            while parts[-1] and b"\n" not in parts[-1]:
                parts.append(file.read(MOST_BYTES))
            data = b"".join(parts)
    end = data.rfind(b"\n") + 1
    out = []
    for raw in data[:end].split(b"\n")[:-1]:
        lines += 1
        out.append((path, lines, raw.rstrip(b"\r").decode("utf-8", "replace")))
    return out, done + end, lines
