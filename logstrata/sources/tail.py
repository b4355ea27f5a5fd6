"""A streaming source that follows a growing file by byte offsets."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader


class LogTail(DataSource):
    """format("logtail"): one row (value) per line of the file at `path`.

    startingOffset is 'latest' (the default: only what is written from now on) or 'earliest'.  A line counts once its
    end is written.  A micro-batch reads maxBytes of the file at most (16 MB by default) and the next goes on from there, so
    a long file never lies in memory as a whole; only a single line may be longer.  A file that shrinks has been replaced and is read from its start.  The file lies on one machine, so
    its reader does too; use a directory source for files that executors can read.
    """

    @classmethod
    def name(cls) -> str:
        return "logtail"

    def schema(self) -> str:
        return "value string"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:  # noqa: ANN001, N802
        return _Reader(self.options)


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.latest = options.get("startingOffset", "latest") == "latest"
        self.most = int(options.get("maxBytes", 16 << 20))

    def _size(self) -> int:
        return os.path.getsize(self.path) if os.path.exists(self.path) else 0

    def initialOffset(self) -> dict:  # noqa: N802
        return {"at": self._size() if self.latest else 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        at = start["at"] if start["at"] <= self._size() else 0
        if not os.path.exists(self.path):
            return iter(()), start
        with open(self.path, "rb") as f:
            f.seek(at)
            data = f.read(self.most)
            while b"\n" not in data and (more := f.read(self.most)):
                data += more
        whole = data[: data.rfind(b"\n") + 1]
        return self._rows(whole), {"at": at + len(whole)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        at = start["at"] if start["at"] <= end["at"] else 0
        with open(self.path, "rb") as f:
            f.seek(at)
            return self._rows(f.read(end["at"] - at))

    @staticmethod
    def _rows(data: bytes) -> Iterator[tuple]:
        return iter([(x.decode("utf-8", "replace"),) for x in data.split(b"\n")[:-1]])
