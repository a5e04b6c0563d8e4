"""Python data sources: HTTP bodies, framed log segments, webhook and framed sinks."""

from __future__ import annotations

import http.client
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..model import ENVELOPE_LIMIT
from ..operators.envelope import decode_frames


@dataclass(frozen=True)
class Target:
    host: str
    port: int
    path: str

    @staticmethod
    def parse(url: str) -> "Target":
        """Plain http only; port 80 and path / by default."""
        parts = urlsplit(url)
        if parts.scheme != "http" or not parts.hostname:
            raise ValueError(f"not an http url: {url}")
        return Target(parts.hostname, parts.port or 80, (parts.path or "/") + (f"?{parts.query}" if parts.query else ""))


def fetch(url: str, limit: int = ENVELOPE_LIMIT, timeout: float = 30) -> bytes:
    """The body of a 2xx answer, whole and within the limit; anything else is an error."""
    t = Target.parse(url)
    connection = http.client.HTTPConnection(t.host, t.port, timeout=timeout)
    try:
        connection.request("GET", t.path, headers={"Connection": "close"})
        answer = connection.getresponse()
        if not 200 <= answer.status < 300:
            raise OSError(f"status {answer.status} from {url}")
        body = answer.read(limit + 1)  # a body shorter than its length raises IncompleteRead
        if len(body) > limit:
            raise OSError(f"more than {limit} bytes from {url}")
        return body
    finally:
        connection.close()


def post(url: str, body: bytes, timeout: float = 30) -> None:
    t = Target.parse(url)
    connection = http.client.HTTPConnection(t.host, t.port, timeout=timeout)
    try:
        connection.request("POST", t.path, body, {"Content-Type": "application/x-ndjson", "Connection": "close"})
        answer = connection.getresponse()
        answer.read()
        if not 200 <= answer.status < 300:
            raise OSError(f"status {answer.status} from {url}")
    finally:
        connection.close()


class HttpLines(DataSource):
    """format("http_lines").option("url", ...): a request is a batch of lines; several urls, separated by spaces, are read in parallel."""

    @classmethod
    def name(cls) -> str:
        return "http_lines"

    def schema(self) -> str:
        return "url string, ord int, value string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _HttpReader(self.options["url"].split())


class _HttpReader(DataSourceReader):
    def __init__(self, urls: list[str]):
        self.urls = urls

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(u) for u in self.urls]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        lines = fetch(partition.value).decode("utf-8", "replace").split("\n")
        lines = [line[:-1] if line.endswith("\r") else line for line in lines]
        yield from ((partition.value, i, line) for i, line in enumerate(x for x in lines if x))


class FramedLog(DataSource):
    """format("framed_log").load(folder): segment files named by their first byte offset, with checked frames.

    A segment is read up to its first torn or corrupt frame; reading goes on with the next segment. Written by tasks
    as one segment each. For folders that every executor mounts.
    """

    @classmethod
    def name(cls) -> str:
        return "framed_log"

    def schema(self) -> str:
        return "segment long, byte_offset long, value binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _FrameReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _FrameWriter(self.options["path"], schema.fieldNames().index("value"))


def segment_files(path: str) -> list[tuple[int, str]]:
    return sorted((int(n.split(".")[0]), os.path.join(path, n)) for n in os.listdir(path) if n.split(".")[0].isdigit())


class _FrameReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(x) for x in segment_files(self.path)] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value:
            start, name = partition.value
            with open(name, "rb") as f:
                yield from ((start, start + at, body) for at, body, good in decode_frames(f.read()) if good)


@dataclass
class _Segment(WriterCommitMessage):
    staged: str
    size: int


class _FrameWriter(DataSourceWriter):
    """Tasks stage their frames; the commit names the segments by byte offset, in order of partitions."""

    def __init__(self, path: str, column: int):
        self.path, self.column = path, column

    def write(self, rows: Iterator) -> WriterCommitMessage:
        import uuid
        import zlib

        os.makedirs(self.path, exist_ok=True)
        staged, size = os.path.join(self.path, f"staged-{uuid.uuid4().hex}"), 0
        with open(staged, "wb") as f:
            for row in rows:
                value = bytes(row[self.column])
                head = struct.pack("<I", len(value)) + value
                size += f.write(head + struct.pack("<I", zlib.crc32(head)))
            f.flush()
            os.fsync(f.fileno())
        return _Segment(staged, size)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files = segment_files(self.path)
        at = files[-1][0] + os.path.getsize(files[-1][1]) if files else 0
        for m in messages:
            if m is None or not m.size:
                if m is not None:
                    os.remove(m.staged)
                continue
            os.rename(m.staged, os.path.join(self.path, f"{at:020d}.seg"))
            at += m.size

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.staged):
                os.remove(m.staged)


class Webhook(DataSource):
    """format("webhook").option("url", ...): each task posts its records as lines; a task without records posts nothing."""

    @classmethod
    def name(cls) -> str:
        return "webhook"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Poster(self.options["url"], schema.fieldNames().index("value"))


class _Poster(DataSourceWriter):
    def __init__(self, url: str, column: int):
        self.url, self.column = url, column

    def write(self, rows: Iterator) -> WriterCommitMessage:
        values = [v if isinstance(v, bytes) else str(v).encode() for v in (row[self.column] for row in rows)]
        if values:
            post(self.url, b"".join(v + b"\n" for v in values))
        return WriterCommitMessage()


def register(spark) -> None:
    for source in (HttpLines, FramedLog, Webhook):
        spark.dataSource.register(source)
