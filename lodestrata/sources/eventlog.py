"""`eventlog`: framed logs as a Spark data source, in batches and as a stream.

Registered with `register(spark)`.

Reading: files are read through a buffer record by record; option startOffset
goes to a byte offset of each file without reading what is before it, mode as in
`files`. A file is never cut. Up to 128 files have a partition each; of more,
neighbours by name share one, so that partitions grow with the bytes and not with
the segments.

Streaming follows a file, or a folder of segments that are read in the order of
their names. An offset names a segment, the file that it was (so that a
replacement is known, however long it is) and the bytes taken of it. The driver
walks the headers of the last segment only, to find where its last whole frame
ends; records are read by the tasks, in partitions as above. A follower that meets a
replaced segment takes it from its start. A batch that was planned on a file that
was replaced since can't run again and fails, instead of giving other records. A
torn tail waits for its rest.

Writing appends segments, renamed into place when the job commits. Rows hold
(ts_ns, source, payload), or (ts_ns, data) for raw payloads, or frame for what is
framed already. Option segmentBy names a column: a task starts a new segment
where its value changes, and the segment's name begins with it.

Paths are opened by Python, so they must be mounted on all machines; `files`
reads from any file system that Spark reads.
"""

from __future__ import annotations

import glob
import os
import uuid
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

from lodestrata.sources import frames as fr

SCHEMA = "file string, offset long, ts_ns long, source string, payload string, status string"
_BUFFER = 1 << 20
# A task's start costs more than reading a small segment: beyond LEAST_PARTS files, a partition takes PART_BYTES, and to open a file counts as OPEN_BYTES.
_LEAST_PARTS, _PART_BYTES, _OPEN_BYTES = 128, 32 << 20, 1 << 16


class _Span(NamedTuple):
    """Bytes `start` to `end` (to the end of the file if None) of a file; identity: the file that it must still be, if given."""

    path: str
    start: int
    end: int | None = None
    identity: str = ""


class _Part(InputPartition):
    """Files, or parts of them, that one task reads one after the other."""

    def __init__(self, spans: list[_Span]):
        self.spans = spans


class _Segments(WriterCommitMessage):
    def __init__(self, paths: list[tuple[str, str]]):
        self.paths = paths


def _files(path: str) -> list[str]:
    path = path.removeprefix("file:")
    return sorted(p for p in glob.glob(f"{path}/*") if os.path.isfile(p) and not os.path.basename(p).startswith((".", "_"))) if os.path.isdir(path) else sorted(glob.glob(path))


def _packed(spans: list[_Span], sizes: list[int]) -> list[InputPartition]:
    """Every span in one of the partitions, in the given order; one without spans if there are none."""
    costs = [size + _OPEN_BYTES for size in sizes]
    total = sum(costs)
    count = max(_LEAST_PARTS, -(-total // _PART_BYTES))
    if len(spans) <= count:
        return [_Part([s]) for s in spans] or [_Part([])]
    held: list[list[_Span]] = [[] for _ in range(count)]
    before = 0
    for span, cost in zip(spans, costs, strict=True):
        held[(2 * before + cost) * count // (2 * total)].append(span)  # by where its middle lies
        before += cost
    return [_Part(h) for h in held if h]


def _identity(f) -> str:
    at = os.fstat(f.fileno())
    return f"{at.st_dev}-{at.st_ino}"


def _read(span: _Span, mode: str) -> Iterator[tuple]:
    with open(span.path, "rb", _BUFFER) as f:
        if span.identity and _identity(f) != span.identity:
            raise ValueError(f"{span.path} was replaced after this batch was planned")
        for offset, ts_ns, data, _, status in fr.frames_of(f, span.start, span.end):
            source = payload = None
            if status == fr.OK:
                try:
                    source, payload = fr.parse_event(data)
                except (ValueError, UnicodeDecodeError):
                    status = "bad_event"
            if status == fr.OK or mode == "PERMISSIVE":
                yield span.path, offset, ts_ns, source, payload, status
            elif mode == "FAILFAST" and status != fr.TRUNCATED:
                raise ValueError(f"{span.path}, byte {offset}: {status}")


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.start, self.mode = options["path"], int(options.get("startOffset", 0)), options.get("mode", "FAILFAST").upper()

    def partitions(self):
        found = _files(self.path)
        return _packed([_Span(p, self.start) for p in found], [max(0, os.path.getsize(p) - self.start) for p in found])

    def read(self, partition):
        for span in partition.spans:
            yield from _read(span, self.mode)


def whole_upto(path: str, start: int = 0) -> tuple[str, int]:
    """What file a path is, and where its last whole frame ends, by its headers from a frame's start on."""
    with open(path, "rb") as f:
        size, at = os.fstat(f.fileno()).st_size, start
        while at + fr.HEADER.size <= size:
            f.seek(at)
            magic, _, length = fr.HEADER.unpack(f.read(fr.HEADER.size))
            end = at + fr.HEADER.size + length + 4
            if magic != fr.MAGIC or end > size:
                break
            at = end
        # damage is for the reader to report
        return _identity(f), size if at + fr.HEADER.size <= size and magic != fr.MAGIC else at


class _Follower(DataSourceStreamReader):
    def __init__(self, options):
        self.path, self.mode = options["path"], options.get("mode", "FAILFAST").upper()
        self.first = int(options.get("startOffset", 0))
        self.walked: tuple[str, str, int] | None = None

    def initialOffset(self):
        return {"segment": "", "file": "", "bytes": self.first}

    def latestOffset(self):
        found = _files(self.path)
        if not found:
            return self.initialOffset()
        last = found[-1]
        start = 0
        if self.walked and self.walked[0] == last:
            with open(last, "rb") as f:
                start = self.walked[2] if _identity(f) == self.walked[1] and os.fstat(f.fileno()).st_size >= self.walked[2] else 0
        identity, upto = whole_upto(last, start)
        self.walked = (last, identity, upto)
        return {"segment": os.path.basename(last), "file": identity, "bytes": upto}

    def partitions(self, start, end):
        """The segments after the start up to the end, each from where it was left."""
        spans: list[_Span] = []
        for path in _files(self.path):
            name = os.path.basename(path)
            if name < start["segment"] or name > end["segment"]:
                continue
            with open(path, "rb") as f:
                identity, size = _identity(f), os.fstat(f.fileno()).st_size
            # the first segment of all may be asked for from a byte on
            begin = start["bytes"] if not start["segment"] and not spans else 0
            if name == start["segment"] and identity == start["file"]:
                begin = start["bytes"]
            last = name == end["segment"]
            upto = end["bytes"] if last else size
            if last and identity != end["file"]:
                raise ValueError(f"{path} was replaced after this batch was planned")
            if begin < upto:
                spans.append(_Span(path, begin, upto, identity))
        return _packed(spans, [s.end - s.start for s in spans])

    def read(self, partition):
        for span in partition.spans:
            yield from _read(span, self.mode)

    def commit(self, end):
        pass


class _Writer(DataSourceWriter):
    def __init__(self, options, columns: list[str]):
        self.path, self.columns = options["path"].removeprefix("file:"), columns
        self.segment_by = options.get("segmentBy", "")
        self.run = uuid.uuid4().hex

    def _frame(self, row) -> bytes:
        if "frame" in self.columns:
            return bytes(row["frame"])
        data = bytes(row["data"]) if "data" in self.columns else fr.event(row["source"], row["payload"])
        return fr.frame(row["ts_ns"], data)

    def write(self, rows):
        os.makedirs(self.path, exist_ok=True)
        made, out, now = [], None, None
        try:
            for row in rows:
                value = str(row[self.segment_by]) if self.segment_by else ""
                if out is None or value != now:
                    if out is not None:
                        out.close()
                    now, hidden = value, f"{self.path}/.{self.run}-{uuid.uuid4().hex}"
                    out = open(hidden, "wb", _BUFFER)  # noqa: SIM115
                    made.append((hidden, value))
                out.write(self._frame(row))
        finally:
            if out is not None:
                out.close()
        return _Segments(made)

    def commit(self, messages):
        for k, (path, value) in enumerate(x for m in messages if m is not None for x in m.paths):
            os.rename(path, f"{self.path}/{value + '-' if value else ''}{self.run}-{k:05d}.wal")

    def abort(self, messages):
        for path, _ in (x for m in messages if m is not None for x in m.paths):
            if os.path.exists(path):
                os.remove(path)


class EventLogSource(DataSource):
    @classmethod
    def name(cls):
        return "eventlog"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)

    def streamReader(self, schema):
        return _Follower(self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options, schema.names)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(EventLogSource)


def written(rows: DataFrame, path: str, segment_by: str = "", order: str = "ts_ns") -> DataFrame:
    """Append rows to the log at a path, and read back where they are: (file, offset, ts_ns, source, payload, status) of the new segments.

    With segment_by, each of its values becomes a segment, in the given order.
    """
    spark = rows.sparkSession
    register(spark)
    before = set(_files(path))
    if segment_by:
        rows = rows.repartition(segment_by).sortWithinPartitions(segment_by, order)
    rows.write.format("eventlog").mode("append").option("path", path).option("segmentBy", segment_by).save()
    found = spark.read.format("eventlog").option("mode", "PERMISSIVE").load(path)
    return found.filter(~found["file"].isin(sorted(before))) if before else found

