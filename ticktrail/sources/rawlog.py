"""A log segment format of our own and its readers: codec, batch and streaming data source, recovery.

A segment file is a 64-byte header and records: a fixed header, the body, padding to eight bytes and a
trailer with the CRC-32C of all before it. Integers are little-endian. Reading stops at the first bad
record; what is before it is valid, the bad record is classified, and nothing is repaired.
"""

from __future__ import annotations

import json
import mmap
import os
import struct
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThanOrEqual, InputPartition, LessThan

from ..functions.hashing import crc32c_bytes, crc32c_many

MAGIC = b"TTSEG001"
SEGMENT = struct.Struct("<8sIIIQQ")  # magic, stream, date, segment number, base position, first sequence
SEGMENT_BYTES = 64
BATCH = 4096  # records whose checksums are computed together
RECORD = struct.Struct("<IIQQQIIIQ")  # size, body length, sequence, realtime, monotonic, service, message, local time, vendor sequence
TRAILER = struct.Struct("<II")  # CRC-32C, size again
SCHEMA = (
    "source_stream_id int, capture_date int, segment_sequence int, ingress_sequence long, start_pos long, end_pos long, recv_realtime_ns long, "
    "recv_monotonic_ns long, service_id int, message_id int, local_time_raw int, vendor_seq long, payload binary, status string"
)


@dataclass(frozen=True)
class Record:
    sequence: int
    realtime_ns: int
    monotonic_ns: int
    service: int
    message: int
    local_time: int
    vendor_seq: int
    body: bytes


def encode(r: Record) -> bytes:
    size = RECORD.size + len(r.body)
    size += -size % 8 + TRAILER.size
    head = RECORD.pack(size, len(r.body), r.sequence, r.realtime_ns, r.monotonic_ns, r.service, r.message, r.local_time, r.vendor_seq)
    data = (head + r.body).ljust(size - TRAILER.size, b"\0")
    return data + TRAILER.pack(crc32c_bytes(data), size)


def blank(data) -> bool:
    return not any(bytes(data[i : i + (1 << 20)]).strip(b"\0") for i in range(0, len(data), 1 << 20))


def framed(data, at: int) -> tuple[int, str]:
    """Size of the record at a position and OK if its lengths agree, else 0 and why there is none."""
    rest = len(data) - at
    if rest < RECORD.size:
        return 0, "PREALLOCATION" if blank(data[at:]) else "PARTIAL_RECORD"
    size, n = RECORD.unpack_from(data, at)[:2]
    if not size and blank(data[at : at + RECORD.size]):
        return 0, "PREALLOCATION" if blank(data[at:]) else "INVALID_RECORD"
    if size != (RECORD.size + n + 7) // 8 * 8 + TRAILER.size:
        return 0, "INVALID_RECORD"
    if size > rest:
        return 0, "PARTIAL_RECORD"
    return (size, "OK") if TRAILER.unpack_from(data, at + size - TRAILER.size)[1] == size else (0, "INVALID_RECORD")


def unpacked(data, at: int) -> Record:
    _, n, *fields = RECORD.unpack_from(data, at)
    seq, rt, mono, service, message, local, vendor = fields
    start = at + RECORD.size
    return Record(seq, rt, mono, service, message, local, vendor, bytes(data[start : start + n]))


def proven(data, begin: int, expected: int | None) -> Iterator[tuple[int, int, Record | None, str]]:
    """(position, size, record, OK) of each record from ``begin`` on, checked in batches; a last row without a record tells why
    the rest isn't one. Sequences go up by one from ``expected``."""
    at, seq = begin, expected
    while at < len(data):
        places, pos, end = [], at, "OK"
        while pos < len(data) and len(places) < BATCH:
            size, end = framed(data, pos)
            if end != "OK":
                break
            places.append((pos, size))
            pos += size
        sums = crc32c_many([data[p : p + n - TRAILER.size] for p, n in places])
        for (p, n), crc in zip(places, sums.tolist()):
            if TRAILER.unpack_from(data, p + n - TRAILER.size)[0] != crc:
                yield p, 0, None, "INVALID_RECORD"
                return
            r = unpacked(data, p)
            if seq is not None and r.sequence != seq:
                yield p, 0, None, "SEQUENCE_MISMATCH"
                return
            yield p, n, r, "OK"
            seq = r.sequence + 1
        if end != "OK":
            yield pos, 0, None, end
            return
        at = pos


def decode(data: bytes, at: int, expected: int | None = None) -> tuple[Record | None, int, str]:
    """The record at a position, its size and a status: OK or why it isn't one."""
    size, status = framed(data, at)
    _, size, r, status = next(proven(data[: at + size], at, expected)) if status == "OK" else (at, 0, None, status)
    return r, size, status


def write_segment(path: str, stream: int, date: int, number: int, base: int, records: Sequence[Record]) -> int:
    """Writes a segment and returns the position after it; an existing file is refused."""
    first = records[0].sequence if records else 0
    body = b"".join(map(encode, records))
    with open(path, "xb") as f:
        f.write(SEGMENT.pack(MAGIC, stream, date, number, base, first).ljust(SEGMENT_BYTES, b"\0") + body)
    return base + len(body)


def header(data) -> tuple | None:
    """(stream, date, segment number, base position, first sequence), or None if that isn't a segment."""
    magic, *rest = SEGMENT.unpack_from(bytes(data[: SEGMENT.size]).ljust(SEGMENT.size, b"\0"), 0)
    return tuple(rest) if magic == MAGIC else None


def scan(data, limit: int | None = None, offset: int = SEGMENT_BYTES, expected: int | None = None) -> Iterator[tuple]:
    """Rows of SCHEMA up to ``limit`` bytes of the file; a last row without payload tells how it ended if not well."""
    head = header(data)
    if head is None:
        yield (None,) * 13 + ("BAD_SEGMENT_HEADER",)
        return
    stream, date, number, base, first = head
    data = data if limit is None else data[:limit]
    for at, size, r, status in proven(data, offset, first if expected is None else expected):
        start = base + at - SEGMENT_BYTES
        if r is None:
            yield (stream, date, number, None, start, base + len(data) - SEGMENT_BYTES, None, None, None, None, None, None, None, status)
        else:
            yield (stream, date, number, r.sequence, start, start + size, r.realtime_ns, r.monotonic_ns, r.service, r.message, r.local_time, r.vendor_seq, r.body, "OK")


@contextmanager
def mapped(path: str) -> Iterator[memoryview]:
    """A file's bytes, paged in as they are read."""
    with open(path, "rb") as f:
        if not os.fstat(f.fileno()).st_size:
            yield memoryview(b"")
            return
        whole = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        yield memoryview(whole)  # unmapped with the last view of it


class _Part(InputPartition):
    def __init__(self, path: str, offset: int = SEGMENT_BYTES, expected: int | None = None, limit: int | None = None):
        self.path, self.offset, self.expected, self.limit = path, offset, expected, limit


class SegmentReader(DataSourceReader):
    """A partition for each segment. Filters are taken in after a record has been proven: skipped records
    are checked too. Rows that tell of damage pass every filter."""

    def __init__(self, options):
        self.path = options["path"]
        self.limits = json.loads(options.get("durableLimits", "{}"))
        self.tests: list[tuple[int, str, object]] = []

    def pushFilters(self, filters: list[Filter]):
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        ops = {EqualTo: "=", GreaterThanOrEqual: ">=", LessThan: "<"}
        for f in filters:
            if type(f) in ops and len(f.attribute) == 1 and f.attribute[0] in names:
                self.tests.append((names.index(f.attribute[0]), ops[type(f)], f.value))
            yield f  # Spark checks again

    def partitions(self):
        files = sorted(x for x in os.listdir(self.path) if x.endswith(".seg"))
        return [_Part(os.path.join(self.path, x), limit=self.limits.get(x)) for x in files]

    def read(self, part):
        test = {"=": lambda a, b: a == b, ">=": lambda a, b: a is not None and a >= b, "<": lambda a, b: a is not None and a < b}
        with mapped(part.path) as data:
            for row in scan(data, part.limit):
                if row[-1] != "OK" or all(test[op](row[i], v) for i, op, v in self.tests):
                    yield row


class SegmentTail(DataSourceStreamReader):
    """Follows a folder of one log's segments. The offset is a file, the end of its last whole record, the sequence that must come
    next there, and the log's stream and date. The sequence was found when the offset was taken, so the bytes of a
    later batch can't vouch for themselves; a record that is still being written waits for the next batch.
    Damage, a gap, another log in the folder, or a segment that was left with half a record fails the query.
    With option ``transitions`` a row of status SEGMENT_TRANSITION, without a sequence, begins each segment."""

    def __init__(self, options):
        self.path = options["path"]
        self.transitions = options.get("transitions", "false").lower() == "true"
        self.seen = ("", SEGMENT_BYTES, None)  # file, position, next sequence: saves walking a file anew

    def _files(self):
        return sorted(x for x in os.listdir(self.path) if x.endswith(".seg"))

    def initialOffset(self):
        return {"file": "", "at": 0, "seq": -1, "log": ""}

    def latestOffset(self):
        for name in reversed(self._files()):
            with mapped(os.path.join(self.path, name)) as data:
                if len(data) < SEGMENT_BYTES:
                    continue  # its header is being written
                head = header(data)
                if head is None:
                    return {"file": name, "at": len(data), "seq": -1, "log": ""}  # reading it fails the query
                at, seq = (SEGMENT_BYTES, head[-1]) if self.seen[0] != name else self.seen[1:]
                while at < len(data):
                    size, status = framed(data, at)
                    if status == "INVALID_RECORD":
                        return {"file": name, "at": len(data), "seq": -1, "log": self._log(head)}
                    if status != "OK":
                        break
                    at, seq = at + size, RECORD.unpack_from(data, at)[2] + 1
                self.seen = (name, at, seq)
                return {"file": name, "at": at, "seq": seq, "log": self._log(head)}
        return self.initialOffset()

    @staticmethod
    def _log(head):
        return f"{head[0]}/{head[1]}"

    def partitions(self, start, end):
        out, log = [], start.get("log") or end.get("log") or None
        for x in self._files():
            if x < start["file"] or x > end["file"]:
                continue
            again = x == start["file"]
            seq = start.get("seq", -1) if again and start["at"] > SEGMENT_BYTES else -1
            part = _Part(os.path.join(self.path, x), max(SEGMENT_BYTES, start["at"]) if again else SEGMENT_BYTES, None if seq < 0 else seq, end["at"] if x == end["file"] else None)
            part.log, part.begins = log, not again
            out.append(part)
        return out

    def read(self, part):
        with mapped(part.path) as data:
            head = header(data)
            if head and part.log and self._log(head) != part.log:
                raise ValueError(f"{part.path}: log {self._log(head)} where {part.log} is followed")
            if head and part.begins and self.transitions:
                yield (*head[:3], None, head[3], head[3], None, None, None, None, None, None, None, "SEGMENT_TRANSITION")
            for row in scan(data, part.limit, part.offset, part.expected):
                if row[-1] not in ("OK", "PREALLOCATION"):
                    raise ValueError(f"{part.path}: {row[-1]} at {row[4]}")
                if row[-1] == "OK":
                    yield row

    def commit(self, end):
        pass


class SegmentSource(DataSource):
    @classmethod
    def name(cls):
        return "ticksegments"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return SegmentReader(self.options)

    def streamReader(self, schema):
        return SegmentTail(self.options)


def register(spark) -> None:
    """Makes format("ticksegments") known, with filters taken in by its reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SegmentSource)


def recovery(records):
    """Per segment: the valid prefix and how its tail reads; ``records`` are rows of SCHEMA."""
    from pyspark.sql import functions as F

    ok = F.col("status") == "OK"
    return records.groupBy("source_stream_id", "segment_sequence").agg(
        F.count_if(ok).alias("records"), F.max(F.when(ok, F.col("end_pos"))).alias("valid_end"), F.coalesce(F.max(F.when(~ok, F.col("status"))), F.lit("CLEAN")).alias("tail")
    )
