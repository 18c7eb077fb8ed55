"""Capture files: reading pcap and pcapng as Spark data sources, batch and streaming, and writing pcap.

`spark.read.format("pcap").load(path)` opens files where the executors see them, split at record boundaries that the
driver finds by walking the record headers once. `read_captures` goes through Spark's own file reader, so it takes any
store, one task per file.
"""

from __future__ import annotations

import glob
import json
import os
import struct
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from netloom.functions.dissect import with_fields
from netloom.schema import FIELDS, GROUP, PACKETS

# Magic numbers as the first four bytes, with byte order and nanoseconds per fraction.
MAGICS = {b"\xd4\xc3\xb2\xa1": ("<", 1000), b"\xa1\xb2\xc3\xd4": (">", 1000), b"\x4d\x3c\xb2\xa1": ("<", 1), b"\xa1\xb2\x3c\x4d": (">", 1)}
PCAPNG = b"\x0a\x0d\x0d\x0a"
SECTION, INTERFACE, SIMPLE, ENHANCED = 0x0A0D0D0A, 1, 3, 6  # block types
BATCH, WINDOW, CHUNK = 4096, 1 << 20, 4 << 20
MOST_BYTES = 1 << 28  # of a record; more is damage
MOST_NANOS = (1 << 63) - 1


class NotACapture(ValueError):
    pass


@dataclass
class State:
    """What a reader must know at a record boundary."""

    order: str = "<"
    unit: int = 1000  # legacy: nanoseconds per fraction; 0 stands for pcapng
    linktype: int = 1
    interfaces: list[tuple[int, int]] = field(default_factory=list)  # (link type, ticks per second)

    def dump(self) -> list:
        return [self.order, self.unit, self.linktype, [list(x) for x in self.interfaces]]

    @staticmethod
    def load(x: list) -> State:
        return State(x[0], x[1], x[2], [tuple(i) for i in x[3]])


def ticks_per_second(resolution: int) -> int:
    """Of an if_tsresol option: a power of ten, or of two if the top bit is set; beyond 64 bits a million."""
    ticks = 2 ** (resolution & 127) if resolution & 128 else 10**resolution
    return ticks if ticks < 1 << 64 else 1_000_000


def ticks_to_nanos(ticks: int, per_second: int) -> int:
    return min(ticks * 1_000_000_000 // per_second, MOST_NANOS) if per_second else 0


def open_state(head: bytes) -> tuple[State, int]:
    """The state at the first record and its offset; NotACapture for other files."""
    if head[:4] == PCAPNG:
        return State(unit=0), 0
    if head[:4] not in MAGICS or len(head) < 24:
        raise NotACapture("neither pcap nor pcapng")
    order, unit = MAGICS[head[:4]]
    return State(order, unit, struct.unpack_from(f"{order}I", head, 20)[0] & 0xFFFF), 24


class Walk:
    """Records of an open file from an offset to a limit. Stops at damage, with truncated set; what came before stays."""

    def __init__(self, file, state: State, at: int, limit: int | None = None):
        self.file, self.state, self.at, self.truncated = file, state, at, False
        self.limit, self.held, self.base = limit, b"", 0

    def _read(self, at: int, n: int) -> bytes | None:
        k = at - self.base
        if k < 0 or k + n > len(self.held):
            self.file.seek(at)
            self.held, self.base, k = self.file.read(max(n, WINDOW)), at, 0
        data = self.held[k : k + n]
        return data if len(data) == n else None

    def records(self, payload: bool = True) -> Iterator[tuple[int, int, int, int, int, int, bytes]]:
        """(record offset, data offset, time, captured, wire length, link type, bytes)"""
        while self.limit is None or self.at < self.limit:
            found = self._legacy(payload) if self.state.unit else self._block(payload)
            if found is None:
                return
            if found:
                yield found

    def _legacy(self, payload: bool):
        s = self.state
        head = self._read(self.at, 16)
        if head is None:
            self.truncated |= self._read(self.at, 1) is not None
            return None
        sec, sub, cap, wire = struct.unpack(f"{s.order}4I", head)
        data = None if cap > MOST_BYTES else self._read(self.at + 16, cap) if payload else self._skip(self.at + 16, cap)
        if data is None:
            self.truncated = True
            return None
        here, self.at = self.at, self.at + 16 + cap
        return here, here + 16, sec * 1_000_000_000 + sub * s.unit, cap, wire, s.linktype, data

    def _skip(self, at: int, n: int) -> bytes | None:
        return b"" if not n or self._read(at + n - 1, 1) is not None else None

    def _block(self, payload: bool):
        s = self.state
        head = self._read(self.at, 12)
        if head is None:
            self.truncated |= self._read(self.at, 1) is not None
            return None
        if head[:4] == PCAPNG:
            s.order = "<" if head[8:12] == b"\x4d\x3c\x2b\x1a" else ">"
            s.interfaces = []
        kind, size = struct.unpack_from(f"{s.order}II", head)
        if size < 12 or size % 4 or size > MOST_BYTES:
            self.truncated = True
            return None
        packet = kind in (SIMPLE, ENHANCED)
        body = self._read(self.at + 8, size - 12) if packet and payload or kind == INTERFACE else self._read(self.at + 8, min(20, size - 12)) if packet else b""
        if body is None or self._skip(self.at, size) is None:
            self.truncated = True
            return None
        here, self.at = self.at, self.at + size
        if kind == INTERFACE and len(body) >= 8:
            s.interfaces.append((struct.unpack_from(f"{s.order}H", body)[0], self._resolution(body[8:])))
        elif kind == ENHANCED and len(body) >= 20:
            index, high, low, cap, wire = struct.unpack_from(f"{s.order}5I", body)
            link, ticks = s.interfaces[index] if index < len(s.interfaces) else (1, 1_000_000)
            cap = min(cap, size - 32)
            return here, here + 28, ticks_to_nanos(high << 32 | low, ticks), cap, wire, link, body[20 : 20 + cap]
        elif kind == SIMPLE and len(body) >= 4:
            wire = struct.unpack_from(f"{s.order}I", body)[0]
            cap = min(size - 16, wire)
            return here, here + 12, 0, cap, wire, s.interfaces[0][0] if s.interfaces else 1, body[4 : 4 + cap]
        return False

    def _resolution(self, options: bytes) -> int:
        at = 0
        while at + 4 <= len(options):
            code, n = struct.unpack_from(f"{self.state.order}HH", options, at)
            if code == 0:
                break
            if code == 9 and n >= 1:
                return ticks_per_second(options[at + 4])
            at += 4 + (n + 3) // 4 * 4
        return 1_000_000


def legacy_chunks(file, state: State, at: int, limit: int | None = None) -> Iterator[tuple[int, bytes, list[tuple[int, int, int, int, int]]]]:
    """(offset, bytes, records) of a legacy capture, some megabytes at a time; a record is (place in the bytes, seconds,
    fraction, captured, wire length). Ends where Walk does."""
    head = struct.Struct(f"{state.order}4I").unpack_from
    file.seek(at)
    held, damaged = b"", False
    while not damaged and (limit is None or at < limit):
        more = file.read(CHUNK)
        held += more
        here, found, most = 0, [], len(held) if limit is None else min(len(held), limit - at)
        while here < most and here + 16 <= len(held):
            sec, sub, cap, wire = head(held, here)
            if cap > MOST_BYTES:
                damaged = True
                break
            if here + 16 + cap > len(held):
                break
            found.append((here, sec, sub, cap, wire))
            here += 16 + cap
        if found:
            yield at, held, found
        if not more:
            return
        held, at = held[here:], at + here


def ends_whole(path: str, last: int | None = None) -> bool:
    """Whether a capture ends with a whole record, looked at from the offset of its last packet, if it has one."""
    with open(path, "rb") as f:
        head = f.read(24)
        state, at = open_state(head)
        if not state.unit:
            state.order = "<" if head[8:12] == b"\x4d\x3c\x2b\x1a" else ">"
        walk = Walk(f, state, at if last is None else last)
        for _ in walk.records(payload=False):
            pass
    return not walk.truncated


def capture_facts(packets: DataFrame, path: str) -> dict:
    """Of the captures that packets were read from: file, file_bytes, truncated (any of them), row_groups."""
    last = {r.file: r.last for r in packets.groupBy("file").agg(F.max("record_offset").alias("last")).collect()}  # one row per file
    files = _files(path)
    groups = packets.select(F.floor(F.col("packet_no") / GROUP)).distinct().count()
    return {"file": path, "file_bytes": sum(map(os.path.getsize, files)), "truncated": not all(ends_whole(f, last.get(f)) for f in files), "row_groups": groups}


def _legacy_boundaries(file, state: State, at: int, every: int) -> Iterator[tuple[int, int, int, list]]:
    start, first, n, held = at, 0, 0, state.dump()
    for base, _, found in legacy_chunks(file, state, at):
        ends = [f[0] for f in found[1:]] + [found[-1][0] + 16 + found[-1][3]]
        for k in range(every - n % every - 1, len(found), every):
            yield first, start, base + ends[k], held
            start, first = base + ends[k], n + k + 1
        n, at = n + len(found), base + ends[-1]
    if n > first or not n:
        yield first, start, at, held
    return n


def boundaries(path: str, every: int = GROUP) -> Iterator[tuple[int, int, int, list]]:
    """(first packet number, start, end, state) of runs of `every` records."""
    with open(path, "rb") as f:
        state, at = open_state(f.read(24))
        if state.unit:
            return (yield from _legacy_boundaries(f, state, at, every))
        walk = Walk(f, state, at)
        start, first, n, held = at, 0, 0, state.dump()
        for _ in walk.records(payload=False):
            n += 1
            if n % every == 0:
                yield first, start, walk.at, held
                start, first, held = walk.at, n, walk.state.dump()
        if n > first or not n:
            yield first, start, walk.at, held
    return n


def numbered(files: list[str], every: int = GROUP) -> Iterator[tuple[str, int, int, int, list]]:
    """(file, first packet number, start, end, state) of the runs of several files; numbers go on from file to file."""
    base = 0
    for file in files:
        found = boundaries(file, every)
        while True:
            try:
                first, start, end, state = next(found)
            except StopIteration as done:
                base += done.value
                break
            yield file, base + first, start, end, state


ARROW = pa.schema([("file", pa.string()), ("packet_no", pa.int64()), ("ts_nanos", pa.int64()), ("record_offset", pa.int64()), ("data_offset", pa.int64()), ("caplen", pa.int64()), ("origlen", pa.int64()), ("linktype", pa.int32()), ("frame", pa.binary())])


def batches(name: str, walk: Walk, first: int) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []

    def flush() -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True))
        out = [pa.array([name] * len(rows)), pa.array(range(first, first + len(rows)), pa.int64()), *(pa.array(cols[k], f.type) for k, f in zip((2, 0, 1, 3, 4, 5, 6), list(ARROW)[2:], strict=True))]
        return pa.RecordBatch.from_arrays(out, schema=ARROW)

    for record in walk.records():
        rows.append(record)
        if len(rows) == BATCH:
            yield flush()
            first, rows = first + BATCH, []
    if rows:
        yield flush()


def legacy_batches(name: str, file, state: State, at: int, limit: int | None, first: int) -> Iterator[pa.RecordBatch]:
    """As batches(), of a legacy capture."""
    for base, held, found in legacy_chunks(file, state, at, limit):
        here, sec, sub, cap, wire = np.array(found, np.int64).T
        n = len(found)
        frames = pa.array([held[x + 16 : x + 16 + c] for x, _, _, c, _ in found], pa.binary())
        columns = [np.arange(first, first + n), sec * 1_000_000_000 + sub * state.unit, base + here, base + here + 16, cap, wire]
        yield pa.RecordBatch.from_arrays([pa.repeat(name, n), *(pa.array(c, pa.int64()) for c in columns), pa.repeat(pa.scalar(state.linktype, pa.int32()), n), frames], schema=ARROW)
        first += n


def record_batches(name: str, file, state: State, at: int, limit: int | None, first: int) -> Iterator[pa.RecordBatch]:
    if state.unit:
        return legacy_batches(name, file, state, at, limit, first)
    return batches(name, Walk(file, state, at, limit), first)


def _files(path: str) -> list[str]:
    path = path.removeprefix("file://")
    found = sorted(glob.glob(os.path.join(path, "*")) if os.path.isdir(path) else glob.glob(path))
    return [f for f in found if os.path.isfile(f) and not os.path.basename(f).startswith((".", "_"))]


class Piece(InputPartition):
    def __init__(self, file: str, first: int, start: int, end: int | None, state: list | None):
        self.file, self.first, self.start, self.end, self.state = file, first, start, end, state


def _read_piece(piece: Piece) -> Iterator[pa.RecordBatch]:
    with open(piece.file, "rb") as f:
        state, at = open_state(f.read(24)) if piece.state is None else (State.load(piece.state), piece.start)
        yield from record_batches(piece.file, f, state, at, piece.end, piece.first)


def wants_fields(options: dict) -> bool:
    """Option dissect: the reader adds the fields itself, which spares the frames a way through another worker."""
    return str(options.get("dissect", "false")).lower() == "true"


class PcapReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.every, self.fields = options["path"], int(options.get("records_per_partition", GROUP)), wants_fields(options)

    def partitions(self) -> list[Piece]:
        files = _files(self.path)
        if len(files) == 1 and os.path.getsize(files[0]) < 32 << 20 and self.every == GROUP:
            return [Piece(files[0], 0, 0, None, None)]
        return [Piece(*x) for x in numbered(files, self.every)]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        found = _read_piece(partition)
        return map(with_fields, found) if self.fields else found


def last_offset(checkpoint: str) -> dict:
    """What a query had planned to read when it ended, from its checkpoint; nothing if it never ran. Spark doesn't tell
    a source where to go on before it asks how far it can go."""
    files, path = fs.FileSystem.from_uri(checkpoint)
    kept = [f for f in files.get_file_info(fs.FileSelector(f"{path}/offsets", allow_not_found=True)) if f.base_name.isdigit()]
    if not kept:
        return {}
    with files.open_input_stream(max(kept, key=lambda f: int(f.base_name)).path) as f:
        return json.loads(json.loads(f.readall().decode().strip().splitlines()[-1])["files"])


class PcapTail(DataSourceStreamReader):
    """Follows growing captures in a folder. An offset holds, per file, the end of the last whole record, the packets
    so far and the reader's state; max_bytes bounds what a file adds to one micro-batch. A query that is to go on after a
    stop names its checkpointLocation in the option checkpoint, too; it may have no other source."""

    def __init__(self, options: dict):
        self.path, self.most, self.fields = options["path"], int(options.get("max_bytes", 64 << 20)), wants_fields(options)
        self.now: dict = last_offset(options["checkpoint"]) if options.get("checkpoint") else {}

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        for file in _files(self.path):
            with open(file, "rb") as f:
                if file not in self.now:
                    try:
                        state, at = open_state(f.read(24))
                    except NotACapture:
                        continue
                    self.now[file] = [at, 0, state.dump()]
                at, n, state = self.now[file]
                walk = Walk(f, State.load(state), at)
                for _ in walk.records(payload=False):
                    n += 1
                    if walk.at - at >= self.most:
                        break
                self.now[file] = [walk.at, n, walk.state.dump()]
        return {"files": json.dumps(self.now)}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        old, new = json.loads(start["files"]), json.loads(end["files"])
        self.now = {**new, **{k: v for k, v in self.now.items() if k in new and v[0] >= new[k][0]}}
        out, first = [], sum(n for _, n, _ in old.values())  # packets are numbered as they come, over all files
        for file, (stop, n, _) in new.items():
            at, before, state = old.get(file) or (None, 0, None)
            if at is None or at < stop:
                out.append(Piece(file, first, at or 0, stop, state))
                first += n - before
        return out

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        found = _read_piece(partition)
        return map(with_fields, found) if self.fields else found

    def commit(self, end: dict) -> None:
        pass


class PcapSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pcap"

    def schema(self):
        return StructType([*PACKETS.fields, *FIELDS.fields]) if wants_fields(self.options) else PACKETS

    def reader(self, schema) -> PcapReader:
        return PcapReader(self.options)

    def streamReader(self, schema) -> PcapTail:
        return PcapTail(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PcapSource)


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """Captures of under 2 GB each from any store that Spark reads; other files give no rows."""
    import io

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for name, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                f = io.BytesIO(content.as_py())
                try:
                    state, at = open_state(f.read(24))
                except NotACapture:
                    continue
                yield from record_batches(name, f, state, at, None, 0)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = files.mapInArrow(run, PACKETS)
    if len(files.inputFiles()) < 2:
        return rows
    sizes = rows.groupBy("file").agg(F.count("*").alias("__n"))  # one row per file
    starts = sizes.select("file", (F.sum("__n").over(Window.orderBy("file")) - F.col("__n")).alias("__start"))
    return rows.join(starts, "file").withColumn("packet_no", F.col("packet_no") + F.col("__start")).select(*PACKETS.fieldNames())


class PcapWriter:
    """A little-endian capture with nanoseconds; packets of other link types than the file's are counted and left out."""

    def __init__(self, path: str, linktype: int, append: bool = False):
        self.linktype, self.packets, self.bytes, self.skipped_linktype = linktype, 0, 0, 0
        self.file = open(path, "ab" if append else "wb")  # noqa: SIM115
        if not append:
            self.file.write(b"\x4d\x3c\xb2\xa1" + struct.pack("<HHiIII", 2, 4, 0, 0, 65_535, linktype))

    def write(self, ts_nanos: int, origlen: int, linktype: int, data: bytes) -> None:
        if linktype != self.linktype:
            self.skipped_linktype += 1
            return
        sec, sub = divmod(ts_nanos, 1_000_000_000)
        self.file.write(struct.pack("<4I", sec & 0xFFFFFFFF, sub, len(data), max(origlen, len(data))) + data)
        self.packets, self.bytes = self.packets + 1, self.bytes + len(data)

    def flush(self) -> None:
        self.file.flush()

    def finish(self) -> tuple[int, int, int]:
        self.file.close()
        return self.packets, self.bytes, self.skipped_linktype


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all machines mount; in local mode, without it, one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must be set on a cluster")
        folder = tempfile.mkdtemp(prefix="netloom-")
    return folder.removeprefix("file://").removeprefix("file:")


def write_part(folder: str, rows: Iterator) -> None:
    """A partition's packets as one capture, put in place whole, so that a task may run again."""
    os.makedirs(folder, exist_ok=True)
    name, writer = f"part-{TaskContext.get().partitionId():05d}.pcap", None
    path = os.path.join(folder, f".{name}-{uuid.uuid4().hex}")
    for r in rows:
        writer = writer or PcapWriter(path, r.linktype)
        writer.write(r.ts_nanos, r.origlen, r.linktype, bytes(r.frame))
    if writer:
        writer.finish()
        os.replace(path, os.path.join(folder, name))


def export_pcap(packets: DataFrame, path: str, limit: int = 0) -> tuple[int, int, int]:
    """Write packets in order to one file on the driver, a partition at a time; the link type is the first packet's.
    No packets: no file, (0, 0, 0)."""
    rows = packets.select("packet_no", "ts_nanos", "origlen", "linktype", "frame").orderBy("packet_no")
    writer = None
    for r in (rows.limit(limit) if limit else rows).toLocalIterator(prefetchPartitions=True):
        writer = writer or PcapWriter(path, r.linktype)
        writer.write(r.ts_nanos, r.origlen, r.linktype, bytes(r.frame))
    return writer.finish() if writer else (0, 0, 0)
