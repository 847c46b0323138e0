"""Packet sources.

* read_ts: transport-stream files by byte ranges, aligned or realigned
* packets_from_raw: a table of 188-byte packets
* packets_from_chunks: a table of chunks cut anywhere, realigned to packets
* TransportStreamSource: the Python data source ("transport_stream") of read_ts
* write_ts: packets as files again
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tsloom.functions.wire import PACKET, PACKETS_SQL, SYNC, decode_packets
from tsloom.operators.ordered import ordered_fold

CONFIRM = 3 * PACKET
LOSSES_SQL = "stream_id string, before_packet_no long, bytes_discarded long"


class Realigner:
    """Finds packets in bytes that come in pieces: a start counts once sync bytes recur at three strides."""

    def __init__(self) -> None:
        self.held, self.aligned, self.packets = b"", False, 0

    def feed(self, data: bytes) -> tuple[list[bytes], list[tuple[int, int]]]:
        """Runs of whole packets and losses (packets before, bytes skipped)."""
        buffer, at = self.held + data, 0
        found, losses = [], []
        while True:
            if not self.aligned:
                begin = at
                while at + CONFIRM <= len(buffer) and not buffer[at] == buffer[at + PACKET] == buffer[at + 2 * PACKET] == SYNC:
                    nxt = buffer.find(b"\x47", at + 1, len(buffer) - CONFIRM + 1)
                    at = nxt if nxt > 0 else len(buffer) - CONFIRM + 1
                if at > begin:
                    losses.append((self.packets, at - begin))
                if at + CONFIRM > len(buffer):
                    break
                self.aligned = True
            stop = at
            while stop + PACKET <= len(buffer) and buffer[stop] == SYNC:
                stop += PACKET
            if stop > at:
                found.append(buffer[at:stop])
                self.packets += (stop - at) // PACKET
                at = stop
            if at + PACKET > len(buffer):
                break
            self.aligned = False
        self.held = buffer[at:]
        return found, losses


class _ChunkFold:
    def __init__(self, key: tuple):
        self.stream_id, self.align, self.next = key[0], Realigner(), 0

    def step(self, row: dict) -> list[dict]:
        runs, losses = self.align.feed(row["data"] or b"")
        out = [{"stream_id": self.stream_id, "first": None, "raw": None, "lost_before": n, "lost": k} for n, k in losses]
        for raw in runs:
            out.append({"stream_id": self.stream_id, "first": self.next, "raw": raw, "lost_before": None, "lost": None})
            self.next += len(raw) // PACKET
        return out

    def end(self) -> list[dict]:
        return []


def _decode_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs (stream_id, first, raw) of whole packets to packet rows; the runs of a batch are decoded together, as most may be of one packet."""
    for batch in batches:
        raws = batch.column("raw").to_pylist()
        counts = np.array([len(r) // PACKET for r in raws], np.int64)
        raw = np.frombuffer(b"".join(r[: n * PACKET] for r, n in zip(raws, counts.tolist(), strict=True)), np.uint8)
        run = np.repeat(np.arange(len(raws)), counts)
        numbers = batch.column("first").to_numpy(zero_copy_only=False)[run] + np.arange(len(run)) - (np.cumsum(counts) - counts)[run]
        streams = batch.column("stream_id").cast(pa.string())
        for lo in range(0, len(run), 10000):
            some = slice(lo, lo + 10000)
            yield decode_packets(raw[lo * PACKET : (lo + 10000) * PACKET], numbers[some], streams.take(pa.array(run[some])))


def packets_from_chunks(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(packets, sync_losses) of chunks (stream_id, chunk_no, data), realigned in order for each stream."""
    runs = ordered_fold(chunks.select("stream_id", "chunk_no", "data"), ["stream_id"], "chunk_no", _ChunkFold, "stream_id string, first long, raw binary, lost_before long, lost long")
    packets = runs.filter("raw IS NOT NULL").select("stream_id", "first", "raw").mapInArrow(_decode_runs, PACKETS_SQL)
    return packets, runs.filter("lost IS NOT NULL").select("stream_id", F.col("lost_before").alias("before_packet_no"), F.col("lost").alias("bytes_discarded"))


def packets_from_raw(raw: DataFrame, with_payload: bool = True) -> DataFrame:
    """Packets of a table (stream_id, packet_no, raw); rows that aren't packets of 188 bytes with a sync byte go."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            data = pa.concat_arrays([batch.column(2)])
            _, offsets, body = data.buffers()
            offsets = np.frombuffer(offsets, np.int32)[data.offset : data.offset + len(data) + 1]
            block = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]]
            yield decode_packets(block, batch.column(1).to_numpy(zero_copy_only=False), batch.column(0).cast(pa.string()), with_payload)

    whole = raw.filter(F.octet_length("raw") == PACKET).select("stream_id", F.col("packet_no").cast("long").alias("packet_no"), F.col("raw").cast("binary").alias("raw"))
    return whole.mapInArrow(decode, PACKETS_SQL)


def read_ts(spark: SparkSession, path: str, stream_id: str | None = None, realign: bool = False, bytes_per_task: int = 64 << 20) -> DataFrame | tuple[DataFrame, DataFrame]:
    """Packets of the files at path, at fixed strides from byte 0; with realign (packets, sync_losses) of files that may start or break anywhere.

    Either way files are read by byte ranges, so one large file is many tasks,
    and bytes behind the last whole packet are left out.  Without a stream_id
    each file is a stream of its own, called by its path.
    """
    if realign:
        return _realigned(spark, path, stream_id, bytes_per_task)
    register(spark)
    options = {"bytes_per_task": bytes_per_task} | ({"stream_id": stream_id} if stream_id else {})
    return spark.read.format("transport_stream").options(**options).load(path)


def _filesystem(path: str):
    """(file system, path in it): local, or by URI what pyarrow knows; for other stores read chunks with Spark and take packets_from_chunks."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9+.-]+:/", path) else (fs.LocalFileSystem(), path)


def _files(path: str) -> list:
    from pyarrow import fs

    where, at = _filesystem(path)
    info = where.get_file_info(at)
    found = [info] if info.is_file else where.get_file_info(fs.FileSelector(at, recursive=True))
    return [f for f in found if f.is_file and not f.base_name.startswith(("_", "."))]


def write_ts(raw: DataFrame, path: str, tail: bytes = b"") -> None:
    """Writes the packets (stream_id, packet_no, raw) of each stream in order as one file, path/stream_id.ts, and the tail behind them."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, top = _filesystem(path)
        where.create_dir(top, recursive=True)
        now, file, part = None, None, f"_{uuid.uuid4().hex}"

        def close() -> None:
            if file is not None:
                file.write(tail)
                file.close()
                where.move(f"{top}/{part}", f"{top}/{now}.ts")  # whole or not at all, also where a task is repeated

        for batch in batches:
            streams = batch.column(0).to_pylist()
            for stream, data in zip(streams, batch.column(1), strict=True):
                if stream != now:
                    close()
                    now, file = stream, where.open_output_stream(f"{top}/{part}")
                file.write(data.as_buffer())
        close()
        yield from ()

    raw.select("stream_id", "packet_no", "raw").repartition("stream_id").sortWithinPartitions("stream_id", "packet_no").select("stream_id", "raw").mapInArrow(write, "done int").count()


def _walk(data: np.ndarray, at: int, aligned: bool, end: int, last: bool) -> tuple[list[tuple[int, int]], list[tuple[int, int]], int, bool]:
    """Runs (start, packets) and gaps (packets before, bytes) of packets that begin before end; then the next place and whether it is aligned.

    data goes on CONFIRM bytes past end, unless the file ends (last).  The rule
    is Realigner's: a place counts once sync bytes recur at three strides.
    """
    runs, gaps, number = [], [], 0
    while at < end:
        if not aligned:
            stop = min(end, len(data) - CONFIRM + 1)
            places = at + np.flatnonzero(data[at:stop] == SYNC) if stop > at else np.zeros(0, np.int64)
            places = places[(data[places + PACKET] == SYNC) & (data[places + 2 * PACKET] == SYNC)]
            to = int(places[0]) if len(places) else max(at, stop)
            if to > at:
                gaps.append((number, to - at))
            at = to
            if not len(places):
                return runs, gaps, at, False
            aligned = True
        beats = data[at:end:PACKET] == SYNC
        n = int(np.argmin(beats)) if not beats.all() else len(beats)
        n = min(n, (len(data) - at) // PACKET)
        if n:
            runs.append((at, n))
            number += n
            at += n * PACKET
        if at + PACKET > len(data) and last:
            break
        aligned = at >= end
    return runs, gaps, at, aligned


def _bytes(path: str, begin: int, end: int) -> np.ndarray:
    where, at = _filesystem(path)
    with where.open_input_file(at) as file:
        file.seek(begin)
        return np.frombuffer(file.read(end - begin), np.uint8)


_RANGE = "path string, k int, begin long, stop long, size long, at long, aligned boolean"


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where the walk through each range meets its first packet, how many it has and where it leaves."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            data = _bytes(r["path"], r["begin"], min(r["size"], r["stop"] + CONFIRM))
            runs, _, at, aligned = _walk(data, r["at"] - r["begin"], r["aligned"], r["stop"] - r["begin"], r["stop"] + CONFIRM >= r["size"])
            out.append({"path": r["path"], "k": r["k"], "first": r["begin"] + runs[0][0] if runs else None, "packets": sum(n for _, n in runs), "left_at": r["begin"] + at, "left_aligned": aligned})
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("path", pa.string()), ("k", pa.int32()), ("first", pa.int64()), ("packets", pa.int64()), ("left_at", pa.int64()), ("left_aligned", pa.bool_())]))


def _realigned(spark: SparkSession, path: str, stream_id: str | None, step: int) -> tuple[DataFrame, DataFrame]:
    """Ranges are walked at once as if each began unaligned; one that the range before enters elsewhere is walked again from there.

    The driver sees a few numbers for each range.
    """
    scheme = path[: path.index("://") + 3] if "://" in path and not path.startswith("file:") else ""
    step = max(step // PACKET, 4) * PACKET
    ranges = [{"path": scheme + f.path, "k": k, "begin": at, "stop": min(f.size, at + step), "size": f.size, "at": at, "aligned": False} for f in _files(path) for k, at in enumerate(range(0, f.size, step))]
    found: dict[tuple, dict] = {}
    todo = ranges
    while todo:
        table = spark.createDataFrame([tuple(r.values()) for r in todo], _RANGE).repartition(len(todo))
        for r in table.mapInArrow(_walked, "path string, k int, first long, packets long, left_at long, left_aligned boolean").collect():
            found[r["path"], r["k"]] = r.asDict()
        todo = []
        for r in ranges:
            before = found.get((r["path"], r["k"] - 1))
            if before is None:
                continue
            enters = (before["left_at"], before["left_aligned"])
            # Entering where the walk found its first packet by itself is the same walk; so is a search that goes on.
            if enters != (r["at"], r["aligned"]):
                same = enters[1] and not r["aligned"] and found[r["path"], r["k"]]["first"] == enters[0] or not enters[1] and not r["aligned"] and enters[0] == r["begin"]
                r["at"], r["aligned"] = enters
                if not same:
                    todo.append(r)
    number: dict[str, int] = {}
    rows = []
    for r in ranges:
        rows.append((*r.values(), number.get(r["path"], 0), stream_id or r["path"]))
        number[r["path"]] = number.get(r["path"], 0) + found[r["path"], r["k"]]["packets"]
    schema = f"{_RANGE}, number long, stream_id string"
    table = spark.createDataFrame(rows, schema).repartition(max(1, len(rows)))

    def walk(r: dict):
        data = _bytes(r["path"], r["begin"], min(r["size"], r["stop"] + CONFIRM))
        return data, *_walk(data, r["at"] - r["begin"], r["aligned"], r["stop"] - r["begin"], r["stop"] + CONFIRM >= r["size"])[:2]

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                data, runs, _ = walk(r)
                number = r["number"]
                for at, n in runs:
                    for lo in range(0, n, 10000):
                        k = min(10000, n - lo)
                        yield decode_packets(data[at + lo * PACKET : at + (lo + k) * PACKET], number + lo + np.arange(k), pa.array([r["stream_id"]] * k, pa.string()))
                    number += n

    def lost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [{"stream_id": r["stream_id"], "before_packet_no": r["number"] + n, "bytes_discarded": k} for r in batch.to_pylist() for n, k in walk(r)[2]]
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("stream_id", pa.string()), ("before_packet_no", pa.int64()), ("bytes_discarded", pa.int64())]))

    # A gap that spans ranges is one loss.
    losses = table.mapInArrow(lost, LOSSES_SQL).groupBy("stream_id", "before_packet_no").agg(F.sum("bytes_discarded").alias("bytes_discarded"))
    return table.mapInArrow(decoded, PACKETS_SQL), losses


class _Range(InputPartition):
    def __init__(self, path: str, begin: int, end: int):
        self.path, self.begin, self.end = path, begin, end


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.stream_id = options["path"], options.get("stream_id")
        self.step = max(1, int(options.get("bytes_per_task", 64 << 20)) // PACKET) * PACKET
        self.payload = str(options.get("payload", "true")).lower() != "false"

    def partitions(self) -> list[InputPartition]:
        whole = [(f.path, f.size // PACKET * PACKET) for f in _files(self.path)]
        return [_Range(path, at, min(size, at + self.step)) for path, size in whole for at in range(0, size, self.step)] or [_Range("", 0, 0)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        if part.begin == part.end:
            return
        where, _ = _filesystem(self.path)
        with where.open_input_file(part.path) as file:
            file.seek(part.begin)
            for at in range(part.begin, part.end, 10000 * PACKET):
                raw = np.frombuffer(file.read(min(10000 * PACKET, part.end - at)), np.uint8)
                n = len(raw) // PACKET
                yield decode_packets(raw[: n * PACKET], at // PACKET + np.arange(n), pa.array([self.stream_id or part.path] * n, pa.string()), self.payload)


class TransportStreamSource(DataSource):
    """spark.read.format("transport_stream").option("payload", "false").load(path)"""

    @classmethod
    def name(cls) -> str:
        return "transport_stream"

    def schema(self) -> str:
        return PACKETS_SQL

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TransportStreamSource)
