"""Packet captures as a Spark source: ``spark.read.format("pcap").load(folder or file)``.

Classic pcap (micro- or nanoseconds, either byte order) and pcapng; VLAN tags are taken off, IPv4 and IPv6 kept, other
frames dropped but counted in ``frame_no``. A capture cut at its end gives its complete records; ``tails`` counts the
dropped one.

``read_captures`` cuts a file into equal splits, on any store that ``pyarrow`` opens. The task of a split guesses where its
first record begins from a chain of plausible headers and follows the headers to the split's end; the guess holds if the
split before ends there, else the split is followed again from that end. Then each task parses its split, so a file is
read twice, and no task reads one whole. Files of other stores go through ``binaryFile``, whole in one task and up to
2 GiB each. ``format("pcap")`` reads local files in ranges that the driver finds by one pass over the headers.
"""

from __future__ import annotations

import glob
import hashlib
import io
import itertools
import os
import struct
from collections.abc import Callable, Iterator
from typing import BinaryIO
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from millrace.operators.ranges import stored

SCHEMA = "capture string, frame_no bigint, ts_us bigint, src_ip string, src_port int, dst_ip string, dst_port int, proto int, wire_len int, tcp_flags int, ip_bytes binary"
VLAN = {0x8100, 0x88A8, 0x9100}


ORDERS = {b"\xd4\xc3\xb2\xa1": ("<", 1), b"\xa1\xb2\xc3\xd4": (">", 1), b"\x4d\x3c\xb2\xa1": ("<", 1000), b"\xa1\xb2\x3c\x4d": (">", 1000)}
RANGE = 64 << 20


def scan(f: BinaryIO, size: int, at: int = 0, stop: int | None = None, state: tuple | None = None, content: bool = True) -> Iterator[tuple]:
    """(start, end, state before it, record) of every complete record or block from ``at`` up to ``stop``.

    A record is (time in microseconds, length on the wire, frame), empty without ``content``, and None for blocks that
    are no packets. ``state`` is the byte order and the units of time; with it a scan can begin at any start.
    """
    if state is None:
        state = first_state(f)
        at = 24 if state[0] == "classic" else 0
    stop = size if stop is None else stop
    return (yield from (_classic if state[0] == "classic" else _pcapng)(f, size, at, stop, state, content))


def first_state(f: BinaryIO) -> tuple:
    """What a file's first bytes say of its kind, byte order and units."""
    f.seek(0)
    magic = f.read(4)
    if magic == b"\x0a\x0d\x0d\x0a":
        return ("ng", "<", ())
    if magic in ORDERS:
        return ("classic", *ORDERS[magic])
    raise ValueError("this file is no packet capture")


def _classic(f: BinaryIO, size: int, at: int, stop: int, state: tuple, content: bool) -> Iterator[tuple]:
    head = struct.Struct(state[1] + "IIII")
    while at + 16 <= size and at < stop:
        f.seek(at)
        sec, frac, kept, wire = head.unpack(f.read(16))
        end = at + 16 + kept
        if end > size:
            break
        yield at, end, state, (sec * 1_000_000 + frac // state[2], wire, f.read(kept)) if content else ()
        at = end
    return state


def _pcapng(f: BinaryIO, size: int, at: int, stop: int, state: tuple, content: bool) -> Iterator[tuple]:
    _, end, units = state
    while at + 12 <= size and at < stop:
        f.seek(at)
        head, before, record = f.read(12), ("ng", end, units), None
        if head[:4] == b"\x0a\x0d\x0d\x0a":
            end, units = ("<" if head[8:12] == b"\x4d\x3c\x2b\x1a" else ">"), ()
        block, length = struct.unpack(end + "II", head[:8])
        if length < 12 or at + length > size:
            break
        if block == 1:  # an interface: option 9 is the unit of its times
            data, unit, o = head + f.read(length - 12), 1_000_000, 16
            while o + 4 <= length - 4:
                code, n = struct.unpack_from(end + "HH", data, o)
                if code == 9 and n:
                    v = data[o + 4]
                    unit = 2 ** (v & 0x7F) if v & 0x80 else 10**v
                if code == 0:
                    break
                o += 4 + (n + 3) // 4 * 4
            units = (*units, unit)
        elif block == 6:
            record = ()
            if content:
                data = head + f.read(length - 12)
                face, hi, lo, kept, wire = struct.unpack_from(end + "IIIII", data, 8)
                record = ((hi << 32 | lo) * 1_000_000 // (units[face] if face < len(units) else 1_000_000), wire, data[28 : 28 + kept])
        yield at, at + length, before, record
        at += length
    return ("ng", end, units)


def ranges(path: str, target: int = RANGE) -> tuple[list[tuple], int]:
    """(start, stop, number of the first record, state) of each part of a file, and how many cut records end it (0 or 1)."""
    size, found, number = os.path.getsize(path), [], 0
    with open(path, "rb") as f:
        last = 0 if f.read(4) == b"\x0a\x0d\x0d\x0a" else 24
        for at, end, state, record in scan(f, size, content=False):
            if not found or at - found[-1][0] >= target:
                found.append((at, number, state))
            number, last = number + (record is not None), end
    stops = [x[0] for x in found[1:]] + [last]
    return [(at, stop, no, state) for (at, no, state), stop in zip(found, stops, strict=bool(found))], int(size > last)


def ip_packet(frame: bytes) -> tuple | None:
    """(src_ip, src_port, dst_ip, dst_port, proto, tcp flags, IP bytes) of an Ethernet frame, None if it holds no IP."""
    if len(frame) < 14:
        return None
    at, kind = 14, int.from_bytes(frame[12:14], "big")
    while kind in VLAN and len(frame) >= at + 4:
        kind, at = int.from_bytes(frame[at + 2 : at + 4], "big"), at + 4
    ip = frame[at:]
    if kind == 0x0800 and len(ip) >= 20 and ip[0] >> 4 == 4:
        start, proto = (ip[0] & 15) * 4, ip[9]
        src, dst = (".".join(map(str, ip[i : i + 4])) for i in (12, 16))
    elif kind == 0x86DD and len(ip) >= 40 and ip[0] >> 4 == 6:
        start, proto = 40, ip[6]
        src, dst = (_ipv6(ip[i : i + 16]) for i in (8, 24))
    else:
        return None
    ports = proto in (6, 17) and len(ip) >= start + 4
    sport, dport = (int.from_bytes(ip[start : start + 2], "big"), int.from_bytes(ip[start + 2 : start + 4], "big")) if ports else (0, 0)
    flags = ip[start + 13] if proto == 6 and len(ip) > start + 13 else 0
    return src, sport, dst, dport, proto, flags, ip


def _ipv6(b: bytes) -> str:
    import ipaddress

    return str(ipaddress.IPv6Address(b))


def packet_rows(name: str, f: BinaryIO, size: int, at: int = 0, stop: int | None = None, number: int = 0, state: tuple | None = None) -> Iterator[tuple]:
    for _, _, _, record in scan(f, size, at, stop, state):
        if record is not None:
            p = ip_packet(record[2])
            if p:
                yield (name, number, record[0], p[0], p[1], p[2], p[3], p[4], record[1], p[5], bytes(p[6]))
            number += 1


def range_rows(name: str, path: str, at: int, stop: int, number: int, state: tuple) -> Iterator[tuple]:
    with open(path, "rb") as f:
        yield from packet_rows(name, f, os.path.getsize(path), at, stop, number, state)


class _Range(InputPartition):
    def __init__(self, path: str, part: tuple):
        self.path, self.part = path, part


class PcapReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.options = options["path"], options

    def partitions(self) -> list[InputPartition]:
        files = sorted(glob.glob(os.path.join(self.root, "*.pcap*"))) if os.path.isdir(self.root) else [self.root]
        size = int(self.options.get("rangeBytes", RANGE))
        return [_Range(f, part) for f in files for part in ranges(f, size)[0]]

    def read(self, partition: _Range) -> Iterator[tuple]:
        name = os.path.basename(partition.path).split(".")[0]
        yield from range_rows(name, partition.path, *partition.part)


class PcapDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pcap"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PcapReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PcapDataSource)


#: Schemes whose files ``pyarrow`` opens at any place; others are read whole by ``binaryFile``.
SEEKABLE = ("file", "s3", "s3a", "gs", "gcs", "abfs", "abfss", "hdfs", "viewfs")
BUFFER = 1 << 20
#: What a guess takes for a record: at most this long, and this many in a row; how many guesses a split is worth.
LARGEST, CHAIN, TRIES = 1 << 18, 6, 20


def _files(spark: SparkSession, path: str) -> tuple[DataFrame, bool]:
    """The ``binaryFile`` table and whether tasks can open all its files at any place; its contents stay unread."""
    files = spark.read.format("binaryFile").load(path)
    return files, not files.where(~F.substring_index("path", ":", 1).isin(*SEEKABLE)).limit(1).count()


def open_uri(uri: str) -> tuple[BinaryIO, int]:
    """A file of any store that ``pyarrow`` knows, buffered, and its size."""
    scheme, _, rest = uri.partition(":")
    where, path = (fs.LocalFileSystem(), "/" + unquote(rest).lstrip("/")) if scheme == "file" else fs.FileSystem.from_uri("s3:" + rest if scheme == "s3a" else uri)
    f = where.open_input_file(path)
    return io.BufferedReader(f, BUFFER), f.size()  # type: ignore[arg-type]


def _numbers(data: bytes, order: str) -> np.ndarray:
    """The 32-bit number that begins at each byte."""
    b = np.frombuffer(data, np.uint8).astype(np.int64)
    parts = (b[:-3], b[1:-2], b[2:-1], b[3:])
    return sum(x << (8 * i) for i, x in enumerate(parts if order == "<" else parts[::-1]))


def guess_start(f: BinaryIO, size: int, lo: int, hi: int, state: tuple) -> tuple[int, str] | None:
    """Where a chain of plausible records begins in [lo, hi), and their byte order; only a guess."""
    f.seek(lo)
    data = f.read(BUFFER)
    whole = lo + len(data) >= size
    for order in ("<", ">") if state[0] == "ng" else (state[1],):
        v = _numbers(data, order) if len(data) >= 16 else np.empty(0, np.int64)
        n = max(len(v) - 12, 0)
        if state[0] == "classic":
            kept = v[8 : 8 + n]
            step, ok = kept + 16, (v[4 : 4 + n] < 1_000_000 * state[2]) & (kept > 0) & (kept <= LARGEST) & (v[12 : 12 + n] >= kept)
        else:  # a block's length stands at both its ends
            step, at = v[4 : 4 + n], np.arange(n)
            again = at + step - 4
            ok = (v[:n] > 0) & (v[:n] <= 6) & (step >= 12) & (step % 4 == 0) & (step <= LARGEST) & ((at + lo) % 4 == 0)
            ok &= (again >= len(v)) | (v[np.minimum(again, len(v) - 1)] == step) if n else ok
        for first in np.flatnonzero(ok[: hi - lo]).tolist():
            place, links = first, 0
            while links < CHAIN and place < n and ok[place]:
                place, links = place + int(step[place]), links + 1
            if links == CHAIN or (links and (lo + place == size if whole else place >= n)):
                return lo + first, order
    return None


def scan_split(f: BinaryIO, size: int, lo: int, hi: int, start: int | None = None, order: str | None = None) -> dict:
    """What the records that begin in [lo, hi) come to: their start and end, their number, the interfaces they declare.

    Without ``start`` it is guessed, -1 if nothing looks like a record. A start outside [lo, hi) means that no record
    begins there. ``reset`` says that a section began, which forgets the interfaces before it.
    """
    state, at = first_state(f), lo
    if start is not None or not lo:
        return _follow(f, size, lo, hi, (24 if state[0] == "classic" else 0) if start is None else start, order, state)
    for _ in range(TRIES):
        guess = guess_start(f, size, at, hi, state)
        if guess is None:
            break
        found = _follow(f, size, lo, hi, *guess, state)
        if found["end"] >= min(hi, size - 16):
            return found
        at = max(found["end"], guess[0] + 1)  # the chain breaks off: it was no chain of records, or the file is cut
    return _follow(f, size, lo, hi, -1, None, state)


def _follow(f: BinaryIO, size: int, lo: int, hi: int, start: int, order: str | None, state: tuple) -> dict:
    order = state[1] if state[0] == "classic" else order or "<"
    out = {"start": start, "end": start, "records": 0, "order_before": order, "order": order, "units": [], "reset": False}
    if not lo <= start < hi:
        return out
    records = scan(f, size, start, hi, state if state[0] == "classic" else ("ng", order, (-1,)), content=False)
    while True:
        try:
            _, out["end"], _, record = next(records)
        except StopIteration as done:
            after = done.value
            break
        out["records"] += record is not None
    if after[0] == "ng":  # -1 stands for the interfaces before the split
        out |= {"order": after[1], "reset": after[2][:1] != (-1,), "units": [u for u in after[2] if u != -1]}
    return out


_PLACE = "path string, capture string, length bigint, split bigint"
_FOUND = "start bigint, end bigint, records bigint, order_before string, order string, units array<bigint>, reset boolean"
_FOUND_ARROW = pa.schema([("path", pa.string()), ("capture", pa.string()), ("length", pa.int64()), ("split", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("records", pa.int64()), ("order_before", pa.string()), ("order", pa.string()), ("units", pa.list_(pa.int64())), ("reset", pa.bool_())])


def capture_splits(files: DataFrame, range_bytes: int = RANGE, open_file: Callable[[str], tuple[BinaryIO, int]] = open_uri) -> DataFrame:
    """The splits of capture files (path, length), each with start, end, number of records and state before it.

    Guessed starts are held against the end of the split before until all agree, so the result is that of one pass over
    each file. Splits that one long record covers, or that lie behind a broken record, are settled together.
    """
    name = F.regexp_extract("path", r"([^/]+?)(\.[^/]*)?$", 1).alias("capture")
    splits = files.select("path", name, "length", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.ceil(F.col("length") / range_bytes) - 1, F.lit(0)).cast("bigint"))).alias("split"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                f, size = open_file(r["path"])
                with f:
                    found = scan_split(f, size, r["split"] * range_bytes, (r["split"] + 1) * range_bytes, r.get("want"), r.get("want_order"))
                yield pa.RecordBatch.from_pylist([{k: r[k] for k in ("path", "capture", "length", "split")} | found], schema=_FOUND_ARROW)

    def spread(rows: DataFrame, number: int) -> DataFrame:
        return rows.repartition(max(number, 1)).mapInArrow(look, f"{_PLACE}, {_FOUND}")

    found = stored(spread(splits, splits.count()))
    by = W.partitionBy("path").orderBy("split")
    odd = (F.col("split") > 0) & ((F.col("start") != F.col("want")) | (F.col("end") > F.col("start")) & (F.col("order_before") != F.col("want_order")))
    every = W.partitionBy("path")
    while True:
        checked = found.withColumns({"want": F.lag("end").over(by), "want_order": F.lag("order").over(by)}).withColumn("odd", odd)
        number = checked.where("odd").count()
        if not number:
            break
        first = checked.withColumn("at", F.min(F.when(F.col("odd"), F.col("split"))).over(every))
        first = first.withColumns({"to": F.max(F.when(F.col("split") == F.col("at"), F.col("want"))).over(every), "to_order": F.max(F.when(F.col("split") == F.col("at"), F.col("want_order"))).over(every)})
        bare = F.coalesce((F.col("split") >= F.col("at")) & ((F.col("to") < F.col("at") * range_bytes) | (F.col("to") >= (F.col("split") + 1) * range_bytes)), F.lit(False))
        marked = stored(first.withColumn("todo", F.when(bare, "bare").when(F.col("odd") & (F.col("want") >= 0), "again").otherwise("keep")))
        columns = found.columns
        empty = {"start": F.col("to"), "end": F.col("to"), "records": F.lit(0).cast("bigint"), "order_before": F.col("to_order"), "order": F.col("to_order"), "units": F.array().cast("array<bigint>"), "reset": F.lit(False)}
        parts = marked.where("todo = 'keep'").select(columns).unionByName(marked.where("todo = 'bare'").withColumns(empty).select(columns))
        again = marked.where("todo = 'again'").select(*columns[:4], "want", "want_order")
        found = stored(parts.unionByName(spread(again, number)))
    before = by.rowsBetween(W.unboundedPreceding, -1)
    told = F.collect_list(F.when(F.col("reset") | (F.size("units") > 0), F.struct("reset", "units"))).over(before)  # few splits declare interfaces
    known = F.aggregate(told, F.array().cast("array<bigint>"), lambda have, x: F.when(x["reset"], x["units"]).otherwise(F.concat(have, x["units"])))
    return found.select("path", "capture", "length", "split", "start", "end", "records", F.coalesce(F.sum("records").over(before), F.lit(0)).alias("number"), F.col("order_before").alias("order"), known.alias("units"))


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    while part := list(itertools.islice(rows, 10_000)):
        yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in part], schema=_ARROW)


def read_captures(spark: SparkSession, path: str, range_bytes: int = RANGE, open_file: Callable[[str], tuple[BinaryIO, int]] = open_uri) -> DataFrame:
    """Packets of capture files; one task reads about ``range_bytes``, or a file of a store that only Spark opens."""
    files, seekable = _files(spark, path)

    def parse_splits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                f, size = open_file(r["path"])
                with f:
                    state = first_state(f)
                    state = state if state[0] == "classic" else ("ng", r["order"], tuple(r["units"]))
                    yield from _batches(packet_rows(r["capture"], f, size, r["start"], r["end"], r["number"], state))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for capture, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                content = data.as_py()
                yield from _batches(packet_rows(capture, io.BytesIO(content), len(content)))

    if not seekable:
        return files.select(F.regexp_extract("path", r"([^/]+?)(\.[^/]*)?$", 1).alias("capture"), "content").mapInArrow(parse, SCHEMA)
    splits = stored(capture_splits(files.select("path", "length"), range_bytes, open_file))
    return splits.where("records > 0").repartition(max(splits.count(), 1)).mapInArrow(parse_splits, SCHEMA)


def tails(spark: SparkSession, path: str, range_bytes: int = RANGE, open_file: Callable[[str], tuple[BinaryIO, int]] = open_uri) -> DataFrame:
    """(path, dropped): how many cut records, 0 or 1, end each file; files of other stores are an error."""
    files, seekable = _files(spark, path)
    if not seekable:
        raise ValueError("tails reads files only where pyarrow opens them")
    splits = capture_splits(files.select("path", "length"), range_bytes, open_file)
    return splits.groupBy("path").agg((F.max("end") < F.max("length")).cast("int").alias("dropped"))


_ARROW = pa.schema([("capture", pa.string()), ("frame_no", pa.int64()), ("ts_us", pa.int64()), ("src_ip", pa.string()), ("src_port", pa.int32()), ("dst_ip", pa.string()), ("dst_port", pa.int32()), ("proto", pa.int32()), ("wire_len", pa.int32()), ("tcp_flags", pa.int32()), ("ip_bytes", pa.binary())])


def fingerprints(spark: SparkSession, path: str, edge: int = 4 << 20, open_file: Callable[[str], tuple[BinaryIO, int]] = open_uri) -> DataFrame:
    """K3: (path, fingerprint): SHA-256 over a file's name, size, first and last 4 MiB."""
    files, seekable = _files(spark, path)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    if seekable:

        def edges(where: str, size: int) -> str:
            f, _ = open_file(where)
            with f:
                digest = hashlib.sha256(f"{where.rsplit('/', 1)[-1]}|{size}".encode() + f.read(edge))
                f.seek(max(size - edge, 0))
                digest.update(f.read(edge))
            return digest.hexdigest()

        return files.select("path", "length", F.udf(edges, "string")("path", "length").alias("fingerprint"))
    head, tail = F.substring("content", 1, edge), F.substring("content", F.greatest(F.length("content") - edge, F.lit(0)) + 1, F.lit(edge))
    return files.select("path", "length", F.sha2(F.concat(F.concat_ws("|", name, F.col("length").cast("string")).cast("binary"), head, tail), 256).alias("fingerprint"))
